"""Vector search: recall by cosine, re-ranking, final order; pluggable encoders.

Neither side is collected. Both are packed into rows that hold a block of vectors each; every pair of blocks is one row of a join
in blocks, of which each query keeps its best k before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries and index rows per packed row; of 64-dimensional doubles a quarter and a whole megabyte.
BLOCK, PACK = 512, 2048


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of doubles; rows must be of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _packed(df: DataFrame, cols: list[str], emb_col: str, size: int, prefix: str) -> DataFrame:
    """Blocks of at most ``size`` rows: arrays of the columns, the vectors as one binary matrix of doubles, their length. Null and empty vectors are left out."""
    fields = [T.StructField(f"{prefix}{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(cols)]
    schema = T.StructType([*fields, T.StructField(f"{prefix}m", T.BinaryType()), T.StructField(f"{prefix}dim", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(len(cols)).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), size):
                    part = b.take(pa.array(at[lo : lo + size]))
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in range(len(cols))]
                    m = _matrix(part.column(len(cols)))
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([m.tobytes()], pa.binary()), pa.array([int(d)], pa.int32())], names=schema.names)

    return df.filter(F.size(emb_col) > 0).select(*cols, emb_col).mapInArrow(run, schema)


def cosine_topk(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", emb_col: str = "embedding", query_id: str = "query_id", exclude_self: bool = False, per: str | None = None) -> DataFrame:
    """The ``k`` index rows nearest to each query by dot product of unit vectors, ties by id: (query_id, id, score, rank).

    Null vectors are left out; a query meets vectors of its own length only. ``queries`` has ``query_id`` and ``emb_col``. ``per`` names a
    column of the index for each of whose values every query gets its own ``k`` rows (null is a value of its own); it comes out as well.
    Of each pair of blocks only the best k per query (and value) leave the task, so what is shuffled is not the product.
    """
    by = [per] if per else []
    ix = _packed(index, [id_col, *by], emb_col, PACK, "_i")
    qs = _packed(queries, [query_id], emb_col, BLOCK, "_q")
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, index.schema[id_col].dataType), *[index.schema[c] for c in by], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = col["_idim"][r].as_py()
                if dim != col["_qdim"][r].as_py():
                    continue
                own, ids = col["_i0"][r].values, col["_q0"][r].values
                m = np.frombuffer(col["_im"][r].as_buffer(), dtype=np.float64).reshape(-1, dim)
                q = np.frombuffer(col["_qm"][r].as_buffer(), dtype=np.float64).reshape(-1, dim)
                s = q @ m.T
                own_np, ids_np = own.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                if exclude_self:
                    s[ids_np[:, None] == own_np[None, :]] = -np.inf
                groups = [np.arange(len(own_np))]
                if per:
                    codes = np.asarray(col["_i1"][r].values.dictionary_encode(null_encoding="encode").indices)
                    groups = [np.flatnonzero(codes == c) for c in np.unique(codes)]
                rows, cols = [], []
                for g in groups:
                    part = s[:, g]
                    if len(g) > k:  # all that tie at the k-th place stay until ids decide
                        least = np.partition(part, -k, axis=1)[:, -k]
                        x, y = np.nonzero(part >= least[:, None])
                    else:
                        x, y = (v.ravel() for v in np.indices(part.shape))
                    y = g[y]
                    order = np.lexsort((own_np[y], -s[x, y], x))
                    x, y = x[order], y[order]
                    first = np.searchsorted(x, x)  # position of the query's first row
                    keep = (np.arange(len(x)) - first < k) & np.isfinite(s[x, y])
                    rows.append(x[keep])
                    cols.append(y[keep])
                x, y = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), own.take(pa.array(y)), *([col["_i1"][r].values.take(pa.array(y))] if per else []), pa.array(s[x, y])], names=schema.names)

    # a stated set of queries against all rows, block by block
    out = ix.crossJoin(qs).mapInArrow(score, schema)
    w = Window.partitionBy(query_id, *by).orderBy(F.desc("score"), F.col(id_col))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pool_sizes(rerank_k: int | None, recall_k: int | None, default_rerank: int = 15, default_recall: int = 100) -> tuple[int, int]:
    """Sizes of the two stages: none or 0 means the default; the first stage is never smaller than the second."""
    k = rerank_k or default_rerank
    return max(recall_k or default_recall, k), k


def rerank(cands: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query_text: str, doc_text: str, k: int, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Score (query, document) texts in Arrow batches and keep the best ``k`` per query, ties by id."""
    score = F.pandas_udf(scorer, T.DoubleType())
    w = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), F.col(id_col))
    return cands.withColumn("rerank_score", score(F.coalesce(query_text, F.lit("")), F.coalesce(doc_text, F.lit("")))).withColumn("rel_rank", F.row_number().over(w)).filter(F.col("rel_rank") <= k)


def sort_results(df: DataFrame, by: str = "relevance", query_id: str = "query_id", citations: str = "citation_count") -> DataFrame:
    """Final order of the kept rows: by relevance, or by citations with relevance deciding ties; adds ``rank`` from 1."""
    if by not in ("relevance", "citations"):
        raise ValueError(f"unknown order: {by}")
    order = [F.col("rel_rank")] if by == "relevance" else [F.coalesce(citations, F.lit(0)).desc(), F.col("rel_rank")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))


def hashed_tf(text: pd.Series, dim: int = 256) -> list[np.ndarray]:
    """Unit-length hashed term frequencies: the offline stand-in for a neural encoder."""
    out = []
    for t in text:
        v = np.zeros(dim)
        for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
            v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dim] += 1
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return out


def embed(df: DataFrame, text_col: str, encoder: Callable[[pd.Series], list[np.ndarray]] = hashed_tf, out_col: str = "embedding") -> DataFrame:
    """Adds an embedding to the same row, which keeps vectors and metadata aligned. Null text is encoded as the empty one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([v.astype(np.float32) for v in encoder(s)])

    return df.withColumn(out_col, run(F.coalesce(text_col, F.lit(""))))


def overlap_score(query: pd.Series, doc: pd.Series) -> pd.Series:
    """Share of the query's words that the document holds, in [0, 1]: the offline stand-in for a cross-encoder."""
    def one(q: str, d: str) -> float:
        a, b = set(re.findall(r"[a-z0-9]+", q.lower())), set(re.findall(r"[a-z0-9]+", d.lower()))
        return len(a & b) / len(a) if a else 0.0

    return pd.Series([one(q, d) for q, d in zip(query, doc, strict=True)], dtype="float64")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", words: str = "words", query_id: str = "query_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` documents with the highest BM25 score for each query, ties by id: (query_id, id, score, rank).

    ``docs``: (id, words), ``queries``: (query_id, words), both arrays of words. Documents without a word of the query don't come out. Only
    the postings of words that queries ask for are joined; a query's word counts once.
    """
    n = docs.select(id_col, F.size(words).alias("len")).filter(F.col("len") > 0)
    total = n.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    asked = queries.select(query_id, F.explode(F.array_distinct(words)).alias("word"))
    post = docs.select(id_col, F.size(words).alias("len"), F.explode(words).alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy(id_col, "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = post.join(df, "word").crossJoin(total).select(id_col, "word", (idf * norm).alias("s"))
    scored = asked.join(weighed, "word").groupBy(query_id, id_col).agg(F.sum("s").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), F.col(id_col))  # sums of one set of terms may differ in the last digits
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def eligible(index: DataFrame, domain: str | None = None, years: Sequence[int] | None = None, domains: Sequence[str] = (), year_col: str = "pub_year", domain_col: str = "domain") -> DataFrame:
    """Index rows of one domain (none means all; one that isn't among ``domains`` raises) and of the years (an empty list means all)."""
    if domain is not None and domains and domain not in domains:
        raise ValueError(f"unknown domain: {domain}")
    out = index if domain is None else index.filter(F.col(domain_col) == domain)
    return out.filter(F.col(year_col).isin(list(years))) if years else out


class SearchEngine:
    """Two-stage search over an index of (id, text, embedding, filters): recall, re-rank, order."""

    def __init__(self, index: DataFrame, encoder=hashed_tf, scorer=overlap_score, id_col: str = "arxiv_id", text_col: str = "text", domains: tuple[str, ...] = (), year_col: str = "pub_year", domain_col: str = "domain"):
        self.index, self.encoder, self.scorer, self.id_col, self.text_col = index, encoder, scorer, id_col, text_col
        self.domains, self.year_col, self.domain_col = domains, year_col, domain_col

    def search(self, query: str, domain: str | None = None, years: list[int] | None = None, sort_by: str = "relevance", rerank_k: int | None = None, recall_k: int | None = None) -> DataFrame:
        """Results as rows with ``rank``; an unknown domain raises, an empty list of years means all, a blank query gives no rows."""
        pool, k = pool_sizes(rerank_k, recall_k)
        docs = eligible(self.index, domain, years, self.domains, self.year_col, self.domain_col)
        if not query.strip():
            docs = docs.filter(F.lit(False))
        q = docs.sparkSession.createDataFrame([(0, self.encoder(pd.Series([query]))[0].tolist())], "query_id int, embedding array<double>")
        hits = cosine_topk(docs, q, pool, id_col=self.id_col)
        got = hits.drop("rank").join(docs.drop("embedding"), self.id_col).withColumn("query", F.lit(query))
        return sort_results(rerank(got, self.scorer, "query", self.text_col, k, id_col=self.id_col), sort_by)
