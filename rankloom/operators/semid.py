"""Semantic item identifiers: vocabulary, residual k-means codes, collision digit, token sequences, beam search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import text as X
from rankloom.operators.resolve import latest_by
from rankloom.session import cut


def numbered(df: DataFrame, order: list[str], out: str, desc: bool = False) -> DataFrame:
    """Adds the place (from 0) of each row in the order of the columns, without a single-partition sort. Rows should differ in them.

    Rows are range-partitioned; the number of rows before each partition is a table of one row per partition.
    """
    by = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()))  # the partition ids must not change between the two uses
    starts = ranged.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1
    return ranged.withColumn("_r", local).join(starts, "_p").withColumn(out, (F.col("_start") + F.col("_r")).cast("bigint")).drop("_p", "_r", "_start")


def dense_index(df: DataFrame, key: str, out: str = "item_idx") -> DataFrame:
    """Distinct keys numbered from 0 in sort order."""
    return numbered(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], out)


def item_vocab(meta: DataFrame, order: list[str]) -> DataFrame:
    """(item_idx, parent_asin, text): last text per item, numbered in key order."""
    last = latest_by(meta.select("parent_asin", *order, X.item_text().alias("text")), ["parent_asin"], order)
    return last.join(dense_index(last, "parent_asin"), "parent_asin").select("item_idx", "parent_asin", "text")


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    return np.round(d, 9).argmin(1)  # ties go to the lowest index


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def plus_plus(rows: DataFrame, books: list[np.ndarray], width: int, id_col: str, emb_col: str, normalize: bool, seed: int = 42) -> np.ndarray:
    """First centroids of k-means++: each the row drawn with a probability in proportion to its squared distance from those before it.

    The draw is a race: every row has an exponential waiting time, a hash of its id and the round divided by its squared distance, and the
    shortest wins. So it is exact, the same on every run, and one pass that returns one row per partition.
    """
    spark, cents = rows.sparkSession, np.zeros((0, 0))
    hashed = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"), emb_col)
    for _ in range(width):
        bc = spark.sparkContext.broadcast((books, cents))

        def race(batches, bc=bc):
            known, c = bc.value
            best = (np.inf, None)
            for b in batches:
                if b.num_rows:
                    x = _residual(_rows(b.column(1)), known, normalize)
                    h = b.column(0).to_numpy().astype(np.uint64) + np.uint64((len(c) + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
                    d = ((x[:, None] - c[None]) ** 2).sum(2).min(1) if len(c) else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        wait = np.where(d > 1e-18, -np.log1p(-u) / np.maximum(d, 1e-300), np.inf)
                    i = int(wait.argmin())
                    if wait[i] < best[0]:
                        best = (float(wait[i]), x[i])
            if best[1] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1].tolist()], pa.list_(pa.float64()))], names=["w", "v"])

        got = hashed.mapInArrow(race, "w double, v array<double>").orderBy("w", "v").first()
        if got is None:  # fewer distinct rows than centroids
            break
        cents = np.vstack([cents, got["v"]]) if len(cents) else np.asarray([got["v"]])
    return cents


def fit_residual_kmeans(df: DataFrame, levels: int, width: int, iters: int = 10, id_col: str = "vec_id", emb_col: str = "embedding", normalize: bool = True, init: list[np.ndarray] | None = None, revive: bool = False) -> list[np.ndarray]:
    """Codebooks of residual k-means, one per level. Starts from k-means++ seeds, or from ``init`` (centroids per level).

    Each step is one pass that returns per-partition sums and counts of each centroid: at most width x (dim + 1) numbers a
    partition, whatever the number of rows. Empty clusters keep their centroid, or with ``revive`` take the row that lies furthest
    from its own centroid. Null vectors are left out.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(emb_col).isNotNull()).select(id_col, emb_col)
    books: list[np.ndarray] = []
    for level in range(levels):
        cents = np.asarray(init[level], dtype=np.float64) if init else plus_plus(rows, books, width, id_col, emb_col, normalize)
        if not len(cents):
            return books
        for _ in range(iters):
            bc = spark.sparkContext.broadcast((books, cents))

            def sums(batches, bc=bc):
                known, c = bc.value
                total, count = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
                far = [(-1.0, [])] * len(c)  # the rows furthest from their centroids, as many as could be asked for
                for b in batches:
                    if b.num_rows:
                        x = _residual(_rows(b.column(0)), known, normalize)
                        at = _nearest(x, c)
                        np.add.at(total, at, x)
                        count += np.bincount(at, minlength=len(c))
                        if revive:
                            d = ((x - c[at]) ** 2).sum(1)
                            top = np.argsort(-d, kind="stable")[: len(c)]
                            far = sorted([*far, *((float(d[i]), x[i].tolist()) for i in top)], key=lambda t: (-t[0], t[1]))[: len(c)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.float64())), pa.array([f[0] for f in far]), pa.array([f[1] for f in far], pa.list_(pa.float64()))], names=["code", "n", "s", "d", "v"])

            part = rows.select(emb_col).mapInArrow(sums, "code int, n bigint, s array<double>, d double, v array<double>")
            dim = cents.shape[1]
            lost = [F.max(F.struct("d", "v")).alias("far")] if revive else []
            got = part.groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)], *lost).orderBy("code").collect()  # one row per centroid
            new = cents.copy()
            spare = sorted([(-r["far"]["d"], list(r["far"]["v"])) for r in got if r["far"]["d"] > 1e-18] if revive else [])
            for r in got:
                if r["n"]:
                    new[r["code"]] = [r[f"s{i}"] / r["n"] for i in range(dim)]
                elif spare:
                    new[r["code"]] = spare.pop(0)[1]
            moved = np.abs(new - cents).max()
            cents = new
            if moved <= 1e-6:
                break
        books.append(cents)
    return books


def _rows(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _residual(x: np.ndarray, books: list[np.ndarray], normalize: bool) -> np.ndarray:
    """What is left of the vectors after the levels that have a codebook."""
    for c in books:
        x = _unit(x) if normalize else x
        x = x - c[_nearest(x, c)]
    return _unit(x) if normalize else x


def encode(df: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", emb_col: str = "embedding", normalize: bool = True) -> DataFrame:
    """(id, codes): index of the nearest centroid level by level, each level on what the one before left over."""
    bc = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, codes = _rows(b.column(1)), []
                for c in bc.value:
                    x = _unit(x) if normalize else x
                    at = _nearest(x, c)
                    codes.append(at)
                    x = x - c[at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.stack(codes, 1).astype(np.int32)), pa.list_(pa.int32()))], names=[id_col, "codes"])

    schema = T.StructType([df.schema[id_col], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return df.filter(F.col(emb_col).isNotNull()).select(id_col, emb_col).mapInArrow(run, schema)


def collision_digit(df: DataFrame, codes: str = "codes", order: str = "item_idx", width: int | None = None) -> DataFrame:
    """Adds ``digit``: how many rows before it (by ``order``) have the same codes. More than ``width`` of one code raise."""
    out = df.withColumn("digit", F.row_number().over(Window.partitionBy(codes).orderBy(order)) - 1)
    if width is not None and (m := df.groupBy(codes).count().agg(F.max("count")).first()[0] or 0) > width:
        raise ValueError(f"{m} items share one code, but the codebook has {width} entries")
    return out


def dead_codes(df: DataFrame, levels: int, width: int, codes: str = "codes") -> DataFrame:
    """(level, code) pairs that no row uses."""
    spark = df.sparkSession
    space = spark.range(levels * width).select((F.col("id") / width).cast("int").alias("level"), (F.col("id") % width).cast("int").alias("code"))
    used = df.select(F.posexplode(codes).alias("level", "code")).distinct()
    return space.join(used, ["level", "code"], "left_anti")


def token_rows(seqs: DataFrame, codes: DataFrame, max_items: int, key: list[str], item: str = "parent_asin", history: str = "history") -> DataFrame:
    """(key..., tokens): codes of the last ``max_items`` known history items, flattened in order. Items without codes go before the cut; rows with none left go."""
    h = seqs.select(*key, F.posexplode(history).alias("pos", "_item"))
    j = h.join(codes.select(F.col(item).alias("_item"), "codes"), "_item")
    w = Window.partitionBy(*key).orderBy(F.desc("pos"))
    kept = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_items)
    return kept.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "codes"))), lambda s: s["codes"])).alias("tokens"))


def offset_tokens(tokens: Column, levels: int, width: int) -> Column:
    """Token of level h becomes token + h * width."""
    return F.transform(tokens, lambda t, i: t + (i % levels) * width)


def pad_right(tokens: Column, length: int, pad: int) -> tuple[Column, Column]:
    """Tokens filled up on the right, and the mask of real ones."""
    n = F.size(tokens)
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(length - n, F.lit(0)))), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(length - n, F.lit(0))))


def beam_search(starts: DataFrame, steps: DataFrame, levels: int, beam: int) -> DataFrame:
    """Best ``beam`` code paths per query by summed log-probability.

    ``starts``: (query_id, prev); ``steps``: (level, prev, code, logp), codes of any type. One join and one window per level; ties by path.
    """
    cur = starts.select("query_id", F.array().cast(T.ArrayType(steps.schema["code"].dataType)).alias("path"), F.lit(0.0).alias("score"), "prev")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    for h in range(levels):
        s = steps.filter(F.col("level") == h).select("prev", "code", "logp")
        cur = cur.join(s, "prev").select("query_id", F.concat("path", F.array("code")).alias("path"), (F.col("score") + F.col("logp")).alias("score"), F.col("code").alias("prev"))
        cur = cur.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= beam).drop("_r")
    return cur.withColumn("rank", F.row_number().over(w)).drop("prev")


def rank_of(generated: DataFrame, targets: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, rank0): rank from 0 of the first generated row equal to the target, -1 without one. ``generated``: (key, rank, value)."""
    hit = generated.join(targets.select(key, F.col("target").alias("value")), [key, "value"]).groupBy(key).agg((F.min("rank") - 1).alias("r"))
    return targets.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("r", F.lit(-1)).alias("rank0"))


def evaluate_generated(generated: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (5, 10), key: str = "query_id") -> DataFrame:
    """One row: recall, NDCG and MRR of ranked lists against one target per key. Keys without a list are misses, keys without a target don't count."""
    from rankloom.operators.interactions import ranking_metrics

    return ranking_metrics(rank_of(generated, targets.filter(F.col("target").isNotNull()), key), ks=ks)


def best_run(runs: DataFrame, metric: str, by: list[str], name: str = "run") -> DataFrame:
    """Per group the run with the highest validation metric, the smaller name in a tie; runs without the metric can't win."""
    best = runs.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.max(metric).alias(metric))
    at = runs.join(best.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(metric).alias("_m")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(metric) == F.col("_m")])
    return at.groupBy(*by).agg(F.min(name).alias(name), F.first(metric).alias(metric))
