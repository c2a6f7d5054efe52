"""Linking papers to identifiers: exact titles with disambiguation, blocked fuzzy titles, acceptance rules.

Null or empty titles never match anything. Repeated rows of one index entry count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ``order``, the remaining columns deciding ties. Aggregates before the shuffle."""
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_l")).select(*keys, *[F.col("_l")[c].alias(c) for c in rest])


def exact_title(papers: DataFrame, index: DataFrame, paper_key: str = "paper_key") -> DataFrame:
    """Every paper with the identifier of its normalised title; of several the largest in id order (the last one) wins, null without a match."""
    last = index.select(X.normalize_title("title").alias("nt"), "arxiv_id").filter("nt != ''").groupBy("nt").agg(F.max("arxiv_id").alias("arxiv_id"))
    return papers.select(paper_key, X.normalize_title("title").alias("nt")).distinct().join(last, "nt", "left").select(paper_key, "arxiv_id")


def choose_exact(papers: DataFrame, index: DataFrame, norm=X.norm_title, paper_key: str = "paper_key") -> DataFrame:
    """Exact title candidates with disambiguation: (paper_key, arxiv_id), null where it stays ambiguous.

    A single candidate is taken without looking at the author. Of several, a single one with the same surname wins; else
    those with the same surname (or all) must agree on one identifier. The decision needs only counts and extremes per
    paper and identifier, so a title shared by very many entries gathers no list.
    """
    cand = index.select(norm("title").alias("nt"), "arxiv_id", X.first_author_surname("surname").alias("sur")).filter("nt != '' and arxiv_id is not null").distinct()
    want = papers.select(paper_key, norm("title").alias("nt"), X.first_author_surname("authors").alias("p_sur")).distinct()
    j = want.join(cand, "nt", "left")
    same = (F.col("p_sur") != "") & (F.col("sur") == F.col("p_sur"))
    per = j.groupBy(paper_key, "p_sur").agg(
        F.count("arxiv_id").alias("n"), F.min("arxiv_id").alias("lo"), F.max("arxiv_id").alias("hi"),
        F.count(F.when(same, F.col("arxiv_id"))).alias("ns"), F.min(F.when(same, F.col("arxiv_id"))).alias("slo"), F.max(F.when(same, F.col("arxiv_id"))).alias("shi"),
    )
    got = F.when(F.col("n") == 0, None).when(F.col("ns") > 0, F.when(F.col("slo") == F.col("shi"), F.col("slo"))).when(F.col("lo") == F.col("hi"), F.col("lo"))
    return per.groupBy(paper_key).agg(F.min(got).alias("arxiv_id"))


def fuzzy_candidates(missing: DataFrame, index: DataFrame, jaccard: float = 0.6, paper_key: str = "paper_key") -> DataFrame:
    """Pairs of the same first-author surname whose title words overlap by ``jaccard``: (paper_key, arxiv_id, nt, cnt, fa, iauth, jaccard).

    The join key is the surname *and* a shared title word: of a title with n words, one of the first n - ceil(0.6 n) + 1 in
    rarity order must be shared by any title that reaches the threshold (prefix filtering), which keeps a surname that
    holds a third of the rows from pairing all with all.
    """
    q = missing.select(paper_key, X.norm_title("title").alias("nt"), X.first_author("authors").alias("fa")).distinct().withColumn("sur", X.first_author_surname("fa")).filter("sur != '' and nt != ''")
    c = index.select("arxiv_id", X.norm_title("title").alias("cnt"), F.col("surname").alias("iauth")).distinct().withColumn("sur", X.first_author_surname("iauth")).filter("sur != '' and cnt != ''")
    q, c = q.withColumn("w", X.words("nt")), c.withColumn("w", X.words("cnt"))
    freq = q.select(F.explode("w").alias("word")).unionByName(c.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, keys: list[str]) -> DataFrame:
        each = df.select(*keys, "sur", F.size("w").alias("size"), F.explode("w").alias("word")).join(freq, "word")
        at = F.row_number().over(Window.partitionBy(*keys).orderBy("f", "word"))
        return each.withColumn("at", at).filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * jaccard) + 1).select(*keys, "sur", "word")

    pq, pc = prefix(q, [paper_key, "nt", "fa"]), prefix(c, ["arxiv_id", "cnt", "iauth"])
    pairs = pq.join(pc, ["sur", "word"]).select(paper_key, "nt", "fa", "arxiv_id", "cnt", "iauth").distinct()
    return pairs.withColumn("jaccard", X.word_jaccard(X.words("nt"), X.words("cnt"))).filter(F.col("jaccard") >= jaccard)


def fuzzy_fill(missing: DataFrame, index: DataFrame, used: DataFrame, threshold: float = 0.93, paper_key: str = "paper_key") -> DataFrame:
    """Best candidate per paper with matching ratio and author, each identifier given once, to the first paper in key order.

    ``used`` holds identifiers that are already linked. A paper's best candidate is fixed before looking at ``used``.
    """
    c = fuzzy_candidates(missing, index, paper_key=paper_key).filter(X.same_first_author("fa", "iauth"))
    # the ratio can't exceed twice the shorter length over both, which spares most pairs the comparison in Python
    a, b = F.length("cnt"), F.length("nt")
    c = c.filter(2 * F.least(a, b) / (a + b) >= threshold).withColumn("ratio", X.sequence_ratio("cnt", "nt")).filter(F.col("ratio") >= threshold)
    best = c.groupBy(paper_key).agg(F.max_by(F.struct("arxiv_id", "ratio"), F.struct("ratio", F.col("arxiv_id"))).alias("b")).select(paper_key, "b.arxiv_id", "b.ratio")
    free = best.join(used.select("arxiv_id").distinct(), "arxiv_id", "left_anti")
    return free.withColumn("rn", F.row_number().over(Window.partitionBy("arxiv_id").orderBy(paper_key))).filter("rn = 1").drop("rn")


def accept_by_title(sim: Column, author_ok: Column, min_sim: float = 0.90, need_author: bool = True) -> Column:
    ok = F.coalesce(sim >= min_sim, F.lit(False))
    return ok & F.coalesce(author_ok, F.lit(False)) if need_author else ok


def accept_by_rerank(sim: Column, rerank: Column, query_author: Column, cand_author: Column, min_sim: float = 0.90, min_rerank: float = 0.97) -> Column:
    """Title alike, or a high re-rank score with a known surname that matches. Scores are taken to three decimals, as they were published."""
    q, c = X.surname_of(query_author), X.surname_of(cand_author)
    return F.coalesce(F.round(sim, 3) >= min_sim, F.lit(False)) | (F.coalesce(F.round(rerank, 3) >= min_rerank, F.lit(False)) & (c != "") & X.surnames_match(q, c))


def match_rates(papers: DataFrame, linked: str = "arxiv_id", by: tuple[str, ...] = ("venue_short",)) -> DataFrame:
    """Papers and linked papers per group with a grand total (null keys)."""
    return papers.rollup(*by).agg(F.count(F.lit(1)).alias("n_papers"), F.count(linked).alias("n_linked")).withColumn("rate", F.round(F.col("n_linked") / F.col("n_papers"), 4))
