"""Roll-ups over (paper, label) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_labels(df: DataFrame, paper: str, label: str, k: int) -> DataFrame:
    """The ``k`` labels of most distinct papers, ties by label. Null labels don't count."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.countDistinct(paper).alias("n_papers")).orderBy(F.desc("n_papers"), label).limit(k)


def family_share(df: DataFrame, paper: str, label: str) -> DataFrame:
    """Distinct papers per label and their percentage of all papers that have any label."""
    known = df.filter(F.col(label).isNotNull())
    total = known.agg(F.countDistinct(paper).alias("_t"))
    return known.groupBy(label).agg(F.countDistinct(paper).alias("n_papers")).crossJoin(total).select(label, "n_papers", F.round(100 * F.col("n_papers") / F.col("_t"), 2).alias("share"))


def long_tail(df: DataFrame, paper: str, label: str, least: int = 2) -> DataFrame:
    """One row: labels of at least ``least`` papers, and the rest."""
    per = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.countDistinct(paper).alias("n"))
    return per.agg(F.count(F.when(F.col("n") >= least, 1)).alias("n_common"), F.count(F.when(F.col("n") < least, 1)).alias("n_tail"))


def shares(df: DataFrame, label: str) -> DataFrame:
    """Rows per label and their share of all."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))
