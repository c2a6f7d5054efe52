"""Incremental loads: text and venue filters, keyed upserts, resume by anti-join, month windows."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.resolve import latest_by


def any_term(x: Column, terms: Sequence[str]) -> Column:
    """True if a normalised term is part of the (already normalised) text; without terms false."""
    hits = [x.contains(t) for t in dict.fromkeys(" ".join(t.lower().replace("-", " ").replace("_", " ").replace("/", " ").split()) for t in terms) if t]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def topic_filter(df: DataFrame, title_terms: Sequence[str], abstract_terms: Sequence[str] = (), categories: Sequence[str] = (), title: str = "title", abstract: str = "abstract", category: str | None = None) -> DataFrame:
    """Rows whose title holds a term; where it doesn't, rows whose abstract holds one and whose category is listed (no list: any).

    Without title terms nothing is filtered, the abstract terms included. Null texts hold no term.
    """
    if not title_terms:
        return df
    hit = any_term(X.normalize_text(title), title_terms)
    if abstract_terms:
        ok = F.col(category).isin(list(categories)) if categories and category else F.lit(True)
        hit = hit | (F.coalesce(ok, F.lit(False)) & any_term(X.normalize_text(abstract), abstract_terms))
    return df.filter(hit)


def venue_filter(df: DataFrame, aliases: list[str], *cols: str) -> DataFrame:
    """Rows that name one of the venues in the joined text columns; rows without text go."""
    return df.filter(F.concat_ws(" ", *cols).rlike(X.venue_pattern(aliases)))


def since(df: DataFrame, date_col: str, start: datetime.date | None = None, days: int | None = None, today: datetime.date | None = None) -> DataFrame:
    """Rows from a date on; ``start`` overrides ``days``. The comparison is on the bare column, so that it reaches the scan."""
    if start is None and days is not None:
        start = (today or datetime.date.today()) - datetime.timedelta(days=days)
    return df if start is None else df.filter(F.col(date_col) >= F.lit(start.isoformat()))


def query_text(keywords: Sequence[str], categories: Sequence[str] = (), venues: Sequence[str] = ()) -> str:
    """The search expression ``(kw OR ...) AND (cat:...) AND (venue ...)``; empty parts are left out."""
    quote = lambda k: f'"{k}"' if " " in k else k
    parts = [[quote(k) for k in keywords], [f"cat:{c}" for c in categories], [quote(v) for v in venues]]
    return " AND ".join("(" + " OR ".join(p) + ")" for p in parts if p)


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the one with the highest version per key; in a tie the batch wins."""
    both = base.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, [version, "_src"]).drop("_src")


def todo(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct keys not yet done; recorded misses count as done. Null keys are never work."""
    return ids.select(key).filter(F.col(key).isNotNull()).distinct().join(done.select(key).distinct(), key, "left_anti")


def harvest_new(page: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key of a page, without keys that the index has."""
    rest = [*order, *[c for c in page.columns if c not in (key, *order)]]
    first = page.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in rest])
    return first.join(known.select(key).distinct(), key, "left_anti")


def month_windows(spark: SparkSession, start: datetime.date, end: datetime.date) -> DataFrame:
    """(window_start, window_end) of every calendar month of the range, clamped to it; no rows if it is empty."""
    if end < start:
        return spark.createDataFrame([], "window_start date, window_end date")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(s, "month"), e, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("m", s).alias("window_start"), F.least(F.last_day("m"), e).alias("window_end"))


def flatten_record(df: DataFrame) -> DataFrame:
    """Nested paper records as flat rows with the names joined by ``"; "``; missing records give ``found = false``."""
    return df.select(
        "arxiv_id", F.col("rec.corpusId").alias("corpusId"), F.col("rec.title").alias("title"), X.join_names("rec.authors").alias("authors"), F.col("rec.year").alias("year"),
        F.array_join(F.col("rec.fieldsOfStudy"), "; ").alias("fieldsOfStudy"), F.col("rec").isNotNull().alias("found"),
    )


def batch_results(ids: DataFrame, results: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Every asked identifier with its record: the aligned answer of a lookup. Identifiers without a record come out with ``found = false``, null ones not at all.

    ``results``: (key, rec). Records are matched by key, not by place, so that lost or repeated answers can't shift the others.
    """
    asked = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    one = results.filter(F.col("rec").isNotNull()).groupBy(key).agg(F.min("rec").alias("rec"))
    return asked.join(one, key, "left").withColumn("found", F.col("rec").isNotNull())


def main_records(df: DataFrame, kind: str = "type", title: str = "title") -> DataFrame:
    """Rows that are papers: front matter (``Editorship``) and rows without a title go."""
    return df.filter(~F.col(kind).eqNullSafe("Editorship") & (X.strip(X.text_or_empty(title)) != ""))


def needs_link(df: DataFrame, url: str = "arxiv_url", ident: str = "arxiv_id") -> DataFrame:
    """Rows with neither an address nor an identifier; null and the empty text are none."""
    return df.filter((X.text_or_empty(url) == "") & (X.text_or_empty(ident) == ""))


def venue_years(df: DataFrame, venues: Sequence[str] = (), years: Sequence[int | str] = (), col: str = "venue_short") -> DataFrame:
    """Rows of the venues and years, by names such as ``KDD2016``; an empty list means all."""
    name = F.col(col)
    out = df.filter(F.regexp_extract(name, r"^(.*?)\d{4}$", 1).isin(list(venues))) if venues else df
    return out.filter(F.regexp_extract(name, r"(\d{4})$", 1).isin([str(y) for y in years])) if years else out


def distinct_counts(df: DataFrame, *cols: str) -> DataFrame:
    """One row: rows, and distinct values (nulls don't count) of each column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def newest_ids(df: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Rows from the largest identifier text to the smallest, a range-partitioned sort."""
    return df.orderBy(F.col(key).desc_nulls_last(), *[c for c in df.columns if c != key])


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order, for trial runs."""
    return df.orderBy(*order).limit(n)
