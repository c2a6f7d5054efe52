"""The core's named queries over the standard tables: ``QUERIES[name](spark, sf_dir)`` and ``SQL[name]``."""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions import vectors as V
from rankloom.operators import harvest as H
from rankloom.operators import interactions as N
from rankloom.operators import resolve as R
from rankloom.operators import search as S
from rankloom.operators import semid as M
from rankloom.operators import survey as Y
from rankloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- interactions

DEDUP = """SELECT category, user_id, parent_asin, ts_ms, ingested_at, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY category, user_id, parent_asin ORDER BY ts_ms NULLS FIRST, ingested_at NULLS FIRST, rating NULLS FIRST) AS rn
  FROM interaction WHERE user_id IS NOT NULL AND parent_asin IS NOT NULL) WHERE rn = 1"""
POS = "row_number() OVER (PARTITION BY category, user_id ORDER BY ts_ms NULLS FIRST, parent_asin) AS pos, count(*) OVER (PARTITION BY category, user_id) AS n"
SPLIT = "CASE WHEN pos = n THEN 'test' WHEN pos = n - 1 THEN 'valid' ELSE 'train' END"


def core_sql(base: str, k: int, rounds: int, group: str, user: str, item: str, cols: str) -> str:
    """The peeling rounds of a k-core unrolled; one round more than needed changes nothing."""
    g = f"{group}, " if group else ""
    parts = [f"r0 AS MATERIALIZED ({base})"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT {cols} FROM (SELECT *, count(*) OVER (PARTITION BY {g}{user}) AS cu, count(*) OVER (PARTITION BY {g}{item}) AS ci FROM r{i}) WHERE cu >= {k} AND ci >= {k})")
    return f"WITH {', '.join(parts)} SELECT {cols} FROM r{rounds}"


def deduped(spark: SparkSession, d: str) -> DataFrame:
    return N.dedupe_earliest(table(spark, d, "interaction"))


@query(DEDUP)
def interactions_dedup(spark, d):
    return deduped(spark, d)


CORE_COLS = "category, user_id, parent_asin, ts_ms, rating"


def _core(spark, d, k):
    return N.core_filter(deduped(spark, d).select(*CORE_COLS.split(", ")), k)


@query(core_sql(f"SELECT {CORE_COLS} FROM ({DEDUP})", 5, 30, "category", "user_id", "parent_asin", CORE_COLS))
def kcore_5(spark, d):
    return _core(spark, d, 5)


@query(core_sql(f"SELECT {CORE_COLS} FROM ({DEDUP})", 3, 30, "category", "user_id", "parent_asin", CORE_COLS))
def kcore_3(spark, d):
    return _core(spark, d, 3)


EVENTS_CORE = "SELECT user_id, k FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase') WHERE k IS NOT NULL"


@query(core_sql(EVENTS_CORE, 10, 12, "", "user_id", "k", "user_id, k"))
def events_kcore_10(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).filter("k is not null").distinct()
    return N.core_filter(e, 10, user="user_id", item="k", group=())


ITEMS_CORE = "SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(core_sql(ITEMS_CORE, 20, 8, "", "o_custkey", "l_partkey", "o_custkey, l_partkey"))
def orders_kcore_20(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return N.core_filter(o.join(li, o.o_orderkey == li.l_orderkey).select("o_custkey", "l_partkey").distinct(), 20, user="o_custkey", item="l_partkey", group=())


@query(f"SELECT category, user_id, parent_asin, ts_ms, {SPLIT} AS split FROM (SELECT *, {POS} FROM ({DEDUP}))")
def last_out_split(spark, d):
    return N.leave_one_out(deduped(spark, d)).select("category", "user_id", "parent_asin", "ts_ms", "split")


@query(f"SELECT category, split, count(*) AS n_rows FROM (SELECT category, {SPLIT} AS split FROM (SELECT *, {POS} FROM ({DEDUP}))) GROUP BY 1, 2")
def split_counts(spark, d):
    return N.split_counts(N.leave_one_out(deduped(spark, d)), "category")


def _seq_sql(n: int) -> str:
    return f"""SELECT category, user_id, parent_asin, split, history FROM (SELECT category, user_id, parent_asin, pos, {SPLIT} AS split,
  coalesce(array_to_string(list(parent_asin) OVER (PARTITION BY category, user_id ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), ' '), '') AS history
  FROM (SELECT *, {POS} FROM ({DEDUP}))) WHERE split <> 'train' OR pos > 1"""


def _seq(spark, d, n):
    return N.sequences(deduped(spark, d), n).select("category", "user_id", "parent_asin", "split", F.array_join("history", " ").alias("history"))


@query(_seq_sql(20))
def seq_history_20(spark, d):
    return _seq(spark, d, 20)


@query(_seq_sql(50))
def seq_history_50(spark, d):
    return _seq(spark, d, 50)


@query(f"""SELECT category, split, count(*) AS n_rows FROM ({_seq_sql(20)}) GROUP BY 1, 2""")
def seq_split_counts(spark, d):
    return N.split_counts(N.sequences(deduped(spark, d), 20), "category")


@query(f"""WITH x AS ({DEDUP}), u AS (SELECT category, count(*) AS len FROM x GROUP BY category, user_id), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY len) AS rn, count(*) OVER (PARTITION BY category) AS nu FROM u)
SELECT a.category, a.n_users, i.n_items, a.n_interactions, round(a.n_interactions / a.n_users, 4) AS avg_seq_len, a.median_seq_len, a.min_seq_len, a.max_seq_len, round(1 - a.n_interactions / (a.n_users * i.n_items), 8) AS sparsity
FROM (SELECT category, count(*) AS n_users, CAST(sum(len) AS BIGINT) AS n_interactions, max(CASE WHEN rn = nu // 2 + 1 THEN len END) AS median_seq_len, min(len) AS min_seq_len, max(len) AS max_seq_len FROM r GROUP BY category) a
JOIN (SELECT category, count(DISTINCT parent_asin) AS n_items FROM x GROUP BY category) i USING (category)""")
def category_stats(spark, d):
    return N.category_stats(deduped(spark, d))


META = "parent_asin, title, main_category, store, price, average_rating, rating_number, details"


@query(f"SELECT {META} FROM item_meta WHERE parent_asin IN (SELECT parent_asin FROM interaction)")
def item_meta_semi(spark, d):
    return N.semi_items(table(spark, d, "item_meta"), table(spark, d, "interaction")).select(*META.split(", "))


@query("""SELECT n_items, n_matched, n_scanned, round(n_matched / n_items, 4) AS coverage FROM (SELECT (SELECT count(DISTINCT parent_asin) FROM interaction) AS n_items,
  (SELECT count(*) FROM item_meta WHERE parent_asin IN (SELECT parent_asin FROM interaction)) AS n_matched, (SELECT count(*) FROM item_meta) AS n_scanned)""")
def meta_coverage(spark, d):
    return N.meta_coverage(table(spark, d, "item_meta"), table(spark, d, "interaction"))


@query("SELECT user_id, parent_asin, rating, ts_ms, category FROM interaction WHERE rating >= 4")
def explicit_positive(spark, d):
    return N.explicit_positive(table(spark, d, "interaction")).select("user_id", "parent_asin", "rating", "ts_ms", "category")


@query(f"""SELECT category, user_id, parent_asin, ts_ms, CASE WHEN pos <= n * 8 // 10 THEN 'train' WHEN pos <= n * 9 // 10 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, {POS} FROM ({DEDUP}))""")
def temporal_split_811(spark, d):
    return N.temporal_split(deduped(spark, d)).select("category", "user_id", "parent_asin", "ts_ms", "split")


@query(f"""SELECT category, split, count(*) AS n_rows FROM (SELECT category, CASE WHEN u * 10 <= t * 8 THEN 'train' WHEN u * 10 <= t * 9 THEN 'valid' ELSE 'test' END AS split FROM (
  SELECT category, count(*) OVER (PARTITION BY category ORDER BY ts_ms NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u, count(*) OVER (PARTITION BY category) AS t FROM ({DEDUP}))) GROUP BY 1, 2""")
def temporal_split_global(spark, d):
    return N.split_counts(N.temporal_split_global(deduped(spark, d)), "category")


POP = "SELECT category, parent_asin, n_rows, rank FROM (SELECT category, parent_asin, count(*) AS n_rows, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, parent_asin) AS rank FROM interaction WHERE user_id IS NOT NULL AND parent_asin IS NOT NULL GROUP BY 1, 2) WHERE rank <= 20"


@query(POP)
def popularity_topk(spark, d):
    return N.popularity(table(spark, d, "interaction").filter("user_id is not null and parent_asin is not null"), 20)


@query(f"""WITH t AS (SELECT category, user_id, parent_asin FROM (SELECT *, {POS} FROM ({DEDUP})) WHERE pos = n), p AS (SELECT category, parent_asin, rank - 1 AS r FROM ({POP}))
SELECT category, avg(CASE WHEN r < 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN r < 5 THEN 1.0 / log2(r + 2) ELSE 0.0 END) AS ndcg_5, avg(CASE WHEN r < 5 THEN 1.0 / (r + 1) ELSE 0.0 END) AS mrr_5,
 avg(CASE WHEN r < 10 THEN 1.0 ELSE 0.0 END) AS recall_10, avg(CASE WHEN r < 10 THEN 1.0 / log2(r + 2) ELSE 0.0 END) AS ndcg_10, avg(CASE WHEN r < 10 THEN 1.0 / (r + 1) ELSE 0.0 END) AS mrr_10
FROM t LEFT JOIN p USING (category, parent_asin) GROUP BY category""")
def full_rank_metrics(spark, d):
    """Popularity ranking over the catalogue scored on the held-out last item of every user."""
    test = N.leave_one_out(deduped(spark, d)).filter("split = 'test'").select("category", "parent_asin")
    pop = popularity_topk(spark, d).select("category", "parent_asin", (F.col("rank") - 1).alias("rank0"))
    return N.ranking_metrics(test.join(pop, ["category", "parent_asin"], "left"), by=("category",))


@query("SELECT domain, avg(CASE WHEN r >= 0 AND r < 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN r >= 0 AND r < 5 THEN 1.0 / log2(r + 2) ELSE 0.0 END) AS ndcg_5, avg(CASE WHEN r >= 0 AND r < 5 THEN 1.0 / (r + 1) ELSE 0.0 END) AS mrr_5, avg(CASE WHEN r >= 0 AND r < 10 THEN 1.0 ELSE 0.0 END) AS recall_10, avg(CASE WHEN r >= 0 AND r < 10 THEN 1.0 / log2(r + 2) ELSE 0.0 END) AS ndcg_10, avg(CASE WHEN r >= 0 AND r < 10 THEN 1.0 / (r + 1) ELSE 0.0 END) AS mrr_10 FROM (SELECT domain, citation_count % 15 - 1 AS r FROM arxiv_paper) GROUP BY domain")
def recall_ndcg_mrr(spark, d):
    """Metrics of ranks from -1 (a miss) and null to 13, by domain."""
    return N.ranking_metrics(table(spark, d, "arxiv_paper").select("domain", (F.col("citation_count") % 15 - 1).alias("rank0")), by=("domain",))


@query(f"""SELECT category, user_id, parent_asin, array_to_string(list_concat([CASE WHEN true THEN '0' END for x in range(10 - len(h))], h), ' ') AS padded FROM (SELECT category, user_id, parent_asin, pos, n,
  coalesce(list(parent_asin) OVER (PARTITION BY category, user_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS h FROM (SELECT *, {POS} FROM ({DEDUP}))) WHERE pos = n""")
def padded_histories(spark, d):
    s = N.sequences(deduped(spark, d), 10).filter("split = 'test'")
    return s.select("category", "user_id", "parent_asin", F.array_join(N.pad_left(F.col("history"), 10, "0"), " ").alias("padded"))


@query("""WITH f AS (SELECT category, count(*) AS a, count(DISTINCT user_id) AS b FROM interaction GROUP BY 1), t AS (SELECT category, a - (length(category) % 3) AS ta, b AS tb FROM f)
SELECT category, CASE WHEN greatest(abs(a - ta), abs(b - tb)) = 0 THEN 'exact' WHEN greatest(abs(a - ta), abs(b - tb)) <= 1 THEN 'off_by_one' ELSE 'different' END AS verdict FROM f JOIN t USING (category)""")
def gate_classify(spark, d):
    f = table(spark, d, "interaction").groupBy("category").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("user_id").alias("b"))
    return N.gate(f, f.withColumn("a", F.col("a") - F.length("category") % 3), "category", ["a", "b"])


# ---------------------------------------------------------------- text functions

NT = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""SELECT arxiv_id, title, {NT.format('title')} AS title_key, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[-_/]+', ' ', 'g'), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g')) AS plain FROM corpus_entry""")
def title_normalize(spark, d):
    return table(spark, d, "corpus_entry").select("arxiv_id", "title", X.normalize_title("title").alias("title_key"), X.normalize_text("title").alias("plain"))


def _each_char(x: str, case: str) -> str:
    return f"array_to_string([{case} FOR c IN string_split({x}, '')], '')"


def unlatex_sql(x: str) -> str:
    for _ in range(3):
        x = rf"regexp_replace({x}, '\\[a-zA-Z]+\s*" + r"\{([^{}]*)\}', '\1', 'g')"
    return rf"regexp_replace({x}, '\\([a-zA-Z]+)', '\1', 'g')"


def unmarked_sql(x: str) -> str:
    """Compatibility decomposition without marks, as far as titles and names need it: DuckDB strips accents but has no NFKD. The grapheme joiner (847) is a mark without a combining class, so it stays and separates."""
    wide = "CASE WHEN ord(c) = 847 THEN ' ' WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) WHEN c = 'ﬀ' THEN 'ff' WHEN c = 'ﬁ' THEN 'fi' WHEN c = 'ﬂ' THEN 'fl' WHEN c = 'ﬃ' THEN 'ffi' WHEN c = 'ﬄ' THEN 'ffl' ELSE c END"
    return f"strip_accents({_each_char(x, wide)})"


def greek_sql(x: str) -> str:
    return _each_char(f"coalesce({x}, '')", "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.GREEK.items()) + " ELSE c END")


def translit_sql(x: str) -> str:
    return NT.format(unlatex_sql(unmarked_sql(greek_sql(x))))


@query(f"SELECT arxiv_id, title, {translit_sql('title')} AS title_key FROM corpus_entry")
def norm_translit(spark, d):
    return table(spark, d, "corpus_entry").select("arxiv_id", "title", X.norm_title("title").alias("title_key"))


@query(rf"""SELECT paper_key, authors, trim(split_part(coalesce(authors, ''), ',', 1)) AS first_author, trim(regexp_replace(trim(split_part(coalesce(authors, ''), ',', 1)), '\s+\d{{4}}$', '')) AS clean,
  coalesce(string_split({NT.format("regexp_replace(trim(split_part(coalesce(authors, ''), ',', 1)), '[ ]+[0-9]{4}$', '')")}, ' ')[-1], '') AS surname FROM accepted_paper""")
def author_names(spark, d):
    a = X.first_author("authors")
    return table(spark, d, "accepted_paper").select("paper_key", "authors", a.alias("first_author"), X.clean_author(a).alias("clean"), X.surname_of(a).alias("surname"))


@query(r"""SELECT arxiv_id, nullif(regexp_extract(arxiv_id, '(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})', 1), '') AS found,
 CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.') THEN '20' || substr(arxiv_id, 1, 2) WHEN regexp_matches(arxiv_id, '^[A-Za-z\-]+(\.[A-Z]{2})?/\d{5,}') THEN CAST(CASE WHEN CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) >= 91 THEN 1900 ELSE 2000 END + CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) AS VARCHAR) ELSE 'unknown_year' END AS id_year,
 row_number() OVER (ORDER BY CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.\d+$') THEN 2000 + CAST(substr(arxiv_id, 1, 2) AS INT) WHEN CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) >= 91 THEN 1900 + CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) ELSE 2000 + CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) END DESC,
  CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.\d+$') THEN CAST(substr(arxiv_id, 3, 2) AS INT) ELSE CAST(regexp_extract(arxiv_id, '/\d{2}(\d{2})', 1) AS INT) END DESC,
  CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.\d+$') THEN CAST(split_part(arxiv_id, '.', 2) AS BIGINT) ELSE CAST(regexp_extract(arxiv_id, '/\d{4}(\d+)', 1) AS BIGINT) END DESC, arxiv_id) AS newest_rank
FROM (SELECT DISTINCT arxiv_id FROM corpus_entry WHERE arxiv_id IS NOT NULL)""")
def arxiv_id_fields(spark, d):
    """Every identifier with its parts and its place from the newest on."""
    ids = table(spark, d, "corpus_entry").select("arxiv_id").filter("arxiv_id is not null").distinct()
    ids = M.numbered(ids.withColumn("_k", X.chrono_key("arxiv_id")).withColumn("_o", F.struct(-F.col("_k.year"), -F.col("_k.month"), -F.col("_k.seq"), "arxiv_id")), ["_o"], "newest_rank")
    return ids.select("arxiv_id", X.extract_arxiv_id("arxiv_id").alias("found"), X.year_of("arxiv_id").alias("id_year"), (F.col("newest_rank") + 1).alias("newest_rank"))


@query(r"""SELECT arxiv_id, fetched_at, coalesce(nullif(regexp_replace(regexp_replace(trim(split_part(coalesce(domain, ''), ';', 1)), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'Unknown') AS subject FROM arxiv_paper""")
def subject_names(spark, d):
    return table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", X.subject_of("domain").alias("subject"))


_V = r"(iclr|international conference on learning representations|neurips|nips|neural information processing systems|icml|international conference on machine learning|acl|association for computational linguistics)"


@query(rf"""SELECT DISTINCT venue, CASE WHEN full_m <> '' THEN canon || CASE WHEN length(full_m) = 2 THEN '20' || full_m ELSE full_m END WHEN canon IS NOT NULL THEN canon ELSE 'null' END AS tag FROM (
 SELECT venue, regexp_extract(venue, '(?i)(?:^|[^A-Za-z]){_V}(?:\s{{0,5}}''|[\s:\-/]{{0,4}})((?:19|20)\d{{2}}|\d{{2}})\b', 2) AS full_m,
 CASE lower(regexp_extract(venue, '(?i)(?:^|[^A-Za-z]){_V}(?:[^A-Za-z]|$)', 1)) WHEN '' THEN NULL WHEN 'iclr' THEN 'ICLR' WHEN 'international conference on learning representations' THEN 'ICLR' WHEN 'icml' THEN 'ICML' WHEN 'international conference on machine learning' THEN 'ICML'
  WHEN 'acl' THEN 'ACL' WHEN 'association for computational linguistics' THEN 'ACL' ELSE 'NeurIPS' END AS canon FROM accepted_paper) WHERE venue IS NOT NULL""")
def venue_canonical(spark, d):
    v = table(spark, d, "accepted_paper").select("venue").filter("venue is not null").distinct()
    return v.select("venue", X.canonical_venue("venue").alias("tag"))


@query(r"""SELECT DISTINCT pages, decision, CASE WHEN coalesce(pages, '') <> '' THEN trim(pages) WHEN regexp_matches(coalesce(decision, ''), '(?i)accept|to appear|camera[\s-]?ready|proceedings') THEN trim(decision) ELSE 'null' END AS venue_text FROM accepted_paper""")
def venue_extract(spark, d):
    return table(spark, d, "accepted_paper").select("pages", "decision").distinct().withColumn("venue_text", X.extract_venue("decision", "pages"))


_INT = r"CASE WHEN regexp_full_match({0}, '\s*[+-]?\d{{1,18}}\s*') THEN CAST(trim({0}) AS BIGINT) END"
_NUMBERS = "SELECT paper_key, run_at, CAST(round(title_sim, 4) AS VARCHAR) AS dec, paper_key[-4:] AS hex, CAST(CAST(floor(title_sim * 100) AS BIGINT) AS VARCHAR) AS whole, title_sim FROM match_result"


@query(f"SELECT paper_key, run_at, coalesce({_INT.format('dec')}, -1) AS n_dec, coalesce({_INT.format('hex')}, -1) AS n_hex, coalesce({_INT.format('whole')}, -1) AS n_whole, coalesce(CAST(trunc(title_sim * 100) AS BIGINT), -1) AS n_float FROM ({_NUMBERS})")
def to_int_cast(spark, d):
    """Integers of decimal text, of text that is partly a number or an exponent, of integer text and of numbers."""
    r = table(spark, d, "match_result")
    t = lambda c: X.to_int(c, -1)
    return r.select("paper_key", "run_at", t(F.round("title_sim", 4).cast("string")).alias("n_dec"), t(F.expr("right(paper_key, 4)")).alias("n_hex"), t(F.floor(F.col("title_sim") * 100).cast("string")).alias("n_whole"), t(F.col("title_sim") * 100).alias("n_float"))


@query(r"""SELECT arxiv_id, fetched_at, md5(regexp_replace(CASE WHEN coalesce(abstract, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || abstract ELSE coalesce(title, '') END, '^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$', '', 'g')) AS digest FROM arxiv_paper WHERE coalesce(title, '') <> '' OR coalesce(abstract, '') <> ''""")
def index_texts(spark, d):
    a = table(spark, d, "arxiv_paper").filter((X.text_or_empty("title") != "") | (X.text_or_empty("abstract") != ""))
    return a.select("arxiv_id", "fetched_at", F.md5(X.index_text("title", "abstract")).alias("digest"))


_DISPLAY = "CASE token " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.VENUE_DISPLAY.items()) + " ELSE upper(token) END"


@query(rf"""SELECT paper_id, {_DISPLAY} AS venue, dd[1:4] AS year, CASE WHEN dd <> '' THEN dd[1:4] || '-' || dd[5:6] || '-' || dd[7:8] ELSE '' END AS pub_date, token = 'arxiv' AS preprint, company FROM (SELECT paper_id, lower(regexp_extract(stem, '^([^_]+)_([^_]+)_(\d{{8}})_', 2)) AS token,
 regexp_extract(stem, '^([^_]+)_([^_]+)_(\d{{8}})_', 3) AS dd, CASE WHEN contains(paper_id, '/') THEN split_part(paper_id, '/', 1) ELSE 'Unknown' END AS company FROM (SELECT paper_id, string_split(paper_id, '/')[-1] AS stem FROM paper))""")
def paper_filenames(spark, d):
    parts = F.split("paper_id", "/")
    m = X.filename_meta(F.element_at(parts, -1))
    return table(spark, d, "paper").select("paper_id", m["venue"].alias("venue"), m["pub_year"].alias("year"), m["pub_date"].alias("pub_date"), m["is_preprint"].alias("preprint"), F.when(F.size(parts) > 1, parts[0]).otherwise("Unknown").alias("company"))


_BLANKS = r"[\s\x0b\p{Z}\x{85}\x1c-\x1f]"


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


def sections_sql(keep: str, source: str) -> str:
    """Rows (keep..., section_no, name, body) of the sections of ``source``, which has a column ``content``."""
    unquoted = stripped_sql("replace(n, chr(8217), chr(39))")
    name = rf"lower(regexp_replace(regexp_replace({unquoted}, '\.+$', ''), '{_BLANKS}+', ' ', 'g'))"
    return rf"""SELECT {keep}, unnest(range(len(names))) AS section_no, unnest(list_transform(names, lambda n: {name})) AS name, unnest(list_transform(bodies[2:], lambda b: {stripped_sql('b')})) AS body
 FROM (SELECT *, regexp_extract_all(c, '{X.SECTION_HEAD}', 1) AS names, string_split(regexp_replace(c, '{X.SECTION_HEAD}', chr(1), 'g'), chr(1)) AS bodies FROM (SELECT *, replace(coalesce(content, ''), chr(1), '') AS c FROM {source}))"""


@query(f"SELECT paper_id, section_no, name, length(body) AS n_chars FROM ({sections_sql('paper_id', 'paper')})")
def section_extract(spark, d):
    """(paper_id, section_no, name, n_chars) of every section that a heading opens."""
    s = table(spark, d, "paper").select("paper_id", F.posexplode(X.extract_sections("content")).alias("section_no", "s"))
    return s.select("paper_id", "section_no", F.col("s.name").alias("name"), F.length("s.body").alias("n_chars"))


_CONTENT = "coalesce(content, '')"
WANTED = ["Research problem and importance", "Core intuition", "Method and full pipeline", "Experimental setup and results"]


@query(f"""WITH p AS (SELECT row_number() OVER () AS rid, * FROM paper), s AS ({sections_sql('rid', 'p')}),
k AS (SELECT rid, string_agg(body, chr(10) || chr(10) ORDER BY section_no) AS body FROM s WHERE name IN ({', '.join(f"'{w.lower()}'" for w in WANTED)}) AND body <> '' GROUP BY rid)
SELECT paper_id, md5({stripped_sql(f"coalesce(title, '') || chr(10) || chr(10) || coalesce(nullif({stripped_sql('k.body')}, ''), {stripped_sql(_CONTENT)})")}) AS digest FROM p LEFT JOIN k USING (rid)""")
def section_select(spark, d):
    return table(spark, d, "paper").select("paper_id", F.md5(X.select_sections_text("title", "content", WANTED)).alias("digest"))


@query("SELECT paper_id, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(t[1:39]) || '…' END AS label FROM (SELECT paper_id, trim(coalesce(title, '')) AS t FROM paper)")
def short_titles(spark, d):
    return table(spark, d, "paper").select("paper_id", X.short_title("title", 40).alias("label"))


@query("SELECT user_id, CAST((('0x' || md5(user_id))::UHUGEINT % 1000000) AS BIGINT) AS bin FROM (SELECT DISTINCT user_id FROM interaction WHERE user_id IS NOT NULL)")
def user_hash_bins(spark, d):
    return table(spark, d, "interaction").select("user_id").filter("user_id is not null").distinct().withColumn("bin", X.user_bin("user_id"))


@query(r"""SELECT parent_asin, rating_number, md5(regexp_replace(concat_ws(' ', nullif(title, ''), nullif(array_to_string([coalesce(x, '') for x in categories], ' '), ''), nullif(array_to_string([coalesce(x, '') for x in description], ' '), ''), CASE WHEN price IS NOT NULL THEN CAST(price AS VARCHAR) END), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM item_meta""")
def item_texts(spark, d):
    return table(spark, d, "item_meta").select("parent_asin", "rating_number", F.md5(X.item_text()).alias("digest"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, round(v[1], 9) AS first FROM (SELECT vec_id, [x / n for x in e] AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings))")
def l2_normalized(spark, d):
    v = table(spark, d, "embeddings").withColumn("v", V.l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 9).alias("norm"), F.round(F.col("v")[0], 9).alias("first"))


SIM = f"(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END)"


@query(f"SELECT paper_key, run_at, round({SIM}, 9) AS sim FROM (SELECT paper_key, run_at, {NT.format('query_title')} AS a, {NT.format('matched_title')} AS b FROM match_result)")
def title_similarities(spark, d):
    return table(spark, d, "match_result").select("paper_key", "run_at", F.round(X.title_similarity("query_title", "matched_title"), 9).alias("sim"))


@query(f"""SELECT paper_key, run_at, coalesce(sim >= 0.9, false) AND coalesce(author_ok, false) AS accept_a,
 coalesce(round(sim, 3) >= 0.9, false) OR (coalesce(round(rerank_score, 3) >= 0.97, false) AND c <> '' AND (q = '' OR q = c OR contains(c, q) OR contains(q, c))) AS accept_b FROM (SELECT paper_key, run_at, author_ok, rerank_score, {SIM} AS sim,
 coalesce(string_split({NT.format("regexp_replace(trim(coalesce(query_author, '')), '[ ]+[0-9]{4}$', '')")}, ' ')[-1], '') AS q, coalesce(string_split({NT.format("regexp_replace(trim(coalesce(matched_surname, '')), '[ ]+[0-9]{4}$', '')")}, ' ')[-1], '') AS c
 FROM (SELECT *, {NT.format('query_title')} AS a, {NT.format('matched_title')} AS b FROM match_result))""")
def edit_distance_adjudicate(spark, d):
    sim = X.title_similarity("query_title", "matched_title")
    return table(spark, d, "match_result").select("paper_key", "run_at", R.accept_by_title(sim, F.col("author_ok")).alias("accept_a"), R.accept_by_rerank(sim, F.col("rerank_score"), F.col("query_author"), F.col("matched_surname")).alias("accept_b"))


# ---------------------------------------------------------------- harvest

TERMS, BOOST = ["semantic identifiers", "Hyperbolic_Embeddings"], ["recommendation", "click-through"]
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[-_/]+', ' ', 'g'), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"
_HIT = f"(contains({_PLAIN.format('title')}, 'semantic identifiers') OR contains({_PLAIN.format('title')}, 'hyperbolic embeddings'))"
_ABS = f"(contains({_PLAIN.format('abstract')}, 'recommendation') OR contains({_PLAIN.format('abstract')}, 'click through'))"


@query(f"SELECT arxiv_id, title, fetched_at FROM arxiv_paper WHERE {_HIT}")
def title_filter(spark, d):
    return H.topic_filter(table(spark, d, "arxiv_paper"), TERMS).select("arxiv_id", "title", "fetched_at")


@query(f"SELECT arxiv_id, title, fetched_at FROM arxiv_paper WHERE {_HIT} OR (coalesce(domain = 'Computer_Science', false) AND {_ABS})")
def abstract_boost(spark, d):
    return H.topic_filter(table(spark, d, "arxiv_paper"), TERMS, BOOST, ["Computer_Science"], category="domain").select("arxiv_id", "title", "fetched_at")


@query(r"SELECT paper_key, venue, fetched_at FROM accepted_paper WHERE regexp_matches(concat_ws(' ', venue, decision), '(?i)(^|[^A-Za-z])(neural information processing systems|neurips|nips|icml)([^A-Za-z]|$)')")
def venue_filtered(spark, d):
    return H.venue_filter(table(spark, d, "accepted_paper"), ["NeurIPS", "NIPS", "Neural Information Processing Systems", "ICML"], "venue", "decision").select("paper_key", "venue", "fetched_at")


@query("SELECT arxiv_id, publication_date, fetched_at FROM arxiv_paper WHERE publication_date >= '2024-06-01'")
def since_date(spark, d):
    return H.since(table(spark, d, "arxiv_paper"), "publication_date", days=30, today=datetime.date(2024, 7, 1)).select("arxiv_id", "publication_date", "fetched_at")


@query("""SELECT arxiv_id, fetched_at, citation_count, title FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY fetched_at DESC NULLS LAST, citation_count DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM arxiv_paper) WHERE rn = 1""")
def keyed_upsert(spark, d):
    """Two halves of the fetch log, the later one upserted into the earlier."""
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", "citation_count", "title")
    cut_at = F.lit("2020-01-01").cast("timestamp_ntz")
    old, new = a.filter(F.coalesce(F.col("fetched_at") < cut_at, F.lit(True))), a.filter(F.col("fetched_at") >= cut_at)
    return H.upsert(old, new, ["arxiv_id"], "fetched_at")


@query("SELECT DISTINCT arxiv_id FROM corpus_entry WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM arxiv_paper WHERE arxiv_id IS NOT NULL)")
def todo_antijoin(spark, d):
    return H.todo(table(spark, d, "corpus_entry"), table(spark, d, "arxiv_paper"), "arxiv_id")


@query("""SELECT arxiv_id, fetched_at, title FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY fetched_at NULLS FIRST, title NULLS FIRST) AS rn FROM arxiv_paper WHERE arxiv_id IS NOT NULL) WHERE rn = 1 AND arxiv_id NOT IN (SELECT arxiv_id FROM corpus_entry WHERE arxiv_id IS NOT NULL)""")
def harvest_dedupe(spark, d):
    return H.harvest_new(table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", "title"), table(spark, d, "corpus_entry"), "arxiv_id", ["fetched_at"])


@query("""SELECT greatest(m, DATE '2023-11-17')::DATE AS window_start, least(last_day(m), DATE '2025-02-03')::DATE AS window_end FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2025-02-03', INTERVAL 1 MONTH))::DATE AS m)""")
def month_windows(spark, d):
    return H.month_windows(spark, datetime.date(2023, 11, 17), datetime.date(2025, 2, 3))


# ---------------------------------------------------------------- entity resolution


@query(f"""WITH i AS (SELECT {NT.format('title')} AS nt, max(arxiv_id) AS arxiv_id FROM corpus_entry WHERE {NT.format('title')} <> '' GROUP BY 1)
SELECT DISTINCT p.paper_key, p.nt, i.arxiv_id FROM (SELECT paper_key, {NT.format('title')} AS nt FROM accepted_paper) p LEFT JOIN i ON p.nt = i.nt""".replace("SELECT DISTINCT p.paper_key, p.nt, i.arxiv_id", "SELECT paper_key, arxiv_id FROM (SELECT DISTINCT p.paper_key, p.nt, i.arxiv_id") + ")")
def exact_title_join(spark, d):
    return R.exact_title(table(spark, d, "accepted_paper"), table(spark, d, "corpus_entry"))


_SUR = "lower(coalesce(regexp_extract(trim(strip_accents({0})), '(\\S+)$', 1), ''))"


@query(f"""WITH c AS (SELECT DISTINCT {NT.format('title')} AS nt, arxiv_id, {_SUR.format("split_part(coalesce(surname, ''), ',', 1)")} AS sur FROM corpus_entry WHERE {NT.format('title')} <> '' AND arxiv_id IS NOT NULL),
p AS (SELECT DISTINCT paper_key, {NT.format('title')} AS nt, {_SUR.format("split_part(coalesce(authors, ''), ',', 1)")} AS ps FROM accepted_paper),
g AS (SELECT paper_key, ps, count(arxiv_id) AS n, min(arxiv_id) AS lo, max(arxiv_id) AS hi, count(CASE WHEN ps <> '' AND sur = ps THEN 1 END) AS ns, min(CASE WHEN ps <> '' AND sur = ps THEN arxiv_id END) AS slo, max(CASE WHEN ps <> '' AND sur = ps THEN arxiv_id END) AS shi FROM p LEFT JOIN c USING (nt) GROUP BY 1, 2)
SELECT paper_key, min(CASE WHEN n = 0 THEN NULL WHEN ns > 0 THEN CASE WHEN slo = shi THEN slo END WHEN lo = hi THEN lo END) AS arxiv_id FROM g GROUP BY 1""")
def exact_match_choose(spark, d):
    return R.choose_exact(table(spark, d, "accepted_paper"), table(spark, d, "corpus_entry"), norm=X.normalize_title)


@query("""SELECT venue_short, count(*) AS n_papers, count(CASE WHEN ok THEN 1 END) AS n_linked, round(count(CASE WHEN ok THEN 1 END) / count(*), 4) AS rate FROM (SELECT a.venue_short, m.ok FROM accepted_paper a LEFT JOIN (SELECT DISTINCT paper_key, true AS ok FROM match_result WHERE matched) m USING (paper_key)) GROUP BY ROLLUP (venue_short)""")
def match_rate_rollup(spark, d):
    m = table(spark, d, "match_result").filter("matched").select("paper_key", F.lit("x").alias("arxiv_id")).distinct()
    return R.match_rates(table(spark, d, "accepted_paper").join(m, "paper_key", "left"))


def words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def surname_sql(x: str) -> str:
    return rf"lower(coalesce(regexp_extract({unmarked_sql(greek_sql(x))}, '([^\s\p{{Z}}]+)[\s\p{{Z}}]*$', 1), ''))"


@query(f"""WITH c AS (SELECT DISTINCT {translit_sql('title')} AS nt, arxiv_id, {surname_sql("split_part(coalesce(surname, ''), ',', 1)")} AS sur FROM corpus_entry), p AS (SELECT DISTINCT paper_key, {translit_sql('title')} AS nt, {surname_sql("split_part(coalesce(authors, ''), ',', 1)")} AS sur FROM accepted_paper),
j AS (SELECT paper_key, arxiv_id, len(list_intersect({words_sql('p.nt')}, {words_sql('c.nt')})) AS n, len({words_sql('p.nt')}) AS a, len({words_sql('c.nt')}) AS b FROM p JOIN c ON p.sur = c.sur WHERE p.sur <> '' AND p.nt <> '' AND c.nt <> '')
SELECT paper_key, arxiv_id, round(max(n / (a + b - n)), 6) AS jaccard FROM j WHERE n / (a + b - n) >= 0.6 GROUP BY 1, 2""")
def fuzzy_block_jaccard(spark, d):
    c = R.fuzzy_candidates(table(spark, d, "accepted_paper"), table(spark, d, "corpus_entry"))
    return c.groupBy("paper_key", "arxiv_id").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


@query()
def fuzzy_ratio_fill(spark, d):
    """Papers that the exact pass left open, filled by matching ratio; identifiers of the exact pass are taken."""
    p, c = table(spark, d, "accepted_paper"), table(spark, d, "corpus_entry")
    exact = R.choose_exact(p, c)
    missing = p.join(exact.filter("arxiv_id is null").select("paper_key"), "paper_key", "left_semi")
    return R.fuzzy_fill(missing, c, exact.filter("arxiv_id is not null")).select("paper_key", "arxiv_id", F.round("ratio", 6).alias("ratio"))


# ---------------------------------------------------------------- search

_E = "CAST({0}.embedding AS DOUBLE[])"


def _topk_sql(where: str, qwhere: str, k: int) -> str:
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product({_E.format('q')}, {_E.format('e')}) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product({_E.format('q')}, {_E.format('e')}) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE {qwhere} AND {where}) WHERE rank <= {k}"""


def _topk(index: DataFrame, q: DataFrame, k: int) -> DataFrame:
    return S.cosine_topk(index, q.select(F.col("vec_id").alias("query_id"), "embedding"), k).withColumn("score", F.round("score", 6))


@query(_topk_sql("true", "q.vec_id = 0", 100))
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return _topk(e, e.filter("vec_id = 0"), 100)


@query(_topk_sql("e.label IN (1, 2, 3)", "q.vec_id % 20 = 0", 15))
def cosine_topk_filtered(spark, d):
    """Domain and year filters narrow the index before it is searched."""
    e = table(spark, d, "embeddings").withColumn("domain", F.lit("vectors"))
    ix = S.eligible(e, domain="vectors", years=[1, 2, 3], domains=("vectors",), year_col="label")
    return _topk(ix, e.filter("vec_id % 20 = 0"), 15)


@query(_topk_sql("true", "q.vec_id % 20 = 0", 10))
def batch_topk(spark, d):
    """The stated query set, every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, d, "embeddings")
    return _topk(e, e.filter("vec_id % 20 = 0"), 10)


@query(f"""SELECT query_id, label, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.label, e.vec_id, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY list_dot_product({_E.format('q')}, {_E.format('e')}) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def batch_topk_per_label(spark, d):
    """For every vector whose id is divisible by 20 the five nearest of each label."""
    e = table(spark, d, "embeddings")
    return S.cosine_topk(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, per="label").select("query_id", "label", "vec_id", "rank")


@query(f"""SELECT vec_id, citations, row_number() OVER (ORDER BY citations DESC, rel) AS rank FROM (SELECT *, (vec_id * 37) % 11 AS citations FROM (SELECT vec_id, rank AS rel FROM ({_topk_sql('true', 'q.vec_id = 0', 15)})))""")
def topk_by_citation(spark, d):
    e = table(spark, d, "embeddings")
    hits = _topk(e, e.filter("vec_id = 0"), 15).withColumnRenamed("rank", "rel_rank").withColumn("citation_count", F.col("vec_id") * 37 % 11)
    return S.sort_results(hits, "citations").select("vec_id", F.col("citation_count").alias("citations"), "rank")


@query()
def paper_search(spark, d):
    """Two-stage search over titles and abstracts with the offline encoder and scorer."""
    a = R.latest_by(table(spark, d, "arxiv_paper").select("arxiv_id", "title", "abstract", "citation_count", "pub_year", "domain", "fetched_at"), ["arxiv_id"], ["fetched_at"])
    ix = S.embed(a.withColumn("text", X.index_text("title", "abstract")), "text")
    return S.SearchEngine(ix).search("semantic identifiers for sequential recommendation", sort_by="citations").select("arxiv_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


# ---------------------------------------------------------------- semantic identifiers


_ITEM_TEXT = r"""regexp_replace(concat_ws(' ', nullif(title, ''), nullif(array_to_string([coalesce(x, '') for x in categories], ' '), ''), nullif(array_to_string([coalesce(x, '') for x in description], ' '), ''), CASE WHEN price IS NOT NULL THEN CAST(price AS VARCHAR) END), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"""


@query(f"SELECT row_number() OVER (ORDER BY parent_asin) - 1 AS item_idx, parent_asin, md5(text) AS digest FROM (SELECT parent_asin, text, row_number() OVER (PARTITION BY parent_asin ORDER BY rating_number DESC NULLS LAST, text DESC) AS rn FROM (SELECT *, {_ITEM_TEXT} AS text FROM item_meta) WHERE parent_asin IS NOT NULL) WHERE rn = 1")
def item_vocab(spark, d):
    return M.item_vocab(table(spark, d, "item_meta").filter("parent_asin is not null"), ["rating_number"]).select("item_idx", "parent_asin", F.md5("text").alias("digest"))


def _books(spark, d, width=8):
    """Two codebooks of stored rows: vectors 0..7, and the halves of vectors 8..15."""
    import numpy as np

    rows = table(spark, d, "embeddings").filter("vec_id < 16").orderBy("vec_id").collect()
    m = np.asarray([r["embedding"] for r in rows], dtype=np.float64)
    return [m[:width], m[width:] / 2]


_RES = "[a - b for a, b in zip(e, c)]"
ENCODE = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id AS c, e FROM v WHERE vec_id < 8), b2 AS (SELECT vec_id - 8 AS c, [x / 2 for x in e] AS e FROM v WHERE vec_id BETWEEN 8 AND 15),
a1 AS (SELECT v.vec_id, v.e, b.c, b.e AS ce, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_dot_product(b.e, b.e) - 2 * list_dot_product(v.e, b.e), 9), b.c) AS r FROM v, b),
r1 AS (SELECT vec_id, c AS c1, list_transform(list_zip(e, ce), lambda z: z[1] - z[2]) AS e FROM a1 WHERE r = 1),
a2 AS (SELECT r1.vec_id, r1.c1, b2.c, row_number() OVER (PARTITION BY r1.vec_id ORDER BY round(list_dot_product(b2.e, b2.e) - 2 * list_dot_product(r1.e, b2.e), 9), b2.c) AS r FROM r1, b2)
SELECT vec_id, CAST(c1 AS INT) AS c1, CAST(c AS INT) AS c2 FROM a2 WHERE r = 1"""


@query(ENCODE)
def encode_codes(spark, d):
    c = M.encode(table(spark, d, "embeddings"), _books(spark, d), normalize=False)
    return c.select("vec_id", F.col("codes")[0].alias("c1"), F.col("codes")[1].alias("c2"))


@query(f"SELECT vec_id, c1, c2, row_number() OVER (PARTITION BY c1, c2 ORDER BY vec_id) - 1 AS digit FROM ({ENCODE})")
def collision_digit(spark, d):
    c = M.encode(table(spark, d, "embeddings"), _books(spark, d), normalize=False)
    return M.collision_digit(c, order="vec_id").select("vec_id", F.col("codes")[0].alias("c1"), F.col("codes")[1].alias("c2"), "digit")


@query(f"SELECT level, code FROM (SELECT l AS level, c AS code FROM range(2) a(l), range(12) b(c)) EXCEPT (SELECT 0, c1 FROM ({ENCODE}) UNION SELECT 1, c2 FROM ({ENCODE}))")
def dead_codes(spark, d):
    """Codes of books of twelve that no vector has; only eight of each book exist."""
    return M.dead_codes(M.encode(table(spark, d, "embeddings"), _books(spark, d), normalize=False), 2, 12)


@query(f"""WITH t AS (SELECT category, user_id, parent_asin, pos, n FROM (SELECT *, {POS} FROM ({DEDUP}))), v AS (SELECT parent_asin, row_number() OVER (ORDER BY parent_asin) - 1 AS i FROM (SELECT DISTINCT parent_asin FROM item_meta WHERE parent_asin IS NOT NULL)),
h AS (SELECT t.category, t.user_id, t.pos, v.i, row_number() OVER (PARTITION BY t.category, t.user_id ORDER BY t.pos DESC) AS r FROM t JOIN v USING (parent_asin) WHERE t.pos < t.n AND t.pos >= t.n - 20)
SELECT category, user_id, string_agg(CAST(i % 16 AS VARCHAR) || ' ' || CAST(16 + i // 16 % 16 AS VARCHAR), ' ' ORDER BY pos) || repeat(' 32', 2 * CAST(10 - count(*) AS INT)) AS tokens, repeat('1', 2 * CAST(count(*) AS INT)) || repeat('0', 2 * CAST(10 - count(*) AS INT)) AS mask FROM h WHERE r <= 10 GROUP BY 1, 2""")
def tokens_padded(spark, d):
    """Tokens of the last ten known items before each user's test item, offset by level and padded."""
    seq = N.sequences(deduped(spark, d), 20).filter("split = 'test'").select("category", "user_id", "history")
    vocab = M.dense_index(table(spark, d, "item_meta"), "parent_asin")
    codes = vocab.select("parent_asin", F.array((F.col("item_idx") % 16).cast("int"), (F.floor(F.col("item_idx") / 16) % 16).cast("int")).alias("codes"))
    t = M.token_rows(seq, codes, 10, ["category", "user_id"])
    padded, mask = M.pad_right(M.offset_tokens(F.col("tokens"), 2, 16), 20, 32)
    return t.select("category", "user_id", F.array_join(padded, " ").alias("tokens"), F.array_join(mask, "").alias("mask"))


@query()
def rq_kmeans(spark, d):
    """Residual k-means fitted on all vectors, codes with a collision digit."""
    e = table(spark, d, "embeddings")
    c = M.encode(e, M.fit_residual_kmeans(e, 2, 8, 5))
    return M.collision_digit(c, order="vec_id").select("vec_id", F.array_join(F.concat("codes", F.array(F.col("digit"))), "-").alias("sid"))


BIGRAM = """WITH o AS (SELECT user_id, event_type, ts, event_id FROM events), s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS code FROM o),
p AS (SELECT prev, code, ln(count(*) / sum(count(*)) OVER (PARTITION BY prev)) AS logp FROM s WHERE prev IS NOT NULL GROUP BY prev, code)"""


@query(BIGRAM + """, b1 AS (SELECT prev AS q, code AS c1, logp AS s, row_number() OVER (PARTITION BY prev ORDER BY logp DESC, code) AS r FROM p),
b2 AS (SELECT b1.q, b1.c1, p.code AS c2, b1.s + p.logp AS s, row_number() OVER (PARTITION BY b1.q ORDER BY b1.s + p.logp DESC, b1.c1, p.code) AS r FROM b1 JOIN p ON p.prev = b1.c1 WHERE b1.r <= 3)
SELECT q AS query_id, c1 || ' ' || c2 AS path, round(s, 6) AS score FROM b2 WHERE r <= 3""")
def beam_search(spark, d):
    """Beam of three over event-type bigrams, two levels deep."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w)).filter("prev is not null").groupBy("prev", F.col("event_type").alias("code")).count()
    p = s.withColumn("logp", F.log(F.col("count") / F.sum("count").over(Window.partitionBy("prev"))))
    steps = p.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("level"))).select("level", "prev", "code", "logp")
    starts = p.select("prev").distinct().select(F.col("prev").alias("query_id"), "prev")
    return M.beam_search(starts, steps, 2, 3).select("query_id", F.array_join("path", " ").alias("path"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- roll-ups


@query("SELECT source, count(DISTINCT doc_id) AS n_papers FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def survey_top_n(spark, d):
    return Y.top_labels(table(spark, d, "documents"), "doc_id", "source", 30)


@query("SELECT lang, count(DISTINCT doc_id) AS n_papers, round(100 * count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents WHERE lang IS NOT NULL), 2) AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def family_share(spark, d):
    return Y.family_share(table(spark, d, "documents"), "doc_id", "lang")


@query("SELECT count(CASE WHEN n >= 2 THEN 1 END) AS n_common, count(CASE WHEN n < 2 THEN 1 END) AS n_tail FROM (SELECT store, count(DISTINCT parent_asin) AS n FROM item_meta WHERE store IS NOT NULL GROUP BY 1)")
def long_tail(spark, d):
    return Y.long_tail(table(spark, d, "item_meta"), "parent_asin", "store")


@query("SELECT doc_kind, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def protocol_shares(spark, d):
    return Y.shares(table(spark, d, "documents"), "doc_kind")


# ---------------------------------------------------------------- streaming


def _work_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid

    from rankloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_rows, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_daily_ingest(spark, d):
    """Event-time counts per day by a stream that works off the files that are there."""
    from rankloom.streaming import ingest as I

    src = table(spark, d, "events")
    work, name = _work_dir(spark), "daily_" + os.urandom(6).hex()
    out = I.windowed_counts(spark.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet"), late="3650 days")
    q = out.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{work}/{name}")).option("checkpointLocation", f"{work}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{work}/{name}")
    last = got.groupBy("window_start", "event_type").agg(F.max(F.struct("n_rows", "total")).alias("m"))  # counts only grow
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "m.n_rows", F.round("m.total", 4).alias("total"))
