"""Named queries of the remaining functions and operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions import vectors as V
from rankloom.operators import harvest as H
from rankloom.operators import interactions as N
from rankloom.operators import search as S
from rankloom.operators import semid as M
from rankloom.plans import core
from rankloom.plans.core import query
from rankloom.session import table

# ---------------------------------------------------------------- text functions


@query(f"SELECT paper_key, fetched_at, {core.unlatex_sql('title')} AS plain FROM accepted_paper")
def latex_plain(spark, d):
    return table(spark, d, "accepted_paper").select("paper_key", "fetched_at", X.strip_latex("title").alias("plain"))


def _name_words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({core.unmarked_sql(f'coalesce({x}, $$$$)')}), '[^a-z]+'), lambda w: w <> '')"


@query(f"SELECT paper_key, run_at, coalesce(a[-1] = b[-1] AND (a[1] = b[1] OR a[1][1] = b[1][1]), false) AS same FROM (SELECT paper_key, run_at, {_name_words_sql('query_author')} AS a, {_name_words_sql('matched_surname')} AS b FROM match_result)")
def first_author_same(spark, d):
    return table(spark, d, "match_result").select("paper_key", "run_at", X.same_first_author("query_author", "matched_surname").alias("same"))


@query(r"SELECT arxiv_id, CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.\d{4,5}') THEN 0 ELSE 1 END AS old, regexp_replace(arxiv_id || 'v' || length(arxiv_id), 'v\d+$', '') AS key, regexp_replace(arxiv_id, 'v\d+$', '') AS plain FROM (SELECT DISTINCT arxiv_id FROM corpus_entry WHERE arxiv_id IS NOT NULL)")
def arxiv_keys(spark, d):
    """Sort class of every identifier, and its key with and without a version behind it."""
    ids = table(spark, d, "corpus_entry").select("arxiv_id").filter("arxiv_id is not null").distinct()
    return ids.select("arxiv_id", X.arxiv_sort_key("arxiv_id")["old"].alias("old"), X.arxiv_key(F.concat("arxiv_id", F.lit("v"), F.length("arxiv_id").cast("string"))).alias("key"), X.arxiv_key("arxiv_id").alias("plain"))


@query("SELECT arxiv_id, fetched_at, coalesce(array_to_string(string_split(authors, ';'), '; '), '-') AS names FROM arxiv_paper")
def names_joined(spark, d):
    names = F.transform(F.split("authors", ";"), lambda n: F.struct(n.alias("name")))
    return table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", F.coalesce(X.join_names(names), F.lit("-")).alias("names"))


@query(r"SELECT paper_id, coalesce(nullif(trim(regexp_extract(coalesce(content, ''), '(?m)^\s*#\s+(.*\S)\s*$', 1)), ''), title) AS head, regexp_extract(coalesce(content, ''), 'https?://arxiv\.example/abs/[^\s)\]]+') AS url FROM paper")
def paper_headers(spark, d):
    return table(spark, d, "paper").select("paper_id", X.markdown_title("content", "title").alias("head"), X.markdown_arxiv_url("content", "arxiv.example").alias("url"))


@query("""SELECT paper_key, run_at, CAST(printf('%.3f', coalesce(title_sim, 0)) AS DOUBLE) AS title_sim, CAST(printf('%.3f', coalesce(rerank_score, 0)) AS DOUBLE) AS rerank, paper_key AS arxiv_id, coalesce(trim(matched_surname), '') AS surname,
 CASE WHEN length(t) <= 70 THEN t ELSE rtrim(t[1:69]) || '…' END AS shown FROM (SELECT *, trim(replace(coalesce(matched_title, ''), '|', '/')) AS t FROM match_result)""")
def match_texts(spark, d):
    """Results rendered as text and parsed back; scores come out with three decimals."""
    m = table(spark, d, "match_result").withColumn("matched_title", F.replace(X.text_or_empty("matched_title"), F.lit("|"), F.lit("/")))
    c = F.struct(F.col("rerank_score").alias("rerank"), F.col("recall_score").alias("recall"), F.col("paper_key").alias("arxiv_id"), F.col("matched_title").alias("title"), F.col("matched_surname").alias("surname"))
    text = X.render_match("title_sim", F.array(c, c))
    return m.select("paper_key", "run_at", X.parse_match(text).alias("p"), F.regexp_extract(text, r"(?m)^\| 2 \| [\d.]+ \| [\d.]+ \| `[^`]*` \| (.*?) \| [^|]*\|$", 1).alias("shown")).select("paper_key", "run_at", "p.*", "shown")


@query(r"SELECT paper_key, run_at, md5('Instruct: match' || chr(10) || 'Query:' || coalesce(query_title, '')) AS q, md5('<Instruct>: match' || chr(10) || '<Query>: ' || coalesce(query_title, '') || chr(10) || '<Document>: ' || coalesce(matched_title, '')) AS p FROM match_result")
def prompts(spark, d):
    task = F.lit("match")
    return table(spark, d, "match_result").select("paper_key", "run_at", F.md5(X.query_prompt(task, "query_title")).alias("q"), F.md5(X.pair_prompt(task, "query_title", "matched_title")).alias("p"))


@query(f"SELECT paper_key, run_at, len(list_intersect(a, b)) AS shared, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS jaccard FROM (SELECT paper_key, run_at, {core.words_sql(core.NT.format('query_title'))} AS a, {core.words_sql(core.NT.format('matched_title'))} AS b FROM match_result)")
def title_word_sets(spark, d):
    a, b = X.words(X.normalize_title("query_title")), X.words(X.normalize_title("matched_title"))
    return table(spark, d, "match_result").select("paper_key", "run_at", F.size(F.array_intersect(a, b)).alias("shared"), F.round(X.word_jaccard(a, b), 9).alias("jaccard"))


@query("SELECT g, round(CASE WHEN count(CASE WHEN m THEN 1 END) = 0 THEN 0 ELSE avg(CASE WHEN m THEN x END) END, 6) AS first, count(*) AS n FROM (SELECT vec_id // 10 AS g, vec_id % 3 <> 0 AS m, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY g")
def mean_pooled(spark, d):
    """Masked mean of ten vectors each."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), "embedding", F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0).alias("m"))
    g = e.groupBy("g").agg(F.collect_list(F.struct("embedding", "m")).alias("x"))  # ten rows a group
    pooled = V.mean_pool(F.transform("x", lambda r: r["embedding"]), F.transform("x", lambda r: r["m"]), 8)
    return g.select("g", F.round(pooled[0], 6).alias("first"), F.size("x").cast("long").alias("n"))


# ---------------------------------------------------------------- filters and counts


@query("SELECT paper_key, decision, title FROM accepted_paper WHERE decision IS DISTINCT FROM 'poster' AND trim(coalesce(title, '')) <> ''")
def main_papers(spark, d):
    """One kind of record and the rows without a title go; here the kind is a decision."""
    a = table(spark, d, "accepted_paper")
    return H.main_records(a.withColumn("type", F.when(F.col("decision") == "poster", "Editorship").otherwise(F.col("decision")))).select("paper_key", "decision", "title")


@query("SELECT paper_key, query_title FROM (SELECT m.*, CASE WHEN matched THEN 'u' ELSE '' END AS url, CASE WHEN author_ok THEN query_title END AS ident FROM match_result m) WHERE url = '' AND coalesce(ident, '') = ''")
def unlinked(spark, d):
    m = table(spark, d, "match_result").withColumn("url", F.when(F.col("matched"), "u").otherwise("")).withColumn("ident", F.when(F.col("author_ok"), F.col("query_title")))
    return H.needs_link(m, "url", "ident").select("paper_key", "query_title")


@query("SELECT paper_key, venue_short, fetched_at FROM accepted_paper WHERE regexp_matches(venue_short, '^(KDD|ICML|WWW)(2016|2017|2023)$')")
def venue_year_files(spark, d):
    return H.venue_years(table(spark, d, "accepted_paper"), ["KDD", "ICML", "WWW"], [2016, 2017, 2023]).select("paper_key", "venue_short", "fetched_at")


@query("SELECT count(*) AS n_rows, count(DISTINCT arxiv_id) AS n_arxiv_id, count(DISTINCT title) AS n_title FROM corpus_entry")
def id_title_counts(spark, d):
    return H.distinct_counts(table(spark, d, "corpus_entry"), "arxiv_id", "title")


@query("SELECT arxiv_id, title FROM corpus_entry ORDER BY arxiv_id DESC")
def newest_ids(spark, d):
    return H.newest_ids(table(spark, d, "corpus_entry").select("arxiv_id", "title"))


@query("SELECT paper_key, fetched_at, title FROM accepted_paper ORDER BY paper_key, fetched_at, title LIMIT 50")
def first_rows(spark, d):
    """The first fifty papers, the trial-run switch of the index builders."""
    return H.first_rows(table(spark, d, "accepted_paper").select("paper_key", "fetched_at", "title"), 50, "paper_key", "fetched_at", "title")


# ---------------------------------------------------------------- search and evaluation


@query(f"""WITH c AS (SELECT query_id, vec_id, list_distinct(['w' || (query_id % 4), 'v' || (query_id % 5), 'l' || (query_id % 3)]) AS q, ['w' || (vec_id % 4), 'v' || (vec_id % 5), 'l' || (vec_id % 3)] AS t FROM ({core._topk_sql('true', 'q.vec_id % 20 = 0', 30)}))
SELECT query_id, vec_id, round(s, 6) AS rerank_score, r AS rank FROM (SELECT *, len(list_intersect(q, t)) / len(q) AS s, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q, t)) / len(q) DESC, vec_id) AS r FROM c) WHERE r <= 10""")
def rerank_topk(spark, d):
    """The thirty nearest of every query, re-ranked by word overlap of short texts, the best ten kept."""
    e = table(spark, d, "embeddings")
    text = lambda c: F.concat_ws(" ", F.concat(F.lit("w"), F.col(c) % 4), F.concat(F.lit("v"), F.col(c) % 5), F.concat(F.lit("l"), F.col(c) % 3))
    recall, k = S.pool_sizes(10, 30)
    hits = core._topk(e, e.filter("vec_id % 20 = 0"), recall).drop("rank").withColumn("q", text("query_id")).withColumn("t", text("vec_id"))
    got = S.sort_results(S.rerank(hits, S.overlap_score, "q", "t", k))
    return got.select("query_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


_BM_WORDS = "list_filter(string_split(" + core.NT.format("{0}") + ", ' '), lambda w: w <> '')"


@query(f"""WITH dd AS (SELECT doc_id, {_BM_WORDS.format('text')} AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM dd WHERE len(w) > 0), q AS (SELECT item_id AS query_id, unnest(list_distinct({_BM_WORDS.format('text')})) AS word FROM eval_item WHERE item_id % 20 = 0),
p AS (SELECT doc_id, word, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS word FROM dd) GROUP BY 1, 2), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS score FROM q JOIN p USING (word) JOIN f USING (word), n GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def bm25_topk(spark, d):
    """The five texts nearest by BM25 to each evaluation item whose id is divisible by 20, of all texts."""
    w = lambda c: F.filter(F.split(X.normalize_title(c), " "), lambda x: x != "")
    docs = table(spark, d, "documents").select("doc_id", w("text").alias("words"))
    items = table(spark, d, "eval_item").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), w("text").alias("words"))
    return S.bm25_topk(docs, items, 5).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT category, user_id, parent_asin FROM (SELECT *, {core.POS} FROM ({core.DEDUP})) WHERE pos = n), p AS (SELECT category, parent_asin, rank - 1 AS r FROM ({core.POP}) WHERE rank <= 20), x AS (SELECT coalesce(p.r, -1) AS r FROM t LEFT JOIN p USING (category, parent_asin))
SELECT avg(CASE WHEN r BETWEEN 0 AND 4 THEN 1.0 ELSE 0 END) AS recall_5, avg(CASE WHEN r BETWEEN 0 AND 4 THEN 1 / log2(r + 2) ELSE 0 END) AS ndcg_5, avg(CASE WHEN r BETWEEN 0 AND 4 THEN 1.0 / (r + 1) ELSE 0 END) AS mrr_5,
 avg(CASE WHEN r BETWEEN 0 AND 9 THEN 1.0 ELSE 0 END) AS recall_10, avg(CASE WHEN r BETWEEN 0 AND 9 THEN 1 / log2(r + 2) ELSE 0 END) AS ndcg_10, avg(CASE WHEN r BETWEEN 0 AND 9 THEN 1.0 / (r + 1) ELSE 0 END) AS mrr_10 FROM x""")
def evaluate_lists(spark, d):
    """Ranked lists of every user (the popular items of the category) against the held-out item."""
    test = N.leave_one_out(core.deduped(spark, d)).filter("split = 'test'").select("category", F.struct("category", "user_id").alias("query_id"), F.col("parent_asin").alias("target"))
    lists = test.select("category", "query_id").join(core.popularity_topk(spark, d).select("category", "rank", F.col("parent_asin").alias("value")), "category").drop("category")
    return M.evaluate_generated(lists, test.drop("category"))


@query("SELECT venue, max(title_sim) AS title_sim, arg_max(paper_key, (title_sim, -k)) AS run FROM (SELECT paper_key, regexp_extract(paper_key, '^([A-Za-z]+)', 1) AS venue, title_sim, row_number() OVER (ORDER BY paper_key) AS k FROM match_result WHERE title_sim IS NOT NULL) GROUP BY venue")
def best_runs(spark, d):
    """Per venue the logged run with the highest score, the smaller key in a tie."""
    m = table(spark, d, "match_result").select(F.col("paper_key").alias("run"), F.regexp_extract("paper_key", "^([A-Za-z]+)", 1).alias("venue"), "title_sim")
    return M.best_run(m, "title_sim", ["venue"]).select("venue", "title_sim", "run")


@query("""WITH p AS (SELECT DISTINCT user_id AS u, parent_asin AS i FROM interaction WHERE user_id IS NOT NULL AND parent_asin IS NOT NULL), n AS (SELECT i, count(*) AS n FROM p GROUP BY 1), q AS (SELECT i FROM (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM n) WHERE k % 20 = 0),
b AS (SELECT x.i AS query_item, y.i AS parent_asin, count(*) AS b FROM p x JOIN q ON q.i = x.i JOIN p y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2), s AS (SELECT query_item, parent_asin, b.b / sqrt(nq.n * ni.n) AS score FROM b JOIN n nq ON nq.i = query_item JOIN n ni ON ni.i = parent_asin)
SELECT query_item, parent_asin, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_item ORDER BY round(score, 9) DESC, parent_asin) AS rank FROM s) WHERE rank <= 10""")
def item_knn(spark, d):
    """The ten nearest items of every twentieth item (in key order) by shared users, against all items."""
    t = table(spark, d, "interaction")
    ids = M.dense_index(t.filter("user_id is not null"), "parent_asin").filter("item_idx % 20 = 0")
    return N.item_neighbors(t, ids.select(F.col("parent_asin").alias("query_item")), 10).withColumn("score", F.round("score", 6))


_DIMS = 4


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id AS c, e FROM v WHERE vec_id < 8),
a AS (SELECT v.e, b.c, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_dot_product(b.e, b.e) - 2 * list_dot_product(v.e, b.e), 9), b.c) AS r FROM v, b)
SELECT c AS code, {', '.join(f'round(avg(e[{i + 1}]), 6) AS d{i}' for i in range(_DIMS))} FROM a WHERE r = 1 GROUP BY c""")
def kmeans_step(spark, d):
    """One step of k-means from the first eight vectors: every centroid becomes the mean of the vectors nearest to it."""
    e = table(spark, d, "embeddings")
    books = M.fit_residual_kmeans(e, 1, 8, 1, normalize=False, init=core._books(spark, d)[:1])
    rows = [(i, *[round(float(x), 6) for x in c[:_DIMS]]) for i, c in enumerate(books[0])]
    return spark.createDataFrame(rows, "code long, " + ", ".join(f"d{i} double" for i in range(_DIMS)))
