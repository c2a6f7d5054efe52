"""Named queries of readers, writers and streams: each writes a whole standard table in a foreign layout and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import text as X
from rankloom.operators import harvest as H
from rankloom.operators import interactions as N
from rankloom.operators import semid as M
from rankloom.operators.resolve import latest_by
from rankloom.plans import core
from rankloom.plans.core import _work_dir, query
from rankloom.session import cut, table
from rankloom.sources import readers as R
from rankloom.sources import writers as W
from rankloom.sources.tables import Table
from rankloom.streaming import ingest as I

_CLEAN = r"regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]+', '', 'g')"


def _printable(c: str) -> F.Column:
    """XML holds no control characters."""
    return F.regexp_replace(X.text_or_empty(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", "")


def _xml(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _rows_of(df: DataFrame, n: int = 20_000) -> F.Column:
    """A shard number with about ``n`` rows each, so that a file that has to be written as one value stays small."""
    return F.pmod(F.xxhash64(df.columns[0]), F.lit(max(1, -(-df.count() // n))))


@query("SELECT user_id, parent_asin, rating, ts_ms AS timestamp FROM interaction")
def ratings_csv(spark, d):
    path = R.dataset_path(_work_dir(spark), "All", "0core", "rating_only")
    table(spark, d, "interaction").select("user_id", "parent_asin", "rating", F.col("ts_ms").alias("timestamp")).write.csv(path, header=True)
    return R.ratings_csv(spark, path)


@query("SELECT parent_asin, title, main_category, store, price, rating_number, coalesce(len(features), -1) AS n_features, coalesce(len(images), -1) AS n_images, details FROM item_meta WHERE title IS NOT NULL OR parent_asin IS NOT NULL")
def item_meta_jsonl(spark, d):
    """Every line comes with a broken and a blank one, which the reader drops."""
    m, path = table(spark, d, "item_meta"), f"{_work_dir(spark)}/meta_All.jsonl"
    m.select(F.concat(F.to_json(F.struct(*m.columns)), F.lit('\n\n{"parent_asin": "broken'))).write.text(path)
    i = R.item_meta(spark, path)
    return i.select("parent_asin", "title", "main_category", "store", "price", "rating_number", F.coalesce(F.array_size("features"), F.lit(-1)).alias("n_features"), F.coalesce(F.array_size("images"), F.lit(-1)).alias("n_images"), "details")


@query("SELECT arxiv_id, title, pub_year AS year, md5(coalesce(abstract, '-')) AS digest, 'All' AS domain FROM arxiv_paper WHERE pub_year IS NOT NULL AND (coalesce(title, '') <> '' OR coalesce(abstract, '') <> '')")
def domain_year_jsonl(spark, d):
    """Even years below the domain, odd ones in the other layout, and years without a folder."""
    root = _work_dir(spark)
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "title", "abstract", F.col("pub_year").alias("year")).filter("year is not null")
    years = sorted(r[0] for r in a.select("year").distinct().collect())  # a few dozen calendar years
    for y in years:
        W.write_jsonl(a.filter(F.col("year") == y), f"{root}/All/{y}" if y % 2 == 0 else f"{root}/{y}/All")
    got = R.domain_papers(spark, root, ["All", "None"], [1800, *years, 2999])
    return got.select("arxiv_id", "title", "year", F.md5(F.coalesce("abstract", F.lit("-"))).alias("digest"), "domain")


@query("SELECT * FROM (VALUES ('documents', 2019, true), ('documents', 2020, false), ('nothing', 2019, false)) v(domain, year, there)")
def domain_has_data(spark, d):
    root = _work_dir(spark)
    W.write_jsonl(table(spark, d, "documents").select("doc_id", "lang"), f"{root}/documents/2019")
    rows = [(x, y, R.has_data(spark, root, x, [y])) for x, y in (("documents", 2019), ("documents", 2020), ("nothing", 2019))]
    return spark.createDataFrame(rows, "domain string, year int, there boolean")


@query(r"SELECT sum(len(list_filter(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: regexp_replace(x, '[\s\x0b\p{Z}\x{85}\x1c-\x1f]+', '', 'g') <> '')))::BIGINT AS n_lines FROM paper")
def line_count(spark, d):
    path = f"{_work_dir(spark)}/lines"
    table(spark, d, "paper").select("content").filter("content is not null").write.text(path)
    return spark.createDataFrame([(R.count_lines(spark, [path]),)], "n_lines long")


@query(rf"""SELECT paper_id, coalesce(nullif(trim(regexp_extract(content, '(?m)^\s*#\s+(.*\S)\s*$', 1)), ''), stem) AS title, {core._DISPLAY} AS venue, token = 'arxiv' AS is_preprint, CASE WHEN dd <> '' THEN dd[1:4] || '-' || dd[5:6] || '-' || dd[7:8] ELSE '' END AS pub_date,
 dd[1:4] AS pub_year, CASE WHEN contains(paper_id, '/') THEN split_part(paper_id, '/', 1) ELSE 'Unknown' END AS company, regexp_extract(content, 'https?://arxiv\.example/abs/[^\s)\]]+') AS arxiv_url FROM (SELECT *, lower(regexp_extract(stem, '^([^_]+)_([^_]+)_(\d{{8}})_', 2)) AS token,
 regexp_extract(stem, '^([^_]+)_([^_]+)_(\d{{8}})_', 3) AS dd FROM (SELECT paper_id, max(content) AS content, string_split(paper_id, '/')[-1] AS stem FROM paper WHERE paper_id IS NOT NULL GROUP BY paper_id) WHERE lower(stem) <> 'readme' AND {core.stripped_sql('content')} <> '')""")
def markdown_files(spark, d):
    """One file per paper, written by the tasks and read back with the fields of path and text."""
    root = _work_dir(spark)
    p = table(spark, d, "paper").filter("paper_id is not null").groupBy("paper_id").agg(F.max("content").alias("content"))
    W.write_files(p.select(F.concat("paper_id", F.lit(".md")).alias("path"), "content"), root)
    return R.markdown_dir(spark, root, "arxiv.example").select("paper_id", "title", "venue", "is_preprint", "pub_date", "pub_year", "company", "arxiv_url")


_FLAT = r"regexp_replace(coalesce({0}, ''), '[\t\r\n\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g')"


@query(f"""SELECT arxiv_id, {_FLAT.format('title')} AS title, nullif({_FLAT.format('surname')}, '') AS first_author FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY title NULLS FIRST, surname NULLS FIRST) AS rn FROM corpus_entry WHERE arxiv_id IS NOT NULL)
WHERE rn = 1 AND {core.stripped_sql(_FLAT.format('title'))} <> ''""")
def title_index_tsv(spark, d):
    """Half of the identifiers first, then all rows, of which only those with new identifiers are appended."""
    path = f"{_work_dir(spark)}/index"
    c = table(spark, d, "corpus_entry").select("arxiv_id", "title", "surname")
    first = c.filter(F.pmod(F.xxhash64("arxiv_id"), F.lit(2)) == 0)
    W.append_new_tsv(first, c.select("arxiv_id").limit(0), path)
    W.append_new_tsv(c, first, path)
    return R.title_index(spark, path)


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY fetched_at DESC NULLS LAST, title DESC NULLS LAST, authors DESC NULLS LAST, venue_short DESC NULLS LAST) AS rn FROM accepted_paper WHERE paper_key IS NOT NULL) WHERE rn = 1)"


def _accepted(spark, d) -> DataFrame:
    a = table(spark, d, "accepted_paper").select("paper_key", "fetched_at", "title", "authors", "venue_short").filter("paper_key is not null")
    return cut(latest_by(a, ["paper_key"], ["fetched_at"]))


@query(f"SELECT venue_short AS topic, paper_key AS key, title, authors FROM {_LATEST} WHERE venue_short IS NOT NULL")
def keyed_json(spark, d):
    """Files ``{topic: {key: record}}``, a topic in shards."""
    root, a = _work_dir(spark), _accepted(spark, d).filter("venue_short is not null")
    files = a.withColumn("shard", _rows_of(a)).groupBy("venue_short", "shard").agg(F.map_from_entries(F.collect_list(F.struct("paper_key", F.struct("title", "authors")))).alias("m"))
    files = files.select(F.concat("venue_short", F.lit("."), "shard", F.lit(".json")).alias("path"), F.to_json(F.create_map("venue_short", "m")).alias("content"))
    W.write_files(files, root)
    return R.keyed_json(spark, root, T.StructType([T.StructField("title", T.StringType()), T.StructField("authors", T.StringType())]))


@query("SELECT arxiv_id, coalesce(title, '') AS title FROM arxiv_paper")
def list_json(spark, d):
    """Files that are one bare list of records each."""
    root, a = _work_dir(spark), table(spark, d, "arxiv_paper").select("arxiv_id", F.coalesce("title", F.lit("")).alias("title"))
    files = a.groupBy(_rows_of(a).alias("shard")).agg(F.to_json(F.collect_list(F.struct("arxiv_id", "title"))).alias("content"))
    W.write_files(files.select(F.concat(F.col("shard").cast("string"), F.lit(".json")).alias("path"), "content"), root)
    return R.list_json(spark, root, T.StructType([T.StructField("arxiv_id", T.StringType()), T.StructField("title", T.StringType())]))


_SQUEEZED = r"trim(regexp_replace({0}, '[\s\x0b\p{{Z}}\x{{85}}\x1c-\x1f]+', ' ', 'g'))"


@query(f"SELECT arxiv_id, {_SQUEEZED.format(_CLEAN.format('title'))} AS title, {_SQUEEZED.format(_CLEAN.format('surname'))} AS first_author FROM corpus_entry WHERE arxiv_id IS NOT NULL")
def oai_xml(spark, d):
    """Harvested pages, each record followed by a deleted one without metadata."""
    root, c = _work_dir(spark), table(spark, d, "corpus_entry").filter("arxiv_id is not null")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), _xml(c), F.lit(f"</{n}>"))
    rec = F.concat(F.lit("<record><metadata><arXiv>"), tag("id", F.col("arxiv_id")), tag("title", _printable("title")), F.lit("<authors><author>"), tag("keyname", _printable("surname")), F.lit("</author></authors></arXiv></metadata></record><record><header status='deleted'/></record>"))
    pages = c.select("arxiv_id", rec.alias("r"))
    pages = pages.groupBy(_rows_of(pages, 1000).alias("shard")).agg(F.array_join(F.collect_list("r"), "\n").alias("x"))
    W.write_files(pages.select(F.concat(F.col("shard").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit("<ListRecords>"), "x", F.lit("</ListRecords>")).alias("content")), root)
    got = R.oai_pages(spark, root)
    blank = lambda c: F.trim(F.regexp_replace(X.text_or_empty(c), r"(?U)\s+", " ")).alias(c)
    return got.select("arxiv_id", blank("title"), blank("first_author"))


_VOLUME = "CASE length(paper_key) % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'demo' END"


@query(f"SELECT {_VOLUME} AS volume, {_SQUEEZED.format(_CLEAN.format('title'))} AS title, {_SQUEEZED.format(_CLEAN.format('authors'))} AS authors FROM {_LATEST} WHERE {_VOLUME} <> 'demo'")
def anthology_xml(spark, d):
    """Volume files with inline markup in the titles; only the main volumes are read."""
    root, a = _work_dir(spark), _accepted(spark, d)
    name = F.transform(F.filter(F.split(X.strip(F.regexp_replace(_printable("authors"), r"(?U)\s+", " ")), ", ?"), lambda n: n != ""), lambda n: F.concat(F.lit("<author><first>"), _xml(F.regexp_replace(n, r" ?[^ ]+$", "")), F.lit("</first><last>"), _xml(F.regexp_extract(n, r"([^ ]+)$", 1)), F.lit("</last></author>")))
    title = F.regexp_replace(_xml(_printable("title")), r"^(\w+)", "<b>$1</b>")
    paper = F.concat(F.lit('<paper id="1"><title>'), title, F.lit("</title>"), F.array_join(name, ""), F.lit("</paper>"))
    p = a.select(F.expr(_VOLUME).alias("volume"), paper.alias("p"), _rows_of(a).alias("shard"))
    files = p.groupBy("volume", "shard").agg(F.array_join(F.collect_list("p"), "\n").alias("x"))
    files = files.select(F.concat("volume", F.lit("."), "shard", F.lit(".xml")).alias("path"), F.concat(F.lit('<collection><volume id="'), "volume", F.lit('">'), "x", F.lit("</volume></collection>")).alias("content"))
    W.write_files(files, root)
    return R.anthology_volumes(spark, root).select("volume", "title", "authors")


@query(rf"""SELECT paper_key AS key, title, coalesce(array_to_string([{core.stripped_sql(r"regexp_replace(n, '\s+\d{4}$', '')")} FOR n IN string_split(authors, ', ')], ', '), '') AS authors FROM {_LATEST} WHERE length(title) % 7 <> 0 AND {core.stripped_sql("coalesce(title, '')")} <> ''""")
def toc_records(spark, d):
    """Tables of contents whose author field is one record or a list; front matter and rows without a title go."""
    path, a = f"{_work_dir(spark)}/toc", _accepted(spark, d)
    names = F.transform(F.split("authors", ", "), lambda n: F.struct(n.alias("text")))
    author = F.when(F.size(names) == 1, F.to_json(names[0])).when(F.col("authors").isNotNull(), F.to_json(names))
    kind = F.when(F.length("title") % 7 == 0, "Editorship").otherwise("Conference")
    js = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")
    info = F.concat(F.lit('{"type":"'), kind, F.lit('","authors":{"author":'), F.coalesce(author, F.lit("[]")), F.lit('},"title":'), F.when(F.col("title").isNull(), "null}").otherwise(F.concat(js(F.col("title")), F.lit("}"))))
    a.select(F.concat(F.lit('{"key":'), js(F.col("paper_key")), F.lit(',"info":'), info, F.lit("}"))).write.text(path)
    return H.main_records(R.toc_hits(spark, path)).select("key", "title", "authors")


@query("SELECT paper_key, run_at, query_title AS title FROM match_result")
def unwrapped_values(spark, d):
    """Values as they are and as ``{"value": x}``."""
    m = table(spark, d, "match_result").withColumn("raw", F.when(F.length("query_title") % 2 == 0, F.to_json(F.struct(F.col("query_title").alias("value")))).otherwise(F.regexp_replace(F.to_json(F.struct(F.col("query_title").alias("x"))), r'^\{"x":|\}$', "")))
    return m.select("paper_key", "run_at", R.unwrap_value("raw").alias("title"))


@query(r"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY fetched_at DESC NULLS LAST, title DESC NULLS LAST, authors DESC NULLS LAST, pub_year DESC NULLS LAST, domain DESC NULLS LAST) AS rn FROM arxiv_paper WHERE arxiv_id IS NOT NULL) WHERE rn = 1)
SELECT i.arxiv_id, l.title, array_to_string([trim(x) FOR x IN string_split(l.authors, ';')], '; ') AS authors, l.pub_year AS year, l.domain AS "fieldsOfStudy", l.arxiv_id IS NOT NULL AS found FROM (SELECT DISTINCT arxiv_id FROM corpus_entry WHERE arxiv_id IS NOT NULL) i LEFT JOIN l USING (arxiv_id)""")
def batch_lookup(spark, d):
    """Asked identifiers with their flattened records; misses come out as such."""
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", "title", "authors", "pub_year", "domain").filter("arxiv_id is not null")
    one = latest_by(a, ["arxiv_id"], ["fetched_at"])
    names = F.transform(F.split("authors", ";"), lambda n: F.struct(F.trim(n).alias("name")))
    rec = F.struct(F.lit(None).cast("long").alias("corpusId"), "title", names.alias("authors"), F.col("pub_year").alias("year"), F.array("domain").alias("fieldsOfStudy"))
    got = H.flatten_record(H.batch_results(table(spark, d, "corpus_entry"), one.select("arxiv_id", rec.alias("rec"))))
    return got.select("arxiv_id", "title", "authors", "year", F.nullif("fieldsOfStudy", F.lit("")).alias("fieldsOfStudy"), "found")


@query(core._seq_sql(20))
def hub_splits(spark, d):
    """The sequence data set in its published layout, one folder per category and split."""
    root = _work_dir(spark)
    s = cut(N.sequences(core.deduped(spark, d), 20).withColumn("timestamp", F.col("ts_ms")))
    cats = sorted(r[0] for r in s.select("category").distinct().collect())  # a handful of categories
    out = None
    for c in cats:
        for folder, name in (("train", "train"), ("validation", "valid"), ("test", "test")):
            W.write_jsonl(s.filter((F.col("category") == c) & (F.col("split") == name)).select("user_id", "parent_asin", "rating", "timestamp", "history"), f"{root}/seq_maxlen20_{c}/{folder}")
        part = R.splits(spark, root, c, 20).withColumn("category", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out.select("category", "user_id", "parent_asin", "split", F.array_join("history", " ").alias("history"))


@query(f"SELECT category, user_id, parent_asin, ts_ms, {core.SPLIT} AS split FROM (SELECT *, {core.POS} FROM ({core.DEDUP}))")
def split_files(spark, d):
    path = f"{_work_dir(spark)}/splits"
    W.write_splits(N.leave_one_out(core.deduped(spark, d)).select("category", "user_id", "parent_asin", "ts_ms", "split"), path)
    return spark.read.schema("user_id string, parent_asin string, ts_ms long, category string, split string").json(path).select("category", "user_id", "parent_asin", "ts_ms", "split")


@query(core.SQL["category_stats"])
def stats_files(spark, d):
    folder, s = f"{_work_dir(spark)}/stats", core.category_stats(spark, d)
    W.write_stats(s, folder)
    return R.list_json(spark, f"{folder}/stats.json", s.schema)


@query(r"""SELECT arxiv_id, fetched_at, subject, CASE WHEN regexp_matches(arxiv_id, '^\d{4}\.') THEN '20' || substr(arxiv_id, 1, 2) WHEN regexp_matches(arxiv_id, '^[A-Za-z\-]+(\.[A-Z]{2})?/\d{5,}') THEN CAST(CASE WHEN CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) >= 91 THEN 1900 ELSE 2000 END + CAST(regexp_extract(arxiv_id, '/(\d{2})', 1) AS INT) AS VARCHAR) ELSE 'unknown_year' END AS year_dir
FROM (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(trim(split_part(coalesce(domain, ''), ';', 1)), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'Unknown') AS subject FROM arxiv_paper)""")
def year_subject_files(spark, d):
    """Two appends below year and subject folders."""
    path = f"{_work_dir(spark)}/by_year"
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", F.col("domain").alias("fieldsOfStudy"))
    half = F.pmod(F.xxhash64("arxiv_id"), F.lit(2)) == 0
    for part in (a.filter(half), a.filter(~half)):
        W.append_by_year_subject(part, path)
    return R.jsonl(spark, path, T.StructType.fromDDL("arxiv_id string, fetched_at timestamp_ntz, year_dir string, subject string"))


@query("SELECT parent_asin, rating_number + 1 AS rating_number FROM item_meta WHERE rating_number IS NOT NULL")
def table_replace(spark, d):
    """A table replaced by what is read from itself."""
    t = Table(spark, f"{_work_dir(spark)}/items")
    t.replace(table(spark, d, "item_meta").select("parent_asin", "rating_number"))
    t.replace(t.read().filter("rating_number is not null").withColumn("rating_number", F.col("rating_number") + 1))
    return t.read()


@query("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE label % 2 = 1 OR vec_id % 3 = 0")
def index_by_domain(spark, d):
    """Domains are built one set after the other and one set anew; the others stay."""
    path, e = f"{_work_dir(spark)}/index", table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    for part in (e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), e.filter("label % 2 = 0 and vec_id % 3 = 0")):
        W.write_index(part, path, "label")
    got = spark.read.parquet(path)
    kept = e.filter("label % 2 = 0 and vec_id % 3 = 0").select("label").distinct()  # an even label without such rows keeps its first build
    got = got.filter("label % 2 = 1").unionByName(got.filter("label % 2 = 0").join(kept, "label", "left_semi").select(got.columns))
    return got.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id, label + 100 AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def metadata_refresh(spark, d):
    """New metadata under old vectors, guarded by equal counts."""
    path, e = f"{_work_dir(spark)}/index", table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    W.write_index(e, path, None)
    out = W.refresh_metadata(spark.read.parquet(path), e.select("vec_id", (F.col("label") + 100).alias("label")), "vec_id")
    return out.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"SELECT vec_id, c1, c2, row_number() OVER (PARTITION BY c1, c2 ORDER BY vec_id) - 1 AS digit, 8 AS codebook_width, 2 AS num_hierarchies FROM ({core.ENCODE})")
def codes_table(spark, d):
    """Identifier table, with the check that no code is shared by more rows than allowed."""
    path, e = f"{_work_dir(spark)}/codes", table(spark, d, "embeddings")
    c = M.collision_digit(M.encode(e, core._books(spark, d), normalize=False), order="vec_id", width=e.count())
    W.write_codes(c, path, "vec_id", 8)
    return spark.read.parquet(path).select("vec_id", F.col("codes")[0].alias("c1"), F.col("codes")[1].alias("c2"), "digit", "codebook_width", "num_hierarchies")


@query(core.SQL["keyed_upsert"])
def stream_upsert(spark, d):
    """The fetch log as files that arrive, upserted batch by batch into a keyed table."""
    work = _work_dir(spark)
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at", "citation_count", "title")
    a.repartition(4).write.parquet(f"{work}/in")
    I.run_upsert(I.file_stream(spark, f"{work}/in", a, max_files=2), f"{work}/papers", f"{work}/ckpt", ["arxiv_id"], "fetched_at")
    return Table(spark, f"{work}/papers").read()


@query("SELECT DISTINCT arxiv_id FROM arxiv_paper WHERE arxiv_id IS NOT NULL AND fetched_at IS NOT NULL")
def stream_new_ids(spark, d):
    """A harvest that stops and goes on: half of the files first, then the rest from the same checkpoint."""
    work = _work_dir(spark)
    a = table(spark, d, "arxiv_paper").select("arxiv_id", "fetched_at").filter("fetched_at is not null")
    half = F.pmod(F.xxhash64("arxiv_id", "fetched_at"), F.lit(2)) == 0
    for part in (a.filter(half), a.filter(~half)):
        part.write.mode("append").parquet(f"{work}/in")
        I.run_new_keys(I.file_stream(spark, f"{work}/in", a), f"{work}/new", f"{work}/ckpt", "arxiv_id", "fetched_at", late="36500 days")
    return spark.read.parquet(f"{work}/new").select("arxiv_id")
