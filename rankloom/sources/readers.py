"""File readers. Paths that don't exist are the caller's error unless a function says that it skips them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import schemas as S
from rankloom.functions import text as X
from rankloom.sources.tables import matches, read_text


def dataset_path(root: str, category: str, core: str, kind: str, split: str | None = None) -> str:
    """``benchmark/<core>/<kind>/<category>[.<split>].csv`` below the root."""
    return f"{root}/benchmark/{core}/{kind}/{category}{f'.{split}' if split else ''}.csv"


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered four-column CSV of interactions; blank lines are skipped, a value of a wrong type fails the read."""
    return spark.read.schema(S.INTERACTION).csv(path, header=True, mode="FAILFAST", enforceSchema=True)


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines are dropped, missing keys are null."""
    return spark.read.schema(schema).options(mode="DROPMALFORMED", timestampFormat=S.MICROS, timestampNTZFormat=S.MICROS).json(path if isinstance(path, str) else list(path))


def item_meta(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, S.ITEM_META)


def domain_year_paths(spark: SparkSession, root: str, domains: Sequence[str], years: Sequence[int | str]) -> list[str]:
    """Existing folders ``<domain>/<year>``, or ``<year>/<domain>`` where the first is missing, on the file system of ``root``."""
    out = []
    for d in domains:
        for y in years:
            for p in (f"{root}/{d}/{y}", f"{root}/{y}/{d}"):
                if matches(spark, f"{p}/*.json*"):
                    out.append(p)
                    break
    return out


def domain_papers(spark: SparkSession, root: str, domains: Sequence[str], years: Sequence[int | str]) -> DataFrame:
    """Paper records of the domains and years in either layout, with ``domain``; years without files are skipped, records without title and abstract dropped."""
    parts = []
    for d in domains:
        paths = domain_year_paths(spark, root, [d], years)
        if paths:
            parts.append(jsonl(spark, [f"{p}/*.json*" for p in paths], S.PAPER_RECORD).withColumn("domain", F.lit(d)))
    if not parts:
        return spark.createDataFrame([], T.StructType([*S.PAPER_RECORD.fields, T.StructField("domain", T.StringType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter((X.text_or_empty("title") != "") | (X.text_or_empty("abstract") != ""))


def count_lines(spark: SparkSession, paths: Sequence[str]) -> int:
    """Non-blank lines."""
    return spark.read.text(list(paths)).filter(X.strip("value") != "").count() if paths else 0


def has_data(spark: SparkSession, root: str, domain: str, years: Sequence[int | str]) -> bool:
    return bool(domain_year_paths(spark, root, [domain], years))


def load_config(spark: SparkSession, path: str) -> dict:
    """A settings file as a dictionary: YAML where a parser is installed, JSON anyway. An empty file gives no settings."""
    text = read_text(spark, path)
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML settings needs the package yaml") from e
    return yaml.safe_load(text) or {}


def flatten_config(nested: dict, prefix: str = "") -> dict:
    """Nested settings as one level with dotted keys; empty groups vanish."""
    out: dict = {}
    for k, v in nested.items():
        out |= flatten_config(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def nest_config(flat: dict) -> dict:
    """The inverse of ``flatten_config``."""
    out: dict = {}
    for k, v in flat.items():
        *groups, last = k.split(".")
        at = out
        for g in groups:
            at = at.setdefault(g, {})
        at[last] = v
    return out


def markdown_dir(spark: SparkSession, root: str, host: str = "arxiv.org") -> DataFrame:
    """One row per ``*.md`` file below the root (``readme.md`` and blank files excluded) with the fields taken from path and text."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("uri"))
    base = os.path.abspath(re.sub(r"^file:/*", "/", root))
    path = F.regexp_replace(F.url_decode(F.regexp_replace("uri", r"\+", "%2B")), r"^file:/+", "/")
    rel = F.regexp_replace(F.expr(f"substring(path, {len(base) + 2})"), r"\.md$", "")
    df = raw.withColumn("path", path).withColumn("paper_id", rel).withColumn("stem", F.element_at(F.split("paper_id", "/"), -1))
    df = df.filter((F.lower("stem") != "readme") & (X.strip("value") != ""))
    meta = X.filename_meta("stem")
    parts = F.split("paper_id", "/")
    return df.select(
        "paper_id", X.markdown_title("value", "stem").alias("title"), F.when(F.size(parts) > 1, parts[0]).otherwise("Unknown").alias("company"), X.markdown_arxiv_url("value", host).alias("arxiv_url"),
        "path", F.col("value").alias("content"), meta["venue"].alias("venue"), meta["is_preprint"].alias("is_preprint"), meta["pub_date"].alias("pub_date"), meta["pub_year"].alias("pub_year"),
    )


def title_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated id, title, author (sharded files by glob); lines without a title are dropped, quotes are ordinary text."""
    df = spark.read.schema(S.TITLE_INDEX).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path if isinstance(path, str) else list(path))
    return df.filter(X.strip(X.text_or_empty("title")) != "")


def keyed_json(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """``{topic: {key: record}}`` as rows (topic, key, fields...)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), record))).alias("m"))
    topics = raw.select(F.explode("m").alias("topic", "recs"))
    return topics.select("topic", F.explode("recs").alias("key", "rec")).select("topic", "key", "rec.*")


def list_json(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """The variant that is a bare list of records."""
    return spark.read.schema(record).option("multiLine", True).json(path)


OAI_RECORD = T.StructType([T.StructField("metadata", T.StructType([T.StructField("arXiv", T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("authors", T.StructType([T.StructField("author", T.ArrayType(T.StructType([T.StructField("keyname", T.StringType()), T.StructField("forenames", T.StringType())])))])),
]))]))])


def oai_pages(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id, title, first_author) of harvested XML pages; records without metadata (deleted ones) are dropped."""
    df = spark.read.format("xml").option("rowTag", "record").schema(OAI_RECORD).load(path)
    a = F.try_element_at(F.col("metadata.arXiv.authors.author"), F.lit(1))
    squeeze = lambda c: X.strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return df.filter(F.col("metadata.arXiv.id").isNotNull()).select(
        X.strip("metadata.arXiv.id").alias("arxiv_id"), squeeze("metadata.arXiv.title").alias("title"), squeeze(F.concat_ws(" ", a["forenames"], a["keyname"])).alias("first_author")
    )


def resumption_token(body: str) -> str | None:
    """Token of a page, None on the last one."""
    import re

    m = re.search(r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", body)
    return m.group(1).strip() or None if m else None


def anthology_volumes(spark: SparkSession, path: str, volumes: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """Papers of the main volumes; text inside inline markup is kept, the tags go."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<volume\b.*?</volume>)"), 1)).alias("v"))
    # the volume's name is taken before its papers are, so that no paper's row carries the text of the volume
    rows = rows.select(F.regexp_extract("v", r'<volume\b[^>]*\bid="([^"]*)"', 1).alias("volume"), "v").filter(F.col("volume").isin(*volumes))
    rows = rows.select("volume", F.explode(F.regexp_extract_all("v", F.lit(r"(?s)(<paper\b.*?</paper>)"), 1)).alias("p"))
    text = lambda tag: X.strip(F.regexp_replace(F.coalesce(F.expr(f"xpath_string(p, 'paper/{tag}')"), F.lit("")), r"(?U)\s+", " "))
    names = F.expr("zip_with(xpath(p, 'paper/author/first/text()'), xpath(p, 'paper/author/last/text()'), (f, l) -> trim(concat_ws(' ', f, l)))")
    return rows.select("volume", text("title").alias("title"), F.array_join(names, ", ").alias("authors"), text("abstract").alias("abstract"), text("url").alias("url"))


def one_or_many(raw: str, record: T.DataType):
    """Column of an array from JSON text that holds one record or a list of them."""
    c = F.col(raw)
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, T.ArrayType(record))).when(c.isNotNull(), F.array(F.from_json(c, record)))


def numbered_volumes(pages: Sequence[Sequence[dict]]) -> list[dict]:
    """Hits of the numbered volumes of a venue, in order, up to the first empty one."""
    return [hit for page in takewhile(bool, pages) for hit in page]


def toc_hits(spark: SparkSession, path: str) -> DataFrame:
    """(key, type, title, authors) of table-of-contents records, one JSON record a line; ``authors.author`` is one record or a list of them."""
    raw = spark.read.schema("key string, info string").option("primitivesAsString", True).json(path)
    name = T.StructType([T.StructField("text", T.StringType())])
    get = lambda p: F.get_json_object("info", p)
    df = raw.select("key", get("$.type").alias("type"), get("$.title").alias("title"), get("$.authors.author").alias("_a"))
    return df.withColumn("authors", F.array_join(F.transform(F.coalesce(one_or_many("_a", name), F.array().cast("array<struct<text:string>>")), lambda a: X.clean_author(a["text"])), ", ")).drop("_a")


def unwrap_value(raw: str):
    """Text of a JSON value that may be wrapped as ``{"value": x}``."""
    return F.coalesce(F.get_json_object(raw, "$.value"), F.get_json_object(raw, "$"), F.col(raw))


def splits(spark: SparkSession, root: str, category: str, maxlen: int) -> DataFrame:
    """The three split folders of a sequence data set with ``split``; ``validation`` becomes ``valid``."""
    out = None
    for folder, name in (("train", "train"), ("validation", "valid"), ("test", "test")):
        part = jsonl(spark, f"{root}/seq_maxlen{maxlen}_{category}/{folder}", S.SEQUENCE).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
