"""Writers. Each goes through Spark's commit protocol; tables that are replaced or upserted are in ``tables``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.functions import text as X
from rankloom.sources.tables import hadoop, write_new


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    w = df.write.mode(mode).options(timestampFormat=S.MICROS, timestampNTZFormat=S.MICROS)  # the default drops microseconds
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_splits(df: DataFrame, path: str, mode: str = "error") -> None:
    """All splits in one scan, one folder per category and split."""
    write_jsonl(df, path, tuple(c for c in ("category", "split") if c in df.columns), mode)


def append_by_year_subject(df: DataFrame, path: str, id_col: str = "arxiv_id", fields: str = "fieldsOfStudy") -> None:
    """Appends records under year and subject folders."""
    write_jsonl(df.withColumn("year_dir", X.year_of(id_col)).withColumn("subject", X.subject_of(fields)), path, ("year_dir", "subject"), "append")


def write_index(df: DataFrame, path: str, domain: str | None = "domain") -> None:
    """Search index: embeddings in the rows of their metadata, one folder per domain. Domains that ``df`` doesn't hold stay as they are."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(domain) if domain and domain in df.columns else w).parquet(path)


def write_codes(df: DataFrame, path: str, key: str, width: int) -> None:
    """Identifier table: (key, codes, digit) with the width of the codebooks and the number of levels in every row."""
    df.select(key, "codes", "digit", F.lit(width).alias("codebook_width"), F.size("codes").alias("num_hierarchies")).write.mode("overwrite").parquet(path)


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """One file per row at ``root/<path>``, written by the tasks; rows without path or content write nothing. ``root`` is a folder all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        n = 0
        for b in batches:
            for name, text in zip(b[path], b[content], strict=True):
                to = f"{base}/{name}"
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(to) as out:
                    out.write(text.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows = df.select(path, content).filter(F.col(path).isNotNull() & F.col(content).isNotNull())
    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def refresh_metadata(index: DataFrame, meta: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Index rows with new metadata and the old embeddings; raises if the two don't hold the same number of rows and keys."""
    out = meta.join(index.select(key, embedding), key)
    a, b, c = index.count(), meta.count(), out.count()
    if not a == b == c:
        raise ValueError(f"index has {a} rows, metadata {b}, common {c}: build the index again")
    return out


def write_stats(stats: DataFrame, folder: str) -> None:
    """stats.json and stats.md of a per-category table (a row per category, so a small one); missing values print as a dash."""
    rows = [r.asDict(recursive=True) for r in stats.collect()]
    cell = lambda v: "—" if v is None else f"{v:,}" if isinstance(v, int) else str(v)
    head = stats.columns
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows)]
    for name, text in (("stats.json", json.dumps(rows, indent=1, default=str)), ("stats.md", "\n".join(lines) + "\n")):
        fresh = f"{folder}/.{name}.{uuid.uuid4().hex}"
        write_new(stats.sparkSession, fresh, text)
        fs, to = hadoop(stats.sparkSession, f"{folder}/{name}")
        fs.delete(to, False)
        fs.rename(hadoop(stats.sparkSession, fresh)[1], to)


def append_new_tsv(df: DataFrame, known: DataFrame, path: str, key: str = "arxiv_id") -> None:
    """Appends rows whose key is new, once per key (the smallest of its rows), as tab-separated text. Tabs and line ends within a value become blanks."""
    rest = [c for c in df.columns if c != key]
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])).alias("_m")).select(key, *[F.col("_m")[f"c{i}"].alias(c) for i, c in enumerate(rest)])
    new = one.join(known.select(key).distinct(), key, "left_anti")
    flat = lambda c: F.regexp_replace(X.text_or_empty(F.col(c).cast("string")), r"[\t\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+", " ")
    new.select(F.concat_ws("\t", *[flat(c) for c in df.columns])).write.mode("append").text(path)
