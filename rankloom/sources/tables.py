"""Parquet tables that are replaced or upserted as a whole or not at all, on any file system Spark can write to.

A table is a folder with ``data/<unique>/_bucket=<b>`` and ``commits/<number>.json``. A commit names, for every bucket, the folders
that hold it; the highest number is the table's state. A commit file is created only if its number is free, which Hadoop file
systems do atomically, so a writer that dies at any point leaves the last state readable and loses nothing, and of two writers
at a time one fails. Commits hold one entry per bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a keyed table; an upsert rewrites only those its keys fall into.
BUCKETS = 64
#: States kept for readers that are still at work on one.
KEPT = 2


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return bool(fs.exists(p))


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob, on the file system the pattern names; none if there are none."""
    fs, p = hadoop(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Creates a small file; raises if it is there."""
    fs, p = hadoop(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class Table:
    """One table below ``path``. ``keys`` are needed for upserts and fix the buckets when the table is first written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys or []), buckets if keys else 1

    def _numbers(self) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[-1][:-5]) for p in matches(self.spark, f"{self.path}/commits/*.json"))

    def state(self) -> dict | None:
        """The current commit, None before the first one. Anything unreadable raises."""
        if not exists(self.spark, f"{self.path}/commits"):
            return None
        n = self._numbers()
        if not n:
            return None
        # a listed commit must be whole: a file that breaks off is an error, never an empty table
        return json.loads(read_text(self.spark, f"{self.path}/commits/{n[-1]:012d}.json")) | {"number": n[-1]}

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        folders = sorted({f"{self.path}/{f}/_bucket={b}" for b, fs in state["buckets"].items() for f in fs if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._read(state)

    def _bucket(self, n: int):
        # null keys are one key; the bucket must not depend on how wide a number is stored
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(n)).cast("int") if self.keys else F.lit(0)

    def _write(self, df: DataFrame, n: int) -> tuple[str, list[int]]:
        folder = f"data/{uuid.uuid4().hex}"
        out = df.withColumn("_bucket", self._bucket(n))
        if n > 1:
            out = out.repartition(n, "_bucket")
        out.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder, [int(p.rsplit("=", 1)[-1]) for p in matches(self.spark, f"{self.path}/{folder}/_bucket=*")]

    def _commit(self, number: int, df: DataFrame, buckets: dict[str, list[str]], n: int) -> None:
        state = {"schema": df.schema.jsonValue(), "keys": self.keys, "n": n, "buckets": buckets}
        write_new(self.spark, f"{self.path}/commits/{number:012d}.json", json.dumps(state))
        self._clean()

    def _clean(self) -> None:
        """Removes commits before the last ``KEPT`` and data that only they name. Data of an unfinished write goes with them."""
        numbers = self._numbers()
        keep = numbers[-KEPT:]
        used = {f for k in keep for fs in json.loads(read_text(self.spark, f"{self.path}/commits/{k:012d}.json"))["buckets"].values() for f in fs}
        fs, _ = hadoop(self.spark, self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for k in numbers[:-KEPT]:
            old = json.loads(read_text(self.spark, f"{self.path}/commits/{k:012d}.json"))
            for f in {f for x in old["buckets"].values() for f in x} - used:
                fs.delete(path(f"{self.path}/{f}"), True)
            fs.delete(path(f"{self.path}/commits/{k:012d}.json"), False)

    def replace(self, df: DataFrame) -> None:
        """Takes ``df`` as the whole table; it may read from the table itself."""
        state = self.state()
        n = state["n"] if state else self.buckets
        folder, got = self._write(df, n)
        self._commit(state["number"] + 1 if state else 0, df, {str(b): [folder] for b in got}, n)

    def upsert(self, batch: DataFrame, version: str) -> None:
        """Merges rows by key, the highest version wins, in a tie the batch. Only buckets with keys of the batch are read and written."""
        from rankloom.operators.harvest import upsert

        if not self.keys:
            raise ValueError("an upsert needs keys")
        state = self.state()
        if state is not None and state["keys"] != self.keys:
            raise ValueError(f"the table at {self.path} is keyed by {state['keys']}")
        n = state["n"] if state else self.buckets
        touched = [r[0] for r in batch.select(self._bucket(n).alias("b")).distinct().collect()]  # at most one row per bucket
        if not touched and state is not None:
            return
        base = self._read(state, touched) if state else batch.limit(0)
        merged = upsert(base, batch, self.keys, version)
        folder, got = self._write(merged, n)
        left = {b: f for b, f in state["buckets"].items() if int(b) not in touched} if state else {}
        self._commit(state["number"] + 1 if state else 0, merged, left | {str(b): [folder] for b in got}, n)
