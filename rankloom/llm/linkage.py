"""Shared parts of the two linkage operators: blocking on rare words and surnames, mixture fitting over distributed pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_one(words: Column) -> Column:
    """Hashes of a word array as it is and with each single word left out, in any order: two arrays that differ by one changed, added or dropped word share one."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    whole = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    return F.when(F.size(words) > 1, F.array_distinct(F.concat(F.array(whole), F.transform(each, lambda x: whole.bitwiseXOR(x))))).otherwise(F.array(whole))


def deletions(word: Column, most: int) -> Column:
    """A word as it is and with up to ``most`` letters left out: two words within that edit distance (an exchange of neighbours counts two) share one."""
    less = lambda w: F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.concat(F.substring(w, 1, i), F.substring(w, i + 2, F.length(w))))
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, less)))
    return out


def one_edit(word: Column, letters: str) -> Column:
    """All strings one error away from a word (a letter of ``letters`` changed or added, a letter dropped, neighbours exchanged) and the word itself."""
    n = F.length(word)
    left, right = lambda i: F.substring(word, 1, i), lambda i: F.substring(word, i + 1, n)
    drop = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(left(i), right(i + 1)))
    swap = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(left(i), F.substring(word, i + 2, 1), F.substring(word, i + 1, 1), right(i + 2)))
    every = F.array(*[F.lit(c) for c in letters])
    more = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(every, lambda c: F.concat(left(i), c, right(i)))))
    other = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(every, lambda c: F.concat(left(i), c, right(i + 1)))))
    return F.array_distinct(F.concat(drop, swap, more, other))


def rare_prefix(df: DataFrame, keys: list[str], words: str, freq: DataFrame, jaccard: float, shared: int = 2) -> DataFrame:
    """Adds ``rare``: of n words the n - ceil(jaccard * n) + ``shared`` rarest, in rarity order. Two arrays that reach the Jaccard share at least ``shared`` of them (or all, if they have fewer)."""
    each = df.select(*keys, F.size(words).alias("_n"), F.explode(words).alias("word")).join(freq, "word")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("f", "word"))
    kept = each.withColumn("_at", at).filter(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * jaccard) + shared)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("word")).alias("rare"))  # at most the words of one title


def word_pairs(rare: Column) -> Column:
    """All pairs of a sorted word array as hashes; a single word stands for itself."""
    n = F.size(rare)
    pairs = F.flatten(F.transform(rare, lambda a, i: F.transform(F.slice(rare, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.xxhash64(a, b))))
    return F.when(n > 1, pairs).otherwise(F.transform(rare, lambda a: F.xxhash64(a)))


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew so that no run of equal keys straddles two of them."""
    held: pd.DataFrame | None = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        last = (b[key] == b[key].iloc[-1]).to_numpy()
        held, b = b[last], b[~last]
        if len(b):
            yield b.reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def partial_sums(pairs: DataFrame, stats: Callable[[pd.DataFrame], np.ndarray], size: int, key: str) -> np.ndarray:
    """Sum over all rows of a fixed-length vector that ``stats`` computes for whole groups of ``key``; one vector per partition leaves the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in whole_groups(batches, key):
            total += stats(b)
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    got = pairs.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out
