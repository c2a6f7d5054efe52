"""Problem 7: evaluation passages inside training text.

Word windows in proportion to the item are embedded by a CGK random walk, which turns edits (a word changed, dropped or added) into
few differing places of a fixed-length string. Bit sampling over these places gives hash keys; items and texts with a window of
equal key are candidates. How many embeddings are needed for the target recall is worked out for every window size by trial on
random items (``tables_for``). Candidates are verified exactly, by the alignment of item and text word by word: the text must hold
half of the item's words in their order, in at most two runs.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import chars as C
from rankloom.session import cut


@dataclass(frozen=True)
class LeakConfig:
    """``share`` of an item's words that a text must hold; ``recall`` that the candidates reach at a ``change`` rate of words.

    An item is held by half at least, in one or two runs, so a run may be a quarter of it and changed words part it further: windows are
    a seventh of the item (``window_size``), with as many sampled places as words. Above ``max_items`` items the keys of both sides are
    joined instead of sending the items to the texts; the rows are the same.
    """

    share: float = 0.5
    recall: float = 0.95
    change: float = 0.16
    seed: int = 11
    max_items: int = 100_000


#: Words that may differ between two matches of a run, on either side; what a differing word costs a run, in matching words; the least words of a run.
GAP, COST, RUN = 3, 2.0, 5
#: Items with fewer words have windows of three words that must be equal.
SHORT = 28


_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")


def leak_words(text: str | None) -> list[str]:
    """Words of a text in the form that case, punctuation, layout and encoding don't change."""
    if not text:
        return []
    if not text.isascii():
        text = C.fold(C.undo_mojibake(text))
    return _WORDS.findall(re.sub(r"[-‐]\r?\n\s*(?=[a-z])|<[^>]{1,40}>|&(?:nbsp|amp|lt|gt|quot|#\d+);", " ", text).lower())


@F.pandas_udf(T.StringType())
def _opening(text: pd.Series) -> pd.Series:
    first = (_SENTENCE.split(t, maxsplit=1) for t in text)
    return pd.Series([" ".join(leak_words(p[0])) if len(p) > 1 else None for p in first], dtype=object)


def shared_openings(items: DataFrame, text_col: str, n: int) -> set[tuple[str, ...]]:
    """Opening sentences of at least a twentieth of ``n`` items (and five), counted over all of them: at most twenty rows reach the driver."""
    seen = items.select(_opening(text_col).alias("o")).filter("o is not null").groupBy("o").count().filter(F.col("count") >= max(5, n // 20))
    return {tuple(r["o"].split()) for r in seen.collect()}


def strip_shared(text: str, known: set[tuple[str, ...]]) -> list[str]:
    """Words of an item without an opening sentence that is ``known`` to be shared."""
    first = _SENTENCE.split(text or "", maxsplit=1)
    return leak_words(first[1] if len(first) > 1 and tuple(leak_words(first[0])) in known else text)


#: Window sizes beside three. Larger ones would hold changed words nearly always and need ever more tables; long items have the more windows of the largest.
SIZES = (4, 6, 9, 14)


def window_size(n: int) -> int:
    """The largest of the sizes that is at most a seventh of ``n`` words; 3 for short items."""
    return max([3, *(s for s in SIZES if n >= SHORT and s <= n / 7)])


def _word_ids(words: list[str], ids: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        v = ids.get(w)
        if v is None:
            if len(ids) > 500_000:
                ids.clear()
            v = ids[w] = xxhash.xxh64_intdigest(w)
        out[k] = v
    return out


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def table_keys(ids: np.ndarray, starts: np.ndarray, size: int, table: int, seed: int = LeakConfig.seed) -> np.ndarray:
    """Hash keys of the windows of ``size`` words from ``starts`` in one embedding, all windows walked at once.

    At step j a walk writes the word it stands on and moves on if a random bit of (j, word) is one; past the window it writes blanks.
    Of the 2 * ``size`` places as many as the window has words are sampled. Windows of three words are their own key.
    """
    key = np.full(len(starts), np.uint64(131 * table + size))
    if size == 3:
        for j in range(3):
            key = _mix(key * _M1 ^ ids[starts + j])
        return key
    rng = np.random.default_rng([seed, size, table])
    picked = set(rng.choice(2 * size, size, replace=False).tolist())
    salt = [np.uint64(x) for x in rng.integers(1, 2**63, 2 * size // 64 + 1)]
    bits = [_mix(ids * _M1 ^ x) for x in salt]  # 64 random bits of every word, one for each step
    at = np.zeros(len(starts), dtype=np.int64)
    for j in range(max(picked) + 1):
        pos = starts + np.minimum(at, size - 1)
        if j in picked:
            key = _mix(key * _M1 ^ np.where(at < size, ids[pos], np.uint64(0)))
        at += ((bits[j // 64][pos] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        np.minimum(at, size, out=at)
    return key


def window_keys(ids: np.ndarray, starts: np.ndarray, size: int, tables: int, seed: int = LeakConfig.seed) -> np.ndarray:
    """Keys (tables x windows) of several embeddings."""
    return np.stack([table_keys(ids, starts, size, t, seed) for t in range(tables)])


def _spoilt(words: np.ndarray, rng: np.random.Generator, change: float) -> np.ndarray:
    """Words of which a share is changed, dropped or has another one before it."""
    out = []
    for w, hit, how in zip(words, rng.random(len(words)) < change, rng.random(len(words)), strict=True):
        out += [w] if not hit else [rng.integers(2**40, 2**50)] if how < 0.5 else [] if how < 0.75 else [rng.integers(2**40, 2**50), w]
    return np.array(out, dtype=np.uint64)


def hit_rates(size: int, cfg: LeakConfig, most: int = 16, trials: int = 300) -> list[float]:
    """Share of random items of the shortest length for ``size``, held by half in two runs of which words are changed, that 1, 2, ... tables find."""
    n = max(SHORT, 7 * size)
    rng, first = np.random.default_rng([cfg.seed, size]), []
    span = int(np.ceil(cfg.share * n / (1 - cfg.change)))
    for _ in range(trials):
        item, noise = rng.integers(1, 2**40, n).astype(np.uint64), rng.integers(2**40, 2**50, 60).astype(np.uint64)
        a = rng.integers(0, n - span + 1)
        b = rng.integers(a + span // 2, n - span + span // 2 + 1)
        doc = np.concatenate([noise[:20], _spoilt(item[a : a + span // 2], rng, cfg.change), noise[20:40], _spoilt(item[b : b + span - span // 2], rng, cfg.change), noise[40:]])
        x, y = np.arange(len(doc) - size + 1), np.arange(n - size + 1)
        first.append(next((t for t in range(most) if np.isin(table_keys(doc, x, size, t, cfg.seed), table_keys(item, y, size, t, cfg.seed)).any()), most))
    return [float(np.mean([f <= t for f in first])) for t in range(most)]


@lru_cache(maxsize=256)
def tables_for(size: int, cfg: LeakConfig) -> int:
    """The fewest tables that reach the target recall in trials; 16 if none do."""
    if size == 3:
        return 1
    rates = hit_rates(size, cfg)
    return next((t + 1 for t, r in enumerate(rates) if r >= cfg.recall), len(rates))


def held_words(doc: list[str], item: list[str]) -> float:
    """Share of the item's words that the text holds in order, as at most two runs.

    A run is a local alignment: equal words in the same order, at most ``GAP`` differing words between two of them on either side, each
    differing word costing ``COST`` matching ones, so that words which only happen to agree make no run. For every pair of equal
    words the best run that ends there is found by dynamic programming over the pairs before it; no pair is left out.
    """
    n = len(item)
    where: dict[str, list[int]] = {}
    for k, w in enumerate(item):
        where.setdefault(w, []).append(k)
    runs: list[tuple[int, int, int, int]] = []  # matched, first item word, last item word + 1, first text word
    rows: deque[tuple[int, dict]] = deque()
    reach = range(1, GAP + 2)
    for d, w in enumerate(doc):
        at = where.get(w)
        while rows and rows[0][0] < d - GAP - 1:
            rows.popleft()
        if at is None:
            continue
        row = {}
        for k in at:
            best = (1.0, 1, k, d)
            for d0, old in rows:
                gd = d - d0
                for gk in reach:
                    c = old.get(k - gk)
                    if c is not None:
                        score = c[0] + 1 - COST * ((gd if gd > gk else gk) - 1)
                        if score > best[0] or (score == best[0] and c[1] + 1 > best[1]):
                            best = (score, c[1] + 1, c[2], c[3])
            row[k] = best
            if best[1] >= min(RUN, n):
                runs.append((best[1], best[2], k + 1, best[3]))
        rows.append((d, row))
    return best_ordered(runs) / n if runs else 0.0


def best_ordered(runs: list[tuple[int, int, int, int]]) -> int:
    """Most words that one run or two of them in their order hold; runs are (matched, first item word, last item word, first text word).

    The second run begins later in the text and at most two words before the first one's end in the item; words that both hold count once.
    Runs are taken by text position, with the best first run so far per end in the item, as prefix maxima in a binary indexed tree.
    """
    last = max(z for _, _, z, _ in runs)
    exact, upto = [0] * (last + 3), [0] * (last + 1)  # a second run alone is as good as one after a first of no words
    top = 0
    runs = sorted(runs, key=lambda r: r[3])
    for _, same in groupby(runs, key=lambda r: r[3]):
        same = list(same)
        for t, a, _, _ in same:
            k, first = a, 0
            while k > 0:
                first = max(first, upto[k])
                k -= k & -k
            top = max(top, t + first, t + exact[a + 1] - 1, t + exact[a + 2] - 2)
        for t, _, z, _ in same:
            exact[z] = max(exact[z], t)
            k = z
            while k <= last:
                upto[k] = max(upto[k], t)
                k += k & -k
    return top


class Bounds:
    """What a text must have to hold a share of an item: exact bounds that spare most candidates the alignment.

    It must have that many of the item's words. And since a gap costs a run more than ``COST`` matches, a run of m matches has at most
    (m - 1) / 2 gaps, so at least (m - 1) / 2 of its words follow one another in both: of two runs at least half the words less one.
    """

    def __init__(self, doc: list[str]):
        self.doc, self.words, self.pairs = doc, set(doc), None

    def allow(self, item: list[str], share: float) -> bool:
        least = share * len(item)
        if sum(w in self.words for w in item) < least:
            return False
        if self.pairs is None:
            self.pairs = set(zip(self.doc, self.doc[1:], strict=False))
        return sum(p in self.pairs for p in zip(item, item[1:], strict=False)) >= least / 2 - 1


class _Index:
    """Window keys of a bounded set of items, looked up for many windows at once."""

    def __init__(self, items: list[tuple[object, list[str]]], cfg: LeakConfig):
        self.items, self.by = items, {}
        ids: dict[str, int] = {}
        for size in sorted({window_size(len(w)) for _, w in items}):
            keys, owns, tables = [], [], tables_for(size, cfg)
            for at, (_, w) in enumerate(items):
                if window_size(len(w)) == size and len(w) >= size:
                    k = window_keys(_word_ids(w, ids), np.arange(len(w) - size + 1), size, tables, cfg.seed).ravel()
                    keys.append(k)
                    owns.append(np.full(len(k), at))
            if keys:
                pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(owns).astype(np.uint64)], 1), axis=0)
                seen = np.zeros(1 << 22, dtype=bool)
                seen[(pairs[:, 0] & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                self.by[size] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), seen, tables)

    def candidates(self, flat: np.ndarray, row_of: np.ndarray, ends: np.ndarray, cfg: LeakConfig) -> set[tuple[int, int]]:
        """(row, item) that share a key; ``flat`` holds the words of several texts, no window reaches from one into the next."""
        out: set[tuple[int, int]] = set()
        for size, (known, owner, seen, tables) in self.by.items():
            starts = np.flatnonzero(np.arange(len(flat)) + size <= ends[row_of])
            for t in range(tables):
                k = table_keys(flat, starts, size, t, cfg.seed)
                maybe = np.flatnonzero(seen[(k & np.uint64((1 << 22) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(known, k[maybe], "left"), np.searchsorted(known, k[maybe], "right")
                for i in np.flatnonzero(hi > lo):
                    out.update((int(row_of[starts[maybe[i]]]), int(o)) for o in owner[lo[i] : hi[i]])
        return out


def _item_words(items: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """(item id, words) of the items with three words and more, without shared openings; a repeated id counts once."""
    known = shared_openings(items, item_text, n)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: strip_shared(t, known))

    return items.select(item_id, words(item_text).alias("_words")).filter(F.size("_words") >= 3)


def find_leaks(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, share) of the texts that hold at least half of an item's words. Null and empty texts hold nothing; repeated rows come out once.

    Items of one or two words are never reported. Up to ``max_items`` items, a number that is checked, are sent to the texts, which are read once and
    never shuffled; more are matched by a join of the window keys of both sides.
    """
    src = items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).groupBy(item_id).agg(F.min(item_text).alias(item_text))
    n = src.count()
    words = _item_words(src, item_id, item_text, n)
    texts = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    hits = _scan(texts, words, cfg, id_col, text_col, item_id) if n <= cfg.max_items else _joined(texts, words, cfg, id_col, text_col, item_id)
    return hits.groupBy(id_col, item_id).agg(F.max("share").alias("share"))


def _schema(texts: DataFrame, words: DataFrame, id_col: str, item_id: str) -> T.StructType:
    return T.StructType([texts.schema[id_col], words.schema[item_id], T.StructField("share", T.DoubleType())])


def _flat(rows: list[list[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in rows], dtype=np.int64)
    return _word_ids([x for w in rows for x in w], ids), np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes)


def _scan(texts: DataFrame, words: DataFrame, cfg: LeakConfig, id_col: str, text_col: str, item_id: str) -> DataFrame:
    index = _Index(sorted(((r[0], list(r[1])) for r in words.collect()), key=lambda x: str(x[0])), cfg)
    bc = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, ids = bc.value, {}
        for batch in batches:
            found = []
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                rows = [leak_words(t) for t in part[text_col]]
                key = part[id_col].to_numpy()
                for r, pairs in groupby(sorted(ix.candidates(*_flat(rows, ids), cfg)), key=lambda x: x[0]):
                    bounds = Bounds(rows[r])
                    for _, o in pairs:
                        item, w = ix.items[o]
                        if bounds.allow(w, cfg.share) and (share := held_words(rows[r], w)) >= cfg.share:
                            found.append((key[r], item, share))
            yield pd.DataFrame(found, columns=[id_col, item_id, "share"])

    return texts.mapInPandas(run, _schema(texts, words, id_col, item_id))


def _joined(texts: DataFrame, words: DataFrame, cfg: LeakConfig, id_col: str, text_col: str, item_id: str) -> DataFrame:
    words = cut(words)
    sizes = {z: tables_for(z, cfg) for z in sorted({window_size(r[0]) for r in words.select(F.size("_words")).distinct().collect()})}  # as many rows as there are lengths
    texts = cut(texts.withColumn("_row", F.xxhash64(id_col, text_col)).dropDuplicates(["_row"]))

    def keys_of(col: str, split, own: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids: dict[str, int] = {}
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    part = batch.iloc[lo : lo + 256]
                    rows, key = [split(t) for t in part[col]], part[own].to_numpy()
                    flat, row_of, ends = _flat(rows, ids)
                    for size, tables in sizes.items():
                        ok = np.array([split is leak_words or window_size(len(w)) == size for w in rows], dtype=bool)
                        starts = np.flatnonzero((np.arange(len(flat)) + size <= ends[row_of]) & ok[row_of]) if len(flat) else np.zeros(0, int)
                        if len(starts):
                            k = window_keys(flat, starts, size, tables, cfg.seed)
                            yield pd.DataFrame({own: np.tile(key[row_of[starts]], len(k)), "key": k.ravel().view(np.int64)}).drop_duplicates()

        return run

    kind = words.schema[item_id].dataType.simpleString()
    doc_keys = texts.mapInPandas(keys_of(text_col, leak_words, "_row"), "_row bigint, key bigint")
    item_keys = words.mapInPandas(keys_of("_words", list, item_id), f"{item_id} {kind}, key bigint")
    pairs = doc_keys.join(item_keys, "key").select("_row", item_id).distinct().join(words, item_id).join(texts, "_row")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = [held_words(d, list(w)) if Bounds(d).allow(list(w), cfg.share) else 0.0 for d, w in ((leak_words(t), w) for t, w in zip(b[text_col], b["_words"], strict=True))]
            out = b[[id_col, item_id]].assign(share=np.asarray(share, dtype=float))
            yield out[out["share"] >= cfg.share]

    return pairs.select(id_col, item_id, text_col, "_words").mapInPandas(check, _schema(texts, words, id_col, item_id))
