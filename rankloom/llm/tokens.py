"""Problem 6: exact byte-pair ids by dynamic programming over prefixes.

For every prefix of a word exactly one vocabulary entry can be the last token of its encoding. An automaton over the
vocabulary gives the entries that end at each byte; the right one is the entry that is compatible with the last token of
the prefix before it, that is, whose pair would not have been merged or split otherwise. Back-pointers then give the ids.
A pair is compatible if undoing the last merges on either side of the border never meets a merge of lower rank across it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: GPT-2's word pattern with White_Space spelled out, since engines differ on control characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids a worker keeps.
KEPT_WORDS = 200_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PrefixEncoder:
    """Encoder of one vocabulary of ranks (token bytes and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.auto = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.auto.add_word(t.decode("latin-1"), (len(t), r))
        self.auto.make_automaton()
        # how each token is made: the pair of ranks merged last, by replaying the merges on its own bytes
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) > 1:
                a, b = self._last_pair(t, r)
                self.split[r] = (a, b)
                self.merged.setdefault((a, b), r)
        self.pattern = regex.compile(PATTERN)
        self.kept: dict[str, np.ndarray] = {}
        self._ok: dict[tuple[int, int], bool] = {}

    def _last_pair(self, t: bytes, r: int) -> tuple[int, int]:
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            if self.rank.get(parts[at] + parts[at + 1], 1 << 60) >= r:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:  # not reachable by merges: never a candidate
            return (-1, -1)
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is just these two tokens."""
        key = (a, b)
        got = self._ok.get(key)
        if got is None:
            got = self._test(a, b)
            if len(self._ok) < 1_000_000:
                self._ok[key] = got
        return got

    def _test(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            # undo the later of the two merges next to the border
            if a > b:
                if a not in self.split:
                    return True
                limit, a = a, self.split[a][1]
                if a == -1:
                    return False
                if a == limit:
                    return True
            else:
                if b not in self.split:
                    return True
                limit, b = b + 1, self.split[b][0]
                if b == -1:
                    return False

    def word(self, w: str) -> np.ndarray:
        """Ids of one word. Linear in its length up to the number of entries that end at a byte."""
        data = w.encode("utf-8", "surrogatepass")
        one = self.rank.get(data)
        if one is not None and (len(data) == 1 or self.split[one][0] != -1):
            return np.array([one], dtype=np.int32)
        text, n = data.decode("latin-1"), len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, r) in self._ends(text):
            start = end - size
            if last[end] != -1 or (start and last[start] == -1):
                continue
            if size > 1 and self.split[r][0] == -1:
                continue
            if start == 0 or self.compatible(last[start], r):
                last[end], back[end] = r, start
        out, at = [], n
        while at:
            if last[at] == -1:
                raise ValueError("the vocabulary lacks the bytes of this text")
            out.append(last[at])
            at = back[at]
        return np.array(out[::-1], dtype=np.int32)

    def _ends(self, text: str):
        for end, hit in self.auto.iter(text):
            yield end + 1, hit

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts give none. Strings of special tokens are ordinary text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        kept, out = self.kept, []
        for w in self.pattern.findall(text):
            ids = kept.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = ids
            out.append(ids)
        return np.concatenate(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, out: str = "ids") -> DataFrame:
    """(id, ids) of every row in one pass without a shuffle; null and empty texts give an empty list. ``ranks`` is the vocabulary file, readable on every executor."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[id_col, out])

    schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
