"""Problem 4: cutting oversized texts at natural boundaries, all greedy cuts derived in parallel.

Every place where a text may be cut is a boundary with a level (section, paragraph, line or sentence, word, hard). One
vectorised look-up joins each boundary to its farthest legal successor, the overlap with the piece before included. The
successor table is then squared again and again (pointer doubling): after k rounds the cuts within 2^k steps of a text's start
are known, so a text of n pieces takes log2(n) rounds instead of n steps. All texts of an Arrow batch share one table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADING = re.compile(r"##[ \t]+§[ \t]*\d+[ \t]*[-–—][ \t]*\S")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+")
_SENTENCE = re.compile(r"\r\n|\r|\n|[.!?][\"'”’)\]]*[ \t]+|[。！？]")
_WORD = re.compile(r"[ \t\u00a0\u2002-\u200a\u3000]+")
#: Level of a boundary, and the share of the limit that a piece must reach to be cut there rather than at a lower one.
SECTION, PARAGRAPH, SENTENCE, WORD, HARD = 4, 3, 2, 1, 0
FILL = {SECTION: 0.5, PARAGRAPH: 0.5, SENTENCE: 0.25, WORD: 0.1, HARD: 0.0}


def section_starts(text: str) -> list[int]:
    """Offsets of the heading lines outside fenced code."""
    out, fence, at = [], "", 0
    for m in _LINE.finditer(text):
        line = m[0]
        if not line:
            break
        f = _FENCE.match(line)
        if f and not fence:
            fence = f[1]
        elif f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end() :].strip():
            fence = ""
        elif not fence and line.startswith("##") and HEADING.match(line):
            out.append(at)
        at = m.end()
    return out


def _is_joint(text: str, at: int) -> bool:
    """Whether a cut here would part a line end or a letter from its marks."""
    c = text[at]
    return (c == "\n" and text[at - 1] == "\r") or "\u0300" <= c <= "\u036f" or c in "\u200d\ufe0f" or text[at - 1] == "\u200d"


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets and levels of all places where the text may be cut, start and end included."""
    n = len(text)
    level: dict[int, int] = {}
    for pat, lv in ((_WORD, WORD), (_SENTENCE, SENTENCE), (_PARAGRAPH, PARAGRAPH)):
        for m in pat.finditer(text):
            level[m.end()] = lv
    for s in section_starts(text):
        level[s] = SECTION
    level[0], level[n] = SECTION, SECTION
    pos = np.array(sorted(level), dtype=np.int64)
    gaps = np.flatnonzero(np.diff(pos) > (grid := max(1, (limit - overlap) // 4)))
    for g in gaps:  # long runs without any boundary get hard ones
        for at in range(int(pos[g]) + grid, int(pos[g + 1]), grid):
            while at > pos[g] + 1 and _is_joint(text, at):
                at -= 1
            level.setdefault(at, HARD)
    if len(gaps):
        pos = np.array(sorted(level), dtype=np.int64)
    return pos, np.fromiter((level[int(p)] for p in pos), dtype=np.int8, count=len(pos))


def greedy_cuts(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """Per text the (start, end) offsets of its pieces. A text within the limit is one piece, an empty one none."""
    if not texts:
        return []
    parts = [boundaries(t, limit, overlap) if len(t) > limit else (np.array([0, len(t)]), np.array([SECTION, SECTION], dtype=np.int8)) for t in texts]
    base = np.cumsum([0, *(len(t) + 2 * limit for t in texts)])  # windows never reach into the next text
    pos = np.concatenate([p + b for (p, _), b in zip(parts, base, strict=False)])
    lv = np.concatenate([x for _, x in parts])
    sizes = np.array([len(p) for p, _ in parts])
    last = np.repeat(np.cumsum(sizes) - 1, sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    idx = np.arange(len(pos))
    # a piece starts up to ``overlap`` before its cut, at the first boundary in that stretch (whole words) or at its far end
    far = np.maximum(pos - overlap, pos[first] if len(pos) else pos)
    at = np.searchsorted(pos, far, "left")
    start = np.where((at < idx) & (pos[np.minimum(at, len(pos) - 1)] < pos), pos[np.minimum(at, len(pos) - 1)], far) if len(pos) else pos
    reach = start + limit
    succ = np.full(len(pos), -1, dtype=np.int64)
    for level in (SECTION, PARAGRAPH, SENTENCE, WORD, HARD):
        own = np.flatnonzero(lv >= level)
        if not len(own):
            continue
        k = np.searchsorted(pos[own], reach, "right") - 1
        cand = own[np.maximum(k, 0)]
        ok = (succ < 0) & (k >= 0) & (cand > idx) & (pos[np.maximum(cand, 0)] - start >= FILL[level] * limit)
        succ = np.where(ok, cand, succ)
    k = np.searchsorted(pos, reach, "right") - 1  # whatever is left takes the farthest boundary of any level
    succ = np.where(succ < 0, np.maximum(k, np.minimum(idx + 1, last)), succ)
    succ = np.where(pos[last] <= reach, last, np.minimum(succ, last)) if len(pos) else succ
    reached = np.zeros(len(pos), dtype=bool)
    reached[np.cumsum(sizes) - sizes] = True
    jump = succ
    while len(pos):
        new = reached.copy()
        new[jump[reached]] = True
        if (new == reached).all() and (jump == last).all():
            break
        reached, jump = new, jump[jump]
    out, at = [], 0
    for t, size, b in zip(texts, sizes, base, strict=False):
        cuts = np.flatnonzero(reached[at : at + size]) + at
        out.append([(int(start[a] - b), int(pos[c] - b)) for a, c in zip(cuts[:-1], cuts[1:], strict=False)] if len(t) else [])
        at += size
    return out


PIECE = T.ArrayType(T.StructType([T.StructField("piece_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())]))


def split_texts(df: DataFrame, keys: list[str], text_col: str, limit: int = 3000, overlap: int = 200, by_section: bool = False) -> DataFrame:
    """(keys..., [section_no,] piece_no, start, stop, text): numbered pieces of at most ``limit`` code points, in one pass without a shuffle.

    Each piece after the first begins with the last code points (at most ``overlap``) of the one before; joined without these the
    pieces give the text back. With ``by_section`` every section is cut by itself, and offsets count from its start; section 0 is the
    text before the first heading. Null and empty texts give no rows; a text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in (["section_no"] if by_section else []) + ["piece_no", "start", "stop"]], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                b = batch.slice(lo, 64)
                units: list[tuple[int, int, str]] = []
                for r, t in enumerate(b.column(len(keys)).to_pylist()):
                    if not t:
                        continue
                    if by_section:
                        heads = section_starts(t)
                        edges = [0, *heads, len(t)]
                        units += [(r, i, t[a:z]) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
                    else:
                        units.append((r, 0, t))
                cuts = greedy_cuts([u[2] for u in units], limit, overlap)
                rows, sec, no, st, en, tx = [], [], [], [], [], []
                for (r, s, t), c in zip(units, cuts, strict=True):
                    for i, (a, z) in enumerate(c):
                        rows.append(r), sec.append(s), no.append(i + 1), st.append(a), en.append(z), tx.append(t[a:z])
                cols = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
                cols += [pa.array(x, pa.int64()) for x in (([sec] if by_section else []) + [no, st, en])] + [pa.array(tx, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.select(*keys, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def cut_sections(papers: DataFrame, limit: int = 3000, overlap: int = 200, key: str = "paper_id", content: str = "content") -> DataFrame:
    """(key, section_no) of the sections that had to be cut inside: those that the splitter returned as several pieces. Repeated papers count once."""
    return split_texts(papers, [key], content, limit, overlap, by_section=True).filter("piece_no = 2").select(key, "section_no").distinct()
