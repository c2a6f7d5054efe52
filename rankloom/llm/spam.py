"""Problem 8: keyword runs, link lists and tag lists.

A text is cut at line ends, list items and sentence ends. A piece counts as no prose by shares that are measured on it: links
and their texts, separators, missing function words, repeated words and n-grams of the text, repeated lines. What is normal is
learnt from the table itself, per language: its function words are the short words that a fifth of its texts hold, and the
thresholds come from the shares in its sentences. A text is spam if more than half of its characters stand in pieces that are no
prose, and these are more than a chance cut of prose could show.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import chars as C
from rankloom.session import cut

#: Letters of a function word at most; share of a language's texts that hold one, at least and with certainty (standard errors); words a language at most.
SHORT, SPREAD, CERTAIN, MOST = 5, 0.2, 5.0, 200
#: Share of the language's median function-word share below which a piece counts as lacking them.
LOW = 0.45
#: Separators a word, and repeated phrases, count as many from this multiple of what nine of ten sentences stay under; phrases never below a third.
SEPARATED, STUFFED, LEAST_STUFFED = 2.0, 3.0, 1 / 3
#: A piece is a link list if half of it is links; a list of tags if a third of its words are.
LINKED, TAGGED = 0.5, 1 / 3
#: Log odds against chance that missing function words, or separators in Chinese, must reach over the whole text: one in a hundred.
PROOF = 4.6

_SPLIT = re.compile(r"\r\n|[\r\n]|</?(?:li|p|br|div|ul|ol|td|tr|h[1-6])\b[^>]*>|(?<=[.!?])\s+(?=[^\s])|(?<=[。！？])|<\|endoftext\|>|&lt;/?p&gt;")
_URL = re.compile(r"https?://\S+|www\.\S+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)|<a\b[^>]*>(.*?)</a>", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SEP = re.compile(r"[,;|·•>/#+:]|&gt;")
_CJK = re.compile(r"[\u3400-\u9fff]")
_END = re.compile(r"[.!?。！？:…][\"'”’)\]*_]*$")
_TAG = re.compile(r"(?:^|\s)(?:[#+]\w|tag:\w)")
_PRICE = re.compile(r"\d[\d.,]*\s?(?:USD|EUR|GBP|\$|€|£)|[$€£]\s?\d")
_CODE = re.compile(r"(?ms)^(?:```|~~~).*?^(?:```|~~~)\s*$")
_BETWEEN = r"[^\p{L}'’]+"


@dataclass(frozen=True)
class Norms:
    """What is learnt from a table: function words per language, and per language the median share of them, the separators a word and the share of repeated phrases that sentences stay under."""

    words: dict[str, frozenset[str]] = field(default_factory=dict)
    median: dict[str, float] = field(default_factory=dict)
    separators: dict[str, float] = field(default_factory=dict)
    repeated: dict[str, float] = field(default_factory=dict)
    cjk_rate: float = 0.1

    def owners(self) -> tuple[list[str], dict[str, list[int]]]:
        langs = list(self.words)  # the most frequent first, which wins ties
        out: dict[str, list[int]] = defaultdict(list)
        for i, k in enumerate(langs):
            for w in self.words[k]:
                out[w].append(i)
        return langs, dict(out)


def learn_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, frozenset[str]]:
    """Function words of each stated language: the words of at most ``SHORT`` letters that ``SPREAD`` of its texts hold, by the lower bound of that share.

    The bound keeps languages of a few texts from having any, since there a chance word is as frequent; their texts are judged by the words of
    the others, and so are those without a language. A table without the column counts as one language. At most ``MOST`` words a language
    reach the driver.
    """
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit("any")
    t = docs.filter(F.col(text_col).isNotNull() & lang.isNotNull()).select(lang.alias("lang"), F.array_distinct(F.filter(F.split(F.lower(text_col), _BETWEEN), lambda w: (F.length(w) <= SHORT) & w.rlike(r"^\p{L}+$"))).alias("w"))
    n = t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    df = t.select("lang", F.explode("w").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("m"))
    p, z, k = F.col("m") / F.col("n"), CERTAIN, F.col("n")
    low = (p + z * z / 2 / k - z * F.sqrt(p * (1 - p) / k + z * z / 4 / k / k)) / (1 + z * z / k)
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "w"))
    got = df.join(n, "lang").filter(low >= SPREAD).withColumn("r", top).filter(F.col("r") <= MOST).collect()
    out: dict[str, set[str]] = defaultdict(set)
    for r in sorted(got, key=lambda r: (-r["n"], r["lang"], r["w"])):
        out[r["lang"]].add(r["w"])
    return {k: frozenset(v) for k, v in out.items()}


def pieces(text: str) -> list[str]:
    return [p.strip() for p in _SPLIT.split(text) if p and p.strip()]


def _function_words(words: list[str], owners: dict[str, list[int]], langs: int) -> tuple[int, int]:
    """Number of the language with most function words among these, and how many; -1 without any."""
    n = [0] * langs
    for w in words:
        if w in owners:
            for k in owners[w]:
                n[k] += 1
    most = max(n, default=0)
    return (n.index(most), most) if most else (-1, 0)


def _phrases(words: list[str], common: dict[str, list[int]]) -> set[tuple[str, ...]]:
    """Phrases of one to three words without function words that are repeated often: at least five times and by at least a twelfth of the words."""
    out: set[tuple[str, ...]] = set()
    n = len(words)
    often = {w for w, m in Counter(words).items() if m >= 5 and m * 36 >= n and w not in common and len(w) > 1}
    if not often:  # a phrase is never more frequent than its words
        return out
    for k in (3, 2, 1) if common else (1,):  # without function words every sentence that is repeated would be phrases throughout
        grams = Counter(g for i in range(n - k + 1) if words[i] in often and words[i + k - 1] in often and (k < 3 or words[i + 1] in often) for g in (tuple(words[i : i + k]),))
        out |= {g for g, m in grams.items() if m >= 5 and m * k * 12 >= n}
    return out


def _covered(words: list[str], phrases: set[tuple[str, ...]]) -> float:
    if not phrases:
        return 0.0
    hit = [False] * len(words)
    for k in (1, 2, 3):
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in phrases:
                hit[i : i + k] = [True] * k
    return sum(hit) / len(hit) if hit else 0.0


def clean(text: str) -> str:
    return text if text.isascii() else C.visible_lines(C.undo_mojibake(text))


CLOSED, UPPER, LINKS, PRICE, CJK, LAID_OUT = 1, 2, 4, 8, 16, 32
#: One piece: characters, words, function words and their language, separators, words in repeated phrases and tags as shares of the words, share of characters in links, Chinese characters, equal lines, flags.
PIECE = np.dtype([("size", "<i4"), ("words", "<i4"), ("fw", "<i4"), ("lang", "<i2"), ("seps", "<i4"), ("cov", "<f4"), ("tags", "<f4"), ("links", "<f4"), ("cjk", "<i4"), ("same", "<i4"), ("flags", "<i2")])


def measure(text: str, owners: dict[str, list[int]], langs: int) -> np.ndarray:
    """What ``judge`` needs to know of each piece of a text; code is left out, headings and table rows are marked."""
    text = _CODE.sub("\n", clean(text))
    parts = pieces(text)
    words_of = [_WORD.findall((_URL.sub(" ", p) if "http" in p or "www." in p else p).lower()) for p in parts]
    phrases = _phrases([w for ws in words_of for w in ws], owners)
    lines = Counter(parts)
    out = np.zeros(len(parts), PIECE)
    for i, (p, words) in enumerate(zip(parts, words_of, strict=True)):
        size, flags = len(p), 0
        mark = len(p) - len(p.lstrip("#"))
        if (mark and p[mark : mark + 1] == " " and size < 120) or (p.startswith("|") and p.endswith("|") and p.count("|") >= 3 and " · " not in p):
            flags |= LAID_OUT
        links, rest = 0, p
        if "](" in p or "<a" in p:
            links = sum(len(m[0]) for m in _LINK.finditer(p))
            rest = _LINK.sub(" ", p)
            words = _WORD.findall(_URL.sub(" ", rest).lower())
        if "http" in rest or "www." in rest:
            links += sum(len(m[0]) for m in _URL.finditer(rest))
            rest = _URL.sub(" ", rest)
        cjk = 0 if rest.isascii() else len(_CJK.findall(rest))
        seps = len(re.findall(r"[,，、;；|/\s]", rest)) if cjk * 3 > size else len(_SEP.findall(rest))
        lang, fw = _function_words(words, owners, langs)
        flags |= CLOSED * bool(_END.search(p)) | UPPER * p[0].isupper() | LINKS * bool(links) | PRICE * bool(_PRICE.search(p)) | CJK * (cjk * 3 > size)
        tags = len(_TAG.findall(p)) / max(1, len(words)) if "#" in p or "+" in p or "tag:" in p else 0.0
        out[i] = (size, len(words), fw, lang, seps, _covered(words, phrases), tags, links / size, cjk, lines[p], flags)
    return out


def _of(values: dict[str, float], langs: list[str], lang: np.ndarray, otherwise: float) -> np.ndarray:
    """Each piece's value by its language; without one the mean of all."""
    every = [values[k] for k in langs if k in values]
    table = np.array([values.get(k, otherwise) for k in langs] + [float(np.mean(every)) if every else otherwise])
    return table[lang]


def judge(x: np.ndarray, doc: np.ndarray, n: int, norms: Norms) -> tuple[np.ndarray, np.ndarray]:
    """(share of characters that are no prose, whether that is beyond chance) of ``n`` texts, whose pieces ``x`` stand together, ``doc`` telling the text of each."""
    langs, _ = norms.owners()
    has = lambda f: (x["flags"] & f) > 0
    words, closed, lang = np.maximum(x["words"], 1), has(CLOSED), x["lang"]
    median = _of(norms.median, langs, lang, 0.0)  # where nothing was learnt, missing function words say nothing
    many, stuffed = _of(norms.separators, langs, lang, 0.25), _of(norms.repeated, langs, lang, LEAST_STUFFED)
    fw, seps = x["fw"] / words, x["seps"] / words
    low = LOW * median * np.where(closed & has(UPPER) & ~has(LINKS), 0.5, 1.0)  # it at least looks like a sentence
    link, cjk = x["links"] >= LINKED, has(CJK)
    lacking = np.where(x["words"] >= 6, fw < low, ~closed & (fw == 0))
    listed = np.where(x["words"] >= 6, (fw < 2 * low) & ~closed & (seps >= many), (fw == 0) & ((seps >= 2 * many) | has(PRICE)))
    again = np.where(x["words"] >= 6, x["cov"] >= stuffed, (x["cov"] >= 2 * stuffed) | (~closed & ((x["cov"] >= stuffed) | (x["same"] > 2))))
    tagged = (x["words"] >= 6) & (x["tags"] > TAGGED)
    worded = ~link & ~cjk & (x["words"] > 0)
    lines_cjk = ~link & cjk & ~closed & (x["same"] > 2)
    dense_cjk = ~link & cjk & ~closed & (x["seps"] * 8 > x["cjk"])
    bare = ~link & ~cjk & (x["words"] == 0) & (x["size"] > 3)
    bad = link | lines_cjk | dense_cjk | bare | (worded & (lacking | listed | again | tagged))
    total = lambda w: np.bincount(doc, w, minlength=n)
    # headings and table rows don't count on either side, unless next to nothing else of the text is prose
    laid = has(LAID_OUT)
    prose, whole = total(x["size"] * (~bad & ~laid)), total(x["size"])
    alone = prose < 0.1 * whole
    counts = ~laid | (alone[doc] & (total(x["size"] * laid) > 0.5 * whole)[doc])
    size = x["size"] * counts
    share = total(size * bad) / np.maximum(total(size), 1)
    # evidence: things that prose never has, or more of what it may have by chance
    bad &= counts
    listed |= seps >= many  # a piece that lacks function words and has separators
    strong = bad & (link | lines_cjk | (worded & (again | tagged | (listed & ((x["seps"] >= 3) | has(PRICE))))))
    lacks = bad & worded & ~strong
    k, m, p = total(x["fw"] * lacks), total(x["words"] * lacks), total(median * x["words"] * lacks)
    odds = _log_odds(k, m, p / np.maximum(m, 1))
    s, e = total(x["seps"] * (bad & dense_cjk)), total(norms.cjk_rate * x["cjk"] * (bad & dense_cjk))
    with np.errstate(divide="ignore", invalid="ignore"):
        odds_cjk = np.where(s > e, s * np.log(s / np.maximum(e, 1e-9)) - (s - e), 0.0)
    sure = (total(x["size"] * strong) * 2 >= total(x["size"] * bad)) | (odds >= PROOF) | (odds_cjk >= PROOF)
    return share, sure


def _log_odds(k: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Against chance: minus the logarithm of Chernoff's bound for at most k of m where the share is p."""
    q = k / np.maximum(m, 1)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(q / p), 0.0) + (1 - q) * np.log((1 - q) / (1 - p))
    return np.where(q < p, m * kl, 0.0)


BINS = 200


def _histograms(x: np.ndarray, langs: list[str]) -> Counter:
    """Pieces by language, feature and bin, as far as they look like sentences; ``cjk`` and ``cjk_seps`` are sums over Chinese sentences."""
    out: Counter = Counter()
    closed, cjk = (x["flags"] & CLOSED) > 0, (x["flags"] & CJK) > 0
    plain = x[(x["words"] >= 6) & closed & ~cjk & (x["lang"] >= 0)]
    for name, v in (("fw", plain["fw"] / plain["words"]), ("sep", plain["seps"] / plain["words"]), ("cov", plain["cov"])):
        at = np.minimum((v * BINS).astype(int), BINS - 1)
        pairs, m = np.unique(np.stack([plain["lang"], at], 1), axis=0, return_counts=True) if len(at) else (np.zeros((0, 2), int), [])
        for (lang, b), c in zip(pairs, m, strict=True):
            out[langs[lang], name, int(b)] += int(c)
    chinese = x[cjk & closed]
    if len(chinese):
        out["", "cjk", 0] += int(chinese["cjk"].sum())
        out["", "cjk_seps", 0] += int(chinese["seps"].sum())
    return out


def norms_of(words: dict[str, frozenset[str]], counts: dict[tuple[str, str, int], int]) -> Norms:
    """Thresholds from the histograms of all pieces."""
    by: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros(BINS))
    for (lang, name, b), m in counts.items():
        if not name.startswith("cjk"):
            by[lang, name][b] += m
    at = lambda h, q: (int(np.searchsorted(np.cumsum(h), q * h.sum())) + 0.5) / BINS  # noqa: E731 - middle of the bin
    cjk, seps = counts.get(("", "cjk", 0), 0), counts.get(("", "cjk_seps", 0), 0)
    return Norms(
        words,
        {k: at(h, 0.5) for (k, n), h in by.items() if n == "fw"},
        {k: SEPARATED * at(h, 0.9) for (k, n), h in by.items() if n == "sep"},
        {k: max(LEAST_STUFFED, STUFFED * at(h, 0.9)) for (k, n), h in by.items() if n == "cov"},
        max(0.02, seps / cjk) if cjk else 0.1,
    )


def _unpack(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b, PIECE) for b in blobs]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, PIECE)), np.repeat(np.arange(len(parts)), sizes)


def find_spam(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, spam_share) of the texts that are mostly no prose. Null, blank and cut texts are never spam; repeated rows of one id come out once.

    The texts are read twice: for the function words, and for the measures of their pieces, which are a fraction of the texts and are kept.
    From these come the thresholds of every language and then the verdicts.
    """
    words = learn_words(docs, text_col, lang_col)
    langs, owners = Norms(words).owners()
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "pieces": [measure(t, owners, len(langs)).tobytes() for t in b[text_col]]})

    packed = cut(docs.select(id_col, text_col).filter(F.col(text_col).isNotNull()).mapInPandas(pack, f"{id_col} {id_type}, pieces binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total += _histograms(_unpack(b["pieces"])[0], langs)
        yield pd.DataFrame([(*k, m) for k, m in total.items()], columns=["lang", "name", "bin", "m"])

    got = packed.select("pieces").mapInPandas(count, "lang string, name string, bin int, m long").groupBy("lang", "name", "bin").agg(F.sum("m").alias("m")).collect()  # bins of three measures a language
    norms = norms_of(words, {(r["lang"], r["name"], r["bin"]): r["m"] for r in got})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, doc = _unpack(b["pieces"])
            share, sure = judge(x, doc, len(b), norms)
            hit = (share > 0.5) & sure
            yield pd.DataFrame({id_col: b[id_col][hit], "spam_share": share[hit]})

    return packed.mapInPandas(run, f"{id_col} {id_type}, spam_share double").groupBy(id_col).agg(F.max("spam_share").alias("spam_share"))
