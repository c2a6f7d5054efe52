"""Problem 1: matching papers with index entries that share no identifier.

Candidates come from blocks on surname and rare title word, and from titles that agree up to one word. Each
candidate gets a similarity vector; a regularised mixture of two Gaussians is fitted to all vectors without labels. In every
expectation step the posteriors obey transitivity: two entries that match one paper would have to match each other, which
different identifiers don't, so the odds of a paper's candidates compete with each other and with no match at all.
"""

from __future__ import annotations

import html
import logging
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import chars as C
from rankloom.llm import linkage as L
from rankloom.llm import names as N
from rankloom.session import cut, cut_counted

FEATURES = ["held", "cover", "author", "date", "log"]
#: Added to the variances; the share of candidates that match at the start.
REGULAR, START_SHARE = 0.001, 0.2
#: The log of earlier runs is weak evidence: its similarity counts for this share, around the value that stands for none.
LOG_WEIGHT, NO_LOG = 0.3, 0.7
#: Similarity of word sets that candidates of the surname blocks reach.
JACCARD = 0.55
#: Change of the means below which the mixture counts as settled.
STILL = 1e-4
#: Pairs of one join key beyond which they are made by several tasks.
HOT = 100_000

# Spelling variants and short forms in titles.
SHORT_FORMS = {
    "poi": "point of interest", "rec": "recommendation", "recs": "recommendations", "catalog": "catalogue", "catalogs": "catalogues", "behavior": "behaviour", "behaviors": "behaviours",
    "optimization": "optimisation", "factorization": "factorisation", "quantization": "quantisation", "personalized": "personalised", "tokenized": "tokenised", "generalized": "generalised",
    "quantizers": "quantisers", "ctr": "click through rate", "llm": "large language model", "llms": "large language models", "gnn": "graph neural network", "gnns": "graph neural networks", "color": "colour",
    "vae": "variational autoencoder", "vaes": "variational autoencoders", "ssm": "state space model", "ssms": "state space models", "moe": "mixture of experts", "mf": "matrix factorisation", "vs": "versus",
    "kd": "knowledge distillation", "ipw": "inverse propensity weights", "ips": "inverse propensity scores", "rl": "reinforcement learning", "nlp": "natural language processing", "ir": "information retrieval",
}
_TAGS = re.compile(r"</?[a-zA-Z][^>]{0,40}>")
_LATEX = re.compile(r"\\[a-zA-Z]+\s*\{([^{}]*)\}|\\[a-zA-Z]+|[${}]")
_TOKEN = re.compile(r"[a-z0-9]+")


def title_key(t: str | None) -> str:
    """Words of a title in the form in which typing, markup and characters don't matter."""
    if not t:
        return ""
    t = html.unescape(html.unescape(t)) if "&" in t else t
    if any(c in t for c in "<\\${"):
        t = re.sub(r"\\['\"`^~=.]\s*\{?\\?([A-Za-z])\}?", r"\1", _TAGS.sub(" ", t))
        t = _LATEX.sub(lambda m: m[1] or ("" if m[0] in "{}" else " "), t)
    t = C.fold(C.undo_mojibake(t))
    words = _TOKEN.findall(t.replace("&", " and ").replace("'", "").replace("’", ""))
    return " ".join(SHORT_FORMS.get(w, w) for w in words)


_CUT = re.compile(r"(?:…|\.\.\.)[\s\"”']*$")


def _initials(words: list[str], other: list[str]) -> list[str]:
    """Words with those replaced that are the initials of two to four words of the other title in a row."""
    out = []
    for w in words:
        stem = w[:-1] if w.endswith("s") and len(w) > 2 else w
        hit = None
        if 2 <= len(stem) <= 4 and w not in other:
            hit = next((other[i : i + len(stem)] for i in range(len(other) - len(stem) + 1) if all(other[i + j][0] == c for j, c in enumerate(stem))), None)
        out += hit or [w]
    return out


def title_match(a: str, b: str, a_cut: bool, b_cut: bool) -> tuple[float, float]:
    """(held, cover): share of the shorter and of the longer title's letters that stand in words of the other, one typing error a word allowed.

    Of a title cut off with an ellipsis the last word may be a part, and the other title is only taken as far as it reaches.
    """
    x, y = a.split(), b.split()
    x, y = _initials(x, y), _initials(y, x)
    if a_cut and x:
        y = y[: len(x)]
    elif b_cut and y:
        x = x[: len(y)]
    left, got_x, got_y = list(y), 0, 0
    open_x = []
    for w in x:
        if w in left:
            left.remove(w)
            got_x, got_y = got_x + len(w), got_y + len(w)
        else:
            open_x.append(w)
    done: list[str] = []
    for n, w in enumerate(open_x):
        last = (a_cut or b_cut) and n == len(open_x) - 1
        hit = next((v for v in left if (min(len(w), len(v)) >= 4 and N.osa(w, v, 1) <= 1) or (last and min(len(w), len(v)) >= 2 and (v.startswith(w) or w.startswith(v)))), None)
        if hit is not None:
            left.remove(hit)
            done.append(w)
            got_x, got_y = got_x + len(w), got_y + len(hit)
    # words that were parted, joined or spoilt twice: what is left of both must be alike as a whole
    rest_x, rest_y = "".join(w for w in open_x if w not in done), "".join(left)
    if min(len(rest_x), len(rest_y)) >= 5 and N.osa(rest_x, rest_y, 2) <= 2:
        got_x, got_y = got_x + len(rest_x) - 1, got_y + len(rest_y) - 1
    nx, ny = sum(map(len, x)), sum(map(len, y))
    if not nx or not ny:
        return 0.0, 0.0
    ax, ay = got_x / nx, got_y / ny
    return (ax, ay) if nx <= ny else (ay, ax)


@F.pandas_udf(T.StructType([T.StructField("held", T.DoubleType()), T.StructField("cover", T.DoubleType())]))
def _title_match(a: pd.Series, b: pd.Series, ac: pd.Series, bc: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([title_match(*r) for r in zip(a, b, ac, bc, strict=True)], columns=["held", "cover"], dtype="float64")


@F.pandas_udf(T.StringType())
def _title_key(s: pd.Series) -> pd.Series:
    return s.map(title_key)


def surnames(name: str) -> list[tuple[str, str]]:
    """(word, initial of the given name) of the words that may be the surname: before a comma the last word there; else the last and the first. The initial is empty where the name has one word."""
    a, b = N.parts(name)
    strip = lambda ws: [w.replace("-", "") for w in ws if w not in N.PARTICLES]
    x, y = strip(a) or [w.replace("-", "") for w in a], strip(b)
    if not x:
        return []
    if y:
        return [(x[-1], y[0][0])]
    if len(x) == 1:
        return [(x[0], "")]
    return [(w, o[0]) for w, o in ((x[-1], x[0]), (x[0], x[-1])) if len(w) > 1] or [(x[-1], x[0][0])]


SURNAMES = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("initial", T.StringType())]))


@F.pandas_udf(SURNAMES)
def _surnames(s: pd.Series) -> pd.Series:
    return s.map(lambda v: [{"word": w, "initial": i} for w, i in surnames(v or "")])


def author_similarity(paper: str, entry: str) -> float:
    """1 full names agree, 0.9 surname with initial or alone, 0.5 one is missing, 0.2 surname with another given name, 0 another surname."""
    pa, pb = N.parts(paper)
    ea, eb = N.parts(entry)
    if not pa or not ea:
        return 0.5
    strip = lambda ws: [w for w in ws if w not in N.PARTICLES]

    def orders(a, b):
        if b:
            return [(strip(a)[-1:], strip(b))]
        w = strip(a)
        both = [(w[-1:], w[:-1])] + ([(w[:1], w[1:])] if len(w) > 1 else [])
        return [o for o in both if o[0] and len(o[0][0]) > 1] or both  # an initial is no surname

    best = 0.0
    for ps, pg in orders(pa, pb):
        for es, eg in orders(ea, eb):
            if not ps or not es or not N.same_surname(ps[0], es[0]):
                continue
            if not pg or not eg:
                best = max(best, 0.9)
            elif N.given_matches(eg, pg[0], [x for x in pg[1:] if len(x) == 1], ps[0]) or N.given_matches(pg, eg[0], [x for x in eg[1:] if len(x) == 1], ps[0]):
                best = max(best, 1.0 if min(len(pg[0]), len(eg[0])) > 1 else 0.95)
            else:
                best = max(best, 0.2)
    if best < 0.9:
        whole, other = "".join(pa + pb).replace("-", ""), "".join(ea + eb).replace("-", "")
        if min(len(whole), len(other)) >= 10 and N.osa(whole, other, 1) <= 1:
            best = 1.0
    return best


@F.pandas_udf(T.DoubleType())
def _author_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([author_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def surname_spellings(words: DataFrame) -> DataFrame:
    """(word, key): each word under itself and under every more frequent word that one typing error leads to.

    Of two spellings one error apart the rarer one has the other among its keys, so they meet; words under four letters only meet themselves.
    ``words``: one row per occurrence. Only distinct words are compared.
    """
    n = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    keyed = n.filter(F.length("word") >= 4).select("word", "n", F.explode(L.deletions(F.col("word"), 1)).alias("d"))
    other = keyed.select("d", F.col("word").alias("key"), F.col("n").alias("m"))
    near = keyed.join(other, "d").filter(F.struct("m", "key") > F.struct("n", "word")).select("word", "key").distinct()
    return n.select("word", F.col("word").alias("key")).unionByName(near)


def _author_keys(df: DataFrame, spell: DataFrame, own: str, entry: bool) -> DataFrame:
    """(id, key) of the surnames. Names of several words meet each other on surname and given initial, others on the surname alone."""
    k = df.select(own, F.explode("who").alias("w")).select(own, "w.word", "w.initial").join(spell, "word")
    full, one = F.concat(F.lit("2 "), "key", F.lit(" "), "initial"), lambda n: F.concat(F.lit(f"{n} "), "key")
    several = F.col("initial") != ""
    keys = F.when(several, F.array(full, one(3) if entry else one(1))).otherwise(F.array(one(1)) if entry else F.array(one(1), one(3)))
    return k.select(own, F.explode(keys).alias("key")).distinct()


def spread_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``, whole, whatever the number of pairs under one key.

    Where a key has more than ``HOT`` pairs the rows of both sides are parted into pieces, and each piece of one side meets each of the other as a key of its own,
    so no task makes more than about ``HOT`` pairs of it at a time. ``a`` and ``b`` are read twice.
    """
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    piece = max(1, math.isqrt(HOT))
    pieces = lambda n: F.ceil(F.col(n) / piece).cast("int")
    hot, any_ = cut_counted(count(a, "_n").join(count(b, "_m"), key).filter(F.col("_n") * F.col("_m") > HOT).select(key, pieces("_n").alias("_n"), pieces("_m").alias("_m")))
    if not any_:
        return a.join(b, key)
    own = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = a.join(hot, key).withColumn("_i", own(a, "_n")).withColumn("_j", every("_m")).drop("_n", "_m")
    y = b.join(hot, key).withColumn("_j", own(b, "_m")).withColumn("_i", every("_n")).drop("_n", "_m")
    return a.join(hot, key, "left_anti").join(b, key).unionByName(x.join(y, [key, "_i", "_j"]).drop("_i", "_j"))


def candidates(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (pid, eid) of distinct paper forms and entry forms that share a block. ``papers``: pid, tk, who; ``entries``: eid, tk, who.

    A block is a surname with one rare title word (of the prefix that a Jaccard similarity of ``JACCARD`` can't miss), or a whole
    title up to one word, whatever the author and the number of records that share it.
    """
    p, e = papers.withColumn("w", F.array_distinct(F.split("tk", " "))), entries.withColumn("w", F.array_distinct(F.split("tk", " ")))
    freq = p.select(F.explode("w").alias("word")).unionByName(e.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    spell = cut(surname_spellings(p.select(F.explode("who.word").alias("word")).unionByName(e.select(F.explode("who.word").alias("word")))))
    pk, ek = cut(_author_keys(p, spell, "pid", False)), cut(_author_keys(e, spell, "eid", True))
    side = lambda df, own, keys: L.rare_prefix(df, [own], "w", freq, JACCARD, 1).join(keys, own).select(own, "key", F.explode("rare").alias("word"))
    a = side(p, "pid", pk).join(side(e, "eid", ek), ["key", "word"]).select("pid", "eid")
    # titles are compared once, however many records have them; then each record of the one title meets each of the other
    titles = lambda df, own, t: cut(df.select(own, F.xxhash64("tk").alias(t), "tk"))
    pt, et = titles(p, "pid", "pt"), titles(e, "eid", "et")
    h = lambda df, t: cut(df.select(t, "tk").distinct().select(t, F.explode(L.without_one(F.split("tk", " "))).alias("h")))
    same = cut(spread_join(h(pt, "pt"), h(et, "et"), "h").select("pt", "et").distinct())
    own = cut(spread_join(pt.select("pid", "pt"), same, "pt").select("pid", "et"))
    b = spread_join(own, et.select("eid", "et"), "et").select("pid", "eid")
    return a.unionByName(b).distinct()


def _years(arxiv_id: str) -> F.Column:
    yy = F.coalesce(F.nullif(F.regexp_extract(arxiv_id, r"^(\d{2})\d{2}\.", 1), F.lit("")), F.nullif(F.regexp_extract(arxiv_id, r"/(\d{2})\d{2}\d+", 1), F.lit(""))).try_cast("int")
    mm = F.coalesce(F.nullif(F.regexp_extract(arxiv_id, r"^\d{2}(\d{2})\.", 1), F.lit("")), F.nullif(F.regexp_extract(arxiv_id, r"/\d{2}(\d{2})\d+", 1), F.lit(""))).try_cast("int")
    return F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy) + F.coalesce(mm, F.lit(6)) / 12.0


def similarity_vectors(papers: DataFrame, entries: DataFrame, log: DataFrame) -> DataFrame:
    """(paper_key, arxiv_id, features...) of all candidates, once per key and identifier (its best entry form)."""
    was_cut = lambda c: F.coalesce(F.col(c).rlike(_CUT.pattern), F.lit(False))
    pf = papers.select("paper_key", _title_key("title").alias("tk"), was_cut("title").alias("pc"), F.coalesce("authors", F.lit("")).alias("authors"), "when_p").filter("paper_key is not null and tk <> ''")
    pf = pf.withColumn("author", F.trim(F.split_part("authors", F.lit(","), F.lit(1))))
    pf = pf.withColumn("author", F.when(F.lower("author").isin("null", "none", "n/a", "et al.", "anonymous"), "").otherwise(F.col("author")))
    pf = cut(pf.groupBy("paper_key", "tk", "pc", "author").agg(F.avg("when_p").alias("when_p")))
    ef = entries.select("arxiv_id", _title_key("title").alias("tk"), was_cut("title").alias("ec"), F.trim(F.coalesce("surname", F.lit(""))).alias("name")).filter("arxiv_id is not null and tk <> ''").distinct()
    ef = cut(ef.withColumn("when_e", _years("arxiv_id")))
    # forms: copies of one title and author are compared once
    pform = pf.select("tk", "pc", "author").distinct().withColumn("pid", F.xxhash64("tk", "pc", "author")).withColumn("who", _surnames("author"))
    eform = ef.withColumn("eid", F.xxhash64("arxiv_id", "tk", "ec", "name")).withColumn("who", _surnames("name"))
    pairs = candidates(pform, eform)
    j = pairs.join(pform.select("pid", "tk", "pc", "author"), "pid").join(eform.select("eid", F.col("tk").alias("tk2"), "ec", "name", "arxiv_id", "when_e"), "eid")
    wa, wb = F.array_distinct(F.split("tk", " ")), F.array_distinct(F.split("tk2", " "))
    alike = F.size(F.array_intersect(wa, wb)) >= JACCARD * F.least(F.size(wa), F.size(wb))
    few = F.least(F.size(wa), F.size(wb)) <= 5  # titles of few words may be alike with an error in most of them
    j = j.filter(F.when(alike, True).when(few, F.levenshtein("tk", "tk2") <= 0.3 * F.greatest(F.length("tk"), F.length("tk2"))).otherwise(False))
    # the judging that follows costs far more than the bytes it reads suggest, so it is spread by number
    j = j.repartition(max(int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")), papers.sparkSession.sparkContext.defaultParallelism), "pid", "eid")
    j = j.withColumn("tm", _title_match("tk", "tk2", "pc", "ec")).select("*", "tm.held", "tm.cover").drop("tm").filter("held >= 0.4")
    j = j.withColumn("author_sim", _author_sim("author", "name"))
    full = j.join(pf.select("paper_key", "tk", "pc", "author", "when_p"), ["tk", "pc", "author"])
    gap = F.abs(F.col("when_p") - F.col("when_e"))
    full = full.withColumn("date", F.exp(-F.coalesce(gap, F.lit(1.5)) / 2))
    seen = log.select("paper_key", _title_key("matched_title").alias("tk2"), F.when(F.col("title_sim") > 1, F.col("title_sim") / 100).otherwise(F.col("title_sim")).alias("s")).filter("tk2 <> ''").groupBy("paper_key", "tk2").agg(F.max("s").alias("s"))
    full = full.join(seen, ["paper_key", "tk2"], "left").withColumn("log", NO_LOG + LOG_WEIGHT * (F.when(F.col("s").isNull(), NO_LOG).otherwise(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0))) - NO_LOG))
    order = F.struct((F.col("author_sim") + F.col("held")).alias("_s"), "held", "cover", "author_sim", "date", "log")
    best = full.groupBy("paper_key", "arxiv_id").agg(F.max(order).alias("b"))
    return best.select("paper_key", "arxiv_id", "b.held", "b.cover", F.col("b.author_sim").alias("author"), "b.date", "b.log")


def _logpdf(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    _, det = np.linalg.slogdet(cov)
    return -0.5 * (np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d) + det + len(mean) * np.log(2 * np.pi))


UNKNOWN = 0.5
_AUTHOR = FEATURES.index("author")


def posteriors(b: pd.DataFrame, model: dict) -> np.ndarray:
    """Posterior of each candidate; the candidates of a paper, which stand together, exclude each other.

    Where an author is unknown the densities leave that dimension out.
    """
    x = b[FEATURES].to_numpy()
    prior = np.log(model["share"]) - np.log1p(-model["share"])
    lo = np.empty(len(x))
    unknown = x[:, _AUTHOR] == UNKNOWN
    for rows, dims in ((~unknown, list(range(len(FEATURES)))), (unknown, [i for i in range(len(FEATURES)) if i != _AUTHOR])):
        if rows.any():
            sub = np.ix_(dims, dims)
            lo[rows] = prior + _logpdf(x[rows][:, dims], model["m1"][dims], model["c1"][sub]) - _logpdf(x[rows][:, dims], model["m0"][dims], model["c0"][sub])
    odds = np.exp(np.clip(lo, -60, 60))
    total = pd.Series(odds).groupby(b["paper_key"].to_numpy()).transform("sum").to_numpy()
    return odds / (1 + total)


def expected(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with an unknown author similarity replaced by what the component expects given the other dimensions, and the variance that stays."""
    rest = [i for i in range(len(FEATURES)) if i != _AUTHOR]
    slope = np.linalg.solve(cov[np.ix_(rest, rest)], cov[rest, _AUTHOR])
    unknown, z = x[:, _AUTHOR] == UNKNOWN, x.copy()
    z[unknown, _AUTHOR] = mean[_AUTHOR] + (x[unknown][:, rest] - mean[rest]) @ slope
    return z, float(cov[_AUTHOR, _AUTHOR] - cov[_AUTHOR, rest] @ slope)


def fit(pairs: DataFrame, rounds: int = 40) -> dict:
    """Mixture of matches and others by expectation-maximisation over all candidates; the pairs of a paper must share a partition and stand together."""
    k = len(FEATURES)
    eye = np.eye(k)
    # the start says what a match looks like: near full agreement; where the fit ends it decides itself
    model = {
        "share": START_SHARE, "m1": np.array([0.98, 0.95, 0.95, 0.7, 0.75]), "m0": np.array([0.65, 0.5, 0.3, 0.35, 0.7]),
        "c1": eye * 0.01, "c0": eye * 0.04,
    }
    for _ in range(rounds):

        def stats(b: pd.DataFrame, model=model) -> np.ndarray:
            r, x = posteriors(b, model), b[FEATURES].to_numpy()
            out = [len(r), r.sum()]
            for w, c in ((r, "1"), (1 - r, "0")):
                z, rest = expected(x, model["m" + c], model["c" + c])
                second = (z * w[:, None]).T @ z
                second[_AUTHOR, _AUTHOR] += (w * (x[:, _AUTHOR] == UNKNOWN)).sum() * rest
                out += [*(w @ z), *second.ravel()]
            return np.array(out)

        s = L.partial_sums(pairs, stats, 2 + 2 * (k + k * k), "paper_key")
        n, n1 = s[0], s[1]
        if n < 10 or n1 < 1 or n - n1 < 1:
            return model
        new = {"share": float(np.clip(n1 / n, 1e-4, 1 - 1e-4))}
        for name, w, at in (("1", n1, 2), ("0", n - n1, 2 + k + k * k)):
            m = s[at : at + k] / w
            c = s[at + k : at + k + k * k].reshape(k, k) / w - np.outer(m, m)
            new["m" + name], new["c" + name] = m, c + eye * REGULAR
        moved = max(np.abs(new[c] - model[c]).max() for c in ("m1", "m0"))
        model = new
        if moved < STILL:
            return model
    logging.getLogger(__name__).warning("the mixture still moved by %.2g after %d rounds", moved, rounds)
    return model


def match_works(papers: DataFrame, entries: DataFrame, log: DataFrame) -> DataFrame:
    """(paper_key, arxiv_id, confidence) of every candidate pair with its posterior; at most one pair of a paper exceeds one half.

    ``papers``: paper_key, title, authors, venue_short, fetched_at; ``entries``: arxiv_id, title, surname; ``log``: paper_key,
    matched_title, title_sim. Repeated rows count once, null or empty titles have no candidates, missing authors neither help nor hurt.
    """
    year = F.nullif(F.regexp_extract(F.coalesce("venue_short", F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("double") + 0.5
    p = papers.withColumn("when_p", F.coalesce(year, F.year("fetched_at") + F.month("fetched_at") / 12.0))
    v = similarity_vectors(p, entries, log)
    pairs = cut(v.repartition("paper_key").sortWithinPartitions("paper_key", "arxiv_id"))
    model = fit(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in L.whole_groups(batches, "paper_key"):
            yield b[["paper_key", "arxiv_id"]].assign(confidence=posteriors(b, model))

    return pairs.mapInPandas(run, "paper_key string, arxiv_id string, confidence double")
