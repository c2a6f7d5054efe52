"""Problem 3: catalogue listings of one product.

Listings are parsed into brand, line, type and attributes in canonical units. What is a name and what a common word, which store
names are brands and which phrases stand for a product type is learnt from the catalogue: common words stand in lower case in
some text or beside very many manufacturers, brands are stated as manufacturers, and type phrases are those that titles share with
their own texts and that go with one category. Listings are compared field by field within blocks; the weight of each field's agreement, disagreement and silence is fitted by expectation-maximisation over all compared
pairs (probabilistic linkage with conditionally independent fields). Pairs above a threshold are clustered; a cluster never
takes in a listing that contradicts one of its stated attributes.
"""

from __future__ import annotations

import html
import logging
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import chars as C
from rankloom.llm import names as N
from rankloom.llm.linkage import deletions, one_edit
from rankloom.session import cut

#: Relative difference of one quantity given in two units.
ROUNDING = 0.035
#: Edit distance within which two spellings are of one name; an exchange of neighbours counts two.
SPELLING = 2
#: Letters from which a type phrase can be told with one typing error.
TELLING = 5
#: Change of the shares below which the weights count as settled.
STILL = 1e-3
#: Posterior from which a pair is a link.
LINK = 0.5

# Units in millimetres, grams, millilitres.
LENGTH = {"mm": 1, "cm": 10, "m": 1000, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4, "ft": 304.8, "feet": 304.8, "foot": 304.8}
WEIGHT = {"mg": 0.001, "g": 1, "gram": 1, "grams": 1, "gr": 1, "kg": 1000, "kilogram": 1000, "kilograms": 1000, "oz": 28.3495, "ounce": 28.3495, "ounces": 28.3495, "lb": 453.592, "lbs": 453.592, "pound": 453.592, "pounds": 453.592}
VOLUME = {"ml": 1, "cl": 10, "dl": 100, "l": 1000, "liter": 1000, "litre": 1000, "liters": 1000, "litres": 1000, "floz": 29.5735}
UNITS = frozenset(u for u in [*LENGTH, *WEIGHT, *VOLUME, "w", "kw", "watt", "watts", "mah", "ah", "mb", "gb", "tb", "pcs", "pc", "pk", "ct", "pp"] if u.isalpha())
# Basic colours, materials and scents with their other names.
COLOURS = {c: c for c in "black white red blue green yellow pink purple orange brown grey silver gold beige turquoise violet".split()} | {"gray": "grey", "navy": "blue", "crimson": "red", "scarlet": "red", "ivory": "white", "charcoal": "grey", "violet": "purple"}
MATERIALS = {m: m for m in "plastic nylon cotton steel wood leather rubber aluminium silicone bamboo metal wool polyester glass ceramic brass felt".split()} | {"aluminum": "aluminium", "wooden": "wood", "oak": "wood", "maple": "wood"}
SCENTS = {s: s for s in "mint citrus rose lavender vanilla coconut lemon jasmine".split()} | {"unscented": "none", "fragrance-free": "none", "scent-free": "none", "peppermint": "mint"}
# Words of any listing, known before anything is learnt.
BASIC = frozenset("a an and by for from in of on the to with pack set box case piece pieces count model new".split())
PLACEHOLDER = frozenset(["", "n/a", "na", "null", "none", "title", "no title", "untitled", "-", "--", "tbd", "test", "unknown", "placeholder", "product", "item"])

_NUM = r"(\d+(?:[.,]\d+)?)"
_Q = {
    "volume": re.compile(rf"(?i){_NUM}\s*-?(fl\.?\s*oz|ml|cl|dl|l(?:it(?:er|re)s?)?)(?![a-z])"),
    "weight": re.compile(rf"(?i){_NUM}\s*-?(mg|kg|kilograms?|grams?|gr?|ounces?|oz|lbs?|pounds?)(?![a-z])"),
    "length": re.compile(rf"(?i){_NUM}\s*-?(mm|cm|m(?!ah)|inch(?:es)?|in(?![a-z])|\"|″|ft|feet|foot)(?![a-z])"),
    "power": re.compile(rf"(?i){_NUM}\s*-?(w|watts?)(?![a-z])"),
    "capacity": re.compile(rf"(?i){_NUM}\s*-?(mah|ah|gb|tb|mb)(?![a-z])"),
}
_SHEETS = re.compile(r"(?i)(\d+)\s*-?\s*sheets?(?![a-z])")
_PAGES = re.compile(r"(?i)(\d+)\s*-?\s*(?:pages?|pp?\.)(?![a-z])|(\d+)\s*pp(?![a-z])")
_PIECES = re.compile(r"(?i)(?:pack|set|box|case)\s+of\s+(\d+)|(\d+)\s*-?\s*(?:pieces?|pcs?\.?|count|ct\.?|packs?|pk|pce)(?![a-z])")
# Numbers of pieces in words.
COUNT_WORDS = {"single": 1.0, "half dozen": 6.0, "dozen": 12.0, "two dozen": 24.0, "twin pack": 2.0, "one piece": 1.0}
_COUNT_WORD = re.compile(r"(?i)\b(?:single|half[\s-]+dozen|two[\s-]+dozen|dozen|twin[\s-]+pack|one[\s-]+piece)\b")
_MODEL = re.compile(r"(?i)\b(?:model\s+)?([a-z]{2,4})[\s-]?(\d{3,5})\b(?!\s*(?:mm|cm|ml|mah|pages?|pcs|watts?|grams?)\b)")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
FIELDS = ["brand", "line", "model", "colour", "material", "scent", "length", "weight", "volume", "power", "capacity", "extent", "pieces"]
ATTRIBUTES = FIELDS[2:]
NUMBERS = ("length", "weight", "volume", "power", "capacity", "extent", "pieces")
EXACT = ("pieces", "extent")


def _clean(t: str | None) -> str:
    if not t:
        return ""
    t = html.unescape(t) if "&" in t else t
    return t if t.isascii() else C.visible(C.undo_mojibake(t)).translate(C.TO_LATIN)


def _quantities(text: str) -> tuple[dict[str, float], str]:
    """Quantities of a text in canonical units, the first of each kind, and the text without them."""
    out: dict[str, float] = {}
    for pat in (_PIECES,):
        for m in pat.finditer(text):
            out.setdefault("pieces", float(m[1] or m[2]))
        text = pat.sub(" ", text)
    for m in _PAGES.finditer(text):
        out.setdefault("extent", float(m[1] or m[2]))
    for m in _SHEETS.finditer(text):
        out.setdefault("extent", 2 * float(m[1]))
    text = _SHEETS.sub(" ", _PAGES.sub(" ", text))
    for m in _COUNT_WORD.finditer(text):
        out.setdefault("pieces", COUNT_WORDS[re.sub(r"[\s-]+", " ", m[0].lower())])
    for kind, pat in _Q.items():
        for m in pat.finditer(text):
            n, unit = float(m[1].replace(",", ".")), re.sub(r"[\s.]", "", m[2].lower()).replace("″", '"')
            if kind == "volume":
                n *= VOLUME[unit]
            elif kind == "weight":
                n *= WEIGHT[unit]
            elif kind == "length":
                n *= LENGTH[unit]
            elif kind == "capacity":
                n *= {"mah": 1, "ah": 1000, "mb": 1e6, "gb": 1e9, "tb": 1e12}[unit]
            out.setdefault(kind, n)
        text = pat.sub(" ", text)
    return out, text


def _qualities(text: str) -> dict[str, str]:
    low = text.lower()
    out: dict[str, str] = {}
    words = re.findall(r"[a-z]+(?:-free)?", low)
    for i, w in enumerate(words):
        nxt = words[i + 1] if i + 1 < len(words) else ""
        if w in SCENTS and not (w == "rose" and nxt in COLOURS):
            out.setdefault("scent", SCENTS[w])
        elif w in MATERIALS:
            out.setdefault("material", MATERIALS[w])
        elif w in COLOURS and nxt not in COLOURS:
            out.setdefault("colour", COLOURS[w])
    return out


def _fold(w: str) -> str:
    return C.fold(w).replace("-", "")


@lru_cache(maxsize=10_000)
def _phrase_pattern(phrases: tuple[str, ...]) -> re.Pattern | None:
    gone = sorted({p for p in phrases if p}, key=lambda p: (-len(p), p))
    return re.compile("(?i)" + "|".join(r"\b" + re.escape(p).replace(r"\ ", r"[\s-]+").replace(" ", r"[\s-]+") + r"\b" for p in gone)) if gone else None


def errors(a: str, b: str) -> int:
    """Typing errors that two spellings of one name may differ by: the shorter, the fewer."""
    n = min(len(a), len(b))
    return SPELLING if n >= 7 else 1 if n >= 4 else 0


def _alike(a: str, b: str) -> bool:
    return a == b or N.osa(a, b, SPELLING) <= errors(a, b)


def parse(title: str | None, features, description, makers, phrases, common, brand_words, text_names, sure=None) -> dict:
    """Fields of one listing; what isn't stated is None.

    ``makers`` are its manufacturer and its store where that is a brand; ``phrases`` the type phrases found in it; ``common`` the words of its title
    that are no names, ``sure`` those that are names in some text; ``brand_words`` its words that are brands somewhere; ``text_names`` the names its texts mention.
    """
    listed = lambda x: [v for v in x if v] if x is not None else []
    title = _clean(title)
    if title.strip().lower() in PLACEHOLDER:
        title = ""
    feats, descs = [_clean(x) for x in listed(features)], [_clean(x) for x in listed(description)]
    known, plain = {_fold(_clean(w)) for w in listed(brand_words)}, {_fold(_clean(w)) for w in listed(common)}
    brands, lines = Counter(), Counter()
    for m in listed(makers):
        brands[_fold(_clean(m)).replace(" ", "")] += 2
    for w in listed(text_names):
        w = _fold(_clean(w))
        if len(w) > 1 and not any(_alike(w, b) for b in brands):
            (brands if w in known else lines)[w] += 1
    out: dict = {}
    rest_of_title = title
    pat = _phrase_pattern(tuple(sorted(listed(phrases))))
    for k, t in enumerate([title, *feats, *descs]):
        t = pat.sub(" | ", t) if pat else t
        if k == 0:
            rest_of_title = t
            if m := _MODEL.search(re.sub(r"(?i)\bnew\s+\d{4}\b|\b(?:pack|set|box)\s+of\s+\d+", " ", t)):
                out["model"] = (m[1] + m[2]).lower()
                t = t.replace(m[0], " ")
                rest_of_title = t
        q, rest = _quantities(t)
        for f, v in q.items():
            out.setdefault(f, v)
        if k == 0:
            rest_of_title = rest
        for f, v in _qualities(rest).items():
            out.setdefault(f, v)
    # names in the title: words that are no common ones; the brand comes before the line
    names = []
    for w in _WORD.findall(re.sub(r"\([^)]*\)|\d+%?", " ", rest_of_title)):
        low = _fold(w)
        if len(low) > 1 and not all(_fold(x) in plain for x in w.split("-")) and low not in COLOURS and low not in MATERIALS and low not in SCENTS and low not in UNITS:
            names.append(low)
    first = lambda c: min(c, key=lambda w: (-c[w], w)) if c else None
    brand = first(brands)
    if brand is None:
        brand = next((w for w in names if w in known), None)
    line = first(lines)
    # of a text's names the one that the title has as well is the line
    shared = [x for x in lines if any(_alike(w, x) for w in names)]
    if shared:
        line = min(shared, key=lambda x: (-lines[x], x))
    certain = {_fold(_clean(w)) for w in listed(sure)}
    taken = [w for w in names if not ((brand is not None and _alike(w, brand)) or any(_alike(w, b) for b in brands) or any(_alike(w, x) for x in lines))]
    if brand is not None and line is None and (told := [w for w in taken if w in certain]):
        line = told[0]
    for w in taken:
        i = names.index(w)
        if line is None and (brand is not None or i > 0 or len(names) == 1):
            line = w
        elif brand is None and i + 1 < len(names):
            brand = w
        elif line is None:
            line = w
    out["brand"], out["line"] = brand, line
    return out


PARSED = T.StructType([T.StructField(f, T.DoubleType() if f in NUMBERS else T.StringType()) for f in FIELDS])


@F.pandas_udf(PARSED)
def _parse(title: pd.Series, feats: pd.Series, descs: pd.Series, makers: pd.Series, phrases: pd.Series, common: pd.Series, brand_words: pd.Series, text_names: pd.Series, sure: pd.Series) -> pd.DataFrame:
    rows = [parse(*r) for r in zip(title, feats, descs, makers, phrases, common, brand_words, text_names, sure, strict=True)]
    out = pd.DataFrame([{f: r.get(f) for f in FIELDS} for r in rows], columns=FIELDS)
    for f in FIELDS:
        out[f] = out[f].astype("float64") if f in NUMBERS else out[f].astype(object).where(out[f].notna(), None)
    return out


#: A word in Java's patterns.
_JWORD = r"\p{L}+"
#: Share of a title word's rows that its most frequent manufacturer has; below it the word belongs to nobody.
OWNED = 0.1
#: And it must stand beside so many of all manufacturers, which a name that several of them use doesn't.
WIDE = 0.05
#: The first for a word that texts write in capitals throughout: with several manufacturers it is an abbreviation.
ABBREVIATED = 0.6
#: Lower bound (one standard error) of the share that a phrase's or a store form's best case has; a single case gives one half.
SURE = 0.5


def _bound(m: F.Column, n: F.Column) -> F.Column:
    p = m / n
    return (p + 0.5 / n - F.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)


def _phrase_key(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\-]+", " "))


def _title_words() -> F.Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}]+", " "), " "), lambda w: w != "")


def _grams(w: F.Column, most: int = 5) -> F.Column:
    """All runs of one to ``most`` words."""
    each = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
    return F.filter(F.array_distinct(F.flatten(each)), lambda g: g != "")


_BREAK, _GAP = re.compile(r"[.!?:;]+"), re.compile(r"[\W\d_]+")


def shared_runs(words, common, texts, most: int = 5) -> list[str]:
    """The longest runs of one to ``most`` words of a title, all of them ``common``, that one of the texts has as well."""
    if words is None or common is None or texts is None or not len(common):
        return []
    said = " . ".join(" . ".join(_GAP.sub(" ", s).strip() for s in _BREAK.split(t.lower())) for t in texts)
    said, plain, words, found = f" {said} ", set(common), list(words), []
    for i in range(len(words)):
        j = i
        while j < len(words) and j - i < most and words[j] in plain and f" {' '.join(words[i : j + 1])} " in said:
            j += 1
        if j > i:
            found.append(" ".join(words[i:j]))
    return sorted({g for g in found if not any(g != o and f" {g} " in f" {o} " for o in found)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shared_runs(words: pd.Series, common: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([shared_runs(*r) for r in zip(words, common, texts, strict=True)], dtype=object)


def prepared(items: DataFrame) -> DataFrame:
    """One row per listing, from the row with the newest counts: title, features, description, texts, cat, man, store. Missing columns are null."""
    rest = [c for c in ("rating_number", "title", "store", "categories", "features", "description", "details") if c in items.columns]
    one = items.filter("parent_asin is not null").groupBy("parent_asin").agg(F.max(F.struct(*rest)).alias("m")).select("parent_asin", "m.*")
    texts = F.concat(F.coalesce("features", F.array().cast("array<string>")), F.coalesce("description", F.array().cast("array<string>")))
    man = F.nullif(F.trim(F.lower(F.get_json_object("details", "$.Manufacturer"))), F.lit(""))
    cat = F.nullif(_phrase_key(F.try_element_at("categories", F.lit(-1))), F.lit(""))
    one = one.select("parent_asin", "title", "features", "description", F.filter(texts, lambda x: x.isNotNull()).alias("texts"), cat.alias("cat"), man.alias("man"), F.nullif(F.trim(F.lower("store")), F.lit("")).alias("store"))
    return cut(one)


def lexicon(one: DataFrame, shops: DataFrame | None = None) -> DataFrame:
    """(word, common, brand, name): what is known of the words of the catalogue, each of the three true or null.

    Common words stand in a category's name or in lower case in some text of the catalogue, or stand beside a twentieth of all manufacturers and more, none of which has a tenth of them, and never as a
    capitalised name in a text; so are abbreviations of several manufacturers, and words of five letters and more that one typing error makes of such a word, unless they are brands or names in texts.
    Brands are manufacturers, and words that stores of a trusted form are called (``shops``, the ``store_brands`` if they are at hand). Names stand in some text with a capital within a sentence, and in none in lower case.
    """
    x = one.select("man", F.explode("texts").alias("x")).select("man", F.explode(F.split("x", r"[.!?:;]+\s+")).alias("x")).select("man", F.regexp_extract_all("x", F.lit(f"({_JWORD})"), 1).alias("w"))
    words = x.select("man", F.posexplode("w").alias("i", "w")).select("man", F.lower("w").alias("word"), (F.col("w") == F.lower("w")).alias("low"), (F.col("i") > 0).alias("inner"), F.col("w").rlike(r"^\p{Lu}\p{Ll}+$").alias("cap"))
    makers = one.agg(F.countDistinct("man").alias("all"))  # one row
    wide = (F.col("top") < OWNED * F.col("made")) & (F.col("mans") >= WIDE * F.col("all"))

    def spread(df: DataFrame, *aggs: F.Column) -> DataFrame:
        """Per word how often it stands beside a manufacturer, beside the most frequent one, and beside how many."""
        own = df.groupBy("word", "man").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("low", "name", "upper") if c in df.columns])
        known = F.when(F.col("man").isNotNull(), F.col("n"))
        out = own.groupBy("word").agg(F.sum("n").alias("m"), F.max(known).alias("top"), F.sum(known).alias("made"), F.count("man").alias("mans"), *aggs)
        return out.crossJoin(F.broadcast(makers)).withColumn("wide", F.coalesce(wide, F.lit(False))).drop("all", "mans")

    flags = words.select("man", "word", "low", (F.col("cap") & F.col("inner")).alias("name"), (~F.col("low") & F.col("inner")).alias("upper"))
    seen = spread(flags, *[F.max(c).alias(c) for c in ("low", "name", "upper")]).select("word", "low", (F.col("name") & ~F.col("wide")).alias("name"), F.col("upper"), F.col("wide").alias("label"))
    per = spread(one.select("man", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(f"({_JWORD})"), 1))).alias("word")))
    brands = cut(one.filter("man is not null").select(F.explode(F.array(F.col("man"), F.regexp_replace("man", " ", ""))).alias("word")).unionByName((store_brands(one) if shops is None else shops).select("word")).distinct())
    w = per.join(seen, "word", "full").join(brands.withColumn("brand", F.lit(True)), "word", "left")
    everywhere = (F.col("wide") | F.coalesce("label", F.lit(False))) & ~F.coalesce("name", F.lit(False))
    everywhere = everywhere | (F.coalesce("upper", F.lit(False)) & ~F.col("name") & (F.col("top") < ABBREVIATED * F.col("made")))
    kinds = one.filter("cat is not null").select(F.explode(F.split("cat", r"[^\p{L}]+")).alias("word")).unionByName(one.sparkSession.createDataFrame([(x,) for x in sorted(BASIC)], "word string")).filter("word <> ''").distinct()
    w = cut(w.join(kinds.withColumn("kind", F.lit(True)), "word", "full"))
    common = cut(w.filter(F.col("brand").isNull() & (F.col("kind").isNotNull() | F.coalesce("low", F.lit(False)) | F.coalesce(everywhere, F.lit(False)))).select("word", F.coalesce("m", F.lit(0)).alias("m")))
    open_ = w.filter("brand is null and not coalesce(name, false) and m is not null").join(common.select("word"), "word", "left_anti")
    keys = lambda df, out: df.filter(F.length("word") >= TELLING).select(F.col("word").alias(out), "m", F.explode(deletions(F.col("word"), 1)).alias("d"))
    typed = keys(open_, "word").join(keys(common.withColumn("m", F.col("m") + 1), "good").withColumnRenamed("m", "k"), "d").filter("m < k").select("word").distinct()
    out = common.select("word").unionByName(typed).distinct().withColumn("common", F.lit(True)).join(brands.withColumn("brand", F.lit(True)), "word", "full")
    names = w.filter(F.col("name") & ~F.col("low") & ~F.col("word").isin(sorted(UNITS))).select("word").withColumn("name", F.lit(True))
    return cut(out.join(names, "word", "full"))


def store_brands(one: DataFrame) -> DataFrame:
    """(parent_asin, word): the name in a listing's store, its rarest word, where stores of this form are mostly called like the manufacturer."""
    s = one.filter("store is not null").select("parent_asin", "store", "man")
    words = s.select("parent_asin", "store", "man", F.explode(F.array_distinct(F.regexp_extract_all("store", F.lit(f"({_JWORD})"), 1))).alias("word"))
    often = words.groupBy("word").agg(F.countDistinct("store").alias("k"))
    name = words.join(often, "word").groupBy("parent_asin", "store", "man").agg(F.min_by("word", F.struct("k", "word")).alias("word"))
    form = name.withColumn("form", F.regexp_replace(F.replace("store", "word", F.lit("_")), r"_(?: _)+", "_"))
    sure = form.filter("man is not null").groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("man") == F.col("word"), 1)).alias("m")).filter(_bound(F.col("m"), F.col("n")) >= SURE)
    return form.join(sure.select("form"), "form", "left_semi").select("parent_asin", "word").distinct()


def marked_words(one: DataFrame, words: DataFrame) -> DataFrame:
    """(parent_asin, common, brand_words, text_names, sure) of every listing: words of its title that are common, its words that are brands somewhere, the names in its texts, and words of its title that are names in some text."""
    mine = one.select("parent_asin", F.explode(F.array_distinct(_title_words())).alias("word"))
    caps = F.filter(F.flatten(F.transform("texts", lambda x: F.regexp_extract_all(x, F.lit(f"({_JWORD})"), 1))), lambda w: w != F.lower(w))
    told = one.select("parent_asin", F.explode(F.array_distinct(F.transform(caps, lambda w: F.lower(w)))).alias("word"))
    marked = mine.withColumn("title", F.lit(True)).unionByName(told.withColumn("title", F.lit(False))).join(words, "word")
    pick = lambda c: F.collect_set(F.when(c, F.col("word")))  # noqa: E731 - at most the words of one listing
    yes = lambda c: F.coalesce(c, F.lit(False))
    some = marked.groupBy("parent_asin").agg(pick(F.col("title") & yes("common")).alias("common"), pick(yes("brand")).alias("brand_words"), pick(~F.col("title") & (yes("name") | yes("brand")) & ~yes("common")).alias("text_names"), pick(F.col("title") & yes("name") & ~yes("common")).alias("sure"))
    none = F.array().cast("array<string>")
    return one.select("parent_asin").join(some, "parent_asin", "left").select("parent_asin", *[F.coalesce(c, none).alias(c) for c in ("common", "brand_words", "text_names", "sure")])


def type_table(one: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, type, sure) of the phrases that stand for a product type, and how sure that is in tenths.

    A phrase is the longest run of common words that a listing's title shares with one of its own texts, or a category's name, whatever the number of listings. It
    stands for a type if one category has most of its listings; the type of a phrase that never occurs with a category is null. Phrases of colours, materials and
    scents alone are none. As many rows as the catalogue has names for types, whatever the number of listings.
    """
    shared = one.join(known, "parent_asin").select("parent_asin", "cat", _shared_runs(_title_words(), "common", "texts").alias("gs"))
    own = one.filter("cat is not null").select("parent_asin", "cat", F.col("cat").alias("phrase"))
    seen = shared.select("parent_asin", "cat", F.explode("gs").alias("phrase")).unionByName(own).distinct()
    n = seen.groupBy("phrase", "cat").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("phrase").agg(F.sum(F.when(F.col("cat").isNotNull(), F.col("n"))).alias("total"), F.max(F.when(F.col("cat").isNotNull(), F.struct("n", "cat"))).alias("m"))
    qualities = [F.lit(w) for w in sorted({*COLOURS, *MATERIALS, *SCENTS})]
    told = F.exists(F.split("phrase", " "), lambda w: ~w.isin(qualities) & (F.length(w) > 2))
    # "pack of" and "set" go with every category, so no category has most of them; what has none at all must not be so frequent elsewhere
    return per.filter(told & (F.col("m").isNull() | (_bound(F.col("m.n"), F.col("total")) >= SURE))).select("phrase", F.col("m.cat").alias("type"), F.coalesce(F.round(_bound(F.col("m.n"), F.col("total")), 1), F.lit(0.0)).alias("sure"))


def profiles(items: DataFrame) -> DataFrame:
    """(parent_asin, type, said, fields...): one row per listing, from the row with the newest counts. ``said`` is a phrase for its type that no category goes with.

    Steps that several others read are materialised: else the driver plans a tree of several dozen exchanges again after each of them, and starts them all at once.
    """
    one = prepared(items)
    shops = cut(store_brands(one))
    known = cut(marked_words(one, lexicon(one, shops)))
    types = cut(type_table(one, known))
    g = one.select("parent_asin", F.explode(_grams(_title_words())).alias("g"))
    key = types.select(F.trim(F.regexp_replace("phrase", r"[^\p{L}]+", " ")).alias("g"), "phrase", "type", F.col("sure").alias("s")).withColumn("said", F.col("phrase"))
    cats = one.filter("cat is not null").select("parent_asin", F.lit(1).alias("p"), F.col("cat").alias("phrase"), F.col("cat").alias("type"), F.lit(1.0).alias("s"), F.col("cat").alias("said"))
    found = g.withColumn("p", F.lit(3)).join(key, "g").drop("g").unionByName(cats)
    # a phrase of the title with one typing error counts where nothing else tells the type, and is no name either
    typed = key.filter(F.length("g") >= TELLING).select(F.explode(one_edit(F.col("g"), " abcdefghijklmnopqrstuvwxyz")).alias("g"), "said", "type", "s").distinct()
    untold = g.join(one.filter("cat is null").select("parent_asin"), "parent_asin", "left_semi")
    found = found.unionByName(untold.withColumn("p", F.lit(4)).join(typed, "g").select("parent_asin", "p", F.col("g").alias("phrase"), "type", "s", "said"))
    # the category is the surest, then the surest phrase of the title, of several the longest
    rank = F.struct("p", -F.col("s"), -F.length("phrase"), "phrase", "said")
    best = cut(found.groupBy("parent_asin").agg(F.min_by("type", F.when(F.col("type").isNotNull(), rank)).alias("type"), F.min_by("said", F.when(F.col("type").isNull(), rank)).alias("said"), F.collect_set("phrase").alias("phrases")))
    shop = shops.groupBy("parent_asin").agg(F.min("word").alias("shop"))
    j = one.join(best, "parent_asin", "left").join(known, "parent_asin", "left").join(shop, "parent_asin", "left").withColumn("makers", F.filter(F.array("man", "shop"), lambda x: x.isNotNull()))
    n = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.sparkSession.sparkContext.defaultParallelism)
    p = j.repartition(n, "parent_asin").withColumn("f", _parse("title", "features", "description", "makers", "phrases", "common", "brand_words", "text_names", "sure"))
    return p.select("parent_asin", "type", "said", "f.*")


def _spelled(a: str, b: str) -> F.Column:
    """``_alike`` of two columns, an exchange of neighbours counting two errors."""
    n, d = F.least(F.length(a), F.length(b)), F.levenshtein(a, b)
    return (F.col(a) == F.col(b)) | (d <= F.when(n >= 7, SPELLING).when(n >= 4, 1).otherwise(0))


def settle_names(p: DataFrame) -> DataFrame:
    """Brand and line in the spelling that most listings of the type use, where one typing error leads there; a brand that isn't stated is taken from the line if only one brand has it.

    A listing without a type is compared with those of all types, and then takes the type of its brand and line (``settle_types``); one whose brand and line
    have none keeps what it ``said``, where that column is given. "" is a type that nothing tells.
    """
    p = p.withColumn("type", F.coalesce("type", F.lit(""))).withColumn("said", F.col("said") if "said" in p.columns else F.lit(None).cast("string"))
    no_line = p.filter("line is null and brand is not null")
    p = p.filter("line is not null")
    trip = cut(p.groupBy("type", "brand", "line").agg(F.count(F.lit(1)).alias("n")))
    # lines within the edit bound share a deletion variant; each distinct line is compared once, whatever its types and brands
    keyed = cut(trip.select("line").distinct().withColumn("key", F.explode(deletions(F.col("line"), SPELLING))))
    close = cut(keyed.join(keyed.select("key", F.col("line").alias("l2")), "key").select("line", "l2").distinct().filter(_spelled("line", "l2")))
    a = trip.join(close, "line")
    b = trip.filter("brand is not null").select(F.col("type").alias("t2"), F.col("brand").alias("b2"), F.col("line").alias("l2"), F.col("n").alias("n2"))
    near = a.filter("type <> ''").join(b.withColumn("type", F.col("t2")), ["type", "l2"]).unionByName(a.filter("type = ''").join(b, "l2"))
    near = near.filter(F.col("brand").isNull() | _spelled("brand", "b2"))
    near = cut(near.select("type", "brand", "line", "n", "t2", "b2", "l2", "n2").distinct())
    stated = near.filter("brand is not null").groupBy("type", "brand", "line").agg(F.max(F.struct("n2", "b2", "l2")).alias("m")).select("type", F.col("brand"), "line", F.col("m.b2").alias("to_b"), F.col("m.l2").alias("to_l"))
    # spellings of one brand count as one before the uniqueness is judged
    back = near.filter("brand is null").join(stated.select(F.col("type").alias("t2"), F.col("brand").alias("b2"), F.col("line").alias("l2"), F.col("to_b").alias("c_b"), F.col("to_l").alias("c_l")), ["t2", "b2", "l2"])
    silent = back.groupBy("type", "line").agg(F.countDistinct("c_b", "c_l").alias("k"), F.max("c_b").alias("to_b"), F.max("c_l").alias("to_l")).filter("k = 1").select("type", F.lit(None).cast("string").alias("brand"), "line", "to_b", "to_l")
    to = stated.unionByName(silent)
    to = to.select(F.col("type").alias("t_"), F.col("brand").alias("b_"), F.col("line").alias("l_"), "to_b", "to_l")
    j = p.join(to, (p.type == F.col("t_")) & p.brand.eqNullSafe(F.col("b_")) & (p.line == F.col("l_")), "left")
    named = j.select("parent_asin", "type", "said", F.coalesce("to_b", "brand").alias("brand"), F.coalesce("to_l", "line").alias("line"), *ATTRIBUTES)
    named = cut(settle_types(named))
    # a listing that names no line is taken for the only line that its brand has of the type, or at all if the brand has none of it and no category tells it
    has = named.filter("brand is not null").select("type", "brand", "line")
    only = lambda df, *by: df.groupBy(*by).agg(F.countDistinct("line").alias("k"), F.max("line").alias("line_"))
    spoken = no_line.withColumn("known", F.col("type") != "").withColumn("type", F.coalesce(F.nullif("type", F.lit("")), "said", F.lit("")))
    by_type = spoken.join(only(has, "type", "brand"), ["type", "brand"], "left")
    taken = by_type.filter("k = 1")
    loose = by_type.filter("k is null and not known").drop("k", "line_", "type").join(only(has, "brand").filter("k = 1"), "brand").withColumn("type", F.lit(""))
    lines = taken.select("parent_asin", "type", "said", "brand", F.col("line_").alias("line"), *ATTRIBUTES)
    lines = lines.unionByName(settle_types(loose.select("parent_asin", "type", "said", "brand", F.col("line_").alias("line"), *ATTRIBUTES), named))
    return named.unionByName(lines).select("parent_asin", "type", *FIELDS)


def settle_types(named: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Type "" replaced by the type with which the brand has the line; of several the one whose listings contradict least and agree most, of the same listings or those ``among``; else by what the listing said."""
    named = cut(named)
    bare = named.filter("type = ''")
    typed = (named if among is None else among).filter("type <> '' and brand is not null").groupBy("type", "brand", "line", *ATTRIBUTES).agg(F.count(F.lit(1)).alias("n"))
    typed = typed.select(F.col("type").alias("t2"), "brand", "line", "n", *[F.col(f).alias(f"{f}_2") for f in ATTRIBUTES])
    same = []
    for f in ATTRIBUTES:
        x, y = F.col(f), F.col(f"{f}_2")
        room = ROUNDING if f in NUMBERS and f not in EXACT else 0
        same.append(F.abs(x - y) <= room * F.greatest(x, y) + 1e-9 if f in NUMBERS else x == y)
    score = sum((F.when(e, 1).when(~e, -len(ATTRIBUTES)).otherwise(0) for e in same), F.lit(0))
    best = bare.join(typed, ["brand", "line"]).groupBy("parent_asin").agg(F.max_by("t2", F.struct(score, "n", "t2")).alias("t2"))
    return named.join(best, "parent_asin", "left").select("parent_asin", F.coalesce("t2", F.nullif("type", F.lit("")), "said", F.lit("")).alias("type"), "said", *FIELDS)


STRINGS = [f for f in FIELDS if f not in NUMBERS]
_ORDER = [*STRINGS, *NUMBERS]
_EXACT = [k for k, f in enumerate(NUMBERS) if f in EXACT]


def _arrays(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Text fields as codes (-1 for null) and number fields as they are."""
    codes = np.stack([pd.factorize(g[f])[0] for f in STRINGS], 1) if len(g) else np.zeros((0, len(STRINGS)), int)
    return codes, g[list(NUMBERS)].to_numpy(dtype=float)


def _levels(codes: np.ndarray, numbers: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per pair and field (text fields first): 2 agree, 1 one of them is silent, 0 disagree."""
    x, y = codes[i], codes[j]
    text = np.where((x < 0) | (y < 0), 1, np.where(x == y, 2, 0))
    x, y = numbers[i], numbers[j]
    room = ROUNDING * np.maximum(x, y)
    room[:, _EXACT] = 1e-9
    with np.errstate(invalid="ignore"):
        num = np.where(np.isnan(x) | np.isnan(y), 1, np.where(np.abs(x - y) <= room, 2, 0))
    return np.concatenate([text, num], 1)


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, first row, size) of the complete runs of equal keys in sorted batches; a run may straddle batches."""
    held: pd.DataFrame | None = None

    def cut_up(b: pd.DataFrame) -> np.ndarray:
        same = np.ones(len(b) - 1, dtype=bool)
        for k in keys:
            v = b[k].to_numpy()
            same &= v[1:] == v[:-1]
        return np.concatenate([[0], np.flatnonzero(~same) + 1, [len(b)]])

    for b in batches:
        if not len(b):
            continue
        b = b.reset_index(drop=True) if held is None else pd.concat([held, b], ignore_index=True)
        at = cut_up(b)
        if len(at) > 2:
            yield b.iloc[: at[-2]], at[:-2], np.diff(at[:-1])
        held = b.iloc[at[-2] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0]), np.array([len(held)])


def _pairs(first: np.ndarray, size: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within runs, in pieces of about ``most`` pairs, or of one row's pairs where that is more."""
    for k in np.unique(size[size > 1]):
        own, k = first[size == k], int(k)
        if k * (k - 1) // 2 > most:
            step = max(1, most // k)
            for f in own:
                for lo in range(0, k - 1, step):
                    rows = np.arange(lo, min(lo + step, k - 1))
                    i = np.repeat(rows, k - 1 - rows)
                    yield f + i, f + np.concatenate([np.arange(r + 1, k) for r in rows])
        else:
            i, j = np.triu_indices(k, 1)
            step = max(1, most // len(i))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step, None]
                yield (part + i).ravel(), (part + j).ravel()


def weights(model: dict) -> np.ndarray:
    """Log likelihood ratio of each field's level; silence says nothing."""
    w = np.log(model["m"]) - np.log(model["u"])
    w[:, 1] = 0.0
    return w


def posterior(levels: np.ndarray, model: dict) -> np.ndarray:
    lo = np.log(model["share"]) - np.log1p(-model["share"]) + weights(model)[np.arange(len(_ORDER)), levels].sum(1)
    return 1 / (1 + np.exp(-np.clip(lo, -50, 50)))


def fit_weights(profiles_by_line: DataFrame, rounds: int = 40) -> dict:
    """Shares of agreement among matches and others, field by field, by expectation-maximisation over all pairs of a block.

    The blocks (type and line) stand together in sorted partitions; their pairs are compared in place and never shuffled.
    """
    n_f = len(_ORDER)
    model = {"share": 0.5, "m": np.tile([0.05, 1.0, 0.95], (n_f, 1)), "u": np.tile([0.6, 1.0, 0.4], (n_f, 1))}
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + 6 * n_f)
            for g, first, size in _blocks(batches, ["type", "line"]):
                codes, numbers = _arrays(g)
                for i, j in _pairs(first, size):
                    lv = _levels(codes, numbers, i, j)
                    r = posterior(lv, model)
                    total[:2] += len(lv), r.sum()
                    total[2:] += np.concatenate([w @ (lv == lev) for w in (r, 1 - r) for lev in (0, 1, 2)])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        got = profiles_by_line.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        s = got["v"].to_numpy()
        if len(s) == 0 or s[0] < 10 or s[1] < 1 or s[0] - s[1] < 1:
            return model
        t = s[2:].reshape(2, 3, n_f)
        new = {"share": float(np.clip(s[1] / s[0], 1e-4, 1 - 1e-4))}
        for name, x in (("m", t[0]), ("u", t[1])):
            x = x.T + [0.5, 0.0, 0.5]  # a level that never occurred isn't impossible
            x[:, 1] = x[:, 0] + x[:, 2]  # shares are taken of the pairs in which both sides speak
            new[name] = x / x[:, 1:2]
        moved = np.abs(new["m"] - model["m"]).max()
        model = new
        if moved < STILL:
            return model
    logging.getLogger(__name__).warning("the weights still moved by %.2g after %d rounds", moved, rounds)
    return model


def cluster_blocks(g: pd.DataFrame, first: np.ndarray, size: np.ndarray, model: dict) -> np.ndarray:
    """Cluster number per profile: strongest links of a block first, never against a stated attribute of any member of the other side.

    What the members of a cluster state is kept with it: one value of each text field, the least and the largest of each number. Of two clusters
    the largest of one and the least of the other are the furthest apart, so they tell of any contradiction, and nothing is kept per pair.
    """
    codes, numbers = _arrays(g)
    copies = g["copies"].to_numpy()
    label = np.arange(len(g))
    base, w = np.log(model["share"]) - np.log1p(-model["share"]), weights(model)
    links = []
    for i, j in _pairs(first, size):
        lv = _levels(codes, numbers, i, j)
        score = base + w[np.arange(len(_ORDER)), lv].sum(1)
        ok = ~(lv == 0).any(1) & (score > np.log(LINK / (1 - LINK)))
        links.append(np.stack([score, (lv == 2).sum(1), copies[i] + copies[j], i, j], 1)[ok])
    if not links:
        return label
    edges = np.concatenate(links)
    members = {c: [c] for c in range(len(g))}
    text, low, high = codes.copy(), numbers.copy(), numbers.copy()
    room = np.full(len(NUMBERS), ROUNDING)
    room[_EXACT] = 0.0
    for e in np.lexsort((edges[:, 4], edges[:, 3], -edges[:, 2], -edges[:, 1], -edges[:, 0])):
        a, b = label[int(edges[e, 3])], label[int(edges[e, 4])]
        if a == b or ((text[a] >= 0) & (text[b] >= 0) & (text[a] != text[b])).any():
            continue
        top, least = np.fmax(high[a], high[b]), np.fmin(low[a], low[b])
        both = ~np.isnan(high[a]) & ~np.isnan(high[b])
        if (both & (top - least > room * top + 1e-9)).any():
            continue
        text[a], low[a], high[a] = np.where(text[a] >= 0, text[a], text[b]), least, top
        members[a] += members.pop(b)
        label[members[a]] = a
    return label


def group_listings(items: DataFrame) -> DataFrame:
    """(parent_asin, group_id): listings of one product share a group; a listing without a twin is alone in its own.

    Nulls and empty arrays state nothing; a listing without a type takes that of its brand and line; listings with neither line nor brand stay alone. Copies with
    the same parsed profile are compared once, so a block holds as many rows as a line has differently stated versions. Repeated
    rows of one ``parent_asin`` count as one listing.
    """
    p = settle_names(cut(profiles(items)))  # read three times
    spelled = F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0002")) for f in ("type", *FIELDS)])
    p = cut(p.withColumn("profile", F.xxhash64(spelled)))
    prof = p.groupBy("profile", "type", *FIELDS).agg(F.count(F.lit(1)).cast("bigint").alias("copies"), F.min("parent_asin").alias("rep"))
    n = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.sparkSession.sparkContext.defaultParallelism)
    prof = cut(prof.repartition(n, "type", "line").sortWithinPartitions("type", "line", "rep"))
    model = fit_weights(prof)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, first, size in _blocks(batches, ["type", "line"]):
            rep = g["rep"].to_numpy()
            yield pd.DataFrame({"profile": g["profile"].to_numpy(), "group_id": rep[cluster_blocks(g, first, size, model)]})

    groups = prof.mapInPandas(run, "profile bigint, group_id string")
    placed = p.select("parent_asin", "profile").join(groups, "profile").select("parent_asin", "group_id")
    rest = items.select("parent_asin").filter("parent_asin is not null").distinct().join(p.select("parent_asin"), "parent_asin", "left_anti")
    return placed.unionByName(rest.select("parent_asin", F.col("parent_asin").alias("group_id")))


def same_pairs(groups: DataFrame) -> DataFrame:
    """(asin_a, asin_b), the smaller first: every pair within a group, as the task asks for."""
    groups = cut(groups)  # both sides read them
    a, b = groups.select("group_id", F.col("parent_asin").alias("asin_a")), groups.select("group_id", F.col("parent_asin").alias("asin_b"))
    return a.join(b, "group_id").filter("asin_a < asin_b").select("asin_a", "asin_b")
