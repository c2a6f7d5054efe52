"""Problem 5: variant spellings of names, linked to reference names.

Exact radius join in a metric space: distinct name keys (surnames, heads of group names, glued names) are assigned to
pivots; a typed key goes to every cell that, by the triangle inequality, may hold a reference key within the radius; inside
a cell only keys whose pivot distances differ by at most the radius are compared, with the true edit distance. Pairs within
the radius are then judged by the remaining parts of the name (given names, initials, nicknames, particles).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import chars as C
from rankloom.session import cut

#: Edit distance (insertions, deletions, substitutions) within which keys are joined; a transposition counts two.
RADIUS = 2
#: Pivots, each one of the reference keys: their square root in number, within these bounds.
PIVOTS = (8, 256)
#: Reference keys of one cell and ring beyond which they are split over several tasks.
RING_ROWS = 20_000
PARTICLES = frozenset("de der van von den del della di da dos du la le ten ter zu al el bin ibn".split())
TITLES = frozenset("dr prof professor mr mrs ms phd md msc bsc jr sr ii iii eds ed editor sir dipl ing".split())
FILLER = frozenset("the team group members of and on behalf for".split())

# Given names and their common short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander al lex", "christopher": "chris kit topher", "daniel": "dan danny", "dmitri": "dima mitya dmitry dimitri", "edmund": "ed eddie ned ted",
    "elizabeth": "liz beth lizzie eliza betty lisa bess", "emile": "emil", "frederik": "fred freddy rik fritz frederick", "gabriela": "gabi gaby gabriella ella", "harold": "harry hal",
    "ingrid": "inga inge", "isabella": "bella isa izzy isabel", "joanna": "jo joan asia", "jose": "pepe joe", "katherine": "kate kathy katie kat kitty cathy catherine",
    "leonardo": "leo nardo lenny len", "margaret": "maggie peggy meg marge rita greta", "michael": "mike mick misha mickey", "nikolai": "kolya nick niko nikolay", "oliver": "ollie oli olly",
    "patricia": "pat patty trish tricia", "robert": "bob rob bobby robbie bert", "rosalind": "rosa roz rose lindy linda", "samuel": "sam sammy", "theodora": "dora theo thea teddy",
    "thomas": "tom tommy", "ulrich": "uli ulli utz", "valentin": "val tino vali", "victoria": "vicky vic tori vicki", "william": "bill will billy liam willy",
    "yevgenia": "zhenya genia evgenia eugenia jenya", "zachary": "zach zack zak", "zoe": "zo", "tomoko": "tomo", "matthew": "matt", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben",
    "charles": "charlie chuck", "david": "dave", "edward": "ed ted ned", "eugene": "gene", "francis": "frank", "gregory": "greg", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny",
    "jonathan": "jon", "joseph": "joe", "joshua": "josh", "kenneth": "ken", "lawrence": "larry", "nathaniel": "nate nat", "nicholas": "nick", "peter": "pete", "philip": "phil", "rebecca": "becky",
    "richard": "dick rick", "ronald": "ron", "stephen": "steve", "susan": "sue", "timothy": "tim", "vladimir": "volodya vova", "aleksandr": "sasha", "farid": "fari", "bjorn": "bjoern", "soren": "soeren",
}
_SHORT = {k: frozenset(v.split()) for k, v in NICKNAMES.items()}


def osa(a: str, b: str, most: int) -> int:
    """Edit distance that counts the exchange of neighbours as one, or ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def clean(raw: str) -> str:
    """Visible form in Latin letters without brackets, numbers and footnote marks."""
    t = C.visible(C.undo_mojibake(raw))
    t = t.translate(C.TO_LATIN) if C.FOREIGN.search(t) else t
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]|\d+|[*†‡§¶_]", " ", t)
    t = re.sub(r"(?i)\bph\.?\s?d\b\.?", " ", t)
    t = re.sub(r"(?i)\bv\.\s?d\.\s?", "van der ", t)
    t = re.sub(r"(?i),?\s*\bet\.?\s*al\.?$", "", t)
    t = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", t)  # glued names show by their capitals
    return C.fold(t)


_PART = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(maxsize=200_000)
def parts(raw: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words before the comma, words after it); titles are dropped, dotted initials stand alone, joined ones stay together."""
    t = clean(raw).replace(".-", "-").replace(".", " ")
    sides = [tuple(w for w in _PART.findall(s) if w not in TITLES) for s in t.split(",")]
    sides = [s for s in sides if s]
    if not sides:
        return (), ()
    return sides[0], tuple(w for s in sides[1:] for w in s)


def name_keys(raw: str) -> list[str]:
    """Keys under which a typed name may be found: each word that may be a surname or the head of a group; a single word also as a glued name."""
    a, b = parts(raw)
    words = a + b
    keys = [w.replace("'", "").replace("’", "") for w in words if len(w) >= 4 and w not in PARTICLES and w not in FILLER]
    for w in words:
        keys += [x for x in w.split("-") if "-" in w and len(x) >= 4]
    # a short word can't stand a typing error: it is looked up with the initial of another word
    short = [(k, w) for k, w in enumerate(words) if 2 <= len(w) < 4 and w not in FILLER]
    keys += [short_key(w, o) for k, w in short for i, o in enumerate(words) if i != k]
    return list(dict.fromkeys(keys))


def short_key(surname: str, given: str) -> str:
    return f"{surname} {given[:1]}"


@lru_cache(maxsize=20_000)
def reference(full: str, kind: str) -> dict:
    words = [w for w in _PART.findall(C.fold(full).replace(".-", "-").replace(".", " ")) if w]
    if kind == "group":
        return {"head": words[0] if words else "", "rest": words[1:], "group": True}
    surname = words[-1] if words else ""
    mid = [w for w in words[1:-1] if w not in PARTICLES]
    return {"given": words[0] if len(words) > 1 else "", "middle": mid, "particles": [w for w in words[1:-1] if w in PARTICLES], "surname": surname, "group": False}


def reference_keys(full: str, kind: str) -> list[str]:
    r = reference(full, kind)
    if r["group"]:
        return [r["head"]] if len(r["head"]) >= 4 else [short_key(r["head"], w) for w in r["rest"]]
    g, p = r["given"].replace("-", ""), "".join(r["particles"])
    keys = [g + p + r["surname"], g + "".join(m[0] for m in r["middle"]) + p + r["surname"]]
    if len(r["surname"]) >= 4:
        keys = [r["surname"], *keys]
    else:
        keys += [short_key(r["surname"], x) for x in (g, *sorted(_SHORT.get(g, ()))) if x]
    return list(dict.fromkeys(k for k in keys if k))


def _close(a: str, b: str, least: int = 3) -> bool:
    """One typing error apart, in words long enough to tell."""
    return a == b or (min(len(a), len(b)) >= least and osa(a, b, 1) <= 1)


def _umlaut(a: str) -> str:
    return a.replace("ue", "u").replace("oe", "o").replace("ae", "a")


def same_word(a: str, b: str, least: int = 3) -> bool:
    return _close(a, b, least) or (len(a) >= 5 and _umlaut(a) == _umlaut(b))


def same_surname(a: str, b: str) -> bool:
    """``same_word`` of surnames: under four letters only equal ones, since one letter tells them apart."""
    return a == b or (min(len(a), len(b)) >= 4 and same_word(a, b))


def given_matches(words: list[str], given: str, middle: list[str], surname: str = "") -> bool:
    """Whether the words beside a surname are forms of the given name and middle initials: full, one error, initials, cut, or a short form.

    A middle initial may be missing, and one may stand where the reference has none; a different one means somebody else. Beside a surname
    under four letters, short given names stand no error either.
    """
    least = 4 if 0 < len(surname) < 4 else 3
    halves = given.split("-")
    initials = "".join(h[0] for h in halves)
    mids = [m[0] for m in middle]
    if not words:
        return False
    first, rest = words[0], list(words[1:])
    flat = given.replace("-", "")
    got = False
    if same_word(first.replace("-", ""), flat, least) or first in _SHORT.get(flat, ()):
        got = True
    elif len(halves) > 1 and rest and same_word(first, halves[0]) and same_word(rest[0], halves[1]):
        got, rest = True, rest[1:]
    elif first.replace("-", "") == initials and len(first) >= 1:
        got = True
    elif len(halves) > 1 and len(first) == 1 and rest and first == initials[0] and rest[0] == initials[1] and len(rest[0]) == 1:
        got, rest = True, rest[1:]
    elif len(halves) > 1 and len(first) == 1 and first == initials[0]:
        got = True
    elif len(first) >= 1 and len(first) <= 4 and "-" not in first and flat.startswith(first):
        got = True
    elif "-" not in first and 2 <= len(first) <= 4 and first in (initials + "".join(mids), initials[0] + "".join(mids)) and mids:
        return not rest
    if not got:
        return False
    return not rest or all(len(r) == 1 for r in rest) and (rest == mids[: len(rest)] or not mids and len(rest) == 1)


def same_group(words: list[str], head: str, rest: list[str]) -> bool:
    """The head's word and every other word, in any order, with cut words and one error each; nothing else but filler may be left."""
    left = [x for w in words for x in w.split("-")]
    for i in range(len(rest) - 1):  # two words by their initials
        if rest[i][0] + rest[i + 1][0] in left and rest[i] not in left:
            at = left.index(rest[i][0] + rest[i + 1][0])
            left[at : at + 1] = rest[i : i + 2]
    for want in [head, *rest]:
        hit = next((i for i, w in enumerate(left) if w == want), None)
        if hit is None:
            hit = next((i for i, w in enumerate(left) if same_word(w, want) or (want != head and len(w) >= 3 and want.startswith(w))), None)
        if hit is None:
            return False
        left.pop(hit)
    return all(w in FILLER for w in left)


def means(raw: str, full: str, kind: str) -> bool:
    """Whether a typed name means a reference name. Nothing but a surname means nobody."""
    a, b = parts(raw)
    r = reference(full, kind)
    if r["group"]:
        return same_group(list(a + b), r["head"], r["rest"])
    orders = []
    strip = lambda ws: [w for w in ws if w not in PARTICLES]
    if b:
        orders.append((strip(a), strip(b)))  # surname, given
        if len(strip(a)) == 1:
            orders.append((strip(b)[-1:], strip(a) + strip(b)[:-1]))
    words = strip(a + b) if not b else []
    if len(words) >= 2:
        orders += [(words[-1:], words[:-1]), (words[:1], words[1:])]
    for sur, given in orders:
        if len(sur) == 1 and same_surname(sur[0], r["surname"]) and given_matches(given, r["given"], r["middle"], r["surname"]):
            return True
    # particles that grew onto a word, and names without any blank
    whole = "".join((*b, *a) if b else a).replace("-", "")
    p, g = "".join(r["particles"]), r["given"].replace("-", "")
    m = "".join(x[0] for x in r["middle"])
    if all(len(x) > 1 for x in a + b):  # initials are judged above, where an additional one counts against the match
        if any(len(f) >= 10 and osa(whole, f, 1) <= 1 for f in (g + p + r["surname"], g + m + p + r["surname"])):
            return True
    short = {x + p + r["surname"] for x in (g, g + m, g[:1], g[:1] + m, r["given"][:1] + "".join(h[0] for h in r["given"].split("-")[1:]))}
    return bool(p or len(a + b) == 1) and len(whole) > len(p + r["surname"]) and whole in short


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(s: pd.Series) -> pd.Series:
    return s.map(name_keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _ref_keys(full: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([reference_keys(f, k) for f, k in zip(full, kind, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def _means(raw: pd.Series, full: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([means(a, f, k) for a, f, k in zip(raw, full, kind, strict=True)], dtype=bool)


def radius_join(left: DataFrame, right: DataFrame, radius: int = RADIUS, pivots: int | None = None, ring_rows: int = RING_ROWS) -> DataFrame:
    """Pairs (key, ref_key) of distinct keys within an edit distance, by metric-space partitioning; exact.

    ``left`` has a column ``key``, ``right`` a column ``ref_key``, both distinct and not null. Every reference key lies in the cell
    of its nearest pivot. A key within the radius of it is at most 2 * radius further from that pivot than from its own nearest
    one, and its distance to the pivot differs from the reference key's by at most the radius: cell and distance are the join key.
    A cell and distance with more than ``ring_rows`` reference keys is split at random, and keys go to all its parts.
    """
    spark = left.sparkSession
    if pivots is None:
        pivots = int(min(max(right.count() ** 0.5, PIVOTS[0]), PIVOTS[1]))
    chosen = [r[0] for r in right.orderBy(F.xxhash64("ref_key"), "ref_key").limit(pivots).collect()]  # at most PIVOTS[1] rows
    if not chosen:
        return left.crossJoin(right).limit(0)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    p = F.array(*[F.lit(c) for c in chosen])
    dist = lambda k: F.transform(p, lambda x: F.levenshtein(F.col(k), x))
    # distances cost far more than the bytes of the keys suggest, so the keys are spread by number
    left, right = cut(left.repartition(n, "key")), cut(right.repartition(n, "ref_key"))
    r = right.withColumn("d", dist("ref_key")).withColumn("near", F.array_min("d"))
    r = cut(r.select("ref_key", (F.array_position("d", F.col("near")) - 1).cast("int").alias("cell"), F.col("near").cast("int").alias("ring")))
    parts = r.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / ring_rows).cast("int").alias("parts"))
    q = left.withColumn("d", dist("key")).withColumn("near", F.array_min("d"))
    q = q.select("key", "near", F.posexplode("d").alias("cell", "dp")).filter(F.col("dp") <= F.col("near") + 2 * radius)
    q = q.select("key", "cell", F.explode(F.sequence(F.greatest(F.col("dp") - radius, F.lit(0)), F.col("dp") + radius).cast("array<int>")).alias("ring"))
    # only cells and rings that hold reference keys, each part of them
    q = q.join(parts, ["cell", "ring"]).select("key", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    r = r.join(parts, ["cell", "ring"]).select("ref_key", "cell", "ring", F.pmod(F.xxhash64("ref_key"), F.col("parts")).cast("int").alias("part"))
    pairs = q.join(r, ["cell", "ring", "part"])
    return pairs.filter(F.levenshtein("key", "ref_key", radius) >= 0).select("key", "ref_key")


def link_names(typed: DataFrame, refs: DataFrame, name: str = "name", radius: int = RADIUS) -> DataFrame:
    """(name, author_id) of the distinct typed names that mean a reference row and aren't its ``full_name`` letter by letter.

    ``refs``: author_id, full_name, kind. Null and empty names, and reference rows without a name, are left out. A name that
    fits several reference rows is linked to none. Names are made distinct first, so a frequent name costs as much as a rare one.
    """
    t = typed.select(F.col(name).alias("name")).filter(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.lit(1).alias("_one")).drop("_one")
    r = refs.select("author_id", "full_name", F.coalesce("kind", F.lit("person")).alias("kind")).filter(F.trim("full_name") != "").distinct()
    rk = r.withColumn("ref_key", F.explode(_ref_keys("full_name", "kind"))).filter("ref_key <> ''")
    tk = cut(t.withColumn("key", F.explode(_keys("name"))))  # read three times
    short = F.col("key").contains(" ")  # keys of short names only meet as they are
    near = radius_join(tk.filter(~short).select("key").distinct(), rk.filter(~F.col("ref_key").contains(" ")).select("ref_key").distinct(), radius)
    near = near.unionByName(tk.filter(short).select("key", F.col("key").alias("ref_key")).distinct())
    cand = tk.join(near, "key").join(rk, "ref_key").select("name", "author_id", "full_name", "kind").distinct()
    hit = cand.filter(_means("name", "full_name", "kind"))
    one = hit.groupBy("name").agg(F.countDistinct("author_id").alias("n"), F.min("author_id").alias("author_id"), F.max(F.when(F.col("name") == F.col("full_name"), True)).alias("exact"))
    return one.filter("n = 1 and exact is null").select("name", "author_id")


def link_authors(papers: DataFrame, corpus: DataFrame, refs: DataFrame) -> DataFrame:
    """(arxiv_id, author_pos, author_id): places from 1 in ``authors`` split at ``;``, 0 for ``surname``. Repeated rows count once."""
    blank = r"(?U)^\s+|\s+$"
    a = papers.select("arxiv_id", "authors").filter("arxiv_id is not null and authors is not null").distinct()
    a = a.select("arxiv_id", F.posexplode(F.split("authors", ";")).alias("i", "n")).select("arxiv_id", (F.col("i") + 1).cast("bigint").alias("author_pos"), F.regexp_replace("n", blank, "").alias("name"))
    c = corpus.select("arxiv_id", F.lit(0).cast("bigint").alias("author_pos"), F.regexp_replace("surname", blank, "").alias("name")).filter("arxiv_id is not null and name is not null").distinct()
    every = a.unionByName(c).filter("name <> ''")
    return every.join(link_names(every, refs), "name").select("arxiv_id", "author_pos", "author_id").distinct()
