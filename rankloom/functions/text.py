"""Titles, authors, identifiers, venues and sections as Column expressions.

Null input gives the empty string unless a function says otherwise; empty and very long texts need no special case.
Python's ``strip`` removes every Unicode blank, so ``strip`` here does too.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spelled-out Greek letters.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "ς": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi",
    "ω": "omega", "Δ": "delta", "Σ": "sigma", "Ω": "omega", "Γ": "gamma", "Φ": "phi", "Ψ": "psi", "Θ": "theta",
    "Λ": "lambda", "Π": "pi", "Ξ": "xi",
}

# Lower-case venue spellings and their short names.
VENUES = {
    "iclr": "ICLR", "international conference on learning representations": "ICLR",
    "neurips": "NeurIPS", "nips": "NeurIPS", "neural information processing systems": "NeurIPS",
    "icml": "ICML", "international conference on machine learning": "ICML",
    "acl": "ACL", "association for computational linguistics": "ACL",
}

# Display names of the venue part of a file name.
VENUE_DISPLAY = {
    "arxiv": "arXiv", "sigir": "SIGIR", "kdd": "KDD", "www": "WWW", "recsys": "RecSys", "aaai": "AAAI", "cikm": "CIKM",
    "wsdm": "WSDM", "neurips": "NeurIPS", "iclr": "ICLR", "umap": "UMAP", "icml": "ICML", "acmmm": "ACM MM",
    "tors": "TORS", "tois": "TOIS", "tmlr": "TMLR", "tkde": "TKDE", "sigmod": "SIGMOD", "ijcai": "IJCAI", "acl": "ACL",
}

NEW_ID, OLD_ID = r"\d{4}\.\d{4,5}", r"[a-z\-]+(?:\.[A-Z]{2})?/\d{7}"
SECTION_HEAD = r"(?m)^##\s+§\s*\d+\s*[-–—]\s*(.+?)\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def null_if_blank(x: Column | str) -> Column:
    """Turn the sentinels ``""`` and ``"null"`` into null."""
    return F.when(strip(x).isin("", "null"), None).otherwise(_c(x))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column | str) -> Column:
    """Lower case; hyphens, underscores and slashes become blanks; runs of blanks become one."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(x)), r"[-_/]+", " "), r"(?U)\s+", " "))


def normalize_title(x: Column | str) -> Column:
    """Lower case; everything but a-z and 0-9 becomes one blank. Letters with accents are separators here."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(x)), r"[^a-z0-9]+", " "))


def strip_latex(x: Column | str) -> Column:
    """Unwrap ``\\cmd{arg}`` up to three levels deep, then drop the backslash of bare commands."""
    out = _c(x)
    for _ in range(3):
        out = F.regexp_replace(out, r"\\[a-zA-Z]+\s*\{([^{}]*)\}", "$1")
    return F.regexp_replace(out, r"\\([a-zA-Z]+)", "$1")


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    table = str.maketrans(GREEK)
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v.translate(table)) if not unicodedata.combining(c)))


def transliterate(x: Column | str) -> Column:
    """Spell out Greek, decompose, drop combining marks. Pure ASCII never leaves the JVM."""
    x = text_or_empty(x)
    plain = x.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, x).otherwise(_fold(F.when(~plain, x)))


def norm_title(x: Column | str) -> Column:
    """``normalize_title`` after transliteration and removal of LaTeX commands: letters keep, accents go."""
    return normalize_title(strip_latex(transliterate(x)))


def first_author(x: Column | str) -> Column:
    return strip(F.split_part(text_or_empty(x), F.lit(","), F.lit(1)))


def clean_author(x: Column | str) -> Column:
    """Drop the trailing four-digit homonym number."""
    return strip(F.regexp_replace(text_or_empty(x), r"\s+\d{4}$", ""))


def _last_word(x: Column, by: str = " ") -> Column:
    return F.coalesce(F.try_element_at(F.split(x, by), F.lit(-1)), F.lit(""))


def surname_of(x: Column | str) -> Column:
    """Last word of the name in title-normalised form, without a homonym number."""
    return _last_word(normalize_title(F.regexp_replace(strip(text_or_empty(x)), r"\s+\d{4}$", "")))


def first_author_surname(x: Column | str) -> Column:
    """Transliterated last word of the first author, lower case."""
    return F.lower(_last_word(strip(transliterate(first_author(x))), r"\s+"))


def surnames_match(query: Column | str, cand: Column | str) -> Column:
    """True if either is empty, they are equal, equal to the other's last word, or one holds the other."""
    q, c = normalize_title(query), normalize_title(cand)
    return (q == "") | (c == "") | (q == c) | (q == _last_word(c)) | c.contains(q) | q.contains(c)


def _name_words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[^a-z]+"), lambda w: w != "")


def same_first_author(a: Column | str, b: Column | str) -> Column:
    """Same last word, and same first word or at least the same initial."""
    wa, wb = _name_words(transliterate_plain(a)), _name_words(transliterate_plain(b))
    fa, fb = F.try_element_at(wa, F.lit(1)), F.try_element_at(wb, F.lit(1))
    return F.coalesce((F.try_element_at(wa, F.lit(-1)) == F.try_element_at(wb, F.lit(-1))) & ((fa == fb) | (F.substring(fa, 1, 1) == F.substring(fb, 1, 1))), F.lit(False))


@F.pandas_udf(T.StringType())
def _unmark(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def transliterate_plain(x: Column | str) -> Column:
    """Decompose and drop combining marks, without spelling out Greek."""
    x = text_or_empty(x)
    plain = x.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, x).otherwise(_unmark(F.when(~plain, x)))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length on normalised titles; two empty titles give 1."""
    x, y = normalize_title(a), normalize_title(b)
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / n)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(cand: pd.Series, query: pd.Series) -> pd.Series:
    """Ratio of matching blocks, the candidate first: the order of the two changes the result."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(cand, query, strict=True)], dtype="float64")


def word_jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(_c(x), " "), lambda w: w != ""))


def extract_arxiv_id(x: Column | str) -> Column:
    """First identifier after the last ``/abs/``; null if there is none."""
    return F.nullif(F.regexp_extract(F.substring_index(strip(text_or_empty(x)), "/abs/", -1), f"({NEW_ID}|{OLD_ID})", 1), F.lit(""))


def arxiv_sort_key(x: Column | str) -> Column:
    """New-style identifiers first, then by text."""
    return F.struct(F.when(_c(x).rlike(f"^{NEW_ID}"), 0).otherwise(1).alias("old"), _c(x).alias("id"))


_NEW_PARTS, _OLD_PARTS = r"^(\d{2})(\d{2})\.(\d+)$", r"^[A-Za-z\-]+(?:\.[A-Z]{2})?/(\d{2})(\d{2})(\d+)$"


def _century(yy: Column) -> Column:
    return F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy)


def chrono_key(x: Column | str) -> Column:
    """Struct (year, month, seq) of an identifier, zeros if it is none."""
    x, part = text_or_empty(x), lambda p, i: F.regexp_extract(text_or_empty(x), p, i).try_cast("bigint")
    new, old = x.rlike(_NEW_PARTS), x.rlike(_OLD_PARTS)
    pick = lambda a, b: F.when(new, a).when(old, b).otherwise(F.lit(0).cast("bigint"))
    return F.struct(
        pick(2000 + part(_NEW_PARTS, 1), _century(part(_OLD_PARTS, 1))).alias("year"),
        pick(part(_NEW_PARTS, 2), part(_OLD_PARTS, 2)).alias("month"),
        pick(part(_NEW_PARTS, 3), part(_OLD_PARTS, 3)).alias("seq"),
    )


def year_of(x: Column | str) -> Column:
    """Calendar year of an identifier as text, or ``unknown_year``."""
    x = text_or_empty(x)
    new, old = F.regexp_extract(x, r"^(\d{2})\d{2}\.", 1), F.regexp_extract(x, r"^[A-Za-z\-]+(?:\.[A-Z]{2})?/(\d{2})\d{2}\d+", 1)
    return F.when(new != "", F.concat(F.lit("20"), new)).when(old != "", _century(old.try_cast("int")).cast("string")).otherwise("unknown_year")


def subject_of(x: Column | str) -> Column:
    """First of the ``;``-separated fields as a safe folder name, ``Unknown`` if there is none."""
    first = strip(F.split_part(text_or_empty(x), F.lit(";"), F.lit(1)))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(first, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("Unknown"))


def extract_venue(comment: Column | str, journal_ref: Column | str) -> Column:
    """The journal reference wins; else a comment that speaks of acceptance; else ``"null"``."""
    j, c = text_or_empty(journal_ref), text_or_empty(comment)
    return F.when(j != "", strip(j)).when(c.rlike(r"(?i)accept|to appear|camera[\s-]?ready|proceedings"), strip(c)).otherwise("null")


def venue_pattern(aliases: list[str]) -> str:
    """Java pattern of the aliases, longest first, bounded by non-letters, any case."""
    return r"(?i)(?<![A-Za-z])(" + "|".join(re.escape(a).replace(r"\ ", " ") for a in sorted(set(aliases), key=lambda a: (-len(a), a))) + r")(?![A-Za-z])"


def canonical_venue(*texts: Column | str) -> Column:
    """``VenueYYYY`` of the first known venue with a year next to it, else the first known venue, else ``"null"``."""
    text = F.concat_ws(" ", *[F.nullif(_c(t), F.lit("")) for t in texts])
    bare, short = venue_pattern(list(VENUES)), F.create_map(*[F.lit(v) for kv in VENUES.items() for v in kv])
    # the year has to lie within the eight characters after the name
    apos, full = bare + r"(?=.{0,8})\s{0,5}'(\d{2})\b", bare + r"[\s:\-/]{0,4}((?:19|20)\d{2})\b"
    dated = bare + r"(?:\s{0,5}'\d{2}\b|[\s:\-/]{0,4}(?:19|20)\d{2}\b)"
    hit = F.regexp_substr(text, F.lit(dated))
    name = lambda x: short[F.lower(F.regexp_extract(x, bare, 1))]
    yy, yyyy = F.regexp_extract(hit, apos, 2), F.regexp_extract(hit, full, 2)
    return F.coalesce(
        F.when(hit.isNotNull(), F.concat(name(hit), F.when(yy != "", F.concat(F.lit("20"), yy)).otherwise(yyyy))),
        F.when(text.rlike(bare), name(text)),
        F.lit("null"),
    )


def to_int(x: Column | str, default: int = 0) -> Column:
    """Integer of a number (truncated) or of integer text; anything else gives the default."""
    return F.coalesce(F.when(F.typeof(_c(x)).isin("double", "float"), _c(x).try_cast("bigint")).otherwise(_c(x).cast("string").try_cast("bigint")), F.lit(default).cast("bigint"))


def index_text(title: Column | str, abstract: Column | str) -> Column:
    t, a = text_or_empty(title), text_or_empty(abstract)
    return strip(F.when(a != "", F.concat(t, F.lit("\n\n"), a)).otherwise(t))


def short_title(x: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis in place of the rest."""
    x = strip(text_or_empty(x))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def filename_meta(stem: Column | str) -> Column:
    """Struct (venue, is_preprint, pub_date, pub_year) of ``Company_venue_YYYYMMDD_Title``; blanks and false if it isn't one."""
    part = lambda i: F.regexp_extract(text_or_empty(stem), r"^([^_]+)_([^_]+)_(\d{8})_", i)
    token, d = F.lower(part(2)), part(3)
    names = F.create_map(*[F.lit(v) for kv in VENUE_DISPLAY.items() for v in kv])
    date = F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise("")
    return F.struct(F.coalesce(F.try_element_at(names, token), F.upper(part(2))).alias("venue"), (token == "arxiv").alias("is_preprint"), date.alias("pub_date"), F.substring(d, 1, 4).alias("pub_year"))


def markdown_title(content: Column | str, default: Column | str) -> Column:
    """First level-one heading, else the default."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(text_or_empty(content), r"(?m)^\s*#\s+(.*\S)\s*$", 1)), F.lit("")), _c(default))


def markdown_arxiv_url(content: Column | str, host: str = "arxiv.org") -> Column:
    return F.regexp_extract(text_or_empty(content), r"https?://" + host.replace(".", r"\.") + r"/abs/[^\s)\]]+", 0)


def normalize_section(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(F.regexp_replace(text_or_empty(x), "’", "'")), r"\.+$", ""), r"(?U)\s+", " "))


def extract_sections(content: Column | str) -> Column:
    """Array of (name, body) in order; text before the first heading belongs to none."""
    x = text_or_empty(content)
    names = F.regexp_extract_all(x, F.lit(SECTION_HEAD), 1)
    bodies = F.split(x, SECTION_HEAD, -1)
    return F.zip_with(names, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda n, b: F.struct(normalize_section(n).alias("name"), strip(b).alias("body")))


def select_sections_text(title: Column | str, content: Column | str, wanted: list[str]) -> Column:
    """Title plus the wanted non-empty sections in order; the whole body where none of them occurs."""
    keep = [w.replace("’", "'").strip().rstrip(".").lower() for w in wanted]
    picked = F.filter(extract_sections(content), lambda s: s["name"].isin(keep) & (s["body"] != ""))
    joined = strip(F.array_join(F.transform(picked, lambda s: s["body"]), "\n\n"))
    body = F.when(joined != "", joined).otherwise(strip(text_or_empty(content)))
    return strip(F.concat(text_or_empty(title), F.lit("\n\n"), body))


def python_float(x: Column | str) -> Column:
    """A double as Python prints it (shortest digits; exponents from 1e16 and below 1e-4)."""
    x = _c(x).cast("double")
    a = F.abs(x)
    # decimal text has at most 17 significant digits in this range, trailing zeros go
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    sci = x.cast("string")
    return F.when(x.isNull(), "").when((a >= 1e7) & (a < 1e16), F.regexp_replace(x.cast("decimal(38,1)").cast("string"), r"^(-?\d+)\.0*$", "$1.0")).when((a >= 1e-4) & (a < 1e-3), plain).otherwise(sci)


def item_text(title: str = "title", categories: str = "categories", description: str = "description", price: str = "price") -> Column:
    """The chosen item fields joined by blanks, empty ones left out."""
    flat = lambda c: F.nullif(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit(""))), " "), F.lit(""))
    return strip(F.concat_ws(" ", F.nullif(F.col(title), F.lit("")), flat(categories), flat(description), F.nullif(python_float(price), F.lit(""))))


def user_bin(x: Column | str, bins: int = 1_000_000) -> Column:
    """md5 as a 128-bit number modulo ``bins``, folded eight hex digits at a time so that 64 bits suffice."""
    h, acc = F.md5(_c(x).cast("string")), F.lit(0).cast("bigint")
    for i in range(4):
        acc = (acc * F.lit(2**32) + F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")) % bins
    return acc


def join_names(x: Column | str) -> Column:
    """Array of structs with a ``name`` as text joined by ``"; "``."""
    return F.array_join(F.transform(_c(x), lambda a: F.coalesce(a["name"], F.lit(""))), "; ")


def arxiv_key(x: Column | str) -> Column:
    """Identifier without its version, of which only a trailing ``vN`` is one: ``solv-int/9901001v2`` keeps its archive's name."""
    return F.regexp_replace(_c(x), r"v\d+$", "")


def query_prompt(task: Column | str, query: Column | str) -> Column:
    """What an instructed encoder is given for a query."""
    return F.concat(F.lit("Instruct: "), text_or_empty(task), F.lit("\nQuery:"), text_or_empty(query))


def pair_prompt(task: Column | str, query: Column | str, doc: Column | str) -> Column:
    """What an instructed scorer is given for a pair."""
    return F.concat(F.lit("<Instruct>: "), text_or_empty(task), F.lit("\n<Query>: "), text_or_empty(query), F.lit("\n<Document>: "), text_or_empty(doc))


def three_decimals(x: Column | str) -> Column:
    """A score as text with three decimals, rounded by its exact binary value, ties to even; null counts as zero.

    A double is split into a part of 24 bits and the exact rest, so that 2000 times each is exact and their sum has the true sign.
    """
    x = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    k, hi = F.floor(x * 1000 + 0.5), x.cast("float").cast("double")
    over = (hi * 2000 - (k * 2 - 1)) + (x - hi) * 2000
    k = F.when((over < 0) | ((over == 0) & (k % 2 != 0)), k - 1).otherwise(k)
    return F.format_string("%.3f", k / 1000.0)


def render_match(title_sim: Column | str, candidates: Column | str) -> Column:
    """Text of a match result: the title similarity, then a table row per candidate (struct of rerank, recall, arxiv_id, title, surname) in their order.

    Scores have three decimals, titles at most 70 characters.
    """
    three = three_decimals
    row = lambda c, i: F.concat_ws(" | ", F.concat(F.lit("| "), (i + 1).cast("string")), three(c["rerank"]), three(c["recall"]), F.concat(F.lit("`"), text_or_empty(c["arxiv_id"]), F.lit("`")), short_title(c["title"], 70), F.concat(text_or_empty(c["surname"]), F.lit(" |")))
    return F.concat_ws("\n", F.concat(F.lit("title_sim "), three(_c(title_sim))), F.array_join(F.transform(_c(candidates), row), "\n"))


def parse_match(x: Column | str) -> Column:
    """Struct (title_sim, rerank, arxiv_id, surname) of a rendered match result, its first candidate; zeros, null and the empty text where it has none."""
    x = text_or_empty(x)
    top = r"(?m)^\|\s*1\s*\|\s*([\d.]+)\s*\|\s*[\d.]+\s*\|\s*`([^`]+)`\s*\|[^|\n]*\|[ \t]*([^|\n]*?)[ \t]*\|"
    num = lambda p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("double"), F.lit(0.0))
    return F.struct(num(r"title_sim\s+([\d.]+)").alias("title_sim"), num(top).alias("rerank"), F.nullif(F.regexp_extract(x, top, 2), F.lit("")).alias("arxiv_id"), F.regexp_extract(x, top, 3).alias("surname"))
