"""Problem 2: titles that look the same in different characters.

``repair_titles`` brings text to its visible form and replaces look-alike letters, but only in tokens that mix scripts (with a token
whose every letter is a look-alike in a title of another script counted among them), and only where the result occurs in the
vocabulary of the whole corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import chars as C
from rankloom.session import cut

PAIRS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))]))


@F.pandas_udf(T.StringType())
def _visible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else C.visible(v))


@F.pandas_udf(PAIRS)
def _mixed(s: pd.Series) -> pd.Series:
    return s.map(lambda v: [] if v is None else [{"token": t, "forms": f} for t, f in C.mixed_tokens(v)])


@F.pandas_udf(T.StringType())
def _replace(t: pd.Series, pairs: pd.Series) -> pd.Series:
    return pd.Series([v if p is None or len(p) == 0 else C.replace_tokens(v, {x["token"]: x["form"] for x in p}) for v, p in zip(t, pairs, strict=True)], dtype=object)


_PLAIN = r"^[\x20-\x7E]*$"
_TOKENS = r"(\p{L}[\p{L}\p{M}]*)"


def repair_titles(titles: DataFrame, col: str = "title", out: str = "form") -> DataFrame:
    """Distinct (title, form) of a column of titles. Nulls are left out, empty titles stay empty.

    The vocabulary is all tokens of all titles, regardless of case. Only those that a repair asks for leave the tasks that read them.
    """
    t = titles.select(F.col(col).alias("title")).filter(F.col("title").isNotNull()).groupBy("title").agg(F.lit(1).alias("_one")).drop("_one")
    plain = F.col("title").rlike(_PLAIN)
    squeezed = F.trim(F.regexp_replace("title", " +", " "))
    t = cut(t.withColumn("vis", F.when(plain, squeezed).otherwise(_visible(F.when(~plain, F.col("title"))))))  # read four times
    odd = t.filter(F.col("vis").rlike(C.BLOCKS)).withColumn("mixed", _mixed("vis"))
    bad = cut(odd.select("title", F.explode("mixed").alias("m")).select("title", F.col("m.token").alias("token"), F.posexplode("m.forms").alias("at", "f")))
    asked = bad.select("token", "at", "f").distinct().withColumn("key", F.lower("f"))
    words = t.select(F.explode(F.regexp_extract_all("vis", F.lit(_TOKENS), 1)).alias("w")).select(F.lower("w").alias("key"))
    known = words.join(asked.select("key").distinct(), "key", "left_semi").distinct()
    good = asked.join(known, "key", "left_semi").groupBy("token").agg(F.min(F.struct("at", "f")).alias("b")).select("token", F.col("b.f").alias("form"))
    fixes = bad.select("title", "token").distinct().join(good, "token").groupBy("title").agg(F.collect_list(F.struct("token", "form")).alias("fixes"))
    return t.join(fixes, "title", "left").select("title", F.when(F.col("fixes").isNull(), F.col("vis")).otherwise(_replace("vis", "fixes")).alias(out))


def same_looking(left: DataFrame, right: DataFrame, key: str = "arxiv_id", title: str = "title") -> DataFrame:
    """Keys of both tables whose titles differ as strings but have one form. Repeated rows count once, null titles never match."""
    a, b = left.select(key, title).distinct().filter(F.col(title).isNotNull()), right.select(key, title).distinct().filter(F.col(title).isNotNull())
    forms = repair_titles(a.select(title).unionByName(b.select(title)), title)
    pairs = a.select(key, F.col(title).alias("t1")).join(b.select(key, F.col(title).alias("t2")), key).filter("t1 <> t2")
    # pairs come first: most titles are equal, so few rows meet the forms
    f1, f2 = forms.select(F.col("title").alias("t1"), F.col("form").alias("f1")), forms.select(F.col("title").alias("t2"), F.col("form").alias("f2"))
    return pairs.join(f1, "t1").join(f2, "t2").filter("f1 = f2 and f1 <> ''").select(key).distinct()
