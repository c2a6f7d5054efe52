"""The named queries of the training-data operators and their SQL, where SQL can state one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, d):
    from rankloom.llm import titles

    return titles.same_looking(table(spark, d, "arxiv_paper"), table(spark, d, "corpus_entry"))


@query
def p2_forms(spark, d):
    """(title, form) of every distinct title of both tables."""
    from rankloom.llm import titles

    a, b = table(spark, d, "arxiv_paper").select("title"), table(spark, d, "corpus_entry").select("title")
    return titles.repair_titles(a.unionByName(b))


@query
def p6_ids(spark, d):
    from rankloom.llm import tokens

    return tokens.encode_column(table(spark, d, "documents"))


@query
def p4_found(spark, d):
    from rankloom.llm import chunks

    return chunks.cut_sections(table(spark, d, "paper"))


@query
def p4_pieces(spark, d):
    """(paper_id, piece_no, text) of every paper longer than 3,000 code points; a repeated paper is cut once, its longest content."""
    from rankloom.llm import chunks

    p = table(spark, d, "paper").filter(F.length("content") > 3000).groupBy("paper_id").agg(F.max(F.struct(F.length("content").alias("n"), F.col("content"))).alias("m"))
    return chunks.split_texts(p.select("paper_id", F.col("m.content").alias("content")), ["paper_id"], "content").select("paper_id", "piece_no", "text")


@query
def p8_found(spark, d):
    from rankloom.llm import spam

    return spam.find_spam(table(spark, d, "documents")).select("doc_id")


@query
def p5_found(spark, d):
    from rankloom.llm import names

    return names.link_authors(table(spark, d, "arxiv_paper"), table(spark, d, "corpus_entry"), table(spark, d, "author_ref"))


@query
def p7_found(spark, d):
    from rankloom.llm import leaks

    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def _works(spark, d):
    from rankloom.llm import works

    return works.match_works(table(spark, d, "accepted_paper"), table(spark, d, "corpus_entry"), table(spark, d, "match_result"))


@query
def p1_found(spark, d):
    return _works(spark, d).filter("confidence > 0.5").select("paper_key", "arxiv_id")


@query
def p1_confidence(spark, d):
    """Every candidate pair with its posterior."""
    return _works(spark, d).select("paper_key", "arxiv_id", F.round("confidence", 6).alias("confidence"))


@query
def p3_groups(spark, d):
    """(parent_asin, group_id) of every listing."""
    from rankloom.llm import listings

    return listings.group_listings(table(spark, d, "item_meta"))


@query
def p3_found(spark, d):
    from rankloom.llm import listings

    return listings.same_pairs(listings.group_listings(table(spark, d, "item_meta")))
