"""Schemas of the records that the readers produce."""

from pyspark.sql import types as T


#: Times in JSON lines.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


INTERACTION = T.StructType([*_s("user_id", "parent_asin"), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
SEQUENCE = T.StructType([*INTERACTION.fields, T.StructField("history", T.ArrayType(T.StringType()))])
IMAGE = T.StructType(_s("thumb", "large", "hi_res", "variant"))
ITEM_META = T.StructType([
    *_s("parent_asin", "title", "main_category", "store"),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("price", T.DoubleType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("rating_number", T.LongType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("images", T.ArrayType(IMAGE)),
    *_s("details"),
])
ARXIV_RECORD = T.StructType(_s("paper_key", "title", "authors", "first_author", "url", "pdf_url", "publish_date", "abstract", "primary_category", "venue", "venue_short", "comment", "journal_ref"))
ACCEPTED_PAPER = T.StructType(_s("title", "authors", "abstract", "venue", "venue_short", "decision", "pages", "dblp_url", "doi", "ee", "openreview_url", "anthology_url", "arxiv_id", "arxiv_url"))
TITLE_INDEX = T.StructType(_s("arxiv_id", "title", "first_author"))
PAPER_RECORD = T.StructType([
    *_s("arxiv_id"), T.StructField("corpusId", T.LongType()), *_s("title", "authors"), T.StructField("year", T.IntegerType()), *_s("publicationDate"),
    T.StructField("citationCount", T.IntegerType()), T.StructField("influentialCitationCount", T.IntegerType()), *_s("fieldsOfStudy", "abstract", "fetched_at"), T.StructField("found", T.BooleanType()),
])
