"""The query batch: ``(qid, query_text, target, max_results)``, one row per search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrank.functions.text import blank, exact_key, fill_blank, phone_digits, placeholder, word_tokens

# Fixed values.
DEFAULT_MAX_RESULTS = 100


def normalise_queries(queries: DataFrame) -> DataFrame:
    """``-`` means empty, and a result count of 0 or less means the default."""
    return queries.select(
        F.col("qid").cast("bigint").alias("qid"),
        fill_blank(placeholder(F.col("query_text"))).alias("query_text"),
        fill_blank(placeholder(F.col("target"))).alias("target"),
        F.when(F.col("max_results") > 0, F.col("max_results"))
        .otherwise(F.lit(DEFAULT_MAX_RESULTS))
        .cast("int")
        .alias("max_results"),
    )


def target_terms(queries: DataFrame, mode: str = "words") -> DataFrame:
    """``(qid, field, term, n)``: what a query's target looks for in each field.

    A blank target looks for nothing. ``mode`` ``"raw"`` takes the lower-cased target as
    one body term instead of its words. ``n`` counts a word that is written repeatedly.
    """
    target = F.col("target")
    body = F.array(F.lower(target)) if mode == "raw" else word_tokens(target)
    wanted = F.concat(
        F.array(F.struct(F.lit("sender_email").alias("field"), exact_key(target).alias("term"))),
        F.array(F.struct(F.lit("phone_num").alias("field"), phone_digits(target).alias("term"))),
        F.transform(body, lambda t: F.struct(F.lit("body_text").alias("field"), t.alias("term"))),
    )
    terms = queries.where(~blank(target)).select("qid", F.inline(wanted)).where("term != ''")
    return terms.groupBy("qid", "field", "term").agg(F.count(F.lit(1)).alias("n"))
