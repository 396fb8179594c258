"""Ranked document ids to hits, and hits to a printable report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.functions.text import SNIPPET_CHARS, flag_from_text, hit_snippet, safe_millis
from mailrank.session import fetch, settle

NO_RESULTS = "No results found."
DAY_MILLIS = 86_400_000
DATED_MILLIS = 8_000_000_000_000_000  # a timestamp reaches a little further


def hydrate(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Add stored fields; a ranked id without a stored document is skipped.

    A bounded ranking is settled first, so that its ids become a filter of the scan.
    """
    return fetch(docs, settle(ranked))


def project_hits(hydrated: DataFrame, on_bad_millis: Column | int | None = None, n: int = SNIPPET_CHARS) -> DataFrame:
    """Hydrated rows to the hit schema, stored text decoded."""
    return hydrated.select(
        "qid",
        "rank",
        "doc_id",
        "message_id",
        "from_email",
        "from_name",
        "all_recipients",
        "subject",
        hit_snippet(F.col("body_content"), n).alias("body_snippet"),
        "body_content",
        safe_millis(F.col("timestamp_ms").cast("string"), on_bad_millis).alias("timestamp_ms"),
        flag_from_text(F.col("has_attachments").cast("string")).alias("has_attachments"),
        "labels",
        F.round("rrf_score", 6).alias("rrf_score"),
        "semantic_rank",
        "keyword_rank",
    )


def hit_date(millis: Column) -> Column:
    """``Mon May 14 23:39:00 UTC 2001``, in the Gregorian calendar carried back.

    Milliseconds beyond ``DATED_MILLIS`` either way are printed as the number they are.
    """
    # A timestamp without zone prints the same in every session time zone.
    in_day = F.pmod(millis, F.lit(DAY_MILLIS))
    day = F.timestamp_add("DAY", ((millis - in_day) / DAY_MILLIS).cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))
    at = F.timestamp_add("SECOND", F.floor(in_day / 1000).cast("int"), day)
    date = F.concat(F.date_format(at, "EEE MMM dd HH:mm:ss"), F.lit(" UTC "), F.date_format(at, "yyyy"))
    return F.when(millis.between(-DATED_MILLIS, DATED_MILLIS), date).otherwise(millis.cast("string"))


def format_hits(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``(qid, rank, block)``: one text block per hit.

    With ``queries`` given, a query without hits gets one line that says so, at rank 0.
    """
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Result #"), F.col("rank").cast("string")),
        F.lit("-" * 40),
        F.concat(F.lit("From: "), "from_name", F.lit(" <"), "from_email", F.lit(">")),
        F.concat(F.lit("To: "), "all_recipients"),
        F.concat(F.lit("Subject: "), "subject"),
        F.concat(F.lit("Date: "), hit_date(F.col("timestamp_ms"))),
        F.concat(F.lit("Has attachments: "), F.col("has_attachments").cast("string")),
        F.concat(F.lit("Labels: "), "labels"),
        F.lit(""),
        F.lit("Snippet:"),
        F.col("body_snippet"),
    )
    blocks = hits.select("qid", "rank", lines.alias("block"))
    if queries is None:
        return blocks
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"))
    silent = asked.join(blocks.select("qid").distinct(), "qid", "left_anti")
    return blocks.unionByName(silent.select("qid", F.lit(0).alias("rank"), F.lit(NO_RESULTS).alias("block")))
