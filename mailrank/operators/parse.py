"""Raw messages to typed rows: a shuffle-free job of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.functions import mail


def split_headers_body(raw: DataFrame) -> DataFrame:
    """Each message's header block and its stripped body."""
    message = F.col("message")
    return raw.select(
        "file",
        mail.header_block(message).alias("header_text"),
        mail.body_text(message).alias("body"),
    )


def parse_headers(raw: DataFrame) -> DataFrame:
    """Each message's headers in order, duplicates kept."""
    block = mail.header_block(F.col("message"))
    return raw.select("file", mail.header_entries(mail.unfold_headers(block)).alias("headers"))


def headers_long(raw: DataFrame) -> DataFrame:
    """One row per header: ``(file, pos, k, v)``, ``pos`` counted from 1."""
    each = parse_headers(raw).select("file", F.posexplode_outer("headers").alias("at", "h"))
    return each.where(F.col("at").isNotNull()).select(
        "file", (F.col("at") + 1).alias("pos"), F.col("h.k").alias("k"), F.col("h.v").alias("v")
    )


def parse_messages(
    raw: DataFrame,
    on_bad_date: Column | int | str | None = None,
    strict_weekday: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(file, message)`` to the emails table.

    Of a repeated header the last one counts; missing headers are ``''``. An empty
    message keeps its label, has blank fields and the time 0. A date that cannot be
    read becomes ``on_bad_date`` (null, ``"now"`` or a value). ``keep`` names columns of
    ``raw`` to carry along.
    """
    message = F.coalesce("message", F.lit(""))
    split = raw.select(
        *keep,
        F.col("file").alias("labels"),
        (message == "").alias("_empty"),
        mail.header_entries(mail.unfold_headers(mail.header_block(message))).alias("_h"),
        mail.body_text(message).alias("body_content"),
    )

    def value(key, default=""):
        return mail.header_value(F.col("_h"), key, default)

    sent = mail.parse_mail_date(F.col("_date"), on_bad_date, strict_weekday)
    fields = split.select(
        *keep,
        value("message-id").alias("message_id"),
        value("from").alias("from_email"),
        mail.sender_name(value("x-from")).alias("from_name"),
        value("to").alias("_to"),
        value("cc").alias("_cc"),
        value("bcc").alias("_bcc"),
        value("subject").alias("subject"),
        "body_content",
        value("date", None).alias("_date"),
        mail.has_attachments(value("content-type")).alias("has_attachments"),
        "labels",
        "_empty",
    )
    return fields.select(
        *keep,
        "message_id",
        "from_email",
        "from_name",
        mail.all_recipients(F.col("_to"), F.col("_cc"), F.col("_bcc")).alias("all_recipients"),
        "subject",
        "body_content",
        F.when(F.col("_empty"), F.lit(0).cast("bigint")).otherwise(sent).alias("timestamp_ms"),
        "has_attachments",
        "labels",
    )
