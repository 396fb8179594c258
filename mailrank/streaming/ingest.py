"""Load mail files as they arrive: the batch load as a file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailrank.operators.parse import parse_messages
from mailrank.sources.mail_csv import MAIL_CSV_OPTIONS

MAIL_CSV_SCHEMA = "file STRING, message STRING"


def stream_mail_csv(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, message)`` of the CSV files that land in ``folder``.

    A stream needs its columns named beforehand; the files' headers are checked against them.
    """
    return spark.readStream.schema(MAIL_CSV_SCHEMA).options(**MAIL_CSV_OPTIONS).csv(folder).na.fill("")


def ingest_mail_csv(
    spark: SparkSession,
    folder: str,
    emails_path: str,
    checkpoint: str,
    on_bad_date: Column | int | str | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Parse new files and append them to the emails table, each file once.

    Stops after the files that are there, or with ``continuous`` waits for more.
    ``checkpoint`` and ``emails_path`` must be folders all executors share.
    """
    emails = parse_messages(stream_mail_csv(spark, folder), on_bad_date)
    writer = emails.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start(emails_path)
