"""The emails table: append, scan, surrogate ids, row cap, count and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.functions.text import flag_to_int
from mailrank.session import fresh_path

# The columns of the table, in order.
EMAIL_COLUMNS = (
    "message_id",
    "from_email",
    "from_name",
    "all_recipients",
    "subject",
    "body_content",
    "timestamp_ms",
    "has_attachments",
    "labels",
)
ROW_CAP = 10_000


def write_emails(emails: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows; the table is created on first use, and a re-run appends again."""
    emails.write.mode(mode).parquet(path)


def read_emails(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    """The named columns of the table (and ``id`` where it was written)."""
    return spark.read.parquet(path).select(*(["id"] if with_id else []), *EMAIL_COLUMNS)


def with_row_id(df: DataFrame, order_by: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the order of ``order_by``, without one big window.

    Rows are range-partitioned and sorted; each partition is numbered from the row
    counts of the partitions before it, of which there is one small row each. A hash of
    the row and its place in the input end the sort key, so that neither equal keys nor
    copies of one row have to share a partition. The sorted rows are written to the
    shared folder with their partition and place: a task that is run again must not
    see other range bounds than the counts did.
    """
    spark = df.sparkSession
    keys = [*map(F.col, order_by), F.col("_tie"), F.col("_came")]
    tie, came = F.xxhash64(*[F.col(c) for c in df.columns]), F.monotonically_increasing_id()
    ranged = df.withColumns({"_tie": tie, "_came": came}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = fresh_path(spark, "row-ids")
    # Low 33 bits of the generated id are the row's place in its partition.
    ranged.select(
        *df.columns,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    ).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # As many offsets as there are partitions.
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_before") + F.col("_place") + start).alias(name), *df.columns
    )


def cap_rows(df: DataFrame, n: int = ROW_CAP, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, for a quick run. Nothing else in the package caps its input."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def sample_rows(df: DataFrame, n: int = 3, order_by: str = "id") -> DataFrame:
    """A few rows with the length of their body."""
    return (
        df.select(
            order_by, "message_id", "from_email", "subject", F.length("body_content").alias("body_length")
        )
        .orderBy(order_by)
        .limit(n)
    )


def flags_as_int(emails: DataFrame) -> DataFrame:
    """The attachment flag as 0/1, the form the stored fields keep it in."""
    return emails.withColumn("has_attachments", flag_to_int(F.col("has_attachments")))
