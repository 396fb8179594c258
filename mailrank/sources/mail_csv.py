"""Read mail CSV files: a header row, then quoted, multi-line ``file,message`` records."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Without enforceSchema=False a file whose header has another order is read under the first file's names.
MAIL_CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
# The CSV writer trims values unless told otherwise.
MAIL_CSV_WRITE_OPTIONS = {
    "header": True,
    "quoteAll": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_mail_csv(
    spark: SparkSession, path: str | list[str], partitions: int | None = None, split: bool | None = None
) -> DataFrame:
    """Scan ``path`` (a file or a folder of files, or a list of those) into ``(file, message)``.

    ``split`` reads a file by as many tasks as it has blocks (:func:`split_mail_csv`); left open,
    it is chosen where a file is larger than a task's share of a scan, and otherwise each file is
    one task. ``partitions`` spreads the rows over that many tasks before any parsing.
    The two columns are found by name, whatever else the files hold; empty values are ``''``.
    Files of one path share one header, and the read fails where they do not; each path of a
    list has its own.
    """
    paths = [path] if isinstance(path, str) else path
    found = []
    for p in paths:
        if split or (split is None and _has_large_file(spark, p)):
            found.append(split_mail_csv(spark, p))
        else:
            found.append(spark.read.options(**MAIL_CSV_OPTIONS).csv(p).select("file", "message"))
    raw = reduce(DataFrame.unionByName, found)
    return (raw.repartition(partitions) if partitions else raw).na.fill("")


def _has_large_file(spark: SparkSession, path: str) -> bool:
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    share = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return largest > share


def split_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(file, message)`` of CSV files whose blocks are read by tasks of their own.

    A block is what a scan of lines gives to a task. The first pass counts the quotes of every
    block; as a quote inside a value is written twice, an odd number of quotes before a block means
    that it starts inside a quoted value. With that known, each task cuts its lines where a line
    ends outside of quotes, which is where a record ends, and parses the whole records; the
    pieces of records that cross blocks, at most two a block, are put together by file and place.

    Quotes may stand only around values and, doubled, inside quoted ones; the header is one line.
    The driver holds nine bytes for each block, and sends them. The scan must find the blocks that
    were counted, so the session's scan sizes must stay until the rows are read; else the read fails.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length")
    )
    block = ["path", "start", "length"]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # The lines of a block come in order to one task, so its first line is the first of the group.
    head = F.first(F.when(F.col("start") == 0, F.col("value")), ignorenulls=True)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*block).agg(F.sum(quotes).alias("quotes"), head.alias("head"))
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    held = blocks.select(F.xxhash64(*block).alias("key"), inside.alias("inside"), "head").toArrow()
    heads = {h.removeprefix("\ufeff").rstrip("\r") for h in pc.unique(held["head"]).to_pylist() if h is not None}
    if not heads:
        return spark.createDataFrame([], "file string, message string")
    names = [next(csv.reader([h])) for h in heads]
    if len(names) > 1 or any(h.count('"') % 2 for h in heads):
        raise ValueError(f"files of one path need one header of one line: {sorted(heads)}")
    if not {"file", "message"} <= set(names[0]):
        raise ValueError(f"the header lacks file or message: {names[0]}")
    places = [names[0].index(c) for c in ("file", "message")]
    order = np.argsort(held["key"].to_numpy())
    keys, starts_inside = held["key"].to_numpy()[order], held["inside"].to_numpy(zero_copy_only=False)[order]
    if len(np.unique(keys)) != len(keys):
        raise RuntimeError("two blocks have one key")
    sent = spark.sparkContext.broadcast((keys, starts_inside))

    def texts(column: pa.Array) -> list[str]:
        try:
            return column.cast(pa.string()).to_pylist()
        except pa.ArrowInvalid:
            return [x.decode(errors="replace") for x in column.to_pylist()]

    def parsed(records: list[str]) -> pa.RecordBatch:
        csv.field_size_limit(2**31 - 1)
        rows = [r for r in csv.reader(f"{x}\n" for x in records) if r]
        columns = [pa.array([r[i] if i < len(r) else "" for r in rows], pa.string()) for i in places]
        return pa.record_batch(columns, names=["file", "message"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, pa.Array]]:
        """Runs of lines ``(part, path, start, lines)``: whole records (0), the end of a record that an
        earlier block started (1), and the start of one that a later block ends (2)."""
        now, odd, closed, rest, place = None, False, False, [], None

        def last() -> Iterator[tuple[int, str, int, pa.Array]]:
            if rest:
                yield 2 if closed else 1, *place, pa.concat_arrays(rest)

        for batch in batches:
            key = batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                if a == b:
                    continue
                run = batch.slice(a, b - a)
                held = run.column(0)
                if key[a] != now:
                    yield from last()
                    now, rest, place = key[a], [], (run.column(2)[0].as_py(), run.column(3)[0].as_py())
                    keys, starts_inside = sent.value
                    at = int(np.searchsorted(keys, now))
                    if at == len(keys) or keys[at] != now:
                        raise RuntimeError("the scan has other blocks than were counted: its sizes changed")
                    odd = bool(starts_inside[at])
                    closed = not odd
                    if place[1] == 0:
                        held = held.slice(1)
                flips = np.cumsum(pc.count_substring(held, '"').to_numpy(zero_copy_only=False)) + odd
                ends = np.flatnonzero(flips % 2 == 0)
                if not len(ends):
                    rest.append(held)
                else:
                    first = 0
                    if not closed:
                        first = int(ends[0]) + 1
                        yield 1, *place, pa.concat_arrays([*rest, held.slice(0, first)])
                        rest, closed = [], True
                    stop = int(ends[-1]) + 1
                    whole = [*rest, held.slice(first, stop - first)]
                    if sum(map(len, whole)):
                        yield 0, *place, pa.concat_arrays(whole)
                    rest = [held.slice(stop)] if stop < len(held) else []
                odd = bool(flips[-1] % 2) if len(flips) else odd
        yield from last()

    def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, held in cut(batches):
            if part == 0:
                yield parsed(texts(held))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, path, start, held in cut(batches):
            if part and len(held):
                yield pa.record_batch(
                    [pa.array([path]), pa.array([start]), pa.array([part], pa.int32()), pa.array(["\n".join(texts(held))])],
                    names=["path", "start", "part", "text"],
                )

    def joined_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parsed(batch.column(0).to_pylist())

    rows = lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64(*block).alias("key"), "path", "start")
    crossing = rows.mapInArrow(pieces, "path string, start bigint, part int, text string")
    so_far = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("part") == 2, F.col("start")), ignorenulls=True).over(so_far)
    crossing = crossing.withColumn("owner", owner).groupBy("path", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("pieces")
    )
    crossing = crossing.select(F.array_join(F.col("pieces.text"), "\n").alias("record"))
    schema = "file string, message string"
    return rows.mapInArrow(whole_records, schema).unionByName(crossing.mapInArrow(joined_records, schema))


def write_mail_csv(raw: DataFrame, path: str) -> None:
    raw.select("file", "message").write.options(**MAIL_CSV_WRITE_OPTIONS).csv(path)
