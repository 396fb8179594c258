"""Shards of nearly equal bytes by best-fit-decreasing bin packing.

Rows of equal texts are one group that is never split. Groups are taken from the largest to the
smallest, and each enters the bin with the tightest remaining capacity that holds it, found in a
balanced tree of remaining capacities. The capacity is the same for all bins: the mean load,
raised by a little until all groups fit into the asked number of bins; a group that alone is over
the mean of what is left has a bin of its own.

Best fit is one sequence of decisions, but groups of equal size are alike, so it is taken over the
histogram of group sizes: the groups of one size that enter one bin are one step. Sizes from
``2 ** EXACT_BITS`` bytes up are rounded up to ``EXACT_BITS`` binary digits (less than 16 in a
million), so the histogram has at most ``2 ** EXACT_BITS`` rows and half as many for every further
binary digit of the largest group, whatever the number of documents. That histogram is all that
reaches the driver. Groups are numbered in its order by a range shuffle, and a step covers a run of
numbers, so each group finds its bin by one search.

Nulls and ties: a null text has no bytes and is in one group with empty texts. Null ids are smaller
than others; repeated rows have places of their own. Groups of one size are ordered by the hash of
their text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, table, written
from mailrank.sources.emails import with_row_id

SHARDS = 24
ROW_BYTES = 8  # what a row takes besides its text
EXACT_BITS = 17
HOT_SHARE = 1_000  # a group with this part of all rows or more is joined by broadcast; there are at most as many
FIRST_SLACK = 2.0**-16  # of the mean load, four times as much in each further try


class Tree:
    """An ordered set in an AA tree: levels keep it balanced."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            up = t[2]
            t[2], up[3] = up[3], t
            return up
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            up = t[3]
            t[3], up[2] = up[2], t
            up[1] += 1
            return up
        return t

    def _add(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def _drop(self, t, key):
        if t is None:
            return None
        if key != t[0]:
            side = 2 if key < t[0] else 3
            t[side] = self._drop(t[side], key)
        elif t[2] is None and t[3] is None:
            return None
        else:
            # The neighbour in order takes the place of the key.
            side, back = (3, 2) if t[2] is None else (2, 3)
            near = t[side]
            while near[back]:
                near = near[back]
            t[0] = near[0]
            t[side] = self._drop(t[side], near[0])
        level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if level < t[1]:
            t[1] = level
            if t[3]:
                t[3][1] = min(t[3][1], level)
        t = self._skew(t)
        t[3] = self._skew(t[3])
        if t[3]:
            t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        t[3] = self._split(t[3])
        return t

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def drop(self, key) -> None:
        self.root = self._drop(self.root, key)

    def at_least(self, key):
        """The smallest key that is not below ``key``, or None."""
        found, t = None, self.root
        while t:
            if t[0] < key:
                t = t[3]
            else:
                found, t = t[0], t[2]
        return found


def best_fit(sizes: list[int], counts: list[int], bins: list[int], capacity: int) -> list[tuple[int, int]] | None:
    """Steps ``(groups, bin)`` in the order of ``sizes`` (descending), or None if not all groups fit."""
    tree = Tree()
    for b in bins:
        tree.add((capacity, b))
    steps = []
    for size, count in zip(sizes, counts):
        while count:
            found = tree.at_least((size, -1))
            if found is None:
                return None
            left, b = found
            n = min(count, left // size)
            tree.drop(found)
            tree.add((left - n * size, b))
            steps.append((n, b))
            count -= n
    return steps


def packed(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int]]:
    """Steps ``(groups, bin)`` for a histogram of positive group sizes, from the largest size down."""
    sizes, counts = list(sizes), list(counts)
    steps, bins = [], list(range(shards))
    total = sum(s * n for s, n in zip(sizes, counts))
    at = 0
    while len(bins) > 1 and at < len(sizes) and sizes[at] * len(bins) > total:
        steps.append((1, bins.pop(0)))
        total -= sizes[at]
        counts[at] -= 1
        at += counts[at] == 0
    mean, slack = -(-total // len(bins)), 0.0
    while True:
        rest = best_fit(sizes[at:], counts[at:], bins, mean + int(mean * slack))
        if rest is not None:
            return steps + rest
        slack = slack * 4 if slack else FIRST_SLACK


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, size, text_crc32`` of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text, 256)).alias("text_key"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def in_bins(groups: DataFrame, shards: int) -> DataFrame:
    """``text_key, n, shard`` for ``groups`` (``text_key, n, bytes``, a written table)."""
    spark = groups.sparkSession
    shift = F.greatest(F.length(F.bin("bytes")) - EXACT_BITS, F.lit(0))
    up = F.col("bytes") + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1
    ceiling = F.call_function("shiftleft", F.call_function("shiftright", up, shift), shift)
    groups = groups.select("text_key", "n", (-ceiling).alias("order"))
    # Bounded by the digits that sizes keep.
    held = groups.groupBy("order").agg(F.count(F.lit(1)).alias("n")).orderBy("order").toArrow()
    steps = packed([-x for x in held["order"].to_pylist()], held["n"].to_pylist(), shards) if held.num_rows else []
    ends = np.cumsum([n for n, _ in steps], dtype=np.int64)
    plan = spark.sparkContext.broadcast((ends, np.array([b for _, b in steps], np.int32)))
    numbered = with_row_id(groups, ["order", "text_key"], "place", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, bins = plan.value
        for batch in batches:
            if batch.num_rows:
                shard = bins[np.searchsorted(ends, batch.column(2).to_numpy(), side="right")]
                yield pa.record_batch([*batch.columns[:2], pa.array(shard)], names=["text_key", "n", "shard"])

    return in_arrow(numbered.select("text_key", "n", "place"), run, "text_key binary, n bigint, shard int")


def in_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, text_key, size, text_crc32, shard, slot``: slots count from 0 in each shard, in the order of ids."""
    rows = written(sized(docs), "sized")
    groups = rows.groupBy("text_key", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("text_key", "n", (F.col("n") * F.col("size")).alias("bytes")), "text-groups")
    bins = written(in_bins(groups, shards), "bins")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_SHARE >= total
    # At most HOT_SHARE rows.
    known = rows.join(F.broadcast(bins.where(hot & (F.col("n") > 1)).select("text_key", "shard")), "text_key", "left")
    rest = bins.where(~hot | (F.col("n") == 1)).select("text_key", "shard")
    dealt = known.where("shard is not null").unionByName(known.where("shard is null").drop("shard").join(rest, "text_key"))
    placed = with_row_id(dealt, ["shard", "doc_id", "text_key"], "place", 0)
    # As many rows as shards.
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return placed.join(first, "shard").withColumn("slot", F.col("place") - F.col("first")).drop("place", "first")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """``docs`` below ``folder``, one ``shard=N`` folder a shard; each of its files holds a run of slots.

    Rows carry ``slot``. A column of ``docs`` named ``shard`` or ``slot`` is replaced.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*kept, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key"))
    # Repeated rows take their places in any order; every row takes one.
    order = [F.col("doc_id"), F.col("_key"), F.xxhash64(*kept)]
    spark = docs.sparkSession
    numbered = with_row_id(keyed.withColumn("_order", order[2]), ["doc_id", "_key", "_order"], "_at", 0)
    places = with_row_id(in_shards(docs, shards).select("doc_id", "text_key", "shard", "slot"), ["doc_id", "text_key", "slot"], "_at", 0)
    out = numbered.drop("_key", "_order").join(places.select("_at", "shard", "slot"), "_at").drop("_at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
