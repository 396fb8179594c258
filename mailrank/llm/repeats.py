"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards.

Every string of ``LENGTH`` bytes holds a chosen anchor: the 48-byte gram of the smallest hash
among its 53 grams. Equal strings choose equal anchors, so a string that repeats lies around an
anchor whose hash repeats, and only those surroundings (at most 152 bytes) go on. Surroundings
that are equal as a whole are settled by sums alone: all but the first are removed. Different
surroundings of one anchor are a unit; units are packed into shards, each shard's suffix array
is built by induced sorting, its common prefixes are computed in text order, and of each run of
suffixes that share ``LENGTH`` bytes all but the first in the corpus are marked. A unit too
large for a shard is dealt to chunks first, which leave only the strings they have first; if
that is still too much, it is split by the bytes left and right of its gram (each string that
holds the gram holds one of the two extensions), until it fits or the gram has the full length,
where all strings of a unit are equal. Whole copies of texts are taken out before all that.

Order: by ``doc_id``, then by the place of the row in the input; null ids are smallest, and null
texts empty. Repeated rows are copies of the first. Texts shorter than ``LENGTH`` lose nothing.
An empty table gives no rows. Columns that start with an underscore are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import carrying, dropped, in_arrow, parts, ranges, slices, strings, table, utf8, written
from mailrank.llm.suffixes import repeated_windows

LENGTH = 100
GRAM = 48
GRAMS = LENGTH - GRAM + 1  # in one string
UNIT_ROWS = 2_048  # surroundings that one shard may hold of one unit
SHARD_BYTES = 512 * 1024
_NEVER = np.uint64(2**64 - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each ``GRAM`` bytes from each place on, put together from halves; the last places have none."""

    def join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        x = a * _C[k % 4] + b
        x ^= x >> np.uint64(29)
        return x

    h = np.arange(256, dtype=np.uint64) * _C[0] + _C[1]
    h = ((h ^ (h >> np.uint64(31))) * _C[2])[data]
    half = None
    for k, width in enumerate((1, 2, 4, 8, 16)):
        h = join(h[:-width], h[width:], k)
        if width == 8:
            half = h
    out = join(h[: len(h) - 16], half[32:], 1) * _C[3]
    return out ^ (out >> np.uint64(32))


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours."""
    held, have = x, 1
    while have * 2 <= width:
        held = pick(held[:-have], held[have:])
        have *= 2
    rest = width - have
    return pick(held[: len(held) - rest], held[rest:]) if rest else held


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, hash, gram place, start, size and hash of the surroundings of each anchor.

    Places are bytes in the row. Of anchors of one hash close together, as in runs of one
    letter, only the outer ones of each half window stay, which is enough for every string.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    if n < LENGTH:
        return none
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    g = gram_hashes(data)
    place = np.arange(len(g))
    h = np.where(place + GRAM <= off[row[: len(g)] + 1], g, _NEVER)
    low = sliding(h, GRAMS, np.minimum)
    inside = np.arange(len(low)) + LENGTH <= off[row[: len(low)] + 1]
    low = np.where(inside, low, np.uint64(0))
    pad = np.zeros(GRAMS - 1, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), GRAMS, np.maximum)
    at = np.flatnonzero((high == h) & (h != _NEVER) & (h != 0))
    if not len(at):
        return none
    own, r = h[at], row[at]
    new_run = np.concatenate([[True], (own[1:] != own[:-1]) | (r[1:] != r[:-1]) | (np.diff(at) > GRAMS)])
    run_start = np.maximum.accumulate(np.where(new_run, at, 0))
    block = (at - run_start) // (GRAMS // 2)
    edge = new_run | np.concatenate([[True], np.diff(block) != 0])
    edge |= np.append(edge[1:], True)
    at, own, r = at[edge], own[edge], r[edge]
    start = np.maximum(at - (GRAMS - 1), off[r])
    size = np.minimum(at + LENGTH, off[r + 1]) - start
    m = size.astype(np.uint64)
    for k, gap in enumerate((0, GRAM, 2 * GRAM, LENGTH * 2)):
        m = (m ^ g[start + np.minimum(gap, size - GRAM)]) * _C[k]
        m ^= m >> np.uint64(31)
    return r, own, at - off[r], start - off[r], size, m


def _anchor_hashes(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                h = anchors(*utf8(batch.column(0)))[1]
                yield pa.record_batch([pa.array(np.ascontiguousarray(h).view(np.int64))], names=["h"])

    return in_arrow(reps.select("text"), run, "h bigint")


def _anchor_rows(reps: DataFrame) -> DataFrame:
    schema = "h bigint, m bigint, _d bigint, _rid bigint, start int, size int, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                r, h, place, start, size, m = anchors(*utf8(batch.column(2)))
                if len(r):
                    take = pa.array(r)
                    small = [pa.array(x.astype(np.int32)) for x in (start, size, place - start)]
                    numbers = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (h, m)]
                    columns = [*numbers, batch.column(0).take(take), batch.column(1).take(take), *small]
                    yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    return in_arrow(reps.select("_d", "_rid", "text"), run, schema)


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of listed surroundings: from ``_d, _rid, text`` and the list ``asked`` of ``h, start, size, at``."""
    schema = "unit bigint, _d bigint, _rid bigint, start int, at int, held binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                data, off = utf8(batch.column(2))
                lists = batch.column(3)
                ends = lists.offsets.to_numpy()
                asked = lists.values.slice(ends[0], ends[-1] - ends[0])
                h, start, size, at = (asked.field(k).to_numpy() for k in range(4))
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                n = size.astype(np.int64)
                at_byte = np.repeat(off[row] + start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                held = strings(data[at_byte], np.concatenate([[0], np.cumsum(n)]), pa.binary())
                take = pa.array(row)
                columns = [pa.array(h), batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(at), held]
                yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    return in_arrow(rows.select("_d", "_rid", "text", "asked"), run, schema)


_SHARD_COLUMNS = ["shard", "unit", "_d", "_rid", "start", "at", "till", "held"]


def _sorted_shards(rows: DataFrame, key, firsts: bool = False) -> DataFrame:
    """Spans to remove from the suffix arrays of groups by ``key`` packed into shards, ``_rid, start, end``;
    with ``firsts`` also the pieces (``held`` not null) whose strings are the first of their group."""
    rows = rows.withColumn("shard", key).select(*_SHARD_COLUMNS)
    rows = rows.repartition(parts(rows.sparkSession), "shard").sortWithinPartitions("shard")
    schema = "_rid bigint, start int, end int, unit bigint, _d bigint, at int, till int, held binary"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    fields = pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], kinds)))

    def runs(owner: np.ndarray, inside: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last of runs of windows of one row, sorted, with steps of at most ``gap``."""
        cut = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(inside) > gap)])
        first = np.flatnonzero(cut)
        return first, np.append(first[1:], len(owner)) - 1

    def settle(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, d, rid, start, at, till = (shard.column(k).to_numpy() for k in range(1, 7))
        data, off = utf8(shard.column(7).combine_chunks())
        order = np.lexsort((rid, d))
        rank = np.empty(len(d), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(d[order]) != 0) | (np.diff(rid[order]) != 0)]))
        owner, inside = repeated_windows(data, off, (rank << 32) + start, LENGTH)
        order = np.lexsort((inside, owner))
        owner, inside = owner[order], inside[order]
        if len(owner):
            first, last = runs(owner, inside, LENGTH)
            own = owner[first]
            begin, end = start[own] + inside[first], start[own] + inside[last] + LENGTH
            ends = [pa.array(x.astype(np.int32)) for x in (begin, end)]
            rest = [pa.nulls(len(own), k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(rid[own]), *ends, *rest], schema=fields)
        if firsts:
            windows = np.maximum(np.diff(off) - LENGTH + 1, 0)
            base = np.cumsum(windows) - windows
            left = np.ones(int(windows.sum()), bool)
            left[base[owner] + inside] = False
            left = np.flatnonzero(left)
            if len(left):
                own = np.repeat(np.arange(len(d)), windows)[left]
                spot = left - base[own]
                first, last = runs(own, spot, 1)
                own, spot, size = own[first], spot[first], spot[last] - spot[first] + LENGTH
                held = strings(data[ranges(off[own] + spot, size)], np.concatenate([[0], np.cumsum(size)]), pa.binary())
                small = [pa.array(x.astype(np.int32)) for x in (start[own] + spot, start[own] + spot + size)]
                gram = [pa.array((x[own] - spot).astype(np.int32)) for x in (at, till)]
                columns = [pa.array(rid[own]), *small, pa.array(unit[own]), pa.array(d[own]), *gram, held]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, now = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != now and size >= SHARD_BYTES:
                    yield from settle(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                now = keys[a]
                part = batch.slice(a, b - a)
                waiting.append(part)
                size += int(np.diff(utf8(part.column(7))[1]).sum())
        if waiting:
            yield from settle(pa.Table.from_batches(waiting))

    out = in_arrow(rows, run, schema)
    return out if firsts else out.select("_rid", "start", "end")


def _fitting(cuts: DataFrame) -> list[DataFrame]:
    """Spans of all units. A unit of more than ``UNIT_ROWS`` rows is dealt to chunks, each of which
    leaves only the strings it has first; what still does not fit is split by longer grams."""
    found = []

    def fit(rows: DataFrame) -> DataFrame | None:
        """Settle the units that fit, give back the rows of those that do not, with the unit's rows ``n``."""
        crowded = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > UNIT_ROWS)
        crowded = written(crowded, "crowded")
        if not crowded.limit(1).count():
            found.append(_sorted_shards(rows, F.col("unit")))
            return None
        found.append(_sorted_shards(rows.join(crowded, "unit", "left_anti"), F.col("unit")))
        return rows.join(crowded, "unit")

    rows = fit(cuts.withColumn("till", F.col("at") + GRAM))
    width = GRAM
    while rows is not None:
        chunk = F.pmod(F.xxhash64("_rid", "start"), F.ceil(F.col("n") / UNIT_ROWS))
        chunks = written(_sorted_shards(rows, F.xxhash64("unit", chunk), firsts=True), "chunk-firsts")
        found.append(chunks.where("held is null").select("_rid", "start", "end"))
        rows = fit(chunks.where("held is not null").drop("end"))
        if rows is None:
            break
        rows = rows.drop("n")
        if width == LENGTH:
            # All strings of a unit are equal.
            here = F.struct("_d", "_rid", (F.col("start") + F.col("at")).alias("s"))
            first = rows.groupBy("unit").agg(F.min(here).alias("first"))
            later = rows.join(first, "unit").where(here > F.col("first"))
            found.append(later.select("_rid", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("till")).alias("end")))
            break
        half = (LENGTH - width + 1) // 2
        split = None
        for at, till, shift in ((F.col("at") - half, F.col("till"), -half), (F.col("at"), F.col("till") + half, 0)):
            gram = F.substring(F.col("held"), at + 1, till - at)
            side = rows.where((at >= 0) & (till <= F.octet_length("held")))
            side = side.withColumn("unit", F.xxhash64("unit", F.lit(shift), gram)).withColumns({"at": at, "till": till})
            split = side if split is None else split.unionByName(side)
        split = written(split, "split-units")
        # A longer gram that occurs once repeats nothing.
        again = split.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
        rows = fit(split.join(again, "unit", "left_semi"))
        width += half
    return found


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a written table with a row number, an order and a digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = {
        "_rid": F.monotonically_increasing_id(),
        "_d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
        "_sha": F.unhex(F.sha2(text, 256)),
        "_n": F.octet_length(text).cast("bigint"),
    }
    return written(docs.withColumns(marks), "numbered")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``_rid, spans`` (lists of ``start, end``, not merged) of :func:`numbered` rows that lose bytes."""
    here = F.struct("_d", "_rid")
    same = rows.groupBy("_sha").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = rows.select("_sha", "_d", "_rid", "_n").join(same, "_sha").where(F.col("_rid") != F.col("first._rid"))
    copies = written(copies.select("_rid", "_n"), "copies")
    reps = rows.where(F.col("_n") >= LENGTH).select("_d", "_rid", "text").join(copies.select("_rid"), "_rid", "left_anti")

    # Anchors are made twice, which is cheaper than keeping those that occur once.
    again = _anchor_hashes(reps).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = written(again, "repeated-hashes")
    every = written(_anchor_rows(reps).join(again, "h", "left_semi"), "repeated-anchors")
    dropped(again)
    place = F.struct("_d", "_rid", "start", "size", "at")
    groups = written(every.groupBy("h", "m").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "surroundings")

    twins = every.join(groups.where("n > 1").select("h", "m", "first"), ["h", "m"])
    twins = twins.where((F.col("_rid") != F.col("first._rid")) | (F.col("start") != F.col("first.start")))
    twins = twins.select("_rid", "start", (F.col("start") + F.col("size")).alias("end"))

    several = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    asked = groups.join(several, "h", "left_semi").select("h", "first.*")
    asked = asked.groupBy("_rid").agg(F.collect_list(F.struct("h", "start", "size", "at")).alias("asked"))
    cuts = written(_cut(rows.select("_d", "_rid", "text").join(written(asked, "asked"), "_rid")), "cuts")

    spans = twins
    for more in _fitting(cuts):
        spans = spans.union(more)
    # A list is bounded by the length of its text.
    lists = spans.groupBy("_rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("_n").cast("int").alias("end")))
    gone = copies.where(F.col("_n") >= LENGTH).select("_rid", whole.alias("spans"))
    return written(lists.union(gone), "spans")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes in any of the spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(cut)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], len(starts)) - 1].tolist()))


def without_repeats(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``_bytes``, ``_removed``, ``_spans`` and ``_kept`` (the bytes that stay).

    With ``whole_characters`` a character that loses one of its bytes loses all.
    """
    names = docs.columns
    rows = numbered(docs)
    rows = rows.join(repeated_spans(rows), "_rid", "left").select(*names, "spans")
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                data, off = utf8(batch.column(at))
                lists = batch.column(len(names))
                n, known = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
                starts, ends = (lists.values.field(k).to_numpy() for k in (0, 1))
                keep = np.ones(len(data), bool)
                runs = np.zeros(batch.num_rows, np.int64)
                for i in np.flatnonzero(known & (np.diff(n) > 0)).tolist():
                    for a, b in (found := merged(starts[n[i] : n[i + 1]], ends[n[i] : n[i + 1]])):
                        keep[off[i] + a : off[i] + b] = False
                    runs[i] = len(found)
                if whole_characters and not keep.all():
                    # Every byte that does not continue a character starts one.
                    first = np.flatnonzero((data & 0xC0) != 0x80)
                    if len(first):
                        keep = np.repeat(np.logical_and.reduceat(keep, first), np.diff(np.append(first, len(data))))
                upto = np.concatenate([[0], np.cumsum(keep)])[off]
                size = np.diff(off)
                columns = [pa.array(size), pa.array(size - np.diff(upto)), pa.array(runs), strings(data[keep], upto, pa.binary())]
                yield pa.record_batch([*batch.columns[:-1], *columns], names=[*names, "_bytes", "_removed", "_spans", "_kept"])

    return in_arrow(rows, run, f"{fields}, _bytes bigint, _removed bigint, _spans bigint, _kept binary")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_bytes").alias("n_bytes"),
        F.col("_removed").alias("n_removed"),
        F.col("_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


@carrying
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated bytes, and ``n_chars`` anew where bytes went; all rows stay.
    What is left of a character that was cut apart goes too, and nothing else: a replacement
    character that the text held itself stays. Columns of any other name come along unchanged."""
    out = without_repeats(docs, whole_characters=True)
    out = out.withColumn("text", F.when(F.col("_removed") > 0, F.col("_kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
