"""SimHash near-duplicates: fingerprints of word shingles, joined in binary tries.

Documents of one fingerprint are one node. Two fingerprints within the error budget agree, up
to a quarter of the budget, in one of their four 16-bit quarters, so there are four tries, each
starting with another quarter. A trie is dealt to tasks by its top nodes: a task holds the
fingerprints below one node, and those below the nodes one bit away visit it. There, two tries
are traversed together from their roots: pairs of nodes collect the bits in which they differ,
and a pair is dropped once it is over the budget. Crowded nodes are split, and their parts
visit each other. Tasks give links that connect what they found, never all pairs of a group.

Nulls and ties: a null text has no words and fingerprint zero, like an empty one; rows with a
null id are linked like others but are never the smallest. Repeated rows share a fingerprint.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import carrying, in_arrow, parts, slices, table, utf8, written
from mailrank.llm.components import components

SEED = 42
NODE_ROWS = 2_048  # fingerprints below one top node, about
CROWDED_ROWS = 4_096  # beyond that a node is split
MOST_TOP_BITS = 14
VISITORS_AT_ONCE = 1_024
LEAF_PAIRS = 64


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts one after the other, and how many each text has."""
    import xxhash

    data, off = utf8(column)
    held, hashes, counts = data.tobytes(), [], []
    digest = xxhash.xxh64_intdigest
    for a, b in zip(off.tolist(), off[1:].tolist()):
        # Both work on ASCII alone for bytes, as asked: A-Z, space and U+0009 to U+000D.
        words = held[a:b].lower().split()
        n = len(words)
        if n <= shingle:
            counts.append(min(n, 1))
            if n:
                hashes.append(digest(b" ".join(words), SEED))
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        hashes += [digest(joined[x:y], SEED) for x, y in zip(starts, ends[shingle - 1 :].tolist())]
        counts.append(n - shingle + 1)
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each text: a bit is 1 if set in over half the hashes of its shingles."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
        ones = (2 * sums > counts[some, None]).astype(np.uint8)
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """``docs`` with ``fp`` (the 64 bits as a signed number; a column of that name is replaced) in place of the text."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(*kept, text)
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                fps = majority(*shingle_hashes(batch.column(at), shingle))
                yield pa.record_batch([*batch.columns[:at], pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return in_arrow(rows, run, f"{schema}, fp bigint")


def pairs_within(a: np.ndarray, b: np.ndarray, budget: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of 64-bit numbers that differ in at most ``budget`` bits, of which at
    most ``first`` (a quarter of the budget, if not given) lie in the first 16."""
    first = budget // 4 if first is None else first
    zero = np.zeros(1, np.int64)
    alo, ahi, blo, bhi, diff = zero, zero + len(a), zero, zero + len(b), zero
    done = []
    for bit in range(64):
        leaf = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        done.append((alo[leaf], ahi[leaf], blo[leaf], bhi[leaf]))
        alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            break
        one = np.uint64(1 << (63 - bit))
        above = np.uint64(2**64 - (1 << (64 - bit)) if bit else 0)
        amid = np.clip(np.searchsorted(a, (a[alo] & above) | one), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & above) | one), blo, bhi)
        alo, ahi = np.concatenate([alo, amid, alo, amid]), np.concatenate([amid, ahi, amid, ahi])
        blo, bhi = np.concatenate([blo, bmid, bmid, blo]), np.concatenate([bmid, bhi, bhi, bmid])
        diff = np.concatenate([diff, diff, diff + 1, diff + 1])
        good = (alo < ahi) & (blo < bhi) & (diff <= (first if bit < 16 else budget))
        alo, ahi, blo, bhi, diff = (x[good] for x in (alo, ahi, blo, bhi, diff))
    done.append((alo, ahi, blo, bhi))
    alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*done))
    found = []
    sizes = (ahi - alo) * (bhi - blo)
    ends = np.cumsum(sizes)
    for k in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
        # A run of leaf pairs at a time; which pair a place belongs to follows from the sums.
        at = np.arange(k, min(k + (1 << 20), int(ends[-1])))
        leaf = np.searchsorted(ends, at, side="right")
        inside = at - (ends[leaf] - sizes[leaf])
        width = bhi[leaf] - blo[leaf]
        i, j = alo[leaf] + inside // width, blo[leaf] + inside % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        found.append((i[near], j[near]))
    if not found:
        return zero[:0], zero[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links reach."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def dealt(nodes: DataFrame, words: list[str], carried: dict[str, Column], one_apart: bool) -> DataFrame:
    """``nodes`` (a written table) dealt to the units of all tries: ``r, at, part, visits, x`` and ``carried``.

    Trie ``r`` starts with quarter ``r % 4`` of word ``words[r // 4]``; ``x`` is that word turned so.
    """
    count = nodes.count()
    top = min(MOST_TOP_BITS, max(0, (count // NODE_ROWS).bit_length()))

    def rotated(word: str, quarter: int) -> Column:
        if not quarter:
            return F.col(word)
        by = 16 * quarter
        return F.call_function("shiftleft", F.col(word), F.lit(by)).bitwiseOR(F.call_function("shiftrightunsigned", F.col(word), F.lit(64 - by)))

    turns = [rotated(word, quarter) for word in words for quarter in range(4)]
    rows = nodes.select(F.posexplode(F.array(*turns)).alias("r", "x"), *[F.col(w) for w in nodes.columns])
    rows = rows.select("r", "x", *[c.alias(name) for name, c in carried.items()])
    node = F.shiftrightunsigned("x", 64 - top) if top else F.lit(0).cast("bigint")
    rows = rows.withColumn("node", node)
    # At most 4 * len(words) * 2 ** MOST_TOP_BITS rows, so they can be broadcast at any size of the input.
    sizes = rows.groupBy("r", "node").agg(F.ceil(F.count(F.lit(1)) / CROWDED_ROWS).alias("n_parts"))
    sizes = F.broadcast(sizes.withColumnRenamed("node", "at"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(max(top - 1, 0))), lambda k: F.getbit(F.col("node"), k) == 1)
    near = F.transform(bits, lambda k: F.col("node") - F.call_function("shiftleft", F.lit(1).cast("bigint"), k))
    rows = rows.withColumn("at", F.explode(F.concat(F.array("node"), near) if top and one_apart else F.array("node"))).join(sizes, ["r", "at"])
    own = F.when(F.col("at") == F.col("node"), F.pmod(F.xxhash64("x", *carried), F.col("n_parts"))).otherwise(F.lit(-1).cast("bigint"))
    rows = rows.withColumn("own", own)
    rows = rows.withColumn("part", F.explode(F.sequence(F.greatest("own", F.lit(0).cast("bigint")), F.col("n_parts") - 1)))
    visits = (F.col("part") != F.col("own")).cast("int")
    key = ["r", "at", "part"]
    rows = rows.select(*key, visits.alias("visits"), "x", *carried)
    return rows.repartition(parts(nodes.sparkSession), *key).sortWithinPartitions(*key, "visits")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray] | None]]:
    """Each unit of dealt rows as its trie and its columns sorted by ``x``: first alone, then with each run of its visitors."""
    unit, own, guests, home = None, [], [], None

    def joined(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*runs)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    def visit() -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray] | None]]:
        nonlocal own, guests, home
        if own:
            home, own = joined(own), []
            yield unit[0], home, None
        if guests and home is not None:
            yield unit[0], home, joined(guests)
        guests = []

    for batch in batches:
        if not batch.num_rows:
            continue
        r, at, part, visits, *columns = (c.to_numpy() for c in batch.columns)
        columns[0] = columns[0].view(np.uint64)
        cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(at) != 0) | (np.diff(part) != 0) | (np.diff(visits) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
            now = (int(r[lo]), at[lo], part[lo])
            if now != unit:
                yield from visit()
                unit, home = now, None
            if not visits[lo]:
                own.append([c[lo:hi] for c in columns])
                continue
            for k in range(lo, hi, VISITORS_AT_ONCE):
                guests.append([c[k : min(hi, k + VISITORS_AT_ONCE)] for c in columns])
                if sum(len(g[0]) for g in guests) >= VISITORS_AT_ONCE:
                    yield from visit()
    yield from visit()


def trie_links(nodes: DataFrame, budget: int) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct ``nodes.fp`` within ``budget`` bits of each other.

    ``nodes`` is a written table.
    """
    if not 0 <= budget <= 7:
        raise ValueError("top nodes are met within one bit, which is whole for budgets of at most 7 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, home, guests in meetings(batches):
            a, b = home[0], None if guests is None else guests[0]
            i, j = pairs_within(a, a if b is None else b, budget)
            if b is None:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            every = a if b is None else np.concatenate([a, b])
            label = spanning(i, j if b is None else j + len(a), len(every))
            moved = np.flatnonzero(label != np.arange(len(every)))
            turned = np.uint64(16 * r)
            back = (every >> turned) | (every << np.uint64(64 - 16 * r)) if r else every
            x, y = back[label[moved]].view(np.int64), back[moved].view(np.int64)
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return in_arrow(dealt(nodes, ["fp"], {}, budget >= 4), run, "a bigint, b bigint")


def labelled(prints: DataFrame, budget: int) -> DataFrame:
    """``fp, label`` for each distinct fingerprint of ``prints``; equal labels are linked within ``budget`` bits."""
    nodes = written(prints.select("fp").distinct(), "fingerprints")
    labels = components(trie_links(nodes, budget)).withColumnRenamed("node", "fp")
    return written(nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labelled")


def near_groups(prints: DataFrame, budget: int) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint of ``doc_id, fp`` (a written table):
    the smallest id that links of at most ``budget`` bits reach."""
    labels = labelled(prints, budget)
    linked = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(labels, "fp")
    linked = written(linked, "linked")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    return written(linked.join(smallest, "label").select("fp", "component_id"), "near-groups")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = written(fingerprints(docs, 4), "prints")
    out = prints.join(near_groups(prints, 4), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


STAGE_SHINGLE = 5
SIMILAR = (4, 5)  # similarity of shingle sets from which documents are near-duplicates
# Two fingerprints of 64 bits a text. Texts at the threshold differ in 19 of 128 bits on average.
PAIR_BUDGET = 28  # of both
WORD_BUDGET = 18  # of the one a trie holds; one bit at most of its first quarter
BLOCK_NODES = 1_024  # texts that are compared at once, twice as many where two blocks meet,
BLOCK_SHINGLES = 500_000  # with as many shingles, or one longer text


def mixed_again(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each shingle."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketches(docs: DataFrame, shingle: int, sets: bool) -> DataFrame:
    """``docs`` with, in place of ``text``, ``t`` (a hash of all its shingles in order), and the fingerprints ``f0, f1``
    and number ``n`` of its distinct shingles, or with ``sets`` the distinct shingles ``s`` themselves."""
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(*kept, "text")
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in slices(whole, at):
                hashes, counts = shingle_hashes(batch.column(at), shingle)
                ends = np.cumsum(counts)
                each = [hashes[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                t = pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in each], np.uint64).view(np.int64))
                each = [np.unique(h) for h in each]
                if sets:
                    s = pa.array([h.view(np.int64) for h in each], pa.list_(pa.int64()))
                    yield pa.record_batch([*batch.columns[:at], t, s], names=[*kept, "t", "s"])
                else:
                    # Of sets, as what decides later: a shingle said again changes nothing.
                    n = np.fromiter(map(len, each), np.int64, len(each))
                    once = np.concatenate([np.zeros(0, np.uint64), *each])
                    prints = [pa.array(majority(h, n).view(np.int64)) for h in (once, mixed_again(once))]
                    yield pa.record_batch([*batch.columns[:at], t, *prints, pa.array(n)], names=[*kept, "t", "f0", "f1", "n"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return in_arrow(rows, run, schema + ("t bigint, s array<bigint>" if sets else "t bigint, f0 bigint, f1 bigint, n bigint"))


def _proposed(r: int, home: list[np.ndarray], guests: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of different labels within both budgets that the traversal of two tries finds, and their bits."""
    x, y, _, label, _ = home
    gx, gy, _, glabel, _ = guests or home
    i, j = pairs_within(x, gx, WORD_BUDGET, 1)
    bits = np.bitwise_count(x[i] ^ gx[j]).astype(np.int32) + np.bitwise_count(y[i] ^ gy[j])
    good = (bits <= PAIR_BUDGET) & (label[i] != glabel[j])
    if guests is None:
        good &= i < j
    return i[good], j[good], bits[good].astype(np.int32)


def _dealt_pairs(nodes: DataFrame) -> DataFrame:
    carried = {"y": F.when(F.col("r") < 4, F.col("f1")).otherwise(F.col("f0")), "t": F.col("t"), "label": F.col("label"), "n": F.col("n")}
    return dealt(nodes, ["f0", "f1"], carried, True)


def nearest_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: each node's nearest partner in each trie, of the smallest ``t`` among equally near
    ones. ``nodes`` is ``t, f0, f1, n, label``, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, home, guests in meetings(batches):
            i, j, bits = _proposed(r, home, guests)
            a, b = home[2][i], (guests or home)[2][j]
            if not len(a):
                continue
            a, b, bits = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([bits, bits])
            order = np.lexsort((b, bits, a))
            a, b, bits = a[order], b[order], bits[order]
            first = np.append(True, a[1:] != a[:-1])
            a, b, bits = a[first], b[first], bits[first]
            yield pa.record_batch([pa.array(np.full(len(a), r, np.int32)), pa.array(a), pa.array(b), pa.array(bits)], names=["r", "a", "b", "bits"])

    found = in_arrow(_dealt_pairs(nodes), run, "r int, a bigint, b bigint, bits int")
    found = found.groupBy("r", "a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(n: np.ndarray) -> np.ndarray:
    """A block number for each place: runs of at most ``BLOCK_NODES`` nodes and about ``BLOCK_SHINGLES`` shingles."""
    by_size = (np.cumsum(n) - n) // BLOCK_SHINGLES
    by_rows = np.arange(len(n)) // BLOCK_NODES
    return np.unique(by_size * (len(n) + 1) + by_rows, return_inverse=True)[1]


def meeting_blocks(nodes: DataFrame) -> DataFrame:
    """``block, t``: which nodes have to be looked at together.

    Two nodes that the tries propose and no link joins yet share a block. A pair that several
    tries find counts in the first only; nodes without such a pair are in no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for r, home, guests in meetings(batches):
            i, j, _ = _proposed(r, home, guests)
            x, y, t, _, n = home
            gx, gy, gt, _, gn = guests or home
            if r and len(i):
                # Tries 0 to 3 hold the first fingerprint; x starts with the trie's own quarter.
                d, e = x[i] ^ gx[j], (y[i] ^ gy[j]).view(np.uint64)
                turn = np.uint64(16 * (r % 4))
                d = (d >> turn) | (d << ((np.uint64(64) - turn) % np.uint64(64))) if r % 4 else d
                f0, f1 = (d, e) if r < 4 else (e, d)
                seen = np.zeros(len(i), bool)
                for q in range(r):
                    f = f0 if q < 4 else f1
                    quarter = (f >> np.uint64(48 - 16 * (q % 4))) & np.uint64(0xFFFF)
                    seen |= (np.bitwise_count(f) <= WORD_BUDGET) & (np.bitwise_count(quarter) <= 1)
                i, j = i[~seen], j[~seen]
            if not len(i):
                continue
            own, other = _blocks(n), _blocks(gn)
            meet = own[i].astype(np.int64) << 32 | other[j]
            kinds, kind = np.unique(meet, return_inverse=True)
            nodes_of = np.unique(np.concatenate([np.stack([kind, t[i]], 1), np.stack([kind, gt[j]], 1)]), axis=0)
            yield pa.record_batch([pa.array((part << 32) + made + nodes_of[:, 0]), pa.array(nodes_of[:, 1])], names=["block", "t"])
            made += len(kinds)

    return in_arrow(_dealt_pairs(nodes), run, "block bigint, t bigint")


def similar_within(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i < j`` of sets (of distinct numbers) with at least the similarity ``SIMILAR``."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    m = len(sets)
    owner = np.repeat(np.arange(m), size)
    _, column, held = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    shared = np.zeros((m, m), np.float32)
    # Shingles of many sets are multiplied as matrices, those of few are counted pair by pair.
    many = held > max(2, m // 16)
    wide = np.cumsum(many) - 1
    mine = many[column]
    for a in range(0, int(many.sum()), 2_048):
        some = mine & (wide[column] >= a) & (wide[column] < a + 2_048)
        matrix = np.zeros((m, min(2_048, int(many.sum()) - a)), np.float32)
        matrix[owner[some], wide[column[some]] - a] = 1
        shared += matrix @ matrix.T
    few = ~mine & (held[column] > 1)
    order = np.argsort(column[few], kind="stable")
    who, column = owner[few][order], column[few][order]
    apart = 1
    while apart < len(who) and (same := column[apart:] == column[:-apart]).any():
        np.add.at(shared, (who[:-apart][same], who[apart:][same]), 1)
        apart += 1
    # Owners rise within a column, so the pairs lie above the diagonal; so does what is read.
    part, whole = SIMILAR
    i, j = np.nonzero(np.triu(shared * (part + whole) >= part * (size[:, None] + size), 1))
    return i, j


def links_within(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links that connect the similar nodes of every block of ``block, t``; pairs stay in the task."""
    rows = blocks.join(sets, "t").select("block", "t", "s")
    rows = rows.repartition(parts(blocks.sparkSession), "block").sortWithinPartitions("block", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ts, held = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(ts) > 1:
                i, j = similar_within(held)
                label = spanning(i, j, len(ts))
                moved = np.flatnonzero(label != np.arange(len(ts)))
                if len(moved):
                    t = np.array(ts, np.int64)
                    a, b = t[label[moved]], t[moved]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            ends, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            for k, (block, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if block != now:
                    yield from links()
                    now, ts, held = block, [], []
                ts.append(t)
                held.append(values[ends[k] : ends[k + 1]].copy())
        yield from links()

    return in_arrow(rows, run, "a bigint, b bigint")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose shingle sets have at least the similarity ``SIMILAR``."""
    part, whole = SIMILAR
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("s").alias("s_a")), "a")
    both = both.join(sets.select(F.col("t").alias("b"), F.col("s").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(shared * (part + whole) >= part * (F.size("s_a") + F.size("s_b"))).select("a", "b")


@carrying
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id, and of the smallest text hash among
    equal ids (a null id is the smallest). Texts without words are one group. Columns of any other
    name come along unchanged.

    Groups are connected by pairs with a similarity of 0.8 or more of their five-word shingle sets.
    The tries propose pairs and the sets decide. Each text first meets its nearest partners, which
    joins most of a large group; then texts that are proposed to each other and not joined yet are
    brought together in blocks and compared there, and only links that connect what was found leave the task.
    """
    key = {"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), "_hash": F.xxhash64("text")}
    prints = written(sketches(docs.withColumns(key).select(*key, "text"), STAGE_SHINGLE, False), "prints")
    first = F.min(F.struct(*key)).alias("first")
    nodes = prints.groupBy("t").agg(*[F.min(c).alias(c) for c in ("f0", "f1", "n")], first)
    nodes = written(nodes.withColumn("label", F.col("t")), "nodes")
    near = written(nearest_pairs(nodes), "near-pairs")
    met = near.select(F.col("a").alias("t")).union(near.select("b")).distinct()
    met = written(nodes.join(met, "t", "left_semi"), "met")
    texts = docs.withColumns(key).select(*key, "text").join(met.select("first.*"), list(key), "left_semi").dropDuplicates(list(key))
    sets = written(sketches(texts, STAGE_SHINGLE, True).select("t", "s"), "sets")
    links = written(similar(near, sets), "near-links")
    known = components(links).withColumnRenamed("node", "t")
    met = written(met.drop("label").join(known, "t", "left").withColumn("label", F.coalesce("label", "t")), "met")
    links = links.union(written(links_within(written(meeting_blocks(met), "blocks"), sets), "rest-links"))
    labels = components(links).withColumnRenamed("node", "t")
    firsts = nodes.drop("label").join(labels, "t", "left").groupBy(F.coalesce("label", "t").alias("label")).agg(F.min("first").alias("first"))
    kept = docs.withColumns(key).join(written(firsts.select("first.*"), "firsts"), list(key), "left_semi")
    return kept.dropDuplicates(list(key)).select(*docs.columns)
