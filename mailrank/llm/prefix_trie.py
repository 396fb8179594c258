"""The trie of conversation prefixes, by ternary search trees over range shards.

A turn is known by a strong hash of its role and text (the first 128 bits of SHA-256), a
conversation by its turns' hashes one after the other, its path. Conversations are ranged by path,
so those that share a prefix lie together, and a task cuts its range into shards of a bounded
number of conversations and turns. In a shard, hashes become ranks (its dictionary), and the
distinct paths are inserted into a ternary search tree, the median of each run before its halves,
which keeps the tree balanced. A traversal with a stack then adds up members, leaves and savings
from the longest prefixes to the root.

Only prefixes of a shard's first or last path can lie in another shard too; these boundary nodes
leave the shard unfinished. Merging sums them by the hash of their prefix. What lies below a
boundary node is a run of boundary nodes in path order, from the node's first shard to its last, so
sums over subtrees are differences of running sums over shards, without walking up the trie. A
shard has at most two boundary nodes for each turn of its first and last path.

Nulls and ties: a null role or text is empty; turns of one number follow the hash of role and text.
Rows without a conversation id belong to no conversation and are left out. Repeated turns count
each. One conversation is one row, as its path is one key. An empty table gives no rows, not even
a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, table, words, written

FAMILY = 20  # a conversation's rebuilt start comes from the one at the last multiple of this
HEADS = 4  # and has fewer turns than this
SHARD_ROWS = 20_000  # conversations of one shard
SHARD_TURNS = 400_000  # turns of one shard, or one longer conversation
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
PARTIAL = (
    "part int, shard int, boundary boolean, on_first boolean, on_last boolean, key binary, parent_key binary, depth bigint, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends string, ends_sha256 string"
)
_KINDS = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}


def sequences(turns: DataFrame) -> DataFrame:
    """``family, conv_id, turns`` (``key, words`` in order) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"),
        conv.alias("conv_id"),
        F.struct(F.col("turn"), key.alias("key"), F.size(words(text)).cast("bigint").alias("words")).alias("t"),
    )
    # Conversations of a family, and later their first member, stay in one place.
    rows = rows.repartition(parts(turns.sparkSession), "family")
    held = rows.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("family", "conv_id", F.transform("t", lambda x: F.struct(x.key.alias("key"), x.words.alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of every conversation, its first turns taken from its family's first member."""
    own = sequences(turns)
    first = own.where("conv_id = family").select("family", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rows = own.join(first, "family", "left").select("conv_id", F.concat(head, rest).alias("turns"))
    return rows.select("conv_id", *path_of(F.col("turns")))


def path_of(turns: Column) -> list[Column]:
    """``path`` and ``words`` of an array of ``key, words``."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t.key), "")).alias("path"), F.transform(turns, lambda t: t.words).alias("words")]


class Ternary:
    """A ternary search tree of sequences of numbers; node 0 is the root of all of them."""

    def __init__(self):
        self.symbol, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]

    def _new(self, symbol: int) -> int:
        for links in (self.low, self.equal, self.high):
            links.append(-1)
        self.symbol.append(symbol)
        return len(self.symbol) - 1

    def walk(self, sequence: list[int]) -> list[int]:
        """The nodes of a sequence after the root; those it lacks are made."""
        symbol, low, equal, high = self.symbol, self.low, self.equal, self.high
        at, nodes = 0, []
        for s in sequence:
            links, t = equal, at
            while (down := links[t]) >= 0:
                t = down
                if symbol[t] == s:
                    break
                links = low if s < symbol[t] else high
            else:
                links[t] = self._new(s)
                t = links[t]
            nodes.append(t)
            at = t
        return nodes

    def insert_sorted(self, paths: list[list[int]]) -> list[int]:
        """Insert sorted distinct sequences by medians; gives the node each one ends at."""
        ends = [0] * len(paths)
        runs = [(0, len(paths))]
        while runs:
            a, b = runs.pop()
            if a < b:
                m = (a + b) // 2
                nodes = self.walk(paths[m])
                ends[m] = nodes[-1] if nodes else 0
                runs += [(a, m), (m + 1, b)]
        return ends

    def traverse(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, each after the one whose prefix it extends; by node: that one, and the prefix length."""
        order, above, depth = [0], [-1] * len(self.symbol), [0] * len(self.symbol)
        stack = [(self.equal[0], 0)]
        while stack:
            t, up = stack.pop()
            if t < 0:
                continue
            above[t], depth[t] = up, depth[up] + 1
            order.append(t)
            stack += [(self.low[t], up), (self.high[t], up), (self.equal[t], t)]
        return order, above, depth


def _prefix_keys(path: bytes) -> list[bytes]:
    """The hashes of all prefixes of a path, the empty one first."""
    state = hashlib.sha256()
    keys = [state.digest()]
    for a in range(0, len(path), DIGEST):
        state.update(path[a : a + DIGEST])
        keys.append(state.digest())
    return keys


def shard_nodes(part: int, shard: int, convs: np.ndarray, paths: list[bytes], n_words: list[np.ndarray]) -> dict[str, list]:
    """The nodes of one shard as columns of ``PARTIAL``, from rows sorted by path and id."""
    lengths = np.array([len(p) // DIGEST for p in paths], np.int64)
    held = np.frombuffer(b"".join(paths), f"S{DIGEST}")
    _, first, codes = np.unique(held, return_index=True, return_inverse=True)
    flat_words = np.concatenate(n_words) if len(n_words) else np.zeros(0, np.int64)
    words_of = flat_words[first].tolist()
    starts = np.flatnonzero(np.array([True, *(a != b for a, b in zip(paths, paths[1:]))]))
    stops = [*starts[1:].tolist(), len(paths)]
    starts = starts.tolist()
    at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    codes = codes.tolist()
    distinct = [codes[at[r] : at[r + 1]] for r in starts]

    tree = Ternary()
    ends = tree.insert_sorted(distinct)
    order, above, depth = tree.traverse()
    n = len(order)
    on_first, on_last = [0, *tree.walk(distinct[0])], [0, *tree.walk(distinct[-1])]
    key: list[bytes | None] = [None] * n
    for nodes, path in ((on_first, paths[0]), (on_last, paths[-1])):
        for node, k in zip(nodes, _prefix_keys(path)):
            key[node] = k
    firsts, lasts = set(on_first), set(on_last)

    smallest, members, children, leaves, saved = [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    ended: list[str | None] = [None] * n
    for node, a, b in zip(ends, starts, stops):
        own = convs[a:b].tolist()
        ended[node] = ",".join(map(str, own))
        smallest[node], members[node] = own[0], b - a
    last_words = [0] * n
    for node in reversed(order):
        if node:
            last_words[node] = words_of[tree.symbol[node]]
        if key[node] is None:
            saved[node] += (members[node] - 1) * last_words[node]
            leaves[node] = leaves[node] or 1
        up = above[node]
        if up < 0:
            continue
        members[up] += members[node]
        if smallest[up] is None or smallest[node] < smallest[up]:
            smallest[up] = smallest[node]
        if key[node] is None:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]

    inner = [k is None for k in key]
    return {
        "part": [part] * n,
        "shard": [shard] * n,
        "boundary": [not x for x in inner],
        "on_first": [i in firsts for i in range(n)],
        "on_last": [i in lasts for i in range(n)],
        "key": key,
        "parent_key": [key[above[i]] if i else None for i in range(n)],
        "depth": depth,
        "conv_id": smallest,
        "parent_conv_id": [smallest[above[i]] if i and inner[above[i]] else None for i in range(n)],
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaves,
        "saved": saved,
        "words": last_words,
        "ends": [None if x else e for x, e in zip(inner, ended)],
        "ends_sha256": [(hashlib.sha256(e.encode()).hexdigest() if e else NO_ENDS) if x else None for x, e in zip(inner, ended)],
    }


def partial_nodes(rows: DataFrame) -> DataFrame:
    """``PARTIAL`` rows of ``conv_id, path, words`` (a written table): finished inner nodes, unfinished boundary nodes."""
    order = ["path", "conv_id"]
    ranged = rows.select("conv_id", "path", "words").repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    most_rows, most_turns = SHARD_ROWS, SHARD_TURNS
    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in PARTIAL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        convs, paths, n_words, turns, shard = [], [], [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            nodes = shard_nodes(part, shard, np.array(convs, np.int64), paths, n_words)
            whole = pa.RecordBatch.from_pydict(nodes, schema)
            for a in range(0, whole.num_rows, 20_000):
                yield whole.slice(a, 20_000)

        for batch in batches:
            lists = batch.column(2)
            ends, held = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (c, p) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if convs and (len(convs) >= most_rows or turns + len(p) // DIGEST > most_turns):
                    yield from done()
                    convs, paths, n_words, turns, shard = [], [], [], 0, shard + 1
                convs.append(c)
                paths.append(p)
                n_words.append(held[ends[i] : ends[i + 1]])
                turns += len(p) // DIGEST
        if convs:
            yield from done()

    return in_arrow(ranged, run, PARTIAL)


def ends_of(boundary: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the ids that end at each boundary node, read shard by shard in a stream."""
    order = ["key", "part", "shard"]
    rows = boundary.where("ends is not null").select(*order, "ends")
    rows = rows.repartition(parts(boundary.sparkSession), "key").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed(keys: list, hashes: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])

        for batch in batches:
            keys, hashes = [], []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if key != now:
                    if state:
                        keys.append(now)
                        hashes.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            if keys:
                yield closed(keys, hashes)
        if state:
            yield closed([now], [state.hexdigest()])

    return in_arrow(rows, run, "key binary, ends_sha256 string")


def merged(boundary: DataFrame) -> DataFrame:
    """The boundary nodes of all shards as whole nodes, with their ``key`` and ``parent_key``."""
    place = F.struct("part", "shard")
    # A node that is only on the last path of its first shard comes after that shard's whole first path.
    side = F.when(F.col("on_first"), 0).otherwise(1)
    nodes = boundary.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "depth", "words")],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.min(F.struct(place.alias("place"), side.alias("side"))).alias("start"),
        F.max(F.struct(place.alias("place"), F.col("on_last").cast("int").alias("side"))).alias("stop"),
    )
    nodes = written(nodes, "boundary-nodes")
    below = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumns(
        {
            "own_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
            "own_saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words"),
            **{c: F.col(f"start.{x}") for c, x in (("part", "place.part"), ("shard", "place.shard"), ("side", "side"))},
        }
    ).drop("n_leaves", "saved")
    nodes = written(nodes, "boundary-nodes")

    # Running sums in path order: within a path by depth, then over both sides of all shards, then over parts.
    group = ["part", "shard", "side"]
    sums = {c: f"own_{c}" for c in ("leaves", "saved")}
    all_groups = boundary.select("part", "shard").distinct().withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    held = nodes.groupBy(*group).agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    held = all_groups.join(held, group, "left").na.fill(0, list(sums))
    in_part = Window.partitionBy("part").orderBy("shard", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part of the range shuffle.
    before = held.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    before = before.select("part", *[F.coalesce(F.sum(c).over(over_parts), F.lit(0)).alias(f"{c}_before") for c in sums])
    through = held.select(*group, *[F.col(c).alias(f"{c}_here") for c in sums], *[F.sum(c).over(in_part).alias(f"{c}_run") for c in sums])
    through = through.join(F.broadcast(before), "part")
    through = written(through.select(*group, *[(F.col(f"{c}_run") + F.col(f"{c}_before")).alias(f"{c}_through") for c in sums], *[f"{c}_here" for c in sums]), "running")

    on_path = Window.partitionBy(*group).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.join(through, group)
    start = {c: F.col(f"{c}_through") - F.col(f"{c}_here") + F.coalesce(F.sum(sums[c]).over(on_path), F.lit(0)) for c in sums}
    nodes = nodes.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "stop", *[x.alias(f"{c}_start") for c, x in start.items()])
    stop = through.select(
        F.struct(F.struct("part", "shard").alias("place"), "side").alias("stop"), *[F.col(f"{c}_through").alias(f"{c}_stop") for c in sums]
    )
    nodes = nodes.join(stop, "stop")
    total = [(F.col(f"{c}_stop") - F.col(f"{c}_start")).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    return nodes.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children", *total)


def nodes(rows: DataFrame) -> DataFrame:
    """Every node of the trie of ``conv_id, path, words`` (ids occur once).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    found = written(partial_nodes(written(rows, "paths")), "trie-nodes")
    inner, boundary = found.where("not boundary"), found.where("boundary")
    whole = written(merged(boundary), "merged-nodes")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    ends = ends_of(boundary)
    outer = whole.join(parents, "parent_key", "left").join(ends, "key", "left")
    outer = outer.withColumns({"parent_conv_id": F.col("parent_conv"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))})
    inner = inner.withColumnRenamed("saved", "saved_tokens")
    # Inner nodes below a boundary node learn its id in their own shard, so no node's children meet in one task.
    here = ["part", "shard", "parent_key"]
    known = boundary.select("part", "shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    hung = inner.where("parent_key is not null").drop("parent_conv_id").join(known, here).withColumn("parent_conv_id", F.col("parent_conv"))
    return inner.where("parent_key is null").select(*out).unionByName(hung.select(*out)).unionByName(outer.select(*out))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return nodes(rebuilt(turns))


SQL = """
WITH k AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
             lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS steps),
turns AS (SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
                 len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS w, turn
          FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, s, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) - 1 AS p FROM turns),
ids AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda z: ord(z)))::BIGINT[],
                 lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT c FROM turns), k),
mixed AS (SELECT i.c, t.p, t.s, t.w FROM ids i JOIN own t ON t.c = i.c - i.c % 20 AND t.p < i.h
          UNION ALL SELECT i.c, t.p, t.s, t.w FROM ids i JOIN own t ON t.c = i.c AND t.p >= i.h),
paths AS (SELECT c, string_agg(s, ',') OVER (PARTITION BY c ORDER BY p) AS path, row_number() OVER (PARTITION BY c ORDER BY p) AS depth, w FROM mixed),
every AS (SELECT c, path, depth, w FROM paths UNION ALL SELECT c, '', 0, 0 FROM ids),
node AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w,
                CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE path[:65 * (depth - 1) - 1] END AS up
         FROM every GROUP BY path, depth),
kids AS (SELECT up, count(*) AS n FROM node GROUP BY up),
deep AS (SELECT c, max(depth) AS depth FROM every GROUP BY c),
ended AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM every JOIN deep USING (c, depth) GROUP BY path),
below AS (SELECT CASE WHEN d = 0 THEN '' ELSE path[:65 * d - 1] END AS path, sum((n_convs - 1) * w)::BIGINT AS saved,
                 (count(*) FILTER (n IS NULL))::BIGINT AS leaves
          FROM (SELECT node.path, n_convs, w, kids.n, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN kids ON kids.up = node.path) GROUP BY 1)
SELECT node.conv_id::BIGINT AS conv_id, node.depth::BIGINT AS depth, over.conv_id::BIGINT AS parent_conv_id, node.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ended.ids, '')) AS ends_sha256
FROM node LEFT JOIN node over ON over.path = node.up LEFT JOIN kids ON kids.up = node.path JOIN below ON below.path = node.path
LEFT JOIN ended ON ended.path = node.path
"""
