"""Best-fit-decreasing shards against a plain version of the rule."""

import zlib
from collections import defaultdict

import numpy as np

import __spark_entry__ as contract
from mailrank.llm import sharding as sh
from mailrank.session import fresh_path


def test_tree_is_an_ordered_and_balanced_set():
    rng = np.random.default_rng(1)
    tree, held = sh.Tree(), set()
    for x in rng.integers(0, 400, 3000).tolist():
        if x in held:
            tree.drop(x)
            held.discard(x)
        else:
            tree.add(x)
            held.add(x)
        ask = int(rng.integers(0, 420))
        assert tree.at_least(ask) == min((y for y in held if y >= ask), default=None)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t[2]), depth(t[3]))

    assert depth(tree.root) <= 2 * np.log2(len(held) + 1) + 1


def one_by_one(items, bins, capacity):
    """Best fit with one group at a time and no tree."""
    left = [capacity] * bins
    out = []
    for size in sorted(items, reverse=True):
        fits = [(left[b], b) for b in range(bins) if left[b] >= size]
        if not fits:
            return None
        _, b = min(fits)
        left[b] -= size
        out.append(b)
    return out


def test_steps_are_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(50):
        items = rng.integers(1, 60, rng.integers(1, 200)).tolist()
        bins = int(rng.integers(1, 9))
        capacity = -(-sum(items) // bins) + int(rng.integers(0, 20))
        sizes = sorted(set(items), reverse=True)
        steps = sh.best_fit(sizes, [items.count(s) for s in sizes], list(range(bins)), capacity)
        want = one_by_one(items, bins, capacity)
        assert (steps is None) == (want is None)
        if steps is not None:
            assert [b for n, b in steps for _ in range(n)] == want


def test_a_group_over_the_mean_has_its_own_bin():
    steps = sh.packed([1000, 10], [1, 90], 4)
    assert steps[0] == (1, 0) and {b for _, b in steps[1:]} == {1, 2, 3}
    load = defaultdict(int)
    for n, b in steps[1:]:
        load[b] += 10 * n
    assert set(load.values()) == {300}
    assert sh.packed([5], [2], 24) == [(1, 0), (1, 1)]


def check(rows, texts, shards):
    """``rows`` by the law; ``texts`` of all documents by id."""
    bins, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        bins[raw].add(r.shard)
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in bins.values()) and set(slots) <= set(range(shards))
    for x in slots.values():
        x.sort()
        assert [s for s, _ in x] == list(range(len(x))) and [d for _, d in x] == sorted(d for _, d in x)
    return load


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = contract.queries()["op13_sharding"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    load = check(rows, {r.doc_id: r.text for r in docs}, 24)
    groups = defaultdict(int)
    for r in docs:
        groups[r.text] += len((r.text or "").encode()) + 8
    assert len(load) == 24 and max(load.values()) <= max(max(groups.values()), sum(groups.values()) / 24 * 1.01)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sh, "HOT_SHARE", 5)
    long = "x" * 300_000
    rows = [(1, None), (2, ""), (None, "é"), (None, "é"), (3, long), (3, long)] + [(10 + i, "hot") for i in range(60)] + [(100 + i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame([(a, b, "clash", 7) for a, b in rows], "doc_id bigint, text string, size string, shard int")
    got = sh.in_shards(docs, 5).collect()
    assert len(got) == len(rows)
    load = check(got, dict(rows), 5)
    # The two large groups have bins of their own; the others share what is left.
    *rest, hot, most = sorted(load.values())
    assert most == 600_016 and hot == 660 and rest[-1] - rest[0] < 15
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert sh.in_shards(docs.limit(0), 5).count() == 0
    folder = fresh_path(spark, "shards")
    sh.write_shards(docs, folder, 5)
    back = spark.read.parquet(folder)
    assert sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in back.collect()) == sorted(
        (r.doc_id or -1, dict(rows)[r.doc_id] or "", r.shard, r.slot) for r in got
    )


def test_large_sizes_are_rounded_up_alike(spark):
    rows = [(bytes([i]) * 32, 1, 2**30 + i) for i in range(40)]
    groups = spark.createDataFrame(rows, "text_key binary, n bigint, bytes bigint")
    got = sh.in_bins(groups, 8).collect()
    per = defaultdict(int)
    for r in got:
        per[r.shard] += 1
    assert sorted(per.values()) == [5] * 8
