"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailrank.llm import simhash as sh
from mailrank.llm.common import written
from mailrank.llm.components import components


def brute_print(text, shingle=4):
    data = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in data).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, budget):
    """Smallest place reachable, by breadth-first search over all pairs."""
    u = np.array(prints, np.uint64)
    out = [-1] * len(u)
    for i in range(len(u)):
        if out[i] < 0:
            todo, out[i] = [i], i
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= budget).tolist():
                    if out[j] < 0:
                        out[j] = i
                        todo.append(j)
    return out


def check(rows, texts):
    """``texts``: id and text, ascending by id."""
    prints = [brute_print(t) for _, t in texts]
    ids = [i for i, _ in texts]
    want = sorted((i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_components(prints, 4)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    check(sh.op4_simhash_components(spark, sf_dir).collect(), [tuple(r) for r in docs])


@pytest.mark.parametrize("budget", [0, 3, 4, 7])
def test_trie_join_loses_no_link(spark, budget, monkeypatch):
    # Small bounds, so that nodes are split and visited in several runs.
    monkeypatch.setattr(sh, "NODE_ROWS", 100)
    monkeypatch.setattr(sh, "CROWDED_ROWS", 60)
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 2**64, 60, np.uint64)
    u = list(centres)
    for c in list(centres) * 12 + [centres[0]] * 300:
        for _ in range(rng.integers(1, 9)):
            c = c ^ np.uint64(1 << int(rng.integers(0, 64)))
        u.append(c)
    u = np.array(u, np.uint64)
    rows = [(i, int(x)) for i, x in enumerate(u.view(np.int64).tolist())]
    prints = written(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), "prints")
    got = {r.fp: r.component_id for r in sh.near_groups(prints, budget).collect()}
    assert [got[fp] for _, fp in rows] == brute_components(u, budget)


def test_odd_rows(spark):
    texts = [(0, ""), (1, None), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A\x0bB C"), (7, "É x"), (8, "é x"),
             (9, "w " * 3000), (9, "w " * 3000), (10, "n\xa0m o p q")]
    rows = [(i, t, "clash", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, fp int")
    prints = written(sh.fingerprints(docs.select("doc_id", "text", "fp"), 4), "prints")
    out = prints.join(sh.near_groups(prints, 4), "fp")
    check(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id").collect(), texts)
    assert sh.near_groups(written(prints.limit(0), "none"), 4).count() == 0
    kept = sh.stage(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {0, 3, 5, 7, 8, 9, 10} and len(kept) == 7
    assert sh.stage(spark, docs, "").columns == docs.columns


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "x y z"), (None, None)], "doc_id bigint, text string")
    prints = written(sh.fingerprints(docs, 4), "prints")
    got = sorted(str(r.component_id) for r in prints.join(sh.near_groups(prints, 4), "fp").collect())
    assert got == ["5", "5", "None", "None"]


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]
