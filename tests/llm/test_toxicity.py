"""Nearest labelled examples against plain cosines of all words."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from mailrank.llm import toxicity as tx


def split(text):
    words, now = [], ""
    for ch in (text or "").lower() + " ":
        if "a" <= ch <= "z" or ord(ch) >= 128:
            now += ch
        elif now:
            words.append(now)
            now = ""
    return Counter(words)


def plain(docs, labels):
    """Scores of ``(doc_id, text)`` rows from ``(doc_id, toxic)`` labels that all take part, one by one."""
    bags = [split(t) for _, t in docs]
    by_id = {}
    for d, t in docs:
        by_id.setdefault(d, set()).add(t)
    examples = sorted({(d, y, t or "") for d, y in labels if d is not None and y in (0, 1) for t in by_id.get(d, ())}, key=str)
    own = [split(t) for _, _, t in examples]
    toxic = np.array([y for _, y, _ in examples], float)
    words = sorted(set().union(*own)) if own else []
    totals = Counter(y for d, y in labels if d is not None and y in (0, 1))
    held = Counter(toxic.tolist())
    stands = np.array([totals[y] / held[y] for y in toxic])
    df = Counter(w for b in bags for w in b if w in set(words))
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    weight = {}
    for w in words:
        a, b = sum(y for o, y in zip(own, toxic) if w in o), sum(1 - y for o, y in zip(own, toxic) if w in o)
        p = (a + b) / (n1 + n0)
        g = 2 * sum(x * math.log(x / e) for x, e in ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p))) if x > 0 and e > 0) if n1 and n0 else 0
        weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * (1 + math.sqrt(max(g, 0)))

    def unit(bag):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in bag.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    vectors = [unit(o) for o in own]
    share = (stands * toxic).sum() / stands.sum()
    bare = [not v for v in vectors]
    alone = ((stands * toxic)[bare].sum() + share) / (stands[bare].sum() + 1)
    scores = []
    for bag in bags:
        v = unit(bag)
        if not v:
            scores.append(alone)
            continue
        cosines = np.array([sum(x * o.get(w, 0.0) for w, x in v.items()) for o in vectors])
        # Of one cosine those votes count alike, so only the set of the nearest matters up to ties.
        best = np.argsort(-cosines, kind="stable")[: tx.NEAREST]
        vote = cosines[best] * stands[best] / stands[[not x for x in bare]].mean()
        scores.append(((vote * toxic[best]).sum() + tx.SMOOTHING * share) / (vote.sum() + tx.SMOOTHING))
    return scores


@pytest.mark.parametrize("block", [128, 8])
def test_query_against_plain_cosines(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(tx, "BLOCK", block)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    want = dict(zip([d for d, _ in docs], plain(docs, [x for x in labels if not out(x[0])])))
    got = contract.queries()["op2_toxicity"](spark, sf_dir).collect()
    assert len(got) == len(docs) and all(r.held_out == out(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    off = [r.doc_id for r in got if abs(r.score - want[r.doc_id]) > 1e-9]
    # Equal cosines at the edge of the nearest may be of other labels.
    assert len(off) <= len(docs) // 50


def test_blocks_give_the_exact_nearest():
    rng = np.random.default_rng(5)
    f = [np.unique(rng.integers(0, 60, rng.integers(0, 9))) for _ in range(500)]
    tf = [rng.integers(1, 4, len(x)) for x in f]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in f])])
    flat_f, flat_tf = np.concatenate(f).astype(np.int64), np.concatenate(tf)
    weight = np.linspace(1, 3, 60)
    index = tx.BlockMax(starts, flat_f, flat_tf, rng.integers(0, 2, 500).astype(float), np.ones(500), np.arange(500), weight)
    number, cosine = index.nearest(starts, flat_f, flat_tf, 10)
    full = np.zeros((500, 60))
    full[np.repeat(np.arange(500), np.diff(starts)), flat_f] = tx.unit(flat_f, flat_tf, starts, weight)
    every = full @ full[index.ids].T
    for q in range(500):
        want = np.sort(every[q][every[q] > 0])[::-1][:10]
        assert np.allclose(cosine[q][: len(want)], want) and (number[q] >= 0).sum() == len(want)
        good = number[q] >= 0
        assert np.allclose(every[q][number[q][good]], cosine[q][good])
        assert len(set(number[q][good])) == len(want)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{'abcdefghij'[int(x)]}{'klmno'[int(y)]}" for x, y in rng.integers(0, 5, (30, 2))) + (" vile" if i % 5 == 0 else "")) for i in range(300)]
    rows += [(None, None), (900, ""), (901, "VILE!"), (902, "vile " * 60_000), (7, "other text of id seven"), (902, "123 456")]
    docs = spark.createDataFrame([(*r, 1.5, ["x"]) for r in rows], "doc_id bigint, text string, score double, evidence array<string>")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(3, None), (None, 1), (12345, 1)], "doc_id bigint, toxic int")
    arrays, every = tx.fit(docs, labels, lambda d: d.select("doc_id", "text"))
    out = tx.scored(every, arrays).collect()
    got = {r.doc_id: r.score for r in out}
    assert len(out) == len(rows) and all((got[i] >= 0.3) == (i % 5 == 0) for i in range(200, 300))
    assert got[901] > 0.5 > got[900] and got[None] == got[900] and all(0 <= s <= 1 for s in got.values())
    assert all(r.evidence for r in out if r.doc_id in range(300))
    arrays, every = tx.fit(docs.limit(0), labels.limit(0), lambda d: d)
    assert tx.scored(every, arrays).count() == 0
    arrays, every = tx.fit(docs, labels.limit(0), lambda d: d.select("doc_id", "text"))
    assert {r.score for r in tx.scored(every, arrays).collect()} == {0.0}


def test_scores_read_as_rates(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in contract.queries()["op2_toxicity"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    score, toxic, said = map(np.array, zip(*rows))
    assert toxic[said == 1].mean() > 0.9 and said[toxic == 1].mean() > 0.8
    for lo, hi in ((0, 0.2), (0.8, 1.01)):
        some = (score >= lo) & (score < hi)
        assert abs(score[some].mean() - toxic[some].mean()) < 0.1
