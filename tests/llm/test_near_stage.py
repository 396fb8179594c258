"""The near-duplicate stage against similarities of all pairs."""

import numpy as np
import pyarrow as pa

from mailrank.llm import simhash as sh


def truth(texts):
    """The smallest place of each group of texts linked by a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders, label = {}, list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in holders.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            holders[g].append(i)
        if not s:
            holders.setdefault(None, []).append(i)
            met = {holders[None][0]: 1} if holders[None][0] != i else {}
        for j, n in met.items():
            if not s or 5 * n >= 4 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {root(i) for i in range(len(texts))}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"z{rng.integers(10**9)}"
    return " ".join(words)


def test_near_copies_go_and_less_alike_texts_stay(spark, monkeypatch):
    monkeypatch.setattr(sh, "NODE_ROWS", 100)
    monkeypatch.setattr(sh, "CROWDED_ROWS", 60)
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        # An edit takes five shingles: similarities of 0.97, 0.9 and 0.86 to the base, and of 0.55.
        texts += [" ".join(base), edited(rng, base, 2), edited(rng, base, 3), edited(rng, base, 4), edited(rng, base, 17)]
    base = [f"v{x}" for x in range(400)]
    texts += [edited(rng, base, 5) for _ in range(400)] + ["", None, " \n", "one", "One", "one two"]
    want = truth(texts)
    got = {r.doc_id for r in sh.stage(spark, frame(spark, texts), "").collect()}
    assert not want - got and len(got - want) <= 1


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in truth([r.text for r in rows])}
    got = {r.doc_id for r in sh.stage(spark, docs, sf_dir).collect()}
    assert not want - got and len(got - want) <= len(want) // 200


def test_two_fingerprints_are_unlike():
    h, n = sh.shingle_hashes(pa.array(["a b c d e f g h"]), 5)
    assert n.tolist() == [4] and sh.majority(h, n)[0] != sh.majority(sh.mixed_again(h), n)[0]


def test_repeated_sentences_do_not_hide_a_copy(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(150):
        base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        # The copy says one sentence of ten words three times more.
        texts += [" ".join(base), " ".join(base + base[40:50] * 3)]
    want = truth(texts)
    got = {r.doc_id for r in sh.stage(spark, frame(spark, texts), "").collect()}
    assert not want - got and len(got - want) <= 5


def test_similar_within_is_exact():
    rng = np.random.default_rng(1)
    base = rng.choice(5000, 60, replace=False)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 5000, 60), base)) for _ in range(200)]
    sets += [np.unique(rng.integers(0, 300, 20)) for _ in range(100)] + [sets[0]]
    i, j = sh.similar_within(sets)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert want and set(zip(i.tolist(), j.tolist())) == want


def test_columns_of_any_name_come_along(spark):
    import corpus_pipeline
    from mailrank.llm import repeats

    names = ["_id", "_hash", "t", "n", "label", "host_rejected", "base_failed", "kept", "spans", "room", "cut", "whole", "domain", "tokens", "epoch", "_carried", "a b"]
    long = "own � mark " + " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{i} é{i} " + long, "en", "src1", 9, *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    kept = {r.doc_id: r.text for r in repeats.stage(spark, docs, "").collect()}
    assert "�" in kept[0]
    torn = spark.createDataFrame([(1, "é" * 60 + "�", "en", "s", 1), (2, "a�é" + "é" * 60 + "b", "en", "s", 1)], docs.schema.fieldNames()[:5])
    got = {r.doc_id: r.text for r in repeats.stage(spark, torn, "").collect()}
    assert got[2].startswith("a�") and got[2].endswith("b") and "�" not in got[2][2:]
