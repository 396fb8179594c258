"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailrank.llm import collocations as co


def plain(rows, least, top):
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``(text, lang)`` rows."""
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    found = [p for p, c in f.items() if c >= least and len(p) > 2]
    out = []
    for lang, *ws in found:
        a = f[(lang, *ws)]
        holders = [p for p in found if p[0] == lang and len(p) - 1 > len(ws) and f[p] >= a]
        if any(list(p[1 + i : 1 + i + len(ws)]) == ws for p in holders for i in range(len(p) - len(ws))):
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[(lang, *ws[:k])], f[(lang, *ws[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    done = []
    for lang, phrase, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            done.append((lang, ranks[lang], phrase, *rest))
    return done


def made(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Ab", "x\x1cy"]
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 60))
        text = "".join(words[int(rng.zipf(1.6)) % len(words)] + [" ", "\t ", "  ", ". ", ",", "\n"][int(rng.integers(0, 40)) % 12 % 6 if rng.random() < 0.3 else 0] for _ in range(n))
        rows.append((text + " New York city. new YORK City", ["en", None, "und", "de"][i % 4 if i % 3 else 0]))
    return [*rows, (None, "en"), ("", None), (" \t. ,", "xx")]


@pytest.mark.parametrize("seed, slice_bytes, nodes, sent", [(1, 4 << 20, 4_000_000, 1_000_000), (2, 64, 4_000_000, 0), (3, 1 << 20, 40, 1_000_000)])
def test_against_plain_counting(spark, monkeypatch, seed, slice_bytes, nodes, sent):
    monkeypatch.setattr(co, "LEAST", 4)
    monkeypatch.setattr(co, "SLICE", slice_bytes)
    monkeypatch.setattr(co, "TRIE_NODES", nodes)
    monkeypatch.setattr(co, "SENT_WORDS", sent)
    rows = made(seed)
    rows = rows + rows[:5]
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "text string, lang string, words string, own int")
    got = sorted(map(tuple, co.collocations(df, 25).collect()))
    want = sorted(plain(rows, 4, 25))
    assert len(want) > 20 and got == want


def test_nothing_frequent_and_no_rows(spark):
    df = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert co.collocations(df).count() == 0 and co.collocations(df.limit(0)).count() == 0


def test_blocks_of_one_long_text_count_every_phrase_once(monkeypatch):
    monkeypatch.setattr(co, "SLICE", 50)
    text = " ".join(f"a{i % 7}" for i in range(200)) + "." + "z" * 130 + " end"
    starts, phrases = 0, Counter()
    for data, off, langs, stop in co.blocks(pa.array([text]), pa.array(["en"])):
        found, at, new = co.tokens(data, off)
        ws = [w.as_py().decode() for w in found]
        own = int(np.searchsorted(at, stop))
        starts += own
        for i in range(own):
            for k in (2, 5):
                if i + k <= len(ws) and not new[i + 1 : i + k].any():
                    phrases[tuple(ws[i : i + k])] += 1
    pieces = [p.split() for p in text.split(".")]
    assert starts == sum(map(len, pieces))
    assert phrases == Counter(tuple(p[i : i + k]) for p in pieces for k in (2, 5) for i in range(len(p) - k + 1))


def test_double_array_holds_its_edges():
    rng = np.random.default_rng(0)
    trie, n_words = co.DoubleArray(300), 300
    edges = np.unique(rng.integers(0, 300, (4000, 2)) ** 2 // 300, axis=0)
    first = trie.add(edges[:, 0], edges[:, 1], 2)
    more = np.unique(np.stack([rng.choice(first, 3000), rng.integers(0, 300, 3000)], axis=1), axis=0)
    second = trie.add(more[:, 0], more[:, 1], 3)
    base, check = trie.arrays()
    assert len(np.unique(np.concatenate([first, second]))) == len(edges) + len(more) == trie.nodes
    to, good = co.advance(base, check, edges[:, 0], edges[:, 1])
    assert good.all() and (to == first).all()
    to, good = co.advance(base, check, more[:, 0], more[:, 1])
    assert good.all() and (to == second).all()
    held = set(map(tuple, edges.tolist()))
    every = np.array([(a, b) for a in range(n_words) for b in range(n_words)])
    _, good = co.advance(base, check, every[:, 0], every[:, 1])
    assert {tuple(x) for x in every[good].tolist()} == held
    assert not co.advance(base, check, edges[:3, 0], np.full(3, -1))[1].any()


def test_slots_stay_about_as_many_as_edges():
    """States that many spread words follow share slots instead of taking a stretch of all words each."""
    rng = np.random.default_rng(1)
    n_words = 100_000
    trie = co.DoubleArray(n_words)
    edges = np.unique(np.stack([np.repeat(np.arange(40) * 2_000, 1_000), rng.integers(0, n_words, 40_000)], axis=1), axis=0)
    new = trie.add(edges[:, 0], edges[:, 1], 2)
    base, check = trie.arrays()
    assert trie.nodes == len(edges) and len(base) - n_words < 2 * len(edges)
    to, good = co.advance(base, check, edges[:, 0], edges[:, 1])
    assert good.all() and (to == new).all()
    others = np.stack([rng.integers(0, n_words, 50_000), rng.integers(0, n_words, 50_000)], axis=1)
    held = set(map(tuple, edges.tolist()))
    assert co.advance(base, check, others[:, 0], others[:, 1])[1].tolist() == [tuple(x) in held for x in others.tolist()]


def test_counts_of_many_states_are_handed_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(co, "STATE_RUN", 2)
    monkeypatch.setattr(co, "RUNS_AT_ONCE", 3)
    trie = co.DoubleArray(30)
    states = trie.add(np.arange(29), np.arange(1, 30), 2)
    coded = spark.createDataFrame([(30, list(range(30))), (2, [4, 5, -1, 7, 8])], "own int, ids array<int>")
    counts = {r.state: r.n for r in co.accepted(coded, trie, 2).collect()}
    assert counts == {int(s): 2 if i == 4 else 1 for i, s in enumerate(states)}
