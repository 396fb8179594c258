"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from mailrank.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """All nodes of ``(conv_id, turn, role, text)`` rows as sorted tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: 2 * pt.DIGEST]
            own.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    node = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            node.setdefault(path[:d], []).append((c, d == len(path)))
    blanks = " \t\n\x0b\x0c\r"
    size = lambda p: len("".join("\x20" if x in blanks else x for x in p[-1][1]).split(" ")) - "".join("\x20" if x in blanks else x for x in p[-1][1]).split(" ").count("") if p else 0
    out = []
    kids = {}
    for p in node:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        stack, found = [p], []
        while stack:
            q = stack.pop()
            found.append(q)
            stack += kids.get(q, [])
        return found

    for p, members in node.items():
        under = below(p)
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.append((
            min(c for c, _ in members), len(p), min(c for c, _ in node[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
            sum(q not in kids for q in under), sum((len(node[q]) - 1) * size(q) for q in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", path string, n_words int")
    return sorted((tuple(r) for r in pt.nodes(pt.rebuilt(df)).collect()), key=str)


def made(rng, n, copies):
    """Conversations of few different turns, so that prefixes are shared at every depth; some are copies of one."""
    rows = []
    for c in range(n):
        if c in copies:
            rows += [(c, t, "user", f"same {t}") for t in range(5)]
        else:
            rows += [(c, t, "user" if t % 2 else None, f"t  {rng.integers(0, 3)}\x1cx") for t in range(rng.integers(1, 7))]
    return rows


@pytest.mark.parametrize("size, turns", [(20_000, 400_000), (7, 400_000), (1, 400_000), (50, 9)])
def test_against_a_dictionary(spark, monkeypatch, size, turns):
    monkeypatch.setattr(pt, "SHARD_ROWS", size)
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    rows = made(np.random.default_rng(size), 150, set(range(40, 100)))
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (0, None, None, None), (0, 2, "user", "b"), (0, 1, "user", "a a"), (3, 0, "user", "x"), (3, 0, "user", "x"),
        (-7, 0, "user", "x"), (-27, 1, "x", ""), (40, 0, "", " \t\n"), (41, 0, "user", None), (100, 5, "user", "y " * 20_000), (63, 0, "user", "alone"),
        (65, 0, "user", "alone"), (66, 0, "user", "alone"), (67, 0, "user", "alone"),
    ]
    rows += [(200, t, "user", f"turn {t}") for t in range(600)] + [(220, t, "user", f"turn {t}") for t in range(600)]
    got = found(spark, rows)
    assert got == plain(rows)
    # Conversations without an own first member lose their first turns; some have none left.
    assert any(r[1] == 0 and r[7] != pt.NO_ENDS for r in got)
    assert found(spark, []) == []


def test_tree_stays_low():
    paths = [[a, b] for a in range(200) for b in range(3)]
    tree = pt.Ternary()
    ends = tree.insert_sorted(paths)
    assert len(set(ends)) == 600 and [tree.walk(p)[-1] for p in paths] == ends

    def height(t):
        return 0 if t < 0 else 1 + max(height(tree.low[t]), height(tree.high[t]))

    assert height(tree.equal[0]) <= 10
    order, above, depth = tree.traverse()
    assert sorted(order) == list(range(801)) and depth.count(1) == 200 and above.count(0) == 200


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = contract.queries()["op11_conversation_trie"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
