"""Suffix arrays and repeated windows against sorting and sets."""

import numpy as np

from mailrank.llm import suffixes as sx


def some_strings(rng):
    k = int(rng.integers(1, 4))
    made = [bytes(rng.integers(97, 97 + k, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
    off = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)
    return made, np.frombuffer(b"".join(made), np.uint8), off


def test_order_of_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(400):
        _, data, off = some_strings(rng)
        s, order = sx.suffix_array(data, off, 1000)
        text = s.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows():
    rng = np.random.default_rng(2)
    for length in (8, 13):
        for _ in range(200):
            made, data, off = some_strings(rng)
            start = rng.permutation(len(made)).astype(np.int64) * 1000
            first = {}
            for q in np.argsort(start).tolist():
                for p in range(len(made[q]) - length + 1):
                    first.setdefault(made[q][p : p + length], (q, p))
            every = [(q, p) for q in range(len(made)) for p in range(len(made[q]) - length + 1)]
            want = [(q, p) for q, p in every if first[made[q][p : p + length]] != (q, p)]
            got = sx.repeated_windows(data, off, start, length)
            assert sorted(zip(*(x.tolist() for x in got))) == want
