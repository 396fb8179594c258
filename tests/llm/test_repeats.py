"""Repeated bytes against a dictionary of all windows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrank.llm import repeats as rp


def brute(texts, length=rp.LENGTH):
    """Bytes of each text that stay, in the order given, and the number of removed runs."""
    first, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            else:
                first.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(data, gone) if not g), len(data), sum(gone), runs))
    return out


def check(rows, ids, texts):
    want = [(i, n, g, r, hashlib.sha256(k).hexdigest()) for i, (k, n, g, r) in zip(ids, brute(texts))]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def result(docs):
    out = rp.without_repeats(docs)
    return out.select(
        "doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"),
        F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    ).collect()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    check(rp.op5_suffix_repeats(spark, sf_dir).collect(), [r.doc_id for r in docs], [r.text for r in docs])


def made_texts():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    passage, line = word(260), word(99)
    texts = ["", None, "x", "a" * 99, "a" * 100, "a" * 101, "a" * 2000, "ab" * 700, "é" * 300, passage, passage, word(150)]
    for i in range(60):
        texts.append(word(int(rng.integers(0, 90))) + passage[int(rng.integers(0, 120)) :] + word(30))
        texts.append(word(40) + line + word(int(rng.integers(0, 60))))
        texts.append(word(20) + "日本" * int(rng.integers(0, 40)) + passage[: 99 + i % 3])
    return texts + [passage * 3, line * 3, (word(37) + "\n") * 20]


@pytest.mark.parametrize("unit_rows", [2048, 8])
def test_made_texts(spark, monkeypatch, unit_rows):
    # With small units, crowded ones are split down to whole strings.
    monkeypatch.setattr(rp, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(rp, "SHARD_BYTES", 3000)
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, n_bytes string")
    check(result(docs.repartition(5)), list(range(len(texts))), texts)


def test_ties_nulls_and_no_rows(spark):
    rows = [(None, "q" * 30 + "r" * 130), (4, "w" * 10 + "r" * 120), (4, "s" * 200), (4, "s" * 200), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    check(result(docs), [r[0] for r in rows], [r[1] for r in rows])
    assert result(docs.limit(0)) == []


def test_stage_keeps_rows_and_whole_characters(spark):
    rows = [(1, "é" * 80, 80, "a"), (2, "xé" + "é" * 80 + "y", 83, "b"), (3, "own", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, lang string")
    got = {r.doc_id: r for r in rp.stage(spark, docs, "").collect()}
    assert docs.columns == rp.stage(spark, docs, "").columns
    assert got[1].text.startswith("é") and got[2].text == "xy" and got[2].n_chars == 2 and got[3].text == "own"
    assert all(len(r.text) == r.n_chars for r in got.values())
