import hashlib
import json
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from mailrank.functions import vectors as v
from mailrank.operators import embed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("hello",), ("é ü",), (" \n",), (None,)], "t STRING")
    made = [r.v for r in rows.select(v.hash_embedding(F.col("t")).alias("v")).collect()]
    for text, got in zip(["hello", "é ü"], made):
        digest = hashlib.sha256(text.encode()).digest()
        want = np.array([digest[i % 32] / 255 * 2 - 1 for i in range(768)])
        assert np.allclose(got, want / np.linalg.norm(want), atol=1e-6)
    assert made[2] == made[3] == [0.0] * 768


@pytest.mark.parametrize("dim", [5, 32, 70])
def test_hash_embedding_of_other_sizes(spark, dim):
    got = spark.range(1).select(v.hash_embedding(F.lit("x"), dim)).first()[0]
    assert len(got) == dim and abs(np.linalg.norm(got) - 1) < 1e-6


def test_normalise_and_cosine(spark):
    row = spark.range(1).select(
        v.l2_normalise(F.lit([3.0, 4.0])), v.l2_normalise(F.lit([0.0, 0.0])),
        v.cosine(F.lit([1.0, 0.0]), F.lit([1.0, 1.0])), v.cosine(F.lit([0.0, 0.0]), F.lit([1.0, 1.0])),
    ).first()
    assert np.allclose(row[0], [0.6, 0.8]) and row[1] == [0.0, 0.0]
    assert abs(row[2] - 0.5**0.5) < 1e-12 and row[3] is None


VOCAB = {
    "model": {"vocab": {"<bos>": 2, "<eos>": 3, "hello": 10}},
    "added_tokens": [{"content": "hello", "id": 99}, {"content": "new", "id": 11}, {"content": "new", "id": 12}],
}


@pytest.fixture()
def vocab(spark, tmp_path):
    (tmp_path / "tokenizer.json").write_text(json.dumps(VOCAB, indent=1))
    return embed.load_vocab(spark, str(tmp_path / "tokenizer.json"))


def test_vocab(vocab):
    assert {r.token: r.id for r in vocab.collect()} == {"<bos>": 2, "<eos>": 3, "hello": 10, "new": 11}


@pytest.mark.parametrize("rows", [1_000, 1])
def test_token_ids_with_small_and_large_vocabulary(spark, vocab, rows):
    docs = spark.createDataFrame(
        [(0, " Hello  zzz new "), (1, ""), (2, None), (3, "new new\nhello")], "doc_id BIGINT, t STRING"
    )
    coded = embed.encode_tokens(docs, "t", vocab, vocab_rows=rows)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {0: [2, 10, 1, 11, 3], 1: [2, 3], 2: [2, 3], 3: [2, 11, 11, 10, 3]}


@pytest.mark.parametrize("bounds", [{}, {"vocab_rows": 1}, {"vocab_bytes": 1}])
def test_token_ids_with_equal_keys_and_a_token_twice(spark, bounds):
    docs = spark.createDataFrame([(1, "a b"), (1, "b"), (1, "b"), (None, "a")], "doc_id BIGINT, t STRING")
    vocab = spark.createDataFrame([("<bos>", 2), ("<eos>", 3), ("a", 10), ("b", 12), ("b", 11)], "token STRING, id BIGINT")
    coded = embed.encode_tokens(docs, "t", vocab, **bounds)
    assert coded.columns == ["doc_id", "t", "ids"]
    got = sorted((r.doc_id or 0, r.t, r.ids) for r in coded.collect())
    assert got == [(0, "a", [2, 10, 3]), (1, "a b", [2, 10, 11, 3]), (1, "b", [2, 11, 3]), (1, "b", [2, 11, 3])]


def _toy_model():
    return lambda ids, mask: np.stack([ids, mask * 2], axis=-1).astype(np.float32)


def _one_row_model():
    return lambda ids, mask: np.stack([ids[0], mask[0] * 2], axis=-1).astype(np.float32)


@pytest.mark.parametrize("factory", [_toy_model, _one_row_model])
def test_model_embed(spark, factory):
    ids = [(0, [1, 2, 3]), (1, [4]), (2, [5, 6, 7])]
    rows = embed.model_embed(spark.createDataFrame(ids, "doc_id BIGINT, ids ARRAY<BIGINT>"), "ids", factory)
    for (_, given), row in zip(ids, rows.orderBy("doc_id").collect()):
        want = np.array([np.mean(given), 2.0])
        assert np.allclose(row.vec, want / np.linalg.norm(want), atol=1e-6)


def test_token_vectors_and_in_row_mean(spark):
    df = spark.createDataFrame([(0, [1, 3])], "doc_id BIGINT, ids ARRAY<BIGINT>")
    row = embed.model_embed(df, "ids", _toy_model, pool=False).select(
        "vec", embed.mean_pool_tokens(F.col("vec")).alias("mean")
    ).first()
    assert row.vec == [[1.0, 2.0], [3.0, 2.0]] and row["mean"] == [2.0, 2.0]
    empty = F.array().cast("array<array<float>>")
    assert spark.range(1).select(embed.mean_pool_tokens(empty, 3)).first()[0] == [0.0] * 3


def _mixing_model():
    """Each token sees the sum of its row's real ids, and garbage stands behind them."""

    def run(ids, mask):
        assert ids.shape == mask.shape and not ids[mask == 0].any()
        total = (ids * mask).sum(axis=1, keepdims=True)
        seen.append(ids.shape)
        return np.where(mask[:, :, None] > 0, np.stack([ids, total + 0 * ids, mask], axis=-1), np.nan)

    seen = []
    run.seen = seen
    return run


@pytest.mark.parametrize("budget", [1, 7, 64, 100_000])
def test_padded_blocks(spark, budget):
    rng = np.random.default_rng(budget)
    given = [(i, rng.integers(1, 50, n).tolist()) for i, n in enumerate(rng.integers(1, 30, 200))]
    given += [(900, []), (901, None), (902, rng.integers(1, 50, 3000).tolist())]
    df = spark.createDataFrame(given, "doc_id BIGINT, ids ARRAY<BIGINT>").coalesce(1)
    each = {r.doc_id: r.vec for r in embed.model_embed(df, "ids", _mixing_model, pool=False, tokens_at_once=budget).collect()}
    assert each == {d: None if ids is None else [[i, sum(ids), 1] for i in ids] for d, ids in given}
    pooled = {r.doc_id: r.vec for r in embed.model_embed(df, "ids", _mixing_model, tokens_at_once=budget).collect()}
    for d, ids in given:
        if not ids:
            assert pooled[d] is None
            continue
        want = np.array([np.mean(ids), sum(ids), 1.0])
        assert np.allclose(pooled[d], want / np.linalg.norm(want), atol=1e-6)


def test_blocks_keep_to_the_budget():
    ids = pa.array([[1] * n for n in [5, 1, 9, 2, 2, 30, 4, 4]], pa.list_(pa.int64()))
    model = _mixing_model()
    embed._pooled(model, ids, 20)
    assert sum(n for n, _ in model.seen) == len(ids) and len(model.seen) == 3
    assert all(rows * width <= 20 or rows == 1 for rows, width in model.seen)
    part = embed._per_token(model, ids.slice(2, 3), 20)
    assert [len(v) for v in part.to_pylist()] == [9, 2, 2]


def test_nothing_to_run(spark):
    df = spark.createDataFrame([(0, None), (1, [])], "doc_id BIGINT, ids ARRAY<BIGINT>")
    for rows in (df, df.limit(0)):
        assert all(r.vec is None for r in embed.model_embed(rows, "ids", _toy_model).collect())
        assert [r.vec for r in embed.model_embed(rows, "ids", _toy_model, pool=False).orderBy("doc_id").collect()] in ([None, []], [])


def _fails_on_x():
    def run(texts):
        if any("x" in t for t in texts):
            raise ValueError("no x")
        return [[float(len(t)), 0.0] for t in texts]

    return run


def test_failure_keeps_the_row(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "x"), (2, " "), (3, None)], "doc_id BIGINT, t STRING").coalesce(1)
    rows = embed.embed_column(df, "t", embed.BatchEmbedder(_fails_on_x, 2)).orderBy("doc_id").collect()
    assert [r.vec for r in rows] == [[2.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    assert [r.embed_error for r in rows] == [None, "ValueError: no x", None, None]


def test_dim_report(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([3.0],)], "vec ARRAY<FLOAT>")
    rows = {r.dim: (r.n_vectors, r.mismatch) for r in embed.dim_report(df, 1).collect()}
    assert rows == {1: (2, False), 2: (1, True)}


def test_a_joined_vocabulary_leaves_texts_where_they_are(spark, vocab, monkeypatch):
    monkeypatch.setattr(embed, "RUN_BITS", 1)
    texts = ["hello new", "zzz", "", None, "new x hello", "hello", "new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, t STRING").coalesce(2)
    coded = embed.encode_tokens(docs, "t", vocab, vocab_rows=1)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    known = {"hello": 10, "new": 11}
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: [2, *(known.get(w, 1) for w in (t or "").split()), 3] for i, t in enumerate(texts)}
