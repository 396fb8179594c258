"""Token files against the library on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mailrank.llm import token_files as tf
from mailrank.session import fresh_path

P = pytest.importorskip("public_tokenizers")
ODD = [
    "a b  c", "İstanbul don't <|endoftext|> x", "", None, "é ́x", "\x1c a\x1db", "Σας ΣΑΣ ", "tab\tnew\nline  two  ",
    "1234 5'll I'LL'D ''s .'s", "a<|startoftext|>b <| |>", "\xa0a b\xa0 c　", "ﬁ ǅ ß ẞ  \x00z", " lead", "x " * 5,
    "日本語 テキスト", "ª²³ ¼ É'S Ñandú,¡hola!", "\x85 n  x", "z" * 5000, " " * 300,
]


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_encoder_gives_the_ids_of_whole_texts():
    texts = ODD + ["".join(x or "" for x in ODD), " ".join(x or "" for x in ODD)]
    ids, n = tf.WordEncoder(P.path("word_bpe_49k.json"), 1).column(pa.array(texts))
    cut = np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in cut] == brute(texts)


def test_splitting_of_odd_words():
    """Endings after a quote, digits, marks, letters whose lower case is longer."""
    rng = random.Random(1)
    signs = list("sStTrReEvVlLmMdDaz  0139.,-!_<|>\n\t\x7f\x00\x1f") + ["'"] * 9 + list("äÖßéÀ×÷ªº²½ĲŉǅȺȾɐƁʼ\x85\xa0İıſ日本Ω")
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(5_000)]
    texts += ["'", "''s", "x'll'd", "'re'", "'r e", "'s's", "1'2", "don't WE'VE"]
    ids, n = tf.WordEncoder(P.path("word_bpe_49k.json"), 1).column(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == brute(texts)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_all_documents_in_order(spark, encoding):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "y"), (3, "again", "y"), (None, "none", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    path = fresh_path(spark, "tokens")
    tf.write_tokens(docs, path, P.path("word_bpe_49k.json"), 1, encoding)
    got = sorted(tf.with_crc32(tf.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: -1 if x is None else x)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in brute([r[1] for r in rows])}
    assert {r.ids_crc32 for r in got} == want
    assert start == sum(map(len, brute([r[1] for r in rows])))


def test_no_rows(spark):
    path = fresh_path(spark, "tokens")
    tf.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path, P.path("word_bpe_49k.json"), 1)
    assert tf.read_tokens(spark, path).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    got = tf.op3_token_files(spark, sf_dir).toPandas().sort_values("doc_id")
    ids = brute(docs.text)
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == (np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
