"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from mailrank.llm import byte_bpe as bb

P = pytest.importorskip("public_tokenizers")
ODD = [
    "a b  c", "İstanbul don't <|endoftext|> x", "", None, "é ́x", "\x1c a\x1db", "Σας ΣΑΣ ", "tab\tnew\nline  two  ",
    "1234 5'll I'LL'D ''s .'s", " \n \n x", "\xa0a b\xa0 c　 d", "ﬁ ǅ ß ẞ  \x00z", " lead", "x " * 5, "a  b", "a   b",
    "日本語 テキスト 🙂🙂", "ª²³ ¼ É'S Ñandú,¡hola!", "\x85 n  x", "z" * 5000, " " * 300, "ab" * 20000, "\n\n\n", "a\n\n b",
]


@pytest.fixture(scope="module")
def bpe():
    return bb.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.tokens)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(bpe):
    assert sorted(bpe.hash.key) == list(range(len(bpe.tokens)))
    assert bpe.hash.find(pa.array(bpe.tokens, pa.binary())).tolist() == list(range(len(bpe.tokens)))
    strange = [t + b"\xff\x00" for t in bpe.tokens[:5000]]
    known = set(bpe.tokens)
    found = bpe.hash.find(pa.array(strange, pa.binary()))
    assert all((i >= 0) == (s in known) for s, i in zip(strange, found))


def test_ids_are_those_of_the_library(bpe, library):
    texts = ODD + ["".join(x or "" for x in ODD), " ".join(x or "" for x in ODD)]
    ids, n = bpe.encoder().ids(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode_ordinary(t or "") for t in texts]


def check(rows, library, texts):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    want = set()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        shas = (",".join(map(str, ids)).encode(), (t or "").encode())
        want.add((i, len(ids), *(hashlib.sha256(x).hexdigest() for x in shas)))
    assert len(rows) == len(texts) and got == want


def test_rows(spark, bpe, library):
    rows = [(i, t, "kept", [1]) for i, t in enumerate(ODD)] + [(1, "again", None, None)] * 2 + [(None, "x", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids array<int>")
    encoded = bb.encode(docs, bpe)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    check(bb.digests(encoded, bpe).collect(), library, [r[:2] for r in rows])
    assert bb.digests(bb.encode(docs.limit(0), bpe), bpe).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(bb.op10_byte_bpe(spark, sf_dir).collect(), library, [tuple(r) for r in docs])
