"""Top-k over shards gives what the whole sum and a rank window give."""

import random

import pytest
from pyspark.sql import functions as F

from mailrank.operators import sharded
from mailrank.operators.index import corpus_stats, posted_lengths, postings, term_stats
from mailrank.operators.keyword import bm25
from mailrank.operators.knn import top_k

SHARDS = 6


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(400 + i, "w3 w4 w5") for i in range(30)] + [(500, "rare w1"), (501, None)]
    posted = postings(spark.createDataFrame(docs, "doc_id BIGINT, body_content STRING")).persist()
    corpus = corpus_stats(posted_lengths(posted))
    path = str(tmp_path_factory.mktemp("sharded"))
    made = sharded.build_sharded(posted, corpus, path, SHARDS)
    yield posted, term_stats(posted), corpus, made, path
    posted.unpersist()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "w1", 1), (1, "w7", 2), (2, "rare", 1), (3, "w3", 1), (3, "w4", 1), (3, "w5", 1), (4, "none", 1), (5, "w0", 1), (5, "rare", 1)]
    return spark.createDataFrame(rows, "qid BIGINT, term STRING, n BIGINT")


def rows(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 20, 1000])
def test_equals_the_whole_sum(tables, asked, k):
    posted, stats, corpus, made, _ = tables
    want = rows(top_k(bm25(posted, stats, corpus, asked), k))
    assert rows(sharded.bm25_top(made, stats, asked, k)) == want and {q for q, *_ in want} == {1, 2, 3, 5}


def test_limits_and_reopened_tables(spark, tables, asked):
    posted, stats, corpus, _, path = tables
    limits = spark.createDataFrame([(1, 2), (3, 4), (5, 9)], "qid BIGINT, max_results INT")
    again = sharded.open_sharded(spark, path)
    assert rows(sharded.bm25_top(again, stats, asked, 9, limits)) == rows(top_k(bm25(posted, stats, corpus, asked), 9, limits=limits))


def test_large_asks(tables, asked, monkeypatch):
    from mailrank import session

    posted, stats, corpus, made, _ = tables
    want = rows(top_k(bm25(posted, stats, corpus, asked), 7))
    monkeypatch.setattr(session, "SMALL_ROWS", 1)
    assert rows(sharded.bm25_top(made, stats, asked, 7)) == want


def test_nothing_asked_or_found(tables, asked):
    _, stats, _, made, _ = tables
    assert sharded.bm25_top(made, stats, asked.limit(0), 5).count() == 0
    assert sharded.bm25_top(made, stats, asked.where("term = 'none'"), 5).count() == 0


def test_a_shard_is_one_file_and_scores_are_summed_in_it(spark, tables, asked):
    _, stats, _, made, _ = tables
    held = made.postings.groupBy(F.input_file_name().alias("file")).agg(F.collect_set("shard").alias("shards")).collect()
    assert len(held) == SHARDS and all(len(r.shards) == 1 for r in held)
    found = sharded.bm25_top(made, stats, asked, 5)._jdf.queryExecution().executedPlan().toString()
    # The one shuffle is that of the rank window, which each task enters with k rows a query.
    assert found.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(qid" in found
    assert found.count("WindowGroupLimit") == 2 and f"SelectedBucketsCount: {SHARDS} out of {SHARDS}" in found


def test_shards_out_of_reach_are_not_read(spark, tables):
    _, stats, _, made, _ = tables
    one = spark.createDataFrame([(2, "rare", 1)], "qid BIGINT, term STRING, n BIGINT")
    found = sharded.bm25_top(made, stats, one, 1)
    home = made.bounds.where("term = 'rare'").first().shard
    assert f"In(shard, [{home}])" in found._jdf.queryExecution().toString() or f"EqualTo(shard,{home})" in found._jdf.queryExecution().toString()
    assert [r.doc_id for r in found.collect()] == [500]


def test_shards_grow_with_the_postings(spark, tables, asked, tmp_path, monkeypatch):
    posted, stats, corpus, _, _ = tables
    monkeypatch.setattr(sharded, "SHARD_ROWS", posted.count() // 20)
    made = sharded.build_sharded(posted, corpus, str(tmp_path))
    files = made.postings.select(F.input_file_name().alias("file"), "shard").groupBy("file").agg(F.collect_set("shard").alias("shards")).collect()
    assert len(files) >= 20 and all(len(r.shards) == 1 for r in files)
    assert rows(sharded.bm25_top(made, stats, asked, 20)) == rows(top_k(bm25(posted, stats, corpus, asked), 20))
