"""Nulls, ties, repeated rows, empty tables and clashing columns of the operators with SQL forms."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailrank.llm import byte_bpe, chat, mixing, quality, vector_search, warc
from mailrank.llm.common import written
from mailrank.session import fresh_path


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "\\#<: </turn>\n### user:", 9), (1, 0, "us:er\\", "hé", 9), (1, 2, None, None, 9), (1, 2, "assistant", "x", 9),
        (None, None, "assistant", "", 9), (2, 0, "assistant", "end\\", 9), (2, 0, "assistant", "end\\", 9),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    assert set(got) == {1, 2, None} and got[1].n_turns == 4 and got[2].n_turns == 2
    assert got[1].turns_sha256 == sha("us:er\\\nhé\n", "assistant\n\\#<: </turn>\n### user:\n", "\n\n", "assistant\nx\n")
    assert got[1].loss_sha256 == sha("\\#<: </turn>\n### user:x") and got[1].loss_chars == 23
    assert got[2].loss_sha256 == sha("end\\end\\") and got[None].loss_chars == 0
    text = "".join(r.formatted for r in chat.format_chats(turns.where("conv_id = 1")).orderBy("first_turn", "part").collect())
    assert text.count("### ") == 4 and text.count("</turn>") == 4
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_one_long_conversation_is_formatted_by_many_tasks(spark):
    turns = spark.range(3000).select(F.lit(5).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                     F.concat(F.lit("t"), "id").alias("text"))
    parts = chat.format_chats(turns)
    assert parts.count() > 1
    assert chat.read_back(parts).first().loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(3000)).encode()).hexdigest()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [nan, 1.0]), (3, [1.0, None]), (4, None), (5, [inf]),
            (6, []), (None, [1.0]), (7, [-1.0, 0.25, 9.0])]
    v = written(vector_search.quantised(spark.createDataFrame(rows, "k bigint, e array<double>"), "k", "e"), "v")
    got = vector_search.top_k(v.where("id % 100 = 0"), v, 3).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    one = 1024 * 1024
    assert found[0] == [(1, one + one // 4), (1, one + one // 4), (6, 0)]
    assert found[100] == [(0, 0), (1, 0), (1, 0)]
    assert vector_search.top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_branch_and_bound_against_brute_force():
    rng = np.random.default_rng(0)
    q, v = rng.integers(-900, 900, (20, 40)), rng.integers(-900, 900, (5000, 40))
    v[::7] = v[3]
    cell = vector_search.Cell(np.arange(20), q, 10)
    for a in range(0, 5000, 900):
        cell.meet(np.arange(a, min(a + 900, 5000)), v[a : a + 900])
    scores = q @ v.T
    for i in range(20):
        want = [j for j in np.lexsort((np.arange(5000), -scores[i])) if j != i][:10]
        assert cell.best[i][1].tolist() == want and cell.best[i][0].tolist() == scores[i][want].tolist()


def test_huge_components_do_not_crash():
    cell = vector_search.Cell(np.array([0]), np.array([[2**40, 1]]), 2)
    cell.meet(np.array([1, 2]), np.array([[2**20, 3], [2**20, 5]]))
    assert cell.best[0][1].tolist() == [2, 1]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_docs(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None, "en", "src1", 0), (2, "", None, None, 0), (3, long, "en", "src1", 9), (3, long, "en", "src1", 9),
            (4, ("a b c d e f g h " * 9) + long[:40], "de", "src2", 9), (None, long + " x y z", "fr", None, 9), (5, "same line\nsame line\n \n" + long, "en", "src1", 9)]
    return spark.createDataFrame(rows, DOCS)


def test_quality(spark):
    docs = odd_docs(spark).withColumn("n_words", F.lit("clash")).withColumn("host_rejected", F.lit(1))
    got = [r.asDict() for r in quality.judged(written(quality.measured(docs), "q")).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["base_failed"] and by[1]["n_words"] == 0 and not by[2]["kept"]
    assert by[4]["n_repeat_words"] == 72 and by[4]["base_failed"] and by[3]["kept"] and by[None]["kept"]
    assert by[5]["n_dup_lines"] == 1
    assert quality.judged(written(quality.measured(docs.limit(0)), "q")).count() == 0


def test_host_verdicts_shrink(spark):
    rows = [(f"h{h}", i < bad) for h, n, bad in ((0, 200, 190), (1, 200, 4), (2, 1, 1), (3, 300, 3), (4, 200, 2)) for i in range(n)]
    got = {r.source: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert got["h0"].host_rejected and not got["h1"].host_rejected
    assert got["h2"].host_rate < 1.0 and abs(got["h1"].host_rate - 0.02) < 0.01


def test_mixing(spark):
    docs = mixing.keyed(odd_docs(spark))
    sizes = written(docs.select(*mixing.SIZES), "s")
    budgets = mixing.leaf_budgets(sizes, 500, mixing.WEIGHTS, 3, mixing.LEVELS)
    got = mixing.select(sizes, mixing.cuts(sizes, budgets, 1, mixing.LEVELS), 1, mixing.LEVELS).collect()
    want = {tuple(r[:3]): r.budget for r in budgets.select(*mixing.LEVELS, "budget").collect()}
    assert sum(want.values()) == 500
    taken = dict.fromkeys(want, 0)
    for r in got:
        taken[(r.domain, r.lang, r.source)] += r.take_tokens
    # Repeated rows share what is left, which may lose a remainder of less than their number.
    assert all(0 <= want[k] - taken[k] <= 1 for k in want)
    none = written(sizes.limit(0), "s")
    assert mixing.mixed(none, none).count() == 0
    assert mixing.stage(spark, odd_docs(spark), "").columns == odd_docs(spark).columns


def test_shortages_go_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000), ("d1", "fr", "d", 1000)]
    sizes = written(spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint"), "s")
    got = {r.source: r.budget for r in mixing.leaf_budgets(sizes, 800, {}, 1, mixing.LEVELS).collect()}
    assert got == {"a": 10, "b": 390, "c": 200, "d": 200}


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://b.example/p?q=1", big, 0), (2, "http://a.example/\r\nX: y", big, 0), (3, None, None, 0), (None, "odd é", big, 0),
            (4, "http://b.example/p?q=1", "small\r\n\r\nrest", 0), (5, "z", "small\r\n\r\nrest", 0), (2, "http://c.example", big, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    folder = fresh_path(spark, "warc")
    warc.write_archives(warc.captures(pages), folder)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == 7
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got) == [
        (-1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0)]
    assert {r.payload_bytes for r in got if r.page_id == 1} == {1500}
    found = warc.read_archives(spark, folder, ["http://b.example/p?q=1", "http://none.example"]).collect()
    assert sorted(r.page_id for r in found) == [1, 4]
    assert [bytes(r.payload) for r in found if r.page_id == 4] == [b"small\r\n\r\nrest"]
    folder = fresh_path(spark, "warc")
    warc.write_archives(warc.captures(pages.limit(0)), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_warc_reads_only_what_is_asked(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.format_string("http://h%d.example/p%d", F.col("id") % 40, F.col("id")).alias("url"),
        F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 512)).alias("html"), F.lit("x").alias("key"), F.lit(1).alias("refers_to"))
    folder = fresh_path(spark, "warc")
    warc.write_archives(warc.captures(pages), folder)
    asked = [f"http://h{i % 40}.example/p{i}" for i in (7, 1900)] + ["http://h7.example/none"]
    blocks = warc.blocks_with(spark, folder, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    read, size = [], sum(r.archive_length for r in spark.read.parquet(f"{folder}/directory").collect())

    def counted(path, offset, length):
        read.append((path, length))
        return warc.read_range(path, offset, length)

    found = [r for b in blocks for r in warc.read_block(b.asDict(), counted)]
    assert sorted(r["page_id"] for r in found) == [7, 1900] and len(blocks) <= 3
    assert sum(n for p, n in read if p.endswith(".warc.gz")) < size / 500
    # A table of URLs: all pages, some twice, each capture once.
    every = warc.read_archives(spark, folder, pages.select("url").union(pages.select("url").limit(50)), payloads=False)
    assert sorted(r.page_id for r in every.collect()) == list(range(3000)) and "payload" not in every.columns


def test_pipeline_stages_on_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "stage")
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
    out = byte_bpe.stage(spark, docs, "").collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("budget", [10**9])
def test_budget_beyond_the_corpus(spark, budget):
    sizes = written(mixing.keyed(odd_docs(spark)).select(*mixing.SIZES), "s")
    got = mixing.leaf_budgets(sizes, budget, mixing.WEIGHTS, 2, mixing.LEVELS).collect()
    assert all(r.budget == 2 * r.held for r in got)
