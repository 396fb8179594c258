"""Keyword, fused and structured searches against plain Python over a small mail set."""

import math
import time
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from mailrank import session
from mailrank.functions.text import word_tokens
from mailrank.operators import embed, fusion, hits, index, ivf, keyword, knn, match, quantise
from mailrank.operators.queries import normalise_queries, target_terms
from mailrank.plans.build import build_search_tables, derive_search_tables, open_search_tables
from mailrank.plans.search import hybrid_search, keyword_search
from mailrank.plans.vector_index import build_vector_index

MAILS = [
    (0, "user3@example.com", "the budget meeting the budget"),
    (1, "user3@example.com", "a plan for example.com and the budget, call 713-853-1234"),
    (2, "User3@example.com", "lunch"),
    (3, "ann@x.org", "budget user3 wrote: the plan"),
    (4, "", ""),
    (5, "bob@x.org", "(713) 853 1234"),
    (6, "bob@x.org", " ... "),
    *[(i, "hot@x.org", "hot copy of the plan") for i in range(7, 40)],
]
QUERIES = [
    (1, "project discussion", "-", 20),
    (2, "financial meeting", "user3@example.com", 20),
    (3, "-", "user3@example.com", 20),
    (4, "-", "-", 20),
    (5, "x", " USER3@EXAMPLE.COM ", 0),
    (6, "-", "713-853-1234", 5),
    (7, "-", "hot@x.org", 4),
    (8, None, "budget budget plan", 3),
    (9, "  ", " \t", 3),
]


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(i, f"<{i}>", f, "n", "t", f"s{i}", b, 1000 * i, i % 2 == 0, "l") for i, f, b in MAILS]
    return spark.createDataFrame(
        rows,
        "doc_id BIGINT, message_id STRING, from_email STRING, from_name STRING, all_recipients STRING, "
        "subject STRING, body_content STRING, timestamp_ms BIGINT, has_attachments BOOLEAN, labels STRING",
    ).repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid BIGINT, query_text STRING, target STRING, max_results INT")


@pytest.fixture(scope="module")
def tables(mails, spark):
    return build_search_tables(mails, embed.hash_embedder(), session.fresh_path(spark, "tables"), 4)


@pytest.fixture(scope="module")
def words(mails):
    rows = mails.select("doc_id", word_tokens(F.col("body_content")).alias("w")).collect()
    return {r.doc_id: r.w for r in rows}


def idf(n, df):
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def brute_keyword(words, terms, k):
    """``terms`` is (field, term) to how often it is asked."""
    bodies = {d: w for d, w in words.items() if w}
    avg = sum(map(len, bodies.values())) / len(bodies)
    exact = {"sender_email": {i: f for i, f, _ in MAILS if f}, "phone_num": {1: "7138531234", 5: "7138531234"}}
    scores = defaultdict(float)
    for (field, term), n in terms.items():
        if field == "body_text":
            df = sum(term in w for w in bodies.values())
            for d, w in bodies.items():
                tf = w.count(term)
                if tf:
                    scores[d] += n * idf(len(bodies), df) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        else:
            found = [d for d, t in exact[field].items() if t == term]
            for d in found:
                scores[d] += idf(len(exact[field]), len(found)) / 2.2
    return sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]


def lists(df):
    found = defaultdict(list)
    for r in df.orderBy("qid", "rank").collect():
        found[r.qid].append(r.doc_id)
    return dict(found)


@pytest.fixture(scope="module")
def wanted(queries, words):
    asked = normalise_queries(queries)
    limits = {r.qid: r.max_results for r in asked.collect()}
    terms = defaultdict(dict)
    for r in target_terms(asked).collect():
        terms[r.qid][r.field, r.term] = r.n
    return {q: found for q in terms if (found := brute_keyword(words, terms[q], limits[q]))}, terms, limits


def test_query_terms(wanted):
    _, terms, limits = wanted
    assert limits == {1: 20, 2: 20, 3: 20, 4: 20, 5: 100, 6: 5, 7: 4, 8: 3, 9: 3}
    assert set(terms) == {2, 3, 5, 6, 7, 8}
    assert terms[5] == terms[3] == {
        ("sender_email", "user3@example.com"): 1, ("body_text", "user3"): 1, ("body_text", "example.com"): 1,
    }
    assert terms[6]["phone_num", "7138531234"] == 1
    assert terms[8]["body_text", "budget"] == 2


@pytest.mark.parametrize("small_rows", [session.SMALL_ROWS, 0])
@pytest.mark.parametrize("written", [True, False])
def test_keyword_search(monkeypatch, mails, tables, queries, wanted, small_rows, written):
    """Broadcast or shuffled, from written or derived tables: the same lists."""
    monkeypatch.setattr(session, "SMALL_ROWS", small_rows)
    used = tables if written else derive_search_tables(mails, embed.hash_embedder())
    assert lists(keyword_search(used, normalise_queries(queries), 100)) == wanted[0]


def brute_hybrid(near, keyword_lists, limits):
    fused = {}
    for q, k in limits.items():
        scores = Counter()
        for ranked in (near.get(q, [])[:k], keyword_lists.get(q, [])[:k]):
            for place, d in enumerate(ranked, 1):
                scores[d] += 1 / (60 + place)
        if scores:
            fused[q] = sorted(scores, key=lambda d: (-scores[d], d))[:k]
    return fused


@pytest.mark.parametrize("small_rows", [session.SMALL_ROWS, 0])
def test_hybrid_search(monkeypatch, tables, queries, wanted, small_rows):
    monkeypatch.setattr(session, "SMALL_ROWS", small_rows)
    keyword_lists, _, limits = wanted
    asked = embed.query_vectors(normalise_queries(queries), embed.hash_embedder())
    near = lists(knn.knn(tables.vectors.select("doc_id", "vec"), asked, 100))
    assert set(near) == {1, 2, 5}
    found = hybrid_search(tables, queries, embed.hash_embedder())
    assert lists(found) == brute_hybrid(near, keyword_lists, limits)
    row = found.where("qid = 3 AND rank = 1").first()
    assert row.message_id == f"<{row.doc_id}>" and row.timestamp_ms == 1000 * row.doc_id
    assert row.has_attachments == (row.doc_id % 2 == 0) and row.semantic_rank is None and row.keyword_rank == 1


def test_one_blank_leg_equals_the_other(tables, queries, wanted):
    only = queries.where("qid IN (3, 6, 7)")
    got = lists(hybrid_search(tables, only, embed.hash_embedder()))
    assert got == {q: wanted[0][q] for q in (3, 6, 7)}


def test_no_leg_at_all(tables, queries):
    assert hybrid_search(tables, queries.where("qid = 4"), embed.hash_embedder()).count() == 0


def test_other_vector_legs(tables, queries):
    vectors = tables.vectors.select("doc_id", "vec")
    centroids, cells = ivf.build_ivf(vectors, 3)
    bounds = quantise.value_bounds(vectors)
    codes = quantise.quantise_int8(vectors, bounds)
    made = build_vector_index(vectors, session.fresh_path(tables.docs.sparkSession, "vectors"), 3)
    legs = [
        None,
        made.leg(3, vectors, oversample=50),
        lambda q, k, limits: knn.knn_ivf(cells, centroids, q, k, 3, limits=limits),
        lambda q, k, limits: knn.knn_int8(codes, bounds, q, k, vectors=vectors, oversample=50, limits=limits),
    ]
    found = [lists(hybrid_search(tables, queries, embed.hash_embedder(), leg=leg)) for leg in legs]
    assert all(f == found[0] for f in found)


def test_mixed_case_sender_needs_a_normalised_index(mails, spark):
    terms = spark.createDataFrame([(1, "sender_email", "user3@example.com")], "qid BIGINT, field STRING, term STRING")
    for normalise, ids in ((False, [0, 1]), (True, [0, 1, 2])):
        found = keyword.match_exact(index.exact_terms(mails, normalise), terms, "sender_email")
        assert sorted(r.doc_id for r in found.collect()) == ids


def test_raw_target(tables, queries, spark):
    asked = spark.createDataFrame([(1, "", "Example.COM", 5), (2, "", "the plan", 5)], queries.schema)
    args = (tables.postings, tables.term_stats, tables.corpus_stats, asked)
    assert [(r.qid, r.doc_id) for r in keyword.match_raw_term(*args).collect()] == [(1, 1)]


def test_tables_open_again(spark, mails, queries):
    path = session.fresh_path(spark, "tables")
    built = build_search_tables(mails, embed.hash_embedder(), path, 4)
    opened = open_search_tables(spark, path)
    for name in ("docs", "exact_terms", "postings", "term_stats"):
        assert sorted(getattr(built, name).collect()) == sorted(getattr(opened, name).collect())
    assert opened.directory.rows.sort_by("file") == built.directory.rows.sort_by("file")
    # A second build replaces the first.
    build_search_tables(mails, embed.hash_embedder(), path, 4)
    assert spark.read.parquet(f"{path}/docs").count() == len(MAILS)


def test_length_in_one_byte(spark):
    kept = {}
    for n in (0, 23, 24, 39, 40, 41, 42, 56, 57, 1000, 1_000_000):
        kept[n] = spark.range(1).select(keyword.length_norm(F.lit(n), True)).first()[0]
    assert kept == {0: 0, 23: 23, 24: 24, 39: 39, 40: 40, 41: 40, 42: 42, 56: 56, 57: 56, 1000: 984, 1_000_000: 983064}


def test_report(tables, queries):
    found = hybrid_search(tables, queries, embed.hash_embedder())
    blocks = {(r.qid, r.rank): r.block for r in hits.format_hits(found, queries).collect()}
    assert blocks[4, 0] == blocks[9, 0] == hits.NO_RESULTS
    first = blocks[6, 1].split("\n")
    assert first[:3] == ["Result #1", "-" * 40, "From: n <bob@x.org>"] and "Date: Thu Jan 01 00:00:05 UTC 1970" in first


def test_fused_weights(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid BIGINT, doc_id BIGINT, rank INT")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2)], "qid BIGINT, doc_id BIGINT, rank INT")
    fused = fusion.rrf_fuse({"semantic": a, "keyword": b})
    scores = {r.doc_id: r.rrf_score for r in fused.collect()}
    assert scores == {12: 1 / 63 + 1 / 61, 10: 1 / 61, 11: 1 / 62, 13: 1 / 62}
    assert lists(knn.top_k(fused, 9, score="rrf_score", digits=None)) == {1: [12, 10, 11, 13]}
    twice = fusion.rrf_fuse({"semantic": a, "keyword": a})
    assert lists(knn.top_k(twice, 9, score="rrf_score", digits=None)) == {1: [10, 11, 12]}
    heavy = fusion.rrf_fuse({"semantic": a, "keyword": b}, weights={"keyword": 5.0})
    assert lists(knn.top_k(heavy, 1, score="rrf_score", digits=None)) == {1: [12]}


# Structured operators


def places(words, phrase, slop=0):
    """Starts from which each word of the phrase has a position of its own, by trying all ways."""
    found = {}
    for d, w in words.items():
        starts = [{p - i for p, x in enumerate(w) if x == term} for i, term in enumerate(phrase)]
        if all(starts):
            n = 0
            for x in set().union(*starts):
                near = [[s + i for s in every if x <= s <= x + slop] for i, every in enumerate(starts)]
                n += any(len(set(way)) == len(phrase) for way in product(*near))
            if n:
                found[d] = n
    return found


@pytest.mark.parametrize("small_rows", [session.SMALL_ROWS, 0])
@pytest.mark.parametrize("slop,rarest", [(0, False), (0, True), (1, False), (2, True)])
def test_phrase(monkeypatch, spark, tables, words, slop, rarest, small_rows):
    monkeypatch.setattr(session, "SMALL_ROWS", small_rows)
    phrases = {1: ["the", "budget"], 2: ["the", "plan"], 3: ["budget", "the", "budget"], 4: ["plan", "the"], 5: ["the", "the"]}
    stats = tables.term_stats if rarest else None
    found = match.match_phrase(tables.postings, match.query_words(spark, phrases), slop, tables.directory, stats)
    got = defaultdict(dict)
    for r in found.collect():
        got[r.qid][r.doc_id] = r.n_places
    assert dict(got) == {q: want for q, p in phrases.items() if (want := places(words, p, slop))}


def test_a_word_does_not_count_for_two(spark):
    texts = {1: "very good", 2: "very very good", 3: "very nice very good", 4: "very a b c very"}
    rows = [(t, d, [p for p, x in enumerate(w.split()) if x == t]) for d, w in texts.items() for t in set(w.split())]
    postings = spark.createDataFrame(rows, "term STRING, doc_id BIGINT, positions ARRAY<INT>")
    phrases = {1: ["very", "very"], 2: ["very", "good", "very"]}
    for slop in (1, 2, 3):
        got = defaultdict(dict)
        for r in match.match_phrase(postings, match.query_words(spark, phrases), slop).collect():
            got[r.qid][r.doc_id] = r.n_places
        assert dict(got) == {q: want for q, p in phrases.items() if (want := places({d: w.split() for d, w in texts.items()}, p, slop))}
    assert 1 not in got[1]


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_all_any_none(spark, tables, words):
    asked = match.query_words(spark, {1: ["the", "budget", "the"]})
    every = match.match_all(tables.postings, asked, tables.directory)
    assert ids(every) == {d for d, w in words.items() if {"the", "budget"} <= set(w)}
    some = match.match_any(tables.postings, asked, tables.directory)
    assert ids(some) == {d for d, w in words.items() if {"the", "budget"} & set(w)}
    left = match.match_none(some, tables.postings, match.query_words(spark, {1: ["plan"]}), tables.directory)
    assert ids(left) == {d for d, w in words.items() if {"the", "budget"} & set(w) and "plan" not in w}


def test_patterns(tables, words):
    def having(test):
        return {d for d, w in words.items() if any(map(test, w))}

    p = tables.postings
    assert ids(match.match_prefix(p, "pl")) == having(lambda w: w.startswith("pl"))
    assert ids(match.match_wildcard(p, "?udg*t")) == having(lambda w: w == "budget")
    assert ids(match.match_wildcard(p, "example.c*")) == having(lambda w: w == "example.com")
    assert ids(match.match_regex(p, "pla.|lunch")) == having(lambda w: w in ("plan", "lunch"))
    assert ids(match.match_range(p, "b", "c")) == having(lambda w: "b" <= w <= "c")
    assert ids(match.match_range(p, None, "budget", inclusive=False)) == having(lambda w: w < "budget")
    assert ids(match.match_range(p, "plan", None)) == having(lambda w: w >= "plan")


def test_fuzzy(tables):
    args = (tables.postings, tables.term_stats)
    assert {r.edits for r in match.match_fuzzy(*args, "budgte", 2).collect()} == {2}
    assert match.match_fuzzy(*args, "budgte", 1).count() == 0
    swapped = match.match_fuzzy(*args, "budgte", 1, swaps=True)
    assert ids(swapped) == {0, 1, 3} and {r.edits for r in swapped.collect()} == {1}


def test_postings(mails, words):
    got = defaultdict(dict)
    for r in index.postings(mails).collect():
        got[r.doc_id][r.term] = (r.tf, r.dl, r.positions)
    want = {
        d: {t: (w.count(t), len(w), [i for i, x in enumerate(w) if x == t]) for t in w} for d, w in words.items() if w
    }
    assert dict(got) == want


def test_statistics_are_sorted_and_vectors_see_the_length_asked_for(spark, mails, tmp_path):
    seen = {}
    for chars in (12, 10_000):
        path = str(tmp_path / str(chars))
        made = build_search_tables(mails, embed.hash_embedder(), path, 2, embed_chars=chars)
        seen[chars] = {r.doc_id: r.vec for r in made.vectors.collect()}
    assert seen[12] != seen[10_000]
    for stats in (made.exact_stats, made.term_stats):
        for file in stats.inputFiles():
            found = [r.term for r in spark.read.parquet(file).collect()]
            assert found == sorted(found)


def test_postings_move_once_however_many_ask(spark, tables):
    """Queries that ask for the same words add no shuffled rows, and blocks of any size give the same sums."""
    asked = spark.createDataFrame([(q, t, 1 + q % 2) for q in range(50) for t in ("the", "budget", "plan")], "qid BIGINT, term STRING, n BIGINT")
    found = keyword.bm25(tables.postings, tables.term_stats, tables.corpus_stats, asked, directory=tables.directory)
    steps = found._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in steps.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "hashpartitioning(doc_id" in shuffled[0] and "qid" not in shuffled[0]
    scores = {(r.qid, r.doc_id): r.score for r in found.collect()}
    assert len(scores) == 50 * len({d for _, d in scores}) > 0
    assert all(math.isclose(scores[q, d], scores[q % 2, d]) for q, d in scores)


@pytest.mark.parametrize("at_once, share", [(1, 8), (7, 0), (1_000, 8)])
def test_sums_of_unknown_and_repeated_documents(spark, monkeypatch, at_once, share):
    monkeypatch.setattr(keyword, "PARTS_AT_ONCE", at_once)
    monkeypatch.setattr(keyword, "CELLS_PER_PART", share)
    posted = [("a", 1, 2, 4), ("b", 1, 1, 4), ("a", 1, 1, 3), ("a", None, 1, 2), ("b", None, 1, 2), ("c", 3, 1, 1)]
    postings = spark.createDataFrame(posted, "term STRING, doc_id BIGINT, tf INT, dl INT")
    stats = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "term STRING, df BIGINT")
    corpus = spark.createDataFrame([(4, 2.5)], "n_docs BIGINT, avgdl DOUBLE")
    asked = [(7, "a", 1), (7, "b", 2), (8, "b", 1), (None, "a", 1), (9, "x", 1)]
    terms = spark.createDataFrame(asked, "qid BIGINT, term STRING, n BIGINT")
    wanted = defaultdict(float)
    for q, t, n in asked:
        for term, d, tf, dl in posted:
            if term == t:
                wanted[q, d] += n * idf(4, {"a": 3, "b": 2}[t]) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / 2.5))
    found = {(r.qid, r.doc_id): r.score for r in keyword.bm25(postings, stats, corpus, terms).collect()}
    assert found.keys() == wanted.keys() and all(math.isclose(found[k], wanted[k]) for k in wanted)


def test_texts_are_analysed_once(monkeypatch, spark, mails):
    """The sampling pass of the ranges reads postings that are there, not texts."""
    plans, ranged = [], type(mails).repartitionByRange

    def seen(df, *args):
        if "positions" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ranged(df, *args)

    monkeypatch.setattr(type(mails), "repartitionByRange", seen)
    build_search_tables(mails, embed.hash_embedder(), session.fresh_path(spark, "tables"), 4)
    assert len(plans) == 1 and "regexp" not in plans[0] and "FileScan parquet" in plans[0]


def test_sloppy_phrase_in_a_long_text(spark):
    """A start looks at those next to it: a pass over all pairs of these starts takes many minutes."""
    postings = spark.createDataFrame([("the", 1, list(range(30_000)))], "term STRING, doc_id BIGINT, positions ARRAY<INT>")
    began = time.monotonic()
    found = match.match_phrase(postings, match.query_words(spark, {1: ["the", "the"], 2: ["the"]}), 3).collect()
    assert {r.qid: r.n_places for r in found} == {1: 30_000, 2: 30_000}
    assert time.monotonic() - began < 60
