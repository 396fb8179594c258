"""Two-level cells against brute force."""

import tracemalloc

import numpy as np
import pytest
from test_knn import brute, lists

from mailrank.operators import cells as ce
from mailrank.operators import knn
from mailrank.session import fresh_path

N, Q, DIM = 1500, 12, 16


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(40, DIM)) * 2
    matrix = (homes[rng.integers(0, 40, N)] + rng.normal(size=(N, DIM))).astype(np.float32)
    matrix[5] = 0
    queries = (homes[rng.integers(0, 40, Q)] + rng.normal(size=(Q, DIM))).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "doc_id BIGINT, vec ARRAY<FLOAT>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid BIGINT, vec ARRAY<FLOAT>")
    made = ce.build_cells(vectors, n_coarse=5, cell_rows=40).write(fresh_path(spark, "cells"))
    return matrix, queries, vectors, asked, made


def test_every_vector_is_in_its_nearest_cell(data):
    matrix, _, vectors, _, made = data
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    coarse = {r.cell: unit(np.array(r.center)) for r in made.coarse.collect()}
    fine = {r.doc_id: (r.cell, unit(np.array(r.vec))) for r in made.fine.collect()}
    rows = made.vectors.collect()
    assert sorted(r.doc_id for r in rows) == [i for i in range(N) if i != 5] and len(fine) >= N // 50
    for r in rows:
        v = unit(matrix[r.doc_id].astype(float))
        assert v @ coarse[r.coarse] >= max(v @ c for c in coarse.values()) - 1e-6
        assert fine[r.cell][0] == r.coarse
        assert v @ fine[r.cell][1] >= max(v @ c for home, c in fine.values() if home == r.coarse) - 1e-6


def test_shuffled_assignment_is_the_same(data):
    _, _, vectors, _, made = data
    cells = {r.doc_id: (r.coarse, r.cell) for r in made.vectors.collect()}
    other = ce.assign(vectors, made.coarse, made.fine, sent_floats=1).vectors
    assert {r.doc_id: (r.coarse, r.cell) for r in other.collect()} == cells


def test_all_cells_are_exact_and_chosen_ones_reach_the_recall(data):
    matrix, queries, _, asked, made = data
    exact = brute(matrix, queries, 10)
    n_fine = made.fine.count()
    assert lists(ce.knn_cells(made, asked, 10, n_fine, 5)) == exact
    for target in (0.9, 0.99):
        nprobe, coarse_probes, said = ce.choose_probes(made, asked, 10, target)
        few = lists(ce.knn_cells(made, asked, 10, nprobe, coarse_probes))
        shuffled = lists(ce.knn_cells(made, asked, 10, nprobe, coarse_probes, query_floats=1, chunk_rows=100, block_queries=2))
        recall = np.mean([len(set(few[q]) & set(exact[q])) / 10 for q in exact])
        assert few == shuffled and recall >= target and abs(recall - said) < 1e-9
    assert ce.choose_probes(made, asked, 10, 0.9)[0] < n_fine // 2


def test_registered_query_keeps_its_recall(spark, sf_dir):
    from checks.queries import QUERIES

    few, exact = lists(QUERIES["knn_ivf_few_cells"](spark, sf_dir)), lists(QUERIES["knn_exact"](spark, sf_dir))
    assert np.mean([len(set(few[q]) & set(exact[q])) / len(exact[q]) for q in exact]) >= 0.9


def test_whole_search_is_exact_from_any_first_cells(data, spark):
    matrix, queries, vectors, asked, made = data
    exact = lists(knn.knn(vectors, asked, 10))
    assert exact == brute(matrix, queries, 10)
    assert lists(ce.knn_cells(made, asked, 10, 1, 1)) != exact
    for options in ({}, {"query_floats": 1, "chunk_rows": 100, "block_queries": 2}):
        assert lists(ce.knn_cells(made, asked, 10, 1, 1, whole=True, **options)) == exact
    # Cells that cannot hold a neighbour stay closed: a floor that only their own vectors reach.
    floors = asked.withColumn("floor", ce.F.lit(0.9))
    opened = {(r.qid, r.cell) for r in ce._open_cells(ce.cell_reach(made), floors).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    homes = {r.doc_id: r.cell for r in made.vectors.collect()}
    scores = unit(queries.astype(float)) @ unit(matrix.astype(float) + (np.arange(N) == 5)[:, None]).T
    assert {(q, homes[i]) for q, i in zip(*np.nonzero(scores >= 0.9)) if i in homes} <= opened
    assert len(opened) < Q * made.fine.count()
    few = spark.createDataFrame([(q, 3) for q in range(Q)], "qid BIGINT, max_results INT")
    assert lists(ce.knn_cells(made, asked, 10, 1, 1, limits=few, whole=True)) == {q: ids[:3] for q, ids in exact.items()}


def test_registered_query_finds_all_neighbours(spark, sf_dir):
    from checks.queries import QUERIES

    assert lists(QUERIES["knn_ivf_few_cells"](spark, sf_dir)) == lists(QUERIES["knn_exact"](spark, sf_dir))


def test_more_cells_than_any_bound_are_measured(spark):
    """5,000 cells, whose vectors lie opposite to their centres: the nearest one is in the last cell."""
    angles = np.arange(5_000) * np.pi / 5_000
    centres = [[float(np.cos(a)), float(np.sin(a))] for a in angles]
    fine = spark.createDataFrame([(i, c, 0) for i, c in enumerate(centres)], "doc_id INT, vec ARRAY<DOUBLE>, cell INT")
    vectors = spark.createDataFrame([(i, [-x for x in c], 0, i) for i, c in enumerate(centres)], "doc_id BIGINT, vec ARRAY<DOUBLE>, coarse INT, cell INT")
    coarse = spark.createDataFrame([(0, [1.0, 0.0])], "cell INT, center ARRAY<DOUBLE>")
    made, asked = ce.Cells(coarse, fine, vectors), spark.createDataFrame([(7, [1.0, 0.0])], "qid BIGINT, vec ARRAY<DOUBLE>")
    nprobe, coarse_probes, recall = ce.choose_probes(made, asked, 1, 0.9)
    assert (nprobe, recall) == (5_000, 1.0)
    assert lists(ce.knn_cells(made, asked, 1, nprobe, coarse_probes)) == {7: [4_999]}
    assert lists(ce.knn_cells(made, asked, 1, 1, 1, whole=True)) == {7: [4_999]}


def test_whole_search_of_no_vectors_and_of_equal_ones(spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "qid BIGINT, vec ARRAY<DOUBLE>")
    none = ce.build_cells(spark.createDataFrame([], "doc_id BIGINT, vec ARRAY<FLOAT>"))
    assert ce.knn_cells(none, asked, 3, 1, 1, whole=True).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)] + [(40, None), (41, [0.0, 0.0])], "doc_id BIGINT, vec ARRAY<FLOAT>")
    made = ce.build_cells(same, n_coarse=1, cell_rows=5)
    assert lists(ce.knn_cells(made, asked, 50, 1, 1, whole=True)) == {0: list(range(30))}


def test_no_vectors_and_equal_vectors(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, vec ARRAY<FLOAT>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid BIGINT, vec ARRAY<FLOAT>")
    made = ce.build_cells(none)
    assert ce.choose_probes(made, asked, 3)[2] == 1.0 and ce.knn_cells(made, asked, 3, 1, 1).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)] + [(40, None), (41, [0.0, 0.0])], "doc_id BIGINT, vec ARRAY<FLOAT>")
    made = ce.build_cells(same, n_coarse=1, cell_rows=5)
    assert lists(ce.knn_cells(made, asked, 3, 1, 1)) == {0: [0, 1, 2]} == lists(knn.knn(same, asked, 3))


def test_fitting_holds_a_bounded_number_of_scores():
    units = knn._unit(np.random.default_rng(5).normal(size=(20_000, 8)))[0]
    tracemalloc.start()
    centres = ce._lloyd(units, 1_500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centres) == 1_500 and peak < 100_000_000  # all scores at once are 240 MB
