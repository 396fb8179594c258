"""Vector search against brute force, over both ways and all layouts."""

import numpy as np
import pytest

from mailrank.operators import ivf, knn, quantise

DIM, N, Q = 12, 700, 9


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(N, DIM)).astype(np.float32)
    matrix[::3] = matrix[0]  # a third of all vectors are copies
    matrix[5] = 0
    queries = rng.normal(size=(Q, DIM)).astype(np.float32)
    queries[1] = matrix[0]
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "doc_id BIGINT, vec ARRAY<FLOAT>")
    asked = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(queries)], "qid BIGINT, vec ARRAY<FLOAT>")
    return matrix.astype(float), queries.astype(float), frame.repartition(6).cache(), asked.cache()


def brute(matrix, queries, k):
    size = np.linalg.norm(matrix, axis=1)
    ids = np.flatnonzero(size > 0)
    scores = np.round((matrix[ids] / size[ids, None]) @ (queries / np.linalg.norm(queries, axis=1)[:, None]).T, 9)
    found = {}
    for q in range(len(queries)):
        order = np.lexsort((ids, -scores[:, q]))[:k]
        found[q] = [int(i) for i in ids[order]]
    return found


def lists(df):
    found = {}
    for r in df.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.doc_id)
    return found


@pytest.mark.parametrize("k", [1, 7, 300, N + 5])
def test_exact(data, k):
    matrix, queries, vectors, asked = data
    assert lists(knn.knn(vectors, asked, k)) == brute(matrix, queries, k)


@pytest.mark.parametrize("k", [1, 7, 300])
def test_exact_when_queries_are_too_many_to_send(data, k):
    matrix, queries, vectors, asked = data
    found = knn.knn(vectors, asked, k, query_floats=1, chunk_rows=100, block_queries=2)
    made = found._jdf.queryExecution().executedPlan().toString()
    # Vectors are scored where they are; what is shuffled are the candidates above.
    assert "MapInArrow" in made and "Exchange" not in made.split("MapInArrow")[1].split("InMemoryTableScan")[0]
    assert lists(found) == brute(matrix, queries, k)


def test_limits_per_query(spark, data):
    matrix, queries, vectors, asked = data
    limits = spark.createDataFrame([(q, q + 1) for q in range(Q)], "qid BIGINT, max_results INT")
    want = {q: ids[: q + 1] for q, ids in brute(matrix, queries, Q).items()}
    assert lists(knn.knn(vectors, asked, Q, limits=limits)) == want


def test_cells(spark, data, tmp_path):
    matrix, queries, vectors, asked = data
    ivf.write_ivf(*ivf.build_ivf(vectors, 6), str(tmp_path))
    centroids, cells = ivf.read_ivf(spark, str(tmp_path))
    n_cells = centroids.count()
    rows = cells.collect()
    assert sorted(r.doc_id for r in rows) == [i for i in range(N) if i != 5]
    centers = {r.cell: np.array(r.center) for r in centroids.collect()}
    for r in rows:
        near = max(centers, key=lambda c: round(matrix[r.doc_id] @ centers[c] / np.linalg.norm(centers[c]), 9))
        best, mine = (matrix[r.doc_id] @ centers[c] / np.linalg.norm(centers[c]) for c in (near, r.cell))
        assert abs(best - mine) < 1e-6
    assert lists(knn.knn_ivf(cells, centroids, asked, 10, n_cells)) == brute(matrix, queries, 10)
    few = lists(knn.knn_ivf(cells, centroids, asked, 10, 3))
    shuffled = lists(knn.knn_ivf(cells, centroids, asked, 10, 3, query_floats=1, chunk_rows=100, block_queries=2))
    assert few == shuffled
    exact = brute(matrix, queries, 10)
    recall = np.mean([len(set(few[q]) & set(exact[q])) / 10 for q in exact])
    assert recall > 0.6


def test_cells_prune_partitions(spark, data, tmp_path):
    _, _, vectors, asked = data
    ivf.write_ivf(*ivf.build_ivf(vectors, 6), str(tmp_path))
    centroids, cells = ivf.read_ivf(spark, str(tmp_path))
    plan = knn.knn_ivf(cells, centroids, asked.where("qid = 0"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_int8(data):
    matrix, queries, vectors, asked = data
    bounds = quantise.value_bounds(vectors)
    assert bounds == (matrix.min(), matrix.max())
    codes = quantise.quantise_int8(vectors, bounds).cache()
    report = quantise.quantisation_error(vectors, codes, bounds).first()
    assert report.max_error <= (bounds[1] - bounds[0]) / 127 / 2 + 1e-9
    assert report.float_bytes == 4 * report.code_bytes
    assert lists(knn.knn_int8(codes, bounds, asked, 10, vectors=vectors, oversample=N)) == brute(matrix, queries, 10)
    back = {r.doc_id: np.array(r.vec) for r in quantise.dequantise(codes, bounds).collect()}
    decoded = np.array([back[i] for i in range(N)])
    assert np.abs(decoded - matrix).max() <= report.max_error + 1e-6


def test_quantile_bounds_are_narrower(data):
    lo, hi = quantise.value_bounds(data[2], 0.9)
    full = quantise.value_bounds(data[2])
    assert full[0] < lo < hi < full[1]


@pytest.mark.parametrize("floats", [knn.QUERY_FLOATS, 1])
def test_null_and_odd_vectors(spark, floats):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (6, []), (7, [1.0, None, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id BIGINT, vec ARRAY<FLOAT>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, None)], "qid BIGINT, vec ARRAY<FLOAT>")
    assert lists(knn.knn(vectors, asked, 9, query_floats=floats, drop_odd=True)) == {0: [1, 4]}
    with pytest.raises(Exception, match="against queries of 3"):
        knn.knn(vectors, asked, 9, query_floats=floats).collect()
