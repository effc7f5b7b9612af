"""Nearest neighbours against brute force."""

import numpy as np

from riskframe.llm.ann import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, node long, v string"


def brute(vectors, query, k=10):
    q = np.array(vectors[query], float)
    found = sorted((float(np.sqrt(((np.array(v, float) - q) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return found[:k]


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:1200] = x[7]  # one very common vector
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)]
    bad = [(5000, None, 1, ""), (5100, [0.0] * 16, 1, ""), (5200, [float("nan")] * 16, 1, ""), (5300, [None] * 16, 1, ""), (5350, [float("inf")] * 16, 1, ""), (None, [1.0] * 16, 1, "")]
    frame = spark.createDataFrame(rows + bad, SCHEMA)
    got = {}
    for r in nearest_neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = {r[0]: r[1] for r in rows}
    assert set(got) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        want = brute(vectors, q)
        assert [r for r, _, _ in found] == list(range(1, 11))
        hits += len({i for _, i, _ in found} & {i for _, i in want})
        assert all(abs(s - np.sqrt(((np.array(vectors[i], float) - np.array(vectors[q], float)) ** 2).sum())) < 1e-9 for _, i, s in found)
    assert hits >= 0.95 * 10 * len(got)
    # all ties at distance 0: the smallest ids
    assert [i for _, i, _ in got[600]] == [7, *range(500, 509)]


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (1, [1.0, 3.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(nearest_neighbours(frame).collect(), key=lambda r: r["rank"])] == [(1, 2, 0.0), (2, 1, 1.0)]
    assert nearest_neighbours(frame.limit(0)).count() == 0


def test_recall_beside_a_long_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1100
    x[8] *= 1e100
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(rows, every=10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, near in found.items():
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(near & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 60 and hits >= 0.95 * 600, hits


def recall(spark, x, every=20):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(rows, every=every).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, near in found.items():
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(near & set(np.argsort(d)[:10].tolist()))
    return hits / (10 * len(found))


def test_recall_of_clusters_and_scales(spark):
    rng = np.random.default_rng(2)
    clusters = rng.standard_normal((40, 24))[rng.integers(0, 40, 2500)] * 10 + rng.standard_normal((2500, 24)) * 0.05
    assert recall(spark, clusters) >= 0.95
    scaled = rng.standard_normal((2500, 24)) * np.exp(2 * rng.standard_normal((2500, 1)))
    assert recall(spark, scaled) >= 0.95


def test_lengths_and_asked_queries(spark):
    rows = [(0, [1.0, 2.0], ""), (1, [1.0, 2.0, 0.5], ""), (2, [4.0], ""), (3, [float("inf"), 1.0], ""), (3, [0.0, 0.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (None,), (1,)], "vec_id long")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(frame, asked).collect())
    assert got == [(1, 1, 0, 0.5), (1, 2, 2, round((9 + 4 + 0.25) ** 0.5, 6)), (2, 1, 0, round(13**0.5, 6)), (2, 2, 1, round(13.25**0.5, 6))]


def recall_of(spark, x, every):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(rows, every=every).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(near & set(np.argsort(d, kind="stable")[:10].tolist()))
    return hits / (10 * len(range(0, len(x), every)))


def test_recall_far_from_the_origin(spark):
    """What single precision holds of such vectors are their common offset and little else."""
    rng = np.random.default_rng(6)
    assert recall_of(spark, 1000 + 0.01 * rng.standard_normal((3000, 16)), 50) >= 0.95


def test_recall_of_near_equal_vectors(spark):
    rng = np.random.default_rng(7)
    assert recall_of(spark, rng.standard_normal(8) + 1e-10 * rng.standard_normal((200, 8)), 10) >= 0.95


def test_recall_of_tight_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 12))
    assert recall_of(spark, centres[np.arange(2000) % 20] + 1e-3 * rng.standard_normal((2000, 12)), 50) >= 0.95


def test_distances_beyond_squares(spark):
    rows = spark.createDataFrame([(0, [1e307, 1.0]), (1, [-1e307, 1.0]), (2, [1.0, 1.0]), (100, [1e-200, 0.0]), (101, [3e-200, 0.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): (r["rank"], r.score) for r in nearest_neighbours(rows).collect()}
    assert found[0, 2][1] == 1e307 and found[0, 1] == (4, 2e307)
    assert found[100, 101] == (1, 2e-200)
