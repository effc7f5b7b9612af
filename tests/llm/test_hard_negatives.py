"""Hard negatives against a full search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, shard string, block long"


def expected(rows, is_anchor, positives=5, negatives=5):
    kept = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        new = (str(label), vector)
        if vec_id not in kept or new < kept[vec_id]:
            kept[vec_id] = new
    ints = {i: [math.floor(256.0 * x) for x in v] for i, (_, v) in kept.items()}
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(ints[a], ints[b]))))
    out = []
    for a in filter(is_anchor, kept):
        others = sorted((-score(a, b), b) for b in kept if b != a)
        near = [(-s, b) for s, b in others if kept[b][0] == kept[a][0]][:positives]
        for p, b in near:
            fit = [(-s, c) for s, c in others if kept[c][0] != kept[a][0] and 80 * p <= -100 * s <= 100 * p][:negatives]
            out += [(a, b, k, c, p, s) for k, (s, c) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels, shards and pages on small tables."""
    for name, value in {"SHARD": 60, "LEAF": 8, "FANOUT": 2, "BLOCK": 7, "PAGE": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_clustered_rows(spark, small):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.2 * rnd.normal(size=8)).tolist(), int(rnd.integers(0, 3)), 1, "s", 2) for k in range(500)]
    got = found(spark, rows)
    assert got == expected(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_ties_nulls_repeats_and_lengths(spark, small):
    rnd = random.Random(2)
    grid = lambda n: [rnd.choice([-0.5, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(k, grid(3), rnd.choice([1, 1, 1, 2, None]), 0, "", 0) for k in range(300)]
    rows += [(k, [0.5, 0.5, 1.0], k % 2, 0, "", 0) for k in range(1000, 1200)]  # a tile of equal vectors
    rows += [(2000, [1.0, 2.0, 3.0, 4.0], 1, 0, "", 0), (2010, [], 2, 0, "", 0), (2020, [1.0], 1, 0, "", 0)]
    rows += [(2030, None, 1, 0, "", 0), (2040, [None, 1.0], 1, 0, "", 0), (2050, [math.nan], 1, 0, "", 0), (2060, [math.inf], 2, 0, "", 0), (None, [1.0], 1, 0, "", 0)]
    rows += [rows[5], (3, [9.0, 9.0, 9.0], 0, 0, "", 0), (0, [1.0, 0.5, 0.5], 1, 0, "", 0)]
    assert found(spark, rows) == expected(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, positives=2, negatives=1) == expected(rows, lambda i: i % 10 == 0, 2, 1)


def test_components_beyond_exact_doubles(spark, small):
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([1e7, -3e7, 12345678.9, 1.0, 1e300, -1e300]) * rnd.random() for _ in range(3)], k % 2, 0, "", 0) for k in range(120)]
    rows += [(200 + k, [1e6 + k / 256, 1e6, 3e6], k % 2, 0, "", 0) for k in range(50)]
    assert found(spark, rows) == expected(rows, lambda i: i % 10 == 0)


def test_nothing_to_find(spark):
    rows = [(k, [1.0, k / 100], 1, 0, "", 0) for k in range(30)]
    assert found(spark, rows) == []
    assert found(spark, [(k + 1, *r[1:]) for k, r in enumerate(rows[:5])]) == []
    df = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert hard_negatives.mine_hard_negatives(df, F.lit(True)).count() == 0


def test_tiles_hold_every_row_once():
    x = np.random.default_rng(4).normal(size=(1000, 5))
    order = hard_negatives.tiled(x, 16, [0, 1, 2])
    assert sorted(order) == list(range(1000))
    low, high, levels = hard_negatives.boxes(x[order])
    assert levels[-1] == len(low) and (low[-1] == x.min(0)).all() and (high[-1] == x.max(0)).all()
