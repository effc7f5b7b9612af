"""Repeats of every length against counting every tuple."""

import random
from collections import Counter

import pytest

from riskframe.operators import entropy, suffixes


def counted(sequence):
    out, w = [], 1
    while True:
        c = Counter(tuple(sequence[i : i + w]) for i in range(len(sequence) - w + 1))
        if max(c.values(), default=0) < 2:
            return out
        out.append((w, len(sequence) - w + 1, max(c.values()), sum(n * (n - 1) // 2 for n in c.values())))
        w += 1


def sources():
    rnd = random.Random(1)
    return {
        "random": [rnd.randint(0, 1) for _ in range(700)],
        "constant": [5] * 300,
        "periodic": [1, 2, 3] * 90,
        "single": [7],
        "different": list(range(-20, 20)),
        "long repeat": [rnd.choice([0, 1]) for _ in range(50)] * 4,
        "wide": [rnd.choice([-(2**40), 0, 2**40]) for _ in range(200)],
    }


@pytest.mark.parametrize("sizes", [(1 << 15, 16, 12), (32, 5, 4)])
def test_every_length(spark, monkeypatch, sizes):
    """Also in blocks so small that runs and lengths cross many of them."""
    for name, value in zip(("BLOCK", "LCP_BITS", "LENGTHS_BITS"), sizes, strict=True):
        monkeypatch.setattr(suffixes, name, value)
    rows = [(k, i, x) for k, v in sources().items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "source_id string, i long, sym long").repartition(5)
    found = {k: [] for k in sources()}
    for r in entropy.tuple_counts(frame).collect():
        found[r.source_id].append((r.w, r.n, r.q, int(r.s)))
    assert {k: sorted(v) for k, v in found.items()} == {k: counted(v) for k, v in sources().items()}


def test_common_prefixes(spark):
    sequence = [0, 1, 0, 1, 1, 0, 1]
    frame = spark.createDataFrame([("a", i, x) for i, x in enumerate(sequence)], "source_id string, i long, sym int")
    order = sorted(range(7), key=lambda i: sequence[i:])
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(sequence[a:], sequence[b:])) if x != y), min(7 - a, 7 - b))
    want = [(0, -1)] + [(p, shared(order[p - 1], order[p])) for p in range(1, 7)]
    assert sorted((r.p, r.lcp) for r in suffixes.common_prefixes(frame).collect()) == want
    assert entropy.tuple_counts(frame.limit(0)).count() == 0


def test_the_package_is_sent_before_it_is_needed(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(suffixes, "ship", sent.append)
    suffixes.symbol_blocks(spark.createDataFrame([("a", 0, 1)], "source_id string, i long, sym int"))
    assert sent == [spark]
