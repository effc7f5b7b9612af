"""What grows with the tables: plans and pieces that stay small, and results that do not depend on how work is cut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe import steps
from riskframe.operators import code, detect, entropy, lives, supply
from riskframe.plans import packages

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbouring_addresses(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, "at 8.8.8.8 9.9.9.9, 7.7.7.7"), (2, "6.6.6.6"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "https://a.example/x")], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    got = {r.reason: r.n for r in packages.suspicious_targets(spark, d).collect()}
    assert got == {"a literal public IP address": 3, None: 1}


def test_advisories_are_put_together_once(spark):
    npm = spark.createDataFrame([("p", "a", "1.0.0"), ("p", "a", "1.0.0"), ("p", "b", "1.0.0"), ("q", "b", "1.0.0"), ("r", "b", "^1.0.0")], "pkg_id string, name string, version string")
    pinned = spark.createDataFrame([("p", "c", "1.0.0"), ("s", "c", "1.0.0")], "pkg_id string, name string, version string")
    listed = spark.createDataFrame([("a", "1.0.0", "CVE-2"), ("a", "1.0.0", "CVE-1"), ("b", "1.0.0", "CVE-2"), ("b", "1.0.0", "MAL-1"), ("c", "1.0.0", "CVE-9"), (None, "1.0.0", "CVE-8")], "name string, version string, advisory string")
    found = supply.advisory_signals(npm, pinned, listed)
    bad, weak = "malicious-dependency", "vulnerable-dependency"
    assert {tuple(r[:3]): r.ids for r in found.collect()} == {("p", weak, 2): ["CVE-1", "CVE-2"], ("p", bad, 1): ["MAL-1"], ("q", weak, 1): ["CVE-2"], ("q", bad, 1): ["MAL-1"], ("s", weak, 1): ["CVE-9"]}
    # no list of advisories is shuffled by package
    assert "advisory" not in plan(found)


def test_equal_advisories_are_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(supply, "LIST_BYTES", 20_000)
    monkeypatch.setattr(supply, "LIST_ROWS", 100)
    # 40 names have 80 advisories each: 3,000 lists, of which 1,600 differ
    npm = spark.range(3000).select("id", F.explode(F.array(F.col("id") % 40, F.floor(F.col("id") / 7) % 40)).alias("k")).select(F.concat(F.lit("p"), "id").alias("pkg_id"), F.concat(F.lit("n"), "k").alias("name"), F.lit("1.0.0").alias("version"))
    listed = spark.range(3200).select(F.concat(F.lit("n"), F.col("id") % 40).alias("name"), F.lit("1.0.0").alias("version"), F.format_string("CVE-%07d", "id").alias("advisory"))
    found = supply.advisory_signals(npm, npm.where("false"), listed, sep=",")
    want = npm.join(listed, ["name", "version"]).groupBy("pkg_id").agg(F.countDistinct("name").alias("n"), F.array_join(F.sort_array(F.collect_set("advisory")), ",").alias("ids"))
    assert found.select("pkg_id", "n", "ids").exceptAll(want).isEmpty() and found.count() == want.count() == 3000
    found.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").select(F.spark_partition_id().alias("part"), F.input_file_name().alias("file"), "ids").withColumn("at", F.monotonically_increasing_id()).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r.at):
        files.setdefault(r.ids, []).append((r.file, r.at))
    # equal lists lie in one file, one behind the other
    assert all(len({f for f, _ in x}) == 1 and x[-1][1] - x[0][1] == len(x) - 1 for x in files.values())
    assert len({r.file for r in rows}) > 20


def test_markov_by_ranges(spark, monkeypatch):
    frame = spark.createDataFrame([("a", i, i * i % 7 % 2) for i in range(300) if not 40 <= i < 60] + [("b", i, i % 2) for i in range(5)], "source_id string, i long, bit int")
    whole = {r.source_id: r.h for r in entropy.markov(frame).collect()}
    monkeypatch.setattr(entropy, "RANGE", 8)
    found = entropy.markov(frame)
    assert {r.source_id: pytest.approx(r.h, rel=1e-12) for r in found.collect()} == whole
    assert "windowspecdefinition(source_id" in plan(found) and ", range#" in plan(found)


def test_hashes_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in packages.manifest_hashes(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tours_by_trees(spark):
    up = {0: None, 1: 0, 2: 1, 3: None, 4: 0, 5: 6, 6: None}
    found = spark.createDataFrame([("s", k, k, u) for k, u in up.items()], "scenario string, process long, life long, up long")
    tour = {r.life: (r.tree, r.last, r.first) for r in lives.toured(found).collect()}
    below = {(a, b) for a in tour for b in tour if a != b and tour[a][0] == tour[b][0] and tour[b][1] < tour[a][2] < tour[b][2]}
    # a life of neither parent nor child is in no tour
    assert below == {(1, 0), (2, 0), (2, 1), (4, 0), (5, 6)} and 3 not in tour


def test_leaves_take_no_rounds(spark, monkeypatch):
    rng = random.Random(2)
    up = {k: None if k % 17 == 0 else rng.randrange(max(0, k - 40), k) for k in range(300)}
    sizes, cut = [], lives.cut

    def seen(df):
        found = cut(df)
        sizes.extend([found.count()] * ("step" in df.columns))
        return found

    monkeypatch.setattr(lives, "cut", seen)
    found = spark.createDataFrame([("s", k, k, u) for k, u in up.items()], "scenario string, process long, life long, up long")
    tour = {r.life: (r.tree, r.last, r.first) for r in lives.toured(found).collect()}
    got = {(a, b) for a in tour for b in tour if a != b and tour[a][0] == tour[b][0] and tour[b][1] < tour[a][2] < tour[b][2]}
    above = lambda k: [] if up[k] is None else [up[k], *above(up[k])]
    assert got == {(k, a) for k in up for a in above(k)}
    # every step of a tree has its own number
    places = [(t, x) for t, last, first in tour.values() for x in (last, first)]
    assert len(set(places)) == len(places)
    # an entry and an end of lives with children only
    assert set(sizes) == {2 * len({u for u in up.values() if u is not None})}


def test_estimates_do_not_grow_by_rounds(spark):
    bits = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
    # a path of 300 lives takes 10 rounds
    path = spark.range(300).select(F.lit("s").alias("scenario"), F.col("id").alias("process"), F.col("id").alias("life"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    assert bits(lives.toured(path)) < 400
    events = spark.range(300).select(F.lit("s").alias("scenario"), F.col("id").alias("process"), F.col("id").alias("t"), F.col("id").alias("idx"), F.lit("spawn").alias("type"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") == 0, "root").alias("user"), F.lit("i").alias("image"), F.lit("c").alias("cmdline"))
    found = detect.inherit_users(events, events.select("scenario", "process", "image", "cmdline", "user", "parent").where("false"))
    assert bits(found) < 400 and found.where("user = 'root'").count() == 300
    assert lives.circles(spark.range(300).select(F.col("id").alias("life"), ((F.col("id") + 1) % 300).alias("up"))).count() == 300


def test_beside(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "n int, k string")
    right = spark.createDataFrame([("a", 10), ("c", 30), (None, 40)], "k string, v int")
    assert sorted(map(tuple, steps.beside(left, right, ["k"]).collect())) == [(1, "a", 10), (2, "a", 10), (3, "b", None), (4, None, None), (5, None, None)]


def test_asks_without_a_process_are_no_group(spark):
    asks = spark.createDataFrame([("s", 1, k, None if k else "a") for k in range(5)], "scenario string, t long, idx long, who string")
    known = spark.createDataFrame([("s", "a", 0, 0, ("x",))], "scenario string, process string, t long, idx long, state struct<image:string>")
    found = lives.as_of(asks, known, "who", "state_of")
    assert {r.idx: r.state_of and r.state_of.image for r in found.collect()} == {0: "x", 1: None, 2: None, 3: None, 4: None}
    groups = [x for x in plan(found).splitlines() if x.lstrip("+- :").startswith("Window [")]
    assert len(groups) == 1 and "_w" in groups[0].split("windowspecdefinition(scenario", 1)[1].split(" ASC")[0]


def test_predictors_as_arrays():
    rng = np.random.default_rng(3)
    for k, n in ((2, 900), (5, 700), (2, 19), (16, 400)):
        s = np.where(rng.random(n) < 0.7, np.arange(n) * np.arange(n) % 7 % k, rng.integers(0, k, n))
        # with few places in a model, too
        for most in (50, 300, 100_000):
            assert entropy.multi_mmc_h(s, k, most=most) == entropy.multi_mmc_by_steps(s, k, 16, most)
        right = rng.random((6, n)) < 0.4
        sums, winner, winners = np.zeros(6, int), 0, []
        for step in right.T:
            for j in np.flatnonzero(step):
                sums[j] += 1
                if sums[j] >= sums[winner]:
                    winner = int(j)
            winners.append(winner)
        assert entropy.followed(right, np.cumsum(right, axis=1), 0).tolist() == winners


def test_manifests_are_dealt_out(spark):
    # the file of parts is one partition
    rows = packages.manifests(spark, SF)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 200


def test_entropies_of_literals_take_one_pass(spark):
    # the file of documents is one partition
    assert packages.escaped(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rng = random.Random(5)
    wide = "".join(map(chr, rng.sample([c for c in range(0xA1, 0x2000) if not chr(c).isspace()] + list(range(0x1F300, 0x1F400)), 300)))
    plain = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=900))
    escapes = [rng.randrange(256) for _ in range(700)]
    hidden = "".join(f"\\x{x:02x}" for x in escapes)
    texts = [f'"{wide}"', f"eval ('{plain}')", f"'{plain}'" + " " * 390 + ";eval(", f'"{hidden}"\nrunInContext(', f'"{hidden}"' + " " * 420 + "eval(", f"'{plain}' `{plain}`"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = code.code_findings(docs)
    got = {(r.doc_id, r.rule_id): (r.detail, r.n, round(r.entropy, 9)) for r in found.collect() if r.entropy is not None}
    bits = lambda values: round(-sum(values.count(x) / len(values) * math.log2(values.count(x) / len(values)) for x in set(values)), 9)
    p, rule = bits(plain), "high-entropy-literal"
    assert got == {(0, rule): (None, 1, bits(wide)), (1, "packed-payload"): ("eval", 1, p), (1, rule): (None, 1, p), (2, "packed-payload"): ("eval", 1, p), (2, rule): (None, 1, p), (3, "packed-payload"): ("runInContext", 1, bits(escapes)), (5, "encoded-blob"): (None, 2, p), (5, rule): (None, 2, p)}
    assert "ArrowEvalPython [entropies(" in plan(found)
