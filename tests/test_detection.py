"""Detection in batch against a replay, and streams against batch."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import detect
from riskframe.operators.detect import DetectionRule
from riskframe.streaming import detect as live

SCHEMA = "scenario string, idx long, t long, type string, process string, parent string, target string, image string, cmdline string, user string, op string, path string, key string, remote string, count long"


def events(seed=0, n=400):
    rnd = random.Random(seed)
    t, rows = 0, []
    for k in range(n):
        t += rnd.choice([0, 0, 1, 3, 10])
        rows.append(("s", k, t, rnd.choice(["file", "network", "exec"]), rnd.choice("abc"), rnd.choice("xy"), None, "img", "cmd", "u", "write", "p", None, rnd.choice(["r1", "r2"]), rnd.choice([None, 1, 2])))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(events(), SCHEMA)


THRESHOLD = DetectionRule("many", "threshold", match={"type": "^file$"}, count=6, within=15)
SEQUENCE = DetectionRule("chain", "sequence", steps=({"type": "^network$", "remote": "$R"}, {"type": "^exec$"}, {"type": "^network$", "remote": "$R"}), within=20)


def test_threshold(frame):
    fired, held = {}, {}
    for r in sorted(events(), key=lambda r: (r[2], r[1])):
        if r[3] == "file" and r[4] not in fired:
            w = [e for e in held.get(r[4], []) if e[0] >= r[2] - 15] + [(r[2], r[1], r[14] or 1)]
            held[r[4]] = w
            if sum(e[2] for e in w) >= 6:
                fired[r[4]] = (r[2], [e[1] for e in w])
    got = {r.processes[0]: (r.t, r.events) for r in detect.detect_threshold(frame, THRESHOLD).collect()}
    assert got == fired


def test_sequence(frame):
    rows = sorted(events(), key=lambda r: (r[2], r[1]))
    want = {}
    for i, a in enumerate(rows):
        if a[3] != "network":
            continue
        best = None
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b[3] == "exec" and b[2] <= a[2] + 20:
                for c in rows[j + 1 :]:
                    if c[3] == "network" and c[13] == a[13] and c[2] <= a[2] + 20:
                        best = min(best or (c[2], c[1]), (c[2], c[1]))
                        break
        if best:
            want[a[1]] = best
    got = {r.events[0]: (r.t, r.events[-1]) for r in detect.detect_sequence(frame, SEQUENCE).collect()}
    assert got == want


def test_bound_parent(spark):
    rows = [("s", 0, 0, "exec", "c", "p"), ("s", 1, 4000, "exec", "b", "p"), ("s", 2, 20000, "exec", "c", "q"), ("s", 3, 31000, "exec", "b", "q")]
    frame = spark.createDataFrame(rows, "scenario string, idx long, t long, type string, process string, parent string")
    rule = DetectionRule("curl-bash", "sequence", steps=({"process": "^c$", "parent": "$P"}, {"process": "^b$", "parent": "$P"}), within=5000)
    assert [r.processes for r in detect.detect_sequence(frame, rule).collect()] == [["c", "b"]]


def test_state_and_ancestors(spark):
    rows = [("s", 0, 1, "file", "x", None, None, None), ("s", 1, 2, "spawn", "x", "w", "img1", "cmd1"), ("s", 2, 3, "exec", "x", None, "img2", "cmd2"), ("s", 3, 4, "file", "x", None, None, None), ("s", 4, 5, "spawn", "x", "v", "img3", None), ("s", 5, 6, "file", "zz", None, None, None)]
    frame = spark.createDataFrame([(*r, "u") for r in rows], "scenario string, idx long, t long, type string, process string, parent string, image string, cmdline string, user string")
    start = spark.createDataFrame([("s", "x", "img0", "c0", "u", "r")], "scenario string, process string, image string, cmdline string, user string, parent string")
    got = {r.idx: (r.p_image, r.p_cmdline, r.p_parent) for r in detect.enrich(frame, start).collect()}
    assert got == {0: ("img0", "c0", "r"), 1: ("img1", "cmd1", "w"), 2: ("img2", "cmd2", "w"), 3: ("img2", "cmd2", "w"), 4: ("img3", None, "v"), 5: ("?", None, None)}
    tree = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "a"), ("s", "e", None)], "scenario string, process string, parent string")
    up = detect.ancestors(tree).where("process = 'd'").collect()
    assert {r.ancestor: r.depth for r in up} == {"a": 1, "b": 2, "c": 3}


def test_missing_times(spark):
    frame = spark.createDataFrame([("s", 0, None), ("s", 1, None), ("s", 2, 50), ("s", 3, None), ("s", 4, 60)], "scenario string, idx long, t long")
    assert [r.t for r in detect.fill_time(frame).orderBy("idx").collect()] == [1, 2, 50, 51, 60]


def run_stream(spark, frame, path, name, build):
    frame.write.json(str(path))
    stream = spark.readStream.schema(frame.schema).json(str(path))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_agrees_on_thresholds(spark, frame, tmp_path, rocks):
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in", "threshold_out", lambda s: live.threshold_stream(s, THRESHOLD))
    want = {(r.grp, r.t, r.idx, r.total) for r in detect.threshold_firings(frame, THRESHOLD).collect()}
    assert {(r.grp, r.t, r.idx, r.total) for r in got} == want and want


def test_stream_agrees_on_sequences(spark, frame, tmp_path, rocks):
    rule = DetectionRule("steps", "sequence", steps=({"type": "^network$"}, {"type": "^exec$"}, {"type": "^file$"}), within=40)
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in", "sequence_out", lambda s: live.sequence_stream(s, rule, "process"))
    want = {(r.events[0], r.t) for r in detect.detect_sequence(frame, rule, key=("process",)).collect()}
    assert {(r.first, r.t) for r in got} == want and want


def test_timed_streams_agree_and_drop_state(spark, frame, tmp_path, rocks):
    """With a watermark results are the same; afterwards no key holds state that no event can meet."""
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in", "timed_out", lambda s: live.threshold_stream(s, THRESHOLD, "0 seconds"))
    want = {(r.grp, r.t, r.idx) for r in detect.threshold_firings(frame, THRESHOLD).collect()}
    assert {(r.grp, r.t, r.idx) for r in got} == want and want
    rule = DetectionRule("steps", "sequence", steps=({"type": "^network$"}, {"type": "^exec$"}, {"type": "^file$"}), within=40)
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in2", "timed_steps", lambda s: live.sequence_stream(s, rule, "process", "0 seconds"))
    want = {(r.events[0], r.t) for r in detect.detect_sequence(frame, rule, key=("process",)).collect()}
    assert {(r.first, r.t) for r in got} == want and want


def test_many_open_sequences(spark, tmp_path, rocks):
    """No partial sequence is dropped, however many are open."""
    rows = [("s", k, k, "network", "a") for k in range(500)] + [("s", 500, 500, "exec", "a")]
    frame = spark.createDataFrame([(*r, *([None] * 10)) for r in rows], SCHEMA)
    rule = DetectionRule("pair", "sequence", steps=({"type": "^network$"}, {"type": "^exec$"}), within=1000)
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in", "pairs_out", lambda s: live.sequence_stream(s, rule, "process"))
    assert len(got) == 500 == detect.detect_sequence(frame, rule, key=("process",)).count()


def test_matches_rates_and_rescans(spark, tmp_path):
    frame = spark.createDataFrame(events(n=60), SCHEMA)
    rule = DetectionRule("file", "match", match={"type": "^file$"})
    got = run_stream(spark, frame.coalesce(1), tmp_path / "in", "match_out", lambda s: live.match_stream(s, rule))
    assert {r.idx for r in got} == {r[1] for r in events(n=60) if r[3] == "file"}
    timed = frame.select("process", F.timestamp_millis(F.col("t") * 10_000).alias("ts"))
    want = {(r.process, r.n) for r in live.rate_stream(timed).collect()}
    assert sum(n for _, n in want) <= 60 and want
    files = frame.select(F.concat("type", "process").alias("key"), "idx")
    files.coalesce(1).write.json(str(tmp_path / "files"))
    scan = lambda fresh: fresh.select("key", "idx")
    for k in range(2):
        # the second run starts anew and finds all of it in the cache
        stream = spark.readStream.schema(files.schema).json(str(tmp_path / "files"))
        live.rescan_stream(stream, scan, str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / f"state{k}")).trigger(availableNow=True).start().awaitTermination(120)
    keys = files.select("key").distinct().count()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == keys == spark.read.schema("key string, idx long").parquet(str(tmp_path / "out")).count()


def test_rescan_writes_a_batch_once(spark, tmp_path):
    """A failure between the findings and the keys, a run after it, and compaction: no finding twice."""
    for k in range(4):
        spark.createDataFrame([(f"k{j}", j) for j in range(3 * k, 3 * k + 5)], "key string, idx long").coalesce(1).write.mode("append").json(str(tmp_path / "files"))
    calls = []

    def scan(fresh):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return fresh.select("key", "idx")

    cache, out = str(tmp_path / "cache"), str(tmp_path / "out")
    start = lambda state: live.rescan_stream(spark.readStream.schema("key string, idx long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "files")), scan, cache, out, str(tmp_path / state), compact=1).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start("state").awaitTermination(120)
    # findings of the third batch, as if it had failed after writing them
    start("state").awaitTermination(120)
    found = sorted(r.key for r in live.committed(spark, out, "key string, idx long").collect())
    assert found == sorted(f"k{j}" for j in range(14))
    start("other").awaitTermination(120)
    assert live.committed(spark, out, "key string, idx long").count() == 14


@pytest.mark.parametrize("variables", [({}, {}, {}), ({"P": "process"}, {"P": "parent"}, {"P": "target"}), ({"P": "process"}, {}, {"P": "target"}), ({}, {"Q": "process"}, {"Q": "target"})])
def test_stream_sequences_with_variables(spark, tmp_path, rocks, variables):
    """A thousand short streams in one, in several batches, against the batch operator."""
    rnd = random.Random(9)
    rows = []
    for s in range(1000):
        t = 0
        for k in range(9):
            t += rnd.choice([0, 1, 4])
            rows.append((str(s), k, t, rnd.choice(["x", "y", "xy"]), rnd.choice("ab"), rnd.choice(["a", "b", None]), rnd.choice("ab")))
    frame = spark.createDataFrame(rows, "scenario string, idx long, t long, type string, process string, parent string, target string")
    rule = DetectionRule("r", "sequence", within=10, steps=tuple({"type": p} | {f: f"${v}" for v, f in own.items()} for p, own in zip("xyx", variables)))
    got = run_stream(spark, frame.repartition(2), tmp_path / "in", "variables_out", lambda s: live.sequence_stream(s.where("idx is not null"), rule))
    want = sorted((int(r.scenario), r.events[0], r.events[-1], r.t) for r in detect.detect_sequence(frame, rule).collect())
    found = sorted((r["first"], r["last"], r.t) for r in got)
    assert found == sorted(w[1:] for w in want) and want


@pytest.mark.parametrize("late", [None, "30 seconds"])
def test_process_table_on_a_stream(spark, tmp_path, rocks, late):
    """States as of events equal those of the batch operator; with a watermark batches may come out of order."""
    rnd = random.Random(11)
    t, rows = 0, []
    for k in range(300):
        t += rnd.choice([0, 1, 400])
        kind = rnd.choice(["spawn", "exec", "file"])
        rows.append(("s", k, t, kind, rnd.choice("abcd"), rnd.choice("xyz") if kind == "spawn" else None, f"i{k}" if kind != "file" else None, f"c{k}" if kind != "file" else None, rnd.choice(["u", "v", None]) if kind == "spawn" else None))
    start = [("s", "x", "ix", "c", "root", None), ("s", "a", "ia", "c", "user", "x"), ("s", "y", "iy", "c", None, None)]
    events = spark.createDataFrame(rows, "scenario string, idx long, t long, type string, process string, parent string, image string, cmdline string, user string")
    initial = spark.createDataFrame(start, "scenario string, process string, image string, cmdline string, user string, parent string")
    # a last event far off lets the watermark pass all others
    flush = spark.createDataFrame([("s", 1000 + k, 10**9 * (k + 1), "file", "end", None, None, None, None) for k in range(2)], events.schema)
    source = events.orderBy(F.rand(3)).coalesce(1) if late else events.coalesce(1)
    folder = tmp_path / "in"
    source.write.parquet(str(folder))
    for part in flush.collect():
        if late:
            spark.createDataFrame([part], events.schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = live.enrich_stream(stream, initial, late, 10**6).writeStream.format("memory").queryName("table_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(240)
    assert query.exception() is None
    pick = lambda r: (r.p_image, r.p_cmdline, r.p_user, r.p_parent, r.user)
    got = {r.idx: pick(r) for r in spark.table("table_out").where("idx < 1000").collect()}
    want = {r.idx: pick(r) for r in detect.enrich(events, initial).collect()}
    assert got == want
