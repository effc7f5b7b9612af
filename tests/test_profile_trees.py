"""Profiles level by level against a walk, event rejects, snapshots, judging by id."""

import json
import random

from riskframe.operators import changes
from riskframe.sources import profile_trees, readers


def made(rnd, depth=0):
    return {"sig": f"s{rnd.randint(0, 9)}", "method": "m", "module": "M", "file": "f.jl", "line": rnd.randint(1, 9), "name": "n", "self": rnd.random(), "total": rnd.randint(0, 99), "children": [made(rnd, depth + 1) for _ in range(rnd.choice([0, 1, 3]) if depth < 6 else 0)]}


def walk(node, path="0", depth=0):
    yield path, path.rpartition(".")[0] or None, depth, node["sig"], node["line"]
    for k, c in enumerate(node["children"]):
        yield from walk(c, f"{path}.{k}", depth + 1)


def test_profiles(spark, tmp_path):
    rnd = random.Random(2)
    site = {"func": "g", "file": "p.jl", "line": 3}
    profile = {
        "version": 1,
        "invalidations": [{**made(rnd), "reason": "insert", "ninvalidated": n, "mt_cache": 1, "backedges": [made(rnd), made(rnd)], "mt_backedges": [{"trigger": "T", "root": made(rnd)}]} for n in (2, 9, 9, 0)],
        "inference": {"total": 1.0, "root": made(rnd)},
        "triggers": [{"callee": made(rnd), "caller": {"func": "f", "file": "a.jl", "line": 7}, "site": site, "time": 0.5}, {"callee": made(rnd), "caller": {"func": "f", "file": "a.jl", "line": 8}, "site": None, "time": 0.25}],
    }
    for name, text in {"a.json": json.dumps(profile), "b.json": json.dumps({"version": 2, "invalidations": []}), "c.json": "{", "d.json": json.dumps({"version": 1, "invalidations": []}), "e.json": json.dumps({"version": 1})}.items():
        (tmp_path / name).write_text(text)
    docs = profile_trees.documents(spark, str(tmp_path))
    assert sorted(r.profile_id[-6] for r in docs.where("problem is not null").collect()) == ["b", "c", "e"]
    found = profile_trees.invalidations(docs).orderBy("place").collect()
    assert [r.ninvalidated for r in found] == [9, 9, 2, 0] and [r.sig for r in found[:2]] == [x["sig"] for x in profile["invalidations"][1:3]]
    nodes = profile_trees.inference_nodes(docs).collect()
    assert sorted((r.node_id, r.parent_id, r.depth, r.sig, r.line) for r in nodes) == sorted(walk(profile["inference"]["root"]))
    want = sorted((k, kind, at, *n) for k, inv in enumerate(profile["invalidations"]) for kind, roots in ((0, inv["backedges"]), (1, [x["root"] for x in inv["mt_backedges"]])) for at, root in enumerate(roots) for n in walk(root))
    edges = profile_trees.backedge_nodes(docs).collect()
    assert sorted((r.invalidation, r.tree.kind, r.tree["at"], r.node_id, r.parent_id, r.depth, r.sig, r.line) for r in edges) == want
    assert {r.trigger for r in edges if r.tree.kind} == {"T"} and {r.trigger for r in edges if not r.tree.kind} == {None}
    got = profile_trees.triggers(docs).orderBy("at").collect()
    assert [(r.caller.line, r.site.file if r.site else None, r.time) for r in got] == [(7, "p.jl", 0.5), (8, None, 0.25)]


def test_event_rejects(spark, tmp_path):
    lines = ['{"scenario": "s", "idx": 0, "t": 5, "type": "module", "process": "a", "path": "x.dll"}', '{"scenario": "s", "idx": 1, "type": "file", "process": "a"}', '{"type": "spawnn", "process": "a"}', '{"type": "file"}', "[1]", "{", "", '{"process": "a"}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    assert sorted((r.idx, r.t, r.type) for r in readers.read_process_events(spark, str(tmp_path)).collect()) == [(0, 5, "module"), (1, 6, "file")]
    assert sorted(r.problem for r in readers.event_rejects(spark, str(tmp_path)).collect()) == ["event must be an object", "event must be an object", "event needs a process", "unknown event type null", "unknown event type spawnn"]


def test_newest_snapshot(spark):
    rows = [(1, "a.b", "2024-01-01", "Spam"), (2, "a.c", "2024-02-01", "Spam"), (2, "a.c", "2024-03-01", "Malware")]
    snapshots = spark.createDataFrame(rows, "fetched int, id string, removed_on string, type string")
    assert [tuple(r) for r in readers.newest_known_bad(snapshots).collect()] == [("a.c", "2024-03-01", "Malware")]
    assert readers.newest_known_bad(snapshots.limit(0)).count() == 0


def test_guard_by_id(spark):
    status = spark.createDataFrame([("a", "added"), ("b", "changed"), ("c", "added"), ("d", "unchanged")], "id string, status string")
    risk = spark.createDataFrame([("a", "low")], "id string, level string")
    none = spark.createDataFrame([], "id string, rule string")
    by_id = spark.createDataFrame([("a", "high"), ("b", "high")], "id string, level string")
    assert {r.id: r.verdict for r in changes.guard(status, risk, none, by_id=by_id).collect()} == {"a": "pass", "b": "fail", "c": "error"}
    assert {r.id: r.verdict for r in changes.guard(status, risk, none).collect()} == {"a": "pass", "b": "error", "c": "error"}
