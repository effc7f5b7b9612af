"""States of parents, targets and ancestors as of events against a replay; sequences against a replay of partial matches."""

import json
import random
import re

import pytest

from riskframe.operators import detect, lives
from riskframe.operators.detect import DetectionRule
from riskframe.operators.process_rules import DEFAULT_RULES, load_process_rules

EVENT = "scenario string, idx long, t long, type string, process string, parent string, target string, image string, cmdline string, user string, op string, path string, key string, remote string, count long"
INITIAL = "scenario string, process string, image string, cmdline string, user string, parent string"


def replay(rows, start):
    """Each event's own, parent, target and ancestors' states; lives keep the parent life that they were born with."""
    lives_of, out = {}, {}
    for _, process, image, cmdline, user, parent in start:
        lives_of[process] = {"id": process, "image": image or "?", "cmdline": cmdline, "user": user, "parent": parent, "up": None}
    for life in lives_of.values():
        life["up"] = lives_of.get(life["parent"])
    for life in lives_of.values():  # a circle has no parents
        seen, at = [], life
        while at is not None and not any(at is s for s in seen):
            seen.append(at)
            at = at["up"]
        if at is life:
            life["ring"] = True
    for life in lives_of.values():
        if life.get("ring"):
            life["up"] = None
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        _, idx, _, kind, process, parent, target, image, cmdline, user = r[:10]
        if kind == "spawn":
            up = lives_of.get(parent)
            lives_of[process] = {"id": process, "image": image or "?", "cmdline": cmdline, "user": user or (up or {}).get("user"), "parent": parent, "up": up}
        elif process not in lives_of:
            lives_of[process] = {"id": process, "image": "?", "parent": None, "up": None}
        if kind == "exec":
            lives_of[process]["image"] = image
        own = lives_of[process]
        target = target or (process if kind == "terminate" else None)
        above, at = [], own["up"]
        while at is not None:
            above.append(at["image"])
            at = at["up"]
        pick = lambda p: (lives_of.get(p) or {}).get("image")
        out[idx] = (own["image"], pick(own["parent"]), pick(target), above)
    return out


def made(seed, n=300):
    rnd = random.Random(seed)
    names = [f"p{k}" for k in range(12)]
    rows, t = [], 0
    for k in range(n):
        t += rnd.choice([0, 1, 5])
        kind = rnd.choice(["spawn", "spawn", "exec", "file", "terminate", "inject"])
        process = rnd.choice(names)
        rows.append(("s", k, t, kind, process, rnd.choice([x for x in names if x != process]) if kind == "spawn" and rnd.random() < 0.9 else None, rnd.choice([*names, None]) if kind in ("terminate", "inject") else None, f"i{rnd.randint(0, 9)}" if kind in ("spawn", "exec") else None, "c", rnd.choice(["u", None]), None, None, None, None, None))
    start = [("s", "p0", "i0", "c", "root", None), ("s", "p1", "i1", "c", "root", "p2"), ("s", "p2", "i2", "c", "root", "p1"), ("s", "p3", "i3", "c", "x", "p2"), ("s", "p4", "i4", "c", "x", "p0")]
    return rows, start


@pytest.mark.parametrize("seed", [1, 2])
def test_scopes_against_a_replay(spark, seed, monkeypatch):
    monkeypatch.setattr(lives, "POINTS", 16)  # so that intervals are dealt to several tasks
    rows, start = made(seed)
    rules = [DetectionRule("a", "match", match={"type": ".", "ancestor.image": "^i[135]$"}), DetectionRule("b", "match", match={"type": ".", "ancestor.image": ["^i0$", "^i9$"], "parent.image": "^i"}), DetectionRule("c", "match", match={"target.image": "^i[0-4]$", "image": "^i"})]
    events = spark.createDataFrame(rows, EVENT)
    scoped = lives.scoped(events, spark.createDataFrame(start, INITIAL), rules)
    found = {"a": set(), "b": set(), "c": set()}
    for r in detect.detect(scoped, rules, column=lives.scope_column(rules)).collect():
        found[r.rule_id].add(r.events[0])
    seen = replay(rows, start)
    assert {r.idx: (r.s_process.image, r.s_parent.image if r.s_parent else None, r.s_target.image if r.s_target else None) for r in scoped.collect()} == {k: v[:3] for k, v in seen.items()}
    want_b = {k for k, v in seen.items() if any(x in ("i0", "i9") for x in v[3]) and (v[1] or "").startswith("i")}
    image = {r[1]: r[7] for r in rows}
    want_c = {k for k, v in seen.items() if re.search("^i[0-4]$", v[2] or "") and (image[k] or v[0]).startswith("i")}
    assert found == {"a": {k for k, v in seen.items() if any(x in ("i1", "i3", "i5") for x in v[3])}, "b": want_b, "c": want_c}


def test_a_chain_needs_no_pairs(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("'s' scenario", "id idx", "id t", "'spawn' type", "string(id) process", "if(id > 0, string(id - 1), null) parent", "string(null) target", "if(id = 5, 'root', 'x') image", "'c' cmdline", "'u' user")
    rules = [DetectionRule("deep", "match", match={"ancestor.image": "^root$"})]
    start = spark.createDataFrame([], INITIAL)
    got = detect.detect(lives.scoped(rows, start, rules), rules, column=lives.scope_column(rules)).selectExpr("min(events[0])", "count(*)").first()
    assert tuple(got) == (6, n - 6)


def partials(rows, steps, within):
    """First completion for each starting event, by a list of partial matches. steps: (fits(row), {variable: field})."""
    live, done = [], {}
    for r in sorted(rows, key=lambda r: (r["t"], r["idx"])):
        live = [p for p in live if within is None or r["t"] - p[1] <= within]
        fresh = []
        for step, t0, path, bound in live:
            fits, variables = steps[step]
            own = {v: r[f] for v, f in variables.items()}
            if fits(r) and None not in own.values() and all(bound.get(v, x) == x for v, x in own.items()):
                if step + 1 == len(steps):
                    done.setdefault(path[0], (r["t"], r["idx"]))
                else:
                    fresh.append((step + 1, t0, [*path, r["idx"]], bound | own))
        live += fresh
        fits, variables = steps[0]
        own = {v: r[f] for v, f in variables.items()}
        if fits(r) and None not in own.values():
            live.append((1, r["t"], [r["idx"]], own))
    return done


@pytest.mark.parametrize("within", [None, 12])
@pytest.mark.parametrize("variables", [({}, {}, {}), ({"P": "process"}, {"P": "parent"}, {"P": "target"}), ({"P": "process"}, {}, {"P": "target"})])
def test_sequences_against_partial_matches(spark, within, variables):
    rnd = random.Random(3)
    t, rows = 0, []
    for k in range(260):
        t += rnd.choice([0, 0, 1, 3])
        rows.append({"scenario": "s", "idx": k, "t": t, "type": rnd.choice(["x", "y", "xy"]), "process": rnd.choice("ab"), "parent": rnd.choice(["a", "b", None]), "target": rnd.choice("ab")})
    rows = rows + [r | {"scenario": "other"} for r in rows[:50]]
    patterns = ("x", "y", "x")
    rule = DetectionRule("r", "sequence", within=within, steps=tuple({"type": p} | {f: f"${v}" for v, f in own.items()} for p, own in zip(patterns, variables)))
    frame = spark.createDataFrame(rows, "scenario string, idx long, t long, type string, process string, parent string, target string").repartition(3)
    got = {(r.scenario, r.events[0]): (r.t, r.events[-1]) for r in detect.detect_sequence(frame, rule).collect()}
    steps = [(lambda r, p=p: p in r["type"], own) for p, own in zip(patterns, variables)]
    want = {(s, k): v for s in ("s", "other") for k, v in partials([r for r in rows if r["scenario"] == s], steps, within).items()}
    assert got == want


def test_default_rules_in_order(spark):
    """A document opens a shell that starts a program, which disables recovery and security tools, injects, persists and encrypts."""
    office, shell, system = "C:\\Office\\EXCEL.EXE", "C:\\Windows\\powershell.exe", "C:\\Windows\\System32\\"
    event = lambda k, t, kind, process, **more: tuple({"scenario": "s", "idx": k, "t": t, "type": kind, "process": process, **more}.get(c.split()[0]) for c in EVENT.split(", "))
    rows = [
        event(0, 0, "spawn", "sh", parent="office", image=shell, cmdline="powershell -enc AAAA"),
        event(1, 100, "spawn", "drop", parent="sh", image="C:\\Users\\x\\AppData\\Local\\Temp\\d.exe", cmdline="d.exe"),
        event(2, 400, "terminate", "sh"),
        event(3, 1000, "spawn", "vss", parent="drop", image=system + "vssadmin.exe", cmdline="vssadmin delete shadows /all"),
        event(4, 2000, "terminate", "drop", target="guard"),
        event(5, 3000, "inject", "drop", target="lsass"),
        event(6, 4000, "registry", "drop", op="set", key="HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\d"),
        event(7, 5000, "file", "drop", op="write", path="a", count=60),
        event(8, 6000, "file", "drop", op="rename", path="b", count=60),
        event(9, 7000, "file", "calm", op="write", path="c", count=99),
    ]
    start = [("s", "office", office, "", "u", None), ("s", "guard", "C:\\Guard\\MsMpEng.exe", "", "s", None), ("s", "lsass", system + "lsass.exe", "", "s", None), ("s", "calm", "x", "", "u", None)]
    rules = [*DEFAULT_RULES, DetectionRule("temp-binary-execution", "match", match={"type": "^spawn$", "image": r"(?i)\\temp\\", "ancestor.image": r"(?i)excel\.exe$"})]
    scoped = lives.scoped(spark.createDataFrame(rows, EVENT), spark.createDataFrame(start, INITIAL), rules)
    found = sorted((r.t, r.events[-1], r.rule_id) for r in detect.detect(scoped, rules, column=lives.scope_column(rules)).collect())
    assert [x[2] for x in found] == ["encoded-powershell", "office-spawns-script-host", "temp-binary-execution", "orphaning-parent-exit", "inhibit-system-recovery", "security-tool-termination", "lsass-access", "process-injection", "run-key-persistence", "mass-file-encryption"]


def test_rule_packs(spark, tmp_path):
    rules = [{"id": "m", "match": {"type": "^x$"}, "severity": "high"}, {"id": "t", "threshold": {"match": {"type": "f"}, "count": 3, "by": "parent"}}, {"id": "s", "sequence": {"within": 5, "steps": [{"match": {"type": "a"}, "bind": {"P": "parent.id"}}, {"match": {"type": "b", "target.id": "$P"}}]}}]
    bad = [{"id": "two", "match": {"a": "b"}, "threshold": {"match": {}, "count": 1}}, {"id": "open", "match": {"image": "("}}, {"match": {}}, {"id": "one", "sequence": {"steps": [{"match": {}}]}}, {"id": "sev", "severity": "x", "match": {"a": "b"}}]
    (tmp_path / "a.json").write_text(json.dumps({"rules": rules + bad}))
    (tmp_path / "b.json").write_text("{")
    found, rejects = load_process_rules(spark, str(tmp_path))
    assert [r.rule_id for r in found] == ["m", "t", "s"] and found[1].group == "parent.id" and found[2].steps[0] == {"type": "a", "parent.id": "$P"}
    assert sorted((r.place, r.rule_id) for r in rejects.where("place is not null").collect()) == [(3, "two"), (4, "open"), (5, None), (6, "one"), (7, "sev")]
    assert rejects.where("place is null").count() == 1
