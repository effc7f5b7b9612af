"""Repair of conversations against an enumeration of all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from riskframe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, edit string, block long"
RIGHT = re.compile("(s?(ua)+)?")


def faults(rows):
    """rows: (role, text) in order."""
    out, seen = [], set()
    for row in rows:
        body = row[1].strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if row in seen else "t" if body[-1] not in ".!?" else ".")
        seen.add(row)
    return out


def cheapest(rows):
    """Every edit sequence that costs no more than deleting all rows."""
    marks, most = faults(rows), 2 * len(rows)
    best = [(most, "D" * len(rows), [])]

    def go(i, cost, audit, done):
        if cost > most or cost > best[0][0]:
            return
        if i == len(rows) and RIGHT.fullmatch("".join(r[:1] for r, _ in done)):
            best[0] = min(best[0], (cost, audit, done))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*done, (role, "")])
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, cost + 2, audit + "D", done)
        if marks[i] not in "bd":
            more = 5 if marks[i] == "t" else 0
            go(i + 1, cost + more, audit + "K", [*done, (role, text)])
            for other in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", [*done, (other, text)])

    go(0, 0, "", [])
    return best[0]


def expected(rows):
    """rows: (turn, role, text) of a conversation after damage."""
    rows = sorted(((t, r or " ", x or " ") if r is None or x is None else (t, r, x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    marks = faults([x[1:] for x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, done = cheapest([x[1:] for x in rows])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def made(seed, n=120, longest=6):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        turns = [None if rnd.random() < 0.1 else rnd.randint(-2, 6) for _ in range(rnd.randint(1, longest))]
        for turn in turns:
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rnd.choice(["A.", "B!", "C?", "cut", " \n", "", None, "long " * 20 + ".", f"{rnd.random()}."])
            out.append((None if conv == 7 else conv, turn, role, text, 1, 2, "x", 3))
    return out


@pytest.mark.parametrize("bits", [10, 1])
def test_repair_against_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = made(bits)
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn, role, text))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r[0]: tuple(r)[1:] for r in conversations.repair_report(df, df).collect()}
    assert found.keys() == by.keys()
    for conv, own in by.items():
        assert found[conv] == expected(own), (conv, own)


def test_solve_is_the_least_of_all_edits():
    rnd = random.Random(5)
    for _ in range(300):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "B.", "cut", "", f"{k}."])) for k in range(rnd.randint(1, 5))]
        initials = "".join(r[0] if r[0] in "sua" else "-" for r, _ in rows)
        assert conversations.solve(initials, "".join(faults(rows)), conversations.START, conversations.END) == cheapest(rows)[:2], rows


def test_long_and_repeated_rows(spark, monkeypatch):
    """One conversation of 4,000 rows, in parts, is repaired as if whole; equal rows and very long texts."""
    rnd = random.Random(3)
    rows = [(1, k // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", f"{k}.", f"{k}", "x" * 300_000 + "." if k % 1000 == 0 else f"{k}!"])) for k in range(4000)]
    rows += [(2, None, "user", "same.")] * 3000 + [(3, 2**62, "user", "a."), (3, -(2**62), "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = sorted(rows[:4000], key=lambda x: (x[1], x[2], x[3]))
    marks = faults([x[2:] for x in whole])
    cost, audit = conversations.solve("".join(x[2][0] for x in whole), "".join(marks), conversations.START, conversations.END)
    monkeypatch.setattr(conversations, "BLOCK_BITS", 8)
    found = {r.conv_id: r for r in conversations.repair_report(df, df).collect()}
    assert (found[1].cost, found[1].audit) == (cost, audit)
    assert (found[2].duplicate, found[2].cost, found[2].illegal) == (2999, 6000, 2999)
    assert found[3].gaps == 2**63 - 1 and found[3].audit == "RR"


def test_repaired_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Yes."), (1, 3, "tool", "cut"), (None, 1, "system", "S.")], "conv_id long, turn long, role string, text string")
    fix = conversations.Repair(df)
    assert sorted((r.conv, r.place, r.role, r.text) for r in fix.repaired().collect()) == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    assert sorted((r.conv or 0, r.edit) for r in fix.steps.collect()) == [(0, "D"), (1, "D"), (1, "K"), (1, "R")]
    assert conversations.repair_report(df.limit(0), df.limit(0)).count() == 0
    only = conversations.repair_report(df.limit(0), df).collect()
    assert {(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in only} == {(c, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, None)}


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (0, 1, None) for r, x in (("assistant", "One. Two!"), (None, None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if kind:
            want += [(c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in conversations.damaged(df).collect())
