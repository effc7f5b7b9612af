"""Rules, scores, lists and changes: small cases with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.operators import changes, names, rules, score
from riskframe.operators.rules import Rule


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_positions_and_validators(spark):
    frame = spark.createDataFrame([(1, "a 4111111111111111\n\n😀b 4111111111111112 4111111111111111"), (2, None), (3, "")], "doc_id long, text string")
    rule = Rule("r", r"[0-9]{13,19}", validate="luhn", message="card {{value}} {{other}}")
    found = sorted(rules.scan(frame, [rule]).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.line, r.col, r.start) for r in found] == [(1, 0, 2, 2), (1, 2, 20, 40)]
    assert found[0].message == "card 4111111111111111 {{other}}"


def test_rule_gates(spark):
    docs = spark.createDataFrame([("a.ts", "ts", "x y"), ("a.test.ts", "ts", "y"), ("b.go", "go", "x\nesphome:")], "path string, language string, text string")
    y = Rule("y", "y", languages=("ts",))
    z = Rule("z", "x|y", exclude_path_pattern=r"\.test\.ts$", when="^esphome:|y")
    absent = Rule("no", r"^x$", kind="absent", anchor="esp")
    got = rules.scan(docs, [y, z, absent], id_col="path", path_col="path", language_col="language").collect()
    assert sorted((r.path, r.rule_id) for r in got) == [("a.test.ts", "no"), ("a.test.ts", "y"), ("a.ts", "no"), ("a.ts", "y"), ("a.ts", "z"), ("a.ts", "z"), ("b.go", "z")]
    assert not [r for r in rules.scan(docs, [y], id_col="path", disabled=("y",)).collect()]


@pytest.mark.parametrize("comment,left", [("", 1), ("// lint-ignore r\n", 1), ("// lint-ignore-next-line r\n", 0), ("// lint-ignore-next-line other, r\n", 0), ("// lint-ignore-file *\n", 0), ("// lint-ignore-file q\n", 1)])
def test_suppression(spark, comment, left):
    docs = spark.createDataFrame([(1, comment + "bad")], "doc_id long, text string")
    found = rules.scan(docs, [Rule("r", "bad")])
    assert rules.suppress(found, rules.directives(docs)).count() == left


def test_osa(spark):
    def brute(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))
    pairs = [("python", "pyhton"), ("kitten", "sitting"), ("lodahs", "lodash"), ("ca", "abc")] + [(word(), word()) for _ in range(150)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.osa(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == brute(r.a, r.b) for r in rows)


def test_functions(spark):
    assert one(spark, tx.round1(F.lit(-0.05))) == 0.0
    assert abs(one(spark, tx.shannon(F.lit("aabb"))) - 1) < 1e-12 and one(spark, tx.shannon(F.lit(""))) == 0
    assert one(spark, tx.signal_id(F.lit("ext/dynamic-code.eval"))) == "ext/dynamic-code"
    assert one(spark, tx.lifetime_seconds(F.lit("expiresIn: 60 * 60 * 2"))) == 7200 and one(spark, tx.lifetime_seconds(F.lit("15 * time.Minute"))) == 900
    assert one(spark, tx.bits_of(F.lit("0xa1"))) == [1, 0, 1, 0, 0, 0, 0, 1]
    assert one(spark, tx.sensitive(F.lit("cardNumber"))) and not one(spark, tx.sensitive(F.lit("panel")))
    assert one(spark, tx.version_key(F.lit("1.2.0-beta")) < tx.version_key(F.lit("1.2.0")))
    assert one(spark, tx.public_ipv4(F.lit("93.184.216.34"))) and not one(spark, tx.public_ipv4(F.lit("10.0.0.1")))
    assert one(spark, tx.editor_of(F.lit("/home/a/.vscode/extensions/x"))) == "vscode"


VECTORS = [("process-exec", 1.0, "process"), ("native-binary", 1.0, "native"), ("dynamic-code", 1.0, "obfuscation"), ("activates-after-startup", 1.0, "manifest"), ("credential-path", 3.0, "data"), ("exfil-endpoint", 3.0, "network"), ("unknown-publisher", 0.0, "reputation"), ("activates-on-startup", 2.0, "manifest"), ("known-bad", 10.0, "reputation"), ("privilege-escalation", 5.0, "process"), ("shell-interpreter", 3.0, "process"), ("process-kill", 2.0, "process"), ("chmod-exec", 2.0, "process"), ("verified-publisher", -1.0, "reputation"), ("obfuscated", 3.0, "obfuscation")]


def scored(spark, packages, allowed=()):
    weights = {v[0]: v[1] for v in VECTORS}
    rows = [(p, s, weights[s], s, 1, "high" if s == "known-bad" else None, k) for p, ids in packages.items() for k, s in enumerate(ids)]
    signals = score.merge(spark.createDataFrame(rows, "pkg_id string, signal_id string, weight double, message string, count long, force string, ord long"))
    vectors = spark.createDataFrame(VECTORS, "signal_id string, weight double, category string")
    allow = spark.createDataFrame([(a,) for a in allowed], "pkg_id string")
    return {r.pkg_id: r for r in score.score(signals, vectors, allowed=allow).collect()}


def test_scores(spark):
    got = scored(
        spark,
        {
            "lsp": ["process-exec", "native-binary", "dynamic-code", "activates-after-startup"],
            "thief": ["credential-path", "exfil-endpoint"],
            "start": ["unknown-publisher", "activates-on-startup", "process-exec"],
            "damped": ["privilege-escalation", "shell-interpreter", "process-kill", "chmod-exec"],
            "bad": ["known-bad"],
            "calm": ["verified-publisher"],
            "capped": ["credential-path", "shell-interpreter", "obfuscated", "native-binary"],
            "allowed": ["credential-path", "exfil-endpoint"],
        },
        allowed=("bad", "allowed"),
    )
    shown = {k: (r.score, r.level) for k, r in got.items()}
    assert shown == {"lsp": (4.0, "low"), "thief": (10.0, "high"), "start": (5.0, "medium"), "damped": (7.3, "medium"), "bad": (10.0, "high"), "calm": (0.0, "low"), "capped": (10.0, "medium"), "allowed": (0.0, "low")}
    assert got["capped"].capped and got["bad"].allowlist_overridden


def test_typosquats(spark):
    popular = spark.createDataFrame([(1, "ms-python.python"), (2, "esbenp.prettier-vscode"), (3, "dbaeumer.vscode-eslint"), (4, "ab.cd")], "ord int, id string")
    ids = spark.createDataFrame([("ms-pythom.python",), ("esbenpp.prettier-vscode",), ("dbaeurner.vscode-es1int",), ("ms-python.pyhton",), ("other.thing",), ("ms-python.python",), ("ba.cd",)], "id string")
    got = {r.id: (r.target, r.reason, r.distance) for r in names.typosquats(ids, popular).collect()}
    assert got == {"ms-pythom.python": ("ms-python.python", "distance", 1), "esbenpp.prettier-vscode": ("esbenp.prettier-vscode", "distance", 1), "dbaeurner.vscode-es1int": ("dbaeumer.vscode-eslint", "homoglyph", 0), "ba.cd": ("ab.cd", "distance", 1)}
    npm = spark.createDataFrame([("lodahs",), ("lodash",), ("re-act",), ("@a/lodahs",), ("abc",)], "name string")
    known = spark.createDataFrame([(1, "lodash"), (2, "react")], "ord int, name string")
    assert {r.name: r.target for r in names.npm_typosquats(npm, known).collect()} == {"lodahs": "lodash", "re-act": "react"}


def test_bench_and_lists(spark):
    schema = "name string, median_ns double, memory long"
    base = spark.createDataFrame([("a", 100.0, 1), ("b", 100.0, 1), ("c", 100.0, 100), ("gone", 1.0, 1), ("zero", 0.0, 0)], schema)
    now = spark.createDataFrame([("a", 120.0, 1), ("b", 90.0, 1), ("c", 103.0, 200), ("new", 1.0, 1), ("zero", 0.0, 5)], schema)
    got = {r.name: (r.verdict, r.memory_verdict) for r in changes.judge(base, now).collect()}
    assert got == {"a": ("regression", "invariant"), "b": ("improvement", "invariant"), "c": ("invariant", "regression"), "gone": ("removed", "removed"), "new": ("added", "added"), "zero": ("invariant", "regression")}
    entry = "id string, version string, file string, line int, remove boolean"
    before = spark.createDataFrame([("A.x", "1", "f", 1, False), ("b.y", None, "f", 2, False)], entry)
    after = spark.createDataFrame([("a.X", "2", "f", 1, False), ("c.z", None, "f", 3, False), ("d.w", None, "f", 4, True)], entry)
    assert {r.id.lower(): r.status for r in changes.diff_lists(before, after).collect()} == {"a.x": "changed", "b.y": "removed", "c.z": "added"}


def test_outliers(spark):
    rows = [(f"p{k}", "network", float(k % 3)) for k in range(6)] + [("evil.x", "network", 9.0)]
    scores = spark.createDataFrame(rows, "pkg_id string, category string, score double")
    assert [r.pkg_id for r in score.outliers(scores, scores).collect()] == ["evil.x"]
    few = scores.where("pkg_id in ('p0', 'p1', 'evil.x')")
    assert score.outliers(few, few).count() == 0


def test_recommendations_and_coverage(spark):
    risk = spark.createDataFrame([("a", "high"), ("b", "low")], "pkg_id string, level string")
    signals = spark.createDataFrame([("a", "typosquat"), ("b", "stale"), ("b", "known-bad")], "pkg_id string, signal_id string")
    got = {(r.pkg_id, r.advice) for r in score.recommendations(risk, signals).collect()}
    assert got == {("a", "verify"), ("a", "review"), ("b", "update"), ("b", "uninstall")}
    vectors = spark.createDataFrame([("x", "c", ["core"], False), ("y", "c", ["go"], False), ("z", "c", ["core"], True)], "signal_id string, category string, engines array<string>, online boolean")
    r = score.coverage(vectors, vectors.where("signal_id = 'x'"), engines=("core",), online=False).first()
    assert (r.total, r.ran, r.offline, r.no_engine, r.other) == (3, 1, 1, 1, 0)
