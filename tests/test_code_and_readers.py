"""Texts that are long or nested, code literals, rule packs, readers, and the entry without optional packages."""

import json
import random
import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.operators import code, detect, entropy, hosts, profiles, rules
from riskframe.operators.rules import Rule
from riskframe.plans.documents import EMAIL, RULES
from riskframe.sources import readers, sinks


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_long_lines_of_directives(spark):
    """A directive of 100,000 names, and one of a single name of that length, end no stack."""
    names = " ".join(f"r{k}" for k in range(100_000))
    docs = spark.createDataFrame([(1, f"# lint-ignore {names}\nx"), (2, "# lint-ignore-file pci/pan, net/ip\n"), (3, "# lint-ignore " + "a" * 100_000), (4, None)], "doc_id long, text string")
    found = rules.directives(docs)
    assert found.where("doc_id = 1").count() == 100_000
    assert sorted((r.line, r.rule_id) for r in found.where("doc_id = 2").collect()) == [(None, "net/ip"), (None, "pci/pan")]
    assert found.where("doc_id = 3").count() == 1


def test_long_escapes(spark):
    quoted = lambda s: f'let a = "{s}"'
    assert one(spark, quoted("\\x41" * 100_000), tx.escape_density) == "run of escapes"
    assert one(spark, quoted("\\u0041\\x41" * 20), tx.escape_density) == "run of escapes"
    assert one(spark, quoted("\\x41" * 39), tx.escape_density) is None
    assert one(spark, "\\x41" * 100, tx.escape_density) is None  # no literal
    assert one(spark, ",".join(["'\\x41\\x42\\x43\\x44'"] * 150), tx.escape_density) == "literals of escapes"
    assert one(spark, ",".join(["'\\x41\\x42\\x43\\x44'"] * 149), tx.escape_density) is None
    assert one(spark, "[]()!+" * 100_000, tx.escape_density) == "code of brackets"
    assert one(spark, None, tx.escape_density) is None


def test_long_hosts_and_addresses(spark):
    labels = "a." * 100_000 + "com"
    docs = spark.createDataFrame([(1, f"see https://{labels}/x and me@{labels} now")], "pkg_id long, text string")
    assert [r.host for r in hosts.inventory(docs).collect()] == [labels]
    assert [r.value for r in rules.scan(docs, [EMAIL], id_col="pkg_id").collect()] == ["me@" + labels]


def test_match_places(spark):
    text = "é1 22\n333\n\n" + "44 x5\n" * 700 + "6"
    got = [(m["start"], m["line"], m["col"], m["matched"]) for m in one(spark, text, lambda c: tx.matches(c, "[0-9]+"))]
    want = [(m.start(), text[: m.start()].count("\n"), m.start() - (text.rfind("\n", 0, m.start()) + 1), m[0]) for m in re.finditer("[0-9]+", text)]
    assert got == want and len(got) > 4 * tx.BLOCK
    assert one(spark, "none", lambda c: tx.matches(c, "[0-9]+")) == [] and one(spark, None, lambda c: tx.matches(c, "[0-9]+")) is None


def test_entropy_of_long_texts(spark):
    assert one(spark, "abcd" * 50_000, tx.shannon) == 2.0 and one(spark, "", tx.shannon) == 0.0 and one(spark, "zz", tx.shannon) == 0.0


def test_code_literals(spark):
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = alphabet * 7
    escapes = "".join(f"\\x{(k * 37) % 256:02x}" for k in range(100_000))
    texts = [f'eval("{blob}")', f'let a = "{blob}"', f'"{blob}" ' + "x" * 401 + " eval(", f"Function('{escapes}')", f'"{"a" * 500}" eval(1)', f'"iVBOR{blob}"', "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in code.code_findings(docs).collect():
        got.setdefault(r.doc_id, {})[r.rule_id] = r
    assert set(got[0]) == {"packed-payload", "high-entropy-literal"} and got[0]["packed-payload"].detail == "eval" and got[0]["packed-payload"].start == 5
    assert set(got[1]) == {"encoded-blob", "high-entropy-literal"} == set(got[2])
    assert got[1]["encoded-blob"].entropy == 6.0 and got[1]["encoded-blob"].length == len(blob)
    assert set(got[3]) == {"packed-payload", "escapes"} and got[3]["packed-payload"].detail == "Function"
    assert 4 not in got and set(got[5]) == {"encoded-blob"} and 6 not in got and 7 not in got


def test_targets_and_places(spark):
    rows = {"http://93.184.216.34/x": "a literal public IP address", "10.0.0.1:80": None, "93.184.216.34:80": "a literal public IP address", "https://webhook.site/a": "an exfiltration or tunnelling service", "https://a.onionx": None, "https://u:p@1.2.3.4:8/": "a literal public IP address", "1.2.3": None, "01.2.3.4": None, "256.1.1.1": None}
    assert {k: one(spark, k, tx.suspicious_target) for k in rows} == rows
    assert tuple(one(spark, "run (/a b/c.js:12:5)", tx.trace_location)) == ("/a b/c.js", 11, 4) and one(spark, "native", tx.trace_location) is None
    manifest = json.dumps({"repository": {"url": "git+https://GitHub.com/a/b.git"}, "homepage": "http://me@x.example:80/p", "bugs": "none"})
    assert one(spark, manifest, tx.declared_hosts) == ["github.com", "x.example"]
    assert one(spark, "ＰÿｔｈόΝ é", tx.fold_lookalikes).startswith("pyth")


def test_rule_packs(spark, tmp_path):
    good = {"id": "a/one", "title": "t", "message": "m", "severity": "error", "languages": ["*"], "kind": "pattern", "pattern": "x(?<value>[0-9]+)", "validate": "luhn"}
    pack = {"id": "p", "rules": [good, good, {**good, "id": "a/two", "severity": "bad"}, {**good, "id": "a/three", "pattern": "(("}, {**good, "id": "a/four", "kind": "query", "query": "q"}, "text", {**good, "id": "a/five", "kind": "absent", "pattern": "y", "validate": None}]}
    (tmp_path / "a.json").write_text(json.dumps(pack))
    (tmp_path / "b.yaml").write_text("id: q\nrules:\n  - {id: a/one, title: t, message: other, severity: info, languages: [en], kind: pattern, pattern: z}\n")
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text('{"rules": 1}')
    found, rejects = rules.load_rules(spark, str(tmp_path))
    assert [(r.rule_id, r.kind, r.group) for r in found] == [("a/one", "pattern", 1), ("a/five", "absent", 0), ("a/one", "pattern", 0)]
    wrong = {(r.source.rpartition("/")[2], r.place, r.rule_id) for r in rejects.collect()}
    assert wrong == {("a.json", 1, "a/one"), ("a.json", 2, "a/two"), ("a.json", 3, "a/three"), ("a.json", 4, "a/four"), ("a.json", 5, None), ("c.json", None, None), ("d.json", None, None)}
    assert [(r.rule_id, r.message) for r in rules.union_rules(found[:1], found[1:])] == [("a/one", "m"), ("a/five", "m")]
    docs = spark.createDataFrame([(1, "x4111111111111111 x12")], "doc_id long, text string")
    assert [(r.rule_id, r.value) for r in rules.scan(docs, rules.union_rules(found)).orderBy("rule_id").collect()] == [("a/five", ""), ("a/one", "4111111111111111")]


def test_an_anchor_and_paths(spark):
    docs = spark.createDataFrame([(1, "/w/sdkconfig", "A=1\n# X is not set\n"), (2, "/w/other.txt", "A=1"), (3, "/w/sdkconfig", "X=y")], "doc_id long, path string, text string")
    rule = Rule("r", "^X=y$", kind="absent", anchor="# X", path_pattern=r"(?:^|/)sdkconfig$")
    assert [(r.doc_id, r.line, r.col) for r in rules.scan(docs, [rule], path_col="path").collect()] == [(1, 1, 0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.c").write_bytes(b"int x;")
    (tmp_path / "b.c").write_bytes(b"\x10\x01\x00\x02 real NUL behind a misaligned one")
    (tmp_path / "c.py").write_bytes(b"\x10\x01 none")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.js").write_text("x")
    assert sorted(r.rel for r in readers.read_documents(spark, str(tmp_path)).collect()) == ["a.c", "c.py"]


def test_active_packages(spark, tmp_path):
    for top, listed in (("one", True), ("two", False)):
        for name in ("a", "b", "c"):
            folder = tmp_path / top / name
            folder.mkdir(parents=True)
            (folder / "package.json").write_text(json.dumps({"publisher": "P", "name": name + top}) if name != "c" else "{bad")
        if listed:
            (tmp_path / top / "extensions.json").write_text(json.dumps([{"relativeLocation": "a"}]))
        (tmp_path / top / ".obsolete").write_text(json.dumps({"b": True}))
    assert sorted(r.pkg_id for r in readers.read_packages(spark, str(tmp_path)).collect()) == ["p.aone", "p.atwo"]


def test_manifest_hashes(spark):
    plain = b'{"name":"a b","n":1}'
    rows = [("a", plain), ("b", b'{ "__metadata": {"id": "x}", "o": {"p": {}}}, "name": "a b",\n "n": 1 }'), ("c", b'{"name":"a  b","n":1}'), ("d", b'{"name":"a b","n":1,"__metadata":{}}')]
    files = spark.createDataFrame([(k, "package.json", bytearray(v)) for k, v in rows] + [("a", ".vsixmanifest", bytearray(b"x"))], "pkg_id string, rel string, content binary")
    got = {r.pkg_id: r.sha256 for r in readers.file_hashes(files).collect()}
    assert got["a"] == got["b"] == got["d"] != got["c"] and len(got) == 4


def test_other_readers(spark, tmp_path):
    body = {"results": [{"extensions": [{"publisher": {"publisherName": "P", "flags": "verified"}, "extensionName": "a", "lastUpdated": "2024-01-02T03:04:05Z", "statistics": [{"statisticName": "install", "value": 12.0}]}]}]}
    got = readers.read_gallery(spark.createDataFrame([(json.dumps(body),)], "body string"), spark.createDataFrame([("p.A",), ("q.b",)], "id string"))
    assert {r.id: (r.found, r.verified, r.installs) for r in got.collect()} == {"p.A": (True, True, 12), "q.b": (False, None, None)}
    (tmp_path / "e.json").write_text('{"scenario":"s","idx":0,"type":"spawn","process":"a"}\n{"scenario":"s","idx":1,"type":"odd","process":"a"}\n{"scenario":"s","idx":2,"t":9,"type":"exit","process":"a"}\n')
    assert [(r.idx, r.t) for r in readers.read_process_events(spark, str(tmp_path / "e.json")).orderBy("idx").collect()] == [(0, 1), (2, 9)]
    (tmp_path / "list.txt").write_text("a.b@1.2.3 # c\n-c.d\nno entry\n")
    (tmp_path / "list.json").write_text('{ // "x" \n "recommendations": ["e.f",], /* y */ "unwantedRecommendations": ["g.h"], "long": "' + "\\\\n" * 50_000 + '"}')
    got = sorted((r.id, r.version, r["remove"]) for r in readers.read_list_entries(spark, str(tmp_path / "list*"), "head").collect())
    assert [(i, str(v), rm) for i, v, rm in got] == [("a.b", "1.2.3", False), ("c.d", "None", True), ("e.f", "None", False), ("g.h", "None", True)]


def test_risk_report(spark):
    risk = spark.createDataFrame([("a", "high", 9.5), ("b", "low", 0.0)], "pkg_id string, level string, score double")
    signals = spark.createDataFrame([("a", "x", "m", [("f.js", 3), ("g.js", 4)]), ("b", "y", "n", None)], "pkg_id string, signal_id string, message string, locations array<struct<file:string,line:int>>")
    got = sorted((r.pkg_id, r.rule_id, r.severity, r.file, r.line) for r in sinks.risk_findings(risk, signals).collect())
    assert got == [("a", "ext/risk", "error", "package.json", 0), ("a", "ext/x", "error", "f.js", 3), ("a", "ext/x", "error", "g.js", 4), ("b", "ext/risk", "info", "package.json", 0), ("b", "ext/y", "info", "package.json", 0)]


def test_deep_chains_and_cycles(spark):
    n = 300
    rows = [("s", k, k - 1 if k else None) for k in range(n)] + [("c", k, (k + 1) % 5) for k in range(5)]
    got = detect.ancestors(spark.createDataFrame(rows, "scenario string, process long, parent long")).collect()
    assert {(r.process, r.ancestor): r.depth for r in got if r.scenario == "s"} == {(a, b): a - b for a in range(n) for b in range(a)}
    assert {(r.process, r.ancestor): r.depth for r in got if r.scenario == "c"} == {(a, b): (b - a) % 5 for a in range(5) for b in range(5) if a != b}
    nodes = spark.createDataFrame([("p", k, k - 1 if k else None, 1.0) for k in range(n)], "profile_id string, node_id long, parent_id long, self double")
    assert {r.node_id: (r.total, r.size) for r in profiles.tree_totals(nodes).collect()} == {k: (float(n - k), n - k) for k in range(n)}


def test_users_come_from_parents(spark):
    event = "scenario string, idx long, t long, type string, process string, parent string, user string, image string, cmdline string"
    rows = [("s", 0, 5, "spawn", "b", "a", None, "ib", "x"), ("s", 1, 6, "spawn", "c", "b", None, "ic", "y"), ("s", 2, 7, "spawn", "a", None, "new", "ia", "z"), ("s", 3, 8, "spawn", "d", "a", None, "id", "w"), ("s", 4, 9, "exec", "c", None, None, "ic2", "v"), ("s", 5, 9, "file", "q", None, None, None, None), ("s", 6, 10, "spawn", "e", "nobody", None, "ie", "u")]
    start = spark.createDataFrame([("s", "a", "i0", "c0", "old", None)], "scenario string, process string, image string, cmdline string, user string, parent string")
    events = spark.createDataFrame(rows, event)
    got = {r.idx: (r.p_image, r.p_user) for r in detect.enrich(events, start).collect()}
    assert got == {0: ("ib", "old"), 1: ("ic", "old"), 2: ("ia", "new"), 3: ("id", "new"), 4: ("ic2", "old"), 5: ("?", None), 6: ("ie", None)}
    assert [(r.process, r.n, r.first_idx) for r in detect.unseen(events, start).collect()] == [("q", 1, 5)]


def test_assessment_takes_tuples(spark):
    rnd = random.Random(4)
    block = [rnd.randrange(4) for _ in range(12)]
    noisy = [s for _ in range(60) for s in (*block, *(rnd.randrange(4) for _ in range(3)))]
    rows = [("p", i, s) for i, s in enumerate(noisy)] + [("one", i, 7) for i in range(5000)] + [("two", i, 5 + s // 2) for i, s in enumerate(noisy)]
    frame = spark.createDataFrame(rows, "source_id string, i long, sym int")
    got = {r.source_id: r for r in entropy.assess(frame).collect()}
    t = entropy.tuples(entropy.tuple_counts(frame.where("source_id = 'p'"))).first()
    assert got["p"].h_original <= min(t.t_tuple, t.lrs) + 1e-12 and got["p"].width == 2 and got["p"].h <= 2 * got["p"].h_bits and got["p"].warning
    assert got["one"].h == 0.0 and (got["one"].k, got["one"].width) == (1, 3)
    assert (got["two"].k, got["two"].width, got["two"].h_bits) == (2, 3, None) and got["two"].h == got["two"].h_original <= 1.0


def test_entry_without_optional_packages():
    """The other queries stay where a package of the corpus operators is missing."""
    run = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pan_findings' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", run], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "True" and int(out[2]) > 100


def test_rules_cover_the_registered_ones():
    assert len({r.rule_id for r in RULES}) == len(RULES)
