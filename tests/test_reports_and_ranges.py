"""Report sinks, samples by byte ranges, evidence by recorded calls."""

import json
import random

import pytest

from riskframe.operators import runtime
from riskframe.sources import readers, reports

FINDING = "path string, rule_id string, severity string, message string, line int, col int"


def findings(spark, n=500):
    rows = [(f"f{k % 7}.c", f"r{k % 5}", ["error", "warning", "info", "hint"][k % 4], f"m {k} \u00e9 \"q\"", k, k % 80) for k in range(n)]
    return spark.createDataFrame(rows, FINDING).repartition(4)


def test_sarif_in_parts(spark, tmp_path):
    reports.register(spark)
    out = tmp_path / "run"
    for n in (500, 60):  # the second run replaces the first
        findings(spark, n).write.format("sarif").mode("overwrite").option("tool", "t").save(str(out))
        run = json.loads((out / "run.sarif").read_text())["runs"][0]
        refs = run["externalPropertyFileReferences"]["results"]
        results = [r for ref in refs for r in json.loads((out / ref["location"]["uri"]).read_text())["results"]]
        assert len(results) == n == sum(r["itemCount"] for r in refs) and run["tool"]["driver"] == {"name": "t", "rules": [{"id": f"r{k}"} for k in range(5)]}
        assert sorted(r["message"]["text"] for r in results) == sorted(r.message for r in findings(spark, n).collect())
        first = next(r for r in results if r["message"]["text"].startswith("m 6 "))
        assert first["level"] == "note" and first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "f6.c"}, "region": {"startLine": 7, "startColumn": 7}}
    assert len(list(out.iterdir())) == len(refs) + 1
    findings(spark, 1).limit(0).write.format("sarif").mode("overwrite").save(str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "run.sarif").read_text())["runs"][0]["externalPropertyFileReferences"]["results"] == []


def test_json_report(spark, tmp_path):
    reports.register(spark)
    findings(spark).write.format("report").mode("overwrite").save(str(tmp_path))
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["findings"] == 500 and report["bySeverity"] == dict.fromkeys(["error", "hint", "info", "warning"], 125) and report["byRule"]["r3"] == 100
    lines = [json.loads(x) for p in report["parts"] for x in (tmp_path / p).read_text().splitlines()]
    assert sorted(x["line"] for x in lines) == list(range(500))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    reports.register(spark)
    bad = findings(spark).selectExpr("path", "rule_id", "severity", "if(line = 77, raise_error('lost'), message) as message", "line", "col")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("sarif").mode("overwrite").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="lack"):
        findings(spark).drop("path").write.format("sarif").mode("overwrite").save(str(tmp_path))


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 1 << 25])
def test_samples_by_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(readers, "RANGE", size)
    monkeypatch.setattr(readers, "SAMPLES", 5)
    rnd = random.Random(size)
    n = 40 if size < 7 else 300
    numbers = [rnd.randint(0, 255) for _ in range(n)]
    text = "".join((f"0x{x:x}" if rnd.random() < 0.3 else str(x)) + rnd.choice([" ", "\n", ", ", ";;\t"]) for x in numbers)
    (tmp_path / "a.txt").write_text("  " + text)
    (tmp_path / "b.txt").write_text(text.strip(" \n,;\t"))
    (tmp_path / "c.bin").write_bytes(bytes(numbers))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "blank.txt").write_text(" \n ")
    got = {}
    for r in readers.read_samples(spark, str(tmp_path)).collect():
        got.setdefault(r.source_id.rsplit("/", 1)[1], []).append((r.i, r.sym))
    assert {k: sorted(v) for k, v in got.items()} == dict.fromkeys(["a.txt", "b.txt", "c.bin"], list(enumerate(numbers)))


def test_samples_out_of_range(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 256")
    with pytest.raises(Exception, match="from 0 to 255"):
        readers.read_samples(spark, str(tmp_path)).collect()


def test_calls_confirm_signals(spark):
    call = "pkg_id string, api string, id string, key string, html string, options string, scripts boolean, uris boolean"
    calls = [("p", "terminal.sendText", None, None, None, None, None, None), ("p", "configuration.update", None, "http.proxy", None, None, None, None), ("p", "webview.html", None, None, "<script src='https://x'>", None, True, None), ("q", "commands.executeCommand", "workbench.extensions.installExtension", None, None, None, None, None), ("q", "configuration.update", None, "editor.font", None, None, None, None)]
    seen = runtime.api_evidence(spark.createDataFrame(calls, call))
    assert {(r.pkg_id, r.signal_id) for r in seen.collect()} == {("p", "terminal-injection"), ("p", "settings-tamper"), ("p", "security-setting-defaults"), ("p", "webview-remote-content"), ("p", "webview-remote-script"), ("p", "webview-no-csp"), ("q", "extension-install")}
    assert {name for name, _ in runtime.api_confirms()} == set(runtime.API_SIGNALS)
    static = spark.createDataFrame([("p", "terminal-injection", 4.0), ("p", "uri-handler", 1.0), ("p", "other", 1.0), ("q", "settings-tamper", 0.0), ("q", "extension-install", 4.0)], "pkg_id string, signal_id string, weight double")
    ran = spark.createDataFrame([("q", "net")], "pkg_id string, signal_id string")
    mapping = spark.createDataFrame([("extension-install", "net"), ("other", "net")], "signal_id string, runtime_id string")
    got = {(r.pkg_id, r.signal_id): (r.verdict, r.evidence) for r in runtime.evidence_chain(static, ran, mapping, seen).collect()}
    assert got == {("p", "terminal-injection"): ("confirmed", ["terminal.sendText"]), ("p", "uri-handler"): ("not-observed", []), ("p", "other"): ("not-observed", []), ("q", "extension-install"): ("confirmed", ["net", "commands.executeCommand"])}
