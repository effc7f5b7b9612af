"""Manifest and gallery signals."""

import json

from pyspark.sql import functions as F

from riskframe.operators import packages


def test_manifests(spark):
    loud = {
        "name": "python", "displayName": "Microsoft Tools", "main": "./assets/x.png", "activationEvents": ["*", "onUri", "workspaceContains:**/*"], "extensionDependencies": ["a.b", "x.c", "c.d", "d.e"],
        "capabilities": {"untrustedWorkspaces": {"supported": True}}, "scripts": {"postinstall": "x"},
        "contributes": {"terminal": {"profiles": [{}]}, "keybindings": [{"key": "Ctrl + C"}, {"key": "ctrl+v", "when": "x"}], "configurationDefaults": {"security.a": 1, "http.proxy": "p"}, "debuggers": [{"windows": {"program": "x"}}], "jsonValidation": [{"url": "https://evil.example/s"}], "walkthroughs": [{"steps": [{"media": {"image": "https://a/b.png"}}]}]},
    }
    calm = {"name": "ok", "main": "./out/a.js", "repository": "r", "license": "MIT", "extensionKind": ["workspace"]}
    rows = [("x.python", "vsix", False, False, json.dumps(loud)), ("good.ok", "gallery", False, True, json.dumps(calm)), ("odd.none", "gallery", False, True, "not json")]
    frame = spark.createDataFrame(rows, "pkg_id string, source string, builtin boolean, has_license boolean, manifest string")
    popular = spark.createDataFrame([(1, "ms-python.python")], "ord int, id string")
    removed = spark.createDataFrame([("X.Python", "Malware")], "id string, type string")
    got = {}
    for r in packages.manifest_signals(frame, trusted=["good"], popular=popular, removed=removed).collect():
        got.setdefault(r.pkg_id, {})[r.signal_id] = r.weight
    assert got["good.ok"] == {"trusted-publisher": -2.0}
    assert got["odd.none"] == {"missing-repository": 0.0, "unknown-publisher": 0.0}
    assert set(got["x.python"]) == {"activates-on-startup", "uri-handler", "broad-workspace-contains", "many-dependencies", "untrusted-workspace", "terminal-profile", "keybinding-override", "security-setting-defaults", "proxy-defaults", "debug-adapter-executable", "remote-schema", "remote-walkthrough-media", "unknown-dependency", "missing-repository", "missing-license", "manifest-install-scripts", "unusual-entry", "brand-impersonation", "sideloaded", "unknown-publisher", "known-bad"}
    signals = spark.createDataFrame([("good.ok", "process-exec"), ("x.python", "process-exec")], "pkg_id string, signal_id string")
    assert [r.pkg_id for r in packages.workspace_exec(frame, signals).collect()] == ["good.ok"]


def test_gallery(spark):
    rows = [("a", True, True, 5000, "2024-01-01"), ("b", True, False, 10, "2020-01-01"), ("c", False, None, None, None)]
    frame = spark.createDataFrame(rows, "id string, found boolean, verified boolean, installs long, last string").withColumn("last_updated", F.to_timestamp("last"))
    got = {(r.pkg_id, r.signal_id) for r in packages.gallery_signals(frame, "2024-06-01").collect()}
    assert got == {("a", "verified-publisher"), ("b", "unverified-publisher"), ("b", "low-installs"), ("b", "stale"), ("c", "not-on-marketplace")}
