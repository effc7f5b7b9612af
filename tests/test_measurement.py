"""Entropy, PUF, supply chain, content, readers and sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import content, entropy, hosts, profiles, puf, runtime, supply
from riskframe.sources import readers, sinks


def uniform(state: int):
    """Numbers from 0 to 1 of the 32-bit mulberry generator."""
    while True:
        state = (state + 0x6D2B79F5) % 2**32
        x = (state ^ state >> 15) * (state | 1) % 2**32
        x ^= (x + (x ^ x >> 7) * (x | 61)) % 2**32
        yield (x ^ x >> 14) / 2**32


@pytest.fixture(scope="module")
def bits():
    numbers = uniform(1)
    return np.array([int(next(numbers) < 0.5) for _ in range(100_000)])


# What the standard's own tool gives for these bits.
def test_sequential_estimators(bits):
    want = {"collision": 0.8671347391505004, "compression": 0.7279428573951393, "lag": 0.9920359620998089, "multi_mcw": 0.9888796307251485, "multi_mmc": 0.9846942210494974, "lz78y": 0.9931266627926287}
    for name, h in want.items():
        assert math.isclose(entropy.SEQUENTIAL[name](bits, 2), h, rel_tol=1e-9), name


def test_counting_estimators(spark, bits):
    frame = spark.createDataFrame([("s", i, int(b)) for i, b in enumerate(bits)], "source_id string, i long, sym int")
    assert math.isclose(entropy.mcv(frame).first()["h"], 0.9853511828575805, rel_tol=1e-9)
    assert math.isclose(entropy.markov(frame.withColumnRenamed("sym", "bit")).first()["h"], 0.9982086636643575, rel_tol=1e-9)
    found = entropy.tuples(entropy.tuple_counts(frame)).first()
    assert math.isclose(found.t_tuple, 0.9207811052372162, rel_tol=1e-9) and math.isclose(found.lrs, 0.9624542666043299, rel_tol=1e-9)


def test_puf(spark):
    rows = [("A", 0, "11110000"), ("A", 1, "11110001"), ("B", 0, "00001111"), ("B", 1, "00001111"), ("C", 0, "10101010")]
    frame = spark.createDataFrame([(d, r, [int(c) for c in x]) for d, r, x in rows], "device string, read int, bits array<int>")
    m = puf.metrics(frame).first()
    assert math.isclose(m.uniqueness, 2 / 3) and math.isclose(m.ber, 1 / 16) and math.isclose(m.uniformity, 21 / 40) and math.isclose(m.unstable, 1 / 24)
    assert math.isclose(puf.block_failure(spark, 1, 0.1).where("t = 0").first()["failure"], 0.1)
    t = puf.required_correction(spark, 255, 0.05, 1e-6)
    tail = lambda k: sum(math.comb(255, i) * 0.05**i * 0.95 ** (255 - i) for i in range(k + 1, 256))
    assert tail(t) <= 1e-6 < tail(t - 1)


def test_supply(spark):
    npm = spark.createDataFrame(
        [("p", "lodahs", "1.0.0", 1, {"postinstall": "curl x"}, None, None, False), ("p", "native", "2.0.0", 1, {"install": "node-gyp rebuild"}, "old", "git+ssh://x/y", False), ("p", "deep", "1.0.0", 12, None, None, "https://registry.npmjs.org/deep/-/deep.tgz", True)],
        "pkg_id string, name string, version string, depth int, scripts map<string,string>, deprecated string, resolved string, from_lock boolean",
    )
    packages = spark.createDataFrame([("p", False, 3)], "pkg_id string, has_lock boolean, n_deps int")
    got = sorted((r.signal_id, r.confidence) for r in supply.dependency_signals(npm, packages).collect())
    assert got == [("dependency-bloat", 1.0), ("dependency-install-script", 0.6), ("dependency-install-script", 0.9), ("deprecated-dependency", 1.0), ("git-dependency", 0.8), ("missing-lockfile", 1.0)]
    refs = spark.createDataFrame([("A.b", None), ("A.b", "1.0.0"), ("c.d", None), ("e.f", "9.9.9")], "id string, version string")
    versions = spark.createDataFrame([("a.B", "1.0.0", None, False), ("a.B", "1.10.0", None, False), ("a.B", "1.10.0", "linux", False), ("a.B", "2.0.0", "linux", True), ("c.d", "0.1.0", None, True), ("e.f", "1.0.0", None, False)], "id string, version string, platform string, prerelease boolean")
    got = {(r.id, r.version): (r.picked, r.platform) for r in supply.pick_versions(refs, versions, "linux").collect()}
    assert got == {("A.b", None): ("1.10.0", "universal"), ("A.b", "1.0.0"): ("1.0.0", "universal"), ("c.d", None): ("0.1.0", "universal"), ("e.f", "9.9.9"): (None, None)}
    tagged = spark.createDataFrame([("p", "1.2.3", "https://github.com/a/b.git"), ("q", "2.3", "https://github.com/a/b"), ("r", "1.0", None)], "pkg_id string, version string, repository string")
    tags = spark.createDataFrame([("A/b", "v1.2.3"), ("a/b", "1.2.3")], "repo string, tag string")
    assert {r.pkg_id for r in supply.missing_version_tags(tagged, tags).collect()} == {"q", "r"}


def test_runtime_and_content(spark):
    rows = [("r", 0.0, "spawn", "/bin/sh", None, None, None, None), ("r", 1.0, "fs", "/home/.ssh/id", "read", None, None, None), ("r", 1.0, "fs", "/box/a", "write", None, None, None), ("r", 2.0, "http", None, None, "evil.duckdns.org", 10, None), ("r", 2.0, "http", None, None, "api.ok.com", 10, None), ("calm", 0.0, "http", None, None, "ok.com", 99999, None)]
    frame = spark.createDataFrame(rows, "run_id string, t double, kind string, path string, op string, host string, bytes long, text string")
    got = {(r.run_id, r.signal_id): r.weight for r in runtime.runtime_signals(frame, declared=("ok.com",), sandbox=("/box/",)).collect()}
    assert got == {("r", "child-process-spawned"): 7.0, ("r", "fs-access-violation"): 8.0, ("r", "dns-and-http-destinations"): 6.0}
    kernel = spark.createDataFrame([("r", "RWX"), ("r", "RWX"), ("r", "RAWSOCK")], "run_id string, kind string")
    assert {r.signal_id for r in runtime.kernel_signals(kernel, 2).collect()} == {"network-raw-socket"}
    files = spark.createDataFrame([("p", "a.py", "import os as o\nfrom subprocess import run\no.system('ls')\nrun('x')\n"), ("p", "bad.py", "def (")], "pkg_id string, rel string, content string")
    assert {(r.name, r.line, r.argument) for r in content.python_calls(files).collect()} == {("os.system", 3, "ls"), ("subprocess.run", 4, "x")}
    code = spark.createDataFrame([("p", "a.c", "x = open_it(1);\nstrcpy(a, b);"), ("p", "b.c", "open_it (2); close_it(2);")], "pkg_id string, rel string, content string")
    found = content.calls(code)
    pairs = spark.createDataFrame([("open_it", "close_it")], "name string, release string")
    assert [(r.rel, r.line) for r in content.unpaired_calls(found, pairs).collect()] == [("a.c", 0)]
    blobs = spark.createDataFrame([("p", "x/data.bin", False), ("p", "y/used.zip", False), ("p", "z.enc", True)], "pkg_id string, rel string, in_deps boolean")
    texts = spark.createDataFrame([("p", "load('used.zip')")], "pkg_id string, content string")
    assert [r.rel for r in content.hidden_blobs(blobs, texts).collect()] == ["x/data.bin"]
    binary = spark.createDataFrame([("p", "a.png", bytearray(b"\x7fELF.....UPX!"), "windows"), ("p", "a.txt", bytearray(b"hello"), None)], "pkg_id string, rel string, content binary, target string")
    assert [(r.format, r.signals) for r in content.binary_signals(binary).collect()] == [("elf", ["native-binary", "binary-unexpected-path", "packed-binary", "foreign-arch"])]
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a"), ("p", "b", "c")], "pkg_id string, src string, dst string")
    flows = content.flow_signals(edges, spark.createDataFrame([("p", "a", "secret")], "pkg_id string, node string, label string"), spark.createDataFrame([("p", "c", "net")], "pkg_id string, node string, sink string"), spark.createDataFrame([("secret", "net", "exfil", 0.9)], "label string, sink string, signal_id string, confidence double"))
    assert [(r.signal_id, r.confidence) for r in flows.collect()] == [("exfil", 0.9)]
    pages = spark.createDataFrame([("p", "http://A.Own.com/x https://github.com/y\nhttps://1.2.3.4 http://a.js", ["own.com"])], "pkg_id string, text string, own array<string>")
    assert {(r.host, r.kind) for r in hosts.inventory(pages, own_col="own").collect()} == {("a.own.com", "first-party"), ("github.com", "platform")}


def test_profiles(spark):
    nodes = spark.createDataFrame([("p", 1, None, 0, "root", 1.0), ("p", 2, 1, 1, "f", 2.0), ("p", 3, 2, 2, "g", 1e-7), ("p", 4, 2, 2, "h", 1e-7)], "profile_id string, node_id long, parent_id long, depth int, method string, self double")
    assert {r.node_id: (round(r.total, 3), r.size) for r in profiles.tree_totals(nodes).collect()} == {1: (3.0, 4), 2: (2.0, 3), 3: (0.0, 1), 4: (0.0, 1)}
    assert {(r.method, r.n) for r in profiles.folded(nodes).collect()} == {("root", 1), ("f", 1), ("(other)", 2)}
    docs = spark.createDataFrame([("a", 'x\n// @sca(one, "text")\n# @sca-ref(one) @sca-ref(two)')], "doc_id string, text string")
    assert {(r.id, r.state) for r in profiles.tag_points(profiles.tags(docs)).collect()} == {("one", "ok"), ("two", "orphan")}


def test_readers(spark, tmp_path):
    tree = tmp_path / "src"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "sub").mkdir()
    (tree / "a.py").write_text("print()")
    (tree / "sub" / "b.unknown").write_text("text")
    (tree / "c.go").write_bytes(b"ab\0c")
    (tree / "node_modules" / "d.js").write_text("x")
    got = {r.rel: (r.language, r.text) for r in readers.read_documents(spark, str(tree)).collect()}
    assert got == {"a.py": ("python", "print()"), "sub/b.unknown": (None, "text")}
    assert {r.rel for r in readers.read_documents(spark, str(tree), ignore=["sub/"]).collect()} == {"a.py"}
    (tmp_path / "list.txt").write_text("# c\nA.b@1.2\n-c.d\nnot an id\n")
    assert [(r.id, r.version, r.remove) for r in readers.read_list_entries(spark, str(tmp_path / "list.txt"), "head").collect()] == [("A.b", "1.2", False), ("c.d", None, True)]
    (tmp_path / "extensions.json").write_text('{"recommendations": ["a.b", // c\n "c.d",], "unwantedRecommendations": ["e.f"]}')
    assert {(r.id, r.remove) for r in readers.read_list_entries(spark, str(tmp_path / "extensions.json"), "head").collect()} == {("a.b", False), ("c.d", False), ("e.f", True)}
    (tmp_path / "bad.md").write_text("| a.b | 1/20/2024 | Malware |\n| --- | --- | --- |\n| c.d | 12/31/2023 | Spam\n")
    assert [(r.id, str(r.removed_on), r.type) for r in readers.read_known_bad(spark, str(tmp_path / "bad.md")).collect()] == [("a.b", "2024-01-20", "Malware"), ("c.d", "2023-12-31", "Spam")]
    (tmp_path / "trace").write_text("RAWSOCK 42 2 node\nRWX mprotect 43 4096 node\nnoise\n")
    assert [(r.kind, r.pid, r.call) for r in readers.read_kernel_trace(spark, str(tmp_path / "trace")).collect()] == [("RAWSOCK", 42, None), ("RWX", 43, "mprotect")]
    (tmp_path / "log").write_text('{"t": 1.5, "kind": "eval", "x": 1}\nbroken\n')
    assert [(r.t, r.kind) for r in readers.read_runtime_events(spark, str(tmp_path / "log")).collect()] == [(1.5, "eval")]
    (tmp_path / "s.bin").write_bytes(bytes([3, 0, 255]))
    (tmp_path / "s.txt").write_text("1, 0x10; 7")
    assert [r.sym for r in readers.read_samples(spark, str(tmp_path / "s.bin")).orderBy("i").collect()] == [3, 0, 255]
    assert [r.sym for r in readers.read_samples(spark, str(tmp_path / "s.txt")).orderBy("i").collect()] == [1, 16, 7]
    (tmp_path / "p.csv").write_text("# c\nresponse,device\nf0,A\n11110001,A\n")
    assert [(r.device, r.read, r.bits) for r in readers.read_puf(spark, str(tmp_path / "p.csv")).orderBy("read").collect()] == [("A", 0, [1, 1, 1, 1, 0, 0, 0, 0]), ("A", 1, [1, 1, 1, 1, 0, 0, 0, 1])]
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "benchmarks": [{"name": "x", "median_ns": 2.0}]}))
    assert readers.read_bench(spark, str(tmp_path / "b.json")).first().median_ns == 2.0
    (tmp_path / "prof.json").write_text(json.dumps({"version": 1, "trees": [{"method": "a", "self": 1, "children": [{"method": "b", "self": 2}]}]}))
    assert [(r.node_id, r.parent_id, r.depth, r.method) for r in readers.read_profile(spark, str(tmp_path / "prof.json")).orderBy("node_id").collect()] == [(1, None, 0, "a"), (2, 1, 1, "b")]


def test_npm_inventory(spark):
    lock = json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/x": {"version": "2.0.0", "hasInstallScript": True}, "node_modules/dev": {"version": "1.0.0", "dev": True}}})
    rows = [("p", "node_modules/a/package.json", json.dumps({"name": "a", "version": "1.0.0", "scripts": {"install": "x"}})), ("p", "node_modules/a/node_modules/@s/b/package.json", json.dumps({"name": "@s/b", "version": "1.1.0"})), ("p", "package-lock.json", lock)]
    got = {r.name: (r.depth, r.from_lock) for r in readers.npm_inventory(spark.createDataFrame(rows, "pkg_id string, rel string, content string")).collect()}
    assert got == {"a": (1, False), "@s/b": (2, False), "x": (1, True)}


def test_sinks(spark):
    findings = spark.createDataFrame([("a.c", "r1", "error", "m", 0, 2), ("a.c", "r2", "hint", "n", 3, 0)], "path string, rule_id string, severity string, message string, line int, col int")
    run = json.loads(sinks.sarif_run(findings, "path").first()["json"])
    assert [r["id"] for r in run["runs"][0]["tool"]["driver"]["rules"]] == ["r1", "r2"]
    assert {r["level"] for r in run["runs"][0]["results"]} == {"error", "note"}
    assert [r.line for r in sinks.markdown(findings).orderBy("rule_id", "place").collect()] == ["## r1 (1)", "- `a.c:1` m", "## r2 (1)", "- `a.c:4` n"]
    assert sinks.sarif_results(findings).count() == 2


def test_queries_have_sql():
    from riskframe.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) >= 60
