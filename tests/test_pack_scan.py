"""Pack scans against rule-by-rule scans, and rules that fail."""

import json
import random

import pytest

from riskframe.operators import rules
from riskframe.operators.pack_scan import required_literals, scan_pack, shipped_rules
from riskframe.operators.rules import Rule

OWN = [
    Rule("a/pan", r"(?<![0-9])(?<value>[0-9]{13,19})(?![0-9])", group=1, validate="luhn", message="{{value}} in {{match}}"),
    Rule("a/ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", validate="publicIpv4"),
    Rule("a/either", r"alpha(?:bet|male)?|omega+x", flags="i"),
    Rule("a/absent", r"^license", kind="absent", anchor="alpha", severity="hint"),
    Rule("a/when", r"b[aeiou]{2}t", when=r"^when", unless="never"),
    Rule("a/path", r"x", path_pattern=r"\.js$", exclude_path_pattern="^test/"),
    Rule("a/language", r"\bomega", languages=("js",)),
]


def rows():
    rnd = random.Random(1)
    words = ["alpha", "ALPHABET", "omegax", "omegaax", "beet", "boot", "when", "never", "license", "\n", "\nwhen", "\nlicense", "x", "é", "4111111111111111", "4111111111111112", "8.8.8.8", "52.1.200.7", "10.0.0.1", "alphamale"]
    out = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), rnd.choice(["a.js", "test/a.js", "b.py", None]), rnd.choice(["js", "py", None])) for k in range(300)]
    return [*out, (1000, None, "a.js", "js"), (1001, "", "a.js", "js"), (1002, "alpha " * 100_000, "a.js", "js"), (5, "alpha", "a.js", "js")]


def test_same_as_rule_by_rule(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, path string, language string").repartition(3)
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "rule_id", "severity", "message", "start", "line", "col", "matched", "value").collect()))
    got = pick(scan_pack(docs, OWN, path_col="path", language_col="language"))
    assert got == pick(rules.scan(docs, OWN, path_col="path", language_col="language").where("severity is not null")) and len({r[1] for r in got}) == len(OWN)
    assert scan_pack(docs.limit(0), OWN).count() == 0
    assert {r.rule_id for r in scan_pack(docs, OWN, disabled=("a/ip",)).select("rule_id").distinct().collect()}.isdisjoint({"a/ip"})


def test_suppression_in_the_scan(spark):
    """The same findings stay as when directives are a table."""
    rnd = random.Random(4)
    heads = ["", "# lint-ignore a/either", "# lint-ignore-next-line a/pan, a/ip", "# lint-ignore *", "# lint-ignore-file a/ip", "// lint-ignore x lint-ignore-file *", "lint-ignore", "lint-ignore-file a/when,a/absent"]
    texts = [(k, "\n".join(rnd.choice(["alpha 8.8.8.8", "4111111111111111 52.1.200.7 omegax", "when beet", "boot"]) + " " + rnd.choice(heads if k % 3 else heads[:4]) for _ in range(rnd.randint(1, 8)))) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    some = OWN[:5]
    pick = lambda df: sorted((r.doc_id, r.rule_id, r.start) for r in df.collect())
    want = pick(rules.suppress(rules.scan(docs, some), rules.directives(docs)))
    assert pick(scan_pack(docs, some, mark="lint-")) == want and len(want) < scan_pack(docs, some).count()


def test_a_failing_rule_is_a_hint(spark):
    bad = [Rule("bad/pattern", "(?<=a+)("), Rule("bad/slow", r"(?:(?:a|a)*)*b"), Rule("good", "aaa+")]
    docs = spark.createDataFrame([(1, "a" * 40), (2, "c")], "doc_id long, text string")
    found = scan_pack(docs, bad, patience=0.2).collect()
    assert {(r.doc_id, r.rule_id, r.severity) for r in found} >= {(1, "bad/pattern", "hint"), (2, "bad/pattern", "hint"), (1, "good", "warning")}
    assert all(r.severity == "hint" and (r.line, r.col) == (0, 0) and r.message.startswith("rule bad/") for r in found if r.rule_id.startswith("bad"))


@pytest.mark.parametrize(("pattern", "want"), [("abc(?:def|ghi)+x", {"abc"}), ("(?:cat|dogs)z?", {"cat", "dogs"}), ("[abc]de", None), ("a?bcd*efg", {"efg"}), ("(?i)HeLLo", {"hello"}), ("x|yyyy", None), ("(?<value>lock)s", {"lock"}), ("(?:abc){0,2}", None), ("é+abc", {"abc"})])
def test_required_literals(pattern, want):
    assert required_literals(Rule("r", pattern)) == (None if want is None else frozenset(want))


def test_shipped_rules_load(spark, tmp_path):
    found = shipped_rules(spark)
    assert len(found) > 100 and len({r.rule_id for r in found}) == len(found)
    texts = [(1, "const a = 1;\nrequire('child_process')\n", "a.js", "javascript"), (2, "CONFIG_ESP_TLS_INSECURE=y\n# CONFIG_SECURE_BOOT is not set\n", "x/sdkconfig", "plain"), (3, "esphome:\n  name: a\napi:\n  port: 1\n", "a.yaml", "yaml")]
    got = {(r.doc_id, r.rule_id, r.line) for r in scan_pack(spark.createDataFrame(texts, "doc_id long, text string, path string, language string"), found, path_col="path", language_col="language").collect()}
    assert got >= {(1, "ext/process-exec.child-process", 1), (2, "esp32/tls-insecure", 0), (2, "esp32/secure-boot-disabled", 1), (2, "esp32/nvs-encryption-disabled", 0), (3, "esphome/api-unencrypted", 2)}
