"""Detection rules over process events that hold for any system, and how packs of such rules are read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators.detect import DetectionRule, valid_rule
from riskframe.operators.rules import parse_yaml

# The built-in rules' ids, patterns, counts and spans. They must match.
DEFAULT_RULES = (
    DetectionRule("office-spawns-script-host", "match", severity="high", match={"type": "^spawn$", "parent.image": r"(?i)\\(winword|excel|powerpnt|outlook|onenote)\.exe$", "image": r"(?i)\\(cmd|powershell|pwsh|wscript|cscript|mshta|rundll32|regsvr32)\.exe$"}),
    DetectionRule("encoded-powershell", "match", match={"type": ["^spawn$", "^exec$"], "image": r"(?i)\\(powershell|pwsh)\.exe$", "cmdline": r"(?i)\s-(e|ec|enc|encodedcommand)\s"}),
    DetectionRule("lolbin-download", "match", severity="high", match={"type": ["^spawn$", "^exec$"], "cmdline": r"(?i)(certutil(\.exe)?\s.*-urlcache|bitsadmin(\.exe)?\s.*/transfer|mshta(\.exe)?\s+https?:|regsvr32(\.exe)?\s.*/i:https?:)"}),
    DetectionRule("inhibit-system-recovery", "match", severity="critical", match={"type": ["^spawn$", "^exec$"], "cmdline": r"(?i)(vssadmin(\.exe)?\s+delete\s+shadows|wmic(\.exe)?\s+shadowcopy\s+delete|wbadmin(\.exe)?\s+delete\s+catalog|bcdedit(\.exe)?\s.*recoveryenabled\s+no)"}),
    DetectionRule("mass-file-encryption", "threshold", severity="critical", match={"type": "^file$", "op": "^(write|rename)$"}, count=100, within=10_000),
    DetectionRule("security-tool-termination", "match", severity="critical", match={"type": "^terminate$", "target.image": r"(?i)(MsMpEng|MsSense|SenseIR|SentinelAgent|CSFalconService|cb|xagt|bdagent|avp|ekrn)\.exe$|/(falcond|com\.crowdstrike|SentinelAgent|osqueryd)$"}),
    DetectionRule("lsass-access", "match", severity="critical", match={"type": "^inject$", "target.image": r"(?i)\\lsass\.exe$"}),
    DetectionRule("process-injection", "match", severity="high", match={"type": "^inject$"}),
    DetectionRule("run-key-persistence", "match", match={"type": "^registry$", "key": r"(?i)\\Software\\Microsoft\\Windows\\CurrentVersion\\Run(Once)?\\?"}),
    DetectionRule("launch-agent-persistence", "match", match={"type": "^file$", "op": "^(create|write)$", "path": r"/Library/Launch(Agents|Daemons)/[^/]+\.plist$"}),
    DetectionRule("download-and-execute", "sequence", severity="high", within=5000, steps=({"type": "^spawn$", "image": "/(curl|wget)$", "parent.id": "$P"}, {"type": "^spawn$", "image": "/(sh|bash|zsh|python3?)$", "parent.id": "$P"})),
    DetectionRule("orphaning-parent-exit", "sequence", severity="low", within=1000, steps=({"type": "^spawn$", "parent.id": "$P"}, {"type": "^terminate$", "target.id": "$P"})),
)

GROUPS = {"process": "process", "parent": "parent.id", "none": None}


def parsed_rule(raw: object) -> DetectionRule | str:
    """A rule of a pack, or why it is none. ``bind`` of a step names the field that a variable takes its value from."""
    if not isinstance(raw, dict) or not isinstance(raw.get("id"), str):
        return "id"
    kinds = [k for k in ("match", "threshold", "sequence") if raw.get(k)]
    if len(kinds) != 1:
        return "exactly one of match, threshold and sequence is required"
    severity = raw.get("severity", "medium")
    if severity not in ("low", "medium", "high", "critical"):
        return "severity"
    kind, body = kinds[0], raw[kinds[0]]
    if not isinstance(body, dict):
        return kind
    if kind == "match":
        return DetectionRule(raw["id"], kind, match=body, severity=severity)
    if kind == "threshold":
        if not isinstance(body.get("count"), (int, float)) or body.get("by", "process") not in GROUPS or not isinstance(body.get("match"), dict):
            return kind
        return DetectionRule(raw["id"], kind, match=body["match"], count=int(body["count"]), within=body.get("within"), group=GROUPS[body.get("by", "process")], severity=severity)
    steps = body.get("steps")
    if not isinstance(steps, list) or len(steps) < 2 or not all(isinstance(s, dict) and isinstance(s.get("match"), dict) for s in steps):
        return "a sequence needs at least two steps"
    out = []
    for s in steps:
        bound = {field: f"${name}" for name, field in (s.get("bind") or {}).items()}
        if bound.keys() & s["match"].keys():
            return "a field is bound and tested in one step"
        out.append(s["match"] | bound)
    return DetectionRule(raw["id"], kind, steps=tuple(out), within=body.get("within"), severity=severity)


def load_process_rules(spark: SparkSession, path: str) -> tuple[list[DetectionRule], DataFrame]:
    """Rules of the packs (JSON or YAML, a list ``rules``) at a path, and (source, place, rule_id, problem) of the others.

    Patterns are compiled in the JVM, where they run. Packs are read on the driver: they become plans.
    """
    rules: list[DetectionRule] = []
    rejects: list[tuple[str, int | None, str | None, str]] = []
    for row in spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value").orderBy("source").collect():
        try:
            pack = json.loads(row["value"]) if row["source"].endswith(".json") else parse_yaml(row["value"])
        except ValueError as error:
            rejects.append((row["source"], None, None, str(error).split("\n")[0]))
            continue
        if not isinstance(pack, dict) or not isinstance(pack.get("rules"), list):
            rejects.append((row["source"], None, None, '"rules" must be a list'))
            continue
        for place, raw in enumerate(pack["rules"]):
            rule = parsed_rule(raw)
            wrong = rule if isinstance(rule, str) else valid_rule(spark, rule)
            if wrong:
                rejects.append((row["source"], place, raw.get("id") if isinstance(raw, dict) and isinstance(raw.get("id"), str) else None, wrong))
            else:
                rules.append(rule)
    return rules, spark.createDataFrame(rejects, "source string, place int, rule_id string, problem string")
