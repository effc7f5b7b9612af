"""Declarative text rules: patterns, absent settings, validators, suppressions, summaries.

A rule set is compiled to one projection, so a text is read once whatever the number of rules, and
is in no shuffle: findings carry ids and places only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions import text as tx

VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": tx.luhn, "publicIpv4": tx.public_ipv4}
FINDING = "array<struct<rule_id:string,severity:string,message:string,start:int,line:int,col:int,matched:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern rule reports every match, an absent rule that there is none.

    The value that a validator sees is group ``group``. ``when`` and ``unless`` are patterns that the text must and must
    not have; path patterns are tried on the path. Languages may be ``*``.
    """

    rule_id: str
    pattern: str
    kind: str = "pattern"
    severity: str = "warning"
    message: str = ""
    languages: tuple[str, ...] = ("*",)
    when: str | None = None
    unless: str | None = None
    path_pattern: str | None = None
    exclude_path_pattern: str | None = None
    anchor: str | None = None
    validate: str | None = None
    group: int = 0
    flags: str = ""
    tags: tuple[str, ...] = field(default=())

    @property
    def regex(self) -> str:
        flags = "".join(f for f in self.flags if f in "ims")
        return (f"(?{flags})" if flags else "") + self.pattern

    @property
    def anchor_regex(self) -> str:
        """The anchor with the rule's flags; by default lines begin and end where texts do."""
        return f"(?{''.join(f for f in self.flags if f in 'ims') or 'm'}){self.anchor}"


KINDS = ("pattern", "absent")
PATTERNS = {"pattern": "pattern", "anchor": "anchor", "unless": "unless", "when": "when", "pathPattern": "path_pattern", "excludePathPattern": "exclude_path_pattern"}
REJECT = "source string, place int, rule_id string, problem string"


def java_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern does not compile in the JVM, where rules run; null if it does."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:
        return str(getattr(error, "java_exception", error)).split("\n")[0]
    return None


def problems(spark: SparkSession, raw: object) -> list[str]:
    """Why an entry of a rule pack is no rule."""
    if not isinstance(raw, dict):
        return ["must be an object"]
    out = [f'"{k}" is required' for k in ("id", "title", "message") if not (isinstance(raw.get(k), str) and raw[k])]
    if raw.get("severity") not in tx.SEVERITIES:
        out.append(f'"severity" must be one of {", ".join(tx.SEVERITIES)}')
    languages = raw.get("languages")
    if not isinstance(languages, list) or not all(isinstance(x, str) for x in languages):
        out.append('"languages" must be a list of language ids')
    kind = raw.get("kind", "query")
    if kind not in KINDS:
        out.append(f'"kind" must be one of {", ".join(KINDS)}')
    elif not isinstance(raw.get("pattern"), str):
        out.append(f'"pattern" is required for {kind} rules')
    for key in PATTERNS:
        if isinstance(raw.get(key), str) and (why := java_error(spark, raw[key])):
            out.append(f'"{key}" is not a valid pattern: {why}')
    if raw.get("validate") is not None and raw["validate"] not in VALIDATORS:
        out.append(f'"validate" must be one of {", ".join(VALIDATORS)}')
    return out


def load_rules(spark: SparkSession, path: str) -> tuple[list[Rule], DataFrame]:
    """Rules of the packs (JSON, YAML) at a path, and (source, place, rule_id, problem) of what is wrong with the others.

    A pack has an id and a list of rules. Of rules with the same id in one pack the first counts; see ``union_rules`` for several
    packs. Packs are read on the driver: a rule set is compiled into a plan. Query rules need parsers and are rejected.
    """
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value").orderBy("source").collect()
    return parse_packs(spark, [(r["source"], r["value"]) for r in texts])


def parse_packs(spark: SparkSession, packs: list[tuple[str, str]]) -> tuple[list[Rule], DataFrame]:
    """``load_rules`` of packs(source, text) that are at hand."""
    rules: list[Rule] = []
    rejects: list[tuple[str, int | None, str | None, str]] = []
    for source, text in packs:
        try:
            pack = json.loads(text) if source.endswith(".json") else parse_yaml(text)
        except ValueError as error:
            rejects.append((source, None, None, str(error).split("\n")[0]))
            continue
        if not isinstance(pack, dict) or not isinstance(pack.get("rules"), list):
            rejects.append((source, None, None, '"rules" must be a list'))
            continue
        if not isinstance(pack.get("id"), str):
            rejects.append((source, None, None, 'missing pack "id"'))
        seen: set[str] = set()
        for place, raw in enumerate(pack["rules"]):
            name = raw["id"] if isinstance(raw, dict) and isinstance(raw.get("id"), str) else None
            wrong = problems(spark, raw) + (["duplicate id"] if name in seen else [])
            if wrong:
                rejects += [(source, place, name, w) for w in wrong]
                continue
            seen.add(name)
            group = raw.get("group", 1 if "(?<value>" in raw["pattern"] else 0)
            rules.append(Rule(name, raw["pattern"], raw["kind"], raw["severity"], raw["message"], tuple(raw["languages"]), **{field: raw.get(key) for key, field in PATTERNS.items() if key != "pattern"}, validate=raw.get("validate"), group=int(group), flags=raw.get("flags", ""), tags=tuple(raw.get("tags", ()))))
    return rules, spark.createDataFrame(rejects, REJECT)


def parse_yaml(text: str) -> object:
    try:
        import yaml
    except ImportError as error:
        raise ValueError("YAML packs need PyYAML; JSON ones do not") from error
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error


def union_rules(*packs: list[Rule]) -> list[Rule]:
    """The rules of several packs; of those with the same id the first counts."""
    found: dict[str, Rule] = {}
    for rule in (r for pack in packs for r in pack):
        found.setdefault(rule.rule_id, rule)
    return list(found.values())


def applies(rule: Rule, text: Column, path: Column | None, language: Column | None) -> Column:
    """Whether a rule looks at a document: cheap tests first. A missing value is no match."""
    tests = []
    if "*" not in rule.languages and language is not None:
        tests.append(language.isin(*rule.languages))
    if rule.path_pattern and path is not None:
        tests.append(path.rlike(rule.path_pattern))
    if rule.exclude_path_pattern and path is not None:
        tests.append(~path.rlike(rule.exclude_path_pattern))
    if rule.unless:
        tests.append(~text.rlike(f"(?m){rule.unless}"))
    if rule.when:
        tests.append(text.rlike(f"(?m){rule.when}"))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def findings_of(rule: Rule, text: Column) -> Column:
    """A rule's findings in a text, as an array."""

    def row(place: dict[str, Column] | Column, matched: Column, value: Column) -> Column:
        message = tx.render(rule.message or rule.rule_id, {"value": value, "match": matched})
        where = [place[k].alias(k) for k in ("start", "line", "col")]
        return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), message.alias("message"), *where, matched.alias("matched"), value.alias("value"))

    if rule.kind == "absent":
        first = F.get(tx.matches(text, rule.anchor_regex), F.lit(0)) if rule.anchor else None
        place = {k: F.coalesce(first[k], F.lit(0)) if rule.anchor else F.lit(0) for k in ("start", "line", "col")}
        one = F.array(row(place, F.lit(""), F.lit("")))
        flags = rule.regex if rule.flags else f"(?m){rule.pattern}"
        return F.when(~text.rlike(flags), one)
    found = tx.matches(text, rule.regex, rule.group)
    if rule.validate:
        found = F.filter(found, lambda m: VALIDATORS[rule.validate](m["value"]))
    return F.transform(found, lambda m: row(m, m["matched"], m["value"]))


def scan(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, language_col: str | None = None, disabled: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings: (id_col, *keep, rule_id, severity, message, start, line, col, matched, value)."""
    text = F.col(text_col)
    path, language = (F.col(c) if c else None for c in (path_col, language_col))
    arrays = [F.when(applies(r, text, path, language), findings_of(r, text)) for r in rules if r.rule_id not in disabled]
    arrays = [F.coalesce(a.cast(FINDING), F.array().cast(FINDING)) for a in arrays]
    # not explode: for that one Spark adds filters on the array, which compute it again
    found = docs.select(id_col, *keep, F.explode_outer(F.flatten(F.array(*arrays)) if arrays else F.array().cast(FINDING)).alias("f")).where("f is not null")
    return found.select(id_col, *keep, "f.rule_id", "f.severity", "f.message", "f.start", "f.line", "f.col", "f.matched", "f.value")


#: One class for all names and what parts them: a loop over a group would call itself for each name.
IGNORE = r"ignore(-file|-next-line)?[ \t]+([A-Za-z0-9*_./-][A-Za-z0-9*_./, -]*)"


def directives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "lint-") -> DataFrame:
    """(id_col, line, rule_id): what comments in a text suppress; a null line is the whole text, ``*`` every rule."""
    pattern = re.escape(mark) + IGNORE
    lines = docs.where(F.col(text_col).contains(mark)).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "body")).where(F.col("body").rlike(pattern))
    kind, ids = F.regexp_extract("body", pattern, 1), F.regexp_extract("body", pattern, 2)
    line = F.when(kind == "-next-line", F.col("line") + 1).when(kind == "", F.col("line"))
    return lines.select(id_col, line.alias("line"), F.explode(F.array_remove(F.split(ids, "[ ,]+"), "")).alias("rule_id"))


def suppress(findings: DataFrame, directives: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """findings without those that a directive names."""
    d = directives.toDF("__id", "__line", "__rule")
    same = (findings[id_col] == d["__id"]) & (d["__line"].isNull() | (findings["line"] == d["__line"])) & ((d["__rule"] == "*") | (findings["rule_id"] == d["__rule"]))
    return findings.join(d, same, "left_anti")


def summary(findings: DataFrame, *by: str, id_col: str = "doc_id") -> DataFrame:
    """Counts by the given columns: findings and documents."""
    return findings.groupBy(*by).agg(F.count("*").alias("n_findings"), F.countDistinct(id_col).alias("n_docs"))


def gate(findings: DataFrame, threshold: str, *by: str) -> DataFrame:
    """failed: whether any finding is at least as grave as the threshold."""
    grave = tx.severity_rank(F.col("severity")) <= tx.SEVERITIES.index(threshold)
    return findings.groupBy(*by).agg(F.count_if(grave).alias("n_grave"), F.coalesce(F.bool_or(grave), F.lit(False)).alias("failed"))
