"""Sinks: SARIF results and Markdown reports as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.text import severity_rank


def sarif_results(findings: DataFrame, *, uri: str = "path") -> DataFrame:
    """(rule_id, json): one SARIF 2.1.0 result for each finding; regions count from 1, info and hint are notes."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.struct((F.col("line") + 1).alias("startLine"), (F.col("col") + 1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col(uri).cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("rule_id", F.to_json(result).alias("json"))


def sarif_run(findings: DataFrame, by: str, *, tool: str = "riskframe", uri: str = "path") -> DataFrame:
    """(by, json): one run for each group, which must be of a size that fits a row; only rules that occur are listed."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.struct((F.col("line") + 1).alias("startLine"), (F.col("col") + 1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col(uri).cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    g = findings.groupBy(by).agg(F.sort_array(F.collect_list(result)).alias("results"), F.transform(F.sort_array(F.collect_set("rule_id")), lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"), F.col("results").alias("results"))
    return g.select(by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def markdown(findings: DataFrame, *, uri: str = "path") -> DataFrame:
    """(rule_id, place, line): the lines of a report, by rule; order by rule_id and place."""
    head = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("rank"))
    head = head.select("rule_id", F.lit("").alias("place"), F.format_string("## %s (%d)", "rule_id", "n").alias("line"))
    where = F.format_string("%s:%06d", F.col(uri).cast("string"), F.col("line") + 1)
    body = findings.select("rule_id", where.alias("place"), F.format_string("- `%s:%d` %s", F.col(uri).cast("string"), F.col("line") + 1, "message").alias("text")).toDF("rule_id", "place", "line")
    return head.unionByName(body)


def risk_findings(risk: DataFrame, signals: DataFrame) -> DataFrame:
    """(pkg_id, rule_id, severity, message, file, line): a row for each package's risk and one for each place of its signals."""
    severity = lambda: F.when(F.col("level") == "high", "error").when(F.col("level") == "medium", "warning").otherwise("info")
    whole = risk.select("pkg_id", F.lit("ext/risk").alias("rule_id"), severity().alias("severity"), F.format_string("risk %s (%.1f)", "level", "score").alias("message"), F.lit("package.json").alias("file"), F.lit(0).alias("line"))
    rows = signals.join(risk.select("pkg_id", "level"), "pkg_id").select("pkg_id", F.concat(F.lit("ext/"), "signal_id").alias("rule_id"), severity().alias("severity"), "message", F.explode_outer("locations").alias("p"))
    return whole.unionByName(rows.select("pkg_id", "rule_id", "severity", "message", F.coalesce("p.file", F.lit("package.json")).alias("file"), F.coalesce("p.line", F.lit(0)).alias("line")))
