"""Files of packages: indicator rules, binary anomalies, calls, flows, what is left unreferenced."""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.shipping import ship
from riskframe.steps import cut


@dataclass(frozen=True)
class IndicatorRule:
    """Fires if at least ``need`` of the strings are in a file (in any case), or all if need is 0."""

    rule_id: str
    strings: tuple[str, ...]
    need: int = 0

    def column(self, text: Column) -> Column:
        low = F.lower(text)
        hits = sum((low.contains(s.lower()).cast("int") for s in self.strings), F.lit(0))
        return hits >= (self.need or len(self.strings))


def indicator_hits(files: DataFrame, rules: list[IndicatorRule], *, keys: tuple[str, ...] = ("pkg_id", "rel"), text_col: str = "content") -> DataFrame:
    """(*keys, rule_id): one row for each file and rule that fires."""
    fired = F.filter(F.array(*(F.when(r.column(F.col(text_col)), F.lit(r.rule_id)) for r in rules)), lambda x: x.isNotNull())
    return files.select(*keys, F.explode(fired).alias("rule_id"))


# First bytes of executable formats, the system that runs them, and their usual endings.
MAGIC = (("7f454c46", "elf", "linux", r"\.(so(\.\d+)*|node|bin)$|/[^./]+$"), ("4d5a", "pe", "windows", r"\.(exe|dll|node|sys)$"), ("cffaedfe", "mach-o", "macos", r"\.(dylib|node|bundle)$|/[^./]+$"), ("cafebabe", "mach-o", "macos", r"\.(dylib|node|bundle|class)$|/[^./]+$"), ("0061736d", "wasm", "any", r"\.wasm$"))


def binary_signals(files: DataFrame) -> DataFrame:
    """(pkg_id, rel, format, os, signals) of files(pkg_id, rel, content, target) that begin like an executable."""
    head = F.lower(F.hex(F.substring("content", 1, 4)))
    formats, systems, usual = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for magic, kind, system, pattern in reversed(MAGIC):
        hit = head.startswith(magic)
        formats, systems, usual = F.when(hit, kind).otherwise(formats), F.when(hit, system).otherwise(systems), F.when(hit, F.concat(F.lit("/"), "rel").rlike(pattern)).otherwise(usual)
    rows = files.withColumn("format", formats).withColumn("os", systems).withColumn("usual", usual).where("format is not null")
    packed = F.hex(F.substring("content", 1, 4096)).contains("55505821")
    names = F.array(
        F.lit("native-binary"),
        F.when(~F.col("usual"), "binary-unexpected-path"),
        F.when(packed, "packed-binary"),
        F.when((F.col("os") != "any") & F.col("target").isNotNull() & (F.col("target") != F.col("os")), "foreign-arch"),
    )
    return rows.select("pkg_id", "rel", "format", "os", F.filter(names, lambda x: x.isNotNull()).alias("signals"))


def hidden_blobs(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(pkg_id, rel) of archives and blobs whose name no text of the package mentions.

    files(pkg_id, rel, in_deps), texts(pkg_id, content). Texts are cut into name-like words, so it is one equi-join.
    """
    blobs = files.where(~F.col("in_deps") & F.lower("rel").rlike(r"\.(zip|tar|gz|tgz|7z|rar|bin|dat|enc|blob|pak)$"))
    blobs = blobs.select("pkg_id", "rel", F.lower(F.substring_index("rel", "/", -1)).alias("name"))
    words = texts.select("pkg_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[a-z0-9_-][a-z0-9_.-]*"), F.lit(0)))).alias("name")).distinct()
    both = blobs.join(words, ["pkg_id", "name"], "left_anti")
    stems = both.withColumn("stem", F.regexp_replace("name", r"(?:\.[a-z0-9]+)++$", ""))
    return stems.join(words.withColumnRenamed("name", "stem"), ["pkg_id", "stem"], "left_anti").select("pkg_id", "rel")


CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("


def calls(files: DataFrame, *, keys: tuple[str, ...] = ("pkg_id", "rel"), text_col: str = "content") -> DataFrame:
    """(*keys, line, name) of calls name(...) in text; also those in comments."""
    lines = files.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line", "body")).where(F.col("body").contains("("))
    return lines.select(*keys, "line", F.explode(F.regexp_extract_all("body", F.lit(CALL), F.lit(1))).alias("name"))


def unpaired_calls(found: DataFrame, pairs: DataFrame, *, keys: tuple[str, ...] = ("pkg_id", "rel")) -> DataFrame:
    """(*keys, name, line) of acquiring calls without any of their releases in the same file; pairs(name, release)."""
    got = found.join(pairs.select("name").distinct(), "name", "left_semi").groupBy(*keys, "name").agg(F.min("line").alias("line"))
    freed = found.select(*keys, F.col("name").alias("release")).distinct().join(pairs, "release").select(*keys, "name").distinct()
    return got.join(freed, [*keys, "name"], "left_anti")


def call_name_findings(found: DataFrame, listed: DataFrame, *, keys: tuple[str, ...] = ("pkg_id", "rel")) -> DataFrame:
    """(*keys, line, name, rule_id) of calls in listed(name, rule_id, unless), without files that call ``unless``."""
    hits = found.join(listed, "name")
    calm = found.select(*keys, F.col("name").alias("unless")).distinct()
    return hits.join(calm, [*keys, "unless"], "left_anti").select(*keys, "line", "name", "rule_id")


def flow_signals(edges: DataFrame, sources: DataFrame, sinks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pkg_id, signal_id, confidence, n): labels that reach sinks over edges(pkg_id, src, dst).

    sources(pkg_id, node, label), sinks(pkg_id, node, sink), mapping(label, sink, signal_id, confidence). A frontier goes on
    from new (node, label) pairs only, until there are none, so a cycle ends.
    """
    seen = sources.select("pkg_id", "node", "label").distinct()
    frontier = seen
    while True:
        step = frontier.join(edges, (frontier["pkg_id"] == edges["pkg_id"]) & (frontier["node"] == edges["src"])).select(frontier["pkg_id"], F.col("dst").alias("node"), "label").distinct()
        frontier = cut(step.join(seen, ["pkg_id", "node", "label"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(sinks, ["pkg_id", "node"]).join(mapping, ["label", "sink"]).groupBy("pkg_id", "signal_id").agg(F.max("confidence").alias("confidence"), F.countDistinct("node", "label").alias("n"))


def call_rows(text: str | None) -> list[tuple[str, int, str | None]]:
    """(dotted name with import aliases resolved, line, first text argument) of the calls in Python source."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    names: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            parts, f = [], node.func
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            if isinstance(f, ast.Name):
                parts.append(names.get(f.id, f.id))
                first = node.args[0] if node.args else None
                out.append((".".join(reversed(parts)), node.lineno, first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None))
    return out


def python_calls(files: DataFrame, *, text_col: str = "content") -> DataFrame:
    """(pkg_id, rel, name, line, argument) of the calls in Python files(pkg_id, rel, content); what does not parse has none."""
    ship(files.sparkSession)

    def run(frames):
        for frame in frames:
            rows = [(p, r, *c) for p, r, t in zip(frame["pkg_id"], frame["rel"], frame["text"], strict=True) for c in call_rows(t)]
            yield pd.DataFrame(rows, columns=["pkg_id", "rel", "name", "line", "argument"])

    return files.select("pkg_id", "rel", F.col(text_col).alias("text")).mapInPandas(run, "pkg_id string, rel string, name string, line int, argument string")


def python_call_signals(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pkg_id, signal_id, confidence, n) of calls in catalog(name, signal_id, confidence)."""
    return found.join(catalog, "name").groupBy("pkg_id", "signal_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def select_scan_files(files: DataFrame, *, most: int = 2000, mb: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Files to scan, and (pkg_id, n) of what a package's budget leaves out: entry points first, own code, then dependencies."""
    rank = F.when(F.col("entry"), 0).when(~F.col("in_deps"), 1).otherwise(2)
    k = F.row_number().over(Window.partitionBy("pkg_id").orderBy(rank, "rel"))
    fits = F.col("size") <= int(mb * 1024 * 1024)
    chosen = files.where(fits).withColumn("k", k).where(F.col("k") <= most).drop("k")
    total = files.groupBy("pkg_id").agg(F.count("*").alias("n"), F.count_if(fits).alias("ok"))
    return chosen, total.select("pkg_id", (F.col("n") - F.least("ok", F.lit(most))).alias("n")).where("n > 0")


def incremental(packages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages whose key is not cached, and the cache without keys of packages that are gone."""
    return packages.join(cache.select("key").distinct(), "key", "left_anti"), cache.join(packages.select("key").distinct(), "key", "left_semi")


def multi_installs(packages: DataFrame) -> DataFrame:
    """(id, editors, mismatch) of ids that several editors have."""
    g = packages.groupBy(F.lower("pkg_id").alias("id")).agg(F.sort_array(F.collect_set("editor")).alias("editors"), (F.countDistinct("version") > 1).alias("mismatch"))
    return g.where(F.size("editors") > 1)
