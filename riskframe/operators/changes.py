"""Comparisons of two states: extension lists, policies, file hashes, benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATUSES = ("added", "changed", "removed", "unchanged")


def listed(entries: DataFrame) -> DataFrame:
    """(key, id, version): one row for each wanted id; the version of its first pinned entry."""
    wanted = entries.where("not remove")
    place = F.struct("file", "line", "id")
    pinned = F.min_by("version", F.when(F.col("version").isNotNull(), place))
    return wanted.groupBy(F.lower("id").alias("key")).agg(F.min_by("id", place).alias("id"), pinned.alias("version"), F.min(place).alias("place"))


def diff_lists(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, status, version, base_version, file, line) of entries(id, version, file, line, remove); removals are no entries."""
    b, h = listed(base), listed(head)
    both = h.join(b.select("key", F.col("id").alias("b_id"), F.col("version").alias("b_version"), F.col("place").alias("b_place")), "key", "full_outer")
    status = F.when(F.col("b_id").isNull(), "added").when(F.col("id").isNull(), "removed").when(F.col("version").eqNullSafe(F.col("b_version")), "unchanged").otherwise("changed")
    place = F.coalesce("place", "b_place")
    return both.select(F.coalesce("id", "b_id").alias("id"), status.alias("status"), "version", F.col("b_version").alias("base_version"), place["file"].alias("file"), place["line"].alias("line"))


def violations(items: DataFrame, *, blocked: tuple[str, ...] = (), publishers: tuple[str, ...] = (), verified: bool = False, id_col: str = "id", publisher: Column | None = None, verified_col: str | None = None) -> DataFrame:
    """(id_col, rule): policy violations. Blocked entries are ids or ``publisher.*``; an unknown verification is one."""
    name = F.lower(F.col(id_col))
    who = F.lower(publisher) if publisher is not None else F.substring_index(name, ".", 1)
    lit = lambda values: F.array(*(F.lit(v.lower()) for v in values)).cast("array<string>")
    rules = [
        F.when(F.array_contains(lit([b for b in blocked if not b.endswith(".*")]), name) | F.array_contains(lit([b[:-2] for b in blocked if b.endswith(".*")]), who), F.lit("blocked")),
        F.when(F.lit(bool(publishers)) & ~F.array_contains(lit(publishers), who), F.lit("publisher")),
        F.when(F.lit(verified) & ~F.coalesce(F.col(verified_col) if verified_col else F.lit(None).cast("boolean"), F.lit(False)), F.lit("unverified")),
    ]
    return items.select(id_col, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))


def guard(changes: DataFrame, risk: DataFrame, broken: DataFrame, *, fail_on: str = "high", by_id: DataFrame | None = None) -> DataFrame:
    """(id, status, level, n_violations, verdict) of changed and added items: fail on a violation or level, error if unscanned.

    by_id(id, level): levels of items that can't be had and are judged by what is known of their ids alone; a scan's level goes first.
    """
    from riskframe.functions.text import LEVELS, level_rank

    v = broken.groupBy("id").agg(F.count("*").alias("n_violations"))
    rows = changes.where(F.col("status").isin("added", "changed")).join(risk.select("id", "level"), "id", "left").join(v, "id", "left")
    if by_id is not None:
        rows = rows.join(by_id.select("id", F.col("level").alias("id_level")), "id", "left").withColumn("level", F.coalesce("level", "id_level"))
    n = F.coalesce("n_violations", F.lit(0))
    verdict = F.when(n > 0, "fail").when(F.col("level").isNull(), "error").when(level_rank(F.col("level")) >= LEVELS.index(fail_on), "fail").otherwise("pass")
    return rows.select("id", "status", "level", n.alias("n_violations"), verdict.alias("verdict"))


def diff_files(published: DataFrame, installed: DataFrame, *, key: tuple[str, ...] = ("pkg_id",), code_only: bool = False) -> DataFrame:
    """(*key, rel, status) of files(*key, rel, sha256) that were modified, added or are missing."""
    on = [*key, "rel"]
    both = published.select(*on, F.col("sha256").alias("was")).join(installed.select(*on, F.col("sha256").alias("now")), on, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "modified")
    out = both.select(*on, status.alias("status")).where("status is not null")
    return out.where(F.col("rel").rlike(r"\.(js|cjs|mjs|ts|node|wasm|py|sh|ps1|exe|dll|so|dylib)$")) if code_only else out


def judge(baseline: DataFrame, current: DataFrame, *, time_tol: float = 0.05, mem_tol: float = 0.01) -> DataFrame:
    """(name, verdict, memory_verdict, ratio): a run against another by median_ns and memory; 0 against 0 is 1, else infinite."""
    b = baseline.select("name", F.col("median_ns").alias("b_ns"), F.col("memory").alias("b_memory"))
    both = current.select("name", "median_ns", "memory").join(b, "name", "full_outer")

    def ratio(now: str, was: str) -> Column:
        a, c = F.col(now).cast("double"), F.col(was).cast("double")
        return F.when(c == 0, F.when(a == 0, 1.0).otherwise(float("inf"))).otherwise(a / F.when(c != 0, c))

    def verdict(r: Column, tol: float) -> Column:
        return F.when(F.col("b_ns").isNull(), "added").when(F.col("median_ns").isNull(), "removed").when(r > 1 + tol, "regression").when(r < 1 - tol, "improvement").otherwise("invariant")

    time = ratio("median_ns", "b_ns")
    return both.select("name", verdict(time, time_tol).alias("verdict"), verdict(ratio("memory", "b_memory"), mem_tol).alias("memory_verdict"), time.alias("ratio"))


def by_verdict(judged: DataFrame) -> DataFrame:
    """Regressions, improvements, added, removed, invariant; the largest ratio first."""
    rank = F.array_position(F.array(*map(F.lit, ("regression", "improvement", "added", "removed", "invariant"))), F.col("verdict"))
    return judged.orderBy(rank, F.desc_nulls_last("ratio"), "name")
