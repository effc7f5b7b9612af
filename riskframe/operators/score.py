"""Signals and risk scores: roll-up of findings, category scores, boosts, levels, prevalence, population outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.text import level_rank, round1, signal_id

# Scores from which a level holds, capability categories whose weights are damped, and
# the combinations that add to a score.
HIGH, MEDIUM = 9.0, 5.0
LOCATIONS = 20
CAPABILITIES = ("process", "data", "network", "obfuscation", "native", "webview", "vscode-api", "scripts")
CREDENTIALS = ("credential-path", "ssh-keys", "cloud-credentials", "registry-tokens", "git-credentials", "kube-docker-config", "browser-data", "keychain-access", "crypto-wallet", "shell-history", "env-file-harvest", "env-dump")
ENDPOINTS = ("hardcoded-ip", "exfil-endpoint", "tor-endpoint", "websocket-c2")
PERSISTENCE = ("persistence-launchagent", "persistence-cron", "persistence-shell-rc", "persistence-windows")
BOOSTS = (
    ("credentials and an endpoint", 4.0, (CREDENTIALS, ENDPOINTS)),
    ("hidden code that is evaluated", 2.0, (("obfuscated", "packer", "charcode-chain"), ("dynamic-code", "decode-eval"))),
    ("a download that persists", 3.0, (("pipe-to-shell", "executable-download"), PERSISTENCE)),
    ("capture and an endpoint", 3.0, (("input-capture", "screen-capture"), ENDPOINTS)),
    ("evasion and hidden code", 2.0, (("anti-debug", "sandbox-evasion"), ("obfuscated", "packer", "decode-eval", "terminal-injection"))),
    ("an unknown publisher that runs or captures from startup", 2.0, (("activates-on-startup", "activates-after-startup"), ("process-exec", "input-capture"), ("unknown-publisher",))),
)


def roll_up(findings: DataFrame, vectors: DataFrame, *, pkg: str = "pkg_id", file: str = "file") -> DataFrame:
    """(pkg, signal_id, weight, count, n_files, message, locations): findings(pkg, rule_id, message, file, line) by signal.

    The count is exact, at most LOCATIONS places are kept, the first by file and line. vectors: (signal_id, weight).
    """
    rows = findings.withColumn("signal_id", signal_id(F.col("rule_id")))
    order = Window.partitionBy(pkg, "signal_id").orderBy(file, "line", "rule_id")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LOCATIONS)
    first = first.groupBy(pkg, "signal_id").agg(F.sort_array(F.collect_list(F.struct(F.col(file).alias("file"), "line"))).alias("locations"), F.min_by("message", "k").alias("message"))
    total = rows.groupBy(pkg, "signal_id").agg(F.count("*").alias("count"), F.countDistinct(file).alias("n_files"))
    text = F.when(F.col("count") > 1, F.concat("message", F.format_string(" (%d hits in %d files)", F.col("count"), F.col("n_files")))).otherwise(F.col("message"))
    return total.join(first, [pkg, "signal_id"]).join(vectors.select("signal_id", "weight"), "signal_id").select(pkg, "signal_id", "weight", "count", "n_files", text.alias("message"), "locations")


def merge(signals: DataFrame, *, pkg: str = "pkg_id", order: str = "ord") -> DataFrame:
    """One row for each (pkg, signal_id): counts add, the heaviest weight and its message win, the strongest force stays."""
    best = F.max_by(F.struct("weight", "message"), F.struct("weight", -F.col(order)))
    out = signals.groupBy(pkg, "signal_id").agg(F.sum("count").alias("count"), best.alias("best"), F.max(level_rank(F.col("force"))).alias("rank"))
    force = F.when(F.col("rank") >= 0, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank").cast("int") + 1))
    return out.select(pkg, "signal_id", F.col("best.weight").alias("weight"), F.col("best.message").alias("message"), "count", force.alias("force"))


def category_scores(signals: DataFrame, vectors: DataFrame, *, pkg: str = "pkg_id", damped: tuple[str, ...] = CAPABILITIES) -> DataFrame:
    """(pkg, category, score): in damped categories the i-th heaviest positive weight counts half of the one before."""
    rows = signals.join(vectors.select("signal_id", "category"), "signal_id")
    i = F.row_number().over(Window.partitionBy(pkg, "category").orderBy(F.desc("weight"), "signal_id")) - 1
    part = F.when((F.col("weight") > 0) & F.col("category").isin(*damped), F.col("weight") / F.pow(F.lit(2.0), "i")).otherwise(F.col("weight"))
    return rows.withColumn("i", i).groupBy(pkg, "category").agg(round1(F.sum(part)).alias("score"))


def boosts(signals: DataFrame, *, pkg: str = "pkg_id", rules: tuple = BOOSTS) -> DataFrame:
    """(pkg, label, weight, because): rules of which each group has a signal; because names the first of each group."""
    sets = signals.groupBy(pkg).agg(F.collect_set("signal_id").alias("ids"))

    def rule(label: str, weight: float, groups: tuple) -> Column:
        lists = [F.array(*map(F.lit, g)) for g in groups]
        hit = F.lit(True)
        for g in lists:
            hit = hit & F.arrays_overlap("ids", g)
        because = F.array(*(F.element_at(F.filter(g, lambda x: F.array_contains("ids", x)), 1) for g in lists))
        return F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"), because.alias("because")))

    found = F.filter(F.array(*(rule(*r) for r in rules)), lambda x: x.isNotNull())
    return sets.select(pkg, F.inline(found))


def score(signals: DataFrame, vectors: DataFrame, *, pkg: str = "pkg_id", allowed: DataFrame | None = None, rules: tuple = BOOSTS, damped: tuple[str, ...] = CAPABILITIES, known_bad: str = "known-bad") -> DataFrame:
    """(pkg, score, level, capped, allowlisted, allowlist_overridden): merged signals scored.

    A score from 9 is high, from 5 medium; a forced level is the least. A high score without a boost, a force or a
    known-bad signal is capped to medium. Allowed packages (a table of pkg) without a force score 0.
    """
    totals = category_scores(signals, vectors, pkg=pkg, damped=damped).groupBy(pkg).agg(F.sum("score").alias("base"))
    extra = boosts(signals, pkg=pkg, rules=rules).groupBy(pkg).agg(F.sum("weight").alias("boost"))
    marks = signals.groupBy(pkg).agg(F.max(level_rank(F.col("force"))).alias("force"), F.bool_or((F.col("signal_id") == known_bad) & (F.col("weight") > 0)).alias("bad"))
    rows = marks.join(totals, pkg, "left").join(extra, pkg, "left")
    rows = rows.join(allowed.select(pkg).distinct().withColumn("ok", F.lit(True)), pkg, "left") if allowed is not None else rows.withColumn("ok", F.lit(False))
    forced, ok = F.coalesce("force", F.lit(-1)), F.coalesce("ok", F.lit(False))
    total = F.greatest(F.lit(0.0), round1(F.coalesce("base", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))))
    own = F.when(total >= HIGH, 2).when(total >= MEDIUM, 1).otherwise(0)
    capped = (own == 2) & F.col("boost").isNull() & (forced < 0) & ~F.col("bad")
    quiet = ok & (forced < 0)
    level = F.when(quiet, 0).otherwise(F.greatest(F.when(capped, 1).otherwise(own), forced))
    name = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level.cast("int") + 1)
    return rows.select(pkg, F.when(quiet, 0.0).otherwise(total).alias("score"), name.alias("level"), (capped & ~quiet).alias("capped"), ok.alias("allowlisted"), (ok & (forced >= 0)).alias("allowlist_overridden"))


def combined(static: DataFrame, runtime: DataFrame, vectors: DataFrame, *, pkg: str = "pkg_id", **options) -> DataFrame:
    """Risk of what was found in the code and of what a run showed, together: (pkg, signal_id, weight, message, count, force, ord) each."""
    return score(merge(static.unionByName(runtime), pkg=pkg), vectors, pkg=pkg, **options)


def ranking(risk: DataFrame, *, pkg: str = "pkg_id") -> DataFrame:
    """Gravest first: level, score, id."""
    return risk.orderBy(F.desc(level_rank(F.col("level"))), F.desc("score"), pkg)


def is_allowlisted(packages: DataFrame, entries: DataFrame, *, pkg: str = "pkg_id", version: str = "version") -> DataFrame:
    """packages that an entry (id, version) names: ids in any case, a null version is any version."""
    e = entries.select(F.lower("id").alias("__id"), F.col("version").alias("__version"))
    return packages.join(e, (F.lower(packages[pkg]) == e["__id"]) & (e["__version"].isNull() | (packages[version] == e["__version"])), "left_semi")


def external(rows: DataFrame, vectors: DataFrame, *, engine: str) -> tuple[DataFrame, DataFrame]:
    """Signals of another engine, and its rejects: ids that are unknown or not its own. Under a confidence of 0.5 weights are halved."""
    v = vectors.select("signal_id", "weight", "engines")
    joined = rows.drop("weight").join(v, "signal_id", "left")
    own = F.coalesce(F.array_contains("engines", engine), F.lit(False))
    weight = F.when(F.col("confidence") < 0.5, F.col("weight") / 2).otherwise(F.col("weight"))
    reason = F.when(F.col("engines").isNull(), "unknown").otherwise("not owned")
    return joined.where(own).withColumn("weight", weight).drop("engines"), joined.where(~own).withColumn("reason", reason).drop("engines", "weight")


def prevalence(signals: DataFrame, risk: DataFrame, *, pkg: str = "pkg_id") -> DataFrame:
    """(signal_id, n, percent): packages with each signal."""
    total = risk.agg(F.count("*").alias("total"))
    counts = signals.groupBy("signal_id").agg(F.countDistinct(pkg).alias("n"))
    return counts.join(F.broadcast(total)).select("signal_id", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def score_summary(risk: DataFrame) -> DataFrame:
    """(n, least, median, most) of scores; the median is the upper middle one."""
    ranked = risk.groupBy("score").agg(F.count("*").alias("n"))
    upto = ranked.withColumn("upto", F.sum("n").over(Window.orderBy("score"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("score")))
    return upto.agg(F.max("total").alias("n"), F.min("score").alias("least"), middle.alias("median"), F.max("score").alias("most"))


def capability_groups(signals: DataFrame, groups: DataFrame, *, pkg: str = "pkg_id") -> DataFrame:
    """(capability, n): packages with a signal of each group(capability, signal_id)."""
    hit = signals.select(pkg, "signal_id").join(groups, "signal_id").groupBy("capability").agg(F.countDistinct(pkg).alias("n"))
    return groups.select("capability").distinct().join(hit, "capability", "left").fillna(0, ["n"])


def inventory(risk: DataFrame, by: str) -> DataFrame:
    """Packages and levels by a column."""
    return risk.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")))


def recommendations(risk: DataFrame, signals: DataFrame, *, pkg: str = "pkg_id") -> DataFrame:
    """(pkg, advice, reason): what to do about which package."""
    ids = signals.groupBy(pkg).agg(F.collect_set("signal_id").alias("ids"))
    has = lambda *x: F.arrays_overlap("ids", F.array(*map(F.lit, x)))
    rows = risk.join(ids, pkg, "left")
    row = lambda advice, reason: F.struct(F.lit(advice).alias("advice"), F.lit(reason).alias("reason"))
    advice = [
        F.when(has("known-bad"), row("uninstall", "known-bad")),
        F.when(has("typosquat", "brand-impersonation"), row("verify", "name")),
        F.when((F.col("level") == "high") & ~has("known-bad"), row("review", "risk")),
        F.when(has("sideloaded", "not-on-marketplace"), row("confirm origin", "source")),
        F.when(has("stale", "vulnerable-dependency"), row("update", "age")),
    ]
    return rows.select(pkg, F.inline(F.filter(F.array(*advice), lambda x: x.isNotNull())))


def coverage(vectors: DataFrame, ran: DataFrame, *, engines: tuple[str, ...], online: bool) -> DataFrame:
    """(category, total, ran, offline, no_engine, other): which checks of each category ran, and why others did not."""
    joined = vectors.join(ran.select("signal_id").distinct().withColumn("did", F.lit(True)), "signal_id", "left")
    did = F.coalesce("did", F.lit(False))
    here = F.arrays_overlap("engines", F.array(*map(F.lit, engines)).cast("array<string>"))
    reason = F.when(did, "ran").when(F.col("online") & F.lit(not online), "offline").when(~here, "no_engine").otherwise("other")
    return joined.withColumn("reason", reason).groupBy("category").agg(F.count("*").alias("total"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("ran", "offline", "no_engine", "other")))


def outliers(scores: DataFrame, packages: DataFrame, *, pkg: str = "pkg_id", least: int = 5, score_from: float = 3.0, z_from: float = 3.5) -> DataFrame:
    """(pkg, category, score, z): packages far above the others of a category, by median and MAD; a missing score is 0.

    Missing scores are not written out: their number is enough for medians, so the table stays as small as its rows.
    """
    n = packages.select(pkg).distinct().agg(F.count("*").alias("n"))
    values = scores.groupBy("category", "score").agg(F.count("*").alias("m"))
    have = values.groupBy("category").agg(F.sum("m").alias("have"))
    zeros = have.join(F.broadcast(n)).select("category", F.lit(0.0).alias("score"), (F.col("n") - F.col("have")).alias("m")).where("m > 0")
    values = values.unionByName(zeros)
    center = weighted_median(values, "score", "median")
    off = values.join(center, "category").withColumn("off", F.abs(F.col("score") - F.col("median")))
    spread = weighted_median(off.select("category", "off", "m"), "off", "mad").join(off.groupBy("category").agg((F.sum(F.col("off") * F.col("m")) / F.sum("m")).alias("mean_off")), "category")
    stats = center.join(spread, "category").join(F.broadcast(n))
    d = F.col("score") - F.col("median")
    z = F.when(F.col("mad") > 0, 0.6745 * d / F.col("mad")).when(F.col("mean_off") > 0, d / (1.253314 * F.col("mean_off"))).otherwise(0.0)
    rows = scores.join(stats, "category").withColumn("z", z)
    return rows.where((F.col("n") >= least) & (F.col("score") >= score_from) & (F.col("z") >= z_from)).select(pkg, "category", "score", F.round("z", 6).alias("z"))


def weighted_median(values: DataFrame, column: str, name: str) -> DataFrame:
    """(category, name): the median of a column with counts m; the mean of both middle ones."""
    upto = values.groupBy("category", column).agg(F.sum("m").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("category").orderBy(column))).withColumn("total", F.sum("m").over(Window.partitionBy("category")))
    low = F.min(F.when(F.col("upto") >= F.col("total") / 2, F.col(column)))
    high = F.min(F.when(F.col("upto") > F.col("total") / 2, F.col(column)))
    return upto.groupBy("category").agg(((low + high) / 2).alias(name))
