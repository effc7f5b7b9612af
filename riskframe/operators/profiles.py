"""Profiles and traces: trees of calls, invalidations, inference triggers, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.steps import cut

OTHER = "(other)"


def tree_totals(nodes: DataFrame) -> DataFrame:
    """nodes(profile_id, node_id, parent_id, self) with total (the self times of a node and all below) and size.

    After round k a node has the sums over all less than 2^k levels below it, and points to its ancestor 2^k levels above. That one
    gets those sums added, so a tree of depth d takes log2(d) joins of as many rows as nodes. Parents must not form a cycle.
    """
    key = ["profile_id", "node_id"]
    state = cut(nodes.select(*key, F.col("parent_id").alias("up"), F.col("self").alias("total"), F.lit(1).cast("long").alias("size")))
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy("profile_id", F.col("up").alias("node_id")).agg(F.sum("total").alias("more"), F.sum("size").alias("n"))
        ups = state.select("profile_id", F.col("node_id").alias("up"), F.col("up").alias("up_up"))
        state = state.join(below, key, "left").join(ups, ["profile_id", "up"], "left")
        state = cut(state.select(*key, F.col("up_up").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), (F.col("size") + F.coalesce("n", F.lit(0))).alias("size")))
    return nodes.drop("total", "size").join(state.select(*key, "total", "size"), key)


def folded(nodes: DataFrame, *, depth: int = 8, children: int = 50, least: float = 1e-5) -> DataFrame:
    """(profile_id, parent_id, method, depth, total, n): children of a node with small ones folded into one row.

    Nodes below depth are left out; of each node the ``children`` largest stay, and those under least seconds are folded.
    """
    rows = tree_totals(nodes).where(F.col("depth") <= depth)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("profile_id", "parent_id").orderBy(F.desc("size"), F.desc("total"), "node_id"))).where(F.col("k") <= children)
    small = F.col("total") < least
    rows = rows.withColumn("method", F.when(small, OTHER).otherwise(F.col("method"))).withColumn("key", F.when(~small, F.col("node_id")))
    return rows.groupBy("profile_id", "parent_id", "method", "depth", "key").agg(F.sum("total").alias("total"), F.count("*").alias("n")).drop("key")


def self_time(nodes: DataFrame, *, by: tuple[str, ...] = ("method", "file", "line")) -> DataFrame:
    """(*by, self, n): self times by method and place, without roots and folded rows."""
    return nodes.where((F.col("parent_id").isNotNull()) & (F.col("method") != OTHER)).groupBy(*by).agg(F.sum("self").alias("self"), F.count("*").alias("n"))


def triggers_by_site(triggers: DataFrame) -> DataFrame:
    """(site, n, callees, time) of triggers(site, caller, callee, time): by project site, else caller; pseudo files left out."""
    site = F.coalesce("site", "caller")
    rows = triggers.withColumn("place", site).where(~F.col("place").rlike(r"^(REPL\[|none|<|\(|\./boot)"))
    return rows.groupBy(F.col("place").alias("site")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("callee")).alias("callees"), F.sum("time").alias("time"))


def summary(trees: DataFrame, triggers: DataFrame) -> DataFrame:
    """(profile_id, n_trees, invalidated, inference_time)."""
    t = trees.groupBy("profile_id").agg(F.count("*").alias("n_trees"), F.sum("ninvalidated").alias("invalidated"))
    return t.join(triggers.groupBy("profile_id").agg(F.sum("time").alias("inference_time")), "profile_id", "full_outer")


def top_roots(trees: DataFrame, k: int) -> DataFrame:
    return trees.orderBy(F.desc("ninvalidated"), "method").limit(k)


def invalidation_gate(trees: DataFrame, most: int) -> DataFrame:
    return trees.groupBy("profile_id").agg(F.sum("ninvalidated").alias("invalidated")).withColumn("failed", F.col("invalidated") > most)


def findings(trees: DataFrame, triggers: DataFrame, files: DataFrame, *, threshold: int = 10) -> DataFrame:
    """(path, line, rule_id, severity, message): roots and triggers whose file is one of files(path)."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\\", "/"), "^\\./", "")
    known = files.select("path", norm("path").alias("key"))
    severity = F.when(F.col("ninvalidated") >= threshold, "warning").otherwise("info")
    a = trees.select(norm("file").alias("key"), "line", F.lit("profile/invalidation").alias("rule_id"), severity.alias("severity"), F.format_string("%s invalidates %d methods", "method", "ninvalidated").alias("message"))
    parts = F.regexp_extract(F.coalesce("site", "caller"), r"^(.*):(\d+)$", 1), F.regexp_extract(F.coalesce("site", "caller"), r"^(.*):(\d+)$", 2).try_cast("int")
    b = triggers.select(norm(parts[0]).alias("key"), parts[1].alias("line"), F.lit("profile/inference").alias("rule_id"), F.lit("info").alias("severity"), F.concat(F.lit("inference of "), "callee").alias("message"))
    return a.unionByName(b).join(known, "key").drop("key")


TAG = r"@sca(-ref)?\(\s*([A-Za-z0-9_.-]+)\s*(?:,\s*\"([^\"]*)\")?\s*\)"


def tags(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, ref, id, description): tags @sca(id, "text") and @sca-ref(id)."""
    from riskframe.functions.text import matches

    found = docs.where(F.col(text_col).contains("@sca")).select(id_col, F.explode(matches(F.col(text_col), TAG)).alias("m"))
    part = lambda g: F.regexp_extract("m.matched", TAG, g)
    return found.select(id_col, F.col("m.line").alias("line"), (part(1) != "").alias("ref"), part(2).alias("id"), F.nullif(part(3), F.lit("")).alias("description"))


def tag_points(tags: DataFrame) -> DataFrame:
    """(id, defs, refs, state): duplicate definitions, references without one, definitions that nothing refers to."""
    n = tags.groupBy("id").agg(F.count_if(~F.col("ref")).alias("defs"), F.count_if(F.col("ref")).alias("refs"))
    state = F.when(F.col("defs") > 1, "duplicate").when(F.col("defs") == 0, "orphan").when(F.col("refs") == 0, "not analysed").otherwise("ok")
    return n.withColumn("state", state)
