"""Compiler profiles in JSON as tables: invalidations, nodes of their trees and of inference, triggers.

A document is a VARIANT; trees are taken apart level by level, all of a level at once, so a step is a projection of the subtrees that
are left and no task walks a tree. A document of more than 128 MB, a VARIANT's limit, is a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskframe.steps import cut


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, doc, problem): each file; a problem is why it is no profile of version 1."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("profile_id"), F.try_parse_json("value").alias("doc"))
    listed = F.schema_of_variant(F.try_variant_get("doc", "$.invalidations", "variant")).startswith("ARRAY")
    ok = F.coalesce((F.try_variant_get("doc", "$.version", "int") == 1) & listed, F.lit(False))
    return rows.select("profile_id", "doc", F.when(F.col("doc").isNull(), "not JSON").when(~ok, "not a profile of version 1 with a list of invalidations").alias("problem"))


def field(name: str, kind: str, of: str = "v") -> Column:
    return F.try_variant_get(of, f"$.{name}", kind)


def place(of: str = "v", prefix: str = "") -> list[Column]:
    """What names a method instance."""
    return [field(f"{prefix}{c}", "long" if c == "line" else "string", of).alias(c) for c in ("sig", "method", "module", "file", "line")]


def elements(rows: DataFrame, path: str, *keep: str) -> DataFrame:
    """rows(*keep, v) to (*keep, at, v): the elements of the list at a path of v, none if there is no list."""
    parts = rows.select(*keep, F.coalesce(F.try_variant_get("v", path, "array<variant>"), F.array().cast("array<variant>")).alias("list"))
    return parts.select(*keep, F.posexplode("list").alias("at", "v"))


def invalidations(docs: DataFrame) -> DataFrame:
    """(profile_id, place, sig, method, module, file, line, reason, ninvalidated, mt_cache, mt_disable), most invalidated first; equal ones as they stand."""
    rows = elements(docs.where("problem is null").select("profile_id", F.col("doc").alias("v")), "$.invalidations", "profile_id")
    rows = rows.select("profile_id", "at", *place(), field("reason", "string").alias("reason"), *(F.coalesce(field(c, "long"), F.lit(0)).alias(c) for c in ("ninvalidated", "mt_cache", "mt_disable")))
    order = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("ninvalidated"), "at")) - 1
    return rows.withColumn("place", order).drop("at")


def triggers(docs: DataFrame) -> DataFrame:
    """(profile_id, at, callee, caller, site, time) of inference triggers; site is null where none is in the project."""
    rows = elements(docs.where("problem is null").select("profile_id", F.col("doc").alias("v")), "$.triggers", "profile_id")
    point = lambda k: F.when(field(f"{k}.file", "string").isNotNull(), F.struct(*(field(f"{k}.{c}", t).alias(c) for c, t in (("func", "string"), ("file", "string"), ("line", "long"))))).alias(k)
    return rows.select("profile_id", "at", F.struct(*place(prefix="callee.")).alias("callee"), point("caller"), point("site"), field("time", "double").alias("time"))


def walked(roots: DataFrame) -> DataFrame:
    """(profile_id, tree, node_id, parent_id, depth, v) of roots(profile_id, tree, v) and all below; an id is the path of places from the root."""
    frontier = cut(roots.select("profile_id", "tree", F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), "v"))
    levels = []
    while not frontier.isEmpty():
        levels.append(frontier)
        below = elements(frontier, "$.children", "profile_id", "tree", "node_id", "depth")
        frontier = cut(below.select("profile_id", "tree", F.concat_ws(".", "node_id", "at").alias("node_id"), F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), "v"))
    out = frontier
    for level in levels:
        out = out.unionByName(level)
    return out


def inference_nodes(docs: DataFrame) -> DataFrame:
    """(profile_id, node_id, parent_id, depth, name, sig, method, module, file, line, self, total) of the inference trees."""
    roots = docs.where("problem is null").select("profile_id", F.lit(0).alias("tree"), F.try_variant_get("doc", "$.inference.root", "variant").alias("v")).where("v is not null")
    return walked(roots).select("profile_id", "node_id", "parent_id", "depth", field("name", "string").alias("name"), *place(), field("self", "double").alias("self"), field("total", "double").alias("total"))


def backedge_nodes(docs: DataFrame) -> DataFrame:
    """(profile_id, invalidation, tree, trigger, node_id, parent_id, depth, sig, method, module, file, line, total): what invalidations reach.

    ``invalidation`` is its place in the file; trees are its backedges, then those of method tables, which name a trigger.
    """
    own = elements(docs.where("problem is null").select("profile_id", F.col("doc").alias("v")), "$.invalidations", "profile_id").withColumnRenamed("at", "invalidation")
    direct = elements(own, "$.backedges", "profile_id", "invalidation").select("profile_id", "invalidation", F.lit(0).alias("kind"), "at", F.lit(None).cast("string").alias("trigger"), "v")
    tables = elements(own, "$.mt_backedges", "profile_id", "invalidation").select("profile_id", "invalidation", F.lit(1).alias("kind"), "at", field("trigger", "string").alias("trigger"), F.try_variant_get("v", "$.root", "variant").alias("v"))
    roots = cut(direct.unionByName(tables).where("v is not null").withColumn("tree", F.struct("invalidation", "kind", "at", "trigger")))
    rows = walked(roots.select("profile_id", "tree", "v"))
    return rows.select("profile_id", "tree.invalidation", F.struct("tree.kind", "tree.at").alias("tree"), "tree.trigger", "node_id", "parent_id", "depth", *place(), field("total", "long").alias("total"))
