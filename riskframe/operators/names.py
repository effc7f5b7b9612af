"""Names against reference lists: removed packages, trusted publishers, look-alikes of popular names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.functions.text import fold_lookalikes, osa, removal_weight


def order_by_name():
    """The order of a list whose places are not given."""
    return Window.orderBy(F.desc("n"), "w")


def known_bad_signals(packages: DataFrame, removed: DataFrame, *, pkg: str = "pkg_id") -> DataFrame:
    """(pkg, signal_id, weight, force) of packages in removed(id, type), in any case."""
    r = removed.select(F.lower("id").alias("__id"), "type")
    weight = removal_weight(F.col("type"))
    hit = packages.join(r, F.lower(packages[pkg]) == r["__id"])
    return hit.select(pkg, F.lit("known-bad").alias("signal_id"), weight.alias("weight"), F.when(weight == 10, "high").alias("force"))


def publisher_signals(packages: DataFrame, trusted: list[str], *, pkg: str = "pkg_id") -> DataFrame:
    """Trusted publishers' packages weigh -2, unless they were side-loaded or are built in; others' publishers are unknown."""
    known = F.lower("publisher").isin([t.lower() for t in trusted])
    rows = packages.where(~(known & F.col("source").isin("vsix", "builtin")))
    return rows.select(pkg, F.when(known, "trusted-publisher").otherwise("unknown-publisher").alias("signal_id"), F.when(known, -2).otherwise(0).alias("weight"))


def publisher(c):
    return F.substring_index(F.lower(c), ".", 1)


def typosquats(ids: DataFrame, popular: DataFrame) -> DataFrame:
    """(id, target, reason, distance): ids like publisher.name that look like a popular one (ord, id) of another publisher.

    An equal look-alike form wins, first in the list's order. Else the whole ids' distance is at most 1, or 2 if the target has
    ten characters or more; the smallest, then the first. Candidates share a piece: of k + 1 pieces of the target one is
    untouched by k edits, so ids are joined on pieces and not compared with the whole list.
    """
    mine = ids.select(F.lower("id").alias("id")).distinct()
    known = popular.select("ord", F.lower("id").alias("target")).withColumn("most", F.when(F.length("target") < 10, 1).otherwise(2))
    mine = mine.join(known, mine["id"] == known["target"], "left_anti")
    folded = mine.withColumn("form", fold_lookalikes(F.col("id"))).join(known.withColumn("form", fold_lookalikes(F.col("target"))), "form")
    folded = folded.where(publisher("id") != publisher("target")).select("id", "target", "ord", F.lit("homoglyph").alias("reason"), F.lit(0).alias("distance"))
    # pieces of a target, with their places; an edit or transposition touches at most two pieces, so 2k + 1 leave one whole
    n = 2 * F.col("most") + 1
    size = F.ceil(F.length("target") / n)
    spots = known.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("at", F.col("k") * size)
    spots = spots.withColumn("piece", F.col("target").substr((F.col("at") + 1).cast("int"), size.cast("int"))).where("piece <> ''")
    spots = spots.withColumn("shift", F.explode(F.sequence(-F.col("most"), F.col("most")))).select("target", "ord", "most", (F.col("at") + F.col("shift")).cast("int").alias("at"), "piece", F.length("piece").alias("size"))
    lengths = spots.select("size").distinct()
    grams = mine.join(F.broadcast(lengths)).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.length("id") - F.col("size"), F.lit(0)))))
    grams = grams.withColumn("piece", F.col("id").substr(F.col("at") + 1, F.col("size")))
    pairs = grams.join(spots, ["at", "piece"]).where(F.abs(F.length("id") - F.length("target")) <= F.col("most")).where(publisher("id") != publisher("target"))
    pairs = pairs.select("id", "target", "ord", "most").distinct().where(F.levenshtein("id", "target") <= 2 * F.col("most"))
    near = pairs.withColumn("distance", osa(F.col("id"), F.col("target"))).where("distance <= most").select("id", "target", "ord", F.lit("distance").alias("reason"), "distance")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("reason"), "distance", "ord"))
    return folded.unionByName(near).withColumn("k", place).where("k = 1").select("id", "target", "reason", "distance")


def npm_typosquats(npm: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target) of unscoped names of 4 characters or more that are not popular (ord, name) but nearly.

    Equal without - _ and ., or for targets of 5 characters or more one edit away; the first popular name.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_.]", "")
    mine = npm.select("name").distinct().where((F.length("name") >= 4) & ~F.col("name").startswith("@"))
    known = popular.select("ord", F.col("name").alias("target"))
    mine = mine.join(known, mine["name"] == known["target"], "left_anti")
    same = mine.withColumn("form", plain("name")).join(known.withColumn("form", plain("target")), "form").select("name", "target", "ord")
    # one edit away: equal without one character, or with two neighbours swapped
    drops = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))))
    a = mine.withColumn("form", F.explode(drops(F.col("name"))))
    b = known.where(F.length("target") >= 5).withColumn("form", F.explode(drops(F.col("target"))))
    near = a.join(b, "form").select("name", "target", "ord").distinct().where((F.abs(F.length("name") - F.length("target")) <= 1) & (osa(F.col("name"), F.col("target")) == 1))
    return same.unionByName(near).groupBy("name").agg(F.min_by("target", "ord").alias("target"))
