"""Connected components of an undirected graph by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Work


def connected_components(links: DataFrame, work: Work, rounds: int = 60) -> DataFrame:
    """links(a, b) to (id, component): the smallest id that is reachable, for every id of a link.

    Each round has only equi-joins and partial minima, so a node with many links is never one list.
    Nulls and self-links are ignored; repeated links change nothing; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = work.save(edges, "edges")
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour of u, linked to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours, linked to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = work.save(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        seen = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(edges)
        edges = fresh
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)
