"""Approximate nearest neighbours: an NN-descent graph, searched greedily. Both are iterative joins.

Equal vectors are one node, so that a vector that many rows share is compared once. Nodes carry single-precision
codes for the graph and the search, so that a few long vectors leave the others as they are; final distances are exact, in double precision on the original vectors.

Building: a first graph links rows that lie close on random hyperplane orders. Each round joins the neighbours and
(a bounded draw of) reverse neighbours of every node u and compares them with each other: neighbours of neighbours. A node keeps
its DEGREE nearest. Rounds end when few edges are new.

Searching: each query keeps the nodes it has seen. A round expands those among its BEAM nearest that were not expanded,
by a join with the graph, until none is left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import Work, fixed_binary, in_batches, in_groups, to_binary
from riskframe.shipping import ship

#: Neighbours of a node; reverse neighbours that take part in a round; links of a node that a search follows.
DEGREE, REVERSE, LINKS = 24, 12, 60
#: Rows that are compared with each other for the first graph; orders for it, which are far cheaper than rounds; neighbours that each gives.
CHUNK, ORDERS, PICKED = 256, 12, 10
#: Proposals of one node in one local join.
PROPOSED = 8
#: Part of all edges that must be new for another round.
FRESH = 0.02
#: Nearest nodes that a search expands; entry nodes; nodes with exact distances.
BEAM, ENTRIES, EXACT = 256, 32, 64
#: Squared distances of codes may be wrong by this part, or by its square in units of the median vector.
ROUNDING = 1e-5
#: Components in codes at most, in those of a median vector: so far, squares stay finite in single precision.
FAR = 1e17
#: Queries up to this many are broadcast to the nodes that they meet.
FEW_QUERIES = 20_000


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with double vectors, without those that are null, zero, or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and of b, in double precision and about their middle, so that a common offset cancels nothing."""
    middle = np.median(b, axis=0).astype(float)
    a, b = a - middle, b - middle
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0)


def edges(src: list[np.ndarray], dst: list[np.ndarray], dist: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(dist).astype(np.float32))], ["src", "dst", "dist"])


EDGE = "src long, dst long, dist float"


def ordered(nodes: DataFrame, width: int, bits: int, orders: int) -> DataFrame:
    """Edges between nodes that lie within one chunk of an order: by the signs of random projections, then by one more."""
    planes = np.random.default_rng(0).standard_normal((width, orders * (bits + 1))).astype(np.float32)

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = (fixed_binary(batch.column(1), 4 * width, np.float32) @ planes).reshape(batch.num_rows, orders, bits + 1)
        region = ((y[:, :, :bits] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int64)
        row = pa.array(np.repeat(np.arange(batch.num_rows), orders))
        seed = np.tile(np.arange(orders, dtype=np.int32), batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(seed), pa.array(region.reshape(-1)), pa.array(y[:, :, bits].reshape(-1))], ["id", "code", "seed", "region", "place"])

    def link(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def compared(table: pa.Table):
            ids, seeds = table["id"].to_numpy(), table["seed"].to_numpy()
            x = fixed_binary(table["code"], 4 * width, np.float32)
            src, dst, dist = [], [], []
            for at in range(0, len(ids), CHUNK):
                part = slice(at, at + CHUNK)
                d = squared(x[part], x[part])
                n = len(d)
                if n < 2:
                    continue
                # itself, or another order that begins within the chunk
                d[(ids[part, None] == ids[None, part]) | (seeds[part, None] != seeds[None, part])] = np.inf
                k = min(PICKED if len(ids) > CHUNK else DEGREE, n - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(np.isfinite(value))
                src.append(ids[part][row])
                dst.append(ids[part][near[row, col]])
                dist.append(value[row, col])
            if src:
                yield edges(src, dst, dist)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * CHUNK:
                yield from compared(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from compared(pa.Table.from_batches(held))

    placed = in_batches(nodes, project, "id long, code binary, seed int, region long, place float")
    return placed.repartitionByRange("seed", "region", "place").sortWithinPartitions("seed", "region", "place", "id").mapInArrow(link, EDGE)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest different dst of each src."""
    best = found.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("k") <= k)


def local_join(table: pa.Table, width: int):
    """Proposals between the members of each node's neighbourhood, where one of both is new to it."""
    at = table["u"].to_numpy()
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    stop = np.r_[start[1:], len(at)]
    ids, kth, fresh = table["v"].to_numpy(), table["kth"].to_numpy(), table["fresh"].to_numpy().astype(bool)
    x = fixed_binary(table["code"], 4 * width, np.float32)
    src, dst, dist = [], [], []
    for a, b in zip(start, stop, strict=True):
        n = b - a
        if n < 2 or not fresh[a:b].any():
            continue
        d = squared(x[a:b], x[a:b])
        known = ids[a:b, None] == ids[None, a:b]
        d[known | ~(fresh[a:b, None] | fresh[None, a:b]) | (d >= kth[a:b, None])] = np.inf
        k = min(PROPOSED, n - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(d, near, 1)
        row, col = np.nonzero(np.isfinite(value))
        if len(row):
            src.append(ids[a:b][row])
            dst.append(ids[a:b][near[row, col]])
            dist.append(value[row, col])
    if src:
        yield edges(src, dst, dist)


def build(nodes: DataFrame, width: int, work: Work) -> DataFrame:
    """(src, dst, dist, fresh, k): the neighbour graph of nodes(id, code) by NN-descent."""
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / CHUNK)))
    found = ordered(nodes, width, bits, ORDERS if n > CHUNK else 1)
    graph = work.save(nearest(found.withColumn("fresh", F.lit(1)), DEGREE), "graph")
    while True:
        far = graph.groupBy("src").agg(F.max("dist").alias("kth"), F.count("*").alias("links"))
        far = far.select(F.col("src").alias("v"), F.when(F.col("links") >= DEGREE, F.col("kth")).otherwise(float("inf")).cast("float").alias("kth"))
        draw = Window.partitionBy("dst").orderBy(F.desc("fresh"), F.xxhash64("src", "dst"))
        back = graph.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= REVERSE)
        members = graph.select(F.col("src").alias("u"), F.col("dst").alias("v"), "fresh").unionByName(back.select(F.col("dst").alias("u"), F.col("src").alias("v"), "fresh"))
        members = members.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        members = members.join(far, "v").join(nodes.withColumnRenamed("id", "v"), "v")
        proposed = in_groups(members, ["u"], ["v"], lambda t: local_join(t, width), EDGE).withColumn("fresh", F.lit(1))
        # an edge that was there stays an old one: the least of both marks
        fresh = work.save(nearest(graph.select("src", "dst", "dist", F.lit(0).alias("fresh")).unionByName(proposed), DEGREE), "graph")
        work.drop(graph)
        graph = fresh
        if (graph.agg(F.avg("fresh")).first()[0] or 0.0) < FRESH:
            return graph


def measured(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """pairs(q, id) with the distance of their codes."""

    def far(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (fixed_binary(batch.column(k), 4 * width, np.float32) for k in (2, 3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(((a - b) ** 2).sum(axis=1))], ["q", "id", "dist"])

    rows = pairs.join(nodes, "id").join(queries.withColumnRenamed("code", "wanted"), "q")
    return in_batches(rows.select("q", "id", "code", "wanted"), far, "q long, id long, dist float")


def greedy(queries: DataFrame, starts: DataFrame, nodes: DataFrame, graph: DataFrame, width: int, work: Work, beam: int) -> DataFrame:
    """(q, id, dist): the nodes near each query. queries: (q, code); starts: (q, id); nodes: (id, code)."""
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    both = graph.select("src", "dst", "dist").unionByName(back).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    links = both.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("k") <= LINKS)
    links = work.save(links.groupBy("src").agg(F.collect_list("dst").alias("near")), "links")
    best = Window.partitionBy("q").orderBy("dist", "id")

    def ranked(rows: DataFrame) -> DataFrame:
        # what is among the beam and was not expanded is expanded next
        place = F.row_number().over(best)
        return work.save(rows.withColumn("open", ~F.col("done") & (place <= beam)), "seen")

    few = queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES
    asked = F.broadcast(queries) if few else queries
    seen = ranked(measured(starts.distinct(), nodes, asked, width).withColumn("done", F.lit(False)))
    # ends: a round expands nodes that were not expanded before
    while True:
        frontier = seen.where("open").select("q", F.col("id").alias("src"))
        if frontier.isEmpty():
            break
        reached = frontier.join(links, "src").select("q", F.explode("near").alias("id")).distinct()
        new = reached.join(seen.select("q", "id"), ["q", "id"], "left_anti")
        new = measured(new, nodes, asked, width).withColumn("done", F.lit(False))
        old = seen.select("q", "id", "dist", (F.col("done") | F.col("open")).alias("done"))
        fresh = ranked(old.unionByName(new))
        work.drop(seen)
        seen = fresh
    return seen.select("q", "id", "dist")


def nearest_neighbours(rows: DataFrame, queries: DataFrame | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found but itself, nearest first, ties to the smaller id.

    queries are rows of the table (ids of which are matched), by default those whose id ``every`` divides. score is the Euclidean
    distance of the original vectors. Vectors that are null, zero, or hold null or non-finite components, and null ids take no
    part. A vector that is shorter than the longest one stands for itself with zeros behind. Of rows that repeat an id the
    smallest vector counts.
    Fewer candidates than k are all returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Work(spark, "neighbours")
    rows = clean(rows, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = work.save(rows, "vectors")
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width = sizes[1] or 1
    if sizes[0] != sizes[1]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
        rows = work.save(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    # codes are about the components' medians and in units of the median vector: an offset or a few long vectors cost no precision
    middles = rows.select(F.posexplode("v").alias("c", "x")).groupBy("c").agg(F.percentile_approx("x", 0.5).alias("m")).collect()
    centre = np.zeros(width)
    for r in middles:
        centre[r.c] = r.m
    away = F.array_max(F.transform(F.zip_with("v", F.lit(centre.tolist()), lambda x, m: x - m), F.abs))
    scale = rows.select(away.alias("a")).where("a > 0 and a < double('infinity')").agg(F.percentile_approx("a", 0.5)).first()[0] or 1.0
    classes = work.save(rows.groupBy("v").agg(F.min("vec_id").alias("id")), "classes")

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            x = np.clip((batch.column(1).flatten().to_numpy().reshape(-1, width) - centre) / scale, -FAR, FAR)
        return pa.RecordBatch.from_arrays([batch.column(0), to_binary(x.astype(np.float32))], ["id", "code"])

    nodes = work.save(in_batches(classes.select("id", "v"), coded, "id long, code binary"), "nodes")
    graph = build(nodes, width, work)
    # at most k + 1 rows of a class can be among the k nearest of a query
    members = rows.join(classes.withColumnRenamed("id", "node"), "v").select("node", "vec_id", "v")
    members = members.withColumn("j", F.row_number().over(Window.partitionBy("node").orderBy("vec_id")))
    if queries is None:
        asked = members.where(F.col("vec_id") % every == 0)
    else:
        asked = members.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = work.save(rows.join(asked.select("vec_id", "node"), "vec_id").select(F.col("vec_id").alias("query_id"), "node", F.col("v").alias("w")), "queries")
    members = work.save(members.where(F.col("j") <= k + 1).select("node", "vec_id", "v"), "members")
    # queries with equal vectors are searched for once
    sought = asked.select(F.col("node").alias("q")).distinct()
    wanted = work.save(sought.join(nodes.withColumnRenamed("id", "q"), "q"), "wanted")
    entries = nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).select("id")
    starts = wanted.select("q").crossJoin(F.broadcast(entries)).unionByName(wanted.select("q", F.col("q").alias("id")))
    near = greedy(wanted, starts, nodes, graph, width, work, beam)
    # nodes that rounding may have put behind the last one come along
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("dist", "id")))
    last = F.max(F.when(F.col("k") <= EXACT, F.col("dist"))).over(Window.partitionBy("q"))
    near = near.withColumn("last", last).where(F.col("dist") <= F.col("last") * (1 + ROUNDING) + ROUNDING * ROUNDING)
    near = work.save(near.select(F.col("q").alias("node"), F.col("id").alias("near")), "near")
    pairs = asked.join(near, "node").join(members.withColumnRenamed("node", "near"), "near").where("vec_id <> query_id")
    pairs = pairs.select("query_id", "vec_id", F.zip_with("v", "w", lambda a, b: a - b).alias("gap"))
    norm = lambda m: F.sqrt(F.aggregate("gap", F.lit(0.0), lambda s, x: s + (x / m) * (x / m)))
    # where squares leave the range of a double they are taken of parts of the largest difference
    largest, plain = F.array_max(F.transform("gap", F.abs)), norm(F.lit(1.0))
    odd = (plain == float("inf")) & (largest < float("inf")) | (plain < 1e-150) & (largest > 0)
    pairs = pairs.select("query_id", "vec_id", F.when(odd, largest * norm(largest)).otherwise(plain).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
