"""Hard negatives by an STR-packed R-tree: rows of another label whose score with an anchor lies in a window below a positive's.

Rows are tiled by sorting recursively (label, then three coordinates in turn, each cut at quantiles); a tile is a shard, in which
a task packs the lower levels of the tree the same way. The shards' own boxes are the tree's top level: it routes blocks of
anchors to the shards whose interval of inner products meets a window, as a job. In a shard each anchor has a queue, best bound
first: a box goes if its interval meets none of the windows that are still open, or lies strictly below the kth score of all.

A score is the integer inner product of components floor(scale * x). Doubles hold it exactly below 2**53, which is checked
for each leaf; beyond that Python integers are used. Every box bounds all its rows, so results are those of a full search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import Work, in_batches, in_groups

#: Rows of a shard, of a leaf, children of a node; anchors of a block; shards whose boxes are looked at together.
SHARD, LEAF, FANOUT, BLOCK, PAGE = 8192, 128, 8, 512, 512
#: Coordinates by which tiles are cut.
LEVELS = 3
EXACT = float(2**53)
LONG = 2**63
#: Larger components count as this, so that scaling stays finite; scores beyond a long count as its nearest value.
LARGEST = 2.0**1000


def matrix(column: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """Lists of numbers as scaled integers in doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return np.floor(scale * np.clip(out, -LARGEST, LARGEST))


def tiled(x: np.ndarray, leaf: int, axes: list[int]) -> np.ndarray:
    """An order of the rows in which each ``leaf`` in a row are a tile: sort by an axis, cut into slabs, go on with the next axis."""
    if not axes or len(x) <= leaf:
        return np.arange(len(x))
    order = np.argsort(x[:, axes[0]], kind="stable")
    tiles = -(-len(x) // leaf)
    slab = leaf * -(-tiles // max(1, round(tiles ** (1 / len(axes)))))
    return np.concatenate([order[at : at + slab][tiled(x[order[at : at + slab]], leaf, axes[1:])] for at in range(0, len(x), slab)])


def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Least and largest values of all nodes, leaves first and each level's parents after it, and where each level begins."""
    starts = np.arange(0, len(x), LEAF)
    low, high = [np.minimum.reduceat(x, starts)], [np.maximum.reduceat(x, starts)]
    levels = [0, len(starts)]
    while len(low[-1]) > 1:
        starts = np.arange(0, len(low[-1]), FANOUT)
        low.append(np.minimum.reduceat(low[-1], starts))
        high.append(np.maximum.reduceat(high[-1], starts))
        levels.append(levels[-1] + len(starts))
    return np.concatenate(low), np.concatenate(high), levels


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner product of each row of a with any vector in each box; without limits where doubles may round."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        large = np.abs(a).max(axis=1, initial=0)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0)[None] * max(1, a.shape[1])
    rounded = ~(large < EXACT)
    least[rounded], most[rounded] = -np.inf, np.inf
    return least, most


def products(x: np.ndarray, a: np.ndarray, exact: bool) -> list[int] | np.ndarray:
    if exact:
        return x @ a
    own = [int(v) for v in a]
    return np.array([max(-LONG, min(LONG - 1, sum(int(v) * w for v, w in zip(row, own, strict=True)))) for row in x], object)


class Shard:
    """A packed shard: the lower levels of the tree."""

    def __init__(self, ids: bytes, vectors: bytes, width: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vectors, "<f8").reshape(len(self.ids), width)
        self.low, self.high, self.levels = boxes(self.x)

    def search(self, a: np.ndarray, least: np.ndarray, most: np.ndarray, own: int, windows: list[tuple[int | float, int | float]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (from, to) the k rows of the highest scores in it but ``own``, as (-score, id).

        ``least`` and ``most`` are the intervals of all nodes with a.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        # what a score must reach to count: the window's lower end, and once there are k the kth score
        need = [low for low, _ in windows]
        floor, top = min(need), max(high for _, high in windows)
        root = len(most) - 1
        queue = [(-most[root], root, len(self.levels) - 2)]
        while queue:
            bound, node, level = heapq.heappop(queue)
            if -bound < floor:
                break
            if least[node] > top or not any(-bound >= n and least[node] <= high for n, (_, high) in zip(need, windows, strict=True)):
                continue
            if level:
                begin = self.levels[level - 1] + (node - self.levels[level]) * FANOUT
                for child in range(begin, min(begin + FANOUT, self.levels[level])):
                    if most[child] >= floor and least[child] <= top:
                        heapq.heappush(queue, (-most[child], child, level - 1))
                continue
            rows = slice(node * LEAF, (node + 1) * LEAF)
            scores = products(self.x[rows], a, np.isfinite(most[node]))
            for i in np.flatnonzero((scores >= floor) & (scores <= top)):
                score, vec_id = int(scores[i]), int(self.ids[rows][i])
                if vec_id == own:
                    continue
                for w, (_, high) in enumerate(windows):
                    if need[w] <= score <= high:
                        heap = found[w]
                        # the worst on top: lowest score, then largest id
                        heapq.heappush(heap, (score, -vec_id))
                        if len(heap) > k:
                            heapq.heappop(heap)
                        if len(heap) == k:
                            need[w] = max(need[w], heap[0][0])
            floor = min(need)
        return [sorted((-s, -i) for s, i in heap) for heap in found]


def each(make):
    """make for each group of a table of whole groups, which are sorted by the first column."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        ends = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield make(table.slice(a, b - a))

    return run


def spread_axes(rows: DataFrame, width: int) -> list[int]:
    """The coordinates of the largest variance."""

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.clip(matrix(batch.column(0), width, 1.0), -1e100, 1e100)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, float(len(x)))), pa.array(x.sum(0)), pa.array((x * x).sum(0))], ["axis", "n", "s", "q"])

    # scaled, since matrix rounds down to integers
    scaled = rows.select(F.transform("vector", lambda v: v * 65536.0).alias("vector"))
    found = in_batches(scaled, sums, "axis long, n double, s double, q double").groupBy("axis").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2))).alias("v"))
    return [r.axis for r in found.orderBy(F.desc("v"), "axis").limit(LEVELS).collect()]


def tiles(rows: DataFrame, work: Work, axes: list[int]) -> DataFrame:
    """rows with t0, t1, ... and part: a tile of at most about SHARD rows. Equal vectors beyond that are dealt out by id."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    left = F.ceil(F.col("n") / SHARD)
    for k in range(len(axes)):
        cuts = F.ceil(F.pow(left, F.lit(1.0 / (len(axes) - k)))).cast("int")
        counts = counts.withColumn(f"cuts{k}", cuts)
        left = F.ceil(left / F.col(f"cuts{k}"))
    counts = work.save(counts, "counts")
    for k, axis in enumerate(axes):
        if counts.where(f"cuts{k} > 1").isEmpty():
            rows = rows.withColumn(f"t{k}", F.lit(0))
            continue
        by = ["label", *(f"t{j}" for j in range(k))]
        value = F.coalesce(F.get("vector", F.lit(axis)), F.lit(0.0))
        # a thousandth is fine enough: a tile that comes out larger is dealt out below
        edges = rows.groupBy(*by).agg(F.percentile_approx(value, [q / 1024 for q in range(1, 1024)], 10_000).alias("edges"))
        edges = edges.join(counts.select("label", f"cuts{k}"), "label").select(*by, F.transform(F.sequence(F.lit(1), F.col(f"cuts{k}") - 1), lambda i: F.get("edges", (i * 1024 / F.col(f"cuts{k}") - 1).cast("int"))).alias("edges"), f"cuts{k}")
        edges = edges.withColumn("edges", F.when(F.col(f"cuts{k}") > 1, F.col("edges")).otherwise(F.array().cast("array<double>"))).drop(f"cuts{k}")
        edges = work.save(edges, "edges")
        rows = rows.join(edges, by).withColumn(f"t{k}", F.size(F.filter("edges", lambda e: e < value))).drop("edges")
    by = ["label", *(f"t{k}" for k in range(len(axes)))]
    sizes = work.save(rows.groupBy(*by).agg(F.ceil(F.count("*") / SHARD).alias("parts")), "sizes")
    rows = rows.join(sizes, by)
    return rows.select("vec_id", "vector", "label", F.concat_ws("/", *by, F.pmod(F.xxhash64("vec_id"), "parts")).alias("shard"))


def search_blocks(work: Work, name: str, blocks: DataFrame, pages: DataFrame, n_pages: int, shards: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, positive_id, positive_score, vec_id, score): the k best rows of each window in each shard.

    blocks(block, ids, vectors, labels, positives): a window lies between the bounds of a positive; without positives it has no bounds.
    """

    def windows(positives: list[dict]) -> list[tuple[int | float, int | float]]:
        if same_label:
            return [(-np.inf, np.inf)]
        # 80 * positive <= 100 * score: the least such integer
        return [(-(-4 * p["score"] // 5), p["score"]) for p in positives]

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            a = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
            least, most = intervals(a, np.frombuffer(row["low"], "<f8").reshape(-1, width), np.frombuffer(row["high"], "<f8").reshape(-1, width))
            labels = np.array(row["labels"], object)
            meets = (labels[:, None] == np.array(row["shard_labels"], object)[None]) == same_label
            if not same_label:
                open_at = [windows(p) for p in row["positives"]]
                for i, own in enumerate(open_at):
                    meets[i] &= np.logical_or.reduce([(most[i] >= low) & (least[i] <= high) for low, high in own])
            out += [{"block": row["block"], "shard": row["shards"][s]} for s in np.flatnonzero(meets.any(axis=0))]
        return pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.string()), ("shard", pa.string())]))

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            shard = Shard(row["shard_ids"], row["shard_vectors"], width)
            a = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
            least, most = intervals(a, shard.low, shard.high)
            for i, (anchor, label) in enumerate(zip(np.frombuffer(row["ids"], "<i8").tolist(), row["labels"], strict=True)):
                if (label == row["shard_label"]) != same_label:
                    continue
                positives = [{"vec_id": None, "score": None}] if same_label else row["positives"][i]
                found = shard.search(a[i], least[i], most[i], anchor, windows(positives), k)
                out += [(anchor, p["vec_id"], p["score"], vec_id, -score) for p, best in zip(positives, found, strict=True) for score, vec_id in best]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    # each block meets each page of boxes: a query set in blocks against the top level of the tree
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page")
    routed = in_batches(blocks.select("*", numbers).join(pages, "page"), route, "block string, shard string")
    pairs = work.save(routed, f"{name}-pairs")
    joined = pairs.join(blocks, "block").join(shards.select("shard", F.col("label").alias("shard_label"), F.col("ids").alias("shard_ids"), F.col("vectors").alias("shard_vectors")), "shard")
    found = in_batches(joined, look, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return work.save(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), name)


def mine_hard_negatives(rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` best other rows of its label. For each, the ``negatives`` best rows of other
    labels whose score is at most the positive's and at least 0.8 times that. Higher scores first, ties by smaller id.
    ``anchor`` is a condition on rows, such as on the id.

    Rows without id, label or vector, with a null or non-finite component take no part. Of rows that repeat an id the one with the
    least label, then vector, counts. Shorter vectors are filled with zeros; an empty one has score 0 with all. Equal vectors are
    rows of their own. A negative positive score has no negatives, since 0.8 times it is more than it. No rows, no anchors or one
    label only give no rows. Other columns may be used by ``anchor`` and are ignored else.
    """
    work = Work(rows.sparkSession, "hard-negatives")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd))
    base = base.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*")
    base = work.save(base, "rows")
    width = base.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("w")).first().w
    none = base.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score")).where("false")
    if not base.where("anchor").limit(1).count():
        return none
    width = max(width, 1)

    def pack(table: pa.Table) -> pa.RecordBatch:
        x = matrix(table["vector"], width, scale)
        ids = table["vec_id"].to_numpy()
        # by id first, so that the order does not depend on how rows came
        order = np.argsort(ids, kind="stable")
        axes = np.argsort(-np.clip(x, -1e100, 1e100).var(axis=0), kind="stable")[:LEVELS].tolist()
        order = order[tiled(x[order], LEAF, axes)]
        x = x[order]
        packed = {"shard": table["shard"][0].as_py(), "label": table["label"][0].as_py(), "ids": ids[order].astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "low": x.min(0).tobytes(), "high": x.max(0).tobytes()}
        return pa.RecordBatch.from_pylist([packed])

    tile = tiles(base.drop("anchor"), work, spread_axes(base, width))
    tile = work.save(tile, "tiles")
    n_shards = tile.agg(F.count_distinct("shard")).first()[0]
    shards = in_groups(tile.select("shard", "vec_id", "vector", "label"), ["shard"], [], each(pack), "shard string, label string, ids binary, vectors binary, low binary, high binary", partitions=min(n_shards, 20_000))
    shards = work.save(shards, "shards")
    n_pages = -(-n_shards // PAGE)
    heads = shards.select(F.pmod(F.xxhash64("shard"), F.lit(n_pages)).cast("int").alias("page"), "shard", "label", "low", "high")

    def page(table: pa.Table) -> pa.RecordBatch:
        glued = {c: b"".join(table[c].to_pylist()) for c in ("low", "high")}
        return pa.RecordBatch.from_pylist([{"page": table["page"][0].as_py(), "shards": table["shard"].to_pylist(), "shard_labels": table["label"].to_pylist(), **glued}], pa.schema([("page", pa.int32()), ("shards", pa.list_(pa.string())), ("shard_labels", pa.list_(pa.string())), ("low", pa.binary()), ("high", pa.binary())]))

    pages = work.save(in_groups(heads, ["page"], ["shard"], each(page), "page int, shards array<string>, shard_labels array<string>, low binary, high binary"), "pages")

    def block(table: pa.Table) -> pa.RecordBatch:
        x = matrix(table["vector"], width, scale)
        row = {"block": table["block"][0].as_py(), "ids": table["vec_id"].to_numpy().astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "labels": table["label"].to_pylist(), "positives": table["positives"].to_pylist()}
        positives = pa.list_(pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))
        return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("labels", pa.list_(pa.string())), ("positives", positives)]))

    def in_blocks(anchors: DataFrame, by: Column, name: str) -> DataFrame:
        """Anchors in blocks of about BLOCK."""
        sizes = anchors.groupBy(by.alias("group")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        dealt = anchors.withColumn("group", by).join(sizes, "group").withColumn("block", F.concat_ws("/", "group", F.pmod(F.xxhash64("vec_id"), "parts")))
        return work.save(in_groups(dealt.select("block", "vec_id", "vector", "label", "positives"), ["block"], ["vec_id"], each(block), "block string, ids binary, vectors binary, labels array<string>, positives array<array<struct<vec_id:bigint,score:bigint>>>"), name)

    anchors = base.where("anchor").drop("anchor")
    alone = anchors.withColumn("positives", F.array().cast("array<struct<vec_id:bigint,score:bigint>>"))
    best = search_blocks(work, "positives", in_blocks(alone, F.col("label"), "blocks"), pages, n_pages, shards, width, positives, True)
    own = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    found = search_blocks(work, "negatives", in_blocks(anchors.join(own, "vec_id"), F.lit(""), "blocks"), pages, n_pages, shards, width, negatives, False)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
