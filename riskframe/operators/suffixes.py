"""Repeats of every length in sequences, by suffix ranks and common prefixes of neighbours.

Ranks of prefixes of 16 symbols give those of 256, and so on, until all suffixes differ: a source of n samples takes log16(n) rounds,
whatever repeats in it. A round sorts distinct keys only, so a key that many places share is one row. Sequences travel in blocks,
of which each task holds a few. How long the common prefix of neighbouring suffixes is follows from where their keys first
differ, looked up level by level. Runs of common prefixes are then found block by block, and the counts of every length are sums over runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.shipping import ship
from riskframe.steps import cut

#: Names that a key joins; samples of a block; suffixes of a block (as powers of two).
FAN, BLOCK, LCP_BITS = 16, 1 << 15, 16
#: Bits of a generated id that number a partition's rows.
INSIDE = 33
#: Lengths whose sums are taken together.
LENGTHS_BITS = 12


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def blobs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def lookup_keys(column: pa.ChunkedArray) -> np.ndarray:
    """Keys of FAN names each as a matrix; no key has zeros only, so a missing one is that."""
    zero = bytes(8 * FAN)
    return np.frombuffer(b"".join(x or zero for x in column.to_pylist()), ">u8").reshape(-1, FAN)


def symbol_blocks(samples: DataFrame) -> DataFrame:
    """(source_id, block, names): symbols as numbers from 1, in order, BLOCK of them in a row."""

    def glue(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["i"].to_numpy(), kind="stable")
        names = table["sym"].to_numpy().astype(np.int64)[order].astype(np.uint64) + np.uint64(1 << 63)
        return pa.table({"source_id": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "names": blobs([names])})

    ship(samples.sparkSession)
    rows = samples.select(F.col("source_id").cast("string").alias("source_id"), F.col("i").cast("long").alias("i"), F.col("sym").cast("long").alias("sym"))
    rows = rows.withColumn("block", F.floor(F.col("i") / BLOCK))
    return rows.groupBy("source_id", "block").applyInArrow(glue, "source_id string, block long, names binary")


def keys_of(blocks: DataFrame, h: int) -> DataFrame:
    """(source_id, block, key, places): the distinct keys of each block and where they stand. A key joins the names at 0, h, 2h, ...; 0 is the end."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        at = key[1].as_py()
        found = {c: np.frombuffer(x, "<u8") for c, x in zip(table["from"].to_pylist(), table["names"].to_pylist(), strict=True)}
        n = len(found[at])
        keys = np.zeros((n, FAN), ">u8")
        for j in range(FAN):
            for c, names in found.items():
                # where this block's names stand, seen from the places of the own one
                shift = (c - at) * BLOCK - j * h
                a, b = max(0, shift), min(n, shift + len(names))
                if a < b:
                    keys[a:b, j] = names[a - shift : b - shift]
        distinct, first, which = np.unique(keys.view(f"S{8 * FAN}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable").astype("<i4")
        ends = np.cumsum(np.bincount(which, minlength=len(distinct))).astype(np.int64)
        offsets = (4 * np.r_[0, ends]).astype(np.int32)
        places = pa.Array.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(order.tobytes())])
        return pa.table({"source_id": pa.array([key[0].as_py()] * len(distinct), pa.string()), "block": pa.array(np.full(len(distinct), at)), "key": binary(keys[first]), "places": places})

    back = sorted({s for j in range(FAN) for s in (j * h // BLOCK, -(-j * h // BLOCK))})
    sent = blocks.select("source_id", F.col("block").alias("from"), "names", F.explode(F.array(*(F.col("block") - s for s in back))).alias("block")).where("block >= 0")
    return sent.groupBy("source_id", "block").applyInArrow(join, "source_id string, block long, key binary, places binary")


def named(keys: DataFrame) -> DataFrame:
    """(source_id, name, key, differs, own, other) of the distinct keys in order: the first place at which a key differs from that before it, and the names there.

    ``differs`` is -1 for the first key of a source and null for the first of a partition.
    """
    ordered = keys.select("source_id", "key").distinct().repartitionByRange("source_id", "key").sortWithinPartitions("source_id", "key").withColumn("name", F.monotonically_increasing_id())

    def compare(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            now = lookup_keys(table["key"])
            sources = table["source_id"].combine_chunks()
            before = np.vstack([now[:1] if last is None else last[1], now[:-1]])
            same = np.r_[last is not None and last[0] == sources[0].as_py(), pc.equal(sources[1:], sources[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            unequal = now != before
            at = np.where(same, unequal.argmax(axis=1), -1)
            pick = np.maximum(at, 0)
            rows = np.arange(len(now))
            unknown = np.zeros(len(now), bool)
            unknown[0] = last is None
            last = (sources[-1].as_py(), now[-1:])
            as_long = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(at.astype(np.int32), mask=unknown), as_long(before[rows, pick]), as_long(now[rows, pick])], ["source_id", "name", "key", "differs", "own", "other"])

    ship(keys.sparkSession)
    return ordered.mapInArrow(compare, "source_id string, name long, key binary, differs int, own long, other long")


def renamed(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks of the keys' names."""

    def place(key: tuple, table: pa.Table) -> pa.Table:
        places = [np.frombuffer(x, "<i4") for x in table["places"].to_pylist()]
        out = np.empty(sum(map(len, places)), "<u8")
        out[np.concatenate(places)] = np.repeat(table["name"].to_numpy().astype(np.uint64) + np.uint64(1), list(map(len, places)))
        return pa.table({"source_id": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "names": blobs([out])})

    found = keys.join(names.select("source_id", "key", "name"), ["source_id", "key"]).select("source_id", "block", "name", "places")
    return found.groupBy("source_id", "block").applyInArrow(place, "source_id string, block long, names binary")


def with_firsts(names: DataFrame) -> DataFrame:
    """names with what differs at the first row of each partition, by the last row of the one before. There is a row for each partition."""
    part = F.shiftright("name", INSIDE)
    ends = names.groupBy(part.alias("part")).agg(F.min_by(F.struct("source_id", "name", "key"), "name").alias("first"), F.max_by(F.struct("source_id", "key"), "name").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))

    def compare(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                at, own, other = -1, 0, 0
                if r["source_before"] == r["source_id"]:
                    a, b = (np.frombuffer(r[c], ">u8") for c in ("key_before", "key"))
                    at = int((a != b).argmax())
                    own, other = (int(x[at : at + 1].astype(np.uint64).view(np.int64)[0]) for x in (a, b))
                out.append((r["source_id"], r["name"], at, own, other))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["source_id", "name", "differs", "own", "other"])

    firsts = ends.select("first.source_id", "first.name", "first.key", F.col("before.source_id").alias("source_before"), F.col("before.key").alias("key_before"))
    schema = "source_id string, name long, differs int, own long, other long"
    return names.where("differs is not null").select("source_id", "name", "differs", "own", "other").unionByName(firsts.mapInArrow(compare, schema))


def common_prefixes(samples: DataFrame) -> DataFrame:
    """(p, source_id, lcp): suffixes in order, numbered from 0 over all sources, and what each shares with the one before; -1 for the first of a source.

    ``i`` numbers the samples of a source without gaps from 0; a symbol is a whole number. No samples give no rows.
    """
    return prefixes_of(cut(symbol_blocks(samples)))


def prefixes_of(blocks: DataFrame) -> DataFrame:
    """common_prefixes of symbol_blocks."""
    levels, h = [], 1
    total = blocks.agg(F.sum(F.length("names") / 8)).first()[0]
    while True:
        keys = cut(keys_of(blocks, h))
        names = cut(named(keys))
        levels.append((h, names))
        if not total or names.count() == total:
            break
        blocks = cut(renamed(keys, names))
        h *= FAN
    pairs = with_firsts(levels[-1][1]).select("source_id", "name", F.when(F.col("differs") < 0, -1).otherwise(F.col("differs") * levels[-1][0]).cast("long").alias("lcp"), "own", "other")
    for h, names in reversed(levels[:-1]):
        pairs = deeper(pairs, names, h)
    part = F.shiftright("name", INSIDE)
    sizes = pairs.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row for each partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    p = F.col("start") + F.col("name") - F.shiftleft(F.col("part"), INSIDE)
    return pairs.withColumn("part", part).join(F.broadcast(starts), "part").select(p.alias("p"), "source_id", "lcp")


def deeper(pairs: DataFrame, names: DataFrame, h: int) -> DataFrame:
    """pairs with what two different names share: up to h times the first place at which their keys differ, and the names there. An end shares nothing."""

    def compare(batches):
        for batch in batches:
            a, b = (lookup_keys(pa.chunked_array([batch.column(c)])) for c in ("own_key", "other_key"))
            open_ = a.any(axis=1) & b.any(axis=1)
            at = (a != b).argmax(axis=1)
            rows = np.arange(len(at))
            lcp = batch.column("lcp").to_numpy() + np.where(open_, at * h, 0)
            own, other = (np.where(open_, x[rows, at].astype(np.uint64).view(np.int64), 0) for x in (a, b))
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("name"), pa.array(lcp), pa.array(own), pa.array(other)], ["source_id", "name", "lcp", "own", "other"])

    key = lambda c: names.select((F.col("name") + 1).alias(c), F.col("key").alias(f"{c}_key"))
    # the first of a source has nothing to look up
    rows = pairs.withColumn("own", F.when(F.col("lcp") >= 0, F.col("own")))
    joined = rows.join(key("own"), "own", "left").join(key("other"), "other", "left")
    return cut(joined.select("source_id", "name", "lcp", "own_key", "other_key").mapInArrow(compare, "source_id string, name long, lcp long, own long, other long"))


def neighbours(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it that is not larger and the first one after it that is smaller; -1 and n where there is none."""
    n = len(lcp)
    left, right, stack = np.full(n, -1), np.full(n, n), []
    for k, v in enumerate(lcp.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = k
        if stack:
            left[k] = stack[-1][0]
        stack.append((k, v))
    return left, right


def repeats(prefixes: DataFrame) -> DataFrame:
    """(source_id, w, q, s) for each length w of which any tuple repeats: the highest count and the pairs of equal ones.

    A run of suffixes that share l symbols, within one that shares fewer, k, counts for the lengths from k + 1 to l. Blocks know
    the least value of every other one (a number for 2 ** LCP_BITS suffixes), so a run's end in another block is looked for there alone.
    """
    size = 1 << LCP_BITS
    spark = prefixes.sparkSession
    ship(spark)

    def glue(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        lcp = table["lcp"].to_numpy().astype("<i8")
        starts = np.r_[0, np.flatnonzero(lcp < 0)]
        starts = np.unique(starts).astype("<i8")
        sources = table["source_id"].take(pa.array(starts)).to_pylist()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "lcp": blobs([lcp]), "starts": blobs([starts]), "sources": pa.array([sources], pa.list_(pa.string())), "least": pa.array([int(lcp.min())])})

    blocks = cut(prefixes.groupBy(F.shiftright("p", LCP_BITS).alias("block")).applyInArrow(glue, "block long, lcp binary, starts binary, sources array<string>, least long"))
    known = blocks.select("block", "least", (F.length("lcp") / 8).cast("long").alias("n")).orderBy("block").collect()
    least, total = np.array([r.least for r in known]), sum(r.n for r in known)

    def ask(batches):
        """(block, target, left, places, values): whose ends lie in other blocks."""
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("lcp").to_pylist(), strict=True):
                lcp = np.frombuffer(data, "<i8")
                left, right = neighbours(lcp)
                out = []
                for is_left, lost in ((True, np.flatnonzero((left < 0) & (lcp > 0))), (False, np.flatnonzero((right == len(lcp)) & (lcp > 0)))):
                    v = lcp[lost]
                    if is_left:
                        so_far = np.minimum.accumulate(least[:b][::-1])
                        target = b - 1 - np.searchsorted(-so_far, -v, side="left")
                    else:
                        so_far = np.minimum.accumulate(least[b + 1 :])
                        target = b + 1 + np.searchsorted(-so_far, -v, side="right")
                    out += [(b, int(t), is_left, lost[target == t].astype("<i4").tobytes(), v[target == t].astype("<i8").tobytes()) for t in np.unique(target) if 0 <= t < len(least)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["block", "target", "left", "places", "values"])

    def answer(batches):
        """(block, left, places, found, values): where the ends are."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lcp, v = np.frombuffer(r["lcp"], "<i8"), np.frombuffer(r["values"], "<i8")
                if r["left"]:
                    k = len(lcp) - 1 - np.searchsorted(-np.minimum.accumulate(lcp[::-1]), -v, side="left")
                else:
                    k = np.searchsorted(-np.minimum.accumulate(lcp), -v, side="right")
                out.append((r["block"], r["left"], r["places"], (r["target"] * size + k).astype("<i8").tobytes(), lcp[k].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "left", "places", "found", "values"])

    asked = blocks.select("block", "lcp").mapInArrow(ask, "block long, target long, left boolean, places binary, values binary")
    there = blocks.select(F.col("block").alias("target"), "lcp")
    answers = asked.join(there, "target").mapInArrow(answer, "block long, left boolean, places binary, found binary, values binary")

    def runs(key: tuple, table: pa.Table) -> pa.Table:
        """Changes at lengths: (source_id, w, q, s)."""
        rows = table.to_pylist()
        own = next(r for r in rows if r["lcp"] is not None)
        lcp, base = np.frombuffer(own["lcp"], "<i8"), key[0].as_py() * size
        n = len(lcp)
        left, right = neighbours(lcp)
        # beyond the last suffix nothing is shared
        low, high = np.where(left < 0, -1, lcp[left]), np.where(right == n, -1, lcp[np.minimum(right, n - 1)])
        # what no other block ends goes on to the last suffix
        left, right = left + base, np.where(right == n, total, right + base)
        for r in rows:
            if r["lcp"] is None:
                at = np.frombuffer(r["places"], "<i4")
                where, values = np.frombuffer(r["found"], "<i8"), np.frombuffer(r["values"], "<i8")
                if r["left"]:
                    left[at], low[at] = where, values
                else:
                    right[at], high[at] = where, values
        kept = (lcp > 0) & (low < lcp)
        starts = np.frombuffer(own["starts"], "<i8")
        source = np.searchsorted(starts, np.flatnonzero(kept), side="right") - 1
        count, share, parent = (right - left)[kept], lcp[kept], np.maximum(np.maximum(low, high), 0)[kept]
        pairs = count * (count - 1) // 2
        src, w = np.r_[source, source], np.r_[share, parent]
        q, s = np.r_[count, np.zeros_like(count)], np.r_[pairs, -pairs]
        order = np.lexsort((w, src))
        src, w, q, s = src[order], w[order], q[order], s[order]
        first = np.flatnonzero(np.r_[True, (np.diff(src) != 0) | (np.diff(w) != 0)]) if len(w) else np.zeros(0, int)
        q, s = (np.maximum.reduceat(q, first), np.add.reduceat(s, first)) if len(w) else (q, s)
        names = pa.array(own["sources"], pa.string()).take(pa.array(src[first]))
        return pa.table({"source_id": names, "w": pa.array(w[first].astype(np.int64)), "q": pa.array(q.astype(np.int64)), "s": pa.array(s.astype(np.int64))})

    wide = blocks.select("block", "lcp", "starts", "sources").unionByName(answers, allowMissingColumns=True)
    changes = wide.groupBy("block").applyInArrow(runs, "source_id string, w long, q long, s long")
    changes = cut(changes.groupBy("source_id", "w").agg(F.max("q").alias("q"), F.sum("s").alias("s")).where("w > 0").withColumn("band", F.shiftright("w", LENGTHS_BITS)))
    bands = changes.groupBy("source_id", "band").agg(F.max("q").alias("band_q"), F.sum("s").alias("band_s"), F.max("w").alias("band_w"))
    after = Window.partitionBy("source_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("source_id", "band", F.max("band_q").over(after).alias("band_q"), F.sum("band_s").over(after).alias("band_s"), F.lead("band_w").over(Window.partitionBy("source_id").orderBy(F.desc("band"))).alias("band_w"))
    inside = Window.partitionBy("source_id", "band").orderBy(F.desc("w"))
    rows = changes.join(bands, ["source_id", "band"])
    q = F.greatest(F.max("q").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("band_q", F.lit(0)))
    s = F.sum("s").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("band_s", F.lit(0))
    before = F.coalesce(F.lead("w").over(inside), "band_w", F.lit(0))
    rows = rows.select("source_id", q.alias("q"), s.alias("s"), before.alias("before"), F.col("w").alias("last")).where("s > 0")
    return rows.select("source_id", F.explode(F.sequence(F.col("before") + 1, F.col("last"))).alias("w"), "q", "s")
