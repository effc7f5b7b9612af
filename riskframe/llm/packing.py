"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

Only the histogram (at most ``length`` counts) goes to the driver. It places lengths longest first and
updates the counts of packing patterns; the patterns then say where the r-th piece of each length goes,
and pieces learn their place by a join on length and rank. Ranks come from counts over (length, bucket),
so that no length, however common, is ranked in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import Work, in_batches
from riskframe.llm.tokens import encoder, vocabulary

#: Pieces of one length are ranked in so many parts.
BUCKETS = 1024


def patterns(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of a sequence, longest first) and their counts.

    Lengths are placed longest first, each into the shortest pack: the open pattern with the most room, if that holds it, or
    else a new one. A step moves as many packs of a pattern as there are pieces for, one piece each, so that the work
    depends on the number of different lengths, not of pieces.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        most = max((room for room, packs in open_by_room.items() if packs), default=0)
        while left and most >= n:
            packs = open_by_room[most]
            if not packs:
                most -= 1
                continue
            packed, count = packs.pop()
            used = min(left, count)
            if count > used:
                packs.append((packed, count - used))
            open_by_room[most - n].append(((*packed, n), used))
            left -= used
        if left:
            # each new pack is the emptiest until it is full
            per = length // n
            if whole := left // per:
                open_by_room[length - per * n].append(((n,) * per, whole))
            if rest := left % per:
                open_by_room[length - rest * n].append(((n,) * rest, 1))
    return [x for room in sorted(open_by_room) for x in open_by_room[room]]


def places(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, step, offset): where the ranks of a length go.

    Rank r of the run goes to sequence ``first + (r - first rank)``; each slot of a pattern is one run.
    """
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, count in packed:
        offset = 0
        for n in lengths:
            out.append((n, taken[n], taken[n] + count - 1, sequence, 1, offset))
            taken[n] += count
            offset += n
        sequence += count
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end: int = 0, path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its text's ids and then ``end``; a null text is empty, so it is that id alone. It is cut into pieces of
    ``length`` ids and a shorter last one. Whole sequences have no padding; the others are filled by ``patterns``.
    Every row is a document of its own, also if its id repeats or is null. An empty table gives no pieces.
    Other columns are ignored.
    """
    work = Work(docs.sparkSession, "packing")
    path = path or vocabulary()
    tail = np.array([end], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), encoder(path).batch(batch.column(1)), strict=True):
            ids += tail
            n = len(ids) // 4
            rows += [(doc, at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = work.save(in_batches(source, cut, "id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")

    bucket = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(BUCKETS))
    pieces = pieces.withColumn("bucket", bucket)
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = work.save(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    runs = places(patterns(histogram, length))
    where = docs.sparkSession.createDataFrame(runs, "length long, low long, high long, sequence long, step long, offset long")
    inside = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("k", F.row_number().over(inside)).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k") - 1)
    # a run is a slot of a pattern: there are at most length * length of them, whatever the input
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & F.col("rank").between(F.col("low"), F.col("high")))
    sequence = F.col("sequence") + (F.col("rank") - F.col("low")) * F.col("step")
    return placed.select(F.col("id").alias(id_col), "start", ranked["length"], "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")
