"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

Files are read in blocks of a fixed size, by byte range. Each block is searched at once (a vectorised comparison); what a block needs
to know about those before it (tokens and separators so far, where the last separator stood) comes from a prefix scan over one small
row for each block, in two levels: over spans of SPAN blocks, then inside each. So documents that cross blocks are counted right,
no task reads more than a block at a time, and a file of any size is scanned in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskframe.llm.common import Work, bounded, in_batches, sliced
from riskframe.llm.tokens import encoder, vocabulary
from riskframe.shipping import ship

#: Tokens of a block; blocks of a span.
BLOCK, SPAN = 65_536, 1024


def read_token_files(spark: SparkSession, path: str, *, width: int = 2, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """(shard, block, tokens): the blocks of flat little-endian token files of any size; width: bytes of an id.

    Spark lists the files; tasks read their blocks by byte range through Arrow's file systems (local, HDFS, S3, GCS).
    Empty files have no block. A file whose size is no multiple of width raises an error.
    """
    size = block * width
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    blocks = files.select("path", "length", at.alias("block")).repartition(partitions or spark.sparkContext.defaultParallelism * 4, "path", F.floor(F.col("block") / 16))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: tuple[str, object] = ("", None)
        for batch in batches:
            for name, length, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes are no multiple of {width}")
                if opened[0] != name:
                    system, place = fs.FileSystem.from_uri(name.replace("file:///", "/").replace("file:/", "/"))
                    opened = (name, system.open_input_file(place))
                data = opened[1].read_at(min(size, length - number * size), number * size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["shard", "block", "tokens"])

    ship(spark)
    return blocks.sortWithinPartitions("path", "block").mapInArrow(read, "shard string, block long, tokens binary")


def token_stream(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end: int = 50256, block: int = BLOCK, width: int = 2, path: str | None = None) -> DataFrame:
    """(shard, block, tokens, ids): texts as flat token streams in blocks, a shard for each partition; width: bytes of an id.

    Each text's ids are followed by ``end``; blocks are cut without regard to documents. ids lists the documents that end in
    a block, which the scan doesn't read. A null text is empty: its separator alone. An id that ``width`` bytes can't hold, or a text
    with the id ``end``, raises an error.
    """
    path = path or vocabulary()

    def write(batches):
        from pyspark import TaskContext

        shard = str(TaskContext.get().partitionId())
        tail = np.array([end], "<u4")
        size = block * width
        held, number, ends, done = b"", 0, [], 0

        def row(data: bytes, ids: list[int | None]):
            arrays = [pa.array([shard]), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "block", "tokens", "ids"])

        for batch in (part for whole in batches for part in sliced(whole)):
            for doc, data in zip(batch.column(0).to_pylist(), encoder(path).batch(batch.column(1)), strict=True):
                ids = np.frombuffer(data, "<u4")
                if (ids == end).any() or (width < 4 and max(int(ids.max(initial=0)), end) >= 1 << 8 * width):
                    raise ValueError(f"an id is the separator or does not fit {width} bytes")
                held += np.concatenate((ids, tail)).astype(f"<u{width}").tobytes()
                ends.append((done + len(held), doc))
                while len(held) >= size:
                    done += size
                    yield row(held[:size], [d for e, d in ends if e <= done])
                    ends = [(e, d) for e, d in ends if e > done]
                    held, number = held[size:], number + 1
        if held:
            yield row(held, [d for _, d in ends])

    ship(docs.sparkSession)
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(write, "shard string, block long, tokens binary, ids array<long>")


def count_tokens(blocks: DataFrame, *, end: int = 50256, width: int = 2) -> DataFrame:
    """(shard, ordinal, start, n_tokens, ended): the documents of blocks(shard, block, tokens).

    n_tokens counts a document's ids without its separator; start is its first id's place in the shard. Ids after the last
    separator are a document that has not ended; a shard that ends with a separator has none. Two separators in a row
    enclose an empty document. Blocks of a shard must be numbered in order; null or empty blocks hold no ids. Other columns are ignored.
    """

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, places = [], []
        for data in batch.column(2):
            ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", f"<u{width}")
            sizes.append(len(ids))
            places.append(np.flatnonzero(ids == end))
        offsets = np.cumsum([0, *map(len, places)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places), pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], ["shard", "block", "size", "places"])

    found = in_batches(blocks.select("shard", "block", "tokens"), search, "shard string, block long, size long, places array<long>")
    work = Work(blocks.sparkSession, "token-scan")
    found = work.save(found.withColumn("span", F.floor(F.col("block") / SPAN)), "places")
    # the prefix scan: tokens and separators before each block, and the place behind the last separator before it
    upto = lambda *by: Window.partitionBy(*by).orderBy("block" if "span" in by else "span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = upto("shard", "span")
    # within its span first
    found = found.withColumn("base", F.coalesce(F.sum("size").over(inner), zero)).withColumn("ordinal", F.coalesce(F.sum(F.size("places")).over(inner), zero))
    behind = F.when(F.size("places") > 0, F.col("base") + F.element_at("places", -1) + 1)
    found = work.save(found.withColumn("behind", behind).withColumn("open", F.max("behind").over(inner)), "inner")
    spans = found.groupBy("shard", "span").agg(F.sum("size").alias("span_size"), F.sum(F.size("places")).cast("long").alias("span_ends"), F.max("behind").alias("span_behind"))
    outer = upto("shard")
    spans = spans.withColumn("span_base", F.coalesce(F.sum("span_size").over(outer), zero)).withColumn("span_ordinal", F.coalesce(F.sum("span_ends").over(outer), zero))
    spans = spans.withColumn("far", F.col("span_base") + F.col("span_behind")).withColumn("span_open", F.coalesce(F.max("far").over(outer), zero))
    spans = work.save(spans.select("shard", "span", "span_base", "span_ordinal", "span_open", "span_size", "span_ends", "far"), "spans")
    found = found.join(spans.select("shard", "span", "span_base", "span_ordinal", "span_open"), ["shard", "span"])
    found = found.withColumn("open", F.coalesce(F.col("open") + F.col("span_base"), "span_open")).withColumn("base", F.col("base") + F.col("span_base")).withColumn("ordinal", F.col("ordinal") + F.col("span_ordinal"))
    each = found.select("shard", "base", "open", "ordinal", "places", F.posexplode("places").alias("k", "place"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.get("places", F.col("k") - 1) + 1)
    ended = each.select("shard", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("place") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    total = spans.groupBy("shard").agg(F.sum("span_size").alias("size"), F.sum("span_ends").alias("ordinal"), F.coalesce(F.max("far"), zero).alias("start"))
    rest = total.where("size > start").select("shard", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def document_token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, width: int = 2) -> DataFrame:
    """(id_col, shard, ordinal, start, n_tokens, ended): the counts of a written token stream, by document.

    Every row of docs is a document, also if its id repeats or is null. An empty table gives no rows. shard, ordinal and start
    say where a document stands in the stream, which depends on how the rows of docs are dealt out; n_tokens does not.
    """
    work = Work(docs.sparkSession, "token-stream")
    stream = work.save(token_stream(docs, id_col=id_col, text_col=text_col, block=block, width=width), "blocks")
    counts = count_tokens(stream.select("shard", "block", "tokens"), width=width)
    before = Window.partitionBy("shard", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = stream.select("shard", "block", F.floor(F.col("block") / SPAN).alias("span"), "ids")
    spans = named.groupBy("shard", "span").agg(F.sum(F.size("ids")).alias("n"))
    spans = spans.select("shard", "span", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    named = named.withColumn("base", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0))).join(spans, ["shard", "span"])
    names = named.select("shard", F.posexplode("ids").alias("k", id_col), (F.col("base") + F.col("first")).alias("base")).select("shard", (F.col("base") + F.col("k")).alias("ordinal"), id_col)
    return counts.join(names, ["shard", "ordinal"], "left").select(id_col, "shard", "ordinal", "start", "n_tokens", "ended")
