"""Helpers shared by the corpus operators: tables, intermediate results, words, packed arrays."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.shipping import ship

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids up to this many (8 bytes each) may be broadcast; larger sets are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, in the JVM and in Python: what a task holds does not depend on how long texts are.
BATCH_BYTES = 4 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Work:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table cuts the lineage, so that a lost executor costs the tasks of one step and no more.
    A result reads its operator's tables until it is written itself; then ``clear`` may delete them.
    """

    opened: list[Work] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        Work.opened.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._riskframe_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that no later step reads."""
        self.delete(df._riskframe_path)

    def delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def clear(cls, since: int) -> None:
        """Deletes the tables of all runs but the first ``since`` that were opened."""
        for work in cls.opened[since:]:
            work.delete(work.base)
        del cls.opened[since:]


def few(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """rows, to be broadcast if they are counted and at most so many."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on an id column; ids are broadcast only if they are counted and few."""
    return df.join(few(ids.select(column).distinct()), column, how)


def sliced(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half), most)
        yield from sliced(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def bounded(spark: SparkSession) -> None:
    """Batches that go to Python are cut by bytes, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def in_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with an output batch for each input batch of at most BATCH_BYTES (or one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """A model in this Python worker: made when it is first asked for, and let go when another one is.

    Workers are used again by later stages, so they would else keep the models of all stages.
    """
    if key not in HELD:
        HELD.clear()
        gc.collect()
        HELD[key] = make()
    return HELD[key]


def in_groups(df: DataFrame, by: list[str], order: list[str], f, schema: str, partitions: int | None = None) -> DataFrame:
    """f gets pa.Table rows holding whole groups (columns ``by`` equal), sorted by ``by + order``; f yields batches.

    Rows are dealt by the group's columns. A group must have a bounded size.
    """
    dealt = df.repartition(partitions, *by) if partitions else df.repartition(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = len(batch) - 1
            same = np.ones(len(batch), bool)
            for c in by:
                column = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                same &= column == column[last]
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            first = True
            for c in by:
                if held:
                    i = batch.schema.get_field_index(c)
                    first &= held[-1].column(i)[-1].as_py() == batch.column(i)[last].as_py()
            if at == 0 and held and not first:
                yield from f(pa.Table.from_batches(held))
                held = [batch]
            elif at == 0:
                held.append(batch)
            else:
                yield from f(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = [batch.slice(at)]
        if held:
            yield from f(pa.Table.from_batches(held))

    ship(df.sparkSession)
    bounded(df.sparkSession)
    return dealt.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def fixed_binary(column, width: int, dtype=np.uint8) -> np.ndarray:
    """A binary column of equally long, non-null values as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, width // np.dtype(dtype).itemsize), dtype)
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], size, n + 1, column.offset * np.dtype(size).itemsize)
    data = np.frombuffer(column.buffers()[2], np.uint8, n * width, int(offsets[0]))
    return data.view(dtype).reshape(n, -1)


def to_binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.dtype.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
