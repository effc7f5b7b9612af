"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds its distinct five-word shingles (ASCII letters lower-cased). Its signature is
64 MinHash values of b = 16 bits, cut into 16 chunks of 4 values. If two signatures differ in at most
``MAX_DISTANCE`` = 31 values, then by the pigeonhole principle some chunk differs in at most one value.
The allowed chunk errors are enumerated by leaving out each value of each chunk in turn: 64 keys a
document, each the other three values, and every pair within the distance shares a key. At a similarity
of 0.75 a signature differs in 16 values on average; more than 31 differ in about one pair of 50,000,
and far fewer above it. Candidates are confirmed on the full sets, in integers.

Hot groups: documents with the same set are one class, represented by its smallest id. In each key's
group the members are first linked to one pivot (as many rows as members, not pairs); only pairs
that are then still in different components are compared, in blocks of at most ``BLOCK`` rows, so the
size of a group bounds no list, and what a block emits are candidates that passed the signature test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import MapType, VariantType

from riskframe.llm.common import Work, fixed_binary, in_batches, in_groups, keep_ids, mix64, to_binary
from riskframe.llm.graph import connected_components

CHUNKS, WIDTH = 16, 4
LANES = CHUNKS * WIDTH
#: CHUNKS chunks of which each has two errors or more need 2 * CHUNKS errors.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Rows of one block of a key's group.
BLOCK = 2048
#: Sets of more shingles have no sketch: their pairs all go to the confirmation.
SKETCHED = 256
MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = max(1, n - size + 1)
    x = np.full(m, min(n, size), np.uint64)
    for j in range(min(n, size)):
        x *= STEP
        x += hashes[j : j + m]
    return np.unique(mix64(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    """LANES MinHash values of 16 bits."""
    least = np.full(LANES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * MULTIPLIERS).min(axis=0), out=least)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """1024 parity bits. Two sketches differ in at most as many bits as the sets in members. Of large sets they are not made."""
    if len(shingles) > SKETCHED:
        return np.zeros(128, np.uint8)
    x = shingles * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount(((x >> np.uint64(20)) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8))


SIGNED = "id long, n_shingles long, h1 long, h2 long, signature binary, sketch binary"


def signed(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    n, h1, h2, signatures, sketches = [], [], [], [], []
    for text in batch.column(1).to_pylist():
        s = shingle_set(text, size)
        n.append(len(s))
        digest = xxhash.xxh3_128_digest(s.tobytes())
        h1.append(int.from_bytes(digest[:8], "little", signed=True))
        h2.append(int.from_bytes(digest[8:], "little", signed=True))
        signatures.append(signature(s))
        sketches.append(odd_sketch(s))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), to_binary(np.stack(signatures)), to_binary(np.stack(sketches))],
        ["id", "n_shingles", "h1", "h2", "signature", "sketch"],
    )


def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The keys of each signature: a chunk's values without one, below the number of chunk and value."""
    lanes = fixed_binary(batch.column(1), 2 * LANES, np.uint16).astype(np.int64).reshape(-1, CHUNKS, WIDTH)
    keys = np.empty((len(lanes), CHUNKS, WIDTH), np.int64)
    for out in range(WIDTH):
        a, b, c = (lanes[:, :, i] for i in range(WIDTH) if i != out)
        keys[:, :, out] = (a << 32 | b << 16 | c) | ((np.arange(CHUNKS) * WIDTH + out) << 48)
    ids = np.repeat(batch.column(0).to_numpy(), LANES)
    return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])


class Rows:
    """Signatures, sketches and set sizes, to test pairs of rows by number."""

    def __init__(self, n, signatures, sketches, percent: int):
        self.n, self.percent = n, percent
        self.lanes = fixed_binary(signatures, 2 * LANES, np.uint16)
        self.sketch = fixed_binary(sketches, 128, np.uint64)

    def near(self, i: np.ndarray, j: np.ndarray, other: Rows | None = None):
        """Which pairs can be similar enough; the number of the first key they share; their distance."""
        o = other or self
        a, b = self.n[i], o.n[j]
        ok = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        equal = (self.lanes[i] == o.lanes[j]).reshape(-1, CHUNKS, WIDTH)
        errors = WIDTH - equal.sum(axis=2)
        distance = errors.sum(axis=1)
        ok &= distance <= MAX_DISTANCE
        chunk = (errors <= 1).argmax(axis=1)
        first = chunk * WIDTH + np.take_along_axis(equal, chunk[:, None, None], 1)[:, 0].argmin(axis=1)
        # |A xor B| <= (|A| + |B|) (1 - s) / (1 + s) at a similarity of s
        most = (a + b) * (100 - self.percent) / (100 + self.percent)
        differ = np.bitwise_count(self.sketch[i] ^ o.sketch[j]).sum(axis=1)
        ok &= (np.maximum(a, b) > SKETCHED) | (differ <= most)
        return ok, first, distance


def cross_pairs(rows: pa.Table, percent: int):
    """Candidates between the components in each (key, low, high) group; each pair at its first key only."""
    key, low, high, comp, blk, ids = (rows[c].to_numpy() for c in ("key", "low", "high", "component", "blk", "id"))
    test = Rows(rows["n_shingles"].to_numpy(), rows["signature"], rows["sketch"], percent)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    size = np.diff(np.r_[start, len(key)])
    left = np.repeat(start + size, size) - np.arange(len(key)) - 1  # rows of the group after this one
    slot = key >> 48
    for d in range(1, int(size.max())):
        for at in range(0, len(rest := np.flatnonzero(left >= d)), 50_000):
            i = rest[at : at + 50_000]
            j = i + d
            wanted = (comp[i] != comp[j]) & ((low[i] == high[i]) | (blk[i] != blk[j]))
            i, j = i[wanted], j[wanted]
            if not len(i):
                continue
            ok, first, _ = test.near(i, j)
            ok &= first == slot[i]
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[ok]]), pa.array(ids[j[ok]])], ["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, work: Work) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. docs: id, text."""
    pairs = work.save(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x, size).tobytes() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "members"])

    members = work.save(in_batches(keep_ids(docs.select("id", "text"), ids, "id"), sets, "id long, members binary"), "sets")

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(len(batch), bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((a, b)))
            common = int((both[1:] == both[:-1]).sum())
            keep[k] = len(both) > 0 and 100 * common >= percent * (len(both) - common)
        return batch.select([0, 1]).filter(pa.array(keep))

    both = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    links = work.save(in_batches(both.select("a", "b", "x", "y"), similar, "a long, b long").distinct(), "links")
    work.drop(members)
    work.drop(pairs)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id that is reachable and kept marks its document. A text that is null or has no word has an empty set,
    is linked with nothing and kept. A text shorter than a shingle is one shingle as a whole. Rows that repeat an id are one
    document: a link of any of them counts, and each gets its row. A null id takes no part: its component is null, kept is true.
    Empty tables give empty results. Other columns are ignored.
    """
    work = Work(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = work.save(in_batches(docs, lambda b: signed(b, size), SIGNED), "signatures")
    full = rows.where("n_shingles > 0 and id is not null")
    classes = work.save(full.groupBy("h1", "h2").agg(F.min("id").alias("head")), "classes")
    # one row for each class; a repeated id may have several
    heads = full.join(classes.select(F.col("head").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    heads = work.save(heads.select("id", "n_shingles", "signature", "sketch"), "heads")
    # classes are linked through ids that repeat, too
    twins = full.select("id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))

    keys = in_batches(heads.select("id", "signature"), keyed, "key long, id long")
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top")
    shared = work.save(keys.join(pivots.select("key", "pivot"), "key"), "shared")
    test = heads.select("id", "n_shingles", "signature", "sketch")

    def distances(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (Rows(batch.column(k).to_numpy(), batch.column(k + 1), batch.column(k + 2), percent) for k in (2, 5))
        at = np.arange(len(batch))
        ok, _, distance = x.near(at, at, y)
        return pa.RecordBatch.from_arrays([pc.filter(batch.column(0), pa.array(ok)), pc.filter(batch.column(1), pa.array(ok)), pa.array(distance[ok].astype(np.int64))], ["a", "b", "distance"])

    # first each member against pivots: its three nearest are enough here, what they miss is compared below
    spokes = shared.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    spokes = spokes.join(test.toDF("a", "n1", "s1", "o1"), "a").join(test.toDF("b", "n2", "s2", "o2"), "b")
    spokes = in_batches(spokes.select("a", "b", "n1", "s1", "o1", "n2", "s2", "o2"), distances, "a long, b long, distance long")
    spokes = spokes.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where("k <= 3")
    reps = docs
    links = confirmed(spokes, reps, size, percent, work)
    found = connected_components(links, work)

    # then every pair that shares a key and is not connected yet
    placed = shared.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = work.save(placed, "placed")
    work.drop(shared)
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y")
    open_keys = open_keys.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    rest = placed.join(open_keys, "key").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rest = rest.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = rest.join(test, "id").select("key", F.least("blk", "j").alias("low"), F.greatest("blk", "j").alias("high"), "blk", "component", "id", "n_shingles", "signature", "sketch")
    pairs = in_groups(rest, ["key", "low", "high"], ["component", "id"], lambda t: cross_pairs(t, percent), "a long, b long")
    links = links.unionByName(confirmed(pairs, reps, size, percent, work)).unionByName(twins)
    work.drop(placed)
    found = connected_components(links, work)
    work.drop(heads)

    out = rows.select("id", "n_shingles").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that are not the kept one of their group; the columns stay as they are.

    Rows that repeat an id are one document, of which one row stays: that whose text has the smallest hash. Null ids stay.
    """
    work = Work(docs.sparkSession, "near-gone")
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.col(id_col))
    out = keep_ids(docs, work.save(gone, "gone"), id_col, "left_anti").select(*docs.columns)
    again = work.save(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "again")
    if again.isEmpty():
        return out
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), *(c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))))
    several = keep_ids(out, again, id_col).withColumn("__k", F.row_number().over(first)).where("__k = 1").select(*docs.columns)
    return keep_ids(out, again, id_col, "left_anti").select(*docs.columns).unionByName(several)
