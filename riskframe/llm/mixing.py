"""Mixing sources to target weights by Pareto order sampling.

A source of size S and target T takes T / S copies of its words on average. The whole part are certain
copies of every document. The rest is a sample without replacement whose size is fixed in words: a document is in it with a
probability p in proportion to its own size, such that the expected words are the rest; where that is 1 or more, the document is
certain, too. A document with a random u gets the order (u / (1 - u)) / (p / (1 - p)), and in that order each document is
taken whose words still fit what is left of the rest. The random numbers are digests of seed and id.
A pass takes all documents before the first that does not fit, which is found by sums over buckets of orders and ordering
inside a bucket. The next pass is over those later documents that are not larger than what is then left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import WORD, Work, few

#: Buckets of a source's orders for each unit of their logarithm, and rows that such a bucket holds at most, about.
BUCKETS, ROWS = 256, 100_000
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """sizes(source, source_size) with target: shares of the total by weight, none above limit times its source.

    A share that is above is set to that, and the excess is dealt to the others by weight until none is above.
    Sources are capped in the order of limit * size / weight, so one pass over prefix sums finds the last capped one.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    sizes = sizes.withColumn("weight", turn.cast("long"))
    caps = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = caps.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every)
    sizes = sizes.withColumn("given", F.coalesce(limit * F.sum("source_size").over(before), F.lit(0)))
    sizes = sizes.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # a source is capped if its share of what the earlier ones leave is above its limit
    sizes = sizes.withColumn("total", total).withColumn("over", (F.col("total") - F.col("given")) * F.col("weight") > limit * F.col("source_size") * F.col("open"))
    first = F.struct("given", "open")
    place = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    level = F.min_by(first, F.when(~F.col("over"), place)).over(every)
    sizes = sizes.withColumn("level", level)
    share = (F.col("total") - F.col("level.given")) * F.col("weight") / F.col("level.open")
    target = F.when(F.col("over"), (limit * F.col("source_size")).cast("double")).otherwise(share.cast("double"))
    return sizes.select("source", "source_size", *(c for c in ("n_docs",) if c in sizes.columns), target.alias("target"))


def chances(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with ``least``, ``words`` and ``rate``: documents of more than ``least`` words are certain and hold ``words`` words; others
    are in the sample with probability ``rate`` times their size.

    sizes(source, size): documents. Probabilities in proportion to size that are 1 or more are made certain, largest first, and
    the others scaled up to the rest, until all are below 1.
    """
    n = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("n").cast("decimal(38,0)") * (F.col("size") * F.col("size")).cast("decimal(18,0)")
    n = n.withColumn("words", F.coalesce(F.sum(F.col("n") * F.col("size")).over(down), F.lit(0))).withColumn("squares", F.sum(square.cast("decimal(38,0)")).over(up).cast("double"))
    n = n.withColumnRenamed("source", "s").join(targets.select("source", "rest"), F.col("s").eqNullSafe(F.col("source")))
    n = n.withColumn("left", F.col("rest") - F.col("words")).where(F.col("left") * F.col("size") < F.col("squares"))
    first = n.groupBy("source").agg(F.max_by(F.struct(F.col("size").alias("least"), "words", (F.col("left") / F.col("squares")).alias("rate")), "size").alias("c"))
    out = targets.join(first.select(F.col("source").alias("s"), "c.*"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return out.withColumns({"words": F.coalesce("words", F.lit(0)), "rate": F.coalesce("rate", F.lit(0.0)), "room": F.floor(F.col("rest") - F.coalesce("words", F.lit(0)))})


def along(rows: DataFrame, limit: str, *order: str) -> DataFrame:
    """rows(source, bucket, size, ...) with more: the words of its source up to this row are at most ``limit``.

    Buckets follow each other, and ``order`` holds inside one.
    """
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["bucket"] == sums["b"])).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("earlier") + F.coalesce(F.sum("size").over(before), F.lit(0))
    return rows.withColumn("more", reached + F.col("size") <= F.col(limit))


def fitting(rows: DataFrame, rooms: DataFrame, work: Work) -> DataFrame:
    """rows(source, bucket, k, size) with the room of their source from rooms(source, room), those that are not larger than it."""
    rows = rows.join(rooms.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") <= F.col("room")))
    return work.save(rows.drop("s"), "fitting")


def at_place(rows: DataFrame):
    """Where rows(source, bucket, k) meet a table (s, b, j) of places."""
    return rows["source"].eqNullSafe(F.col("s")) & (rows["bucket"] == F.col("b")) & (rows["k"] == F.col("j"))


#: Documents that are not as their source's rule says are broadcast up to this many (some 50 bytes each), and else joined by a shuffle.
EXCEPTIONS = 500_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the mix knows of a row: id, source, key (a hash of the text) and size (its words)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("key"), size.alias("size")]


def ordered(rows: DataFrame, seed: str) -> DataFrame:
    """rows(id, source, size, least, rate) with ``certain`` and ``order``: the Pareto order of those that are drawn, null for others."""
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**13)
    p = F.col("rate") * F.col("size")
    certain = F.coalesce(F.col("size") > F.col("least"), F.lit(False)) & (F.col("size") > 0)
    rows = rows.withColumn("u", u).withColumn("certain", certain)
    return rows.withColumn("order", F.when((p > 0) & (p < 1) & ~F.col("certain"), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))).drop("u")


PLACE = ("order", "id", "size", "key")


def taken_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], limit: int, seed: str, work: Work) -> tuple[DataFrame, DataFrame]:
    """(id, source, key, size, source_size, target, copies, ...) for every row of docs, and the rule of each source.

    A rule (source, whole, least, rate, cut, ...) gives the copies of nearly all documents from their own columns: those that stand in
    the order up to ``cut`` are drawn. ``ruled`` says how many copies that are; drawn documents behind it differ.
    """
    rows = work.save(docs.select(*sized(docs, id_col, text_col, source_col)), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, limit)
    whole = F.floor(F.col("target") / F.col("source_size"))
    targets = targets.withColumn("whole", F.coalesce(F.when(F.col("source_size") > 0, whole), F.lit(0)))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = work.save(chances(rows, targets), "targets")
    # one row for each source
    rows = ordered(rows.join(targets.drop("room").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), seed)
    # orders spread over some units of their logarithm; a large source is cut finer
    fine = F.greatest(F.lit(BUCKETS), F.floor(F.col("n_docs") / ROWS))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.log("order") * fine), F.pmod(F.xxhash64("id"), F.lit(BUCKETS))))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*PLACE)))
    rows = work.save(rows.select("id", "source", "key", "size", "source_size", "target", "whole", "certain", "order", "bucket", "k"), "ordered")
    # past a document that does not fit the order goes on: what is left is filled by those that do, until none does
    rooms = targets.select("source", "room")
    left, filled, cuts = fitting(rows.where("order is not null").select("source", "bucket", "k", "size", "order", "id", "key"), rooms, work), None, None
    while not left.isEmpty():
        passed = work.save(along(left, "room", "k").select(*(c for c in left.columns if c != "room"), "more"), "passed")
        work.drop(left)
        found = passed.where("more")
        if cuts is None:
            # what is drawn before the first document that does not fit; larger ones than the whole room never do
            cuts = work.save(found.groupBy(F.col("source").alias("s")).agg(F.max(F.struct(*PLACE)).alias("cut")), "cuts")
        used = found.groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "s")
        rooms = rooms.join(used, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        rooms = work.save(rooms, "rooms")
        found = found.select("source", "bucket", "k")
        filled = found if filled is None else filled.unionByName(found)
        left = fitting(passed.where("not more").drop("more"), rooms, work)
    if filled is not None:
        filled = work.save(filled.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("k").alias("j"), F.lit(True).alias("fills")), "filled")
        rows = rows.join(filled, at_place(rows), "left").withColumn("more", F.coalesce("fills", F.lit(False))).drop("s", "b", "j", "fills")
        rules = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        rows = rows.withColumn("more", F.lit(False))
        kinds = dict(rows.dtypes)
        rules = targets.withColumn("cut", F.lit(None).cast("struct<" + ",".join(f"{c}:{kinds[c]}" for c in PLACE) + ">"))
    rules = work.save(rules.select("source", "whole", "least", "rate", F.col("room").alias("all_room"), "cut"), "rules")
    # one more document for each source: the one whose size is nearest to the words that are left
    ends = rooms.toDF("s", "room").join(targets.select("source", "rest", "words", F.col("room").alias("all")), F.col("s").eqNullSafe(F.col("source")))
    ends = ends.select("s", (F.col("rest") - (F.col("words") + F.col("all") - F.col("room"))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    others = rows.where("order is not null and not more").join(ends, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("gap"))
    last = others.groupBy("source").agg(F.min(F.struct(off.alias("off"), *PLACE, "bucket", "k")).alias("last"))
    last = last.select(F.col("source").alias("s"), F.col("last.bucket").alias("b"), F.col("last.k").alias("j"), F.lit(True).alias("is_last"))
    rows = rows.join(last, at_place(rows), "left").drop("s", "b", "j")
    extra = F.col("certain").cast("long") + (F.col("more") | F.coalesce("is_last", F.lit(False))).cast("long")
    return rows.withColumn("copies", F.col("whole") + extra), rules


def drawn_by_rule() -> Column:
    """Copies of a document by its source's rule: a row with its size, order, certain, whole, all_room and cut."""
    before = F.col("order").isNotNull() & (F.col("size") <= F.col("all_room")) & (F.struct(*PLACE) <= F.col("cut"))
    return F.col("whole") + F.col("certain").cast("long") + F.coalesce(before, F.lit(False)).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: str = "mix") -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row of docs; taken is a multiple of size.

    size: words of the text (null: 0). Sources stand in code-point order, null last, and weigh ``weights``, repeating.
    The number of copies is taken / size; no document has more than ``limit``. An empty document is taken with 0 words.
    A document that does not fit is passed over, and the order goes on until none fits. Then one more document is taken,
    that whose size is nearest to the words that are left, if it brings the source nearer to its target.
    Rows that repeat an id are ordered by it, their size and text: each is a document. An empty table gives no rows.
    """
    rows, _ = taken_rows(docs, id_col, text_col, source_col, weights, limit, seed, Work(docs.sparkSession, "mixing"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay as they are. Documents without words are not in it.

    Rows that repeat id, source and text stand as often as all of them are taken together. Texts are not shuffled: each row's copies
    follow from its source's rule, and only the few that differ from it (draws past a document that did not fit, repeated rows) are joined.
    """
    work = Work(docs.sparkSession, "mixed")
    rows, rules = taken_rows(docs, id_col, text_col, source_col, weights, limit, seed, work)
    rows = rows.where("size > 0").drop("whole").join(rules.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = rows.select("id", "source", "key", "copies", drawn_by_rule().alias("ruled")).groupBy("id", "source", "key")
    each = each.agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__n"), F.min("ruled").alias("ruled"))
    odd = work.save(each.where("__n > 1 or __copies <> ruled").drop("ruled").toDF("__id", "__source", "__key", "__copies", "__n"), "odd")
    names = ["id", "source", "key", "size"]
    marked = docs.select("*", *(c.alias(f"__r_{n}") for c, n in zip(sized(docs, id_col, text_col, source_col), names, strict=True))).where("__r_size > 0")
    row = F.struct(*(F.col(f"__r_{n}").alias(n) for n in names)).alias("__row")
    marked = marked.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), row).select("__doc", "__row.*")
    marked = marked.join(few(rules.withColumnRenamed("source", "s"), EXCEPTIONS), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    marked = ordered(marked, seed).withColumn("__rule", drawn_by_rule()).select("__doc", "id", "source", "key", "__rule")
    same = F.col("__id").eqNullSafe(F.col("id")) & F.col("__source").eqNullSafe(F.col("source")) & (F.col("__key") == F.col("key"))
    marked = marked.join(few(odd, EXCEPTIONS), same, "left")
    several = marked.where("__n > 1")
    out = marked.where("coalesce(__n, 1) = 1").select("__doc", F.coalesce("__copies", "__rule").cast("int").alias("__copies"))
    if not odd.where("__n > 1").isEmpty():
        out = out.unionByName(several.dropDuplicates(["id", "source", "key"]).select("__doc", "__copies"))
    out = out.where(F.col("__copies") > 0)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")
