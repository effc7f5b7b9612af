"""Process states as of an event for the acting process, its parent and its target, and conditions on ancestors.

A life of a process begins with a spawn, or with the initial table. Its parent is the life that the parent's id had then, so lives
form trees. A tour of the trees numbers each life's entry and end; the ranks of the tour's steps come from pointer jumping, 2 to the
power of k steps after k rounds. A life is below another exactly if its entry lies between the other's entry and end, so whether
an ancestor fits is a question of intervals: nothing holds the pairs of descendants and ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.operators.detect import STATE, Condition, inherit_users, one_test, options_of
from riskframe.steps import beside, cut

#: Points of an interval node that one task looks at.
POINTS = 1 << 20
#: Blocks of numbers that may be broadcast.
BROADCAST_NODES = 100_000
#: Bits of the number of steps of a tour.
LEVELS = 40


def initial_rows(initial: DataFrame) -> DataFrame:
    """initial(scenario, process, ...) as changes before all events."""
    return initial.select("scenario", "process", F.lit(None).cast("long").alias("t"), F.lit(-1).cast("long").alias("idx"), F.struct(*STATE).alias("spawned"), F.lit(None).cast("struct<image:string,cmdline:string>").alias("exec"))


def changes(events: DataFrame, initial: DataFrame) -> DataFrame:
    """(scenario, process, t, idx, spawned, exec): what sets a process's state. Users are the parents' where a spawn names none.

    A process that acts before any spawn and is not in the initial table begins there, with the image ``?``.
    """
    rows = inherit_users(events, initial)
    first = events.groupBy("scenario", "process").agg(F.min(F.struct("t", "idx", "type")).alias("f")).where("f.type <> 'spawn'").join(initial.select("scenario", "process").distinct(), ["scenario", "process"], "left_anti")
    rows = rows.join(first.select("scenario", F.col("f.idx").alias("idx"), F.lit(True).alias("begins")), ["scenario", "idx"], "left")
    parent = dict(events.dtypes)["parent"]
    unknown = F.struct(F.lit("?").alias("image"), *(F.lit(None).cast(t).alias(c) for c, t in (("cmdline", "string"), ("user", "string"), ("parent", parent))))
    spawned = F.when(F.col("type") == "spawn", F.struct(*STATE)).when(F.col("begins"), unknown)
    rows = rows.where("type in ('spawn', 'exec') or begins").select("scenario", "process", "t", "idx", spawned.alias("spawned"), F.when(F.col("type") == "exec", F.struct("image", "cmdline")).alias("exec"))
    return initial_rows(initial).unionByName(rows)


def versions(changed: DataFrame) -> DataFrame:
    """changes with the state that holds from then on: image (``?`` if unknown), cmdline, user, parent; t0 and idx0 begin its life."""
    order = Window.partitionBy("scenario", "process").orderBy(F.asc_nulls_first("t"), "idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = changed.withColumn("life", F.count("spawned").over(order)).withColumn("s", F.last("spawned", ignorenulls=True).over(order))
    inside = Window.partitionBy("scenario", "process", "life").orderBy(F.asc_nulls_first("t"), "idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.last("exec", ignorenulls=True).over(inside)).withColumn("born", F.first(F.struct("t", "idx")).over(inside))
    image = F.coalesce(F.when(F.col("e").isNotNull(), F.col("e.image")), F.col("s.image"), F.lit("?"))
    cmdline = F.coalesce(F.when(F.col("e").isNotNull(), F.col("e.cmdline")), F.col("s.cmdline"))
    return rows.select("scenario", "process", "t", "idx", F.struct(image.alias("image"), cmdline.alias("cmdline"), F.col("s.user").alias("user"), F.col("s.parent").alias("parent"), F.col("born")["t"].alias("t0"), F.col("born")["idx"].alias("idx0")).alias("state"))


def as_of(asks: DataFrame, known: DataFrame, process: str, name: str) -> DataFrame:
    """asks(scenario, t, idx, ...) with ``name``: the state of the process in column ``process``, changes at the ask's own event included; null if it has none."""
    rows = asks.withColumn("__p", F.col(process)).withColumn("__ask", F.lit(1))
    both = rows.unionByName(known.select("scenario", F.col("process").alias("__p"), "t", "idx", F.col("state").alias("__state"), F.lit(0).alias("__ask")), allowMissingColumns=True)
    # asks without a process have no state, so they need not meet in one group
    alone = F.when(F.col("__p").isNull(), F.xxhash64("idx"))
    order = Window.partitionBy("scenario", "__p", alone).orderBy(F.asc_nulls_first("t"), "idx", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("__p").isNotNull(), F.last("__state", ignorenulls=True).over(order))
    return both.withColumn(name, found).where("__ask = 1").drop("__p", "__ask", "__state")


def lives(known: DataFrame) -> DataFrame:
    """(scenario, process, t0, idx0, life, up): each life, numbered, and the life that it descends from; null where there is none.

    Initial processes that descend from each other in a circle have no parents there.
    """
    state = F.col("state")
    born = known.where(state["idx0"].eqNullSafe(F.col("idx")) & state["t0"].eqNullSafe(F.col("t"))).select("scenario", "process", "t", "idx", state["parent"].alias("parent"))
    born = cut(born.withColumn("life", F.monotonically_increasing_id()))
    # what was born at the same event is not yet there; initial processes are all there at once
    asks = born.where("parent is not null").select("scenario", F.col("parent").alias("process"), "t", "idx", F.when(F.col("t").isNull(), 2).otherwise(0).alias("kind"), F.col("life").alias("asks"), F.lit(None).cast("long").alias("life"))
    both = asks.unionByName(born.select("scenario", "process", "t", "idx", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("asks"), "life"))
    order = Window.partitionBy("scenario", "process").orderBy(F.asc_nulls_first("t"), "idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    up = both.withColumn("up", F.last("life", ignorenulls=True).over(order)).where("asks is not null").select(F.col("asks").alias("life"), "up")
    found = cut(born.join(up, "life", "left").select("scenario", "process", F.col("t").alias("t0"), F.col("idx").alias("idx0"), "life", "up"))
    ring = circles(found.where("t0 is null and up is not null").select("life", "up"))
    return found if ring is None else cut(found.join(ring.withColumn("ring", F.lit(True)), "life", "left").withColumn("up", F.when(F.col("ring").isNull(), F.col("up"))).drop("ring"))


def circles(links: DataFrame) -> DataFrame | None:
    """The lives on circles of links(life, up): those that a jump of more steps than there are links still reaches."""
    jump, n, steps = cut(links), links.count(), 1
    while steps <= n and not jump.isEmpty():
        there = jump.select(F.col("life").alias("up"), F.col("up").alias("far"))
        jump = cut(beside(jump, there, ["up"]).where("far is not null").select("life", F.col("far").alias("up")))
        steps *= 2
    return None if jump.isEmpty() else jump.select(F.col("up").alias("life")).distinct()


def toured(found: DataFrame) -> DataFrame:
    """lives that have a parent or a child, with tree, first and last: how far entry and end of each are from the end of its tree's tour.

    A life is below another of its tree if its ``first`` lies between the other's ``last`` and ``first``. The tour enters a life,
    enters and ends its children without children, tours the others by number, ends it, and goes on with its next sibling, or ends
    the parent. ``tree`` numbers the last step. Only lives with children take part in the rounds; their other children are
    two steps each right behind their entry.
    """
    parents = found.where("up is not null").select(F.col("up").alias("life")).distinct().withColumn("inner", F.lit(True))
    rows = found.join(parents, "life", "left").withColumn("inner", F.coalesce("inner", F.lit(False))).where("up is not null or inner")
    # roots are no siblings, and no group
    siblings = Window.partitionBy("up", F.when(F.col("up").isNull(), F.col("life")), "inner").orderBy("life")
    rows = cut(rows.withColumn("k", F.row_number().over(siblings)).withColumn("next", F.lead("life").over(siblings)))
    below = rows.where("up is not null").groupBy(F.col("up").alias("life")).agg(F.count_if(~F.col("inner")).alias("leaves"), F.min(F.when(F.col("inner"), F.col("life"))).alias("child"))
    inner = rows.where("inner").select("life", "up", "next")
    # keys of below are those of inner
    inner = cut(inner.join(below, "life"))
    enter = inner.select((F.col("life") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("life") * 2 + 1).alias("next"), (F.col("leaves") * 2 + 1).alias("d"))
    leave = inner.select((F.col("life") * 2 + 1).alias("step"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("d"))
    state = cut(enter.unionByName(leave).select("step", "next", F.when(F.col("next").isNull(), F.col("step")).alias("end"), F.when(F.col("next").isNotNull(), F.col("d")).otherwise(0).alias("d")))
    while not state.where("next is not null").isEmpty():
        # twice at a time: half as many written tables
        for _ in range(2):
            there = state.select(F.col("step").alias("next"), F.col("next").alias("far"), F.col("end").alias("far_end"), F.col("d").alias("more"))
            state = beside(state, there, ["next"]).select("step", F.col("far").alias("next"), F.coalesce("end", "far_end").alias("end"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        state = cut(state)
    # entry and end of a life as one row
    ends = cut(state.groupBy(F.shiftright("step", 1).alias("life")).agg(F.max("end").alias("tree"), F.max("d").alias("first"), F.min("d").alias("last")))
    names = [*found.columns, "tree", "first", "last"]
    # a child without children is found from its parent's entry
    entered = rows.where("not inner").join(ends.select(F.col("life").alias("up"), "tree", F.col("first").alias("entry")), "up")
    leaves = entered.withColumn("first", F.col("entry") - F.col("k") * 2 + 1).withColumn("last", F.col("first") - 1)
    return rows.where("inner").join(ends, "life").select(*names).unionByName(leaves.select(*names))


def covered(rectangles: DataFrame, points: DataFrame) -> DataFrame:
    """(scenario, ref) of points(scenario, tree, at, when, ref) that lie in any of rectangles(scenario, tree, low, high, since, until).

    ``low`` to ``high`` are whole numbers from 0, both included; ``until`` is not. An interval is cut into aligned blocks of numbers, of
    which a point lies in one of each size, so that they meet by equal keys; within a block a running maximum of
    ``until`` in the order of time tells whether one is open. A block with many points is dealt to several tasks.
    """
    size = F.expr("shiftleft(1L, level)")
    cuts = rectangles.where("low <= high and since < until").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    l, r = F.ceil(F.col("low") / size).cast("long"), F.floor((F.col("high") + 1) / size).cast("long")
    found = F.filter(F.array(F.when((l < r) & (l % 2 == 1), l), F.when((l < r) & (r % 2 == 1), r - 1)), lambda x: x.isNotNull())
    cuts = cut(cuts.select("scenario", "tree", "level", F.explode(F.array_distinct(found)).alias("node"), "since", "until"))
    key = ["scenario", "tree", "level", "node"]
    nodes = cut(cuts.select(*key).distinct())
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    # a point is looked for in the sizes of blocks that there are
    levels = F.array(*(F.lit(r.level) for r in nodes.select("level").distinct().orderBy("level").collect())).cast("array<int>")
    places = points.withColumn("level", F.explode(levels)).withColumn("node", F.floor(F.col("at") / size).cast("long"))
    places = cut(places.join(F.broadcast(nodes) if few else nodes, key, "left_semi"))
    parts = places.groupBy(*key).agg(F.ceil(F.count("*") / POINTS).cast("int").alias("parts"))
    dealt = cuts.join(parts, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("since").alias("when"), "until", F.lit(0).alias("is_point"))
    asked = places.join(parts, key).select(*key, F.pmod(F.xxhash64("ref"), "parts").cast("int").alias("part"), "when", F.lit(1).alias("is_point"), "ref")
    order = Window.partitionBy(*key, "part").orderBy("when", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.unionByName(asked, allowMissingColumns=True).withColumn("open", F.max("until").over(order))
    return both.where((F.col("is_point") == 1) & (F.col("open") > F.col("when"))).select("scenario", "ref").distinct()


def scoped(events: DataFrame, initial: DataFrame, rules: list) -> DataFrame:
    """events with what conditions of the rules look at: own, parent and target states, and a flag for each ancestor condition.

    Give ``scope_column(rules)`` to the detectors. ``parent`` of a spawn is the event's, else the process's. The target of a
    terminate event without one is the process itself. A process that no spawn or initial row knows has the image ``?`` from its first event on.
    """
    known = cut(versions(changes(events, initial)))
    rows = as_of(events, known, "process", "s_process")
    rows = rows.withColumn("s_parent_id", F.col("s_process.parent"))
    target = F.col("target") if "target" in events.columns else F.lit(None).cast(dict(events.dtypes)["process"])
    rows = rows.withColumn("s_target_id", F.coalesce(target, F.when(F.col("type") == "terminate", F.col("process"))))
    rows = as_of(as_of(rows, known, "s_parent_id", "s_parent"), known, "s_target_id", "s_target")
    tests = ancestor_tests(rules)
    if not tests:
        return rows
    rows = cut(rows)
    tour = cut(toured(lives(known)))
    key = lambda t0, idx0: F.struct(F.coalesce(t0, F.lit(-(2**63))).alias("t0"), idx0.alias("idx0"))
    tour = tour.select("scenario", "process", key(F.col("t0"), F.col("idx0")).alias("born"), "up", "tree", "first", "last")
    moment = lambda t, idx: F.struct(F.coalesce(t, F.lit(-(2**63))).alias("t"), idx.alias("idx"))
    state = F.col("state")
    later = F.lead(moment(F.col("t"), F.col("idx"))).over(Window.partitionBy("scenario", "process", key(state["t0"], state["idx0"])).orderBy(F.asc_nulls_first("t"), "idx"))
    spans = known.select("scenario", "process", key(state["t0"], state["idx0"]).alias("born"), "state", moment(F.col("t"), F.col("idx")).alias("since"), F.coalesce(later, moment(F.lit(2**63 - 1), F.lit(2**63 - 1))).alias("until"))
    # nothing lies below lives without children
    spans = cut(spans.join(tour.where("first - last > 1"), ["scenario", "process", "born"]))
    points = rows.select("scenario", "process", key(F.col("s_process.t0"), F.col("s_process.idx0")).alias("born"), moment(F.col("t"), F.col("idx")).alias("when"), F.col("idx").alias("ref"))
    points = cut(points.join(tour.where("up is not null"), ["scenario", "process", "born"]).select("scenario", "tree", F.col("first").alias("at"), "when", "ref"))
    for name, (field, options) in tests.items():
        value = F.col("process").cast("string") if field == "id" else state[field]
        fits = reduce(lambda a, b: a | b, (one_test(value, f"ancestor.{field}", v) for v in options))
        inside = spans.where(fits).select("scenario", "tree", (F.col("last") + 1).alias("low"), (F.col("first") - 1).alias("high"), "since", "until")
        hit = covered(inside, points).select("scenario", F.col("ref").alias("idx"), F.lit(True).alias(name))
        rows = rows.join(hit, ["scenario", "idx"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def conditions_of(rules: list) -> list[Condition]:
    return [c for rule in rules for c in (rule.match or {}, *rule.steps)]


def ancestor_tests(rules: list) -> dict[str, tuple[str, list]]:
    """Names for the different conditions on ancestors of the rules."""
    found: dict[str, tuple[str, list]] = {}
    for c in conditions_of(rules):
        for name, values in c.items():
            if name.startswith("ancestor.") and (options := options_of(values)):
                test = (name.split(".", 1)[1], options)
                if test not in found.values():
                    found[f"s_ancestor_{len(found)}"] = test
    return found


def scope_column(rules: list):
    """How conditions find their fields in ``scoped`` rows: own values before the process's, dotted ones by scope."""
    tests = ancestor_tests(rules)

    def column(name: str, options: list | None = None) -> Column:
        scope, _, prop = name.rpartition(".")
        if scope == "ancestor":
            return F.col(next(k for k, v in tests.items() if v == (prop, options)))
        if scope in ("process", "parent", "target"):
            if prop == "id":
                return F.col("process" if scope == "process" else f"s_{scope}_id")
            return F.col(f"s_{scope}.{prop}")
        if name in ("image", "cmdline", "user"):
            return F.coalesce(F.col(name), F.col(f"s_process.{name}"))
        return F.col(name)

    return column
