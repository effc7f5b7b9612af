"""Detection over process events: conditions, state as of an event, single-event, threshold and sequence rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskframe.operators.rules import java_error
from riskframe.steps import beside, cut

Condition = dict[str, object]


@dataclass(frozen=True)
class DetectionRule:
    """kind: match, threshold (at least ``count`` within ``within`` ms per group) or sequence (of ``steps``, all within ``within``).

    A condition maps fields to a value or a list of values of which one must fit: text is a pattern (``(?i)`` before it: in any
    case); numbers and booleans must be equal, but a number for ``count`` is the least. ``$X`` in a step binds a variable, or must equal it.
    ``group`` names the column that a threshold is counted by; None counts all.
    """

    rule_id: str
    kind: str
    match: Condition | None = None
    steps: tuple[Condition, ...] = ()
    count: int = 1
    within: int | None = None
    group: str | None = "process"
    severity: str = "medium"


def is_variable(value: object) -> bool:
    return isinstance(value, str) and value.startswith("$")


def options_of(values: object) -> list:
    """The values that a field is tested against; variables are bound elsewhere."""
    return [v for v in (values if isinstance(values, (list, tuple)) else [values]) if not is_variable(v)]


def one_test(c: Column, name: str, value: object) -> Column:
    """Whether a field fits a value."""
    if isinstance(value, bool):
        return c == F.lit(value)
    if isinstance(value, (int, float)):
        return c >= value if name.endswith("count") else c == value
    return c.cast("string").rlike(value)


def condition(fields: Condition, column: Callable[[str], Column] = F.col, ancestors: Column | None = None) -> Column:
    """A condition as a Column over event rows; a missing field is no match. Variables are left to the sequence join.

    A field ``ancestor.x`` is looked for in an array of ancestors, or, if there is none, in a flag that ``column`` names (see ``lives.scoped``).
    """
    tests = []
    for name, values in fields.items():
        options = options_of(values)
        if not options:
            continue
        if name.startswith("ancestor.") and ancestors is None:
            tests.append(column(name, options))
        elif name.startswith("ancestor."):
            field = name.split(".", 1)[1]
            tests.append(F.exists(ancestors, lambda a, o=options, n=name, f=field: reduce(lambda x, y: x | y, (F.coalesce(one_test(a[f], n, v), F.lit(False)) for v in o))))
        else:
            tests.append(reduce(lambda x, y: x | y, (one_test(column(name), name, v) for v in options)))
    return F.coalesce(reduce(lambda x, y: x & y, tests, F.lit(True)), F.lit(False))


def bindings(step: Condition) -> dict[str, str]:
    """Variables of a step and the fields that hold them."""
    return {v: name for name, v in step.items() if is_variable(v)}


DETECTION = ("scenario", "rule_id", "severity", "t", "events", "processes")


def detections(rows: DataFrame, rule: DetectionRule, t: Column, events: Column, processes: Column) -> DataFrame:
    return rows.select("scenario", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), t.alias("t"), events.alias("events"), F.array_distinct(processes).alias("processes"))


def detect_match(events: DataFrame, rule: DetectionRule, ancestors: Column | None = None, column: Callable[..., Column] = F.col) -> DataFrame:
    """One detection for each event(scenario, idx, t, process, ...) that fits."""
    return detections(events.where(condition(rule.match or {}, column, ancestors)), rule, F.col("t"), F.array("idx"), F.array("process"))


def threshold_firings(events: DataFrame, rule: DetectionRule, ancestors: Column | None = None, column: Callable[..., Column] = F.col) -> DataFrame:
    """(scenario, grp, t, idx): the first event of each group at which the trailing sum of counts reaches the rule's.

    The window reaches ``within`` ms back, both ends included. Events at the same time count only up to the event itself.
    """
    n = F.coalesce(F.col("count"), F.lit(1)) if "count" in events.columns else F.lit(1)
    grp = column(rule.group).cast("string") if rule.group else F.lit("all")
    rows = events.where(condition(rule.match or {}, column, ancestors)).select("scenario", grp.alias("grp"), "t", "idx", n.cast("long").alias("n"))
    span = Window.partitionBy("scenario", "grp").orderBy("t")
    span = span.rangeBetween(-rule.within, 0) if rule.within is not None else span.rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("scenario", "grp", "t").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("n").over(span) - F.coalesce(F.sum("n").over(later), F.lit(0)))
    fired = rows.where(F.col("total") >= rule.count).groupBy("scenario", "grp").agg(F.min(F.struct("t", "idx", "total")).alias("f"))
    return fired.select("scenario", "grp", F.col("f.t").alias("t"), F.col("f.idx").alias("idx"), F.col("f.total").alias("total"))


def detect_threshold(events: DataFrame, rule: DetectionRule, ancestors: Column | None = None, column: Callable[..., Column] = F.col) -> DataFrame:
    """One detection for each group, at its first firing, with the window's events and processes."""
    fired = threshold_firings(events, rule, ancestors, column).toDF("scenario", "grp", "f_t", "f_idx", "total")
    grp = column(rule.group).cast("string") if rule.group else F.lit("all")
    rows = events.where(condition(rule.match or {}, column, ancestors)).withColumn("grp", grp).join(fired, ["scenario", "grp"])
    inside = F.col("t") >= F.col("f_t") - rule.within if rule.within is not None else F.lit(True)
    rows = rows.where(inside & (F.struct("t", "idx") <= F.struct(F.col("f_t").alias("t"), F.col("f_idx").alias("idx"))))
    found = rows.groupBy("scenario", "grp", "f_t").agg(F.sort_array(F.collect_list(F.struct("t", "idx", "process"))).alias("w"))
    return detections(found, rule, F.col("f_t"), F.transform("w", lambda x: x["idx"]), F.transform("w", lambda x: x["process"]))


def detect_sequence(events: DataFrame, rule: DetectionRule, ancestors: Column | None = None, key: tuple[str, ...] = (), column: Callable[..., Column] = F.col) -> DataFrame:
    """For each event of the first step the earliest completion by later events of the other steps, all within the rule's span.

    Of several paths to a completion the earliest is taken. ``key`` columns, if given, must be equal in all steps. No step repeats
    an event. Where all variables are in all steps, no event meets another one: see ``next_steps``.
    """
    fits = [condition(s, column, ancestors) for s in rule.steps]
    variables = [bindings(s) for s in rule.steps]
    if all(v.keys() == variables[0].keys() for v in variables):
        return next_steps(events, rule, fits, variables, key, column)
    return joined_steps(events, rule, fits, variables, key, column)


def next_steps(events: DataFrame, rule: DetectionRule, fits: list[Column], variables: list[dict[str, str]], key: tuple[str, ...], column: Callable[..., Column]) -> DataFrame:
    """Sequences whose steps share all variables, by one sort of the events by scenario, key and variables, latest first.

    Coming from the end, each step's event knows the nearest event of the next step and the path that leads on from it: a
    window for each step over the same order. A nearer event is never worse, since all that completes a later one completes it.
    """
    n = len(fits)
    names = sorted(variables[0])
    # an event is a row for each step that it fits, with the step's own fields for the variables
    steps = F.array(*(F.when(fit, F.struct(F.lit(k).alias("step"), F.struct(F.lit(0).alias("none"), *(column(bound[v]).cast("string").alias(v[1:]) for v in names)).alias("vars"))) for k, (fit, bound) in enumerate(zip(fits, variables, strict=True))))
    rows = events.select("scenario", *key, "t", "idx", "process", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s"))
    rows = rows.select("scenario", *key, "t", "idx", "process", "s.step", *(F.col(f"s.vars.{v[1:]}").alias(f"v_{v[1:]}") for v in names))
    for v in names:
        rows = rows.where(F.col(f"v_{v[1:]}").isNotNull())
    # the step of an event comes before its next one, which so is no successor
    after = Window.partitionBy("scenario", *key, *(f"v_{v[1:]}" for v in names)).orderBy(F.desc("t"), F.desc("idx"), "step").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda more: F.struct(*more[:1], F.concat(F.array("idx"), *more[1:2]).alias("events"), F.concat(F.array("process"), *more[2:]).alias("processes"))
    rows = rows.withColumn("path", F.when(F.col("step") == n - 1, own([F.col("t").alias("t")])))
    for k in range(n - 2, -1, -1):
        rows = rows.withColumn("on", F.last(F.when(F.col("step") == k + 1, F.col("path")), ignorenulls=True).over(after))
        rows = rows.withColumn("path", F.when((F.col("step") == k) & F.col("on").isNotNull(), own([F.col("on.t").alias("t"), F.col("on.events"), F.col("on.processes")])).otherwise(F.col("path")))
    done = rows.where("step = 0 and path is not null")
    if rule.within is not None:
        done = done.where(F.col("path.t") <= F.col("t") + rule.within)
    return detections(done, rule, F.col("path.t"), F.col("path.events"), F.col("path.processes"))


def joined_steps(events: DataFrame, rule: DetectionRule, fits: list[Column], variables: list[dict[str, str]], key: tuple[str, ...], column: Callable[..., Column]) -> DataFrame:
    """Sequences of which some steps lack a variable: steps are joined one after the other, within buckets of time if there is a span."""
    bound: dict[str, str] = {}
    rows = events.where(fits[0])
    path = rows.select("scenario", *key, F.col("t").alias("t0"), F.col("idx").alias("i0"), F.struct("t", "idx").alias("at"), F.array("idx").alias("events"), F.array("process").alias("processes"), *(column(f).alias(f"v_{v[1:]}") for v, f in variables[0].items()))
    bound |= {v: f"v_{v[1:]}" for v in variables[0]}
    for k, (fit, own) in enumerate(zip(fits[1:], variables[1:], strict=True), 1):
        names = {v: f for v, f in own.items() if v in bound}
        fresh = {v: f for v, f in own.items() if v not in bound}
        hits = events.where(fit).select("scenario", *key, F.col("t").alias("s_t"), F.struct("t", "idx").alias("s_at"), F.col("idx").alias("s_idx"), F.col("process").alias("s_process"), *(column(f).alias(f"w_{v[1:]}") for v, f in own.items()))
        on = ["scenario", *key]
        if rule.within is not None:
            size = max(1, rule.within)
            hits = hits.withColumn("bucket", F.floor(F.col("s_t") / size))
            path = path.withColumn("bucket", F.explode(F.array(F.floor(F.col("t0") / size), F.floor(F.col("t0") / size) + 1)))
            on.append("bucket")
        for v in names:
            # equal variables are join keys
            hits = hits.withColumn(bound[v], F.col(f"w_{v[1:]}").cast("string"))
            path = path.withColumn(bound[v], F.col(bound[v]).cast("string"))
            on.append(bound[v])
        joined = path.join(hits, on).where(F.col("s_at") > F.col("at"))
        if rule.within is not None:
            joined = joined.where(F.col("s_t") <= F.col("t0") + rule.within)
        final = k == len(rule.steps) - 1
        keep = [F.col(c) for c in ("scenario", *key, "t0", "i0")]
        joined = joined.select(*keep, F.col("s_at").alias("at"), F.concat("events", F.array("s_idx")).alias("events"), F.concat("processes", F.array("s_process")).alias("processes"), *(F.col(c) for c in bound.values()), *(F.col(f"w_{v[1:]}").alias(f"v_{v[1:]}") for v in fresh))
        bound |= {v: f"v_{v[1:]}" for v in fresh}
        # the earliest arrival for the same start and variables leads to every completion that a later one leads to
        groups = ["scenario", *key, "t0", "i0"] + ([] if final else list(bound.values()))
        path = joined.groupBy(*groups).agg(F.min(F.struct("at", "events", "processes")).alias("p")).select(*groups, "p.at", "p.events", "p.processes")
    return detections(path, rule, F.col("at.t"), F.col("events"), F.col("processes"))


def detect(events: DataFrame, rules: list[DetectionRule], ancestors: Column | None = None, column: Callable[..., Column] = F.col) -> DataFrame:
    """Detections of all rules: (scenario, rule_id, severity, t, events, processes)."""
    by_kind = {"match": detect_match, "threshold": detect_threshold, "sequence": detect_sequence}
    return reduce(DataFrame.unionByName, (by_kind[r.kind](events, r, ancestors, column=column) for r in rules))


def missing_detections(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(scenario, rule_id) without those that were found."""
    return expected.join(found, ["scenario", "rule_id"], "left_anti")


def fill_time(events: DataFrame) -> DataFrame:
    """A missing t is one ms after the event before; before the first known one time starts at 0."""
    order = Window.partitionBy("scenario").orderBy("idx")
    rows = events.withColumn("__g", F.count("t").over(order))
    inside = Window.partitionBy("scenario", "__g").orderBy("idx")
    base = F.first("t", ignorenulls=True).over(Window.partitionBy("scenario", "__g"))
    offset = F.row_number().over(inside) - F.when(F.col("__g") > 0, 1).otherwise(0)
    return rows.withColumn("t", F.coalesce(base, F.lit(0)) + offset).drop("__g")


STATE = ("image", "cmdline", "user", "parent")


def inherit_users(events: DataFrame, initial: DataFrame) -> DataFrame:
    """events whose spawns without a user have that of the parent, as of the spawn; it may have its own from its parent in turn.

    Each spawn begins a life of its process. Lives without a user point to the life of the parent at that time; each round lets
    such a pointer skip to where its target points, so a chain of n takes log2(n) joins.
    """
    key = lambda: F.struct(F.col("process").cast("string").alias("process"), "idx")
    born = events.where("type = 'spawn'").select("scenario", "process", "t", "idx", "user", "parent")
    lives = born.unionByName(initial.select("scenario", "process", F.lit(None).cast("long").alias("t"), F.lit(-1).cast("long").alias("idx"), "user", "parent"))
    asks = born.where("user is null and parent is not null").select("scenario", F.col("parent").alias("process"), "t", "idx", F.lit(0).alias("is_life"), key().alias("key"))
    known = lives.select("scenario", "process", "t", "idx", F.lit(1).alias("is_life"), key().alias("key"))
    before = Window.partitionBy("scenario", "process").orderBy(F.asc_nulls_first("t"), "idx", "is_life").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = asks.unionByName(known).withColumn("up", F.last(F.when(F.col("is_life") == 1, F.col("key")), ignorenulls=True).over(before)).where("is_life = 0 and up is not null")
    up = up.select("scenario", "key", "up")
    state = cut(lives.select("scenario", key().alias("key"), "user").join(up, ["scenario", "key"], "left"))
    while not state.where("user is null and up is not null").isEmpty():
        target = state.select("scenario", F.col("key").alias("up"), F.col("user").alias("up_user"), F.col("up").alias("up_up"))
        state = cut(beside(state, target, ["scenario", "up"]).select("scenario", "key", F.coalesce("user", "up_user").alias("user"), F.when(F.col("user").isNull() & F.col("up_user").isNull(), F.col("up_up")).alias("up")))
    found = state.where("key.idx >= 0").select("scenario", F.col("key.idx").alias("idx"), F.col("user").alias("__user"))
    rows = events.join(found, ["scenario", "idx"], "left").withColumn("user", F.coalesce("user", "__user"))
    return rows.select(*events.columns)


def unseen(events: DataFrame, initial: DataFrame) -> DataFrame:
    """(scenario, process, n, first_idx): processes that act before any spawn of theirs and are not in the initial table."""
    starts = events.where("type = 'spawn'").groupBy("scenario", "process").agg(F.min(F.struct("t", "idx")).alias("start"))
    rows = events.where("type <> 'spawn'").join(initial.select("scenario", "process").distinct(), ["scenario", "process"], "left_anti").join(starts, ["scenario", "process"], "left")
    early = rows.where(F.col("start").isNull() | (F.struct("t", "idx") < F.col("start")))
    return early.groupBy("scenario", "process").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def enrich(events: DataFrame, initial: DataFrame) -> DataFrame:
    """events with p_image, p_cmdline, p_user, p_parent: the process's state as of each event, its own change included.

    States come from initial(scenario, process, image, cmdline, user, parent) and from spawn and exec events; a spawn sets all,
    also to null (but a missing user is the parent's), an exec image and command line. An unseen process has the image ``?``.
    """
    events = inherit_users(events, initial)
    before = initial.select("scenario", "process", F.lit(None).cast("long").alias("t"), F.lit(-1).cast("long").alias("idx"), F.struct(*STATE).alias("spawned"), F.lit(None).cast("struct<image:string,cmdline:string>").alias("exec"), F.lit(False).alias("real"))
    spawned = F.when(F.col("type") == "spawn", F.struct(*STATE))
    changed = F.when(F.col("type") == "exec", F.struct("image", "cmdline"))
    rows = events.select("scenario", "process", "t", "idx", spawned.alias("spawned"), changed.alias("exec"), F.lit(True).alias("real"))
    order = Window.partitionBy("scenario", "process").orderBy(F.asc_nulls_first("t"), "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = before.unionByName(rows)
    both = both.withColumn("life", F.count("spawned").over(order)).withColumn("s", F.last("spawned", ignorenulls=True).over(order))
    inside = Window.partitionBy("scenario", "process", "life").orderBy(F.asc_nulls_first("t"), "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("e", F.last("exec", ignorenulls=True).over(inside)).where("real")
    image = F.when(F.col("e").isNotNull(), F.col("e.image")).otherwise(F.coalesce("s.image", F.lit("?")))
    state = both.select("scenario", "idx", image.alias("p_image"), F.when(F.col("e").isNotNull(), F.col("e.cmdline")).otherwise(F.col("s.cmdline")).alias("p_cmdline"), F.col("s.user").alias("p_user"), F.col("s.parent").alias("p_parent"))
    return events.join(state, ["scenario", "idx"])


def ancestors(processes: DataFrame) -> DataFrame:
    """(scenario, process, ancestor, depth) of processes(scenario, process, parent), by doubling; cycles end where they begin.

    Each round joins chains of length 2^k with themselves, so depth d takes log2(d) joins. It ends when no pair is new.
    """
    step = processes.where("parent is not null and parent <> process").select("scenario", "process", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    reach = jump = cut(step.groupBy("scenario", "process", "ancestor").agg(F.min("depth").alias("depth")))
    n = reach.count()
    while True:
        on = F.col("a.scenario") == F.col("b.scenario")
        far = reach.alias("a").join(jump.alias("b"), on & (F.col("a.ancestor") == F.col("b.process"))).select("a.scenario", "a.process", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        far = far.where(F.col("process") != F.col("ancestor"))
        reach = cut(reach.unionByName(far).groupBy("scenario", "process", "ancestor").agg(F.min("depth").alias("depth")))
        if (more := reach.count()) == n:
            return reach
        n = more
        jump = jump.alias("a").join(jump.alias("b"), on & (F.col("a.ancestor") == F.col("b.process"))).select("a.scenario", "a.process", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        jump = cut(jump)


def process_summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """(scenario, process, n_events, children, detections, terminated_by, injected_by, ended_at)."""
    own = events.groupBy("scenario", "process").agg(F.count("*").alias("n_events"), F.max(F.when(F.col("type") == "exit", F.col("t"))).alias("ended_at"))
    children = events.where("type = 'spawn' and parent is not null").groupBy("scenario", F.col("parent").alias("process")).agg(F.sort_array(F.collect_set("process")).alias("children"))
    hit = found.select("scenario", "rule_id", F.explode("processes").alias("process")).groupBy("scenario", "process").agg(F.sort_array(F.collect_set("rule_id")).alias("detections"))
    target = events.where("target is not null").groupBy("scenario", F.col("target").alias("process")).agg(F.min_by(F.when(F.col("type") == "terminate", F.col("process")), F.when(F.col("type") == "terminate", F.struct("t", "idx"))).alias("terminated_by"), F.sort_array(F.collect_set(F.when(F.col("type") == "inject", F.col("process")))).alias("injected_by"))
    on = ["scenario", "process"]
    return own.join(children, on, "left").join(hit, on, "left").join(target, on, "left")


def timeline(events: DataFrame, found: DataFrame) -> DataFrame:
    """(scenario, idx, t, line, rules): a text for each event and the rules that it is part of."""
    what = F.coalesce(*(F.col(c).cast("string") for c in ("path", "key", "remote", "target", "cmdline")), F.lit(""))
    line = F.rtrim(F.concat_ws(" ", F.col("process"), F.col("type"), F.col("op"), what))
    hits = found.select("scenario", "rule_id", F.explode("events").alias("idx")).groupBy("scenario", "idx").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
    return events.select("scenario", "idx", "t", line.alias("line")).join(hits, ["scenario", "idx"], "left")


def valid_rule(spark: SparkSession, rule: DetectionRule) -> str | None:
    """Why a rule can't run, or null."""
    if rule.kind not in ("match", "threshold", "sequence"):
        return "kind"
    if rule.kind == "sequence" and len(rule.steps) < 2:
        return "steps"
    for step in (rule.match or {}, *rule.steps):
        for values in step.values():
            for v in values if isinstance(values, (list, tuple)) else [values]:
                if isinstance(v, str) and not is_variable(v):
                    if java_error(spark, v):
                        return "pattern"
    return None
