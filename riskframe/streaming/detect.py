"""Live detection over event streams: matches, thresholds that fire once, sequences, rates.

Batch and stream agree if no event is late. State is kept by key. With ``late``, the time by which events may be late, events carry
a watermark and a key's state is dropped once no event can meet it any more; without, it stays. A rule without ``within`` needs its state
for ever.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskframe.operators.detect import STATE, DetectionRule, bindings, condition

FIRING = "rule_id string, grp string, t long, idx long, total long"
COMPLETED = "rule_id string, grp string, first long, last long, t long"


def expire(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer for the key: that at which its newest event is too old for any other."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
    handle.registerTimer(at)


def match_stream(events: DataFrame, rule: DetectionRule) -> DataFrame:
    """Detections of a match rule; no state."""
    return events.where(condition(rule.match or {})).select(F.lit(rule.rule_id).alias("rule_id"), "t", "idx", "process")


class Threshold(StatefulProcessor):
    """The events of the trailing window, and whether the key has fired."""

    def __init__(self, rule: DetectionRule, timed: bool):
        self.rule, self.timed = rule, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t long, idx long, n long")
        self.fired = handle.getValueState("fired", "fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(t), int(i), int(n)) for frame in rows for t, i, n in zip(frame["t"], frame["idx"], frame["n"], strict=True))
        if self.fired.exists():
            return
        held = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        for event in new:
            held.append(event)
            if self.rule.within is not None:
                held = [e for e in held if e[0] >= event[0] - self.rule.within]
            total = sum(e[2] for e in held)
            if total >= self.rule.count:
                self.fired.update((True,))
                self.events.clear()
                yield pd.DataFrame({"rule_id": [self.rule.rule_id], "grp": [key[0]], "t": [event[0]], "idx": [event[1]], "total": [total]})
                return
        if held:
            self.events.put(held)
            if self.timed:
                expire(self.handle, held[-1][0] + self.rule.within + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        yield from ()

    def close(self) -> None:
        pass


class Sequence(StatefulProcessor):
    """Open partial sequences of a key: the next step, where the first one stood, and the variables that are bound so far.

    A partial that a step gives new variables also waits on without them, since another event may bind others. Partials of
    the same first event, step and variables are one, that which came first. A first event is completed once.
    """

    def __init__(self, rule: DetectionRule, fresh: list[bool], timed: bool):
        self.rule, self.fresh, self.timed = rule, fresh, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.partials = handle.getListState("partials", "step int, t0 long, first long, vars string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = len(self.fresh) - 1
        new = sorted(((int(t), int(idx), list(steps)) for frame in rows for t, idx, steps in zip(frame["t"], frame["idx"], frame["steps"], strict=True)), key=lambda x: x[:2])
        held = {(int(p[0]), int(p[2]), p[3]): int(p[1]) for p in self.partials.get()} if self.partials.exists() else {}
        done = []
        for t, idx, steps in new:
            if self.rule.within is not None:
                held = {k: t0 for k, t0 in held.items() if t <= t0 + self.rule.within}
            fits = [None if s is None else json.loads(s) for s in steps]
            ended, moved = set(), {}
            for (step, first, bound), t0 in list(held.items()):
                own, known = fits[step], json.loads(bound)
                if first in ended or own is None or any(known.get(v, x) != x for v, x in own.items()):
                    continue
                if step == last:
                    done.append((first, idx, t))
                    ended.add(first)
                    continue
                moved.setdefault((step + 1, first, json.dumps(known | own, sort_keys=True)), t0)
                if not self.fresh[step]:
                    del held[step, first, bound]
            held = {k: t0 for k, t0 in ({**moved, **held}).items() if k[1] not in ended}
            if fits[0] is not None:
                held[1, idx, json.dumps(fits[0], sort_keys=True)] = t
        if held:
            self.partials.put([(step, t0, first, bound) for (step, first, bound), t0 in held.items()])
            if self.timed:
                expire(self.handle, max(held.values()) + self.rule.within + 1)
        else:
            self.partials.clear()
        if done:
            yield pd.DataFrame([(self.rule.rule_id, key[0], *d) for d in done], columns=["rule_id", "grp", "first", "last", "t"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.partials.clear()
        yield from ()

    def close(self) -> None:
        pass


#: What an event's process is as of it: its spawn and exec included.
TABLE_STATE = "image string, cmdline string, user string, parent string"


class ProcessTable(StatefulProcessor):
    """The state of a process, changed by its spawns and execs before an event of its own is given out.

    With event time, events wait until the watermark has passed them, and are taken in the order of (t, idx); the state of a process
    that had no event for ``idle`` ms of event time goes. Without, those of a batch are ordered, and state stays.
    """

    def __init__(self, columns: list[str], timed: bool, idle: int | None):
        self.columns, self.timed, self.idle = columns, timed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{TABLE_STATE}, t long")
        self.waiting = handle.getListState("waiting", "t long, idx long, event string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((*(plain(row[c]) for c in STATE), None))

    def replayed(self, events: list[tuple[int, int, str]]) -> list[dict]:
        """Events in order, each with the state as of it."""
        held = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for t, _, text in sorted(events, key=lambda e: e[:2]):
            event = json.loads(text)
            if event["type"] == "spawn":
                held = (event["image"] or "?", event["cmdline"], event["user"], None if event["parent"] is None else str(event["parent"]), t)
            elif event["type"] == "exec":
                held = (event["image"], event["cmdline"], *(held[2:4] if held else (None, None)), t)
            held = (*(held or ("?", None, None, None))[:4], t)
            out.append(event | {f"p_{c}": v for c, v in zip(STATE, held[:4], strict=True)})
        if held:
            self.state.update(held)
        return out

    def given(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([[r.get(c) for c in self.columns] for r in rows], columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), e) for frame in rows for t, i, e in zip(frame["t"], frame["idx"], frame["event"], strict=True)]
        if not self.timed:
            yield from self.given(self.replayed(new))
            return
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.put(held + new)
        expire(self.handle, min(e[0] for e in held + new) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self.given(self.replayed([e for e in held if e[0] < now]))
        later = [e for e in held if e[0] >= now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(e[0] for e in later) + 1)
            return
        self.waiting.clear()
        last = self.state.get()[4] if self.state.exists() else None
        if self.idle is not None and last is not None:
            if last + self.idle < now:
                self.state.clear()
            else:
                self.handle.registerTimer(last + self.idle + 1)

    def close(self) -> None:
        pass


def plain(value):
    return None if value is None or value != value else value


def enrich_stream(events: DataFrame, initial: DataFrame, late: str | None = None, idle: int | None = None) -> DataFrame:
    """A stream of process events with p_image, p_cmdline, p_user, p_parent as of each, as ``operators.detect.enrich`` gives them.

    initial(scenario, process, image, cmdline, user, parent) is the process table at the start. An event is given out once no earlier
    one can come (``late``); without ``late``, micro-batches must come in order. A spawn without a user asks for its parent's in a
    pass before, keyed by the parent: that which a spawn or the table names for it; a user is not passed on further.
    """
    # an int64 time, as the timers have it; a process is a text, as a key
    flat = [c for c, t in events.dtypes if c not in ("ts",)]
    name = lambda c: F.concat_ws("\x1f", "scenario", F.col(c).cast("string")).alias("grp")
    state = initial.select(name("process"), *(F.col(c).cast("string").alias(c) for c in STATE))
    asked = users_of_parents(events, state, late, idle)
    out = asked.schema
    types = {f.name: f.dataType.simpleString() for f in out}
    schema = ", ".join([f"{c} {types[c]}" for c in flat] + [f"p_{c} string" for c in STATE])
    rows = asked.select(name("process"), F.col("t").cast("long").alias("t"), F.col("idx").cast("long").alias("idx"), F.to_json(F.struct(*flat), {"ignoreNullFields": "false"}).alias("event"), *(["ts"] if late else []))
    return keyed(rows, ProcessTable([*flat, *(f"p_{c}" for c in STATE)], late is not None, idle), schema, late, state, "ts" if late else None)


def users_of_parents(events: DataFrame, state: DataFrame, late: str | None, idle: int | None) -> DataFrame:
    """events of which spawns without a user have that of their parent: a state keyed by process, which spawns also ask for their parent's."""
    spawn = F.col("type") == "spawn"
    flat = [c for c in events.columns if c != "ts"]
    ask = spawn & F.col("user").isNull() & F.col("parent").isNotNull()
    who = F.filter(F.array(F.struct(F.when(ask, F.col("parent").cast("string")).otherwise(F.col("process").cast("string")).alias("of"), F.lit(True).alias("real")), F.when(ask, F.struct(F.col("process").cast("string").alias("of"), F.lit(False).alias("real")))), lambda x: x.isNotNull())
    # the event itself goes to the parent if it asks, and tells its own key that a life begins
    rows = events.select(*flat, F.explode(who).alias("who"))
    rows = rows.select(F.concat_ws("\x1f", "scenario", "who.of").alias("grp"), F.col("t").cast("long").alias("t"), F.col("idx").cast("long").alias("idx"), F.to_json(F.struct(*flat, F.col("who.real").alias("real")), {"ignoreNullFields": "false"}).alias("event"))
    types = dict(events.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in flat)
    if late:
        schema += ", ts timestamp"
    return keyed(rows, Users([*flat, *(["ts"] if late else [])], late is not None, idle), schema, late, state, None)


class Users(ProcessTable):
    """Users by process. Spawns of children that ask are answered by the state as of them; own spawns change it."""

    def replayed(self, events: list[tuple[int, int, str]]) -> list[dict]:
        held = tuple(self.state.get()) if self.state.exists() else None
        user = held[2] if held else None
        out, last = [], None
        for t, _, text in sorted(events, key=lambda e: e[:2]):
            event, last = json.loads(text), t
            real = event.pop("real")
            own = event["user"] is not None or event["type"] != "spawn" or event["parent"] is None
            if not real:
                user = None
            elif own:
                user = event["user"] if event["type"] == "spawn" else user
                out.append(event)
            else:
                out.append(event | {"user": user})
        if last is not None:
            self.state.update((*((held or (None,) * 4)[:2]), user, (held or (None,) * 4)[3], last))
        return [e | {"ts": pd.Timestamp(e["t"], unit="ms")} for e in out]


def keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, late: str | None, state: DataFrame, ts: str | None) -> DataFrame:
    """rows(grp, t, ...) by grp through a processor that begins with state(grp, ...)."""
    if late is None:
        return rows.groupBy("grp").transformWithStateInPandas(processor, schema, "Append", "None", initialState=state.groupBy("grp"))
    timed = rows if ts else rows.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    grouped, begun = timed.groupBy("grp"), state.groupBy("grp")
    if "ts" in [c.strip().split()[0] for c in schema.split(",")]:
        return grouped.transformWithStateInPandas(processor, schema, "Append", "EventTime", initialState=begun, eventTimeColumnName="ts")
    return grouped.transformWithStateInPandas(processor, schema, "Append", "EventTime", initialState=begun)


def stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, late: str | None) -> DataFrame:
    """rows(grp, t, ...) by grp through a processor; with ``late`` in event time, which t in ms gives."""
    if late is None:
        return rows.groupBy("grp").transformWithStateInPandas(processor, schema, "Append", "None")
    timed = rows.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    return timed.groupBy("grp").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def threshold_stream(events: DataFrame, rule: DetectionRule, late: str | None = None) -> DataFrame:
    """First firings by group of a stream of (t, idx, process, ...)."""
    n = F.coalesce(F.col("count"), F.lit(1)) if "count" in events.columns else F.lit(1)
    grp = F.col(rule.group).cast("string") if rule.group else F.lit("all")
    rows = events.where(condition(rule.match or {})).select(grp.alias("grp"), F.col("t").cast("long").alias("t"), "idx", n.cast("long").alias("n"))
    return stateful(rows, Threshold(rule, late is not None and rule.within is not None), FIRING, late)


def sequence_stream(events: DataFrame, rule: DetectionRule, key: str | None = None, late: str | None = None) -> DataFrame:
    """Completed sequences of a stream: the first completion of each first event.

    State is kept by scenario (if there is that column), the column ``key`` (if all steps share one) and the variables that all
    steps have; other variables are carried in the state of partial sequences. A step needs a value for each of its variables.
    """
    bound = [bindings(s) for s in rule.steps]
    shared = sorted(set.intersection(*(set(b) for b in bound)))
    rest = [{v: f for v, f in b.items() if v not in shared} for b in bound]
    fresh = [bool(set(r) - {v for earlier in rest[:k] for v in earlier}) for k, r in enumerate(rest)]
    text = lambda f: F.col(f).cast("string")
    keys = [*(["scenario"] if "scenario" in events.columns else []), *([key] if key else [])]

    def step(k: int) -> Column:
        there = condition(rule.steps[k])
        for f in bound[k].values():
            there = there & F.col(f).isNotNull()
        group = F.concat_ws("\x1f", F.lit(""), *map(text, keys), *(text(bound[k][v]) for v in shared)) if keys or shared else F.lit("all")
        carried = F.to_json(F.struct(*(text(f).alias(v) for v, f in sorted(rest[k].items())))) if rest[k] else F.lit("{}")
        return F.when(there, F.struct(group.alias("grp"), F.lit(k).alias("k"), carried.alias("vars")))

    n = len(rule.steps)
    fits = events.select(F.col("t").cast("long").alias("t"), F.col("idx").cast("long").alias("idx"), F.filter(F.array(*map(step, range(n))), lambda x: x.isNotNull()).alias("fits"))
    rows = fits.select("t", "idx", "fits", F.explode(F.array_distinct(F.transform("fits", lambda x: x["grp"]))).alias("grp"))
    of = lambda k: F.get(F.filter("fits", lambda x: (x["grp"] == F.col("grp")) & (x["k"] == k)), F.lit(0))["vars"]
    rows = rows.select("grp", "t", "idx", F.array(*map(of, range(n))).alias("steps"))
    return stateful(rows, Sequence(rule, fresh, late is not None and rule.within is not None), COMPLETED, late)


def rate_stream(events: DataFrame, *, late: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """(process, start, n): events by process and window of their time ``ts``."""
    return events.withWatermark("ts", late).groupBy("process", F.window("ts", width)).agg(F.count("*").alias("n")).select("process", F.col("window.start").alias("start"), "n")


def rescan(batch: DataFrame, cache: DataFrame, scan):
    """Findings of files(key, ...) that the cache does not hold, and the cache's new keys."""
    from riskframe.operators.content import incremental

    fresh, _ = incremental(batch, cache)
    return scan(fresh), fresh.select("key")


@dataclass(frozen=True)
class Batch:
    run: str
    number: int
    path: str


def whole_batches(spark: SparkSession, folder: str) -> list[Batch]:
    """The batches ``run=../batch=..`` of a folder whose write has ended."""
    path = lambda *p: spark._jvm.org.apache.hadoop.fs.Path(*p)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    ended = fs.globStatus(path(folder, "run=*/batch=*/_SUCCESS")) or []
    places = [s.getPath().getParent() for s in ended]
    return [Batch(p.getParent().getName()[4:], int(p.getName()[6:]), p.toString()) for p in places]


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches that were written whole."""
    done = [b.path for b in whole_batches(spark, folder)]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def rescan_stream(files: DataFrame, scan, cache: str, out: str, checkpoint: str, compact: int = 100):
    """A query to be started: each batch of a stream of files(key, ...) is scanned but for what earlier batches held.

    Findings go to ``out/run=../batch=n`` and then keys to ``cache/run=../batch=n``, each overwritten as a whole; a run is the life of a
    checkpoint. A batch that runs again after a failure sees the keys of earlier batches and other runs only and so writes the same
    again: no finding is lost, and none is there twice. ``committed`` reads what is whole. Every ``compact``
    batches the keys so far are also written as one, beside the cache.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        earlier = [b for b in whole_batches(spark, cache) if b.run != run or b.number < number]
        whole = [b for b in whole_batches(spark, f"{cache}-whole") if b.run == run and b.number < number]
        if whole:
            last = max(whole, key=lambda b: b.number)
            # what other runs wrote since is not in it
            earlier = [last, *(b for b in earlier if b.run != run or b.number > last.number)]
        known = spark.read.schema("key string").parquet(*(b.path for b in earlier)) if earlier else batch.select("key").where("false")
        found, keys = rescan(batch.dropDuplicates(["key"]), known, scan)
        place = f"run={run}/batch={number}"
        found.write.mode("overwrite").parquet(f"{out}/{place}")
        keys.write.mode("overwrite").parquet(f"{cache}/{place}")
        if compact and number and number % compact == 0:
            own = spark.read.parquet(f"{cache}/{place}").select("key")
            known.unionByName(own).distinct().write.mode("overwrite").parquet(f"{cache}-whole/{place}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
