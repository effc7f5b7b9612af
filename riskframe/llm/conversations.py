"""Repair of the turn structure of conversations: the cheapest edits that give ``(s?(ua)+)?``, found by branch-and-bound.

Rows are sorted by range and numbered, so a conversation of any length is spread over tasks; 1024 numbers in a row are a block.
The part of a conversation that lies in a block is solved by itself, for each state in which it can be entered and left. Only
16 costs a block are then put together for a conversation that has several blocks, and texts are not touched until its repaired
rows are streamed in order.

An edit is Keep, Rerole (to what the structure wants), Delete or Insert (an empty text). States are the last role that stands:
nothing, s, u or a. Insertions count to the row that follows, so parts of different blocks always end with a row's edit, and two
ways through a block from the same state differ in one of its rows: the ASCII-least whole is made of choices within blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import BATCH_BYTES, Work, bounded, in_batches, sliced
from riskframe.shipping import ship

#: Rows are solved together in blocks of 2 to the power of this.
BLOCK_BITS = 10
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States as the bound sees them: a system row counts as an answer, which allows one end too many and so never bounds too high.
SEEN = {START: 0, USER: 1, ASSISTANT: 2, SYSTEM: 2}
#: The end of a conversation, as a state to leave by.
END = -1


def wanted(state: int) -> int:
    """The role that comes next, but for a system row at the start."""
    return ASSISTANT if state == USER else USER


def row_edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state) for a row, in ASCII order."""
    yield "D", DELETE, state
    if fault in "bd":
        return
    more = CUT_SHORT if fault == "t" else 0
    if state == START and initial == "s":
        yield "K", KEEP + more, SYSTEM
    elif initial == "?sua"[wanted(state)]:
        yield "K", KEEP + more, wanted(state)
    yield "R", REROLE + more, wanted(state)


def suffix_bounds(initials: str, faults: str, leave: int) -> list[tuple[float, float, float]]:
    """For each row and seen state at least what the rows from there on cost."""
    if leave == END:
        low = (0.0, float(INSERT), 0.0)
    else:
        low = tuple(0.0 if SEEN[leave] == k else inf for k in range(3))
    out = [low]
    for c, f in zip(reversed(initials), reversed(faults), strict=True):
        at = [min(cost + low[SEEN[to]] for _, cost, to in row_edits(c, f, state)) for state in (START, USER, ASSISTANT)]
        low = (min(at[0], INSERT + at[1], 2 * INSERT + at[2]), min(at[1], INSERT + at[2]), min(at[2], INSERT + at[1]))
        out.append(low)
    return out[::-1]


def solve(initials: str, faults: str, enter: int, leave: int) -> tuple[int, str] | None:
    """The least cost and, of its audits, the ASCII-least, from one state to another; None if there is no way.

    Depth first with an explicit stack. The likeliest edit is tried first, so that the incumbent is near the best from the
    start. A prefix goes if its bound can't beat the incumbent (cost, audit), or if its node was reached no dearer before:
    two prefixes of equal cost at a node have as many edits, so the ASCII-lesser one stays so whatever follows.
    """
    bounds, n = suffix_bounds(initials, faults, leave), len(initials)
    best: tuple[float, str] = (inf, "")
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, enter, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bounds[i][SEEN[state]]
        if least == inf or (least, audit) >= best:
            continue
        node = (i, state)
        if node in reached and reached[node] <= (cost, audit):
            continue
        reached[node] = (cost, audit)
        if i == n and (state in (START, ASSISTANT) if leave == END else state == leave):
            best = (cost, audit)
            continue
        steps = [] if i == n else [(i + 1, to, cost + more, audit + edit) for edit, more, to in row_edits(initials[i], faults[i], state)]
        if i < n or leave == END:
            steps.append((i, wanted(state), cost + INSERT, audit + "I"))
        steps.sort(key=lambda x: (x[2] + bounds[x[0]][SEEN[x[1]]], x[3]), reverse=True)
        stack += steps
    return None if best[0] == inf else (int(best[0]), best[1])


def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ways through the parts of a batch: (conv, block, enter, leave, cost, audit, place among the audits of its entry)."""
    rows = []
    for conv, block, initials, faults, first, last in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "initials", "faults", "first", "last")), strict=True):
        for enter in (START,) if first else range(4):
            ways = [(leave, solve(initials, faults, enter, leave)) for leave in ((END,) if last else range(4))]
            ways = sorted((way[1], leave, way[0]) for leave, way in ways if way)
            rows += [(conv, block, enter, leave, cost, audit, place) for place, (audit, leave, cost) in enumerate(ways)]
    return pa.RecordBatch.from_pylist([dict(zip(WAYS.names, r, strict=True)) for r in rows], WAYS)


WAYS = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("place", pa.int32())])


def through(key: tuple, ways: pd.DataFrame) -> pd.DataFrame:
    """The states by which a conversation's best way enters and leaves each of its blocks."""
    blocks = [(b, list(w[["enter", "leave", "cost", "place"]].itertuples(index=False, name=None))) for b, w in ways.sort_values("block").groupby("block")]
    ahead: list[dict[int, float]] = [{END: 0.0}]
    for _, own in reversed(blocks):
        low: dict[int, float] = {}
        for enter, leave, cost, _ in own:
            low[enter] = min(low.get(enter, inf), cost + ahead[-1].get(leave, inf))
        ahead.append(low)
    ahead.reverse()
    state, out = START, []
    for k, (b, own) in enumerate(blocks):
        leave = min((cost + ahead[k + 1].get(leave, inf), place, leave) for enter, leave, cost, place in own if enter == state)[2]
        out.append((b, state, leave))
        state = leave
    found = pd.DataFrame(out, columns=["block", "enter", "leave"])
    found.insert(0, "conv", pd.array([None if pd.isna(key[0]) else int(key[0])] * len(found), dtype="Int64"))
    return found


def edited(conv: int | None, start: int, initials: str, enter: int, audit: str) -> Iterator[tuple]:
    """(conv, pos, step, edit, role) of a block's audit. An insertion has the number of the row that it precedes, or of the last row."""
    state, at = enter, 0
    for step, edit in enumerate(audit):
        pos, role = start + min(at, len(initials) - 1), None
        if edit == "K" and state == START and initials[at] == "s":
            state = SYSTEM
        elif edit != "D":
            state = wanted(state)
            role = None if edit == "K" else ROLE[state]
        at += edit != "I"
        yield conv, pos, step, edit, role


STEPS = pa.schema([("conv", pa.int64()), ("pos", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string())])


def steps_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = zip(*(batch.column(c).to_pylist() for c in ("conv", "start", "initials", "enter", "audit")), strict=True)
    rows = [x for row in columns for x in edited(*row)]
    return pa.RecordBatch.from_pylist([dict(zip(STEPS.names, r, strict=True)) for r in rows], STEPS)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(conv, role, text) of each repaired row, from rows (edit is null) each followed by its edits; (conv, None, None) at each row, so that no conversation is missed."""
    own_role = own_text = ""
    for batch in batches:
        for part in sliced(batch):
            for conv, edit, role, text in zip(*(part.column(c).to_pylist() for c in ("conv", "edit", "role", "text")), strict=True):
                if edit is None:
                    own_role, own_text = role, text
                    yield conv, None, None
                elif edit != "D":
                    yield conv, role or own_role, "" if edit == "I" else own_text


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, last, place = [], 0, (), 0
    names = ["conv", "place", "role", "text"]
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for conv, role, text in stream(batches):
        if last != (conv,):
            last, place = (conv,), 0
        if role is None:
            continue
        held.append(dict(zip(names, (conv, place, role, text), strict=True)))
        place += 1
        size += len(text) + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def repaired_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 by conversation of its repaired ``role:text`` lines. It is fed line by line: nothing of a conversation is held."""
    found, last, digest, begun = [], (), None, False
    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for conv, role, text in stream(batches):
        if last != (conv,):
            if last:
                found.append({"conv": last[0], "repaired_sha256": digest.hexdigest()})
            last, digest, begun = (conv,), hashlib.sha256(), False
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if role is not None:
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
    if last:
        found.append({"conv": last[0], "repaired_sha256": digest.hexdigest()})
    yield pa.RecordBatch.from_pylist(found, schema)


class Repair:
    """The repair of conversations.

    ``rows``: (conv, pos, turn, role, text), numbered in order. ``blocks``: the parts of conversations with their initials, faults,
    cost and audit. ``steps``: (conv, pos, step, edit, role), the edits of each row, insertions among them. ``repaired`` and
    ``report`` derive results from them.

    A null in role or text is one space. Rows go by turn (nulls first), then by role and text, so that equal rows are neighbours
    and ties have an order (by the first 256 characters of a text, then by its digest). A null id is one conversation.
    A role counts by its first character; one without any can't be kept. An empty table gives no rows. Other columns are ignored.
    A conversation is spread over tasks but for its final hash, which is one pass over its rows by nature, and its audit, one cell.
    """

    def __init__(self, rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        work = Work(rows.sparkSession, "conversations")
        filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
        rows = rows.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
        rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
        # equal rows may be many: a number that differs spreads them
        rows = rows.withColumn("salt", F.monotonically_increasing_id())
        order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 256), F.col("digest"), F.col("salt")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("salt")
        self.rows = rows = work.save(rows, "rows")
        # many tasks, however few bytes: the search costs more than reading
        parts = self.parts(rows).repartition(int(work.spark.conf.get("spark.sql.shuffle.partitions")), "conv", "block")
        self.blocks = work.save(self.chosen(work, work.save(parts, "parts")), "chosen")
        self.steps = in_batches(self.blocks.select("conv", "start", "initials", "enter", "audit"), steps_of, "conv long, pos long, step int, edit string, role string")

    @staticmethod
    def parts(rows: DataFrame) -> DataFrame:
        """What lies of a conversation in a block: its first number, the rows' initials (``-``: none of s, u, a) and first faults."""
        seen = rows.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
        initial = F.substring("role", 1, 1)
        initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
        last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
        compact = rows.select("conv", "pos", initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_short")).join(seen, "pos", "left")
        fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("cut_short"), "t").otherwise(".")
        # a block has at most 2 ** BLOCK_BITS rows
        blocks = compact.groupBy("conv", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault")))).alias("x"))
        glued = lambda field: F.array_join(F.col(f"x.{field}"), "")
        blocks = blocks.select("conv", "block", F.col("x")[0]["pos"].alias("start"), glued("initial").alias("initials"), glued("fault").alias("faults"))
        order = Window.partitionBy("conv").orderBy("block")
        before = F.lag(F.substring("initials", -1, 1)).over(order)
        return blocks.select("*", F.coalesce(before, F.lit("")).alias("before"), before.isNull().alias("first"), F.lead("block").over(order).isNull().alias("last"))

    @staticmethod
    def chosen(work: Work, parts: DataFrame) -> DataFrame:
        """parts with state of entry, cost and audit of the best way through each."""
        wayside = "conv long, block long, enter int, leave int, cost long, audit string, place int"
        ways = work.save(in_batches(parts.select("conv", "block", "initials", "faults", "first", "last"), solved, wayside), "ways")
        same = lambda *names: [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]
        own = parts.select(F.col("conv").alias("own_conv"), F.col("block").alias("own_block"), "start", "initials", "faults", "before", "first", "last")
        ways = ways.join(own, same("conv", "block")).drop("own_conv", "own_block")
        alone = F.col("first") & F.col("last")
        several = ways.where(~alone)
        path = several.select("conv", "block", "enter", "leave", "cost", "place").groupBy("conv").applyInPandas(through, "conv long, block long, enter int, leave int")
        path = path.select(*(F.col(c).alias(f"own_{c}") for c in path.columns))
        several = several.join(path, same("conv", "block", "enter", "leave"), "left_semi")
        return ways.where(alone).unionByName(several)

    def lines(self) -> DataFrame:
        """Rows, each followed by its edits, conversation by conversation."""
        steps = self.steps.select("conv", "pos", "step", "edit", "role", F.lit(None).cast("string").alias("text"))
        rows = self.rows.select("conv", "pos", F.lit(-1).alias("step"), F.lit(None).cast("string").alias("edit"), "role", "text")
        ship(self.rows.sparkSession)
        bounded(self.rows.sparkSession)
        return rows.unionByName(steps).repartition("conv").sortWithinPartitions("conv", "pos", "step")

    def repaired(self) -> DataFrame:
        """(conv, place, role, text): the rows after repair, numbered from 0."""
        return self.lines().mapInArrow(repaired_rows, "conv long, place long, role string, text string")

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation that has rows."""
        turns = self.rows.groupBy("conv").agg((F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
        pairs = F.concat("before", "initials")
        legal = F.size(F.regexp_extract_all(pairs, F.lit("s(?=u)|u(?=a)|a(?=u)"), F.lit(0)))
        n = lambda f: F.sum(F.length(F.regexp_replace("faults", f"[^{f}]", ""))).alias
        audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit")
        sums = self.blocks.groupBy("conv").agg(n("b")("blank"), n("d")("duplicate"), n("t")("truncated"), F.sum(F.length(pairs) - 1 - legal).alias("illegal"), F.sum("cost").alias("cost"), audit)
        digests = self.lines().mapInArrow(repaired_digests, "conv long, repaired_sha256 string")
        every = turns.unionByName(sums, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
        return every.groupBy("conv").agg(*(F.max(c).alias(c) for c in every.columns if c != "conv"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(rows: DataFrame, every: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """The report for each id of ``every``; one without rows has zeros, an empty audit and the hash of an empty text."""
    report = Repair(rows, id_col=id_col).report()
    ids = every.select(F.col(id_col).cast("long").alias("conv")).distinct()
    found = report.unionByName(ids, allowMissingColumns=True).groupBy("conv").agg(*(F.max(c).alias(c) for c in report.columns if c != "conv"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select(F.col("conv").alias(id_col), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
