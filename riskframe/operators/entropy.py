"""Min-entropy of sample sources by the estimators of NIST SP 800-90B, section 6.3.

Counting estimators are aggregations over (source, i, sym). The order-dependent predictors look at one data set's
sequence as arrays, a grouped function each; sources, data sets and estimators run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.operators.suffixes import prefixes_of, repeats, symbol_blocks
from riskframe.shipping import ship
from riskframe.steps import cut

#: The 0.995 quantile of the normal distribution.
Z = 2.5758293035489008
TUPLE_LEAST = 35
#: Samples of a data set.
DATA_SET = 1_000_000
#: Places of a source that one window sorts.
RANGE = 1 << 16
#: Different symbols of all sources that may be broadcast.
BROADCAST_CODES = 100_000


def upper(p, n):
    return F.least(F.lit(1.0), p + Z * F.sqrt(p * (1 - p) / (n - 1)))


def mcv(samples: DataFrame) -> DataFrame:
    """(source_id, h): the most common value."""
    counts = samples.groupBy("source_id", "sym").agg(F.count("*").alias("c"))
    top = counts.groupBy("source_id").agg(F.max("c").alias("mode"), F.sum("c").alias("n"))
    return top.select("source_id", (-F.log2(upper(F.col("mode") / F.col("n"), F.col("n")))).alias("h"))


def markov(bits: DataFrame) -> DataFrame:
    """(source_id, h) of bits(source_id, i, bit): the likeliest of six paths of 128 steps."""
    # by ranges of places: a range's last bit is followed by the first one of the next range that has any
    rows = bits.select("source_id", "i", "bit", F.floor(F.col("i") / RANGE).alias("range"))
    firsts = rows.groupBy("source_id", "range").agg(F.min_by("bit", "i").alias("first"))
    firsts = firsts.select("source_id", "range", F.lead("first").over(Window.partitionBy("source_id").orderBy("range")).alias("after"))
    nxt = F.coalesce(F.lead("bit").over(Window.partitionBy("source_id", "range").orderBy("i")), "after")
    n = lambda a, b: F.sum(F.when((F.col("bit") == a) & (F.col("nxt") == b), 1).otherwise(0)).cast("double")
    c = rows.join(firsts, ["source_id", "range"]).withColumn("nxt", nxt).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("bit").cast("double").alias("ones"), *(n(a, b).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    p1 = F.col("ones") / F.col("n")
    # logarithms, so that a path of 128 steps does not vanish; an impossible step is minus infinity
    log = lambda x: F.when(x > 0, F.log2(x)).otherwise(float("-inf"))
    p = lambda a, b: log(F.col(f"c{a}{b}") / F.nullif(F.col(f"c{a}0") + F.col(f"c{a}1"), F.lit(0.0)))
    paths = [
        log(1 - p1) + 127 * p(0, 0),
        log(1 - p1) + 64 * p(0, 1) + 63 * p(1, 0),
        log(1 - p1) + p(0, 1) + 126 * p(1, 1),
        log(p1) + p(1, 0) + 126 * p(0, 0),
        log(p1) + 64 * p(1, 0) + 63 * p(0, 1),
        log(p1) + 127 * p(1, 1),
    ]
    return c.select("source_id", F.least(F.lit(1.0), -F.greatest(*paths) / 128).alias("h"))


def tuple_counts(samples: DataFrame) -> DataFrame:
    """(source_id, w, n, q, s, total): for each tuple length w the tuples, the highest count q and the pairs s of equal ones.

    Lengths go on as long as a tuple repeats, however long that is; a source in which none does has no row. ``i`` numbers the
    samples of a source from 0.
    """
    blocks = cut(symbol_blocks(samples))
    sizes = blocks.groupBy("source_id").agg((F.sum(F.length("names")) / 8).cast("long").alias("total"))
    found = repeats(prefixes_of(blocks))
    return found.join(sizes, "source_id").select("source_id", F.col("w").cast("int").alias("w"), (F.col("total") - F.col("w") + 1).alias("n"), "q", F.col("s").cast("double").alias("s"), "total")


def tuples(counts: DataFrame) -> DataFrame:
    """(source_id, t_tuple, lrs) of tuple_counts."""
    often = F.col("q") >= TUPLE_LEAST
    p = F.max(F.when(often, F.pow(F.col("q") / F.col("n"), 1 / F.col("w")))).alias("p")
    r = F.max(F.when(~often, F.pow(F.col("s") / (F.col("n") * (F.col("n") - 1) / 2), 1 / F.col("w")))).alias("r")
    each = counts.groupBy("source_id").agg(p, r, F.max("total").alias("total"))
    return each.select("source_id", (-F.log2(upper(F.col("p"), F.col("total")))).alias("t_tuple"), (-F.log2(upper(F.col("r"), F.col("total")))).alias("lrs"))


def collision_h(s: np.ndarray) -> float:
    times, i = [], 0
    while i + 1 < len(s):
        step = 2 if s[i] == s[i + 1] else 3
        if i + step > len(s):
            break
        times.append(step)
        i += step
    t = np.array(times, float)
    if len(t) < 2:
        return math.nan
    low = t.mean() - Z * t.std(ddof=1) / math.sqrt(len(t))
    p = 0.5 + math.sqrt(1.25 - 0.5 * low) if low < 2.5 else 0.5
    return -math.log2(min(p, 1.0))


def compression_h(s: np.ndarray, b: int = 6, d: int = 1000) -> float:
    n = len(s) // b
    if n <= d + 1:
        return math.nan
    blocks = s[: n * b].reshape(n, b) @ (1 << np.arange(b - 1, -1, -1))
    last = np.zeros(1 << b, np.int64)
    gaps = []
    for i, x in enumerate(blocks, 1):
        if i > d:
            gaps.append(i - last[x] if last[x] else i)
        last[x] = i
    logs = np.log2(np.array(gaps, float))
    v, mean = len(logs), math.fsum(logs) / len(logs)
    sigma = 0.5907 * math.sqrt(math.fsum(logs * logs) / (v - 1) - mean * mean)
    low = mean - Z * sigma / math.sqrt(v)
    u = np.arange(1, n + 1, dtype=float)
    log_u = np.log2(u)

    def g(z: float) -> float:
        power = (1 - z) ** (u - 1)
        inner = np.cumsum(log_u * power) * z * z
        return (math.fsum(inner[d - 1 : n - 1]) + math.fsum((log_u * power * z)[d:n])) / v

    k = 1 << b
    f = lambda p: g(p) + (k - 1) * g((1 - p) / (k - 1))
    lo, hi = 1 / k, 1.0
    if f(lo) < low:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > low else (lo, mid)
    return -math.log2((lo + hi) / 2) / b


def prediction_h(correct: np.ndarray, k: int, n: int | None = None) -> float:
    """From which predictions were right: the larger of the global rate and what the longest run allows.

    n: the number of predictions, if some were left out of correct because they neither lengthen nor end a run.
    """
    n, c = len(correct) if n is None else n, int(correct.sum())
    if not n:
        return math.nan
    p = c / n
    top = 1 - 0.01 ** (1 / n) if c == 0 else min(1.0, p + Z * math.sqrt(p * (1 - p) / (n - 1)))
    edges = np.flatnonzero(np.diff(np.r_[0, correct.astype(np.int8), 0]))
    r = int((edges[1::2] - edges[::2]).max(initial=0)) + 1

    def unlikely(q: float) -> float:
        x = 1.0
        for _ in range(64):
            x = 1 + (1 - q) * q**r * x ** (r + 1)
        return math.log1p(-q * x) - math.log((r + 1 - r * x) * (1 - q)) - (n + 1) * math.log(x)

    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        try:
            ok = unlikely(mid) > math.log(0.99)
        except (ValueError, OverflowError):
            ok = False
        lo, hi = (mid, hi) if ok else (lo, mid)
    return -math.log2(max(top, lo, 1 / k))


def followed(right: np.ndarray, scores: np.ndarray, winner: int) -> np.ndarray:
    """Who is followed after each step of right(predictor, step), scores being the sums so far; ``winner`` is followed before.

    The one followed always has the highest score. Of those that were right and now have it, the last is followed.
    """
    best = right & (scores == scores.max(axis=0))
    last = len(best) - 1 - best[::-1].argmax(axis=0)
    at = np.maximum.accumulate(np.where(best.any(axis=0), np.arange(best.shape[1]), -1))
    return np.where(at < 0, winner, last[at])


def chosen_right(right: np.ndarray, scores: np.ndarray, winner: int) -> tuple[np.ndarray, np.ndarray]:
    """For each step the predictor followed until then, and whether it was right."""
    after = followed(right, scores, winner)
    before = np.r_[winner, after[:-1]].astype(int)
    return after, right[before, np.arange(right.shape[1])]


def lag_h(s: np.ndarray, k: int, depth: int = 128, step: int = 1 << 14) -> float:
    totals, winner, correct = np.zeros((depth, 1), np.int64), 0, []
    # what lies before the first sample equals no symbol
    padded = np.r_[np.full(depth, -1), s].astype(np.int64)
    for start in range(1, len(s), step):
        now = s[start : start + step]
        right = np.stack([padded[start + depth - 1 - d : start + depth - 1 - d + len(now)] == now for d in range(depth)])
        scores = totals + np.cumsum(right, axis=1)
        after, ok = chosen_right(right, scores, winner)
        totals, winner = scores[:, -1:], int(after[-1])
        correct.append(ok)
    return prediction_h(np.concatenate(correct) if correct else np.zeros(0, bool), k)


def multi_mcw_h(s: np.ndarray, k: int, windows: tuple[int, ...] = (63, 255, 1023, 4095)) -> float:
    n = len(s)
    if n <= windows[0] + 1:
        return math.nan
    best, latest, guess = np.full((len(windows), n), -1), np.full((len(windows), n), -2), np.full((len(windows), n), -1)
    for x in range(k):
        hit = s == x
        # how often, and where last, x stands before each place
        seen = np.r_[0, np.cumsum(hit)]
        last = np.r_[-1, np.maximum.accumulate(np.where(hit, np.arange(n), -1))[:-1]]
        for j, w in enumerate(windows):
            if w >= n:
                continue
            count = seen[w:n] - seen[: n - w]
            better = (count > best[j, w:]) | ((count == best[j, w:]) & (last[w:] > latest[j, w:]))
            best[j, w:][better], latest[j, w:][better], guess[j, w:][better] = count[better], last[w:][better], x
    right = (guess == s)[:, windows[0] :]
    return prediction_h(chosen_right(right, np.cumsum(right, axis=1), 0)[1], k)


def contexts(s: np.ndarray, k: int, depth: int):
    """For each length from 1 to depth the symbols before each place, from that of this length on, as a number."""
    now = np.zeros(len(s), np.int64)
    size = 1
    for d in range(1, depth + 1):
        # the shorter context that ends a place earlier, then the last symbol
        now = now[:-1] * k + s[d - 1 : -1]
        size *= k
        if size > 1 << 32:
            now = np.unique(now, return_inverse=True)[1]
            size = len(s)
        yield d, now


def groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal numbers together, by place within, and where groups start in it."""
    order = np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")
    y = x[order]
    return order, np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)


def running(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place how many of its group lie before it."""
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
    return out


def champions(context: np.ndarray, x: np.ndarray, k: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, symbol) of the most frequent symbol, ties to the larger, that followed each place's context before; count 0 if none.

    ``counts``: how often the place's symbol has followed its context by then, itself included; 0 if it does not count.
    """
    order, starts = groups(context)
    code = np.where(counts > 0, counts * k + x, 0)[order]
    # counts only grow, so the largest code so far is the most frequent symbol's; a group's codes lie above those of all before
    shift = (np.cumsum(starts) - 1) * ((len(x) + 1) * k)
    top = np.maximum.accumulate(code + shift)
    before = np.where(starts, 0, np.r_[0, top[:-1]] - shift)
    out = np.empty(len(x), np.int64)
    out[order] = before
    return out // k, out % k


def multi_mmc_h(s: np.ndarray, k: int, depth: int = 16, most: int = 100_000) -> float:
    """Markov models of all depths; a deeper context is known only where the shallower ones are. Of each depth the first ``most`` pairs of context and symbol are kept."""
    n = len(s)
    if n <= depth + 1:
        return math.nan
    right, known = np.zeros((depth, n - 2), bool), np.zeros((depth, n - 2), bool)
    full = []
    for d, context in contexts(s, k, depth):
        x = s[d:]
        order, starts = groups(context * k + x)
        nth = running(order, starts)
        fresh = np.cumsum(nth == 0)
        full.append(d + int(np.searchsorted(fresh, most)) if fresh[-1] >= most else n)
        # a pair that came first when all places were taken never counts
        kept = np.empty(len(x), bool)
        firsts = order[starts]
        kept[order] = np.repeat(fresh[firsts] <= most, np.diff(np.r_[np.flatnonzero(starts), len(x)]))
        count, guess = champions(context, x, k, np.where(kept, nth + 1, 0))
        # the first place only fills the model
        at = slice(max(2 - d, 1), None)
        known[d - 1, n - 2 - len(x[at]) :] = count[at] > 0
        right[d - 1, n - 2 - len(x[at]) :] = (count[at] > 0) & (guess[at] == x[at])
    if any(a < b for a, b in zip(full, full[1:])):
        # a depth is full before the next one: what is under it is forgotten, one symbol after the other
        return multi_mmc_by_steps(s, k, depth, most)
    # deeper contexts are known only where the shallower ones are, since those came with them
    after, ok = chosen_right(right, np.cumsum(right, axis=1), 0)
    before = np.r_[0, after[:-1]].astype(int)
    return prediction_h(ok[known[before, np.arange(n - 2)]], k, n - 2)


def multi_mmc_by_steps(s: np.ndarray, k: int, depth: int, most: int) -> float:
    """multi_mmc_h, one symbol after the other."""
    text = s.tolist()
    if len(text) <= depth + 1:
        return math.nan
    seen: list[dict[tuple, dict[int, int]]] = [{tuple(text[: d + 1]): {text[d + 1]: 1}} for d in range(depth)]
    scores, winner, entries = [0] * depth, 0, [1] * depth
    correct = []
    for i in range(2, len(text)):
        x, chosen, known = text[i], winner, True
        for d in range(min(depth, i - 1)):
            key = tuple(text[i - d - 1 : i])
            old = seen[d].get(key) if known else None
            known = old is not None
            if known:
                right = max(old.items(), key=lambda e: (e[1], e[0]))[0] == x
                if right:
                    scores[d] += 1
                    if scores[d] >= scores[winner]:
                        winner = d
                if d == chosen:
                    correct.append(right)
                if x in old:
                    old[x] += 1
                elif entries[d] < most:
                    old[x] = 1
                    entries[d] += 1
            elif entries[d] < most:
                # a context that was known before, under an unknown shallower one, starts anew
                seen[d].setdefault(key, {})[x] = 1
                entries[d] += 1
    return prediction_h(np.array(correct, bool), k, len(text) - 2)


def lz78y_h(s: np.ndarray, k: int, depth: int = 16, most: int = 65_536) -> float:
    """The most frequent followers of all contexts, longest first; the first ``most`` contexts of any length are kept."""
    n = len(s)
    if n <= depth + 1:
        return prediction_h(np.zeros(0, bool), k)
    tables, firsts = [], []
    for d, context in contexts(s, k, depth):
        # from the place at which the longest context is whole
        context = context[depth - d :]
        order, starts = groups(context)
        first = np.empty(len(context), np.int64)
        first[order] = np.repeat(order[starts], np.diff(np.r_[np.flatnonzero(starts), len(order)]))
        # a place's longer contexts come first
        tables.append((context, first * depth + depth - d))
        firsts.append(order[starts] * depth + depth - d)
    firsts = np.concatenate(firsts)
    limit = np.partition(firsts, most - 1)[most - 1] if len(firsts) > most else firsts.max()
    x = s[depth:]
    best, guess = np.zeros(len(x), np.int64), np.full(len(x), -1)
    for context, came in reversed(tables):
        nth = running(*groups(context * k + x))
        count, symbol = champions(context, x, k, np.where(came <= limit, nth + 1, 0))
        better = count > best
        best, guess = np.where(better, count, best), np.where(better, symbol, guess)
    return prediction_h((guess == x)[1:], k)


SEQUENTIAL = {"collision": lambda s, k: collision_h(s), "compression": lambda s, k: compression_h(s), "lag": lag_h, "multi_mcw": multi_mcw_h, "multi_mmc": multi_mmc_h, "lz78y": lz78y_h}
BINARY_ONLY = ("collision", "compression")


def sequential(samples: DataFrame, estimators: tuple[str, ...] = tuple(SEQUENTIAL)) -> DataFrame:
    """(source_id, data_set, estimator, h) of samples(source_id, i, sym) by order-dependent estimators; two of them take bits only.

    A data set is a million consecutive samples (the standard's size), so no group is larger, and all samples are used.
    """
    ship(samples.sparkSession)

    def glue(key, frame: pd.DataFrame) -> pd.DataFrame:
        symbols, codes = np.unique(frame.sort_values("i")["sym"].to_numpy(), return_inverse=True)
        return pd.DataFrame({"source_id": [key[0]], "data_set": [key[1]], "k": [len(symbols)], "codes": [codes.astype("<i4").tobytes()]})

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        name, k, s = key[2], int(frame["k"].iloc[0]), np.frombuffer(frame["codes"].iloc[0], "<i4").astype(np.int64)
        h = math.nan if k < 2 or (name in BINARY_ONLY and k != 2) else SEQUENTIAL[name](s, k)
        return pd.DataFrame({"source_id": [key[0]], "data_set": [key[1]], "estimator": [name], "h": [None if math.isnan(h) else h]})

    # samples are shuffled once; estimators get a data set as one value
    sets = samples.select(F.col("source_id").cast("string").alias("source_id"), F.floor(F.col("i") / DATA_SET).alias("data_set"), "i", "sym")
    sets = sets.groupBy("source_id", "data_set").applyInPandas(glue, "source_id string, data_set long, k int, codes binary")
    wide = sets.withColumn("estimator", F.explode(F.array(*map(F.lit, estimators))))
    return wide.groupBy("source_id", "data_set", "estimator").applyInPandas(run, "source_id string, data_set long, estimator string, h double")


def to_bits(samples: DataFrame, width: int | str) -> DataFrame:
    """(source_id, i, bit): the bits of symbols, the highest first. The width is a number or a column's name."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    bits = samples.select("source_id", "i", "sym", w.alias("__w")).select("*", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)).alias("j"))
    return bits.select("source_id", (F.col("i") * F.col("__w") + F.col("j")).alias("i"), F.expr("getbit(sym, __w - 1 - j)").cast("int").alias("bit"))


def restart_counts(samples: DataFrame, n: int) -> DataFrame:
    """(source_id, matrix, x_max): the highest count of a symbol in a row or column of each n by n restart matrix; n * n samples make one."""
    cells = samples.select("source_id", F.floor(F.col("i") / (n * n)).alias("matrix"), F.floor(F.col("i") % (n * n) / n).alias("row"), (F.col("i") % n).alias("col"), "sym")
    rows = cells.groupBy("source_id", "matrix", F.col("row").alias("k"), "sym").count()
    columns = cells.groupBy("source_id", "matrix", F.col("col").alias("k"), "sym").count()
    return rows.unionByName(columns).groupBy("source_id", "matrix").agg(F.max("count").alias("x_max"))


def restart_cutoff(spark, n: int, h: float, *, alpha: float = 0.01, rounds: int = 20_000, seed: int = 1) -> int:
    """The count that the largest of a row's symbols exceeds with probability alpha / (symbols of 2n rows), by simulation.

    Rounds are spread over tasks; only how often each count was the largest comes back.
    """
    p = 2.0**-h
    k = max(1, math.ceil(1 / p))
    level = 1 - math.exp(math.log1p(-alpha) / (k * n))
    ship(spark)

    def simulate(batches):
        for frame in batches:
            rng = np.random.default_rng(seed + int(frame["id"].iloc[0]))
            parts = np.full(k, (1 - p) / max(1, k - 1)) if k > 1 else np.ones(1)
            parts[0] = p
            counts = rng.multinomial(n, parts / parts.sum(), size=len(frame)).max(axis=1)
            yield pd.DataFrame({"x": counts.astype("int64")})

    found = spark.range(rounds).mapInPandas(simulate, "x long").groupBy("x").count()
    ranked = found.withColumn("above", F.sum("count").over(Window.orderBy(F.desc("x"))))
    return ranked.where(F.col("above") <= max(1.0, level * rounds)).agg(F.min("x")).first()[0] or n


def assess(samples: DataFrame, width: int | None = None, *, all_bits: bool = False) -> DataFrame:
    """(source_id, n, k, width, h_original, h_bits, h, warning): the least estimate of symbols and, per bit times width, of bits.

    A source's width is that given, or the least of 1 to 8 bits that holds its largest symbol; symbols are cut to it. k is the number
    of different ones. Symbols take most common value, t-tuple, longest repeated substring and the predictors, and if there are two
    of them also collision, Markov and compression; bits, of sources with more, take all. Of the bits the first million count, or all.
    A source of one symbol has no estimate: h is 0. No estimate exceeds the width.
    """
    name = F.col("source_id").cast("string")
    widths = samples.groupBy(name.alias("source_id")).agg(F.count("*").alias("n"), F.max("sym").alias("top"))
    least = F.greatest(F.lit(1), F.least(F.lit(8), F.length(F.bin(F.col("top").cast("long")))))
    widths = widths.select("source_id", "n", (F.lit(width) if width else least).cast("int").alias("width"))
    # a row for each source
    cut_to = samples.select(name.alias("source_id"), F.col("i").cast("long").alias("i"), F.col("sym").cast("long").alias("sym")).join(widths, "source_id")
    cut_to = cut_to.withColumn("sym", F.col("sym").bitwiseAND(F.expr("shiftleft(1, width) - 1")))
    codes = cut_to.select("source_id", "sym").distinct()
    order = Window.partitionBy("source_id")
    codes = codes.select("source_id", "sym", (F.dense_rank().over(order.orderBy("sym")) - 1).cast("int").alias("code"), F.count("*").over(order).alias("k"))
    rows = cut_to.join(F.broadcast(codes) if codes.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES else codes, ["source_id", "sym"])
    rows = cut(rows.select("source_id", "i", "sym", "code", "k", "width"))
    sizes = cut(widths.join(rows.groupBy("source_id").agg(F.first("k").alias("k")), "source_id"))

    def row(h: DataFrame, estimator: str) -> DataFrame:
        return h.select("source_id", F.lit(estimator).alias("estimator"), "h")

    def every(s: DataFrame) -> DataFrame:
        t = tuples(tuple_counts(s))
        out = sequential(s).select("source_id", "estimator", "h")
        for part in (row(mcv(s), "mcv"), row(t.select("source_id", F.col("t_tuple").alias("h")), "t_tuple"), row(t.select("source_id", F.col("lrs").alias("h")), "lrs"), row(markov(s.withColumnRenamed("sym", "bit")), "markov")):
            out = out.unionByName(part)
        return out

    original = every(rows.where("k > 1").select("source_id", "i", F.col("code").alias("sym")))
    original = original.join(sizes, "source_id").where(F.col("k").eqNullSafe(2) | ~F.col("estimator").isin(*BINARY_ONLY, "markov"))
    bits = to_bits(rows.where("k > 2"), "width")
    binary = every((bits if all_bits else bits.where(F.col("i") < DATA_SET)).withColumnRenamed("bit", "sym"))
    a = original.groupBy("source_id").agg(F.least(F.min("h"), F.first("width").cast("double")).alias("h_original"))
    b = binary.groupBy("source_id").agg(F.least(F.min("h"), F.lit(1.0)).alias("h_bits"))
    h = F.when(F.col("k") < 2, 0.0).otherwise(F.least(F.col("width").cast("double"), "h_original", F.col("h_bits") * F.col("width")))
    return sizes.join(a, "source_id", "left").join(b, "source_id", "left").select("source_id", "n", "k", "width", "h_original", "h_bits", h.alias("h"), (F.col("n") < DATA_SET).alias("warning"))
