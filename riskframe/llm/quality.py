"""Quality rules: base counts, then robust multivariate outliers per language and source.

A document's statistics are transformed to a vector. For each group the minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps: the h rows nearest to the present estimate
give the next one. A step is one aggregation: rows are counted by bands of their distance, with the sums that mean
and covariance need, and the bands that hold the nearest h rows are added up for each group. So a group of any
size costs no more than its bands. Vectors are whole numbers of 1 / UNIT and their sums exact, so that equal input gives
equal verdicts, however it is dealt out.

Each group has two starts: medians and deviations of all its rows, and the best of many random subsets of a bounded sample.
Both are concentrated over all rows until the determinant falls no more; the smaller one counts. Every group has an estimate of its
own, however small; it is mixed with its language's, and that with the estimate of all rows, by numbers of rows. Outliers are told
from the rest where their language's distances are rarest: in the valley behind the bulk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import Work, few, in_batches, in_groups

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
STATISTICS = ("word_length", "symbols", "repeats", "lines", "capitals")
P = len(STATISTICS)
#: Part of a group that the estimates rest on.
PART = 0.75
#: Rows that the estimate of a wider group counts for beside a group's own: a group of n has n / (n + PRIOR_ROWS) of the say, a
#: language beside all rows likewise.
PRIOR_ROWS = 200
#: The same for the valley, which few outliers show badly: rows of all languages beside one's own.
VALLEY_ROWS = 2000
#: Vectors are rounded to whole numbers of 1 / UNIT. A product of two is below 2**28, so sums of 2**35 rows are exact.
UNIT = 1024
#: Added to each statistic's standard deviation (squared to squared), so that one that hardly varies rejects little:
#: a tenth of the size that a statistic has in junk, about.
FLOOR = np.array([0.08, 0.08, 0.08, 0.08, 0.06])
#: Bands of the squared distance for each doubling.
BANDS = 16
#: A step that lowers the logarithm of the determinant by less ends.
SETTLED = 1e-6
#: Rows of a group (those with the smallest hashes) of which random subsets start the estimate; so many subsets.
START_ROWS, SUBSETS = 512, 30
#: Squared distances of a standard normal vector: the quantiles at PART and at 0.999 of chi-squared with P degrees of freedom.
CHI2_PART, CHI2_FAR = 6.6257, 20.515
#: Bands that are looked at together for the valley: distances that differ by a quarter.
STRETCH = 10


def measure(text: str | None) -> tuple[int, ...]:
    """(words, characters in words, symbols, duplicate lines, repeated words, lines with a word, ASCII capitals)."""
    if not text:
        return (0,) * 7
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            again += line in seen
            seen.add(line)
    repeated = 0
    if n > 3:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        step = np.uint64(0x9E3779B97F4A7C15)
        windows = (h[:-2] * step + h[1:-1]) * step + h[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            inside = np.zeros(n, bool)
            for j in range(3):
                inside[j : n - 2 + j] |= twice
            repeated = int(inside.sum())
    return n, chars, sum(map(data.count, SYMBOLS.encode())), again, repeated, lines, len(data) - len(data.translate(None, UPPER))


def content_key(text_col: str, extra: tuple[str, ...] | list[str]) -> Column:
    return F.xxhash64(F.col(text_col), *(F.col(c).cast("string") for c in extra))


def measured(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """One row of counts for each row of docs, with its id, its key and the columns ``extra``."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), content_key(text_col, extra).alias("key"), *(F.col(c).cast("string").alias(f"g_{c}") for c in extra))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True))
        keep = [0, *range(2, batch.num_columns)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in found)], [*(batch.schema.names[k] for k in keep), *names])

    schema = ", ".join(["id long", "key long", *(f"g_{c} string" for c in extra), *(f"{n} long" for n in names)])
    return in_batches(source, count, schema)


def vector() -> list[Column]:
    """The transformed statistics of a row of counts, in units of 1 / UNIT."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    found = [
        F.log(chars / words),
        F.log1p(F.col("n_symbols") / words * 10),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_upper") / chars),
    ]
    return [F.round(x * UNIT).cast("long") for x in found]


MOMENTS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = ", ".join(["grp string", "start int", "spread double", *(f"m{i} double" for i in range(P)), *(f"q{i}{j} double" for i, j in MOMENTS)])


def estimate_rows(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(group, start, centre, scatter) as rows with the inverse scatter; spread is the logarithm of its determinant."""
    c = np.array([r[2] for r in rows])
    q = np.array([np.linalg.inv(r[3]) for r in rows])
    spread = [float(np.linalg.slogdet(r[3])[1]) for r in rows]
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(spread), *(pa.array(c[:, i]) for i in range(P)), *(pa.array(q[:, i, j] * (1 if i == j else 2)) for i, j in MOMENTS)]
    return pa.RecordBatch.from_arrays(columns, ["grp", "start", "spread", *(f"m{i}" for i in range(P)), *(f"q{i}{j}" for i, j in MOMENTS)])


def distance() -> Column:
    """The squared distance of x0, x1, ... under the estimate of the same row."""
    d = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    out = F.lit(0.0)
    for i, j in MOMENTS:
        out = out + F.col(f"q{i}{j}") * d[i] * d[j]
    return F.greatest(out, F.lit(0.0))


def band(squared: Column) -> Column:
    return F.floor(F.log2(squared + 2.0**-20) * BANDS)


def medians(table: pa.Table):
    """From counts by (grp, k, cell) of values: medians and deviations as a first estimate."""
    rows = []
    for name, group in table.to_pandas().groupby("grp", sort=True):
        center, scale = np.zeros(P), FLOOR.copy()
        for k, cells in group.groupby("k"):
            value, n = cells["cell"].to_numpy() / UNIT, cells["n"].to_numpy()
            order = np.argsort(value, kind="stable")
            value, n = value[order], n[order]
            center[k] = value[np.searchsorted(np.cumsum(n), n.sum() / 2)]
            off = np.abs(value - center[k])
            order = np.argsort(off, kind="stable")
            mad = off[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
            scale[k] = np.hypot(1.4826 * mad, FLOOR[k])
        rows.append((name, 0, center, np.diag(scale**2.0)))
    if rows:
        yield estimate_rows(rows)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    center = x.mean(axis=0)
    return center, (x - center).T @ (x - center) / len(x) * SHRINK + np.diag(FLOOR**2)


def best_subset(x: np.ndarray, subsets: int, part: float = PART) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter with the smallest determinant that random subsets of P + 1 rows lead to."""
    rng, best, h = np.random.default_rng(len(x)), None, max(1, int(np.ceil(part * len(x))))
    for _ in range(subsets):
        center, cov = scatter(x[rng.choice(len(x), min(len(x), P + 1), replace=False)])
        spread = np.inf
        while True:
            d = x - center
            near = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]
            center, cov = scatter(x[near])
            fresh = np.linalg.slogdet(cov)[1]
            if fresh > spread - SETTLED:
                break
            spread = fresh
        if best is None or fresh < best[0]:
            best = (fresh, center, cov)
    return best[1], best[2]


def sampled(table: pa.Table):
    """From at most START_ROWS rows of each group: the best subset's estimate."""
    rows = []
    for name, group in table.to_pandas().groupby("grp", sort=True):
        x = group[[f"x{i}" for i in range(P)]].to_numpy() / UNIT
        rows.append((name, 1, *best_subset(x, SUBSETS)))
    if rows:
        yield estimate_rows(rows)


def concentrate(table: pa.Table):
    """From counts and sums by (grp, start, band): the estimate of the nearest PART of each group, made consistent."""
    out = []
    for (name, start), rows in table.to_pandas().groupby(["grp", "start"], sort=True):
        rows = rows.sort_values("band", kind="stable")
        n = rows["n"].to_numpy()
        last = int(np.searchsorted(np.cumsum(n), PART * n.sum()))
        near = rows.iloc[: last + 1]
        count = int(near["n"].sum())
        # whole numbers, so the order of rows does not matter
        center = np.array([int(near[f"s{i}"].sum()) / count / UNIT for i in range(P)])
        cov = np.zeros((P, P))
        for i, j in MOMENTS:
            cov[i, j] = cov[j, i] = int(near[f"s{i}{j}"].sum()) / count / UNIT**2 - center[i] * center[j]
        # the nearest rows of a normal vector vary less than all: the scatter is scaled up for that
        out.append((name, start, center, cov * SHRINK + np.diag(FLOOR**2)))
    if out:
        yield estimate_rows(out)


def valley(bands: np.ndarray, n: np.ndarray) -> float:
    """The distance that parts outliers from the rest, from counts n of rows by (sorted) bands of the squared distance.

    Of all stretches of STRETCH bands behind the quantile CHI2_FAR the emptiest is taken, and of equal ones the middle of
    the first run that is at least half as long as the longest. If none has a fuller one behind it there is no valley, and the outer fence of the logarithms holds: the
    upper quartile and three times the distance of both quartiles.
    """
    first = int(np.ceil(np.log2(CHI2_FAR) * BANDS))
    root = lambda b: float(2.0 ** (b / BANDS / 2))
    far = bands >= first
    if far.any():
        counts = np.zeros(int(bands[-1]) - first + 1 + STRETCH, np.int64)
        counts[bands[far] - first] = n[far]
        sums = np.convolve(counts, np.ones(STRETCH, np.int64), "valid")
        low = int(sums.min())
        # a valley has a fuller stretch behind it
        good = (sums == low) & (np.maximum.accumulate(sums[::-1])[::-1] > low)
        at = np.flatnonzero(good)
        if len(at):
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            # the first of the wide ones: what lies behind it are outliers, whatever gaps are among them
            run = next(r for r in runs if 2 * len(r) >= max(map(len, runs)))
            return root(first + (run[0] + run[-1] + STRETCH) / 2)
    upto = np.cumsum(n)
    q1, q3 = (bands[np.searchsorted(upto, p * upto[-1])] for p in (0.25, 0.75))
    return max(root(q3 + 3 * (q3 - q1)), float(np.sqrt(CHI2_FAR)))


def valleys(table: pa.Table):
    """(pool, cutoff) from counts by (pool, band)."""
    names, cutoffs = [], []
    for name, rows in table.to_pandas().groupby("pool", sort=True):
        rows = rows.sort_values("band")
        names.append(name)
        cutoffs.append(valley(rows["band"].to_numpy(), rows["n"].to_numpy()))
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cutoffs)], ["pool", "cutoff"])


def chi2_cdf(x: float, p: int) -> float:
    """Of chi-squared with odd p degrees of freedom."""
    from math import erf, exp, gamma, sqrt

    out = erf(sqrt(x / 2))
    for k in range(1, p - 1, 2):
        out -= (x / 2) ** (k / 2) * exp(-x / 2) / gamma(k / 2 + 1)
    return out


#: PART over the variance that a normal vector keeps within its nearest PART.
SHRINK = PART / chi2_cdf(CHI2_PART, P + 2)


def beside(rows: DataFrame, small: DataFrame, by: str) -> DataFrame:
    """rows with the row of their group in a table of one row (or two) for each group.

    It is broadcast if it is counted and of a bounded size; else rows are dealt by group and salt, so that a large
    group is in many tasks.
    """
    if small.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        return rows.join(F.broadcast(small), by)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [by, "salt"]).drop("salt")


#: Estimates of so many groups (some 250 bytes each) are broadcast; parts of a group beyond that.
MOST_GROUPS, SALTS = 100_000, 64


def estimated(rows: DataFrame, work: Work) -> DataFrame:
    """(grp, m0, ..., q00, ...): the minimum-covariance-determinant estimate of each group of rows(grp, row, x0, x1, ...)."""
    xs = [f"x{i}" for i in range(P)]
    cells = rows.select("grp", F.posexplode(F.array(*xs)).alias("k", "cell")).groupBy("grp", "k", "cell").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("row", *xs), "row", *xs)
    drawn = rows.select("grp", "row", *xs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= START_ROWS)
    open_ = in_groups(cells, ["grp"], ["k", "cell"], medians, ESTIMATE).unionByName(in_groups(drawn.drop("row"), ["grp"], ["place"], sampled, ESTIMATE))
    # the first estimates rest on other rows than a step's, so their spread is no bound
    open_ = work.save(open_.withColumn("spread", F.lit(float("inf"))), "start")
    settled = None
    while not open_.isEmpty():
        near = beside(rows, open_.drop("spread"), "grp").withColumn("band", band(distance()))
        sums = near.groupBy("grp", "start", "band").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in MOMENTS))
        fresh = in_groups(sums, ["grp", "start"], ["band"], concentrate, ESTIMATE)
        both = work.save(fresh.join(open_.select("grp", "start", F.col("spread").alias("before")), ["grp", "start"]), "estimate")
        falls = F.col("spread") < F.col("before") - SETTLED
        done = both.where(~falls).drop("before")
        settled = done if settled is None else settled.unionByName(done)
        open_ = both.where(falls).drop("before")
    if settled is None:
        return open_
    best = settled.groupBy("grp").agg(F.min_by(F.struct(*(c for c in settled.columns if c != "grp")), F.struct("spread", "start")).alias("e"))
    return work.save(best.select("grp", "e.*"), "best")


def mixed_estimates(groups: DataFrame, estimate: DataFrame) -> DataFrame:
    """(grp, m0, ..., q00, ...) of groups(g2, g1, n2, n1): a group's estimate, its language's and that of all rows as one.

    The moments of a mixture: the centres' weighted mean, and the scatters' with what the centres differ by.
    """
    names = [*(f"m{i}" for i in range(P)), *(f"q{i}{j}" for i, j in MOMENTS)]
    rows = groups.withColumn("g0", F.lit(""))
    for level in ("g2", "g1", "g0"):
        rows = rows.join(estimate.select(F.col("grp").alias(level), F.array(*(F.col(n) for n in names)).alias(f"e_{level}")), level)

    def moments(x: list[float]) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.zeros((P, P))
        for (i, j), v in zip(MOMENTS, x[P:], strict=True):
            inverse[i, j] = inverse[j, i] = v if i == j else v / 2
        return np.array(x[:P]), np.linalg.inv(inverse)

    def mix(own: tuple, n: int, wide: tuple) -> tuple[np.ndarray, np.ndarray]:
        w = n / (n + PRIOR_ROWS)
        off = own[0] - wide[0]
        return w * own[0] + (1 - w) * wide[0], w * own[1] + (1 - w) * wide[1] + w * (1 - w) * np.outer(off, off)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            language = mix(moments(r["e_g1"]), r["n1"], moments(r["e_g0"]))
            out.append((r["g2"], 0, *mix(moments(r["e_g2"]), r["n2"], language)))
        return estimate_rows(out)

    return in_batches(rows.select("g2", "n2", "n1", "e_g2", "e_g1", "e_g0"), run, ESTIMATE).drop("start", "spread")


def outlier_distances(rows: DataFrame, groups: DataFrame, work: Work) -> DataFrame:
    """rows(own, pool, ...) that are judged with their robust distance from the group ``own`` and the cutoff of their ``pool``.

    rows has one row for each group ``grp`` that a document counts for; it is judged where that is its own.
    groups(g2, g1, n2, n1) are own groups, their pools, and the rows of both.
    """
    estimate = work.save(mixed_estimates(groups, estimated(rows, work)), "mixed")
    judged = beside(rows.where("grp = own"), estimate, "grp").withColumn("squared", distance())
    judged = work.save(judged.select(*rows.columns, "squared"), "distances")
    counts = work.save(judged.groupBy("pool", band(F.col("squared")).alias("band")).agg(F.count("*").alias("n")), "bands")
    every = counts.groupBy("band").agg(F.sum("n").alias("n")).select(F.lit("").alias("pool"), "band", "n")
    found = work.save(in_groups(counts.unionByName(every), ["pool"], ["band"], valleys, "pool string, cutoff double"), "valleys")
    sizes = groups.select(F.col("g1").alias("pool"), "n1").distinct()
    # one row
    of_all = found.where("pool = ''").select(F.col("cutoff").alias("wide"))
    own = F.col("n1") / (F.col("n1") + VALLEY_ROWS)
    cutoffs = work.save(found.join(sizes, "pool").crossJoin(F.broadcast(of_all)).select("pool", (own * F.col("cutoff") + (1 - own) * F.col("wide")).alias("cutoff")), "cutoffs")
    return beside(judged, cutoffs, "pool").withColumn("distance", F.sqrt("squared")).drop("squared")


JUDGED = ("id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judged(docs: DataFrame, id_col: str, text_col: str, by: tuple[str, str], cutoff: float | None, work: Work) -> DataFrame:
    """JUDGED, kept, distance and cutoff for every row of docs. key tells rows that share an id apart by what the verdict rests on."""
    rows = measured(docs, id_col, text_col, list(by)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = work.save(rows, "counts")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"g_{c}")), F.lit("-"))
    first, second = name(by[0]), F.concat_ws("\x1f", *map(name, by))
    rest = rows.where("not base_failed").withColumns({f"x{i}": x for i, x in enumerate(vector())} | {"g1": first, "g2": second})
    sizes = rest.groupBy("g1", "g2").agg(F.count("*").alias("n2"))
    larger = sizes.groupBy("g1").agg(F.sum("n2").alias("n1"))
    groups = work.save(sizes.join(larger, "g1"), "groups")
    wide = rest.withColumn("grp", F.explode(F.array("g2", "g1", F.lit("")))).withColumn("row", F.xxhash64("id", "key"))
    wide = wide.select(*JUDGED, "grp", F.col("g2").alias("own"), F.col("g1").alias("pool"), "row", *(f"x{i}" for i in range(P)))
    wide = work.save(wide, "vectors")
    found = outlier_distances(wide, groups, work)
    limit = F.col("cutoff") if cutoff is None else F.lit(float(cutoff))
    found = found.select(*JUDGED, (F.col("distance") <= limit).alias("kept"), "distance", limit.alias("cutoff"))
    none = F.lit(None).cast("double")
    return found.unionByName(rows.where("base_failed").select(*JUDGED, F.lit(False).alias("kept"), none.alias("distance"), none.alias("cutoff")))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), cutoff: float | None = None) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, cutoff) for every row.

    base_failed: under 50 words, or over half of the words in three-word windows that occur twice or more.
    A row that did not fail is kept if its robust distance from its language and source is at most ``cutoff``; by default
    that is the valley in its language's distances. Estimates and cutoffs of small groups lean on wider ones by PRIOR_ROWS and VALLEY_ROWS, with
    no bound at which that begins. A null language or source is a value of its own.
    A null text has no words, so it fails; distance and cutoff are null where the base failed.
    Repeated rows and ids get a row each. An empty table gives no rows. Other columns are ignored.
    """
    found = judged(docs, id_col, text_col, by, cutoff, Work(docs.sparkSession, "quality"))
    return found.drop("key").withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), cutoff: float | None = None) -> DataFrame:
    """docs without rejected rows; the columns and their order stay. Of rows that share an id each is judged by itself."""
    work = Work(docs.sparkSession, "quality")
    found = judged(docs, id_col, text_col, by, cutoff, work)
    gone = work.save(found.where("not kept").select("id", "key").distinct(), "gone").toDF("__id", "__key")
    same = F.col("__id").eqNullSafe(F.col(id_col).cast("long")) & (F.col("__key") == content_key(text_col, by))
    return docs.join(few(gone), same, "left_anti")
