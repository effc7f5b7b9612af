"""Cutting the lineage of iterative operators, and what they look up from round to round."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as it stands, written to the checkpoint folder that all executors share; one of our own only where none is set and the session runs on this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="riskframe-"))
    return df.checkpoint()


def beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right, which has a row for a key at most; left rows without one get nulls.

    A cut table keeps the size that Spark estimated for it, and a join's estimate is the product of its sides'. In a loop that joins
    a table with itself, such numbers get twice as many digits with each round, until they fill the driver's memory. Here rows
    meet by union and window, of which the estimates add up.
    """
    more = [c for c in right.columns if c not in on]
    both = left.withColumn("__own", F.lit(True)).unionByName(right.select(*on, F.struct(*more).alias("__more")), allowMissingColumns=True)
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    # rows without a key need not meet in one group
    order = Window.partitionBy(*on, F.when(~known, F.xxhash64(*left.columns))).orderBy(F.asc_nulls_first("__own")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__more", F.when(known, F.last("__more", ignorenulls=True).over(order))).where("__own")
    return rows.select(*left.columns, *(F.col("__more")[c].alias(c) for c in more))
