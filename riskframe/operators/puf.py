"""Physically unclonable functions: quality of readings, and the error correction they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def exploded(puf: DataFrame) -> DataFrame:
    """(device, read, pos, bit) of readings(device, read, bits)."""
    return puf.select("device", "read", F.posexplode("bits").alias("pos", "bit"))


def reference(bits: DataFrame) -> DataFrame:
    """The lowest read of each device."""
    low = bits.groupBy("device").agg(F.min("read").alias("read"))
    return bits.join(low, ["device", "read"])


def uniformity(bits: DataFrame) -> DataFrame:
    """(device, read, ones): the part of ones in each reading."""
    return bits.groupBy("device", "read").agg(F.avg("bit").alias("ones"))


def aliasing(bits: DataFrame) -> DataFrame:
    """(pos, p, h_min): the part of devices whose reference has a one, and the min-entropy of that."""
    p = reference(bits).groupBy("pos").agg(F.avg("bit").alias("p"))
    return p.withColumn("h_min", -F.log2(F.greatest("p", 1 - F.col("p"))))


def worst_aliased(bits: DataFrame, k: int = 10) -> DataFrame:
    return aliasing(bits).orderBy(F.desc(F.abs(F.col("p") - 0.5)), "pos").limit(k)


def uniqueness(bits: DataFrame) -> DataFrame:
    """(uniqueness): the mean distance between the references of two devices.

    Of n devices with k ones at a place k (n - k) pairs differ, so counts for each place are enough and no pairs are made.
    """
    places = reference(bits).groupBy("pos").agg(F.sum("bit").alias("k"), F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return places.agg((F.sum(F.col("k") * (F.col("n") - F.col("k"))) / F.nullif(F.sum(pairs), F.lit(0.0))).alias("uniqueness"))


def reliability(bits: DataFrame) -> DataFrame:
    """(device, read, errors): the part of bits of later reads that differ from the device's reference."""
    low = reference(bits).select("device", F.col("read").alias("first"), "pos", F.col("bit").alias("was"))
    return bits.join(low, ["device", "pos"]).where("read <> first").groupBy("device", "read").agg(F.avg((F.col("bit") != F.col("was")).cast("double")).alias("errors"))


def unstable(bits: DataFrame) -> DataFrame:
    """(unstable): the part of a device's bits that are not the same in all reads."""
    each = bits.groupBy("device", "pos").agg((F.min("bit") != F.max("bit")).cast("double").alias("moved"))
    return each.agg(F.avg("moved").alias("unstable"))


def metrics(puf: DataFrame) -> DataFrame:
    """One row: uniformity (mean, least, most), uniqueness, bit error rate, reliability, mean min-entropy, unstable part."""
    bits = exploded(puf)
    u = uniformity(bits).agg(F.avg("ones").alias("uniformity"), F.min("ones").alias("least"), F.max("ones").alias("most"))
    e = reliability(bits).agg(F.avg("errors").alias("ber")).withColumn("reliability", 1 - F.col("ber"))
    h = aliasing(bits).agg(F.avg("h_min").alias("h_min"))
    return u.join(uniqueness(bits)).join(e).join(h).join(unstable(bits))


def block_failure(spark: SparkSession, n: int, ber: float) -> DataFrame:
    """(t, failure): the probability that a block of n bits has more than t errors, for every t."""
    from math import log

    rows = spark.range(n + 1).withColumnRenamed("id", "t")
    # ln C(n, t) by a running sum of ln((n - t + 1) / t), which needs no gamma function
    order = Window.orderBy("t")
    ln_c = F.sum(F.when(F.col("t") > 0, F.log((n - F.col("t") + 1) / F.col("t"))).otherwise(0.0)).over(order)
    if ber <= 0:
        return rows.withColumn("failure", F.lit(0.0))
    if ber >= 1:
        return rows.withColumn("failure", F.when(F.col("t") < n, 1.0).otherwise(0.0))
    p = F.exp(ln_c + F.col("t") * log(ber) + (n - F.col("t")) * log(1 - ber))
    after = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("p", p).withColumn("failure", F.least(F.lit(1.0), F.coalesce(F.sum("p").over(after), F.lit(0.0)))).drop("p")


def required_correction(spark: SparkSession, n: int, ber: float, target: float) -> int | None:
    """The smallest number of correctable errors at which a block fails at most with probability target."""
    return block_failure(spark, n, ber).where(F.col("failure") <= target).agg(F.min("t")).first()[0]


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of values from 0 to 1; 1 is in the last bin."""
    return df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(column) * bins)).alias("bin")).agg(F.count("*").alias("n"))
