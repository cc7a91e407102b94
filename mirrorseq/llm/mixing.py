"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_key, md5_prefix, stored

#: A row's place in its source: 60 bits, refined by 12 bits a level.
BITS, STEP = 60, 12
MOST = 3


def place(key: Column) -> Column:
    """A uniform 60-bit number that depends on the key alone."""
    return md5_prefix(as_key(key), BITS // 4)


def cycling_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle's numbers dealt to the sources by code point, null last.

    ``sources`` has one row a source, the only rows that are ordered globally.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), rank % len(cycle)).cast("long"))


def targets(sources: DataFrame, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    The budget (a share of all words) is dealt by weight; a target stops at
    ``most`` times its source and the excess goes to the others by weight.
    With the sources in order of size / weight those that stop come first, so
    one pass of running sums finds the level at which the rest is dealt.
    """
    cap = F.col("source_size") * most
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    dealt = sources.withColumn("__level", level).withColumn("__stops", cap <= F.col("__level") * F.col("weight"))
    # the first source that doesn't stop has the highest of their levels
    dealt = dealt.withColumn("__final", F.max(F.when(~F.col("__stops"), F.col("__level"))).over(whole))
    target = F.when(F.col("__final").isNull() | (cap <= F.col("__final") * F.col("weight")), cap.cast("double")).otherwise(F.col("__final") * F.col("weight"))
    return dealt.withColumn("target", target).drop("__level", "__stops", "__final")


def thresholds(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """For each source the least place whose rows no longer fit its quota.

    rows: (source, size, place); quotas: (source, quota).  Words are summed
    by source and the leading 12 bits of the place; the bucket in which the
    running sum passes the quota is the boundary, and only its rows are summed
    again by the next 12 bits, until the place is exact.  A source whose rows
    all fit has no row in the result.  Thresholds of smaller quotas are
    smaller, so the sets they choose are nested.
    """
    bound = quotas.select("source", F.lit(0).cast("long").alias("bucket"), F.col("quota").cast("double").alias("left"))
    for shift in range(BITS - STEP, -1, -STEP):
        of = bound.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "left")
        inside = rows.join(of, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + STEP) == F.col("b")))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("running", running).filter("running > left")
        bound = over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - (F.col("running") - F.col("size"))).alias("left")), "bucket").alias("m")).select("source", "m.bucket", "m.left")
    return bound.select("source", F.col("bucket").alias("threshold"))


def aims(slim: DataFrame, budget: float, most: int) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, size, place).

    The table has a row a source and is stored, so its readers see its size.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = targets(cycling_weights(sizes), budget, most)
    copies = F.floor(F.try_divide("target", "source_size"))
    table = stored(table.withColumn("whole", F.coalesce(copies, F.lit(0)).cast("long")).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")))
    left = thresholds(slim, table.select("source", "quota")).withColumnRenamed("source", "s")
    found = table.join(left, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(found.select("source", "source_size", "target", "whole", "threshold"))


def mix(df: DataFrame, key: str, size: Column, source: str = "source", budget: float = 1.0, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, *carry) for each row.

    Every row is taken target // source_size times, and once more where its
    place lies below its source's threshold; no row exceeds ``most`` times.

    Defined results: a null source is a source, the last; rows with equal keys
    share their place and so their fate; a null or empty text has size 0 and
    adds nothing; sources of size 0 have target 0; an empty table stays empty.
    Sources are as many as the data has: nothing is gathered on the driver,
    and only the table of sources is ordered in one task.  A source's rows meet
    only as sums of 4096 buckets.
    """
    slim = stored(df.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), place(F.col(key)).alias("place"), *carry))
    found = aims(slim, budget, most).withColumnRenamed("source", "s")
    extra = F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)
    joined = slim.join(found, F.col("source").eqNullSafe(F.col("s")))
    out = joined.withColumn("copies", F.col("whole") + extra)
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry)


def take(df: DataFrame, key: str, size: Column, source: str = "source", budget: float = 1.0, most: int = MOST) -> DataFrame:
    """The rows that a mix takes, each as often as it takes them, with the
    columns of ``df``.

    Sizes are measured in a first, narrow pass; the chosen copies depend on a
    row's key, source and the table of sources alone, so the second pass needs
    no join by row and moves no text.
    """
    slim = stored(df.select(F.col(source).alias("source"), size.alias("size"), place(F.col(key)).alias("place")))
    found = aims(slim, budget, most)
    extra = F.when(place(F.col(key)) < F.col("__threshold"), 1).otherwise(0)
    found = found.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold"))
    joined = df.join(found, F.col(source).eqNullSafe(F.col("__source")))
    copies = F.array_repeat(F.lit(1), (F.col("__whole") + extra).cast("int"))
    return joined.withColumn("__copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in df.columns])
