"""Validation and alignment of ground truth and predictions.

Frames have the keys ``sequenceId`` and ``itemPosition``; values of a paired
frame end in ``_gt`` and ``_inf``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEQ, TIME = "sequenceId", "itemPosition"
KEYS = [SEQ, TIME]


class DataValidationError(ValueError):
    """The data cannot be scored."""


def canonical(df: DataFrame, sequence_key: str = SEQ, time_key: str = TIME) -> DataFrame:
    """Keys under their usual names, values as doubles, NaN and infinite as null."""
    missing = [k for k in (sequence_key, time_key) if k not in df.columns]
    if missing:
        raise DataValidationError(f"missing key columns {missing}")
    if not isinstance(df.schema[time_key].dataType, T.NumericType):
        raise DataValidationError(f"{time_key} must be numeric")
    values = [c for c in df.columns if c not in (sequence_key, time_key)]
    finite = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")).alias(c) for c in values]
    return df.select(F.col(sequence_key).alias(SEQ), F.col(time_key).alias(TIME), *finite)


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n > 1")


def check_keys(df: DataFrame) -> DataFrame:
    if df.filter(F.col(SEQ).isNull() | F.col(TIME).isNull()).limit(1).count():
        raise DataValidationError("keys must not be null")
    if duplicate_keys(df).limit(1).count():
        raise DataValidationError("duplicate (sequence, time) keys")
    return df


def pair(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Inner join on the keys; shared values get the suffixes, others stay."""
    shared = [c for c in gt.columns if c in pred.columns and c not in KEYS]
    left = gt.withColumnsRenamed({c: f"{c}_gt" for c in shared})
    return left.join(pred.withColumnsRenamed({c: f"{c}_inf" for c in shared}), KEYS)


def truncated(paired: DataFrame) -> DataFrame:
    """The first rows of each sequence, as many as the shortest has."""
    at = F.row_number().over(Window.partitionBy(SEQ).orderBy(TIME))
    least = paired.groupBy(SEQ).count().agg(F.min("count").alias("__least"))
    return paired.withColumn("__at", at).join(F.broadcast(least)).filter("__at <= __least").drop("__at", "__least")


def overlap(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: rows of both sides and merged, overlap, verdict, and the
    shortest and longest merged sequence; one grouped pass over both sides."""
    side = lambda d, g, p: d.select(*KEYS, F.lit(g).alias("g"), F.lit(p).alias("p"))
    by_key = side(gt, 1, 0).unionByName(side(pred, 0, 1)).groupBy(*KEYS).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    by_sequence = by_key.groupBy(SEQ).agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("p")).alias("m"))
    met = F.when(F.col("m") > 0, F.col("m"))
    counts = by_sequence.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_gt"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_merged"), F.min(met).alias("shortest"), F.max(met).alias("longest"), F.count(met).alias("sequences"))
    share = F.try_divide(F.col("n_merged").cast("double"), F.least("n_gt", "n_pred"))
    verdict = F.when(F.coalesce(share, F.lit(0.0)) < 0.5, "error").when(share < 0.95, "warn").otherwise("ok")
    return counts.withColumn("overlap", share).withColumn("verdict", verdict)


def check_overlap(gt: DataFrame, pred: DataFrame) -> None:
    """At least half of the shorter side must match; less than 95 % of it, or
    of the longest sequence in the shortest, is a warning."""
    r = overlap(gt, pred).first()
    if not r["n_merged"]:
        raise DataValidationError("ground truth and predictions share no rows")
    if r["verdict"] == "error":
        raise DataValidationError(f"only {r['overlap']:.1%} of the shorter side match")
    if r["verdict"] == "warn":
        warnings.warn(f"only {r['overlap']:.1%} of the shorter side match", stacklevel=2)
    if r["shortest"] < 0.95 * r["longest"]:
        warnings.warn(f"merged sequences have {r['shortest']} to {r['longest']} rows", stacklevel=2)


def scale_gap(paired: DataFrame, values: list[str]) -> DataFrame:
    """(gap, consistent): orders of magnitude between both sides' deviations;
    up to 3 are consistent, and a side without any deviation isn't."""
    cells = long_form(paired, values)
    gap = F.abs(F.log10(F.try_divide(F.stddev_pop("gt"), F.stddev_pop("inf"))))
    return cells.agg(gap.alias("gap")).select("gap", F.coalesce(F.col("gap") <= 3, F.lit(False)).alias("consistent"))


def check_traces(paired: DataFrame, values: list[str], least_sequences: int = 2, least_rows: int = 60, least_regions: int = 2) -> None:
    """Gates of neural scores: sequences, rows, regions, missing values, flat
    regions; inconsistent scales are a warning."""
    if len(values) < least_regions:
        raise DataValidationError(f"at least {least_regions} regions are needed, found {len(values)}")
    sizes = paired.groupBy(SEQ).count().agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    if sizes["n"] < least_sequences:
        raise DataValidationError(f"at least {least_sequences} sequences are needed, found {sizes['n']}")
    if sizes["least"] < least_rows:
        raise DataValidationError(f"sequences need {least_rows} rows, the shortest has {sizes['least']}")
    for side in ("gt", "inf"):
        bad = [r["region"] for r in array_quality(paired, [f"{v}_{side}" for v in values]).filter("verdict = 'error'").collect()]
        if bad:
            raise DataValidationError(f"regions with too many missing values or none that vary: {sorted(bad)}")
    if not scale_gap(paired, values).first()["consistent"]:
        warnings.warn("deviations of both sides differ by over three orders of magnitude", stacklevel=2)


def check_multimodal(paired: DataFrame, regions: list[str], parts: list[str], least_rows: int = 33) -> None:
    """Both sides of all regions and parts are there; short or uneven sequences
    are warnings."""
    wanted = [f"{c}_{s}" for c in [*regions, *[f"{p}_{a}" for p in parts for a in "XY"]] for s in ("gt", "inf")]
    missing = [c for c in wanted if c not in paired.columns]
    if missing:
        raise DataValidationError(f"missing columns {missing}")
    r = paired.groupBy(SEQ).count().agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
    if (r["least"] or 0) < least_rows:
        warnings.warn(f"lead-lag scores need {least_rows} rows, the shortest sequence has {r['least']}", stacklevel=2)
    if r["most"] and r["least"] < 0.95 * r["most"]:
        warnings.warn(f"sequences have {r['least']} to {r['most']} rows", stacklevel=2)


def array_quality(df: DataFrame, values: list[str], most_missing: float = 0.10, least_deviation: float = 1e-6) -> DataFrame:
    """One row a region: share of nulls, deviation, verdict; a single pass."""
    aggregates = [F.struct(F.lit(v).alias("region"), F.avg(F.col(v).isNull().cast("double")).alias("missing"), F.stddev_pop(v).alias("deviation")) for v in values]
    rows = df.agg(F.array(*aggregates).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return rows.withColumn("verdict", F.when(F.col("missing") > most_missing, "error").when(F.coalesce("deviation", F.lit(0.0)) < least_deviation, "error").otherwise("ok"))


def long_form(paired: DataFrame, values: list[str]) -> DataFrame:
    """(sequenceId, itemPosition, region, gt, inf)."""
    cells = F.array(*[F.struct(F.lit(v).alias("region"), F.col(f"{v}_gt").alias("gt"), F.col(f"{v}_inf").alias("inf")) for v in values])
    return paired.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.*")


def sides(paired: DataFrame, columns: list[str]) -> DataFrame:
    """(sequenceId, itemPosition, side, *columns): both sides below each other."""
    both = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in columns]) for s in ("gt", "inf")])
    return paired.select(*KEYS, F.explode(both).alias("s")).select(*KEYS, "s.*")
