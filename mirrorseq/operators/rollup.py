"""Composites and summaries of scores given as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import correlation01, geometric_mean, weighted_mean

# The weights of metrics in their families and of families.
METRIC_WEIGHTS = {
    "family_distribution": {"KL_or_JSD_score": 0.25, "QNT_score": 0.25, "MOM_score": 0.25, "Mean_score": 0.25},
    "family_temporal_spectral": {"TRJDIST_score": 1.0},
    "family_relational": {"GRAPH_score": 0.25, "CrossRegionMI_score": 0.25, "LaggedCovariance_score": 0.25, "ImpulseResponse_score": 0.25},
    "family_geometry": {"MANI_score": 0.5, "SubspaceAngle_score": 0.5},
    "family_state_dynamics": {"LatentStateOccupancyK11_score": 0.2, "LatentStateOccupancyK12_score": 0.2, "LatentStateTransitionLag1K11_score": 0.2, "LatentStateTransitionLag2K11_score": 0.2, "LatentStateTransitionLag3K11_score": 0.2},
}
FAMILY_WEIGHTS = {"family_distribution": 0.22, "family_temporal_spectral": 0.18, "family_relational": 0.24, "family_geometry": 0.18, "family_state_dynamics": 0.18}
FIDELITY_WEIGHTS = {"Error_score": 0.65, "MI_score": 0.35}


# Older names of scores.
ALIASES = {
    "KL_or_JSD_score": "KL_or_JSD_score01", "Mean_score": "Mean_score01", "QNT_score": "QNT_score01", "MOM_score": "MOM_score01", "GRAPH_score": "GRAPH_score01", "TRJDIST_score": "TRJDIST_score01", "MANI_score": "MANI_score01",
    "CrossRegionMI_score": "CrossRegionMI_score01", "LaggedCovariance_score": "LaggedCovariance_score01", "ImpulseResponse_score": "ImpulseResponse_score01", "SubspaceAngle_score": "SubspaceAngle_score01",
    "LatentStateOccupancyK11_score": "LatentStateOccupancyK11_score01", "LatentStateOccupancyK12_score": "LatentStateOccupancyK12_score01", "LatentStateTransitionLag1K11_score": "LatentStateTransitionLag1K11_score01",
    "LatentStateTransitionLag2K11_score": "LatentStateTransitionLag2K11_score01", "LatentStateTransitionLag3K11_score": "LatentStateTransitionLag3K11_score01", "Error_score": "Error_score01", "MI_score": "MI_score01",
}


def with_aliases(scores: DataFrame) -> DataFrame:
    """(metric, value) with each score under its older name too, where that is free."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    older = scores.withColumn("metric", F.try_element_at(names, F.col("metric"))).filter("metric is not null")
    return scores.unionByName(older.join(scores.select("metric"), "metric", "left_anti").select(*scores.columns))


def metric_table(scores: DataFrame) -> DataFrame:
    """(family, metric, weight, value) of every metric of the composite; a
    missing one has a null value."""
    rows = [(f, m, w) for f, ms in METRIC_WEIGHTS.items() for m, w in ms.items()]
    table = scores.sparkSession.createDataFrame(rows, "family string, metric string, weight double")
    return table.join(scores.select("metric", "value"), "metric", "left").select("family", "metric", "weight", "value")


def family_table(scores: DataFrame) -> DataFrame:
    """(family, weight, value) of every family of the composite."""
    table = scores.sparkSession.createDataFrame(list(FAMILY_WEIGHTS.items()), "family string, weight double")
    return table.join(families(scores).select(F.col("metric").alias("family"), "value"), "family", "left")


def _weight(column: str, weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(column)]


def families(scores: DataFrame) -> DataFrame:
    """(metric, value) of the families and of the final composite, from the
    (metric, value) of the metrics; missing ones leave their weight to the rest."""
    family_of = {m: f for f, ms in METRIC_WEIGHTS.items() for m in ms}
    weight_of = {m: w for ms in METRIC_WEIGHTS.values() for m, w in ms.items()}
    lookup = F.create_map(*[F.lit(x) for kv in family_of.items() for x in kv])
    known = scores.withColumn("family", F.try_element_at(lookup, F.col("metric"))).filter("family is not null")
    by_family = known.groupBy("family").agg(weighted_mean(F.col("value"), _weight("metric", weight_of)).alias("value")).select(F.col("family").alias("metric"), "value")
    whole = by_family.agg(weighted_mean(F.col("value"), _weight("metric", FAMILY_WEIGHTS)).alias("value")).select(F.lit("FINAL_COMPOSITE_SCORE").alias("metric"), "value")
    return by_family.unionByName(whole)


def composite(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Geometric mean of the scores, each held in [1e-6, 1 - 1e-6]."""
    return scores.groupBy(*by).agg(geometric_mean(F.col(value)).alias("composite"))


def spread(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, least and most of each group."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))


def dose_response(scores: DataFrame) -> DataFrame:
    """Mean value by (perturbation, level, metric)."""
    return scores.groupBy("perturbation", "level", "metric").agg(F.avg("value").alias("mean"))


def selectivity(scores: DataFrame, oracle: DataFrame) -> DataFrame:
    """Relative drop of each metric at a perturbation's highest level."""
    top = scores.withColumn("__top", F.max("level").over(Window.partitionBy("perturbation"))).filter("level = __top")
    base = oracle.groupBy("metric").agg(F.avg("value").alias("oracle"))
    low = top.groupBy("perturbation", "metric").agg(F.avg("value").alias("mean"))
    return low.join(base, "metric").select("perturbation", "metric", ((F.col("oracle") - F.col("mean")) / F.greatest("oracle", F.lit(1e-9))).alias("drop"))


def monotonicity(scores: DataFrame) -> DataFrame:
    """By (perturbation, metric): share of level steps that don't rise, change
    from the lowest to the highest level, rank agreement in [0, 1]."""
    by = Window.partitionBy("perturbation", "metric")
    rank = lambda c: F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy("perturbation", "metric", c)) - 1) / 2.0
    rows = dose_response(scores).withColumn("step", F.col("mean") - F.lag("mean").over(by.orderBy("level"))).withColumn("x", rank("level")).withColumn("y", rank("mean"))
    return rows.groupBy("perturbation", "metric").agg(F.avg((F.col("step") <= 0).cast("double")).alias("falling"), (F.max_by("mean", "level") - F.min_by("mean", "level")).alias("change"), correlation01(F.col("x"), F.col("y")).alias("rank01"))


def saturation(scores: DataFrame, by: list[str], limits: tuple[float, float] = (0.90, 0.95)) -> DataFrame:
    """Share of values at or above each limit."""
    return scores.groupBy(*by).agg(*[F.avg((F.col("value") >= x).cast("double")).alias(f"at_{round(100 * x)}") for x in limits])
