"""The data behind report figures, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.shared import Kept
from ..functions.stats import bin_of
from ..operators import etho, latent, linear, movement, rollup
from ..operators.embedding import embed
from ..operators.groupwise import _thinned
from .align import KEYS, SEQ, long_form, sides


def _binned(rows: DataFrame, value: str, by: list[str], ends: DataFrame, bins: int) -> DataFrame:
    """(*by, side, bin, low, high, n) of the values within the ends (lo, hi)."""
    held = rows.join(F.broadcast(ends.filter("lo < hi")), by) if by else rows.crossJoin(F.broadcast(ends.filter("lo < hi")))
    place = bin_of(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")
    counts = held.filter(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(*by, "side", place, "lo", "hi").agg(F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    return counts.select(*by, "side", "bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def traces(paired: DataFrame, values: list[str], sequences: int = 4) -> DataFrame:
    """Long form of evenly spaced sequences."""
    picks = linear.evenly(paired.select(SEQ).distinct(), sequences)
    return long_form(paired.join(F.broadcast(picks), SEQ), values)


def region_histograms(paired: DataFrame, values: list[str], bins: int = 59, trim: float = 0.001) -> DataFrame:
    """(region, side, bin, low, high, n) over the middle 99.8 % of both sides."""
    cells = sides(paired, values).select("side", F.explode(F.array(*[F.struct(F.lit(v).alias("region"), F.col(v).alias("v")) for v in values])).alias("c")).select("side", "c.*")
    ends = quantiles(cells, "v", ["region"], [trim, 1 - trim]).select("region", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    return _binned(cells, "v", ["region"], ends, bins)


def embedding(paired: DataFrame, values: list[str], most: int | None = 3000, method: str = "neighbours") -> DataFrame:
    """(side, keys, e0, e1): at most ``most`` rows a side (None: all rows) in the
    plane.

    method: ``neighbours`` lays out the graph of nearest neighbours of the
    standardised rows, from the two main directions of the ground truth on;
    ``components`` gives these directions themselves.
    """
    basis = latent.gt_basis(paired, values, 2, least=2)
    if basis is None or basis.k < 2:
        return sides(paired, values).limit(0).select("side", *KEYS, F.lit(0.0).alias("e0"), F.lit(0.0).alias("e1"))
    rows = sides(latent.complete(paired, values), values)
    z = rows.select("side", *KEYS, F.array(*[basis.standardised(v, i) for i, v in enumerate(values)]).alias("p"), basis.projection(0).alias("e0"), basis.projection(1).alias("e1"))
    every = z if most is None else _thinned(z.filter("side = 'gt'"), most).unionByName(_thinned(z.filter("side = 'inf'"), most))
    if method == "components":
        return every.drop("p")
    with Kept(paired.sparkSession) as keep:
        held = keep(every.withColumn("id", F.xxhash64("side", *KEYS)))
        places = embed(held.select("id", "p"), held.select("id", "e0", "e1"), keep)
        return keep.result(held.select("side", *KEYS, "id").join(places, "id").select("side", *KEYS, "e0", "e1"))


def dose_figures(scores: DataFrame, oracle: DataFrame | None = None) -> dict[str, DataFrame]:
    """The data of the dose-response lines and of the heat map of drops, from
    score records (perturbation, level, metric, value): ``dose`` has the mean of
    each point, ``heat`` a row a perturbation and a column a metric.

    oracle: the records that drops are measured from; those of level 0 else.
    """
    drops = rollup.selectivity(scores, scores.filter("level = 0") if oracle is None else oracle)
    metrics = sorted(r["metric"] for r in drops.select("metric").distinct().collect())  # a name a metric
    heat = drops.groupBy("perturbation").pivot("metric", metrics).agg(F.first("drop")) if metrics else drops.select("perturbation")
    return {"dose": rollup.dose_response(scores), "heat": heat}


def scenario_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Tables of scenario score records (scenario_name, scenario_group,
    noise_sigma, metric, value).

    ``results``: a row a scenario with a column a metric; ``monotonicity``: how
    each group's mean scores fall with the noise; ``saturation``: shares of
    scores at or above .90 and .95 in each group; ``summary``: mean and spread
    in each group.
    """
    metrics = sorted(r["metric"] for r in records.select("metric").distinct().collect())  # a name a metric
    keys = ["scenario_name", "scenario_group", "noise_sigma"]
    results = records.groupBy(*keys).pivot("metric", metrics).agg(F.avg("value")) if metrics else records.select(*keys).distinct()
    as_doses = records.filter("noise_sigma is not null").select(F.col("scenario_group").alias("perturbation"), F.col("noise_sigma").alias("level"), "metric", "value")
    falls = rollup.monotonicity(as_doses).withColumnRenamed("perturbation", "scenario_group")
    by = ["scenario_group", "metric"]
    return {"results": results, "monotonicity": falls, "saturation": rollup.saturation(records, by), "summary": rollup.spread(records, by)}


def load_stats(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(side, rows, sequences)."""
    one = lambda d, s: d.agg(F.count("*").alias("rows"), F.countDistinct(SEQ).alias("sequences")).select(F.lit(s).alias("side"), "rows", "sequences")
    return one(gt, "gt").unionByName(one(pred, "inf"))


def part_errors(paired: DataFrame, parts: list[str]) -> DataFrame:
    """Errors of the body parts, the largest first."""
    return etho.body_part_errors(paired, parts).orderBy(F.desc("rmse"), "part")


def speed_histogram(paired: DataFrame, center: str = "CENTER", bins: int = 50, below: float = 0.99) -> DataFrame:
    """(side, bin, low, high, n) of the speeds up to their 99th percentile."""
    speeds = etho.steps(paired, center).select("side", F.col("size").alias("v"))
    ends = quantiles(speeds, "v", [], [0.0, below]).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    return _binned(speeds, "v", [], ends, bins)


def limb_distances(paired: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, gt, inf): mean distances of both sides."""
    rows = etho.inter_limb_distances(paired, pairs)
    return rows.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col("mean"))).alias(s) for s in ("gt", "inf")])


def chunk_embedding(paired: DataFrame, center: str = "CENTER", axis: tuple[str, str] = ("NOSE", "TAIL_BASE")) -> DataFrame:
    return movement.embedded_chunks(paired, center=center, axis=axis)


def cross_bars(scores: DataFrame) -> DataFrame:
    """The cross scores of both sides, by what they measure."""
    names = {"cca": ("cca_gt", "cca_pred"), "neural to behaviour": ("r2_neural_to_behavior_gt", "r2_neural_to_behavior_pred"), "behaviour to neural": ("r2_behavior_to_neural_gt", "r2_behavior_to_neural_pred"), "lead lag": ("lead_lag_gt", "lead_lag_pred")}
    rows = [(k, m, s) for k, pair in names.items() for m, s in zip(pair, ("gt", "inf"), strict=True)]
    table = scores.sparkSession.createDataFrame(rows, "measure string, metric string, side string")
    joined = table.join(scores.select("metric", "value"), "metric", "left")
    return joined.groupBy("measure").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("gt", "inf")])


def neuro_report(paired: DataFrame, values: list[str], scores: DataFrame) -> dict[str, DataFrame]:
    return {"traces": traces(paired, values), "histograms": region_histograms(paired, values), "embedding": embedding(paired, values), "metrics": rollup.metric_table(scores), "families": rollup.family_table(scores)}


def etho_report(paired: DataFrame, parts: list[str], center: str = "CENTER", axis: tuple[str, str] = ("NOSE", "TAIL_BASE")) -> dict[str, DataFrame]:
    pairs = [(a, b) for a, b in ((axis[0], axis[1]), ("LEFT_EAR", "RIGHT_EAR"), (axis[0], center)) if a in parts and b in parts]
    tables = {"part_errors": part_errors(paired, parts), "speeds": speed_histogram(paired, center), "chunks": chunk_embedding(paired, center, axis)}
    return tables | ({"limbs": limb_distances(paired, pairs)} if pairs else {})
