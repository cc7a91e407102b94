"""Scores of a ground truth and a prediction, as (metric, value) rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, parts_of
from .operators import clusters, etho, groupwise, latent, linear, movement, neuro, rollup, structure
from .plans import reports
from .plans.align import KEYS, SEQ, canonical, check_keys, check_multimodal, check_overlap, check_traces, pair, truncated


def aligned(gt: DataFrame, pred: DataFrame, config: Config = Config(), same_columns: bool = False) -> DataFrame:
    """Validated and paired; at least half of the shorter side must match."""
    left, right = (check_keys(canonical(d, config.sequence_key, config.time_key)) for d in (gt, pred))
    if same_columns and set(left.columns) != set(right.columns):
        raise AssertionError("ground truth and predictions have different columns")
    check_overlap(left, right)
    return pair(left, right)


def _values(paired: DataFrame, config: Config) -> list[str]:
    shared = [c[:-3] for c in paired.columns if c.endswith("_gt") and f"{c[:-3]}_inf" in paired.columns]
    track = {f"{p}_{a}" for p in parts_of(shared) for a in "XY"}
    return [c for c in shared if c not in track and (config.neuro_cols is None or c in config.neuro_cols)]


def _named(df: DataFrame, metric: str, column: str = "score") -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))


def _below(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def _gathered(spark: SparkSession, tasks: list[Callable[[], DataFrame]], at_once: int = 4) -> DataFrame:
    """The (metric, value) rows that the tasks give, each a handful of scores:
    every metric runs as plans of its own, which keeps plans small, and some run
    side by side, since most of them wait for short jobs."""
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda task: [(r.metric, r.value) for r in task().collect()], tasks))
    return spark.createDataFrame([r for rows in found for r in rows], "metric string, value double")


def compute_neuro_scores(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> DataFrame:
    """Metrics, families and composite of region traces.

    The composite gives the weight of a metric without a value to the others.
    """
    paired = truncated(aligned(ground_truth, predictions, config)).persist()
    values = _values(paired, config)
    check_traces(paired, values)
    metrics = _neuro_metrics(paired, values, config)
    paired.unpersist()
    return metrics.unionByName(rollup.families(metrics))


def _neuro_metrics(paired: DataFrame, values: list[str], config: Config = Config()) -> DataFrame:
    one: dict[str, Callable[[], DataFrame]] = {
        "MANI_score": lambda: latent.manifold_score(paired, values), "TRJDIST_score": lambda: latent.trajectory_score(paired, values),
        "KL_or_JSD_score": lambda: neuro.kl(paired, values), "QNT_score": lambda: neuro.quantile_shift(paired, values), "MOM_score": lambda: neuro.moments(paired, values), "Mean_score": lambda: neuro.mean_shift(paired, values),
        "GRAPH_score": lambda: neuro.graph(paired, values), "CrossRegionMI_score": lambda: neuro.matrix_similarity(groupwise.cross_region_mi(paired, values, config.MI_MAX_POINTS, k=config.MI_N_NEIGHBORS)),
        "LaggedCovariance_score": lambda: linear.lagged_covariance(paired, values), "ImpulseResponse_score": lambda: linear.impulse_response(paired, values), "SubspaceAngle_score": lambda: linear.subspace_angle(paired, values, config.PCA_VARIANCE_THRESHOLD),
    }
    tasks = [lambda m=m, f=f: _named(f(), m) for m, f in one.items()]
    return _gathered(paired.sparkSession, [lambda: clusters.latent_states(paired, values), *tasks])


def compute_fidelity_scores(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> DataFrame:
    """Error and information of paired traces, and their composite."""
    paired = truncated(aligned(ground_truth, predictions, config)).cache()
    values = _values(paired, config)
    metrics = _gathered(paired.sparkSession, [lambda: _named(neuro.error(paired, values), "Error_score"), lambda: _named(groupwise.mi_score(paired, values, config.MAX_TIME_STEPS_SUBSAMPLE, config.MI_N_NEIGHBORS), "MI_score")])
    paired.unpersist()
    weight = F.create_map(*[F.lit(x) for kv in rollup.FIDELITY_WEIGHTS.items() for x in kv])[F.col("metric")]
    whole = metrics.agg(rollup.weighted_mean(F.col("value"), weight).alias("value"))
    return metrics.unionByName(_named(whole, "FIDELITY_SCORE", "value"))


def compute_replacement_scores(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> DataFrame:
    """(metric, value) of the scores that stand outside of the composite: main
    directions, moments, graph, autocorrelation, cross-correlation, band power,
    power spectrum, trajectory and manifold."""
    paired = truncated(aligned(ground_truth, predictions, config)).persist()
    values = _values(paired, config)
    one: dict[str, Callable[[], DataFrame]] = {
        "PCA_score": lambda: structure.reconstruction_transfer(paired, values), "MOM_score": lambda: neuro.moments(paired, values), "GRAPH_score": lambda: neuro.graph(paired, values),
        "AUTO_score": lambda: structure.autocorrelation_score(paired, values, config.AUTOCORR_MAX_LAG), "CC_score": lambda: structure.cross_correlation_score(paired, values),
        "BP_score": lambda: groupwise.band_power_score(paired, values, config.WELCH_NPERSEG), "PSDShape_score": lambda: structure.spectrum_shape(paired, values, config.WELCH_NPERSEG),
        "TRJDIST_score": lambda: latent.trajectory_score(paired, values), "MANI_score": lambda: latent.manifold_score(paired, values),
    }
    found = _gathered(paired.sparkSession, [lambda m=m, f=f: _named(f(), m) for m, f in one.items()])
    paired.unpersist()
    return found


def etho_metrics(paired: DataFrame, config: Config = Config()) -> DataFrame:
    """(metric, sequenceId, score, weight); all sequences have a null id."""
    c = config.center_part
    axis = [f"{p}_{a}_{s}" for p in config.body_axis for a in "XY" for s in ("gt", "inf")]
    tables = {
        "position_kl_score": etho.position(paired, c), "stationary_score": etho.stationary(paired, c, config.STATIONARY_THRESHOLD_PERCENTILE), "velocity_score": etho.distribution(paired, 1, c),
        "acceleration_score": etho.distribution(paired, 2, c), "quadrant_score": etho.quadrant(paired, c),
        "syllable_score": clusters.syllables(paired, c, config.KMEANS_K_SYLLABLE), "trajectory_shape_score": clusters.trajectory_shapes(paired, c, config.KMEANS_K_TRAJECTORY),
    }
    if set(axis) <= set(paired.columns):
        tables["direction_score"] = etho.direction(paired, c, config.body_axis)
    return _below([t.select(F.lit(m).alias("metric"), F.col(SEQ).cast("string").alias(SEQ), "score", F.col("weight").cast("long").alias("weight")) for m, t in tables.items()])


def compute_etho_scores(ground_truth: DataFrame, predictions: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global (metric, value) with the composite, per-sequence rows, and their
    weighted means and deviations."""
    paired = aligned(ground_truth, predictions, config, same_columns=True).cache()
    rows = etho_metrics(paired, config).cache()
    whole = rows.filter(F.col(SEQ).isNull()).select("metric", F.col("score").alias("value"))
    composite = whole.agg(rollup.geometric_mean(F.col("value")).alias("value"))
    dtw = groupwise.dtw_similarity(paired, config.center_part)
    both = movement.alignment(paired, config.center_part, config.body_axis)
    manifold = _named(both, "procrustes_similarity", "procrustes_similarity").unionByName(_named(both, "mmd_similarity", "mmd_similarity"))
    each = rows.filter(F.col(SEQ).isNotNull()).unionByName(dtw.select(F.lit("dtw_similarity_score").alias("metric"), F.col(SEQ).cast("string").alias(SEQ), "score", F.lit(1).cast("long").alias("weight")))
    spark = paired.sparkSession
    total = _gathered(spark, [lambda: whole, lambda: _named(dtw.agg(F.avg("score").alias("score")), "dtw_similarity_score"), lambda: manifold, lambda: _named(composite, "composite_score", "value")])
    return total, each, etho.across_sequences(each)


def cross_metrics(paired: DataFrame, values: list[str], config: Config = Config()) -> dict[str, float | None]:
    """How traces and the five behaviour features go together on either side."""
    features = movement.behaviour_features(paired, config.center_part, config.body_axis)
    got: dict[str, float | None] = {}
    for s, label in (("gt", "gt"), ("inf", "pred")):
        mine = features.filter(F.col("side") == s).select(*KEYS, *[F.col(c).alias(f"__{c}") for c in movement.BEHAVIOUR])
        side = paired.select(*KEYS, *[F.col(f"{v}_{s}").alias(v) for v in values]).join(mine, KEYS).persist()
        behaviour = [f"__{c}" for c in movement.BEHAVIOUR]
        got[f"cca_{label}"] = linear.canonical_correlation(side, values, behaviour)
        got[f"r2_neural_to_behavior_{label}"] = linear.predictive_r2(side, values, behaviour)
        got[f"r2_behavior_to_neural_{label}"] = linear.predictive_r2(side, behaviour, values)
        side.unpersist()
    gap = lambda a: None if None in (got[f"{a}_gt"], got[f"{a}_pred"]) else abs(got[f"{a}_gt"] - got[f"{a}_pred"])
    cca, forth, back = gap("cca"), gap("r2_neural_to_behavior"), gap("r2_behavior_to_neural")
    got["cca_alignment_score"] = None if cca is None else 1 - min(1.0, cca)
    got["neural_to_behavior_similarity"] = None if forth is None else 1 / (1 + forth)
    got["behavior_to_neural_similarity"] = None if back is None else 1 / (1 + back)
    lag = groupwise.lead_lag_score(groupwise.lead_lag(paired, values, config.center_part, config.LEAD_LAG_DEFAULT_MAX_LAG)).first()
    got |= {"lead_lag_gt": None if lag["gt"] is None else float(lag["gt"]), "lead_lag_pred": None if lag["inf"] is None else float(lag["inf"]), "lead_lag_score": lag["score"]}
    parts = [v for k, v in got.items() if v is not None and (k.endswith("score") or k.endswith("similarity"))]
    got["cross_composite"] = (0.0 if 0.0 in parts else math.prod(parts) ** (1 / len(parts))) if parts else None
    return got


def compute_cross_scores(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> DataFrame:
    """(block, metric, value): the neural and behaviour scores, how traces and
    behaviour go together, and the mean of the three composites."""
    paired = aligned(ground_truth, predictions, config).persist()
    values = _values(paired, config)
    check_multimodal(paired, values, list(config.behavior_parts or [config.center_part]))
    cross = cross_metrics(paired, values, config)
    blocks = [("cross_scores", k, v) for k, v in cross.items()]
    composites = [cross["cross_composite"]]
    short = truncated(paired).persist()
    check_traces(short, values)
    neuro_rows = _neuro_metrics(short, values, config)
    neuro_rows = neuro_rows.unionByName(rollup.families(neuro_rows)).collect()
    blocks += [("neuro_scores", r.metric, r.value) for r in neuro_rows]
    composites.append(next((r.value for r in neuro_rows if r.metric == "FINAL_COMPOSITE_SCORE"), None))
    whole_rows = etho_metrics(paired, config).filter(F.col(SEQ).isNull()).select("metric", F.col("score").alias("value"))
    whole = _gathered(paired.sparkSession, [lambda: whole_rows])
    behaviour = whole.unionByName(_named(whole.agg(rollup.geometric_mean(F.col("value")).alias("value")), "composite_score", "value")).collect()
    blocks += [("behavior_scores", r.metric, r.value) for r in behaviour]
    composites.append(next((r.value for r in behaviour if r.metric == "composite_score"), None))
    known = [v for v in composites if v is not None]
    blocks += [("composite", m, v) for m, v in zip(("cross_composite", "neuro_composite", "etho_composite"), composites, strict=True)]
    blocks.append(("composite", "composite", sum(known) / len(known) if known else None))
    short.unpersist()
    paired.unpersist()
    return predictions.sparkSession.createDataFrame(blocks, "block string, metric string, value double")


# Scores with the data of their figures.


def run_neuro_full_analysis(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> tuple[DataFrame, dict[str, DataFrame]]:
    scores = compute_neuro_scores(predictions, ground_truth, config)
    paired = truncated(aligned(ground_truth, predictions, config))
    return scores, reports.neuro_report(paired, _values(paired, config), scores)


def run_etho_full_analysis(ground_truth: DataFrame, predictions: DataFrame, config: Config = Config()) -> tuple[tuple[DataFrame, DataFrame, DataFrame], dict[str, DataFrame]]:
    scores = compute_etho_scores(ground_truth, predictions, config)
    paired = aligned(ground_truth, predictions, config, same_columns=True)
    parts = parts_of([c[:-3] for c in paired.columns if c.endswith("_gt")])
    tables = {"load": reports.load_stats(*(canonical(d, config.sequence_key, config.time_key) for d in (ground_truth, predictions)))}
    return scores, tables | reports.etho_report(paired, parts, config.center_part, config.body_axis)


def run_cross_full_analysis(predictions: DataFrame, ground_truth: DataFrame, config: Config = Config()) -> tuple[DataFrame, dict[str, DataFrame]]:
    scores = compute_cross_scores(predictions, ground_truth, config)
    return scores, {"bars": reports.cross_bars(scores.filter("block = 'cross_scores'"))}
