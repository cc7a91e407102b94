"""Structural scores of region traces: spectra, precision, lags, and corruptions
by which scores are tried out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import Kept
from ..functions.stats import correlation01, from_distance, rmse_similarity
from ..plans.align import KEYS, SEQ, TIME, pair
from . import groupwise, latent, linear, neuro

_EPS = 1e-8
ScoreFunction = Callable[[DataFrame, list[str]], DataFrame]
Corruption = Callable[[DataFrame, list[str], float, int], DataFrame]
LEVELS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def _one(paired: DataFrame, score: float | None) -> DataFrame:
    return linear._row(paired.sparkSession, score=score)


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    """1 / (1 + root mean square gap in scales of x)."""
    scale = next((s for s in (x.std(), np.abs(x).mean()) if s >= 1e-8), 1.0)
    return float(1 / (1 + np.sqrt(((x - y) ** 2).mean()) / scale))


def spectrum_similarity(x: np.ndarray, y: np.ndarray) -> float | None:
    """.55 correlation of logarithms + .45 RMSE similarity, of equal lengths."""
    n = min(len(x), len(y))
    if not n:
        return None
    x, y = x[:n], y[:n]
    a, b = np.log(x + _EPS), np.log(y + _EPS)
    if n < 3 or a.std() < 1e-8 or b.std() < 1e-8:
        return _alike(x, y)
    return float(0.55 * (np.corrcoef(a, b)[0, 1] + 1) / 2 + 0.45 * _alike(x, y))


def _spectrum(matrix: np.ndarray) -> np.ndarray:
    values = np.linalg.eigvalsh(matrix)
    values = np.sort(values[values > 0])[::-1]
    return values / values.sum() if values.sum() >= _EPS else values[:0]


def covariances(paired: DataFrame, values: list[str]) -> list[np.ndarray]:
    """Shrunk covariances of either side in its own robust scales."""
    return linear.robust_covariances(paired, values)


def precision_scores(paired: DataFrame, values: list[str]) -> DataFrame:
    """(metric, value): partial correlations, effective dimension, spectra of
    the covariance and of its inverse."""
    both = covariances(paired, values)
    inverse = [np.linalg.inv(c) for c in both]
    partial = []
    for p in inverse:
        d = np.sqrt(np.maximum(np.diag(p), _EPS))
        m = np.clip(-p / np.outer(d, d), -1, 1)
        np.fill_diagonal(m, 1.0)
        partial.append(m)
    dimension = [np.trace(c) ** 2 / (c**2).sum() / len(values) for c in both]
    rows = {
        "PartialCorr_score": linear._matrix_score(*partial), "Dimensionality_score": 1 / (1 + abs(dimension[0] - dimension[1]) / max(dimension[0], 1e-6)),
        "PrecisionMatrixSpectrum_score": spectrum_similarity(*map(_spectrum, inverse)), "EigenspectrumShape_score": spectrum_similarity(*map(_spectrum, both)),
    }
    return paired.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in rows.items()], "metric string, value double")


def spectrum_shape(paired: DataFrame, values: list[str], size: int = 256) -> DataFrame:
    """PSDShape: mean power spectra of both sides, compared in logarithms."""
    mean = groupwise.band_power(paired, values, size, least=32).groupBy("frequency").agg(F.avg("gt").alias("gt"), F.avg("inf").alias("inf"))
    log = lambda c: F.log(F.col(c) + _EPS)
    parts = mean.agg(correlation01(log("gt"), log("inf")).alias("c"), rmse_similarity(F.col("gt"), F.col("inf")).alias("r"))
    return parts.select(F.when(F.col("c").isNull(), F.col("r")).otherwise(0.55 * F.col("c") + 0.45 * F.col("r")).alias("score"))


def reconstruction_transfer(paired: DataFrame, values: list[str]) -> DataFrame:
    """PCA score, squared: how well the ground truth's directions hold the
    variance of the prediction, from the moments of the projections."""
    basis = latent.gt_basis(paired, values, 8)
    if basis is None:
        return _one(paired, None)
    rows = latent.complete(paired, values)
    z = [f"z{j}" for j in range(basis.k)]
    got = {}
    for s in ("gt", "inf"):
        side = rows.select(*[F.col(f"{v}_{s}").alias(v) for v in values])
        side = side.select(*[basis.standardised(v, i).alias(v) for i, v in enumerate(values)], *[basis.projection(j).alias(z[j]) for j in range(basis.k)])
        # what is left of a row after its projection on orthonormal directions
        got[s] = side.agg(F.avg(sum((F.col(v) * F.col(v) for v in values), F.lit(0.0))).alias("whole"), F.avg(sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))).alias("held"), *[F.var_pop(c).alias(c) for c in z]).first()
    share = lambda r: 1 - ((r["whole"] - r["held"]) / len(values)) / (r["whole"] / len(values) + _EPS)
    gaps = np.mean([abs(got["inf"][c] - got["gt"][c]) / (got["gt"][c] + 0.05) for c in z])
    held = float(np.clip(share(got["inf"]) / (share(got["gt"]) + _EPS), 0, 1))
    return _one(paired, float(np.clip(0.5 * held + 0.5 / (1 + gaps), 0, 1)) ** 2)


def _shortest(paired: DataFrame) -> int:
    return paired.groupBy(SEQ).count().agg(F.min("count")).first()[0] or 0


def autocorrelation_score(paired: DataFrame, values: list[str], most: int = 48) -> DataFrame:
    """AUTO score, squared: mean autocorrelations of each region, lags weighed
    by 1 / sqrt(lag)."""
    top = min(most, _shortest(paired) // 6)
    if top < 1:
        return _one(paired, None)
    mean = neuro.autocorrelations(paired, values, top).groupBy("region", "lag").agg(F.avg("gt").alias("gt"), F.avg("inf").alias("inf"))
    w = 1.0 / F.sqrt("lag")
    gap, size = (F.col("inf") - F.col("gt")) * w, F.col("gt") * w
    each = mean.groupBy("region").agg(from_distance(F.sqrt(F.avg(gap * gap)) / (F.sqrt(F.avg(size * size)) + 0.05)).alias("s"))
    return each.agg(F.pow(F.avg("s"), 2).alias("score"))


def _agreement(pairs: DataFrame) -> DataFrame:
    """Half correlation, half mean gap in robust scales of the ground truth.
    The table has a row a pair of regions."""
    q = F.percentile("gt", F.array(F.lit(0.25), F.lit(0.75)))
    scale = latent.robust_scale(F.get(q, F.lit(0)), F.get(q, F.lit(1)), F.stddev_pop("gt"), F.count("gt"))
    gap = from_distance(F.avg(F.abs(F.col("inf") - F.col("gt"))) / (scale + _EPS))
    return pairs.agg(correlation01(F.col("gt"), F.col("inf")).alias("c"), gap.alias("d")).select((0.5 * F.col("c") + 0.5 * F.col("d")).alias("score"))


def lagged_agreement(paired: DataFrame, values: list[str]) -> DataFrame:
    """Mean agreement of the correlations at lag 0 and at lag 1."""
    now, later = _agreement(neuro.correlations(paired, values)), _agreement(neuro.lagged_correlations(paired, values))
    return now.unionByName(later).agg(F.avg("score").alias("score"))


def cross_correlations(paired: DataFrame, pairs: list[tuple[str, str]], most: int) -> DataFrame:
    """(a, b, lag, gt, inf): mean over sequences of the full cross-correlation
    within ``most`` lags; a sequence needs ``most`` + 5 rows."""
    whole, by = Window.partitionBy(SEQ), Window.partitionBy(SEQ).orderBy(TIME)
    names = sorted({v for p in pairs for v in p})
    centred = paired.select(SEQ, TIME, *[(F.col(f"{v}_{s}") - F.avg(f"{v}_{s}").over(whole)).alias(f"{v}_{s}") for v in names for s in ("gt", "inf")])
    lags = range(-most, most + 1)
    shifted = centred.select(SEQ, *[f"{v}_{s}" for v in names for s in ("gt", "inf")], *[F.lead(f"{v}_{s}", k).over(by).alias(f"{v}_{s}_{k + most}") for v in sorted({a for a, _ in pairs}) for s in ("gt", "inf") for k in lags])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.struct(F.col(f"{a}_{s}").alias("x"), F.col(f"{b}_{s}").alias("y"), F.array(*[F.col(f"{a}_{s}_{k + most}") * F.col(f"{b}_{s}") for k in lags]).alias("p")).alias(s) for s in ("gt", "inf")]) for a, b in pairs])
    rows = shifted.select(SEQ, F.explode(cells).alias("c")).select(SEQ, "c.*")
    size = lambda s: F.sqrt(F.sum(F.col(f"{s}.x") * F.col(f"{s}.x")) * F.sum(F.col(f"{s}.y") * F.col(f"{s}.y")))
    at = lambda s, k: F.when(size(s) >= _EPS, F.sum(F.get(f"{s}.p", F.lit(k))) / size(s))
    sums = rows.groupBy(SEQ, "a", "b").agg(F.count("*").alias("n"), *[F.array(*[at(s, k) for k in range(2 * most + 1)]).alias(s) for s in ("gt", "inf")]).filter(F.col("n") >= most + 5)
    flat = sums.select("a", "b", F.posexplode(F.arrays_zip("gt", "inf")).alias("lag", "z")).select("a", "b", (F.col("lag") - most).alias("lag"), "z.gt", "z.inf")
    return flat.groupBy("a", "b", "lag").agg(F.avg("gt").alias("gt"), F.avg("inf").alias("inf"))


def strong_pairs(paired: DataFrame, values: list[str], share: float = 0.75) -> list[tuple[str, str]]:
    """Pairs of regions whose correlation in the ground truth is at least the
    quantile of all pairs; their number depends on the regions alone."""
    edges = neuro.correlations(paired, values)
    limit = edges.agg(F.percentile(F.abs("gt"), share).alias("limit"))
    return [(r["a"], r["b"]) for r in edges.crossJoin(F.broadcast(limit)).filter(F.abs("gt") >= F.col("limit")).orderBy("a", "b").collect()]


def edge_profiles(paired: DataFrame, values: list[str], most: int = 16) -> DataFrame:
    """Curves, peak lags and peak heights of the strongest pairs."""
    top = min(most, _shortest(paired) // 12)
    pairs = strong_pairs(paired, values)
    if not pairs or top < 1:
        return _one(paired, None)
    curves = cross_correlations(paired, pairs, top)
    peak = lambda s: F.max_by(F.struct("lag", F.col(s).alias("v")), F.struct(F.abs(s), -F.col("lag")))
    q = F.percentile("gt", F.array(F.lit(0.25), F.lit(0.75)))
    scale = latent.robust_scale(F.get(q, F.lit(0)), F.get(q, F.lit(1)), F.stddev_pop("gt"), F.count("gt"))
    each = curves.groupBy("a", "b").agg(correlation01(F.col("gt"), F.col("inf")).alias("curve"), peak("gt").alias("g"), peak("inf").alias("i"), scale.alias("scale"))
    lag = 1.0 - F.abs(F.col("i.lag") - F.col("g.lag")) / top
    height = from_distance(F.abs(F.col("i.v") - F.col("g.v")) / (F.col("scale") + _EPS))
    mean = F.when(F.col("curve").isNull(), (lag + height) / 2).otherwise((F.col("curve") + lag + height) / 3)
    return each.agg(F.avg(mean).alias("score"))


def cross_correlation_score(paired: DataFrame, values: list[str]) -> DataFrame:
    """CC score: .75 lagged agreement, .25 profiles of the strongest pairs."""
    parts = []
    for score, weight in ((lagged_agreement, 0.75), (edge_profiles, 0.25)):
        # one part after the other, so that their shuffles don't add up
        with linear.released(paired.sparkSession):
            parts.append((_one(paired, score(paired, values).first()["score"]), weight))
    return latent._weighed(parts)


#: Scores that may replace others, each a function of the paired frame and its regions.
REPLACEMENTS: dict[str, ScoreFunction] = {
    "PCA_score": reconstruction_transfer, "MOM_score": neuro.moments, "GRAPH_score": neuro.graph, "AUTO_score": autocorrelation_score, "CC_score": cross_correlation_score,
    "BP_score": groupwise.band_power_score, "TRJDIST_score": latent.trajectory_score, "MANI_score": latent.manifold_score,
}


def structural_scores(paired: DataFrame, values: list[str]) -> DataFrame:
    """(metric, value) of all structural scores."""
    named = lambda d, m: d.select(F.lit(m).alias("metric"), F.col("score").cast("double").alias("value"))
    return precision_scores(paired, values).unionByName(named(spectrum_shape(paired, values), "PSDShape_score"))


# Corruptions of a frame (sequenceId, itemPosition, regions) by a level of 0 to 1.


def _draw(seed: int, *parts: Column | str) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) + 0.5) * 2.0**-53


def shuffle_in_time(df: DataFrame, values: list[str], level: float, seed: int = 0) -> DataFrame:
    """Each region of a sequence blended with itself in shuffled order."""
    at = F.row_number().over(Window.partitionBy(SEQ).orderBy(TIME)).alias("__at")
    out = df.select(*KEYS, *values, at)
    for v in values:
        order = Window.partitionBy(SEQ).orderBy(F.xxhash64(F.lit(seed), SEQ, TIME, F.lit(v)))
        moved = df.select(SEQ, F.row_number().over(order).alias("__at"), F.col(v).alias(f"__{v}"))
        out = out.join(moved, [SEQ, "__at"])
    return out.select(*KEYS, *[((1 - level) * F.col(v) + level * F.col(f"__{v}")).alias(v) for v in values])


def permute_regions(df: DataFrame, values: list[str], level: float, seed: int = 0) -> DataFrame:
    """Regions blended with one permutation of them."""
    order = np.random.default_rng(seed).permutation(len(values))
    return df.select(*KEYS, *[((1 - level) * F.col(v) + level * F.col(values[order[i]])).alias(v) for i, v in enumerate(values)])


def shift_regions(df: DataFrame, values: list[str], level: float, seed: int = 0) -> DataFrame:
    """Each region of a sequence turned round by its own number of rows, at most
    level * min(24, rows / 6), and one at least."""
    whole = Window.partitionBy(SEQ)
    n, at = F.count("*").over(whole), F.row_number().over(whole.orderBy(TIME)) - 1
    rows = df.select(*KEYS, *values, n.alias("__n"), at.alias("__at"))
    most = F.greatest(F.lit(1), F.round(F.lit(level) * F.least(F.lit(24), F.floor(F.col("__n") / 6)))).cast("int")
    out = rows
    for v in values:
        shift = F.floor(_draw(seed, SEQ, F.lit(v)) * (2 * most + 1)).cast("int") - most
        moved = rows.select(SEQ, F.pmod(F.col("__at") + shift, F.col("__n")).alias("__at"), F.col(v).alias(f"__{v}"))
        out = out.join(moved, [SEQ, "__at"])
    return out.select(*KEYS, *[F.col(f"__{v}").alias(v) for v in values])


def scale_gains(df: DataFrame, values: list[str], level: float, seed: int = 0) -> DataFrame:
    """Regions blended with themselves times a lognormal gain (sigma .55)."""
    gains = np.random.default_rng(seed).lognormal(0.0, 0.55, len(values))
    return df.select(*KEYS, *[(F.col(v) * float(1 - level + level * g)).alias(v) for v, g in zip(values, gains, strict=True)])


def add_noise(df: DataFrame, values: list[str], sigma: float, seed: int = 0, relative: bool = False) -> DataFrame:
    """Gaussian noise of deviation ``sigma``, or of that share of each region's
    own deviation."""
    normal = lambda v: F.sqrt(-2.0 * F.log(_draw(seed, SEQ, TIME, F.lit(v), F.lit(1)))) * F.cos(2 * np.pi * _draw(seed, SEQ, TIME, F.lit(v), F.lit(2)))
    if not relative:
        return df.select(*KEYS, *[(F.col(v) + sigma * normal(v)).alias(v) for v in values])
    scales = df.agg(*[F.stddev_pop(v).alias(f"__{v}") for v in values])
    return df.crossJoin(F.broadcast(scales)).select(*KEYS, *[(F.col(v) + sigma * F.col(f"__{v}") * normal(v)).alias(v) for v in values])


CORRUPTIONS: dict[str, Corruption] = {"time_shuffle_blend": shuffle_in_time, "region_permute_blend": permute_regions, "region_shift_desync": shift_regions, "gain_scaling_blend": scale_gains, "gaussian_noise": add_noise}


def sweep(gt: DataFrame, values: list[str], score: ScoreFunction, corrupt: Corruption, family: str, levels: tuple[float, ...] = LEVELS, seed: int = 0) -> DataFrame:
    """(family, magnitude, score): the ground truth against itself, corrupted
    ever more; the family of level 0 is ``baseline``."""
    out = None
    for level in levels:
        found = score(pair(gt, corrupt(gt, values, level, seed)), values)
        row = found.select(F.lit(family if level > 0 else "baseline").alias("family"), F.lit(float(level)).alias("magnitude"), F.col("score").cast("double").alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def standardised(paired: DataFrame, values: list[str]) -> DataFrame:
    """Both sides in means and deviations of the ground truth (below 1e-8: 1)."""
    stats = paired.agg(*[x for v in values for x in (F.avg(f"{v}_gt").alias(f"__m_{v}"), F.stddev_pop(f"{v}_gt").alias(f"__s_{v}"))])
    scale = lambda v: F.when(F.col(f"__s_{v}") < _EPS, 1.0).otherwise(F.col(f"__s_{v}"))
    return paired.crossJoin(F.broadcast(stats)).select(*KEYS, *[((F.col(f"{v}_{s}") - F.col(f"__m_{v}")) / scale(v)).alias(f"{v}_{s}") for s in ("gt", "inf") for v in values])


def sliding_states(paired: DataFrame, values: list[str], k: int = 4, width: int = 45, step: int = 15) -> DataFrame:
    """Agreement of the states that windows of correlations fall into: each
    window's pairwise correlations, clustered on the ground truth."""
    from .clusters import centres

    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    names = [f"p{j}" for j in range(len(pairs))]
    both = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in names]) for s in ("gt", "inf")])
    with Kept(paired.sparkSession) as keep:
        tables = keep(neuro.sliding_pairs(paired, pairs, width, step))
        rows = tables.select(SEQ, F.col("start").alias(TIME), F.explode(both).alias("s")).select(SEQ, TIME, "s.*").dropna()
        assigned = keep(neuro.states(rows, names, centres(rows.filter("side = 'gt'"), names, k)).select("side", SEQ, TIME, "state"))
        shares = [neuro.occupancy(assigned, k), neuro.transitions(assigned, k)]
        found = [(metric, neuro.histogram_similarity(x).first()["score"]) for metric, x in zip(("occupancy", "transition"), shares, strict=True)]
    return paired.sparkSession.createDataFrame(found, "metric string, score double")
