"""Trajectory and manifold scores in the main directions of the ground truth."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.quantiles import quantiles
from ..functions.shared import Kept
from ..functions.stats import correlation01, from_distance, norm
from ..plans.align import SEQ, TIME, sides
from .groupwise import _thinned
from .linear import _heads, _row, evenly, moments, numbered, pooled_leads

_EPS = 1e-8
#: Quantiles that a distribution is compared at, and weights.
GRID = (0.1, 0.25, 0.5, 0.75, 0.9)
TRAJECTORY_WEIGHTS, MANIFOLD_WEIGHTS = (0.60, 0.40), (0.75, 0.25)


@dataclass(frozen=True)
class Basis:
    """Means, deviations and main directions of the ground truth's regions."""

    values: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    vectors: np.ndarray
    ratios: np.ndarray

    @property
    def k(self) -> int:
        return self.vectors.shape[1]

    def standardised(self, column: str, i: int) -> Column:
        return (F.col(column) - F.lit(float(self.mean[i]))) / F.lit(float(self.deviation[i]))

    def projection(self, j: int, raw: bool = False) -> Column:
        """Direction j of standardised columns, or of raw ones."""
        total = F.lit(0.0)
        for i, v in enumerate(self.values):
            total = total + (F.col(v) if raw else self.standardised(v, i)) * F.lit(float(self.vectors[i, j]))
        return total


def complete(paired: DataFrame, values: list[str]) -> DataFrame:
    """Rows without a null on either side."""
    return paired.dropna(subset=[f"{v}_{s}" for v in values for s in ("gt", "inf")])


def choose_k(ratios: np.ndarray, n: int, k_max: int, target: float = 0.9) -> int:
    """The least number of directions that explain the target, 2 or more where
    the data allow it."""
    most = min(k_max, len(ratios), n - 1)
    if most < 2:
        return 1
    return int(np.clip(np.searchsorted(np.cumsum(ratios), target) + 1, 2, most))


def gt_basis(paired: DataFrame, values: list[str], k_max: int, least: int = 64) -> Basis | None:
    """Principal directions of the standardised ground truth, from its moments;
    signs make the largest weight positive.  None for fewer than ``least`` rows."""
    names = [f"{v}_gt" for v in values]
    n, mean, _, products = moments(complete(paired, values), names, names)
    if n < least:
        return None
    deviation = np.sqrt(np.maximum(np.diag(products) / n, 0))
    deviation = np.where(deviation < _EPS, 1.0, deviation)
    spectrum, vectors = np.linalg.eigh(products / n / np.outer(deviation, deviation))
    spectrum, vectors = np.maximum(spectrum[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])
    ratios = spectrum / spectrum.sum()
    return Basis(values, mean, deviation, vectors[:, : choose_k(ratios, n, min(k_max, len(values)))], ratios)


def projected(paired: DataFrame, basis: Basis, raw: bool = False) -> DataFrame:
    """(side, sequenceId, itemPosition, z0, z1, ...) of complete rows."""
    rows = sides(complete(paired, basis.values), basis.values)
    return rows.select("side", SEQ, TIME, *[basis.projection(j, raw).alias(f"z{j}") for j in range(basis.k)])


def robust_scale(q1: Column, q3: Column, deviation: Column, n: Column, floor: float = 0.05) -> Column:
    """Interquartile range, else the deviation, never below ``floor``."""
    iqr = q3 - q1
    return F.when(n < 4, floor).otherwise(F.greatest(F.lit(floor), F.when(iqr < floor, deviation).otherwise(iqr)))


def quantile_distance(rows: DataFrame, value: str, by: list[str], grid: tuple[float, ...] = GRID, least: int = 8) -> DataFrame:
    """(*by, distance): mean gap of both sides' quantiles in robust scales of
    the ground truth; rows have a column ``side``."""
    qs = quantiles(rows, value, [*by, "side"], [*grid, 0.25, 0.75])
    counted = rows.groupBy(*by, "side").agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"))
    both = qs.join(counted, [*by, "side"]).groupBy(*by).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("gt", "inf") for c in ("q", "n", "sd")])
    k = len(grid)
    scale = robust_scale(F.get("q_gt", F.lit(k)), F.get("q_gt", F.lit(k + 1)), F.col("sd_gt"), F.col("n_gt"))
    gaps = sum((F.abs(F.get("q_gt", F.lit(i)) - F.get("q_inf", F.lit(i))) for i in range(k)), F.lit(0.0)) / k
    return both.select(*by, F.when((F.col("n_gt") >= least) & (F.col("n_inf") >= least), gaps / (scale + _EPS)).alias("distance"))


def clipped_histogram(rows: DataFrame, value: str, by: list[str], bins: int = 12) -> DataFrame:
    """(*by, score): overlap of both sides' histograms over the middle 96 % of
    the ground truth, values beyond it in the outer bins."""
    gt = rows.filter("side = 'gt'")
    ends = quantiles(gt, value, by, [0.02, 0.98]).join(gt.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most")), by)
    flat = F.get("q", F.lit(0)) >= F.get("q", F.lit(1))
    ends = ends.select(*by, F.when(flat, F.col("least")).otherwise(F.get("q", F.lit(0))).alias("lo"), F.when(flat, F.col("most") + _EPS).otherwise(F.get("q", F.lit(1))).alias("hi"))
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    counts = rows.filter(F.col(value).isNotNull()).join(F.broadcast(ends), by).groupBy(*by, place.alias("bin")).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("gt", "inf")])
    whole = Window.partitionBy(*by)
    shares = counts.select(*by, *[(F.col(s) / (F.sum(s).over(whole) + _EPS)).alias(s) for s in ("gt", "inf")], *[F.sum(s).over(whole).alias(f"n_{s}") for s in ("gt", "inf")])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.5 * F.sum(F.abs(F.col("gt") - F.col("inf")))))
    return shares.groupBy(*by).agg(F.when((F.max("n_gt") >= bins + 2) & (F.max("n_inf") >= bins + 2), score).alias("score"))


def _null_score(paired: DataFrame) -> DataFrame:
    return paired.sparkSession.createDataFrame([(None,)], "score double")


def occupancy_velocity(paired: DataFrame, values: list[str]) -> DataFrame:
    """(part, score): occupancy of each direction, speed and turn.

    Velocities are differences of raw projections inside a sequence; turns run
    over all velocities in the order of sequence and time, so the last one of a
    sequence meets the first of the next, as the score is defined.
    """
    schema = "part string, score double"
    with Kept(paired.sparkSession) as keep:
        rows = keep(complete(paired, values).select(SEQ, TIME, *[f"{v}_{s}" for v in values for s in ("gt", "inf")]))
        basis = gt_basis(rows, values, 3)
        if basis is None:
            return paired.sparkSession.createDataFrame([], schema)
        z = projected(rows, basis)
        cells = z.select("side", F.explode(F.array(*[F.struct(F.lit(f"occupancy{j}").alias("part"), F.col(f"z{j}").alias("v")) for j in range(basis.k)])).alias("c")).select("side", "c.*")
        parts = clipped_histogram(cells, "v", ["part"]).collect()
        names = [f"v{j}" for j in range(basis.k)]
        raw = lambda s, j: sum((F.col(f"{v}_{s}") * F.lit(float(basis.vectors[i, j])) for i, v in enumerate(values)), F.lit(0.0))
        by = Window.partitionBy(SEQ).orderBy(TIME)
        moved = rows.select(SEQ, TIME, *[raw(s, j).alias(f"z{j}_{s}") for s in ("gt", "inf") for j in range(basis.k)])
        # both sides have the same rows, so they move side by side
        moved = moved.select(SEQ, TIME, *[(F.col(f"z{j}_{s}") - F.lag(f"z{j}_{s}").over(by)).alias(f"v{j}_{s}") for s in ("gt", "inf") for j in range(basis.k)]).dropna()
        moved = keep(numbered(moved.select("*", *[norm(*[F.col(f"{v}_{s}") for v in names]).alias(f"speed_{s}") for s in ("gt", "inf")])))
        columns = [f"{c}_{s}" for s in ("gt", "inf") for c in (*names, "speed")]
        heads = keep(_heads(moved, columns, 1))
        dot = lambda s: sum((F.col(f"{v}_{s}") * F.col(f"{v}_{s}_later_1") for v in names), F.lit(0.0))
        turn = lambda s: dot(s) / (F.col(f"speed_{s}") * F.col(f"speed_{s}_later_1") + _EPS)
        led = pooled_leads(moved, heads, columns, (1,)).filter("__some_1")
        turns = sides(keep(led.select(SEQ, TIME, *[turn(s).alias(f"turn_{s}") for s in ("gt", "inf")])), ["turn"])
        speed = quantile_distance(sides(moved, ["speed"]).withColumn("part", F.lit("speed")), "speed", ["part"])
        turned = quantile_distance(turns.withColumn("part", F.lit("turn")), "turn", ["part"], (0.1, 0.3, 0.5, 0.7, 0.9))
        parts += speed.unionByName(turned).select("part", from_distance(F.col("distance")).alias("score")).collect()
    return paired.sparkSession.createDataFrame(parts, schema)  # a row a direction, and two


def latent_path_features(paired: DataFrame, values: list[str], least: int = 5) -> DataFrame:
    """(side, sequenceId, path, displacement, radius, persistence, speed_lag1)
    of the projected traces of sequences with at least ``least`` rows."""
    basis = gt_basis(paired, values, 4)
    schema = T.StructType([T.StructField("side", T.StringType()), paired.schema[SEQ], *[T.StructField(c, T.DoubleType()) for c in ("path", "displacement", "radius", "persistence", "speed_lag1")]])
    if basis is None:
        return paired.sparkSession.createDataFrame([], schema)
    names = [f"z{j}" for j in range(basis.k)]
    z = projected(paired, basis)
    by, whole = Window.partitionBy("side", SEQ).orderBy(TIME), Window.partitionBy("side", SEQ)
    steps = z.select("side", SEQ, TIME, *names, norm(*[F.col(c) - F.lag(c).over(by) for c in names]).alias("speed"), norm(*[F.col(c) - F.avg(c).over(whole) for c in names]).alias("off"))
    steps = steps.withColumn("before", F.lag("speed").over(by))
    ends = [f(c, TIME).alias(f"{n}_{c}") for c in names for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    sums = steps.groupBy("side", SEQ).agg(F.sum("speed").alias("path"), F.avg("off").alias("radius"), correlation01(F.col("speed"), F.col("before")).alias("speed_lag1"), F.count("*").alias("n"), *ends).filter(F.col("n") >= least)
    net = norm(*[F.col(f"last_{c}") - F.col(f"first_{c}") for c in names])
    return sums.select("side", SEQ, "path", net.alias("displacement"), "radius", (net / (F.col("path") + _EPS)).alias("persistence"), "speed_lag1")


def path_feature_score(paired: DataFrame, values: list[str]) -> DataFrame:
    names = ["path", "displacement", "radius", "persistence", "speed_lag1"]
    features = latent_path_features(paired, values)
    mean = lambda s, c, f=lambda x: x: F.avg(F.when(F.col("side") == s, f(F.col(c))))
    gaps = features.agg(F.array(*[F.abs(mean("inf", c) - mean("gt", c)) / (mean("gt", c, F.abs) + _EPS) for c in names]).alias("g"))
    return gaps.select(F.explode("g").alias("g")).agg(from_distance(F.avg("g")).alias("score"))


def _weighed(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of one-row scores over those that aren't null."""
    rows = [d.agg(F.avg("score").alias("score")).withColumn("w", F.lit(w)) for d, w in parts]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    known = F.col("score").isNotNull()
    return both.agg(F.try_divide(F.sum(F.when(known, F.col("w") * F.col("score"))), F.sum(F.when(known, F.col("w")))).alias("score"))


def _held(paired: DataFrame, values: list[str], score) -> DataFrame:
    """One row with the score of the complete rows, which are kept while it is
    computed, as several passes read them."""
    rows = complete(paired, values).select(SEQ, TIME, *[f"{v}_{s}" for v in values for s in ("gt", "inf")]).persist()
    found = score(rows).first()["score"]
    rows.unpersist()
    return _row(paired.sparkSession, score=found)


def trajectory_score(paired: DataFrame, values: list[str]) -> DataFrame:
    """TRJDIST: .60 occupancy and velocity, .40 path features."""
    return _held(paired, values, lambda rows: _weighed([(occupancy_velocity(rows, values), TRAJECTORY_WEIGHTS[0]), (path_feature_score(rows, values), TRAJECTORY_WEIGHTS[1])]))


# Clouds of points and their topology.


def pooled_cloud(paired: DataFrame, values: list[str], most: int, k_max: int = 3) -> DataFrame | None:
    """(side, sequenceId, itemPosition, z...) of at most ``most`` rows a side,
    those whose keys hash lowest: the score is defined on a sample."""
    basis = gt_basis(paired, values, k_max)
    if basis is None:
        return None
    z = projected(paired, basis)
    # a bounded sample, read several times: its rows become a table of their own
    cloud = _thinned(z.filter("side = 'gt'"), most).unionByName(_thinned(z.filter("side = 'inf'"), most))
    return paired.sparkSession.createDataFrame(cloud.collect(), cloud.schema)


def stratified_cloud(paired: DataFrame, values: list[str], per_sequence: int = 2, most: int = 48, k_max: int = 3) -> DataFrame | None:
    """(side, ..., z...): evenly spaced rows of evenly spaced sequences."""
    basis = gt_basis(paired, values, k_max)
    if basis is None:
        return None
    rows = complete(paired, values)
    ids = rows.groupBy(SEQ).agg(F.count("*").alias("n")).filter(F.col("n") >= max(8, per_sequence + 1))
    ids = evenly(ids, most)
    at = F.row_number().over(Window.partitionBy("side", SEQ).orderBy(TIME)) - 1
    spaced = F.transform(F.sequence(F.lit(0), F.lit(per_sequence - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, per_sequence - 1)))
    z = projected(rows.join(F.broadcast(ids), SEQ), basis).withColumn("at", at).join(F.broadcast(ids), SEQ)
    cloud = z.filter(F.array_contains(spaced, F.col("at"))).drop("at", "n")
    return paired.sparkSession.createDataFrame(cloud.collect(), cloud.schema)


def landmarks(points: np.ndarray, n: int) -> np.ndarray:
    """Distances between n points chosen farthest first, from the first point."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    chosen, far = [0], d[0].copy()
    while len(chosen) < min(n, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, d[chosen[-1]])
    return d[np.ix_(chosen, chosen)]


def rips(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive finite lifetimes of components and of loops.

    Components die along the least spanning tree; loops are paired by reducing
    the triangles' boundaries over Z2, each a set of edges kept as the bits of
    an integer.
    """
    n = len(distances)
    edges = sorted((float(distances[i, j]), i, j) for i, j in itertools.combinations(range(n), 2))
    order = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    deaths, tree = [], set()
    for k, (length, i, j) in enumerate(edges):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            deaths.append(length)
            tree.add(k)
    triangles = sorted((max(order[i, j], order[i, k], order[j, k]), 1 << order[i, j] | 1 << order[i, k] | 1 << order[j, k]) for i, j, k in itertools.combinations(range(n), 3))
    pivots: dict[int, int] = {}
    loops = []
    for last, boundary in triangles:
        while boundary:
            low = boundary.bit_length() - 1
            if low not in pivots:
                pivots[low] = boundary
                if edges[last][0] > edges[low][0]:
                    loops.append(edges[last][0] - edges[low][0])
                break
            boundary ^= pivots[low]
        if len(pivots) == len(edges) - len(tree):
            break
    return np.array([x for x in deaths if x > 0]), np.array(loops)


def lifetimes(cloud: DataFrame, most: int = 64, least: int = 16) -> DataFrame:
    """(side, dimension, life) of each side's cloud, found in one task a side;
    a cloud has at most some hundred points."""
    names = [c for c in cloud.columns if c.startswith("z")]

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([SEQ, TIME])
        if len(rows) < least:
            return pd.DataFrame(columns=["side", "dimension", "life"])
        parts = rips(landmarks(rows[names].to_numpy(float), most))
        return pd.DataFrame({"side": rows["side"].iloc[0], "dimension": np.repeat([0, 1], [len(p) for p in parts]), "life": np.concatenate(parts)})

    return cloud.groupBy("side").applyInPandas(found, "side string, dimension int, life double")


def lifetime_similarity(lives: DataFrame) -> DataFrame:
    """(dimension, score) from (side, dimension, life): quantiles and sums of
    both sides; 1 where neither has any, 0 where only one has."""
    every = lives.sparkSession.createDataFrame([(0,), (1,)], "dimension int")
    distance = quantile_distance(lives, "life", ["dimension"], (0.25, 0.5, 0.75, 0.9))
    one = lambda s, f: f(F.when(F.col("side") == s, F.col("life")))
    sums = lives.groupBy("dimension").agg(*[one(s, f).alias(f"{n}_{s}") for s in ("gt", "inf") for n, f in (("n", F.count), ("sum", F.sum))])
    joined = every.join(sums, "dimension", "left").join(distance, "dimension", "left")
    total = F.abs(F.col("sum_gt") - F.col("sum_inf")) / (F.col("sum_gt") + 0.05)
    some = lambda s: F.coalesce(F.col(f"n_{s}"), F.lit(0)) > 0
    by_distance, by_total = from_distance(F.col("distance")), from_distance(total)
    mean = F.when(F.col("distance").isNull(), by_total).otherwise((by_distance + by_total) / 2)
    score = F.when(~some("gt") & ~some("inf"), 1.0).when(~some("gt") | ~some("inf"), 0.0).otherwise(mean)
    return joined.select("dimension", score.alias("score"))


def topology_score(cloud: DataFrame | None, paired: DataFrame, least: int = 16) -> DataFrame:
    if cloud is None:
        return _null_score(paired)
    sizes = {r["side"]: r["count"] for r in cloud.groupBy("side").count().collect()}
    if min(sizes.get("gt", 0), sizes.get("inf", 0)) < least:
        return _null_score(paired)
    return lifetime_similarity(lifetimes(cloud)).agg(F.avg("score").alias("score"))


def neighbour_profile(cloud: DataFrame, k: int = 5) -> DataFrame:
    """(side, distance): of each point of a cloud to its k-th neighbour."""
    names = [c for c in cloud.columns if c.startswith("z")]
    a, b = cloud.select("side", F.struct(SEQ, TIME).alias("i"), F.array(*names).alias("p")), cloud.select("side", F.struct(SEQ, TIME).alias("j"), F.array(*names).alias("q"))
    square = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)
    near = a.join(b, "side").filter("i <> j").select("side", "i", F.sqrt(square).alias("distance"))
    at = F.row_number().over(Window.partitionBy("side", "i").orderBy("distance"))
    return near.withColumn("at", at).filter(F.col("at") == k).select("side", "distance")


def _manifold(rows: DataFrame, values: list[str]) -> DataFrame:
    stratified = topology_score(stratified_cloud(rows, values), rows)
    life = topology_score(pooled_cloud(rows, values, 96), rows)
    cloud = pooled_cloud(rows, values, 128)
    if cloud is None:
        return _null_score(rows)
    near = quantile_distance(neighbour_profile(cloud), "distance", [], GRID).select(from_distance(F.col("distance")).alias("near"))
    local = life.crossJoin(near).select(F.sqrt(F.col("score") * F.col("near")).alias("score"))
    return _weighed([(stratified, MANIFOLD_WEIGHTS[0]), (local, MANIFOLD_WEIGHTS[1])])


def manifold_score(paired: DataFrame, values: list[str]) -> DataFrame:
    """MANI: .75 topology of the stratified cloud, .25 topology with neighbours."""
    return _held(paired, values, lambda rows: _manifold(rows, values))


def betti_curve_similarity(lives: DataFrame, points: int = 32) -> DataFrame:
    """(dimension, score): how many features outlive each of ``points`` levels."""
    top = lives.groupBy("dimension").agg(F.max("life").alias("top"))
    levels = lives.join(top, "dimension").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    alive = (F.col("life") > F.col("top") * F.col("k") / (points - 1)).cast("int")
    curve = levels.groupBy("dimension", "k").agg(*[F.sum(F.when(F.col("side") == s, alive).otherwise(0)).cast("double").alias(s) for s in ("gt", "inf")])
    distance = F.avg(F.abs(F.col("gt") - F.col("inf"))) / (F.avg("gt") + _EPS)
    both = curve.groupBy("dimension").agg(correlation01(F.col("gt"), F.col("inf")).alias("c"), from_distance(distance).alias("d"))
    return both.select("dimension", F.when(F.col("c").isNull(), F.col("d")).otherwise((F.col("c") + F.col("d")) / 2).alias("score"))
