"""Scores of clustered behaviour and latent states."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.shared import Kept
from ..plans.align import SEQ, TIME, sides
from . import etho, linear, neuro


#: Rounds and candidates a round (for each centre) of the first choice.
DRAWS, OVERSAMPLED = 4, 2


def _nearest(points: list[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of points given by coordinate, the first of equally
    near ones, and its squared distance."""
    state, least = np.zeros(len(points[0]), np.int16), None
    for j, centre in enumerate(centres):
        d = points[0] - centre[0]
        d *= d
        for x, v in zip(points[1:], centre[1:], strict=True):
            off = x - v
            off *= off
            d += off
        if least is None:
            least = d
        else:
            state[d < least] = j
            np.minimum(least, d, out=least)
    return state, least


def _points(batch: pa.RecordBatch, at: slice = slice(None)) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns[at]]


def _farthest(found: np.ndarray, most: int):
    """Of a task's rows (values, __u) the ``most`` different ones with the least
    -ln(u) / d2 to the nearest of the found, with that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((0, found.shape[1] + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch, slice(0, -1))
            d = _nearest(x, found)[1]
            with np.errstate(divide="ignore"):
                keyed = np.column_stack([-np.log(batch.column(batch.num_columns - 1).to_numpy()) / d, *x])[d > 0]
            # equal rows have equal keys; the first columns order all
            if len(best) == most:
                keyed = keyed[keyed[:, 0] <= best[-1, 0]]
            if len(keyed):
                if len(keyed) > 50 * most:
                    few = np.unique(keyed[:, 0])
                    keyed = keyed[keyed[:, 0] <= few[min(most, len(few)) - 1]]
                best = np.unique(np.vstack([best, keyed]), axis=0)[:most]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, i].copy()) for i in range(best.shape[1])], ["__key", *[f"x{i}" for i in range(found.shape[1])]])

    return run


def _sums(centres: np.ndarray, unit: float):
    """(state, n, x...): a task's rows at each centre, the first of equally near
    ones, and the sums of their values in whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centres.shape
        n, total = np.zeros(k, np.int64), np.zeros((d, k), np.int64)
        for batch in batches:
            x = _points(batch)
            near = _nearest(x, centres)[0]
            n += np.bincount(near, minlength=k)
            for i in range(d):
                np.add.at(total[i], near, np.rint(x[i] * unit).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), *[pa.array(t) for t in total]], ["state", "n", *[f"x{i}" for i in range(d)]])

    return run


def _first_centres(points: np.ndarray, weights: np.ndarray, k: int, seed: int, tries: int = 10) -> np.ndarray:
    """k of the weighted candidates by k-means++, then moved to the means of
    theirs; the best of several tries."""
    best, cost = points[:k], np.inf
    for t in range(tries):
        rng = np.random.default_rng([seed, t])
        chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
        while len(chosen) < k:
            d = ((points[:, None] - points[chosen][None]) ** 2).sum(2).min(1) * weights
            if not d.sum():
                break
            chosen.append(int(rng.choice(len(points), p=d / d.sum())))
        found = points[chosen]
        for _ in range(20):
            near = ((points[:, None] - found[None]) ** 2).sum(2)
            at = near.argmin(1)
            found = np.array([np.average(points[at == j], axis=0, weights=weights[at == j]) if weights[at == j].sum() else found[j] for j in range(len(found))])
        total = float((((points[:, None] - found[None]) ** 2).sum(2).min(1) * weights).sum())
        if total < cost:
            best, cost = found, total
    return best


def centres(df: DataFrame, columns: list[str], k: int, seed: int = 0, steps: int = 50, tolerance: float = 1e-6) -> list[list[float]]:
    """At most k cluster centres, fitted on all rows; fewer where there are
    fewer different rows.

    First candidates come from a few rounds over all rows (k-means||, Bahmani et
    al., 2012): in each the rows with the least -ln(u) / d2 are drawn, with u
    from the hash of a row's values and d2 its squared distance to the nearest
    candidate.  Then rows go to their nearest centre and centres to the means of
    their rows, one aggregate a step.  Sums are whole numbers of a fixed unit,
    so centres don't depend on how rows are spread over tasks.
    """
    with Kept(df.sparkSession) as keep:
        rows = keep(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
        facts = rows.agg(F.count("*").alias("n"), F.max(F.greatest(*[F.abs(c) for c in columns], F.lit(0.0))).alias("top")).first()
        if not facts["n"]:
            return []
        unit = 2.0 ** min(52, 61 - math.ceil(math.log2(facts["n"] + 1)) - math.ceil(math.log2(max(facts["top"], 2.0**-20))))
        hashed = F.xxhash64(*columns, F.lit(seed))
        first = rows.orderBy(hashed, *columns).limit(1).collect()
        found = [[float(r[c]) for c in columns] for r in first]
        names = [f"x{i}" for i in range(len(columns))]
        doubles = ", ".join(f"{c} double" for c in names)
        for t in range(DRAWS):
            u = (F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(t)), F.lit(2**52)) + 0.5) / 2.0**52
            # proven bound: some candidates a round, each task's own best among them
            best = rows.select(*columns, u.alias("__u")).mapInArrow(_farthest(np.array(found), OVERSAMPLED * k), f"__key double, {doubles}")
            found += [[float(r[c]) for c in names] for r in best.distinct().orderBy("__key", *names).limit(OVERSAMPLED * k).collect()]
        longs = ", ".join(f"{c} long" for c in names)

        def step(centres: np.ndarray) -> tuple[list[int], list[list[int]]]:
            """Rows at each centre and their sums; a row a task and centre comes
            to the driver, which adds whole numbers."""
            n, total = [0] * len(centres), [[0] * len(names) for _ in centres]
            for r in rows.mapInArrow(_sums(centres, unit), f"state int, n long, {longs}").filter("n > 0").collect():
                n[r["state"]] += r["n"]
                total[r["state"]] = [a + r[c] for a, c in zip(total[r["state"]], names, strict=True)]
            return n, total

        counts = np.array(step(np.array(found))[0], float)
        now = _first_centres(np.array(found), counts, min(k, len(found)), seed)
        for _ in range(steps):
            moved = now.copy()
            for state, (n, total) in enumerate(zip(*step(now), strict=True)):
                if n:
                    moved[state] = [v / unit / n for v in total]
            far, now = float(np.abs(moved - now).max()), moved
            if far <= tolerance * max(facts["top"], 1e-300):
                break
    return [[float(v) for v in c] for c in now]


def _shares(features: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Score of the shares of clusters, of each sequence and of all."""
    features = features.dropna(subset=columns)
    empty = T.StructType([features.schema[SEQ], T.StructField("score", T.DoubleType()), T.StructField("weight", T.LongType())])
    if features.limit(2 * k).count() < 2 * k:
        return features.sparkSession.createDataFrame([], empty)
    assigned = neuro.states(features, columns, centres(features, columns, k))
    counts = assigned.groupBy("side", SEQ, "state").agg(F.count("*").alias("n"), F.lit(1.0).alias("width"))
    return etho._each_and_whole(counts, ["state"], k)


def syllables(paired: DataFrame, center: str = "CENTER", k: int = 8) -> DataFrame:
    """Clusters of each step's speed and the acceleration that follows."""
    by = Window.partitionBy("side", SEQ).orderBy(TIME)
    moved = etho.both_steps(paired, center)
    # the step before is the last one that is known
    before = F.last("speed", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    features = moved.select("side", SEQ, TIME, before.alias("speed"), F.when(F.col("speed").isNotNull(), F.col("acceleration")).alias("acceleration"))
    return _shares(features.filter("acceleration is not null"), ["speed", "acceleration"], k)


def trajectory_shapes(paired: DataFrame, center: str = "CENTER", k: int = 6) -> DataFrame:
    """Clusters of the sequences' path features."""
    return _shares(etho.path_features(paired, center), ["path", "net", "straightness", "speed", "turn"], k)


def latent_states(paired: DataFrame, values: list[str], occupancies: tuple[int, ...] = (11, 12), moving: int = 11, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(metric, value): agreement of occupancy and moves of latent states.

    Both sides are scaled by the ground truth's median and interquartile range
    and projected on its three main directions; states are the nearest of the
    centres fitted on the ground truth.
    """
    with Kept(paired.sparkSession) as keep:
        rows = keep(sides(paired, values))
        scale = linear.stored_middles(rows.filter("side = 'gt'"), values)
        scaled = rows.select("side", SEQ, TIME, *[((F.col(v) - scale[v][0]) / scale[v][1]).alias(v) for v in values])
        n, mean, _, products = linear.moments(scaled.filter("side = 'gt'"), values, values)
        vectors = np.linalg.eigh(products)[1][:, ::-1][:, :3]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
        names = [f"z{j}" for j in range(vectors.shape[1])]
        project = lambda j: sum(((F.col(v) - F.lit(float(m))) * F.lit(float(vectors[i, j])) for i, (v, m) in enumerate(zip(values, mean, strict=True))), F.lit(0.0))
        latent = keep(scaled.dropna(subset=values).select("side", SEQ, TIME, *[project(j).alias(z) for j, z in enumerate(names)]))
        scores: list[tuple[str, float | None]] = []
        for k in sorted({*occupancies, moving}):
            assigned = keep(neuro.states(latent, names, centres(latent.filter("side = 'gt'"), names, k, seed=k)).select("side", SEQ, TIME, "state"))
            if k in occupancies:
                scores.append((f"LatentStateOccupancyK{k}_score", neuro.histogram_similarity(neuro.occupancy(assigned, k)).first()["score"]))
            if k == moving:
                scores += [(f"LatentStateTransitionLag{lag}K{k}_score", neuro.histogram_similarity(neuro.transitions(assigned, k, lag)).first()["score"]) for lag in lags]
    return paired.sparkSession.createDataFrame(scores, "metric string, value double")
