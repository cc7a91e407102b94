"""Matrix scores from sufficient statistics.

Executors sum products of columns; the driver gets one row of them, whose size
depends on the number of regions alone, and solves the small systems there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.quantiles import column_quantiles
from ..functions.shared import Kept, released
from ..plans.align import SEQ, TIME


#: Ranges that a table of sequences is cut into where its order matters.
RANGES = 64


def _ranges(ids: DataFrame, ranges: int) -> list:
    """At most ``ranges`` - 1 ids that cut the sorted ids (one a row) into
    ranges of about equal size: quantiles of at most some 64 times as many ids,
    those whose hashes are multiples of a number that follows from the count."""
    n = ids.count()
    every = max(1, n // (64 * ranges))
    some = sorted(r[SEQ] for r in ids.filter(F.pmod(F.xxhash64(SEQ), F.lit(every)) == 0).select(SEQ).collect())
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def evenly(ids: DataFrame, most: int, ranges: int = RANGES) -> DataFrame:
    """``most`` evenly spaced rows of ``ids`` in the order of their ids (a row
    an id): those of rank floor(i (n - 1) / (most - 1)); all if there are no
    more.  Ranks are counted within ranges of ids, and the ranges' sizes added.
    """
    n = ids.count()
    if n <= most:
        return ids
    cuts = _ranges(ids, ranges)
    place = sum((F.when(F.col(SEQ) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = ids.withColumn("__range", place)
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(len(cuts))])])
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(SEQ)) - 1 + F.get(F.array(*[F.lit(int(b)) for b in before]), F.col("__range"))
    wanted = sorted({i * (n - 1) // max(1, most - 1) for i in range(most)})
    return placed.withColumn("__rank", rank).filter(F.col("__rank").isin(wanted)).select(*ids.columns)


def following(heads: DataFrame, lag: int, ranges: int = RANGES) -> DataFrame:
    """(sequenceId, __next): the first rows of the sequences after each one, as
    far as ``lag`` rows may reach, from (sequenceId, __head).

    Sequences are cut into ranges of ids.  A range is ordered on its own, and
    only the first sequences of each range, at most ``lag`` of them, are handed
    to the ranges before it, so no task orders all sequences.
    """
    cuts = _ranges(heads, ranges)
    place = sum((F.when(F.col(SEQ) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = heads.withColumn("__range", place)
    by = Window.partitionBy("__range").orderBy(SEQ)
    own = placed.select(SEQ, "__range", F.flatten(F.collect_list("__head").over(by.rowsBetween(1, lag))).alias("__own"))
    firsts = placed.withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= lag)
    firsts = firsts.groupBy("__range").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__head"))), lambda x: x["__head"])).alias("__first"))
    # at most ``ranges`` rows: those after each range, in order
    table = {r["__range"]: r["__first"] for r in firsts.collect()}
    later: dict[int, list] = {}
    for k in range(len(cuts) + 1):
        later[k] = [x for j in range(k + 1, len(cuts) + 1) for x in table.get(j, [])][:lag]
    schema = T.StructType([T.StructField("__range", T.IntegerType()), T.StructField("__after", heads.schema["__head"].dataType)])
    after = heads.sparkSession.createDataFrame([(k, v) for k, v in later.items()], schema)
    return own.join(F.broadcast(after), "__range").select(SEQ, F.concat("__own", "__after").alias("__next"))


def pooled_lead(df: DataFrame, columns: list[str], lag: int = 1, ranges: int = RANGES) -> DataFrame:
    """Adds ``<column>_later``: the value ``lag`` rows on in the order of
    sequence and time, across the borders of sequences.

    A sequence looks ahead in its own rows; its last ones meet the first rows
    of the next sequences that hold enough of them, see :func:`following`.
    """
    at = numbered(df)
    led = pooled_leads(at, _heads(at, columns, lag), columns, (lag,), ranges)
    return led.filter(f"__some_{lag}").select(*df.columns, *[F.col(f"{c}_later_{lag}").alias(f"{c}_later") for c in columns])


def numbered(df: DataFrame) -> DataFrame:
    """Adds the place of a row in its sequence, from 1, and the sequence's rows."""
    whole = Window.partitionBy(SEQ)
    return df.withColumn("__at", F.row_number().over(whole.orderBy(TIME))).withColumn("__n", F.count("*").over(whole))


def _heads(at: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(sequenceId, __head): the first rows of each sequence, in order."""
    return at.filter(F.col("__at") <= most).groupBy(SEQ).agg(F.sort_array(F.collect_list(F.struct("__at", *columns))).alias("__head"))


def pooled_leads(at: DataFrame, heads: DataFrame, columns: list[str], lags: tuple[int, ...], ranges: int = RANGES) -> DataFrame:
    """Adds ``<column>_later_<lag>`` and ``__some_<lag>``, whether there is such
    a row, to :func:`numbered` rows, from the first rows of all sequences, at
    least as many as the greatest lag."""
    own = Window.partitionBy(SEQ).orderBy("__at")
    follows = following(heads, max(lags), ranges)
    led = at.select("*", *[F.lead(c, k).over(own).alias(f"__{c}_{k}") for k in lags for c in columns]).join(follows, SEQ)
    later = []
    for k in lags:
        border = F.get("__next", F.col("__at") + k - F.col("__n") - 1)
        inside = F.col("__at") + k <= F.col("__n")
        later += [F.when(inside, F.col(f"__{c}_{k}")).otherwise(border[c]).alias(f"{c}_later_{k}") for c in columns]
        later.append((inside | border.isNotNull()).alias(f"__some_{k}"))
    return led.select(*at.columns, *later)


Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def several_moments(df: DataFrame, wanted: list[tuple[list[str], list[str], Column | None]]) -> list[Moments]:
    """Rows, means of both sides and centred cross products for each of the
    wanted (left, right, condition), over the rows that have all their values
    and for which the condition holds; one pass for all."""
    names = list(dict.fromkeys(c for left, right, _ in wanted for c in (*left, *right)))
    conditions = [F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for _, _, c in wanted]
    places = [([names.index(c) for c in left], [names.index(c) for c in right]) for left, right, _ in wanted]
    with released(df.sparkSession):
        rows = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(names)], *[c.alias(f"__c{k}") for k, c in enumerate(conditions)])
        # a row a task
        parts = rows.mapInArrow(_summed(places, len(names)), "k int, n long, x array<double>, y array<double>, p array<double>").collect()
    out = []
    for k, (left, right) in enumerate(places):
        total = 0, np.zeros(len(left)), np.zeros(len(right)), np.zeros((len(left), len(right)))
        for r in parts:
            if r["k"] == k:
                total = _added(total, (r["n"], np.array(r["x"]), np.array(r["y"]), np.array(r["p"]).reshape(len(left), len(right))))
        out.append(total)
    return out


def _added(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of rows from those of each (Chan et al., 1979)."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    x, y, share = b[1] - a[1], b[2] - a[2], b[0] / n
    return n, a[1] + x * share, a[2] + y * share, a[3] + b[3] + np.outer(x, y) * (a[0] * share)


def _summed(places: list[tuple[list[int], list[int]]], width: int):
    """(k, n, x, y, p) of a task's rows: for each k rows, means and centred
    products of the columns at the places, where the k-th condition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(0, np.zeros(len(i)), np.zeros(len(j)), np.zeros((len(i), len(j)))) for i, j in places]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], 1)
            missing = np.isnan(values)
            for k, (i, j) in enumerate(places):
                usable = batch.column(width + k).to_numpy(zero_copy_only=False).astype(bool) & ~missing[:, [*i, *j]].any(1)
                n = int(usable.sum())
                if n:
                    x, y = values[usable][:, i], values[usable][:, j]
                    mx, my = x.mean(0), y.mean(0)
                    totals[k] = _added(totals[k], (n, mx, my, (x - mx).T @ (y - my)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(places)), pa.int32()), pa.array([t[0] for t in totals], pa.int64()), *[pa.array([t[c].ravel() for t in totals], pa.list_(pa.float64())) for c in (1, 2, 3)]], ["k", "n", "x", "y", "p"]
        )

    return run


def moments(df: DataFrame, left: list[str], right: list[str]) -> Moments:
    """Rows, means of both sides and centred cross products, over whole rows."""
    return several_moments(df, [(left, right, None)])[0]


def shrunk_covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Covariance shrunk by Ledoit & Wolf (2004)."""
    n, mean, _, products = moments(df, columns, columns)
    square = {c: F.pow(F.col(c) - F.lit(float(m)), 2) for c, m in zip(columns, mean, strict=True)}
    with released(df.sparkSession):
        fourth = df.dropna(subset=columns).agg(F.sum(sum((square[c] for c in columns), F.lit(0.0)) ** 2).alias("q")).first()["q"]
    return _shrunk(n, products, fourth)


def _shrunk(n: int, products: np.ndarray, fourth: float) -> np.ndarray:
    """From centred products and the sum of the fourth powers of the distances
    from the mean."""
    p, s = len(products), products / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - p * mu * mu) / p
    beta = min(delta, max(0.0, (fourth / n - (s**2).sum()) / (p * n)))
    share = beta / delta if delta > 0 else 0.0
    return (1 - share) * s + share * mu * np.eye(p)


def robust_covariances(paired: DataFrame, values: list[str]) -> list[np.ndarray]:
    """Shrunk covariances of either side in its own robust scales; rows are
    stored once, and both sides are read side by side.

    Fourth powers follow from the moments of the values x and of their squared
    length q about the median: |x - m|^2 = q - 2 m x + m m.
    """
    names = {s: [f"{v}_{s}" for v in values] for s in ("gt", "inf")}
    both = [*names["gt"], *names["inf"]]
    with Kept(paired.sparkSession) as keep:
        rows = keep(paired.select(*both))
        scaled = robust(rows, both, stored_middles(rows, both))
        long = scaled.select("*", *[sum((F.col(c) * F.col(c) for c in names[s]), F.lit(0.0)).alias(f"__q_{s}") for s in names])
        found = several_moments(long, [([*names[s], f"__q_{s}"], [*names[s], f"__q_{s}"], None) for s in names])
    out = []
    for n, mean, _, products in found:
        m, at = mean[:-1], np.append(-2 * mean[:-1], 1.0)
        fourth = at @ products @ at + n * (at @ mean + m @ m) ** 2
        out.append(_shrunk(n, products[:-1, :-1], fourth))
    return out


def middles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and robust scale (interquartile range, else deviation, else 1) of
    each column; the driver gets a row a column."""
    with Kept(df.sparkSession) as keep:
        return stored_middles(keep(df.select(*columns)), columns)


def stored_middles(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """:func:`middles` of rows that are cheap to read again."""
    q = column_quantiles(rows, columns, [0.25, 0.5, 0.75])
    sd = rows.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        low, middle, high = q.get(c, (0.0, 0.0, 0.0))
        out[c] = middle, next((s for s in (high - low, sd[c]) if s and s > 1e-9), 1.0)
    return out


def robust(df: DataFrame, columns: list[str], scale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns scaled by their own median and interquartile range."""
    scale = scale or middles(df, columns)
    return df.select(*[x for x in (SEQ, TIME) if x in df.columns], *[((F.col(c) - F.lit(scale[c][0])) / F.lit(scale[c][1])).alias(c) for c in columns])


def basis(covariance: np.ndarray, share: float = 0.85, most: int = 6) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    return vectors[:, : max(1, min(k, most, len(values)))]


def _side(paired: DataFrame, values: list[str], side: str) -> DataFrame:
    return paired.select(SEQ, TIME, *[F.col(f"{v}_{side}").alias(v) for v in values])


def _row(spark: SparkSession, **values: float) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in values])
    return spark.createDataFrame([tuple(None if v is None or v != v else float(v) for v in values.values())], schema)


def subspace_angle(paired: DataFrame, values: list[str], share: float = 0.85) -> DataFrame:
    """Mean squared cosine of the angles between both principal subspaces, with
    the effective dimension of either side."""
    covariances = robust_covariances(paired, values)
    a, b = (basis(c, share) for c in covariances)
    k = min(a.shape[1], b.shape[1])
    dimension = [np.trace(c) ** 2 / (c**2).sum() / len(values) for c in covariances]
    return _row(paired.sparkSession, score=((a[:, :k].T @ b[:, :k]) ** 2).sum() / k, dimension_gt=dimension[0], dimension_inf=dimension[1])


def _matrix_score(a: np.ndarray, b: np.ndarray) -> float:
    """.60 correlation + .40 RMSE similarity of the upper triangles."""
    upper = np.triu_indices_from(a, 1)
    x, y = a[upper], b[upper]
    scale = next((s for s in (x.std(), np.abs(x).mean()) if s >= 1e-8), 1.0)
    alike = 1 / (1 + np.sqrt(((x - y) ** 2).mean()) / scale)
    if len(x) < 3 or x.std() < 1e-8 or y.std() < 1e-8:
        return float(alike)
    return float(0.60 * (np.corrcoef(x, y)[0, 1] + 1) / 2 + 0.40 * alike)


def lagged(paired: DataFrame, values: list[str], lags: tuple[int, ...], sides: tuple[str, ...] = ("gt", "inf"), own: bool = False) -> dict[tuple[str, int], Moments]:
    """Moments of the values against those ``lag`` rows later across the borders
    of sequences (with ``own`` against the values themselves before these), for
    each side and lag, in the robust scales of the side.

    Rows are stored once.  Moments are taken of the values as they are, all in
    one pass, and scaled afterwards.
    """
    names = [f"{v}_{s}" for s in sides for v in values]
    with Kept(paired.sparkSession) as keep:
        at = keep(numbered(paired.select(SEQ, TIME, *names)))
        scale = stored_middles(at, names)
        heads = keep(_heads(at, names, max(lags)))
        led = pooled_leads(at, heads, names, lags)
        keys = [(s, k) for s in sides for k in lags]
        wanted = [([f"{v}_{s}" for v in values], [*([f"{v}_{s}" for v in values] if own else []), *[f"{v}_{s}_later_{k}" for v in values]], F.col(f"__some_{k}")) for s, k in keys]
        found = several_moments(led, wanted)
    out = {}
    for (s, k), (n, mx, my, products) in zip(keys, found, strict=True):
        middle, spread = (np.array([scale[f"{v}_{s}"][i] for v in values]) for i in (0, 1))
        again = 2 if own else 1
        out[s, k] = n, (mx - middle) / spread, (my - np.tile(middle, again)) / np.tile(spread, again), products / np.outer(spread, np.tile(spread, again))
    return out


def lagged_covariance(paired: DataFrame, values: list[str], lags: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    found, scores = lagged(paired, values, lags), {}
    for lag in lags:
        scores[f"lag_{lag}"] = _matrix_score(*[found[s, lag][3] / max(found[s, lag][0] - 1, 1) for s in ("gt", "inf")])
    return _row(paired.sparkSession, score=float(np.mean(list(scores.values()))), **scores)


def impulse_response(paired: DataFrame, values: list[str], ridge: float = 1e-2) -> DataFrame:
    """Agreement of first-order autoregressions of the pooled rows."""
    both, k, found = [], len(values), lagged(paired, values, (1,), own=True)
    for s in ("gt", "inf"):
        n, mx, my, products = found[s, 1]
        sums = products + n * np.outer(mx, my)
        both.append(np.linalg.solve(sums[:, :k] + ridge * np.eye(k), sums[:, k:]).T)
    return _row(paired.sparkSession, score=_matrix_score(*both))


def canonical_correlation(df: DataFrame, left: list[str], right: list[str], most: int = 5) -> float | None:
    """Mean canonical correlation of two sets of columns."""
    names = [*left, *right]
    n, _, _, c = moments(df, names, names)
    if n < 2:
        return None
    k = len(left)

    def whitened(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        keep = values > 1e-10 * values.max()
        return vectors[:, keep] / np.sqrt(values[keep])

    s = np.linalg.svd(whitened(c[:k, :k]).T @ c[:k, k:] @ whitened(c[k:, k:]), compute_uv=False)
    return float(np.clip(s[: min(most, len(s))], 0, 1).mean())


def predictive_r2(df: DataFrame, inputs: list[str], outputs: list[str], test_share: float = 0.2) -> float | None:
    """Pooled R2 of a linear model on the sequences held out.

    A fifth of the sequences is held out by the hash of their id, so the split
    needs no list of sequences.
    """
    return predictive_r2s(df, [(inputs, outputs)], test_share)[0]


def predictive_r2s(df: DataFrame, models: list[tuple[list[str], list[str]]], test_share: float = 0.2) -> list[float | None]:
    """:func:`predictive_r2` of several models, from one pass: the errors on the
    sequences held out follow from the moments of their values."""
    held = F.pmod(F.xxhash64(SEQ), F.lit(1000)) < int(1000 * test_share)
    wanted = []
    for inputs, outputs in models:
        wanted += [(inputs, inputs, ~held), (inputs, outputs, ~held), ([*inputs, *outputs], [*inputs, *outputs], held)]
    found, scores = several_moments(df, wanted), []
    for k, (inputs, outputs) in enumerate(models):
        (n, mx, _, xx), (_, _, my, xy), (tests, mean, _, products) = found[3 * k : 3 * k + 3]
        if not n or not tests:
            scores.append(None)
            continue
        weights = np.linalg.lstsq(xx, xy, rcond=None)[0]
        constant = my - mx @ weights
        # an error is the output less the fit, a sum of columns
        off = np.vstack([-weights, np.eye(len(outputs))])
        errors = np.diag(off.T @ products @ off) + tests * (mean @ off - constant) ** 2
        scores.append(float(1.0 - np.maximum(errors, 0).sum() / (np.diag(products)[len(inputs) :].sum() + 1e-12)))
    return scores


def procrustes(paired: DataFrame, columns: list[str]) -> DataFrame:
    """1 / (1 + disparity) of both sides' centred and normed clouds."""
    names = [f"{c}_{s}" for s in ("gt", "inf") for c in columns]
    _, _, _, c = moments(paired, names, names)
    k = len(columns)
    s = np.linalg.svd(c[:k, k:], compute_uv=False).sum() / np.sqrt(np.trace(c[:k, :k]) * np.trace(c[k:, k:]))
    return _row(paired.sparkSession, score=1 / (1 + max(0.0, 1 - s * s)))
