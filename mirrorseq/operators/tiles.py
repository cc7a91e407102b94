"""Sums over all pairs of rows, in tiles.

Rows are dealt into blocks by the hash of their keys; a tile is a pair of
blocks, and its distances are summed where it is.  What leaves a task is a
histogram or three sums, so nothing grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, bins of a histogram, distances that are sorted at last.
BLOCK, BINS, FEW = 1000, 4096, 50_000


def tiles(rows: DataFrame, key: list[str], columns: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, xa, sa, xb, sb): all pairs of blocks a <= b of the rows (side, key,
    columns), with their points and sides as arrays."""
    n = rows.count()
    count = max(1, -(-n // block))
    dealt = rows.select(F.pmod(F.xxhash64(*key), F.lit(count)).cast("int").alias("a"), F.struct(F.array(*columns).alias("x"), (F.col("side") == "gt").alias("s")).alias("r"))
    blocks = dealt.groupBy("a").agg(F.collect_list("r").alias("r")).select("a", F.col("r.x").alias("xa"), F.col("r.s").alias("sa"))
    pairs = blocks.select("a", "xa", "sa", F.explode(F.sequence(F.col("a"), F.lit(count - 1))).alias("b"))
    return pairs.join(blocks.select(F.col("a").alias("b"), F.col("xa").alias("xb"), F.col("sa").alias("sb")), "b").select("a", "b", "xa", "sa", "xb", "sb")


def _distances(part: pd.DataFrame) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(one block with itself, distances, sides of the rows, of the columns)."""
    for r in part.itertuples():
        x, y = np.stack(r.xa).astype(float), np.stack(r.xb).astype(float)
        d = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            d += np.square(x[:, None, i] - y[None, :, i])
        yield r.a == r.b, np.sqrt(d, out=d), np.asarray(r.sa, bool), np.asarray(r.sb, bool)


def _pairs(same: bool, d: np.ndarray) -> np.ndarray:
    return d[np.triu_indices(len(d), 1)] if same else d.ravel()


def median_distance(pairs: DataFrame, bins: int = BINS, few: int = FEW) -> float | None:
    """Exact median of the distances between different rows; None without any.

    Distances are counted in equal bins; the bin that holds the middle is cut
    again until it holds ``few`` distances, which are sorted, or one value.
    """

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = [_pairs(s, d) for s, d, _, _ in _distances(part)]
            yield pd.DataFrame([(len(v), v.min(), v.max()) for v in values if len(v)], columns=["n", "lo", "hi"])

    whole = pairs.mapInPandas(ends, "n long, lo double, hi double").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if not whole["n"]:
        return None
    middle = []
    for rank in sorted({(whole["n"] - 1) // 2, whole["n"] // 2}):
        middle.append(_ranked(pairs, rank, whole["n"], whole["lo"], whole["hi"], bins, few))
    return float(np.mean(middle))


def _ranked(pairs: DataFrame, rank: int, n: int, lo: float, hi: float, bins: int, few: int) -> float:
    """The distance of a rank (from 0) among those within lo and hi."""
    while lo < hi and n > few:

        def counts(parts: Iterator[pd.DataFrame], lo: float = lo, hi: float = hi) -> Iterator[pd.DataFrame]:
            total, least, most = np.zeros(bins, np.int64), np.full(bins, np.inf), np.full(bins, -np.inf)
            for part in parts:
                for s, d, _, _ in _distances(part):
                    v = _pairs(s, d)
                    v = v[(v >= lo) & (v <= hi)]
                    at = np.minimum(((v - lo) / (hi - lo) * bins).astype(int), bins - 1)
                    total += np.bincount(at, minlength=bins)
                    np.minimum.at(least, at, v)
                    np.maximum.at(most, at, v)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"bin": some, "n": total[some], "lo": least[some], "hi": most[some]})

        found = pairs.mapInPandas(counts, "bin int, n long, lo double, hi double").groupBy("bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("bin").collect()
        for r in found:  # at most ``bins`` rows
            if rank < r["n"]:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    if lo == hi:
        return lo

    def inside(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s, d, _, _ in _distances(part):
                v = _pairs(s, d)
                yield pd.DataFrame({"v": v[(v >= lo) & (v <= hi)]})

    return float(sorted(r["v"] for r in pairs.mapInPandas(inside, "v double").collect())[rank])


def kernel_means(pairs: DataFrame, width: float) -> tuple[float, float, float] | None:
    """Means of exp(-d d / (2 (width width + 1e-8))) over all pairs within the
    ground truth, within the other side and between both, a row with itself
    included; None where a side is empty."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            total = np.zeros(6)
            for same, d, a, b in _distances(part):
                kernel = np.exp(-np.square(d) / (2 * (width**2 + 1e-8)))
                twice = 1 if same else 2  # a tile below the diagonal is its mirror
                for j, (rows, columns) in enumerate(((a, b), (~a, ~b))):
                    total[j] += twice * kernel[np.ix_(rows, columns)].sum()
                    total[3 + j] += twice * rows.sum() * columns.sum()
                total[2] += kernel[np.ix_(a, ~b)].sum() + (0 if same else kernel[np.ix_(~a, b)].sum())
                total[5] += a.sum() * (~b).sum() + (0 if same else (~a).sum() * b.sum())
            yield pd.DataFrame([total], columns=[f"s{j}" for j in range(6)])

    schema = T.StructType([T.StructField(f"s{j}", T.DoubleType()) for j in range(6)])
    got = pairs.mapInPandas(sums, schema).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(6)]).first()
    if not got["s3"] or not got["s4"]:
        return None
    return got["s0"] / got["s3"], got["s1"] / got["s4"], got["s2"] / got["s5"]


def mean_discrepancy(rows: DataFrame, key: list[str], columns: list[str], block: int = BLOCK) -> float | None:
    """Squared mean discrepancy of both sides of the rows (side, key, columns)
    under a Gaussian kernel of the median distance, at least 0."""
    pairs = tiles(rows, key, columns, block).persist()
    width = median_distance(pairs)
    means = kernel_means(pairs, 1.0 if width is None else width)
    pairs.unpersist()
    return None if means is None else max(0.0, means[0] + means[1] - 2 * means[2])
