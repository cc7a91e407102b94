"""Whitening of embeddings: blockwise QR, bidiagonal form, dqds, twisted
factorisations.

Executors reduce the centred rows to one triangle R by QR, block by block and
then in a tree.  What follows depends on the dimension alone: Householder
reflections make R bidiagonal, dqds finds its singular values, and a twisted
factorisation for each of them gives the direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries become floor(SCALE * c).
SCALE = 256
#: Triangles that one task merges.
FAN_IN = 16
#: Eigenvalues below this share of the largest count as zero.
LEAST_SHARE = 1e-12
_EPS = float(np.finfo(float).eps)


def usable(vector: str = "embedding") -> Column:
    """No null, NaN or infinite entry, and at least one entry."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def fixed_point(df: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """The usable rows with ``out``, an array of long floor(256 c)."""
    return df.filter(usable(vector)).withColumn(out, F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")))


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def reduced(rows: DataFrame, mean: np.ndarray, x: str = "x") -> np.ndarray:
    """R of the QR factorisation of all rows less ``mean``.

    Each partition folds its batches into one triangle; ``FAN_IN`` triangles at
    a time are stacked and factored again until one is left, so a task never
    holds more than a batch, or FAN_IN triangles.
    """
    d = len(mean)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        triangle = np.zeros((0, d))
        for part in parts:
            for at in range(0, len(part), 4096):
                block = np.stack(part[x].iloc[at : at + 4096].to_numpy()).astype(float) - mean
                triangle = _triangle(np.vstack([triangle, block]))
        if len(triangle):
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "r": list(triangle)})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": int(part["part"].iloc[0]) // FAN_IN, "r": list(_triangle(np.stack(part["r"].to_numpy())))})

    schema = "part long, r array<double>"
    triangles = stored(rows.select(x).mapInPandas(fold, schema))
    last = triangles.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while last:
        triangles = triangles.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema)
        last //= FAN_IN
    return _triangle(np.array([r["r"] for r in triangles.collect()], float).reshape(-1, d))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal v with r = u B v', by
    Householder reflections from both sides."""
    m = np.array(r, float)
    n = m.shape[1]
    if len(m) < n:
        m = np.vstack([m, np.zeros((n - len(m), n))])
    v = np.eye(n)

    def reflector(y: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(y)
        if size == 0 or not np.any(y[1:]):
            return None
        w = y / size
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(m[k:, k].copy())
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k < n - 2:
            w = reflector(m[k, k + 1 :].copy())
            if w is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd transform; None where the shift passes an eigenvalue."""
    n = len(q)
    qq, ee, d = np.empty(n), np.empty(n - 1), q[0] - shift
    for k in range(n - 1):
        qq[k] = d + e[k]
        if not qq[k] > 0:
            return None
        t = q[k + 1] / qq[k]
        ee[k] = e[k] * t
        d = d * t - shift
    qq[-1] = d
    return (qq, ee) if d >= 0 else None


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix, falling, by dqds.

    Shifts that pass an eigenvalue are lessened, at last to none, so each step
    keeps all quantities positive; off-diagonals that no longer count split the
    problem, and a block of one is a result.
    """
    top = max(float(np.max(a * a, initial=0.0)), float(np.max(b * b, initial=0.0)))
    if top == 0:
        return np.zeros(len(a))
    found: list[float] = []
    # squares below the last digit of a square can't be told from zero
    blocks = [(np.maximum(a * a / top, 1e-40), b * b / top, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(100 * len(q) + 1):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = np.flatnonzero(e <= (_EPS * _EPS) * (q[:-1] + moved) + 1e-300)
            near = np.flatnonzero(e <= _EPS * 0.01 * np.minimum(q[:-1], q[1:])) if not len(cut) else cut
            if len(near):
                k = int(near[-1])
                # a split leaves an error of the square of what it drops
                blocks.append((q[: k + 1], e[:k], moved))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # the small end belongs at the bottom
                q, e = _flipped(q, e)
            shift = _bound(q, e)
            while (step := _dqds(q, e, shift)) is None:
                shift = shift / 4 if shift > 1e-3 * q.min() else 0.0
            q, e = step
            q = np.maximum(q, 0.0) + 1e-300
            moved += shift
        else:
            found.extend(q + moved)
    return np.sqrt(np.sort(np.array(found) * top)[::-1])


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values in reverse order of rows and columns."""
    return q[::-1].copy(), e[::-1].copy()


def _bound(q: np.ndarray, e: np.ndarray) -> float:
    """A shift below the least eigenvalue of the block, or near it: what the
    last two rows have, less a margin."""
    x, y, z = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    mean, half = (x + y) / 2, (x - y) / 2
    least = mean - np.hypot(half, np.sqrt(max(z, 0.0)))
    return max(0.0, min(least, q[-1]) * (1 - 1e-3))


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Null vector of B'B - value by the twisted factorisation with the least
    twist element."""
    n = len(a)
    d, l = a * a, b / a[:-1]
    tiny = _EPS * _EPS * max(float(d.max()), 1e-300)
    safe = lambda y: y if abs(y) > tiny else tiny
    s, down = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        down[i] = d[i] * l[i] / safe(s[i] + d[i])
        s[i + 1] = down[i] * l[i] * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * l[i] ** 2 + p[i + 1])
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def decomposed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the bidiagonal matrix, falling, and its right
    singular vectors as columns.

    Off-diagonals that rounding can't tell from zero split the matrix; vectors
    of a part are zero elsewhere, so parts never need to be compared.
    """
    n, top = len(a), max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    split = np.flatnonzero(np.abs(b) <= _EPS * np.maximum(np.abs(a[:-1]) + np.abs(a[1:]), 0.01 * top))
    values, vectors = [], []
    for lo, hi in zip([0, *(split + 1)], [*(split + 1), n], strict=True):
        part = singular_values(a[lo:hi], b[lo : hi - 1])
        z = np.zeros((n, hi - lo))
        z[lo:hi] = _part_vectors(a[lo:hi], b[lo : hi - 1], part)
        values.append(part)
        vectors.append(z)
    every = np.concatenate(values)
    order = np.argsort(-every, kind="stable")
    return every[order], np.hstack(vectors)[:, order]


def _part_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Right singular vectors of an unsplit bidiagonal matrix.

    A twisted factorisation loses what 1 / (relative gap) takes, all of it
    towards the neighbours.  So values that follow within ``close`` of each
    other form a group: its vectors are made orthogonal, those that were lost
    come from inverse iteration beside the others, and a rotation inside the
    group's subspace (Rayleigh-Ritz) tells them apart again.
    """
    n = len(a)
    if n == 1:
        return np.ones((1, 1))
    top = float(values[0])
    if top == 0:
        return np.eye(n)
    a = np.where(np.abs(a) < 1e-3 * _EPS * top, 1e-3 * _EPS * top, a)  # a zero on the diagonal is a zero value
    t = np.diag(a * a) + np.diag(np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    rng, out, at = np.random.default_rng(0), np.zeros((n, n)), 0
    while at < n:
        to = at + 1
        while to < n and values[to - 1] - values[to] <= close * values[to - 1]:
            to += 1
        for j in range(at, to):
            square, others = values[j] ** 2, out[:, at:j]
            beside = lambda z, o=others: z - o @ (o.T @ z)
            z = beside(beside(_twisted(a, b, square)))
            if np.linalg.norm(z) < 1e-3:
                z, shifted = beside(rng.standard_normal(n)), t - (square + 4 * _EPS * top * top) * np.eye(n)
                for _ in range(4):
                    z = beside(beside(np.linalg.solve(shifted, z / np.linalg.norm(z))))
            out[:, j] = z / np.linalg.norm(z)
        if to - at > 1:
            z = np.linalg.qr(out[:, at:to])[0]
            turn = np.linalg.eigh(z.T @ t @ z)[1][:, ::-1]
            out[:, at:to] = z @ turn
        at = to
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows and sums of the fit list, and the components."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def k(self) -> int:
        return len(self.eigenvalues)

    def whitened(self, j: int, x: str = "x") -> Column:
        """Component j (from 0) of the column, centred, in units of its deviation."""
        mean = F.array(*[F.lit(s / self.n) for s in self.sums])
        weight = F.array(*[F.lit(float(v)) for v in self.vectors[:, j] / np.sqrt(self.eigenvalues[j])])
        centred = F.zip_with(x, mean, lambda c, m: c - m)
        return F.aggregate(F.zip_with(centred, weight, lambda c, w: c * w), F.lit(0.0), lambda s, c: s + c)


def components(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of r'r / n, those of zero
    eigenvalues left out."""
    a, b, v = bidiagonal(r)
    s, z = decomposed(a, b)
    keep = s * s > LEAST_SHARE * s[0] * s[0]
    return s[keep] ** 2 / max(n, 1), v @ z[:, keep]


def fit_list(rows: DataFrame, x: str = "x") -> DataFrame:
    """Each distinct vector once."""
    return rows.select(x).distinct()


def fit(distinct: DataFrame, d: int, x: str = "x") -> Whitening:
    """Components of the fit list; it is read twice, so it should be stored."""
    sums = distinct.agg(F.count("*").alias("n"), *[F.sum(F.get(x, F.lit(j))).alias(f"s{j}") for j in range(d)]).first()
    n, total = sums["n"], [int(sums[f"s{j}"] or 0) for j in range(d)]
    if not n:
        return Whitening(0, total, np.zeros(0), np.zeros((d, 0)), 0.0)
    r = reduced(distinct, np.array([s / n for s in total]), x)
    values, vectors = components(r, n)
    return Whitening(n, total, values, vectors, float((r**2).sum() / n))


def deviation(model: Whitening, x: str = "x") -> Column:
    """Sum over dimensions of (n x - S) ** 2 as a long; null beyond a long.

    Expanded to n n x.x - 2 n x.S + S.S: two sums of long products a row, and
    the rest in decimals of 38 digits.
    """
    wide = "decimal(38,0)"
    sums = F.array(*[F.lit(s) for s in model.sums]).cast("array<bigint>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.try_multiply(p, q)), F.lit(0).cast("long"), lambda s, c: F.try_add(s, c))
    number = lambda k: F.lit(str(k)).cast(wide)
    exact = F.try_subtract(F.try_multiply(dot(x, x).cast("decimal(19,0)"), number(model.n**2)), F.try_multiply(dot(x, sums).cast("decimal(19,0)"), number(2 * model.n)))
    total = F.try_add(exact, number(sum(s * s for s in model.sums)))
    return total.try_cast("long")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a
    row for each usable row and each of its first ``most`` components.

    Distinct vectors are written once to the shared folder; sums, QR and the
    covariance of the result read them there.  Only the triangle R, of the
    size of the dimension, reaches the driver.

    Defined results: rows whose vector is null or empty, or holds a null or
    non-finite entry, leave.  So do vectors of another length than most have
    (the longer of equally frequent ones stays).  Repeated rows stay, each with
    its own result; null keys stay null.  Components with an eigenvalue of zero
    (fewer distinct vectors than dimensions, constant columns) have no rows, so
    a single distinct vector or an empty table gives none.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = fixed_point(df.select(F.col(key).alias("__key"), F.col(vector).alias("__v")), "__v").select("__key", "x")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    distinct = stored(fit_list(rows))
    model = fit(distinct, d)
    k = min(most, model.k)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    w = [f"w{j}" for j in range(k)]
    fitted = distinct.select(*[model.whitened(j).alias(c) for j, c in enumerate(w)])
    covariance = fitted.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    each = F.array(*[F.struct(F.lit(j + 1).alias("component"), model.whitened(j).alias("whitened"), F.lit(float(model.eigenvalues[j] / model.trace)).alias("explained")) for j in range(k)])
    out = rows.select("__key", deviation(model).alias("deviation"), F.explode(each).alias("c"))
    return out.select(F.col("__key").alias(key), F.col("c.component"), F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
