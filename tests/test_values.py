"""Trajectory and structural scores against NumPy, on the provided tables."""

from __future__ import annotations

import numpy as np
import pytest

from mirrorseq.operators import latent, linear, structure
from mirrorseq.plans import frames
from mirrorseq.plans.align import SEQ, TIME

R = frames.REGIONS


@pytest.fixture(scope="module")
def paired(spark, sf):
    rows = frames.paired(spark, sf).persist()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def table(paired):
    return paired.toPandas().sort_values([SEQ, TIME]).dropna()


def sides(table):
    return {s: table[[f"{r}_{s}" for r in R]].to_numpy(float) for s in ("gt", "inf")}


def directions(x, k_max):
    z = (x - x.mean(0)) / x.std(0)
    spectrum, vectors = np.linalg.eigh(z.T @ z / len(z))
    spectrum, vectors = spectrum[::-1], vectors[:, ::-1]
    k = int(np.clip(np.searchsorted(np.cumsum(spectrum / spectrum.sum()), 0.9) + 1, 2, k_max))
    return vectors[:, :k]


def scale(x, floor=0.05):
    spread = np.subtract(*np.quantile(x, [0.75, 0.25]))
    return max(floor, x.std() if spread < floor else spread)


def gap(x, y, grid):
    return np.mean(np.abs(np.quantile(x, grid) - np.quantile(y, grid))) / (scale(x) + 1e-8)


def overlap(x, y, bins=12):
    lo, hi = np.quantile(x, [0.02, 0.98])
    p, q = (np.histogram(np.clip(v, lo, hi), bins, (lo, hi))[0] / (len(v) + 1e-8) for v in (x, y))
    return 1 - 0.5 * np.abs(p - q).sum()


def occupancy_velocity(table):
    both = sides(table)
    w = directions(both["gt"], 3)
    z = {s: (v - both["gt"].mean(0)) / both["gt"].std(0) @ w for s, v in both.items()}
    out = {f"occupancy{j}": overlap(z["gt"][:, j], z["inf"][:, j]) for j in range(w.shape[1])}
    speed, turn = {}, {}
    for s, v in both.items():
        steps = np.vstack([np.diff(v[rows] @ w, axis=0) for rows in table.groupby(SEQ).indices.values()])
        speed[s] = np.linalg.norm(steps, axis=1)
        turn[s] = (steps[:-1] * steps[1:]).sum(1) / (speed[s][:-1] * speed[s][1:] + 1e-8)
    out["speed"] = 1 / (1 + gap(speed["gt"], speed["inf"], [0.1, 0.25, 0.5, 0.75, 0.9]))
    out["turn"] = 1 / (1 + gap(turn["gt"], turn["inf"], [0.1, 0.3, 0.5, 0.7, 0.9]))
    return out


def path_features(table):
    both = sides(table)
    w = directions(both["gt"], 4)
    out = {}
    for s, v in both.items():
        z = (v - both["gt"].mean(0)) / both["gt"].std(0) @ w
        for q, rows in table.groupby(SEQ).indices.items():
            t = z[rows]
            speed = np.linalg.norm(np.diff(t, axis=0), axis=1)
            net = np.linalg.norm(t[-1] - t[0])
            out[s, q] = [speed.sum(), net, np.linalg.norm(t - t.mean(0), axis=1).mean(), net / (speed.sum() + 1e-8), (np.corrcoef(speed[:-1], speed[1:])[0, 1] + 1) / 2]
    return out


def test_occupancy_and_velocity(paired, table):
    got = {r.part: r.score for r in latent.occupancy_velocity(paired, R).collect()}
    assert got == pytest.approx(occupancy_velocity(table), abs=1e-6)


def test_path_features(paired, table):
    names = ("path", "displacement", "radius", "persistence", "speed_lag1")
    got = {(r.side, r[SEQ]): [r[n] for n in names] for r in latent.latent_path_features(paired, R).collect()}
    want = path_features(table)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7)


def test_trajectory(paired, table):
    features = path_features(table)
    gt, inf = (np.array([v for (s, _), v in features.items() if s == side]) for side in ("gt", "inf"))
    paths = 1 / (1 + np.mean(np.abs(inf.mean(0) - gt.mean(0)) / (np.abs(gt).mean(0) + 1e-8)))
    want = 0.6 * np.mean(list(occupancy_velocity(table).values())) + 0.4 * paths
    assert latent.trajectory_score(paired, R).first()["score"] == pytest.approx(want, abs=1e-6)


def robust(x):
    spread = np.subtract(*np.quantile(x, [0.75, 0.25], axis=0))
    return (x - np.median(x, axis=0)) / np.where(spread > 1e-9, spread, np.where(x.std(0) > 1e-9, x.std(0), 1))


def shrunk(x):
    """Ledoit and Wolf's covariance, term by term."""
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, np.mean([((np.outer(r, r) - s) ** 2).sum() for r in c]) / (p * n))
    return (1 - beta / delta) * s + beta / delta * mu * np.eye(p)


def test_subspace_angle(paired, table):
    both = [shrunk(robust(v)) for v in sides(table).values()]
    bases = []
    for c in both:
        values, vectors = np.linalg.eigh(c)
        values, vectors = values[::-1], vectors[:, ::-1]
        bases.append(vectors[:, : int(np.searchsorted(np.cumsum(values) / values.sum(), 0.85) + 1)])
    k = min(b.shape[1] for b in bases)
    want = ((bases[0][:, :k].T @ bases[1][:, :k]) ** 2).sum() / k
    assert linear.subspace_angle(paired, R).first()["score"] == pytest.approx(want, abs=1e-6)


def matrix_score(a, b):
    x, y = a[np.triu_indices(len(a), 1)], b[np.triu_indices(len(b), 1)]
    return 0.6 * (np.corrcoef(x, y)[0, 1] + 1) / 2 + 0.4 / (1 + np.sqrt(((x - y) ** 2).mean()) / x.std())


def test_lagged_covariance_and_impulse(paired, table):
    x, y = (robust(v) for v in sides(table).values())
    lagged = []
    for lag in (1, 2, 4):
        both = [(v[:-lag] - v[:-lag].mean(0)).T @ (v[lag:] - v[lag:].mean(0)) / (len(v) - lag - 1) for v in (x, y)]
        lagged.append(matrix_score(*both))
    assert linear.lagged_covariance(paired, R).first()["score"] == pytest.approx(np.mean(lagged), abs=1e-6)
    moves = [np.linalg.solve(v[:-1].T @ v[:-1] + 1e-2 * np.eye(len(R)), v[:-1].T @ v[1:]).T for v in (x, y)]
    assert linear.impulse_response(paired, R).first()["score"] == pytest.approx(matrix_score(*moves), abs=1e-6)


def test_precision_scores(paired, table):
    both = [shrunk(robust(v)) for v in sides(table).values()]
    partial = []
    for c in both:
        p = np.linalg.inv(c)
        m = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
        partial.append(m)
    size = [np.trace(c) ** 2 / (c**2).sum() / len(R) for c in both]
    got = {r.metric: r.value for r in structure.precision_scores(paired, R).collect()}
    assert got["PartialCorr_score"] == pytest.approx(matrix_score(*partial), abs=1e-6)
    assert got["Dimensionality_score"] == pytest.approx(1 / (1 + abs(size[0] - size[1]) / size[0]), abs=1e-6)


def test_reconstruction(paired, table):
    both = sides(table)
    z = {s: (v - both["gt"].mean(0)) / both["gt"].std(0) for s, v in both.items()}
    spectrum, vectors = np.linalg.eigh(z["gt"].T @ z["gt"] / len(z["gt"]))
    spectrum, vectors = spectrum[::-1], vectors[:, ::-1]
    k = int(np.clip(np.searchsorted(np.cumsum(spectrum / spectrum.sum()), 0.9) + 1, 2, min(8, len(R))))
    w = vectors[:, :k]
    explained = {s: 1 - ((v - v @ w @ w.T) ** 2).sum() / (v**2).sum() for s, v in z.items()}
    variance = {s: (v @ w).var(0) for s, v in z.items()}
    part = np.clip(explained["inf"] / explained["gt"], 0, 1)
    alike = 1 / (1 + np.mean(np.abs(variance["inf"] - variance["gt"]) / (variance["gt"] + 0.05)))
    got = structure.reconstruction_transfer(paired, R).first()["score"]
    assert got == pytest.approx((0.5 * part + 0.5 * alike) ** 2, abs=1e-6)
