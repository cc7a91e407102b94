"""Matrix and grouped algorithms against NumPy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from mirrorseq.operators import groupwise, linear
from mirrorseq.plans.align import SEQ, TIME


def test_warping_against_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 9), (7, 12), (40, 40), (60, 31)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        band = max(int(max(n, m) * 0.1), abs(n - m))
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, i - band), min(m, i + band) + 1):
                d[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert groupwise.warped_distance(a, b) == pytest.approx(d[n, m] / (n + m))


def test_mutual_information_of_gaussians():
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    y = 0.8 * x + 0.6 * rng.normal(size=1500)
    assert groupwise.mutual_information(x, y) == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.08)
    assert groupwise.mutual_information(x, rng.normal(size=1500)) < 0.05


def test_spectrum_finds_a_sine():
    v = np.sin(2 * np.pi * np.arange(1024) / 16)
    assert groupwise.welch(v).argmax() == 16


@pytest.mark.parametrize("lag", [1, 3])
def test_pooled_lead_crosses_borders(spark, lag):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame([(s, t, rng.normal()) for s, n in ((1, 5), (2, 1), (3, 2), (7, 6)) for t in range(n)], columns=[SEQ, TIME, "v"])
    got = linear.pooled_lead(spark.createDataFrame(rows), ["v"], lag).toPandas().sort_values([SEQ, TIME])
    flat = rows["v"].to_numpy()
    assert got["v"].to_numpy() == pytest.approx(flat[:-lag]) and got["v_later"].to_numpy() == pytest.approx(flat[lag:])


def test_moments_and_shrinkage(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) @ np.array([[1.0, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + 5
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    n, mean, _, products = linear.moments(df, list("abc"), list("abc"))
    assert n == 200 and mean == pytest.approx(x.mean(0)) and products == pytest.approx(np.cov(x.T, ddof=0) * 200)
    c = x - x.mean(0)
    s = c.T @ c / 200
    mu = np.trace(s) / 3
    delta = ((s - mu * np.eye(3)) ** 2).sum() / 3
    beta = min(delta, sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (3 * 200**2))
    assert linear.shrunk_covariance(df, list("abc")) == pytest.approx((1 - beta / delta) * s + beta / delta * mu * np.eye(3))


def test_regression_and_canonical_correlation(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({SEQ: np.repeat(np.arange(40), 25), "x": rng.normal(size=1000), "z": rng.normal(size=1000)})
    rows["y"] = 2 * rows["x"] - rows["z"] + 3
    df = spark.createDataFrame(rows)
    assert linear.predictive_r2(df, ["x", "z"], ["y"]) == pytest.approx(1.0)
    assert linear.canonical_correlation(df, ["x", "z"], ["y"]) == pytest.approx(1.0)


def test_lead_lag_of_a_shifted_sine(spark):
    t = np.arange(200)
    steps = 2 + np.sin(2 * np.pi * t / 40)
    x = np.cumsum(np.concatenate([[0.0], steps[1:]]))
    rows = pd.DataFrame({SEQ: 1, TIME: t, "a_gt": np.sin(2 * np.pi * (t - 2) / 40), "b_gt": 0.01 * t % 3, "CENTER_X_gt": x, "CENTER_Y_gt": 0.0})
    for c in ("a", "b", "CENTER_X", "CENTER_Y"):
        rows[f"{c}_inf"] = rows[f"{c}_gt"]
    got = groupwise.lead_lag_score(groupwise.lead_lag(spark.createDataFrame(rows), ["a", "b"], most=10)).first()
    assert got["gt"] == got["inf"] == 2 and got["score"] == 1.0


def test_discrepancy_tells_clouds_apart(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({SEQ: 1, TIME: range(300), "x_gt": rng.normal(size=300), "x_inf": rng.normal(size=300)})
    near = groupwise.mmd_similarity(spark.createDataFrame(rows), ["x"]).first()["score"]
    far = groupwise.mmd_similarity(spark.createDataFrame(rows.assign(x_inf=rows["x_inf"] + 3)), ["x"]).first()["score"]
    assert near > 0.98 > 0.8 > far
