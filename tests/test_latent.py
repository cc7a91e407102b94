"""Quantiles, topology, features, corruptions and gates against NumPy and known answers."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirrorseq.functions.quantiles import quantiles
from mirrorseq.operators import latent, movement, rollup, structure
from mirrorseq.plans import align, frames
from mirrorseq.plans.align import SEQ, TIME, DataValidationError, pair
from mirrorseq.sources import files, sinks

R = frames.REGIONS


@pytest.fixture(scope="module")
def gt(spark, sf):
    return frames.ground_truth(spark, sf).filter(f"{SEQ} < 5 and {TIME} < 150").cache()


@pytest.mark.parametrize("few", [100_000, 7])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 30), "c": np.array([4.0]), "d": np.full(50, 3.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    qs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], qs, bins=16, few=few).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, qs).tolist())


def _homology(points):
    """Lifetimes of components and loops by ranks of boundary matrices over Z2."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    n = len(points)
    cells = [((i,), 0.0) for i in range(n)] + [((i, j), d[i, j]) for i, j in itertools.combinations(range(n), 2)] + [((i, j, k), max(d[i, j], d[i, k], d[j, k])) for i, j, k in itertools.combinations(range(n), 3)]
    cells.sort(key=lambda c: (c[1], len(c[0]), c[0]))
    place = {c: i for i, (c, _) in enumerate(cells)}
    low, out = {}, {0: [], 1: []}
    for j, (c, t) in enumerate(cells):
        column = {place[f] for f in itertools.combinations(c, len(c) - 1)} if len(c) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            life = t - cells[max(column)][1]
            if life > 0 and len(c) < 4:
                out[len(c) - 2].append(life)
    return out


def test_rips_against_matrix_reduction():
    rng = np.random.default_rng(2)
    ring = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 2 * np.pi, 12, endpoint=False)]) + rng.normal(scale=0.05, size=(12, 2))
    for points in (ring, rng.normal(size=(14, 3))):
        deaths, loops = latent.rips(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)))
        expected = _homology(points)
        assert sorted(deaths) == pytest.approx(sorted(expected[0])) and sorted(loops) == pytest.approx(sorted(expected[1]))
    assert max(latent.rips(latent.landmarks(ring, 12))[1]) > 0.8


def test_basis_against_numpy(gt):
    paired = pair(gt, frames.predictions(gt))
    basis = latent.gt_basis(paired, R, 3)
    x = paired.select(*[f"{v}_gt" for v in R]).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, ddof=0))[::-1]
    assert basis.ratios == pytest.approx(values / values.sum()) and basis.k == latent.choose_k(values / values.sum(), len(z), 3)
    got = latent.projected(paired, basis).filter("side = 'gt'").toPandas()
    assert sorted(got["z0"]) == pytest.approx(sorted(z @ basis.vectors[:, 0]))


@pytest.mark.parametrize("score", [latent.trajectory_score, latent.manifold_score, structure.reconstruction_transfer, structure.cross_correlation_score])
def test_identity_is_one(gt, score):
    assert score(pair(gt, gt), R).first()["score"] == pytest.approx(1.0, abs=1e-6)


def test_features_against_pandas(gt):
    rows = frames.pose(pair(gt, frames.predictions(gt)))
    table = rows.toPandas().sort_values([SEQ, TIME])
    got = movement.beside(movement.movement_features(rows), movement.MOVEMENT).toPandas().sort_values([SEQ, TIME])
    steps = table.groupby(SEQ)["CENTER_X_inf"].diff()
    first = steps.isna()
    steps[first] = steps.shift(-1)[first]
    assert got["dx_inf"].to_numpy() == pytest.approx(steps.to_numpy())
    assert got["ear_span_gt"].to_numpy() == pytest.approx(np.hypot(table["LEFT_EAR_X_gt"] - table["RIGHT_EAR_X_gt"], table["LEFT_EAR_Y_gt"] - table["RIGHT_EAR_Y_gt"]).to_numpy())
    speed = movement.behaviour_features(rows).filter("side = 'gt'").toPandas().sort_values([SEQ, TIME])["speed"].to_numpy()
    assert speed == pytest.approx(np.hypot(table.groupby(SEQ)["CENTER_X_gt"].diff(), table.groupby(SEQ)["CENTER_Y_gt"].diff()).fillna(0).to_numpy())


def test_corruptions_keep_what_they_should(gt):
    table = gt.toPandas().sort_values([SEQ, TIME]).reset_index(drop=True)
    for name, corrupt in structure.CORRUPTIONS.items():
        none = corrupt(gt, R, 0.0, 3).toPandas().sort_values([SEQ, TIME]).reset_index(drop=True)
        if name != "region_shift_desync":
            assert none[R].to_numpy() == pytest.approx(table[R].to_numpy()), name
        full = corrupt(gt, R, 1.0, 3).toPandas().sort_values([SEQ, TIME]).reset_index(drop=True)
        assert len(full) == len(table) and not np.allclose(full[R], table[R]), name
        if name in ("time_shuffle_blend", "region_shift_desync"):
            for _, rows in full.groupby(SEQ):
                own = table.loc[rows.index]
                assert all(sorted(rows[v]) == pytest.approx(sorted(own[v])) for v in R)


def test_sweep_falls(gt):
    rows = structure.sweep(gt, R, lambda p, v: structure.latent.path_feature_score(p, v), structure.scale_gains, "gain", (0.0, 1.0)).collect()
    assert rows[0].family == "baseline" and rows[0].score == pytest.approx(1.0) and rows[1].score < 0.95


def test_gates(spark, gt):
    paired = pair(gt, frames.predictions(gt))
    align.check_traces(paired, R)
    with pytest.raises(DataValidationError, match="regions"):
        align.check_traces(paired, R[:1])
    with pytest.raises(DataValidationError, match="sequences"):
        align.check_traces(paired.filter(f"{SEQ} = 1"), R)
    with pytest.raises(DataValidationError, match="rows"):
        align.check_traces(paired.filter(f"{TIME} < 50"), R)
    with pytest.raises(DataValidationError, match="r3_gt"):
        align.check_traces(paired.withColumn("r3_gt", F.lit(1.0)), R)
    with pytest.warns(UserWarning, match="magnitude"):
        align.check_traces(paired.select(SEQ, TIME, *[x for v in R for x in (f"{v}_gt", (F.col(f"{v}_inf") * 1e6).alias(f"{v}_inf"))]), R)
    with pytest.warns(UserWarning, match="of the shorter side"):
        align.check_overlap(gt, gt.withColumn(TIME, F.col(TIME) + 20))
    with pytest.raises(DataValidationError, match="only"):
        align.check_overlap(gt, gt.withColumn(TIME, F.col(TIME) + 100))
    with pytest.raises(DataValidationError, match="CENTER_X_gt"):
        align.check_multimodal(paired, R, ["CENTER"])
    with pytest.warns(UserWarning, match="lead-lag"):
        align.check_multimodal(paired.filter(f"{TIME} < 20"), R, [])


def test_older_files_and_subsets(spark, tmp_path):
    pd.DataFrame({"v": [1.0, 2.0, 3.0]}, index=[4, 4, 5]).to_csv(tmp_path / "preds.noise_0.25.csv")
    pd.DataFrame({SEQ: [4, 4, 5], TIME: [0, 1, 0], "v": [1.0, 2.0, 3.0]}).to_csv(tmp_path / "gt.csv", index=False)
    gt, preds = files.load_pairs(spark, str(tmp_path / "gt.csv"), str(tmp_path / "preds.noise_0.25.csv"))
    rows = lambda d: sorted(tuple(r) for r in d.select(SEQ, TIME, "v").collect())
    assert rows(gt) == rows(preds) == rows(files.subset(gt, 6, 5)) and files.subset(gt, 5, 1).count() == 1
    assert spark.createDataFrame([("a/preds.noise_0.25.csv",), ("x.csv",)], "n string").select(files.noise_level(F.col("n")).alias("l")).collect() == [(0.25,), (None,)]
    assert [p.rsplit("/", 1)[1] for p in files.candidates("preds", str(tmp_path))] == ["preds.noise_0.25.csv"]
    with pytest.raises(ValueError, match="rows"):
        files.check_equal_lengths(gt)


def test_tables_and_names(spark, tmp_path):
    scores = spark.createDataFrame([("MOM_score", 0.5), ("QNT_score", 0.25)], "metric string, value double")
    named = {r.metric: r.value for r in rollup.with_aliases(scores).collect()}
    assert named == {"MOM_score": 0.5, "QNT_score": 0.25, "MOM_score01": 0.5, "QNT_score01": 0.25}
    table = rollup.metric_table(scores).collect()
    assert len(table) == 16 and sum(r.value is not None for r in table) == 2
    assert {r.family: r.value for r in rollup.family_table(scores).collect()}["family_distribution"] == pytest.approx(0.375)
    sinks.write_tables({"scores": scores}, str(tmp_path), {"seed": 1})
    assert spark.read.csv(str(tmp_path / "scores"), header=True).count() == 2
    assert sinks.bar(0.9, colours=False).count("=") == 14 and sinks.bar(None) == "-" * 16
