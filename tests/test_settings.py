"""Settings that change scores, the command line's choices, scenario tables,
file order, clustering and quantiles."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorseq import api, cli
from mirrorseq.config import Config
from mirrorseq.functions.quantiles import quantiles
from mirrorseq.operators import clusters, groupwise, linear, structure
from mirrorseq.plans import frames, reports
from mirrorseq.plans.align import SEQ, TIME
from mirrorseq.sources import files, sinks


@pytest.fixture(scope="module")
def paired(spark, sf):
    rows = frames.paired(spark, sf).filter(F.col(SEQ) <= 3).persist()
    yield rows
    rows.unpersist()


def differs(score, one, other):
    a, b = score(one), score(other)
    return a is not None and b is not None and abs(a - b) > 1e-9


def test_each_setting_changes_its_score(paired):
    r = ["r1", "r2", "r4"]
    first = lambda df: df.first()["score"]
    assert differs(lambda c: first(structure.autocorrelation_score(paired, r, c.AUTOCORR_MAX_LAG)), Config(), Config().updated({"AUTOCORR_MAX_LAG": 3}))
    assert differs(lambda c: first(groupwise.band_power_score(paired, r, c.WELCH_NPERSEG)), Config(), Config().updated({"WELCH_NPERSEG": 64}))
    assert differs(lambda c: first(groupwise.mi_score(paired, ["r1"], c.MAX_TIME_STEPS_SUBSAMPLE, c.MI_N_NEIGHBORS)), Config(), Config().updated({"MI_N_NEIGHBORS": 2}))
    assert differs(lambda c: first(groupwise.mi_score(paired, ["r1"], c.MAX_TIME_STEPS_SUBSAMPLE, c.MI_N_NEIGHBORS)), Config(), Config().updated({"MAX_TIME_STEPS_SUBSAMPLE": 150}))
    # one main direction of each side, or all of them
    assert differs(lambda c: first(linear.subspace_angle(paired, r, c.PCA_VARIANCE_THRESHOLD)), Config().updated({"PCA_VARIANCE_THRESHOLD": 0.1}), Config().updated({"PCA_VARIANCE_THRESHOLD": 0.999}))


def test_settings_reach_the_api(paired, monkeypatch):
    seen = {}
    one = lambda name: lambda *a, **k: seen.setdefault(name, (a[2:], k)) and None or paired.sparkSession.createDataFrame([(0.5,)], "score double")
    monkeypatch.setattr(api.groupwise, "mi_score", one("mi"))
    monkeypatch.setattr(api.neuro, "error", one("error"))
    gt, pred = (paired.select(SEQ, TIME, *[F.col(f"r{i}_{s}").alias(f"r{i}") for i in (1, 2)]) for s in ("gt", "inf"))
    api.compute_fidelity_scores(pred, gt, Config().updated({"MI_N_NEIGHBORS": 3, "MAX_TIME_STEPS_SUBSAMPLE": 99}))
    assert seen["mi"][0] == (99, 3)


def test_several_settings_files_are_asked_for(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.chosen_config(None) is None
    Path("a.json").write_text("{}")
    assert cli.chosen_config(None) == "a.json"
    Path("b.json").write_text("{}")
    assert cli.chosen_config(None, lambda _: "2") == "b.json" and cli.chosen_config(None, lambda _: "a.json") == "a.json"
    assert cli.chosen_config("c.json") == "c.json"
    for answer in ("", "7", "none.json"):
        with pytest.raises(FileNotFoundError):
            cli.chosen_config(None, lambda _, a=answer: a)

    def nobody(_):
        raise EOFError

    with pytest.raises(FileNotFoundError):
        cli.chosen_config(None, nobody)


def test_rows_of_sequences_in_the_payload(spark):
    each = spark.createDataFrame([("m", "1", 0.5), ("m", "2", None), ("k", "1", 1.0)], f"metric string, {SEQ} string, score double")
    assert cli.per_sequence(each, "there") == {"k": {"1": 1.0}, "m": {"1": 0.5, "2": None}}
    assert cli.per_sequence(each, "there", most=2) == "there"


def test_scenarios(spark, tmp_path):
    rows = [(f"s{g}{k}", f"g{g}", k / 4, m, 1.0 - k / 8 - (m == "b") * 0.1) for g in (0, 1) for k in range(4) for m in ("a", "b")] + [("base", "baseline", None, "a", 0.97)]
    records = spark.createDataFrame(rows, "scenario_name string, scenario_group string, noise_sigma double, metric string, value double")
    tables = reports.scenario_tables(records)
    results = {r["scenario_name"]: (r["a"], r["b"]) for r in tables["results"].collect()}
    assert len(results) == 9 and results["s01"] == pytest.approx((0.875, 0.775)) and results["base"] == (0.97, None)
    falls = {(r["scenario_group"], r["metric"]): r for r in tables["monotonicity"].collect()}
    assert falls["g0", "a"].falling == 1.0 and falls["g0", "a"].change == pytest.approx(-0.375) and len(falls) == 4
    full = {(r["scenario_group"], r["metric"]): r for r in tables["saturation"].collect()}
    assert full["g1", "a"].at_90 == 0.25 and full["baseline", "a"].at_95 == 1.0
    path = sinks.write_scenarios(tables, str(tmp_path / "out"))
    found = json.loads(path.read_text())
    assert found["g0"]["a"]["monotonicity"]["falling"] == 1.0 and "summary" in found["baseline"]["a"]
    assert spark.read.json(str(tmp_path / "out/results.json")).count() == 9
    figures = reports.dose_figures(records.filter("noise_sigma is not null").selectExpr("scenario_group perturbation", "noise_sigma level", "metric", "value"))
    heat = {r["perturbation"]: r["a"] for r in figures["heat"].collect()}
    assert heat == {"g0": pytest.approx(0.375), "g1": pytest.approx(0.375)} and figures["dose"].count() == 16
    assert {k: t.count() for k, t in reports.scenario_tables(records.limit(0)).items()} == dict.fromkeys(tables, 0)


def test_file_order_from_many_splits(spark, tmp_path):
    g = np.random.default_rng(0)
    ids = g.integers(0, 40, 30_000)
    path = tmp_path / "old.csv"
    path.write_text(",a,b\n" + "".join(f"{s},{i},{i * 0.5}\n" for i, s in enumerate(ids)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        table = files.load_table(spark, str(path))
        assert table.rdd.getNumPartitions() > 5
        rows = files.with_positions(table, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    seen: dict = {}
    for r in sorted(rows, key=lambda r: r["a"]):
        assert r[SEQ] == ids[r["a"]] and r[TIME] == seen.get(r[SEQ], 0)
        seen[r[SEQ]] = r[TIME] + 1
    assert len(rows) == 30_000


def test_centres_do_not_depend_on_partitions(spark):
    g = np.random.default_rng(1)
    means = np.array([[0, 0], [8, 0], [0, 8], [8, 8], [20, 4]])
    x = means[g.integers(0, 5, 3000)] + g.standard_normal((3000, 2))
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    found = [clusters.centres(df.repartition(n), ["a", "b"], 5, seed=3) for n in (1, 4, 32)]
    assert found[0] == found[1] == found[2]
    off = np.abs(np.array(found[0])[:, None] - means[None]).sum(2)
    assert off.min(1).max() < 0.3 and len(set(off.argmin(1))) == 5
    cost = lambda c: ((x[:, None] - np.array(c)[None]) ** 2).sum(2).min(1).sum()
    assert cost(found[0]) <= 1.01 * cost(means)
    few = spark.createDataFrame([(1.0, 1.0)] * 5 + [(2.0, 2.0)], "a double, b double")
    assert sorted(clusters.centres(few, ["a", "b"], 4))[0] == [1.0, 1.0] and len(clusters.centres(few, ["a", "b"], 4)) == 2
    assert clusters.centres(df.limit(0), ["a", "b"], 3) == []


def test_evenly_spaced_ids(spark):
    for n in (3, 48, 49, 200):
        ids = spark.createDataFrame([(f"s{k:04}",) for k in range(n)], f"{SEQ} string")
        got = sorted(r[SEQ] for r in linear.evenly(ids, 48, ranges=5).collect())
        assert got == ([f"s{k:04}" for k in range(n)] if n <= 48 else sorted({f"s{int(k):04}" for k in np.linspace(0, n - 1, 48)}))


def test_quantiles_hold_nothing_and_span_all_numbers(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    values = [-1.7e308, 1.7e308, 0.0, 1.0, 2.0, *map(float, range(3, 200))]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, v double")
    got = {r.g: r.q for r in quantiles(df, "v", ["g"], [0.0, 0.25, 0.5, 1.0], bins=8, few=20).collect()}
    assert got["a"] == pytest.approx([-1.7e308, *np.quantile(sorted(values)[1:-1], [0.2487, 0.5]).round(0), 1.7e308], abs=1.0) and got["b"] == [1.0] * 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
