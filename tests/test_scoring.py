"""Scoring operators: DuckDB oracles, identities, guards and known answers."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from mirrorseq.functions import stats
from mirrorseq.operators import etho, neuro, rollup
from mirrorseq.plans import align, frames, queries
from mirrorseq.plans.align import SEQ, TIME


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(table, columns):
    return sorted(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v for v in r) for r in table[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    got, expected = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and len(got) == len(expected)
    key = lambda r: tuple(str(v) for v in r)
    clean = lambda t: sorted(([None if v is None or v != v else float(v) if not isinstance(v, str) else v for v in r] for r in t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False)), key=key)
    for a, b in zip(clean(got), clean(expected), strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.fixture(scope="module")
def same(spark, sf):
    gt = frames.ground_truth(spark, sf).filter(f"{SEQ} <= 3").cache()
    return align.pair(gt, gt)


@pytest.mark.parametrize("score", ["kl", "mean_shift", "quantile_shift", "moments", "error"])
def test_identity_is_one(same, score):
    assert getattr(neuro, score)(same, frames.REGIONS).first()["score"] == pytest.approx(1.0)


@pytest.mark.parametrize("score", ["distribution", "stationary", "direction", "quadrant", "position"])
def test_identity_is_one_for_tracks(same, score):
    assert all(r.score == pytest.approx(1.0) for r in getattr(etho, score)(frames.pose(same)).collect())


def test_guards(spark):
    with pytest.raises(align.DataValidationError):
        align.canonical(spark.createDataFrame([(1, "a", 1.0)], f"{SEQ} int, {TIME} string, v double"))
    with pytest.raises(align.DataValidationError):
        align.canonical(spark.createDataFrame([(1, 1.0)], f"{SEQ} int, v double"))
    with pytest.raises(align.DataValidationError):
        align.check_keys(spark.createDataFrame([(1, 1), (1, 1)], f"{SEQ} int, {TIME} int"))
    renamed = align.canonical(spark.createDataFrame([(1, 2, float("nan")), (1, 3, float("inf"))], "trial int, frame int, v double"), "trial", "frame")
    assert renamed.columns == [SEQ, TIME, "v"] and renamed.filter("v is null").count() == 2


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert df.agg(stats.correlation(F.col("x"), F.col("y"))).first()[0] is None


def test_families_renormalise(spark):
    scores = spark.createDataFrame([("KL_or_JSD_score", 0.5), ("QNT_score", 1.0), ("TRJDIST_score", 0.2), ("MANI_score", None)], "metric string, value double")
    got = {r.metric: r.value for r in rollup.families(scores).collect()}
    assert got["family_distribution"] == pytest.approx(0.75) and got["family_geometry"] is None
    assert got["FINAL_COMPOSITE_SCORE"] == pytest.approx((0.22 * 0.75 + 0.18 * 0.2) / 0.40)
