"""Scores that read their rows once, or hold little of them at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrorseq.functions.quantiles import column_quantiles
from mirrorseq.operators import clusters, embedding, etho, groupwise, latent, linear, movement, neuro, structure
from mirrorseq.plans import frames
from mirrorseq.plans.align import KEYS, SEQ, TIME


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


REGIONS = ["r1", "r2", "r3", "r4"]


@pytest.fixture
def counted(spark, sf):
    """The paired rows, their number, and how often rows were read so far."""
    rows = frames.paired(spark, sf).toPandas()
    df, seen = spark.createDataFrame(rows), spark.sparkContext.accumulator(0)

    def read(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return df.mapInPandas(read, df.schema), len(rows), lambda: seen.value / len(rows)


def test_paired_rows_equal_the_join(spark, sf, tmp_path):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    items.unionByName(items.limit(50).withColumn("l_suppkey", F.lit(None).cast("long"))).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole, one = frames.joined(spark, str(tmp_path)), frames.paired(spark, str(tmp_path))
    assert whole.count() == one.count() > 5000
    assert whole.select(*sorted(whole.columns)).exceptAll(one.select(*sorted(whole.columns))).count() == 0
    counted = one.groupBy(SEQ).agg(F.max("r1_inf"))
    assert plan(counted).count("Exchange hashpartitioning") == 1


def test_band_power_of_gaps_and_lengths_equals_numpy(spark):
    g = np.random.default_rng(8)
    lengths = {f"s{n:04}": n for n in (40, 64, 65, 255, 256, 257, 700, 9001)}
    rows, series = [], {}
    for s, n in lengths.items():
        x = np.cumsum(g.standard_normal((n, 4)), axis=0) + 50
        x[g.uniform(size=(n, 4)) < (0.1 if n in (257, 9001) else 0.0)] = np.nan
        series[s] = x
        rows += [(s, t, *[None if np.isnan(v) else float(v) for v in r]) for t, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"{SEQ} string, {TIME} long, a_gt double, a_inf double, b_gt double, b_inf double").repartition(5, TIME)
    found = groupwise.band_power(df, ["a", "b"])
    assert "ObjectHashAggregate" not in plan(found) 
    got = {(r[SEQ], r.region, r.frequency): (r.gt, r.inf) for r in found.collect()}
    n_cells = 0
    for s, x in series.items():
        for j, region in enumerate("ab"):
            both = [x[:, 2 * j + k][~np.isnan(x[:, 2 * j + k])] for k in (0, 1)]
            size = min(256, *map(len, both))
            if size < 64:
                continue
            for k, v in enumerate(both):
                want = groupwise.welch(v, size)[1:]
                assert [got[s, region, f + 1][k] for f in range(len(want))] == pytest.approx((want / want.sum()).tolist(), rel=1e-9)
            n_cells += size // 2
    assert len(got) == n_cells and KEYS == [SEQ, TIME]


def test_spectra_take_as_many_rows_as_there_are(spark):
    """Each row must not become a row for each frequency."""
    x = np.random.default_rng(9).standard_normal(50_000)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "s string, at int, v double")
    found = groupwise.spectra(df, ["s"], "v", F.lit(256))
    assert plan(found).count("Generate") == 1  # the result's frequencies only
    got = [r.power for r in found.orderBy("frequency").collect()]
    assert got == pytest.approx(groupwise.welch(x)[1:].tolist(), rel=1e-9)


def test_lagged_moments_read_rows_once(spark, counted):
    rows, _, reads = counted
    found = linear.lagged(rows, REGIONS, (1, 2, 4))
    assert reads() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    table = rows.toPandas().sort_values(KEYS)
    for s in ("gt", "inf"):
        x = table[[f"{v}_{s}" for v in REGIONS]].to_numpy()
        low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        x = (x - middle) / (high - low)
        for k in (1, 2, 4):
            n, mx, my, products = found[s, k]
            assert n == len(x) - k and mx == pytest.approx(x[:-k].mean(0)) and my == pytest.approx(x[k:].mean(0))
            assert products == pytest.approx((x[:-k] - mx).T @ (x[k:] - my), abs=1e-6)


@pytest.mark.parametrize("few", [3, 5000])
def test_quantiles_of_columns_equal_numpy(spark, few):
    g = np.random.default_rng(10)
    x = np.stack([g.standard_normal(4000), g.integers(0, 5, 4000), np.full(4000, 2.5), g.standard_cauchy(4000) * 1e200], 1)
    rows = [(*map(float, r), None) for r in x] + [(None, float("nan"), None, None, None)] * 7
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = column_quantiles(df, list("abcde"), [0.0, 0.013, 0.5, 0.75, 1.0], bins=16, few=few)
    assert got.keys() == set("abcd")
    for i, c in enumerate("abcd"):
        assert got[c] == pytest.approx(np.quantile(x[:, i], [0.0, 0.013, 0.5, 0.75, 1.0]).tolist(), rel=1e-12)


def test_covariances_read_rows_once(spark, counted):
    rows, _, reads = counted
    got = linear.robust_covariances(rows, REGIONS)
    assert reads() == 1
    want = [linear.shrunk_covariance(linear.robust(linear._side(rows, REGIONS, s), REGIONS), REGIONS) for s in ("gt", "inf")]
    assert np.array(got) == pytest.approx(np.array(want), rel=1e-9, abs=1e-12)


def test_linear_prediction_reads_rows_once(counted):
    rows, _, reads = counted
    df = rows.withColumn("r3_gt", F.when(F.col(TIME) % 11 != 0, F.col("r3_gt")))
    models = [([f"r1_{s}", f"r2_{s}"], [f"r3_{s}", f"r4_{s}"]) for s in ("gt", "inf")]
    got = linear.predictive_r2s(df, models)
    assert reads() == 1
    table = df.withColumn("held", F.pmod(F.xxhash64(SEQ), F.lit(1000)) < 200).toPandas()
    for (inputs, outputs), r2 in zip(models, got, strict=True):
        train, test = table[~table["held"]], table[table["held"]].dropna(subset=[*inputs, *outputs])
        x = train[inputs].to_numpy()
        whole = train.dropna(subset=[*inputs, *outputs])
        a, y = whole[inputs].to_numpy(), whole[outputs].to_numpy()
        w = np.linalg.lstsq((x - x.mean(0)).T @ (x - x.mean(0)), (a - a.mean(0)).T @ (y - y.mean(0)), rcond=None)[0]
        off = test[outputs].to_numpy() - (test[inputs].to_numpy() @ w + y.mean(0) - x.mean(0) @ w)
        t = test[outputs].to_numpy()
        assert r2 == pytest.approx(1 - (off**2).sum() / (((t - t.mean(0)) ** 2).sum() + 1e-12), abs=1e-9)


def test_centres_take_two_jobs_a_round_at_most(spark):
    g = np.random.default_rng(11)
    df = spark.createDataFrame(g.standard_normal((2000, 2)).tolist(), "a double, b double")
    spark.sparkContext.setJobGroup("centres", "")
    try:
        found = clusters.centres(df, ["a", "b"], 4, steps=3)
        stages = sum(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("centres"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 4
    # three steps and the weights of the candidates are one stage each
    assert stages <= 30


def test_syllables_order_rows_once(spark, sf):
    rows = frames.pose(frames.paired(spark, sf)).withColumn("CENTER_X_inf", F.when(F.col(TIME) % 50 != 7, F.col("CENTER_X_inf")))
    moved = etho.both_steps(rows)
    assert plan(moved).count("Exchange hashpartitioning") == 1
    by = ["side", *KEYS]
    window = groupwise.Window.partitionBy("side", SEQ).orderBy(TIME)
    speed = etho.steps(rows).select(*by, F.lag("size", 1).over(window).alias("speed"))
    force = etho.steps(rows, order=2).select(*by, F.col("size").alias("acceleration"))
    want = speed.join(force, by).dropna()
    last = F.last("speed", ignorenulls=True).over(window.rowsBetween(groupwise.Window.unboundedPreceding, -1))
    got = moved.select(*by, last.alias("before"), "speed", "acceleration").dropna().select(*by, "before", "acceleration")
    assert got.count() == want.count() > 10_000 and got.exceptAll(want).count() == 0


def test_pairs_of_blocks_leave_in_parts():
    """One Arrow batch of blocks has millions of pairs; they must not be held."""
    g = np.random.default_rng(12)
    blocks, size = 300, 200
    x = g.standard_normal((blocks * size, embedding.AXES + 4))
    cuts = pa.array(np.arange(0, blocks * size + 1, size, dtype=np.int32))
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(np.arange(blocks * size))), pa.ListArray.from_arrays(cuts, points)], ["ids", "ps"])
    tracemalloc.start()
    n = 0
    for part in embedding._inside(15)(iter([batch.slice(1)])):
        n += part.num_rows
        if n == part.num_rows:
            first = {c: part.column(c).to_numpy() for c in "ijd"}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (blocks - 1) * size * 15 and peak < 60e6
    own = x[size : 2 * size, embedding.AXES :]
    d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert first["i"][:30].tolist() == [size] * 15 + [size + 1] * 15
    assert first["j"][:15].tolist() == (size + d[0].argsort(kind="stable")[:15]).tolist() and first["d"][:15] == pytest.approx(np.sort(d[0])[:15])


def test_movement_of_both_sides_in_one_order(spark, sf):
    rows = frames.pose(frames.paired(spark, sf)).withColumn("CENTER_X_gt", F.when(F.col(TIME) % 40 > 1, F.col("CENTER_X_gt")))
    for df in (rows, rows.drop("LEFT_EAR_X_inf")):
        got = movement.wide_features(df)
        assert plan(got).count("Exchange hashpartitioning") == 1
        want = movement.beside(movement.movement_features(df), movement.MOVEMENT).select(*got.columns)
        if "LEFT_EAR_X_inf" in df.columns:
            assert got.count() == want.count() and got.exceptAll(want).count() == 0
        else:
            assert got.dropna().count() == 0


def test_windows_of_all_pairs_in_one_order(spark, sf, counted):
    rows, _, reads = counted
    pairs = [(a, b) for i, a in enumerate(REGIONS) for b in REGIONS[i + 1 :]]
    found = neuro.sliding_pairs(rows, pairs)
    assert plan(found).count("Exchange hashpartitioning") == 1
    one = neuro.sliding_correlations(rows, "r2", "r4")
    assert found.select(SEQ, "start", F.round("p4_gt", 9), F.round("p4_inf", 9)).exceptAll(one.select(SEQ, "start", F.round("gt", 9), F.round("inf", 9))).count() == 0
    before = reads()
    assert {r.metric for r in structure.sliding_states(rows, REGIONS).collect()} == {"occupancy", "transition"}
    assert reads() - before == 1


def test_occupancy_and_velocity_read_rows_once(spark, counted):
    rows, _, reads = counted
    assert len(latent.occupancy_velocity(rows, REGIONS).collect()) >= 4
    assert reads() == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
