"""Whole scoring runs on small frames."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mirrorseq import api, cli
from mirrorseq.config import Config, load_config
from mirrorseq.plans import frames
from mirrorseq.plans.align import SEQ, TIME, DataValidationError


@pytest.fixture(scope="module")
def both(spark, sf):
    gt = frames.ground_truth(spark, sf).filter(f"{SEQ} < 6 and {TIME} < 120").cache()
    return gt, frames.predictions(gt)


def test_fidelity(both):
    got = {r.metric: r.value for r in api.compute_fidelity_scores(both[1], both[0]).collect()}
    assert got["FIDELITY_SCORE"] == pytest.approx(0.65 * got["Error_score"] + 0.35 * got["MI_score"])


def _track(df):
    return df.select(F.col(SEQ).alias("trial"), F.col(TIME).alias("frame"), F.col("r1").alias("BODY_X"), F.col("r2").alias("BODY_Y"), (F.col("r1") + F.col("r3")).alias("NOSE_X"), (F.col("r2") + F.col("r4")).alias("NOSE_Y"), (F.col("r1") - F.col("r4")).alias("TAIL_BASE_X"), (F.col("r2") - F.col("r3")).alias("TAIL_BASE_Y"))


def test_etho_with_own_keys(both):
    config = Config().updated({"sequence_key": "trial", "time_key": "frame", "center_part": "BODY", "unknown": 1})
    whole, each, across = api.compute_etho_scores(_track(both[0]), _track(both[1]), config)
    got = {r.metric: r.value for r in whole.collect()}
    assert 0 < got["composite_score"] < 1 and len(got) >= 9 and each.count() and across.count() >= 8
    with pytest.raises(DataValidationError):
        api.compute_etho_scores(_track(both[0]), _track(both[1]))


def test_cross(both):
    """All neural, behaviour and cross scores, and the composites."""
    rows = [d.select(*d.columns, F.col("r1").alias("CENTER_X"), F.col("r3").alias("CENTER_Y")) for d in both]
    got = {}
    for r in api.compute_cross_scores(rows[1], rows[0]).collect():
        got.setdefault(r.block, {})[r.metric] = r.value
    cross, traces, whole = got["cross_scores"], got["neuro_scores"], got["composite"]
    assert 0.4 < cross["cca_gt"] <= 1 and 0 <= cross["cca_alignment_score"] <= 1
    assert len(traces) >= 21 and all(v is not None and 0 <= v <= 1 for v in traces.values())
    assert traces["family_temporal_spectral"] == traces["TRJDIST_score"] and "direction_score" not in got["behavior_scores"]
    assert whole["composite"] == pytest.approx((whole["neuro_composite"] + whole["etho_composite"] + whole["cross_composite"]) / 3)
    assert whole["neuro_composite"] == traces["FINAL_COMPOSITE_SCORE"]


def test_no_overlap(both):
    with pytest.raises(DataValidationError):
        api.compute_neuro_scores(both[1].withColumn(TIME, F.col(TIME) + 10000), both[0])


@pytest.mark.parametrize(("text", "says"), [("", "is not JSON"), ('{"center_part": "BODY"', "is not JSON"), ("[1, 2]", "JSON object"), ("17", "JSON object")])
def test_malformed_config(tmp_path, text, says):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(DataValidationError, match=says):
        load_config(str(tmp_path / "c.json"))


def test_command_line(both, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)  # a folder without settings
    for name, df in zip(("gt", "preds"), both, strict=True):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cli.main(["fidelity-scores", "--gt", str(tmp_path / "gt.parquet"), "--preds", str(tmp_path / "preds.parquet"), "--json-out", str(tmp_path / "out/s.json")]) == 0
    assert "FIDELITY_SCORE" in json.loads((tmp_path / "out/s.json").read_text())["scores"]
