"""Queries that return every row of the paired frame, not sums of it."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from mirrorseq.plans import frames, queries
from mirrorseq.plans.align import KEYS

VALUES = [f"{v}_{s}" for v in frames.REGIONS for s in ("gt", "inf")]


@pytest.fixture
def duck(sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    return c


def _rows(df: pd.DataFrame) -> pd.DataFrame:
    return df[[*KEYS, *VALUES]].sort_values(KEYS).reset_index(drop=True)


def _paired(sf: str) -> pd.DataFrame:
    """The paired frame by pandas alone."""
    items = pd.read_parquet(f"{sf}/lineitem.parquet").sort_values(["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    gt = pd.DataFrame({KEYS[0]: items.l_suppkey, KEYS[1]: items.groupby("l_suppkey").cumcount(), "r1_gt": items.l_quantity, "r2_gt": items.l_extendedprice / 1000, "r3_gt": items.l_discount * 100, "r4_gt": items.l_tax * 100})
    gt["r1_inf"], gt["r2_inf"], gt["r4_inf"] = gt.r1_gt * 0.8 + gt.r2_gt * 0.2, gt.r2_gt * 1.05 + 1.0, 8.0 - gt.r4_gt
    gt["r3_inf"] = gt.groupby(KEYS[0]).r3_gt.shift(1, fill_value=0.0)
    return gt[gt[KEYS[1]] % 97 != 0]


@pytest.mark.parametrize("name", ["align_inner_join", "standardised"])
def test_every_row_and_value(spark, sf, duck, name):
    want = _paired(sf)
    if name == "standardised":
        for v in frames.REGIONS:
            mean, deviation = want[f"{v}_gt"].mean(), want[f"{v}_gt"].std(ddof=0)
            want[f"{v}_gt"], want[f"{v}_inf"] = (want[f"{v}_gt"] - mean) / deviation, (want[f"{v}_inf"] - mean) / deviation
    want = _rows(want)
    for found in (queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()):
        found = _rows(found)
        assert len(found) == len(want) > 1000 and (found[KEYS] == want[KEYS]).all().all()
        np.testing.assert_allclose(found[VALUES], want[VALUES], rtol=0, atol=2e-6)
