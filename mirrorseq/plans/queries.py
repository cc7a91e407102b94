"""Registered queries of the scoring operators, with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.quantiles import quantiles
from ..operators import clusters, etho, groupwise, latent, linear, movement, neuro, rollup, structure
from . import align, frames, reports
from .align import SEQ, TIME

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
R = frames.REGIONS

#: The frames of :mod:`.frames` in SQL.
_FRAMES = """
gt AS (
  SELECT l_suppkey AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS t,
    l_quantity + 0.0::DOUBLE AS r1, l_extendedprice / 1000 + 0.0::DOUBLE AS r2, l_discount * 100 + 0.0::DOUBLE AS r3, l_tax * 100 + 0.0::DOUBLE AS r4 FROM lineitem
), pred AS (
  SELECT * FROM (SELECT seq, t, r1 * 0.8::DOUBLE + r2 * 0.2::DOUBLE AS r1, r2 * 1.05::DOUBLE + 1.0::DOUBLE AS r2, lag(r3, 1, 0.0::DOUBLE) OVER (PARTITION BY seq ORDER BY t) AS r3, 8.0::DOUBLE - r4 AS r4 FROM gt) WHERE t % 97 <> 0
), paired AS (
  SELECT g.seq, g.t, g.r1 AS r1_gt, p.r1 AS r1_inf, g.r2 AS r2_gt, p.r2 AS r2_inf, g.r3 AS r3_gt, p.r3 AS r3_inf, g.r4 AS r4_gt, p.r4 AS r4_inf FROM gt g JOIN pred p USING (seq, t)
), cells AS (
  SELECT seq, t, 'r1' AS region, r1_gt AS g, r1_inf AS i FROM paired UNION ALL SELECT seq, t, 'r2', r2_gt, r2_inf FROM paired
  UNION ALL SELECT seq, t, 'r3', r3_gt, r3_inf FROM paired UNION ALL SELECT seq, t, 'r4', r4_gt, r4_inf FROM paired
), tracks AS (
  SELECT seq, t, 'gt' AS side, r1_gt AS r1, r2_gt AS r2, r3_gt AS r3, r4_gt AS r4 FROM paired UNION ALL SELECT seq, t, 'inf', r1_inf, r2_inf, r3_inf, r4_inf FROM paired
), moves AS (
  SELECT *, r1 - lag(r1) OVER w AS dx, r2 - lag(r2) OVER w AS dy,
    r1 - lag(r1) OVER w - (lag(r1) OVER w - lag(r1, 2) OVER w) AS ax, r2 - lag(r2) OVER w - (lag(r2) OVER w - lag(r2, 2) OVER w) AS ay
  FROM tracks WINDOW w AS (PARTITION BY side, seq ORDER BY t)
), scales AS (
  SELECT region, CASE WHEN q > 0 THEN q WHEN sd > 0 THEN sd ELSE 1.0 END AS scale FROM (SELECT region, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS q, stddev_pop(g) AS sd FROM cells GROUP BY region)
)"""


def query(sql: str | None = None, frames_needed: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"WITH {_FRAMES}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}") if frames_needed else sql
        return f

    return register


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals: engines add in different orders."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _whole(scores: DataFrame) -> DataFrame:
    """Rounded, with sequence -1 for the score of all sequences."""
    return _rounded(scores.withColumn(SEQ, F.coalesce(SEQ, F.lit(-1).cast("long"))))


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.pose(frames.paired(spark, sf_dir))


@query("SELECT l_orderkey AS \"sequenceId\", l_linenumber AS \"itemPosition\", count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", False)
def schema_duplicate_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias(SEQ), F.col("l_linenumber").alias(TIME))
    return align.duplicate_keys(rows)


@query("SELECT n_gt, n_pred, n_merged, (SELECT min(n) FROM (SELECT count(*) AS n FROM paired GROUP BY seq)) AS shortest, (SELECT max(n) FROM (SELECT count(*) AS n FROM paired GROUP BY seq)) AS longest, (SELECT count(DISTINCT seq) FROM paired) AS sequences, round(n_merged / least(n_gt, n_pred), 6) AS overlap, CASE WHEN n_merged / least(n_gt, n_pred) < 0.5 THEN 'error' WHEN n_merged / least(n_gt, n_pred) < 0.95 THEN 'warn' ELSE 'ok' END AS verdict FROM (SELECT (SELECT count(*) FROM gt) AS n_gt, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM paired) AS n_merged)")
def overlap_ratio(spark, sf_dir):
    gt = frames.ground_truth(spark, sf_dir)
    return _rounded(align.overlap(gt, frames.predictions(gt)))


@query("SELECT seq AS \"sequenceId\", t AS \"itemPosition\", " + ", ".join(f"round({v}_{s}, 9) AS {v}_{s}" for v in R for s in ("gt", "inf")) + " FROM paired")
def align_inner_join(spark, sf_dir):
    """Every row of the join of both sides on sequence and time.  Values have up
    to seven decimals, so they are rounded beyond those."""
    rows = frames.joined(spark, sf_dir)
    return rows.select(SEQ, TIME, *[(F.round(f"{v}_{s}", 9) + 0.0).alias(f"{v}_{s}") for v in R for s in ("gt", "inf")])


@query("SELECT seq AS \"sequenceId\", count(*) AS n FROM paired GROUP BY 1")
def sequence_lengths(spark, sf_dir):
    return frames.paired(spark, sf_dir).groupBy(SEQ).agg(F.count("*").alias("n"))


@query("SELECT region, round(avg(CASE WHEN g IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, round(stddev_pop(g), 6) AS deviation, CASE WHEN stddev_pop(g) < 1e-6 THEN 'error' ELSE 'ok' END AS verdict FROM (SELECT unnest(['r1', 'r2', 'r3', 'r4']) AS region, unnest([r1, r2, r3, r4]) AS g FROM gt) GROUP BY region")
def array_quality(spark, sf_dir):
    return _rounded(align.array_quality(frames.ground_truth(spark, sf_dir), R))


@query("SELECT round(abs(log10(stddev_pop(g) / stddev_pop(i))), 6) AS gap, abs(log10(stddev_pop(g) / stddev_pop(i))) <= 3 AS consistent FROM cells")
def scale_consistency(spark, sf_dir):
    return _rounded(align.scale_gap(frames.paired(spark, sf_dir), R))


@query("SELECT seq AS \"sequenceId\", count(*) AS n, max(t) AS last FROM (SELECT seq, t, row_number() OVER (PARTITION BY seq ORDER BY t) AS k FROM paired) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM paired GROUP BY seq)) GROUP BY seq")
def truncate_min_len(spark, sf_dir):
    return align.truncated(frames.paired(spark, sf_dir)).groupBy(SEQ).agg(F.count("*").alias("n"), F.max(TIME).alias("last"))


@query("SELECT k || ':' || user_id AS \"sequenceId\", count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1", False)
def tag_sequence_ids(spark, sf_dir):
    from ..sources.files import tagged

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias(SEQ), "value")
    return tagged([events, events]).groupBy(SEQ).agg(F.count("*").alias("n"))


@query("SELECT user_id AS \"sequenceId\", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS \"itemPosition\", round(value, 6) AS \"value\" FROM events", False)
def cumcount(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _rounded(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias(SEQ), at.cast("long").alias(TIME), "value"))


@query("SELECT side, seq AS \"sequenceId\", t AS \"itemPosition\", round(sqrt(dx * dx + dy * dy), 6) AS size FROM moves WHERE dx IS NOT NULL")
def speed(spark, sf_dir):
    return _rounded(etho.steps(_posed(spark, sf_dir)).select("side", SEQ, TIME, "size"))


@query("SELECT side, seq AS \"sequenceId\", t AS \"itemPosition\", round(sqrt(ax * ax + ay * ay), 6) AS size FROM moves WHERE ax IS NOT NULL")
def acceleration(spark, sf_dir):
    return _rounded(etho.steps(_posed(spark, sf_dir), order=2).select("side", SEQ, TIME, "size"))


def _distribution_sql(x: str, y: str) -> str:
    return f"""+ sizes AS (SELECT side, seq, sqrt({x} * {x} + {y} * {y}) AS v FROM moves WHERE {x} IS NOT NULL
), edges AS (SELECT min(v) AS lo, max(v) AS hi FROM sizes
), counts AS (SELECT side, seq, least(floor((v - lo) / (hi - lo) * 59), 58)::INT AS bin, count(*) AS n FROM sizes, edges GROUP BY ALL
), every AS (SELECT * FROM counts UNION ALL SELECT side, NULL, bin, sum(n) FROM counts GROUP BY ALL
), wide AS (SELECT seq, bin, coalesce(sum(n) FILTER (side = 'gt'), 0) AS g, coalesce(sum(n) FILTER (side = 'inf'), 0) AS i FROM every GROUP BY ALL
), dense AS (SELECT seq, g / sum(g) OVER (PARTITION BY seq) + 1e-12 * (hi - lo) / 59 AS p, i / sum(i) OVER (PARTITION BY seq) + 1e-12 * (hi - lo) / 59 AS q, g FROM wide, edges)
SELECT coalesce(seq, -1) AS "sequenceId", round(1 / (1 + 0.5 * (sum(p * ln(p / q)) + sum(q * ln(q / p)))), 6) AS score, sum(g)::BIGINT AS weight FROM dense GROUP BY seq"""


@query(_distribution_sql("dx", "dy"))
def velocity_kl(spark, sf_dir):
    return _whole(etho.distribution(_posed(spark, sf_dir), 1))


@query(_distribution_sql("ax", "ay"))
def acceleration_kl(spark, sf_dir):
    return _whole(etho.distribution(_posed(spark, sf_dir), 2))


@query("""+ sizes AS (SELECT side, seq, sqrt(dx * dx + dy * dy) AS v FROM moves WHERE dx IS NOT NULL
), cap AS (SELECT quantile_cont(v, 0.1) AS c FROM sizes WHERE side = 'gt'
), gaps AS (SELECT seq, abs(avg(CASE WHEN side = 'gt' THEN (v <= c)::INT END) - avg(CASE WHEN side = 'inf' THEN (v <= c)::INT END)) AS gap, count(*) FILTER (side = 'gt') AS weight FROM sizes, cap GROUP BY seq)
SELECT seq AS "sequenceId", round(1 - least(1, gap), 6) AS score, weight FROM gaps UNION ALL SELECT -1, round(1 - least(1, avg(gap)), 6), sum(weight)::BIGINT FROM gaps""")
def stationary(spark, sf_dir):
    return _whole(etho.stationary(_posed(spark, sf_dir)))


@query("""+ cosines AS (SELECT side, seq, t, (dx * (r1 + r3 - (r1 - r4)) + dy * (r2 + r4 - (r2 - r3))) / ((sqrt(dx * dx + dy * dy) + 1e-8) * (sqrt((r1 + r3 - (r1 - r4)) ** 2 + (r2 + r4 - (r2 - r3)) ** 2) + 1e-8)) AS c FROM moves WHERE dx IS NOT NULL
), gaps AS (SELECT seq, avg(abs(g - i)) AS gap, count(g) AS weight FROM (SELECT seq, t, max(c) FILTER (side = 'gt') AS g, max(c) FILTER (side = 'inf') AS i FROM cosines GROUP BY ALL) GROUP BY seq)
SELECT seq AS "sequenceId", round(1 - least(1, gap / 2), 6) AS score, weight FROM gaps UNION ALL SELECT -1, round(1 - least(1, avg(gap) / 2), 6), sum(weight)::BIGINT FROM gaps""")
def direction(spark, sf_dir):
    return _whole(etho.direction(_posed(spark, sf_dir)))


def _share_sql(cell: str, edges: str, width: str) -> str:
    return f"""+ edges AS (SELECT {edges} FROM tracks
), counts AS (SELECT side, seq, {cell} AS bin, count(*) AS n FROM tracks, edges GROUP BY ALL
), every AS (SELECT * FROM counts UNION ALL SELECT side, NULL, bin, sum(n) FROM counts GROUP BY ALL
), wide AS (SELECT seq, bin, coalesce(sum(n) FILTER (side = 'gt'), 0) AS g, coalesce(sum(n) FILTER (side = 'inf'), 0) AS i FROM every GROUP BY ALL
), dense AS (SELECT seq, g / sum(g) OVER (PARTITION BY seq) + 1e-12 * {width} AS p, i / sum(i) OVER (PARTITION BY seq) + 1e-12 * {width} AS q, g FROM wide, edges)
SELECT coalesce(seq, -1) AS "sequenceId", round(1 / (1 + 0.5 * (sum(p * ln(p / q)) + sum(q * ln(q / p)))), 6) AS score, sum(g)::BIGINT AS weight FROM dense GROUP BY seq"""


@query(_share_sql("2 * (r1 > mx)::INT + (r2 > my)::INT", "(min(r1) + max(r1)) / 2 AS mx, (min(r2) + max(r2)) / 2 AS my", "1"))
def quadrant_kl(spark, sf_dir):
    return _whole(etho.quadrant(_posed(spark, sf_dir)))


@query(_share_sql("least(floor((r1 - x0) / (x1 - x0) * 60), 59)::INT * 60 + least(floor((r2 - y0) / (y1 - y0) * 60), 59)::INT", "min(r1) AS x0, max(r1) AS x1, min(r2) AS y0, max(r2) AS y1", "((x1 - x0) / 60 * ((y1 - y0) / 60))"))
def position_kl(spark, sf_dir):
    return _whole(etho.position(_posed(spark, sf_dir)))


@query("""+ parts AS (
  SELECT 'CENTER' AS part, r1_gt AS x, r2_gt AS y, r1_inf AS u, r2_inf AS v FROM paired UNION ALL SELECT 'NOSE', r1_gt + r3_gt, r2_gt + r4_gt, r1_inf + r3_inf, r2_inf + r4_inf FROM paired
  UNION ALL SELECT 'TAIL_BASE', r1_gt - r4_gt, r2_gt - r3_gt, r1_inf - r4_inf, r2_inf - r3_inf FROM paired UNION ALL SELECT 'LEFT_EAR', r1_gt + r4_gt, r2_gt, r1_inf + r4_inf, r2_inf FROM paired
  UNION ALL SELECT 'RIGHT_EAR', r1_gt, r2_gt + r3_gt, r1_inf, r2_inf + r3_inf FROM paired)
SELECT part, round(sqrt(avg((u - x) ** 2 + (v - y) ** 2)), 6) AS rmse, round(avg(abs(u - x)), 6) AS mae_x, round(avg(abs(v - y)), 6) AS mae_y, round(corr(x, u), 6) AS corr_x, round(corr(y, v), 6) AS corr_y FROM parts GROUP BY part""")
def body_part_errors(spark, sf_dir):
    return _rounded(etho.body_part_errors(_posed(spark, sf_dir), frames.PARTS))


@query("""SELECT side, pair, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS deviation FROM (
  SELECT side, 'NOSE-TAIL_BASE' AS pair, sqrt((r1 + r3 - (r1 - r4)) ** 2 + (r2 + r4 - (r2 - r3)) ** 2) AS d FROM tracks UNION ALL SELECT side, 'LEFT_EAR-RIGHT_EAR', sqrt((r1 + r4 - r1) ** 2 + (r2 - (r2 + r3)) ** 2) FROM tracks
  UNION ALL SELECT side, 'NOSE-CENTER', sqrt((r1 + r3 - r1) ** 2 + (r2 + r4 - r2) ** 2) FROM tracks) GROUP BY ALL""")
def inter_limb_distances(spark, sf_dir):
    return _rounded(etho.inter_limb_distances(_posed(spark, sf_dir), [("NOSE", "TAIL_BASE"), ("LEFT_EAR", "RIGHT_EAR"), ("NOSE", "CENTER")]))


@query("""+ turned AS (SELECT side, seq, t, sqrt(dx * dx + dy * dy) AS v, acos(greatest(-1, least(1, (dx * lag(dx) OVER w + dy * lag(dy) OVER w) / ((sqrt(dx * dx + dy * dy) + 1e-8) * (sqrt(lag(dx) OVER w ** 2 + lag(dy) OVER w ** 2) + 1e-8))))) AS turn FROM moves WINDOW w AS (PARTITION BY side, seq ORDER BY t)
), sums AS (SELECT side, seq, sum(v) AS path, avg(v) AS speed, avg(turn) AS turn FROM turned WHERE v IS NOT NULL GROUP BY ALL
), ends AS (SELECT side, seq, sqrt((arg_max(r1, t) - arg_min(r1, t)) ** 2 + (arg_max(r2, t) - arg_min(r2, t)) ** 2) AS net FROM tracks GROUP BY ALL)
SELECT side, seq AS "sequenceId", round(path, 6) AS path, round(net, 6) AS net, round(net / (path + 1e-8), 6) AS straightness, round(speed, 6) AS speed, round(turn, 6) AS turn FROM sums JOIN ends USING (side, seq)""")
def path_features(spark, sf_dir):
    return _rounded(etho.path_features(_posed(spark, sf_dir)))


@query("""+ v AS (SELECT seq, region, g AS x, 'gt' AS side FROM cells UNION ALL SELECT seq, region, i, 'inf' FROM cells
), e AS (SELECT seq, region, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi, count(*) FILTER (side = 'gt') AS n FROM v GROUP BY ALL
), b AS (SELECT seq, region, n, CASE WHEN x < lo THEN -1 WHEN x > hi THEN 60 ELSE least(floor((x - lo) / (hi - lo) * 60), 59)::INT END AS bin, count(*) FILTER (side = 'gt') AS g, count(*) FILTER (side = 'inf') AS i FROM v JOIN e USING (seq, region) GROUP BY ALL
), p AS (SELECT seq, region, (g + 1e-12) / (n + 62e-12) AS p, (i + 1e-12) / (n + 62e-12) AS q FROM b
), k AS (SELECT seq, region, 0.5 * (sum(p * ln(p / q)) + sum(q * ln(q / p))) AS kl FROM p GROUP BY ALL
), s AS (SELECT seq, exp(avg(ln(1 / (1 + kl)))) AS s FROM k GROUP BY seq)
SELECT round(0.5 * (avg(s) + quantile_cont(s, 0.1)), 6) AS score FROM s""")
def neuro_kl(spark, sf_dir):
    return _rounded(neuro.kl(frames.paired(spark, sf_dir), R))


def _top_sql(each: str, share: float) -> str:
    return f"""+ d AS ({each}), k AS (SELECT seq, d, row_number() OVER (PARTITION BY seq ORDER BY d DESC) AS k, count(*) OVER (PARTITION BY seq) AS n FROM d
), s AS (SELECT seq, avg(d) AS d FROM k WHERE k <= ceil({share} * n) GROUP BY seq) SELECT round(1 / (1 + avg(d)), 6) AS score FROM s"""


@query(_top_sql("SELECT seq, abs(avg(g) - avg(i)) / (max(scale) + 1e-12) AS d FROM cells JOIN scales USING (region) GROUP BY seq, region", 0.1))
def neuro_mean_shift(spark, sf_dir):
    return _rounded(neuro.mean_shift(frames.paired(spark, sf_dir), R))


@query(_top_sql(f"SELECT seq, list_avg(list_transform(list_zip(quantile_cont(g, {neuro.TAILS}), quantile_cont(i, {neuro.TAILS})), lambda z: abs(z[1] - z[2]))) / (max(scale) + 1e-12) AS d FROM cells JOIN scales USING (region) GROUP BY seq, region", 0.25))
def neuro_quantile(spark, sf_dir):
    return _rounded(neuro.quantile_shift(frames.paired(spark, sf_dir), R))


@query("SELECT round(avg(1 / (1 + d)), 6) AS score FROM (SELECT region, abs(ln((var_pop(i) + 1e-8) / (var_pop(g) + 1e-8))) + 0.5 * abs(skewness(i) - skewness(g)) + 0.25 * abs(kurtosis(i) - kurtosis(g)) AS d FROM cells GROUP BY region)")
def neuro_moments(spark, sf_dir):
    return _rounded(neuro.moments(frames.paired(spark, sf_dir), R))


@query(_top_sql("SELECT seq, sqrt(avg((i - g) ** 2)) / (max(scale) + 1e-12) AS d FROM cells JOIN scales USING (region) GROUP BY seq, region", 0.25))
def error_nrmse(spark, sf_dir):
    return _rounded(neuro.error(frames.paired(spark, sf_dir), R))


@query("SELECT region, round(scale, 6) AS scale FROM scales")
def iqr_scale(spark, sf_dir):
    return _rounded(neuro.scales(align.long_form(frames.paired(spark, sf_dir), R)))


_CORR = "+ c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}_gt, {b}_gt) AS g, corr({a}_inf, {b}_inf) AS i FROM paired" for k, a in enumerate(R) for b in R[k + 1 :]) + ")"
_LAGGED = "+ w AS (SELECT *, " + ", ".join(f"lead({v}_{s}) OVER o AS {v}_{s}_l" for v in R for s in ("gt", "inf")) + " FROM paired WINDOW o AS (PARTITION BY seq ORDER BY t)), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}_gt, {b}_gt_l) AS g, corr({a}_inf, {b}_inf_l) AS i FROM w" for a in R for b in R) + ")"


@query(_CORR + " SELECT a, b, round(g, 6) AS gt, round(i, 6) AS inf FROM c")
def corr_matrix(spark, sf_dir):
    return _rounded(neuro.correlations(frames.paired(spark, sf_dir), R))


@query(_LAGGED + " SELECT a, b, round(g, 6) AS gt, round(i, 6) AS inf FROM c")
def lagged_corr_matrix(spark, sf_dir):
    return _rounded(neuro.lagged_correlations(frames.paired(spark, sf_dir), R))


@query(_CORR + """, n AS (SELECT a AS node, b AS o, g, i FROM c UNION ALL SELECT b, a, g, i FROM c
), k AS (SELECT *, row_number() OVER (ORDER BY abs(g) DESC, a DESC, b DESC) <= 3 AS x, row_number() OVER (ORDER BY abs(i) DESC, a DESC, b DESC) <= 3 AS y FROM c
), j AS (SELECT sum((x AND y)::INT) / sum((x OR y)::INT) AS jaccard FROM k
), d AS (SELECT 1 / (1 + avg(abs(i - g)) / (avg(g) + 1e-8)) AS degree FROM (SELECT node, 1 + sum(abs(g)) AS g, 1 + sum(abs(i)) AS i FROM n GROUP BY node)
), e AS (SELECT a AS u, b AS v, x, y FROM k UNION ALL SELECT b, a, x, y FROM k
), l AS (SELECT (1 - avg(abs(p - q))) AS clustering FROM (
  SELECT m.node, coalesce((SELECT count(*) FROM e f, e h, e z WHERE f.u = m.node AND h.u = m.node AND f.v < h.v AND z.u = f.v AND z.v = h.v AND f.x AND h.x AND z.x) * 2.0 / nullif((SELECT count(*) FROM e f WHERE f.u = m.node AND f.x) * ((SELECT count(*) FROM e f WHERE f.u = m.node AND f.x) - 1), 0), 0) AS p,
    coalesce((SELECT count(*) FROM e f, e h, e z WHERE f.u = m.node AND h.u = m.node AND f.v < h.v AND z.u = f.v AND z.v = h.v AND f.y AND h.y AND z.y) * 2.0 / nullif((SELECT count(*) FROM e f WHERE f.u = m.node AND f.y) * ((SELECT count(*) FROM e f WHERE f.u = m.node AND f.y) - 1), 0), 0) AS q
  FROM (SELECT DISTINCT node FROM n) m))
SELECT round(jaccard, 6) AS jaccard, round(degree, 6) AS degree, round(clustering, 6) AS clustering, round(exp((ln(greatest(1e-6, jaccard)) + ln(greatest(1e-6, degree)) + ln(greatest(1e-6, clustering))) / 3), 6) AS score FROM j, d, l""")
def graph_agreement(spark, sf_dir):
    return _rounded(neuro.graph(frames.paired(spark, sf_dir), R))


_SIMILAR = "round(0.6 * (corr(g, i) + 1) / 2 + 0.4 / (1 + sqrt(avg((g - i) ** 2)) / stddev_pop(g)), 6) AS score"


@query(_LAGGED + f" SELECT {_SIMILAR} FROM c")
def lagged_matrix_similarity(spark, sf_dir):
    return _rounded(neuro.matrix_similarity(neuro.lagged_correlations(frames.paired(spark, sf_dir), R)))


@query("SELECT seq AS \"sequenceId\", round((corr(r1_gt, r1_inf) + 1) / 2, 6) AS correlation, round(1 / (1 + sqrt(avg((r1_gt - r1_inf) ** 2)) / stddev_pop(r1_gt)), 6) AS similarity FROM paired GROUP BY seq")
def rmse_similarity(spark, sf_dir):
    g, i = F.col("r1_gt"), F.col("r1_inf")
    return _rounded(frames.paired(spark, sf_dir).groupBy(SEQ).agg(stats.correlation01(g, i).alias("correlation"), stats.rmse_similarity(g, i).alias("similarity")))


_CENTRES = [[10.0, 15.0], [25.0, 30.0], [40.0, 60.0], [25.0, 90.0]]
_STATES = "+ s AS (SELECT side, seq, t, list_position(d, list_min(d)) - 1 AS state FROM (SELECT side, seq, t, [" + ", ".join(f"0.0::DOUBLE + (r1 - {a}) * (r1 - {a}) + (r2 - {b}) * (r2 - {b})" for a, b in _CENTRES) + "] AS d FROM tracks))"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.sides(frames.paired(spark, sf_dir), ["r1", "r2"])
    return neuro.states(rows, ["r1", "r2"], _CENTRES)


@query(_STATES + " SELECT k::INT AS state, round(count(*) FILTER (side = 'gt') / (SELECT count(*) FROM s WHERE side = 'gt'), 6) AS gt, round(count(*) FILTER (side = 'inf') / (SELECT count(*) FROM s WHERE side = 'inf'), 6) AS inf FROM range(4) r(k) LEFT JOIN s ON s.state = k GROUP BY k")
def state_occupancy_fixed_centres(spark, sf_dir):
    return _rounded(neuro.occupancy(_assigned(spark, sf_dir), len(_CENTRES)))


@query(_STATES + ", m AS (SELECT side, state, lead(state) OVER (PARTITION BY side, seq ORDER BY t) AS nxt FROM s) SELECT (k // 4)::INT AS state, (k % 4)::INT AS \"to\", round(count(*) FILTER (side = 'gt') / (SELECT count(*) FROM m WHERE side = 'gt' AND nxt IS NOT NULL), 6) AS gt, round(count(*) FILTER (side = 'inf') / (SELECT count(*) FROM m WHERE side = 'inf' AND nxt IS NOT NULL), 6) AS inf FROM range(16) r(k) LEFT JOIN m ON m.state = k // 4 AND m.nxt = k % 4 GROUP BY k")
def state_transition_fixed_centres(spark, sf_dir):
    return _rounded(neuro.transitions(_assigned(spark, sf_dir), len(_CENTRES)))


@query(_STATES + ", h AS (SELECT k, count(*) FILTER (side = 'gt') / (SELECT count(*) FROM s WHERE side = 'gt') AS g, count(*) FILTER (side = 'inf') / (SELECT count(*) FROM s WHERE side = 'inf') AS i FROM range(4) r(k) LEFT JOIN s ON s.state = k GROUP BY k) SELECT round(0.4 * sum(least(g, i)) + 0.25 * (corr(g, i) + 1) / 2 + 0.35 / (1 + sqrt(avg((g - i) ** 2)) / stddev_pop(g)), 6) AS score FROM h")
def hist_similarity(spark, sf_dir):
    return _rounded(neuro.histogram_similarity(neuro.occupancy(_assigned(spark, sf_dir), len(_CENTRES))))


_CENTRED = "+ z AS (SELECT seq, t, region, g - avg(g) OVER w AS g, i - avg(i) OVER w AS i, row_number() OVER (PARTITION BY seq, region ORDER BY t) AS k FROM cells WINDOW w AS (PARTITION BY seq, region)), y AS (SELECT a.seq, a.region, b.k - a.k AS lag, sum(a.g * b.g) AS g, sum(a.i * b.i) AS i FROM z a JOIN z b ON a.seq = b.seq AND a.region = b.region AND b.k - a.k BETWEEN 0 AND 48 GROUP BY ALL), u AS (SELECT y.seq, y.region, y.lag, y.g / o.g AS gt, y.i / o.i AS inf FROM y JOIN y o ON o.seq = y.seq AND o.region = y.region AND o.lag = 0 WHERE y.lag > 0)"


@query(_CENTRED + ' SELECT seq AS "sequenceId", region, lag::INT AS lag, round(gt, 6) AS gt, round(inf, 6) AS inf FROM u')
def autocorrelation(spark, sf_dir):
    """All regions at lags 1 to 48."""
    return _rounded(neuro.autocorrelations(frames.paired(spark, sf_dir), R))


@query("+ a AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS place FROM paired) SELECT seq AS \"sequenceId\", (k * 15)::BIGINT AS start, round(corr(r1_gt, r2_gt), 6) AS gt, round(corr(r1_inf, r2_inf), 6) AS inf FROM a, range(60) r(k) WHERE place BETWEEN k * 15 AND k * 15 + 44 GROUP BY seq, k HAVING count(*) = 45")
def dfc_window_corr(spark, sf_dir):
    return _rounded(neuro.sliding_correlations(frames.paired(spark, sf_dir), "r1", "r2"))


@query("+ m AS (SELECT avg(r1_gt) AS x, avg(r1_inf) AS y FROM paired GROUP BY seq), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM m) SELECT round((corr(x, y) + 1) / 2, 6) AS score FROM k")
def spearman01(spark, sf_dir):
    means = frames.paired(spark, sf_dir).groupBy(SEQ).agg(F.avg("r1_gt").alias("x"), F.avg("r1_inf").alias("y"))
    return _rounded(neuro.spearman01(means, "x", "y"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbation records: suppliers' r1 and r3 errors at levels from r4."""
    cells = align.long_form(frames.paired(spark, sf_dir), R).withColumn("level", (F.col(TIME) % 5) / 4.0)
    value: Column = 1.0 / (1.0 + F.abs(F.col("gt") - F.col("inf")) * (1.0 + F.col("level")))
    return cells.select(F.concat(F.lit("p"), (F.col(SEQ) % 3).cast("string")).alias("perturbation"), "level", F.col("region").alias("metric"), value.alias("value"))


_SCORES = "+ x AS (SELECT 'p' || (seq % 3) AS perturbation, (t % 5) / 4.0::DOUBLE AS level, region AS metric, 1 / (1 + abs(g - i) * (1 + (t % 5) / 4.0::DOUBLE)) AS value FROM cells)"


@query(_SCORES + " SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(min(value), 6) AS least, round(max(value), 6) AS most FROM x GROUP BY metric")
def oracle_summary(spark, sf_dir):
    return _rounded(rollup.spread(_scores(spark, sf_dir), ["metric"]))


@query(_SCORES + " SELECT perturbation, round(level, 6) AS level, metric, round(avg(value), 6) AS mean FROM x GROUP BY ALL")
def dose_response(spark, sf_dir):
    return _rounded(rollup.dose_response(_scores(spark, sf_dir)))


@query(_SCORES + ", o AS (SELECT metric, avg(value) AS o FROM x WHERE level = 0 GROUP BY metric), l AS (SELECT perturbation, metric, avg(value) AS m FROM x WHERE level = 1 GROUP BY ALL) SELECT perturbation, metric, round((o - m) / greatest(o, 1e-9), 6) AS \"drop\" FROM l JOIN o USING (metric)")
def selectivity(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return _rounded(rollup.selectivity(scores, scores.filter("level = 0")))


@query(_SCORES + ", d AS (SELECT perturbation, level, metric, avg(value) AS m FROM x GROUP BY ALL), s AS (SELECT *, m - lag(m) OVER w AS step, rank() OVER w AS u, rank() OVER (PARTITION BY perturbation, metric ORDER BY m) AS v FROM d WINDOW w AS (PARTITION BY perturbation, metric ORDER BY level)) SELECT perturbation, metric, round(avg((step <= 0)::INT), 6) AS falling, round(arg_max(m, level) - arg_min(m, level), 6) AS change, round((corr(u, v) + 1) / 2, 6) AS rank01 FROM s GROUP BY ALL")
def monotonicity(spark, sf_dir):
    return _rounded(rollup.monotonicity(_scores(spark, sf_dir)))


@query(_SCORES + " SELECT metric, round(avg((value >= 0.9)::INT), 6) AS at_90, round(avg((value >= 0.95)::INT), 6) AS at_95 FROM x GROUP BY metric")
def saturation(spark, sf_dir):
    return _rounded(rollup.saturation(_scores(spark, sf_dir), ["metric"]))


@query(_SCORES + " SELECT perturbation, round(exp(avg(ln(greatest(1e-6, least(1 - 1e-6, value))))), 6) AS composite FROM x GROUP BY perturbation")
def geometric_mean(spark, sf_dir):
    return _rounded(rollup.composite(_scores(spark, sf_dir), ["perturbation"]))


@query("SELECT * FROM (SELECT round(sum(w * v) FILTER (v IS NOT NULL) / sum(w) FILTER (v IS NOT NULL), 6) AS mean, seq AS \"sequenceId\" FROM (SELECT seq, 1 + t % 3 AS w, CASE WHEN t % 7 <> 0 THEN r1_gt END AS v FROM paired) GROUP BY seq)")
def weighted_mean_available(spark, sf_dir):
    rows = frames.paired(spark, sf_dir).select(SEQ, (1 + F.col(TIME) % 3).alias("w"), F.when(F.col(TIME) % 7 != 0, F.col("r1_gt")).alias("v"))
    return _rounded(rows.groupBy(SEQ).agg(stats.weighted_mean(F.col("v"), F.col("w")).alias("mean")))


@query()
def syllable(spark, sf_dir):
    return _whole(clusters.syllables(_posed(spark, sf_dir)))


@query()
def trajectory_shape(spark, sf_dir):
    return _whole(clusters.trajectory_shapes(_posed(spark, sf_dir)))


@query()
def latent_states(spark, sf_dir):
    return _rounded(clusters.latent_states(frames.paired(spark, sf_dir), R))


@query()
def dtw_similarity(spark, sf_dir):
    return _rounded(groupwise.dtw_similarity(_posed(spark, sf_dir)))


@query()
def ksg_mi(spark, sf_dir):
    return _rounded(groupwise.ksg_mi(frames.paired(spark, sf_dir), R))


@query()
def mi_score(spark, sf_dir):
    return _rounded(groupwise.mi_score(frames.paired(spark, sf_dir), R))


#: Windows of 256 rows, half overlapping; sums of the values times cosines and
#: sines give the spectrum.
_SPECTRA = """+ c AS (SELECT seq, region, row_number() OVER (PARTITION BY seq, region ORDER BY t) - 1 AS place, count(*) OVER (PARTITION BY seq, region) AS n, g, i FROM cells
), z AS (SELECT *, least(256, n) AS size, least(256, n) - least(256, n) // 2 AS step FROM c WHERE n >= 64
), w AS (SELECT seq, region, size, k AS win, place - k * step AS p, g, i FROM z, range(0, 40) r(k) WHERE k <= (n - size) // step AND place BETWEEN k * step AND k * step + size - 1
), m AS (SELECT seq, region, size, win, p, g - avg(g) OVER o AS g, i - avg(i) OVER o AS i, 0.5 - 0.5 * cos(2 * pi() * p / size) AS h FROM w WINDOW o AS (PARTITION BY seq, region, win)
), f AS (SELECT seq, region, win, size, freq, sum(g * h * cos(2 * pi() * freq * p / size)) AS gc, sum(g * h * sin(2 * pi() * freq * p / size)) AS gs, sum(i * h * cos(2 * pi() * freq * p / size)) AS ic, sum(i * h * sin(2 * pi() * freq * p / size)) AS ii
  FROM m, range(1, 129) s(freq) WHERE freq <= size // 2 GROUP BY ALL
), e AS (SELECT seq, region, freq, avg((gc ** 2 + gs ** 2) * CASE WHEN 2 * freq = size THEN 1 ELSE 2 END) AS g, avg((ic ** 2 + ii ** 2) * CASE WHEN 2 * freq = size THEN 1 ELSE 2 END) AS i FROM f GROUP BY ALL
), s AS (SELECT seq, region, freq, g / sum(g) OVER o AS g, i / sum(i) OVER o AS i FROM e WINDOW o AS (PARTITION BY seq, region)
), a AS (SELECT freq, avg(g) AS g, avg(i) AS i FROM s GROUP BY freq)"""


@query(_SPECTRA + """, b AS (SELECT g / sum(g) OVER () AS g, i / sum(i) OVER () AS i, sum(g) OVER (ORDER BY freq) / sum(g) OVER () AS c FROM a)
SELECT round(1 - 0.5 * sum(abs(g - i)), 6) AS score FROM (SELECT CASE WHEN c <= 1 / 3 THEN 0 WHEN c <= 2 / 3 THEN 1 ELSE 2 END AS band, sum(g) AS g, sum(i) AS i FROM b GROUP BY band)""")
def bandpower(spark, sf_dir):
    return _rounded(groupwise.band_power_score(frames.paired(spark, sf_dir), R))


@query(_SPECTRA + " SELECT freq::INT AS frequency, round(g, 6) AS gt, round(i, 6) AS inf FROM a")
def spectra(spark, sf_dir):
    """Mean shares of power by frequency."""
    shares = groupwise.band_power(frames.paired(spark, sf_dir), R)
    return _rounded(shares.groupBy("frequency").agg(F.avg("gt").alias("gt"), F.avg("inf").alias("inf")))


#: The main direction of two traces lies at half the angle of their covariance.
_LEAD_LAG = """+ z AS (SELECT side, seq, t, r3 - avg(r3) OVER o AS x, r4 - avg(r4) OVER o AS y, coalesce(sqrt(dx * dx + dy * dy), 0) AS speed, row_number() OVER (PARTITION BY side, seq ORDER BY t) AS k, count(*) OVER o AS n FROM moves WINDOW o AS (PARTITION BY side, seq)
), d AS (SELECT side, seq, cos(a) AS u, sin(a) AS v FROM (SELECT side, seq, 0.5 * atan2(2 * sum(x * y), sum(x * x) - sum(y * y)) AS a FROM z GROUP BY ALL)
), m AS (SELECT z.side, z.seq, k, speed, (x * u + y * v) * sign(CASE WHEN abs(u) >= abs(v) THEN u ELSE v END) AS main FROM z JOIN d ON z.side = d.side AND z.seq = d.seq WHERE n >= 33
), c AS (SELECT a.side, a.seq, a.k - b.k AS lag, corr(a.main, b.speed) AS r FROM m a JOIN m b ON a.side = b.side AND a.seq = b.seq AND abs(a.k - b.k) <= 30 GROUP BY ALL
), l AS (SELECT lag::INT AS lag, avg(r) FILTER (side = 'gt') AS gt, avg(r) FILTER (side = 'inf') AS inf FROM c GROUP BY lag)"""


@query(_LEAD_LAG + " SELECT lag, round(gt, 6) AS gt, round(inf, 6) AS inf FROM l")
def lead_lag_curve(spark, sf_dir):
    rows = frames.paired(spark, sf_dir)
    both = rows.select("*", *[F.col(f"{r}_{s}").alias(f"CENTER_{a}_{s}") for r, a in (("r1", "X"), ("r2", "Y")) for s in ("gt", "inf")])
    return _rounded(groupwise.lead_lag(both, ["r3", "r4"]))


@query(_LEAD_LAG + ", p AS (SELECT arg_max(lag, {'r': abs(gt), 'l': -lag}) AS gt, arg_max(lag, {'r': abs(inf), 'l': -lag}) AS inf FROM l) SELECT gt, inf, round(1 - least(1, abs(gt - inf) / 30), 6) AS score FROM p")
def lead_lag(spark, sf_dir):
    rows = frames.paired(spark, sf_dir)
    both = rows.select("*", *[F.col(f"{r}_{s}").alias(f"CENTER_{a}_{s}") for r, a in (("r1", "X"), ("r2", "Y")) for s in ("gt", "inf")])
    return _rounded(groupwise.lead_lag_score(groupwise.lead_lag(both, ["r3", "r4"])))


@query()
def mmd(spark, sf_dir):
    return _rounded(groupwise.mmd_similarity(_posed(spark, sf_dir), ["CENTER_X", "CENTER_Y"]))


@query()
def cross_region_mi(spark, sf_dir):
    return _rounded(groupwise.cross_region_mi(frames.paired(spark, sf_dir), R))


@query()
def subspace_angle(spark, sf_dir):
    return _rounded(linear.subspace_angle(frames.paired(spark, sf_dir), R))


@query()
def lagged_covariance(spark, sf_dir):
    return _rounded(linear.lagged_covariance(frames.paired(spark, sf_dir), R))


@query()
def var1_impulse(spark, sf_dir):
    return _rounded(linear.impulse_response(frames.paired(spark, sf_dir), R))


@query()
def procrustes(spark, sf_dir):
    return _rounded(linear.procrustes(_posed(spark, sf_dir), ["CENTER_X", "CENTER_Y", "NOSE_X"]))


@query()
def cca(spark, sf_dir):
    """Mean canonical correlation of two pairs of regions on either side."""
    rows = frames.paired(spark, sf_dir)
    both = {s: linear.canonical_correlation(rows, [f"r1_{s}", f"r2_{s}"], [f"r3_{s}", f"r4_{s}"]) for s in ("gt", "inf")}
    return _rounded(linear._row(spark, gt=both["gt"], inf=both["inf"], score=1 - min(1, abs(both["gt"] - both["inf"]))))


@query()
def predictive_r2(spark, sf_dir):
    rows = frames.paired(spark, sf_dir)
    scores = linear.predictive_r2s(rows, [([f"r1_{s}", f"r2_{s}"], [f"r3_{s}", f"r4_{s}"]) for s in ("gt", "inf")])
    both = dict(zip(("gt", "inf"), scores, strict=True))
    score = None if None in both.values() else 1 / (1 + abs(both["gt"] - both["inf"]))
    return _rounded(linear._row(spark, gt=both["gt"], inf=both["inf"], score=score))


_AXIS = "r1 + r3 - (r1 - r4)", "r2 + r4 - (r2 - r3)"


@query(f"""SELECT side, seq AS "sequenceId", t AS "itemPosition", round(r1, 6) AS x, round(r2, 6) AS y, round(coalesce(sqrt(dx * dx + dy * dy), 0), 6) AS speed,
  round(({_AXIS[0]}) / (sqrt(({_AXIS[0]}) ** 2 + ({_AXIS[1]}) ** 2) + 1e-8), 6) AS heading_cos, round(({_AXIS[1]}) / (sqrt(({_AXIS[0]}) ** 2 + ({_AXIS[1]}) ** 2) + 1e-8), 6) AS heading_sin FROM moves""")
def behaviour_features(spark, sf_dir):
    return _rounded(movement.behaviour_features(_posed(spark, sf_dir)))


@query(f"""SELECT side, seq AS "sequenceId", t AS "itemPosition", round(coalesce(dx, lead(dx) OVER w, 0), 6) AS dx, round(coalesce(dy, lead(dy) OVER w, 0), 6) AS dy, round({_AXIS[0]}, 6) AS axis_x, round({_AXIS[1]}, 6) AS axis_y,
  round(sqrt((r1 + r4 - r1) ** 2 + (r2 - (r2 + r3)) ** 2), 6) AS ear_span FROM moves WINDOW w AS (PARTITION BY side, seq ORDER BY t)""")
def movement_features(spark, sf_dir):
    return _rounded(movement.movement_features(_posed(spark, sf_dir)))


@query("""SELECT label, seq AS "sequenceId", n // 5 AS chunks, (n // 5) * 25 AS "values" FROM (SELECT seq, count(*) AS n FROM paired GROUP BY seq), (SELECT unnest(['gt', 'inf', 'gt_shuffled']) AS label) WHERE n >= 5""")
def movement_chunks(spark, sf_dir):
    found = movement.chunks(_posed(spark, sf_dir))
    return found.groupBy("label", SEQ).agg(F.count("*").alias("chunks"), F.sum(F.size("values")).alias("values"))


@query()
def manifold_alignment(spark, sf_dir):
    return _rounded(movement.alignment(_posed(spark, sf_dir)))


@query()
def chunk_embedding(spark, sf_dir):
    return _rounded(movement.embedded_chunks(_posed(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.abs("e0")).alias("e0"), F.avg(F.abs("e1")).alias("e1")))


@query()
def trajectory(spark, sf_dir):
    return _rounded(latent.trajectory_score(frames.paired(spark, sf_dir), R))


@query()
def occupancy_velocity(spark, sf_dir):
    return _rounded(latent.occupancy_velocity(frames.paired(spark, sf_dir), R))


@query()
def latent_path_features(spark, sf_dir):
    return _rounded(latent.latent_path_features(frames.paired(spark, sf_dir), R))


@query()
def manifold(spark, sf_dir):
    return _rounded(latent.manifold_score(frames.paired(spark, sf_dir), R))


@query()
def precision_scores(spark, sf_dir):
    return _rounded(structure.structural_scores(frames.paired(spark, sf_dir), R))


@query()
def reconstruction_transfer(spark, sf_dir):
    return _rounded(structure.reconstruction_transfer(frames.paired(spark, sf_dir), R))


@query(_CENTRED + ", m AS (SELECT region, lag, avg(gt) AS g, avg(inf) AS i FROM u GROUP BY ALL), s AS (SELECT 1 / (1 + sqrt(avg((i - g) ** 2 / lag)) / (sqrt(avg(g * g / lag)) + 0.05)) AS s FROM m GROUP BY region) SELECT round(avg(s) ** 2, 6) AS score FROM s")
def autocorrelation_score(spark, sf_dir):
    return _rounded(structure.autocorrelation_score(frames.paired(spark, sf_dir), R))


_AGREE = "(corr(g, i) + 1) / 4 + 0.5 / (1 + avg(abs(i - g)) / (greatest(0.05, CASE WHEN quantile_cont(g, 0.75) - quantile_cont(g, 0.25) < 0.05 THEN stddev_pop(g) ELSE quantile_cont(g, 0.75) - quantile_cont(g, 0.25) END) + 1e-8))"


@query(_LAGGED + ", e AS (" + _CORR.removeprefix("+ c AS (").removesuffix(")") + f") SELECT round((x + y) / 2, 6) AS score FROM (SELECT {_AGREE} AS x FROM e), (SELECT {_AGREE} AS y FROM c)")
def lagged_agreement(spark, sf_dir):
    return _rounded(structure.lagged_agreement(frames.paired(spark, sf_dir), R))


@query("+ z AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY t) AS k, r1_gt - avg(r1_gt) OVER w AS ag, r1_inf - avg(r1_inf) OVER w AS ai, r2_gt - avg(r2_gt) OVER w AS bg, r2_inf - avg(r2_inf) OVER w AS bi FROM paired WINDOW w AS (PARTITION BY seq)), n AS (SELECT seq, sqrt(sum(ag * ag) * sum(bg * bg)) AS g, sqrt(sum(ai * ai) * sum(bi * bi)) AS i FROM z GROUP BY seq), y AS (SELECT x.seq, x.k - y.k AS lag, sum(x.ag * y.bg) / any_value(n.g) AS g, sum(x.ai * y.bi) / any_value(n.i) AS i FROM z x JOIN z y ON x.seq = y.seq AND abs(x.k - y.k) <= 16 JOIN n ON n.seq = x.seq GROUP BY x.seq, x.k - y.k) SELECT 'r1' AS a, 'r2' AS b, lag::INT AS lag, round(avg(g), 6) AS gt, round(avg(i), 6) AS inf FROM y GROUP BY lag")
def cross_correlations(spark, sf_dir):
    return _rounded(structure.cross_correlations(frames.paired(spark, sf_dir), [("r1", "r2")], 16))


@query()
def cross_correlation_score(spark, sf_dir):
    return _rounded(structure.cross_correlation_score(frames.paired(spark, sf_dir), R))


@query()
def sliding_states(spark, sf_dir):
    return _rounded(structure.sliding_states(frames.paired(spark, sf_dir), R))


@query("SELECT p.seq AS \"sequenceId\", p.t AS \"itemPosition\", " + ", ".join(f"round(({v}_{s} - m_{v}) / s_{v}, 6) AS {v}_{s}" for s in ("gt", "inf") for v in R) + " FROM paired p, (SELECT " + ", ".join(f"avg({v}_gt) AS m_{v}, stddev_pop({v}_gt) AS s_{v}" for v in R) + " FROM paired)")
def standardised(spark, sf_dir):
    """Every row in units of the ground truth."""
    return _rounded(structure.standardised(frames.paired(spark, sf_dir), R))


_QS = [0.001, 0.1, 0.25, 0.5, 0.9, 0.999]


@query(f"+ q AS (SELECT region, unnest(range({len(_QS)}))::INT AS k, unnest(quantile_cont(g, {_QS})) AS v FROM cells GROUP BY region) SELECT region, k, round(v, 6) AS v FROM q")
def exact_quantiles(spark, sf_dir):
    found = quantiles(align.long_form(frames.paired(spark, sf_dir), R), "gt", ["region"], _QS, bins=64, few=500)
    return _rounded(found.select("region", F.posexplode("q").alias("k", "v")))


def _corrupted(name: str, level: float = 0.4) -> Query:
    def run(spark, sf_dir):
        out = structure.CORRUPTIONS[name](frames.ground_truth(spark, sf_dir), R, level, 0)
        return _rounded(out)

    run.__name__ = f"corruption_{name}"
    return run


_PERMUTED = [R[i] for i in np.random.default_rng(0).permutation(len(R))]
_GAINS = [float(g) for g in np.random.default_rng(0).lognormal(0.0, 0.55, len(R))]
query('SELECT seq AS "sequenceId", t AS "itemPosition", ' + ", ".join(f"round(0.6 * {a} + 0.4 * {b}, 6) AS {a}" for a, b in zip(R, _PERMUTED, strict=True)) + " FROM gt")(_corrupted("region_permute_blend"))
query('SELECT seq AS "sequenceId", t AS "itemPosition", ' + ", ".join(f"round({a} * ({0.6 + 0.4 * g!r})::DOUBLE, 6) AS {a}" for a, g in zip(R, _GAINS, strict=True)) + " FROM gt")(_corrupted("gain_scaling_blend"))
for _name in ("time_shuffle_blend", "region_shift_desync", "gaussian_noise"):
    query()(_corrupted(_name))


@query()
def corruption_sweep(spark, sf_dir):
    return _rounded(structure.sweep(frames.ground_truth(spark, sf_dir), R, neuro.moments, structure.permute_regions, "region_permute_blend"))


@query("+ v AS (SELECT region, 'gt' AS side, g AS v FROM cells UNION ALL SELECT region, 'inf', i FROM cells), e AS (SELECT region, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM v GROUP BY region), b AS (SELECT region, side, least(floor((v - lo) / (hi - lo) * 59), 58)::INT AS bin, lo, hi, count(*) AS n FROM v JOIN e USING (region) WHERE v BETWEEN lo AND hi GROUP BY ALL) SELECT region, side, bin, round(lo + bin * (hi - lo) / 59, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 59, 6) AS high, n FROM b")
def report_region_histograms(spark, sf_dir):
    return _rounded(reports.region_histograms(frames.paired(spark, sf_dir), R))


@query("+ v AS (SELECT side, sqrt(dx * dx + dy * dy) AS v FROM moves WHERE dx IS NOT NULL), e AS (SELECT min(v) AS lo, quantile_cont(v, 0.99) AS hi FROM v), b AS (SELECT side, least(floor((v - lo) / (hi - lo) * 50), 49)::INT AS bin, lo, hi, count(*) AS n FROM v, e WHERE v BETWEEN lo AND hi GROUP BY ALL) SELECT side, bin, round(lo + bin * (hi - lo) / 50, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS high, n FROM b")
def report_speed_histogram(spark, sf_dir):
    return _rounded(reports.speed_histogram(_posed(spark, sf_dir)))


@query("SELECT 'gt' AS side, count(*) AS rows, count(DISTINCT seq) AS sequences FROM gt UNION ALL SELECT 'inf', count(*), count(DISTINCT seq) FROM pred")
def report_load_stats(spark, sf_dir):
    gt = frames.ground_truth(spark, sf_dir)
    return reports.load_stats(gt, frames.predictions(gt))


@query(f"""SELECT pair, round(avg(d) FILTER (side = 'gt'), 6) AS gt, round(avg(d) FILTER (side = 'inf'), 6) AS inf FROM (
  SELECT side, 'NOSE-TAIL_BASE' AS pair, sqrt(({_AXIS[0]}) ** 2 + ({_AXIS[1]}) ** 2) AS d FROM tracks UNION ALL SELECT side, 'NOSE-CENTER', sqrt(r3 ** 2 + r4 ** 2) FROM tracks) GROUP BY pair""")
def report_limb_distances(spark, sf_dir):
    return _rounded(reports.limb_distances(_posed(spark, sf_dir), [("NOSE", "TAIL_BASE"), ("NOSE", "CENTER")]))


@query()
def report_embedding(spark, sf_dir):
    return _rounded(reports.embedding(frames.paired(spark, sf_dir), R))


@query("+ o AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT seq FROM paired)) SELECT seq AS \"sequenceId\", t AS \"itemPosition\", region, round(g, 9) AS gt, round(i, 9) AS inf FROM cells JOIN o USING (seq) WHERE k IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)")
def report_traces(spark, sf_dir):
    """Values have up to seven decimals, so they are rounded beyond those."""
    rows = reports.traces(frames.paired(spark, sf_dir), R)
    return rows.select(SEQ, TIME, "region", *[(F.round(s, 9) + 0.0).alias(s) for s in ("gt", "inf")])


def _matrix(spark: SparkSession, cells: dict[tuple[str, ...], float], names: list[str]) -> DataFrame:
    schema = ", ".join(f"{n} string" for n in names) + ", value double"
    return spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], schema)


@query("SELECT a, b, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}_gt, {b}_gt) AS value FROM paired" for a in R for b in R) + ")")
def covariance_moments(spark, sf_dir):
    """Second moments behind the canonical, linear and subspace scores."""
    names = [f"{v}_gt" for v in R]
    n, _, _, products = linear.moments(frames.paired(spark, sf_dir), names, names)
    return _rounded(_matrix(spark, {(a, b): products[i, j] / n for i, a in enumerate(R) for j, b in enumerate(R)}, ["a", "b"]))


_POOLED = "+ q AS (SELECT " + ", ".join(f"quantile_cont({v}_gt, 0.5) AS m_{v}, quantile_cont({v}_gt, 0.75) - quantile_cont({v}_gt, 0.25) AS s_{v}" for v in R) + " FROM paired), z AS (SELECT seq, t, " + ", ".join(f"({v}_gt - m_{v}) / s_{v} AS {v}" for v in R) + " FROM paired, q), "


@query(_POOLED + ", ".join(f"l{k} AS (SELECT *, " + ", ".join(f"lead({v}, {k}) OVER o AS {v}_l" for v in R) + " FROM z WINDOW o AS (ORDER BY seq, t))" for k in (1, 2, 4)) + " SELECT lag, a, b, round(value, 5) AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS lag, '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}_l) AS value FROM l{k} WHERE {b}_l IS NOT NULL" for k in (1, 2, 4) for a in R for b in R) + ")")
def lagged_moments(spark, sf_dir):
    """Cross covariances at lags 1, 2 and 4 across the borders of sequences, as
    the lagged covariance and the autoregression use them."""
    cells = {}
    for (_, lag), (n, _, _, products) in linear.lagged(frames.paired(spark, sf_dir), R, (1, 2, 4), ("gt",)).items():
        cells |= {(str(lag), a, b): products[i, j] / (n - 1) for i, a in enumerate(R) for j, b in enumerate(R)}
    out = _matrix(spark, cells, ["lag", "a", "b"])
    return out.withColumn("value", F.round("value", 5) + 0.0)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
