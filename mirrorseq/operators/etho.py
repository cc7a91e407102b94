"""Behaviour scores of paired body-part tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import quantiles
from ..functions.stats import bin_of, correlation, from_distance, norm, symmetric_kl
from ..plans.align import SEQ, TIME, sides

_TINY = 1e-12


def _track():
    return Window.partitionBy("side", SEQ).orderBy(TIME)


def _step(c: str, order: int = 1) -> Column:
    one = F.col(c) - F.lag(c, 1).over(_track())
    return one if order == 1 else one - (F.lag(c, 1).over(_track()) - F.lag(c, 2).over(_track()))


def steps(paired: DataFrame, center: str = "CENTER", order: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """(side, sequenceId, itemPosition, dx, dy, size, *extra) of each step of
    the track; rows before the first full step are left out."""
    x, y = f"{center}_X", f"{center}_Y"
    rows = sides(paired, [x, y, *extra])
    moved = rows.select("side", SEQ, TIME, _step(x, order).alias("dx"), _step(y, order).alias("dy"), *extra)
    return moved.withColumn("size", norm(F.col("dx"), F.col("dy"))).filter("size is not null")


def both_steps(paired: DataFrame, center: str = "CENTER") -> DataFrame:
    """(side, sequenceId, itemPosition, speed, acceleration) of every row, null
    where there are too few rows before; both from one order of the rows."""
    x, y = f"{center}_X", f"{center}_Y"
    size = lambda order: norm(_step(x, order), _step(y, order))
    return sides(paired, [x, y]).select("side", SEQ, TIME, size(1).alias("speed"), size(2).alias("acceleration"))


def _likeness(counts: DataFrame, by: list[str], bins: list[str], n_bins: int) -> DataFrame:
    """Score of counted bins: symmetric divergence of both sides' densities,
    each raised by 1e-12 and scaled to sum to 1.  ``width`` is a bin's size.
    Bins that neither side has add nothing but their part of the sum."""
    wide = counts.groupBy(*by, *bins).agg(F.sum(F.when(F.col("side") == "gt", F.col("n"))).alias("g"), F.sum(F.when(F.col("side") == "inf", F.col("n"))).alias("i"), F.max("width").alias("width"))
    whole = Window.partitionBy(*by)
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.sum(c).over(whole) + _TINY * F.col("width")
    mass = 1.0 + n_bins * _TINY * F.col("width")
    shares = wide.withColumn("p", share("g") / mass).withColumn("q", share("i") / mass)
    return shares.groupBy(*by).agg(from_distance(symmetric_kl(F.col("p"), F.col("q"))).alias("score"), F.sum("g").alias("weight"))


def _each_and_whole(counts: DataFrame, bins: list[str], n_bins: int) -> DataFrame:
    """Scores of each sequence and, with a null id, of all: the counts of the
    sequences are summed for the whole, so rows are read once."""
    both = F.array(F.col(SEQ), F.lit(None).cast(counts.schema[SEQ].dataType))
    return _likeness(counts.withColumn(SEQ, F.explode(both)), [SEQ], bins, n_bins)


def distribution(paired: DataFrame, order: int = 1, center: str = "CENTER", bins: int = 59) -> DataFrame:
    """Velocity (order 1) or acceleration (order 2) score of each sequence, and
    of all (sequenceId null), over 59 bins of the pooled range."""
    sizes = steps(paired, center, order).select("side", SEQ, "size")
    edges = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.when(F.col("side") == "gt", 1)).alias("ng"), F.count(F.when(F.col("side") == "inf", 1)).alias("ni")).filter("lo < hi and ng >= 10 and ni >= 10")
    binned = sizes.crossJoin(F.broadcast(edges)).withColumn("bin", bin_of(F.col("size"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy("side", SEQ, "bin").agg(F.count("*").alias("n"), F.max((F.col("hi") - F.col("lo")) / bins).alias("width"))
    return _each_and_whole(counts, ["bin"], bins)


def stationary(paired: DataFrame, center: str = "CENTER", percent: float = 10) -> DataFrame:
    """Share of steps at most the ground truth's 10th percentile: its gap."""
    speeds = steps(paired, center).select("side", SEQ, "size")
    limit = quantiles(speeds.filter("side = 'gt'"), "size", [], [percent / 100]).select(F.get("q", F.lit(0)).alias("limit"))
    still = speeds.crossJoin(F.broadcast(limit)).groupBy(SEQ).agg(
        F.avg(F.when(F.col("side") == "gt", (F.col("size") <= F.col("limit")).cast("double"))).alias("g"),
        F.avg(F.when(F.col("side") == "inf", (F.col("size") <= F.col("limit")).cast("double"))).alias("i"), F.count(F.when(F.col("side") == "gt", 1)).alias("weight"),
    )
    gaps = still.withColumn("gap", F.abs(F.col("g") - F.col("i"))).filter("gap is not null")
    return _gap_scores(gaps, 1.0)


def _gap_scores(gaps: DataFrame, width: float) -> DataFrame:
    score = lambda gap: 1.0 - F.least(F.lit(1.0), gap / width)
    each = gaps.select(SEQ, score(F.col("gap")).alias("score"), "weight")
    whole = gaps.agg(score(F.avg("gap")).alias("score"), F.sum("weight").alias("weight")).select(F.lit(None).cast(gaps.schema[SEQ].dataType).alias(SEQ), "score", "weight")
    return each.unionByName(whole)


def direction(paired: DataFrame, center: str = "CENTER", axis: tuple[str, str] = ("NOSE", "TAIL_BASE")) -> DataFrame:
    """Gap of the cosine between each step and the body axis after it."""
    extra = tuple(f"{p}_{a}" for p in axis for a in "XY")
    ax, ay = F.col(extra[0]) - F.col(extra[2]), F.col(extra[1]) - F.col(extra[3])
    cosine = (F.col("dx") * ax + F.col("dy") * ay) / ((F.col("size") + 1e-8) * (norm(ax, ay) + 1e-8))
    rows = steps(paired, center, 1, extra).select("side", SEQ, TIME, cosine.alias("c"))
    wide = rows.groupBy(SEQ, TIME).agg(F.max(F.when(F.col("side") == "gt", F.col("c"))).alias("g"), F.max(F.when(F.col("side") == "inf", F.col("c"))).alias("i"))
    gaps = wide.groupBy(SEQ).agg(F.avg(F.abs(F.col("g") - F.col("i"))).alias("gap"), F.count("g").alias("weight")).filter("gap is not null")
    return _gap_scores(gaps, 2.0)


def _centres(paired: DataFrame, center: str) -> DataFrame:
    return sides(paired, [f"{center}_X", f"{center}_Y"]).select("side", SEQ, F.col(f"{center}_X").alias("x"), F.col(f"{center}_Y").alias("y")).dropna(subset=["x", "y"])


def quadrant(paired: DataFrame, center: str = "CENTER") -> DataFrame:
    """Shares of the four quadrants around the middle of the pooled bounds."""
    points = _centres(paired, center)
    middle = points.agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"))
    where = (2 * (F.col("x") > F.col("mx")).cast("int") + (F.col("y") > F.col("my")).cast("int")).alias("quadrant")
    counts = points.crossJoin(F.broadcast(middle)).groupBy("side", SEQ, where).agg(F.count("*").alias("n"), F.lit(1.0).alias("width"))
    return _each_and_whole(counts, ["quadrant"], 4)


def position(paired: DataFrame, center: str = "CENTER", bins: int = 60) -> DataFrame:
    """Shares of a 60 x 60 grid over the pooled bounds."""
    points = _centres(paired, center)
    box = points.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    for c in "xy":
        flat = F.col(f"{c}_lo") == F.col(f"{c}_hi")
        box = box.withColumn("__flat", flat).withColumn(f"{c}_lo", F.when(F.col("__flat"), F.col(f"{c}_lo") - 0.5).otherwise(F.col(f"{c}_lo"))).withColumn(f"{c}_hi", F.when(F.col("__flat"), F.col(f"{c}_hi") + 0.5).otherwise(F.col(f"{c}_hi"))).drop("__flat")
    cell = [bin_of(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).alias(f"b{c}") for c in "xy"]
    area = (F.col("x_hi") - F.col("x_lo")) / bins * ((F.col("y_hi") - F.col("y_lo")) / bins)
    counts = points.crossJoin(F.broadcast(box)).groupBy("side", SEQ, *cell).agg(F.count("*").alias("n"), F.max(area).alias("width"))
    return _each_and_whole(counts, ["bx", "by"], bins * bins)


def body_part_errors(paired: DataFrame, parts: list[str]) -> DataFrame:
    """Distance error, mean errors and correlations of each part, in one pass."""
    cells = F.array(*[F.struct(F.lit(p).alias("part"), *[F.col(f"{p}_{a}_{s}").alias(f"{a.lower()}_{s}") for a in "XY" for s in ("gt", "inf")]) for p in parts])
    rows = paired.select(F.explode(cells).alias("c")).select("c.*")
    dx, dy = F.col("x_inf") - F.col("x_gt"), F.col("y_inf") - F.col("y_gt")
    return rows.groupBy("part").agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"), F.avg(F.abs(dx)).alias("mae_x"), F.avg(F.abs(dy)).alias("mae_y"), correlation(F.col("x_gt"), F.col("x_inf")).alias("corr_x"), correlation(F.col("y_gt"), F.col("y_inf")).alias("corr_y"))


def inter_limb_distances(paired: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean and deviation of the distance of each pair of parts on each side."""
    columns = sorted({f"{p}_{a}" for ab in pairs for p in ab for a in "XY"})
    rows = sides(paired, columns)
    cells = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), norm(F.col(f"{a}_X") - F.col(f"{b}_X"), F.col(f"{a}_Y") - F.col(f"{b}_Y")).alias("d")) for a, b in pairs])
    return rows.select("side", F.explode(cells).alias("c")).groupBy("side", "c.pair").agg(F.avg("c.d").alias("mean"), F.stddev_pop("c.d").alias("deviation"))


def path_features(paired: DataFrame, center: str = "CENTER") -> DataFrame:
    """Path length, net displacement, straightness, mean speed and mean turn."""
    x, y = f"{center}_X", f"{center}_Y"
    ends = sides(paired, [x, y]).groupBy("side", SEQ).agg(*[f(c, TIME).alias(f"{n}_{c[-1]}") for c in (x, y) for f, n in ((F.min_by, "first"), (F.max_by, "last"))], F.count("*").alias("rows"))
    moved = steps(paired, center)
    before = lambda c: F.lag(c, 1).over(_track())
    dot = (F.col("dx") * before("dx") + F.col("dy") * before("dy")) / ((F.col("size") + 1e-8) * (before("size") + 1e-8))
    turned = moved.withColumn("turn", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    sums = turned.groupBy("side", SEQ).agg(F.sum("size").alias("path"), F.avg("size").alias("speed"), F.avg("turn").alias("turn"))
    net = norm(F.col("last_X") - F.col("first_X"), F.col("last_Y") - F.col("first_Y"))
    return sums.join(ends.filter("rows >= 3"), ["side", SEQ]).select("side", SEQ, "path", net.alias("net"), (net / (F.col("path") + 1e-8)).alias("straightness"), "speed", "turn")


def across_sequences(scores: DataFrame) -> DataFrame:
    """Weighted mean and deviation of (metric, score, weight) by metric."""
    w, s = F.col("weight").cast("double"), F.col("score")
    means = scores.filter("score is not null").groupBy("metric").agg((F.sum(w * s) / F.sum(w)).alias("mean"), (F.sum(w * s * s) / F.sum(w)).alias("square"), F.count("*").alias("sequences"))
    return means.select("metric", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("deviation"), "sequences")
