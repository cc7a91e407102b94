"""Scores of paired region traces, from the long form (one row a cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import quantiles
from ..functions.stats import bin_of, corrected_kurtosis, corrected_skewness, correlation, correlation01, from_distance, rmse_similarity, symmetric_kl
from ..plans.align import SEQ, TIME, long_form

_EPS = 1e-12
#: The tail quantiles compared by the quantile score.
TAILS = [k / 100 for k in range(1, 11)] + [k / 100 for k in range(90, 100)]


def scales(cells: DataFrame, least: int = 10) -> DataFrame:
    """Robust scale of each region's pooled ground truth: the interquartile
    range, else the deviation, else 1."""
    q = quantiles(cells, "gt", ["region"], [0.25, 0.75])
    spread = cells.groupBy("region").agg(F.count("gt").alias("n"), F.stddev_pop("gt").alias("sd"))
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    usable = F.when((F.col("n") >= least) & (iqr > 0), iqr).otherwise(F.col("sd"))
    return spread.join(q, "region", "left").select("region", F.when(usable > 0, usable).otherwise(1.0).alias("scale"))


def _top_mean(cells: DataFrame, value: str, share: float) -> DataFrame:
    """Mean of the largest ceil(share * n) values of each sequence."""
    by = Window.partitionBy(SEQ)
    ranked = cells.filter(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(by.orderBy(F.desc(value)))).withColumn("__n", F.count("*").over(by))
    return ranked.filter(F.col("__k") <= F.ceil(F.lit(share) * F.col("__n"))).groupBy(SEQ).agg(F.avg(value).alias("d"))


def _score(per_sequence: DataFrame) -> DataFrame:
    return per_sequence.agg(from_distance(F.avg("d")).alias("score"))


def kl(paired: DataFrame, values: list[str], bins: int = 60, least: int = 10) -> DataFrame:
    """Histogram divergence of each sequence and region over the middle 99.8 %
    of the pooled values, with a bin for either tail."""
    cells = long_form(paired, values)
    both = cells.select(SEQ, "region", F.explode(F.array(F.struct(F.lit("gt").alias("side"), F.col("gt").alias("v")), F.struct(F.lit("inf").alias("side"), F.col("inf").alias("v")))).alias("s")).select(SEQ, "region", "s.*").filter("v is not null")
    q = F.percentile("v", F.array(F.lit(0.001), F.lit(0.999)))
    flat = F.get(q, F.lit(0)) >= F.get(q, F.lit(1))
    low, high = F.when(flat, F.min("v")).otherwise(F.get(q, F.lit(0))), F.when(flat, F.max("v")).otherwise(F.get(q, F.lit(1)))
    edges = both.groupBy(SEQ, "region").agg(low.alias("lo"), F.when(low >= high, low + 1e-6).otherwise(high).alias("hi"), *[F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("gt", "inf")]).filter((F.col("n_gt") >= least) & (F.col("n_inf") >= least))
    v = F.col("v")
    where = F.when(v < F.col("lo"), -1).when(v > F.col("hi"), bins).otherwise(bin_of(v, F.col("lo"), F.col("hi"), bins)).alias("bin")
    counts = both.join(edges, [SEQ, "region"]).groupBy(SEQ, "region", where).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("gt", "inf")], F.max("n_gt").alias("n_gt"), F.max("n_inf").alias("n_inf"))
    share = lambda s: (F.col(s) + _EPS) / (F.col(f"n_{s}") + (bins + 2) * _EPS)
    each = counts.groupBy(SEQ, "region").agg(symmetric_kl(share("gt"), share("inf")).alias("kl"))
    per = each.groupBy(SEQ).agg(F.exp(F.avg(F.log(F.greatest(F.lit(_EPS), F.least(F.lit(1.0), 1.0 / (1.0 + F.col("kl"))))))).alias("s"))
    return per.agg((0.5 * (F.avg("s") + F.percentile("s", 0.1))).alias("score"))


def mean_shift(paired: DataFrame, values: list[str]) -> DataFrame:
    cells = long_form(paired, values)
    shift = cells.groupBy(SEQ, "region").agg(F.abs(F.avg("gt") - F.avg("inf")).alias("d")).join(scales(cells), "region")
    return _score(_top_mean(shift.withColumn("d", F.col("d") / (F.col("scale") + _EPS)), "d", 0.1))


def quantile_shift(paired: DataFrame, values: list[str], least: int = 80) -> DataFrame:
    """Distance of the tail quantiles, in robust scales.  All rows count."""
    cells = long_form(paired, values)
    q = F.array(*[F.lit(x) for x in TAILS])
    each = cells.groupBy(SEQ, "region").agg(F.percentile("gt", q).alias("qg"), F.percentile("inf", q).alias("qi"), F.count("gt").alias("ng"), F.count("inf").alias("ni")).filter((F.col("ng") >= least) & (F.col("ni") >= least))
    mean = F.aggregate(F.zip_with("qg", "qi", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / len(TAILS)
    shift = each.withColumn("d", mean).join(scales(cells), "region").withColumn("d", F.col("d") / (F.col("scale") + _EPS))
    return _score(_top_mean(shift, "d", 0.25))


def moments(paired: DataFrame, values: list[str], least: int = 24) -> DataFrame:
    cells = long_form(paired, values).filter("gt is not null and inf is not null")
    each = cells.groupBy("region").agg(F.count("*").alias("n"), *[f(F.col(s)).alias(f"{m}_{s}") for s in ("gt", "inf") for m, f in (("var", F.var_pop), ("skew", corrected_skewness), ("kurt", corrected_kurtosis))]).filter(F.col("n") >= least)
    gap = lambda m: F.abs(F.col(f"{m}_inf") - F.col(f"{m}_gt"))
    d = F.abs(F.log((F.col("var_inf") + 1e-8) / (F.col("var_gt") + 1e-8))) + 0.5 * gap("skew") + 0.25 * gap("kurt")
    return each.agg(F.avg(from_distance(d)).alias("score"))


def error(paired: DataFrame, values: list[str], least: int = 50) -> DataFrame:
    cells = long_form(paired, values)
    d = F.col("inf") - F.col("gt")
    rmse = cells.filter("gt is not null and inf is not null").groupBy(SEQ, "region").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n")).filter(F.col("n") >= least)
    shift = rmse.join(scales(cells), "region").withColumn("d", F.col("rmse") / (F.col("scale") + _EPS))
    return _score(_top_mean(shift, "d", 0.25))


def correlations(paired: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, gt, inf) for each pair of regions a < b, over rows complete on
    both sides; one aggregate of all pairs."""
    whole = paired.dropna(subset=[f"{v}_{s}" for v in values for s in ("gt", "inf")])
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[correlation(F.col(f"{a}_{s}"), F.col(f"{b}_{s}")).alias(s) for s in ("gt", "inf")]) for a, b in pairs]
    return whole.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def lagged_correlations(paired: DataFrame, values: list[str], lag: int = 1) -> DataFrame:
    """(a, b, gt, inf): a now against b ``lag`` rows later in its sequence."""
    by = Window.partitionBy(SEQ).orderBy(TIME)
    later = paired.select("*", *[F.lead(f"{v}_{s}", lag).over(by).alias(f"{v}_{s}_later") for v in values for s in ("gt", "inf")])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[correlation(F.col(f"{a}_{s}"), F.col(f"{b}_{s}_later")).alias(s) for s in ("gt", "inf")]) for a in values for b in values]
    return later.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def graph(paired: DataFrame, values: list[str], share: float = 0.15) -> DataFrame:
    """Agreement of the correlation graphs: strongest edges, degrees, clustering.

    The table of edges has R(R-1)/2 rows and depends on the regions alone.
    """
    edges = correlations(paired, values)
    n_edges = len(values) * (len(values) - 1) // 2
    k = min(n_edges, max(3, -int(-share * n_edges // 1)))
    top = lambda s: F.row_number().over(Window.orderBy(F.abs(s).desc(), F.desc("a"), F.desc("b"))) <= k
    marked = edges.withColumn("in_gt", top(F.col("gt"))).withColumn("in_inf", top(F.col("inf")))
    jaccard = marked.agg((F.sum((F.col("in_gt") & F.col("in_inf")).cast("double")) / F.sum((F.col("in_gt") | F.col("in_inf")).cast("double"))).alias("jaccard"))
    ends = marked.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"), "gt", "inf", "in_gt", "in_inf").select("e.*", "gt", "inf", "in_gt", "in_inf")
    degrees = ends.groupBy("node").agg((1.0 + F.sum(F.abs("gt"))).alias("g"), (1.0 + F.sum(F.abs("inf"))).alias("i")).agg(from_distance(F.avg(F.abs(F.col("i") - F.col("g"))) / (F.avg("g") + 1e-8)).alias("degree"))
    clustering = None
    for s in ("gt", "inf"):
        linked = ends.filter(f"in_{s}").select("node", "to")
        size = linked.groupBy("node").agg(F.count("*").alias("k"))
        two = linked.alias("x").join(linked.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.to") < F.col("y.to"))).select(F.col("x.node").alias("node"), F.col("x.to").alias("u"), F.col("y.to").alias("v"))
        closed = two.join(linked.select(F.col("node").alias("u"), F.col("to").alias("v")), ["u", "v"]).groupBy("node").agg(F.count("*").alias("t"))
        nodes = ends.select("node").distinct().join(size, "node", "left").join(closed, "node", "left").select("node", F.when(F.col("k") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias(f"c_{s}"))
        clustering = nodes if clustering is None else clustering.join(nodes, "node")
    clustering = clustering.agg((1.0 - F.avg(F.abs(F.col("c_inf") - F.col("c_gt")))).alias("clustering"))
    parts = jaccard.crossJoin(degrees).crossJoin(clustering)
    clip = lambda c: F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col(c))))
    return parts.withColumn("score", F.exp((clip("jaccard") + clip("degree") + clip("clustering")) / 3))


def matrix_similarity(pairs: DataFrame) -> DataFrame:
    """.60 correlation + .40 RMSE similarity of two sets of matrix cells."""
    return pairs.agg((0.60 * correlation01(F.col("gt"), F.col("inf")) + 0.40 * rmse_similarity(F.col("gt"), F.col("inf"))).alias("score"))


def states(df: DataFrame, columns: list[str], centres: list[list[float]], out: str = "state") -> DataFrame:
    """Nearest of the given centres; the first of equally near ones."""
    far = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    names = [f"__d{j}" for j in range(len(far))]
    near = df.withColumns(dict(zip(names, far, strict=True)))
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    state = F.coalesce(*[F.when(F.col(d) == least, F.lit(j)) for j, d in enumerate(names)])
    return near.withColumn(out, state.cast("int")).drop(*names)


def occupancy(assigned: DataFrame, n_states: int) -> DataFrame:
    """(state, gt, inf): shares of every state, those without rows included."""
    counts = assigned.groupBy("state").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("gt", "inf")])
    every = assigned.sparkSession.range(n_states).select(F.col("id").cast("int").alias("state")).join(counts, "state", "left").fillna(0)
    whole = Window.partitionBy()
    return every.select("state", *[(F.col(s) / F.sum(s).over(whole)).alias(s) for s in ("gt", "inf")])


def transitions(assigned: DataFrame, n_states: int, lag: int = 1) -> DataFrame:
    """(state, to, gt, inf): shares of the moves ``lag`` rows apart."""
    to = F.lead("state", lag).over(Window.partitionBy("side", SEQ).orderBy(TIME)).alias("to")
    counts = assigned.select("side", "state", to).filter("to is not null").groupBy("state", "to").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("gt", "inf")])
    n = assigned.sparkSession.range(n_states * n_states).select((F.col("id") / n_states).cast("int").alias("state"), (F.col("id") % n_states).cast("int").alias("to"))
    every = n.join(counts, ["state", "to"], "left").fillna(0)
    whole = Window.partitionBy()
    return every.select("state", "to", *[(F.col(s) / F.sum(s).over(whole)).alias(s) for s in ("gt", "inf")])


def histogram_similarity(shares: DataFrame) -> DataFrame:
    """.40 overlap + .25 correlation + .35 RMSE similarity, over those present."""
    parts = shares.agg(F.sum(F.least("gt", "inf")).alias("o"), correlation01(F.col("gt"), F.col("inf")).alias("c"), rmse_similarity(F.col("gt"), F.col("inf")).alias("r"))
    c = F.col("c")
    return parts.select(F.when(c.isNull(), (0.40 * F.col("o") + 0.35 * F.col("r")) / 0.75).otherwise(0.40 * F.col("o") + 0.25 * c + 0.35 * F.col("r")).alias("score"))


def autocorrelations(paired: DataFrame, values: list[str], most: int = 48) -> DataFrame:
    """(sequenceId, region, lag, gt, inf): of the centred values of each region
    of a sequence, at lags 1 to ``most``; a sequence needs ``most`` + 5 rows."""
    cells = long_form(paired, values)
    whole = Window.partitionBy(SEQ, "region")
    by = whole.orderBy(TIME)
    centred = cells.select(SEQ, TIME, "region", *[(F.col(s) - F.avg(s).over(whole)).alias(s) for s in ("gt", "inf")])
    lags = range(most + 1)
    products = centred.select(SEQ, "region", *[(F.col(s) * F.lead(s, k).over(by)).alias(f"{s}_{k}") for s in ("gt", "inf") for k in lags])
    sums = products.groupBy(SEQ, "region").agg(F.count("*").alias("n"), *[F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in ("gt", "inf") for k in lags]).filter(F.col("n") >= most + 5)
    share = lambda s, k: F.when(F.col(f"{s}_0") >= 1e-8, F.col(f"{s}_{k}") / F.col(f"{s}_0")).alias(s)
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), share("gt", k), share("inf", k)) for k in lags if k])
    return sums.select(SEQ, "region", F.explode(rows).alias("r")).select(SEQ, "region", "r.*")


def sliding_correlations(paired: DataFrame, a: str, b: str, width: int = 45, step: int = 15) -> DataFrame:
    """(sequenceId, start, gt, inf): correlation in full windows of the sequence."""
    found = sliding_pairs(paired, [(a, b)], width, step)
    return found.select(SEQ, "start", F.col("p0_gt").alias("gt"), F.col("p0_inf").alias("inf"))


def sliding_pairs(paired: DataFrame, pairs: list[tuple[str, str]], width: int = 45, step: int = 15) -> DataFrame:
    """(sequenceId, start, p0_gt, p0_inf, p1_gt, ...): correlations of each pair
    of regions in full windows of the sequence, all from one order of the rows."""
    at = (F.row_number().over(Window.partitionBy(SEQ).orderBy(TIME)) - 1).alias("at")
    rows = paired.select(SEQ, at, *[f"{c}_{s}" for c in dict.fromkeys(c for p in pairs for c in p) for s in ("gt", "inf")])
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - width + 1) / step)).cast("long")
    starts = F.transform(F.sequence(first, F.floor(F.col("at") / step)), lambda k: k * step)
    spread = rows.withColumn("start", F.explode(starts))
    found = spread.groupBy(SEQ, "start").agg(*[correlation(F.col(f"{a}_{s}"), F.col(f"{b}_{s}")).alias(f"p{j}_{s}") for j, (a, b) in enumerate(pairs) for s in ("gt", "inf")], F.count("*").alias("n"))
    return found.filter(F.col("n") == width).drop("n")


def spearman01(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, in [0, 1].

    Ranks come from running counts: values are dealt to 1024 bins of their
    range, counted, and ranked inside their bin only.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    ends = rows.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = rows.crossJoin(F.broadcast(ends))
    for c in "xy":
        width = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        rows = rows.withColumn(f"{c}_bin", F.when(width > 0, F.least(F.lit(1023), F.floor(F.try_divide(F.col(c) - F.col(f"{c}_lo"), width) * 1024))).otherwise(0))
    for c in "xy":
        sizes = rows.groupBy(f"{c}_bin").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.orderBy(f"{c}_bin")) - F.col("__n")  # at most 1024 rows
        rows = rows.join(F.broadcast(sizes.select(f"{c}_bin", before.alias(f"{c}_before"))), f"{c}_bin")
        inside = Window.partitionBy(f"{c}_bin")
        rank = F.rank().over(inside.orderBy(c)) + (F.count("*").over(Window.partitionBy(f"{c}_bin", c)) - 1) / 2.0
        rows = rows.withColumn(f"{c}_rank", F.col(f"{c}_before") + rank)
    return rows.agg(correlation01(F.col("x_rank"), F.col("y_rank")).alias("score"))
