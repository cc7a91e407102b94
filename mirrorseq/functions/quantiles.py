"""Exact quantiles of any number of rows, without a group in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Kept

BINS, FEW = 4096, 100_000


def quantiles(df: DataFrame, value: str, by: list[str], qs: list[float], out: str = "q", bins: int = BINS, few: int = FEW) -> DataFrame:
    """(*by, out): the quantiles of each group, linear between neighbours.

    Values are counted in ``bins`` equal bins of the group's range; the bins
    that hold a wanted rank are cut again, until none holds more than ``few``
    rows or its values are all equal, and only then are rows ranked, inside
    those bins.  Groups must be few (regions, sides), as their bins are
    broadcast; nulls don't count, and a group without values has no row.  The
    values are read once and stored while they are counted; what is returned is
    a small table that depends on nothing.
    """
    held = []

    def kept(table: DataFrame) -> DataFrame:
        held.append(table.persist())
        return held[-1]

    with Kept(df.sparkSession) as keep:
        # keys and values alone, as a file: encoded, they take a small part of a cache
        rows = keep(df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")).withColumn("__g", F.struct(F.lit(0).alias("_"), *by))
        try:
            return _quantiles(rows, by, qs, out, bins, few, kept)
        finally:
            for table in held:
                table.unpersist()


def column_quantiles(rows: DataFrame, columns: list[str], qs: list[float], bins: int = BINS, few: int = BINS) -> dict[str, list[float]]:
    """The quantiles of each column, linear between neighbours, over its values
    that are neither null nor NaN; a column without any is left out.

    As :func:`quantiles`, for columns side by side: a pass counts the bins of
    all columns, and only ``few`` values of a bin reach the driver.  The rows
    are read once a pass, so they should be stored.
    """
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    rows = rows.select(*[v.alias(f"__{i}") for i, v in enumerate(known.values())])
    facts = rows.agg(*[f(f"__{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # (column, wanted rank) -> rows before its cell, rows in it, its ends
    cells = {}
    for i in range(len(columns)):
        n = facts[f"n{i}"]
        for q in qs if n else ():
            for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}:
                cells[i, rank] = (0, n, facts[f"lo{i}"], facts[f"hi{i}"])
    while still := sorted({(i, *c) for (i, _), c in cells.items() if c[1] > few and c[2] < c[3]}):
        counted = rows.mapInArrow(_counts(still, bins), "cell int, bin int, n long, lo double, hi double")
        found: dict[tuple, list] = {}
        for r in counted.groupBy("cell", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("cell", "bin").collect():
            found.setdefault(still[r["cell"]], []).append(r)
        for (i, rank), c in cells.items():
            before = c[0]
            for r in found.get((i, *c), ()):  # at most ``bins`` rows
                if rank < before + r["n"]:
                    cells[i, rank] = (before, r["n"], r["lo"], r["hi"])
                    break
                before += r["n"]
    values = {(i, c[2], c[3]): np.array([c[2]]) for (i, _), c in cells.items()}
    small = sorted({(i, *c) for (i, _), c in cells.items() if c[2] < c[3]})
    if small:
        got = rows.mapInArrow(_inside(small), "k int, v double").toPandas()
        for k, part in got.groupby("k"):
            i, _, _, lo, hi = small[k]
            values[i, lo, hi] = np.sort(part["v"].to_numpy())
    out = {}
    for i, c in enumerate(columns):
        n = facts[f"n{i}"]
        if n:
            at = lambda rank, i=i: values[i, cells[i, rank][2], cells[i, rank][3]][min(rank - cells[i, rank][0], len(values[i, cells[i, rank][2], cells[i, rank][3]]) - 1)]
            places = [q * (n - 1) for q in qs]
            out[c] = [float(2 * (at(math.floor(p)) / 2 + (at(math.ceil(p)) / 2 - at(math.floor(p)) / 2) * (p - math.floor(p)))) for p in places]
    return out


def _counts(cells: list[tuple], bins: int):
    """(cell, bin, n, lo, hi): values in the equal bins of each of the cells
    (column, rows before, rows, lo, hi), one row a task and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), bins), np.int64)
        least, most = np.full((len(cells), bins), np.inf), np.full((len(cells), bins), -np.inf)
        for batch in batches:
            columns = {i: batch.column(i).to_numpy(zero_copy_only=False) for i in {c[0] for c in cells}}
            for k, (i, _, _, lo, hi) in enumerate(cells):
                v = columns[i]
                v = v[(v >= lo) & (v <= hi)]
                if not len(v):
                    continue
                # halves, as the difference of two numbers may be beyond all numbers
                width = hi / 2 - lo / 2
                at = np.minimum(((v / 2 - lo / 2) / width * bins).astype(np.int64), bins - 1) if width > 0 else (v > lo).astype(np.int64)
                total[k] += np.bincount(at, minlength=bins)
                np.minimum.at(least[k], at, v)
                np.maximum.at(most[k], at, v)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b]), pa.array(least[k, b]), pa.array(most[k, b])], ["cell", "bin", "n", "lo", "hi"])

    return run


def _quantiles(rows: DataFrame, by: list[str], qs: list[float], out: str, bins: int, few: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    whole = rows.groupBy("__g").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("p")) for k, q in enumerate(qs)])).alias("__q")
    ranks = whole.select("*", at).withColumn("__pos", F.col("__q.p") * (F.col("__n") - 1))
    # each quantile lies between the ranks below and above its place
    ranks = kept(ranks.select("__g", F.col("__q.k").alias("__k"), "__pos", F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos")))).alias("__rank"), F.lit(0).cast("long").alias("__before"), "__n", "__lo", "__hi"))
    while (ranks.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__n")))).first()[0] or 0) > few:
        cells = ranks.select("__g", "__lo", "__hi", "__before").distinct()
        inside = rows.join(F.broadcast(cells), "__g").filter("__v between __lo and __hi")
        # halves, as the difference of two numbers may be beyond all numbers
        half = lambda c: F.col(c) / 2
        place = F.least(F.lit(bins - 1), F.floor((half("__v") - half("__lo")) / (half("__hi") - half("__lo")) * bins))
        counts = inside.filter("__lo < __hi").groupBy("__g", "__before", place.alias("__bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        running = F.sum("n").over(Window.partitionBy("__g", "__before").orderBy("__bin"))
        placed = counts.withColumn("to", F.col("__before") + running).withColumn("from", F.col("to") - F.col("n"))
        found = ranks.join(F.broadcast(placed.drop("__bin")), ["__g", "__before"], "left").filter("lo is null or (__rank >= from and __rank < to)")
        ranks = kept(found.select("__g", "__k", "__pos", "__rank", F.coalesce("from", "__before").alias("__before"), F.coalesce("n", "__n").alias("__n"), F.coalesce("lo", "__lo").alias("__lo"), F.coalesce("hi", "__hi").alias("__hi")))
    cells = ranks.select("__g", "__lo", "__hi", "__before").distinct()
    order = F.row_number().over(Window.partitionBy("__g", "__before").orderBy("__v")) - 1 + F.col("__before")
    open_cells = rows.join(F.broadcast(cells.filter("__lo < __hi")), "__g").filter("__v between __lo and __hi")
    ranked = open_cells.select("__g", "__before", order.alias("__rank"), "__v")
    known = ranks.join(ranked, ["__g", "__before", "__rank"], "left").withColumn("__v", F.coalesce("__v", "__lo"))
    each = known.groupBy("__g", "__k").agg(F.max("__pos").alias("p"), F.min_by("__v", "__rank").alias("a"), F.max_by("__v", "__rank").alias("b"))
    value_at: Column = 2 * (F.col("a") / 2 + (F.col("b") / 2 - F.col("a") / 2) * (F.col("p") - F.floor("p")))
    listed = each.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", value_at.alias("v")))), lambda x: x["v"]).alias(out))
    table = listed.select(*[F.col(f"__g.{c}").alias(c) for c in by], out)
    # a row a group, and groups are few
    return rows.sparkSession.createDataFrame(table.collect(), table.schema)


def _inside(cells: list[tuple]):
    """(k, v): the values inside each of the cells (column, rows before, rows,
    lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {i: batch.column(i).to_numpy(zero_copy_only=False) for i in {c[0] for c in cells}}
            found = [columns[i][(columns[i] >= lo) & (columns[i] <= hi)] for i, _, _, lo, hi in cells]
            ks = np.repeat(np.arange(len(cells), dtype=np.int32), [len(v) for v in found])
            if len(ks):
                yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(np.concatenate(found))], ["k", "v"])

    return run
