"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Nodes with more neighbours than this, and more than a part in 10000 of all
#: edges, so at most 20000 nodes, are joined apart.
HOT = 100_000


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int, hot: int) -> DataFrame:
    """``rows`` (u, v) with m, the least node that u sees.

    A node with very many neighbours would be one task of a shuffled join, so
    the few such nodes are broadcast; the others are joined by a shuffle.
    """
    if n_edges <= hot:
        return rows.join(least.select("u", "m"), "u")
    few = least.filter(F.col("degree") > max(hot, n_edges // 10_000)).select("u", F.col("m").alias("hot_m"))
    marked = rows.join(F.broadcast(few), "u", "left")
    apart = marked.filter("hot_m is not null").select("u", "v", F.col("hot_m").alias("m"))
    return apart.unionByName(marked.filter("hot_m is null").select("u", "v").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, most_rounds: int = 50, hot: int = HOT) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    node links its larger neighbours, then its smaller ones, to the least node
    that it sees, until nothing changes.  Rows never exceed the edges, and the
    number of rounds grows with the logarithm of the longest chain.  Minima are
    aggregated before the shuffle, and a node with more than ``hot`` neighbours
    is no key of a shuffled join.  Every round is written to the shared folder,
    which cuts the lineage.

    Self-links and repeated or reversed edges are allowed; no edges give no
    rows.
    """
    graph = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = lambda g: g.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = digest(graph)
    for _ in range(most_rounds):
        n = now[0]
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = _with_least(both.filter("v > u"), least, n, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        moved = _with_least(large, least, n, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        graph = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, digest(graph)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return graph.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
