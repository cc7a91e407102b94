"""Exact similarity joins of sets of shingles: five words, Jaccard >= 0.8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored
from .components import components
from .paragraphs import _HASHES, _MIX, SHINGLE, SIMILAR, _mixed, _words

#: A pair of similarity 0.8 shares none of the bands with probability
#: (1 - 0.8 ** 4) ** 20 = 0.00003.
BANDS, ROWS = 20, 4
#: Bands up to this size are compared pair by pair.
PAIRWISE = 64
#: Sets that each set of a large band is compared with first.
_HUBS = 3
#: Sets of a gram in one task, and bands whose hubs are broadcast.
BLOCK, _FEW_BANDS = 2000, 50_000
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of five words (one of all words
    if they are fewer, none without words)."""
    found = _words(text)
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, n)
    size = min(SHINGLE, n)
    grams = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        grams += hashed[k : n - size + 1 + k] * _MIX[k]
    return np.unique(_mixed(grams, 0))


def _bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(least, (grams[at : at + 1024, None] * _FACTORS + _SHIFTS).min(0), out=least)
    rows = _mixed(least, 1).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _MIX[4] + rows[:, k], 2)
    return keys.view(np.int64)


def _simhash(grams: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes; a bit is set if it is in over half."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        ones += np.unpackbits(grams[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams)).view(">i8")[0])


@F.pandas_udf(T.StructType([T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Hash of the set of shingles (0 without words), its SimHash and its
    MinHash bands."""
    for texts in parts:
        found = [shingles(t) for t in texts]
        places = [np.arange(len(g), dtype=np.uint64) for g in found]
        h = [int(_mixed(_mixed(g + p * _MIX[3], 1).sum(keepdims=True, dtype=np.uint64), 3).view(np.int64)[0]) if len(g) else 0 for g, p in zip(found, places, strict=True)]
        yield pd.DataFrame({"h": h, "fp": [_simhash(g) for g in found], "bands": [_bands(g) if len(g) else np.zeros(0, np.int64) for g in found]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_array(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets have the Jaccard similarity."""
    left, right = sets.select(F.col("h").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("h").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").filter(both / (F.size("ga") + F.size("gb") - both) >= similar - 1e-12).select("a", "b")


def facts(sets: DataFrame) -> DataFrame:
    """(h, n, bits): number of grams of each set, and 256 bits, of which a gram
    turns one over.

    Two sets that differ in d grams differ in at most d bits (Sandes et al.,
    2020), so pairs whose bits differ in too many places aren't similar, and
    their grams need not meet.
    """
    one = lambda j: F.aggregate("grams", F.lit(0).cast("long"), lambda x, g: F.when(F.shiftright(g, 6).bitwiseAND(F.lit(3)) == j, x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(F.lit(63)).cast("int")))).otherwise(x))
    return sets.select("h", F.size("grams").alias("n"), F.array(*[one(j) for j in range(4)]).alias("bits"))


def _may_be(a: str, b: str, similar: float) -> Column:
    """Whether the sets of the columns n<a>, bits<a> and n<b>, bits<b> can have
    the similarity: neither length nor bits say no."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    differ = sum((F.bit_count(F.get(f"bits{a}", F.lit(j)).bitwiseXOR(F.get(f"bits{b}", F.lit(j)))) for j in range(4)), F.lit(0))
    return (F.least(na, nb) >= similar * F.greatest(na, nb) - 1e-9) & (differ <= (1 - similar) / (1 + similar) * (na + nb) + 1e-9)


def shared_bands(members: DataFrame) -> DataFrame:
    """(key, h, size, hub) of the members (key, h) of bands of two and more."""
    sized = members.groupBy("key").agg(F.count("*").alias("size"), F.min("h").alias("hub")).filter("size > 1")
    return members.join(sized, "key")


def links(members: DataFrame, sets: DataFrame, similar: float = SIMILAR, pairwise: int = PAIRWISE, first: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between sets of at least the similarity, with the same
    components as all such pairs that share a band or are in ``first``.

    members: (key, h, size, hub) of :func:`shared_bands`; sets: (h, grams) with
    the distinct grams of each; first: candidates (a, b) found otherwise, which
    are verified before the bands.  In bands of more than ``pairwise`` sets all are
    verified against a hub, the set that shares bands with most others, as the
    least edited of a group of copies does; those that it isn't similar to have
    a hub of their own, and once more.  What these edges connect, also through
    other bands, is one component already, and pairs inside it add nothing.  In
    smaller bands all other pairs are verified; in the larger ones, where they
    hold several components, all pairs of different components meet by their
    prefixes, be they near a hub or not, see :func:`across`.
    """
    known = stored(facts(sets))
    stars = None if first is None else stored(verified(_possible(first, known, similar), sets, similar))
    roots = None if stars is None else stored(components(stars).select(F.col("node").alias("h"), "root"))
    if roots is None:
        rooted = members.withColumn("root", F.col("h"))
    else:
        rooted = stored(members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")))
    reach = rooted.groupBy("h").agg(F.sum("size").alias("reach"))
    large = stored(rooted.filter(F.col("size") > pairwise).select("key", "h", "root").join(reach, "h"))
    if large.isEmpty():
        pairs = _near_pairs_of(rooted.select("key", "h", "root"), known, sets, similar)
        return pairs if stars is None else stars.unionByName(pairs)
    rest = large
    for _ in range(_HUBS):
        hubs = stored(rest.groupBy("key").agg(F.max_by(F.struct("h", "root"), F.struct("reach", "h")).alias("m")).select("key", F.col("m.h").alias("a"), F.col("m.root").alias("roota")))
        facing = rest.join(F.broadcast(hubs) if hubs.count() <= _FEW_BANDS else hubs, "key")
        tried = facing.filter("roota <> root").select("a", F.col("h").alias("b")).distinct()
        near = stored(verified(_possible(tried, known, similar), sets, similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        stars = near if stars is None else stars.unionByName(near)
        met = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(hubs, "a").select("key", F.col("b").alias("h"))
        rest = stored(rest.join(met.unionByName(facing.filter("roota = root").select("key", "h")).distinct(), ["key", "h"], "left_anti"))
        if rest.isEmpty():
            break
    roots = stored(components(stars).select(F.col("node").alias("h"), "root"))
    rooted = stored(members.join(roots, "h", "left").select("key", "h", "size", F.coalesce("root", "h").alias("root")))
    edges = stars.unionByName(_near_pairs_of(rooted.filter(F.col("size") <= pairwise), known, sets, similar))
    labelled = rooted.filter(F.col("size") > pairwise)
    ends = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    apart = stored(labelled.join(ends.select("key"), "key", "left_semi").select("h", "root").distinct())
    if apart.isEmpty():
        return edges
    return edges.unionByName(stored(verified(across(apart, known, sets, similar), sets, similar)))


def _of(x: str, known: DataFrame) -> DataFrame:
    """The facts of the sets, under the name x."""
    return known.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))


def _possible(pairs: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that neither lengths nor bits turn away."""
    return pairs.join(_of("a", known), "a").join(_of("b", known), "b").filter(_may_be("a", "b", similar)).select("a", "b")


def _near_pairs_of(members: DataFrame, known: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Edges between the members (key, h, root) of a band that have different roots."""
    told = members.join(known, "h")
    left, right = (told.select("key", *[F.col(c).alias(x if c == "h" else f"{c}{x}") for c in ("h", "root", "n", "bits")]) for x in "ab")
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & _may_be("a", "b", similar)).select("a", "b")
    return stored(verified(pairs.distinct(), sets, similar))


def across(parts: DataFrame, known: DataFrame, sets: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (a, b) of the sets (h, root) of different roots; no pair
    of the similarity is missing.

    Of two sets of n grams or more that share 0.8 of them, each has a shared
    gram among its first n - ceil(0.8 n) + 1, in any common order; here the
    rarest come first.  A pair whose first shared gram stands so far back that
    too few grams can follow is no candidate, so copies that differ in grams of
    their own don't meet over what all of them share.  Grams that one root has
    alone are left out before the join, so a group of copies doesn't meet
    itself, pairs whose bits differ in too many places are none (:func:`facts`), and a gram of many sets is dealt to one task for each ``block`` of
    them.  The count of a gram is a window over its rows, which spill: a gram of
    very many sets is one task's narrow rows there.
    """
    each = parts.join(sets, "h").select("h", "root", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    of_gram = Window.partitionBy("gram")
    told = each.select("*", F.count("*").over(of_gram).alias("f"), (F.min("root").over(of_gram) != F.max("root").over(of_gram)).alias("open"))
    ordered = told.groupBy("h", "root", "n").agg(F.sort_array(F.collect_list(F.struct("f", "gram", "open"))).alias("o"))
    length = (F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1).cast("int")
    prefix = ordered.select("h", "root", "n", F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "g")).filter("g.open").select("h", "root", "n", "at", "g.gram", F.ceil(F.col("g.f") / block).cast("int").alias("salts"))
    prefix = stored(prefix.join(known.select("h", "bits"), "h"))
    dealt = prefix.select("gram", F.pmod(F.xxhash64("h"), F.col("salts")).cast("int").alias("salt"), F.col("h").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("bits").alias("bitsx"))
    whole = prefix.select("gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("h").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("bits").alias("bitsy"))
    left_over = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    enough = left_over >= similar / (1 + similar) * (F.col("nx") + F.col("ny")) - 1e-9
    fits = (F.col("rx") < F.col("ry")) & enough & _may_be("x", "y", similar)
    return dealt.join(whole, ["gram", "salt"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
