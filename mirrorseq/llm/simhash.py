"""SimHash near duplicates with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components
from .paragraphs import SIMILAR
from .similar import links, shared_bands, shingle_array, sketch

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Buckets up to this size are compared pair by pair, larger ones by bit.
PAIRWISE = 64
#: Radius of the SimHashes of five-word sets: 63 masks, each of which keeps 32
#: or 33 bits.
WIDE = 5


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text as a signed integer.

    A-Z in lower case, words between ASCII white space, XXH64 of the shingles
    with repeats (one of all words if they are fewer); a bit is set if it is in
    over half the hashes.  A text without words has fingerprint 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    grams = [b" ".join(x) for x in zip(*(found[i:] for i in range(shingle)), strict=False)] or [b" ".join(found)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        block = grams[at : at + 65536]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in block), np.uint64, len(block))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _simhashes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return _simhashes(text)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 bit masks that cover the radius.

    Each bit position gets a nonzero vector of radius + 1 bits, and the mask of
    a nonzero vector v keeps the positions whose vectors have odd parity with
    v.  The vectors of ``radius`` positions don't span the space, so some v is
    orthogonal to all of them: its mask drops every position in which a pair
    within the radius differs, and the pair collides there.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(prints: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect all distinct 64-bit values within the radius.

    prints: one column ``fp`` of distinct values.  In buckets of up to
    ``pairwise`` values every pair is compared.  In larger buckets no pairs are
    made: each value is keyed by itself with every set of ``radius`` of the
    dropped bits cleared.  Values that share such a key differ in those bits
    only, so a key has at most 2 ** radius values, all within the radius, and
    they are linked to its least; every pair within the radius that the bucket
    holds shares a key.  Both ways are exact, and rows grow with the number of
    values, not of pairs.
    """
    tables = masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tables])).alias("t", "key"))
    sized = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keyed.join(sized, ["t", "key"]))

    few = members.filter(F.col("n") <= pairwise)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = left.join(right, ["t", "key"]).filter(close).select("a", "b")

    dropped = [[i for i in range(64) if not m >> i & 1] for m in tables]
    clears = F.array(*[F.array(*[F.lit(_signed(sum(1 << i for i in c))) for c in combinations(d, radius)]) for d in dropped])
    many = members.filter(F.col("n") > pairwise).select("fp", F.explode(F.get(clears, F.col("t"))).alias("clear"))
    rest = F.col("fp").bitwiseAND(F.bitwise_not("clear")).alias("rest")
    groups = many.groupBy(rest, "clear").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def close_pairs(prints: DataFrame, radius: int = WIDE, pairwise: int = 8) -> DataFrame:
    """Pairs (a, b) of distinct 64-bit values within the radius.

    prints: one column ``fp`` of distinct values.  Buckets of up to ``pairwise``
    values give all their pairs, each in the first mask that holds it.  At a
    wide radius the bits of larger buckets can't be cleared set by set as in
    :func:`near_pairs`; their values meet the bucket's least one alone, so the
    caller needs another way to the other pairs.
    """
    tables = F.array(*[F.lit(_signed(m)) for m in masks(radius)])
    key = F.xxhash64("t", "m").alias("key")
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])).alias("t", "m")).select("fp", key)
    sized = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    two = sized.filter("n = 2").select("a", "b")
    members = stored(keyed.join(sized.filter("n > 2").select("key", "n", F.col("a").alias("least")), "key"))
    stars = members.filter((F.col("n") > pairwise) & (F.col("fp") != F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    groups = members.filter(F.col("n") <= pairwise).groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    pairs = groups.select("key", F.posexplode("fps").alias("at", "a"), "fps").select("key", "a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    table = F.array_position(F.transform(tables, lambda m: differ.bitwiseAND(m) == 0), True) - 1
    mask = F.get(tables, table.cast("int"))
    once = pairs.filter(F.bit_count(differ) <= radius).filter(F.xxhash64(table.cast("int"), F.col("a").bitwiseAND(mask)) == F.col("key")).select("a", "b")
    return two.unionByName(stars).filter(F.bit_count(differ) <= radius).unionByName(once).distinct()


def candidates(prints: DataFrame, radius: int = WIDE) -> DataFrame:
    """Pairs (a, b) of the sets (h, fp) whose SimHashes are within the radius;
    sets of one SimHash meet its least set, which stands for them."""
    of_print = stored(prints.groupBy("fp").agg(F.min("h").alias("least"), F.count("*").alias("n")))
    pairs = close_pairs(of_print.select("fp"), radius)
    left, right = (of_print.select(F.col("fp").alias(x), F.col("least").alias(f"h{x}")) for x in "ab")
    between = pairs.join(left, "a").join(right, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    inside = prints.join(of_print.filter("n > 1").select("fp", "least"), "fp").filter("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    return between.unionByName(inside)


def near_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component_id, *carry) for each row of ``df``.

    component_id is the least id that can be reached over fingerprints at most
    ``radius`` bits apart.  Rows with equal fingerprints, such as copies, count
    once in the search.

    Defined results: null and wordless texts have fingerprint 0 and are linked
    like others; a null id is never a component's id unless all its ids are
    null; repeated rows stay; an empty table stays empty.
    """
    slim = stored(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text)).alias("fp"), *carry))
    prints = stored(slim.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(near_pairs(prints.select("fp"), radius))
    roots = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = roots.join(ids, "root").select("fp", "component_id")
    return slim.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id", *carry)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row
    with the least id stays, nulls last, then the least hash of the row.

    Two texts are near duplicates if the sets of their shingles of five words
    have Jaccard similarity 0.8.  Sets whose SimHashes differ in at most 5 bits
    meet over covering masks and are verified by their exact similarity.  Pairs
    at 0.8 lie up to 11 bits and more apart, which masks can't cover; so what
    SimHash leaves in different components is also verified where it shares one
    of 20 bands of four MinHashes.  Components of all links are groups.  Texts
    with equal sets count once, texts without words are equal to each other,
    and of rows that are repeated in full one stays.  Texts move once for the
    verified pairs and once to meet the chosen rows, whose place in ``df`` is
    kept by a hash of the row.
    """
    hashed = df.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    slim = stored(hashed.select(F.col(f"`{id_col}`").alias("id"), "__row", sketch(F.col(text)).alias("s")).select("id", "__row", "s.*"))
    distinct = slim.groupBy("h").agg(F.min("__row").alias("__row"))
    close = stored(candidates(slim.filter("h <> 0").select("h", "fp").distinct()))
    bands = slim.join(distinct, ["h", "__row"]).dropDuplicates(["h"]).select("h", F.explode("bands").alias("key"))
    members = stored(shared_bands(bands))
    met = members.select("h").unionByName(close.select(F.col("a").alias("h"))).unionByName(close.select(F.col("b").alias("h"))).distinct()
    wanted = distinct.join(met, "h", "left_semi")
    sets = stored(hashed.select("__row", text).join(wanted, "__row").dropDuplicates(["h"]).select("h", shingle_array(F.col(text)).alias("grams")))
    roots = components(links(members, sets, similar, first=close)).withColumnRenamed("node", "h")

    rows = slim.groupBy("h", "id", "__row").agg(F.count("*").alias("n"))
    of_set = rows.groupBy("h").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "__row", "n")).alias("m"))
    of_root = of_set.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("m").alias("m"))
    stay = stored(of_root.select("m.id", "m.__row", "m.n"))
    mine = stay.select(F.col("id").alias("__id"), F.col("__row").alias("__stay"))
    kept = hashed.join(mine, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__stay")), "left_semi")
    if not stay.filter("n > 1").isEmpty():  # only rows repeated in full need another pass
        kept = kept.dropDuplicates([id_col, "__row"])
    return kept.drop("__row")
