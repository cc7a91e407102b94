"""SimHash of five-word sets within a wide radius, and the stage that uses it."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mirrorseq.llm import simhash


@pytest.mark.parametrize("pairwise", [64, 4])
def test_close_pairs_against_all_pairs(spark, pairwise):
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for k in (0, 0, 1, 2, 4, 5, 6, 8):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [simhash._signed(v) for v in values]
    found = [tuple(r) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), pairwise=pairwise).collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.WIDE}
    got = {tuple(sorted(p)) for p in found}
    assert got <= want and len(want) > 200
    if pairwise == 64:
        assert got == want and len(found) == len(want)


def test_large_bucket_meets_its_least(spark):
    base = random.Random(4).getrandbits(63)
    values = [base ^ (1 << k) for k in range(63)] + [base]
    rows = [(v,) for v in map(simhash._signed, values)]
    found = simhash.close_pairs(spark.createDataFrame(rows, "fp long"), pairwise=8).collect()
    assert {x for p in found for x in p} == {r[0] for r in rows}


def test_simhash_alone_finds_near_copies(spark, monkeypatch):
    """Without any MinHash band the stage still finds most near copies: one word
    in 400 turns 3 bits on average, and more than 5 in a few pairs."""
    monkeypatch.setattr(simhash, "shared_bands", lambda members: members.select("key", "h", F.lit(2).cast("long").alias("size"), F.col("h").alias("hub")).filter("size > 2"))
    rng = random.Random(5)
    rows = []
    for _ in range(30):
        base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
        rows.append((len(rows), " ".join(base)))
        base[rng.randrange(400)] = "other"
        rows.append((len(rows), " ".join(base)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(0, 60, 2)) and len(kept) <= 34


def test_simhash_neighbours_unlike_in_words_stay(spark, monkeypatch):
    """A pair within the radius is dropped only if its words say so."""
    monkeypatch.setattr(simhash, "candidates", lambda prints: prints.select(F.col("h").alias("a")).crossJoin(prints.select(F.col("h").alias("b"))).filter("a < b"))
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"] + [" ".join(f"a{i}" for i in range(41))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, 1, 2}
