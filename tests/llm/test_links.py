"""Components of similar sets in large bands, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mirrorseq.llm import paragraphs, similar
from mirrorseq.llm.components import components


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def all_pairs(sets, least=0.8):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12]


def linked(spark, sets, keys=None, pairwise=64):
    df = spark.createDataFrame([(h, sorted(g)) for h, g in sets.items()], "h long, grams array<long>")
    rows = [(k, h) for h in sets for k in (keys[h] if keys else [5])]
    members = similar.shared_bands(spark.createDataFrame(rows, "key long, h long"))
    edges = similar.links(members, df, pairwise=pairwise).collect()
    for a, b in edges:
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    return classes(sets, edges)


def test_chain_between_two_hubs(spark):
    """hub 1 - x - y - hub 2, each pair at 9 / 11, beside 35 sets near either hub."""
    base = list(range(10))
    step = lambda s, k: frozenset([*(g for g in s if g != base[k]), 100 + k])
    hub1 = frozenset(base)
    x = step(hub1, 0)
    y = step(x, 1)
    hub2 = step(y, 2)
    sets = dict(enumerate([hub1, x, y, hub2]))
    for k in range(35):
        sets[10 + k] = frozenset([*sorted(hub1)[1:], 1000 + k])
        sets[50 + k] = frozenset([*sorted(hub2)[1:], 2000 + k])
    want = classes(sets, all_pairs(sets))
    assert linked(spark, sets) == want
    assert want[0] == want[3]


@pytest.mark.parametrize("seed", range(3))
def test_walks_of_sets(spark, seed):
    """Sets made by random edits of earlier ones: long chains, stars, families
    that nearly meet, some in several bands."""
    g = random.Random(seed)
    sets, keys, fresh = {}, {}, iter(range(10_000, 10**6))
    for family in range(4):
        members = [frozenset(range(100 * family, 100 * family + g.choice([12, 25, 40])))]
        for _ in range(90):
            s = set(g.choice(members[-12:] if family % 2 else members))
            for _ in range(g.choice([1, 1, 2, 3])):
                s.discard(g.choice(sorted(s)))
                s.add(next(fresh) if g.random() < 0.7 else 100 * family + g.randrange(60))
            members.append(frozenset(s))
        for s in members:
            h = len(sets)
            sets[h] = s
            keys[h] = [1] + ([2] if g.random() < 0.5 else []) + ([3 + family] if g.random() < 0.8 else [])
    assert linked(spark, sets, keys, pairwise=16) == classes(sets, all_pairs(sets))


def test_a_gram_of_many_sets_is_dealt(spark):
    """Every second set shares most grams with the one before it, all share one."""
    sets = {}
    for k in range(0, 300, 2):
        own = [10_000 + 20 * k + i for i in range(9)]
        sets[k], sets[k + 1] = frozenset([1, *own]), frozenset([1, *own[:-1], 9_000_000 + k])
    df = spark.createDataFrame([(h, sorted(g)) for h, g in sets.items()], "h long, grams array<long>")
    parts = df.select("h", F.col("h").alias("root"))
    got = {(r.a, r.b) for r in similar.across(parts, similar.facts(df), df, block=7).collect()}
    assert {(a, b) for a, b in all_pairs(sets)} <= got and len(got) < 1000


def test_classes_of_paragraph_families(spark):
    """Twelve boilerplate paragraphs with numbers, variants with changed words
    and versions between them: bands and links together keep the classes."""
    g = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, family = [], []
    for f in range(12):
        base = g.choices(vocabulary, k=60)
        other = list(base)
        for k in (12, 31, 50):
            other[k] = g.choice(vocabulary)
        bridge = list(base)
        bridge[12] = other[12]
        bridge2 = list(bridge)
        bridge2[31] = other[31]
        for k in range(40):
            texts += [[*base, f"n{f}x{k}"], [*other, f"m{f}x{k}"]]
        texts += [bridge, bridge2]
        family += [f] * 82
    rows = []
    for k, words in enumerate(texts):
        rows.append((k, " ".join(words), *map(int, _mins(words))))
    df = spark.createDataFrame(rows, f"h long, words string, {', '.join(f'{m} long' for m in paragraphs._MINS)}")
    sets = {r.h: frozenset(r.grams) for r in df.select("h", F.transform(paragraphs._grams("words"), lambda x: F.xxhash64(x)).alias("grams")).collect()}
    want = classes(sets, all_pairs(sets))
    grams = df.select("h", F.transform(paragraphs._grams("words"), lambda x: F.xxhash64(x)).alias("grams"))
    found = {r.node: r.root for r in components(similar.links(paragraphs.band_members(df), grams)).collect()}
    got = {h: found.get(h, h) for h in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and family[a] == family[b] and want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def _mins(words):
    """MinHashes of one paragraph, as :func:`paragraphs.split` makes them."""
    import numpy as np

    hashed = paragraphs._hashed(" ".join(words))
    n = len(hashed)
    grams = np.zeros(n - paragraphs.SHINGLE + 1, np.uint64)
    for k in range(paragraphs.SHINGLE):
        grams += hashed[k : n - paragraphs.SHINGLE + 1 + k] * paragraphs._MIX[k]
    return [paragraphs._mixed(grams, b).min().view(np.int64) for b in range(paragraphs.BANDS)]


def test_bits_never_turn_similar_sets_away(spark):
    g = random.Random(4)
    rows = []
    for k in range(3000):
        a = {g.getrandbits(63) - 2**62 for _ in range(g.choice([1, 5, 30, 200]))}
        b = set(g.sample(sorted(a), max(1, round(len(a) * g.choice([1, 0.95, 0.9, 0.85, 0.5]))))) | {g.getrandbits(62) for _ in range(g.choice([0, 0, 1, 3, 20]))}
        rows += [(2 * k, sorted(a)), (2 * k + 1, sorted(b))]
    known = similar.facts(spark.createDataFrame(rows, "h long, grams array<long>"))
    pairs = spark.range(3000).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
    kept = {r.a for r in pairs.join(similar._of("a", known), "a").join(similar._of("b", known), "b").filter(similar._may_be("a", "b", 0.8)).collect()}
    sets = {h: set(s) for h, s in rows}
    near = {2 * k for k in range(3000) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    assert near <= kept and 300 < len(near) and len(kept) < 1.2 * len(near) + 200
