"""Rule ensembles, spelling variants and whitening against plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorseq.llm import queries, rule_ensemble, spelling, whitening
from mirrorseq.llm.common import read


def words_of(rows, thinned=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if h % thinned == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spelling_query_equals_all_pairs(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    got = {r.word: r for r in queries.op12_spelling(spark, sf).collect()}
    n = words_of(docs.collect())
    assert set(got) == set(n) and len(n) > 500
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    assert any(form.values())


def test_neighbourhood_is_whole(spark):
    rows = spark.createDataFrame([("0123",), ("00",), ("3",)], "r string").select("r", spelling.neighbourhood(F.col("r"), 4).alias("s")).collect()
    for r in rows:
        every = {"".join(s) for k in range(len(r.r) + 2) for s in itertools.product("0123", repeat=k)}
        want = {s for s in every if s == r.r or one_edit(s, r.r)}
        assert set(r.s) == want and len(r.s) == len(want)


def test_roots_follow_chains(spark):
    text = "lettera " * 5 + "letterab " * 30 + "letterabc " * 200 + "letterabcd " * 1100 + "lettermbcd " * 5500
    got = {r.word: (r.form, r.root, r.n) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), thinned=None).collect()}
    assert got["lettera"] == ("letterab", "lettermbcd", 5) and got["letterabcd"][0] == "lettermbcd" and got["lettermbcd"] == (None, "lettermbcd", 5500)


def test_spelling_ties_and_case(spark):
    text = "Éclairs " * 5 + "éclairs " * 5 + "ECLAIRs " * 60 + "aclairs " * 60
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), thinned=None).collect()}
    assert set(got) == {"Éclairs", "éclairs", "eclairs", "aclairs"}  # only A to Z are lowered
    assert got["Éclairs"].form == "aclairs" and got["Éclairs"].n_near == 3 and got["eclairs"].form is None


def test_spelling_awkward(awkward, empty):
    got = {r.word: r.n for r in spelling.variants(awkward.select("doc_id", "text", "key", "n_words")).collect()}
    assert got == words_of(awkward.select("doc_id", "text").collect())
    assert spelling.variants(empty).count() == 0


def test_rules_are_paths(spark):
    tree = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      If (feature 0 <= 0.25)
       Predict: 1.0
      Else (feature 0 > 0.25)
       Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    inf = math.inf
    got = {r.limits for r in rule_ensemble.paths(tree, ["a", "b"])}
    assert got == {(("a", -inf, 0.5),), (("a", -inf, 0.5), ("b", -inf, 2.0)), (("a", -inf, 0.5), ("b", 2.0, inf)), (("a", -inf, 0.25), ("b", 2.0, inf)), (("a", 0.25, 0.5), ("b", 2.0, inf)), (("a", 0.5, inf),)}


def test_compiled_score_equals_the_rules(spark, sf):
    labels = read(spark, sf, "labels").select("doc_id", "quality")
    rows = rule_ensemble.measured(read(spark, sf, "documents"))
    model = rule_ensemble.fit(rule_ensemble.stored(rule_ensemble.training_rows(rows, labels, "doc_id", "quality", F.lit(True))))
    assert 0 < len(model.rules) < 200
    for r in rows.withColumn("score", model.score()).collect():
        odds = model.intercept + sum(w for rule, w in model.rules if all(low < r[k] <= high for k, low, high in rule.limits))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-12)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op11_quality_rules(spark, sf)
    rows = scored.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert min(good) > max(bad) or np.mean(good) - np.mean(bad) > 0.8


def test_quality_scores_follow_the_text_alone(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text").limit(100)
    labels = read(spark, sf, "labels")
    one = {r.doc_id: r.score for r in rule_ensemble.classify(docs.unionByName(docs), labels, F.col("doc_id") % 2 == 0).collect()}
    two = {r.doc_id: r.score for r in rule_ensemble.classify(docs.repartition(7), labels, F.col("doc_id") % 2 == 0).collect()}
    assert one == pytest.approx(two)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    out = rule_ensemble.classify(awkward.drop("rank"), labels, F.lit(True)).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert rule_ensemble.classify(empty, labels, F.lit(True)).count() == 0
    none = rule_ensemble.classify(awkward, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    single = rule_ensemble.classify(awkward, labels.filter("quality = 0"), F.lit(True)).collect()
    assert {round(r.score, 6) for r in single} == {round(1 / 3, 6)} or len({r.score for r in single}) == 1


MATRICES = {
    "plain": lambda g: g.standard_normal((300, 24)),
    "graded": lambda g: g.standard_normal((300, 24)) * np.logspace(0, -5, 24),
    "graded up": lambda g: g.standard_normal((300, 24)) * np.logspace(-5, 0, 24),
    "equal": lambda g: np.eye(12) * 3,
    "groups": lambda g: np.diag([9.0] * 8 + [4.0] * 8 + [1.0] * 8) @ np.linalg.qr(g.standard_normal((24, 24)))[0],
    "close": lambda g: np.diag([2, 2 + 1e-9, 2 + 1e-6, 2 + 1e-4, 1, 1]) @ np.linalg.qr(g.standard_normal((6, 6)))[0],
    "flat": lambda g: g.standard_normal((3, 24)),
    "one": lambda g: np.array([[2.0]]),
    "singular": lambda g: np.ones((5, 5)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_components_to_double_precision(name):
    r = MATRICES[name](np.random.default_rng(3))
    values, vectors = whitening.components(r, 1)
    v = r.T @ r
    want = np.linalg.eigvalsh(v)[::-1]
    k = len(values)
    assert k == (want > 1e-11 * want[0]).sum()
    assert np.abs(values - want[:k]).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_small_singular_values_are_relatively_exact():
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1e-2, 1e-5, 1e-8])
    got = whitening.singular_values(a, b)
    # in 60 digits: the squares are the roots of the characteristic polynomial
    import decimal

    decimal.getcontext().prec = 80
    d = [decimal.Decimal(float(x)) for x in a]
    e = [decimal.Decimal(float(x)) for x in b]

    def below(x):
        """Eigenvalues of B'B less than x, by signs of its LDL' factors."""
        q, count = d[0] ** 2 - x, 0
        for i in range(4):
            if i:
                q = d[i] ** 2 + e[i - 1] ** 2 - x - (d[i - 1] * e[i - 1]) ** 2 / q
            count += q < 0
        return count

    for k, s in enumerate(got):
        square = decimal.Decimal(float(s)) ** 2
        assert below(square * decimal.Decimal("1.00000000000002")) >= 4 - k and below(square * decimal.Decimal("0.99999999999998")) <= 3 - k


def test_no_components_of_nothing():
    assert len(whitening.components(np.zeros((4, 4)), 1)[0]) == 0


def test_whitening_query_equals_numpy(spark, sf):
    vectors = {r.vec_id: r.embedding for r in read(spark, sf, "embeddings").collect()}
    got = queries.op13_whitening(spark, sf).collect()
    ids = sorted(vectors)
    x = np.floor(256 * np.array([vectors[i] for i in ids], float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    want = (x - s / n) @ directions[:, :4] / np.sqrt(values[:4])
    exact = {i: int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True))) for i, row in zip(ids, x, strict=True)}
    assert len(got) == 4 * len(ids)
    place = {i: k for k, i in enumerate(ids)}
    found = np.zeros((len(ids), 4))
    for r in got:
        assert r.n == n and r.deviation == exact[r.vec_id] and r.identity_error < 1e-10
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        found[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-9


def test_blocks_and_trees_of_triangles(spark):
    g = np.random.default_rng(5)
    x = g.integers(-99, 99, (5000, 7))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    r = whitening.reduced(rows, x.mean(0))
    c = x - x.mean(0)
    assert np.abs(r.T @ r - c.T @ c).max() < 1e-8 * np.abs(c.T @ c).max() and np.allclose(r, np.triu(r))


def test_whitening_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (None, [0.0, -0.0, 5.0]), (8, [3.0, 1.0, 5.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 5.0])]
    df = spark.createDataFrame([(i, v, 0, "a") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")
    out = whitening.whiten(df).collect()
    # three distinct vectors span two directions, the third entry is constant
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((i, c) for i in ("1", "1", "10", "8", "None") for c in (1, 2))
    assert {r.n for r in out} == {3} and all(r.identity_error < 1e-9 for r in out)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).collect()] == [None, None]
