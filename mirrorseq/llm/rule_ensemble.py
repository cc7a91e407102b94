"""Quality classifier: a sparse ensemble of rules.

A forest grown on labelled rows gives the rules: each way from a root to a node
is a conjunction of limits on statistics of the text.  A logistic model with an
L1 penalty weighs them and leaves most without weight.  The others are compiled
into one Column, so scoring is an expression without any Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import md5_prefix, stored

#: Labelled rows to learn from, at most about as many: rows with the lowest
#: hashes of their ids.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0005, 42


def statistics() -> dict[str, Column]:
    """The statistics that rules are made of, from :func:`quality.measures`."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per_word("word_chars"),
        "symbols": per_word("n_symbols"),
        "plain": per_word("n_plain"),
        "repeated": per_word("n_repeat_words"),
        "distinct": per_word("n_distinct"),
        "short": per_word("n_short"),
        "shouts": per_word("n_shouts"),
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "same_lines": F.col("n_dup_lines") / lines,
        "ended": F.col("n_ended") / lines,
        "line_words": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Rule:
    """Statistics within limits, above ``low`` and up to ``high`` each."""

    limits: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.limits:
            if low > -math.inf:
                out = out & (F.col(name) > low)
            if high < math.inf:
                out = out & (F.col(name) <= high)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{low:.6g} < {name} <= {high:.6g}" for name, low, high in self.limits)


@dataclass(frozen=True)
class Ensemble:
    """Weighed rules; what no rule says is the intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1 from the columns of :func:`statistics`."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-odds))


_TEST = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def paths(description: str, names: list[str]) -> list[Rule]:
    """The distinct rules of a forest's description (``toDebugString``): one
    for each node but the roots, limits on one statistic merged."""
    found: dict[Rule, None] = {}
    way: list[tuple[int, str, str, float]] = []
    for line in description.splitlines():
        if re.match(r"^\s*Tree \d+", line):
            way = []
        test = _TEST.match(line)
        if not test:
            continue
        depth = len(test[1])
        way = [w for w in way if w[0] < depth] + [(depth, names[int(test[2])], test[3], float(test[4]))]
        limits: dict[str, tuple[float, float]] = {}
        for _, name, sign, at in way:
            low, high = limits.get(name, (-math.inf, math.inf))
            limits[name] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        found[Rule(tuple((k, *v) for k, v in sorted(limits.items())))] = None
    return list(found)


def training_rows(measured: DataFrame, labels: DataFrame, key: str, label: str, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """(statistics, label) of about ``sample`` labelled rows at most; equal
    statistics count once, with the label that most of them have.

    measured: (key, statistics); usable: which keys may be learned from.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("label"))
    n = max(1, known.count())
    part = int(16**8 * min(1.0, sample / n))
    chosen = known.filter(md5_prefix(F.concat_ws(":", F.lit(label), F.col(key)), 8) < part)
    names = list(statistics())
    # proven bound: the sample is a parameter
    rows = measured.join(F.broadcast(chosen), key).groupBy(*names).agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    return rows.select(*names, "label")


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> Ensemble:
    """The ensemble for stored rows (statistics, label).

    The forest takes all rows for every tree and a third of the statistics for
    every node, so it doesn't depend on how rows are spread.  Rows of one label
    alone, or none, give no rules: the score is the share of label 1, with a
    row of either label added.
    """
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("good")).first()
    n, good = count["n"], count["good"]
    constant = Ensemble(math.log(good + 1) - math.log(n - good + 1))
    if good in (0, n):
        return constant
    names = list(statistics())
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, bootstrap=False, featureSubsetStrategy="onethird", seed=seed).fit(vectors.select("features", "label"))
    rules = paths(forest.toDebugString, names)
    if not rules:
        return constant
    holds = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, tol=1e-6).fit(holds)
    weights = [float(w) for w in model.coefficients]
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics) of each whole text, written once to the shared folder."""
    out = quality.measures(df.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text")
    return stored(out.select(F.col("__key").alias(key), *[c.alias(k) for k, c in statistics().items()]))


def classify(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(key, score): probability of label 1 for each row of ``df``.

    Each text is measured once; its statistics (some hundred bytes a row) serve
    training and scoring.  Scores depend on the text alone.

    Defined results: null and empty texts have statistics of 0 and get their
    score; repeated rows get equal scores; null keys are scored but never
    learned from; an empty table stays empty; a key with several labels has the
    greatest; without labels all scores are 0.5.
    """
    rows = measured(df, key, text)
    model = fit(stored(training_rows(rows, labels, key, label, usable, sample).coalesce(8)))
    return rows.select(key, model.score().alias("score"))
