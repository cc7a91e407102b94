"""Windows of 51 words that a lesser document holds."""

from __future__ import annotations

import collections
import random

from mirrorseq.llm import paragraphs


def _rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(300), 0, at, rng.randrange(2000)) for at in range(4000)] + [(i, 0, 9000, 7) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id long, th int, at int, w long")


def test_later_rows_both_ways(spark):
    rows, df = _rows(spark)
    least = {}
    for i, _, _, w in rows:
        least[w] = min(i, least.get(w, i))
    want = collections.Counter((*r, least[r[3]]) for r in rows if r[0] > least[r[3]])
    for most in (1000, 10**9):
        found = paragraphs._later(df, most).select("id", "th", "at", "w", "keeper").collect()
        assert collections.Counter(tuple(r) for r in found) == want and len(want) > 1000


def test_windows_are_shuffled_once_and_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(paragraphs, "stored", lambda df: stored.append(df) or df)
    plan = paragraphs._later(_rows(spark)[1], 1000)._jdf.queryExecution().executedPlan().toString()
    assert not stored and plan.count("Exchange hashpartitioning") == 1


def _texts():
    """Texts of few and many words, of repeats of all lengths, short and empty."""
    rng = random.Random(3)
    for _ in range(150):
        words = [str(rng.getrandbits(40)) for _ in range(rng.choice([1, 2, 20, 5000]))]
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 24, 28, 50, 51, 52, 100, 700]))]
        yield " ".join(text[: rng.choice([3, 20, 27, 28, 40])] * 6 if rng.random() < 0.2 else text)


def test_texts_at_once_are_as_each_alone():
    texts = [*_texts()]
    hashed = [paragraphs._hashed(t) for t in texts]
    for at in range(0, len(texts), 7):
        few = hashed[at : at + 7]
        counts, rows = paragraphs._anchors_all(few)
        alone = [paragraphs._anchors(h) for h in few]
        assert counts.tolist() == [len(a) for a in alone] and rows.tolist() == [r for a in alone for r in a.tolist()]
        counts, rows = paragraphs._split_all(few)
        alone = [paragraphs._split(h) for h in few]
        assert counts.tolist() == [len(a) for a in alone] and rows.tolist() == [r for a in alone for r in a.tolist()]
    assert sum(len(paragraphs._anchors(h)) for h in hashed) > 500
