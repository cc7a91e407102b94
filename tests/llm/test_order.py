"""Texts that fingerprints shuffle."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from mirrorseq.llm import fingerprint


def test_texts_are_shuffled_once(spark, docs, monkeypatch):
    """The first rows of buckets are found without a shuffle of all texts, also
    when no table is small enough to be broadcast unasked."""
    plans = []
    stored = fingerprint.stored

    def spy(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        plans.append((df.columns, out.getvalue()))
        return stored(df)

    monkeypatch.setattr(fingerprint, "stored", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fingerprint.fingerprints(docs.select("doc_id", "text"))
        assert found.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    firsts = [p for c, p in plans if c == ["bucket", "text"]]
    assert len(firsts) == 1 and "BroadcastHashJoin" in firsts[0] and "SortMergeJoin" not in firsts[0]


def test_least_of_each_bucket(spark):
    rows = [(i, (i * 7919) % 2**40) for i in range(3000)] + [(5, k << 50) for k in range(40)] + [(None, 3), (None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, tie long")
    dealt, follows, least = fingerprint.in_order(df, "doc_id", "tie", ["doc_id", "tie"])
    want = {r.bucket: (r.m.doc_id, r.m.tie) for r in dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("m")).collect()}
    assert {r.bucket: (r.id, r.tie) for r in least.collect()} == want
    order = sorted(want)
    assert {r.bucket: r.next_bucket for r in follows.collect()} == dict(zip(order, order[1:] + order[:1], strict=True))
