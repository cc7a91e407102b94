"""What :func:`stored` leaves behind."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from mirrorseq.llm.common import stored

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_when_a_result_is_stored(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(FILE_CLEANUP, "false")
    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.max("id").alias("m"))
    joined = df.join(df.select("k", F.col("m").alias("n")).repartition("n"), "k")
    found = stored(joined)
    for _ in range(50):  # executors are told to delete, not waited for
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(FILE_CLEANUP, "false") == setting
    # the frame itself can be used again, and the result too
    assert joined.filter("m = n").count() == found.filter("m = n").count() == 5000
    assert {(r.k, r.m) for r in stored(joined.filter("k < 3")).collect()} == {(0, 15000), (1, 15001), (2, 15002)}
