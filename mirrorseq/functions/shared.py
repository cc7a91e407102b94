"""Results that several plans read, kept where all executors see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and run inside the block go when
    their run ends; else Spark keeps them until the driver collects its garbage,
    and passes over the same rows add up on disk."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


class Kept:
    """Tables written below ``spark.checkpoint.dir`` while a result is made.

    Unlike a cache they survive the loss of executors, and they cut the lineage
    of loops.  Leaving the block deletes the tables, so what is made from them
    must be written, collected or handed out by :meth:`result` by then.  A session that
    runs in one process gets a temporary folder if the setting is unset.
    """

    def __init__(self, spark: SparkSession) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="mirrorseq-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.path, self.n = spark, f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        with released(self.spark):
            df.select("*").write.parquet(path)  # a frame has the setting of its making
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df``, written to a folder of its own that stays."""
        path = f"{self.path}-result-{uuid.uuid4().hex}"
        with released(self.spark):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
