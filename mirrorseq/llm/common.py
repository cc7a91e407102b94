"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of this process's stored results.
RUN = f"mirrorseq-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; ``sf_dir`` is any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below
    ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder if it runs in one
    process (``local[...]``, as tests do); on a cluster executors would write
    to disks of their own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mirrorseq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{RUN}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all files that :func:`stored` has written for this process.

    To be called once the results that were built on them have been written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{RUN}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage and keeps a costly result from being computed twice;
    unlike a local checkpoint it survives the loss of executors.  The shuffle
    files of the write go with its end: nothing reads them again, and Spark
    would keep them until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a frame has the setting of its making
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words of a text as a long (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def md5_prefix(value: Column, digits: int) -> Column:
    """The first ``digits`` (at most 15) hexadecimal digits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def as_key(column: Column) -> Column:
    """A key as a string; null becomes its own key."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def number_within(df: DataFrame, group: list[str], key: Column, order: list[str], out: str, digits: int = 2) -> DataFrame:
    """Adds ``out``: a gapless number from 0 within each group.

    Each group is split into 16 ** ``digits`` parts by the hash of ``key``;
    parts are numbered on their own and shifted by the rows of the parts before
    them, so no group has to fit into one task.  The counts are a second, narrow
    read of ``df`` with a row a part.
    """
    part = f"__part_{out}"
    keyed = df.withColumn(part, md5_prefix(key, digits))
    by = [*group, part]
    counts = keyed.groupBy(*by).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        keyed.withColumn("__rank", rank)
        .join(offsets, by)
        .withColumn(out, (F.col("__before") + F.col("__rank") - 1).cast("long"))
        .drop(part, "__rank", "__before")
    )


def part_digits(rows: int, most: int = 1_000_000) -> int:
    """Digits for :func:`number_within` that keep parts of a group of ``rows``
    rows near ``most`` or less; 2 (256 parts) at least, 5 at most."""
    digits = 2
    while digits < 5 and rows > most * 16**digits:
        digits += 1
    return digits
