"""Reading sequence tables and pairing files."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.align import SEQ, TIME


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """One ``.csv`` (with header) or ``.parquet`` file."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"unsupported file type: {path}")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or a folder's ``.parquet`` and ``.csv`` files by name."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if path.endswith((".csv", ".parquet")):
        return [path]
    names = sorted(str(x.getPath()) for x in fs.listStatus(place))
    found = [x for x in names if x.endswith((".csv", ".parquet"))]
    if not found:
        raise FileNotFoundError(f"no .csv or .parquet files in {path}")
    return found


def tagged(tables: list[DataFrame], sequence_key: str = SEQ) -> DataFrame:
    """All tables below each other; ids of several become ``"{index}:{id}"``."""
    if len(tables) > 1:
        tables = [t.withColumn(sequence_key, F.concat_ws(":", F.lit(i), F.col(sequence_key).cast("string"))) for i, t in enumerate(tables)]
    if any(set(t.columns) != set(tables[0].columns) for t in tables):
        raise AssertionError("tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), tables)


def with_positions(df: DataFrame, path: str, sequence_key: str = SEQ, time_key: str = TIME) -> DataFrame:
    """``df``, or, for a CSV file without the time key whose first column is an
    unnamed index, its legacy form with positions."""
    if time_key in df.columns or not path.endswith(".csv") or not df.columns[0].startswith("_c"):
        return df
    return legacy_positions(df, sequence_key).withColumnRenamed(TIME, time_key)


def subset(df: DataFrame, sequences_below: int | None = None, positions_below: float | None = None, sequence_key: str = SEQ, time_key: str = TIME) -> DataFrame:
    """Rows of the first sequences and positions; both limits reach the scan."""
    if sequences_below is not None:
        df = df.filter(F.col(sequence_key) < sequences_below)
    return df if positions_below is None else df.filter(F.col(time_key) < positions_below)


def check_equal_lengths(df: DataFrame, sequence_key: str = SEQ) -> int:
    """The rows that every sequence has; an error if they differ."""
    r = df.groupBy(sequence_key).count().agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
    if r["least"] != r["most"]:
        raise ValueError(f"sequences have {r['least']} to {r['most']} rows")
    return r["least"] or 0


def noise_level(name: Column) -> Column:
    """The number in ``....noise_0.5.csv``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"\.noise_(\d+(?:\.\d+)?)\.csv$", 1), F.lit("")).cast("double")


def candidates(prefix: str, folder: str = ".") -> list[str]:
    """Files of a local folder whose names begin with ``prefix``, by name."""
    return sorted(str(p) for p in Path(folder).glob(f"{prefix}*") if p.is_file())


def load_pairs(spark: SparkSession, gt_path: str, pred_path: str, sequence_key: str = SEQ, time_key: str = TIME) -> tuple[DataFrame, DataFrame]:
    """Both sides of n:n files in the order of their names, or of 1:n and n:1."""
    gt, pred = list_files(spark, gt_path), list_files(spark, pred_path)
    if len(gt) != len(pred) and 1 not in (len(gt), len(pred)):
        raise ValueError(f"cannot pair {len(gt)} and {len(pred)} files")
    n = max(len(gt), len(pred))
    load = lambda path: with_positions(load_table(spark, path), path, sequence_key, time_key)
    both = [[load(files[i % len(files)]) for i in range(n)] for files in (gt, pred)]
    return tagged(both[0], sequence_key), tagged(both[1], sequence_key)


def in_file_order(df: DataFrame, out: str = "__at") -> DataFrame:
    """``df``, which must be read from text files, with ``out``, which orders its
    rows as they stand in their files.

    A file may be read in many splits, in any tasks: rows are ordered by file,
    by where their split begins, and within a split by how they were read.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(out))


def legacy_positions(df: DataFrame, sequence_key: str = SEQ) -> DataFrame:
    """Adds the position of each row in its sequence, in the order of the file
    that ``df`` was read from; the first column is the sequence's id."""
    first, *rest = df.columns
    named = in_file_order(df).withColumnRenamed(first, sequence_key)
    at = F.row_number().over(Window.partitionBy(sequence_key).orderBy("__at")) - 1
    return named.withColumn(TIME, at.cast("long")).select(sequence_key, TIME, *rest)
