"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_key, md5_prefix, number_within, stored

#: 13 hexadecimal digits fill 52 bits, which a double holds exactly.
_DIGITS, _RANGE = 13, float(16**13)


def _cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, exponential with the shard's rate: the least cost wins."""
    u = (md5_prefix(F.concat_ws(":", key, F.lit(str(shard))), _DIGITS) + 0.5) / _RANGE
    return -F.log(u) / F.lit(float(weight))


def rendezvous(df: DataFrame, key: Column, weights: list[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds the shard of each row; with ``grown`` also its shard among one more.

    Every (key, shard) pair draws an exponential variable whose rate is the
    shard's weight, and the least draw wins, so shard k gets the share
    weights[k] / sum(weights) of the keys.  Draws of other shards don't change
    when a shard comes or goes: rows move only into a new shard or out of a
    removed one.

    Defined results: a null key is a key of its own; equal keys share a shard;
    an empty table stays empty; columns named ``shard`` or ``grown`` are
    replaced, all others kept.  No shuffle.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = [_cost(key, k, w) for k, w in enumerate(weights)]
    all_costs = costs + ([_cost(key, len(weights), grown_weight)] if grown else [])
    out = df.withColumn("__costs", F.array(*all_costs))
    first = F.slice("__costs", 1, len(weights))
    out = out.withColumn(shard, F.array_position(first, F.array_min(first)).cast("int") - 1)
    if grown:
        out = out.withColumn(grown, F.array_position("__costs", F.array_min("__costs")).cast("int") - 1)
    return out.drop("__costs")


def numbered(df: DataFrame, key: str, order: list[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """Adds ``out``, a gapless place from 0 in each shard, without ever
    gathering a shard in one task (see :func:`.common.number_within`).

    Rows are written once, so ``df`` should be narrow; the draws of
    :func:`rendezvous` aren't repeated.  Rows with one key are dealt to parts by
    the columns of ``order`` as well, so that a key that very many rows share is
    split; only rows that are equal in all of them stay together.
    """
    part = F.concat_ws(":", *[as_key(F.col(c)) for c in (key, *order)])
    return number_within(stored(df), [shard], part, [key, *order], out)


def write_shards(df: DataFrame, path: str, key: str, weights: list[float], files_per_shard: int = 64) -> None:
    """Writes one folder ``shard=k`` a shard, each in up to ``files_per_shard``
    files that different tasks write."""
    sharded = rendezvous(df, as_key(F.col(key)), weights)
    salt = md5_prefix(as_key(F.col(key)), 8) % files_per_shard
    sharded.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
