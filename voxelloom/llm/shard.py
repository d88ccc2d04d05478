"""Weighted rendezvous sharding in DataFrame functions only.

Every (key, shard) pair has a pseudo-random number u in (0, 1]; a row goes to the shard with the smallest -ln(u) / weight.
A key's choice depends on the key and the shards alone: a new shard takes rows only into itself, a removed shard gives up
only its own.  Nothing is shuffled to assign rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.setup import stored

_PRIME = 2147483647


def base(key: Column) -> Column:
    """31 bits of the key's MD5; null is a key of its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % _PRIME


def mixed(h: Column, shard: Column) -> Column:
    """31 pseudo-random bits of a key and a shard (plain integer arithmetic)."""
    x = ((h + (shard + 1) * 362437069) % _PRIME) * 1103515245 % _PRIME
    x = x.bitwiseXOR(F.shiftright(x, 15)) % _PRIME
    x = x * 1566083941 % _PRIME
    x = x.bitwiseXOR(F.shiftright(x, 13)) % _PRIME
    return x * 1812433253 % _PRIME


def _cost(h: Column, shard: Column, weight: Column) -> Column:
    return -F.log((mixed(h, shard) + 1) / F.lit(float(_PRIME))) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct<cost, shard> of the shard that wins the key; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    h = base(key)
    sizes = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_min(F.transform(sizes, lambda w, s: F.struct(_cost(h, s.cast("long"), w).alias("cost"), s.alias("shard"))))


def assign(rows: DataFrame, key: str = "doc_id", weights: list[float] | None = None, shards: int = 40, grown: float | None = 1.0) -> DataFrame:
    """`rows` with `shard`, and `grown_shard`: the shard after one more of weight `grown` joins (None: no such column).

    `weights` gives one positive weight a shard (else `shards` equal ones).  Equal keys share a shard; a null key is a
    key of its own.  Columns of these names are replaced.
    """
    weights = weights or [1.0] * shards
    rows = rows.withColumn("__won", rendezvous(F.col(key), weights)).withColumn("shard", F.col("__won.shard"))
    if grown is not None:
        cost = _cost(base(F.col(key)), F.lit(len(weights)).cast("long"), F.lit(float(grown)))
        rows = rows.withColumn("grown_shard", F.when(cost < F.col("__won.cost"), F.lit(len(weights))).otherwise(F.col("shard")))
    return rows.drop("__won")


def number(rows: DataFrame, order: list[str], block_rows: int = 65536) -> DataFrame:
    """`rows` with `slot`: their rank in their shard by `order` (nulls first), gapless from 0; equal rows in any order.

    Rows are dealt to blocks by ranges of `order` and, within ties, of a row number, so repeated rows and hot keys spread
    too.  Each block of a shard gets its offset from the counts of the earlier ones and is numbered alone.
    """
    columns = [c for c in rows.columns if c != "slot"]
    blocks = max(1, -(-rows.count() // block_rows))
    ranged = rows.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("__row"))
    ranged = stored(ranged.repartitionByRange(blocks, *order, "__row").withColumn("__block", F.spark_partition_id()), "shards")
    counts = ranged.groupBy("shard", "__block").count()
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__block").orderBy(*order, "__row")
    numbered = ranged.withColumn("__n", F.row_number().over(inside)).join(offsets, ["shard", "__block"])
    return numbered.select(*[F.col(f"`{c}`") for c in columns], (F.col("__offset") + F.col("__n") - 1).alias("slot"))


def write(rows: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Sharded rows as Parquet, one folder a shard, `files_per_shard` files in each."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "grown_shard")]), F.lit(files_per_shard))
    rows.repartition("shard", part).write.partitionBy("shard").parquet(path)
