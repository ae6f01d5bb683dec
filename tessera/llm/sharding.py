"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable integer key decides the shard with no table of ring points; when a
shard is appended only the rows that go into it move, one in ``n + 1`` of them.
Keys that are not integers are hashed to 64 bits first.

Slots number the rows of a shard from 0 without gaps, in key order. They come
from a range partitioning by (shard, key) whose per-partition counts give each
partition its offset, so no shard is ever sorted in one task; rows that repeat
one key are told apart by their digest and a row number, and so split too.

Defined cases: a null text has size 1 and crc32 0; a null key acts as key 0 but
stays null in the result; repeated rows each get a slot of their own; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys, all at once."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.float64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live].astype(np.int64)
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = np.floor((shard[live] + 1).astype(np.float64) * (float(1 << 31) / draw))
        live = live[jump[live] < n_shards]
    return shard.astype(np.int32)


def shard_column(key: Column, n_shards: int) -> Column:
    """The shard of a bigint column, as an Arrow-batched expression."""

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64).view(np.uint64), n_shards))

    return of(F.coalesce(key, F.lit(0).cast("long")))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: digest, shard, slot in it, and the shard after growth by one."""
    kind = docs.schema[id_col].dataType.typeName()
    key = F.col(id_col).cast("long") if kind in ("long", "integer", "short", "byte") else F.xxhash64(F.col(id_col))
    body = text_bytes(text_col)
    digest = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_column(key, n_shards).alias("shard"),
        shard_column(key, n_shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("__row"),
    )
    digest = materialize(digest, "shard-digest")
    order = ["shard", "__id", "size", "text_crc32", "__row"]
    placed = digest.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    placed = placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    placed = materialize(placed, "shard-order")
    parts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    return placed.join(parts, ["shard", "__part"]).select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__at") + F.col("__base")).alias("slot"),
        "grown_shard",
    )
