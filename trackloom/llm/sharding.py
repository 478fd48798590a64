"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own (offset and skip from a hash of its name) and
the shards take turns claiming their next free slot. A key goes to the shard that owns slot ``hash(key) mod size``. The
shards end up with equal numbers of slots (give or take one), and when a shard is added or removed few keys move.

The table has a fixed number of rows whatever the input holds, so it is broadcast; placing a row is one lookup, without
a shuffle. A hot source or a run of copies does not matter, because the key is the document id and not the source.

Defined results: a null or repeated doc_id is placed like any other value (equal ids share a shard); texts are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm.common import fresh

TABLE_SIZE = 65_537
SHARDS = 64


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Owner (index into ``names``) of every slot. ``size`` must be a prime of at least the number of shards."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and there must be one at least")
    if not is_prime(size) or size < len(names):
        raise ValueError("the table size must be a prime and not below the number of shards")
    digests = [hashlib.blake2b(n.encode(), digest_size=16).digest() for n in names]
    offset = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    owner, turn, free = np.full(size, -1, np.int32), [0] * len(names), size
    while free:
        for k in range(len(names)):
            if not free:
                break
            slot = (offset[k] + turn[k] * skip[k]) % size
            while owner[slot] >= 0:
                turn[k] += 1
                slot = (offset[k] + turn[k] * skip[k]) % size
            owner[slot] = k
            turn[k] += 1
            free -= 1
    return owner


def slot_table(spark: SparkSession, names: list[str], size: int, slot: str, shard: str) -> DataFrame:
    owner = fill_table(names, size)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(owner)], f"`{slot}` int, `{shard}` int")


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """All columns of ``df`` and ``shard`` (int) and ``slot`` (int).

    Columns of these names in the input are replaced. The broadcast table has exactly ``size`` rows of two integers.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    slot, owner_slot, shard = fresh(df, "slot_of_key", "owner_slot", "owner_shard")
    table = slot_table(df.sparkSession, names or shard_names(), size, owner_slot, shard)
    placed = df.select(*[F.col(f"`{c}`") for c in kept], F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int").alias(slot))
    return (
        placed.join(F.broadcast(table), F.col(slot) == F.col(owner_slot))
        .select(*[F.col(f"`{c}`") for c in kept], F.col(shard).alias("shard"), F.col(slot).alias("slot"))
    )


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8, **place_args) -> None:
    """Write the placed rows as one folder per shard; each shard is spread over ``files_per_shard`` tasks."""
    placed = place(df, **place_args)
    salt, = fresh(placed, "file_salt")
    spread = placed.withColumn(salt, F.pmod(F.xxhash64(F.col(placed.columns[0]), F.col("slot")), F.lit(files_per_shard)))
    spread.repartition(F.col("shard"), F.col(salt)).drop(salt, "slot").write.partitionBy("shard").parquet(path)
