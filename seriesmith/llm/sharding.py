"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards take
turns; in its turn a shard claims the first slot of its permutation that is still free.
The filled table is broadcast (its size is the parameter ``size``, not the data's), so a
row is placed by one hash and one lookup, without a shuffle. When a shard joins or leaves,
few slots change hands.

Defined results: null key columns hash as a fixed marker, so rows with null keys share a
shard; equal keys always share a shard; keys of any length count whole; an empty frame gives
an empty frame; any other columns are carried along whatever their names, unless they are
named like the two that are added, which replace them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_row, in_row, others

SHARDS = 32
#: Prime, over a hundred slots a shard.
TABLE_SIZE = 4099
MAX_TABLE_SIZE = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's permutation of the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(names: list[str], size: int = TABLE_SIZE, turns: list[int] | None = None) -> list[int]:
    """Slot -> index of the shard that owns it. turns: slots a shard claims per round (default 1 each)."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(size) or not len(names) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"table size must be a prime between the number of shards and {MAX_TABLE_SIZE}")
    turns = turns or [1] * len(names)
    if len(turns) != len(names) or min(turns) < 0 or not any(turns):
        raise ValueError("turns must be non-negative, one per shard, not all zero")
    state = [preference(n, size) for n in names]
    at, step = [s for s, _ in state], [s for _, s in state]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(names)):
            for _ in range(turns[i]):
                if not free:
                    return owner
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                owner[at[i]] = i
                free -= 1
    return owner


def key_slot(keys: list[Column], size: int, spread_by: list[Column] | None = None, spread: int = 1) -> Column:
    """The slot of a row's key. spread > 1 deals each key over so many slots by the hash of spread_by."""
    parts = [F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]
    if spread > 1:
        parts.append(F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("string"))
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    slots = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(slots).alias("slot", "shard"))


def place(
    df: DataFrame,
    keys: list[str],
    shards: int | list[str] = SHARDS,
    size: int = TABLE_SIZE,
    turns: list[int] | None = None,
    spread_by: list[str] | None = None,
    spread: int = 1,
) -> DataFrame:
    """df with ``slot`` and ``shard``. A key that holds too many rows for one shard can be spread."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    owner = table_frame(df.sparkSession, fill_table(names, size, turns))
    if spread_by is None:
        spread_by = [c for c in df.columns if c not in keys]
    keyed = in_row(df).withColumn("slot", key_slot(from_row(keys), size, from_row(spread_by), spread))
    kept = from_row(others(df.columns, ["slot", "shard"]))
    return keyed.join(F.broadcast(owner), "slot").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Parquet under ``shard=N`` folders; each shard is written by several tasks, so a heavy shard is no bottleneck."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
