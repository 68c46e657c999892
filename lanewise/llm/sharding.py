"""Sharding by a permutation-filled lookup table. Built-in functions only on the path of the rows.

Every shard has a preference order over the slots of a table whose size is prime: an offset and a step from its
name's digest give a permutation. Shards take turns, each claiming its next free slot, until the table is full.
Shares of slots differ by one slot at most, and when a shard joins or leaves few other slots move. The table is a
parameter-sized broadcast (one row a slot, never more), so a row is placed by one hash and one hash lookup and
nothing is shuffled.

Defined cases: rows with a null key share the slot of the empty key, however long it is; equal keys and repeated rows share a slot, so there are no ties to break. An empty
table stays empty. All columns stay, whatever their names, but for slot and shard, which are replaced. A key that owns a third of the rows is one placement unit by nature:
give more key columns to spread it.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 256


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("give distinct shards and a prime number of slots")
    order = [preferences(s, slots) for s in shards]
    held, turn, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k, (offset, step) in enumerate(order):
            slot = (offset + turn[k] * step) % slots
            while held[slot] >= 0:
                turn[k] += 1
                slot = (offset + turn[k] * step) % slots
            held[slot] = k
            turn[k] += 1
            left -= 1
            if not left:
                break
    return held


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's md5 modulo the table's size; any engine computes the same."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot and shard, one row a slot, unfolded from one array."""
    held = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(held), ",")).alias("slot", "shard")).withColumn("shard", F.col("shard").cast("int"))


def assign_shards(df: DataFrame, keys: list[str], shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard (index into shards)."""
    shards = shards or shard_names()
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    # The row is nested, so no name of it meets one of ours.
    placed = df.select(F.struct(*[df[c] for c in kept]).alias("row"), slot_of(*[df[k] for k in keys], slots=slots).alias("slot"))
    joined = placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], path: str, shards: list[str] | None = None) -> None:
    """One folder a shard. Rows are dealt to tasks evenly, so a large shard is written by several tasks."""
    assign_shards(df, keys, shards).drop("slot").write.partitionBy("shard").parquet(path)
