"""Sharding by a permutation-filled lookup table, with DataFrame functions on the documents' path.

Each shard prefers the slots of a prime-sized table in an order of its own (offset and skip from a digest of its
name); shards take turns claiming the first free slot they prefer until the table is full. Every shard then holds
an equal number of slots, give or take one, and few slots change hands when shards come or go. The table's size is a
parameter, not a property of the data, so it is broadcast; a document's shard is one lookup by the digest of its id.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(64))


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The place in ``shards`` of each slot's owner. ``slots`` must be a prime not smaller than the number of shards."""
    if not shards or slots < len(shards) or slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, as large as the number of shards at least")
    turns = []
    for name in shards:
        digest = md5(name.encode()).digest()
        offset, skip = (int.from_bytes(digest[i : i + 8], "big") for i in (0, 8))
        turns.append([offset % slots, skip % (slots - 1) + 1])
    owner, free = [-1] * slots, slots
    while free:
        for i, turn in enumerate(turns):
            while owner[turn[0]] >= 0:
                turn[0] = (turn[0] + turn[1]) % slots
            owner[turn[0]] = i
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``, one row for each slot."""
    return spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot int, shard int")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the first 48 bits of its text's md5; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` plus ``slot`` and ``shard`` (its place in ``shards``); columns of these names are replaced.

    Rows with one key share a shard, repeats included; null keys share the empty text's. No shuffle: the table, of
    fixed size, is broadcast. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    table = lookup_table(docs.sparkSession, shards, slots)
    return docs.select(*kept).withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot", "left").select(*kept, "slot", "shard")


def sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL over the filled table (the fill itself is tested against a plain replay)."""
    owner = ",".join(map(str, fill(shards, slots)))
    return f"""
    WITH t AS (SELECT CAST(string_split('{owner}', ',') AS INTEGER[]) AS owner),
    d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, slot, owner[slot + 1] AS shard FROM d, t"""
