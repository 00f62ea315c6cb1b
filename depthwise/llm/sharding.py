"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime over a hundred times the number of shards keeps shares within about one per cent of each other.
TABLE_SIZE = 16411


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """slot -> position in `shards`.

    Each shard prefers the slots of its own permutation (offset + i * skip) mod size. Shards take turns; in its turn a shard
    claims its most preferred free slots, as many as its weight (default 1). The size must be prime so that every skip walks
    all slots. Adding or removing a shard moves few slots besides its own. The result depends on the names alone.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, math.isqrt(size) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    position = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [1 + int.from_bytes(d[8:16], "big") % (size - 1) for d in digests]
    share = [(weights or {}).get(s, 1) for s in shards]
    if min(share) < 0 or not sum(share):
        raise ValueError("weights must not be negative nor all 0")
    table, free = [-1] * size, size
    while free:
        for k, times in enumerate(share):
            for _ in range(min(times, free)):
                while table[position[k]] >= 0:
                    position[k] = (position[k] + skip[k]) % size
                table[position[k]] = k
                free -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table size. A null key has the slot of ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row, by one array access a row and without a shuffle.

    The table travels inside the plan as one literal of `size` small integers, whatever the data's size. Rows with a null key
    share one shard; equal keys always share one; an empty table stays empty. Columns of df named as the new ones are
    replaced.
    """
    table = F.from_json(F.lit(str(fill_table(shards, size, weights))), "array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    slotted = df.withColumn(slot_col, slot_of(F.col(key), size))
    return slotted.withColumn(shard_col, F.get(names, F.get(table, F.col(slot_col))))
