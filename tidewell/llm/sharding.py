"""Placement of documents on shards by a permutation-filled lookup table (native).

Each shard walks a permutation of the slots of a prime-sized table, fixed by two
hashes of its name; shards take turns, each claiming the first free slot of its
walk, until the table is full. A key's hash names a slot, the slot names the shard:
one array access a row, no shuffle, and few keys move when a shard comes or goes.
The table has ``slots`` small numbers whatever the data size, and travels as a
constant of the plan.

Defined results: a null key is placed like the text ``\\N``; equal keys share a shard;
an empty table gives no rows; other columns pass through, but a column with an output's
name gives way to it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
#: A prime of about a hundred slots a shard: loads differ by a percent or so.
SLOTS = 6421


def _hash(text: str) -> int:
    """The first 60 bits of MD5, as both SQL dialects can compute it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard index of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    walk = [(_hash(f"{s}:offset") % slots, _hash(f"{s}:skip") % (slots - 1) + 1) for s in shards]
    at, table, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for k, (offset, skip) in enumerate(walk):
            while table[slot := (offset + at[k] * skip) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(docs: DataFrame, key: str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS, slot: str = "slot", name: str = "shard") -> DataFrame:
    """``docs`` with their slot and their shard's index in ``shards``."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    table = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",").cast("array<int>")
    at = slot_of(F.col(key), slots)
    return docs.withColumns({slot: at, name: F.element_at(table, at + 1)})
