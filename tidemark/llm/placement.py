"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose size is a prime, and
the shards take turns, each claiming the first free slot of its order. Their shares differ by one
slot at most, and when a shard goes, nearly all slots of the others stay. The table has a fixed
size, so it is broadcast, and a row finds its shard by one hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; at 100 slots a shard or more, shares differ by one hundredth at most.
SLOTS = 65_537


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, which of ``shards`` has it. Names must differ; the order of the list doesn't matter for who gets what, but for ties of turn."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    if not shards or len({*shards}) < len(shards) or len(shards) > slots:
        raise ValueError("give between 1 and slots shards of different names")
    turns = sorted(range(len(shards)), key=shards.__getitem__)
    start, step = [0] * len(shards), [0] * len(shards)
    for i, name in enumerate(shards):
        digest = hashlib.sha256(name.encode()).digest()
        start[i] = int.from_bytes(digest[:8], "big") % slots
        step[i] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    table, free = [-1] * slots, slots
    while free:
        for i in turns:
            while table[start[i]] >= 0:
                start[i] = (start[i] + step[i]) % slots
            table[start[i]] = i
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows: slot, shard."""
    return spark.createDataFrame([(k, shards[i]) for k, i in enumerate(fill_table(shards, slots))], "slot int, shard string")


def slot_of(*keys, slots: int = SLOTS) -> F.Column:
    """The slot of a row by its key columns; null keys count as values."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All columns of ``df`` with ``slot`` and ``shard`` (which replace columns of those names). Rows with equal keys share a shard; an empty table stays empty."""
    kept = df.withColumn("slot", slot_of(*[df[k] for k in keys], slots=slots)).drop("shard")
    return kept.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot").select(*kept.columns, "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, slots: int = SLOTS) -> None:
    """``df`` as Parquet, a folder for each shard. Rows go out from the tasks that hold them: no shard waits for one task."""
    place(df, keys, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)
