"""Sharding by a permutation-filled look-up table (operator 4).

Each shard has a preference order of the slots of a prime-sized table: a start and a
stride taken from hashes of its name. The shards take turns and claim their next free
slot until the table is full, so that each gets an equal part and a change of the shards
moves few slots. Documents look up the slot of their key's hash: a broadcast join with
the table, whose size is fixed, places any key in constant time. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh

SLOTS = 4093
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number of every slot."""
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, as many as shards at least")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    place = [_number(f"offset:{s}") % slots for s in shards]
    stride = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + stride[shard]) % slots
            table[place[shard]], left = shard, left - 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table: ``slots`` rows, whatever the data."""
    numbers = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(docs: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (with a leading underscore where a column has the name).

    Equal keys share a shard; a missing key counts as the empty text. Other columns, whatever their names and
    however long, pass unread; rows that repeat stay; an empty table gives an empty one. Nothing is shuffled.
    """
    slot, shard, own_slot, own_shard = fresh(docs, "slot", "shard", "table_slot", "table_shard")
    hashed = F.conv(F.substring(F.md5(F.coalesce(column(key_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").alias(own_slot), F.col("shard").alias(own_shard)))
    out = docs.withColumn(slot, F.pmod(hashed, F.lit(slots)).cast("int"))
    return out.join(table, F.col(slot) == F.col(own_slot)).select(*map(column, docs.columns), slot, F.col(own_shard).alias(shard))


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", files_per_shard: int | None = None, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Writes ``docs`` as Parquet, a folder for each shard.

    The rows are rebalanced by shard, so that a large shard is split over tasks and files of the session's advisory
    partition size, and there are as many of them as its bytes ask for; ``files_per_shard`` deals to that number by slot instead.
    Rows as in ``place``: an empty table writes no folder of a shard.
    """
    placed = place(docs, key_col, shards, slots)
    slot, shard = placed.columns[-2:]
    if files_per_shard is None:
        dealt = placed.hint("rebalance", shard)
    else:
        dealt = placed.repartition(len(shards) * files_per_shard, shard, F.pmod(F.col(slot), F.lit(files_per_shard)))
    dealt.drop(slot).write.partitionBy(shard).parquet(path)
