"""Seeded orders by permuted row numbers (K3, K4): rows are numbered once, each epoch's order is arithmetic on the number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitline.operators.selection import global_rank

ROUNDS = 4
WALK = 64


def permuted(number: Column, size: int, seed: str) -> Column:
    """A bijection of 0..size-1: a Feistel network on pairs of digits to the base m = ceil(sqrt(size)), walked on while it leads beyond ``size``.

    At most about 2 in m numbers lead there, and a walk ends in the range at the latest when its cycle does; 64 steps leave none out that can be met.
    """
    if size < 1:
        raise ValueError("size must be 1 at least")
    m = max(1, math.isqrt(size - 1) + 1)
    pair = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def digest(i: Column, right: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i.cast("string"), right.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")

    def step(x: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(F.floor(x / m), x % m), lambda s, i: pair(s["r"], (s["l"] + digest(i, s["r"])) % m))
        return walked["l"] * m + walked["r"]

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(number.cast("long")), lambda x, _: F.when(x < size, x).otherwise(step(x)))


def numbered(items: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """Items with ``number`` 0.. in the order of their key, by range partitions, and how many there are; done once for all epochs."""
    out = global_rank(items, key, "number").withColumn("number", F.col("number") - 1)
    return out, out.count()


def epoch_batches(rows: DataFrame, size: int, batch: int, seed: int, epoch: int) -> DataFrame:
    """K3: numbered rows with their ``place`` in an epoch's order and their ``batch_id``: no shuffle, no sort."""
    place = permuted(F.col("number"), size, f"{seed}:{epoch}")
    return rows.withColumn("place", place).withColumn("batch_id", F.floor(F.col("place") / batch).cast("long"))


def epoch_draws(rows: DataFrame, sizes: dict[str, int], counts: dict[str, int], batch: int, seed: int, epoch: int = 0) -> DataFrame:
    """K4: rows (stratum, number within it) with the ``step`` and ``round`` in which each is drawn: each stratum gives ``counts`` of it to a step, and is permuted anew when it is used up.

    ``sizes``: rows of each stratum, a number for each of the few strata; a row comes once for each round that draws it.
    """
    if any(v < 0 for v in counts.values()) or sum(counts.values()) != batch:
        raise ValueError("counts must not be negative and add up to the batch")
    steps, out = math.ceil(sum(sizes.values()) / batch), None
    for stratum, count in counts.items():
        if not count:
            continue
        if not sizes.get(stratum):
            raise ValueError(f"the pool {stratum} is empty")
        n, own = sizes[stratum], rows.where(F.col("stratum") == stratum)
        drawn = None
        for turn in range(math.ceil(steps * count / n)):
            part = own.withColumn("round", F.lit(turn)).withColumn("draw", permuted(F.col("number"), n, f"{seed}:{epoch}:{stratum}:{turn}") + turn * n)
            drawn = part if drawn is None else drawn.unionByName(part)
        drawn = drawn.where(F.col("draw") < steps * count).withColumn("step", F.floor(F.col("draw") / count).cast("long")).drop("draw")
        out = drawn if out is None else out.unionByName(drawn)
    return out
