"""Mixing sources to target weights by a time-varying curriculum (operator 2).

Every source has a weight schedule over the training run, from 0 to 1. Its integral is
the source's weight in the whole mix and, with caps on repeats, gives its target of
words. Documents lie on the source's line of words in a fixed random order, and repeat
when the line is used up; a copy whose middle lies under the target is taken. Inverting
the source's cumulative demand at that middle gives the copy's training position, by
which the result is range-sorted. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, word_count

#: Start and end of the linear weight schedules that sources take in turn; their integrals are 5, 2 and 1.
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
_BUCKET_ROWS = 3_000


def _targets(sums: DataFrame, schedules, most_repeats: float) -> DataFrame:
    """One row per source: its place, weight, size and target.

    The common level of words for a unit of weight is the first at which no source that
    is left would pass its cap, with sources in the order of cap for a unit of weight.
    Windows without a partition run over one row per source only.
    """
    by_name = Window.orderBy(F.col("none"), F.col("src"))
    weight = [(a + b) / 2 for a, b in schedules]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules))) + 1).cast("int"))
    rows = sums.groupBy("none", "src").agg(F.sum("part").alias("total"))
    rows = rows.select("*", pick(weight).alias("w"), pick([a for a, _ in schedules]).alias("from"), pick([b for _, b in schedules]).alias("to"), (F.lit(float(most_repeats)) * F.col("total")).alias("cap"))
    ratio = F.col("cap") / F.col("w")
    before = Window.orderBy(ratio, "none", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left_words = F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left_words / left_weight).withColumn("ratio", ratio)
    free = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    return rows.withColumn("target", F.least("cap", F.coalesce(free, F.lit(0.0)) * F.col("w"))).drop("level", "ratio", "cap")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, most_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, taken, copies and positions (array, one for each copy taken).

    A missing text has size 0. Missing sources are one source, the last in the order;
    sources stand by code point. Whole copies are taken, at most ``most_repeats``, so a
    source's words miss its target by half a document at most. Rows that repeat count each
    for itself. An empty table gives an empty one. Clashing columns of ``docs`` stay: the
    new ones then get a leading underscore.

    Only sums for each source and hash bucket leave the first pass; the documents are
    dealt by source and bucket, so that a source with most rows is spread like any other. A missing
    id is dealt by its text.
    """
    size, source_size, target, taken, copies, positions = fresh(docs, "size", "source_size", "target", "taken", "copies", "positions")
    inner = ("none", "src", "bucket", "order", "tie", "start", "total", "level", "w", "from", "to", "used")
    own = dict(zip(inner, fresh(docs.select(*[F.lit(1).alias(c) for c in (*docs.columns, size, source_size, target, taken, copies, positions)]), *(f"mix_{c}" for c in inner)), strict=True))
    at = {name: column(own[name]) for name in inner}
    digits = max(1, min(8, math.ceil(math.log(max(1, docs.count() / _BUCKET_ROWS), 16))))
    tie = F.xxhash64(column(text_col))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(column(id_col).cast("string"), F.concat(F.lit("text "), tie.cast("string")))).cast("binary"))
    keyed = docs.select("*", word_count(text_col).alias(size), column(source_col).isNull().alias(own["none"]), F.coalesce(column(source_col), F.lit("")).alias(own["src"]), order.alias(own["order"]), tie.alias(own["tie"])).withColumn(own["bucket"], F.substring(own["order"], 1, digits))
    keys = ["none", "src", "bucket"]
    sums = keyed.groupBy(*[at[c].alias(c) for c in keys]).agg(F.sum(size).alias("part"))
    earlier = Window.partitionBy("none", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("part").over(earlier), F.lit(0))).join(_targets(sums, schedules, most_repeats), ["none", "src"]).withColumnRenamed("target", "level")
    joined = keyed.join(starts.select(*[F.col(c).alias(own[c]) for c in (*keys, "start", "total", "level", "w", "from", "to")]), [own[c] for c in keys])
    within = Window.partitionBy(*[own[c] for c in keys]).orderBy(own["order"], size, own["tie"]).rowsBetween(Window.unboundedPreceding, -1)
    middle = at["start"] + F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col(size) / 2
    placed = joined.withColumn(own["tie"], middle)
    turns = F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda e: e * at["total"] + at["tie"])
    used = F.filter(turns, lambda x: x < at["level"])
    # Demand up to u is target * (a*u + (b-a)*u*u/2) / w; solved for u.
    a, slope = at["from"], at["to"] - at["from"]
    when = lambda x: F.when(slope == 0, x / at["level"]).otherwise((F.sqrt(F.greatest(a * a + 2 * slope * at["w"] * x / at["level"], F.lit(0.0))) - a) / slope)
    out = placed.withColumn(own["used"], used)
    return out.select(*map(column, docs.columns), size, at["total"].alias(source_size), at["level"].alias(target), (F.size(at["used"]) * F.col(size)).cast("long").alias(taken), F.size(at["used"]).alias(copies), F.transform(at["used"], when).alias(positions))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each copy taken, range-sorted by training position, then by id and the hash of the text.

    Documents without words take none, but are copied where their place on the line is; an empty table gives an empty
    one. Missing ids, texts and sources, long texts and repeated rows as in ``mix``.
    """
    mixed = mix(docs, id_col, text_col, **options)
    positions = mixed.columns[-1]
    at, tie = fresh(mixed, "position", "position_tie")
    copies = mixed.select(*map(column, docs.columns), F.explode(column(positions)).alias(at), F.xxhash64(column(text_col)).alias(tie))
    return copies.orderBy(at, column(id_col), tie).select(*map(column, docs.columns))
