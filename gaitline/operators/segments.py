"""Bouts by segments of a video (W5, A10): no task holds a whole one.

Rows are dealt to segments of frames. A segment finds its islands and keeps three kinds of things: islands
inside it, which are final; its first and last island, which a neighbour may continue; and what it has
before its first and behind its last positive row. These few rows for each segment are put together in the
order of segments: positions by the rows before, islands by the gap between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 1 << 16
_BOUTS = "array<struct<start_pos:int,end_pos:int,start_frame:int,end_frame:int,n_positive:bigint,n_frames:bigint,valued:bigint,total:double,most:double>>"


def segmented_bouts(frames: DataFrame, positive: Column, min_length: int = 16, max_gap: int = 3, keys: tuple[str, ...] = ("stem",), order: str = "frame", value: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """Islands of positive rows with gaps of at most ``max_gap`` rows, of at least ``min_length`` positives.

    Gives keys, start_pos, end_pos, start_frame, end_frame, n_positive and, over all rows from the start to the end, n_frames, and number (``valued``), total and most of ``value``.
    An island whose gap to the last row is allowed ends there. ``order`` is numeric and different in a group of ``keys``; a missing ``positive`` is none.
    """
    value = F.lit(None).cast("double") if value is None else value.cast("double")
    own = [*keys, "__seg"]
    rows = frames.select(*keys, F.floor(F.col(order) / segment).cast("long").alias("__seg"), F.col(order).cast("long").alias("f"), F.coalesce(positive, F.lit(False)).alias("hit"), value.alias("v"))
    before = Window.partitionBy(*own).orderBy("f")
    pos = (F.row_number().over(before) - 1).cast("long")
    counted = rows.withColumn("pos", pos).withColumn("at", F.when(F.col("hit"), F.col("pos")))
    last = F.last("at", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.first("at", ignorenulls=True).over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = counted.select("*", last.alias("last"), follows.alias("follows"))
    opens = F.coalesce((F.col("hit") & (F.col("pos") - F.col("last") - 1 > max_gap)).cast("int"), F.lit(0))  # another island of this segment
    # rows before the first hit stand under -1, rows behind the last one under null, rows of a gap that is too long go
    part = F.when(F.col("last").isNull() & ~F.col("hit"), F.lit(-1)).when(F.col("follows").isNotNull(), F.sum(opens).over(before))
    inside = F.col("hit") | F.col("last").isNull() | F.col("follows").isNull() | (F.col("follows") - F.col("last") - 1 <= max_gap)
    stats = [F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.min("at").alias("a"), F.max("at").alias("b"), F.min(F.when(F.col("hit"), F.col("f"))).alias("fa"), F.max(F.when(F.col("hit"), F.col("f"))).alias("fb"), F.count("v").alias("valued"), F.sum("v").alias("total"), F.max("v").alias("most")]
    pieces = placed.select(*own, "f", "pos", "at", "hit", "v", part.alias("part"), inside.alias("inside"))
    summed = pieces.groupBy(*own, F.when(F.col("inside"), F.coalesce("part", F.lit(1 << 40))).alias("part")).agg(*stats, F.max("f").alias("far"), F.count(F.lit(1)).alias("size"))
    piece = F.struct("part", "n", "hits", "a", "b", "fa", "fb", "valued", "total", "most")
    segments = summed.groupBy(*own).agg(F.sum("size").alias("rows"), F.max("far").alias("far"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), piece))).alias("pieces"))

    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__seg")
    offset = F.coalesce(F.sum("rows").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = F.filter("pieces", lambda p: p["hits"] > 0)
    least, most = F.array_min(F.transform(islands, lambda p: p["part"])), F.array_max(F.transform(islands, lambda p: p["part"]))
    placed = segments.select(*own, "pieces", offset.alias("offset"), F.sum("rows").over(whole).alias("all"), F.max("far").over(whole).alias("end_f"), least.alias("least"), most.alias("most"))
    final = lambda p: (p["hits"] > 0) & (p["part"] > F.col("least")) & (p["part"] < F.col("most"))

    def bout(a: Column, b: Column, fa: Column, fb: Column, p) -> Column:
        return F.struct(a.cast("int").alias("start_pos"), b.cast("int").alias("end_pos"), fa.cast("int").alias("start_frame"), fb.cast("int").alias("end_frame"), p("hits").alias("n_positive"), p("n").alias("n_frames"), p("valued").alias("valued"), p("total").alias("total"), p("most").alias("most"))

    inner = F.transform(F.filter("pieces", lambda p: final(p) & (p["hits"] >= min_length)), lambda p: bout(p["a"] + F.col("offset"), p["b"] + F.col("offset"), p["fa"], p["fb"], lambda c: p[c]))
    edges = placed.select(*own, "offset", "all", "end_f", inner.alias("inner"), F.posexplode(F.filter("pieces", lambda p: ~final(p))).alias("k", "p"))
    edges = edges.select(*own, "k", "all", "end_f", F.when(F.col("k") == 0, F.col("inner")).alias("inner"), *[F.col(f"p.{c}").alias(c) for c in ("n", "hits", "fa", "fb", "valued", "total", "most")], *[(F.col(f"p.{c}") + F.col("offset")).alias(c) for c in "ab"])

    # first and last islands and what surrounds them, in order; the rows of a gap count where the island behind it goes on
    run = Window.partitionBy(*keys).orderBy("__seg", "k")
    edges = edges.withColumn("last", F.last("b", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.withColumn("new", F.when(F.col("hits") > 0, (F.coalesce(F.col("a") - F.col("last") - 1, F.lit(max_gap + 1)) > max_gap).cast("int")))
    edges = edges.select("*", F.first("new", ignorenulls=True).over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("goes_on"), F.sum(F.coalesce("new", F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("bout"))
    reaches = F.col("goes_on").isNull() & (F.col("all") - 1 - F.col("last") <= max_gap)
    counts = (F.col("bout") > 0) & ((F.col("hits") > 0) | (F.col("goes_on") == 0) | reaches)
    own_sum = lambda f, c: f(F.when(counts, F.col(c))).alias(c)
    merged = edges.groupBy(*keys, "bout").agg(*[own_sum(F.sum, c) for c in ("n", "hits", "valued", "total")], *[own_sum(F.min, c) for c in ("a", "fa")], *[own_sum(F.max, c) for c in ("b", "fb", "most")], F.max("all").alias("all"), F.max("end_f").alias("end_f"), F.flatten(F.collect_list("inner")).cast(_BOUTS).alias("inner"))
    to_end = F.col("all") - 1 - F.col("b") <= max_gap
    edge = bout(F.col("a"), F.when(to_end, F.col("all") - 1).otherwise(F.col("b")), F.col("fa"), F.when(to_end, F.col("end_f")).otherwise(F.col("fb")), F.col)
    return merged.select(*keys, F.inline(F.concat("inner", F.when(F.col("hits") >= min_length, F.array(edge)).otherwise(F.array()).cast(_BOUTS))))
