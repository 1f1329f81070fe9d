"""Statistics that no task and no driver holds whole: exact quantiles, mergeable moments, signatures of tables, and summaries of data sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitline.operators.features import FAMILIES, family_columns

# --- A15: exact quantiles ----------------------------------------------------------------------------

BUCKETS = 1024


def exact_quantiles(rows: DataFrame, column: str, fractions: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(fraction, value): exact quantiles of a column, between neighbours by linear interpolation; null where there is no value.

    A pass counts the values of each range that still holds a wanted rank in 1,024 buckets, with the least
    and largest value of each; the bucket of the rank is the next range, until it holds one value only. Passes aggregate
    on the map side, and what returns to the driver are the buckets of as many ranges as there are ranks. Missing values and NaN don't count.
    """
    if any(not 0 <= q <= 1 for q in fractions):
        raise ValueError("fractions lie between 0 and 1")
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = rows.sparkSession
    if not whole.n:
        return spark.createDataFrame([(float(q), None) for q in fractions], "fraction double, value double")
    wanted = {k for q in fractions for k in (math.floor(q * (whole.n - 1)), math.ceil(q * (whole.n - 1)))}
    ranges = {k: (0, whole.lo, whole.hi) for k in wanted}  # rank: values below the range, least and largest in it
    while active := sorted({r for r in ranges.values() if r[1] < r[2]}, key=lambda r: r[1]):
        bucket: Column = F.lit(None).cast("int")
        for i, (_, lo, hi) in enumerate(active):
            part = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS), F.lit(BUCKETS - 1))
            bucket = F.when(F.col("v").between(lo, hi), (i * BUCKETS + part).cast("int")).otherwise(bucket)
        counted = values.groupBy(bucket.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("b is not null").collect()
        found = {r.b: r for r in counted}
        for k, place in ranges.items():
            if place[1] < place[2]:
                i, below = active.index(place), place[0]
                for b in range(i * BUCKETS, (i + 1) * BUCKETS):
                    if b in found:
                        if k < below + found[b].n:
                            ranges[k] = (below, found[b].lo, found[b].hi)
                            break
                        below += found[b].n
    def at(q: float) -> float:
        low, high = math.floor(q * (whole.n - 1)), math.ceil(q * (whole.n - 1))
        return ranges[low][1] + (ranges[high][1] - ranges[low][1]) * (q * (whole.n - 1) - low)

    return spark.createDataFrame([(float(q), float(at(q))) for q in fractions], "fraction double, value double")


def score_distribution(scores: DataFrame, column: str = "hardness") -> DataFrame:
    """One row: the least, the median and the largest score."""
    found = exact_quantiles(scores, column, (0.0, 0.5, 1.0))
    pick = lambda q, name: F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(name)
    return found.agg(pick(0.0, f"min_{column}"), pick(0.5, f"median_{column}"), pick(1.0, f"max_{column}"))


# --- A1, S18: moments --------------------------------------------------------------------------------


def column_moments(features: DataFrame, by: str = "stem") -> DataFrame:
    """(by, column, n, mean, m2) of the columns of each feature family: number, mean and summed squared deviation for each video."""
    columns = sorted({c for f in FAMILIES for c in family_columns(features.columns, f)})
    one = features.groupBy(by).agg(*[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2")) for i, c in enumerate(columns)]
    return one.select(by, F.inline(F.array(*parts))).where("n > 0")


def replace_moments(stored: DataFrame, changed: DataFrame, gone: DataFrame | None = None, by: str = "stem") -> DataFrame:
    """Stored moments with those of new or changed videos in place of theirs, and without the videos that are gone: nothing else is read again."""
    out = changed.select(by).distinct() if gone is None else changed.select(by).union(gone.select(by)).distinct()
    return stored.join(out, by, "left_anti").unionByName(changed)


def merged_moments(moments: DataFrame) -> DataFrame:
    """(column, n, mean, m2) over all videos; deviations are summed around the common mean, so nothing cancels out."""
    total = moments.groupBy("column").agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("mean")).alias("__sum"))
    both = moments.join(total, "column").withColumn("__mean", F.col("__sum") / F.col("__n"))
    return both.groupBy("column").agg(F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__mean"), 2)).alias("m2"))


def scalers_of(moments: DataFrame) -> DataFrame:
    """The scalers (family, column, mean, scale) that a fit over all rows gives; population deviation, 0 gives 1."""
    family = F.array_compact(F.array(*[F.when(F.col("column").rlike(p), F.lit(f)) for f, p in FAMILIES.items()]))
    deviation = F.sqrt(F.col("m2") / F.col("n"))
    return merged_moments(moments).select(F.explode(family).alias("family"), "column", "mean", F.when(deviation == 0, 1.0).otherwise(deviation).alias("scale"))


# --- A22: signatures of tables -------------------------------------------------------------------------

LEAVES = 1024


def table_signature(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and the SHA-256 root of a hash tree over a table's rows, whatever their order and partitions.

    A row's leaf is the SHA-256 of its canonical JSON; equal rows are one leaf with their number. Leaves stand by
    their hash; blocks of about 1,024 with a common prefix are hashed, then 256 blocks each, up to the root. The length of the first
    prefix follows from the number of leaves in the largest group. Any row that changes, comes or goes changes the root.
    """
    leaf = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    leaves = rows.groupBy(*by, leaf.alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    most = leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    length = max(0, math.ceil(math.log(most / LEAVES, 16)))
    level = leaves.select(*by, F.col("hash").alias("place"), F.concat_ws(":", "hash", F.col("n").cast("string")).alias("item"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]), ",")
        level = level.groupBy(*by, F.substring("place", 1, length).alias("place")).agg(F.sha2(joined, 256).alias("item"))
        if not length:
            return level.select(*by, F.col("item").alias("signature"))
        length = max(0, length - 2)


# --- A11, A12: data sets -------------------------------------------------------------------------------


def dataset_summary(rows: DataFrame, behaviors: list[str], subset: str = "subset") -> DataFrame:
    """(subset, behavior, n_rows, n_videos, positives, state): a behaviour without positive frames is an error in training, else a warning."""
    counts = rows.groupBy(subset).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stem").alias("n_videos"), *[F.sum(F.col(b).cast("long")).alias(b) for b in behaviors])
    long = counts.unpivot([subset, "n_rows", "n_videos"], behaviors, "behavior", "positives")
    state = F.when(F.col("positives") > 0, "ok").when(F.col(subset) == "train", "error").otherwise("warning")
    return long.select(subset, "behavior", "n_rows", "n_videos", F.coalesce("positives", F.lit(0)).alias("positives"), state.alias("state"))


def require_positives(summary: DataFrame) -> DataFrame:
    """A11's guard: the summary, unless a behaviour has no positive frame in training. The summary is a row for each subset and behaviour."""
    if bad := [r.behavior for r in summary.where("state = 'error'").select("behavior").collect()]:
        raise ValueError(f"no positive frames in training: {sorted(bad)}")
    return summary


def sampling_summary(windows: DataFrame, batch: int, hard: DataFrame | None = None, per_batch: tuple[int, int, int] | None = None) -> DataFrame:
    """One row of how a training epoch draws windows (stem, start, positives): strategy, numbers by stratum, steps and samples.

    With a pool of ``hard`` negatives and their numbers of a batch (positive, hard, random) an epoch has whole batches only.
    """
    if hard is None:
        out = windows.agg(F.lit("uniform").alias("strategy"), F.count_if(F.col("positives") > 0).alias("n_positive_windows"), F.count_if(F.col("positives") == 0).alias("n_negative_windows"), F.count(F.lit(1)).alias("samples_per_epoch"))
        return out.withColumn("steps_per_epoch", F.ceil(F.col("samples_per_epoch") / batch))
    if per_batch is None or min(per_batch) < 0 or sum(per_batch) != batch:
        raise ValueError("numbers of a batch must not be negative and add up to it")
    flagged = windows.join(hard.select("stem", "start", F.lit(True).alias("hard")).distinct(), ["stem", "start"], "left")
    negative = F.col("positives") == 0
    out = flagged.agg(F.lit("hard_negative_stratified").alias("strategy"), F.count_if(~negative).alias("n_positive_windows"), F.count_if(negative).alias("n_negative_windows"), F.count_if(negative & F.col("hard")).alias("n_hard_negative_windows"), F.count_if(negative & F.col("hard").isNull()).alias("n_random_negative_windows"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("steps_per_epoch", F.ceil(F.col("n") / batch)).withColumn("samples_per_epoch", F.col("steps_per_epoch") * batch).drop("n")
