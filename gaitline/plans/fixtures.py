"""Pose, annotation and prediction tables derived from the driver's tables, as DataFrames and as SQL.

The SQL is DuckDB's; it is what the registered queries' oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = ("head", "thorax", "abdomen", "left_back_leg_tip", "right_back_leg_tip")
CONFIG = {
    "ref_pt": "thorax",
    "body_length_pts": ["head", "thorax"],
    "angles": [["head", "thorax", "abdomen"], ["left_back_leg_tip", "thorax", "right_back_leg_tip"]],
    "distances": [["head", "abdomen"], ["left_back_leg_tip", "right_back_leg_tip"]],
    "relational": {
        "back_legs": {"type": "bilateral_tips", "behavior": "b0", "origin": "abdomen", "axis": ["thorax", "abdomen"], "left_tip": "left_back_leg_tip", "right_tip": "right_back_leg_tip", "dynamics": {"lags": [1, 4], "features": ["left_signed_angle", "tip_separation"]}},
    },
}
WINDOW, STRIDE = 10, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("stem"), (F.row_number().over(w) - 1).cast("int").alias("frame"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"),
        F.col("event_type").isin("click", "view").cast("int").alias("truth"), "event_type", "user_id", "event_id",
    )


FRAMES = """fx_frames as (
    select concat('v', user_id) as stem, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame, least(value / 100.0, 1.0) as prob,
           case when event_type in ('click', 'view') then 1 else 0 end as truth, event_type, user_id, event_id from events)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).where(F.col("event_type").isin("click", "purchase"))
    return rows.select("stem", F.concat(F.lit("b"), (F.col("event_id") % 2).cast("string")).alias("behavior"), F.when(F.col("event_type") == "click", "START").otherwise("STOP").alias("event_type"), F.col("frame").alias("image_index"))


ANNOTATIONS = """fx_annotations as (
    select stem, concat('b', event_id % 2) as behavior, case when event_type = 'click' then 'START' else 'STOP' end as event_type, frame as image_index
    from fx_frames where event_type in ('click', 'purchase'))"""


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: 100.0 * F.element_at("embedding", i).cast("double")
    w = Window.partitionBy("label").orderBy("vec_id")
    same = F.col("vec_id") % 53 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("stem"), (F.row_number().over(w) - 1).cast("int").alias("frame"),
        F.when(F.col("vec_id") % 17 != 0, e(1)).alias("head_x"), e(2).alias("head_y"), F.when(same, e(1)).otherwise(e(3)).alias("thorax_x"), F.when(same, e(2)).otherwise(e(4)).alias("thorax_y"),
        e(5).alias("abdomen_x"), e(6).alias("abdomen_y"), e(9).alias("left_back_leg_tip_x"), e(10).alias("left_back_leg_tip_y"), e(11).alias("right_back_leg_tip_x"), e(12).alias("right_back_leg_tip_y"),
        F.abs(F.element_at("embedding", 13).cast("double")).alias("head_p"),
    )


POSE = """fx_pose as (
    select concat('v', label) as stem, cast(row_number() over (partition by label order by vec_id) - 1 as int) as frame,
           case when vec_id % 17 = 0 then null else 100.0 * cast(embedding[1] as double) end as head_x, 100.0 * cast(embedding[2] as double) as head_y,
           case when vec_id % 53 = 0 then 100.0 * cast(embedding[1] as double) else 100.0 * cast(embedding[3] as double) end as thorax_x,
           case when vec_id % 53 = 0 then 100.0 * cast(embedding[2] as double) else 100.0 * cast(embedding[4] as double) end as thorax_y,
           100.0 * cast(embedding[5] as double) as abdomen_x, 100.0 * cast(embedding[6] as double) as abdomen_y,
           100.0 * cast(embedding[9] as double) as left_back_leg_tip_x, 100.0 * cast(embedding[10] as double) as left_back_leg_tip_y,
           100.0 * cast(embedding[11] as double) as right_back_leg_tip_x, 100.0 * cast(embedding[12] as double) as right_back_leg_tip_y,
           abs(cast(embedding[13] as double)) as head_p
    from embeddings)"""


def large_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    stem = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    w = Window.partitionBy("stem").orderBy(*order)
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    # dealt by video before any column is derived: all that is made of these rows shares this one shuffle
    return table(spark, sf_dir, "lineitem").select(stem.alias("stem"), *order).repartition("stem").select(
        "stem", (F.row_number().over(w) - 1).cast("int").alias("frame"),
        q.alias("head_x"), (p / 1000.0).alias("head_y"), (q * (1 - d)).alias("thorax_x"), (p / 1000.0 * (1 - t)).alias("thorax_y"), (q * (1 - 2 * d)).alias("abdomen_x"), (p / 1000.0 * (1 - 2 * t)).alias("abdomen_y"),
        (q + F.col("l_linenumber")).alias("left_back_leg_tip_x"), (F.col("l_partkey") % 97).cast("double").alias("left_back_leg_tip_y"), (q - F.col("l_linenumber")).alias("right_back_leg_tip_x"), (F.col("l_partkey") % 89).cast("double").alias("right_back_leg_tip_y"),
    )


def runs(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Metrics of 20 runs at 9 thresholds: (outer_id, outer_seed, inner_seed, threshold, tp..f1)."""
    from gaitline.operators import bouts as B
    from gaitline.operators import selection as S

    grid = S.threshold_grid(spark, 0.35, 0.75, 0.05)
    rows = frames(spark, sf_dir).select((F.col("user_id") % 5).alias("outer_seed"), (F.floor(F.col("user_id") / 5) % 4).alias("inner_seed"), F.least(F.col("prob") * scale, F.lit(1.0)).alias("prob"), "truth")
    out = B.with_accuracy(S.threshold_counts(rows, grid, ["outer_seed", "inner_seed"]))
    return out.select(F.concat(F.lit("outer_seed"), F.col("outer_seed").cast("string")).alias("outer_id"), F.col("outer_seed").cast("int").alias("outer_seed"), F.col("inner_seed").cast("int").alias("inner_seed"), "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")


def runs_sql(name: str = "fx_runs", scale: float = 1.0) -> str:
    return f"""{name} as (
    select concat('outer_seed', o) as outer_id, cast(o as int) as outer_seed, cast(i as int) as inner_seed, threshold, tp, fp, fn, tn, precision, recall,
           case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end as f1, (tp + tn) / greatest(tp + tn + fp + fn, 1) as accuracy
    from (select o, i, threshold, tp, fp, fn, tn, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall
          from (select user_id % 5 as o, (user_id // 5) % 4 as i, threshold, count(*) filter (truth = 1 and least(prob * {scale}, 1.0) >= threshold) as tp, count(*) filter (truth = 0 and least(prob * {scale}, 1.0) >= threshold) as fp,
                       count(*) filter (truth = 1 and least(prob * {scale}, 1.0) < threshold) as fn, count(*) filter (truth = 0 and least(prob * {scale}, 1.0) < threshold) as tn
                from fx_frames, (select distinct round(0.35::double + k * 0.05::double, 10) as threshold from range(9) t(k)) group by 1, 2, 3)))"""


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("stem").distinct()


STEMS = "fx_stems as (select distinct stem from fx_frames)"

MEMBERS = 3


def seen_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, stem): the videos that a member of the ensemble has been trained on."""
    return frames(spark, sf_dir).select("stem", (F.col("user_id") % 10).cast("int").alias("member")).distinct().where(F.col("member") < MEMBERS)


def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window rows times members with closed-form probabilities: (member, user_id, stem, frame, start, pos, prob, truth)."""
    from gaitline.operators import bouts as B

    rows = B.window_rows(frames(spark, sf_dir).select("stem", "frame", "prob", "truth", "user_id"), WINDOW, STRIDE)
    kept = B.recuse(rows, spark.range(MEMBERS).select(F.col("id").cast("int").alias("member")), seen_stems(spark, sf_dir))
    return kept.withColumn("prob", F.least(F.lit(1.0), F.col("prob") * ((8 + ((F.col("start") / STRIDE).cast("int") + F.col("member")) % 5) / 10)))


WINDOWS = f"""fx_rows as (
    select f.*, k * {STRIDE} as start, frame - k * {STRIDE} as pos
    from (select *, count(*) over (partition by stem) as n from fx_frames) f, range(0, 10000) t(k)
    where k * {STRIDE} <= frame and frame < k * {STRIDE} + {WINDOW} and k * {STRIDE} + {WINDOW} <= n)"""

MEMBER_SCORES = f"""fx_members as (
    select m as member, stem, frame, start, pos, truth, least(1.0, prob * (0.8 + 0.1 * ((start // {STRIDE} + m) % 5))) as prob
    from fx_rows, range({MEMBERS}) t(m) where user_id % 10 <> m)"""


def bout_sql(source: str, positive: str, min_length: int, gap: int, keys: str = "stem", name: str = "fx_bouts") -> str:
    """CTEs that end in ``name``: keys, start_frame, end_frame, n_positive (frames are positions in the fixtures)."""
    return f"""{name}_p as (select *, max(frame) over (partition by {keys}) as last from {source}),
    {name}_q as (select *, frame - lag(frame) over (partition by {keys} order by frame) - 1 as g from {name}_p where {positive}),
    {name}_r as (select *, sum(case when g is null or g > {gap} then 1 else 0 end) over (partition by {keys} order by frame) as b from {name}_q),
    {name} as (select {keys}, min(frame) as start_frame, cast(case when max(last) - max(frame) <= {gap} then max(last) else max(frame) end as int) as end_frame, count(*) as n_positive from {name}_r group by {keys}, b having count(*) >= {min_length})"""
