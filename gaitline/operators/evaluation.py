"""Evaluation of fixed prediction sources on any run's subset of videos.

A source is a model or an ensemble, made by one run; the videos may be another run's. All pairs
of a source and a subset are one plan: each window is scored once for each member that any pair
needs there, overlaps are summed by member, and only those sums fan out to the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitline.operators import bouts as B
from gaitline.sources.io import union_of_columns

PAIR = ("source", "subset")
POLICIES = ("none", "train", "train_val")


def scoring_plan(pairs: DataFrame, sources: DataFrame, members: DataFrame, subsets: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, subset, member, stem): which member scores which video for whom.

    ``pairs`` (source, subset) are wanted; ``sources`` (source, kind, policy, threshold), ``members`` (source, member) and ``subsets``
    (subset, stem) describe them. ``seen`` (member, stem, part) are the videos of a member's own training and validation: an
    ensemble is recused by them under its policy (``train``, ``train_val``), never by what the evaluated run has seen. A single model is not recused.
    """
    wanted = pairs.select(*PAIR).distinct().join(sources.select("source", "kind", "policy"), "source").join(members.select("source", "member").distinct(), "source").join(subsets.select("subset", "stem").distinct(), "subset")
    known = seen.groupBy("member", "stem").agg(F.bool_or(F.col("part") == "train").alias("trained"), F.bool_or(F.col("part").isin("train", "val")).alias("used"))
    recused = F.when(F.col("kind") != "ensemble", False).when(F.col("policy") == "train", F.col("trained")).when(F.col("policy") == "train_val", F.col("used")).otherwise(False)
    return wanted.join(known, ["member", "stem"], "left").where(~F.coalesce(recused, F.lit(False))).select(*PAIR, "member", "stem")


def plan_problems(pairs: DataFrame, sources: DataFrame, members: DataFrame, subsets: DataFrame) -> DataFrame:
    """(source, subset, problem): pairs of an unknown source, policy or subset, ensembles of fewer than two members, models of several."""
    sizes = members.groupBy("source").agg(F.count_distinct("member").alias("n"))
    known = pairs.select(*PAIR).distinct().join(sources, "source", "left").join(sizes, "source", "left").join(subsets.select("subset").distinct().withColumn("there", F.lit(True)), "subset", "left")
    n = F.coalesce("n", F.lit(0))
    problem = (
        F.when(F.col("kind").isNull(), "unknown source").when(~F.col("policy").isin(*POLICIES), "unknown policy").when(F.col("there").isNull(), "unknown subset")
        .when((F.col("kind") == "ensemble") & (n < 2), "fewer than two members").when((F.col("kind") != "ensemble") & (n != 1), "not one model")
    )
    return known.select(*PAIR, problem.alias("problem")).where("problem is not null")


def source_frames(rows: DataFrame, plan: DataFrame, sources: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, subset, stem, frame, prob, truth, pred): frames of each pair, a mean over all windows and members.

    ``rows`` are window rows (stem, start, frame, truth, …) of all videos; ``score`` gets those that any pair wants, once for each
    member (``member``), and returns (member, stem, frame, truth, prob), with ``start`` where it has one. A frame's values of one member
    are a short list, which fans out to the pairs; each pair adds up the last member and the latest window first.
    """
    scored = score(rows.join(plan.select("member", "stem").distinct(), "stem"))
    value = F.struct((F.col("start") if "start" in scored.columns else F.lit(0)).alias("at"), F.col("prob").cast("double").alias("v"))
    lists = scored.groupBy("member", "stem", "frame").agg(F.collect_list(F.when(F.col("prob").isNotNull(), value)).alias("list"), F.max("truth").cast("int").alias("truth"))
    placed = F.transform("list", lambda x: F.struct(F.col("member"), x["at"].alias("at"), x["v"].alias("v")))
    mean = B.mean_in_order(F.sort_array(F.flatten(F.collect_list(placed)), asc=False))
    spread = lists.join(plan, ["member", "stem"]).groupBy(*PAIR, "stem", "frame").agg(mean.alias("prob"), F.max("truth").alias("truth"))
    return spread.where("prob is not null").join(sources.select("source", "threshold"), "source").withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("int")).drop("threshold")


def source_coverage(rows: DataFrame, pairs: DataFrame, subsets: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """A6 for each pair: frames and videos there are, those scored, and those recused throughout."""
    extents = rows.groupBy("stem").agg((F.max("start") + size).cast("long").alias("n"))
    total = pairs.select(*PAIR).distinct().join(subsets.select("subset", "stem").distinct(), "subset").join(extents, "stem")
    scored = frames.groupBy(*PAIR, "stem").agg(F.count(F.lit(1)).alias("scored"))
    both = total.join(scored, [*PAIR, "stem"], "left").fillna(0, subset=["scored"])
    out = both.groupBy(*PAIR).agg(F.sum("n").alias("n_total_frames"), F.sum("scored").alias("n_scored_frames"), F.count(F.lit(1)).alias("n_total_videos"), F.count_if(F.col("scored") > 0).alias("n_scored_videos"))
    return out.withColumns({"frame_coverage": F.coalesce(F.try_divide("n_scored_frames", "n_total_frames"), F.lit(0.0)), "n_fully_recused_videos": F.col("n_total_videos") - F.col("n_scored_videos")})


def source_episodes(frames: DataFrame, min_length: int = 16, max_gap: int = 3) -> tuple[DataFrame, DataFrame]:
    """Predicted and true episodes of each pair's frames."""
    keys = (*PAIR, "stem")
    return B.bouts(frames, F.col("pred") == 1, min_length, max_gap, keys), B.bouts(frames, F.col("truth") == 1, 1, 0, keys)


def source_metrics(frames: DataFrame, sources: DataFrame, members: DataFrame, coverage: DataFrame, level: str = "both", min_length: int = 16, max_gap: int = 3, overlap: float = 0.2) -> DataFrame:
    """Rows (source, subset, level, rates, counts, coverage and what the source is) of frame or episode metrics, or of both."""
    if level not in ("frame", "episode", "both"):
        raise ValueError(f"unknown level {level}")
    parts = []
    if level != "episode":
        totals = frames.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("truth").cast("long").alias("n_positive_frames"))
        parts.append(B.binary_metrics(frames, list(PAIR)).join(totals, list(PAIR)).withColumn("level", F.lit("frame")))
    if level != "frame":
        pred, truth = source_episodes(frames, min_length, max_gap)
        settings = {"level": F.lit("episode"), "episode_min_frames": F.lit(min_length), "episode_max_gap": F.lit(max_gap), "episode_overlap_threshold": F.lit(float(overlap))}
        parts.append(B.episode_metrics(pred, truth, overlap, (*PAIR, "stem"), PAIR).withColumns(settings))
    sizes = members.groupBy("source").agg(F.count_distinct("member").alias("ensemble_n_members"))
    policy = F.when(F.col("kind") == "ensemble", F.col("policy")).otherwise("none").alias("recusal_policy")
    described = sources.join(sizes, "source").select("source", F.col("kind").alias("manifest_kind"), policy, "threshold", "ensemble_n_members")
    return union_of_columns(*parts).join(described, "source").join(coverage, list(PAIR))


def source_errors(frames: DataFrame, min_length: int = 16, max_gap: int = 3, overlap: float = 0.2) -> DataFrame:
    """J7 for each pair: episodes without a partner."""
    keys = (*PAIR, "stem")
    pred, truth = source_episodes(frames, min_length, max_gap)
    return B.bout_errors(pred, truth, B.match_bouts(B.eligible_pairs(pred, truth, overlap, keys), keys), keys)
