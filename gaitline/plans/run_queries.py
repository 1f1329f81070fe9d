"""Registered queries about runs: their manifests, and sources evaluated on other runs' subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitline.operators import bouts as B
from gaitline.operators import evaluation as E
from gaitline.operators import manifests as M
from gaitline.plans import fixtures as fx
from gaitline.plans.catalog import _ELIGIBLE, _matched, query, rounded
from gaitline.sources import documents as D

# --- a fixed source on another run's subset ----------------------------------------------------------
# Members 0 to 2 have seen the videos of users 0 to 2 modulo 10: in training those of an even tens digit, else in validation.
# Ensemble e0 is recused by training and validation, e1 by training only, m2 is a single model.
# Subset a is one run's test set, b another's; e0 is wanted on both, the others on b.

_SOURCES = [("e0", "ensemble", "train_val", 0.5), ("e1", "ensemble", "train", 0.45), ("m2", "train", "train_val", 0.5)]
_MEMBERS = [("e0", 0), ("e0", 1), ("e1", 1), ("e1", 2), ("m2", 2)]
_PAIRS = [("e0", "a"), ("e0", "b"), ("e1", "b"), ("m2", "b")]


def plan_tables(spark, d):
    users = fx.frames(spark, d).select("stem", "user_id").distinct()
    subsets = users.where("user_id % 3 = 0").select(F.lit("a").alias("subset"), "stem").unionByName(users.where("user_id % 4 = 1").select(F.lit("b").alias("subset"), "stem"))
    seen = users.where("user_id % 10 < 3").select((F.col("user_id") % 10).cast("int").alias("member"), "stem", F.when(F.floor(F.col("user_id") / 10) % 2 == 0, "train").otherwise("val").alias("part"))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return table(_PAIRS, "source string, subset string"), table(_SOURCES, "source string, kind string, policy string, threshold double"), table(_MEMBERS, "source string, member int"), subsets, seen


def closed_form(rows):
    """The members' stand-in: a probability by window and member that SQL can state."""
    turn = ((F.col("start") / fx.STRIDE).cast("int") + F.col("member")) % 5
    return rows.withColumn("prob", F.least(F.lit(1.0), F.col("prob") * ((8 + turn) / 10)))


def planned_frames(spark, d):
    pairs, sources, members, subsets, seen = plan_tables(spark, d)
    rows = B.window_rows(fx.frames(spark, d).select("stem", "frame", "prob", "truth"), fx.WINDOW, fx.STRIDE)
    plan = E.scoring_plan(pairs, sources, members, subsets, seen)
    return rows, E.source_frames(rows, plan, sources, closed_form)


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows) + ")"


_PLAN_SQL = f"""
src as (select * from {_values(_SOURCES)} t(source, kind, policy, threshold)),
mem as (select * from {_values(_MEMBERS)} t(source, member)),
wanted as (select * from {_values(_PAIRS)} t(source, subset)),
vid as (select distinct stem, user_id from fx_frames),
sub as (select 'a' as subset, stem, user_id from vid where user_id % 3 = 0 union all select 'b', stem, user_id from vid where user_id % 4 = 1),
plan as (
    select source, subset, member, stem from wanted join src using (source) join mem using (source) join sub using (subset)
    where kind = 'train' or user_id % 10 <> member or (policy = 'train' and (user_id // 10) % 2 <> 0)
),
scored as (
    select source, subset, stem, frame, truth, least(1.0, prob * (0.8 + 0.1 * ((start // {fx.STRIDE} + member) % 5))) as p from fx_rows join plan using (stem)
),
rec as (
    select source, subset, stem, frame, sum(p) / count(*) as prob, max(truth) as truth, (sum(p) / count(*) >= any_value(threshold))::int as pred
    from scored join src using (source) group by 1, 2, 3, 4
)"""
_KEYS = "source, subset, stem"
_PAIR_EPISODES = f"""
{fx.bout_sql('rec', 'pred = 1', 3, 1, _KEYS, 'pb')},
{fx.bout_sql('rec', 'truth = 1', 1, 0, _KEYS, 'tb')},
{_ELIGIBLE.replace('select p.stem', 'select p.source, p.subset, p.stem', 1).replace('p.stem = t.stem', 'p.source = t.source and p.subset = t.subset and p.stem = t.stem', 1)},
{_matched('pairs', _KEYS)}"""


@query("u4_a25_source_frames", f"with {fx.FRAMES}, {fx.WINDOWS}, {_PLAN_SQL} select source, subset, stem, frame, round(prob + 1e-9, 6) as prob, truth, pred from rec")
def source_frames(spark, d):
    return rounded(planned_frames(spark, d)[1], 1e-9)


@query(
    "u4_a25_sources_on_other_subsets",
    f"""with recursive {fx.FRAMES}, {fx.WINDOWS}, {_PLAN_SQL}, {_PAIR_EPISODES},
cells as (
    select source, subset, count(*) as n_frames, sum(truth)::bigint as n_positive_frames, count(*) filter (truth = 1 and pred = 1) as tp, count(*) filter (truth = 0 and pred = 1) as fp,
           count(*) filter (truth = 1 and pred = 0) as fn from rec group by 1, 2
),
events as (
    select source, subset, coalesce((select sum(m) from matched m where m.source = w.source and m.subset = w.subset), 0)::bigint as tp,
           (select count(*) from pb where pb.source = w.source and pb.subset = w.subset) as p, (select count(*) from tb where tb.source = w.source and tb.subset = w.subset) as t
    from wanted w
),
levels as (
    select source, subset, 'frame' as level, tp, fp, fn, n_frames, n_positive_frames, cast(null as bigint) as n_predicted_episodes from cells
    union all
    select source, subset, 'episode', tp, p - tp, t - tp, null, null, p from events
),
extent as (select stem, max(start) + {fx.WINDOW} as n from fx_rows group by 1),
cover as (
    select source, subset, sum(n)::bigint as n_total_frames, sum(coalesce(s.scored, 0))::bigint as n_scored_frames, count(*) filter (s.scored is null) as n_fully_recused_videos
    from wanted join sub using (subset) join extent using (stem) left join (select source, subset, stem, count(*) as scored from rec group by 1, 2, 3) s using (source, subset, stem) group by 1, 2
)
select source, subset, level, kind as manifest_kind, case kind when 'ensemble' then policy else 'none' end as recusal_policy, (select count(*) from mem where mem.source = levels.source) as ensemble_n_members,
       tp, fp, fn, n_frames, n_positive_frames, n_predicted_episodes, n_total_frames, n_scored_frames, n_fully_recused_videos, round(n_scored_frames / n_total_frames, 6) as frame_coverage,
       round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1
from levels join src using (source) join cover using (source, subset)""",
)
def sources_on_other_subsets(spark, d):
    """Two ensembles and a model on foreign subsets: frame and episode metrics, each with its coverage."""
    pairs, sources, members, subsets, _ = plan_tables(spark, d)
    rows, frames = planned_frames(spark, d)
    coverage = E.source_coverage(rows, pairs, subsets, frames, fx.WINDOW)
    out = E.source_metrics(frames, sources, members, coverage, "both", 3, 1)
    names = "source subset level manifest_kind recusal_policy ensemble_n_members tp fp fn n_frames n_positive_frames n_predicted_episodes n_total_frames n_scored_frames n_fully_recused_videos frame_coverage f1".split()
    return rounded(out.select(names))


# --- manifests as documents ----------------------------------------------------------------------------
# A manifest for each video's user: every 11th is no YAML, every 7th lacks its training run, every 5th is an ensemble
# (of one member where the user's number is even).


def manifest_texts(spark, d):
    users = fx.frames(spark, d).select("stem", "user_id").distinct()
    u = F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shared = text("behavior: b", (F.col("user_id") % 2).cast("string"), "\nbehavior_idx: 0\nlabel_columns: [b0, 'b1']\nfeature_columns:\n- x\n- \"y: z\"\nwindow: {size: ", (F.col("user_id") % 3 + 60).cast("string"), ", stride: 5}\nfeature_selection: {}\n")
    train = text("artifacts: {}\nresolved_stems:\n  train:\n  - v1\n  - v2\n  val: [", F.col("stem"), "]\n")
    run = text("training_run:\n  checkpoint_selection:\n    enabled: true\n    selected: {threshold: 0.", F.lpad((F.col("user_id") % 90 + 5).cast("string"), 2, "0"), ", epoch: ", u, "}\n")
    ensemble = text("manifest_type: ensemble\ntraining: {}\naggregation:\n  method: mean_probability\nmembers:\n- manifest_path: a.yml\n", F.when(F.col("user_id") % 2 == 1, "- {manifest_path: b.yml, weight: 1}\n").otherwise(""))
    body = F.when(F.col("user_id") % 5 == 0, text(shared, ensemble)).when(F.col("user_id") % 7 == 0, text(shared, train)).otherwise(text(shared, train, run))
    return users.select(F.col("stem").alias("path"), F.when(F.col("user_id") % 11 == 0, "behavior: [b0\nwindow: }").otherwise(body).alias("value"))


@query(
    "s10_manifest_documents",
    f"""with {fx.FRAMES}, u as (select distinct stem, user_id from fx_frames),
k as (select *, user_id % 11 = 0 as broken, case when user_id % 11 = 0 then null when user_id % 5 = 0 then 'ensemble' else 'train' end as kind from u)
select stem as manifest_path, kind,
       case when broken then 'unreadable' when kind = 'ensemble' and user_id % 2 = 0 then 'fewer than two members' when kind = 'train' and user_id % 7 = 0 then 'missing keys: training_run' end as error,
       case when not broken then user_id % 3 + 60 end as size,
       case when kind = 'train' and user_id % 7 <> 0 then round((user_id % 90 + 5) / 100.0, 6) end as selected_threshold,
       case when kind = 'train' then case when stem in ('v1', 'v2') then 2 else 3 end else 0 end as n_seen
from k""",
)
def manifest_documents(spark, d):
    """Nested YAML of a text column to manifests: kind, what is wrong, and settings from within."""
    found = D.manifests_of(D.parse_documents(manifest_texts(spark, d)))
    seen = M.recusal_stems(found).groupBy("manifest_path").agg(F.count(F.lit(1)).cast("int").alias("n_seen"))
    out = M.selected_thresholds(found).join(seen, "manifest_path", "left").fillna(0, ["n_seen"])
    error = F.when(F.col("document").isNull(), "unreadable").otherwise(F.col("error"))
    return rounded(out.select("manifest_path", "kind", error.alias("error"), F.try_variant_get("document", "$.window.size", "bigint").alias("size"), "selected_threshold", "n_seen"))
