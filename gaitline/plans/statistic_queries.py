"""Registered queries about statistics, signatures, seeded orders and guards of batches and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitline.operators import bouts as B
from gaitline.operators import features as X
from gaitline.operators import lives as L
from gaitline.operators import permutation as P
from gaitline.operators import selection as S
from gaitline.operators import statistics as T
from gaitline.operators.stages import kept
from gaitline.plans import fixtures as fx
from gaitline.plans.catalog import _COLS, _MOTION, _SPLIT, _matched, features, query, rounded, splits
from gaitline.sources import io


@query("a15_exact_quantiles", f"with {fx.FRAMES} select unnest([0.0, 0.1, 0.5, 0.75, 1.0])::double as fraction, round(unnest(quantile_cont(prob::double, [0.0, 0.1, 0.5, 0.75, 1.0])) + 1e-9, 6) as value from fx_frames")
def exact_quantiles(spark, d):
    return rounded(T.exact_quantiles(kept(fx.frames(spark, d).select("prob"), "frames"), "prob", (0.0, 0.1, 0.5, 0.75, 1.0)), 0.0).select("fraction", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query(
    "a22_table_signature",
    f"""with {fx.FRAMES}, leaf as (
    select event_type, sha256('{{"stem":"' || stem || '","truth":' || truth || '}}') as hash, count(*) as n from fx_frames group by 1, 2
), size as (
    select greatest(0, ceil(log2(max(n) / {T.LEAVES}.0) / 4))::int as len from (select event_type, count(*) as n from leaf group by 1)
), block as (
    select event_type, substr(hash, 1, len) as place, sha256(string_agg(hash || ':' || n, ',' order by hash)) as item, any_value(len) as len from leaf, size group by 1, 2
)
select event_type, case when any_value(len) = 0 then any_value(item) else sha256(string_agg(item, ',' order by place)) end as signature from block group by 1""",
)
def table_signature(spark, d):
    return T.table_signature(fx.frames(spark, d), ["stem", "truth"], ("event_type",))


@query(
    "s18_a1_merged_moments",
    f"with {fx.POSE}, {_MOTION}, u as ("
    + " union all ".join(f"select '{f}' as family, '{c}' as column_name, avg({c}) as mean, stddev_pop({c}) as s from motion where stem <> 'v1'" for f in X.FAMILIES for c in X.family_columns(_COLS, f))
    + ") select family, column_name, round(mean, 6) as mean, round(case when s = 0 then 1.0 else s end, 6) as scale from u",
)
def merged_moments(spark, d):
    """Moments of each video; one video's are stored wrongly and replaced, another goes: scalers as from a fit over what is left."""
    own = kept(T.column_moments(features(spark, d)), "moments")
    stored = own.withColumn("mean", F.when(F.col("stem") == "v2", F.col("mean") + 1).otherwise(F.col("mean")))
    now = T.replace_moments(stored, own.where("stem = 'v2'"), own.where("stem = 'v1'").select("stem"))
    return rounded(T.scalers_of(now).withColumnRenamed("column", "column_name"))


_FINE = "t as (select distinct round(0.35::double + k * 0.001::double, 10) as threshold from range(401) q(k))"


@query(
    "j14_fine_sweep",
    f"with {fx.FRAMES}, {_FINE}, x as (select stem, frame, threshold, prob from fx_frames, t where prob >= threshold - 1), {fx.bout_sql('x', 'prob >= threshold', 3, 1, 'stem, threshold')}, n as (select threshold, count(*) as n_bouts, sum(n_positive)::bigint as positives from fx_bouts group by 1) select threshold, coalesce(n_bouts, 0)::bigint as n_bouts, coalesce(positives, 0)::bigint as positives from t left join n using (threshold)",
)
def fine_sweep(spark, d):
    """Bouts and their positive frames at 401 thresholds, from lives that are made once."""
    grid = [r.threshold for r in S.threshold_grid(spark, 0.35, 0.75, 0.001).collect()]
    return L.totals_at(L.bout_lives(fx.frames(spark, d), min(grid), 3, 1), grid)


def _permuted_sql(source: str, seed: str, name: str) -> str:
    """CTEs (recursive) that end in ``name``: number, grp and place of ``source`` (number, grp, size, tag), by the same arithmetic as the library's."""
    base = "cast(ceil(sqrt(size)) as bigint)"
    levels = "select number, grp, size, tag, m, x // m as l, x % m as r from {0}"
    for i in range(P.ROUNDS):
        levels = f"select number, grp, size, tag, m, r as l, (l + ('0x' || substr(md5('{seed}' || tag || ':{i}:' || r), 1, 12))::bigint) % m as r from ({levels})"
    step = f"select number, grp, size, tag, m, l * m + r as x from ({levels})"
    first = step.format(f"(select *, {base} as m, number as x from {source})")
    return f"{name}_w as ({first} union all {step.format(f'(select * from {name}_w where x >= size)')}), {name} as (select number, grp, x as place from {name}_w where x < size)"


@query(
    "k3_permuted_batches",
    f"with recursive {fx.FRAMES}, s as (select stem, frame, row_number() over (order by stem, frame) - 1 as number, count(*) over () as size, 0 as grp, '' as tag from fx_frames), {_permuted_sql('(select number, grp, size, tag from s)', '1:0', 'p')} select stem, frame, place, place // 32 as batch_id from s join p using (number)",
)
def permuted_batches(spark, d):
    rows, n = P.numbered(fx.frames(spark, d).select("stem", "frame"), ["stem", "frame"])
    return P.epoch_batches(rows, n, 32, 1, 0).drop("number")


_COUNTS = {"positive": 1, "hard": 3, "random": 4}
_STRATUM = "case when sum(truth) > 2 then 'positive' when start % 20 = 0 then 'hard' else 'random' end"


@query(
    "k4_permuted_draws",
    f"""with recursive {fx.FRAMES}, {fx.WINDOWS}, items as (select stem, cast(start as int) as start, {_STRATUM} as stratum from fx_rows group by stem, start),
s as (select *, row_number() over (partition by stratum order by stem, start) - 1 as number, count(*) over (partition by stratum) as size, (select ceil(count(*) / 8.0) from items)::bigint as steps,
             case stratum when 'positive' then 1 when 'hard' then 3 else 4 end as per from items),
turns as (select s.*, k::int as round, concat(':', stratum, ':', k) as tag, concat(stratum, k) as grp from s, range(0, 100000) t(k) where k < ceil(steps * per / size::double)),
{_permuted_sql('(select number, grp, size, tag from turns)', '3:0', 'p')}
select stem, start, stratum, round, (round * size + place) // per as step from turns join p using (number, grp) where round * size + place < steps * per""",
)
def permuted_draws(spark, d):
    w = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum("truth").alias("p"))
    items = w.select("stem", "start", F.when(F.col("p") > 2, "positive").when(F.col("start") % 20 == 0, "hard").otherwise("random").alias("stratum"))
    ranked = kept(S.rank_within(items, ["stratum"], ["stem", "start"]).withColumn("number", F.col("rn") - 1), "items")
    sizes = {r.stratum: r.n for r in ranked.select("stratum", "n").distinct().collect()}
    return P.epoch_draws(ranked.drop("rn", "n"), sizes, _COUNTS, 8, 3).drop("number")


@query(
    "a11_summary_by_behavior",
    f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT}, r as (select s.subset, f.*, (event_type = 'none')::int as never from fx_frames f join split s using (stem) where seed = 0), b as (select subset, stem, 'truth' as behavior, truth as hit from r union all select subset, stem, 'never', never from r) select subset, behavior, count(*) as n_rows, count(distinct stem) as n_videos, sum(hit)::bigint as positives, case when sum(hit) > 0 then 'ok' when subset = 'train' then 'error' else 'warning' end as state from b group by 1, 2",
)
def summary_by_behavior(spark, d):
    rows = fx.frames(spark, d).join(splits(spark, d).where("seed = 0"), "stem").withColumn("never", (F.col("event_type") == "none").cast("int"))
    return T.dataset_summary(rows, ["truth", "never"])


@query(
    "a12_sampling_summary",
    f"""with {fx.FRAMES}, {fx.WINDOWS}, w as (select stem, start, sum(truth) as p from fx_rows group by 1, 2),
c as (select count(*) as n, count(*) filter (p > 0) as pos, count(*) filter (p = 0) as neg, count(*) filter (p = 0 and start % 20 = 0) as hard from w)
select 'uniform' as strategy, pos as n_positive_windows, neg as n_negative_windows, null::bigint as n_hard_negative_windows, null::bigint as n_random_negative_windows, ceil(n / 32.0)::bigint as steps_per_epoch, n as samples_per_epoch from c
union all select 'hard_negative_stratified', pos, neg, hard, neg - hard, ceil(n / 32.0)::bigint, ceil(n / 32.0)::bigint * 32 from c""",
)
def sampling_summary(spark, d):
    w = kept(B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum("truth").alias("positives")), "windows")
    hard = w.where("positives = 0 and start % 20 = 0")
    return T.sampling_summary(w, 32).unionByName(T.sampling_summary(w, 32, hard, (8, 8, 16)), allowMissingColumns=True)


def _batch_rows(spark, d):
    """Runs of three batches: the second lacks those of inner seed 1 and has another validation split for those of 2, the third is another subset's and has episodes of an unknown scorer."""
    runs = fx.runs(spark, d).select("outer_id", F.col("inner_seed").cast("string").alias("inner_seed")).distinct()
    of = lambda label, order, subset, level, val: runs.select(F.lit(label).alias("batch"), F.lit(order).alias("batch_ord"), "outer_id", "inner_seed", F.lit("b").alias("behavior"), F.lit(subset).alias("subset"), F.lit(level).alias("level"), F.lit("last").alias("checkpoint_policy"), F.lit("fixed:0.5").alias("threshold_policy"), F.lit("s").alias("split_signature"), val.alias("val_split_signature"))
    changed = F.when(F.col("inner_seed") == "2", "other").otherwise("v")
    return of("base", 0, "test", "frame", F.lit("v")), of("cand", 1, "test", "frame", changed).where("inner_seed <> '1'"), of("third", 2, "val", "episode", F.lit("v")).where("inner_seed = '0'")


@query(
    "j15_problems_of_batches",
    f"""with {fx.FRAMES}, {fx.runs_sql()}, r as (select distinct outer_id, inner_seed from fx_runs)
select 'cand' as batch, case inner_seed when 1 then 'missing' else 'val_split_signature' end as problem, outer_id || '/' || inner_seed || '/b/test/frame' as detail from r where inner_seed in (1, 2)
union all select 'third', 'missing', outer_id || '/' || inner_seed || '/b/test/frame' from r
union all select 'third', 'extra', outer_id || '/' || inner_seed || '/b/val/episode' from r where inner_seed = 0
union all select 'third', 'subset', 'val'
union all select 'third', 'episode_overlap_denominator', 'missing'""",
)
def problems_of_batches(spark, d):
    base, cand, third = _batch_rows(spark, d)
    scorer = {"episode_matching_method": "largest", "episode_overlap_denominator": "prediction"}
    of = lambda rows, order, config: io.batch_metadata(rows, config).withColumn("batch_ord", F.lit(order))
    metadata = of(base, 0, scorer).unionByName(of(cand, 1, scorer)).unionByName(of(third, 2, {"episode_matching_method": "largest"}))
    return S.batch_problems(base.unionByName(cand).unionByName(third), metadata)


_OF_MEMBER = "manifest_path, stem"


def _scores_sql(metric: str) -> str:
    frames = "recm as (select 'm' || member as manifest_path, stem, frame, sum(prob) / count(*) as prob, max(truth) as truth, (sum(prob) / count(*) >= 0.5)::int as pred from fx_members group by 1, 2, 3)"
    rates = "precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1"
    if metric.startswith("frame"):
        counts = "c as (select manifest_path, count(*) filter (truth = 1 and pred = 1) as tp, sum(pred) as p, sum(truth) as t from recm group by 1)"
    else:
        counts = f"""{fx.bout_sql('recm', 'pred = 1', 3, 1, _OF_MEMBER, 'pb')}, {fx.bout_sql('recm', 'truth = 1', 1, 0, _OF_MEMBER, 'tb')},
    pairs as (select p.manifest_path, p.stem, p.start_frame as pred_start, t.start_frame as true_start from pb p join tb t on p.manifest_path = t.manifest_path and p.stem = t.stem and p.start_frame <= t.end_frame and t.start_frame <= p.end_frame
              where least(p.end_frame, t.end_frame) - greatest(p.start_frame, t.start_frame) + 1 >= 0.2 * (p.end_frame - p.start_frame + 1)),
    {_matched('pairs', _OF_MEMBER)},
    c as (select manifest_path, coalesce((select sum(m) from matched x where x.manifest_path = r.manifest_path), 0) as tp, (select count(*) from pb where pb.manifest_path = r.manifest_path) as p, (select count(*) from tb where tb.manifest_path = r.manifest_path) as t from (select distinct manifest_path from recm) r)"""
    level, rate = metric.split("_")
    return f"""with recursive {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES}, {frames}, {counts},
    s as (select manifest_path, case when p > 0 then tp / p else 0 end as precision, case when t > 0 then tp / t else 0 end as recall from c), f as (select manifest_path, {rates} from s)
    select manifest_path, round({rate}, 6) as score, '{level}' as score_level, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f"""


def _candidate_frames(spark, d):
    rows = fx.member_scores(spark, d).withColumn("manifest_path", F.concat(F.lit("m"), F.col("member").cast("string")))
    return B.reconstruct(rows, 0.5, keys=("manifest_path", "stem", "frame"))


@query("t4_scores_by_frame_recall", _scores_sql("frame_recall"))
def scores_by_frame_recall(spark, d):
    return rounded(S.score_candidates(_candidate_frames(spark, d), "frame_recall"))


@query("t4_scores_by_episode_f1", _scores_sql("episode_f1"))
def scores_by_episode_f1(spark, d):
    return rounded(S.score_candidates(_candidate_frames(spark, d), "episode_f1", 0.5, 3, 1))
