
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.operators import bouts as B
from gaitline.operators import features as X
from gaitline.operators import manifests as M
from gaitline.operators import selection as S
from gaitline.operators import statistics as T
from gaitline.operators.stages import kept
from gaitline.plans import fixtures as fx
from gaitline.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles at six places, as sums differ in their last digits by the order of rows; ``nudge`` keeps sums of short decimals off the half."""
    return df.select(*[F.round(F.col(c) + nudge, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c.split('.')[-1]}" for c in columns)


XY = [f"{k}_{a}" for k in sorted(fx.POINTS) for a in "xy"]
LAG = "over (partition by stem order by frame)"


def _hyp(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def _dist(p: str, q: str) -> str:
    return _hyp(f"{p}_x - {q}_x", f"{p}_y - {q}_y")


def _angle(p: str, q: str, r: str) -> str:
    ax, ay, bx, by = f"({p}_x - {q}_x)", f"({p}_y - {q}_y)", f"({r}_x - {q}_x)", f"({r}_y - {q}_y)"
    cosine = f"(({ax} * {bx} + {ay} * {by}) / ({_hyp(ax, ay)} * {_hyp(bx, by)} + 1e-10))"
    return f"degrees(acos(case when {cosine} > 1 then 1.0 when {cosine} < -1 then -1.0 else {cosine} end))"


BL = _dist("head", "thorax")
_REL = [f"({c} - thorax_{c[-1]}) / nullif(bl, 0) as {c[:-2]}_coord_{c[-1]}" for c in XY]
_VEL = [f"coalesce({c} - lag({c}) {LAG}, 0) / nullif(bl, 0) as {c[:-2]}_velocity_{c[-1]}" for c in XY]
_ACC = [f"coalesce({c[:-2]}_velocity_{c[-1]} - lag({c[:-2]}_velocity_{c[-1]}) {LAG}, 0) as {c[:-2]}_acceleration_{c[-1]}" for c in XY]
_ANG = [f"{_angle(*p)} as angle_{'_'.join(p)}" for p in fx.CONFIG["angles"]]
_DIS = [f"{_dist(*p)} as distance_{'_'.join(p)}" for p in fx.CONFIG["distances"]]
_TIPS = f"""tips0 as (
    select *, case when abs(al) > 1e-8 then ax / al end as ux, case when abs(al) > 1e-8 then ay / al end as uy,
           {', '.join(f"case when abs(bl) > 1e-8 then ({s}_back_leg_tip_{a} - abdomen_{a}) / bl end as {s[0]}{a}" for s in ('left', 'right') for a in 'xy')}
    from (select *, {_hyp('ax', 'ay')} as al from (select *, {BL} as bl, abdomen_x - thorax_x as ax, abdomen_y - thorax_y as ay from fx_pose) q) q2
), tips1 as (
    select *, lx * ux + ly * uy as lp, ly * ux - lx * uy as lq, rx * ux + ry * uy as rp, ry * ux - rx * uy as rq, {_hyp('lx', 'ly')} as ld, {_hyp('rx', 'ry')} as rd from tips0
), tips2 as (
    select *, case when ld > 1e-8 then atan2(lq, lp) end as la, case when rd > 1e-8 then atan2(rq, rp) end as ra from tips1
), tips as (
    select stem, frame, lp as rel_back_legs_left_posterior, lq as rel_back_legs_left_lateral, rp as rel_back_legs_right_posterior, rq as rel_back_legs_right_lateral,
           {_hyp('lx - rx', 'ly - ry')} as rel_back_legs_tip_separation, (lp + rp) / 2 as rel_back_legs_midpoint_posterior, (lq + rq) / 2 as rel_back_legs_midpoint_lateral,
           (ld + rd) / 2 as rel_back_legs_mean_origin_tip_distance, abs(ld - rd) / (ld + rd + 1e-8) as rel_back_legs_distance_asymmetry,
           la / pi() as rel_back_legs_left_signed_angle, ra / pi() as rel_back_legs_right_signed_angle, abs(atan2(sin(la - ra), cos(la - ra))) / pi() as rel_back_legs_angle_asymmetry
    from tips2
)"""
_MOTION = f"""base as (select *, {BL} as bl from fx_pose), moved as (select *, {', '.join(_REL + _VEL + _ANG + _DIS)} from base), motion as (select *, {', '.join(_ACC)} from moved)"""
_COLS = [*[f"{c[:-2]}_coord_{c[-1]}" for c in XY], *[f"{c[:-2]}_velocity_{c[-1]}" for c in XY], *[f"{c[:-2]}_acceleration_{c[-1]}" for c in XY], *["angle_" + "_".join(p) for p in fx.CONFIG["angles"]], *["distance_" + "_".join(p) for p in fx.CONFIG["distances"]]]
_FAMILY = [c for f in X.FAMILIES for c in X.family_columns(_COLS, f)]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pose_features(fx.pose(spark, sf_dir), fx.CONFIG)


# --- features --------------------------------------------------------------------------------------


@query("p1_relative_coordinates", f"with {fx.POSE}, {_MOTION} select stem, frame, {r6(*[c for c in _COLS if '_coord_' in c])} from motion")
def p1(spark, d):
    out = features(spark, d)
    return rounded(out.select("stem", "frame", *[c for c in out.columns if "_coord_" in c]))


@query("w1_w2_velocity_acceleration", f"with {fx.POSE}, {_MOTION} select stem, frame, {r6(*[c for c in _COLS if '_velocity_' in c or '_acceleration_' in c])} from motion")
def w1(spark, d):
    out = features(spark, d)
    return rounded(out.select("stem", "frame", *X.family_columns(out.columns, "velocity"), *X.family_columns(out.columns, "acceleration")))


@query("g1_g2_distance_angle", f"with {fx.POSE}, {_MOTION} select stem, frame, {r6(*[c for c in _COLS if c.startswith(('angle_', 'distance_'))])} from motion")
def g1(spark, d):
    out = features(spark, d)
    return rounded(out.select("stem", "frame", *X.family_columns(out.columns, "angle"), *X.family_columns(out.columns, "distance")))


@query("g3_g4_bilateral_tips", f"with {fx.POSE}, {_TIPS} select stem, frame, {r6(*[f'rel_back_legs_{s}' for s in G.TIP_SUFFIXES])} from tips")
def g4(spark, d):
    out = features(spark, d)
    return rounded(out.select("stem", "frame", *[f"rel_back_legs_{s}" for s in G.TIP_SUFFIXES]))


_TURN = "rel_back_legs_left_signed_angle"
_SEP = "rel_back_legs_tip_separation"


def _delta(c: str, k: int) -> str:
    change = f"{c} - lag({c}, {k}) {LAG}"
    change = f"atan2(sin(pi() * ({change})), cos(pi() * ({change}))) / pi()" if c == _TURN else change
    return f"round(case when row_number() {LAG} <= {k} and {c} is not null then 0.0 else {change} end, 6) as {c}_delta_lag{k}"


@query("g5_g6_w3_lagged_deltas", f"with {fx.POSE}, {_TIPS} select stem, frame, {', '.join(_delta(c, k) for k in (1, 4) for c in (_TURN, _SEP))} from tips")
def w3(spark, d):
    out = features(spark, d)
    return rounded(out.select("stem", "frame", *[f"{c}_delta_lag{k}" for k in (1, 4) for c in (_TURN, _SEP)]))


@query("w4_frame_numbers", "select concat('v', user_id) as stem, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame from events")
def w4(spark, d):
    rows = fx.table(spark, d, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("stem"), "ts", "event_id")
    return X.number_frames(rows, ["ts", "event_id"]).drop("ts")


@query("p2_a1_s18_fit_scalers", f"with {fx.POSE}, {_MOTION}, u as (" + " union all ".join(f"select '{f}' as family, '{c}' as column_name, avg({c}) as mean, stddev_pop({c}) as s from motion" for f in X.FAMILIES for c in X.family_columns(_COLS, f)) + ") select family, column_name, round(mean, 6) as mean, round(case when s = 0 then 1.0 else s end, 6) as scale from u")
def a1(spark, d):
    return rounded(X.fit_scalers(features(spark, d)).withColumnRenamed("column", "column_name"))


@query("p9_standardise", f"with {fx.POSE}, {_MOTION} select stem, frame, {', '.join(f'round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 6) as {c}' for c in _FAMILY)} from motion")
def p9(spark, d):
    out = features(spark, d)
    return rounded(X.standardise(out, X.fit_scalers(out)).select("stem", "frame", *_FAMILY))


@query("p21_impute_means", f"with {fx.POSE}, {_MOTION} select stem, frame, {', '.join(f'round(coalesce({c}, avg({c}) over (partition by stem)), 6) as {c}' for c in _COLS)} from motion")
def p21(spark, d):
    return rounded(X.impute_means(features(spark, d)).select("stem", "frame", *_COLS))


@query("p3_behavior_columns", f"with {fx.POSE}, {_MOTION} select stem, frame, {r6(*_COLS)} from motion")
def p3(spark, d):
    out = features(spark, d)
    kept = X.behavior_columns(out.columns, fx.CONFIG, "b1")  # the back legs are b0's
    return rounded(out.select(*[c for c in kept if not X.is_absolute_coordinate(c) and not c.endswith("_probability")]))


@query("p4_p8_drop_absolute", f"with {fx.POSE}, {_MOTION} select stem, frame, {r6(*_COLS)}, round(head_p, 6) as head_probability from motion")
def p4(spark, d):
    out = features(spark, d)
    if X.non_numeric(out):
        raise ValueError("a model takes numbers only")
    return rounded(X.drop_absolute(out.drop(*[c for c in out.columns if c.startswith("rel_")])))


@query("p5_p6_p7_align_zero_fill", f"with {fx.POSE}, {_MOTION} select stem, frame, {', '.join(f'round(coalesce({c}, 0), 6) as {c}' for c in _FAMILY)}, ({' + '.join(f'({c} is null)::int' for c in _FAMILY)})::int as n_filled from motion")
def p7(spark, d):
    out = features(spark, d).select("stem", "frame", *_FAMILY)
    aligned = X.align(out, _FAMILY)
    _, missing = X.zero_fill(aligned, _FAMILY)
    counted = aligned.withColumn("n_filled", missing)
    return rounded(X.zero_fill(counted, _FAMILY)[0])


def _noise(c: str, seed: int) -> str:
    h = f"md5(concat('{seed}:{c}:', stem, ':', frame))"
    part = lambda at: f"((('0x' || substring({h}, {at}, 8))::bigint + 0.5) / 4294967296.0)"
    return f"sqrt(-2.0 * ln({part(1)})) * cos(2 * pi() * {part(9)})"


@query("p11_augment", f"with {fx.POSE} select stem, frame, {', '.join(f'round({c} + 0.5 * {_noise(c, 7)}, 6) as {c}' for c in XY)} from fx_pose")
def p11(spark, d):
    return rounded(X.augment(features(spark, d).select("stem", "frame", *XY), XY, X.noise_for({"keypoint_noise_std": {"b0": 0.5}}, "b0"), 7))


@query("p13_infer_behaviors", f"with {fx.FRAMES} select stem, frame, 'a' as behavior, round(prob, 6) as prob from fx_frames union all select stem, frame, 'b', round(1 - prob, 6) from fx_frames")
def p13(spark, d):
    wide = fx.frames(spark, d).select("stem", "frame", F.col("prob").alias("prob_a"), (1 - F.col("prob")).alias("prob_b"))
    return rounded(io.unpivot_predictions(wide))


@query("p12_p14_subset_seconds", f"with {fx.FRAMES} select stem, frame, round(frame / 25.0, 6) as seconds, round(prob, 6) as prob from fx_frames where stem in ('v1', 'v2', 'v3')")
def p14(spark, d):
    rows = io.subset_predictions(fx.frames(spark, d).select("stem", "frame", F.col("prob").alias("prob_b"), F.col("truth").alias("true_c"), F.lit(0.0).alias("prob_c")), ["v1", "v2", "v3"], ["b"])
    return rounded(rows.select("stem", "frame", io.time_axis(25.0).alias("seconds"), F.col("prob_b").alias("prob")))


# --- annotations -----------------------------------------------------------------------------------

_PAIRS = """pairs as (select stem, behavior, start, image_index as stop from (
    select *, lag(event_type) over w as before, lag(image_index) over w as start from fx_annotations window w as (partition by stem, behavior order by image_index, event_type)) q
    where event_type = 'STOP' and before = 'START')"""
_LABELS = f"""labelled as (select f.stem, f.frame, {', '.join(f"coalesce(max(case when p.behavior = '{b}' then 1 end), 0) as {b}" for b in ('b0', 'b1'))}
    from fx_frames f left join pairs p on p.stem = f.stem and f.frame >= p.start and f.frame < p.stop group by 1, 2)"""


@query("s3_w7_pair_events", f"with {fx.FRAMES}, {fx.ANNOTATIONS}, {_PAIRS} select * from pairs")
def w7(spark, d):
    raw = fx.annotations(spark, d).withColumns({"behavior": F.concat(F.lit(" "), "behavior"), "event_type": F.lower("event_type")})
    return B.pair_events(io.clean_annotations(raw, ["b0", "b1"]))


def labels(spark, d):
    return B.label_frames(fx.frames(spark, d), B.pair_events(fx.annotations(spark, d)), ["b0", "b1"])


@query("j2_label_frames", f"with {fx.FRAMES}, {fx.ANNOTATIONS}, {_PAIRS}, {_LABELS} select * from labelled")
def j2(spark, d):
    return labels(spark, d)


@query("s5_reconcile_labels", f"with {fx.FRAMES}, {fx.ANNOTATIONS}, {_PAIRS}, {_LABELS} select f.stem, f.frame, round(prob, 6) as prob, coalesce(b1, 0) as b1, 0 as b2 from fx_frames f left join labelled l using (stem, frame)")
def s5(spark, d):
    return rounded(B.reconcile_labels(fx.frames(spark, d).select("stem", "frame", "prob"), labels(spark, d), ["b1", "b2"]))


@query("j1_label_mismatches", f"with {fx.FRAMES} select stem, frame, 'labels' as missing_in from fx_frames where event_id % 7 = 0 union all select stem, frame + 100000, 'features' from fx_frames where event_id % 11 = 0")
def j1(spark, d):
    f = fx.frames(spark, d)
    own = f.where("event_id % 7 <> 0").select("stem", "frame").union(f.where("event_id % 11 = 0").select("stem", F.col("frame") + 100000))
    return B.label_mismatches(f, own)


@query("j3_merge_behaviors", f"with {fx.FRAMES} select stem, frame, truth as true_a, round(prob, 6) as prob_a, (prob >= 0.5)::int as pred_a, case when frame % 2 = 0 then 1 - truth end as true_b, case when frame % 2 = 0 then round(1 - prob, 6) end as prob_b, case when frame % 2 = 0 then (1 - prob >= 0.5)::int end as pred_b from fx_frames")
def j3(spark, d):
    f = fx.frames(spark, d)
    a = f.select("stem", "frame", F.lit("a").alias("behavior"), "truth", "prob", (F.col("prob") >= 0.5).cast("int").alias("pred"))
    b = f.where("frame % 2 = 0").select("stem", "frame", F.lit("b").alias("behavior"), (1 - F.col("truth")).alias("truth"), (1 - F.col("prob")).alias("prob"), (1 - F.col("prob") >= 0.5).cast("int").alias("pred"))
    return rounded(B.merge_behaviors(a.unionByName(b), ["a", "b"]))


# --- windows and scoring ---------------------------------------------------------------------------


@query("a3_window_count", f"with {fx.FRAMES} select stem, count(*) as n, cast(case when count(*) < 10 then 0 else 1 + floor((count(*) - 10) / 5.0) end as bigint) as windows from fx_frames group by stem")
def a3(spark, d):
    return fx.frames(spark, d).groupBy("stem").agg(F.count(F.lit(1)).alias("n")).withColumn("windows", B.window_count(F.col("n"), fx.WINDOW, fx.STRIDE))


@query("a2_s20_windows", f"with {fx.FRAMES}, {fx.WINDOWS} select stem, cast(start as int) as start, round(sum(prob * (pos + 1)), 6) as weighted, count(*) as n_rows, cast(sum(truth) as bigint) as positives from fx_rows group by 1, 2")
def a2(spark, d):
    w = B.window_arrays(fx.frames(spark, d), ["prob"], fx.WINDOW, fx.STRIDE, "truth")
    # float features would show in the sums: the weights use the exact column again
    rows = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum(F.col("prob") * (F.col("pos") + 1)).alias("weighted"))
    sums = w.select("stem", "start", F.size("x").cast("long").alias("n_rows"), F.aggregate("y", F.lit(0).cast("long"), lambda a, y: a + y).alias("positives"))
    return rounded(sums.join(rows, ["stem", "start"]))


@query("a12_window_strata", f"with {fx.FRAMES}, {fx.WINDOWS}, w as (select stem, start, sum(truth) as p from fx_rows group by 1, 2) select count(*) filter (p > 0) as positive, count(*) filter (p = 0) as negative, cast(ceil(count(*) / 32.0) as bigint) as steps from w")
def a12(spark, d):
    w = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum("truth").alias("p"))
    return w.agg(F.count_if(F.col("p") > 0).alias("positive"), F.count_if(F.col("p") == 0).alias("negative"), F.ceil(F.count(F.lit(1)) / 32).alias("steps"))


@query("a13_window_norms", f"with {fx.FRAMES}, {fx.WINDOWS}, w as (select stem, start, min(abs(prob)) as lo, max(abs(prob)) as hi, sum(abs(prob)) as total, count(*) as n from fx_rows group by 1, 2) select stem, round(min(lo), 6) as min_norm, round(max(hi), 6) as max_norm, round(sum(total) / sum(n) + 1e-9, 6) as mean_norm, count(*) filter (hi = 0) as zero_windows, count(*) as windows from w group by stem")
def a13(spark, d):
    return rounded(B.window_norms(fx.frames(spark, d), ["prob"], fx.WINDOW, fx.STRIDE), 1e-9)


@query("a26_restored_windows", f"with {fx.FRAMES}, {fx.WINDOWS}, w as (select stem, count(distinct start) as restored from fx_rows group by 1), n as (select stem, cast(case when count(*) < 10 then 0 else 1 + (count(*) - 10) // 5 end as bigint) as recorded from fx_frames group by 1) select stem, recorded, coalesce(restored, 0) as restored, recorded = coalesce(restored, 0) as valid from n left join w using (stem)")
def a26(spark, d):
    windows = B.window_arrays(fx.frames(spark, d), ["prob"], fx.WINDOW, fx.STRIDE)
    return B.restored_windows(windows, a3(spark, d).select("stem", F.col("windows").alias("recorded")), fx.WINDOW, 1)


@query("u1_score_windows", f"with {fx.FRAMES}, {fx.WINDOWS} select stem, cast(start as int) as start, round(sum(prob::float::double * prob::float::double) + 1e-9, 6) as total, count(*) as n from fx_rows group by 1, 2")
def u1(spark, d):
    w = B.window_arrays(fx.frames(spark, d), ["prob"], fx.WINDOW, fx.STRIDE)
    scored = B.score_windows(w, lambda x: [[float(f[0]) ** 2 for f in rows] for rows in x])
    return scored.select("stem", "start", F.round(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p) + 1e-9, 6).alias("total"), F.size("probs").cast("long").alias("n"))


_ENSEMBLE = "recon as (select stem, frame, sum(prob) / count(*) as prob, max(truth) as truth, (sum(prob) / count(*) >= 0.5)::int as pred from fx_members group by 1, 2)"


def reconstructed(spark, d):
    return B.reconstruct(fx.member_scores(spark, d), 0.5)


@query("j4_u2_recusal", f"with {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES} select member, stem, count(*) as n_rows, round(sum(prob), 6) as total from fx_members group by 1, 2")
def j4(spark, d):
    return rounded(fx.member_scores(spark, d).groupBy("member", "stem").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("prob").alias("total")))


@query("a4_a5_p10_reconstruct", f"with {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES}, {_ENSEMBLE} select stem, frame, round(prob + 1e-9, 6) as prob, truth, pred from recon")
def a4(spark, d):
    return rounded(reconstructed(spark, d), 1e-9)


@query("a6_coverage", f"with {fx.FRAMES}, {fx.WINDOWS}, t as (select stem, max(start) + 10 as n from fx_rows group by 1), s as (select stem, count(distinct frame) as c from fx_rows where user_id % 10 <> 1 group by 1), b as (select n, coalesce(c, 0) as c from t left join s using (stem)) select cast(sum(n) as bigint) as n_total_frames, cast(sum(c) as bigint) as n_scored_frames, count(*) as n_total_videos, count(*) filter (c > 0) as n_scored_videos, round(sum(c) / sum(n), 6) as frame_coverage, count(*) filter (c = 0) as n_fully_recused_videos from b")
def a6(spark, d):
    rows = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE)
    return rounded(B.coverage(rows, B.reconstruct(rows.where("user_id % 10 <> 1"), 0.5), fx.WINDOW))


@query("a16_window_level_metrics", f"with {fx.FRAMES}, {fx.WINDOWS}, c as (select count(*) filter (truth = 1 and prob > 0.5) as tp, count(*) filter (truth = 0 and prob > 0.5) as fp, count(*) filter (truth = 1 and prob <= 0.5) as fn, count(*) filter (truth = 0 and prob <= 0.5) as tn from fx_rows) select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy from c")
def a16(spark, d):
    rows = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    return rounded(B.binary_metrics(rows, []))


@query("u3_baseline_scorer")
def u3(spark, d):
    """A weighted logistic model on lags and leads of the frame's value, fitted on two thirds of the videos."""
    rows = fx.frames(spark, d)
    return B.fit_baseline(rows, fitted=F.crc32(F.encode("stem", "UTF-8")).__mod__(3) < 2)(rows)


_MEMBER_SUM = "least(1.0, prob::float::double * (0.9 + 0.1 * m))"


@query("u2_member_scores", f"with {fx.FRAMES}, {fx.WINDOWS} select m as member, stem, cast(start as int) as start, cast(frame as int) as frame, round({_MEMBER_SUM} + 1e-9, 6) as prob from fx_rows, range(3) t(m) where user_id % 10 <> m")
def u2(spark, d):
    """Three members score the windows of videos that they have not seen, each with its own scorer."""
    windows = B.window_arrays(fx.frames(spark, d), ["prob"], fx.WINDOW, fx.STRIDE)
    scorer = lambda m: lambda x: [[min(1.0, float(f[0]) * (0.9 + 0.1 * m)) for f in rows] for rows in x]
    scored = B.score_members(windows, {m: scorer(m) for m in range(3)}, fx.seen_stems(spark, d))
    return rounded(B.scored_frames(scored).select("member", "stem", "start", F.col("frame").cast("int").alias("frame"), "prob"), 1e-9)


# --- bouts and episode metrics ---------------------------------------------------------------------


@query("w5_bouts", f"with {fx.FRAMES}, {fx.bout_sql('fx_frames', 'prob >= 0.4', 3, 1)} select stem, start_frame, end_frame, n_positive from fx_bouts")
def w5(spark, d):
    return B.bouts(fx.frames(spark, d), F.col("prob") >= 0.4, 3, 1).select("stem", "start_frame", "end_frame", "n_positive")


@query("w6_simple_runs", f"with {fx.FRAMES}, {fx.bout_sql('fx_frames', 'truth = 1', 1, 0)} select stem, start_frame, end_frame, n_positive from fx_bouts")
def w6(spark, d):
    return B.bouts(fx.frames(spark, d), F.col("truth") == 1, 1, 0).select("stem", "start_frame", "end_frame", "n_positive")


@query("a10_bout_table", f"with {fx.FRAMES}, {fx.bout_sql('fx_frames', 'prob >= 0.4', 3, 1)} select b.stem, start_frame, end_frame, count(*) as n_frames, round(avg(prob), 6) as mean_probability, round(max(prob), 6) as max_probability from fx_bouts b join fx_frames f on f.stem = b.stem and frame between start_frame and end_frame group by 1, 2, 3")
def a10(spark, d):
    return rounded(B.bout_table(fx.frames(spark, d), F.col("prob") >= 0.4, 3, 1))


_CELLS = "count(*) filter (truth = 1 and pred = 1) as tp, count(*) filter (truth = 0 and pred = 1) as fp, count(*) filter (truth = 1 and pred = 0) as fn, count(*) filter (truth = 0 and pred = 0) as tn"
_METRIC = "tp, fp, fn, tn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) as accuracy"


@query("a7_binary_metrics", f"with {fx.FRAMES}, p as (select *, (prob >= 0.5)::int as pred from fx_frames), c as (select stem, {_CELLS} from p group by 1) select stem, {_METRIC} from c")
def a7(spark, d):
    return rounded(B.binary_metrics(fx.frames(spark, d).withColumn("pred", (F.col("prob") >= 0.5).cast("int")), ["stem"]))


@query("a9_macro_average", f"with {fx.FRAMES}, p as (select event_type, truth, (prob >= 0.5)::int as pred from fx_frames), c as (select event_type, {_CELLS} from p group by 1), m as (select 'frame' as level, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end as f1 from c) select level, round(avg(f1), 6) as macro_f1, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall from m group by 1")
def a9(spark, d):
    rows = B.binary_metrics(fx.frames(spark, d).withColumn("pred", (F.col("prob") >= 0.5).cast("int")), ["event_type"])
    return rounded(B.macro_average(rows.withColumn("level", F.lit("frame"))))


_PRED = fx.bout_sql("fx_frames", "prob >= 0.4", 3, 1, name="pb")
_TRUE = fx.bout_sql("fx_frames", "truth = 1", 1, 0, name="tb")
_ELIGIBLE = "pairs as (select p.stem, p.start_frame as pred_start, p.end_frame as pred_end, t.start_frame as true_start, t.end_frame as true_end, least(p.end_frame, t.end_frame) - greatest(p.start_frame, t.start_frame) + 1 as overlap from pb p join tb t on p.stem = t.stem and p.start_frame <= t.end_frame and t.start_frame <= p.end_frame where least(p.end_frame, t.end_frame) - greatest(p.start_frame, t.start_frame) + 1 >= 0.2 * (p.end_frame - p.start_frame + 1))"


def episodes(spark, d):
    f = fx.frames(spark, d)
    return B.bouts(f, F.col("prob") >= 0.4, 3, 1), B.bouts(f, F.col("truth") == 1, 1, 0)


@query("g8_j5_eligible_pairs", f"with {fx.FRAMES}, {_PRED}, {_TRUE}, {_ELIGIBLE} select * from pairs")
def j5(spark, d):
    return B.eligible_pairs(*episodes(spark, d))


@query("j6_match_bouts")
def j6(spark, d):
    return B.match_bouts(B.eligible_pairs(*episodes(spark, d)))


@query("j7_bout_errors")
def j7(spark, d):
    pred, truth = episodes(spark, d)
    return B.bout_errors(pred, truth, B.match_bouts(B.eligible_pairs(pred, truth)))


_LONE = "lone as (select * from (select *, count(*) over (partition by stem, pred_start) as np, count(*) over (partition by stem, true_start) as nt from pairs) q where np = 1 and nt = 1)"


@query("j7_errors_of_given_matches", f"with {fx.FRAMES}, {_PRED}, {_TRUE}, {_ELIGIBLE}, {_LONE} select stem, start_frame, end_frame, 'false_positive' as error_type from pb where not exists (select 1 from lone l where l.stem = pb.stem and l.pred_start = pb.start_frame) union all select stem, start_frame, end_frame, 'false_negative' from tb where not exists (select 1 from lone l where l.stem = tb.stem and l.true_start = tb.start_frame)")
def j7b(spark, d):
    pred, truth = episodes(spark, d)
    p, t = Window.partitionBy("stem", "pred_start"), Window.partitionBy("stem", "true_start")
    lone = B.eligible_pairs(pred, truth).select("*", F.count(F.lit(1)).over(p).alias("np"), F.count(F.lit(1)).over(t).alias("nt")).where("np = 1 and nt = 1")
    return B.bout_errors(pred, truth, lone)


def _matched(pairs: str, keys: str = "stem", name: str = "matched") -> str:
    """CTEs (recursive) that end in ``name``: keys and m, the largest number of one-to-one matches, from the left to the right."""
    same = " and ".join(f"w.{k} = e.{k}" for k in keys.split(", "))
    return f"""{name}_e as (select *, row_number() over (partition by {keys} order by pred_start, true_start) as rn from {pairs}),
    {name}_w as (select {keys}, rn, pred_start, true_start, 1 as m from {name}_e where rn = 1
        union all select {', '.join(f'e.{k}' for k in keys.split(', '))}, e.rn, case when w.pred_start = e.pred_start or w.true_start = e.true_start then w.pred_start else e.pred_start end,
            case when w.pred_start = e.pred_start or w.true_start = e.true_start then w.true_start else e.true_start end,
            w.m + case when w.pred_start = e.pred_start or w.true_start = e.true_start then 0 else 1 end
        from {name}_w w join {name}_e e on {same} and e.rn = w.rn + 1),
    {name} as (select {keys}, max(m) as m from {name}_w group by {keys})"""


def _episodes_of(by: str = "") -> str:
    """Columns of episode metrics from a row (tp, p, t)."""
    rates = "case when p > 0 then tp / p else 0.0 end as precision, case when t > 0 then tp / t else 0.0 end as recall, case when tp > 0 then 2.0 * tp / (p + t) else 0.0 end as f1"
    return f"select {by}cast(tp as bigint) as tp, cast(p - tp as bigint) as fp, cast(t - tp as bigint) as fn, {rates}, cast(p as bigint) as n_predicted_episodes, cast(t as bigint) as n_true_episodes"


_EPISODE_COLS = "tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, n_predicted_episodes, n_true_episodes"


@query("a8_episode_metrics", f"with recursive {fx.FRAMES}, {_PRED}, {_TRUE}, {_ELIGIBLE}, {_matched('pairs')}, s as (select (select coalesce(sum(m), 0) from matched) as tp, (select count(*) from pb) as p, (select count(*) from tb) as t), e as ({_episodes_of()} from s) select {_EPISODE_COLS} from e")
def a8(spark, d):
    return rounded(B.episode_metrics(*episodes(spark, d)))


@query("g9_focal_loss", f"with {fx.FRAMES}, p as (select event_type, truth, case when prob > 1 - 1e-7 then 1 - 1e-7 when prob < 1e-7 then 1e-7 else prob end as q from fx_frames) select event_type, round(avg(case when truth = 1 then -0.7 * pow(1 - q, 2) * ln(q) else -0.3 * pow(q, 2) * ln(1 - q) end), 6) as loss from p group by 1")
def g9(spark, d):
    return rounded(fx.frames(spark, d).groupBy("event_type").agg(F.avg(G.focal_loss(F.col("truth"), F.col("prob"))).alias("loss")))


# --- thresholds ------------------------------------------------------------------------------------

_ORDER = "f1 desc, least(precision, recall) desc, precision desc, recall desc, abs(threshold - 0.5), threshold"


@query("p19_threshold_grid", f"with {fx.FRAMES}, t as (select distinct round(0.35::double + k * 0.01::double, 10) as threshold from range(41) q(k)) select threshold, count(*) filter (prob >= threshold) as positives from fx_frames, t group by 1")
def p19(spark, d):
    # how many frames each threshold lets through: the grid alone would be a fixed small table
    return S.threshold_counts(fx.frames(spark, d), S.threshold_grid(spark), []).select("threshold", (F.col("tp") + F.col("fp")).alias("positives"))


@query("j14_threshold_sweep", f"with {fx.FRAMES}, t as (select distinct round(0.35::double + k * 0.05::double, 10) as threshold from range(9) q(k)), x as (select stem, frame, threshold, prob from fx_frames, t), {fx.bout_sql('x', 'prob >= threshold', 3, 1, 'stem, threshold')} select threshold, count(*) as n_bouts, cast(sum(n_positive) as bigint) as positives from fx_bouts group by 1")
def j14(spark, d):
    return B.bouts_at(fx.frames(spark, d), S.threshold_grid(spark, 0.35, 0.75, 0.05), 3, 1).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_bouts"), F.sum("n_positive").alias("positives"))


@query("fx_runs_metrics", f"with {fx.FRAMES}, {fx.runs_sql()} select outer_id, outer_seed, inner_seed, threshold, tp, fp, fn, tn, {r6('precision', 'recall', 'f1', 'accuracy')} from fx_runs")
def runs(spark, d):
    return rounded(fx.runs(spark, d))


@query("p16_p17_w9_best_threshold", f"with {fx.FRAMES}, {fx.runs_sql()}, k as (select *, row_number() over (partition by outer_id, inner_seed order by {_ORDER}) as rn from fx_runs) select outer_id, cast(inner_seed as varchar) as inner_seed, threshold, round(f1, 6) as validation_f1, round(precision, 6) as validation_precision, round(recall, 6) as validation_recall from k where rn = 1")
def w9(spark, d):
    raw = fx.runs(spark, d).select(F.col("outer_id").alias("outer_split"), F.concat(F.lit("inner_seed"), F.col("inner_seed").cast("string")).alias("inner_split"), "threshold", "f1", "precision", "recall")
    # each row three times: what is of another behaviour or level would win every run, and is filtered away
    kinds = F.explode(F.array(*[F.struct(F.lit(b).alias("behavior"), F.lit(l).alias("level")) for b, l in (("b", "episode"), ("other", "episode"), ("b", "frame"))]))
    sweep = raw.select("*", kinds.alias("kind")).select("*", "kind.*").drop("kind").withColumn("f1", F.when((F.col("behavior") == "b") & (F.col("level") == "episode"), F.col("f1")).otherwise(1.0))
    return rounded(S.best_per_run(S.normalise_run_keys(S.select_sweep_rows(sweep, "b"))))


@query("g10_w10_best_epochs", f"with {fx.FRAMES}, {fx.runs_sql()}, c as (select outer_seed * 4 + inner_seed as epoch, * from fx_runs), k as (select *, row_number() over (partition by epoch order by {_ORDER}) = 1 as selected_for_epoch, row_number() over (order by {_ORDER}, epoch) = 1 as selected from c) select epoch, threshold, {r6('f1', 'precision', 'recall')}, selected_for_epoch, selected from k")
def w10(spark, d):
    return rounded(S.best_epochs(fx.runs(spark, d).select((F.col("outer_seed") * 4 + F.col("inner_seed")).alias("epoch"), "threshold", "f1", "precision", "recall")))


@query("a17_training_history", f"with {fx.FRAMES}, h as (select frame as epoch, avg(prob) as loss, avg(abs(prob - truth)) as val_loss from fx_frames group by 1) select (select epoch from h order by val_loss, epoch limit 1) as best_epoch, round(min(val_loss), 6) as best_val_loss, count(*) as epochs_completed, round(arg_max(loss, epoch), 6) as final_loss, round(arg_max(val_loss, epoch), 6) as final_val_loss from h")
def a17(spark, d):
    h = fx.frames(spark, d).groupBy(F.col("frame").alias("epoch")).agg(F.avg("prob").alias("loss"), F.round(F.avg(F.abs(F.col("prob") - F.col("truth"))), 12).alias("val_loss"))
    return rounded(S.training_history(h))


_BEST = f"best as (select * from (select *, row_number() over (partition by outer_id, inner_seed order by {_ORDER}) as rn from fx_runs) q where rn = 1)"


def best(spark, d):
    return S.best_per_run(fx.runs(spark, d))


@query("j10_p20_threshold_map", f"with {fx.FRAMES}, {fx.runs_sql()}, {_BEST}, r as (select distinct outer_id, inner_seed from fx_runs) select r.outer_id, r.inner_seed, case r.inner_seed when 0 then 0.5 when 1 then round(b.threshold - 0.3, 6) else b.threshold end as threshold, case r.inner_seed when 0 then 'disabled' when 3 then 'invalid' end as threshold_problem from r left join best b on b.outer_id = r.outer_id and b.inner_seed = r.inner_seed")
def j10(spark, d):
    """The map has the runs of inner seeds 2 and 3; checkpoints of seed 1 have selected one, those of 3 a bad one, those of 0 none."""
    keys = ["outer_id", "inner_seed"]
    found = best(spark, d)
    number = F.when(F.col("inner_seed") == 3, F.lit("1.5")).otherwise(F.round(F.col("threshold") - 0.3, 6).cast("string"))
    text = F.concat(F.lit('{"training_run":{"checkpoint_selection":{"enabled":'), F.when(F.col("inner_seed") == 0, "false").otherwise("true"), F.lit(',"selected":{"threshold":'), number, F.lit("}}}}"))
    runs = M.selected_thresholds(found.select(*keys, text.alias("manifest"))).drop("manifest")
    both, lost = S.join_threshold_map(runs, found.where("inner_seed > 1").select(*keys, F.col("threshold").alias("map_threshold")), keys)
    rest = runs.join(lost.where("missing_in = 'map'"), keys, "left_semi").withColumn("map_threshold", F.lit(None).cast("double"))
    return both.unionByName(rest).select(*keys, S.resolve_threshold().alias("threshold"), "threshold_problem")


@query("s11_threshold_map_problems", f"with {fx.FRAMES}, {fx.runs_sql()}, {_BEST} select outer_id, inner_seed, 'threshold' as problem from best where inner_seed = 1 union all select outer_id, inner_seed, 'repeated' from best where inner_seed = 2")
def s11(spark, d):
    b = best(spark, d).select("outer_id", "inner_seed", F.when(F.col("inner_seed") == 1, F.lit("1.5")).otherwise(F.col("threshold").cast("string")).alias("threshold"))
    return io.threshold_map_problems(b.unionByName(b.where("inner_seed = 2")), ["outer_id", "inner_seed"])


# --- hard negatives --------------------------------------------------------------------------------

_NEG = f"""neg_rows as (select *, case when event_type = 'signup' then 1 else 0 end as hit from fx_rows),
neg as (select stem, start, max(prob) as max_probability, avg(prob) as mean_probability from neg_rows group by 1, 2 having sum(hit) = 0),
rolled as (select stem, start, avg(prob) over (partition by stem, start order by pos rows between 3 preceding and current row) as m, pos from neg_rows),
scores as (select n.stem, cast(n.start as int) as start, max(m) as hardness, any_value(max_probability) as max_probability, any_value(mean_probability) as mean_probability from neg n join rolled r on r.stem = n.stem and r.start = n.start and r.pos >= 3 group by 1, 2)"""


def negatives(spark, d):
    rows = B.window_rows(fx.frames(spark, d).withColumn("hit", (F.col("event_type") == "signup").cast("tinyint")), fx.WINDOW, fx.STRIDE)
    w = rows.groupBy("stem", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "prob", "hit"))).alias("w")).select("stem", "start", F.transform("w", lambda s: s["prob"]).alias("probs"), F.transform("w", lambda s: s["hit"]).alias("y"))
    return S.score_negatives(w, 4)


def ranked_negatives(spark, d):
    # six places before any order, so that sums in another order can't swap rows
    return rounded(negatives(spark, d))


@query("g7_a14_negative_scores", f"with {fx.FRAMES}, {fx.WINDOWS}, {_NEG} select stem, start, {r6('hardness', 'max_probability', 'mean_probability')} from scores")
def a14(spark, d):
    return ranked_negatives(spark, d)


_R = "six as (select stem, start, round(hardness, 6) as hardness, round(max_probability, 6) as max_probability, round(mean_probability, 6) as mean_probability from scores)"


@query("w8_hardness_rank", f"with {fx.FRAMES}, {fx.WINDOWS}, {_NEG}, {_R} select *, row_number() over (order by hardness desc, max_probability desc, stem, start) as hardness_rank from six")
def w8(spark, d):
    return S.global_rank(ranked_negatives(spark, d), S.hard_order(), "hardness_rank").withColumn("hardness_rank", F.col("hardness_rank").cast("long"))


@query("a15_score_distribution", f"with {fx.FRAMES}, {fx.WINDOWS}, {_NEG}, {_R} select min(hardness) as min_hardness, round(median(hardness), 6) as median_hardness, max(hardness) as max_hardness from six")
def a15(spark, d):
    return rounded(T.score_distribution(kept(ranked_negatives(spark, d), "scores")))


_THIN = """o as (select *, row_number() over (partition by stem order by hardness desc, max_probability desc, start) as rn from six),
    w as (select stem, rn, [start] as taken from o where rn = 1
        union all select o.stem, o.rn, case when len(list_filter(w.taken, lambda x: abs(x - o.start) < 10)) = 0 then list_append(w.taken, o.start) else w.taken end from w join o on o.stem = w.stem and o.rn = w.rn + 1),
    k as (select stem, unnest(arg_max(taken, rn)) as start from w group by stem)"""


@query("t1_diverse_pool", f"with recursive {fx.FRAMES}, {fx.WINDOWS}, {_NEG}, {_R}, {_THIN}, n as (select count(*) as n from six), r as (select six.*, row_number() over (order by hardness desc, max_probability desc, six.stem, six.start) as place from six join k on k.stem = six.stem and k.start = six.start) select r.* exclude (place), cast(place as bigint) as pool_rank from r, n where place <= ceil(n.n * 0.5)")
def t1(spark, d):
    return S.diverse_pool(ranked_negatives(spark, d), 0.5, fx.WINDOW)


@query("j12_pool_flags", f"with {fx.FRAMES}, {fx.WINDOWS}, {_NEG}, {_R} select *, start % 10 = 0 as in_pool from six")
def j12(spark, d):
    n = ranked_negatives(spark, d)
    return S.flag_selected(n, n.where("start % 10 = 0"))


@query("j9_pool_problems", f"with {fx.FRAMES}, {fx.WINDOWS}, w as (select stem, cast(start as int) as start, sum(truth) as positives from fx_rows group by 1, 2) select stem, start, 'positive' as problem from w where start = 0 and positives > 0 union all select stem, start, 'repeated' from w where start = 0 and stem like '%5' union all select stem, start + 1, 'unmatched' from w where start = 5")
def j9(spark, d):
    w = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum("truth").alias("positives"))
    zero = w.where("start = 0").select("stem", "start")
    pool = zero.unionByName(zero.where("stem like '%5'")).unionByName(w.where("start = 5").select("stem", (F.col("start") + 1).alias("start")))
    return S.pool_problems(pool, w).distinct()


# --- splits and samplers ---------------------------------------------------------------------------

_SPLIT = """split as (select seed, stem, case when rn <= case when n < 13 then 1 else ceil(n * 0.2) end then 'test' else 'train' end as subset from (
    select seed, stem, row_number() over (partition by seed order by md5(concat(seed, ':', stem)), stem) as rn, count(*) over (partition by seed) as n from fx_stems, range(3) s(seed)) q)"""


def splits(spark, d):
    return S.split_stems(fx.stems(spark, d), spark.range(3).select(F.col("id").cast("int").alias("seed")), 0.2)


@query("k1_split_stems", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT} select cast(seed as int) as seed, stem, subset from split")
def k1(spark, d):
    return splits(spark, d)


@query("k2_j13_nested_splits", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT} select cast(seed as int) as outer_seed, cast(i as int) as inner_seed, stem, case when row_number() over (partition by seed, i order by md5(concat(seed, '/', i, ':', stem)), stem) <= ceil(count(*) over (partition by seed, i) * 0.2) then 'val' else 'train' end as subset from split, range(2) q(i) where subset = 'train'")
def k2(spark, d):
    return S.nested_splits(splits(spark, d), spark.range(2).select(F.col("id").cast("int").alias("inner_seed")))


@query("e2_split_disjoint", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT} select stem from split where seed = 0 and subset = 'test' intersect select stem from split where seed = 1 and subset = 'test'")
def e2(spark, d):
    s = splits(spark, d).where("subset = 'test'")
    return S.common_stems(s.where("seed = 0"), s.where("seed = 1"))


@query("e3_partition_problems", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT}, o as (select stem from split where seed = 0 and subset = 'train'), b as (select stem from split where seed = 1 and subset = 'train') select stem, 'missing' as problem from o where stem not in (select stem from b) union all select stem, 'extra' from b where stem not in (select stem from o)")
def e3(spark, d):
    s = splits(spark, d).where("subset = 'train'")
    one = s.where("seed = 1")
    return S.partition_problems(one.where("stem like '%1'"), one.where("stem not like '%1'"), s.where("seed = 0"))


@query("j8_resolve_stems", f"with {fx.FRAMES}, {fx.STEMS}, q as (select stem as req from fx_stems where stem like '%3' union select substring(stem, 2) from fx_stems union select 'nothing'), e as (select req from q where req in (select stem from fx_stems)), m as (select q.req, count(s.stem) as n, min(s.stem) as stem from q left join fx_stems s on ends_with(s.stem, q.req) where q.req not in (select req from e) group by 1) select req, req as stem, 'exact' as status from e union all select req, case when n = 1 then stem end, case n when 0 then 'none' when 1 then 'suffix' else 'ambiguous' end from m")
def j8(spark, d):
    s = fx.stems(spark, d)
    req = s.where("stem like '%3'").select(F.col("stem").alias("req")).union(s.select(F.expr("substring(stem, 2)"))).union(spark.range(1).select(F.lit("nothing"))).distinct()
    return S.resolve_stems(req, s)


@query("k3_shuffled_batches", f"with {fx.FRAMES}, k as (select stem, frame, row_number() over (order by md5(concat('1:0:', stem, ':', frame)), stem, frame) as rn from fx_frames) select stem, frame, cast((rn - 1) // 32 as bigint) as batch_id from k")
def k3(spark, d):
    return S.shuffled_batches(fx.frames(spark, d).select("stem", "frame"), ["stem", "frame"], 32, 1, 0)


_STRATA = "items as (select stem, cast(start as int) as start, case when sum(truth) > 2 then 'positive' when start % 20 = 0 then 'hard' else 'random' end as stratum from fx_rows group by stem, start)"
_DRAWS = """sizes as (select stratum, count(*) as n, case stratum when 'positive' then 1 when 'hard' then 3 else 4 end as per, (select ceil(count(*) / 8.0) from items) as steps from items group by 1),
    rounds as (select stratum, per, steps, unnest(range(cast(ceil(steps * per / n) as bigint))) as round from sizes),
    drawn as (select i.stem, i.start, i.stratum, r.round, r.per, r.steps, row_number() over (partition by i.stratum order by r.round, md5(concat('3:0:', i.stratum, ':', r.round, ':', i.stem, ':', i.start)), i.stem, i.start) as draw from items i join rounds r on r.stratum = i.stratum)"""


@query("k4_e5_stratified_batches", f"with {fx.FRAMES}, {fx.WINDOWS}, {_STRATA}, {_DRAWS} select stem, start, stratum, cast(round as int) as round, cast((draw - 1) // per as bigint) as step from drawn where draw <= steps * per")
def k4(spark, d):
    w = B.window_rows(fx.frames(spark, d), fx.WINDOW, fx.STRIDE).groupBy("stem", "start").agg(F.sum("truth").alias("p"))
    items = w.select("stem", "start", F.when(F.col("p") > 2, "positive").when(F.col("start") % 20 == 0, "hard").otherwise("random").alias("stratum"))
    return S.stratified_batches(items, ["stem", "start"], {"positive": 1, "hard": 3, "random": 4}, 8, 3)


@query("a11_dataset_summary", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT} select subset, count(*) as n_rows, cast(sum(truth) as bigint) as positives, case when sum(truth) > 0 then 'ok' when subset = 'train' then 'error' else 'warning' end as state from fx_frames f join split s on s.stem = f.stem and s.seed = 0 group by 1")
def a11(spark, d):
    rows = fx.frames(spark, d).join(splits(spark, d).where("seed = 0"), "stem").groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("truth").alias("positives"))
    return rows.withColumn("state", F.when(F.col("positives") > 0, "ok").when(F.col("subset") == "train", "error").otherwise("warning"))


@query("a24_frame_rates", f"with {fx.FRAMES} select count(distinct event_id % 3) as n_rates, count(distinct event_id % 3) = 1 as uniform from fx_frames")
def a24(spark, d):
    return S.uniform_rate(fx.frames(spark, d).withColumn("rate", F.col("event_id") % 3), "rate")


# --- sweeps ----------------------------------------------------------------------------------------


def _batch(spark, d, label: str, scale: float, order: int) -> DataFrame:
    rows = S.best_per_run(fx.runs(spark, d, scale)).withColumnsRenamed({f"validation_{m}": m for m in S.RATES})
    return rows.select("outer_id", "inner_seed", F.lit("b").alias("behavior"), F.lit("test").alias("subset"), F.lit("frame").alias("level"), F.lit(label).alias("batch"), F.lit(order).alias("batch_ord"), "threshold", "f1", "precision", "recall")


def batches(spark, d):
    return _batch(spark, d, "base", 1.0, 0).unionByName(_batch(spark, d, "cand", 1.2, 1))


def _batch_sql(source: str, label: str, order: int) -> str:
    return f"select outer_id, inner_seed, 'b' as behavior, 'test' as subset, 'frame' as level, '{label}' as batch, {order} as batch_ord, threshold, f1, precision, recall from (select *, row_number() over (partition by outer_id, inner_seed order by {_ORDER}) as rn from {source}) q where rn = 1"


_BATCHES = f"{fx.FRAMES}, {fx.runs_sql()}, {fx.runs_sql('fx_runs12', 1.2)}, batches as ({_batch_sql('fx_runs', 'base', 0)} union all {_batch_sql('fx_runs12', 'cand', 1)})"


def _stats(values: tuple[str, ...], bar: float, fraction: bool = True) -> str:
    each = ", ".join(f"round(avg({m}), 6) as mean_{m}, round(coalesce(stddev_samp({m}), 0), 6) as std_{m}, round(min({m}), 6) as min_{m}, round(max({m}), 6) as max_{m}" for m in values)
    ok = f"f1 >= {bar} and precision >= {bar} and recall >= {bar}"
    part = f"round(avg(case when {ok} then 1.0 else 0.0 end), 6) as fraction_runs_all_ge, " if fraction else ""
    return f"count(*) as n_runs, {each}, count(*) filter ({ok}) as n_runs_all_ge, {part}least(avg(f1), avg(precision), avg(recall)) >= {bar} as all_means_ge"


@query("p15_a18_sweep_summary", f"with {_BATCHES}, r as (select *, cast(right(outer_id, 1) as int) as outer_seed from batches where batch_ord = 0 and inner_seed <> 3) select behavior, subset, level, outer_id, outer_seed, grouping(outer_id) = 0 as by_outer, {_stats((*S.RATES, 'threshold'), 0.4)} from r group by grouping sets ((behavior, subset, level), (outer_id, outer_seed, behavior, subset, level))")
def a18(spark, d):
    rows = batches(spark, d).where("batch_ord = 0").withColumns({"outer_seed": F.expr("cast(right(outer_id, 1) as int)"), "eval_returncode": F.when(F.col("inner_seed") == 3, "1").otherwise("0"), "error": F.lit("")})
    return rounded(S.sweep_summary(S.successful(rows), 0.4))


@query("p18_a19_batch_summary", f"with {_BATCHES}, r as (select *, 'last' as checkpoint_policy, case inner_seed when 0 then 'validation_selected_posthoc_map' when 1 then 'validation_selected_from_checkpoint_training' when 2 then 'fixed:0.55' else 'fixed:0.5' end as threshold_policy from batches) select batch, checkpoint_policy, threshold_policy, behavior, subset, level, {_stats(S.RATES, 0.4, False)} from r group by 1, 2, 3, 4, 5, 6")
def a19(spark, d):
    mode = F.when(F.col("inner_seed") == 0, "external_map").when(F.col("inner_seed") == 1, "selected_checkpoint").when(F.col("inner_seed") == 2, "fixed")
    rows = batches(spark, d).withColumns({"checkpoint_policy": F.lit("last"), "fixed": F.when(F.col("inner_seed") == 2, F.lit(0.55)), "mode": mode})
    return rounded(S.batch_summary(rows.withColumn("threshold_policy", S.threshold_policy("fixed", "mode")), False, 0.4))


_KEYS = ["outer_id", "inner_seed", "behavior", "subset", "level"]
_DELTAS = f"deltas as (select a.batch as baseline_batch, b.batch as candidate_batch, {', '.join('a.' + k for k in _KEYS)}, {', '.join(f'b.{m} - a.{m} as delta_{m}' for m in S.RATES)} from batches a join batches b on {' and '.join(f'a.{k} = b.{k}' for k in _KEYS)} and a.batch_ord < b.batch_ord)"


@query("j16_paired_deltas", f"with {_BATCHES}, {_DELTAS} select baseline_batch, candidate_batch, {', '.join(_KEYS)}, {r6(*[f'delta_{m}' for m in S.RATES])} from deltas")
def j16(spark, d):
    return rounded(S.paired_deltas(batches(spark, d), _KEYS))


@query("a20_paired_summary", f"with {_BATCHES}, {_DELTAS} select baseline_batch, candidate_batch, behavior, subset, level, count(*) as n_paired_runs, {', '.join(f'round(avg(delta_{m}), 6) as mean_delta_{m}, count(*) filter (delta_{m} > 0) as wins_{m}, count(*) filter (delta_{m} = 0) as ties_{m}, count(*) filter (delta_{m} < 0) as losses_{m}' for m in S.RATES)} from deltas group by 1, 2, 3, 4, 5")
def a20(spark, d):
    return rounded(S.paired_summary(S.paired_deltas(batches(spark, d), _KEYS), ["behavior", "subset", "level"]))


@query("j15_batch_mismatches", f"with {_BATCHES} select outer_id, inner_seed, case when inner_seed = 1 then 'missing_in_candidate' else 'signature' end as problem from batches where batch_ord = 0 and inner_seed in (1, 2)")
def j15(spark, d):
    changed = F.when((F.col("inner_seed") == 2) & (F.col("batch_ord") == 1), "other").otherwise("same")
    rows = batches(spark, d).where("not (batch_ord = 1 and inner_seed = 1)").withColumns({"split_signature": F.lit("same"), "val_split_signature": changed})
    return S.batch_mismatches(rows, ["outer_id", "inner_seed"], ["split_signature", "val_split_signature"])


@query("a23_duplicate_keys", "select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def a23(spark, d):
    return S.duplicates(fx.table(spark, d, "events"), ["user_id", "event_type"])


_STATUS = "s as (select outer_id, inner_seed, case when inner_seed = 0 then 'm/' || outer_id when inner_seed = 1 then null end as manifest_path, case inner_seed when 0 then 'complete' else 'pending' end as state, case inner_seed when 0 then 'complete' when 1 then 'incomplete' else 'missing' end as detail from batches where batch_ord = 0)"


@query("j11_plan_status", f"with {_BATCHES}, {_STATUS} select * from s")
def j11(spark, d):
    plan = batches(spark, d).where("batch_ord = 0").select("outer_id", "inner_seed")
    results = plan.where("inner_seed < 2").withColumn("manifest_path", F.when(F.col("inner_seed") == 0, F.concat(F.lit("m/"), "outer_id")))
    return S.plan_status(plan, results, ["outer_id", "inner_seed"])


@query("j11_pending_runs", f"with {_BATCHES}, {_STATUS} select outer_id, inner_seed, detail = 'incomplete' as has_partial_run, (select count(*) from s where state = 'pending') as pending, (select count(*) from s where detail = 'missing') as missing, (select count(*) from s) as total from s where state = 'pending'")
def j11_pending(spark, d):
    status = j11(spark, d)
    return S.pending_runs(status).crossJoin(F.broadcast(S.status_counts(status).select("pending", "missing", "total")))


@query("j17_resolve_manifests", f"with {_BATCHES} select outer_id, inner_seed, case inner_seed when 0 then 'p/' || outer_id when 1 then 'n/' || outer_id when 2 then 's/' || outer_id end as manifest_path from batches where batch_ord = 0")
def j17(spark, d):
    r = batches(spark, d).where("batch_ord = 0")
    pick = lambda k, v: F.when(F.col("inner_seed") == k, F.concat(F.lit(v), "outer_id")).otherwise(F.lit("none"))
    found = r.select("outer_id", "inner_seed", pick(0, "p/").alias("recorded_path"), pick(1, "run").alias("run_name"), pick(2, "split").alias("split_path"), pick(2, "val").alias("val_split_path"))
    outer = r.select("outer_id").distinct()
    m = lambda path, name, split, val: outer.select(F.concat(F.lit(path), "outer_id").alias("path"), *[F.concat(F.lit(x), "outer_id").alias(n) for x, n in ((name, "run_name"), (split, "split_path"), (val, "val_split_path"))])
    manifests = m("p/", "x", "x", "x").unionByName(m("n/", "run", "y", "y")).unionByName(m("s/", "z", "split", "val"))
    return S.resolve_manifests(found, manifests).select("outer_id", "inner_seed", "manifest_path")


@query("j18_reusable_results", f"with {_BATCHES} select outer_id, inner_seed, threshold from batches where batch_ord = 0 and inner_seed in (0, 1)")
def j18(spark, d):
    req = batches(spark, d).where("batch_ord = 0").select("outer_id", "inner_seed", "threshold")
    res = req.withColumns({"eval_returncode": F.when(F.col("inner_seed") == 2, 1).otherwise(0), "threshold": F.col("threshold") + F.when(F.col("inner_seed") == 3, 1e-6).otherwise(1e-13)})
    return S.reusable(res, req, ["outer_id", "inner_seed"], ["threshold"])


@query("j19_sweep_completeness", f"with {_BATCHES} select outer_id as sweep, count(*) as planned, count(*) filter (inner_seed < 3 or outer_id = 'outer_seed0') as completed, count(*) filter (inner_seed < 3 or outer_id = 'outer_seed0') >= count(*) as is_complete from batches where batch_ord = 0 group by 1")
def j19(spark, d):
    plan = batches(spark, d).where("batch_ord = 0").select(F.col("outer_id").alias("sweep"), "inner_seed")
    return S.sweep_completeness(plan, plan.where("inner_seed < 3 or sweep = 'outer_seed0'"))


@query("a22_content_signature", f"with {fx.FRAMES}, {fx.STEMS}, {_SPLIT} select cast(seed as int) as seed, subset, sha256('[' || string_agg('\"' || stem || '\"', ',' order by stem) || ']') as signature from split group by 1, 2")
def a22(spark, d):
    return S.content_signature(splits(spark, d).withColumn("ord", F.col("stem")), ["seed", "subset"], "stem", "ord")


@query("a21_incompatible_fields", f"with {_BATCHES}, c as (select outer_id, count(distinct threshold) as threshold, count(distinct level) as level from batches group by 1) select outer_id, 'threshold' as field, threshold as values from c where threshold > 1 union all select outer_id, 'level', level from c where level > 1")
def a21(spark, d):
    return S.incompatible_fields(batches(spark, d), "outer_id", ["threshold", "level"])


def _manifests(spark, d) -> DataFrame:
    """A manifest for every run, as JSON: runs of inner seed 1 have other windows, those of 2 another recipe, those of 3 only another seed and order of keys."""
    runs = batches(spark, d).where("batch_ord = 0").select("outer_id", "inner_seed")
    size = F.when(F.col("inner_seed") == 1, "20").otherwise("10")
    rate = F.when(F.col("inner_seed") == 2, "0.1").otherwise("0.2")
    window = F.when(F.col("inner_seed") == 3, F.concat(F.lit('{"stride":5,"size":'), size, F.lit("}"))).otherwise(F.concat(F.lit('{"size":'), size, F.lit(',"stride":5}')))
    text = F.concat(F.lit('{"behavior":"b","behavior_idx":0,"label_columns":["b"],"feature_columns":["x","y"],"feature_selection":{},"split":"s.yml","kl_config":"c.yml","window":'), window, F.lit(',"training":{"seed":'), F.col("inner_seed").cast("string"), F.lit(',"val_fraction":0.2,"rate":'), rate, F.lit("}}"))
    return runs.select("outer_id", "inner_seed", F.concat_ws("/", "outer_id", F.col("inner_seed").cast("string")).alias("manifest_path"), text.alias("manifest"))


@query("a21_manifest_conflicts", f"with {_BATCHES}, r as (select outer_id, outer_id || '/' || inner_seed as manifest_path, inner_seed from batches where batch_ord = 0), c as (select *, 'ensemble' as guard, 'window' as field from r where inner_seed = 1 union all select *, 'selection', 'window' from r where inner_seed = 1 union all select *, 'selection', 'training_recipe' from r where inner_seed = 2 union all select *, 'train_set', 'window' from r where inner_seed = 1 union all select *, 'train_set', 'seed' from r where inner_seed > 0 union all select *, 'train_set', 'behavior' from r where inner_seed > 0 union all select *, 'source', 'window' from r where inner_seed = 1) select outer_id, manifest_path, guard, field from c")
def a21_manifests(spark, d):
    fields = M.manifest_fields(_manifests(spark, d))
    named = lambda df, guard: df.select("outer_id", "manifest_path", F.lit(guard).alias("guard"), "field")
    of_source = M.source_conflicts(fields, fields.where("manifest_path = 'outer_seed0/0'")).withColumn("outer_id", F.substring_index("manifest_path", "/", 1))
    return named(M.ensemble_conflicts(fields, "outer_id"), "ensemble").unionByName(named(M.selection_conflicts(fields, "outer_id"), "selection")).unionByName(named(M.train_set_conflicts(fields, "val", "outer_id"), "train_set")).unionByName(named(of_source, "source"))


@query("a22_manifest_signatures", f"with {_BATCHES} select inference, count(*) as runs from (select inner_seed = 1 as inference from batches where batch_ord = 0) q group by 1")
def a22_manifests(spark, d):
    """How many runs share the most common inference signature, and how many have another."""
    signed = M.signatures(M.manifest_fields(_manifests(spark, d)), M.INFERENCE)
    counts = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("runs"))
    most = counts.agg(F.max("runs").alias("most"))
    return counts.crossJoin(F.broadcast(most)).groupBy((F.col("runs") < F.col("most")).alias("inference")).agg(F.sum("runs").alias("runs"))


@query("s10_s12_load_batch", f"with {_BATCHES} select outer_id, inner_seed, round(f1, 6) as f1, 'base' as batch, 'last' as checkpoint_policy, 'fixed:0.5' as threshold_policy, sha256('content ' || outer_id) as split_signature, sha256('content ' || inner_seed) as val_split_signature from batches where batch_ord = 0 and inner_seed <> 3")
def s12(spark, d):
    seed = F.col("inner_seed").cast("string")
    raw = batches(spark, d).where("batch_ord = 0").withColumns({"split_path": F.concat(F.lit("/old/splits/"), "outer_id", F.lit(".yml")), "val_split_path": F.concat(F.lit("/new/splits/val"), seed, F.lit(".yml")), "eval_returncode": F.when(F.col("inner_seed") == 3, 1).otherwise(0), "error": F.lit(None).cast("string"), "threshold_mode": F.lit("fixed"), "threshold": F.lit(0.5)})
    files = raw.select(F.concat(F.lit("/new/splits/"), "outer_id", F.lit(".yml")).alias("path"), F.concat(F.lit("content "), "outer_id").alias("content")).union(raw.select("val_split_path", F.concat(F.lit("content "), seed))).distinct()
    out = io.load_batch(io.sweep_rows(raw), files.withColumn("signature", F.sha2("content", 256)), "base", "b", "last")
    return rounded(out.select("outer_id", "inner_seed", "f1", "batch", "checkpoint_policy", "threshold_policy", "split_signature", "val_split_signature"))


@query("p22_manifest_summary", f"with {_BATCHES} select outer_id, inner_seed, 7 as best_epoch_by_val_loss, cast(null as int) as epochs_completed, inner_seed as best_epoch_by_checkpoint_selection, threshold as selected_threshold, round(f1, 6) as selected_val_episode_f1, cast(null as double) as selected_val_episode_precision, cast(null as double) as selected_val_episode_recall, round(recall, 6) as test_recall from batches where batch_ord = 0")
def p22(spark, d):
    rows = batches(spark, d).where("batch_ord = 0")
    chosen = F.struct(F.struct(F.col("inner_seed").alias("epoch"), "threshold", "f1").alias("selected"))
    run = F.struct(F.lit(7).alias("best_epoch_by_val_loss"), chosen.alias("checkpoint_selection"), F.struct("recall").alias("test_metrics"))
    return rounded(M.run_summary(rows.select("outer_id", "inner_seed", F.to_json(F.struct(run.alias("training_run"))).alias("manifest")), ("recall",)).drop("manifest"))


# --- ensembles -------------------------------------------------------------------------------------

_CAND = "cand as (select outer_id || '/' || inner_seed as manifest_path, case when inner_seed = 3 then null else outer_id end as outer_id, round(f1, 6) as score from batches where batch_ord = 0)"


def candidates(spark, d):
    return rounded(batches(spark, d).where("batch_ord = 0").select(F.concat_ws("/", "outer_id", F.col("inner_seed").cast("string")).alias("manifest_path"), F.when(F.col("inner_seed") != 3, F.col("outer_id")).alias("outer_id"), F.col("f1").alias("score")))


@query("t2_t4_top_candidates", f"with {_BATCHES}, {_CAND} select * from cand where score >= 0.2 order by score desc, manifest_path limit 6")
def t2(spark, d):
    return S.select_top(candidates(spark, d), 0.2, 6)


@query("t3_diverse_candidates", f"with {_BATCHES}, {_CAND}, b as (select * from cand where score >= (select max(score) from cand) - 0.1), r as (select *, row_number() over (partition by outer_id, case when outer_id is null then manifest_path end order by score desc, manifest_path) > 1 as later from b) select manifest_path, outer_id, score from r order by later, score desc, manifest_path limit 6")
def t3(spark, d):
    return S.select_diverse(candidates(spark, d), 0.1, 6)


@query("s22_selection_report", f"with {_BATCHES}, {_CAND}, t as (select manifest_path from cand order by score desc, manifest_path limit 6) select *, manifest_path in (select manifest_path from t) as selected from cand")
def s22(spark, d):
    c = candidates(spark, d)
    return S.selection_report(c, S.select_top(c, None, 6))


@query("a25_define_ensembles", f"with {_BATCHES} select outer_id as ensemble, count(*) as n_members, string_agg(cast(inner_seed as varchar), ',' order by cast(inner_seed as varchar)) as members from batches where batch_ord = 0 and (outer_id <> 'outer_seed0' or inner_seed = 0) group by 1 having count(*) >= 2")
def a25(spark, d):
    m = batches(spark, d).where("batch_ord = 0 and (outer_id <> 'outer_seed0' or inner_seed = 0)").select(F.col("outer_id").alias("ensemble"), F.col("inner_seed").cast("string").alias("member"))
    return S.define_ensembles(m).withColumn("members", F.array_join("members", ","))


@query("e4_first_of_each", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as rn from events) q where rn = 1")
def e4(spark, d):
    return S.first_of_each(fx.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("e5_negative_pool", f"with {fx.FRAMES} select stem, frame from fx_frames where truth = 0 and not (frame % 4 = 0)")
def e5(spark, d):
    n = fx.frames(spark, d).where("truth = 0").select("stem", "frame")
    return S.negative_pool(n, n.where("frame % 4 = 0"), ["stem", "frame"])


# --- sources ---------------------------------------------------------------------------------------


@query("s2_flatten_pose", f"with {fx.POSE} select stem, frame, {r6('head_x', 'head_y', 'thorax_x', 'thorax_y')}, round(head_p, 6) as head_p, cast(null as double) as thorax_p from fx_pose")
def s2(spark, d):
    p = fx.pose(spark, d).select("stem", "frame", "head_x", "head_y", F.col("head_p").alias("head_likelihood"), "thorax_x", "thorax_y")
    long = p.unpivot(["stem", "frame"], p.columns[2:], "c", "value").select("stem", "frame", F.substring_index("c", "_", 1).alias("keypoint"), F.substring_index("c", "_", -1).alias("axis"), "value")
    return rounded(io.flatten_pose(long, ["head", "thorax"]))


@query("s4_features_for_stems", f"with {fx.FRAMES} select stem, frame, round(prob, 6) as prob from fx_frames where user_id % 4 = 0")
def s4(spark, d):
    f = fx.frames(spark, d)
    return rounded(io.features_for(f.select("stem", "frame", "prob"), f.where("user_id % 4 = 0")))


@query("s4_missing_stems", f"with {fx.FRAMES}, {fx.STEMS} select stem || 'x' as stem from fx_stems")
def s4b(spark, d):
    s = fx.stems(spark, d)
    return io.missing_stems(fx.frames(spark, d), s.union(s.select(F.concat("stem", F.lit("x")))))


@query("s6_available_stems", f"with {fx.FRAMES}, {fx.STEMS} select stem from fx_stems")
def s6(spark, d):
    return io.available_stems(fx.frames(spark, d))


@query("s7_stems_of_paths", "select distinct concat('v', user_id, '.raw') as stem from events")
def s7(spark, d):
    return io.stems_of(fx.table(spark, d, "events").select(F.concat(F.lit(" /data/day.1/v"), F.col("user_id").cast("string"), F.lit(".raw.mp4 ")).alias("path"))).distinct()


@query("s19_e1_union_of_columns", "select r_name as name, cast(null as bigint) as nation_key, r_regionkey as region_key from region union all select n_name, n_nationkey, n_regionkey from nation")
def s19(spark, d):
    a = fx.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region_key"))
    b = fx.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("nation_key"), F.col("n_regionkey").alias("region_key"))
    return io.union_of_columns(a, b)


@query("s21_run_summary", f"with {fx.FRAMES} select count(*) as n_frames, count(distinct stem) as n_videos, cast(sum(truth) as bigint) as positives, round(avg(prob), 6) as mean_probability from fx_frames")
def s21(spark, d):
    return rounded(fx.frames(spark, d).agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("stem").alias("n_videos"), F.sum("truth").alias("positives"), F.avg("prob").alias("mean_probability")))


# --- pipelines -------------------------------------------------------------------------------------


@query("u4_extract_pipeline")
def u4_extract(spark, d):
    """Features of the large pose table, imputed, scaled and filled, in one plan with one shuffle. Scaling and imputing by means commute."""
    scaled = X.imputed_and_standardised(X.pose_features(fx.large_pose(spark, d), fx.CONFIG))
    out = X.drop_absolute(scaled)
    return X.zero_fill(out, [c for c in out.columns if c not in ("stem", "frame")])[0]


@query("u4_predict_pipeline", f"with {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES}, {_ENSEMBLE}, num as (select *, frame as f0, cast(row_number() over (partition by stem order by frame) - 1 as int) as p from recon), posd as (select stem, p as frame, f0, prob from num), {fx.bout_sql('posd', 'prob >= 0.4', 3, 1)} select b.stem, min(f0) as start_frame, max(f0) as end_frame, count(*) as n_frames, round(avg(prob) + 1e-9, 6) as mean_probability, round(max(prob) + 1e-9, 6) as max_probability from fx_bouts b join posd on posd.stem = b.stem and posd.frame between b.start_frame and b.end_frame group by b.stem, b.start_frame")
def u4_predict(spark, d):
    return rounded(B.bout_table(reconstructed(spark, d), F.col("prob") >= 0.4, 3, 1), 1e-9)


_RECON_EVENTS = f"{fx.bout_sql('posn', 'pred = 1', 3, 1, name='pb')}, {fx.bout_sql('posn', 'truth = 1', 1, 0, name='tb')}, {_ELIGIBLE}, {_matched('pairs')}"


@query("u4_evaluate_pipeline", f"with recursive {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES}, {_ENSEMBLE}, posn as (select stem, pred, truth, frame from recon), {_RECON_EVENTS}, s as (select (select coalesce(sum(m), 0) from matched) as tp, (select count(*) from pb) as p, (select count(*) from tb) as t), e as (select 'episode' as level, * from ({_episodes_of()} from s)), c as (select {_CELLS} from recon), f as (select 'frame' as level, tp, fp, fn, tn, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end as f1, (tp + tn) / greatest(tp + fp + fn + tn, 1) as accuracy from c), r as (select level, tp, fp, fn, tn, precision, recall, f1, accuracy, cast(null as bigint) as n_predicted_episodes, cast(null as bigint) as n_true_episodes from f union all select level, tp, fp, fn, cast(null as bigint), precision, recall, f1, cast(null as double), n_predicted_episodes, n_true_episodes from e) select level, tp, fp, fn, tn, {r6('precision', 'recall', 'f1', 'accuracy')}, n_predicted_episodes, n_true_episodes, round(f1, 6) as macro_f1, round(precision, 6) as macro_precision, round(recall, 6) as macro_recall from r")
def u4_evaluate(spark, d):
    """Frame and episode metrics of the reconstructed ensemble, with their macro rows."""
    f = reconstructed(spark, d)
    pred, truth = B.bouts(f, F.col("pred") == 1, 3, 1), B.bouts(f, F.col("truth") == 1, 1, 0)
    rows = io.union_of_columns(B.binary_metrics(f, []).withColumn("level", F.lit("frame")), B.episode_metrics(pred, truth).withColumn("level", F.lit("episode")))
    return rounded(rows.join(B.macro_average(rows), "level"))


@query("u4_compare_pipeline", f"with {_BATCHES}, {_DELTAS} select candidate_batch, round(avg(delta_f1), 6) as mean_delta_f1, count(*) as n_paired_runs from deltas group by 1")
def u4_compare(spark, d):
    return rounded(S.paired_summary(S.paired_deltas(batches(spark, d), _KEYS), ["behavior"]).select("candidate_batch", "mean_delta_f1", "n_paired_runs"))


_SWEEP = f"t as (select distinct round(0.35::double + k * 0.05::double, 10) as threshold from range(9) q(k)), x as (select stem, frame, threshold, prob from fx_frames, t), {fx.bout_sql('x', 'prob >= threshold', 3, 1, 'stem, threshold', 'pb')}, {_TRUE}, {_ELIGIBLE.replace('select p.stem', 'select p.threshold, p.stem', 1)}, {_matched('pairs', 'stem, threshold')}"


@query("u4_sweep_evaluate_pipeline", f"with recursive {fx.FRAMES}, {_SWEEP}, s as (select threshold, coalesce((select sum(m) from matched m where m.threshold = g.threshold), 0) as tp, g.p, (select count(*) from tb) as t from (select threshold, count(*) as p from pb group by 1) g), e as ({_episodes_of('threshold, ')} from s) select threshold, {_EPISODE_COLS} from e")
def u4_sweep(spark, d):
    """Episode metrics at every threshold of the grid, best first; truths, which no threshold changes, are made once."""
    f = fx.frames(spark, d).select("stem", "frame", "prob", "truth")
    pred = B.bouts_at(f, S.threshold_grid(spark, 0.35, 0.75, 0.05), 3, 1)
    out = B.episode_metrics(pred, B.bouts(f, F.col("truth") == 1, 1, 0), 0.2, ("stem", "threshold"), ("threshold",))
    return rounded(out).orderBy(F.desc("f1"), "threshold")


from gaitline.plans import run_queries, statistic_queries  # noqa: E402, F401
