"""Exact small cases of the pose, bout, metric and selection operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.operators import bouts as B
from gaitline.operators import features as X
from gaitline.operators import manifests as M
from gaitline.operators import selection as S
from gaitline.sources import io

GROUP = {"type": "bilateral_tips", "origin": "thorax", "axis": ["head", "abdomen"], "left_tip": "l", "right_tip": "r"}


def tips(spark, points):
    row = {"stem": "a", "frame": 0} | {f"{k}_{a}": float(v) for k, xy in points.items() for a, v in zip("xy", xy)}
    return X.bilateral_tips(spark.createDataFrame([row]), "g", GROUP | {"body_length_pts": ["head", "thorax"]}).first()


def test_tips_of_a_symmetric_pose(spark):
    pose = {"head": (0, -2), "thorax": (0, 0), "abdomen": (0, 4), "l": (-1, 3), "r": (1, 3)}
    got = tips(spark, pose)
    assert got.rel_g_left_lateral == pytest.approx(-got.rel_g_right_lateral) and got.rel_g_tip_separation == pytest.approx(1)
    assert got.rel_g_left_signed_angle == pytest.approx(-got.rel_g_right_signed_angle)
    rng = random.Random(11)
    for _ in range(3):  # turned, scaled and moved, the body-centric columns stay
        a, size, dx, dy = rng.uniform(-3, 3), rng.uniform(0.5, 9), rng.uniform(-50, 50), rng.uniform(-50, 50)
        moved = tips(spark, {k: (size * (x * math.cos(a) - y * math.sin(a)) + dx, size * (x * math.sin(a) + y * math.cos(a)) + dy) for k, (x, y) in pose.items()})
        for name in G.TIP_SUFFIXES:
            assert moved[f"rel_g_{name}"] == pytest.approx(got[f"rel_g_{name}"], abs=1e-9)


def test_no_body_length_gives_missing(spark):
    got = tips(spark, {"head": (0, 0), "thorax": (0, 0), "abdomen": (1, 0), "l": (1, 1), "r": (1, 1)})
    assert all(got[f"rel_g_{s}"] is None for s in G.TIP_SUFFIXES)


def test_lagged_deltas_wrap_and_boundaries(spark):
    rng = random.Random(12)
    values = [(round(rng.uniform(-5, 5), 3), None if rng.random() < 0.2 else round(rng.uniform(-1, 1), 3)) for _ in range(30)]
    df = spark.createDataFrame([("a", i, x, t) for i, (x, t) in enumerate(values)], "stem string, frame int, x double, t double")
    rows = df.select("frame", *[X.lagged_delta("x", k, False).alias(f"x{k}") for k in (1, 3)], *[X.lagged_delta("t", k, True).alias(f"t{k}") for k in (1, 3)]).orderBy("frame").collect()
    for i, r in enumerate(rows):
        for k in (1, 3):
            assert r[f"x{k}"] == pytest.approx(values[i][0] - values[i - k][0] if i >= k else 0)
            now, then = values[i][1], values[i - k][1] if i >= k else None
            if now is not None and i < k:
                assert r[f"t{k}"] == 0
            elif now is None or then is None:
                assert r[f"t{k}"] is None
            else:  # angles in half turns: the shortest way round
                assert r[f"t{k}"] == pytest.approx((now - then + 1) % 2 - 1, abs=1e-9)


def test_bad_dynamics_and_groups():
    for dynamics in ({"lags": [0]}, {"lags": [1, 1]}, {"lags": [1], "features": ["unknown"]}, {"lags": []}, []):
        with pytest.raises(ValueError):
            X.relational_groups({"relational": {"g": GROUP | {"dynamics": dynamics}}})
    with pytest.raises(ValueError):
        X.relational_groups({"relational": {"g": {"type": "other"}}})


def test_column_selection():
    columns = ["a_x", "rel_own_tip_separation", "rel_other_tip_separation", "rel_all_angle_asymmetry", "angle_a_b_c", "a_velocity_x"]
    config = {"relational": {"own": {"behavior": "walk"}, "other": {"behaviors": ["fly"]}, "all": {}}}
    assert X.behavior_columns(columns, config, "walk") == ["a_x", "rel_own_tip_separation", "rel_all_angle_asymmetry", "angle_a_b_c", "a_velocity_x"]
    assert X.behavior_columns(columns, {}, "walk") == ["a_x", "angle_a_b_c", "a_velocity_x"]
    assert X.family_columns(columns, "angle") == ["angle_a_b_c"] and X.family_columns(columns, "velocity") == ["a_velocity_x"]


def test_events_pair_with_the_latest_start(spark):
    rows = [("a", "b", t, i) for t, i in (("STOP", 1), ("START", 2), ("START", 4), ("STOP", 7), ("STOP", 9), ("START", 11))]
    got = B.pair_events(spark.createDataFrame(rows, "stem string, behavior string, event_type string, image_index int"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", 4, 7)]
    frames = spark.range(10).select(F.lit("a").alias("stem"), F.col("id").cast("int").alias("frame"))
    assert [r.b for r in B.label_frames(frames, got, ["b"]).orderBy("frame").collect()] == [0, 0, 0, 0, 1, 1, 1, 0, 0, 0]


def islands(mask, least, gap):
    """Brute force: merge positives whose gaps are allowed."""
    hits = [i for i, m in enumerate(mask) if m]
    out = []
    for i in hits:
        if out and i - out[-1][-1] - 1 <= gap:
            out[-1].append(i)
        else:
            out.append([i])
    return sorted((g[0], len(mask) - 1 if len(mask) - 1 - g[-1] <= gap else g[-1]) for g in out if len(g) >= least)


def test_bouts_against_brute_force(spark):
    rng = random.Random(3)
    masks = {f"v{k}": [rng.random() < 0.4 for _ in range(rng.randint(1, 25))] for k in range(60)}
    df = spark.createDataFrame([(s, 2 * i, int(m)) for s, mask in masks.items() for i, m in enumerate(mask)], "stem string, frame int, hit int")
    for least, gap in ((1, 0), (2, 1), (3, 3)):
        got = {}
        for r in B.bouts(df, F.col("hit") == 1, least, gap).collect():
            got.setdefault(r.stem, []).append((r.start_pos, r.end_pos))
            assert (r.start_frame, r.end_frame) == (2 * r.start_pos, 2 * r.end_pos)
        assert {s: sorted(v) for s, v in got.items()} == {s: v for s, m in masks.items() if (v := islands(m, least, gap))}


def largest(edges):
    best = 0
    for k in range(len(edges), 0, -1):
        for chosen in itertools.combinations(edges, k):
            if len({e[0] for e in chosen}) == k == len({e[1] for e in chosen}):
                return k
    return best


def test_matching_is_largest(spark):
    rng = random.Random(5)
    for _ in range(200):
        edges = sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randint(0, 7))})
        got = B.largest_matching([(a, b, rng.randint(1, 9)) for a, b in edges])
        assert all((a, b) in edges for a, b in got.items()) and len(set(got.values())) == len(got) == largest(edges)


def episodes(spark, rows):
    return spark.createDataFrame([("a", s, e) for s, e in rows], "stem string, start_frame int, end_frame int")


def disjoint(rng, n, longest):
    """Bouts in order that don't touch."""
    out, at = [], 0
    for _ in range(n):
        start = at + rng.randint(1, 6)
        at = start + rng.randint(0, longest)
        out.append((start, at))
    return out


def test_episode_metrics(spark):
    rng = random.Random(13)
    videos = {f"v{k}": (disjoint(rng, rng.randint(0, 6), 4), disjoint(rng, rng.randint(0, 6), 9)) for k in range(40)}
    rows = lambda side: spark.createDataFrame([(v, s, e) for v, both in videos.items() for s, e in both[side]], "stem string, start_frame int, end_frame int")
    for least in (0.2, 0.7):
        m = p = t = 0
        for preds, truths in videos.values():
            shared = lambda a, b: min(a[1], b[1]) - max(a[0], b[0]) + 1
            edges = [(i, j) for i, a in enumerate(preds) for j, b in enumerate(truths) if shared(a, b) > 0 and shared(a, b) >= least * (a[1] - a[0] + 1)]
            m, p, t = m + largest(edges), p + len(preds), t + len(truths)
        for pairs in (B.eligible_pairs(rows(0), rows(1), least), B.eligible_pairs(rows(0), rows(1), least, bin_frames=8)):
            assert B.match_bouts(pairs).count() == m == B.matched_count(pairs).first().m
        got = B.episode_metrics(rows(0), rows(1), least).first()
        assert (got.tp, got.fp, got.fn) == (m, p - m, t - m) and got.precision == pytest.approx(m / p) and got.recall == pytest.approx(m / t)
    none = B.episode_metrics(rows(0).limit(0), rows(1)).first()
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, t, 0.0)


def test_bouts_and_counts_at_thresholds(spark):
    rng = random.Random(14)
    frames = spark.createDataFrame([(v, i, rng.choice([0.1, 0.3, 0.5, 0.7, 0.9]), rng.randint(0, 1)) for v in "abc" for i in range(40)], "stem string, frame int, prob double, truth int")
    grid = S.threshold_grid(spark, values=[0.3, 0.5, 0.6])
    copied = frames.crossJoin(grid).withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("int"))
    cols = ["stem", "threshold", "start_pos", "end_pos", "start_frame", "end_frame", "n_positive"]
    assert sorted(B.bouts_at(frames, grid, 2, 1).select(cols).collect()) == sorted(B.bouts(copied, F.col("pred") == 1, 2, 1, ("stem", "threshold")).select(cols).collect())
    cells = ["stem", "threshold", "tp", "fp", "fn", "tn"]
    assert sorted(S.threshold_counts(frames, grid, ["stem"]).select(cells).collect()) == sorted(B.binary_metrics(copied, ["stem", "threshold"]).select(cells).collect())
    pred, truth = B.bouts_at(frames, grid, 2, 1), B.bouts(frames, F.col("truth") == 1, 1, 0)
    both = {r.threshold: tuple(r) for r in B.episode_metrics(pred, truth, 0.2, ("stem", "threshold"), ("threshold",)).collect()}
    copies = truth.crossJoin(grid)
    assert both == {r.threshold: tuple(r) for r in B.episode_metrics(pred, copies, 0.2, ("stem", "threshold"), ("threshold",)).collect()}


def test_windows_and_reconstruction(spark):
    df = spark.createDataFrame([("a", i) for i in range(13)] + [("b", i) for i in range(3)], "stem string, frame int")
    rows = {(r.stem, r.start, r.frame) for r in B.window_rows(df, 5, 3).collect()}
    assert rows == {("a", s, s + p) for s in (0, 3, 6) for p in range(5)}
    rng = random.Random(12)
    scored = [(f"m{m}", f"v{v}", f, rng.random(), rng.randrange(2)) for m in range(3) for v in range(4) for f in range(6) for _ in range(rng.randrange(3))]
    got = {(r.stem, r.frame): (r.prob, r.truth, r.pred) for r in B.reconstruct(spark.createDataFrame(scored, "member string, stem string, frame int, prob double, truth int"), 0.5).collect()}
    for key in {x[1:3] for x in scored}:
        own = [x for x in scored if x[1:3] == key]
        mean = sum(x[3] for x in own) / len(own)
        assert got.pop(key) == (pytest.approx(mean), max(x[4] for x in own), int(mean >= 0.5))
    assert not got


def test_rolling_means(spark):
    rng = random.Random(11)
    for width in (1, 3, 7):
        rows = [[rng.random() for _ in range(rng.randrange(1, 12))] for _ in range(40)]
        got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p array<double>").orderBy("k").select(G.maximum_rolling_mean(F.col("p"), width)).collect()
        for r, (found,) in zip(rows, got, strict=True):
            means = [sum(r[i : i + width]) / width for i in range(len(r) - width + 1)]
            assert found == (pytest.approx(max(means)) if means else None)


def test_threshold_grid_and_choice(spark):
    assert [r[0] for r in S.threshold_grid(spark, 0.2, 0.26, 0.02).collect()] == [0.2, 0.22, 0.24, 0.26]
    assert [r[0] for r in S.threshold_grid(spark, values=[0.9, 0.15, 0.9]).collect()] == [0.15, 0.9]
    with pytest.raises(ValueError):
        S.threshold_grid(spark, values=[1.0])
    rng = random.Random(15)
    rows = [("o", str(k), t / 20, rng.choice([0.3, 0.6]), rng.choice([0.2, 0.5, 0.8]), rng.choice([0.2, 0.5, 0.8])) for k in range(6) for t in range(1, 20)]
    got = S.best_per_run(spark.createDataFrame(rows, "outer_id string, inner_seed string, threshold double, f1 double, precision double, recall double"))
    rank = lambda r: (-r[3], -min(r[4], r[5]), -r[4], -r[5], abs(r[2] - 0.5), r[2])
    assert {r.inner_seed: r.threshold for r in got.collect()} == {str(k): min((r for r in rows if r[1] == str(k)), key=rank)[2] for k in range(6)}


def test_sweep_rows_have_one_behavior(spark):
    rows = spark.createDataFrame([("walk", "episode", 1), ("fly", "episode", 2), ("walk", "frame", 3)], "behavior string, level string, k int")
    assert [r.k for r in S.select_sweep_rows(rows, "walk").collect()] == [1]
    assert [r.k for r in S.select_sweep_rows(rows.drop("level").where("behavior = 'fly'")).collect()] == [2]
    for behavior, level in ((None, "episode"), ("swim", "episode"), ("fly", "frame")):
        with pytest.raises(ValueError):
            S.select_sweep_rows(rows, behavior, level)
    with pytest.raises(ValueError):
        S.select_sweep_rows(rows.drop("behavior"), "walk")


def test_ensemble_selection(spark):
    rng = random.Random(16)
    rows = [(f"m{k:02d}", round(rng.uniform(0.5, 0.9), 2), rng.choice(["p", "q", "", None])) for k in range(30)]
    c = spark.createDataFrame(rows, "manifest_path string, score double, outer_id string")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r[0] for r in S.select_top(c, 0.6, 7).collect()] == [r[0] for r in order if r[1] >= 0.6][:7]
    band = [r for r in order if r[1] >= order[0][1] - 0.2]
    first, later, seen = [], [], set()
    for r in band:
        group = r[2] or r
        (later if group in seen else first).append(r[0])
        seen.add(group)
    assert [r.manifest_path for r in S.select_diverse(c, 0.2).collect()] == first + later
    assert [r.manifest_path for r in S.select_diverse(c, 0.2, 5).collect()] == (first + later)[:5]
    for bad in (lambda: S.select_top(c, 0.95), lambda: S.select_top(c, None, 1), lambda: S.select_diverse(c, -0.1), lambda: S.select_diverse(c.where("manifest_path in ('m00', 'm01')"), 0.0), lambda: S.select_top(c.limit(0))):
        with pytest.raises(ValueError):
            bad()


def test_policy_labels(spark):
    rows = spark.createDataFrame([("fixed", 0.5), (None, None), ("fixed", 0.05), ("fixed", 0.1234567), ("fixed", 1.0), ("selected_checkpoint", 0.5), ("external_map", None), ("own", 0.5)], "threshold_mode string, threshold double")
    assert [r[0] for r in rows.select(S.threshold_policy()).collect()] == ["fixed:0.5", "fixed:0.5", "fixed:0.05", "fixed:0.123457", "fixed:1", "validation_selected_from_checkpoint_training", "validation_selected_posthoc_map", "own"]


def test_plan_status(spark):
    plan = spark.createDataFrame([(k,) for k in range(4)], "run int")
    results = spark.createDataFrame([(0, "m0"), (1, None), (2, None), (2, "m2")], "run int, manifest_path string")
    status = S.plan_status(plan, results, ["run"])
    assert {r.run: (r.state, r.detail) for r in status.collect()} == {0: ("complete", "complete"), 1: ("pending", "incomplete"), 2: ("complete", "complete"), 3: ("pending", "missing")}
    assert {(r.run, r.has_partial_run) for r in S.pending_runs(status).collect()} == {(1, True), (3, False)}
    assert tuple(S.status_counts(status).first()) == (4, 2, 2, 1, 1)


def test_negative_pool_guard(spark):
    negatives, hard = spark.createDataFrame([(k,) for k in range(5)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(r.k for r in S.negative_pool(negatives, hard, ["k"]).collect()) == [0, 2, 4]
    with pytest.raises(ValueError):
        S.negative_pool(negatives, spark.createDataFrame([(9,)], "k int"), ["k"])


def test_noise_depends_on_the_row_alone(spark):
    df = spark.createDataFrame([(f"v{k % 7}", k, 0.0, 5.0) for k in range(2000)], "stem string, frame int, x double, y double")
    one = {(r.stem, r.frame): r.x for r in X.augment(df, ["x"], 2.0, 3).collect()}
    two = X.augment(df.repartition(5, "frame"), ["x"], 2.0, 3).collect()
    assert one == {(r.stem, r.frame): r.x for r in two} and all(r.y == 5.0 for r in two)
    mean = sum(one.values()) / len(one)
    assert abs(mean) < 0.2 and 1.8 < math.sqrt(sum(v * v for v in one.values()) / len(one)) < 2.2
    assert one != {(r.stem, r.frame): r.x for r in X.augment(df, ["x"], 2.0, 4).collect()}


def test_manifests(spark):
    import json

    base = {"behavior": "b", "behavior_idx": 1, "label_columns": ["b", "c"], "feature_columns": ["x"], "window": {"size": 10, "stride": 5}, "feature_selection": {"a": [1]}, "kl_config": "c", "split": "s", "training": {"seed": 1, "val_fraction": 0.2, "rate": 0.1}}
    turned = dict(reversed(list(base.items()))) | {"window": {"stride": 5, "size": 10}, "training": {"rate": 0.1, "seed": 2, "val_fraction": 0.2, "final_zero_fill": False}}
    rows = [("a", base), ("b", turned), ("c", base | {"label_columns": ["c", "b"]}), ("d", base | {"training": base["training"] | {"final_zero_fill": True}}), ("e", {k: v for k, v in base.items() if k != "window"})]
    table = spark.createDataFrame([("g", p, json.dumps(m)) for p, m in rows], "g string, manifest_path string, manifest string")
    fields = M.manifest_fields(table)
    pairs = lambda df: {(r.manifest_path, r.field) for r in df.collect()}
    assert pairs(M.ensemble_conflicts(fields, "g")) == {("c", "label_columns"), ("d", "final_zero_fill"), ("e", "window")}
    assert pairs(M.selection_conflicts(fields, "g")) >= {("c", "label_columns"), ("d", "training_recipe"), ("e", "window")} and ("b", "window") not in pairs(M.selection_conflicts(fields, "g"))
    assert pairs(M.train_set_conflicts(fields, "test", "g")) == {("c", "label_columns"), ("e", "window"), *((p, "behavior") for p in "bcde")}
    assert ("b", "seed") in pairs(M.train_set_conflicts(fields, "val", "g"))
    assert pairs(M.source_conflicts(fields, fields.where("manifest_path = 'b'"))) == {("c", "label_columns"), ("d", "final_zero_fill"), ("e", "window")}
    assert pairs(M.lacking_fields(fields)) == {("e", "window")}
    assert M.groups_too_small(fields, "g").isEmpty() and M.groups_too_small(fields, "manifest_path").count() == 5
    runs = spark.createDataFrame([("a", json.dumps({"training_run": {"evaluation_weights": "w1", "checkpoint_best_model": "w2"}, "resolved_stems": {"train": ["p", "q"], "val": ["q", "r"]}})), ("b", "{}")], "manifest_path string, manifest string")
    assert {r.manifest_path: r.weights_path for r in M.usable_weights(runs, spark.createDataFrame([("w2",)], "path string")).collect()} == {"a": "w2", "b": None}
    assert sorted(r.stem for r in M.recusal_stems(runs).collect()) == ["p", "q", "r"] and sorted(r.stem for r in M.recusal_stems(runs, "train").collect()) == ["p", "q"]
    with pytest.raises(ValueError):
        M.recusal_stems(runs, "all")


def test_split_files(spark, tmp_path, monkeypatch):
    flow = "train: [a, 'b b', \"c\"]  # videos\ntest: [d]\nval: []\nouter_seed: 3\n"
    legacy = "Train videos:\na\nb b\nc\n\nTest videos:\nd\n"
    dashed = "---\ntrain:\n- a\n- b b\n- c\nouter_seed: 3\ntest:\n  - d\n"
    for name, text in (("f.yml", flow), ("l.txt", legacy), ("d.yaml", dashed)):
        (tmp_path / name).write_text(text)
        assert sorted((r.subset, r.stem) for r in io.read_split(spark, str(tmp_path / name)).collect()) == [("test", "d"), ("train", "a"), ("train", "b b"), ("train", "c")]
        if name != "l.txt":
            assert io.plain_yaml(text) == io.split_content(text)
    for text, yaml in (("a\nTrain videos:\nb\n", False), ("- a\n- b\n", True)):
        with pytest.raises(ValueError):
            io.split_content(text, yaml)
    (tmp_path / "s/splits").mkdir(parents=True)
    (tmp_path / "s/splits/x.yml").write_text("{test: [d], train: [a]}")
    (tmp_path / "s/splits/y.yml").write_text("train:\n- a\ntest:\n- d\n")
    (tmp_path / "s/splits/z.yml").write_text("train: [a]\ntest: [e]\n")
    splits = io.read_splits(spark, str(tmp_path / "s/splits/*.yml"))
    recorded = spark.createDataFrame([("x", "/gone/splits/x.yml"), ("y", str(tmp_path / "s/splits/y.yml")), ("z", "/gone/splits/z.yml"), ("w", "/gone/w.yml")], "k string, split_path string")
    got = {r.k: r.split_signature for r in io.resolve_splits(recorded, splits, "split_path").collect()}
    assert got["x"] == got["y"] != got["z"] and got["w"] is None and got["z"] is not None


def test_batches_of_evaluations(spark):
    rows = spark.createDataFrame([("o", "1", "b", "test", "frame", "0", None, 0.5, 0.5, 0.5, "/s/splits/p", "/s/splits/q", "fixed", 0.5), ("o", "2", "b", "test", "frame", "1", None, 0.5, 0.5, 0.5, "/s/splits/p", "/s/splits/q", "fixed", 0.5)], "outer_id string, inner_seed string, behavior string, subset string, level string, eval_returncode string, error string, f1 double, precision double, recall double, split_path string, val_split_path string, threshold_mode string, threshold double")
    splits = spark.createDataFrame([("/t/splits/p", "P"), ("/t/splits/q", "Q")], "path string, signature string")
    got = io.load_batch(rows, splits, "base", "b", "last").collect()
    assert [(r.inner_seed, r.split_signature, r.val_split_signature, r.threshold_policy) for r in got] == [("1", "P", "Q", "fixed:0.5")]
    for bad in (lambda: io.load_batch(rows, splits, "x", "other", "last"), lambda: io.load_batch(rows.union(rows), splits, "x", "b", "last"), lambda: io.load_batch(rows, splits.limit(0), "x", "b", "last")):
        with pytest.raises(ValueError):
            bad()


def test_folders_of_predictions_and_sweeps(spark, tmp_path):
    frames = spark.createDataFrame([("a", 0, 0.25, 1), ("b", 1, 0.5, 0)], "__stem__ string, __frame__ int, prob_walk double, true_walk int")
    frames.write.csv(str(tmp_path / "run/frame_predictions.csv"), header=True)
    text = io.read_predictions(spark, str(tmp_path / "run"))
    assert dict(text.dtypes) == {"stem": "string", "frame": "int", "prob_walk": "double", "true_walk": "int"}
    frames.withColumnsRenamed({"prob_walk": "prob_fly"}).write.parquet(str(tmp_path / "run/frame_predictions.parquet"))
    both = io.read_predictions(spark, str(tmp_path / "run"))
    assert io.infer_behaviors(both) == ["fly"] and io.unpivot_predictions(both).count() == 2
    assert io.subset_predictions(both, ["a"], ["fly"]).count() == 1
    for bad in (lambda: io.subset_predictions(both, ["c"]), lambda: io.subset_predictions(both, None, ["swim"]), lambda: io.infer_behaviors(both.drop("prob_fly")), lambda: io.read_predictions(spark, str(tmp_path))):
        with pytest.raises(ValueError):
            bad()
    assert [r[0] for r in both.orderBy("frame").select(io.time_axis(4.0)).collect()] == [0.0, 0.25] and [r[0] for r in both.orderBy("frame").select(io.time_axis()).collect()] == [0.0, 1.0]
    (tmp_path / "sweep").mkdir()
    (tmp_path / "sweep/experiment_plan.csv").write_text("outer_id,inner_seed,manifest_path,split_path\no,1,,s\no,2,,\n")
    assert io.read_sweep(spark, str(tmp_path / "sweep")).count() == 1
    (tmp_path / "sweep/results_summary.csv").write_text("outer_id,inner_seed,manifest_path,split_path\no,1,m,s\no,2,n,\n")
    assert io.read_sweep(spark, str(tmp_path / "sweep")).count() == 2 and io.read_sweep(spark, str(tmp_path / "sweep/experiment_plan.csv")).count() == 1


def test_windows_are_written_by_subset(spark, tmp_path):
    frames = spark.createDataFrame([("a", i, i / 10, i % 2) for i in range(12)], "stem string, frame int, x double, y int")
    windows = B.window_arrays(frames, ["x"], 4, 2, "y").withColumn("subset", F.when(F.col("start") < 4, "train").otherwise("val"))
    io.write_windows(windows, str(tmp_path / "w"))
    back = {(r.subset, r.start): ([round(f.features[0], 3) for f in r.x], r.y) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert back == {("train" if s < 4 else "val", s): ([(s + k) / 10 for k in range(4)], [(s + k) % 2 for k in range(4)]) for s in range(0, 9, 2)}


def test_filled_alignment(spark):
    df = spark.createDataFrame([("a", 0, None, 2.0)], "stem string, frame int, f double, g double")
    assert tuple(X.align(df, ["g", "f"], fill=True).first()) == ("a", 0, 2.0, 0.0)


def test_stratified_batches(spark):
    items = spark.createDataFrame([(i, "positive" if i < 2 else "hard" if i < 4 else "random") for i in range(10)], "k int, stratum string")
    rows = S.stratified_batches(items, ["k"], {"positive": 1, "hard": 3, "random": 4}, 8, 1)
    got = {(r.step, r.stratum): r["count"] for r in rows.groupBy("step", "stratum").count().collect()}
    assert got == {(s, t): n for s in (0, 1) for t, n in (("positive", 1), ("hard", 3), ("random", 4))}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "video.1_pose.csv").write_text(" index , head_x,head_y,head_p\n0,1,2,0.5\n1,bad,3,0.6\n")
    pose = io.read_pose(spark, str(tmp_path / "*.csv"), "_pose").orderBy("frame").collect()
    assert [r.stem for r in pose] == ["video.1"] * 2 and pose[1].head_x is None and pose[0].head_p == 0.5
    (tmp_path / "split.yaml").write_text("TRAIN:\n- /x/a.mp4\n- b\nTest:\n- c.mp4\n")
    assert sorted((r.subset, r.stem) for r in io.read_split(spark, str(tmp_path / "split.yaml")).collect()) == [("test", "c"), ("train", "a"), ("train", "b")]
    (tmp_path / "ann.tsv").write_text("Behavior\tBehavior type\tImage index\n walk \tstart\t3\nwalk\tSTOP\t5\nother\tSTART\t1\n")
    assert [tuple(r)[1:] for r in io.read_annotations(spark, str(tmp_path / "ann.tsv"), ["walk"]).collect()] == [("walk", "START", 3), ("walk", "STOP", 5)]
    frames = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.25)], "stem string, frame int, prob double")
    io.write_frames(frames, str(tmp_path / "out"), csv=True)
    assert io.read_predictions(spark, str(tmp_path / "out/frames.parquet")).count() == 2
    io.write_by_stem(frames, str(tmp_path / "by"))
    assert io.features_for(spark.read.parquet(str(tmp_path / "by")), spark.createDataFrame([("a",)], "stem string")).count() == 2
    scalers = spark.createDataFrame([("velocity", "c", 0.0, 1.0)], "family string, column string, mean double, scale double")
    io.write_scalers(scalers, str(tmp_path / "scalers"))
    with pytest.raises(ValueError):
        io.read_scalers(spark, str(tmp_path / "scalers"), ["velocity", "angle"])
    io.write_csv(frames, str(tmp_path / "bouts"))
    io.write_summary(frames.agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().n == 2


def test_alignment_errors(spark):
    df = spark.createDataFrame([("a", 0, 1.0, "x")], "stem string, frame int, f double, s string")
    assert X.non_numeric(df) == ["s"]
    with pytest.raises(ValueError):
        X.align(df, ["f"])
    assert X.align(df.drop("s"), ["f"]).columns == ["stem", "frame", "f"]


def test_recorded_runs(spark):
    rows = [("a", '{"training_run":{"epochs_completed":9,"checkpoint_selection":{"enabled":true,"selected":{"epoch":3,"threshold":0.4,"f1":0.5}},"test_metrics":{"loss":0.25}}}'), ("b", "{}"), ("c", '{"training_run":{"checkpoint_selection":{"enabled":true,"selected":{}}}}'), ("d", '{"training_run":{"checkpoint_selection":{"enabled":true,"selected":{"threshold":"x"}}}}')]
    table = spark.createDataFrame(rows, "manifest_path string, manifest string")
    one = M.run_summary(table).where("manifest_path = 'a'").first()
    assert (one.epochs_completed, one.best_epoch_by_checkpoint_selection, one.selected_threshold, one.selected_val_episode_f1, one.test_loss, one.best_epoch_by_val_loss) == (9, 3, 0.4, 0.5, 0.25, None)
    assert {r.manifest_path: (r.selected_threshold, r.threshold_problem) for r in M.selected_thresholds(table).collect()} == {"a": (0.4, None), "b": (None, "disabled"), "c": (None, "missing"), "d": (None, "invalid")}


def test_rows_of_features_and_labels(spark):
    frames = lambda rows: spark.createDataFrame([(s, k) for s, n in rows for k in range(n)], "stem string, frame int")
    assert [tuple(r) for r in B.row_mismatches(frames([("a", 3), ("b", 2), ("c", 4)]), frames([("a", 3), ("b", 1)])).collect()] == [("b", 2, 1)]
