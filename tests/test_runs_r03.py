"""Manifests from their files, sources on other runs' subsets, and the guards of splits, pools, batches and candidates."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gaitline.operators import evaluation as E
from gaitline.operators import manifests as M
from gaitline.operators import selection as S
from gaitline.operators import statistics as T
from gaitline.sources import documents as D
from gaitline.sources import io

TRAIN = {
    "behavior": "wing", "behavior_idx": 1, "label_columns": ["walk", "wing"], "feature_columns": ["d: 1", "d_2"], "window": {"size": 30, "stride": 15}, "artifacts": {}, "feature_selection": {"absolute": False},
    "training": {"seed": 4, "final_zero_fill": True}, "training_run": {"checkpoint_selection": {"enabled": True, "selected": {"threshold": 0.35}}}, "resolved_stems": {"train": ["p", "q"], "val": ["r"]},
}


def dumped(value, depth=0):
    """Block-style YAML of nested dicts, lists and plain values."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:" + (f" {json.dumps(v)}\n" if not (isinstance(v, (dict, list)) and v) else "\n" + dumped(v, depth + 1)) for k, v in value.items())
    return "".join(f"{pad}- {json.dumps(v)}\n" for v in value)


def test_manifests_from_files(spark, tmp_path):
    pytest.importorskip("yaml")
    write = lambda name, text: (tmp_path / name).write_text(text) and f"file:{tmp_path / name}"
    a, b = write("a.yml", dumped(TRAIN)), write("b.yml", dumped({**TRAIN, "feature_columns": ["d: 1", "d_3"]}))
    shared = {k: TRAIN[k] for k in ("behavior", "behavior_idx", "label_columns", "feature_columns", "window", "feature_selection", "training")}
    ensemble = lambda members, method: json.dumps({"manifest_type": "ensemble", **shared, "aggregation": {"method": method}, "members": [{"manifest_path": m} for m in members]})
    both = write("both.yml", ensemble([f"file://{tmp_path}/a.yml", f"file://{tmp_path}/b.yml"], "mean_probability"))
    write("one.yml", ensemble(["x"], "mean_probability"))
    write("median.yml", ensemble(["x", "y"], "median"))
    write("list.yml", "- a\n- b\n")
    write("broken.yml", "a: [1\nb: }")
    write("lacking.yml", dumped({k: v for k, v in TRAIN.items() if k not in ("window", "artifacts")}))
    write("empty.yml", "# nothing\n")
    found = D.read_manifests(spark, f"{tmp_path}/*.yml")
    rows = {r.manifest_path.rsplit("/", 1)[1]: r for r in found.select("manifest_path", "kind", "error").collect()}
    assert {k for k, r in rows.items() if r.error is None} == {"a.yml", "b.yml", "both.yml"} and rows["both.yml"].kind == "ensemble" and rows["a.yml"].kind == "train"
    assert rows["one.yml"].error == "fewer than two members" and rows["median.yml"].error == "unsupported aggregation: median"
    assert rows["lacking.yml"].error == "missing keys: window, artifacts" and rows["list.yml"].error.endswith("not a mapping") and rows["broken.yml"].kind is None
    assert {(r.manifest_path.rsplit("/", 1)[1], r.key) for r in D.missing_keys(found).collect()} == {("lacking.yml", "window"), ("lacking.yml", "artifacts")}
    stale = {(r.member.rsplit("/", 1)[1], r.field) for r in D.stale_ensembles(found).collect()}
    assert stale == {("b.yml", "feature_columns")}, (stale, a, b, both)
    one = found.where(F.col("manifest_path").endswith("a.yml"))
    assert M.selected_thresholds(one).first().selected_threshold == 0.35 and sorted(r.stem for r in M.recusal_stems(one).collect()) == ["p", "q", "r"]
    wrong = D.read_manifests(spark, f"{tmp_path}/both.yml", "train").first()
    assert wrong.error.startswith("not of kind train")


def test_sources_on_foreign_subsets_equal_a_loop(spark):
    rng = random.Random(9)
    stems = [f"v{k}" for k in range(8)]
    windows = [(s, 5 * w, 5 * w + p, rng.randrange(2)) for s in stems for w in range(3) for p in range(10)]
    truth = {(s, f): max(t for a, _, g, t in windows if (a, g) == (s, f)) for s, _, f, _ in windows}
    sources = [("e0", "ensemble", "train_val", 0.5), ("e1", "ensemble", "train", 0.6), ("e2", "ensemble", "none", 0.5), ("m", "train", "train_val", 0.4)]
    members = [("e0", 0), ("e0", 1), ("e1", 0), ("e1", 2), ("e2", 1), ("e2", 2), ("m", 0)]
    seen = [(m, s, rng.choice(["train", "val"])) for m in range(3) for s in stems if rng.random() < 0.5]
    subsets = [("a", s) for s in stems[:5]] + [("b", s) for s in stems[3:]]
    pairs = list(itertools.product(["e0", "e1", "e2", "m"], "ab"))
    prob = lambda m, s, start, f: ((m + 1) * (int(s[1:]) + 3) * (start + 7) * (f + 1) % 97) / 97
    table = spark.createDataFrame
    ps, ss, ms, bs = table(pairs, "source string, subset string"), table(sources, "source string, kind string, policy string, threshold double"), table(members, "source string, member int"), table(subsets, "subset string, stem string")
    asked = []

    def score(rows):
        asked.append(rows.groupBy("stem", "start", "frame", "member").count().where("count > 1").count())
        s = F.substring("stem", 2, 9).cast("long")
        return rows.withColumn("prob", ((F.col("member") + 1) * (s + 3) * (F.col("start") + 7) * (F.col("frame") + 1) % 97) / 97)

    plan = E.scoring_plan(ps, ss, ms, bs, table(seen, "member int, stem string, part string"))
    rows = table(windows, "stem string, start int, frame int, truth int")
    frames = E.source_frames(rows, plan, ss, score)
    want = {}
    for (source, subset), (name, kind, policy, threshold) in itertools.product(pairs, sources):
        if name != source:
            continue
        for s in [x for b, x in subsets if b == subset]:
            out = {"train": {"train"}, "train_val": {"train", "val"}}.get(policy, set()) if kind == "ensemble" else set()
            used = [m for n, m in members if n == source and not any(a == m and b == s and part in out for a, b, part in seen)]
            for f in sorted({g for a, _, g, _ in windows if a == s}):
                values = [prob(m, s, start, f) for m in used for start in {w for a, w, g, _ in windows if (a, g) == (s, f)}]
                if values:
                    mean = sum(values) / len(values)
                    want[source, subset, s, f] = (round(mean, 9), truth[s, f], int(mean >= threshold))
    assert {(r.source, r.subset, r.stem, r.frame): (round(r.prob, 9), r.truth, r.pred) for r in frames.collect()} == want
    assert asked == [0]  # each window once for each member, whatever pairs want it
    coverage = {(r.source, r.subset): r for r in E.source_coverage(rows, ps, bs, frames, 10).collect()}
    assert all(coverage[p].n_scored_frames == sum(k[:2] == p for k in want) and coverage[p].n_total_videos == 5 for p in pairs)
    metrics = E.source_metrics(frames, ss, ms, E.source_coverage(rows, ps, bs, frames, 10), "both", 2, 1).collect()
    assert {(r.source, r.subset, r.level) for r in metrics} == {(*p, level) for p in pairs for level in ("frame", "episode")}
    assert {r.source: r.recusal_policy for r in metrics} == {"e0": "train_val", "e1": "train", "e2": "none", "m": "none"}
    episodes = {(r.source, r.subset): r for r in metrics if r.level == "episode"}
    errors = {(r.source, r.subset): r["count"] for r in E.source_errors(frames, 2, 1).groupBy("source", "subset").count().collect()}
    assert all(errors.get(p, 0) == episodes[p].fp + episodes[p].fn for p in pairs)
    with pytest.raises(ValueError):
        E.source_metrics(frames, ss, ms, frames, "video")


def test_problems_of_a_plan(spark):
    table = spark.createDataFrame
    pairs = table([("a", "s"), ("lost", "s"), ("a", "t"), ("b", "s"), ("c", "s"), ("d", "s")], "source string, subset string")
    sources = table([("a", "ensemble", "none", 0.5), ("b", "ensemble", "none", 0.5), ("c", "train", "none", 0.5), ("d", "ensemble", "all", 0.5)], "source string, kind string, policy string, threshold double")
    members = table([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("d", 0), ("d", 1)], "source string, member int")
    got = {(r.source, r.subset): r.problem for r in E.plan_problems(pairs, sources, members, table([("s", "v")], "subset string, stem string")).collect()}
    assert got == {("lost", "s"): "unknown source", ("a", "t"): "unknown subset", ("b", "s"): "fewer than two members", ("c", "s"): "not one model", ("d", "s"): "unknown policy"}


def test_guards_of_split_files(spark, tmp_path):
    for name, text in (("scalar.yml", "train: a\ntest: [b]\n"), ("lacking.yml", "train: [a]\n"), ("legacy.txt", "Train videos:\na\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            io.read_split(spark, str(tmp_path / name))
    (tmp_path / "inner.yml").write_text("train: [a]\nval: [b]\n")
    assert io.read_split(spark, str(tmp_path / "inner.yml"), ("train", "val")).count() == 2


def test_guards_of_pools(spark):
    windows = spark.createDataFrame([("a", 0, 0), ("a", 5, 0), ("b", 0, 2)], "stem string, start int, positives int")
    pool = lambda *rows: spark.createDataFrame(list(rows), "stem string, start int")
    assert S.matched_pool(pool(("a", 5)), windows).count() == 1
    for bad, all_windows in ((pool(("a", 5), ("a", 5)), windows), (pool(("c", 5)), windows), (pool(("b", 0)), windows), (pool(("a", 5)).limit(0), windows), (pool(("a", 5)), windows.union(windows.limit(1)))):
        with pytest.raises(ValueError):
            S.matched_pool(bad, all_windows)


def test_rows_with_an_error_text_are_part_of_a_batch(spark):
    columns = "outer_id string, inner_seed string, behavior string, subset string, level string, eval_returncode string, error string, f1 double, precision double, recall double, split_path string, val_split_path string, threshold_mode string, threshold double"
    rows = spark.createDataFrame([("o", str(k), "b", "test", "episode", code, text, f1, 0.5, 0.5, "/s/splits/p", "/s/splits/q", "fixed", 0.5) for k, (code, text, f1) in enumerate([("0", "late", 0.5), ("0.0", None, 0.5), ("1", None, 0.5), ("0", None, None), ("x", None, 0.5)])], columns)
    splits = spark.createDataFrame([("/t/splits/p", "P"), ("/t/splits/q", "Q")], "path string, signature string")
    batch = io.load_batch(rows, splits, "base", "b", "last")
    assert sorted(r.inner_seed for r in batch.collect()) == ["0", "1"]
    described = io.batch_metadata(batch, {"episode_matching_method": "largest"}).first()
    assert described.subset == ["test"] and described.levels == ["episode"] and described.episode_matching_method == "largest" and described.episode_overlap_denominator is None


def test_batches_that_agree_have_no_problem(spark):
    rows = spark.createDataFrame([(b, k, "o", str(i), "b", "test", "frame", "s", "v", "last", "fixed:0.5") for k, b in enumerate(["x", "y", "z"]) for i in range(3)], "batch string, batch_ord int, outer_id string, inner_seed string, behavior string, subset string, level string, split_signature string, val_split_signature string, checkpoint_policy string, threshold_policy string")
    order = rows.select("batch", "batch_ord").distinct()
    metadata = io.batch_metadata(rows, {}).join(order, "batch")
    assert S.batch_problems(rows, metadata).isEmpty()  # frames need no word on episodes
    episodes = rows.withColumn("level", F.when(F.col("batch") == "z", "episode").otherwise(F.col("level")))
    found = {(r.batch, r.problem) for r in S.batch_problems(episodes, io.batch_metadata(episodes, {}).join(order, "batch")).collect()}
    assert {("x", "episode_matching_method"), ("z", "missing"), ("z", "extra")} <= found and ("y", "missing") not in found


def test_scores_of_candidates(spark):
    frames = spark.createDataFrame([(m, "a", f, 0.9 if f in hits else 0.1, int(f < 4)) for m, hits in (("one", {0, 1, 2, 3}), ("two", {0, 1}), ("three", set())) for f in range(10)], "manifest_path string, stem string, frame int, prob double, truth int")
    assert [(r.manifest_path, r.score, r.score_level) for r in S.score_candidates(frames, "frame_recall").collect()] == [("one", 1.0, "frame"), ("two", 0.5, "frame"), ("three", 0.0, "frame")]
    assert {r.manifest_path: r.score for r in S.score_candidates(frames, "episode_f1", 0.5, 2, 0).collect()} == {"one": 1.0, "two": 1.0, "three": 0.0}
    with pytest.raises(ValueError):
        S.score_candidates(frames, "video_f1")


def test_summaries_of_data_sets(spark):
    rows = spark.createDataFrame([("train", "a", 1, 0), ("train", "b", 0, 0), ("val", "c", 0, 1)], "subset string, stem string, walk int, wing int")
    summary = T.dataset_summary(rows, ["walk", "wing"])
    assert {(r.subset, r.behavior): (r.n_rows, r.n_videos, r.positives, r.state) for r in summary.collect()} == {("train", "walk"): (2, 2, 1, "ok"), ("train", "wing"): (2, 2, 0, "error"), ("val", "walk"): (1, 1, 0, "warning"), ("val", "wing"): (1, 1, 1, "ok")}
    with pytest.raises(ValueError, match="wing"):
        T.require_positives(summary)
    assert T.require_positives(summary.where("behavior = 'walk'")).count() == 2
    windows = spark.createDataFrame([("a", k, int(k < 3)) for k in range(10)], "stem string, start int, positives int")
    with pytest.raises(ValueError):
        T.sampling_summary(windows, 4, windows.limit(1), (1, 1, 1))
    one = T.sampling_summary(windows, 4, windows.where("start in (1, 5, 6)"), (1, 1, 2)).first()
    assert (one.n_positive_windows, one.n_hard_negative_windows, one.n_random_negative_windows, one.steps_per_epoch, one.samples_per_epoch) == (3, 2, 5, 3, 12)
