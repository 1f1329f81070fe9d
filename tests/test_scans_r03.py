"""Segments, merge trees, pools by rounds, statistics and seeded orders against plain loops on random input."""

import json
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitline.operators import lives as L
from gaitline.operators import permutation as P
from gaitline.operators import segments as G
from gaitline.operators import selection as S
from gaitline.operators import statistics as T
from gaitline.sources import io


def plain_bouts(rows, at, least, gap):
    """Islands of each stem by a walk: stem, positions, frames, positives, rows, total and most."""
    out, by = [], {}
    for stem, frame, p in rows:
        by.setdefault(stem, []).append((frame, p))
    for stem, v in by.items():
        v.sort()
        found = []
        for i, (_, p) in enumerate(v):
            if p is not None and p >= at:
                if found and i - found[-1][1] - 1 <= gap:
                    found[-1][1:] = [i, found[-1][2] + 1]
                else:
                    found.append([i, i, 1])
        for k, (a, b, n) in enumerate(found):
            if k == len(found) - 1 and len(v) - 1 - b <= gap:
                b = len(v) - 1
            if n >= least:
                values = [p for _, p in v[a : b + 1] if p is not None]
                out.append((stem, a, b, v[a][0], v[b][0], n, b - a + 1, round(sum(values), 6), max(values)))
    return sorted(out)


def random_frames(rng, stems=20, longest=80, dense=0.4):
    rows = []
    for s in range(stems):
        frame = 0
        for _ in range(rng.randrange(1, longest)):
            frame += rng.choice([1, 1, 1, 2, 9])
            rows.append((f"v{s}", frame, None if rng.random() < 0.03 else round(rng.uniform(0.5, 1) if rng.random() < dense else rng.uniform(0, 0.49), 2)))
    return rows


@pytest.mark.parametrize("segment, gap, least, dense", [(4, 1, 1, 0.4), (4, 5, 2, 0.15), (3, 10, 1, 0.1), (2, 3, 2, 0.3), (1000, 2, 3, 0.5)])
def test_bouts_by_segments(spark, segment, gap, least, dense):
    rows = random_frames(random.Random(segment * gap), dense=dense)
    df = spark.createDataFrame(rows, "stem string, frame int, prob double")
    got = G.segmented_bouts(df, F.col("prob") >= 0.5, least, gap, value=F.col("prob"), segment=segment)
    assert sorted((r.stem, r.start_pos, r.end_pos, r.start_frame, r.end_frame, r.n_positive, r.n_frames, round(r.total, 6), r.most) for r in got.collect()) == plain_bouts(rows, 0.5, least, gap)


def test_no_window_over_a_whole_video(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "stem string, frame int, prob double")
    plan = G.segmented_bouts(df, F.col("prob") >= 0.5)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("row_number()") :].split("\n")[0]
    assert "__seg" in first.split("], [")[1], first  # frames are numbered within a segment


@pytest.mark.parametrize("segment, gap, least", [(5, 1, 1), (8, 3, 2), (1000, 0, 1)])
def test_lives_of_bouts(spark, segment, gap, least):
    rows = random_frames(random.Random(segment), stems=10)
    df = spark.createDataFrame(rows, "stem string, frame int, prob double")
    grid = [0.3, 0.35, 0.42, 0.5, 0.6, 0.9, 0.95]
    lives = L.bout_lives(df, min(grid), least, gap, segment=segment)
    want = sorted((t, *r[:6]) for t in grid for r in plain_bouts(rows, t, least, gap))
    assert sorted(map(tuple, L.lives_at(lives, grid).select("threshold", "stem", "start_pos", "end_pos", "start_frame", "end_frame", "n_positive").collect())) == want
    totals = {r.threshold: (r.n_bouts, r.positives) for r in L.totals_at(lives, grid).collect()}
    assert totals == {t: (sum(w[0] == t for w in want), sum(w[6] for w in want if w[0] == t)) for t in grid}
    assert lives.count() <= len(rows)


def plain_pool(rows, fraction, separation):
    taken, out = {}, []
    for stem, start, h, m in sorted(rows, key=lambda r: (-r[2], -r[3], r[0], r[1])):
        if all(abs(start - x) >= separation for x in taken.get(stem, [])):
            taken.setdefault(stem, []).append(start)
            out.append((len(out) + 1, stem, start))
        if len(out) >= math.ceil(len(rows) * fraction):
            break
    return out


@pytest.mark.parametrize("fraction, separation, rounds, passes", [(1.0, 12, 2, 1), (0.5, 60, 4, 6), (1.0, 0, 4, 6)])
def test_pools_by_rounds(spark, fraction, separation, rounds, passes):
    """One stem has half of all windows and steadily rising scores, which a single pass of two rounds leaves to the pieces."""
    rng = random.Random(separation)
    rows = [(f"v{s}", 5 * k, rng.choice([0.1, 0.2, 0.3]) if s else k / 1000, rng.choice([0.5, 0.6])) for s in range(4) for k in range(rng.choice([3, 100]) if s else 250)] + [("v0", 100, 0.9, 0.9)] * 2
    scores = spark.createDataFrame(rows, "stem string, start int, hardness double, max_probability double")
    assert [(r.pool_rank, r.stem, r.start) for r in S.diverse_pool(scores, fraction, separation, rounds, passes).collect()] == plain_pool(rows, fraction, separation)
    with pytest.raises(ValueError):
        S.diverse_pool(scores.limit(0), fraction, separation)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), rng.integers(0, 3, 4000).astype(float), np.array([7.0]), np.r_[rng.normal(size=500) * 1e-9, 1e300, -1e300]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        got = {r.fraction: r.value for r in T.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
        assert all(got[q] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-12) for q in got)
    assert T.exact_quantiles(df.limit(0), "x").first().value is None
    with pytest.raises(ValueError):
        T.exact_quantiles(df, "x", (1.5,))


def test_moments_after_coming_and_going(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{k % 5}", float(a), None if k % 7 == 0 else float(b) + 1e6, 3.0) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    names = "stem string, distance_a_b double, distance_c_d double, distance_e_f double"
    df = spark.createDataFrame(rows, names)
    own = T.column_moments(df)
    changed = spark.createDataFrame([("v1", 5.0, 2.0, 3.0), ("new", 1.0, None, 3.0)], names)
    now = T.replace_moments(own, T.column_moments(changed), spark.createDataFrame([("v3",)], "stem string"))
    left = np.array([r[1:] for r in rows if r[0] not in ("v1", "v3")] + [(5.0, 2.0, 3.0), (1.0, None, 3.0)], dtype=float)
    for r in T.scalers_of(now).collect():
        column = left[:, ["distance_a_b", "distance_c_d", "distance_e_f"].index(r.column)]
        deviation = np.nanstd(column)
        assert r.mean == pytest.approx(np.nanmean(column), rel=1e-9) and r.scale == pytest.approx(deviation if deviation else 1.0, rel=1e-9)


def test_signatures_of_tables(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAVES", 2)  # a tree of several levels
    rows = [(k, f"t{k % 50}", None if k % 9 == 0 else k / 3) for k in range(400)] + [(1, "t1", 1 / 3)] * 3
    df = spark.createDataFrame(rows, "a long, b string, c double")
    sign = lambda d: T.table_signature(d, ["a", "b", "c"]).first().signature
    whole = sign(df)
    assert sign(df.repartition(7)) == sign(df.orderBy(F.desc("b")).coalesce(1)) == whole
    others = [sign(df.where("a <> 17")), sign(df.unionByName(df.where("a = 17"))), sign(df.withColumn("c", F.when(F.col("a") == 200, 0.0).otherwise(F.col("c"))))]
    assert len({whole, *others}) == 4
    by = {r.b: r.signature for r in T.table_signature(df, ["a", "c"], ("b",)).collect()}
    assert len(by) == 50 and len(set(by.values())) == 50


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 1001])
def test_permutations_are_bijections(spark, size):
    got = [r.p for r in spark.range(size).select(P.permuted(F.col("id"), size, "7:0").alias("p")).collect()]
    assert sorted(got) == list(range(size))
    if size > 90:
        again = [r.p for r in spark.range(size).select(P.permuted(F.col("id"), size, "7:1").alias("p")).collect()]
        assert got != again and got != sorted(got) and abs(np.corrcoef(got, range(size))[0, 1]) < 0.3


def test_epochs_of_permuted_rows(spark):
    items = spark.createDataFrame([(f"s{k % 7}", k, ("positive", "hard", "random")[min(k % 5, 2)]) for k in range(103)], "stem string, start int, stratum string")
    rows, n = P.numbered(items, ["stem", "start"])
    batches = P.epoch_batches(rows, n, 10, 1, 0).groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in batches) == [(k, 10) for k in range(10)] + [(10, 3)]
    ranked = S.rank_within(items, ["stratum"], ["stem", "start"]).withColumn("number", F.col("rn") - 1).drop("rn", "n")
    sizes = {r.stratum: r["count"] for r in items.groupBy("stratum").count().collect()}
    drawn = P.epoch_draws(ranked, sizes, {"positive": 1, "hard": 3, "random": 4}, 8, 3)
    steps = drawn.groupBy("step", "stratum").count().collect()
    assert {(r.stratum, r["count"]) for r in steps} == {("positive", 1), ("hard", 3), ("random", 4)} and len({r.step for r in steps}) == 13
    assert drawn.groupBy("stem", "start", "round").count().where("count > 1").isEmpty()
    for bad in ({"positive": 8}, {"positive": 4, "lost": 4}, {"positive": 9, "hard": -1}):
        with pytest.raises(ValueError):
            P.epoch_draws(ranked, {k: v for k, v in sizes.items() if k != "positive"}, bad, 8, 3)


def test_a_long_video_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, "long").otherwise(F.concat(F.lit("v"), (F.col("id") % 30).cast("string"))).alias("stem"), F.col("id").cast("int").alias("frame"), F.lit(0.5).alias("prob"))
    io.write_by_stem(df, str(tmp_path / "t"), 300)
    files = [p.parent.name for p in (tmp_path / "t").glob("stem=*/*.parquet")]
    assert files.count("stem=long") > 1 and all(files.count(f"stem=v{k}") == 1 for k in range(30))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 3000 and sorted(back.columns) == ["frame", "prob", "stem"]
    io.write_by_stem(df.drop("frame"), str(tmp_path / "u"), 300)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3000


def test_entry_without_the_training_data_operators():
    """In a process in which the subpackage can't be imported, all other queries are there."""
    code = "import sys, json; sys.modules['gaitline.llm'] = None\nimport __spark_entry__ as e\nprint(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(io.__file__).rsplit("/gaitline/", 1)[0])
    names, sql = json.loads(done.stdout)
    assert "a10_bout_table" in names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(sql) <= set(names)
