"""Pools, matchings and splits equal brute force without a global limit, whole-stem groups or single-task ranks."""

import hashlib
import random

import pandas as pd

from gaitline.operators import bouts as B
from gaitline.operators import selection as S


def plan(df):
    return df._jdf.queryExecution().toString()


def test_diverse_pool_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(s, start, rng.random(), rng.random(), 0.5) for s in "abc" for start in rng.sample(range(0, 3000, 10), 80)]
    got = S.diverse_pool(spark.createDataFrame(rows, "stem string, start long, hardness double, max_probability double, mean_probability double"), 0.3, 60)
    want = []
    for r in sorted(rows, key=lambda r: (-r[2], -r[3], r[0], r[1])):
        if all(r[0] != w[0] or abs(r[1] - w[1]) >= 60 for w in want):
            want.append(r)
    assert [tuple(r) for r in got.collect()] == [(*w, k) for k, w in enumerate(want[:72], 1)]  # pool_rank comes last
    assert "Limit" not in plan(got)


def test_matching_in_pieces(spark):
    rng = random.Random(2)
    pairs = sorted({(p, p + 9, t, t + 9, 10 - abs(p - t)) for base in range(0, 2000, 50) for p in rng.sample(range(base, base + 20), 3) for t in rng.sample(range(base, base + 20), 3) if abs(p - t) < 10})
    df = spark.createDataFrame([("a", *r) for r in pairs], "stem string, pred_start long, pred_end long, true_start long, true_end long, overlap long")
    got = B.match_bouts(df)
    assert {(r.pred_start, r.true_start) for r in got.collect()} == set(B.largest_matching([(p, t, o) for p, _, t, _, o in pairs]).items())
    assert "__piece" in plan(got)


def test_splits_rank_by_ranges(spark):
    stems = spark.createDataFrame(pd.DataFrame({"stem": [f"v{i}" for i in range(50)]}))
    got = S.split_stems(stems, spark.createDataFrame([(1,), (2,)], "seed int"), 0.2)
    for seed in (1, 2):
        order = sorted((f"v{i}" for i in range(50)), key=lambda s: hashlib.md5(f"{seed}:{s}".encode()).hexdigest())
        assert {r.stem for r in got.where(f"seed = {seed} and subset = 'test'").collect()} == set(order[:10])
    assert "row_number" not in plan(got)
