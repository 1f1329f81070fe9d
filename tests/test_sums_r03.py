"""Means of overlapping windows do not depend on the order in which rows arrive."""

from itertools import permutations

import duckdb
import pytest

from gaitline.operators import bouts as B
from gaitline.operators import evaluation as E
from gaitline.plans import fixtures as fx
from gaitline.plans import run_queries as R

# (0.3 + 0.2 + 0.1) / 3 is under 0.2, (0.1 + 0.2 + 0.3) / 3 is above it.
WINDOWS = [(0, 0.1), (5, 0.2), (10, 0.3)]


@pytest.mark.parametrize("rows", [WINDOWS, WINDOWS[::-1], [WINDOWS[1], WINDOWS[0], WINDOWS[2]]])
def test_a_frame_is_summed_from_its_latest_window(spark, rows):
    scored = spark.createDataFrame([("v", 10, s, p, 1) for s, p in rows], "stem string, frame int, start int, prob double, truth int").coalesce(1)
    assert [(r.prob, r.pred) for r in B.reconstruct(scored, 0.2).collect()] == [((0.3 + 0.2 + 0.1) / 3, 0)]


def test_members_are_summed_one_after_the_other_and_missing_values_left_out(spark):
    rows = [(1, 0, 0.3), (0, 0, 0.2), (0, 5, 0.1), (1, 5, None), (2, 0, None)]
    scored = spark.createDataFrame([("v", 5, *r, 0) for r in rows], "stem string, frame int, member int, start int, prob double, truth int").coalesce(1)
    assert [(r.prob, r.pred) for r in B.reconstruct(scored, 0.2).collect()] == [((0.1 + 0.2 + 0.3) / 3, 1)]
    assert B.reconstruct(scored.where("prob is null"), 0.2).count() == 0


def test_a_frame_whose_mean_is_the_threshold_reaches_it_in_whatever_order_its_rows_arrive(spark):
    # u4_evaluate_pipeline, frames of value 50 of a user that two members score: 2 of the 24 orders add up to less than 2
    scores = [(0, 45, 0.6), (0, 40, 0.55), (2, 45, 0.45), (2, 40, 0.4)]
    orders = list(permutations(scores))
    rows = [(f"v{k}", 45, *r, 1) for k, order in enumerate(orders) for r in order]
    assert sum(a[2] + b[2] + c[2] + d[2] < 2 for a, b, c, d in orders) == 2
    scored = spark.createDataFrame(rows, "stem string, frame int, member int, start int, prob double, truth int").coalesce(1)
    counts = B.binary_metrics(B.reconstruct(scored, 0.5), []).first()
    assert (counts.tp, counts.fp, counts.fn, counts.tn) == (24, 0, 0, 0)


@pytest.mark.parametrize("rows", [WINDOWS, WINDOWS[::-1]])
def test_frames_of_a_source_are_summed_from_the_last_member_and_latest_window(spark, rows):
    table = spark.createDataFrame
    windows = table([("v", 10, s, p, 1) for s, p in rows], "stem string, frame int, start int, prob double, truth int").coalesce(1)
    plan = table([("a", "s", 0, "v"), ("b", "s", 0, "v"), ("b", "s", 1, "v")], "source string, subset string, member int, stem string")
    sources = table([("a", "train", "none", 0.2), ("b", "ensemble", "none", 0.2)], "source string, kind string, policy string, threshold double")
    score = lambda x: x.selectExpr("member", "stem", "start", "frame", "truth", "case when member = 0 then prob when start = 0 then 0.7D end as prob")
    got = {r.source: (r.prob, r.pred) for r in E.source_frames(windows, plan, sources, score).collect()}
    assert got == {"a": ((0.3 + 0.2 + 0.1) / 3, 0), "b": ((0.7 + 0.3 + 0.2 + 0.1) / 4, 1)}


def test_members_of_the_fixtures_weigh_by_exact_tenths(spark):
    rows = [(0.5, 5 * k, m) for k in range(5) for m in range(3)]
    got = [r.prob for r in R.closed_form(spark.createDataFrame(rows, "prob double, start int, member int").coalesce(1)).collect()]
    want = duckdb.connect().execute("select least(1.0, p * (0.8 + 0.1 * ((s // 5 + m) % 5))) from (values " + ", ".join(f"({p}::double, {s}, {m})" for p, s, m in rows) + ") t(p, s, m)").fetchall()
    assert got == [w for (w,) in want] and 0.5 * 1.2 in got


def test_scores_of_members_equal_the_sql_to_the_last_bit(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = con.execute(f"with {fx.FRAMES}, {fx.WINDOWS}, {fx.MEMBER_SCORES} select member, stem, frame, start, prob from fx_members").fetchall()
    got = fx.member_scores(spark, sf).select("member", "stem", "frame", "start", "prob").collect()
    assert sorted(map(tuple, got)) == sorted(want)
