"""Operator 6 on vectors of unequal lengths: recall against brute force, exact search, overflow and repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitline.llm import vptree


def found_and_wanted(spark, x, k=20, **options):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.neighbours(df, F.col("vec_id") % 20 == 0, k=k, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q in range(0, len(x), 20):
        with np.errstate(over="ignore", invalid="ignore"):
            score = x @ x[q]
        score = np.where(np.isnan(score), -np.inf, score)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:k]
        assert sorted(got[q]) == list(range(1, k + 1))
        hits += len({v for v, _ in got[q].values()} & set(want.tolist()))
        total += k
    return hits / total


def made(kind):
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(2000, 16))
    if kind == "log-normal lengths":
        return plain / np.linalg.norm(plain, axis=1)[:, None] * np.exp(1.5 * rng.normal(size=(2000, 1)))
    if kind == "clusters":
        return rng.normal(size=(30, 16))[rng.integers(0, 30, 2000)] + 0.1 * rng.normal(size=(2000, 16))
    plain[17] *= float(kind) / np.linalg.norm(plain[17])
    return plain


@pytest.mark.parametrize("kind", ["1", "1000", "1e200", "log-normal lengths", "clusters"])
def test_recall_whatever_the_lengths(spark, kind):
    assert found_and_wanted(spark, made(kind), shard_rows=500) >= 0.98


@pytest.mark.parametrize("kind", ["1000", "log-normal lengths"])
def test_factor_one_is_exact(spark, kind):
    assert found_and_wanted(spark, made(kind), shard_rows=300, factor=1.0) == 1


def test_ids_with_several_vectors_are_in_a_list_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.1]), (2, [0.1, 3.0]), (3, [0.2, 0.2]), (4, [-1.0, -1.0]), (5, [1e200, -1e200])]
    got = vptree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1, k=4).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 5, 1e200), (1, 2, 2, 3.0), (1, 3, 3, 0.2), (1, 4, 4, -1.0)]
