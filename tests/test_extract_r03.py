"""Extraction keeps to one narrow shuffle: no table of features is written, none is shuffled."""

import os

from gaitline.operators import features as X
from gaitline.plans import catalog
from gaitline.plans import fixtures as fx


def test_extraction_writes_nothing_and_shuffles_its_rows_once(spark, sf):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    df = catalog.QUERIES["u4_extract_pipeline"](spark, sf)
    df.collect()
    assert set(os.listdir(folder)) == before
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1 and plan.count("ReusedExchange") == 2


def test_scaling_in_the_plan_equals_scalers_that_were_read(spark):
    rows = [("a", 0, 1.0, 3.0, None), ("a", 1, None, 3.0, None), ("b", 0, 5.0, 3.0, None), ("b", 1, 6.0, None, None)]
    features = spark.createDataFrame(rows, "stem string, frame int, angle_x double, distance_y double, distance_z double")
    want = X.standardise(X.impute_means(features), X.fit_scalers(features))
    got = X.imputed_and_standardised(features)
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.columns == want.columns
