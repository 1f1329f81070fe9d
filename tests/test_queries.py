"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

from gaitline.operators import bouts as B
from gaitline.operators import features as X
from gaitline.plans import catalog
from gaitline.plans import fixtures as fx

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(float(x), 6) + 0.0 if isinstance(x, float) else x


def compare(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    by_name = lambda row, columns: str([plain(v) for _, v in sorted(zip(columns, row, strict=True))])
    assert sorted(by_name(tuple(r), df.columns) for r in df.collect()) == sorted(by_name(r, names) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, name):
    compare(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)


def test_matches_are_pairs_of_free_bouts(spark, sf):
    pred, truth = catalog.episodes(spark, sf)
    pairs = {(r.stem, r.pred_start, r.true_start) for r in B.eligible_pairs(pred, truth).collect()}
    found = [(r.stem, r.pred_start, r.true_start) for r in catalog.QUERIES["j6_match_bouts"](spark, sf).collect()]
    assert set(found) <= pairs and len({x[::2] for x in found}) == len({x[:2] for x in found}) == len(found) == catalog.QUERIES["a8_episode_metrics"](spark, sf).first().tp
    errors = catalog.QUERIES["j7_bout_errors"](spark, sf).collect()
    assert len(errors) == pred.count() + truth.count() - 2 * len(found)


def test_extracted_features_are_scaled_and_filled(spark, sf):
    raw = X.pose_features(fx.large_pose(spark, sf), fx.CONFIG)
    scaled = X.standardise(raw, X.fit_scalers(raw)).toPandas().set_index(["stem", "frame"]).sort_index()
    got = catalog.QUERIES["u4_extract_pipeline"](spark, sf).toPandas().set_index(["stem", "frame"]).sort_index()
    assert len(got) == len(scaled) and not got.isna().any().any()
    for c in [c for c in got.columns if c.startswith(("angle_", "distance_")) or "_velocity_" in c]:
        want = scaled[c].fillna(scaled[c].groupby(level="stem").transform("mean")).fillna(0.0)
        assert np.allclose(got[c], want, atol=1e-9)


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_where_the_training_data_operators_are_deleted(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "gaitline", tmp_path / "gaitline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not [k for k in q if k == 'pipeline' or k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
