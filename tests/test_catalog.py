"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tissuegrid.catalog import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# listing: below, landmark attention: tests/test_landmarks.py, fitting: tests/test_fitting.py, holes of wide masks: tests/test_wide_masks.py
ROWS_ONLY = {"n5_landmark_attention", "n9_fit_head", "r4_wide_all_fill_holes", "s1_list_files"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(round(v + 0.0, 9))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, PATH)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_listing(spark):
    from tissuegrid.sources.files import list_files

    assert list_files(spark, PATH, ".parquet").where("size > 0").count() == len(TABLES.split())


def test_listing_query_names_every_file(spark):
    found = {r["name"]: r["size"] for r in QUERIES["s1_list_files"](spark, PATH).collect()}
    assert found == {f.name: f.stat().st_size for f in Path(PATH).glob("*.parquet")}
