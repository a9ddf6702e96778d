"""Steps whose work or memory would fall to one task on tables of many slides."""

import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import grid, patches


@pytest.fixture
def five_parts(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield 5
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_points_of_small_boxes_are_spread(spark, five_parts):
    boxes = spark.range(40).selectExpr("id AS slide_id", "0L AS row_min", "9L AS row_max", "0L AS col_min", "9L AS col_max").coalesce(1)
    points = grid.grid_points(boxes, F.lit(4), 0.0)
    assert points.rdd.getNumPartitions() == five_parts and points.count() == 40 * 9


def test_repeated_cells_are_never_broadcast(spark):
    rows = [(s, i % 6, i % 4, [float(i), 1.0]) for s in (1, 2) for i in range(40)] + [(1, 9, 9, [2.0, 3.0]), (1, 9, 8, None)]
    tiles = spark.createDataFrame(rows, "slide_id long, gx int, gy int, features array<double>")
    merged = patches.coalesce_cells(tiles)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = {(1, 9, 9): [2.0, 3.0], (1, 9, 8): None}
    for s, x, y, f in rows[:-2]:
        a = want.setdefault((s, x, y), [0.0, 0.0])
        want[s, x, y] = [a[0] + f[0], a[1] + f[1]]
    assert merged.count() == len(want) and {(r.slide_id, r.gx, r.gy): r.features for r in merged.collect()} == want


def test_heatmap_moves_changes_not_pixels(spark):
    shape = spark.createDataFrame([(1, 30, 40), (2, 5, 6), (3, 1, 1)], "slide_id long, h long, w long")
    rows = [(1, x, y, 2.0, s) for x in range(-6, 90, 7) for y in range(-6, 70, 9) for s in (8, 5)] + [(2, 3, 3, 1.0, 50)] + [(2, 0, 0, 1.0, 2)] * 3 + [(9, 0, 0, 1.0, 2)]
    coords = spark.createDataFrame(rows, "slide_id long, x long, y long, scale double, size int")
    found = grid.heatmap(coords, shape)
    got = {(r.slide_id, r.r, r.c): r.n for r in found.collect()}
    want = {(s, r, c): 0 for s, h, w in ((1, 30, 40), (2, 5, 6), (3, 1, 1)) for r in range(h) for c in range(w)}
    for s, x, y, scale, size in rows:
        r0, c0, side = round(y / scale), round(x / scale), round(size / scale)
        for r in range(r0, r0 + side):
            for c in range(c0, c0 + side):
                if (s, r, c) in want:
                    want[s, r, c] += 1
    assert got == want and found.count() == len(want)
    # one row of a pixel a line would be 30 x 40 of them in the shuffle
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and found.schema["n"].dataType.simpleString() == "bigint"
