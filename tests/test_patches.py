"""Patches: closed forms, invariants and the inverse."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import patches as pt


def loop_starts(side, max_dim, overlap):
    step, limit = max(1, int(max_dim * (1 - overlap))), max(0, side - max_dim)
    return [min(s, limit) for s in range(0, limit + step, step)]


@pytest.mark.parametrize("max_dim,overlap", [(4, 0.25), (32, 0.1), (5, 0.0), (3, 0.9)])
def test_split_region_starts(spark, max_dim, overlap):
    sides = [(1, 1), (max_dim, max_dim), (max_dim + 1, 2), (97, 64), (130, 5)]
    rows = [(1, i, 10, 20, 10 + h, 20 + w, h * w) for i, (h, w) in enumerate(sides)]
    df = spark.createDataFrame(rows, "slide_id long, region_id int, r0 int, c0 int, r1 int, c1 int, area long")
    got = pt.split_region(df, max_dim, overlap).orderBy("patch_id").collect()
    assert [g.patch_id for g in got] == list(range(len(got)))
    want = []
    for i, (h, w) in enumerate(sides):
        fits = h <= max_dim and w <= max_dim
        for r in [0] if fits else loop_starts(h, max_dim, overlap):
            for c in [0] if fits else loop_starts(w, max_dim, overlap):
                want.append((i, r, c, min(r + max_dim, h), min(c + max_dim, w)))
    assert [(g.region_id, g.patch_row_start, g.patch_col_start, g.patch_row_end, g.patch_col_end) for g in got] == want


def test_split_region_even(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 10, 3)], "slide_id long, region_id int, r0 int, c0 int, r1 int, c1 int")
    got = sorted((r.row_start, r.col_start) for r in pt.split_region_even(df, 4).collect())
    assert got == [(0, 0), (3, 0), (6, 0)]


@pytest.fixture(scope="module")
def tiles(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        for x in range(23):
            for y in range(17):
                if rng.random() < 0.5:
                    v = [0.0, 0.0, 0.0] if rng.random() < 0.1 else rng.normal(size=3).round(3).tolist()
                    rows.append((s, x, y, v))
                    if rng.random() < 0.05:
                        rows.append((s, x, y, [-e for e in v]))  # cancels to a blank cell
    return spark.createDataFrame(rows, "slide_id long, gx int, gy int, features array<double>").cache()


def test_reconstruct_inverts_make_patches(tiles):
    merged = pt.coalesce_cells(tiles)
    active = merged.where(pt.active("features"))
    patches = pt.make_patches(tiles, 4, 0.25).cache()
    cells = pt.patch_cells(patches, active)
    back = pt.reconstruct(patches, cells).select("slide_id", F.col("row").alias("gx"), F.col("col").alias("gy"), "features")
    assert back.exceptAll(active).isEmpty() and active.exceptAll(back).isEmpty()


def test_patches_lie_in_regions_and_cover_cells(tiles):
    patches = pt.make_patches(tiles, 4, 0.25)
    inside = (F.col("patch_row_end") <= F.col("region_max_row") - F.col("region_min_row")) & (F.col("patch_row_start") >= 0)
    assert patches.where(~inside).isEmpty()
    cells = pt.active_cells(tiles)
    hit = pt.patch_cells(patches, cells).join(
        pt.patch_geometry(patches).select("slide_id", "patch_id", "row_start", "col_start"), ["slide_id", "patch_id"]
    ).select("slide_id", (F.col("row_start") + F.col("pr")).alias("gx"), (F.col("col_start") + F.col("pc")).alias("gy"))
    assert cells.join(hit.distinct(), ["slide_id", "gx", "gy"], "left_anti").isEmpty()


def test_later_blank_overwrites_earlier_value(spark):
    patch = "slide_id long, patch_id long, region_id int, " + ", ".join(f"{c} int" for c in pt.PATCH_INFO[1:])
    patches = spark.createDataFrame([(1, 0, 0, 0, 0, 2, 3, 0, 0, 2, 2), (1, 1, 0, 0, 0, 2, 3, 0, 1, 2, 3)], patch)
    cells = spark.createDataFrame([(1, 0, 0, 0, [1.0]), (1, 0, 0, 1, [2.0])], "slide_id long, patch_id long, pr int, pc int, features array<double>")
    got = [(r.row, r.col, r.features) for r in pt.reconstruct(patches, cells).collect()]
    # cell (0, 1) belongs to patch 1, which is blank there
    assert got == [(0, 0, [1.0])]
    assert pt.reconstructed_grid(patches).count() == 6


def test_repeated_cells_are_summed(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (1, 0, 0, [0.5, -2.0]), (1, 0, 1, [3.0, 4.0])], "slide_id long, gx int, gy int, features array<double>")
    assert sorted((r.gy, r.features) for r in pt.coalesce_cells(df).collect()) == [(0, [1.5, 0.0]), (1, [3.0, 4.0])]


def test_empty_tiles_give_schema(spark, tiles):
    none = pt.make_patches(tiles.where("slide_id < 0"), 4, 0.25)
    assert none.count() == 0 and "patch_col_end" in none.columns


def test_densify_is_channels_first(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, [1.0, 2.0]), (1, 0, 1, 0, [3.0, 4.0])], "slide_id long, patch_id long, pr int, pc int, features array<double>")
    dense = pt.densify(cells, 2, 2).first()["dense"]
    assert dense == [0.0, 1.0, 3.0, 0.0, 0.0, 2.0, 4.0, 0.0]


def test_feature_dim_disagreement_fails(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "slide_id long, features array<double>")
    with pytest.raises(Exception, match="different width"):
        pt.feature_dim(df).collect()


def test_incomplete_patch_record_fails(spark):
    patch = "slide_id long, patch_id long, region_id int, " + ", ".join(f"{c} int" for c in pt.PATCH_INFO[1:])
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 2, 3, 0, 0, None, 2)], patch)
    with pytest.raises(Exception, match="incomplete"):
        pt.patch_geometry(df).collect()


def test_repeated_cells_of_unequal_width_fail(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (1, 0, 0, [1.0, 2.0, 3.0])], "slide_id long, gx int, gy int, features array<double>")
    with pytest.raises(Exception):
        pt.coalesce_cells(df).collect()
