"""Rows made by an explode pass for a small table; no plan may broadcast them."""

import pytest

from tissuegrid.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


def joins(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line]


@pytest.mark.parametrize("name", ["a14_block_max_pool", "a21_triangle_threshold", "g5_minmax_255", "r7_regrid_mask", "v11_random_crop"])
def test_only_the_row_of_a_slide_is_broadcast_to_its_pixels(spark, name):
    found = joins(spark, name)
    assert found and all("LeftOuter" in line for line in found)


@pytest.mark.parametrize("name", ["j6_coverage_lookup", "w2_coverage_filter"])
def test_tables_as_long_as_the_pixels_are_sorted_and_merged(spark, name):
    found = joins(spark, name)
    assert found and all("SortMergeJoin" in line for line in found)


def test_pixels_of_one_file_are_spread_before_they_are_made(spark):
    from tissuegrid.catalog import fixtures as fx

    assert fx.mask(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_covering_side_leaves_rows_without_a_key_out(spark):
    from tissuegrid.functions.skew import attach_by_key

    df = spark.createDataFrame([(1, 5), (None, 6)], "k long, v int")
    side = df.groupBy("k").agg({"v": "max"})
    assert attach_by_key(df, side, ["k"], covers=True).collect() == attach_by_key(df, side, ["k"]).collect()


def test_crop_draws_are_made_once_a_bag_and_size(spark):
    from tissuegrid.operators.augment import random_crop

    rows = [(b, r, c, 4, 4) for b in (1, 2) for r in range(4) for c in range(4)] + [(None, 0, 0, 4, 4), (1, 0, 0, 4, None)]
    df = spark.createDataFrame(rows, "bag long, r int, c int, h int, w int")
    cropped = random_crop(df, 0.5, 1, ["bag"])
    plan = cropped._jdf.queryExecution().executedPlan().toString()
    assert plan.index("md5") > plan.index("Join")
    assert cropped.groupBy("bag").count().where("bag IS NOT NULL").count() == 2 and cropped.where("w IS NULL").count() == 0


def test_line_moments_of_words_equal_those_of_pixels(spark):
    import random

    from tissuegrid.operators.words import frame_words, line_moments, pack_cells, unpack_mask

    draw = random.Random(3)
    cells = [(s, draw.randrange(7), draw.randrange(150)) for s in (1, 2) for _ in range(300)] + [(3, 6, 149), (3, 7, 1), (3, 0, 150), (3, 2, 63)]
    words = frame_words(pack_cells(spark.createDataFrame(cells, "slide_id long, r int, c int")), 7, 150)
    kept = {x for x in cells if x[1] < 7 and x[2] < 150}
    mask = {(x.slide_id, x.r, x.c): x.v for x in unpack_mask(words).collect()}
    assert mask == {(s, r, c): int((s, r, c) in kept) for s in (1, 2, 3) for r in range(7) for c in range(150)}
    expected = {(s, r): [0, 0, 0] for s in (1, 2, 3) for r in range(7)}
    for s, r, c in kept:
        expected[s, r] = [a + b for a, b in zip(expected[s, r], (1, c, c * c))]
    assert {(x.slide_id, x.r): [x.n, x.c_sum, x.c2_sum] for x in line_moments(words).collect()} == expected


@pytest.mark.parametrize("name", ["w7_wide_all_dilate", "w8_wide_all_closing"])
def test_wide_masks_never_become_pixels(spark, name):
    assert not joins(spark, name)


def test_a_byte_does_not_hang_on_the_last_bit_of_a_mean(spark):
    from pyspark.sql import functions as F

    from tissuegrid.operators.stain import reinhard

    # spread and target are such that values are whole numbers but for the last bits
    rows = [(i, *[0.1 * (k * i % 7) for _ in range(3)]) for i in range(1, 200) for k in range(7)]
    pixels = spark.createDataFrame(rows, "image_id long, ch0 double, ch1 double, ch2 double")
    targets = pixels.select("image_id").distinct()
    for c in ("ch0", "ch1", "ch2"):
        targets = targets.withColumn(f"{c}_target_mean", F.lit(100.0)).withColumn(f"{c}_target_std", F.lit(40.0))
    plain, cut_off = (reinhard(pixels, targets, to_bytes=b).groupBy("image_id") for b in (False, True))
    whole = plain.agg(F.sum(F.floor(F.round("ch0", 7))).alias("v")).collect()
    assert {tuple(x) for x in whole} == {tuple(x) for x in cut_off.agg(F.sum("ch0").alias("v")).collect()}
