"""Holes within a block are filled where it is labelled; what crosses blocks is decided from runs."""

import numpy as np
import pytest

from tissuegrid.operators import components, mask
from tissuegrid.operators.words import frame_words, pack_cells, pack_mask

from test_wide_masks import plain_fill

SIZES = {1: (300, 530), 2: (256, 256), 3: (257, 256), 4: (1, 1), 5: (513, 70), 6: (40, 64)}


def masks(seed, share):
    rng = np.random.default_rng(seed)
    out = {}
    for s, (h, w) in SIZES.items():
        m = (rng.random((h, w)) < share).astype(int)
        for _ in range(h * w // 900):  # frames, so that there are holes of all sizes, some over borders of blocks
            r, c, k = rng.integers(0, max(h - 3, 1)), rng.integers(0, max(w - 3, 1)), rng.integers(2, 60)
            m[r : r + k, c] = m[r : r + k, min(c + k, w - 1)] = 1
            m[r, c : c + k] = m[min(r + k, h - 1), c : c + k + 1] = 1
        out[s] = m
    # a ring around the corner in which four blocks meet, open by one pixel on slide 2's last line only
    out[1][230:280, 230:280] = 0
    out[1][230, 230:281] = out[1][280, 230:281] = out[1][230:281, 230] = out[1][230:281, 280] = 1
    out[2][250:, 10] = out[2][250:, 20] = out[2][250, 10:21] = 1
    out[2][251:, 11:20] = 0
    return out


def frame(spark, found):
    cells = [(s, r, c, int(v)) for s, m in found.items() for (r, c), v in np.ndenumerate(m)]
    return spark.createDataFrame(cells, "slide_id long, r int, c int, v int")


@pytest.mark.parametrize("seed,share", [(1, 0.02), (2, 0.35), (3, 0.6)])
def test_filled_masks_equal_brute_force(spark, seed, share):
    found = masks(seed, share)
    got = {s: np.full(m.shape, -1) for s, m in found.items()}
    rows = mask.fill_holes(frame(spark, found)).toPandas()
    assert len(rows) == sum(m.size for m in found.values())
    for s, own in rows.groupby("slide_id"):
        got[s][own.r, own.c] = own.v
    for s, m in found.items():
        assert (got[s] == plain_fill(m)).all(), s
    assert got[1][255, 255] == 1 and got[2][255, 15] == 0


def test_a_ragged_mask_is_judged_by_its_largest_line_and_column(spark):
    # line 5 ends at column 3: its cell there lies on no side of the 10 x 10 slide
    m = np.ones((10, 10), int)
    m[5, 3] = 0
    rows = frame(spark, {1: m}).where("NOT (r = 5 AND c > 3)")
    assert {(x.r, x.c): x.v for x in mask.fill_holes(rows).collect()}[5, 3] == 1


def test_holes_of_a_block_are_no_rows(spark):
    m = np.zeros((250, 250), int)
    m[1::4, :] = 1
    m[:, 1::4] = 1  # thousands of holes
    stored = components.fill_in_blocks(pack_mask(frame(spark, {1: m, 2: m[:200]})))
    runs = stored.where("label IS NOT NULL").collect()
    assert runs and all(x.open or x.r in (198, 199) for x in runs) and len(runs) < 800
    assert stored.where("label IS NULL").count() == 450 * 4


def test_edges_of_settled_labels_are_left_out(spark):
    runs = [(1, 255, 0, 9, 1, True), (1, 256, 0, 9, 2, True), (1, 255, 20, 29, 3, True), (1, 256, 20, 29, 4, False), (1, 255, 40, 49, 5, False), (1, 256, 45, 49, 6, False)]
    df = spark.createDataFrame(runs, "slide_id long, r int, c0 int, c1 int, label long, open boolean")
    assert {(x.a, x.b) for x in components.border_edges(df, 4, settled="open").collect()} == {(3, 4), (5, 6)}
    assert {(x.a, x.b) for x in components.border_edges(df, 4).collect()} == {(1, 2), (3, 4), (5, 6)}


def test_a_frame_reads_its_words_once(spark):
    words = pack_cells(spark.createDataFrame([(1, 0, 0), (1, 2, 70), (2, 9, 9), (3, 1, 1), (3, 1, 2)], "slide_id long, r int, c int"))
    framed = frame_words(words, 5, 100)
    plan = framed._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    rows = {(x.slide_id, x.r, x.wi): x.bits for x in framed.collect()}
    assert set(rows) == {(s, r, w) for s in (1, 2, 3) for r in range(5) for w in (0, 1)}
    assert {k: v for k, v in rows.items() if v} == {(1, 0, 0): 1, (1, 2, 1): 1 << 6, (3, 1, 0): 6}


def test_bars_are_dealt_before_they_are_pixels(spark):
    from tissuegrid.catalog import fixtures as fx

    plan = fx.wide_bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
