"""The wide mask queries that run on every slide."""

import numpy as np
import pytest

from tissuegrid.catalog import QUERIES
from tissuegrid.catalog import fixtures as fx

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["r4_wide_all_fill_holes", "w7_wide_all_dilate", "w8_wide_all_closing"])
def test_every_slide_is_read(spark, name):
    slides = fx.wide(spark, PATH).select("slide_id").distinct().count()
    lines = QUERIES[name](spark, PATH).groupBy("slide_id").count().collect()
    assert len(lines) == slides and {r["count"] for r in lines} == {fx.WIDE_H}


def plain_fill(m):
    """Background that does not reach the border over sides becomes foreground; runs are swept down and up."""
    bg = m == 0
    starts = bg & ~np.pad(bg, ((0, 0), (1, 0)))[:, :-1]
    run = np.cumsum(starts).reshape(m.shape) * bg
    reach = np.zeros(starts.sum() + 1, bool)
    for edge in (run[0], run[-1], run[:, 0], run[:, -1]):
        reach[edge] = True
    reach[0] = False
    while True:
        before = reach.sum()
        for lines in (range(1, len(m)), range(len(m) - 2, -1, -1)):
            for r in lines:
                other = run[r - 1] if lines.step == 1 else run[r + 1]
                reach[run[r][reach[other]]] = True
                reach[0] = False
        if reach.sum() == before:
            return np.where(bg & ~reach[run], 1, m)


def test_wide_holes_equal_brute_force(spark):
    cells = fx.wide(spark, PATH).toPandas()
    wanted = {}
    for slide, own in cells.groupby("slide_id"):
        m = np.zeros((fx.WIDE_H + 3, fx.WIDE_W + 3), int)
        for dr in range(-1, 3):  # dilation by an even kernel leans to the right
            for dc in range(-1, 3):
                m[own.r + dr * -1 + 2, own.c + dc * -1 + 2] = 1
        m = plain_fill(m[2 : 2 + fx.WIDE_H, 2 : 2 + fx.WIDE_W])
        c = np.arange(fx.WIDE_W)
        for r in range(fx.WIDE_H):
            wanted[slide, r] = (m[r].sum(), (m[r] * c).sum(), (m[r] * c * c).sum())
    got = {(r["slide_id"], r["r"]): (r["n"], r["c_sum"], r["c2_sum"]) for r in QUERIES["r4_wide_all_fill_holes"](spark, PATH).collect()}
    assert got == wanted
