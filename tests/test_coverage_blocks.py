"""Coverage of boxes from blocks of running sums."""

import random

import numpy as np

from tissuegrid.operators import grid

BOX = "slide_id long, box_id long, r0 long, r1 long, c0 long, c1 long"


def made_up(seed=4):
    rng = random.Random(seed)
    shapes = {1: (130, 300), 2: (64, 128), 3: (63, 127), 4: (1, 1), 5: (65, 129)}
    masks = {s: np.array([[rng.randrange(3) for _ in range(w)] for _ in range(h)]) for s, (h, w) in shapes.items()}
    boxes = []
    for s, (h, w) in shapes.items():
        for k in range(120):
            r, c = sorted(rng.choices(range(h + 1), k=2)), sorted(rng.choices(range(w + 1), k=2))
            boxes.append((s, k, r[0], r[1], c[0], c[1]))
        boxes += [(s, 200, 0, h, 0, w), (s, 200, 0, 1, 0, 1), (s, 201, 0, h + 5, 0, w)]
    return masks, boxes


def pixels(spark, masks):
    rows = [(s, r, c, int(v)) for s, m in masks.items() for (r, c), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "slide_id long, r int, c int, v int")


def plain(masks, boxes):
    """Signed corners, as a corner that is no pixel counts as zero."""
    out = {}
    for s, k, r0, r1, c0, c1 in boxes:
        sums = masks[s].cumsum(axis=0).cumsum(axis=1) if s in masks else np.zeros((0, 0))
        at = lambda r, c: int(sums[r, c]) if None not in (r, c) and 0 <= r < sums.shape[0] and 0 <= c < sums.shape[1] else 0
        less = lambda x: None if x is None else x - 1
        r0, r1, c0, c1 = map(less, (r0, r1, c0, c1))
        out[s, k] = out.get((s, k), 0) + at(r1, c1) - at(r0, c1) - at(r1, c0) + at(r0, c0)
    return out


def test_boxes_over_many_blocks_equal_brute_force(spark):
    masks, boxes = made_up()
    boxes += [(9, 1, 0, 5, 0, 5), (None, 7, 0, 1, 0, 1), (1, 300, None, 5, 0, 4), (1, 301, 3, 100, 7, None), (1, 302, -70, 20, -200, 9), (1, 303, 900, 950, 2, 40)]
    sat = grid.integral_image(pixels(spark, masks))
    got = grid.coverage_lookup(spark.createDataFrame(boxes, BOX), sat).collect()
    assert {(x.slide_id, x.box_id): x.covered for x in got} == plain(masks, boxes) and len(got) == len({b[:2] for b in boxes})


def test_places_without_a_pixel_count_as_zero(spark):
    masks = {1: np.ones((70, 140), int)}
    sat = grid.integral_image(pixels(spark, masks)).where("(r * 7 + c) % 5 <> 0")
    boxes = [(1, k, k % 50, k % 50 + 9, k % 100, k % 100 + 21) for k in range(200)]
    kept = {(x.r, x.c): x.s for x in sat.collect()}
    want = {(1, k): kept.get((r1 - 1, c1 - 1), 0) - kept.get((r0 - 1, c1 - 1), 0) - kept.get((r1 - 1, c0 - 1), 0) + kept.get((r0 - 1, c0 - 1), 0) for _, k, r0, r1, c0, c1 in boxes}
    got = grid.coverage_lookup(spark.createDataFrame(boxes, BOX), sat).collect()
    assert {(x.slide_id, x.box_id): x.covered for x in got} == want


def test_sums_move_as_blocks_and_a_small_box_once(spark):
    masks = {s: np.ones((48, 64), int) for s in (1, 2, 3)}
    sat = grid.integral_image(pixels(spark, masks))
    assert grid._sum_blocks(sat).count() == 3
    boxes = spark.createDataFrame([(s, r * 64 + c, r, min(r + 5, 48), c, min(c + 9, 64)) for s in masks for r in range(48) for c in range(64)], BOX)
    found = grid.coverage_lookup(boxes, sat)
    assert {x.covered for x in found.where("box_id = 0").collect()} == {45}
    # before their shuffle boxes are as many as before, not four rows each
    asked = []
    keep = type(boxes).join
    try:
        type(boxes).join = lambda self, *a, **b: (asked.append(self.count()), keep(self, *a, **b))[-1]
        grid.coverage_lookup(boxes, sat)
    finally:
        type(boxes).join = keep
    assert asked == [boxes.count()]
