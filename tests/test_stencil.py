"""Convolution over the tile grid against a dense one."""

import numpy as np
import pytest

from tissuegrid.operators import stencil

SCHEMA = "slide_id string, gx int, gy int, features array<double>, _bx int, x string"


def made_up(seed=1, n=500, width=3, span=80):
    rng = np.random.default_rng(seed)
    rows = []
    for slide in ("a", "b", None):
        for _ in range(n):
            f = rng.normal(size=width).round(3) if rng.random() > 0.15 else np.zeros(width)
            rows.append((slide, int(rng.integers(0, span)), int(rng.integers(0, span)), f.tolist(), 1, "x"))
    return rows


def plain(rows, kernels, residual, mix, width):
    out = {}
    for slide in {r[0] for r in rows}:
        cells = {}
        for s, x, y, f, *_ in rows:
            if s == slide:
                cells[x, y] = cells.get((x, y), np.zeros(width)) + np.array(f if f is not None else [0.0] * width)
        for (x, y), own in cells.items():
            total = np.zeros(width)
            for k in kernels:
                first = (k.shape[0] - 1) // 2
                for i in range(k.shape[0]):
                    for j in range(k.shape[1]):
                        total += k[i, j] * cells.get((x + i - first, y + j - first), np.zeros(width))
            made = total if mix is None else total @ mix
            made = made + own if residual else made
            out[slide, x, y] = made if own.any() else np.zeros_like(made)
    return out


@pytest.mark.parametrize("sizes,residual,mixed", [((3,), True, False), ((7, 5, 3), True, True), ((4, 1), False, True), ((40,), False, False)])
def test_equals_a_dense_convolution(spark, sizes, residual, mixed):
    rng = np.random.default_rng(sum(sizes))
    kernels = [rng.normal(size=(k, k, 3)) for k in sizes]
    mix = rng.normal(size=(3, 3 if residual else 5)) if mixed else None
    rows = made_up(n=150 if sizes == (40,) else 500)
    got = stencil.grid_convolve(spark.createDataFrame(rows, SCHEMA), kernels, residual=residual, pointwise=mix)
    found = {(r["slide_id"], r["gx"], r["gy"]): np.array(r["features"]) for r in got.collect()}
    wanted = plain(rows, kernels, residual, mix, 3)
    assert len(found) == got.count() and set(found) == set(wanted)
    assert all(np.allclose(found[c], wanted[c]) for c in wanted)


def test_one_shuffle_for_many_kernels(spark):
    got = stencil.grid_convolve(spark.createDataFrame(made_up(n=5), SCHEMA), [np.ones((k, k, 3)) for k in (3, 5, 7)])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_awkward_cells(spark):
    rows = [("a", 0, 0, None, 1, "x"), ("a", 0, 1, [1.0], 1, "x"), ("a", 0, 1, [1.0], 1, "x"), ("a", -40, 5, [2.0], 1, "x"), ("a", None, 5, [2.0], 1, "x"), (None, 1, 1, [3.0], 1, "x")]
    got = stencil.grid_convolve(spark.createDataFrame(rows, SCHEMA), [np.ones((3, 3, 1))], residual=False)
    assert {(r["slide_id"], r["gx"], r["gy"]): r["features"] for r in got.collect()} == {
        ("a", 0, 0): [0.0], ("a", 0, 1): [2.0], ("a", -40, 5): [2.0], (None, 1, 1): [3.0],
    }
    assert stencil.grid_convolve(spark.createDataFrame([], SCHEMA), [np.ones((3, 3, 1))]).collect() == []
    with pytest.raises(ValueError):
        stencil.grid_convolve(spark.createDataFrame([], SCHEMA), [np.ones((3, 2, 1))])
