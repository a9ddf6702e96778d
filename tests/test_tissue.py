"""Tissue mixture against a plain fit."""

import math

import numpy as np
import pytest

from tissuegrid.operators import tissue
from tissuegrid.params import ForegroundParams
from tissuegrid.plans import pipelines

SCHEMA = "slide_id string, r int, c int, gray double, bin string, n int"


def pixels(spark, slides):
    return spark.createDataFrame([(s, i // 20, i % 20, v, "x", 1) for s, values in slides.items() for i, v in enumerate(values)], SCHEMA)


def plain_density(values, bandwidth):
    n = [0] * 256
    for v in values:
        if v is not None:
            n[min(max(math.floor(v), 0), 255)] += 1
    reach = math.ceil(4 * bandwidth)
    return n, [sum(n[j] * math.exp(-0.5 * ((j - b) / bandwidth) ** 2) for j in range(max(0, b - reach), min(255, b + reach) + 1)) for b in range(256)]


def plain_share(b, p):
    part = lambda m, v: -0.5 * math.log(v) - (b - m) ** 2 / (2 * v)
    odds = math.log(p[0]) - math.log(1 - p[0]) + part(p[1], p[2]) - part(p[3], p[4])
    return 1 / (1 + math.exp(-max(min(odds, 700), -700)))


def plain_fit(values, bandwidth, rounds, tolerance):
    n, density = plain_density(values, bandwidth)
    if sum(x > 0 for x in n) < 2:
        return None
    total = [sum(d * b**k for b, d in enumerate(density)) for k in range(3)]

    def mixture(dark):
        bright = [t - d for t, d in zip(total, dark, strict=True)]
        out = [dark[0] / total[0]]
        for s in (dark, bright):
            m = s[1] / s[0]
            out += [m, max(s[2] / s[0] - m * m, 1.0)]
        return out

    p = mixture([sum(d * b**k for b, d in enumerate(density) if b <= total[1] / total[0]) for k in range(3)])
    for k in range(1, rounds + 1):
        dark = [sum(d * plain_share(b, p) * b**e for b, d in enumerate(density)) for e in range(3)]
        if not 1e-6 * total[0] <= dark[0] <= (1 - 1e-6) * total[0]:
            return p, k - 1, True
        q = mixture(dark)
        still = abs(q[1] - p[1]) < tolerance and abs(q[3] - p[3]) < tolerance
        p = q
        if still:
            return p, k, True
    return p, rounds, False


def slides():
    rng = np.random.default_rng(4)
    tissue_ = lambda n, m, s: rng.normal(m, s, n)
    return {
        "clear": np.concatenate([tissue_(150, 110, 25), tissue_(450, 235, 4)]).tolist(),
        "faint": np.concatenate([tissue_(40, 190, 12), tissue_(560, 230, 8)]).tolist(),
        "one part": rng.uniform(0, 255, 400).tolist(),
        "beyond": [-5.0, 300.0, 17.5, None, 250.0, 250.2],
        "two values": [10.0] * 5 + [200.0] * 7,
    }


@pytest.mark.parametrize("bandwidth,rounds", [(2.0, 100), (0.5, 3)])
def test_mixture_equals_a_plain_fit(spark, bandwidth, rounds):
    given = slides()
    got = {r["slide_id"]: r for r in tissue.tissue_mixture(pixels(spark, given), bandwidth=bandwidth, max_rounds=rounds).collect()}
    assert set(got) == set(given)
    for name, values in given.items():
        p, n, settled = plain_fit(values, bandwidth, rounds, 1e-3)
        r = got[name]
        assert (r["rounds"], r["settled"]) == (n, settled)
        assert np.allclose([r[c] for c in ("share", "dark", "dark_var", "bright", "bright_var")], p, rtol=1e-6)
    assert abs(got["clear"]["dark"] - 110) < 12


def test_smoothing_keeps_all_bins(spark):
    values = slides()["beyond"]
    rows = tissue.smoothed_histogram(pixels(spark, {"s": values})).orderBy("bin").collect()
    n, density = plain_density(values, 2.0)
    assert [r["n"] for r in rows] == n and np.allclose([r["density"] for r in rows], density)


def test_mask_marks_the_dark_part(spark):
    given = slides()
    rows = tissue.simple_mask(pixels(spark, given)).collect()
    assert len(rows) == sum(map(len, given.values()))
    clear = [r for r in rows if r["slide_id"] == "clear"]
    assert all(r["v"] == 1 for r in clear if r["gray"] < 170) and sum(r["v"] for r in clear if r["gray"] > 232) == 0
    for r in rows:
        assert r["v"] == int(r["gray"] is not None and min(max(math.floor(r["gray"]), 0), 255) <= r["threshold"])


def test_flat_and_empty_slides(spark):
    flat = pixels(spark, {"flat": [7.0] * 30, "null": [None] * 4})
    got = {r["slide_id"]: r for r in tissue.tissue_mixture(flat).collect()}
    assert got["flat"]["share"] is None and got["flat"]["settled"] and "null" not in got
    assert {(r["threshold"], r["v"]) for r in tissue.simple_mask(flat).collect()} == {(None, 0)}
    assert tissue.simple_mask(pixels(spark, {})).collect() == []


def test_slides_of_little_tissue_take_the_triangle(spark):
    rng = np.random.default_rng(1)
    given = {"much": [60.0] * 150 + [230.0] * 250, "flat": [9.0] * 100, "little": rng.normal(60, 3, 3).tolist() + rng.normal(230, 5, 397).tolist()}
    rows = pipelines.tissue_mask(pixels(spark, given), ForegroundParams()).collect()
    fill = {s: sum(r["v"] for r in rows if r["slide_id"] == s) / len(v) for s, v in given.items()}
    assert fill["much"] == 150 / 400 and fill["flat"] == 1.0 and len(rows) == 900
    assert fill["little"] > 3 / 400  # a threshold of its own


def test_fits_are_spread_over_tasks(spark):
    # small histograms would else fall to one task
    few = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        given = {f"s{i}": [float(i), 200.0 + i % 9, 40.0] for i in range(60)}
        found = tissue.tissue_mixture(pixels(spark, given))
        assert found.rdd.getNumPartitions() == 7 and found.count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
