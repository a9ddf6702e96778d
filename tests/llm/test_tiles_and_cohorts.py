"""Mixing of cohorts and near-duplicate tiles."""

import random
from collections import Counter

import numpy as np
import pytest

from tissuegrid.llm import mixing, vectors


def slides(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2.0) for r in rows], "slide_id long, cohort string, n_tiles long, _c string, _k long, target double")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = share * sum(sizes.values()), set()
    while True:
        rest = [n for n in names if n not in fixed]
        left = total - sum(cap * sizes[n] for n in fixed)
        level = left / sum(w[n] for n in rest) if rest else 0
        over = [n for n in rest if level * w[n] > cap * sizes[n] * (1 + 1e-12)]
        if not over:
            return {n: cap * sizes[n] if n in fixed else level * w[n] for n in names}
        fixed |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {n: rng.randrange(0, 1000) for n in [None, "a", "B", "é", "\U0001f600", "￮", "", *map(str, range(6))]}
    got = mixing.cohort_targets(spark.createDataFrame(list(sizes.items()), "cohort string, size long")).collect()
    expected = plain_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expected[r["cohort"]], rel=1e-9), r


def test_mix_reaches_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)  # many groups and levels
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "a", "b", "b", "b", "c"]), rng.choice([0, None, 1, 5, 40, 900])) for i in range(3000)]
    df = slides(spark, rows)
    got = mixing.mix_cohorts(df).collect()
    assert len(got) == 3000
    taken, largest = {}, {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["cohort"]] = taken.get(r["cohort"], 0) + r["taken"]
        largest[r["cohort"]] = max(largest.get(r["cohort"], 0), r["size"])
    for r in got:
        assert abs(taken[r["cohort"]] - r["target"]) <= largest[r["cohort"]]
    again = mixing.mix_cohorts(df.repartition(3)).collect()
    key = lambda r: (r["slide_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_pivotal_steps_keep_mass_and_are_unbiased():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 400).astype(float)
    part = np.full(400, 0.3)
    mean = np.zeros(400)
    for _ in range(300):
        out = mixing._settle(size, part, rng.random(400))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert out @ size == pytest.approx(part @ size)
        mean += out / 300
    assert abs(mean.mean() - 0.3) < 0.02 and abs(mean - 0.3).max() < 0.15


def test_mix_awkward_rows(spark):
    rows = [(None, "a", 3), (1, None, 4), (1, None, 4), (2, "b", None), (3, "b", -5), (4, "c", 10**12)]
    got = mixing.mix_cohorts(slides(spark, rows)).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.take_mix(slides(spark, rows)).columns == slides(spark, rows).columns
    assert mixing.mix_cohorts(slides(spark, rows).limit(0)).count() == 0
    assert mixing.mix_cohorts(slides(spark, [(1, "a", 0), (2, "a", 0)])).count() == 2


def tiles(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "tile_id long, slide_id int, features array<float>, _v string, _h long")


def plain_near(rows, threshold=0.93):
    def sound(r):
        v = r[2]
        return r[0] is not None and r[1] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, least = len(rows), list(range(len(rows)))
    unit = [np.array(r[2], np.float32).astype(float) / np.linalg.norm(np.array(r[2], np.float32).astype(float)) if sound(r) else None for r in rows]

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                least[root(i)] = root(j)
    comp = {}
    for i in range(n):
        if unit[i] is not None:
            comp[root(i)] = min(comp.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], comp[root(i)] if unit[i] is not None else rows[i][0]) for i in range(n)]


def test_near_tiles_equal_brute_force(spark, monkeypatch):
    from tissuegrid.llm import tiles as places

    monkeypatch.setattr(places, "BLOCK_ROWS", 16)  # keys of many blocks
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = rng.standard_normal(48)
        if rows and i % 2:
            v = np.array(rows[rng.integers(len(rows))][2]) + rng.standard_normal(48) * rng.choice([0.0, 0.05, 0.2, 0.4])
        rows.append((i, int(rng.integers(3)), [float(x) for x in np.float32(v)]))
    cluster = rng.standard_normal(48)
    rows += [(400 + i, 1, [float(x) for x in np.float32(cluster + 0.1 * rng.standard_normal(48))]) for i in range(120)]
    got = vectors.near_tiles(tiles(spark, rows)).collect()
    expected = plain_near(rows)
    assert sorted((r["tile_id"], r["n_links"], r["component_id"]) for r in got) == sorted(expected)
    assert all(r["kept"] == (r["tile_id"] == r["component_id"]) for r in got)


def test_near_tiles_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0, 0.0]), (4, 1, [1.0, None, 2.0]), (5, 1, [1.0, float("nan"), 2.0]),
        (6, 1, [1.0, float("inf"), 2.0]), (7, None, v), (8, None, v), (9, 2, v), (10, 2, v), (10, 2, v), (11, 2, [2.0, 4.0, 6.0]),
        (12, 2, [1.0, 2.0]), (13, 3, v), (None, 2, v), (14, 2, [1e-30, 2e-30, 3e-30]), (15, 2, [1e30, 2e30, 3e30]),
    ]
    got = sorted(((r["tile_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_tiles(tiles(spark, rows)).collect())
    assert got[0] == (0, 0, None, False)
    linked = [x for x in got if x[1]]
    assert [x[:3] for x in linked] == [(9, 5, 9), (10, 5, 9), (10, 5, 9), (11, 5, 9), (14, 5, 9), (15, 5, 9)]
    assert all(x[1] == 0 and x[2] == x[0] and x[3] for x in got[1:] if x[0] in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13))
    assert vectors.near_tiles(tiles(spark, rows).limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    bits, bands = vectors.banding(100_000, 0.93, 0.999)
    x = rng.standard_normal((1500, 64))
    y = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.935 * x + np.sqrt(1 - 0.935**2) * y
    keys = [vectors.band_keys(vectors.band_signs(v, bits, bands)) for v in (x, z)]
    met = (keys[0] == keys[1]).any(1)
    assert met.mean() > 0.99


def test_take_mix_against_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.randrange(0, 40), f"t{i}") for i in range(200)]
    # one id on unlike rows, equal rows, no id: names that are not a row's own
    rows += [(7, "a", 5, f"u{i}") for i in range(30)] + [(8, "b", 6, "same")] * 40 + [(None, None, 3, f"v{i % 3}") for i in range(20)]
    df = spark.createDataFrame(rows, "slide_id long, cohort string, n_tiles int, _k string")
    got = Counter(tuple(r) for r in mixing.take_mix(df).collect())
    drawn = Counter()
    for r in mixing.mix_cohorts(df).collect():
        drawn[r["slide_id"], r["cohort"], r["size"]] += r["copies"]
    by_name, have = Counter(), Counter(rows)
    for row, n in got.items():
        by_name[row[:3]] += n
        assert n <= 2 * have[row]
    assert by_name == +drawn
    assert got == Counter(tuple(r) for r in mixing.take_mix(df.repartition(5)).collect())


def test_take_mix_moves_whole_rows_once(spark):
    df = spark.range(1000).selectExpr("id AS slide_id", "'a' AS cohort", "10 AS n_tiles", "repeat('x', 50) AS text")
    taken = mixing.take_mix(df)
    tree = taken._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in tree.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) <= 2 and 900 <= taken.count() <= 2000
