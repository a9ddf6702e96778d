"""Fitting of an attention head against plain descent."""

import numpy as np
import pytest

from tissuegrid.plans import fitting
from tissuegrid.plans.fitting import FitParams

REGIONS, LABELS = "patient_id string, features array<double>, _y int, _bag string", "patient_id string, label int, learn boolean, _f int"


def made_up(spark, seed=3, bags=60, width=4):
    rng = np.random.default_rng(seed)
    regions, labels, plain = [], [], []
    for b in range(bags):
        y = int(b % 2)
        x = rng.normal(size=(int(rng.integers(1, 7)), width))
        x[0, 0] += 3 * (2 * y - 1)  # one telling region
        regions += [(f"p{b}", row.tolist(), 1, "x") for row in x]
        labels.append((f"p{b}", y, b % 5 != 0, 1))
        plain.append((x, y, b % 5 != 0))
    regions += [("unlabelled", [1.0] * width, 1, "x"), ("null", [1.0] * width, 1, "x"), (None, [1.0] * width, 1, "x")]
    labels += [("null", None, True, 1), ("no regions", 1, True, 1)]
    return spark.createDataFrame(regions, REGIONS), spark.createDataFrame(labels, LABELS), plain


def plain_loss(x, y, w):
    d = x.shape[1]
    a = np.exp(x @ w[:d] - (x @ w[:d]).max())
    p = 1 / (1 + np.exp(-((a / a.sum()) @ x @ w[d : 2 * d] + w[-1])))
    return -np.log(p if y else 1 - p)


def plain_fit(bags, p, width):
    w = np.random.default_rng(p.seed).normal(scale=0.01, size=2 * width + 1)
    rate, best, stale, out = p.rate, np.inf, 0, []
    for _ in range(p.epochs):
        if stale >= p.patience:
            break
        mean = lambda learn: np.mean([plain_loss(x, y, w) for x, y, l in bags if l == learn])  # noqa: B023, E731, E741
        train, val = mean(True), mean(False)
        gradient = np.zeros_like(w)
        for k in range(len(w)):  # by differences
            step = np.zeros_like(w)
            step[k] = 1e-5
            sides = [np.mean([plain_loss(x, y, w + s) for x, y, learn in bags if learn]) for s in (step, -step)]
            gradient[k] = (sides[0] - sides[1]) / 2e-5
        if val < best - p.least_gain:
            best, stale = val, 0
        else:
            stale += 1
            rate *= p.shrink if stale % p.plateau == 0 else 1
        w = w - rate * gradient
        out.append((train, val, rate, w))
    return out


def test_equals_plain_descent(spark):
    regions, labels, bags = made_up(spark)
    p = FitParams(epochs=8, rate=0.8, plateau=1, patience=3, least_gain=0.02)
    rows = fitting.fit_head(regions, labels, p).orderBy("epoch").collect()
    wanted = plain_fit(bags, p, 4)
    assert [r["epoch"] for r in rows] == list(range(len(wanted)))
    for r, (train, val, rate, w) in zip(rows, wanted, strict=True):
        assert np.isclose(r["train_loss"], train, atol=1e-5) and np.isclose(r["val_loss"], val, atol=1e-5)
        assert r["rate"] == rate and np.allclose(r["weights"], w, atol=1e-4)
    assert rows[-1]["train_loss"] < 0.8 * rows[0]["train_loss"]


def test_restart_and_any_partitioning_give_the_same_bits(spark, tmp_path):
    regions, labels, _ = made_up(spark, bags=30)
    p = FitParams(epochs=4, rate=0.5)
    whole = [tuple(r) for r in fitting.fit_head(regions, labels, p).orderBy("epoch").collect()]
    store = str(tmp_path / "steps")
    fitting.fit_head(regions, labels, FitParams(epochs=2, rate=0.5), store=store)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = fitting.fit_head(regions.repartition(5), labels, p, store=store).orderBy("epoch").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [tuple(r) for r in again] == whole


@pytest.mark.parametrize("n", [0, 1])
def test_little_or_nothing_to_learn_from(spark, n):
    regions = spark.createDataFrame([("a", [1.0, 2.0], 1, "x")][:n], REGIONS)
    labels = spark.createDataFrame([("a", 1, True, 1)], LABELS)
    rows = fitting.fit_head(regions, labels, FitParams(epochs=2)).collect()
    assert len(rows) == 2 * n and all(r["val_loss"] == r["train_loss"] for r in rows)
