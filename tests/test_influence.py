"""Scores without a region and attention maps against recomputation."""

import math

import numpy as np
import pytest

from tissuegrid.operators import influence

SCHEMA = "slide_id long, region_id string, features array<float>, logit double, _l int, share string"
HEAD, BIAS = np.array([[0.5, -1.0], [0.25, 2.0], [-0.75, 0.1]]), [0.1, -0.3]


def tiles(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain_score(rows, use_logit, squash):
    if not rows:
        return None
    l = np.array([r[3] for r in rows]) if use_logit else np.zeros(len(rows))  # noqa: E741
    w = np.exp(l - l.max())
    x = np.array([r[2] if r[2] is not None else [0.0] * 3 for r in rows], np.float32).astype(float)
    out = (w / w.sum()) @ x @ HEAD + BIAS
    return 1 / (1 + np.exp(-out)) if squash else out


def compare(got, rows, use_logit, squash, atol=1e-9):
    rows = [r for r in rows if not use_logit or r[3] is not None]
    found = got.collect()
    assert {(r["slide_id"], r["region_id"]) for r in found} == {r[:2] for r in rows} and len(found) == len({r[:2] for r in rows})
    for r in found:
        bag = [x for x in rows if x[0] == r["slide_id"]]
        own = [x for x in bag if x[1] == r["region_id"]]
        whole, without = plain_score(bag, use_logit, squash), plain_score([x for x in bag if x[1] != r["region_id"]], use_logit, squash)
        assert r["n_tiles"] == len(own) and np.allclose(r["score"], whole, atol=atol)
        if without is None:
            assert r["score_without"] is None and r["influence"] is None and r["share"] == 1.0
        else:
            assert np.allclose(r["score_without"], without, atol=atol) and np.allclose(r["influence"], whole - without, atol=atol)


@pytest.mark.parametrize("use_logit,squash", [(True, True), (False, False)])
def test_equals_recomputation(spark, use_logit, squash):
    rng = np.random.default_rng(6)
    rows = [(int(s), str(rng.integers(0, 6)), rng.normal(size=3).tolist(), float(rng.normal() * 4)) for s in rng.integers(0, 5, 400)]
    rows += [(9, "only", [1.0, 2.0, 3.0], 0.5), (10, None, [1.0, 0.0, 0.0], 0.0), (10, "a", None, 1.0), (10, "a", [0.0, 1.0, 0.0], None), (None, "a", [1.0, 1.0, 1.0], 2.0), (None, "b", [2.0, 1.0, 1.0], 2.0)]
    got = influence.dropout_influence(tiles(spark, rows), HEAD, BIAS, logit="logit" if use_logit else None, squash=squash)
    compare(got, rows, use_logit, squash)


def test_a_region_of_nearly_all_weight_does_not_cancel(spark):
    rows = [(1, "heavy", [1.0, 2.0, 3.0], 900.0), (1, "light", [-1.0, 0.5, 0.0], 0.0), (1, "lighter", [5.0, 0.5, 0.0], -40.0), (1, "gone", [0.0, 9.0, 0.0], -2000.0)]
    got = influence.dropout_influence(tiles(spark, rows), HEAD, BIAS, logit="logit")
    compare(got, rows, True, True, atol=1e-12)
    shares = {r["region_id"]: r["share"] for r in got.collect()}
    assert shares["heavy"] == 1.0 and shares["gone"] == 0.0


def test_no_tiles(spark):
    assert influence.dropout_influence(tiles(spark, []), HEAD, BIAS).collect() == []


def test_map_sums_to_one_and_counts_overlaps(spark):
    cells = [(1, 0, 0, 0, 0.75), (1, 0, 0, 1, 0.25), (1, 1, 0, 1, 0.5), (1, 1, 0, 2, 0.5), (2, 0, 0, 0, 0.0), (3, 7, 1, 1, None), (None, 0, 0, 0, 1.0)]
    patches = [(1, 0, 0.8), (1, 1, 0.2), (2, 0, 1.0), (None, 0, 1.0)]
    got = influence.attention_map(
        spark.createDataFrame(cells, "slide_id long, patch_id int, gx int, gy int, weight double"),
        spark.createDataFrame(patches, "slide_id long, patch_id int, weight double"),
    ).collect()
    found = {(r["slide_id"], r["gx"], r["gy"]): (r["coverage"], r["weight"]) for r in got if r["slide_id"] is not None}
    raw = {(0, 0): 0.6, (0, 1): (0.2 + 0.1) / 2, (0, 2): 0.1}
    assert {k[1:]: v[0] for k, v in found.items() if k[0] == 1} == {(0, 0): 1, (0, 1): 2, (0, 2): 1}
    assert all(math.isclose(found[1, *k][1], v / sum(raw.values())) for k, v in raw.items())
    assert found[2, 0, 0] == (1, 0.0) and found[3, 1, 1] == (1, 0.0)
