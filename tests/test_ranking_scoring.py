"""Ranks of large groups, losses, metrics, splits and seeded draws."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tissuegrid.functions import ranking
from tissuegrid.functions import scalars as sc
from tissuegrid.operators import augment as au
from tissuegrid.operators import cohort as co
from tissuegrid.operators import scoring as so
from tissuegrid.operators import stain as st
from tissuegrid.operators import vectors as ve


@pytest.fixture
def small_groups(monkeypatch):
    """Treat every group above 50 rows as large."""
    monkeypatch.setattr(ranking, "TARGET_ROWS", 50)


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(2)
    n = 3000
    frame = pd.DataFrame(
        {
            # bag 0 holds a third of the rows
            "bag_id": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 90, n)),
            "instance_id": np.arange(n),
            # many equal scores
            "score": np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n).round(2)),
            "y": rng.integers(0, 2, n),
        }
    )
    frame["is_global"] = False
    return frame


def test_large_groups_rank_as_small_ones(spark, preds, monkeypatch):
    df = spark.createDataFrame(preds)

    def results():
        return {
            "top": so.top_k_instances(df).toPandas(),
            "auroc": so.auroc(df, by=["is_global"]).toPandas(),
            "order": co.shuffle_order(df.select("instance_id"), "instance_id", 7).toPandas(),
            "groups": ve.token_groups(df.select("bag_id", "instance_id"), 4, 3, ["instance_id"], ["bag_id"]).toPandas(),
        }

    plain = results()
    monkeypatch.setattr(ranking, "TARGET_ROWS", 50)
    large = results()
    for name in plain:
        cols = sorted(plain[name].columns)
        a, b = (x[name][cols].sort_values(cols).reset_index(drop=True) for x in (plain, large))
        pd.testing.assert_frame_equal(a, b)


def test_top_k_brute_force(spark, preds, small_groups):
    got = so.top_k_instances(spark.createDataFrame(preds)).toPandas()
    for bag, rows in preds.groupby("bag_id"):
        k = max(1, len(rows) // 10)
        want = rows.sort_values(["score", "instance_id"], ascending=[False, True]).head(k).instance_id.tolist()
        assert got[got.bag_id == bag].sort_values("rank").instance_id.tolist() == want


def test_auroc_brute_force(spark, preds, small_groups):
    got = so.auroc(spark.createDataFrame(preds)).first()["auroc"]
    pos, neg = preds[preds.y == 1].score.to_numpy(), preds[preds.y == 0].score.to_numpy()
    diff = pos[:, None] - neg[None, :]
    assert got == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, y int")
    assert so.auroc(df).first()["auroc"] is None


def test_null_keys_keep_their_rows(spark, small_groups):
    df = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(300)], "k int, i int")
    got = ranking.hash_order(df, ["i"], 1, "rn", by=["k"]).groupBy("k").agg(F.max("rn").alias("m"), F.count("*").alias("n"))
    assert sorted((r.m, r.n) for r in got.collect()) == [(150, 150), (150, 150)]


def test_patient_slides_of_a_large_patient(spark, small_groups):
    rows = [(f"s{i}", 1 if i < 200 else i, f"dir/s{i:04d}", "c", "f") for i in range(300)]
    df = spark.createDataFrame(rows, "slide_id string, patient_id int, base string, coords_path string, features_path string")
    got = co.patient_slides(df).where("patient_id = 1").orderBy("ord").collect()
    assert [g.ord for g in got] == list(range(200)) and [g.slide_id for g in got] == [f"s{i}" for i in range(200)]


def bce(p, y):
    return -(y * math.log(p) + (1 - y) * math.log(1 - p))


def test_regional_loss_golden(spark):
    rows = [(1, -1, True, 0.7), (1, 1, False, 0.8), (1, 2, False, 0.6), (1, 3, False, 0.3), (1, 4, False, 0.2), (2, -1, True, 0.4)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "bag_id int, instance_id int, is_global boolean, score double, y double")
    got = {r.bag_id: r.loss for r in so.regional_loss(df, 0.5, "bce").collect()}
    assert got[1] == pytest.approx(0.5 * bce(0.7, 1) + 0.5 * bce(0.8, 1))
    assert got[2] == pytest.approx(0.5 * bce(0.4, 1))
    zero = {r.bag_id: r.loss for r in so.regional_loss(df, 0.0, "bce").collect()}
    assert zero[1] == pytest.approx(bce(0.7, 1))


def test_local_loss_divides_by_k(spark):
    rows = [(1, -1, True, 0.5, 1.0)] + [(1, i, False, 0.9 - i / 100, 1.0) for i in range(25)]
    df = spark.createDataFrame(rows, "bag_id int, instance_id int, is_global boolean, score double, y double")
    got = so.regional_loss(df, 1.0, "bce").first()["loss"]
    assert got == pytest.approx((bce(0.9, 1) + bce(0.89, 1)) / 2 / 2)


def test_multitask_golden(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "task string, loss double")
    assert so.multitask_loss(df, {"a": 1.0, "b": 0.5, "c": 0.75}).first()["total_loss"] == pytest.approx(1.125)
    assert so.multitask_loss(df, {"b": 0.5}).first()["total_loss"] == pytest.approx(1.25)


def test_losses_closed_forms(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "score double, y double")
    assert so.losses(df, "bce").first()["loss"] == pytest.approx(50.0)
    logits = spark.createDataFrame([(100.0, 0.0), (-100.0, 1.0), (0.0, 1.0)], "score double, y double")
    assert so.losses(logits, "bce_logits").first()["loss"] == pytest.approx((200 + math.log(2)) / 3)
    ce = spark.createDataFrame([([1.0, 2.0, 1000.0], 2)], "score array<double>, y int")
    assert so.losses(ce, "ce").first()["loss"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        so.losses(df, "hinge")


def test_binary_accuracy_reads_logits(spark):
    df = spark.createDataFrame([(1, 0.4, 1), (1, 0.6, 1), (2, 0.4, 1), (2, -3.0, 0)], "b int, score double, y int")
    assert so.binary_accuracy(df, update=["b"]).first()["accuracy"] == pytest.approx(0.75)


def test_balanced_split_rules(spark):
    rows = [(i, "H" if i < 20 else "L") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, odx85 string")
    out = co.balanced_split(df, "id", "odx85", "H", 0.2, 42)
    counts = {(r.split, r.odx85): r["count"] for r in out.groupBy("split", "odx85").count().collect()}
    assert counts == {("test", "H"): 4, ("test", "L"): 4, ("train", "H"): 16, ("train", "L"): 16}
    three = co.three_way_split(df, "id", "odx85", "H", 0.2, 0.2, 42)
    assert three.select("id").distinct().count() == 40 == three.count()
    sizes = {r.split: r["count"] for r in three.groupBy("split").count().collect()}
    assert sizes == {"test": 8, "val": 8, "train": 24}
    assert "val" not in {r.split for r in co.three_way_split(df, "id", "odx85", "H", 0, 0.2).select("split").collect()}
    with pytest.raises(ValueError):
        co.balanced_split(df, "id", "odx85", "H", 0.01, 42)
    with pytest.raises(ValueError):
        co.balanced_split(df, "id", "odx85", "X", 0.2, 42)


def test_small_class_goes_to_test_whole(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(100)], "id int, y int")
    out = co.balanced_split(df, "id", "y", 1, 0.2, 1)
    assert out.where("y = 1 AND split = 'test'").count() == 3 and out.where("y = 0 AND split = 'test'").count() == 10


def test_inherit_split_without_old(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r.split for r in co.inherit_split(df, None, "id").collect()} == {None}


def test_labels_accept_text_and_numbers(spark):
    df = spark.createDataFrame([("p", "L", "Present", "1e2"), ("q", "1", "?", "x")], "id string, odx85 string, Necrosis string, Grade string")
    got = {(r.id, r.label): (r.value, r.task_type) for r in co.patient_labels(df, "id").collect()}
    assert got == {
        ("p", "odx85"): (0.0, "binary"),
        ("p", "necrosis"): (1.0, "binary"),
        ("p", "grade"): (100.0, "regression"),
        ("q", "odx85"): (1.0, "binary"),
    }
    maps = {r.id: r.labels for r in co.label_map(co.patient_labels(df, "id"), "id").collect()}
    assert maps["q"] == {"odx85": 1.0}


def test_rollup_rejects_text_numbers(spark):
    df = spark.createDataFrame([(1, "x", "H", "H", "1", "Present", "1")], "patient_id int, odx_train string, odx85 string, mphr string, disease_free_months string, necrosis string, pleomorph string")
    with pytest.raises(Exception):
        co.patient_rollup(df).collect()


def test_soft_label_points(spark):
    df = spark.createDataFrame([(-2.009,), (0.7169,), (2.744,), (-3.0,)], "s double")
    got = [r[0] for r in df.select(sc.soft_label(F.col("s"))).collect()]
    assert got[:3] == pytest.approx([0.0, 0.5, 1.0]) and math.isnan(got[3])


def test_erf_and_gelu(spark):
    xs = [i / 7 for i in range(-30, 31)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(sc.erf(F.col("x")), sc.gelu(F.col("x"))).collect()
    for x, (e, g) in zip(xs, got):
        assert e == pytest.approx(math.erf(x), abs=2e-7)
        assert g == pytest.approx(0.5 * x * (1 + math.erf(x / math.sqrt(2))), abs=1e-6)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_rot90_matches_numpy(spark, k):
    a = np.arange(12).reshape(3, 4)
    rows = [(int(i), int(j), int(a[i, j]), 3, 4) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "row int, col int, v int, h int, w int")
    want = np.rot90(a, k)
    for r in au.rot90(df, F.lit(k)).collect():
        assert want[r.row, r.col] == r.v and (r.h, r.w) == want.shape


def test_noise_repeats_and_has_the_right_spread(spark):
    rows = [(i, [1.0] * 50 if i else [0.0] * 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    one = np.array([r.features for r in au.add_noise(df, 0.5, 9, ["id"]).orderBy("id").collect()])
    two = np.array([r.features for r in au.add_noise(df.repartition(7), 0.5, 9, ["id"]).orderBy("id").collect()])
    assert (one == two).all() and (one[0] == 0).all()
    noise = one[1:] - 1
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 0.5) < 0.02
    assert au.add_noise(df, 0.0, 9, ["id"]) is df


def test_nearest_to_centers_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(400, 8)), rng.normal(size=(9, 8))
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, features array<double>")
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "center_id int, center array<double>")
    want = {i: np.argsort(((x - v) ** 2).sum(axis=1))[:5].tolist() for i, v in enumerate(c)}
    for floats, rows in ((ve.CLOSURE_FLOATS, ve.BLOCK_ROWS), (16, 70)):
        monkeypatch.setattr(ve, "CLOSURE_FLOATS", floats)
        monkeypatch.setattr(ve, "BLOCK_ROWS", rows)
        got = ve.nearest_to_centers(vecs, centers, 5).orderBy("center_id", "rank").collect()
        assert {i: [g.vec_id for g in got if g.center_id == i] for i in want} == want


def test_projection_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(20, 6)), rng.normal(size=(6, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    for floats in (1000, 12):
        monkeypatch.setattr(ve, "CLOSURE_FLOATS", floats)
        got = np.array([r.projected for r in ve.project(df, w, activation=None).orderBy("id").collect()])
        assert np.allclose(got, x @ w)


def test_reinhard_reaches_its_target(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 2, *map(float, rng.normal(100, 20, 3))) for i in range(2000)]
    px = spark.createDataFrame(rows, "image_id int, ch0 double, ch1 double, ch2 double")
    t = {c: {"avg_mean": 50.0, "avg_std": 0.0, "std_mean": 7.0, "std_std": 0.0} for c in st.CHANNELS}
    moved = st.reinhard(px, st.virtual_template(px, t), to_bytes=False)
    for r in st.channel_stats(moved).collect():
        assert r.ch1_mean == pytest.approx(50) and r.ch1_std == pytest.approx(7)
    with pytest.raises(ValueError):
        st.virtual_template(px, t, "cauchy")


@pytest.mark.parametrize("space", ["LAB", "HSV", "HED"])
def test_colours_come_back(spark, space):
    rng = np.random.default_rng(3)
    # colours that absorb some of each stain, as others have stains below zero
    stains = rng.uniform(0.02, 0.2, (200, 3)) @ np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])
    rgb = 255 * np.exp(stains * math.log(1e-6)) if space == "HED" else rng.uniform(0, 255, (200, 3))
    px = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rgb)], "i int, ch0 double, ch1 double, ch2 double")
    back = st.convert(st.convert(px, space), space, back=True).orderBy("i").collect()
    assert np.allclose([[r.ch0, r.ch1, r.ch2] for r in back], rgb, atol=0.05)


def test_known_colours(spark):
    px = spark.createDataFrame([(255.0, 0.0, 0.0), (255.0, 255.0, 255.0), (0.0, 0.0, 255.0)], "ch0 double, ch1 double, ch2 double")
    lab = [tuple(round(x, 1) for x in r) for r in st.convert(px, "LAB").collect()]
    assert lab == [(135.8, 208.1, 195.2), (255.0, 128.0, 128.0), (82.4, 207.2, 20.1)]
    assert [tuple(r) for r in st.convert(px, "HSV").collect()] == [(0.0, 255.0, 255.0), (0.0, 0.0, 255.0), (120.0, 255.0, 255.0)]
    with pytest.raises(ValueError):
        st.convert(px, "YUV")


def test_buckets_of_many_large_groups_stay_near_the_target(spark, small_groups):
    # 100 groups on ranges of their own, and one whose rows are mostly ties
    df = spark.range(0, 40_000).selectExpr("id div 400 AS g", "id AS i", "CASE WHEN id < 400 AND id > 20 THEN 5.0 ELSE id / 7 END AS v")
    rows, within = ranking._bucketed(df, ["g"], [F.col("v"), F.col("i")], F.lit(1))
    sizes = [r["count"] for r in rows.groupBy(*within).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 110
    got = ranking.bucketed_row_number(df, "rn", by=["g"], keys=[F.col("v"), F.col("i")], order=[F.col("v"), F.col("i")])
    wrong = got.selectExpr("rn", "row_number() OVER (PARTITION BY g ORDER BY v, i) AS want").where("rn <> want")
    assert wrong.count() == 0
