"""Tiles that move once, tokens that are made once, words that are never gathered in lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import components, landmarks, patches
from tissuegrid.operators.attention import AttentionWeights
from tissuegrid.operators.words import pack_cells

TILE = "slide_id long, gx int, gy int, features array<double>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made_up():
    rng = random.Random(3)
    rows = [(s, rng.randrange(9), rng.randrange(7), [float(rng.randrange(-1, 2)), float(rng.randrange(2))]) for s in (1, 2) for _ in range(80)]
    return [*rows, (3, 0, 0, None), (3, 0, 1, None), (3, 0, 1, [1.0, 2.0]), (3, 0, 2, [0.0, None])]


def test_narrow_vectors_move_once(spark):
    tiles = spark.createDataFrame(made_up(), TILE)
    got = patches.coalesce_cells(tiles, width=2)
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = {(3, 0, 0): None, (3, 0, 1): [1.0, 2.0], (3, 0, 2): [0.0, None]}
    for s, x, y, f in made_up()[:-4]:
        a = want.get((s, x, y), [0.0, 0.0])
        want[s, x, y] = [a[0] + f[0], a[1] + f[1]]
    assert {(r.slide_id, r.gx, r.gy): r.features for r in got.collect()} == want
    with pytest.raises(Exception, match="different width"):
        patches.coalesce_cells(tiles, width=3).collect()


def test_active_cells_of_narrow_vectors_move_once(spark):
    tiles = spark.createDataFrame(made_up(), TILE)
    got = patches.active_cells(tiles)
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    whole = patches.coalesce_cells(tiles, width=2).where(patches.active("features"))
    assert sorted(map(tuple, got.collect())) == sorted((r.slide_id, r.gx, r.gy) for r in whole.collect())


def test_wide_and_uneven_vectors_are_still_summed(spark):
    wide = [(1, 0, c, [float(c)] * 40) for c in (0, 1, 1, 2)]
    assert sorted(r.gy for r in patches.active_cells(spark.createDataFrame(wide, TILE)).collect()) == [1, 2]
    uneven = [(1, 0, 0, [1.0]), (1, 0, 1, [0.0, 2.0])]
    assert patches.active_cells(spark.createDataFrame(uneven, TILE)).count() == 2


def test_landmarks_make_their_tokens_once(spark):
    rng = np.random.default_rng(4)
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    rows = [(s, i // 5, i % 5, rng.normal(size=2).tolist()) for s in (1, 2) for i in range(20)]
    tokens = spark.createDataFrame(rows, TILE).withColumn("slide_id", counted.asNondeterministic()("slide_id"))
    w = AttentionWeights(*(rng.normal(size=(2, 4)) for _ in range(3)), rng.normal(size=(4, 2)), None, 2)
    assert landmarks.landmark_attention(tokens, w, landmarks=3).count() == 40
    assert made.value == 40


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_words_of_a_block_are_not_gathered(spark, batch):
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(5)
    cells = {(rng.choice(["a", "b", None]), rng.randrange(600), rng.randrange(600)) for _ in range(3000)}
    words = pack_cells(spark.createDataFrame(sorted(cells, key=str), "slide_id string, r int, c int"))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        runs = components.block_runs(words)
        assert "collect_list" not in plan_of(runs)
        found = [(r.slide_id, r.r, c) for r in runs.collect() for c in range(r.c0, r.c1 + 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert len(found) == len(set(found)) and set(found) == cells


@pytest.mark.parametrize("name", ["n2_self_attention", "n3_relative_attention"])
def test_cells_of_short_bags_are_moved_once_and_only_answers_are_stored(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    from tissuegrid.catalog import QUERIES
    from tissuegrid.operators import attention

    stored, plans = [], []
    monkeypatch.setattr(patches, "cut", lambda df, label: pytest.fail("a table of repeated cells is stored"))
    keep = attention.cut
    monkeypatch.setattr(attention, "cut", lambda df, label: (stored.append(label), plans.append(plan_of(df)), keep(df, label))[-1])
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    # cells are summed (fine and coarse ones for n3, a patient's for n2) and dealt by bag
    assert stored == ["attention"] and "SortMergeJoin" not in plans[0] and isinstance(found, DataFrame)
    assert plans[0].count("REPARTITION_BY_NUM") == 1 and plans[0].count("xxhash64") >= 1
