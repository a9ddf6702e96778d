"""Bounds of learning samples, and columns of the caller's that clash with the operators' own."""

from pyspark.sql import functions as F

from tissuegrid.llm import shingles, tokens
from tissuegrid.llm.queries import vocabulary
from tissuegrid.llm.texts import bounded_sample


def test_sample_is_bounded_though_ids_repeat(spark):
    texts = spark.range(400).select((F.col("id") % 2).alias("_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("_text"))
    chosen = spark.createDataFrame([(0, 1), (1, 0)], "_id long, _label int")
    got = bounded_sample(texts, chosen, 7)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 7 and got.columns == ["_id", "_label", "_text"]
    assert rows == [tuple(r) for r in bounded_sample(texts.repartition(5), chosen, 7).collect()]
    assert bounded_sample(texts, chosen, 1000).count() == 400


def test_keep_one_returns_the_callers_columns(spark):
    rows = [(1, "one text of a few words", 7, "a", 0.5, 1), (2, "one text of a few words", 9, "b", 1.5, 2), (3, "another", 11, "c", 2.5, 3), (None, "another", 13, "d", 3.5, 4)]
    df = spark.createDataFrame(rows, "event_id long, event string, _text_hash long, _row string, _i double, _u int")
    got = shingles.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [rows[0], rows[2], rows[3]]


def test_round_trip_of_no_rows_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "twice", "x"), (3, "twice", "x"), (None, "é", "x")]
    df = spark.createDataFrame(rows, "event_id long, event string, decoded string")
    got = sorted((r["event_id"] or 0, r["n_tokens"], bytes(r["decoded"])) for r in tokens.round_trip_events(df, vocabulary()).collect())
    assert [(i, back) for i, _, back in got] == [(0, "é".encode()), (1, b""), (2, b""), (3, b"twice"), (3, b"twice")]
    assert [n for i, n, _ in got if i in (1, 2)] == [0, 0]
    assert tokens.round_trip_events(df.limit(0), vocabulary(), compare=True).collect() == []


def test_repeated_rows_share_a_component(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (3, "z")], "event_id long, event string")
    got = sorted((r["event_id"], r["component_id"]) for r in shingles.near_groups(df).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3)]
