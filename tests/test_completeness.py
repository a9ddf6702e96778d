"""Completeness of slides, as a batch and as a stream that is cut anywhere."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tissuegrid.streaming import jobs

SCHEMA = "slide_id string, output string, ts timestamp"
START = datetime(2024, 5, 1)


def made_up(seed=1, slides=60):
    rng = random.Random(seed)
    rows = []
    for s in range(slides):
        begin = START + timedelta(minutes=rng.randrange(0, 900))
        kinds = [rng.choice(["coords", "features", "thumbnail", "heatmap", "log"]) for _ in range(rng.randrange(1, 9))]
        rows += [(f"s{s}", k, begin + timedelta(seconds=rng.randrange(0, 6000))) for k in kinds]
    return sorted(rows, key=lambda r: r[2])


def plain(rows, expected=4, wait=timedelta(hours=1), until=None):
    out = set()
    for s in {r[0] for r in rows}:
        first = {}
        for _, kind, ts in (r for r in rows if r[0] == s):
            first[kind] = min(ts, first.get(kind, ts))
        times = sorted(first.values())
        end = times[0] + wait
        n = sum(t <= end for t in times[:expected])
        status, at = ("complete", times[expected - 1]) if n == expected else ("quarantined", end)
        if until is None or at < until:
            out.add((s, status, n, at))
    return out


def rows_of(df):
    found = [(r["slide_id"], r["status"], r["n_outputs"], r["at"]) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("expected", [4, 2])
def test_batch_equals_a_plain_version(spark, expected):
    rows = made_up()
    got = rows_of(jobs.slide_completeness(spark.createDataFrame(rows, SCHEMA), expected=expected))
    assert got == plain(rows, expected) and {g[1] for g in got} == {"complete", "quarantined"}


@pytest.mark.parametrize("cuts", [[], [0.5], [0.2, 0.4, 0.9]])
def test_stream_restarted_anywhere_equals_the_batch(spark, tmp_path, cuts):
    rows = made_up(seed=2, slides=40)
    # out of order within the watermark, repeated, and without a slide or output
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=random.Random(str(r)).randrange(0, 500)))
    shuffled += [(None, "coords", rows[-1][2]), ("s1", None, rows[-1][2]), shuffled[-1]]
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    bounds = [0, *[int(c * len(shuffled)) for c in cuts], len(shuffled)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        spark.createDataFrame(shuffled[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.slide_completeness_stream(stream, sink, state)
    until = max(r[2] for r in shuffled) - timedelta(minutes=10)
    kept = [r for r in shuffled if r[0] and r[1]]
    batch = jobs.slide_completeness(spark.createDataFrame(shuffled, SCHEMA), until=F.lit(until))
    assert rows_of(spark.read.parquet(sink)) == rows_of(batch) == plain(kept, until=until)


@pytest.mark.parametrize("shards", [1, 3, 1 << 14])
def test_slides_of_a_shard_are_one_state(spark, tmp_path, shards):
    rows = made_up(seed=4, slides=50)
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    for a, b in ((0, 100), (100, 130), (130, len(rows))):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.slide_completeness_stream(stream, sink, state, shards=shards)
    assert rows_of(spark.read.parquet(sink)) == plain(rows, until=max(r[2] for r in rows) - timedelta(minutes=10))
    assert 0 < spark.read.format("statestore").load(state).count() <= min(shards, 50)


def test_decided_slides_are_forgotten(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    for day in (0, 1, 2):
        rows = [(f"s{day}", k, START + timedelta(days=day)) for k in "abcd"] + [("late", "a", START + timedelta(days=day, hours=5))]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.slide_completeness_stream(stream, sink, state, forget="12 hours", shards=1)
    assert {r.slide_id for r in spark.read.parquet(sink).collect()} == {"s0", "s1", "s2", "late"}
    held = spark.read.format("statestore").load(state).select("value.groupState.slides").first()[0]
    assert "s0" not in held and "s2" in held


def test_empty_listing(spark):
    assert jobs.slide_completeness(spark.createDataFrame([], SCHEMA)).collect() == []
