"""Files, metadata documents, the tile store, error policy and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tissuegrid import session
from tissuegrid.operators import cohort as co
from tissuegrid.sources import events as ev
from tissuegrid.sources import files as fs
from tissuegrid.sources import metadata as md
from tissuegrid.sources import tiles as ts
from tissuegrid.streaming import jobs

SCHEMA = "slide_id long, gx int, gy int, features array<float>"


def test_shared_folder_is_the_configured_one(spark):
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.cut(spark.range(10))
    assert df.count() == 10 and df.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(
        session.checkpoint_dir(spark).lstrip("/")
    )


def test_list_files_suffix_and_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.svs").write_bytes(b"12345")
    (tmp_path / "a" / "y.txt").write_bytes(b"1")
    got = fs.list_files(spark, str(tmp_path), ".svs").collect()
    assert [(r.fkey.rsplit("/", 1)[1], r.size) for r in got] == [("x.svs", 5)]
    assert fs.list_files(spark, str(tmp_path), ".none").count() == 0


def test_unique_key_without_folder(spark):
    got = fs.unique_key(spark.createDataFrame([("f.svs",), ("d/e/f.svs",)], "p string"), "p").collect()
    assert got[0].ukey.split("::")[1:] == ["", "f.svs"] and got[1].ukey.split("::")[1:] == ["e", "f.svs"]


def test_publish_plan_reupload(spark):
    local = spark.createDataFrame([("a.h5", 1), ("b.h5", 2), ("c.png", 3)], "fkey string, size long")
    remote = spark.createDataFrame([("a.h5", 1), ("b.h5", 9)], "fkey string, size long")
    assert {r.fkey for r in fs.publish_plan(local, remote).collect()} == {"b.h5", "c.png"}
    assert fs.publish_plan(local, remote, reupload=True, ext=".h5").count() == 2


def test_metadata_one_document(spark, tmp_path):
    doc = {"s1": {"patient": "p", "odx85": "H", "other": 1}, "s2": {"patient": "q", "odx_train": "0.5"}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    got = {r.slide_id: r for r in md.load_slide_metadata(spark, str(tmp_path / "m.json"), one_document=True).collect()}
    assert got["s1"].odx85 == "H" and got["s2"].odx_train == "0.5" and got["s2"].odx85 is None


def test_malformed_metadata_fails(spark, tmp_path):
    (tmp_path / "m.json").write_text("{not json")
    with pytest.raises(Exception):
        md.load_slide_metadata(spark, str(tmp_path / "m.json")).collect()


def test_error_policy(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    checks = {"positive": F.col("v") > 0}
    good, bad = fs.apply_error_policy(df, checks, stop_on_fail=False)
    assert [r.id for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}
    strict, _ = fs.apply_error_policy(df, checks, stop_on_fail=True)
    with pytest.raises(Exception, match="positive"):
        strict.collect()


def test_pairing_report_without_pairs_fails(spark):
    files = spark.createDataFrame([("a_coords.h5", 1)], "fkey string, size long")
    meta = spark.createDataFrame([("a", "p")], "slide_id string, patient_id string")
    with pytest.raises(Exception, match="no complete"):
        co.pairing_report(files, meta).collect()


def test_tile_store_prunes_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 0, 1, [2.0])], SCHEMA)
    ts.write_tiles(df.withColumn("tile_idx", F.col("gy")), str(tmp_path / "t"))
    got = ts.read_tiles(spark, str(tmp_path / "t"), tile_idx=1)
    assert [r.gy for r in got.collect()] == [1]
    plan = ts.read_tiles(spark, str(tmp_path / "t")).select("gx")._jdf.queryExecution().executedPlan().toString()
    assert "features" not in plan


def test_unknown_level_is_refused():
    with pytest.raises(ValueError):
        ev.event_record(None, None, None, level="fatal")


def test_ingest_keeps_every_delivery_of_a_slide(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    cells = [(1, 0, k, [float(k)]) for k in range(8)]
    one = spark.createDataFrame(cells, SCHEMA)
    ts.write_tiles(one.repartition(4), src)
    jobs.ingest_tiles_stream(spark, src, sink, state, one.schema, max_files=1)
    # the second delivery brings new cells of the same slide
    two = spark.createDataFrame([(1, 1, 0, [9.0]), (3, 0, 0, [3.0])], SCHEMA)
    ts.write_tiles(two, src, mode="append")
    jobs.ingest_tiles_stream(spark, src, sink, state, one.schema, max_files=1)
    jobs.ingest_tiles_stream(spark, src, sink, state, one.schema, max_files=1)
    got = sorted((r.slide_id, r.gx, r.gy) for r in spark.read.parquet(sink).collect())
    assert got == sorted([(1, 0, k) for k in range(8)] + [(1, 1, 0), (3, 0, 0)])


def test_ingest_leaves_out_complete_slides(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    tiles = spark.createDataFrame([(2, 0, 0, [9.0]), (3, 0, 0, [3.0])], SCHEMA)
    ts.write_tiles(tiles, src)
    done = spark.createDataFrame([(2,), (2,)], "slide_id int")
    jobs.ingest_tiles_stream(spark, src, sink, state, tiles.schema, complete=done)
    assert [r.slide_id for r in spark.read.parquet(sink).collect()] == [3]


def test_misaligned_slides_are_not_written(spark, tmp_path):
    coords = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0), (3, 0, 0)], "slide_id int, gx int, gy int")
    feats = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 0, 1, [2.0]), (2, 0, 0, [1.0]), (2, 0, 1, [1.0])], SCHEMA)
    refused = ts.save_slides(coords, feats, str(tmp_path / "t"))
    assert {(r.slide_id, r.n_coords, r.n_features) for r in refused.collect()} == {(2, 1, 2), (3, 1, 0)}
    assert sorted((r.slide_id, r.gy) for r in ts.read_tiles(spark, str(tmp_path / "t")).collect()) == [(1, 0), (1, 1)]


def test_event_times_are_utc_in_any_session(spark, tmp_path):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp '2024-01-01 12:00:00 UTC' AS t")
        line = df.select(ev.event_record(F.lit("e"), F.lit("ok"), F.col("t")).alias("value"))
        assert '"2024-01-01T12:00:00.000000"' in line.first()["value"]
        line.unionByName(spark.sql("SELECT 'no json' AS value")).coalesce(1).write.text(str(tmp_path / "log"))
        got = ev.read_events(spark, str(tmp_path / "log"))
        assert got.count() == 1
        assert got.select(F.unix_timestamp("ts")).first()[0] == 1704110400
        assert [r["value"] for r in ev.malformed_events(spark, str(tmp_path / "log")).collect()] == ["no json"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_event_rates_drop_late_rows(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    schema = "event string, status string, ts timestamp"

    def deliver(*times):
        rows = [("e", "ok", t) for t in times]
        spark.createDataFrame(rows, "event string, status string, t string").select(
            "event", "status", F.to_timestamp("t").alias("ts")
        ).coalesce(1).write.mode("append").parquet(src)

    def run():
        jobs.event_rates_stream(spark.readStream.schema(schema).parquet(src), sink, state)

    deliver("2024-01-01 00:01:00", "2024-01-01 00:02:00", "2024-01-01 01:00:00")
    run()
    deliver("2024-01-01 00:03:00", "2024-01-01 02:00:00")
    run()
    got = {(str(r.window_start), r.n) for r in spark.read.parquet(sink).collect()}
    assert got == {("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)}


def test_event_rate_updates_hold_open_windows(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    schema = "event string, status string, ts timestamp"
    for times in (["2024-01-01 00:01:00", "2024-01-01 00:11:00"], ["2024-01-01 00:12:00"]):
        rows = spark.createDataFrame([("e", "ok", t) for t in times], "event string, status string, t string")
        rows.select("event", "status", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        jobs.event_rate_updates(spark.readStream.schema(schema).parquet(src), sink, state)
    got = {(str(r.window_start), r.n) for r in jobs.latest_event_rates(spark, sink).collect()}
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-01 00:10:00", 2)}
