"""Sources, sinks, catalog work and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import magnification
from ..session import scratch_path
from ..sources import events as ev
from ..sources import files as fs
from ..sources import metadata as md
from ..sources import tiles as ts
from ..streaming import jobs
from . import fixtures as fx
from .registry import query


@query(
    "s2_path_parts",
    fx.with_sql(
        """SELECT fkey, starts_with(fkey, 's3://') AS is_remote,
             CASE WHEN starts_with(fkey, 's3://') THEN regexp_extract(fkey, '^s3://([^/]+)', 1) END AS bucket,
             CASE WHEN starts_with(fkey, 's3://') THEN regexp_extract(fkey, '^s3://[^/]+/(.*)$', 1) ELSE fkey END AS object_key,
             split_part(fkey, '/', -1) AS basename,
             split_part(split_part(split_part(fkey, '/', -1), '_', 1), '.', 1) AS slide_id
           FROM (SELECT CASE WHEN size % 2 = 0 THEN concat('s3://slides/', fkey) ELSE fkey END AS fkey FROM fx_files) t""",
        fx.FILES,
    ),
)
def s2(spark, path):
    files = fx.files(spark, path)
    mixed = files.select(
        F.when(F.col("size") % 2 == 0, F.concat(F.lit("s3://slides/"), "fkey")).otherwise(F.col("fkey")).alias("fkey")
    )
    return fs.path_parts(mixed, "fkey")


def _stored_meta(spark, path):
    """Metadata written as JSON objects keyed by slide id, one object per line."""
    meta = fx.slide_meta(spark, path)
    record = F.struct(
        F.col("patient_id").cast("string").alias("patient"),
        "odx_train",
        "odx85",
        "mphr",
        F.col("disease_free_months").alias("Disease_Free_Months"),
        F.col("necrosis").alias("Necrosis"),
        F.col("pleomorph").alias("Pleomorph"),
        F.col("mitosis").alias("Mitosis"),
        F.col("barcode").alias("not_a_known_field"),
    )
    target = scratch_path(spark, "meta")
    meta.select(F.to_json(F.create_map(F.col("slide_id").cast("string"), record)).alias("value")).write.text(target)
    return target


@query(
    "s3_load_slide_metadata",
    fx.with_sql(
        """SELECT CAST(slide_id AS VARCHAR) AS slide_id, CAST(patient_id AS VARCHAR) AS patient, odx_train, odx85, mphr,
             disease_free_months AS "Disease_Free_Months", necrosis AS "Necrosis", pleomorph AS "Pleomorph",
             mitosis AS "Mitosis" FROM fx_slide_meta""",
        fx.META,
    ),
)
def s3(spark, path):
    return md.load_slide_metadata(spark, _stored_meta(spark, path))


def _stored_tiles(spark, path):
    target = scratch_path(spark, "tiles")
    # dealt out so that every slide lies in several files
    tiles = fx.tiles(spark, path).select("slide_id", "gx", "gy", "features").repartition(6)
    ts.write_tiles(tiles, target)
    return target


@query(
    "s4_read_tiles",
    fx.with_sql("SELECT slide_id, gx, gy FROM fx_tiles", fx.TILES),
)
def s4(spark, path):
    return ts.read_tiles(spark, _stored_tiles(spark, path)).select("slide_id", "gx", "gy")


@query(
    "s5_write_tiles",
    fx.with_sql(
        """SELECT slide_id, gx, gy, len(features) AS width, round(list_sum(CAST(features AS DOUBLE[])) + 0.0, 5) AS total
           FROM fx_tiles WHERE slide_id % 3 <> 0""",
        fx.TILES,
    ),
)
def s5(spark, path):
    # a third of the slides lacks a feature row and is refused
    tiles = fx.tiles(spark, path)
    feats = tiles.where((F.col("slide_id") % 3 != 0) | (F.col("vec_id") % 50 != 7))
    target = scratch_path(spark, "tiles")
    ts.save_slides(tiles, feats.select("slide_id", "gx", "gy", "features"), target)
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return ts.read_tiles(spark, target).select(
        "slide_id",
        "gx",
        "gy",
        F.size("features").cast("bigint").alias("width"),
        (F.round(total, 5) + 0.0).alias("total"),
    )


@query(
    "s6_work_list",
    fx.with_sql(
        """, ids AS (SELECT fkey, size, split_part(split_part(split_part(fkey, '/', -1), '_', 1), '.', 1) AS slide_id FROM fx_files)
           SELECT slide_id, fkey, size FROM ids WHERE fkey LIKE '%.svs'
             AND slide_id IN (SELECT CAST(slide_id AS VARCHAR) FROM fx_slide_meta)
             AND slide_id NOT IN (SELECT slide_id FROM ids WHERE fkey LIKE 'preprocessed/%' GROUP BY slide_id HAVING count(*) = 4)""",
        fx.FILES,
        fx.META,
    ),
)
def s6(spark, path):
    files = fx.files(spark, path)
    done = files.where(F.col("fkey").startswith("preprocessed/"))
    return fs.work_list(files, fx.keyed_meta(spark, path), done)


@query(
    "s7_publish_plan",
    fx.with_sql(
        """SELECT fkey, size FROM fx_files f WHERE fkey LIKE '%.h5' AND NOT EXISTS (
             SELECT 1 FROM fx_files g WHERE g.fkey = f.fkey
               AND (CASE WHEN g.size % 3 = 0 THEN g.size + 1 ELSE g.size END) = f.size)""",
        fx.FILES,
    ),
)
def s7(spark, path):
    local = fx.files(spark, path)
    remote = local.withColumn("size", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return fs.publish_plan(local, remote, ext=".h5")


@query(
    "s8_apply_error_policy",
    fx.with_sql(
        """SELECT slide_id, concat_ws(',', CASE WHEN mitosis IS NULL THEN 'has_mitosis' END,
             CASE WHEN necrosis = 'Unknown' THEN 'known_necrosis' END,
             CASE WHEN app_mag = 'n/a' THEN 'has_magnification' END) AS failed
           FROM fx_slide_meta WHERE mitosis IS NULL OR necrosis = 'Unknown' OR app_mag = 'n/a'""",
        fx.META,
    ),
)
def s8(spark, path):
    checks = {
        "has_mitosis": F.col("mitosis").isNotNull(),
        "known_necrosis": F.col("necrosis") != "Unknown",
        "has_magnification": magnification("app_mag", default=-1.0) > 0,
    }
    _, bad = fs.apply_error_policy(fx.slide_meta(spark, path), checks, stop_on_fail=False)
    return bad.select("slide_id", "failed")


@query(
    "s9_assert_aligned",
    fx.with_sql(
        """SELECT slide_id, count(*) AS n_coords, CAST(sum(CASE WHEN blank THEN 0 ELSE 1 END) AS BIGINT) AS n_features
           FROM fx_tiles GROUP BY slide_id HAVING sum(CASE WHEN blank THEN 0 ELSE 1 END) <> count(*)""",
        fx.TILES,
    ),
)
def s9(spark, path):
    tiles = fx.tiles(spark, path)
    return ts.assert_aligned(tiles, tiles.where(~F.col("blank")))


EVENTS = """evs AS (SELECT 'slide_event' AS event, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k, event_id FROM events)"""


@query("s10_event_records", fx.with_sql("SELECT event, status, ts, user_id, k FROM evs", EVENTS))
def s10(spark, path):
    source = fx.table(spark, path, "events")
    line = ev.event_record(
        F.lit("slide_event"),
        F.col("event_type"),
        F.col("ts").cast("timestamp"),
        user_id=F.col("user_id"),
        k=F.get_json_object("props", "$.k"),
    )
    target = scratch_path(spark, "events")
    source.select(line.alias("value")).write.text(target)
    return ev.read_events(spark, target).select(
        "event",
        "status",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.col("props")["user_id"].alias("user_id"),
        F.col("props")["k"].alias("k"),
    )


@query(
    "s11_unique_key",
    fx.with_sql(
        """SELECT fkey, concat_ws('::', substr(md5(fkey), 1, 6), split_part(fkey, '/', -2), split_part(fkey, '/', -1)) AS ukey
           FROM fx_files""",
        fx.FILES,
    ),
)
def s11(spark, path):
    return fs.unique_key(fx.files(spark, path).select("fkey"), "fkey")


@query(
    "s12_union_cohorts",
    fx.with_sql(
        """SELECT patient_id, odx85, mphr, CAST(odx_train AS DOUBLE) AS odx_train FROM fx_slide_meta
           UNION ALL SELECT patient_id, mphr, odx85, CAST(odx_train AS DOUBLE) FROM fx_slide_meta""",
        fx.META,
    ),
)
def s12(spark, path):
    meta = fx.slide_meta(spark, path)
    one, two = scratch_path(spark, "cohort"), scratch_path(spark, "cohort")
    meta.select("patient_id", "odx85", "mphr", "odx_train").write.option("header", True).csv(one)
    meta.select("patient_id", F.col("mphr").alias("odx85"), F.col("odx85").alias("mphr"), "odx_train").write.option(
        "header", True
    ).csv(two)
    return md.union_cohorts(spark, [one, two], "patient_id bigint, odx85 string, mphr string, odx_train double")


@query(
    "x1_ingest_tiles_stream",
    fx.with_sql(
        "SELECT slide_id, gx, gy, round(list_sum(CAST(features AS DOUBLE[])) + 0.0, 5) AS total FROM fx_tiles", fx.TILES
    ),
)
def x1(spark, path):
    src = _stored_tiles(spark, path)
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "state")
    schema = spark.read.parquet(src).schema
    # one file to a batch, so that slides cross batches
    jobs.ingest_tiles_stream(spark, src, sink, state, schema, max_files=1)
    # a second run over the same source finds nothing new
    jobs.ingest_tiles_stream(spark, src, sink, state, schema)
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(sink).select("slide_id", "gx", "gy", (F.round(total, 5) + 0.0).alias("total"))


@query(
    "x2_event_rates_stream",
    """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w0, event_type AS status, count(*) AS n
         FROM events GROUP BY 1, 2)
       SELECT strftime(w0, '%Y-%m-%d %H:%M:%S') AS window_start,
              strftime(w0 + INTERVAL 5 MINUTES, '%Y-%m-%d %H:%M:%S') AS window_end, 'slide_event' AS event, status, n
       FROM w WHERE w0 + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def x2(spark, path):
    sink, state = scratch_path(spark, "rates"), scratch_path(spark, "state")
    jobs.event_rates_stream(_event_stream(spark, path), sink, state)
    return _shown_rates(spark.read.parquet(sink))


@query(
    "x2_event_rate_updates",
    """SELECT strftime(w0, '%Y-%m-%d %H:%M:%S') AS window_start,
              strftime(w0 + INTERVAL 5 MINUTES, '%Y-%m-%d %H:%M:%S') AS window_end, 'slide_event' AS event, status, n
       FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w0, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2) w""",
)
def x2_updates(spark, path):
    sink, state = scratch_path(spark, "rates"), scratch_path(spark, "state")
    jobs.event_rate_updates(_event_stream(spark, path), sink, state)
    return _shown_rates(jobs.latest_event_rates(spark, sink))


def _event_stream(spark, path):
    schema = fx.table(spark, path, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(path)
        .select(
            F.lit("slide_event").alias("event"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts")
        )
    )


def _shown_rates(rates):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rates.select(text("window_start"), text("window_end"), "event", "status", "n")


# a user's events of five days are the outputs of a slide, their types the kinds of output
SLIDE_OUTPUTS = """outputs AS MATERIALIZED (
  SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(day(ts) // 5 AS VARCHAR)) AS slide_id, event_type AS output, min(ts) AS ts FROM events GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY ts, output) AS n, min(ts) OVER (PARTITION BY slide_id) + INTERVAL 60 HOURS AS last FROM outputs),
  judged AS (SELECT slide_id, CAST(count(*) FILTER (ts <= last) AS INT) AS n_outputs, max(ts) AS reached, any_value(last) AS last FROM ranked WHERE n <= 4 GROUP BY slide_id),
  verdicts AS (SELECT slide_id, CASE WHEN n_outputs = 4 THEN 'complete' ELSE 'quarantined' END AS status, n_outputs, CASE WHEN n_outputs = 4 THEN reached ELSE last END AS decided FROM judged)"""

SHOWN = "SELECT slide_id, status, n_outputs, strftime(decided, '%Y-%m-%d %H:%M:%S') AS decided FROM verdicts"


def _outputs(events):
    ts = F.col("ts").cast("timestamp")
    slide = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.dayofmonth("ts") / 5).cast("string"))
    return events.select(slide.alias("slide_id"), F.col("event_type").alias("output"), ts.alias("ts"))


def _decided(found):
    return found.select("slide_id", "status", "n_outputs", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("decided"))


@query("x3_slide_completeness", fx.with_sql(SHOWN, SLIDE_OUTPUTS))
def x3(spark, path):
    found = jobs.slide_completeness(_outputs(fx.table(spark, path, "events")), wait="60 HOURS")
    return _decided(found)


@query(
    "x3_slide_completeness_stream",
    fx.with_sql(SHOWN + " WHERE floor(epoch_us(decided) / 1000) < floor(epoch_us((SELECT max(ts) FROM events) - INTERVAL 10 MINUTES) / 1000)", SLIDE_OUTPUTS),
)
def x3_stream(spark, path):
    schema = fx.table(spark, path, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    sink, state = scratch_path(spark, "complete"), scratch_path(spark, "state")
    jobs.slide_completeness_stream(_outputs(events), sink, state, wait="60 HOURS")
    return _decided(spark.read.parquet(sink))


# what a folder holds is not in the tables, so that SQL has nothing to compare
@query("s1_list_files")
def s1(spark, path):
    found = fs.list_files(spark, path, ".parquet")
    return found.select(F.element_at(F.split("fkey", "/"), -1).alias("name"), "size")
