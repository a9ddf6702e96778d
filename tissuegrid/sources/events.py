"""Structured log events as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("info", "debug", "warning", "error")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)


def event_record(event: Column, status: Column, ts: Column, level: str = "info", **props: Column) -> Column:
    """JSON text of one event with its time in UTC; an unknown level is refused."""
    if level not in LEVELS:
        raise ValueError(f"invalid log level {level!r}")
    entries = [x for name, value in props.items() for x in (F.lit(name), value.cast("string"))]
    return F.to_json(
        F.struct(
            event.alias("event"),
            status.alias("status"),
            F.date_format(_shifted(ts, to_utc=True), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            (F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")).alias("props"),
        )
    )


def _shifted(ts: Column, to_utc: bool) -> Column:
    """A time whose clock face in the session's zone is moved to or from UTC's."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")) if to_utc else F.convert_timezone(
        F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")
    ).cast("timestamp")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.from_json("value", EVENT_SCHEMA).alias("e"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``(event, status, ts, props)`` from JSON lines, whose times are UTC; other lines are left out."""
    parsed = _parsed(spark, path).where(F.col("e.event").isNotNull())
    ts = _shifted(F.to_timestamp_ntz("e.timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), to_utc=False)
    return parsed.select("e.event", "e.status", ts.alias("ts"), "e.props")


def malformed_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold no event, as they stand."""
    return _parsed(spark, path).where(F.col("e.event").isNull()).select("value")
