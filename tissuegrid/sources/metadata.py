"""Slide metadata documents and cohort tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metadata fields the roll-up and the labels know; values are text and cast where used.
SLIDE_FIELDS = [
    "patient",
    "odx_train",
    "odx85",
    "mphr",
    "Disease_Free_Months",
    "Necrosis",
    "Pleomorph",
    "Mitosis",
]


def load_slide_metadata(
    spark: SparkSession, path: str, fields: Sequence[str] = tuple(SLIDE_FIELDS), one_document: bool = False
) -> DataFrame:
    """JSON objects keyed by slide id to one row per slide; unknown fields are left out.

    By default every line is an object with any number of slides, so a large file is
    split among tasks. ``one_document`` reads each file as a single object instead.
    """
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    text = spark.read.text(path, wholetext=one_document)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), record), {"mode": "FAILFAST"}).alias("doc"))
    return parsed.select(F.explode("doc").alias("slide_id", "_m")).select("slide_id", "_m.*")


def union_cohorts(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of all cohort tables; columns are matched by name."""
    frames = [spark.read.option("header", True).schema(schema).csv(p) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
