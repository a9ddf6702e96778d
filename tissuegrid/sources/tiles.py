"""The tile store: Parquet rows ``(slide_id, gx, gy, features)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def read_tiles(spark: SparkSession, path: str, tile_idx: int | None = None) -> DataFrame:
    """Stored tiles; columns not selected are not read. ``tile_idx`` picks one position of every slide."""
    tiles = spark.read.parquet(path)
    return tiles if tile_idx is None else tiles.where(F.col("tile_idx") == tile_idx)


def write_tiles(df: DataFrame, path: str, mode: str = "error") -> None:
    """32-bit coordinates and vectors, compressed, ordered by slide and position inside files.

    The write asks for no shuffle, so a slide with most of the tiles stays spread
    over its input partitions; sorting inside them gives row groups narrow ranges.
    """
    shaped = df.withColumns(
        {
            "gx": F.col("gx").cast("int"),
            "gy": F.col("gy").cast("int"),
            "features": F.col("features").cast("array<float>"),
        }
    )
    shaped.sortWithinPartitions("slide_id", "gx", "gy").write.mode(mode).option("compression", "zstd").parquet(path)


def alignment(coords: DataFrame, feats: DataFrame) -> DataFrame:
    """Rows per slide on both sides and whether they agree."""
    one = coords.select("slide_id", F.lit(1).alias("c"), F.lit(0).alias("f"))
    two = feats.select("slide_id", F.lit(0).alias("c"), F.lit(1).alias("f"))
    return (
        one.unionByName(two)
        .groupBy("slide_id")
        .agg(F.sum("c").alias("n_coords"), F.sum("f").alias("n_features"))
        .withColumn("aligned", F.col("n_coords") == F.col("n_features"))
    )


def assert_aligned(coords: DataFrame, feats: DataFrame) -> DataFrame:
    """Slides whose counts differ; these are not saved."""
    return alignment(coords, feats).where(~F.col("aligned")).drop("aligned")


def save_slides(coords: DataFrame, feats: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write the tiles of aligned slides only; returns the slides that were refused, with both counts.

    ``feats`` has ``(slide_id, gx, gy, features)``; a slide is saved if it has as many
    feature rows as coordinates.
    """
    refused = cut(assert_aligned(coords, feats), "refused")
    write_tiles(feats.join(refused.select("slide_id"), "slide_id", "left_anti"), path, mode)
    return refused
