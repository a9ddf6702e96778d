"""Object listings, paths and work lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """``(fkey, size)`` of every object below ``path``; contents are never read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("fkey"), F.col("length").alias("size"))
    )
    return found.where(F.col("fkey").endswith(suffix)) if suffix else found


def path_parts(df: DataFrame, col: str) -> DataFrame:
    """Scheme test, bucket, key, base name and slide id of object paths."""
    p = F.col(col)
    remote = p.startswith("s3://")
    tail = F.substring_index(p, "/", -1)
    return (
        df.withColumn("is_remote", remote)
        .withColumn("bucket", F.when(remote, F.regexp_extract(p, r"^s3://([^/]+)", 1)))
        .withColumn("object_key", F.when(remote, F.regexp_extract(p, r"^s3://[^/]+/(.*)$", 1)).otherwise(p))
        .withColumn("basename", tail)
        .withColumn("slide_id", slide_id_of(tail))
    )


def slide_id_of(basename: Column) -> Column:
    """Base name without its known ending."""
    return F.regexp_replace(basename, r"(\.svs|_coords\.h5|_features\.h5|_thumbnail\.png|_heatmap\.png)$", "")


def unique_key(df: DataFrame, path_col: str, sep: str = "::", out: str = "ukey") -> DataFrame:
    """Six hex digits, parent folder and base name; the digits come from the path, so reruns agree."""
    p = F.col(path_col)
    return df.withColumn(
        out,
        F.concat_ws(
            sep,
            F.substring(F.md5(p), 1, 6),
            F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-2)), F.lit("")),
            F.substring_index(p, "/", -1),
        ),
    )


def complete_outputs(done: DataFrame, expected: int = 4, key: str = "fkey") -> DataFrame:
    """Slide ids that have exactly ``expected`` output files."""
    return (
        done.groupBy(slide_id_of(F.substring_index(key, "/", -1)).alias("slide_id"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == expected)
        .select("slide_id")
    )


def work_list(raw: DataFrame, meta: DataFrame, done: DataFrame, expected: int = 4, key: str = "fkey") -> DataFrame:
    """Raw slide files listed in the metadata and not yet complete."""
    slides = raw.where(F.col(key).endswith(".svs")).withColumn(
        "slide_id", slide_id_of(F.substring_index(key, "/", -1))
    )
    return slides.join(meta.select("slide_id"), "slide_id", "left_semi").join(
        complete_outputs(done, expected, key), "slide_id", "left_anti"
    )


def publish_plan(local: DataFrame, remote: DataFrame, reupload: bool = False, ext: str = "", key: str = "fkey") -> DataFrame:
    """Files to copy: right extension and not already there with the same size."""
    wanted = local.where(F.col(key).endswith(ext)) if ext else local
    return wanted if reupload else wanted.join(remote.select(key, "size"), [key, "size"], "left_anti")


def apply_error_policy(
    df: DataFrame, checks: Mapping[str, Column], stop_on_fail: bool
) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows (with ``failed``, the names of the checks missed).

    With ``stop_on_fail`` the first bad row that is evaluated fails the job instead.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    judged = df.withColumn("failed", F.concat_ws(",", failed))
    if stop_on_fail:
        passed = F.when(F.col("failed") == "", F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("row failed: "), F.col("failed"))).cast("boolean")
        )
        return judged.where(passed).drop("failed"), judged.where(F.lit(False))
    return judged.where(F.col("failed") == "").drop("failed"), judged.where(F.col("failed") != "")
