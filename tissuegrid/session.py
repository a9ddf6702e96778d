"""Session helpers: checkpoint folder, scratch paths and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    The folder the cluster names in ``spark.checkpoint.dir`` wins. A private
    temporary folder is used only in local mode, where every task runs on this
    machine; a cluster session without the setting is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tissuegrid-")
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark)}/tissuegrid/{app}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where a frame feeds several branches or an iteration. Unlike an RDD
    checkpoint the result keeps column pruning and its true size, so the planner
    can choose broadcast joins on evidence. It survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the stored table behind a frame that ``cut`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/tissuegrid/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has stored for this application; call it once the results that read them are written."""
    folder = f"{checkpoint_dir(spark)}/tissuegrid/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
