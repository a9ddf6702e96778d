"""Tiles from chunked array stores.

A slide is a folder with two arrays, ``coords`` (n, 2) and ``features`` (n, width), each a ``zarr.json`` and chunks of
whole rows under ``c/<i>/0``: plain bytes, or gzip. A chunk is one file and one task's work; what a query does not need
(the other array, chunks outside a range of rows) is left out of the listing and never opened.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.words import SLIDE

_META = (
    "shape array<long>, data_type string, chunk_grid struct<configuration: struct<chunk_shape: array<long>>>, "
    "codecs array<struct<name: string, configuration: struct<endian: string>>>"
)
# numbers that arrays may hold, fixed names of the format
KINDS = {"int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "float32": "f4", "float64": "f8"}


def _part(path: Column, back: int) -> Column:
    """The ``back``-th folder or file from the end of a path."""
    return F.element_at(F.split(path, "/"), -back)


def array_metadata(spark: SparkSession, path: str, array: str) -> DataFrame:
    """``(slide_id, n_rows, width, chunk_rows, kind, big_endian, codecs)`` of one array of every slide."""
    text = spark.read.text(f"{path}/*/{array}/zarr.json", wholetext=True).select(
        _part(F.input_file_name(), 3).alias(SLIDE), F.from_json("value", _META, {"mode": "FAILFAST"}).alias("m")
    )
    codecs = F.transform("m.codecs", lambda c: c["name"])
    big = F.exists("m.codecs", lambda c: F.coalesce(c["configuration"]["endian"] == "big", F.lit(False)))
    chunk = F.col("m.chunk_grid.configuration.chunk_shape")
    return text.select(
        SLIDE,
        F.get("m.shape", F.lit(0)).alias("n_rows"),
        F.get("m.shape", F.lit(1)).alias("width"),
        F.get(chunk, F.lit(0)).alias("chunk_rows"),
        F.get(chunk, F.lit(1)).alias("chunk_width"),
        F.col("m.data_type").alias("kind"),
        big.alias("big_endian"),
        codecs.alias("codecs"),
    )


def decode_chunk(content: bytes, kind: str, big_endian: bool, codecs: list[str], width: int) -> np.ndarray:
    """Rows of a chunk; an unknown codec or kind of number is refused."""
    for name in reversed(codecs):
        if name == "gzip":
            content = gzip.decompress(content)
        elif name != "bytes":
            raise ValueError(f"unknown codec {name}")
    if kind not in KINDS:
        raise ValueError(f"unknown kind of number {kind}")
    return np.frombuffer(content, (">" if big_endian else "<") + KINDS[kind]).reshape(-1, width)


def read_array(spark: SparkSession, path: str, array: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """``(slide_id, tile_idx long, values array<double>)``: rows ``rows[0] <= tile_idx < rows[1]`` (default all) of one array.

    A chunk that is not stored has no rows. Rows that only fill up the last chunk are left out.
    """
    meta = array_metadata(spark, path, array)
    which = "*"
    if rows is not None:
        # chunk sizes follow from a rule, so that there are few of them
        sizes = [r[0] for r in meta.select("chunk_rows").distinct().collect()]
        wanted = sorted({i for n in sizes for i in range(max(0, rows[0]) // n, -(-rows[1] // n))})
        if not wanted:
            return spark.createDataFrame([], "slide_id string, tile_idx long, values array<double>")
        which = "{" + ",".join(map(str, wanted)) + "}"
    files = spark.read.format("binaryFile").load(f"{path}/*/{array}/c/{which}/0")
    chunks = files.select(_part(F.col("path"), 5).alias(SLIDE), _part(F.col("path"), 2).cast("long").alias("i"), "content").join(meta, SLIDE)
    columns = [SLIDE, "i", "content", "n_rows", "width", "chunk_rows", "chunk_width", "kind", "big_endian", "codecs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                slide, i, content, n_rows, width, chunk_rows, chunk_width, kind, big, codecs = (batch.column(k)[r].as_py() for k in range(len(columns)))
                if chunk_width != width:
                    raise ValueError("chunks of whole rows are expected")
                found = decode_chunk(content, kind, big, codecs, width)[: max(0, n_rows - i * chunk_rows)].astype(float)
                index = np.arange(len(found)) + i * chunk_rows
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * width)
                values = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([slide] * len(found)), pa.array(index), values], names=["slide_id", "tile_idx", "values"])

    out = chunks.select(*columns).mapInArrow(run, "slide_id string, tile_idx long, values array<double>")
    return out if rows is None else out.where(F.col("tile_idx").between(rows[0], rows[1] - 1))


def read_chunked_tiles(spark: SparkSession, path: str, *, features: bool = True, rows: tuple[int, int] | None = None) -> DataFrame:
    """``(slide_id, tile_idx, gx int, gy int, features array<float>)`` of every slide below ``path``.

    Without ``features`` that column is not there and no chunk of it is read. ``rows`` is a range of positions in each slide.
    A position with only one of its two parts stored is left out, as of ``read_tiles`` only aligned slides are kept.
    """
    at = read_array(spark, path, "coords", rows)
    place = at.select(SLIDE, "tile_idx", *[F.get("values", F.lit(i)).cast("int").alias(c) for i, c in enumerate(("gx", "gy"))])
    if not features:
        return place
    vectors = read_array(spark, path, "features", rows).select(SLIDE, "tile_idx", F.col("values").cast("array<float>").alias("features"))
    return place.join(vectors, [SLIDE, "tile_idx"])
