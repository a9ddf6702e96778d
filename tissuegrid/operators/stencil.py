"""Convolution over the sparse tile grid.

A slide's grid is cut into blocks. A cell goes to its own block and, if it has a value, to
every block whose cells it can reach; that is the only shuffle, for any number of kernels. A
block with its halo is one small dense array, so a slide of any size is spread over tasks and no
slide is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import key_hash, matrix, vectors, whole_groups
from ..functions.scalars import active
from .words import SLIDE

BLOCK = 32


def _blocks(at: Column, before: int, behind: int) -> Column:
    """Blocks that hold an output cell which a cell at ``at`` can reach."""
    return F.sequence(F.floor((at - behind) / BLOCK).cast("int"), F.floor((at + before) / BLOCK).cast("int"))


def convolve_block(cells: np.ndarray, kernels: Sequence[np.ndarray], before: int, behind: int) -> np.ndarray:
    """Sum of the depthwise convolutions of a block; ``cells`` has ``before`` and ``behind`` lines of halo on either axis."""
    rows, cols = (n - before - behind for n in cells.shape[:2])
    out = np.zeros((rows, cols, cells.shape[2]))
    for kernel in kernels:
        first = before - (kernel.shape[0] - 1) // 2
        for i in range(kernel.shape[0]):
            for j in range(kernel.shape[1]):
                out += kernel[i, j] * cells[first + i : first + i + rows, first + j : first + j + cols]
    return out


def grid_convolve(
    tiles: DataFrame,
    kernels: Sequence[np.ndarray],
    *,
    features: str = "features",
    residual: bool = True,
    pointwise: np.ndarray | None = None,
) -> DataFrame:
    """``(slide_id, gx, gy, features array<double>)``, one row per cell.

    A kernel is an array (k, k, width): its number (i, j, d) weighs element d of the cell at
    ``gx + i - (k - 1) // 2, gy + j - (k - 1) // 2``; cells that are missing count as zeros. The results
    of all kernels are added, multiplied by the matrix ``pointwise`` (width, width out) if there is one, and added to
    the cell's own vector if ``residual``. Blank cells, whose vector is all zeros or null, stay blank.

    Tiles that share a cell are summed first. Rows without a coordinate are left out. Kernels
    and matrix are parameters of a model and travel with the task.
    """
    kernels = [np.asarray(k, float) for k in kernels]
    width = kernels[0].shape[2]
    if any(k.ndim != 3 or k.shape[0] != k.shape[1] or k.shape[2] != width for k in kernels):
        raise ValueError("kernels are square and of one width")
    mix = None if pointwise is None else np.asarray(pointwise, float)
    out_width = width if mix is None else mix.shape[1]
    if residual and out_width != width:
        raise ValueError("a residual needs as many numbers as the input has")
    before, behind = max((k.shape[0] - 1) // 2 for k in kernels), max(k.shape[0] // 2 for k in kernels)
    side = BLOCK + before + behind
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["_g", "_h", "_bx", "_by"]
    placed = (
        tiles.where(F.col("gx").isNotNull() & F.col("gy").isNotNull())
        .select(*key_hash([SLIDE]), SLIDE, F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.col(features).cast("array<double>").alias("_f"))
        .withColumn("_bx", F.explode(_blocks(F.col("gx"), before, behind)))
        .withColumn("_by", F.explode(_blocks(F.col("gy"), before, behind)))
        .withColumn("_own", (F.floor(F.col("gx") / BLOCK) == F.col("_bx")) & (F.floor(F.col("gy") / BLOCK) == F.col("_by")))
        .where(F.col("_own") | F.coalesce(active("_f"), F.lit(False)))
        .select(*place, SLIDE, "gx", "gy", "_own", "_f")
        .repartition(parts, *place)
        .sortWithinPartitions(*place, "gx", "gy")
    )
    schema = T.StructType([placed.schema[SLIDE]]).add("gx", T.IntegerType()).add("gy", T.IntegerType()).add("features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, 4):
            own = block.column("_own").to_numpy(zero_copy_only=False)
            if not own.any():
                continue
            x0, y0 = (block.column(c)[0].as_py() * BLOCK - before for c in ("_bx", "_by"))
            x, y = block.column("gx").to_numpy() - x0, block.column("gy").to_numpy() - y0
            given = matrix(block.column("_f"), width)
            cells = np.zeros((side, side, width))
            np.add.at(cells, (x, y), given)
            found = convolve_block(cells, kernels, before, behind)
            at = np.unique(x[own] * side + y[own])
            cx, cy = at // side, at % side
            source = cells[cx, cy]
            result = found[cx - before, cy - before]
            if mix is not None:
                result = result @ mix
            if residual:
                result = result + source
            result[~source.any(axis=1)] = 0.0
            slide = block.column(SLIDE).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))
            columns = [slide, pa.array((cx + x0).astype(np.int32)), pa.array((cy + y0).astype(np.int32)), vectors(result)]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)

    return placed.mapInArrow(run, schema)
