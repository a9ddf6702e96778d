"""Attention through landmarks: linear in the tiles of a slide.

The tokens of a bag are cut, in order, into segments; the mean of a segment is a landmark. The
matrix of all weights is approximated by three thin ones: tokens against landmarks, the
inverse of landmarks against each other, landmarks against tokens. The outer two are attention whose
keys or queries are the landmarks, so tokens pass twice and meet only landmarks; the middle one is a small
matrix for each bag, inverted by iteration.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import key_hash, matrix, vectors, whole_groups
from ..functions.ranking import bucketed_row_number
from ..session import cut
from .attention import AttentionWeights, attend
from .pooling import vector_mean

ITERATIONS = 6


def iterated_inverse(a: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Pseudo-inverse of square matrices (..., m, m) by a third-order iteration from the scaled transpose.

    A matrix of zeros has an inverse of zeros.
    """
    flipped = np.swapaxes(a, -1, -2)
    size = np.abs(a).sum(axis=-1).max(axis=-1) * np.abs(a).sum(axis=-2).max(axis=-1)
    z = flipped / np.where(size > 0, size, 1.0)[..., None, None]
    one = np.eye(a.shape[-1])
    for _ in range(iterations):
        az = a @ z
        z = 0.25 * z @ (13 * one - az @ (15 * one - az @ (7 * one - az)))
    return z


def inverse_residual(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Largest error of ``a z a`` as a stand-in for ``a``; 0 for a true pseudo-inverse, of singular matrices too."""
    return np.abs(a @ z @ a - a).max(axis=(-1, -2))


def pseudo_inverses(bags: DataFrame, values: str, *, iterations: int = ITERATIONS) -> DataFrame:
    """``bags`` with ``inverse array<double>`` and ``residual double`` of the square matrix in ``values``, row after row.

    A null matrix has a null inverse; a singular one the pseudo-inverse as far as the iteration gets, which
    ``residual`` tells. A number of values that is no square is refused.
    """
    schema = T.StructType([*bags.schema.fields]).add("inverse", T.ArrayType(T.DoubleType())).add("residual", T.DoubleType())
    at = bags.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inverse, residual = [], []
            for row in batch.column(at).to_pylist():
                if row is None:
                    inverse.append(None)
                    residual.append(None)
                    continue
                m = round(len(row) ** 0.5)
                if m * m != len(row):
                    raise ValueError("a square matrix is expected")
                a = np.array(row, float).reshape(m, m)
                z = iterated_inverse(a, iterations)
                inverse.append(z.ravel().tolist())
                residual.append(float(inverse_residual(a, z)) if m else 0.0)
            made = [pa.array(inverse, pa.list_(pa.float64())), pa.array(residual, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return bags.mapInArrow(run, schema)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def landmark_attention(
    tokens: DataFrame,
    weights: AttentionWeights,
    *,
    by: Sequence[str] = ("slide_id",),
    token: Sequence[str] = ("gx", "gy"),
    features: str = "features",
    mask: str | None = None,
    landmarks: int = 32,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """``(*by, *token, features array<double>, residual double)``, one row per row of ``tokens``.

    ``token`` are whole numbers that place a token in its bag and order it. A bag of n active tokens is cut into
    ``landmarks`` segments of about n / landmarks (fewer if n is less). Rows whose ``mask`` is false or null are
    no part of any segment, no keys, and answered with zeros and a null residual. ``residual`` is the largest error of the bag's
    inverse over all heads: where it is not small, ``iterations`` are too few. With as many landmarks as
    tokens and a small residual the answer is that of full attention.

    Only the landmarks of a bag, at most ``landmarks`` rows, ever stand together.
    """
    if weights.rel_rows is not None:
        raise ValueError("landmarks have no place on a grid")
    by, token = list(by), list(token)
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
    rows = tokens.select(*by, *[F.col(c).cast("long").alias(c) for c in token], F.col(features).cast("array<double>").alias("features"), on.alias("live"))
    # read seven times below, and whatever made the tokens would run each time
    rows = cut(rows, "tokens")
    live = rows.where("live").select(*key_hash(by), *by, *token)
    # positions alone are ordered; vectors join afterwards
    placed = bucketed_row_number(live, "_n", by=["_g", "_h"], keys=[F.col(c) for c in token], order=[F.col(c) for c in token])
    placed = cut(placed, "token-order")
    sizes = placed.groupBy("_g", "_h").agg(F.max("_n").alias("_all"))
    step = F.ceil(F.col("_all") / landmarks)
    segment = F.floor((F.col("_n") - 1) / step).cast("long")
    numbered = placed.join(sizes, ["_g", "_h"]).select("_g", "_h", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(token)], segment.alias("landmark"))
    given = rows.where("live").select("*", *key_hash(by))
    same = (given["_g"] == numbered["_g"]) & (given["_h"] == numbered["_h"])
    for i, c in enumerate(token):
        same = same & (given[c] == numbered[f"_t{i}"])
    zero = F.array_repeat(F.lit(0.0), weights.width)
    means = given.join(numbered, same).groupBy(*by, "landmark").agg(vector_mean(F.coalesce("features", zero)).alias("features"))
    means = cut(means, "landmarks")

    inner = weights.query.shape[1]
    plain = replace(weights, out=np.eye(inner), bias=None)
    gathered = _gathered(means, rows, plain, by, token)
    scale = weights.scale if weights.scale is not None else weights.head_width**-0.5
    heads = weights.heads
    both = means.select(*by, "landmark", F.col("features").alias("_x")).join(
        gathered.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("landmark").alias("_l"), F.col("features").alias("_v")),
        _null_safe(by) & (F.col("landmark") == F.col("_l")),
    )
    place = ["_g", "_h"]
    sorted_ = both.select(*key_hash(by), *by, "landmark", "_x", "_v").repartition(parts, *place).sortWithinPartitions(*place, "landmark")
    schema = T.StructType([*[means.schema[c] for c in by], T.StructField("landmark", T.LongType())])
    schema = schema.add("features", T.ArrayType(T.DoubleType())).add("_values", T.ArrayType(T.DoubleType())).add("residual", T.DoubleType())

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bag in whole_groups(batches, 2):
            x, v = matrix(bag.column("_x"), weights.width), matrix(bag.column("_v"), inner)
            m = len(x)
            split = lambda y: y.reshape(m, heads, -1).transpose(1, 0, 2)
            q, k = split(x @ weights.query), split(x @ weights.key)
            a = _softmax(q @ k.transpose(0, 2, 1) * scale)
            z = iterated_inverse(a, iterations)
            made = (z @ split(v)).transpose(1, 0, 2).reshape(m, -1)
            residual = pa.array(np.full(m, inverse_residual(a, z).max()))
            columns = [bag.column(c).combine_chunks() for c in (*by, "landmark", "_x")]
            yield pa.RecordBatch.from_arrays([*columns, vectors(made), residual], names=schema.names)

    middle = cut(sorted_.mapInArrow(invert, schema), "landmark-values")
    answered = _spread(rows, middle, weights, by, token)
    residuals = middle.groupBy(*by).agg(F.first("residual").alias("residual"))
    joined = answered.join(residuals.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("residual").alias("_r")), _null_safe(by), "left")
    marked = rows.where("NOT live").select(*by, *token, F.array_repeat(F.lit(0.0), weights.out.shape[1]).alias("features"), F.lit(None).cast("double").alias("residual"))
    return joined.select(*by, *token, "features", F.col("_r").alias("residual")).unionByName(marked)


def _null_safe(by: list[str]):
    on = F.col(by[0]).eqNullSafe(F.col("_b0"))
    for i, c in enumerate(by[1:], 1):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return on


def _gathered(means: DataFrame, rows: DataFrame, weights: AttentionWeights, by: list[str], token: list[str]) -> DataFrame:
    """Every landmark over all active tokens of its bag."""
    none = F.lit(0).cast("long")
    asked = means.select(*by, "landmark", *[none.alias(c) for c in token], "features")
    told = rows.where("live").select(*by, none.alias("landmark"), *token, "features")
    return attend(asked, told, weights, by=by, token=["landmark", *token]).select(*by, "landmark", "features")


def _spread(rows: DataFrame, middle: DataFrame, weights: AttentionWeights, by: list[str], token: list[str]) -> DataFrame:
    """Every active token over the landmarks of its bag, whose values are ready."""
    none = F.lit(0).cast("long")
    asked = rows.where("live").select(*by, none.alias("landmark"), *token, "features")
    told = middle.select(*by, "landmark", *[none.alias(c) for c in token], "features", "_values")
    return attend(asked, told, weights, by=by, token=["landmark", *token], values="_values").select(*by, *token, "features")
