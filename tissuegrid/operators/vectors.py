"""Per-tile vector work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import hash_order
from ..functions.scalars import active, gelu, positional_encoding
from ..functions.skew import attach_by_key

# Largest table of floats shipped to tasks inside a closure (64 MiB of doubles).
CLOSURE_FLOATS = 8 * 1024 * 1024
# vectors that meet a piece of the centers at once
BLOCK_ROWS = 20_000


def zscore(df: DataFrame, stats: DataFrame, features: str = "features", out: str = "z") -> DataFrame:
    """(x - mean) / std per element; ``stats`` is one row of ``mean`` and ``std``."""
    with_stats = df.withColumns({"_mean": stats.select("mean").scalar(), "_std": stats.select("std").scalar()})
    centred = F.zip_with(F.col(features).cast("array<double>"), F.col("_mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("_std"), lambda x, s: x / F.nullif(s, F.lit(0.0)))
    return with_stats.withColumn(out, scaled).drop("_mean", "_std")


def fill_blanks(df: DataFrame, background: DataFrame | None = None, features: str = "features") -> DataFrame:
    """Zero vectors become the background vector (one row, column ``mean``); zeros without one."""
    if background is None:
        return df
    kind = df.schema[features].dataType
    bg = background.select("mean").scalar()
    return df.withColumn(features, F.when(active(features), F.col(features)).otherwise(bg.cast(kind)))


def foreground_mask(df: DataFrame, key: Sequence[str], with_cls: bool = False, features: str = "features") -> DataFrame:
    """Active flag per cell; ``with_cls`` adds a leading true entry (``pos`` -1) per bag."""
    flags = df.select(*key, F.col("pos"), active(features).alias("active"))
    if not with_cls:
        return flags
    lead = df.select(*key).distinct().select(
        *key, F.lit(-1).cast(df.schema["pos"].dataType).alias("pos"), F.lit(True).alias("active")
    )
    return lead.unionByName(flags)


def select_unmasked(
    df: DataFrame, ids: Sequence[str], by: Sequence[str] = (), seed: int | None = None, features: str = "features"
) -> DataFrame:
    """Active rows only; with a seed they also get a random position ``rn`` in their bag."""
    kept = df.where(active(features))
    return kept if seed is None else hash_order(kept, ids, seed, "rn", by=by)


def token_groups(
    df: DataFrame, m: int, seed: int, ids: Sequence[str], by: Sequence[str], out: str = "grp"
) -> DataFrame:
    """m groups of n // m tokens per bag after a shuffle; the remainder joins the last group."""
    if m < 1:
        raise ValueError("m must be at least 1")
    sizes = df.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / m).alias("_per"))
    ranked = attach_by_key(hash_order(df, ids, seed, "_rn", by=by), sizes, by)
    group = F.when(
        F.col("_per") > 0, F.least(F.floor((F.col("_rn") - 1) / F.col("_per")), F.lit(m - 1))
    ).otherwise(F.lit(m - 1))
    return ranked.withColumn(out, group.cast("int")).drop("_rn", "_per")


def masked_copies(df: DataFrame, m: int, seed: int, ids: Sequence[str], by: Sequence[str], features: str = "features") -> DataFrame:
    """m sparse copies of each bag: copy i keeps the active tokens of group i and drops the rest.

    Stored sparsely, so a token is written once with its ``copy`` number.
    """
    return token_groups(df.where(active(features)), m, seed, ids, by, "copy")


def add_positions(df: DataFrame, row: str, col: str, dim: int, features: str = "features", out: str = "encoded") -> DataFrame:
    """Vector plus the 2-D positional encoding of its cell."""
    code = positional_encoding(F.col(row), F.col(col), dim)
    return df.withColumn(out, F.zip_with(F.col(features).cast("array<double>"), code, lambda a, b: a + b))


def project(
    df: DataFrame,
    weights: np.ndarray,
    features: str = "features",
    out: str = "projected",
    mask: str | None = None,
    activation: str | None = "gelu",
) -> DataFrame:
    """x @ weights without bias; GELU; masked rows become zero.

    The matrix product runs in NumPy on Arrow batches. The weight matrix travels in
    the closure, so its size is checked; a larger one is cut by output columns.
    """
    weights = np.asarray(weights, dtype=np.float64)
    width = max(1, CLOSURE_FLOATS // weights.shape[0])
    pieces = []
    frame = df
    for i, at in enumerate(range(0, weights.shape[1], width)):
        frame = frame.withColumn(f"_p{i}", _matmul(weights[:, at : at + width])(F.col(features).cast("array<double>")))
        pieces.append(f"_p{i}")
    value = F.concat(*pieces) if len(pieces) > 1 else F.col(pieces[0])
    if activation == "gelu":
        value = F.transform(value, lambda x: gelu(x))
    elif activation is not None:
        raise ValueError(f"unknown activation {activation!r}")
    if mask is not None:
        value = F.when(F.col(mask), value).otherwise(F.transform(value, lambda x: F.lit(0.0)))
    return frame.withColumn(out, value).drop(*pieces)


def _matmul(weights: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vectors.to_numpy()) @ weights))

    return apply


def nearest_to_centers(
    vecs: DataFrame,
    centers: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    features: str = "features",
    center_id: str = "center_id",
    center: str = "center",
) -> DataFrame:
    """The k vectors closest to each center: ``(center_id, vec_id, distance, rank)``.

    Vectors are dealt in blocks of ``BLOCK_ROWS`` and centers in pieces of at most
    ``CLOSURE_FLOATS`` numbers; every block meets every piece in one task, which keeps its own
    k best for each center. Nothing of either side reaches the driver but two counts.
    """
    width = centers.agg(F.max(F.size(center))).first()[0]
    if not width:
        return centers.select(center_id).join(vecs.select(vec_id), F.lit(False)).withColumns(
            {"distance": F.lit(0.0), "rank": F.lit(0)}
        )
    n_pieces = -(-centers.count() * width // CLOSURE_FLOATS)
    n_blocks = max(1, -(-vecs.count() // BLOCK_ROWS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vecs.select(deal(vec_id, n_blocks).alias("_block"), every(n_pieces).alias("_piece"), F.col(vec_id), F.col(features))
    right = centers.select(every(n_blocks).alias("_block"), deal(center_id, n_pieces).alias("_piece"), F.col(center_id), F.col(center))
    schema = T.StructType([centers.schema[center_id], vecs.schema[vec_id], T.StructField("distance", T.DoubleType())])

    def best(block: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(piece):
            return pd.DataFrame({f.name: [] for f in schema})
        x, keys = np.stack(block[features].to_numpy()).astype(float), block[vec_id].to_numpy()
        matrix, ids = np.stack(piece[center].to_numpy()).astype(float), piece[center_id].to_numpy()
        take, found = min(k, len(keys)), []
        for at in range(0, len(ids), 256):
            c = matrix[at : at + 256]
            rough = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
            # widen by a margin far above rounding error, then measure exactly
            bound = np.partition(rough, take - 1, axis=0)[take - 1]
            row, col = np.nonzero(rough <= bound + 1e-6 * (1 + np.abs(bound)))
            exact = np.sqrt(((x[row] - c[col]) ** 2).sum(axis=1))
            # ties at the bound go by id, so that a block of equal vectors gives k rows as well
            near = pd.DataFrame({center_id: ids[at + col], vec_id: keys[row], "distance": exact}).sort_values(["distance", vec_id])
            found.append(near.groupby(center_id, sort=False, dropna=False).head(k))
        return pd.concat(found)

    met = left.groupBy("_block", "_piece").cogroup(right.groupBy("_block", "_piece")).applyInPandas(best, schema)
    w = Window.partitionBy(center_id).orderBy("distance", vec_id)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def embed_tiles(
    tiles: DataFrame,
    fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str,
    batch: int = 256,
    out: str = "features",
    shape: Sequence[int] | None = None,
) -> DataFrame:
    """Apply a batched encoder to ``column``; rows keep their keys.

    ``fn`` is called once per Python worker and returns the encoder, which maps an
    array of inputs to an array of vectors; ``shape`` is that of one array input,
    none for scalars. Filter tiles before this step: filters
    are not pushed through it.
    """
    from pyspark.ml.functions import predict_batch_udf

    encode = predict_batch_udf(fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[list(shape)] if shape else None)
    return tiles.withColumn(out, encode(F.col(column)))
