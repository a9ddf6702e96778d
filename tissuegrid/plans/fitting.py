"""Fitting an attention head over pooled regions.

A bag's regions are weighed by the softmax of their product with one vector, and the weighted mean goes through a
linear head and a sigmoid. An epoch is one pass: every task adds up the gradients of its bags, and the sums of
tasks are added once more; what reaches the driver is as long as the weights, however many bags there are. Gradients
are added as whole numbers, so that neither the number of tasks nor their order changes a bit of the result.

Bags are put together and stored once, one row each; no epoch moves a vector. The regions of one bag must fit a task:
they are pooled regions, not tiles. After each epoch weights, rate and counters are stored, and a later call goes on
from the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import key_hash, matrix, whole_groups
from ..session import cut, scratch_path

# one unit of a whole-number sum
UNIT = 2.0**-26


@dataclass(frozen=True)
class FitParams:
    """Schedule of a fit. The rate is multiplied by ``shrink`` after ``plateau`` epochs without a better validation loss."""

    epochs: int = 50
    rate: float = 0.1
    shrink: float = 0.5
    plateau: int = 3
    patience: int = 8
    least_gain: float = 1e-4
    seed: int = 42


def bag_gradient(x: np.ndarray, y: float, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a bag of regions and its gradient by attention vector, head and bias."""
    width = x.shape[1]
    attention, head, bias = weights[:width], weights[width : 2 * width], weights[-1]
    logit = x @ attention
    share = np.exp(logit - logit.max())
    share /= share.sum()
    pooled = share @ x
    z = pooled @ head + bias
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    off = p - y
    by_attention = off * ((share * (x @ head - pooled @ head)) @ x)
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z)))
    return float(loss), np.concatenate([by_attention, off * pooled, [off]])


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row per bag with the vectors of its regions one after the other."""
    for bag in whole_groups(batches, 2):
        flat = matrix(bag.column("_f"), width).ravel()
        vectors = pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()), pa.array(flat))
        one = [bag.column(c).slice(0, 1).combine_chunks() for c in ("_learn", "_y")]
        one = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in one]
        yield pa.RecordBatch.from_arrays([*one, vectors], names=["_learn", "_y", "_x"])


def _epoch(placed: DataFrame, weights: np.ndarray) -> dict[bool, tuple[int, float, np.ndarray]]:
    """Number of bags, mean loss and mean gradient of the bags to learn from (True) and to judge by (False)."""
    width = (len(weights) - 1) // 2
    n = len(weights) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {True: np.zeros(n, np.int64), False: np.zeros(n, np.int64)}
        for batch in batches:
            bags = batch.column("_x")
            flat, ends = bags.flatten().to_numpy(), bags.offsets.to_numpy()
            ends = ends - ends[0]
            kept = zip(batch.column("_learn").to_pylist(), batch.column("_y").to_pylist(), ends[:-1], ends[1:], strict=True)
            for learn, y, a, b in kept:
                loss, gradient = bag_gradient(flat[a:b].reshape(-1, width), y, weights)
                sums[learn] += np.rint(np.concatenate([[1.0], [loss], gradient]) / UNIT).astype(np.int64)
        kinds, places, values = [], [], []
        for learn, total in sums.items():
            kinds += [learn] * n
            places += list(range(n))
            values += total.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(places, pa.int32()), pa.array(values, pa.int64())], names=["learn", "at", "v"])

    # a task gives as many rows as there are weights, and so does their sum
    rows = placed.mapInArrow(run, "learn boolean, at int, v long").groupBy("learn", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for kind in (True, False):
        total = np.zeros(n)
        for r in rows:
            if r["learn"] == kind:
                total[r["at"]] = r["v"] * UNIT
        bags = max(1, round(total[0]))
        out[kind] = (round(total[0]), total[1] / bags, total[2:] / bags)
    return out


_STEP = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("best", T.DoubleType()),
        T.StructField("stale", T.IntegerType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ]
)


def stored_steps(spark: SparkSession, store: str) -> DataFrame:
    """One row per epoch: losses before its step, rate, best validation loss so far, epochs since, and the weights after it."""
    return spark.read.schema(_STEP).option("recursiveFileLookup", True).parquet(store)


def fit_head(
    regions: DataFrame,
    labels: DataFrame,
    p: FitParams = FitParams(),
    *,
    bag: str = "patient_id",
    features: str = "features",
    label: str = "label",
    learn: str = "learn",
    store: str | None = None,
) -> DataFrame:
    """``stored_steps`` of a fit on ``regions`` ``(bag, features)`` with ``labels`` ``(bag, label 0..1, learn boolean)``.

    Bags with a true ``learn`` give the gradient, the others the validation loss by which the rate shrinks and the fit
    stops early; without any of the others the training loss stands in. Bags without a label, or with a null one, are left out;
    a null vector counts as zeros. ``store`` is a folder on shared storage; steps found there are gone on from.
    """
    spark = regions.sparkSession
    sides = labels.where(F.col(label).isNotNull() & F.col(bag).isNotNull()).groupBy(F.col(bag).alias("_bag")).agg(
        F.max(F.col(label).cast("double")).alias("_y"), F.bool_and(F.coalesce(F.col(learn), F.lit(False))).alias("_learn")
    )
    joined = regions.select(F.col(bag).alias("_bag"), F.col(features).cast("array<double>").alias("_f")).join(sides, "_bag")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = joined.select(*key_hash(["_bag"]), "_learn", "_y", "_f", F.xxhash64("_f").alias("_o"))
    width = joined.agg(F.max(F.size("_f"))).first()[0]
    store = store or scratch_path(spark, "fit-steps")
    if width is None or width < 1:
        return spark.createDataFrame([], _STEP)
    sorted_ = keyed.repartition(parts, "_g", "_h").sortWithinPartitions("_g", "_h", "_o")
    placed = cut(sorted_.mapInArrow(lambda batches: _packed(batches, width), "_learn boolean, _y double, _x array<double>"), "fit-bags")
    first = np.random.default_rng(p.seed).normal(scale=0.01, size=2 * width + 1)
    weights, rate, best, stale, start = first, p.rate, np.inf, 0, 0
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        last = stored_steps(spark, store).orderBy(F.desc("epoch")).first()
        if last is not None:
            weights, rate, best, stale, start = np.array(last["weights"]), last["rate"], last["best"], last["stale"], last["epoch"] + 1
    for epoch in range(start, p.epochs):
        if stale >= p.patience:
            break
        found = _epoch(placed, weights)
        train, val = found[True][1], found[False][1] if found[False][0] else found[True][1]
        if val < best - p.least_gain:
            best, stale = val, 0
        else:
            stale += 1
            if stale % p.plateau == 0:
                rate *= p.shrink
        weights = weights - rate * found[True][2]
        step = [(epoch, float(train), float(val), float(rate), float(best), stale, weights.tolist())]
        spark.createDataFrame(step, _STEP).coalesce(1).write.mode("overwrite").parquet(f"{store}/step={epoch:05d}")
    return stored_steps(spark, store)
