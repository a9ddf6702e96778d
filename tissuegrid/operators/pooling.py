"""Element-wise aggregation of vector columns.

The dense-vector summarizer merges partial results on the map side, so a group of
any size reaches its reducer as one vector per task. Nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import attach_by_key

EPSILON = 1e-7


def _vector(features: str | Column) -> Column:
    f = F.col(features) if isinstance(features, str) else features
    return array_to_vector(f.cast("array<double>"))


def _summary(features, metrics: Sequence[str], weight: Column | None = None) -> Column:
    made = Summarizer.metrics(*metrics)
    return made.summary(_vector(features), weight) if weight is not None else made.summary(_vector(features))


def vector_sum(features) -> Column:
    return vector_to_array(Summarizer.sum(_vector(features)))


def vector_mean(features, weight: Column | None = None) -> Column:
    v = _vector(features)
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def vector_max(features) -> Column:
    return vector_to_array(Summarizer.max(_vector(features)))


def vector_stats(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """``mean`` and population ``std`` of every dimension, plus ``n``."""
    agg = df.groupBy(*by).agg(_summary(features, ["mean", "variance", "count"]).alias("s"))
    n = F.col("s.count")
    shrink = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return agg.select(
        *by,
        n.alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) * shrink)).alias("std"),
    )


def mean_vector(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of the given rows (a background vector)."""
    return df.groupBy(*by).agg(vector_mean(features).alias("mean"))


def masked_mean_pool(df: DataFrame, key: Sequence[str], mask: str | None, features: str = "features") -> DataFrame:
    """Sum of unmasked vectors over (their count + 1e-7); plain mean without a mask."""
    if mask is None:
        return df.groupBy(*key).agg(vector_mean(features).alias("pooled"))
    zero = F.transform(features, lambda x: F.lit(0.0).cast("double"))
    kept = F.when(F.col(mask), F.col(features).cast("array<double>")).otherwise(zero)
    return (
        df.groupBy(*key)
        .agg(vector_sum(kept).alias("_sum"), F.count_if(mask).alias("_n"))
        .select(*key, F.transform("_sum", lambda x: x / (F.col("_n") + F.lit(EPSILON))).alias("pooled"))
    )


def max_pool(df: DataFrame, key: Sequence[str], mask: str | None = None, features: str = "features") -> DataFrame:
    """Element-wise maximum; masked rows count as -10000 in every element."""
    values = F.col(features).cast("array<double>")
    if mask is not None:
        values = F.when(F.col(mask), values).otherwise(F.transform(values, lambda x: F.lit(-10000.0)))
    return df.groupBy(*key).agg(vector_max(values).alias("pooled"))


def avg_max_pool(df: DataFrame, key: Sequence[str], mask: str, features: str = "features") -> DataFrame:
    """Masked mean and plain maximum side by side, in one pass; ``unmasked`` if any row is."""
    values = F.col(features).cast("array<double>")
    kept = F.when(F.col(mask), values).otherwise(F.transform(values, lambda x: F.lit(0.0)))
    return (
        df.groupBy(*key)
        .agg(
            vector_sum(kept).alias("_sum"),
            vector_max(values).alias("_max"),
            F.count_if(mask).alias("_n"),
            F.bool_or(mask).alias("unmasked"),
        )
        .select(
            *key,
            F.concat(F.transform("_sum", lambda x: x / (F.col("_n") + F.lit(EPSILON))), "_max").alias("pooled"),
            "unmasked",
        )
    )


def attention_weights(df: DataFrame, key: Sequence[str], logit: str, mask: str | None = None) -> DataFrame:
    """Softmax of ``logit`` inside each bag as ``weight``; masked rows are lowered by 1e9."""
    raised = F.col(logit) if mask is None else F.when(F.col(mask), F.col(logit)).otherwise(F.col(logit) - F.lit(1e9))
    # maximum and sum come from keys and logits alone; vectors join once
    scores = df.select(*key, raised.alias("_l"))
    top = scores.groupBy(*key).agg(F.max("_l").alias("_top"))
    total = attach_by_key(scores, top, key).groupBy(*key).agg(
        F.first("_top").alias("_top"), F.sum(F.exp(F.col("_l") - F.col("_top"))).alias("_total")
    )
    return attach_by_key(df.withColumn("_l", raised), total, key).withColumn(
        "weight", F.exp(F.col("_l") - F.col("_top")) / F.col("_total")
    ).drop("_l", "_top", "_total")


def attention_pool(
    df: DataFrame, key: Sequence[str], logit: str, mask: str | None = None, features: str = "features"
) -> DataFrame:
    """Softmax-weighted mean vector of each bag.

    The weighted mean divides by the sum of weights itself, so only the largest
    logit of each bag is needed beforehand.
    """
    raised = F.col(logit) if mask is None else F.when(F.col(mask), F.col(logit)).otherwise(F.col(logit) - F.lit(1e9))
    scored = df.withColumn("_l", raised)
    top = scored.groupBy(*key).agg(F.max("_l").alias("_top"))
    return (
        attach_by_key(scored, top, key)
        .groupBy(*key)
        .agg(vector_mean(features, F.exp(F.col("_l") - F.col("_top"))).alias("pooled"))
    )
