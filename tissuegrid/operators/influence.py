"""Which regions of a slide drive its score: scores without a region, and attention laid over the grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.skew import attach_by_key
from ..session import cut
from .words import SLIDE


def _head_scores(features: Column, head: np.ndarray) -> Column:
    """Products of a vector with the columns of ``head``; a null vector counts as zeros."""
    each = [F.aggregate(F.zip_with(features, F.lit([float(x) for x in column]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for column in head.T]
    return F.when(features.isNotNull(), F.array(*each)).otherwise(F.array_repeat(F.lit(0.0), head.shape[1]))


def _scored(mean: Column, bias: np.ndarray, squash: bool) -> Column:
    out = F.zip_with(mean, F.lit([float(b) for b in bias]), lambda m, b: m + b)
    return F.transform(out, sigmoid) if squash else out


def _log_sum(top: Column, total: Column) -> Column:
    return top + F.log(total)


def dropout_influence(
    tiles: DataFrame,
    head: np.ndarray,
    bias: Sequence[float],
    *,
    bag: Sequence[str] = (SLIDE,),
    region: str = "region_id",
    features: str = "features",
    logit: str | None = None,
    squash: bool = True,
) -> DataFrame:
    """``(*bag, region, n_tiles long, share double, score, score_without, influence array<double>)``, one row per region.

    A bag's score is a linear head on the mean of its tiles' vectors, weighted by the softmax of ``logit`` (or
    plain without one), and squashed by a sigmoid. ``share`` is the region's part of the weights, ``score_without``
    the bag's score were the region not there, ``influence`` what it adds: score minus score without. A
    region that is all of its bag has no score without it (null). Rows with a null logit are left out; a null
    region is a region.

    The head is linear, so a tile is its products with the head and no vector is aggregated. A region is a sum, and
    leaving it out is a difference: every bag is summed once. The heaviest region is kept apart from the
    sum of the others, so that no difference cancels.
    """
    head = np.asarray(head, float).reshape(len(head), -1)
    bag = list(bag)
    n = head.shape[1]
    part = [*bag, region]
    weight = F.lit(0.0) if logit is None else F.col(logit).cast("double")
    rows = tiles.select(*part, weight.alias("_l"), _head_scores(F.col(features).cast("array<double>"), head).alias("_y")).where(F.col("_l").isNotNull())

    def summed(df: DataFrame, key: list[str], level: Column, count: Column) -> DataFrame:
        """Log weight and mean products of the rows of a key, each of log weight ``level``."""
        given = df.withColumn("_w", level)
        top = given.groupBy(*key).agg(F.max("_w").alias("_top"))
        hashed = given.join(top.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_top"), _same(key))
        raised = F.exp(F.col("_w") - F.col("_top"))
        sums = hashed.groupBy(*key).agg(
            F.first("_top").alias("_top"), F.sum(raised).alias("_s"), count.alias("_n"), *[F.sum(raised * F.get("_y", F.lit(i))).alias(f"_t{i}") for i in range(n)]
        )
        means = F.array(*[F.col(f"_t{i}") / F.col("_s") for i in range(n)])
        return sums.select(*key, _log_sum(F.col("_top"), F.col("_s")).alias("_lw"), F.col("_n"), means.alias("_y"))

    regions = cut(summed(rows, part, F.col("_l"), F.count(F.lit(1))), "regions")
    heaviest = regions.groupBy(*bag).agg(F.max(F.struct("_lw", F.col(region).isNull().alias("none"), F.col(region).alias("region"), "_y")).alias("_first"))
    marked = cut(_attach(regions, heaviest, bag).withColumn("_is_first", F.col(region).eqNullSafe(F.col("_first.region"))), "marked-regions")
    others = summed(marked.where("NOT _is_first").select(*bag, "_lw", "_y", "_n"), bag, F.col("_lw"), F.sum("_n"))
    others = others.select(*bag, F.col("_lw").alias("_rest_lw"), F.col("_y").alias("_rest_y"))
    both = _attach(marked, others, bag, "left")
    # the heaviest weighs one; all others together, and this region, in its terms
    rest = F.coalesce(F.exp(F.col("_rest_lw") - F.col("_first._lw")), F.lit(0.0))
    own = F.exp(F.col("_lw") - F.col("_first._lw"))
    rest_y = F.coalesce("_rest_y", F.array_repeat(F.lit(0.0), n))
    first_y = F.col("_first._y")
    mix = lambda a, wa, b, wb: F.zip_with(a, b, lambda x, y: (x * wa + y * wb) / (wa + wb))
    whole = mix(first_y, F.lit(1.0), rest_y, rest)
    left = F.greatest(rest - own, F.lit(0.0))
    without = F.when(F.col("_is_first"), F.col("_rest_y")).otherwise(
        F.transform(F.arrays_zip(first_y.alias("f"), rest_y.alias("r"), F.col("_y").alias("o")), lambda z: (z["f"] + z["r"] * rest - z["o"] * own) / (1 + left))
    )
    made = both.select(
        *part,
        F.col("_n").alias("n_tiles"),
        (own / (1 + rest)).alias("share"),
        _scored(whole, np.asarray(bias, float), squash).alias("score"),
        F.when(without.isNotNull(), _scored(without, np.asarray(bias, float), squash)).alias("score_without"),
    )
    return made.withColumn("influence", F.zip_with("score", "score_without", lambda a, b: a - b))


def _same(key: list[str]) -> Column:
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}")) if i else F.col(c).eqNullSafe(F.col("_k0"))
    return on


def _attach(df: DataFrame, side: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined null-safely to ``side``, one row per key."""
    renamed = side.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[c for c in side.columns if c not in key])
    return df.join(renamed, _same(key), how).drop(*[f"_k{i}" for i in range(len(key))])


def attention_map(
    cells: DataFrame, patches: DataFrame, *, weight: str = "weight", patch_weight: str = "weight", patch_key: Sequence[str] = (SLIDE, "patch_id")
) -> DataFrame:
    """``(slide_id, gx, gy, coverage long, weight double)``: attention of all levels laid over a slide's grid.

    ``cells`` has the weight of a cell inside its patch (``slide_id, patch_id, gx, gy``), ``patches`` that of the patch in
    its slide. The two are multiplied; a cell under several overlapping patches takes their mean, so that
    cells seen twice are not brighter for it, and the map of a slide sums to one. Weights are at
    least 0, null counts as 0; a slide without any weight has a map of zeros. Cells of unknown patches weigh 0.
    """
    key = list(patch_key)
    sides = patches.groupBy(*key).agg(F.sum(F.coalesce(F.col(patch_weight), F.lit(0.0)).cast("double")).alias("_p"))
    joined = attach_by_key(cells.select(*key, "gx", "gy", F.coalesce(F.col(weight), F.lit(0.0)).cast("double").alias("_c")), sides, key, "left")
    level = (F.col("_c") * F.coalesce("_p", F.lit(0.0))).alias("_v")
    grid = joined.groupBy(SLIDE, "gx", "gy").agg(F.count(F.lit(1)).alias("coverage"), F.avg(level).alias("_v"))
    grid = cut(grid, "attention-map")
    total = grid.groupBy(SLIDE).agg(F.sum("_v").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("_v") / F.col("_total")).otherwise(F.lit(0.0))
    return attach_by_key(grid, total, [SLIDE], stored=True).select(SLIDE, "gx", "gy", "coverage", share.alias("weight"))
