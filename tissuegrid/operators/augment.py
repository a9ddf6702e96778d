"""Seeded augmentation of tile grids, bag by bag.

Every draw is a pure function of the bag key and the seed, so a retried task or a
second run makes the same choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fast_normal01, normal01, uniform01
from ..functions.ranking import hash_order
from ..functions.scalars import active
from .pooling import vector_sum


def apply_draw(p: float, seed: int, bag: Sequence[str], per: str = "bag") -> Column:
    """Bernoulli(p): one draw per bag, or a single one for the batch."""
    if p <= 0:
        return F.lit(False)
    u = uniform01(seed, *bag) if per == "bag" else uniform01(seed, F.lit("batch"))
    return u < F.lit(float(p))


def random_apply(df: DataFrame, p: float, seed: int, bag: Sequence[str], per: str = "bag", out: str = "applied") -> DataFrame:
    return df.withColumn(out, apply_draw(p, seed, bag, per))


def flip(df: DataFrame, axis: str, p: float, seed: int, bag: Sequence[str], row="row", col="col", h="h", w="w") -> DataFrame:
    """Mirror columns ('h') or rows ('v') of a bag with probability p."""
    if axis not in ("h", "v"):
        raise ValueError("axis must be 'h' or 'v'")
    name, extent = (col, w) if axis == "h" else (row, h)
    mirrored = F.col(extent) - 1 - F.col(name)
    kind = df.schema[name].dataType
    return df.withColumn(name, F.when(apply_draw(p, f"{seed}{axis}", bag), mirrored).otherwise(F.col(name)).cast(kind))


def rot90(df: DataFrame, k: Column, row="row", col="col", h="h", w="w") -> DataFrame:
    """Turn counter-clockwise k times by 90 degrees; odd turns swap the extents."""
    r, c, hh, ww = F.col(row), F.col(col), F.col(h), F.col(w)

    def pick(*by_turn: Column) -> Column:
        return F.when(k == 1, by_turn[1]).when(k == 2, by_turn[2]).when(k == 3, by_turn[3]).otherwise(by_turn[0])

    moved = {
        row: pick(r, ww - 1 - c, hh - 1 - r, c),
        col: pick(c, r, ww - 1 - c, hh - 1 - r),
        h: pick(hh, ww, hh, ww),
        w: pick(ww, hh, ww, hh),
    }
    return df.withColumns(moved)


def random_rot90(df: DataFrame, seed: int, bag: Sequence[str], **names) -> DataFrame:
    """Zero to three turns, drawn per bag."""
    return rot90(df, F.floor(uniform01(f"{seed}rot", *bag) * 4).cast("int"), **names)


def add_noise(
    df: DataFrame, sigma: float, seed: int, ids: Sequence[str], features: str = "features", masked: bool = True, fast: bool = False
) -> DataFrame:
    """Gaussian noise on every element, on active cells only when ``masked``.

    Draws come from md5 digests of ids, element number and seed, which any system can
    repeat; ``fast`` takes 64-bit hashes instead, several times cheaper for long vectors.
    """
    if sigma <= 0:
        return df
    keys = [F.col(i) for i in ids]
    noisy = F.transform(
        F.col(features),
        lambda x, i: x + F.lit(float(sigma)) * (fast_normal01(seed, *keys, i) if fast else normal01(seed, *keys, i)),
    ).cast(df.schema[features].dataType)
    return df.withColumn(features, F.when(active(features), noisy).otherwise(F.col(features)) if masked else noisy)


def dampen_blocks(
    df: DataFrame,
    block: int,
    frac: float,
    seed: int,
    bag: str,
    row="row",
    col="col",
    h="h",
    w="w",
    features: str = "features",
    background: DataFrame | None = None,
) -> DataFrame:
    """Overwrite random whole blocks of a bag by the background vector or by their own mean.

    The number of blocks is drawn from 0..int(blocks * frac), the kind of fill once
    per bag. A block mean counts missing cells as zero vectors. Only cells present
    in the table are written, as blank cells stay blank.
    """
    bags = df.groupBy(bag).agg(
        F.max(F.floor(F.col(h) / block)).alias("_bh"), F.max(F.floor(F.col(w) / block)).alias("_bw")
    )
    most = F.floor(F.col("_bh") * F.col("_bw") * F.lit(float(frac)))
    drawn = bags.select(
        bag,
        "_bh",
        "_bw",
        F.floor(uniform01(f"{seed}n", bag) * (most + 1)).alias("_m"),
        (uniform01(f"{seed}k", bag) < 0.5).alias("_to_background"),
    ).where(F.col("_m") > 0)
    blocks = drawn.select(
        bag, "_m", "_to_background", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bh") * F.col("_bw") - 1)).alias("_b"), "_bw"
    )
    chosen = (
        hash_order(blocks, [bag, "_b"], seed, "_rn", by=[bag])
        .where(F.col("_rn") <= F.col("_m"))
        .select(
            bag, F.floor(F.col("_b") / F.col("_bw")).alias("_br"), F.pmod("_b", "_bw").alias("_bc"), "_to_background"
        )
    )
    keyed = df.withColumn("_br", F.floor(F.col(row) / block)).withColumn("_bc", F.floor(F.col(col) / block))
    key = [bag, "_br", "_bc"]
    # only cells of chosen blocks move; all others pass with a marker
    picked = keyed.join(chosen, key)
    means = (
        picked.where(~F.col("_to_background"))
        .groupBy(*key)
        .agg(F.transform(vector_sum(features), lambda x: x / (block * block)).alias("_mean"))
    )
    kind = df.schema[features].dataType
    if background is None:
        bg = F.transform(features, lambda x: x * 0)
    else:
        bg = background.select("mean").scalar().cast(kind)
    value = F.when(F.col("_to_background"), bg).otherwise(F.col("_mean").cast(kind))
    changed = picked.join(means, key, "left").withColumn("dampened", F.lit(True)).withColumn(features, value)
    same = keyed.join(chosen.select(*key), key, "left_anti").withColumn("dampened", F.lit(False))
    columns = [*df.columns, "dampened"]
    return same.select(*columns).unionByName(changed.select(*columns))


def random_crop(df: DataFrame, factor: float, seed: int, bag: Sequence[str], row="r", col="c", h="h", w="w") -> DataFrame:
    """Square crop: side drawn from [int(factor * w), w), corner from what is left; positions restart at 0.

    Draws are made once for each bag and size and join back.
    """
    names = ["_side", "_left", "_top"]
    low = F.floor(F.lit(float(factor)) * F.col(w))
    side = low + F.floor(uniform01(f"{seed}s", *bag) * (F.col(w) - low))
    left = F.floor(uniform01(f"{seed}x", *bag) * F.greatest(F.col(w) - F.col("_side"), F.lit(1)))
    top = F.floor(uniform01(f"{seed}y", *bag) * F.greatest(F.col(h) - F.col("_side"), F.lit(1)))
    bags = df.select(*bag, h, w).distinct()
    drawn = bags.withColumn("_side", side).withColumn("_left", left).withColumn("_top", top)
    keys = [*bag, h, w]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    # an outer join, as pixels pass for fewer than they are and must not be broadcast
    placed = df.join(drawn.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names), same, "left").select(*df.columns, *names)
    # every row has its draws; a default keeps the filter from asking for them
    extent, from_c, from_r = (F.coalesce(n, F.lit(0)) for n in names)
    r, c = F.col(row) - from_r, F.col(col) - from_c
    return (
        placed.where((r >= 0) & (r < extent) & (c >= 0) & (c < extent))
        .withColumn(row, r.cast(df.schema[row].dataType))
        .withColumn(col, c.cast(df.schema[col].dataType))
        .drop(*names)
    )
