"""Channel statistics and stain normalisation of pixel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import SPACES
from ..functions.hashing import laplace01, normal01, uniform01
from ..functions.skew import attach_by_key
from .augment import apply_draw

CHANNELS = ("ch0", "ch1", "ch2")


def channel_stats(pixels: DataFrame, key: str = "image_id", channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean and population standard deviation of every channel per image."""
    return pixels.groupBy(key).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in channels],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in channels],
    )


def virtual_template(
    images: DataFrame,
    template: dict[str, dict[str, float]],
    distribution: str = "normal",
    std_hyper: float = 0.0,
    seed: int = 42,
    key: str = "image_id",
) -> DataFrame:
    """Target mean and deviation drawn per image and channel.

    ``template`` maps a channel to avg_mean, avg_std, std_mean, std_std. Normal and
    Laplace draws scale the deviation by (1 + std_hyper); uniform spans three
    deviations either way.
    """

    def draw(mean: float, std: float, tag: str) -> Column:
        if distribution == "uniform":
            return F.lit(mean - 3 * std) + uniform01(f"{seed}{tag}", key) * F.lit(6.0 * std)
        if distribution not in ("normal", "laplace"):
            raise ValueError(f"unknown distribution {distribution!r}")
        unit = (normal01 if distribution == "normal" else laplace01)(f"{seed}{tag}", key)
        return F.lit(float(mean)) + unit * F.lit(std * (1 + std_hyper))

    made = []
    for c, t in template.items():
        made.append(draw(t["avg_mean"], t["avg_std"], f"{c}m").alias(f"{c}_target_mean"))
        made.append(draw(t["std_mean"], t["std_std"], f"{c}s").alias(f"{c}_target_std"))
    return images.select(key).distinct().select(key, *made)


def reinhard(
    pixels: DataFrame, targets: DataFrame, key: str = "image_id", channels: Sequence[str] = CHANNELS, to_bytes: bool = True
) -> DataFrame:
    """Move every channel to the target mean and deviation.

    The image deviation is bounded to 1e-4..255 first. ``to_bytes`` clips to 0..255
    and truncates, as for LAB and HSV images, after rounding to 7 decimals: where a value is a
    whole number, the order in which a mean was summed must not decide about a byte. Statistics are one
    row per image and join back by key, so an image with most of the pixels is not gathered anywhere.
    """
    stats = channel_stats(pixels, key, channels).join(targets, key)
    moved = {}
    for c in channels:
        spread = F.greatest(F.lit(1e-4), F.least(F.col(f"{c}_std"), F.lit(255.0)))
        value = (F.col(c) - F.col(f"{c}_mean")) * (F.col(f"{c}_target_std") / spread) + F.col(f"{c}_target_mean")
        moved[c] = F.floor(F.round(F.greatest(F.lit(0.0), F.least(value, F.lit(255.0))), 7)).cast("int") if to_bytes else value
    out = [moved[c].alias(c) if c in moved else F.col(c) for c in pixels.columns]
    return attach_by_key(pixels, stats, [key]).select(*out)


def convert(pixels: DataFrame, space: str, back: bool = False, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Channels from RGB bytes to ``space`` (LAB, HSV or HED), or back to RGB on the byte scale, unrounded."""
    if space not in SPACES:
        raise ValueError(f"unknown colour space {space!r}")
    moved = SPACES[space][back](*map(F.col, channels))
    return pixels.withColumns(dict(zip(channels, moved, strict=True)))


def stretch(pixels: DataFrame, key: str = "image_id", channels: Sequence[str] = CHANNELS) -> DataFrame:
    """All channels of an image scaled together to 0..255, least value to greatest; a flat image becomes 0."""
    span = pixels.groupBy(key).agg(
        F.least(*[F.min(c) for c in channels]).alias("_lo"), F.greatest(*[F.max(c) for c in channels]).alias("_hi")
    )
    wide = F.col("_hi") - F.col("_lo")
    scaled = {c: F.when(wide > 0, 255.0 * (F.col(c) - F.col("_lo")) / wide).otherwise(0.0) for c in channels}
    return attach_by_key(pixels, span, [key], covers=True).withColumns(scaled).drop("_lo", "_hi")


def normalize_stain(
    pixels: DataFrame, targets: DataFrame, space: str, key: str = "image_id", channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """RGB pixels whose statistics in ``space`` move to the targets; the result is RGB, unrounded.

    LAB and HSV values are clipped to bytes before the way back; HED has no byte scale,
    so the image is stretched afterwards.
    """
    moved = reinhard(convert(pixels, space, channels=channels), targets, key, channels, to_bytes=space != "HED")
    rgb = convert(moved, space, back=True, channels=channels)
    return stretch(rgb, key, channels) if space == "HED" else rgb


def augment_with_prob(
    pixels: DataFrame, targets: DataFrame, p: float, seed: int, key: str = "image_id", channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """Normalise an image with probability p, leave it as it is otherwise."""
    marked = pixels.withColumn("augmented", apply_draw(p, seed, [key]))
    changed = reinhard(marked.where("augmented"), targets, key, channels, to_bytes=False)
    return changed.unionByName(marked.where(~F.col("augmented")))


def background_tiles(pixels: DataFrame, value: str, key: str = "image_id") -> DataFrame:
    """Images that look like background: minimum below 255, most common value 255, mean above 240."""
    counts = pixels.groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counts.groupBy(key)
        .agg(
            F.min("_v").alias("min_value"),
            F.max(F.struct("_n", (-F.col("_v")).alias("_neg"))).alias("_top"),
            (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean_value"),
        )
        .select(key, "min_value", (-F.col("_top._neg")).alias("mode_value"), "mean_value")
        .where((F.col("min_value") < 255) & (F.col("mode_value") == 255) & (F.col("mean_value") > 240))
    )
