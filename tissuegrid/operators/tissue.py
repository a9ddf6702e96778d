"""Tissue by a smoothed histogram and a mixture of two normal distributions.

A slide's gray values are counted in 256 bins, which is all that leaves the pixels. A
Gaussian kernel smooths the counts; a mixture of a dark part (tissue) and a bright one
(background) is fitted to them by expectation maximisation, slide by slide until its means
settle. A slide's histogram is one short array, so the rounds of a fit need no shuffle. Slides are spread
over tasks and fitted many at a time; one that settles early does no further work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import attach_by_key
from ..session import cut
from .words import SLIDE

BINS = 256
# a part is never narrower than one bin, nor empty
LEAST_VAR, LEAST_SHARE = 1.0, 1e-6
# slides that one step of a task fits at once
FIT_SLIDES = 256


def _bin(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int"))


def _counts(pixels: DataFrame, value: str) -> DataFrame:
    return pixels.where(F.col(value).isNotNull()).groupBy(SLIDE, _bin(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _filled(counts: DataFrame) -> DataFrame:
    """``(slide_id, ns)``: the counts of all 256 bins as one array."""
    whole = counts.groupBy(SLIDE).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # 256 entries at most
    at = F.sequence(F.lit(0), F.lit(BINS - 1))
    return whole.select(SLIDE, F.transform(at, lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("bigint")).alias("ns"))


def smoothed_histogram(pixels: DataFrame, value: str = "gray", bandwidth: float = 2.0) -> DataFrame:
    """``(slide_id, bin, n, density)``: all 256 bins of every slide, counts and their kernel sums.

    ``value`` runs from 0 to 255; anything beyond counts in the last bin on its side, null
    not at all. The kernel reaches four bandwidths and is not renormalised at the ends.
    """
    filled = _filled(_counts(pixels, value))
    at = F.sequence(F.lit(0), F.lit(BINS - 1))
    reach = math.ceil(4 * bandwidth)

    def kernel(b: Column) -> Column:
        near = F.sequence(F.greatest(b - reach, F.lit(0)), F.least(b + reach, F.lit(BINS - 1)))
        weight = lambda j: F.exp(-0.5 * F.pow((j - b) / F.lit(float(bandwidth)), F.lit(2.0)))
        return F.aggregate(near, F.lit(0.0), lambda s, j: s + F.get("ns", j) * weight(j))

    both = filled.select(SLIDE, F.arrays_zip(at.alias("bin"), F.col("ns").alias("n"), F.transform(at, kernel).alias("density")).alias("z"))
    return both.select(SLIDE, F.inline("z"))


def _log_odds(b: Column, p: Column) -> Column:
    """Log odds of tissue against background at bin ``b``."""

    def part(mean: Column, var: Column) -> Column:
        return -0.5 * F.log(var) - (b - mean) * (b - mean) / (2 * var)

    return F.log(p["share"]) - F.log(1 - p["share"]) + part(p["dark"], p["dark_var"]) - part(p["bright"], p["bright_var"])


def tissue_share(b: Column, p: Column) -> Column:
    """Probability that a pixel of bin ``b`` is tissue under mixture ``p``."""
    return 1 / (1 + F.exp(-F.greatest(F.least(_log_odds(b, p), F.lit(700.0)), F.lit(-700.0))))


def _fit(counts: np.ndarray, bandwidth: float, max_rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures of histograms (slides, 256): five columns, rounds, settled, and whether there are two parts.

    All slides of a batch go through a round together; one that has settled takes no further part.
    """
    at = np.arange(BINS, dtype=float)
    away = np.abs(at[:, None] - at[None, :])
    density = counts @ np.where(away <= math.ceil(4 * bandwidth), np.exp(-0.5 * (away / bandwidth) ** 2), 0.0)
    powers = np.stack([np.ones(BINS), at, at * at], axis=1)
    n = len(counts)
    found, rounds, settled = np.full((n, 5), np.nan), np.zeros(n, np.int32), np.ones(n, bool)
    two = (counts > 0).sum(axis=1) > 1
    total = density @ powers

    def mixture(dark: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out = [dark[:, 0] / whole[:, 0]]
        for s in (dark, whole - dark):
            mean = s[:, 1] / s[:, 0]
            out += [mean, np.maximum(s[:, 2] / s[:, 0] - mean * mean, LEAST_VAR)]
        return np.stack(out, axis=1)

    now = np.flatnonzero(two)
    low = density[now] * (at <= (total[now, 1] / total[now, 0])[:, None])
    found[now], settled[now] = mixture(low @ powers, total[now]), False
    for k in range(1, max_rounds + 1):
        if not now.size:
            break
        share, m0, v0, m1, v1 = (c[:, None] for c in found[now].T)
        odds = np.log(share) - np.log(1 - share) - 0.5 * np.log(v0) - (at - m0) ** 2 / (2 * v0) + 0.5 * np.log(v1) + (at - m1) ** 2 / (2 * v1)
        dark = (density[now] / (1 + np.exp(-np.clip(odds, -700.0, 700.0)))) @ powers
        whole = total[now, 0]
        inside = (dark[:, 0] >= LEAST_SHARE * whole) & (dark[:, 0] <= (1 - LEAST_SHARE) * whole)
        settled[now[~inside]] = True
        now, moved = now[inside], mixture(dark[inside], total[now[inside]])
        settled[now] = (np.abs(moved[:, [1, 3]] - found[now][:, [1, 3]]) < tolerance).all(axis=1)
        found[now], rounds[now] = moved, k
        now = now[~settled[now]]
    return found, rounds, settled, two


def tissue_mixture(pixels: DataFrame, value: str = "gray", bandwidth: float = 2.0, max_rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """``(slide_id, share, dark, dark_var, bright, bright_var, rounds, settled)`` of every slide.

    ``share`` is the part of tissue, ``dark`` and ``bright`` are the means of tissue and background.
    The start splits the smoothed histogram at its mean. A slide is settled once both means move less
    than ``tolerance`` bins in a round, or a part is all but empty; ``max_rounds`` ends the others. A
    slide of one gray value has no two parts: all its columns but ``rounds`` and ``settled`` are null.
    """
    # a slide is one short array from here on, and fitting it is most of the work: it must not fall to a few tasks
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # (by a hash of the slide: a repartition by the key of the aggregate would be left out)
    rows = _filled(_counts(pixels, value)).repartition(parts, F.xxhash64(SLIDE))
    columns = ("share", "dark", "dark_var", "bright", "bright_var")
    schema = T.StructType([pixels.schema[SLIDE], *[T.StructField(c, T.DoubleType()) for c in columns]])
    schema = schema.add("rounds", T.IntegerType()).add("settled", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FIT_SLIDES):
                part = batch.slice(at, FIT_SLIDES)
                counts = part.column("ns").flatten().to_numpy().reshape(-1, BINS).astype(float)
                found, rounds, settled, two = _fit(counts, float(bandwidth), max_rounds, tolerance)
                made = [pa.array(c, pa.float64(), mask=~two) for c in found.T]
                yield pa.RecordBatch.from_arrays([part.column(SLIDE), *made, pa.array(rounds), pa.array(settled)], names=schema.names)

    return rows.mapInArrow(run, schema)


def tissue_threshold(mixture: DataFrame, min_prob: float = 0.05) -> DataFrame:
    """``(slide_id, threshold)``: the brightest bin, up to the background's mean, that is tissue with ``min_prob``; null if none."""
    p = F.struct("share", "dark", "dark_var", "bright", "bright_var")
    at = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: (b <= F.col("bright")) & (tissue_share(b, p) >= min_prob))
    return mixture.select(SLIDE, F.array_max(at).alias("threshold"))


def simple_mask(pixels: DataFrame, value: str = "gray", min_prob: float = 0.05, bandwidth: float = 2.0, **how) -> DataFrame:
    """``pixels`` with ``threshold`` and ``v``: 1 where the gray bin is at most the slide's threshold.

    Slides without two parts have a null threshold and no tissue; a pixel without a value is none.
    """
    limits = cut(tissue_threshold(tissue_mixture(pixels, value, bandwidth, **how), min_prob), "tissue-threshold")
    v = F.coalesce(_bin(F.col(value)) <= F.col("threshold"), F.lit(False)).cast("int")
    return attach_by_key(pixels, limits, [SLIDE], "left", stored=True).withColumn("v", v)
