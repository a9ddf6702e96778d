"""Column expressions without state."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Round half to even, as a bigint."""
    return F.rint(value).cast("bigint")


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b).cast("bigint")


def magnification(app_mag: str, objective_power: str | None = None, default: float = 20.0) -> Column:
    """First value that parses as a number: app_mag with a decimal comma, objective power, default."""
    tries = [F.replace(F.col(app_mag), F.lit(","), F.lit(".")).try_cast("double")]
    if objective_power:
        tries.append(F.col(objective_power).try_cast("double"))
    return F.coalesce(*tries, F.lit(float(default)))


def sampling_size(tile_size, mag: Column, reference_mag: float) -> Column:
    """Tile side at level 0 for a slide of magnification ``mag``."""
    size = F.lit(float(tile_size)) if not isinstance(tile_size, Column) else tile_size.cast("double")
    return half_even(size * (mag / F.lit(float(reference_mag)))).cast("int")


def clamp_window(x: Column, y: Column, size: Column, w: Column, h: Column) -> Column:
    """Struct (x, y, size) moved inside the slide.

    Both coordinates are clipped when either one is outside, none otherwise.
    """
    s = F.greatest(F.lit(16), F.least(size, w, h)).cast("bigint")
    outside = ~((x >= 0) & (x < w) & (y >= 0) & (y < h))
    cx = F.least(F.greatest(x, F.lit(0)), w - s)
    cy = F.least(F.greatest(y, F.lit(0)), h - s)
    return F.struct(
        F.when(outside, cx).otherwise(x).cast("bigint").alias("x"),
        F.when(outside, cy).otherwise(y).cast("bigint").alias("y"),
        s.alias("size"),
    )


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 0..1 channels."""
    # Fixed weights of the luminance formula.
    return F.lit(0.2125) * r + F.lit(0.7154) * g + F.lit(0.0721) * b


def soft_label(score: Column, beta: float = 1.5) -> Column:
    """Risk score to a 0..1 label by two power curves that meet at the cut-off.

    Scores outside the known range give NaN (a negative base).
    """
    # Cut-off, smallest and largest score.
    cutoff, lowest, highest = 0.7169, -2.009, 2.744
    below = F.lit(0.5) * F.pow((score - lowest) / (cutoff - lowest), F.lit(beta))
    above = 1 - F.lit(0.5) * F.pow(1 - (score - cutoff) / (highest - cutoff), F.lit(beta))
    return F.when(score <= cutoff, below).otherwise(above)


def patient_from_barcode(barcode: str) -> Column:
    return F.substring_index(F.col(barcode), "-", 3)


def active(features: str | Column) -> Column:
    """True when any element differs from zero."""
    f = F.col(features) if isinstance(features, str) else features
    return F.exists(f, lambda x: x != 0)


def positional_encoding(row: Column, col: Column, channels: int) -> Column:
    """Interleaved sine and cosine of row then of column, cut to ``channels`` values."""
    half = 2 * math.ceil(channels / 4)
    freqs = F.array(*[F.lit(float(10000 ** (-i / half))) for i in range(0, half, 2)])

    def axis(pos: Column) -> Column:
        return F.flatten(F.transform(freqs, lambda f: F.array(F.sin(pos * f), F.cos(pos * f))))

    return F.slice(F.concat(axis(row.cast("double")), axis(col.cast("double"))), 1, channels)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erf(x: Column) -> Column:
    """Error function by the five-term rational formula (absolute error below 1.5e-7)."""
    # Fixed coefficients, Abramowitz and Stegun 7.1.26.
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + F.lit(p) * F.abs(x))
    tail = ((((F.lit(a5) * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.signum(x) * (1 - tail)


def gelu(x: Column, approximate: str = "none") -> Column:
    """Gaussian error linear unit, by the error function or its tanh approximation."""
    if approximate == "tanh":
        inner = F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + F.lit(0.044715) * x * x * x))
    else:
        inner = erf(x / F.lit(math.sqrt(2)))
    return F.lit(0.5) * x * (1 + inner)


def softmax(scores: str | Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    s = F.col(scores) if isinstance(scores, str) else scores
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Zero-based index of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
