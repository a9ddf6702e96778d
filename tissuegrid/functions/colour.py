"""Colour spaces of pixel columns: RGB to LAB, HSV and HED and back.

Built-in arithmetic only, so that conversion stays inside the scan's code. LAB and HSV
come on byte scales (L, S, V and a, b shifted into 0..255; H in 0..180), unrounded, as
stain templates give their means and deviations on these scales. White point D65.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ over the D65 white point, its inverse, and the white point: fixed values
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
# stain vectors of haematoxylin, eosin and DAB, by Ruifrok and Johnston: fixed values
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
FLOOR = 1e-6

Triple = tuple[Column, Column, Column]


def _inverse(m) -> tuple:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


UNMIX = _inverse(STAINS)


def _times(v: Triple, m) -> Triple:
    """Row vector times matrix."""
    return tuple(v[0] * m[0][j] + v[1] * m[1][j] + v[2] * m[2][j] for j in range(3))


def _unit(v: Triple) -> Triple:
    return tuple(c.cast("double") / 255.0 for c in v)


def _bytes(v: Triple) -> Triple:
    return tuple(F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))) * 255.0 for c in v)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Triple:
    linear = tuple(F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92) for c in _unit((r, g, b)))
    xyz = tuple(sum(linear[j] * row[j] for j in range(3)) / w for row, w in zip(XYZ, WHITE))
    x, y, z = (F.when(c > 0.008856, F.pow(c, 1 / 3)).otherwise(7.787 * c + 16 / 116) for c in xyz)
    light = F.when(xyz[1] > 0.008856, 116 * y - 16).otherwise(903.3 * xyz[1])
    return light * 255 / 100, 500 * (x - y) + 128, 200 * (y - z) + 128


def lab_to_rgb(light: Column, a: Column, b: Column) -> Triple:
    y = (light * 100 / 255 + 16) / 116
    root = (y + (a - 128) / 500, y, y - (b - 128) / 200)
    xyz = tuple(F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787) * w for t, w in zip(root, WHITE))
    linear = (sum(xyz[j] * row[j] for j in range(3)) for row in RGB)
    return _bytes(
        tuple(F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c) for c in linear)
    )


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Triple:
    red, green, blue = (c.cast("double") for c in (r, g, b))
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - low
    turn = (
        F.when(span == 0, 0.0)
        .when(top == red, (green - blue) / span)
        .when(top == green, 2 + (blue - red) / span)
        .otherwise(4 + (red - green) / span)
    )
    hue = F.when(turn < 0, turn + 6).otherwise(turn) * 30
    return hue, F.when(top > 0, span / top * 255).otherwise(0.0), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Triple:
    sector, share = F.pmod(h / 30, F.lit(6.0)), s / 255

    def part(shift: int) -> Column:
        # distance from the sector in which the colour is full
        k = F.pmod(sector + shift, F.lit(6.0))
        return v - v * share * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(5), part(3), part(1)


def rgb_to_hed(r: Column, g: Column, b: Column) -> Triple:
    light = tuple(F.log(F.greatest(c, F.lit(FLOOR))) / F.log(F.lit(FLOOR)) for c in _unit((r, g, b)))
    return tuple(F.greatest(c, F.lit(0.0)) for c in _times(light, UNMIX))


def hed_to_rgb(h: Column, e: Column, d: Column) -> Triple:
    mixed = _times((h, e, d), STAINS)
    return _bytes(tuple(F.exp(c * F.log(F.lit(FLOOR))) for c in mixed))


SPACES: dict[str, tuple[Callable[..., Triple], Callable[..., Triple]]] = {
    "LAB": (rgb_to_lab, lab_to_rgb),
    "HSV": (rgb_to_hsv, hsv_to_rgb),
    "HED": (rgb_to_hed, hed_to_rgb),
}
