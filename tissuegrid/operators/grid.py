"""Sampling grids, coverage and heat maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import floor_div, half_even
from ..functions.skew import attach_by_key
from ..session import cut
from .components import whole_blocks
from .words import SLIDE, WORD, bit, bit_range

# lines and columns of a block of running sums, below the byte that says that a place is not in it
SUM_BLOCK = (64, 128)
_ELSEWHERE = 255


def mask_bbox(mask: DataFrame) -> DataFrame:
    """Inclusive foreground box per slide; slides without foreground give no row."""
    return (
        mask.where(F.col("v") > 0)
        .groupBy(SLIDE)
        .agg(
            F.min("r").alias("row_min"),
            F.max("r").alias("row_max"),
            F.min("c").alias("col_min"),
            F.max("c").alias("col_max"),
        )
    )


def words_bbox(words: DataFrame) -> DataFrame:
    """``mask_bbox`` on packed words: first and last set bit by bit counts."""
    bits = F.col("bits")
    # spread the lowest set bit up and the highest one down, then count
    up = down = bits
    for s in (1, 2, 4, 8, 16, 32):
        up = up.bitwiseOR(F.shiftleft(up, s))
        down = down.bitwiseOR(F.shiftrightunsigned(down, s))
    low, high = F.lit(WORD) - F.bit_count(up), F.bit_count(down) - 1
    return (
        words.where(bits != 0)
        .groupBy(SLIDE)
        .agg(
            F.min("r").cast("int").alias("row_min"),
            F.max("r").cast("int").alias("row_max"),
            F.min(F.col("wi") * WORD + low).cast("int").alias("col_min"),
            F.max(F.col("wi") * WORD + high).cast("int").alias("col_max"),
        )
    )


def scale_bbox(bbox: DataFrame, scale: Column) -> DataFrame:
    """Mask box to level-0 pixels. The scale comes from the heights and serves both axes."""
    names = ["row_min", "row_max", "col_min", "col_max"]
    return bbox.select(
        *[c for c in bbox.columns if c not in names], *[half_even(F.col(n) * scale).alias(n) for n in names]
    )


def fill_ratio(mask: DataFrame, floor: float = 0.15) -> DataFrame:
    """Foreground share and whether it is too low to trust the mask."""
    return (
        mask.groupBy(SLIDE)
        .agg(F.avg(F.col("v").cast("double")).alias("fill"))
        .withColumn("needs_fallback", F.col("fill") < F.lit(floor))
    )


def grid_points(bbox: DataFrame, size: Column, overlap: float) -> DataFrame:
    """Regular grid over each box, far edge excluded: ``(…, x, y)`` in row-major order of generation."""
    if overlap >= 1:
        raise ValueError("overlap must be below 1")
    step = half_even(size * F.lit(1.0 - overlap))

    def points(lo: str, hi: str) -> Column:
        last = F.col(hi) - 1
        some = F.sequence(F.col(lo).cast("bigint"), F.greatest(last, F.col(lo)).cast("bigint"), F.col("_step"))
        return F.when(F.col(hi) > F.col(lo), some).otherwise(F.array().cast("array<bigint>"))

    names = ["row_min", "row_max", "col_min", "col_max"]
    rest = [c for c in bbox.columns if c not in names]
    # a box is a few bytes before it is hundreds of points, and small boxes of many slides would be one task
    parts = int(bbox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = bbox.repartition(parts, F.xxhash64(*rest, *names))
    stepped = spread.withColumn("_step", step).withColumn(
        "_step",
        F.when(F.col("_step") > 0, F.col("_step")).otherwise(F.raise_error(F.lit("grid step is not positive")).cast("bigint")),
    )
    return (
        stepped.select(*rest, F.explode(points("row_min", "row_max")).alias("y"), "col_min", "col_max", "_step")
        .select(*rest, F.explode(points("col_min", "col_max")).alias("x"), "y")
    )


def coo_coords(coords: DataFrame, size: Column, overlap: float) -> DataFrame:
    """Grid index of every coordinate: distance from the slide's smallest, by whole steps."""
    low = coords.groupBy(SLIDE).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    step = half_even(size * F.lit(1.0 - overlap))
    return (
        attach_by_key(coords, low, [SLIDE], covers=True)
        .withColumn("gx", floor_div(F.col("x") - F.col("_x0"), step).cast("int"))
        .withColumn("gy", floor_div(F.col("y") - F.col("_y0"), step).cast("int"))
        .drop("_x0", "_y0")
    )


def minmax_255(df: DataFrame, value: str, out: str = "u8", unit: bool = False) -> DataFrame:
    """Stretch values of each image to 0..255 (truncated), or to 0..1 without the epsilon."""
    span = df.groupBy(SLIDE).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    if unit:
        scaled = (v - lo) / F.nullif(hi - lo, F.lit(0))
    else:
        scaled = F.floor((v - lo) / (F.lit(1e-6) + (hi - lo)) * 255.0).cast("int")
    return attach_by_key(df, span, [SLIDE], covers=True).withColumn(out, scaled).drop("_lo", "_hi")


def integral_image(mask: DataFrame) -> DataFrame:
    """Inclusive 2-D running sum ``s``. Windows span one mask line or column."""
    across = Window.partitionBy(SLIDE, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(SLIDE, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return (
        mask.withColumn("_line", F.sum(F.col("v").cast("bigint")).over(across))
        .withColumn("s", F.sum("_line").over(down))
        .select(SLIDE, "r", "c", "s")
    )


def _sum_blocks(sat: DataFrame) -> DataFrame:
    """Running sums ``(slide_id, _rb, _cb, _top, _left, _cols, _sums)``, one row a block of ``SUM_BLOCK`` pixels.

    ``_sums`` holds the lines of the smallest box around the block's pixels one after the other, null where there is no pixel;
    ``_top`` and ``_left`` say where in the block it begins, counted as ``_block_of`` does. The window moves pixels only if they are not yet dealt by slide or block.
    """
    block = [SLIDE, "_rb", "_cb"]
    row, col = (F.col(x).cast("int") for x in ("r", "c"))
    pixels = sat.select(SLIDE, *_block_of("r", "c"), row.alias("r"), col.alias("c"), F.col("s").cast("bigint").alias("s"))
    pixels = pixels.where(F.col(SLIDE).isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull())
    numbered = pixels.withColumn("nth", F.row_number().over(Window.partitionBy(*block).orderBy("r", "c")))
    names = ["_top", "_left", "_cols"]
    schema = T.StructType([pixels.schema[c] for c in block] + [T.StructField(n, T.IntegerType()) for n in names])
    schema = schema.add("_sums", T.ArrayType(T.LongType()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches):
            first, n = starts[:-1], np.diff(starts)
            r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
            top, left = np.minimum.reduceat(r, first), np.minimum.reduceat(c, first)
            cols = np.maximum.reduceat(c, first) - left + 1
            size = (np.maximum.reduceat(r, first) - top + 1) * cols
            ends = np.cumsum(size)
            at = (r - np.repeat(top, n)) * np.repeat(cols, n) + c - np.repeat(left, n) + np.repeat(ends - size, n)
            sums, none = np.zeros(ends[-1], np.int64), np.ones(ends[-1], bool)
            sums[at], none[at] = table.column("s").to_numpy(), False
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(sums, mask=none))
            keys = [pa.concat_arrays(table.column(x).take(pa.array(first)).chunks) for x in block]
            top, left = (low + 1 - k.to_numpy().astype(np.int64) * side for low, k, side in zip((top, left), keys[1:], SUM_BLOCK, strict=True))
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, pa.int32()) for x in (top, left, cols)], lists], names=schema.names)

    return numbered.mapInArrow(gather, schema)


def _block_of(row: str, col: str) -> list[Column]:
    """Block ``_rb, _cb`` of a pixel; the places just before the first line and column are those of the first block."""
    lines, columns = SUM_BLOCK
    place = lambda at, side, name: floor_div(F.col(at) + 1, F.lit(side)).cast("int").alias(name)
    return [place(row, lines, "_rb"), place(col, columns, "_cb")]


def coverage_lookup(boxes: DataFrame, sat: DataFrame, key: str = "box_id") -> DataFrame:
    """Foreground pixels ``covered`` in each half-open box from four corners of the running sum.

    Running sums are gathered in blocks of bounded size and a box moves once to each block that holds one of its corners, which for
    most is one. It carries a byte for each of its ends: the place in that block, or ``_ELSEWHERE``. Boxes and running
    sums are as many as pixels, whatever the planner makes of them, so neither is broadcast.
    """
    ends = [(F.col(x) - 1).alias(f"_{x}") for x in ("r0", "r1", "c0", "c1")]
    corners = [("_r1", "_c1", 1), ("_r0", "_c1", -1), ("_r1", "_c0", -1), ("_r0", "_c0", 1)]
    places = F.array_distinct(F.array(*[F.struct(*_block_of(r, c)) for r, c, _ in corners]))
    asked = boxes.select(SLIDE, key, *ends).select("*", F.inline(places))
    names = ["_r0", "_r1", "_c0", "_c1"]
    in_block = []
    for name, block, side in zip(names, ("_rb", "_rb", "_cb", "_cb"), np.repeat(SUM_BLOCK, 2).tolist(), strict=True):
        at = F.col(name) + 1 - F.col(block).cast("bigint") * side
        in_block.append(F.when((at >= 0) & (at < side), at).otherwise(_ELSEWHERE).cast("bigint"))
    packed = sum((F.shiftleft(at, 8 * n) for n, at in enumerate(in_block[1:], 1)), in_block[0])
    asked = asked.select(SLIDE, key, "_rb", "_cb", packed.alias("_ends"))

    def found(r: str, c: str) -> Column:
        row, col = (F.shiftright("_ends", 8 * names.index(x)).bitwiseAND(F.lit(255)).cast("int") for x in (r, c))
        y, x = row - F.col("_top"), col - F.col("_left")
        inside = (row != _ELSEWHERE) & (col != _ELSEWHERE) & (y >= 0) & (x >= 0) & (x < F.col("_cols"))
        return F.coalesce(F.when(inside, F.get("_sums", y * F.col("_cols") + x)), F.lit(0))

    covered = sum((found(r, c) * sign for r, c, sign in corners), F.lit(0).cast("bigint"))
    met = asked.join(_sum_blocks(sat).hint("merge"), [SLIDE, "_rb", "_cb"], "left").select(SLIDE, key, covered.alias("_n"))
    return met.groupBy(SLIDE, key).agg(F.sum("_n").alias("covered"))


def coverage_window(scale: Column, size: Column) -> tuple[Column, Column]:
    """``(factor, side)``: how much finer than the mask the coverage test looks, and its window.

    The mask is refined by 4 until the window measures at least 8 of its pixels.
    """
    side_at = lambda f: half_even(size.cast("double") / (scale / f))
    # a side of 7.5 rounds to 8; the steps around the exact logarithm absorb its rounding
    steps = F.floor(F.log(F.lit(7.5) * scale / size.cast("double")) / F.log(F.lit(4.0))).cast("int")
    near = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.pow(F.lit(4.0), F.greatest(steps + n, F.lit(0))))
    factor = F.filter(near, lambda f: side_at(f) >= 8)[0]
    return factor.cast("bigint"), side_at(factor)


def coverage_counts(coords: DataFrame, words: DataFrame) -> DataFrame:
    """Refined foreground pixels under each tile window.

    ``coords`` carries ``x, y, scale, size, h, w``. A refined pixel is a replica of
    the mask pixel above it, so a window is a weighted count of mask pixels: each
    tile asks for the few words it overlaps, by equi-join on slide, line and word. Both
    sides grow with the slides and are made by explodes, which the planner underrates: neither is broadcast.
    """
    factor, side = coverage_window(F.col("scale"), F.col("size"))

    def start(at: str, extent: str) -> Column:
        fine = F.floor(F.col(at) / (F.col("scale") / F.col("_f"))).cast("bigint")
        return F.greatest(F.least(F.greatest(fine, F.lit(0)), F.col(extent) * F.col("_f") - F.col("_side")), F.lit(0))

    placed = (
        coords.select(SLIDE, "x", "y", "scale", "size", "h", "w")
        .distinct()
        .withColumn("_f", factor)
        .withColumn("_side", side)
        .withColumn("_r", start("y", "h"))
        .withColumn("_c", start("x", "w"))
    )
    f, end_r, end_c = F.col("_f"), F.col("_r") + F.col("_side"), F.col("_c") + F.col("_side")
    asked = (
        placed.withColumn("r", F.explode(F.sequence(floor_div(F.col("_r"), f), floor_div(end_r - 1, f))))
        .withColumn("_first", floor_div(F.col("_c"), f))
        .withColumn("_last", floor_div(end_c - 1, f))
        .withColumn("wi", F.explode(F.sequence(floor_div(F.col("_first"), WORD), floor_div(F.col("_last"), WORD))))
        .withColumn("r", F.col("r").cast("int"))
        .withColumn("wi", F.col("wi").cast("int"))
    )
    line_weight = F.least((F.col("r") + 1) * f, end_r) - F.greatest(F.col("r") * f, F.col("_r"))
    lo = F.greatest(F.col("_first") - F.col("wi") * WORD, F.lit(0))
    hi = F.least(F.col("_last") - F.col("wi") * WORD, F.lit(63))

    def edge(column: Column) -> Column:
        at = column - F.col("wi") * WORD
        here = (at >= 0) & (at < WORD)
        spot = bit(F.when(here, at).otherwise(0))
        return F.when(here & (F.col("bits").bitwiseAND(spot) != 0), 1).otherwise(0)

    in_word = (
        F.bit_count(F.col("bits").bitwiseAND(bit_range(lo, hi))) * f
        - edge(F.col("_first")) * (F.col("_c") - F.col("_first") * f)
        - edge(F.col("_last")) * ((F.col("_last") + 1) * f - end_c)
    )
    return (
        asked.join(words.select(SLIDE, "r", "wi", "bits").hint("merge"), [SLIDE, "r", "wi"])
        .groupBy(SLIDE, "x", "y")
        .agg(F.sum(line_weight * in_word).alias("covered"), F.first("_side").alias("side"))
    )


def coverage_filter(coords: DataFrame, words: DataFrame, p: float) -> DataFrame:
    """Tiles whose window is foreground to a share of at least ``p``, with the count as ``covered``."""
    kept = coverage_counts(coords, words).where(
        F.col("covered") / (F.col("side") * F.col("side")).cast("double") >= F.lit(p)
    )
    return coords.join(kept.select(SLIDE, "x", "y", "covered").hint("merge"), [SLIDE, "x", "y"])


def heatmap(coords: DataFrame, shape: DataFrame) -> DataFrame:
    """Tiles over every mask pixel, zero included.

    ``coords`` has ``x, y, scale, size``; ``shape`` has ``(slide_id, h, w)``. Tiles are
    counted per grid start. Of a line of pixels only the columns where the count changes meet, at most two for a start that
    crosses it; pixels are made from them last and never move.
    """
    shape = cut(shape, "shape")
    side = half_even(F.col("size").cast("double") / F.col("scale"))
    starts = (
        coords.groupBy(
            SLIDE,
            half_even(F.col("y") / F.col("scale")).alias("_r"),
            half_even(F.col("x") / F.col("scale")).alias("_c"),
            side.alias("_side"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    starts = attach_by_key(starts, shape, [SLIDE], stored=True)
    top, left = F.greatest(F.col("_r"), F.lit(0)), F.greatest(F.col("_c"), F.lit(0))
    end = F.least(F.col("_c") + F.col("_side"), F.col("w"))
    last = F.least(F.col("_r") + F.col("_side"), F.col("h")) - 1
    lines = starts.where((top <= last) & (left < end)).select(
        SLIDE, "w", "n", left.alias("_from"), end.alias("_to"), F.explode(F.sequence(top, last)).alias("r")
    )
    steps = F.array(F.struct(F.col("_from").alias("c"), F.col("n").alias("d")), F.struct(F.col("_to").alias("c"), (-F.col("n")).alias("d")))
    changes = lines.select(SLIDE, "w", "r", F.inline(steps)).where(F.col("c") < F.col("w"))
    zero = F.lit(0).cast("bigint")
    blank = shape.where((F.col("h") > 0) & (F.col("w") > 0)).select(SLIDE, "w", F.explode(F.sequence(zero, F.col("h") - 1)).alias("r"))
    # few rows become many pixels behind this shuffle, so that its partitions are not to be merged
    parts = int(shape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = changes.unionByName(blank.select("*", zero.alias("c"), zero.alias("d"))).repartition(parts, SLIDE, "r")
    line = Window.partitionBy(SLIDE, "r").orderBy("c")
    spans = dealt.select(
        SLIDE,
        F.col("r").cast("int").alias("r"),
        "c",
        F.coalesce(F.lead("c").over(line), F.col("w")).alias("_end"),
        F.sum("d").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
    ).where(F.col("c") < F.col("_end"))
    pixels = F.sequence(F.col("c").cast("int"), (F.col("_end") - 1).cast("int"))
    return spans.select(SLIDE, "r", F.explode(pixels).alias("c"), "n")
