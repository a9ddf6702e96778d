"""Tiles to regions to overlapping patches, and back.

``tiles`` are ``(slide_id, gx, gy, features)``. The first grid axis is the slide's
x, so rows of a region are ``gx`` and columns ``gy``. Vectors stay out of every
step that only needs positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import bucketed_prefix_sum
from ..functions.scalars import active
from ..session import cut
from .components import region_boxes
from .pooling import vector_sum
from .words import SLIDE

CELL = [SLIDE, "gx", "gy"]
# widest vectors that are summed column by column
NARROW = 16

# The ten integers that place a patch.
PATCH_INFO = [
    "region_id",
    "region_min_row",
    "region_min_col",
    "region_max_row",
    "region_max_col",
    "patch_row_start",
    "patch_col_start",
    "patch_row_end",
    "patch_col_end",
]


def coalesce_cells(tiles: DataFrame, features: str = "features", width: int | None = None) -> DataFrame:
    """Tiles that share a cell are summed element by element; others pass through untouched.

    Cells seldom repeat, so those that do are found on positions alone and only their
    vectors go through an aggregate. Repeated cells grow with the tiles and their stored bytes say little
    of what they fill in memory, so they are sorted and merged, never broadcast; a hot cell's rows are split by
    the join, as the sum behind it is shuffled by a key of its own.

    ``width`` says how many numbers every vector has, few: they are then summed as plain columns, so that a tile moves
    once and what shares a cell is added before it moves.
    """
    if width is not None:
        return _sum_narrow(tiles, features, width)
    kind = tiles.schema[features].dataType
    repeated = cut(
        tiles.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*CELL), "repeated"
    ).hint("merge")
    single = tiles.join(repeated, CELL, "left_anti").select(*CELL, features)
    again = tiles.join(repeated, CELL, "left_semi").groupBy(F.struct(*CELL).alias("_cell"))
    summed = again.agg(vector_sum(features).cast(kind).alias(features)).select("_cell.*", features)
    return single.unionByName(summed)


def _sums(features: str, width: int) -> list[Column]:
    return [F.sum(F.get(features, F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(width)]


def _sum_narrow(tiles: DataFrame, features: str, width: int) -> DataFrame:
    """Cells with their summed vector, null where all are; a vector of another width is an error."""
    size = F.when(F.col(features).isNotNull(), F.size(features))
    summed = tiles.groupBy(*CELL).agg(F.min(size).alias("_lo"), F.max(size).alias("_hi"), *_sums(features, width))
    kind = tiles.schema[features].dataType
    vector = F.array(*[f"_s{i}" for i in range(width)]).cast(kind)
    odd = F.from_json(F.raise_error(F.lit("tiles have vectors of different width")).cast("string"), kind)
    one_width = (F.col("_lo") == width) & (F.col("_hi") == width)
    return summed.select(*CELL, F.when(one_width, vector).when(F.col("_lo").isNotNull(), odd).alias(features))


def narrow_width(tiles: DataFrame, features: str = "features") -> int | None:
    """The width of all vectors if it is one and at most ``NARROW``, else none."""
    size = F.when(F.col(features).isNotNull(), F.size(features))
    lo, hi = tiles.agg(F.min(size), F.max(size)).first()
    return hi if lo == hi and 0 < (hi or 0) <= NARROW else None


def active_cells(tiles: DataFrame, features: str = "features", unique: bool = False) -> DataFrame:
    """Positions whose (summed) vector has a non-zero element.

    ``unique`` promises one tile per cell and skips the summing.
    """
    width = None if unique else narrow_width(tiles, features)
    if width is None:
        merged = tiles if unique else coalesce_cells(tiles, features)
        return merged.where(active(features)).select(*CELL)
    some = F.lit(False)
    for i in range(width):
        some = some | (F.col(f"_s{i}") != 0)
    return tiles.groupBy(*CELL).agg(*_sums(features, width)).where(some).select(*CELL)


def grid_dims(tiles: DataFrame) -> DataFrame:
    """Grid height and width per slide: largest index + 1."""
    return tiles.groupBy(SLIDE).agg((F.max("gx") + 1).alias("height"), (F.max("gy") + 1).alias("width"))


def feature_dim(tiles: DataFrame, features: str = "features") -> DataFrame:
    """Vector width; fails when tiles disagree."""
    found = tiles.agg(F.min(F.size(features)).alias("lo"), F.max(F.size(features)).alias("hi"))
    return found.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo"))
        .otherwise(F.raise_error(F.lit("tiles have vectors of different width")).cast("int"))
        .alias("feature_dim")
    )


def _starts(side: Column, max_dim: int, overlap: float) -> Column:
    """Patch starts along one side; the last is pulled back to end at the border."""
    step = max(1, int(max_dim * (1 - overlap)))
    limit = F.greatest(side - max_dim, F.lit(0))
    return F.transform(F.sequence(F.lit(0), limit + step - 1, F.lit(step)), lambda s: F.least(s, limit))


def split_region(regions: DataFrame, max_dim: int, overlap: float) -> DataFrame:
    """Overlapping patches of each region with the ten placing integers and ``patch_id``.

    Patches are numbered per slide by region, row and column. Their number per
    region is known from its size, so only region totals take part in the running sum.
    """
    height, width = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    fits = (height <= max_dim) & (width <= max_dim)
    one = F.array(F.lit(0))
    sized = (
        regions.withColumn("_rs", F.when(fits, one).otherwise(_starts(height, max_dim, overlap)))
        .withColumn("_cs", F.when(fits, one).otherwise(_starts(width, max_dim, overlap)))
        .withColumn("_n", F.size("_rs").cast("bigint") * F.size("_cs"))
    )
    placed = bucketed_prefix_sum(
        sized, "_n", "_base", by=[SLIDE], keys=[F.col("region_id")], order=[F.col("region_id")]
    )
    rows = placed.select("*", F.posexplode("_rs").alias("_i", "rs"))
    cells = rows.select("*", F.posexplode("_cs").alias("_j", "cs"))
    return cells.select(
        SLIDE,
        (F.col("_base") + F.col("_i") * F.size("_cs") + F.col("_j")).cast("bigint").alias("patch_id"),
        "region_id",
        F.col("r0").alias("region_min_row"),
        F.col("c0").alias("region_min_col"),
        F.col("r1").alias("region_max_row"),
        F.col("c1").alias("region_max_col"),
        F.col("rs").alias("patch_row_start"),
        F.col("cs").alias("patch_col_start"),
        F.least(F.col("rs") + max_dim, height).alias("patch_row_end"),
        F.least(F.col("cs") + max_dim, width).alias("patch_col_end"),
    )


def split_region_even(regions: DataFrame, max_dim: int) -> DataFrame:
    """Fewest patches that cover each side, evenly spread: ``(…, row_start, col_start)``.

    A side below ``max_dim`` has one start at 0.
    """

    def starts(side: Column) -> Column:
        n = F.greatest(F.ceil(side / max_dim), F.lit(1)).cast("int")
        spread = lambda i: (i * (side - max_dim) / F.greatest(n - 1, F.lit(1))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), spread)

    height, width = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    keys = [c for c in regions.columns if c in (SLIDE, "region_id")]
    return regions.select(
        *keys, F.explode(starts(height)).alias("row_start"), starts(width).alias("_cs")
    ).select(*keys, "row_start", F.explode("_cs").alias("col_start"))


def make_patches(
    tiles: DataFrame, max_dim: int = 32, overlap: float = 0.1, features: str = "features", unique: bool = False
) -> DataFrame:
    """Regions of active tiles cut into patches; no tiles give an empty table with the schema."""
    regions = cut(region_boxes(active_cells(tiles, features, unique), conn=8, row="gx", col="gy"), "regions")
    return split_region(regions, max_dim, overlap)


def patch_geometry(patches: DataFrame) -> DataFrame:
    """Size and absolute extent of each patch; a null among the ten integers is an error."""
    r, c = F.col("region_min_row"), F.col("region_min_col")
    missing = F.lit(False)
    for name in [SLIDE, *PATCH_INFO]:
        missing = missing | F.col(name).isNull()
    height = F.col("patch_row_end") - F.col("patch_row_start")
    return patches.select(
        SLIDE,
        "patch_id",
        F.when(missing, F.raise_error(F.lit("patch record is incomplete")).cast("int")).otherwise(height).alias("height"),
        (F.col("patch_col_end") - F.col("patch_col_start")).alias("width"),
        (r + F.col("patch_row_start")).alias("row_start"),
        (c + F.col("patch_col_start")).alias("col_start"),
        (r + F.col("patch_row_end")).alias("row_end"),
        (c + F.col("patch_col_end")).alias("col_end"),
    )


def cells_in_box(cells: DataFrame, boxes: DataFrame, row: str = "gx", col: str = "gy", block: int = 32) -> DataFrame:
    """Cells inside half-open boxes ``(row_start, col_start, row_end, col_end)`` of the same slide.

    Boxes are spread over the coarse blocks they touch, so the range test runs as
    an equi-join on (slide, block) and one large slide is split by position.
    """

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))

    spread = (
        boxes.where((F.col("row_end") > F.col("row_start")) & (F.col("col_end") > F.col("col_start")))
        .withColumn("_br", F.explode(span("row_start", "row_end")))
        .withColumn("_bc", F.explode(span("col_start", "col_end")))
    )
    keyed = cells.withColumn("_br", F.floor(F.col(row) / block)).withColumn("_bc", F.floor(F.col(col) / block))
    return (
        spread.join(keyed, [SLIDE, "_br", "_bc"])
        .where(
            (F.col(row) >= F.col("row_start"))
            & (F.col(row) < F.col("row_end"))
            & (F.col(col) >= F.col("col_start"))
            & (F.col(col) < F.col("col_end"))
        )
        .drop("_br", "_bc")
    )


def patch_cells(patches: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells of each patch with local position ``pr, pc``.

    A patch crops the bounding box of its region, so cells of other regions
    inside the box come along.
    """
    boxes = patch_geometry(patches).drop("height", "width")
    rest = [c for c in tiles.columns if c not in CELL]
    return cells_in_box(tiles, boxes).select(
        SLIDE,
        "patch_id",
        (F.col("gx") - F.col("row_start")).alias("pr"),
        (F.col("gy") - F.col("col_start")).alias("pc"),
        *rest,
    )


def densify(cells: DataFrame, max_dim: int, dim: int, features: str = "features") -> DataFrame:
    """One row per patch: ``dense`` is the zero-padded patch, channels first, flattened.

    For export. A patch holds at most ``max_dim`` squared cells, which bounds the group.
    """
    grouped = cells.groupBy(SLIDE, "patch_id").agg(
        F.collect_list(F.struct((F.col("pr") * max_dim + F.col("pc")).cast("int").alias("at"), F.col(features).alias("f"))).alias("cs")
    )
    flat = grouped.select(SLIDE, "patch_id", F.col("cs.at").alias("at"), F.flatten("cs.f").alias("values"))
    schema = T.StructType(
        [cells.schema[SLIDE], cells.schema["patch_id"], T.StructField("dense", T.ArrayType(T.FloatType()))]
    )

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 16):
                part = frame.iloc[at : at + 16]
                dense = []
                for where, values in zip(part["at"], part["values"]):
                    grid = np.zeros((dim, max_dim * max_dim), dtype=np.float32)
                    grid[:, np.asarray(where)] = np.asarray(values, dtype=np.float32).reshape(-1, dim).T
                    dense.append(grid.ravel())
                yield pd.DataFrame({SLIDE: part[SLIDE], "patch_id": part["patch_id"], "dense": dense})

    return flat.mapInPandas(fill, schema)


def last_writer_wins(cells: DataFrame, order: str = "patch_id", row: str = "row", col: str = "col") -> DataFrame:
    """The cell version of the highest patch at each position."""
    rest = [c for c in cells.columns if c not in (SLIDE, row, col)]
    return (
        cells.groupBy(SLIDE, row, col)
        .agg(F.max_by(F.struct(*rest), order).alias("_w"))
        .select(SLIDE, row, col, "_w.*")
    )


def reconstruct(patches: DataFrame, cells: DataFrame, features: str = "features") -> DataFrame:
    """Put patch cells back on the slide grid: ``(slide_id, row, col, patch_id, features)``.

    Where patches overlap the last one in list order wins, with its blanks too: a
    cell survives only when no later patch covers its position. The owner is found
    on positions alone and vectors join last.
    """
    geometry = patch_geometry(patches)
    spots = cells.join(geometry.select(SLIDE, "patch_id", "row_start", "col_start"), [SLIDE, "patch_id"]).withColumn(
        "row", F.col("row_start") + F.col("pr")
    ).withColumn("col", F.col("col_start") + F.col("pc"))
    positions = spots.select(SLIDE, "row", "col").distinct()
    owners = (
        cells_in_box(positions, geometry.drop("height", "width"), row="row", col="col")
        .groupBy(SLIDE, "row", "col")
        .agg(F.max("patch_id").alias("patch_id"))
    )
    return spots.join(owners, [SLIDE, "row", "col", "patch_id"], "left_semi").select(
        SLIDE, "row", "col", "patch_id", features
    )


def reconstructed_grid(patches: DataFrame) -> DataFrame:
    """Every position of the rebuilt grid, up to the largest region end: ``(slide_id, row, col)``."""
    size = patches.groupBy(SLIDE).agg(F.max("region_max_row").alias("h"), F.max("region_max_col").alias("w"))
    return size.select(SLIDE, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")).select(
        SLIDE, "row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col")
    )


def start_lines(patches: DataFrame) -> DataFrame:
    """Distinct start rows and start columns per slide: ``(slide_id, axis, start)``."""
    g = patch_geometry(patches)
    rows = g.select(SLIDE, F.lit("row").alias("axis"), F.col("row_start").alias("start"))
    cols = g.select(SLIDE, F.lit("col").alias("axis"), F.col("col_start").alias("start"))
    return rows.unionByName(cols).distinct()


def section_filter(sections: DataFrame, min_side: int = 15, max_side: int = 21, height="height", width="width") -> DataFrame:
    """Sections whose short side is at least ``min_side`` and long side at least ``max_side``."""
    return sections.where(
        (F.least(height, width) >= min_side) & (F.greatest(height, width) >= max_side)
    )


def any_side_filter(sections: DataFrame, side: int = 3, height="height", width="width") -> DataFrame:
    """Second pass: sections with any side of at least ``side``."""
    return sections.where(F.greatest(height, width) >= side)


def review_list(sections: DataFrame, patient: str, side: int = 12, height="height", width="width") -> DataFrame:
    """Patients with exactly one section that has a side below ``side``."""
    return (
        sections.groupBy(patient)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.least(height, width)).alias("short_side"))
        .where((F.col("_n") == 1) & (F.col("short_side") < side))
        .select(patient, "short_side")
    )


def sections_per_patient(sections: DataFrame, patient: str) -> DataFrame:
    return sections.groupBy(patient).agg(F.count(F.lit(1)).alias("n_sections"))
