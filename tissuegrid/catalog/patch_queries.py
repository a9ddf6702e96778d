"""Tiles, regions, patches and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as co
from ..operators import components as cc
from ..operators import patches as pt
from ..params import PatchParams
from ..plans import pipelines as pl
from ..session import cut
from . import fixtures as fx
from .cohort_queries import PAIRS
from .mask_sql import Steps
from .registry import query

DIM, OVERLAP, STEP = 4, 0.25, 3

TILE_CELLS = "tile_cells AS MATERIALIZED (SELECT slide_id, gx AS r, gy AS c FROM fx_tiles WHERE NOT blank)"


def _regions(s: Steps, cells: str) -> str:
    return s.boxes(s.runs(cells, 8))


def _starts(side: str) -> str:
    limit = f"greatest({side} - {DIM}, 0)"
    return f"list_transform(range(0, {limit} + {STEP}, {STEP}), lambda q: least(q, {limit}))"


def _patches(s: Steps, boxes: str) -> str:
    return s.add(
        f"""SELECT slide_id, row_number() OVER (PARTITION BY slide_id ORDER BY region_id, rs, cs) - 1 AS patch_id, region_id,
          r0 AS region_min_row, c0 AS region_min_col, r1 AS region_max_row, c1 AS region_max_col,
          CAST(rs AS INT) AS patch_row_start, CAST(cs AS INT) AS patch_col_start,
          CAST(least(rs + {DIM}, r1 - r0) AS INT) AS patch_row_end, CAST(least(cs + {DIM}, c1 - c0) AS INT) AS patch_col_end
        FROM (SELECT *, unnest({_starts('(c1 - c0)')}) AS cs FROM (
          SELECT *, unnest({_starts('(r1 - r0)')}) AS rs FROM {boxes}) t) u"""
    )


def _tile_patches() -> tuple[Steps, str]:
    s = Steps(fx.TILES, TILE_CELLS)
    return s, _patches(s, _regions(s, "tile_cells"))


def _stored_patches(spark, path):
    return cut(pt.make_patches(fx.tiles(spark, path), DIM, OVERLAP, unique=True), "patches")


def _sql(body: str) -> str:
    s, p = _tile_patches()
    return s.text(body.format(p=p))


# --- flagship --------------------------------------------------------------


def _summary_sql(table: str, cells_table: str, cells: str) -> str:
    s = Steps(table, cells_table)
    boxes = _regions(s, cells)
    patches = _patches(s, boxes)
    source = "fx_tiles" if "fx_tiles" in table else "fx_lattice"
    return s.text(
        f""", slides AS (SELECT DISTINCT slide_id, patient_id FROM {source}),
          r AS (SELECT slide_id, count(*) AS n_regions, sum(area) AS n_active FROM {boxes} GROUP BY slide_id),
          p AS (SELECT slide_id, count(*) AS n_patches FROM {patches} GROUP BY slide_id)
          SELECT patient_id, count(*) AS n_slides, CAST(coalesce(sum(n_regions), 0) AS BIGINT) AS n_regions,
            CAST(coalesce(sum(n_patches), 0) AS BIGINT) AS n_patches, CAST(coalesce(sum(n_active), 0) AS BIGINT) AS n_active
          FROM slides s LEFT JOIN r ON r.slide_id = s.slide_id LEFT JOIN p ON p.slide_id = s.slide_id GROUP BY patient_id"""
    )


@query("flagship_patient_summary", _summary_sql(fx.LATTICE, fx.LATTICE_CELLS, "lattice_cells"))
def flagship(spark, path):
    tiles = fx.lattice(spark, path)
    slides = tiles.select("slide_id", "patient_id").distinct()
    return pl.patient_summary(tiles, slides, DIM, OVERLAP)


@query("flagship_embedding_tiles", _summary_sql(fx.TILES, TILE_CELLS, "tile_cells"))
def flagship_tiles(spark, path):
    tiles = fx.tiles(spark, path)
    slides = tiles.select("slide_id", "patient_id").distinct()
    return pl.patient_summary(tiles, slides, DIM, OVERLAP, unique=True)


# --- cells -----------------------------------------------------------------


@query("g15_active", fx.with_sql("SELECT vec_id, NOT blank AS active FROM fx_tiles", fx.TILES))
def g15(spark, path):
    return fx.tiles(spark, path).select("vec_id", pt.active("features").alias("active"))


@query("g16_feature_dim", fx.with_sql("SELECT CAST(max(len(features)) AS INT) AS feature_dim FROM fx_tiles", fx.TILES))
def g16(spark, path):
    return pt.feature_dim(fx.tiles(spark, path))


@query(
    "a6_coalesce_cells",
    fx.with_sql(
        """SELECT slide_id, gx, gy, round(sum(f0), 6) AS f0, round(sum(f1), 6) AS f1 FROM fx_lattice GROUP BY 1, 2, 3""",
        fx.LATTICE,
    ),
)
def a6(spark, path):
    merged = pt.coalesce_cells(fx.lattice(spark, path), width=2)
    return merged.select(
        "slide_id",
        "gx",
        "gy",
        F.round(F.col("features")[0], 6).alias("f0"),
        F.round(F.col("features")[1], 6).alias("f1"),
    )


@query(
    "a7_grid_dims",
    fx.with_sql(
        "SELECT slide_id, max(gx) + 1 AS height, max(gy) + 1 AS width FROM fx_lattice GROUP BY slide_id", fx.LATTICE
    ),
)
def a7(spark, path):
    return pt.grid_dims(fx.lattice(spark, path))


def _lattice_regions(body: str, components: bool = False) -> str:
    s = Steps(fx.LATTICE, fx.LATTICE_CELLS)
    runs = s.runs("lattice_cells", 8)
    boxes = s.boxes(runs)
    return s.text(body.format(b=boxes, n=runs))


@query(
    "r1_connected_components",
    _lattice_regions(
        """SELECT n.slide_id, n.r AS gx, CAST(unnest(range(n.c0, n.c1 + 1)) AS INT) AS gy, b.region_id
           FROM {n} n JOIN {b} b ON b.slide_id = n.slide_id AND b.lab = n.lab"""
    ),
)
def r1(spark, path):
    return cc.connected_components(pt.active_cells(fx.lattice(spark, path)), 8, "gx", "gy")


def _lattice_boxes(spark, path):
    return cc.region_boxes(pt.active_cells(fx.lattice(spark, path)), 8, "gx", "gy")


@query("r2_region_boxes", _lattice_regions("SELECT slide_id, region_id, r0, c0, r1, c1, area FROM {b}"))
def r2(spark, path):
    return _lattice_boxes(spark, path)


SECTIONS = "SELECT b.slide_id, CAST(floor(b.slide_id / 2) AS BIGINT) AS patient_id, b.region_id, r1 - r0 AS height, c1 - c0 AS width FROM {b} b"


def _sections(spark, path):
    return _lattice_boxes(spark, path).select(
        "slide_id",
        F.floor(F.col("slide_id") / 2).alias("patient_id"),
        "region_id",
        (F.col("r1") - F.col("r0")).alias("height"),
        (F.col("c1") - F.col("c0")).alias("width"),
    )


@query(
    "g17_section_filter",
    _lattice_regions(
        f"""SELECT slide_id, region_id, height, width, CASE WHEN least(height, width) >= 5 AND greatest(height, width) >= 7
              THEN 'kept' ELSE 'second pass' END AS pass FROM ({SECTIONS}) t WHERE greatest(height, width) >= 3"""
    ),
)
def g17(spark, path):
    sections = _sections(spark, path).drop("patient_id")
    second = pt.any_side_filter(sections, 3)
    first = pt.section_filter(second, 5, 7).select("slide_id", "region_id", F.lit("kept").alias("pass"))
    return second.join(first, ["slide_id", "region_id"], "left").withColumn("pass", F.coalesce("pass", F.lit("second pass")))


@query(
    "g17_review_list",
    _lattice_regions(
        f"""SELECT slide_id, min(least(height, width)) AS short_side FROM ({SECTIONS}) t
            WHERE greatest(height, width) >= 8 GROUP BY slide_id HAVING count(*) = 1 AND min(least(height, width)) < 12"""
    ),
)
def g17_review(spark, path):
    large = pt.any_side_filter(_sections(spark, path), 8)
    return pt.review_list(large, "slide_id", 12)


@query(
    "a18_density_2d",
    _lattice_regions(
        f""", sec AS MATERIALIZED ({SECTIONS}), span AS (SELECT min(height) AS hl, max(height) AS hh, min(width) AS wl, max(width) AS wh FROM sec)
            SELECT CAST(least(floor((height - hl) * 5 / (hh - hl)), 4) AS INT) AS x_bin,
              CAST(least(floor((width - wl) * 5 / (wh - wl)), 4) AS INT) AS y_bin, count(*) AS n FROM sec, span GROUP BY 1, 2"""
    ),
)
def a18(spark, path):
    return co.density_2d(cut(_sections(spark, path), "sections"), "height", "width", 5)


@query(
    "a19_sections_per_patient",
    _lattice_regions(f"SELECT patient_id, count(*) AS n_sections FROM ({SECTIONS}) t GROUP BY patient_id"),
)
def a19(spark, path):
    return pt.sections_per_patient(_sections(spark, path), "patient_id")


def _lattice_split(body: str) -> str:
    s = Steps(fx.LATTICE, fx.LATTICE_CELLS)
    boxes = _regions(s, "lattice_cells")
    return s.text(body.format(p=_patches(s, boxes), b=boxes))


@query("u4_split_region", _lattice_split("SELECT * FROM {p}"))
def u4(spark, path):
    return pt.split_region(cut(_lattice_boxes(spark, path), "regions"), DIM, OVERLAP)


_EVEN = "list_transform(range(0, greatest(CAST(ceil({s} / 4.0) AS BIGINT), 1)), lambda i: CAST(trunc(i * ({s} - 4) / greatest(CAST(ceil({s} / 4.0) AS BIGINT) - 1, 1)) AS INT))"


@query(
    "u5_split_region_even",
    _lattice_regions(
        "SELECT slide_id, region_id, row_start, unnest("
        + _EVEN.replace("{s}", "(c1 - c0)")
        + ") AS col_start FROM (SELECT *, unnest("
        + _EVEN.replace("{s}", "(r1 - r0)")
        + ") AS row_start FROM {b}) t"
    ),
)
def u5(spark, path):
    return pt.split_region_even(_lattice_boxes(spark, path), DIM)


# --- patches of embedding tiles --------------------------------------------


@query("p1_make_patches", _sql("SELECT * FROM {p}"))
def p1(spark, path):
    return pt.make_patches(fx.tiles(spark, path), DIM, OVERLAP)


GEO = """SELECT slide_id, patch_id, patch_row_end - patch_row_start AS height, patch_col_end - patch_col_start AS width,
  region_min_row + patch_row_start AS row_start, region_min_col + patch_col_start AS col_start,
  region_min_row + patch_row_end AS row_end, region_min_col + patch_col_end AS col_end FROM {p}"""


@query("g19_patch_geometry", _sql(GEO))
def g19(spark, path):
    return pt.patch_geometry(pt.make_patches(fx.tiles(spark, path), DIM, OVERLAP, unique=True))


@query(
    "u6_start_lines",
    _sql(
        f"SELECT DISTINCT slide_id, 'row' AS axis, row_start AS start FROM ({GEO}) g UNION "
        f"SELECT DISTINCT slide_id, 'col', col_start FROM ({GEO}) g"
    ),
)
def u6(spark, path):
    return pt.start_lines(_stored_patches(spark, path))


@query(
    "j5_cells_in_box",
    _sql(
        f"""SELECT t.slide_id, g.patch_id, t.vec_id FROM fx_tiles t JOIN ({GEO}) g ON g.slide_id = t.slide_id
            AND t.gx >= row_start AND t.gx < row_end AND t.gy >= col_start AND t.gy < col_end"""
    ),
)
def j5(spark, path):
    boxes = pt.patch_geometry(_stored_patches(spark, path))
    tiles = fx.tiles(spark, path).select("slide_id", "gx", "gy", "vec_id")
    return pt.cells_in_box(tiles, boxes, block=DIM).select("slide_id", "patch_id", "vec_id")


CELLS = f"""SELECT t.slide_id, g.patch_id, t.gx - row_start AS pr, t.gy - col_start AS pc, t.vec_id, t.features, t.blank,
  t.gx, t.gy FROM fx_tiles t JOIN ({GEO}) g ON g.slide_id = t.slide_id
  AND t.gx >= row_start AND t.gx < row_end AND t.gy >= col_start AND t.gy < col_end"""


@query("p2_patch_cells", _sql(f"SELECT slide_id, patch_id, pr, pc, vec_id FROM ({CELLS}) c"))
def p2(spark, path):
    tiles = fx.tiles(spark, path).select("slide_id", "gx", "gy", "vec_id")
    return pt.patch_cells(_stored_patches(spark, path), tiles)


@query(
    "p3_densify",
    _sql(
        f"""SELECT g.slide_id, g.patch_id, a.spot AS "at", coalesce(round(v.value, 6), 0) + 0.0 AS value
            FROM ({GEO}) g CROSS JOIN range(1024) AS a(spot) LEFT JOIN (
              SELECT slide_id, patch_id, (ch - 1) * 16 + pr * 4 + pc AS spot, features[ch] AS value FROM (
                SELECT *, unnest(range(1, 65)) AS ch FROM ({CELLS}) c) t) v
            ON v.slide_id = g.slide_id AND v.patch_id = g.patch_id AND v.spot = a.spot"""
    ),
)
def p3(spark, path):
    tiles = fx.tiles(spark, path).select("slide_id", "gx", "gy", "features")
    dense = pt.densify(pt.patch_cells(_stored_patches(spark, path), tiles), DIM, 64)
    return dense.select("slide_id", "patch_id", F.posexplode("dense").alias("at", "value")).select(
        "slide_id", "patch_id", F.col("at").cast("bigint").alias("at"), (F.round("value", 6) + 0.0).alias("value")
    )


@query(
    "w10_last_writer_wins",
    _sql(
        f"""SELECT slide_id, gx AS row, gy AS col, patch_id, pr, pc FROM ({CELLS}) c
            QUALIFY row_number() OVER (PARTITION BY slide_id, gx, gy ORDER BY patch_id DESC) = 1"""
    ),
)
def w10(spark, path):
    tiles = fx.tiles(spark, path).select("slide_id", "gx", "gy")
    patches = _stored_patches(spark, path)
    placed = pt.patch_cells(patches, tiles).join(
        pt.patch_geometry(patches).select("slide_id", "patch_id", "row_start", "col_start"), ["slide_id", "patch_id"]
    )
    spots = placed.select(
        "slide_id",
        (F.col("row_start") + F.col("pr")).alias("row"),
        (F.col("col_start") + F.col("pc")).alias("col"),
        "patch_id",
        "pr",
        "pc",
    )
    return pt.last_writer_wins(spots)


@query(
    "p4_reconstruct",
    _sql(
        f""", owner AS (SELECT slide_id, gx, gy, max(patch_id) AS patch_id FROM ({CELLS}) c GROUP BY 1, 2, 3)
            SELECT o.slide_id, o.gx AS row, o.gy AS col, o.patch_id, round(list_sum(CAST(t.features AS DOUBLE[])) + 0.0, 5) AS total
            FROM owner o JOIN fx_tiles t ON t.slide_id = o.slide_id AND t.gx = o.gx AND t.gy = o.gy"""
    ),
)
def p4(spark, path):
    tiles = fx.tiles(spark, path)
    patches = _stored_patches(spark, path)
    cells = pt.patch_cells(patches, tiles.select("slide_id", "gx", "gy", "features"))
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return pt.reconstruct(patches, cut(cells, "cells")).select(
        "slide_id", "row", "col", "patch_id", (F.round(total, 5) + 0.0).alias("total")
    )


def _dataset_sql() -> str:
    s = Steps(fx.META, fx.FILES, PAIRS, fx.ORDER_TILES)
    # cells of slides with a complete pair
    s.parts.append(
        """lattice_cells AS MATERIALIZED (SELECT slide_id, gx AS r, gy AS c FROM fx_order_tiles
          WHERE CAST(slide_id AS VARCHAR) IN (SELECT slide_id FROM pairs)
          GROUP BY slide_id, gx, gy HAVING sum(f0) <> 0 OR sum(f1) <> 0)"""
    )
    patches = _patches(s, _regions(s, "lattice_cells"))
    return s.text(
        f""", used AS (SELECT * FROM fx_slide_meta WHERE CAST(slide_id AS VARCHAR) IN (SELECT slide_id FROM pairs)),
             used_rollup AS (SELECT patient_id, max(CAST(odx_train AS DOUBLE)) AS odx_train,
               max(CASE WHEN odx85 = 'H' THEN 1 ELSE 0 END) AS odx85, max(CASE WHEN mphr = 'H' THEN 1 ELSE 0 END) AS mphr,
               count(*) AS n_slides FROM used GROUP BY patient_id),
             n AS (SELECT u.patient_id, count(*) AS n_patches FROM {patches} p JOIN used u ON u.slide_id = p.slide_id GROUP BY 1)
           SELECT r.patient_id, n_slides, CAST(odx85 AS FLOAT) AS default_label, CAST(odx85 AS FLOAT) AS odx85,
             CAST(mphr AS FLOAT) AS mphr, CAST(odx_train AS FLOAT) AS odx_train, coalesce(n_patches, 0) AS n_patches
           FROM used_rollup r LEFT JOIN n ON n.patient_id = r.patient_id"""
    )


@query("c4_patient_dataset", _dataset_sql())
def c4(spark, path):
    tiles = fx.order_tiles(spark, path).withColumn("slide_id", F.col("slide_id").cast("string"))
    data = pl.PatientDataset(
        fx.files(spark, path),
        fx.keyed_meta(spark, path),
        tiles,
        PatchParams(DIM, OVERLAP),
        include=("odx85", "mphr", "odx_train"),
    )
    wide = data.labels().groupBy("patient_id").pivot("label", ["odx85", "mphr", "odx_train"]).agg(F.first("value"))
    slides = data.slides().groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_slides"))
    patches = data.patches().groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_patches"))
    return (
        slides.join(data.default_labels(), "patient_id")
        .join(wide, "patient_id")
        .join(patches, "patient_id", "left")
        .withColumn("n_patches", F.coalesce("n_patches", F.lit(0).cast("bigint")))
    )
