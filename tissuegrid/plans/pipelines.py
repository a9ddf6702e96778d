"""Composed jobs: masks to sampling points, and files to a patient data set."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sampling_size
from ..functions.skew import attach_by_key
from ..operators import cohort, grid, mask, patches, tissue
from ..operators.words import SLIDE, mask_shape, pack_mask
from ..params import CleanParams, ForegroundParams, PatchParams, TilingParams
from ..session import cut


def foreground_mask(
    mask_rows: DataFrame, gray: DataFrame, p: ForegroundParams = ForegroundParams(), value: str = "gray"
) -> DataFrame:
    """The given mask where it covers enough of the slide, the triangle threshold elsewhere.

    A slide of ``gray`` that has no mask rows at all takes the threshold too.
    """
    good_ids = grid.fill_ratio(mask_rows, p.min_foreground_ratio).where("NOT needs_fallback").select(SLIDE)
    good_ids = cut(good_ids, "good")
    good = attach_by_key(mask_rows, good_ids, [SLIDE], "left_semi", stored=True).select(SLIDE, "r", "c", "v")
    second = mask.triangle_threshold(attach_by_key(gray, good_ids, [SLIDE], "left_anti", stored=True), value)
    return good.unionByName(second.select(SLIDE, "r", "c", "v"))


def tissue_mask(gray: DataFrame, p: ForegroundParams = ForegroundParams(), value: str = "gray") -> DataFrame:
    """``(slide_id, r, c, v)``: the two-part mixture's mask, and the triangle threshold where that covers too little.

    ``value`` runs from 0 to 255. All pixels are counted, so no sampling fraction is needed.
    """
    first = tissue.simple_mask(gray, value, p.min_tissue_prob, float(p.bandwidth)).select(SLIDE, "r", "c", "v")
    return foreground_mask(cut(first, "tissue-mask"), gray, p, value)


def sample_points(
    slides: DataFrame,
    mask_rows: DataFrame | None,
    clean: CleanParams = CleanParams(),
    tiling: TilingParams = TilingParams(),
    gray: DataFrame | None = None,
    foreground: ForegroundParams = ForegroundParams(),
) -> DataFrame:
    """Tile corners ``(slide_id, x, y, size, scale)`` on enough tissue.

    ``slides`` has ``(slide_id, full_h, mag)``. Masks are cleaned, boxed, gridded and
    filtered by coverage; a slide whose mask comes out empty gives no rows. With ``gray``
    pixels, slides whose mask is missing or too small start from their own threshold; without
    ``mask_rows`` all slides start from ``tissue_mask`` of ``gray``.
    """
    if mask_rows is None:
        mask_rows = tissue_mask(gray, foreground)
    elif gray is not None:
        mask_rows = foreground_mask(mask_rows, gray, foreground)
    words = cut(mask.clean_words(pack_mask(mask_rows), clean), "mask")
    info = mask_shape(words).join(slides, SLIDE).select(
        SLIDE,
        "h",
        "w",
        (F.col("full_h") / F.col("h")).alias("scale"),
        sampling_size(tiling.tile_size, F.col("mag"), tiling.reference_mag).alias("size"),
    )
    boxes = grid.scale_bbox(grid.words_bbox(words).join(info, SLIDE), F.col("scale"))  # one row per slide
    points = grid.grid_points(boxes, F.col("size"), tiling.tile_overlap)
    kept = grid.coverage_filter(points, words, tiling.patch_foreground_ratio)
    return kept.select(SLIDE, "x", "y", "size", "scale")


def sample_heatmap(points: DataFrame, mask_rows: DataFrame) -> DataFrame:
    """Tiles per mask pixel for the output of ``sample_points``."""
    return grid.heatmap(points, mask_shape(pack_mask(mask_rows)))


def patient_summary(
    tiles: DataFrame, slide_patient: DataFrame, max_dim: int, overlap: float, features: str = "features", unique: bool = False
) -> DataFrame:
    """Slides, regions, patches and active cells per patient, for every patient with tiles."""
    cells = patches.active_cells(tiles, features, unique)
    regions = cut(patches.region_boxes(cells, conn=8, row="gx", col="gy"), "regions")
    per_slide = (
        regions.groupBy(SLIDE)
        .agg(F.count(F.lit(1)).alias("n_regions"), F.sum("area").alias("n_active"))
        .join(
            patches.split_region(regions, max_dim, overlap).groupBy(SLIDE).agg(F.count(F.lit(1)).alias("n_patches")),
            SLIDE,
        )
    )
    return (
        slide_patient.join(per_slide, SLIDE, "left")
        .groupBy("patient_id")
        .agg(
            F.count(F.lit(1)).alias("n_slides"),
            *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_regions", "n_patches", "n_active")],
        )
    )


@dataclass(frozen=True)
class PatientDataset:
    """Files, metadata and tiles joined to what a training set needs, table by table.

    Every table is keyed by patient or slide and built only when asked for.
    """

    files: DataFrame
    meta: DataFrame
    tiles: DataFrame
    params: PatchParams = PatchParams()
    include: tuple[str, ...] | None = None
    task_overrides: dict[str, str] = field(default_factory=dict)
    root: str = ""

    @cached_property
    def examples(self) -> DataFrame:
        """Complete slides in the metadata with their patient and two paths; stored, as all tables use it."""
        pairs = cohort.restrict_to_metadata(cohort.complete_pairs(self.files), self.meta)
        return cut(cohort.slide_examples(pairs, self.meta, root=self.root), "examples")

    def slides(self) -> DataFrame:
        """Slides of each patient in key order."""
        return cohort.patient_slides(self.examples)

    @cached_property
    def patients(self) -> DataFrame:
        """Label roll-up over complete slides, stored."""
        return cut(cohort.patient_rollup(self.meta.join(self.examples.select(SLIDE), SLIDE, "left_semi")), "patients")

    def labels(self) -> DataFrame:
        """Included labels, long, with their task types."""
        long = cohort.patient_labels(self.patients, "patient_id")
        return cohort.task_types(cohort.include_labels(long, self.include), self.task_overrides)

    def default_labels(self) -> DataFrame:
        return cohort.default_label(self.patients, self.labels(), "patient_id")

    def used_tiles(self) -> DataFrame:
        return attach_by_key(self.tiles, self.examples.select(SLIDE), [SLIDE], "left_semi", stored=True)

    def patches(self) -> DataFrame:
        """Patches of complete slides with ``patient_id`` and the ten placing integers."""
        made = patches.make_patches(self.used_tiles(), self.params.max_dim, self.params.overlap)
        return attach_by_key(made, self.examples.select(SLIDE, "patient_id"), [SLIDE], stored=True)
