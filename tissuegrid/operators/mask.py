"""Mask morphology, hole filling, bar removal and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import attach_by_key
from ..params import CleanParams
from ..session import cut
from .components import border_edges, component_runs, fill_in_blocks, merge_labels, runs_of_labels
from .words import SLIDE, WORD, bit_range, mask_shape, pack_mask, runs_to_words, unpack_mask


def _shl(w: Column, n: int) -> Column:
    return F.shiftleft(w, n) if n else w


def _shr(w: Column, n: int) -> Column:
    return F.shiftrightunsigned(w, n) if n else w


def _across(words: DataFrame, before: int, after: int, erosion: bool) -> DataFrame:
    """Combine each pixel with those ``before`` columns left to ``after`` columns right."""
    if before == 0 and after == 0:
        return words
    line = Window.partitionBy(SLIDE, "r").orderBy("wi")
    fill = F.col("bits").bitwiseOR(F.bitwise_not("valid")) if erosion else F.col("bits").bitwiseAND(F.col("valid"))
    neutral = -1 if erosion else 0
    reach_left, reach_right = -(-before // WORD), -(-after // WORD)
    step = words.withColumn("_w0", fill)
    names = {0: "_w0"}
    for k in range(1, reach_left + 1):
        names[-k] = f"_wl{k}"
        step = step.withColumn(names[-k], F.lag("_w0", k, neutral).over(line))
    for k in range(1, reach_right + 1):
        names[k] = f"_wr{k}"
        step = step.withColumn(names[k], F.lead("_w0", k, neutral).over(line))
    empty = F.lit(neutral).cast("bigint")
    total = None
    for s in range(-before, after + 1):
        q, rest = divmod(s, WORD)
        near = F.col(names[q]) if q in names else empty
        far = F.col(names[q + 1]) if q + 1 in names else empty
        moved = near if rest == 0 else _shr(near, rest).bitwiseOR(_shl(far, WORD - rest))
        total = moved if total is None else (total.bitwiseAND(moved) if erosion else total.bitwiseOR(moved))
    return step.withColumn("bits", total.bitwiseAND(F.col("valid"))).drop(*names.values())


def _down(words: DataFrame, before: int, after: int, erosion: bool) -> DataFrame:
    """Combine each pixel with those ``before`` lines above to ``after`` lines below."""
    if before == 0 and after == 0:
        return words
    near = Window.partitionBy(SLIDE, "wi").orderBy("r").rangeBetween(-before, after)
    fold = F.bit_and if erosion else F.bit_or
    return words.withColumn("bits", fold("bits").over(near))


def _reach(k: int, erosion: bool) -> tuple[int, int]:
    """Kernel extent; an even kernel leans left to erode and right to dilate, so opening has no drift."""
    lean = (k // 2, k - 1 - k // 2)
    return lean if erosion else lean[::-1]


def erode_words(words: DataFrame, k: int, rows_first: bool = True) -> DataFrame:
    before, after = _reach(k, True)
    for step in (_across, _down) if rows_first else (_down, _across):
        words = step(words, before, after, True)
    return words


def dilate_words(words: DataFrame, k: int, rows_first: bool = True) -> DataFrame:
    before, after = _reach(k, False)
    for step in (_across, _down) if rows_first else (_down, _across):
        words = step(words, before, after, False)
    return words


def open_words(words: DataFrame, k: int) -> DataFrame:
    """The two column passes sit next to each other and share one shuffle."""
    return dilate_words(erode_words(words, k), k, rows_first=False)


def close_words(words: DataFrame, k: int) -> DataFrame:
    return erode_words(dilate_words(words, k), k, rows_first=False)


def erode(mask: DataFrame, k: int) -> DataFrame:
    """k x k square minimum; pixels outside the mask are ignored."""
    return unpack_mask(erode_words(pack_mask(mask), k))


def dilate(mask: DataFrame, k: int) -> DataFrame:
    """k x k square maximum; pixels outside the mask are ignored."""
    return unpack_mask(dilate_words(pack_mask(mask), k))


def opening(mask: DataFrame, k: int) -> DataFrame:
    return unpack_mask(open_words(pack_mask(mask), k))


def closing(mask: DataFrame, k: int) -> DataFrame:
    return unpack_mask(close_words(pack_mask(mask), k))


def _with_shape(df: DataFrame, words: DataFrame, shape: DataFrame | None) -> DataFrame:
    """``df`` with ``h`` and ``w`` of its slide; ``shape`` is stored when given."""
    if shape is None:
        return attach_by_key(df, mask_shape(words), [SLIDE], covers=True)
    return attach_by_key(df, shape, [SLIDE], stored=True, covers=True)


def fill_holes_words(words: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """Background 4-components that do not reach the border become foreground.

    ``words`` is read once; ``shape`` saves a reading of what is stored. Holes within a block are filled where the block is labelled, and only
    components that reach the border of theirs become rows. The words come dealt by line.
    """
    stored = cut(fill_in_blocks(words), "filled-blocks")
    filled, runs = (stored.where(F.col("label").isNull() == words_only) for words_only in (True, False))
    names = [SLIDE, "r", "wi", "bits", "valid"]
    filled, runs = filled.select(*names), runs.select(SLIDE, "r", "c0", "c1", "label", "open")
    roots = merge_labels(border_edges(runs, 4, settled="open"))
    extent = runs.groupBy(SLIDE, "label").agg(F.max("open").alias("open"), F.max("r").alias("r_max"), F.max("c1").alias("c_max"))
    reaches = F.col("open") | (F.col("r_max") >= F.col("h") - 1) | (F.col("c_max") >= F.col("w") - 1)
    parts = _with_shape(extent, filled, shape).select(SLIDE, "label", reaches.alias("open"))
    parts = parts.join(roots, [SLIDE, "label"], "left").select(SLIDE, "label", "open", F.coalesce("root", "label").alias("root"))
    parts = cut(parts, "parts")
    inner = parts.groupBy(SLIDE, "root").agg(F.max("open").alias("open")).where("NOT open").select(SLIDE, "root")
    inner = parts.join(inner, [SLIDE, "root"], "left_semi").select(SLIDE, "label")
    holes = runs_to_words(runs.where("NOT open").join(inner, [SLIDE, "label"], "left_semi"), "bits")
    both = filled.unionByName(holes.select(SLIDE, "r", "wi", "bits", F.lit(0).cast("bigint").alias("valid")))
    count = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = both.repartition(count, SLIDE, "r").groupBy(SLIDE, "r", "wi")
    return lines.agg(F.bit_or("bits").alias("bits"), F.bit_or("valid").alias("valid"))


def fill_holes(mask: DataFrame) -> DataFrame:
    return unpack_mask(fill_holes_words(pack_mask(mask)))


def remove_bars_words(
    words: DataFrame, width_ratio: float, height_ratio: float, shape: DataFrame | None = None
) -> DataFrame:
    """Drop wide flat and tall narrow components; ``words`` is read twice, so pass a stored frame, and ``shape`` saves a third reading."""
    runs = component_runs(words.select(SLIDE, "r", "wi", "bits"), conn=8)
    boxes = runs.groupBy(SLIDE, "label").agg(
        F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("c0").alias("c0"), (F.max("c1") + 1).alias("c1")
    )
    boxes = _with_shape(boxes, words, shape)
    bw, bh = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    flat = (bw > F.lit(width_ratio) * F.col("w")) & (bh < F.lit(1 - height_ratio) * F.col("h"))
    tall = (bh > F.lit(height_ratio) * F.col("h")) & (bw < F.lit(1 - width_ratio) * F.col("w"))
    bars = runs_to_words(runs_of_labels(runs, boxes.where(flat | tall)), "bar")
    keep = F.bitwise_not(F.coalesce("bar", F.lit(0).cast("bigint")))
    return words.join(bars, [SLIDE, "r", "wi"], "left").select(
        SLIDE, "r", "wi", F.col("bits").bitwiseAND(keep).alias("bits"), "valid"
    )


def remove_bars(mask: DataFrame, width_ratio: float, height_ratio: float) -> DataFrame:
    return unpack_mask(remove_bars_words(cut(pack_mask(mask), "mask"), width_ratio, height_ratio))


def clear_margin_words(
    words: DataFrame, margin: int, edge_mode: str = "rows", shape: DataFrame | None = None
) -> DataFrame:
    """Zero line ``margin`` and line ``h - margin`` ('rows'), or everything outside them ('band')."""
    if margin < 1:
        raise ValueError("margin must be at least 1")
    sized = _with_shape(words, words, shape)
    r, h = F.col("r"), F.col("h")
    if edge_mode == "rows":
        off = (r == margin) | (r == h - margin)
    elif edge_mode == "band":
        off = (r < margin) | (r >= h - margin)
    else:
        raise ValueError(f"unknown edge_mode {edge_mode!r}")
    return sized.select(
        SLIDE, "r", "wi", F.when(off, F.lit(0).cast("bigint")).otherwise(F.col("bits")).alias("bits"), "valid"
    )


def clear_full_sides_words(
    words: DataFrame, margin: int, share: float = 0.9, shape: DataFrame | None = None
) -> DataFrame:
    """Zero ``margin`` lines along any side whose outermost line is at least ``share`` set.

    Sides are tested top, bottom, left, right, and a side already cleared counts
    as cleared in the later tests. All tests read one small row of counts per slide.
    """
    if margin < 1:
        raise ValueError("margin must be at least 1")
    sized = _with_shape(words, words, shape)
    r, h, w, wi = F.col("r"), F.col("h"), F.col("w"), F.col("wi")
    left = F.when(wi == 0, F.getbit("bits", F.lit(0)).cast("int")).otherwise(0)
    last = w - 1
    right = F.when(wi == F.floor(last / WORD), F.getbit("bits", (last % WORD).cast("int")).cast("int")).otherwise(0)
    in_top, in_bottom = r < margin, r >= h - margin

    def count(value: Column, where: Column, name: str) -> Column:
        return F.sum(F.when(where, value).otherwise(0)).alias(name)

    zones = {"t": in_top & ~in_bottom, "b": in_bottom & ~in_top, "x": in_top & in_bottom, "m": ~in_top & ~in_bottom}
    counts = sized.groupBy(SLIDE, "h", "w").agg(
        count(F.bit_count("bits"), r == 0, "n_top"),
        count(F.bit_count("bits"), r == h - 1, "n_bottom"),
        *[count(left, zone, f"l_{z}") for z, zone in zones.items()],
        *[count(right, zone, f"r_{z}") for z, zone in zones.items()],
    )

    def remaining(side: str) -> Column:
        return (
            F.col(f"{side}_m")
            + F.when(F.col("top"), 0).otherwise(F.col(f"{side}_t"))
            + F.when(F.col("bottom"), 0).otherwise(F.col(f"{side}_b"))
            + F.when(F.col("top") | F.col("bottom"), 0).otherwise(F.col(f"{side}_x"))
        )

    flags = (
        counts.withColumn("top", F.col("n_top") >= F.lit(share) * w)
        .withColumn("bottom", (F.col("n_bottom") >= F.lit(share) * w) & ~(F.col("top") & (h <= margin)))
        .withColumn("left", remaining("l") >= F.lit(share) * h)
        .withColumn("right", (remaining("r") >= F.lit(share) * h) & ~(F.col("left") & (w <= margin)))
        .select(SLIDE, "h", "w", "top", "bottom", "left", "right")
    )
    lo = wi * WORD
    zero, every = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")

    def columns(from_c: Column, to_c: Column) -> Column:
        a, b = F.greatest(from_c - lo, F.lit(0)), F.least(to_c - lo, F.lit(63))
        return F.when(a <= b, bit_range(a, b)).otherwise(zero)

    cleared = (
        F.when((F.col("top") & (r < margin)) | (F.col("bottom") & (r >= h - margin)), every)
        .otherwise(zero)
        .bitwiseOR(F.when(F.col("left"), columns(F.lit(0), F.lit(margin - 1))).otherwise(zero))
        .bitwiseOR(F.when(F.col("right"), columns(w - margin, w - 1)).otherwise(zero))
    )
    return attach_by_key(words, flags, [SLIDE], covers=True).select(
        SLIDE, "r", "wi", F.col("bits").bitwiseAND(F.bitwise_not(cleared)).alias("bits"), "valid"
    )


def clear_edges(mask: DataFrame, margin: int, edge_mode: str = "rows") -> DataFrame:
    """Both edge rules in turn."""
    return unpack_mask(clear_full_sides_words(clear_margin_words(pack_mask(mask), margin, edge_mode), margin))


def regrid_mask(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Nearest-neighbour resize to ``height`` x ``width``.

    Driven by the source pixels: each emits the target cells whose centre falls in
    it, so the target grid is never joined as a whole.
    """
    shape = mask.groupBy(SLIDE).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))

    def targets(at: Column, size: Column, new: int) -> Column:
        # target t samples source floor((t + 0.5) * size / new)
        first = F.ceil(at * new / size - 0.5).cast("int")
        stop = F.ceil((at + 1) * new / size - 0.5).cast("int")
        return F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))

    return (
        attach_by_key(mask, shape, [SLIDE], covers=True)
        .select(SLIDE, F.explode(targets(F.col("r"), F.col("_h"), height)).alias("nr"), "c", "v", "_w")
        .select(SLIDE, F.col("nr").alias("r"), F.explode(targets(F.col("c"), F.col("_w"), width)).alias("c"), "v")
        .withColumn("v", F.ceil("v").cast("int"))
    )


def clean_words(words: DataFrame, p: CleanParams) -> DataFrame:
    """The whole clean-up chain on packed words.

    Words are stored before each step that reads them more than once, so no step is
    computed twice; the shape of a mask never changes and is found once.
    """
    words = cut(words, "mask")
    shape = cut(mask_shape(words), "shape")
    words = fill_holes_words(open_words(words, p.opening_kernel), shape)
    words = cut(clear_margin_words(words, p.edge_margin, shape=shape), "mask")
    words = remove_bars_words(words, p.max_width_ratio, p.max_height_ratio, shape)
    if p.square_fill_kernel > 0:
        words = fill_holes_words(close_words(words, p.square_fill_kernel), shape)
    if p.square_dilation_kernel > 0:
        words = dilate_words(words, p.square_dilation_kernel)
    return clear_full_sides_words(cut(open_words(words, p.opening_kernel * 4), "mask"), p.edge_margin, shape=shape)


def clean_mask(mask: DataFrame, p: CleanParams = CleanParams(), shape: tuple[int, int] | None = None) -> DataFrame:
    """Open, fill, clear edges, drop bars, close, dilate, open wide, clear full sides, optionally regrid."""
    cleaned = unpack_mask(clean_words(pack_mask(mask), p))
    return regrid_mask(cleaned, *shape) if shape else cleaned


def triangle_threshold(pixels: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Pixels with ``threshold`` (triangle rule on a histogram per slide) and ``v`` = value <= threshold.

    The histogram side holds at most ``bins`` rows per slide.
    """
    span = cut(pixels.groupBy(SLIDE).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "span")
    spot = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))
    hist = cut(
        attach_by_key(pixels, span, [SLIDE], stored=True, covers=True)
        .groupBy(SLIDE, F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n")),
        "hist",
    )
    marks = hist.groupBy(SLIDE).agg(
        F.max(F.struct("n", (-F.col("bin")).alias("nb"))).alias("top"),
        F.min("bin").alias("low"),
        F.max("bin").alias("high"),
    )
    peak = -F.col("top.nb")
    flip = (peak - F.col("low")) < (F.col("high") - peak)
    sides = marks.select(
        SLIDE,
        F.col("top.n").alias("peak_n"),
        flip.alias("flip"),
        F.when(flip, bins - 1 - peak).otherwise(peak).alias("at"),
        F.when(flip, bins - 1 - F.col("high")).otherwise(F.col("low")).alias("from_bin"),
        (F.col("low") == F.col("high")).alias("flat"),
    )
    walk = sides.where(~F.col("flat")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("at") - F.col("from_bin") - 1)).alias("x")
    )
    walk = walk.withColumn("fb", F.col("x") + F.col("from_bin")).withColumn(
        "bin", F.when(F.col("flip"), bins - 1 - F.col("fb")).otherwise(F.col("fb"))
    )
    length = F.col("peak_n") * F.col("x") - (F.col("at") - F.col("from_bin")) * F.coalesce("n", F.lit(0))
    best = (
        walk.join(hist, [SLIDE, "bin"], "left")
        .groupBy(SLIDE)
        .agg(F.max(F.struct(length.alias("length"), (-F.col("x")).alias("nx"), "bin")).alias("best"))
        .select(SLIDE, F.col("best.bin").alias("bin"))
    )
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    cut_at = span.join(best, SLIDE, "left").select(
        SLIDE, F.when(F.col("bin").isNull(), F.col("lo")).otherwise(centre).alias("threshold")
    )
    return attach_by_key(pixels, cut_at, [SLIDE], covers=True).withColumn("v", (F.col(value) <= F.col("threshold")).cast("int"))


def block_max_pool(mask: DataFrame, s: int) -> DataFrame:
    """Max over s x s blocks; the grid is padded evenly on both sides when s does not divide it."""
    shape = mask.groupBy(SLIDE).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))

    def block(at: str, size: str) -> Column:
        missing = F.ceil(F.col(size) / s) * s - F.col(size)
        return F.floor((F.col(at) + F.floor(missing / 2)) / s).cast("int")

    return (
        attach_by_key(mask, shape, [SLIDE], covers=True)
        .groupBy(SLIDE, block("r", "_h").alias("r"), block("c", "_w").alias("c"))
        .agg(F.max("v").alias("v"))
    )
