"""Connected components of sparse grids, for all slides at once.

1. Cells are packed to words and grouped into square blocks of bounded size.
2. One Arrow pass labels the cell runs of each block (a small NumPy helper).
3. Only cells on block borders can join labels of different blocks. They are
   matched by an equi-join on position, so no pairs within a group are formed.
4. Labels that touch across borders are merged by alternating stars, which settle in a
   logarithmic number of rounds; each round is cut to the shared folder. Slides no
   larger than a block need no round at all.

The label of a component is its first cell in raster order, which does not depend
on how the data is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import star_components
from ..functions.ranking import bucketed_row_number
from ..session import cut
from .words import SLIDE, WORD, pack_cells

BLOCK = 256
_SPAN = 1 << 31


def _label_runs(block: np.ndarray, row: np.ndarray, word: np.ndarray, bits: np.ndarray, diagonal: int):
    """Runs of set bits and the run index of each component's first run.

    Blocks are independent: every (block, row) pair gets its own stretch of key
    space with a gap column on both sides, and a spare row closes each block.
    """
    stride = BLOCK + 2
    line = block * (BLOCK + 1) + row
    key = line * (BLOCK // WORD) + word
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        line, key, word, bits = line[order], key[order], word[order], bits[order]
    bits = np.ascontiguousarray(bits, np.int64).view(np.uint64)
    # a run begins and ends where the bit before and behind is not set, maybe in the next word of its line
    joined = np.flatnonzero((key[1:] == key[:-1] + 1) & (word[1:] != 0))
    before, behind = np.zeros_like(bits), np.zeros_like(bits)
    one, top = np.uint64(1), np.uint64(WORD - 1)
    before[joined + 1] = bits[joined] >> top
    behind[joined] = bits[joined + 1] << top

    def places(chosen: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(chosen.astype("<u8").view(np.uint8), bitorder="little").view(bool))
        entry = at // WORD
        return line[entry] * stride + word[entry] * WORD + at % WORD + 1

    start, end = places(bits & ~((bits << one) | before)), places(bits & ~((bits >> one) | behind))
    if start.size == 0:
        return start, start, start
    lo = np.searchsorted(end, start + stride - diagonal, "left")
    hi = np.searchsorted(start, end + stride + diagonal, "right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(start.size), count)
    b = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    label = np.arange(start.size)
    while True:
        of_a, of_b = label[a], label[b]
        apart = of_a != of_b
        if not apart.any():
            return start, end, label
        a, b, of_a, of_b = a[apart], b[apart], of_a[apart], of_b[apart]
        np.minimum.at(label, np.maximum(of_a, of_b), np.minimum(of_a, of_b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _block_starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which blocks begin, and the end; ``nth`` counts the rows of a block from 1."""
    nth = table.column("nth").to_numpy()
    starts = np.flatnonzero(nth == 1)
    if starts.size == 0 or starts[0] != 0 or (nth != np.arange(nth.size) - np.repeat(starts, np.diff(np.r_[starts, nth.size])) + 1).any():
        raise ValueError("the rows of a block do not follow each other")
    return np.r_[starts, nth.size]


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks and the rows at which blocks begin, and the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = _block_starts(table)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]), starts[:-1]
        held = table.slice(starts[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _block_starts(table)


def _runs_of_blocks(table: pa.Table, starts: np.ndarray, diagonal: int) -> pa.RecordBatch:
    at, bits = table.column("pos").to_numpy(), table.column("bits").to_numpy()
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    words = BLOCK // WORD
    owner, row, c0, c1, label = _local_runs(block, at // words, at % words, bits, diagonal)
    slide, cols = _placed_runs(table, starts, owner, row, c0, c1, label)
    return pa.RecordBatch.from_arrays([slide, *cols], names=[SLIDE, "r", "c0", "c1", "label"])


def _local_runs(block: np.ndarray, row: np.ndarray, word: np.ndarray, bits: np.ndarray, diagonal: int):
    """Runs with their block, line and ends in it, and the number of the first run of their component."""
    start, end, label = _label_runs(block, row, word, bits, diagonal)
    line, c0 = np.divmod(start, BLOCK + 2)
    owner, r = np.divmod(line, BLOCK + 1)
    return owner, r, c0 - 1, end % (BLOCK + 2) - 1, label


def _placed_runs(table: pa.Table, starts: np.ndarray, owner, row, c0, c1, label, chosen=slice(None)) -> tuple[pa.Array, list[pa.Array]]:
    """Slides of ``chosen`` runs, and their lines, ends and labels on the slide."""
    first = starts[owner]
    r = row + table.column("rb").to_numpy().astype(np.int64)[first] * BLOCK
    base = table.column("cb").to_numpy().astype(np.int64)[first] * BLOCK
    lab = r[label] * _SPAN + c0[label] + base[label]
    slide = pa.concat_arrays(table.column(SLIDE).take(pa.array(first[chosen])).chunks)
    return slide, [*[pa.array(x[chosen], pa.int32()) for x in (r, c0 + base, c1 + base)], pa.array(lab[chosen], pa.int64())]


def fill_in_blocks(words: DataFrame) -> DataFrame:
    """Words ``(slide_id, r, wi, bits, valid)`` with the holes filled that lie within a block, and runs of what a block alone cannot tell.

    A background 4-component that stays off the border of its block and off the last line and column of the block's pixels is a hole. Of one that
    reaches the first line or column of the slide (``open``) the runs on the border of its block are given, of other ones all.
    Words have no ``label``, runs ``(slide_id, r, c0, c1, label, open)`` no ``wi``.
    """
    numbered = _numbered(words, "bits", "valid")
    longs, ints = T.LongType(), T.IntegerType()
    kinds = [("r", ints), ("wi", ints), ("bits", longs), ("valid", longs), ("c0", ints), ("c1", ints), ("label", longs), ("open", T.BooleanType())]
    schema = T.StructType([words.schema[SLIDE]] + [T.StructField(n, k) for n, k in kinds])
    per_block, last = BLOCK // WORD, BLOCK - 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches):
            n, first = table.num_rows, starts[:-1]
            at, bits, valid = (table.column(x).to_numpy() for x in ("pos", "bits", "valid"))
            block = np.repeat(np.arange(len(first)), np.diff(starts))
            row, word = at // per_block, at % per_block
            rb, cb = (table.column(x).to_numpy().astype(np.int64) for x in ("rb", "cb"))
            owner, r, c0, c1, label = _local_runs(block, row, word, ~bits & valid, 0)
            bits = bits.copy()
            if owner.size:
                # extent of every component, at the number of its first run
                low_c, high_r, high_c = c0.copy(), r.copy(), c1.copy()
                np.minimum.at(low_c, label, c0)
                np.maximum.at(high_r, label, r)
                np.maximum.at(high_c, label, c1)
                ends = word * WORD + np.bitwise_count(valid.view(np.uint64)) - 1
                bottom, right = (np.maximum.reduceat(x, first)[owner] for x in (row, ends))
                one = rb[first][owner], cb[first][owner]
                opened = ((r + one[0] * BLOCK <= 0) | (low_c + one[1] * BLOCK <= 0))[label]
                inside = (r > 0) & (low_c > 0) & (high_r < np.minimum(bottom, last)) & (high_c < np.minimum(right, last))
                _set_runs(bits, starts, at, owner, r, c0, c1, inside[label] & ~opened)
                edge = (r == 0) | (r == last) | (c0 == 0) | (c1 == last)
                left = ~inside[label] & (~opened | edge)
            none = lambda kind, m: pa.nulls(m, kind)
            own = [pa.array(row + rb * BLOCK, pa.int32()), pa.array(word + cb * per_block, pa.int32()), pa.array(bits), pa.array(valid)]
            blank = [none(pa.int32(), n), none(pa.int32(), n), none(pa.int64(), n), none(pa.bool_(), n)]
            slides = pa.concat_arrays(table.column(SLIDE).chunks)
            yield pa.RecordBatch.from_arrays([slides, *own, *blank], names=schema.names)
            if owner.size and left.any():
                slide, cols = _placed_runs(table, starts, owner, r, c0, c1, label, left)
                m = len(slide)
                rest = [none(pa.int32(), m), none(pa.int64(), m), none(pa.int64(), m)]
                yield pa.RecordBatch.from_arrays([slide, cols[0], *rest, *cols[1:], pa.array(opened[left])], names=schema.names)

    return numbered.mapInArrow(fill, schema)


def _set_runs(bits: np.ndarray, starts: np.ndarray, at: np.ndarray, owner, row, c0, c1, chosen: np.ndarray) -> None:
    """Set the bits of ``chosen`` runs in the words of their blocks, which are sorted by ``at``."""
    owner, row, c0, c1 = (x[chosen] for x in (owner, row, c0, c1))
    words = BLOCK // WORD
    place = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * (BLOCK * words) + at
    for word in range(words):
        low, high = np.maximum(c0 - word * WORD, 0), np.minimum(c1 - word * WORD, WORD - 1)
        met = low <= high
        ones = np.uint64(2**64 - 1)
        run = (ones << low[met].astype(np.uint64)) & (ones >> (WORD - 1 - high[met]).astype(np.uint64))
        entry = np.searchsorted(place, owner[met] * (BLOCK * words) + row[met] * words + word)
        np.bitwise_or.at(bits.view(np.uint64), entry, run)


def _numbered(words: DataFrame, *columns: str) -> DataFrame:
    """Words by block: ``(slide_id, rb, cb, pos, *columns, nth)``, sorted and counted from 1 in each block."""
    per_block = BLOCK // WORD
    return words.select(
        SLIDE,
        F.floor(F.col("r") / BLOCK).cast("int").alias("rb"),
        F.floor(F.col("wi") / per_block).cast("int").alias("cb"),
        ((F.col("r") % BLOCK) * per_block + F.col("wi") % per_block).cast("int").alias("pos"),
        *columns,
    ).withColumn("nth", F.row_number().over(Window.partitionBy(SLIDE, "rb", "cb").orderBy("pos")))


def block_runs(words: DataFrame, conn: int = 8) -> DataFrame:
    """Runs ``(slide_id, r, c0, c1, label)`` labelled inside each block only.

    Words are numbered by block, never gathered in lists: a block is at most 1,024 words that follow each other.
    The window moves them only if they are not yet dealt by slide or block.
    """
    if conn not in (4, 8):
        raise ValueError("conn must be 4 or 8")
    diagonal = 1 if conn == 8 else 0
    numbered = _numbered(words.where(F.col("bits") != 0), "bits")
    schema = T.StructType(
        [words.schema[SLIDE]]
        + [T.StructField(n, T.IntegerType()) for n in ("r", "c0", "c1")]
        + [T.StructField("label", T.LongType())]
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches):
            yield _runs_of_blocks(table, starts, diagonal)

    return numbered.mapInArrow(label, schema)


def border_edges(runs: DataFrame, conn: int, settled: str | None = None) -> DataFrame:
    """Pairs of labels that touch across a block border; those of two runs that are both ``settled`` are left out."""
    known = F.lit(False) if settled is None else F.col(settled)
    first, last = F.lit(0), F.lit(BLOCK - 1)
    row_in, c0_in, c1_in = F.col("r") % BLOCK, F.col("c0") % BLOCK, F.col("c1") % BLOCK
    whole = F.sequence("c0", "c1")
    ends = F.array_compact(F.array(F.when(c0_in == first, F.col("c0")), F.when(c1_in == last, F.col("c1"))))
    cells = runs.select(
        SLIDE,
        "r",
        F.explode(F.when((row_in == first) | (row_in == last), whole).otherwise(ends)).alias("c"),
        "label",
        known.alias("_known"),
    )
    ahead = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    block_of = lambda x: F.floor(x / BLOCK)
    steps = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ahead])
    out = (
        cells.select(SLIDE, F.col("label").alias("a"), F.col("_known").alias("_both"), "r", "c", F.explode(steps).alias("n"))
        .where((block_of(F.col("n.r")) != block_of(F.col("r"))) | (block_of(F.col("n.c")) != block_of(F.col("c"))))
        .select(SLIDE, "a", "_both", F.col("n.r").alias("r"), F.col("n.c").alias("c"))
    )
    return (
        out.join(cells.withColumnRenamed("label", "b"), [SLIDE, "r", "c"])
        .where(~(F.col("_both") & F.col("_known")))
        .select(SLIDE, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def merge_labels(edges: DataFrame) -> DataFrame:
    """Smallest reachable label of every label in ``edges`` but the least ones: ``(slide_id, label, root)``."""
    return star_components(edges, "a", "b", by=[SLIDE])


def component_runs(words: DataFrame, conn: int = 8) -> DataFrame:
    """Cell runs with the final component ``label`` and ``part``, their label inside their block.

    A part is bounded by its block, so what is decided about a label reaches runs by
    part: no key of that join holds more than a block's runs.
    """
    runs = cut(block_runs(words, conn).withColumnRenamed("label", "part"), "runs")
    edges = border_edges(runs.withColumnRenamed("part", "label"), conn)
    roots = merge_labels(edges).withColumnRenamed("label", "part")
    return runs.join(roots, [SLIDE, "part"], "left").select(
        SLIDE, "r", "c0", "c1", F.coalesce("root", "part").alias("label"), "part"
    )


def label_parts(runs: DataFrame) -> DataFrame:
    """``(slide_id, label, part)``, one row per block and component in it."""
    return runs.select(SLIDE, "label", "part").distinct()


def runs_of_labels(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs whose ``(slide_id, label)`` is in ``labels``, joined by part."""
    chosen = label_parts(runs).join(labels.select(SLIDE, "label"), [SLIDE, "label"], "left_semi")
    return runs.join(chosen.select(SLIDE, "part"), [SLIDE, "part"], "left_semi")


def boxes_of_runs(runs: DataFrame) -> DataFrame:
    """Half-open box and area of every component, with ``region_id`` 0.. in raster order."""
    boxes = cut(runs.groupBy(SLIDE, "label").agg(
        F.min("r").alias("r0"),
        F.min("c0").alias("c0"),
        (F.max("r") + 1).alias("r1"),
        (F.max("c1") + 1).alias("c1"),
        F.sum((F.col("c1") - F.col("c0") + 1).cast("bigint")).alias("area"),
    ), "boxes")
    return bucketed_row_number(boxes, "_rn", by=[SLIDE], keys=[F.col("label")], order=[F.col("label")]).select(
        SLIDE, (F.col("_rn") - 1).cast("int").alias("region_id"), "r0", "c0", "r1", "c1", "area", "label"
    )


def connected_components(cells: DataFrame, conn: int = 8, row: str = "r", col: str = "c") -> DataFrame:
    """``(slide_id, r, c, region_id)`` for every distinct cell."""
    runs = component_runs(pack_cells(cells, row, col), conn)
    ids = boxes_of_runs(runs).select(SLIDE, "label", "region_id")
    by_part = label_parts(runs).join(ids, [SLIDE, "label"]).select(SLIDE, "part", "region_id")
    return runs.join(by_part, [SLIDE, "part"]).select(
        SLIDE,
        F.col("r").alias(row),
        F.explode(F.sequence("c0", "c1")).alias(col),
        "region_id",
    )


def region_boxes(cells: DataFrame, conn: int = 8, row: str = "r", col: str = "c") -> DataFrame:
    """``regions(slide_id, region_id, r0, c0, r1, c1, area)`` straight from runs."""
    return boxes_of_runs(component_runs(pack_cells(cells, row, col), conn)).drop("label")
