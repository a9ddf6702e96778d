"""Masks packed 64 pixels to a word.

A mask is a table of pixel rows ``(slide_id, r, c, v)``. Neighbourhood work runs
on ``(slide_id, r, wi, bits, valid)``: word ``wi`` of line ``r`` holds columns
``64*wi .. 64*wi+63``, ``valid`` marks columns that exist. That is up to 64 times
fewer rows to shuffle and sort, and every step stays a built-in bit operation.
A window partition is one line of one slide, or one word column of it, so its size
is the mask side and a slide with most of the pixels still spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64
SLIDE = "slide_id"


def bit(position: Column) -> Column:
    """Word with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def bit_range(lo: Column, hi: Column) -> Column:
    """Word with bits ``lo..hi`` (inclusive, 0..63) set."""
    ones = F.lit(-1).cast("bigint")
    return F.call_function("shiftleft", ones, lo.cast("int")).bitwiseAND(
        F.call_function("shiftrightunsigned", ones, (F.lit(63) - hi).cast("int"))
    )


def pack_mask(mask: DataFrame, v: str = "v") -> DataFrame:
    """Pixel rows to words; the partial aggregate packs before anything is shuffled."""
    b = bit(F.col("c") % WORD)
    return (
        mask.groupBy(SLIDE, "r", F.shiftright("c", 6).alias("wi"))
        .agg(
            F.coalesce(F.bit_or(F.when(F.col(v) > 0, b)), F.lit(0).cast("bigint")).alias("bits"),
            F.bit_or(b).alias("valid"),
        )
    )


def pack_cells(cells: DataFrame, row: str = "r", col: str = "c") -> DataFrame:
    """Sparse cell rows to words; repeated cells fall together."""
    return cells.groupBy(SLIDE, F.col(row).cast("int").alias("r"), F.shiftright(col, 6).cast("int").alias("wi")).agg(
        F.bit_or(bit(F.col(col) % WORD)).alias("bits")
    )


def unpack_mask(words: DataFrame) -> DataFrame:
    """Words back to dense pixel rows with ``v`` 0 or 1."""
    return (
        words.select(SLIDE, "r", "wi", "bits", "valid", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
        .where(F.getbit("valid", F.col("b")) == 1)
        .select(
            SLIDE,
            F.col("r").cast("int").alias("r"),
            (F.col("wi") * WORD + F.col("b")).cast("int").alias("c"),
            F.getbit("bits", F.col("b")).cast("int").alias("v"),
        )
    )


def mask_shape(words: DataFrame) -> DataFrame:
    """Lines and columns per slide: ``(slide_id, h, w)``."""
    return words.groupBy(SLIDE).agg(
        (F.max("r") + 1).cast("bigint").alias("h"),
        F.max(F.col("wi") * WORD + F.bit_count("valid")).cast("bigint").alias("w"),
    )


def runs_to_words(runs: DataFrame, out: str) -> DataFrame:
    """Cell runs ``(slide_id, r, c0, c1)`` to words."""
    per_word = runs.select(
        SLIDE, "r", "c0", "c1", F.explode(F.sequence(F.shiftright("c0", 6), F.shiftright("c1", 6))).alias("wi")
    )
    lo = F.greatest(F.col("c0") - F.col("wi") * WORD, F.lit(0))
    hi = F.least(F.col("c1") - F.col("wi") * WORD, F.lit(63))
    return per_word.groupBy(SLIDE, "r", "wi").agg(F.bit_or(bit_range(lo, hi)).alias(out))


def frame_words(words: DataFrame, height: int, width: int) -> DataFrame:
    """Every word of a ``height`` x ``width`` grid for the slides of sparse ``words``, absent ones empty.

    Words fall together by an aggregate, so that no pixel is a row; cells outside the grid are left out.
    """
    last = -(-width // WORD) - 1
    # the first word of a slide brings the empty frame along, so that words are made once; line -1 is the word itself
    first = F.row_number().over(Window.partitionBy(SLIDE).orderBy("r", "wi")) == 1
    lines = F.when(F.col("_first"), F.sequence(F.lit(-1), F.lit(height - 1))).otherwise(F.array(F.lit(-1)))
    own = F.col("_line") == -1
    across = F.when(own, F.array("wi")).otherwise(F.sequence(F.lit(0), F.lit(last)))
    framed = (
        words.select(SLIDE, F.col("r").cast("int").alias("r"), F.col("wi").cast("int").alias("wi"), "bits")
        .withColumn("_first", first)
        .select(SLIDE, "r", "wi", "bits", F.explode(lines).alias("_line"))
        .select(SLIDE, F.when(own, F.col("r")).otherwise(F.col("_line")).alias("r"), F.explode(across).alias("wi"), F.when(own, F.col("bits")).otherwise(0).alias("bits"))
        .where(F.col("r").between(0, height - 1) & F.col("wi").between(0, last))
    )
    valid = F.when(F.col("wi") == last, bit_range(F.lit(0), F.lit((width - 1) % WORD))).otherwise(F.lit(-1).cast("bigint"))
    return (
        framed.groupBy(SLIDE, "r", "wi")
        .agg(F.bit_or("bits").alias("bits"))
        .select(SLIDE, "r", "wi", F.col("bits").bitwiseAND(valid).alias("bits"), valid.alias("valid"))
    )


def line_moments(words: DataFrame) -> DataFrame:
    """``(slide_id, r, n, c_sum, c2_sum)`` of each line: pixels set, sums of their columns and squared columns."""
    bits, at = F.col("bits"), F.col("wi").cast("bigint") * WORD
    # column b of a word is the sum of the powers of two in b; a plane has the columns with one of them
    planes = [sum(1 << b for b in range(WORD) if b >> k & 1) for k in range(6)]
    planes = [F.lit(p - (1 << 64) if p >> 63 else p).cast("bigint") for p in planes]
    count = lambda *of: F.bit_count(reduce(Column.bitwiseAND, of, bits)).cast("bigint")
    n = count()
    s1 = sum((count(p) * (1 << k) for k, p in enumerate(planes)), F.lit(0).cast("bigint"))
    s2 = sum((count(p, q) * (1 << (j + k)) for j, p in enumerate(planes) for k, q in enumerate(planes)), F.lit(0).cast("bigint"))
    return words.groupBy(SLIDE, "r").agg(
        F.sum(n).alias("n"), F.sum(n * at + s1).alias("c_sum"), F.sum(n * at * at + s1 * at * 2 + s2).alias("c2_sum")
    )
