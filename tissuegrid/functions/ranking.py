"""Exact ranks and running sums whose groups may hold any share of the rows.

A window sends one whole group to one task. A group of more than ``TARGET_ROWS`` rows is
cut into ordered buckets of about that size first: its own quantiles are the bounds, and
a bound that very many rows share is a bucket of its own, cut again by the next key.
Bucket totals give the offsets and a window inside one bucket gives the rest. Nothing is
dropped and ties are broken by the order the caller states, so the numbers do not depend
on where, or whether, a group was cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .hashing import md5_key

# rows that one window partition should hold
TARGET_ROWS = 500_000

# numeric columns that ascend with the order, or a function that adds them to the rows of
# groups to be cut: (rows, by) -> (rows, columns)
Keys = Sequence[Column] | Callable[[DataFrame, list[str]], tuple[DataFrame, list[Column]]]


def _attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping one copy of them."""
    renamed = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        term = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = term if i == 0 else cond & term
    return df.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def _large(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int]:
    """Groups to be cut, and into how many parts the largest of them."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TARGET_ROWS)
    sizes = cut(sizes, "large-groups")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    return sizes.drop("_n"), -(-most // TARGET_ROWS)


def text_key(col: str) -> Keys:
    """Order of a text: seven bytes behind what all texts of its group begin with."""

    def add(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[Column]]:
        ends = rows.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        # least and greatest text share what all share
        steps = F.sequence(F.lit(1), F.greatest(F.least(F.octet_length("_lo"), F.octet_length("_hi")), F.lit(1)))
        same = lambda i: F.substring(F.col("_lo").cast("binary"), 1, i) == F.substring(F.col("_hi").cast("binary"), 1, i)
        begin = F.coalesce(F.array_max(F.filter(steps, same)), F.lit(0))
        placed = _attach(rows, ends.select(*by, begin.alias("_begin")), by)
        after = F.rpad(F.hex(F.substring(F.col(col).cast("binary"), F.col("_begin") + 1, F.lit(7))), 14, "0")
        return placed.withColumn("_text_key", F.conv(after, 16, 10).cast("bigint")), [F.col("_text_key")]

    return add


def _bucketed(df: DataFrame, by: list[str], keys: Keys, value: Column) -> tuple[DataFrame, list[str]] | None:
    """Rows with bucket columns (null in groups left whole) and ``_boff``, the sum before the bucket."""
    large, parts = _large(df, by)
    if not parts:
        return None
    if by:
        marked = _attach(df, large.withColumn("_hot", F.lit(True)), by).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    else:
        marked = df.withColumn("_hot", F.lit(True))
    rows = marked.where("_hot")
    rows, columns = keys(rows, by) if callable(keys) else (rows, list(keys))
    names: list[str] = []
    within = list(by)
    for i, key in enumerate(columns):
        probs = [k / parts for k in range(1, parts)]
        chosen = rows if i == 0 else _attach(rows, crowded, within, "left_semi")
        bounds = chosen.groupBy(*within).agg(
            F.array_distinct(F.percentile_approx(key, probs, max(10_000, 100 * parts))).alias("_bounds")
        )
        below = F.size(F.filter("_bounds", lambda x: x < key))
        # odd buckets hold one value, even ones the open interval between two
        bucket = 2 * below + F.array_contains("_bounds", key).cast("int")
        names.append(f"_b{i}")
        rows = cut(_attach(rows, bounds, within).withColumn(names[-1], F.coalesce(bucket, F.lit(-1))).drop("_bounds"), "buckets")
        within = [*within, names[-1]]
        if i + 1 < len(columns):
            crowded, parts = _large(rows.where(F.col(names[-1]) % 2 == 1), within)
            if not parts:
                break
    totals = rows.groupBy(*by, *names).agg(F.sum(value).alias("_bsum"))
    # one row for each bucket
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_boff", F.coalesce(F.sum("_bsum").over(before), F.lit(0))).drop("_bsum")
    cold = marked.where(~F.col("_hot")).select(*df.columns, *[F.lit(None).cast("int").alias(n) for n in names], F.lit(0).cast("bigint").alias("_boff"))
    hot = _attach(rows.select(*df.columns, *names), offsets, [*by, *names]).select(*df.columns, *names, F.col("_boff").cast("bigint"))
    return cold.unionByName(hot), [*by, *names]


def bucketed_prefix_sum(
    df: DataFrame, value: str, out: str, *, by: Sequence[str], keys: Keys, order: Sequence[Column]
) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order`` inside ``by``; ``keys`` ascend with ``order``."""
    by = list(by)

    def inside(within):
        w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    found = _bucketed(df, by, keys, F.col(value))
    if found is None:
        return df.withColumn(out, inside(by))
    rows, within = found
    return rows.withColumn(out, F.col("_boff") + inside(within)).select(*df.columns, out)


def bucketed_row_number(
    df: DataFrame, out: str, *, by: Sequence[str], keys: Keys, order: Sequence[Column], at_most: str | None = None
) -> DataFrame:
    """Row number from 1 inside ``by``; ``keys`` as in ``bucketed_prefix_sum``.

    ``at_most`` names a column with a per-row limit: rows ranked beyond it are left
    out, and buckets that start beyond it never reach the sort.
    """
    by = list(by)

    def inside(within):
        return F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)).cast("bigint")

    found = _bucketed(df, by, keys, F.lit(1))
    if found is None:
        ranked = df.withColumn(out, inside(by))
    else:
        rows, within = found
        if at_most:
            rows = rows.where(F.col("_boff") < F.col(at_most))
        ranked = rows.withColumn(out, F.col("_boff") + inside(within)).select(*df.columns, out)
    return ranked.where(F.col(out) <= F.col(at_most)) if at_most else ranked


def hash_order(df: DataFrame, ids: Sequence[str], seed: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Random permutation: number rows by the md5 of ``ids`` and ``seed``, then by ``ids``."""
    return bucketed_row_number(
        df.withColumn("_h", md5_key(seed, *ids)),
        out,
        by=by,
        keys=[F.conv(F.substring("_h", 1, 13), 16, 10).cast("bigint")],
        order=[F.col("_h"), *[F.col(i) for i in ids]],
    ).drop("_h")


def top_by_value(df: DataFrame, value: str, tiebreak: str, limit: str, out: str, *, by: Sequence[str]) -> DataFrame:
    """Rows of each group ranked by ``value`` descending then ``tiebreak``, up to the ``limit`` column."""
    v = F.col(value).cast("double")
    # not a number sorts above all, null below
    down = F.when(F.isnan(v), F.lit(float("-inf"))).when(v.isNull(), F.lit(float("inf"))).otherwise(-v)
    return bucketed_row_number(
        df, out, by=by, keys=[down, F.col(tiebreak)], order=[F.col(value).desc(), F.col(tiebreak)], at_most=limit
    )
