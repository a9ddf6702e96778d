"""Mixing cohorts to target weights by pivotal dependent rounding.

Every slide of a cohort is to be taken ``target / size`` times on average. The whole part
of that is certain; the rest is a probability. Two slides with fractional
probabilities meet, and mass (tiles, not slides) moves at random from one to the other
until one of them is integral; the sum of tiles does not change and no probability is
biased. One fractional slide is left of each partition; a reduction tree lets these meet
level by level, until one per cohort remains, which is drawn by itself. So a cohort
misses its target by less than its largest slide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_prefix_sum
from ..session import cut

# rows of one cohort that meet in one task, and residuals that meet on the next level
GROUP_ROWS = 2_000
FAN_IN = 4_096


def cohort_targets(
    sizes: DataFrame, *, cohort_col: str = "cohort", weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """``(cohort, size, target)`` from one row ``(cohort_col, size)`` per cohort.

    Cohorts by code point, null last, weigh ``weights`` in turn and share ``total_share``
    of all sizes. None gets more than ``cap`` times its size; the excess goes to the
    others by weight until none is above, which is the level at which capped cohorts (those
    with least size for their weight) and uncapped ones use up the total. Works on one
    row per cohort, in one window; rows of slides never meet here.
    """
    everyone = Window.partitionBy(F.lit(0))
    # UTF-8 bytes sort as code points do; binary strings compare unsigned
    by_name = everyone.orderBy(F.col(cohort_col).cast("binary").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select(F.col(cohort_col), F.col("size").cast("long").alias("size")).withColumn("_w", turn)
    by_room = everyone.orderBy((F.col("size") / F.col("_w")), F.col(cohort_col).cast("binary").asc_nulls_last())
    up_to = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.lit(total_share) * F.sum("size").over(everyone)
    # level if this cohort and all with less room are capped
    left_weight = F.sum("_w").over(everyone) - F.sum("_w").over(up_to)
    level = (total - F.lit(cap) * F.sum("size").over(up_to)) / F.when(left_weight > 0, left_weight)
    # a cohort is capped if even the level with it among the uncapped ones gives it too much
    level_with = (total - F.lit(cap) * (F.sum("size").over(up_to) - F.col("size"))) / (left_weight + F.col("_w"))
    marked = ranked.withColumn("_capped", level_with * F.col("_w") > F.lit(cap) * F.col("size")).withColumn("_level", level).withColumn("_first", level_with)
    # the first uncapped cohort by room has the level of all uncapped ones
    final = F.min(F.when(~F.col("_capped"), F.struct((F.col("size") / F.col("_w")).alias("r"), F.col("_first").alias("l")))).over(everyone)["l"]
    return marked.withColumn("_l", final).select(
        cohort_col,
        "size",
        F.when(F.col("_capped") | F.col("_l").isNull(), F.lit(cap) * F.col("size")).otherwise(F.least(F.col("_l") * F.col("_w"), F.lit(cap) * F.col("size"))).alias("target"),
    )


def _settle(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pivotal steps over rows in order; all results but at most one are 0 or 1."""
    part = part.copy()
    open_at = -1
    for i in range(len(part)):
        p = part[i]
        if p <= 0.0 or p >= 1.0 or size[i] == 0:
            continue
        if open_at < 0:
            open_at = i
            continue
        j, q = open_at, part[open_at]
        si, sj = size[i], size[j]
        up = min((1 - p) * si, q * sj)  # mass that can move from j to i
        down = min(p * si, (1 - q) * sj)
        move = up if draw[i] * (up + down) < down else -down
        p, q = p + move / si, q - move / sj
        # what has reached a bound is exactly there
        full_i = move == (1 - part[i]) * si or -move == part[i] * si
        if full_i:
            p = 1.0 if move > 0 else 0.0
        full_j = move == part[j] * sj or -move == (1 - part[j]) * sj
        if full_j:
            q = 0.0 if move > 0 else 1.0
        part[i], part[j] = p, q
        open_at = j if full_i and not full_j else (i if full_j and not full_i else -1)
    return part


def _meet(rows: DataFrame, parts: int) -> DataFrame:
    """One level: rows ``(_c, _g, _key, _size, _part)`` settle inside ``(_c, _g)``."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(group: pa.Table) -> pa.Table:
            key = group.column("_key").to_numpy()
            mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (key.astype(np.uint64) >> np.uint64(29))
            draw = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)).astype(float) / float(1 << 53)
            part = _settle(group.column("_size").to_numpy().astype(float), group.column("_part").to_numpy(), draw)
            return group.set_column(group.schema.get_field_index("_part"), "_part", pa.array(part))

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
            c, g = table.column("_c").to_numpy(), table.column("_g").to_numpy()
            edge = np.flatnonzero((c[1:] != c[:-1]) | (g[1:] != g[:-1])) + 1
            bounds = np.r_[0, edge, len(c)]
            cuts = [table.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
            return (cuts, None) if last else (cuts[:-1], cuts[-1])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = pa.Table.from_batches([*held, batch])
            done, rest = groups(whole, False)
            held = rest.to_batches() if rest is not None else []
            for t in done:
                yield from settle(t).to_batches()
        if held:
            for t in groups(pa.Table.from_batches(held), True)[0]:
                yield from settle(t).to_batches()

    spread = rows.repartition(parts, "_c", "_g").sortWithinPartitions("_c", "_g", "_key", "_size")
    return spread.mapInArrow(run, schema)


def mix_cohorts(
    slides: DataFrame,
    *,
    id_col: str = "slide_id",
    cohort_col: str = "cohort",
    size_col: str = "n_tiles",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    total_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """How often each slide is taken so that cohorts reach target weights.

    ``slides`` has one row per slide with its cohort and size (``n_tiles``; null or
    negative counts as 0). Returns ``(id_col, cohort_col, size long, cohort_size long,
    target double, copies int, taken long)`` with ``taken = copies * size`` and at most
    ``cap`` copies (a whole number). Slides of size 0 take nothing and are never copied.
    Repeated ids are separate slides; equal rows share a draw but not a fate, as each
    settles in its turn. The draw depends on id and seed alone, so reruns agree.
    """
    if cap != int(cap):
        raise ValueError("cap must be a whole number")
    spark = slides.sparkSession
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    base = slides.select(F.col(id_col).alias("_id"), F.col(cohort_col).alias("_cohort"), size.alias("_size"))
    base = cut(base, "slides")
    sums = base.groupBy("_cohort").agg(F.sum("_size").alias("size"), F.count("*").alias("_n"))
    sums = cut(sums, "cohorts")
    targets = cut(
        cohort_targets(sums, cohort_col="_cohort", weights=weights, total_share=total_share, cap=cap)
        .join(sums.select(F.col("_cohort").alias("_k"), "_n"), F.col("_cohort").eqNullSafe(F.col("_k")))
        .select(
            F.col("_cohort").alias("_k"),
            F.col("size").alias("_total"),
            F.col("target").alias("_target"),
            F.xxhash64(F.coalesce("_cohort", F.lit("\x00null"))).alias("_c"),
            F.ceil(F.col("_n") / GROUP_ROWS).cast("long").alias("_groups"),
            F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0)).alias("_ratio"),
        ),
        "targets",
    )
    draw = F.xxhash64(F.col("_id"), F.lit(seed))
    rows = base.join(targets, F.col("_cohort").eqNullSafe(F.col("_k")))
    sure = F.floor("_ratio").cast("double")
    rows = rows.select(
        "_id",
        "_cohort",
        "_size",
        "_total",
        "_target",
        sure.cast("int").alias("_sure"),
        draw.alias("_key"),
        "_c",
        F.pmod(F.xxhash64("_key", "_size"), "_groups").alias("_g"),
        "_groups",
        F.when(F.col("_size") > 0, F.col("_ratio") - sure).otherwise(F.lit(0.0)).alias("_part"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = cut(_meet(rows, parts), "mix-0")
    done = [carried.where("_part <= 0 or _part >= 1")]
    level = 0
    while True:
        left = carried.where("_part > 0 and _part < 1")
        widest = left.agg(F.max("_groups")).first()[0]
        if widest is None:
            break
        if widest <= 1 and level:
            # the last slide of each cohort is drawn by itself
            u = F.shiftrightunsigned(F.xxhash64("_key", F.lit("last")), 11) / F.lit(float(1 << 53))
            done.append(left.withColumn("_part", (u < F.col("_part")).cast("double")))
            break
        level += 1
        up = left.withColumn("_g", F.floor(F.col("_g") / FAN_IN).cast("long")).withColumn(
            "_groups", F.ceil(F.col("_groups") / FAN_IN).cast("long")
        )
        carried = cut(_meet(up, parts), f"mix-{level}")
        done.append(carried.where("_part <= 0 or _part >= 1"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("_sure") + F.col("_part").cast("int")).alias("copies")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_cohort").alias(cohort_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("cohort_size"),
        F.col("_target").alias("target"),
        F.when(F.col("_size") > 0, copies).otherwise(0).alias("copies"),
        F.when(F.col("_size") > 0, copies * F.col("_size")).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def _names(id_: Column, cohort: Column, size: Column) -> list[Column]:
    """128 bits that stand for an id, a cohort and a size, nulls told apart."""
    parts = [id_, id_.isNull(), cohort, cohort.isNull(), size]
    return [F.xxhash64(*parts).alias("_k"), F.xxhash64(F.lit(1), *parts).alias("_m")]


def take_mix(
    slides: DataFrame, *, id_col: str = "slide_id", cohort_col: str = "cohort", size_col: str = "n_tiles", cap: float = 2.0, **how
) -> DataFrame:
    """All columns of ``slides``, each row as often as ``mix_cohorts`` takes it (``how``: its other parameters).

    Slides of size 0 are not taken. Rows that share id, cohort and size are as many draws: the
    highest of them go to the rows of least hash, and equal rows are taken together.

    Whole rows meet their number once, by a name of id, cohort and size.
    """
    mixed = mix_cohorts(slides, id_col=id_col, cohort_col=cohort_col, size_col=size_col, cap=cap, **how)
    name = ["_k", "_m"]
    drawn = mixed.select(*_names(F.col(id_col), F.col(cohort_col), F.col("size")), "copies")
    # how many rows of a name are taken so many times; at most cap + 1 numbers
    times = [F.sum((F.col("copies") == i).cast("long")).alias(f"_x{i}") for i in range(int(cap) + 1)]
    plan = cut(drawn.groupBy(*name).agg(F.count("*").alias("_n"), F.max("copies").alias("_copies"), *times), "mix-plan")
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    # a struct keeps any column name apart from ours
    row = F.struct(*[F.col(c) for c in slides.columns]).alias("_row")
    rows = slides.select(row, *_names(F.col(id_col), F.col(cohort_col), size))
    single = plan.where("_n = 1 and _copies > 0").select(*name, "_copies")
    repeated = plan.where("_n > 1 and _n > _x0").drop("_copies")
    each = lambda df: df.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
    taken = each(rows.join(single, name))
    return taken if repeated.isEmpty() else taken.unionByName(each(_shared_draws(rows, repeated, name, int(cap))))


def _shared_draws(rows: DataFrame, repeated: DataFrame, name: list[str], cap: int) -> DataFrame:
    """``(_row, _copies)`` of rows whose name is not theirs alone, one row for all equal ones."""
    again = cut(rows.join(repeated.select(*name), name, "left_semi"), "mix-repeated")
    mark = F.to_json("_row", {"ignoreNullFields": "false"})
    keyed = again.withColumn("_p", F.xxhash64(mark)).withColumn("_q", F.xxhash64(F.lit(1), mark))
    key = [*name, "_p", "_q"]
    # equal rows merge where they lie before any of them moves
    equal = keyed.groupBy(*key).agg(F.count("*").alias("_same"))
    before = bucketed_prefix_sum(equal, "_same", "_before", by=name, keys=[F.col("_p"), F.col("_q")], order=[F.col("_p"), F.col("_q")])
    copies, start = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(cap, 0, -1):
        stop = start + F.col(f"_x{i}")
        inside = F.least(F.col("_before") + F.col("_same"), stop) - F.greatest(F.col("_before"), start)
        copies, start = copies + i * F.greatest(inside, F.lit(0)), stop
    counted = before.join(repeated, name).select(*key, copies.alias("_copies")).where("_copies > 0")
    first = keyed.groupBy(*key).agg(F.any_value("_row").alias("_row"))
    return first.join(counted, key).select("_row", "_copies")


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
