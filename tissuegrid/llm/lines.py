"""Line dedup of event texts by the spread of a line over sites.

A line that many sites carry is boilerplate. Per line hash, HyperLogLog sketches of the
sites merge by aggregation; only lines whose estimate is close to the threshold get an
exact distinct count. The first record that has a boilerplate line keeps it, all others
lose it. Built of DataFrame functions only.

A site is any column that says where a record comes from (for log records the host or
job that wrote them); records are ``event_id``, ``event`` and ``site``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

LOG_K = 12
_SPACE = " \t\r\x0b\x0c"


def spread_lines(
    lines: DataFrame, *, min_sites: int, id_col: str = "_id", site_col: str = "_site", keys: tuple[str, ...] = ("_h", "_m")
) -> DataFrame:
    """``(*keys, _first)`` of lines on ``min_sites`` sites or more, with the least id that has them.

    Null sites do not count. More than three standard errors (of 1.6 %) from ``min_sites`` the sketch decides alone: of
    lines that lie right at that margin about one in 700 is decided wrongly.
    """
    keys = list(keys)
    sketched = cut(
        lines.groupBy(*keys).agg(
            F.hll_sketch_agg(F.col(site_col), F.lit(LOG_K)).alias("_sketch"), F.min(id_col).alias("_first"), F.count("*").alias("_n")
        )
        # fewer lines than sites asked for: no sketch can say otherwise
        .where(F.col("_n") >= min_sites)
        .select(*keys, "_first", F.hll_sketch_estimate("_sketch").alias("_sites")),
        "line-sketches",
    )
    # three standard errors of a sketch, one site at least
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << LOG_K) * min_sites))
    sure = sketched.where(F.col("_sites") > min_sites + margin)
    near = sketched.where(F.col("_sites").between(min_sites - margin, min_sites + margin))
    exact = (
        lines.join(near.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.countDistinct(site_col).alias("_exact"))
        .where(F.col("_exact") >= min_sites)
    )
    return sure.select(*keys, "_first").unionByName(near.join(exact, keys).select(*keys, "_first"))


def _stripped(events: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, min_words: int) -> DataFrame:
    """``(_row, _id, n_lines, n_removed, _kept)`` with the whole input row as ``_row``."""
    rows = events.select(
        F.struct(*[F.col(c) for c in events.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.col(site_col).cast("string").alias("_site"),
    ).withColumn("_t", F.xxhash64("_text"))
    line = F.btrim("_line", F.lit(_SPACE))
    words = F.regexp_count(F.col("_line"), F.lit(r"[^\x20\x09-\x0D]+"))
    lines = (
        rows.select("_id", "_t", "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .where(words >= min_words)
        .select("_id", "_t", "_site", "_pos", F.xxhash64(line).alias("_h"), F.hash(line).alias("_m"))
    )
    found = cut(spread_lines(lines, min_sites=min_sites), "boilerplate")
    gone = (
        lines.join(found, ["_h", "_m"])
        .where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy(F.col("_id").alias("_i"), F.col("_t").alias("_u"))
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u")), "left")
    parts = F.split("_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        "_row",
        "_id",
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("_kept"),
    )


def remove_boilerplate(
    events: DataFrame,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    site_col: str = "site",
    min_sites: int = 10,
    min_words: int = 1,
) -> DataFrame:
    """``(id_col, n_lines int, n_removed int, kept string)``, one row per input row.

    Lines are cut at line feeds and compared without white space at their ends; those of
    fewer than ``min_words`` words (by default none but blank lines) are never boilerplate. A line on ``min_sites`` distinct
    sites or more stays in the record of least id only (all its occurrences there). Null texts stay
    null with no lines; an empty text has one empty line. Rows that repeat an id keep or
    lose lines alike; a row with a null id is never the first unless no row has an id.
    """
    found = _stripped(events, id_col, text_col, site_col, min_sites, min_words)
    return found.select(F.col("_id").alias(id_col), "n_lines", "n_removed", F.col("_kept").alias("kept"))


def strip_boilerplate(
    events: DataFrame,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    site_col: str = "site",
    min_sites: int = 10,
    min_words: int = 1,
) -> DataFrame:
    """All rows and columns of ``events``, the text without the lines that ``remove_boilerplate`` removes."""
    found = _stripped(events, id_col, text_col, site_col, min_sites, min_words)
    return found.select(*[F.col("_kept").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in events.columns])
