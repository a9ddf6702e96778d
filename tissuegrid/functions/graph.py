"""Connected components of an edge table by alternating stars.

A large star hooks every larger neighbour of a node to the least node around it, a
small star does so with the smaller neighbours. Both keep components and shrink paths
at least geometrically, so that long chains settle in a logarithmic number of rounds.
There is no limit on rounds: the work ends when a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def star_components(edges: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, root)`` for every node of ``edges`` that is not the least of its component.

    Nodes are compared within ``by``. ``root`` is the least node reachable. Rounds are
    written to the shared folder and those before the last are deleted.
    """
    by = list(by)
    key = [*by, "u"]
    now = cut(
        edges.select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct(),
        "stars",
    )

    def mark(df: DataFrame):
        # order-free fingerprint of the edge set; a node has one edge once settled
        row = df.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = mark(now)
    if seen[0] == 0:
        return now.select(*by, F.col("u").alias("label"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key).agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # smaller endpoint u, larger neighbour v
        large = (
            now.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, key)
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut(large, "large-star")
        least = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = (
            large.join(least, key)
            .where(F.col("v") != F.col("m"))
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(*by, "u", F.col("m").alias("v")))
            .distinct()
        )
        after = cut(small, "small-star")
        drop_cut(large)
        drop_cut(now)
        mark_after = mark(after)
        now = after
        if mark_after == seen:
            return now.select(*by, F.col("u").alias("label"), F.col("v").alias("root"))
        seen = mark_after
