"""Joins of one row per key to all rows of that key.

Whether the side is small enough to be broadcast is decided from its bytes at run time,
and so is the split of a key that fills a partition: both are adaptive execution's
work, for which the join must stand next to its shuffles. Nothing is counted here.

The rows themselves are never broadcast. Spark's estimate of rows that come from an explode is that of
the rows before it, so that pixels of many slides pass for a small table; outer and semi joins
leave it the side only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_by_key(
    df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", stored: bool = False, covers: bool = False
) -> DataFrame:
    """``df`` joined to ``side``, which has one row per key; ``stored`` says it is cheap to read again.

    ``covers`` says that ``side`` has every key of ``df`` that is not null, as one made from ``df`` does: the
    inner join is then asked for as an outer one, which never broadcasts ``df``. A filter on columns of
    ``side`` that rejects nulls would undo that.
    """
    keys = list(keys)
    if covers and how == "inner":
        for key in keys:
            df = df.where(F.col(key).isNotNull())
        how = "left"
    return df.join(side, keys, how)
