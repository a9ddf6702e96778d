"""Bounded meeting places for rows that share a key.

Rows of one key meet in a tile. A key with more rows than a tile holds is cut into blocks by a
hash, and every pair of blocks gets a tile of its own, so that each two rows still meet
in exactly one task at a time, however large the key; no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048


def tiled(rows: DataFrame, keys: Sequence[str], spread: Column, parts: int) -> DataFrame:
    """``rows`` of keys that occur twice or more, with ``_ti, _tj, _block``, placed and sorted by tile.

    ``spread`` is a hash that decides on blocks. A row of block b goes to the tiles (b, j)
    and (j, b) with the smaller number first.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    met = rows.join(sizes, list(keys)).withColumn("_block", F.pmod(spread, blocks).cast("int"))
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_n")
    met = met.withColumns({"_ti": F.least("_block", "_o"), "_tj": F.greatest("_block", "_o")}).drop("_o")
    place = [*keys, "_ti", "_tj"]
    return met.repartition(parts, *place).sortWithinPartitions(*place, "_block")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles with the row numbers at which tiles start (and the end).

    The first ``n_keys`` columns, long or int, say which tile a row belongs to.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = _starts(table, n_keys)
        last = int(starts[-2])
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, n_keys)


def _starts(table: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(n_keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


class Forest:
    """Union-find over row numbers that reports each pair which joins two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        parent = self.label
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = x, y
            while parent[r] != r:
                r = parent[r]
            while parent[s] != s:
                s = parent[s]
            if r != s:
                parent[max(r, s)] = min(r, s)
                self.edges.append((x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        self.label = parent
