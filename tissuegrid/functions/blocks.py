"""Arrow passes over sorted groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(cols: Sequence[str]) -> list[Column]:
    """128 bits ``_g, _h`` that stand for the values of ``cols``, nulls told apart."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("_g"), F.xxhash64(F.lit(1), *parts).alias("_h")]


def group_starts(table: pa.Table, n_keys: int) -> np.ndarray:
    """Row numbers at which groups of the first ``n_keys`` columns (whole numbers) start, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(n_keys):
        values = table.column(i).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def tables_of_groups(batches: Iterator[pa.RecordBatch], n_keys: int, most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Tables of whole groups, many where they are small, with ``group_starts``; the input is sorted by the keys.

    A group of more than ``most`` rows may come in parts, tables without starts, so that it is never held.
    """
    held: list[pa.RecordBatch] = []
    long = None
    key_at = lambda batch, row: [batch.column(i)[row].as_py() for i in range(n_keys)]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if long is not None:
            same = np.logical_and.reduce([batch.column(i).to_numpy() == long[i] for i in range(n_keys)])
            n = int(same.sum())
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), None
            if n == batch.num_rows:
                continue
            long, batch = None, batch.slice(n)
        held.append(batch)
        here = key_at(batch, 0)
        if key_at(batch, batch.num_rows - 1) != here or key_at(held[0], 0) != here:
            table = pa.Table.from_batches(held)
            starts = group_starts(table, n_keys)
            if len(starts) > 2:
                yield table.slice(0, starts[-2]), starts[:-1]
            held = table.slice(starts[-2]).to_batches()
        if most is not None and sum(b.num_rows for b in held) > most:
            long = key_at(held[0], 0)
            yield pa.Table.from_batches(held), None
            held = []
    if held:
        table = pa.Table.from_batches(held)
        yield table, group_starts(table, n_keys)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """One table for each group of rows that agree in the first ``n_keys`` columns; the input is sorted by them."""
    for table, starts in tables_of_groups(batches, n_keys):
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of doubles as rows of ``width`` numbers; null lists and null numbers are 0."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    given = np.asarray(lists.is_valid())
    if (sizes[given] != width).any():
        raise ValueError(f"vectors of {width} numbers are expected")
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out[given] = np.nan_to_num(flat, nan=0.0).reshape(-1, width) if lists.flatten().null_count else flat.reshape(-1, width)
    return out


def vectors(rows: np.ndarray) -> pa.ListArray:
    """Rows of numbers as a list column of doubles."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows, float).ravel()))
