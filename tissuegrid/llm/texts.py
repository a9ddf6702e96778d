"""Arrow passes over one text column, shared by the text operators.

The text operators work on the ``event`` text of structured log records (see
``sources.events``), keyed by ``event_id``; both names are parameters, so any table
of texts will do. Only the two named columns are read: further columns are ignored,
whatever their names. A null text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def remembered(make: Callable) -> Callable:
    """``make`` with its results kept for the life of a process, by arguments.

    Worker functions travel by value and must work where the package is not installed, so neither a wrapper that is
    pickled by reference nor the tables themselves may be part of them: what is kept hangs on ``sys``.
    """
    name = f"{make.__module__}.{make.__qualname__}"

    @functools.wraps(make)
    def get(*args):
        tables = sys.__dict__.setdefault("_tissuegrid_tables", {})
        if (name, args) not in tables:
            tables[name, args] = make(*args)
        return tables[name, args]

    return get


def bytes_of(text: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def chunks(batches: Iterator[pa.RecordBatch], size_of: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``CHUNK_BYTES`` in column ``size_of``; a longer row stands alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(size_of)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and held + n > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keep: Sequence[str | Column],
    text: str,
    fields: Sequence[tuple[str, str]],
    make: Callable[[], Callable[[list], list]],
    null_as_empty: bool = True,
) -> DataFrame:
    """``keep`` columns plus ``fields`` (name, type) worked out from whole texts.

    ``make()`` runs once per task and returns a function from a list of UTF-8 bytes to
    one sequence per field.
    """
    kept = [F.col(k) if isinstance(k, str) else k for k in keep]
    body = bytes_of(text) if null_as_empty else F.col(text).cast("binary")
    source = df.select(*kept, body.alias("_body"))
    n = len(kept)
    schema = T.StructType(source.schema.fields[:n])
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[n:]]
        work = make()
        for part in chunks(batches, n):
            made = work(part.column(n).to_pylist())
            cols = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names=names)

    return source.mapInArrow(run, schema)


def labelled_sample(
    labels: DataFrame, id_col: str, label_col: str, usable: Column, max_rows: int
) -> DataFrame:
    """At most ``max_rows`` rows ``(_id, _label)`` of smallest hash among ``usable`` ids with a label.

    The bound makes the broadcast of the result safe at any table size.
    """
    return (
        labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_rows)
    )


def bounded_sample(texts: DataFrame, chosen: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows ``(_id, _label, _text)`` of ``texts`` ``(_id, _text)`` whose id is in ``chosen``.

    Ids may repeat, so the bound holds after the join; the rows of least hash of id and text are kept.
    """
    joined = texts.join(F.broadcast(chosen), "_id")
    return joined.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_label").limit(max_rows).select("_id", "_label", "_text")


def words_of(text: bytes) -> set[str]:
    """Distinct lower-case letter runs."""
    return set(LETTERS.findall(text.decode("utf-8", "replace").lower()))
