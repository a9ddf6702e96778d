"""Document fingerprints: quartile bucket digests of event texts.

Byte triplets of every five-byte window are hashed into 256 buckets. A bucket's count
becomes two bits by the quartile it falls in, so the digest says which triplets are
common, not how long the text is; a logarithmic length and a checksum byte stand in
front. Two digests differ by the sum of their bucket distances (a jump over all four
quartiles counts six) and of their lengths' distance, which is bounded, so that the
difference maps to a likeness of 0 to 1.

It works on the ``event`` text of log records or any other text column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .texts import bytes_of, map_texts

BUCKETS = 256
WINDOW = 5
# places of a triplet inside a window; the first byte is always one of them
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
LENGTH_CAP = 48
WORST = 6 * BUCKETS // 2 + LENGTH_CAP
_PIECE = 1 << 20


def _bucket_counts(text: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(text) - WINDOW + 1), _PIECE):
        part = np.frombuffer(text, np.uint8, count=min(_PIECE + WINDOW - 1, len(text) - at), offset=at).astype(np.uint32)
        n = part.size - WINDOW + 1
        # one odd multiplier for each place
        by = [part[k : k + n] * np.uint32(m) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))]
        for salt, (i, j, k) in enumerate(TRIPLETS):
            mixed = by[i] + by[j] + by[k] + np.uint32(0x3C6EF372 * (salt + 1) & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: bytes) -> str:
    """Hex of a length byte, a checksum byte and 64 bytes of quartile codes. Equal texts, equal digests.

    Texts under five bytes have no window; length and checksum alone tell them apart.
    """
    counts = _bucket_counts(text)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    length = min(255, round(8 * np.log2(1 + len(text))))
    check = int(np.frombuffer(text, np.uint8).sum(dtype=np.int64)) % 256
    return bytes([length, check]).hex() + packed.tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[0]), ((raw[2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).astype(np.int8).ravel()


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``WORST``."""
    if a == b:
        return 0
    (n, x), (m, y) = _codes(a), _codes(b)
    d = np.abs(x - y)
    total = int(d.sum()) + 3 * int((d == 3).sum()) + min(LENGTH_CAP, abs(n - m))
    return min(WORST, max(1, total))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / WORST


def fingerprint_events(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event") -> DataFrame:
    """``(id_col, fingerprint string)``, one row per input row; a null text counts as empty."""

    def make():
        return lambda bodies: [[digest(b) for b in bodies]]

    return map_texts(events, [id_col], text_col, [("fingerprint", "string")], make)


def _edited(text: str, donor: str) -> str:
    """The last quarter of ``text`` replaced by as much of the front of ``donor``."""
    q = len(text) // 4
    return text[: len(text) - q] + donor[:q]


def _edge_rows(events: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows ``(_b, _halo, _id, _text)`` by range of id; the first id of a range also closes the one before.

    Only the ranges' first ids, at most ``parts`` of them, reach the driver.
    """
    rows = events.select(F.col(id_col).alias("_id"), bytes_of(text_col).alias("_text"))
    ids = rows.select("_id")
    ranged = cut(ids.repartitionByRange(parts, "_id").select("_id", F.spark_partition_id().alias("_b")), "ranges")
    firsts = sorted((r[0], r[1]["_id"]) for r in ranged.groupBy("_b").agg(F.min(F.struct("_id")).alias("f")).collect())
    kind = rows.schema["_id"].dataType
    bounds = F.array(*[F.lit(v).cast(kind) for _, v in firsts[1:]]) if len(firsts) > 1 else F.array().cast(T.ArrayType(kind))
    bucket = F.size(F.filter(bounds, lambda x: x <= F.col("_id")))
    ends = [(v, (i - 1) % len(firsts)) for i, (_, v) in enumerate(firsts)]
    schema = T.StructType().add("_first", kind).add("_before", T.IntegerType())
    halo = F.broadcast(events.sparkSession.createDataFrame(ends, schema))
    places = F.array(
        F.struct(bucket.alias("_b"), F.lit(0).alias("_halo")), F.struct(F.col("_before").alias("_b"), F.lit(1).alias("_halo"))
    )
    return (
        rows.join(halo, F.col("_id").eqNullSafe(F.col("_first")), "left")
        .select("_id", "_text", F.explode(F.filter(places, lambda p: p["_b"].isNotNull())).alias("_p"))
        .select("_p._b", "_p._halo", "_id", "_text")
        .repartition(parts, "_b")
        .sortWithinPartitions("_b", "_halo", "_id", "_text")
    )


def compare_with_next(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event") -> DataFrame:
    """How like a text's digest is to an edited version's and to its successor's.

    The successor is the next row by ascending id (nulls first, equal ids by text); the
    first row follows the last. The edited text has its last quarter of code points
    replaced by as many from the successor's front, or all it has. Returns ``(id_col,
    n_chars long, edited binary, fingerprint, edited_fingerprint string, near_edited,
    near_next double)``, one row per input row; a null text counts as empty.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = events.schema[id_col].dataType
    schema = T.StructType().add(id_col, kind)
    for name, t in (
        ("n_chars", "long"),
        ("edited", "binary"),
        ("fingerprint", "string"),
        ("edited_fingerprint", "string"),
        ("near_edited", "double"),
        ("near_next", "double"),
    ):
        schema = schema.add(name, t)
    if events.select(id_col).isEmpty():
        return events.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: list[tuple] = []
        size = 0
        before = None  # bucket, id, text, fingerprint of the row that waits for its successor
        for batch in batches:
            for b, halo, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is None and halo:
                    continue
                text, mark = body.decode("utf-8", "replace"), digest(body)
                if before is not None:
                    _, k, t, m = before
                    edited = _edited(t, text).encode()
                    other = digest(edited)
                    held.append((k, len(t), edited, m, other, likeness(m, other), likeness(m, mark)))
                    size += len(edited)
                before = None if halo else (b, key, text, mark)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], arrow)

    return _edge_rows(events, id_col, text_col, parts).mapInArrow(run, schema)
