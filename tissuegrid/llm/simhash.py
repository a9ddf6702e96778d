"""SimHash near-duplicates of event texts with pivot distance tables.

A text's shingles of four words vote on 64 bits. Texts are near if their fingerprints
differ in at most four bits. To find all such pairs:

1. Of six segments of a fingerprint, four flipped bits leave two untouched, so near pairs
   agree in at least one of fifteen pairs of segments. These are the keys under which
   fingerprints meet, in tiles of bounded size.
2. In a tile, the table of Hamming distances to many reference fingerprints (pivots)
   discards pairs: the distances of near fingerprints to any pivot differ by four at
   most, so the largest coordinate difference decides.
3. Survivors are verified by their own Hamming distance; a tile reports a spanning
   forest of its links, never all pairs.

Equal fingerprints are one row before anything is compared. It works on the ``event``
text of log records or any other text column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import star_components
from ..session import cut
from .texts import map_texts, remembered
from .tiles import Forest, groups, tiled

SHINGLE = 4
MAX_BITS = 4
N_PIVOTS = 32
SEGMENTS = (11, 11, 11, 11, 10, 10)
_PIECE = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash; words are runs free of ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    k = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(body[a:b], 42) for a, b in spans], ">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = hashes[at : at + _PIECE]
        votes += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint_events(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event") -> DataFrame:
    """``(id_col, _fp long)``: the fingerprint's bits as a signed number; null and wordless texts give 0."""

    def make():
        return lambda bodies: [np.array([fingerprint(b) for b in bodies], np.uint64).view(np.int64)]

    return map_texts(events, [id_col], text_col, [("_fp", "long")], make)


@remembered
def pivots() -> np.ndarray:
    """Reference fingerprints: rows of the Walsh matrix, which stand 32 bits apart from each other."""
    at = np.arange(64)
    rows = np.bitwise_count(at[1 : N_PIVOTS + 1, None] & at[None, :]) & 1
    return np.packbits(rows.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot, one row per pivot."""
    return np.bitwise_count(pivots()[:, None] ^ fps[None, :]).astype(np.int8)


def _keys():
    """(number, value) of the fifteen pairs of segments as one array column."""
    fields, low = [], 64
    for width in SEGMENTS:
        low -= width
        fields.append((F.shiftrightunsigned("_fp", low).bitwiseAND(F.lit((1 << width) - 1)), width))
    pairs = [
        F.struct(F.lit(k).alias("k"), F.shiftleft(x, m).bitwiseOR(y).alias("v"))
        for k, ((x, _), (y, m)) in enumerate(combinations(fields, 2))
    ]
    return F.array(*pairs)


def tile_links(fps: np.ndarray, block: np.ndarray, starts: np.ndarray, cross: np.ndarray) -> Forest:
    """Forest of near pairs inside tiles that stand one after the other.

    ``cross`` says by row whether its tile is of two blocks, whose own pairs have met elsewhere.
    """
    n = len(fps)
    table = pivot_table(fps)
    forest = Forest(n)
    stop = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(n)
    shift = 0
    while True:
        shift += 1
        at = at[at + shift < stop[at]]
        if not at.size:
            return forest
        a = at[(forest.label[at] != forest.label[at + shift]) & (~cross[at] | (block[at] != block[at + shift]))]
        for row in table:
            if not a.size:
                break
            a = a[np.abs(row[a] - row[a + shift]) <= MAX_BITS]
        a = a[np.bitwise_count(fps[a] ^ fps[a + shift]) <= MAX_BITS]
        if a.size:
            forest.add(a, a + shift)


def near_links(codes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``_fp`` that connect all near ones."""
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = codes.select("_fp", F.inline(_keys()).alias("k", "v"))
    met = tiled(rows, ["k", "v"], F.xxhash64("_fp"), parts).select("k", "v", "_ti", "_tj", "_block", "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, 4):
            fps = table.column("_fp").to_numpy().astype(np.int64).view(np.uint64)
            cross = table.column("_ti").to_numpy() != table.column("_tj").to_numpy()
            forest = tile_links(fps, table.column("_block").to_numpy(), starts, cross)
            if forest.edges:
                a, b = (fps[list(x)].view(np.int64) for x in zip(*forest.edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_groups(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event") -> DataFrame:
    """``(id_col, fingerprint string, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links, itself included; rows with
    equal fingerprints are linked, those of null, empty and wordless texts (zero) too. A
    null id is never the smallest; a group of null ids only has a null component.
    """
    marked = cut(fingerprint_events(events, id_col=id_col, text_col=text_col), "fingerprints")
    codes = cut(marked.groupBy("_fp").agg(F.min(id_col).alias("_least")), "codes")
    roots = star_components(near_links(codes))
    rooted = codes.join(roots, codes["_fp"] == roots["label"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    found = rooted.join(least, "_root").select("_fp", "component_id")
    return marked.join(found, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event") -> DataFrame:
    """Of each near group the row of least id, with all columns; of rows that repeat that id, any one.

    Rows with a null id cannot be told apart and stay.
    """
    first = near_groups(events, id_col=id_col, text_col=text_col).select(F.col("component_id").alias(id_col)).distinct()
    named = events.join(first, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(events.where(F.col(id_col).isNull()))
