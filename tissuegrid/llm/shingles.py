"""Near copies of event texts by the share of word shingles they have in common.

A text is the set of its runs of five words. Texts are near if the Jaccard similarity of
their sets is 0.8 or more:

1. Texts of equal sets are one row. Of 48 minimum hashes, three at a time make a key;
   two sets of similarity s agree in one of the sixteen keys with a probability of
   1 - (1 - s^3)^16, which is 0.99999 at 0.8 and more above.
2. Keys under which the same sets meet are one meeting place. Only sets that meet another
   carry their text there, in tiles of bounded size.
3. In a tile, the table of Jaccard distances of its sets to a few of them (pivots) discards
   pairs: Jaccard distance is a metric, so the distances of near sets to any pivot differ by a fifth at
   most, and the largest coordinate difference decides. No near pair is lost by that.
4. Survivors are verified on the shingle sets themselves, so no unlike pair is linked; a tile
   reports a spanning forest of its links, never all pairs.

The steps are those of ``simhash``, with sets and their metric in place of fingerprints and bits. With ``fingerprints``
the links of ``simhash`` itself, which sees how often a run of words repeats, are added to them.

It works on the ``event`` text of log records or any other text column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import star_components
from ..session import cut
from .simhash import fingerprint, near_links
from .texts import bytes_of, map_texts
from .tiles import Forest, groups, tiled

SHINGLE = 5
# least similarity of near texts as a fraction, so that the comparison is exact
NEAR = (4, 5)
BANDS, ROWS = 16, 3
N_PIVOTS = 8
_PIECE = 1 << 12
_SALTS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; a shorter text is one run, a wordless one none.

    Words are runs free of ASCII white space, A-Z lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    k = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(body[a:b], 42) for a, b in spans], np.uint64))


def is_near(x: np.ndarray, y: np.ndarray) -> bool:
    num, den = NEAR
    if min(x.size, y.size) * den < max(x.size, y.size) * num:
        return False
    shared = np.intersect1d(x, y, assume_unique=True).size
    return shared * den >= (x.size + y.size - shared) * num


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of a set that is not empty."""
    salt, odd = _SALTS[0], _SALTS[1] | np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, found.size, _PIECE):
        mixed = (found[at : at + _PIECE, None] ^ salt) * odd
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _marks(events: DataFrame, id_col: str, text_col: str, fingerprints: bool) -> DataFrame:
    """``(id_col, _text_hash, _s, _keys)``: number of the shingle set, 0 if it is empty, and its keys; and ``_fp`` if asked for."""

    def make():
        def work(bodies):
            numbers, keys = [], []
            signs = [np.array([fingerprint(b) for b in bodies], np.uint64).view(np.int64)] if fingerprints else []
            for body in bodies:
                found = shingles(body)
                number = xxhash.xxh64_intdigest(found.tobytes(), 7) | 1 if found.size else 0
                numbers.append(number - (1 << 64) if number >> 63 else number)
                keys.append(band_keys(found).tolist() if found.size else [])
            return [numbers, keys, *signs]

        return work

    kept = [id_col, F.xxhash64(text_col).alias("_text_hash")]
    fields = [("_s", "long"), ("_keys", "array<long>"), *([("_fp", "long")] if fingerprints else [])]
    return map_texts(events, kept, text_col, fields, make)


def pivot_table(sets: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Jaccard distance of every set to the pivots of its tile, one row per pivot.

    Pivots are the first sets of a tile, which stand there by hash; what a small tile lacks is zero and discards nothing.
    """
    sizes = np.array([x.size for x in sets], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate(sets)
    table = np.zeros((N_PIVOTS, len(sets)))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        low = ends[a] - sizes[a]
        here, size, stop = flat[low : ends[b - 1]], sizes[a:b], ends[a:b] - low
        for k in range(min(N_PIVOTS, b - a - 1)):
            pivot = sets[a + k]
            if pivot.size:
                hit = pivot[np.minimum(np.searchsorted(pivot, here), pivot.size - 1)] == here
                upto = np.r_[0, np.cumsum(hit)]
                shared = upto[stop] - upto[stop - size]
            else:
                shared = np.zeros(b - a, np.int64)
            table[k, a:b] = 1 - shared / np.maximum(size + pivot.size - shared, 1)
    return table


def tile_links(sets: list[np.ndarray], block: np.ndarray, starts: np.ndarray, cross: np.ndarray) -> Forest:
    """Forest of near pairs inside tiles that stand one after the other; ``cross`` as in ``simhash.tile_links``."""
    n = len(sets)
    table = pivot_table(sets, starts)
    # a little more than a fifth, as quotients are rounded
    radius = 1 - NEAR[0] / NEAR[1] + 1e-9
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
            a = a[np.abs(row[a] - row[a + shift]) <= radius]
        a = a[[is_near(sets[i], sets[i + shift]) for i in a.tolist()]] if a.size else a
        if a.size:
            forest.add(a, a + shift)


def _links(events: DataFrame, codes: DataFrame, text_col: str) -> DataFrame:
    """Edges ``(a, b)`` between numbers of sets that connect all near ones that meet."""
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = codes.select("_s", F.posexplode("_keys").alias("k", "v"))
    places = (
        rows.groupBy("k", "v")
        .agg(
            F.count("*").alias("_n"),
            F.bit_xor(F.xxhash64("_s")).alias("_g"),
            F.bit_xor(F.xxhash64(F.lit(1), "_s")).alias("_h"),
        )
        .where("_n > 1")
    )
    members = cut(rows.join(places, ["k", "v"]).select("_g", "_h", "_s").distinct(), "meetings")
    wanted = cut(codes.join(members.select("_s").distinct(), "_s").select("_s", "_text_hash"), "wanted")
    texts = (
        events.select(F.xxhash64(text_col).alias("_text_hash"), bytes_of(text_col).alias("_body"))
        .join(wanted, "_text_hash")
        .select("_s", "_body")
        .dropDuplicates(["_s"])
    )
    carried = members.join(cut(texts, "near-texts"), "_s")
    met = tiled(carried, ["_g", "_h"], F.xxhash64("_s"), parts).select("_g", "_h", "_ti", "_tj", "_block", "_s", "_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, 4):
            cross = table.column("_ti").to_numpy() != table.column("_tj").to_numpy()
            sets = [shingles(body) for body in table.column("_body").to_pylist()]
            forest = tile_links(sets, table.column("_block").to_numpy(), starts, cross)
            if forest.edges:
                numbers = table.column("_s").to_numpy()
                a, b = (numbers[list(x)] for x in zip(*forest.edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _fingerprint_links(marked: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between numbers of sets whose texts have near fingerprints; a fingerprint stands for its least set."""
    seen = cut(marked.select("_fp", "_s").distinct(), "fingerprints")
    named = cut(seen.groupBy("_fp").agg(F.min("_s").alias("_least")), "codes")
    same = seen.join(named, "_fp").select(F.col("_s").alias("a"), F.col("_least").alias("b"))
    links = near_links(named.select("_fp"))
    for end in ("a", "b"):
        links = links.withColumnRenamed(end, "_fp").join(named, "_fp").withColumnRenamed("_least", end).drop("_fp")
    return same.where("a <> b").unionByName(links.select("a", "b"))


def _rooted(events: DataFrame, id_col: str, text_col: str, fingerprints: bool) -> tuple[DataFrame, DataFrame]:
    """Marks of all rows and the least set ``_root`` that each set ``_s`` is linked to."""
    marked = cut(_marks(events, id_col, text_col, fingerprints), "shingles")
    codes = cut(marked.groupBy("_s").agg(F.min("_text_hash").alias("_text_hash"), F.first("_keys").alias("_keys")), "sets")
    links = _links(events, codes, text_col)
    roots = star_components(links.unionByName(_fingerprint_links(marked)) if fingerprints else links)
    rooted = codes.join(roots, codes["_s"] == roots["label"], "left").select("_s", F.coalesce("root", "_s").alias("_root"))
    return marked.select(id_col, "_text_hash", "_s"), cut(rooted, "rooted")


def near_groups(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event", fingerprints: bool = False) -> DataFrame:
    """``(id_col, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links, itself included; null, empty and
    wordless texts are linked to each other. A null id is never the smallest. Rows that repeat an id or a text are
    rows of their own in the same component. ``fingerprints`` links what ``simhash`` links too.
    """
    marked, rooted = _rooted(events, id_col, text_col, fingerprints)
    named = cut(marked.join(rooted, "_s").select(id_col, "_root"), "components")
    least = named.groupBy("_root").agg(F.min(id_col).alias("component_id"))
    return named.join(least, "_root").select(id_col, "component_id")


def keep_one(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event", fingerprints: bool = False) -> DataFrame:
    """Of each near group the row of least id and then of least text hash, with all columns.

    Rows that repeat an id and a text are one. Rows with a null id cannot be told apart and stay. Groups are those of ``near_groups``.
    """
    marked, rooted = _rooted(events, id_col, text_col, fingerprints)
    pick = F.min(F.when(F.col(id_col).isNotNull(), F.struct(id_col, "_text_hash"))).alias("_pick")
    first = marked.join(rooted, "_s").groupBy("_root").agg(pick).where("_pick IS NOT NULL")
    first = first.select(F.col("_pick")[id_col].alias(id_col), F.col("_pick._text_hash").alias("_text_hash"))
    # a struct keeps any column name apart from ours
    row = F.struct(*[F.col(c) for c in events.columns]).alias("_row")
    rows = events.where(F.col(id_col).isNotNull()).select(row, F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_u"))
    named = rows.join(first.select(F.col(id_col).alias("_i"), F.col("_text_hash").alias("_u")), ["_i", "_u"], "left_semi")
    return named.dropDuplicates(["_i", "_u"]).select("_row.*").unionByName(events.where(F.col(id_col).isNull()))
