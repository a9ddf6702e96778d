"""Near-duplicate tiles by rotated binary codes with correction factors.

A tile's feature vector is scaled to length one and turned by random rotations. The signs
of the first rotation are its binary code; beside it stands the inner product of the
vector with its own code, which corrects estimates: code of x times rotated y, divided by
that factor, is an unbiased estimate of the inner product of x and y, with an error
bound that shrinks with the square root of the code's length.

1. Tiles of one group (a slide, or any label) meet if they agree in a band of sign bits.
   The number of bands follows from the share of pairs at the threshold that must meet.
2. Where they meet, estimates and their confidence bounds decide which pairs are
   recomputed exactly; only pairs whose upper bound misses the threshold are passed over.
3. What is recomputed and reaches the threshold is a link, counted in the first band
   that the pair shares. A meeting place reports counts and a spanning forest, no pairs.

Equal vectors of a group are one row before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import star_components
from ..session import cut
from .texts import remembered
from .tiles import Forest, groups, tiled

TURN = 256
SURE = 6.0
_PAIRS = 200_000


@remembered
def rotation(dim: int, turn: int) -> np.ndarray:
    """The first ``dim`` columns of the ``turn``-th random rotation, at least ``TURN`` bits wide."""
    width = max(TURN, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(1000 + turn).standard_normal((width, width)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])


def banding(n_rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands: about one stranger per band, ``recall`` at the threshold."""
    bits = max(8, min(60, math.ceil(math.log2(max(2, n_rows)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that tiny and huge components neither vanish nor overflow
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def band_signs(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Sign bits of every row by band, from as many rotations as needed."""
    need, found, turn = bits * bands, [], 0
    while sum(f.shape[1] for f in found) < need:
        found.append(unit @ rotation(unit.shape[1], turn).T > 0)
        turn += 1
    return np.concatenate(found, axis=1)[:, :need].reshape(len(unit), bands, bits)


def band_keys(signs: np.ndarray) -> np.ndarray:
    """One whole number per row and band."""
    return signs.astype(np.int64) @ (np.int64(1) << np.arange(signs.shape[2], dtype=np.int64))


def first_band(packed: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """First band in which rows i and j agree; ``packed`` holds the sign bits of a row as bytes."""
    out = np.empty(i.size, np.int64)
    for at in range(0, i.size, 10_000):
        a, b = i[at : at + 10_000], j[at : at + 10_000]
        apart = np.unpackbits(packed[a] ^ packed[b], axis=1, count=bits * bands).reshape(a.size, bands, bits).any(axis=2)
        out[at : at + a.size] = (~apart).argmax(axis=1)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy().astype(np.float64)
    return values.reshape(len(flat), -1)


def tile_links(unit: np.ndarray, cross: np.ndarray | None, threshold: float):
    """Links ``(i, j)`` inside one meeting place, in chunks.

    ``cross`` holds the rows' blocks if only pairs of different blocks count.
    """
    turned = unit @ rotation(unit.shape[1], 0).T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(turned.shape[1])
    factor = np.einsum("ij,ij->i", code, turned)
    bound = SURE * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(turned.shape[1] - 1)
    n = len(unit)
    rows = max(1, _PAIRS // n)
    for at in range(0, n, rows):
        part = slice(at, min(n, at + rows))
        estimate = (code[part] @ turned.T) / factor[part, None]
        maybe = estimate + bound[part, None] >= threshold
        i, j = np.nonzero(maybe)
        i = i + at
        keep = i < j
        if cross is not None:
            keep &= cross[i] != cross[j]
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        yield i[exact], j[exact]


def near_tiles(
    tiles: DataFrame,
    *,
    id_col: str = "tile_id",
    group_col: str = "slide_id",
    vector_col: str = "features",
    threshold: float = 0.93,
    recall: float = 0.999,
) -> DataFrame:
    """``(id_col, n_links long, component_id, kept boolean)``, one row per input row.

    Two rows are linked if their groups are equal and not null, their vectors of equal
    width, and the cosine in double precision is ``threshold`` or more. Vectors that are
    null, empty or zero, or hold null or non-finite components, link with nothing, nor
    do rows with a null id; these are their own component. ``n_links`` counts other
    rows, copies included; ``component_id`` is the least id reachable; ``kept`` marks the
    row that has that id (rows that repeat an id with it are all marked).

    ``recall`` is the share of pairs exactly at the threshold that meet; closer pairs
    meet more surely.
    """
    spark = tiles.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = tiles.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    # single precision travels as it is and is computed in double
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.col("_id").isNotNull() & F.col("_g").isNotNull() & F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0)
    rows = tiles.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_g"), vector.alias("_v"))
    # group and 96 bits of the vector's content name it from here on
    named = cut(
        rows.withColumn("_ok", F.coalesce(sound, F.lit(False))).select(
            "_id", "_ok", "_v", F.xxhash64("_g", F.size("_v")).alias("_s"), F.xxhash64("_g", "_v").alias("_h"), F.hash("_v").alias("_m")
        ),
        "vectors",
    )
    content = ["_s", "_h", "_m"]
    kinds = cut(
        named.where("_ok").groupBy(*content).agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"), F.first("_v").alias("_v")),
        "distinct-vectors",
    )
    n_rows = kinds.count()
    bits, bands = banding(n_rows, threshold, recall)
    kind = T.StructType([T.StructField("_s", T.LongType()), T.StructField("_h", T.LongType()), T.StructField("_m", T.IntegerType())])

    def by_width(batch: pa.RecordBatch, column: str):
        width = batch.column(column).value_lengths().to_numpy()
        for w in np.unique(width):
            yield pa.Table.from_batches([batch.filter(pa.array(width == w))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for t in by_width(batch.slice(at, 512), "_v"):
                    signs = band_signs(_unit(_matrix(t.column("_v"))), bits, bands)
                    keys, packed = band_keys(signs), np.packbits(signs.reshape(len(signs), -1), axis=1)
                    cols = [t.column(c).combine_chunks() for c in content]
                    cols.append(pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel()))
                    cols.append(pa.array([row.tobytes() for row in packed], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=[*content, "_bands", "_signs"])

    sketch_type = T.StructType(kind.fields).add("_bands", T.ArrayType(T.LongType())).add("_signs", "binary")
    sketches = cut(kinds.select(*content, "_v").mapInArrow(sketch, sketch_type), "sketches")
    keyed = sketches.select(*content, F.posexplode("_bands").alias("_band", "_key"))
    met = tiled(keyed, ["_s", "_band", "_key"], F.col("_h"), parts)
    # only rows with a partner carry their vectors along
    place = ["_s", "_band", "_key", "_ti", "_tj"]
    body = kinds.join(sketches, content).select("_h", "_m", F.col("_s").alias("_s0"), "_rep", "_copies", "_v", "_signs")
    met = met.withColumnsRenamed({"_h": "_h1", "_m": "_m1"})
    full = (
        met.join(body, (F.col("_h1") == F.col("_h")) & (F.col("_m1") == F.col("_m")) & (F.col("_s") == F.col("_s0")))
        .select(*place, "_block", "_h", "_m", "_rep", "_copies", "_v", "_signs")
        .repartition(parts, *place)
        .sortWithinPartitions(*place, "_block")
    )
    out = T.StructType().add("_rep", named.schema["_id"].dataType).add("_other", named.schema["_id"].dataType)
    out = out.add("_s", "long").add("_h", "long").add("_m", "integer").add("_links", "long")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for table, starts in groups(batches, len(place)):
            n = table.num_rows
            copies = table.column("_copies").to_numpy()
            block, cross = table.column("_block").to_numpy(), table.column("_ti").to_numpy() != table.column("_tj").to_numpy()
            band = table.column("_band").to_numpy()
            counts, forest = np.zeros(n, np.int64), Forest(n)
            for a, b in zip(starts, starts[1:]):
                if b - a < 2:
                    continue
                own = table.slice(a, b - a)
                unit = _unit(_matrix(own.column("_v")))
                packed = np.frombuffer(b"".join(own.column("_signs").to_pylist()), np.uint8).reshape(b - a, -1)
                for i, j in tile_links(unit, block[a:b] if cross[a] else None, threshold):
                    # other bands in which a pair meets count it no more
                    here = first_band(packed, i, j, bits, bands) == band[a]
                    i, j = i[here], j[here]
                    np.add.at(counts, a + i, copies[a + j])
                    np.add.at(counts, a + j, copies[a + i])
                    forest.add(a + i, a + j)
            hit = np.flatnonzero(counts)
            if not hit.size:
                continue
            take = lambda c, at: table.column(c).take(pa.array(at)).combine_chunks()
            reps = pa.array([None] * hit.size, arrow.field("_other").type)
            cols = [take("_rep", hit), reps, *(take(c, hit) for c in content), pa.array(counts[hit])]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
            a, b = (np.array(x) for x in zip(*forest.edges, strict=True))
            cols = [take("_rep", a), take("_rep", b), *(take(c, a) for c in content), pa.array(np.zeros(a.size, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    found = cut(full.mapInArrow(link, out), "links")
    roots = star_components(found.where("_other is not null").select(F.col("_rep").alias("a"), F.col("_other").alias("b")))
    links = found.groupBy(*content).agg(F.sum("_links").alias("_links"))
    solved = (
        kinds.select(*content, "_rep", "_copies")
        .join(links, content, "left")
        .join(roots, F.col("_rep") == F.col("label"), "left")
        .select(
            *content,
            (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
            F.coalesce("root", "_rep").alias("component_id"),
            F.lit(True).alias("_sound"),
        )
    )
    alone = named.where(~F.col("_ok")).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    linked = named.where("_ok").select("_id", *content).join(solved, content).select("_id", "n_links", "component_id")
    return linked.unionByName(alone).select(
        F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
