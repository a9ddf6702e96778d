"""Removal of long repeats from event texts by prefix doubling over sampled positions.

A byte goes if a string of ``span`` bytes that covers it starts anywhere else as well. A
row for every byte would be many times the corpus, so ranks are kept for samples:

1. Every window of ``span`` bytes has an anchor, its leftmost 64-byte string of least
   hash. Equal windows have equal anchors at equal offsets, so windows of different
   anchors never need to meet. Windows in a row that share an anchor form a run.
2. First rank: the anchor. Second rank: the whole run with all bytes under its windows.
   A run that occurs twice is repeated throughout. An anchor whose runs are all unique
   and alone is done with: unique ranks drop out, and most of a corpus with them.
3. What is left, runs that differ somewhere but share an anchor (they lie at the ends
   of repeats), is placed and sorted by anchor. There ranks double from a quarter of
   the span to half to the whole, as pairs of the ranks at a position and at the growing
   offset behind it; positions whose rank is unique drop out at each step.
4. An anchor with more such runs than one task should hold takes the same last rank
   through an aggregation over windows instead, so no group is gathered whole.

It works on the ``event`` text of log records or any other text column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .texts import bytes_of, chunks, map_texts, remembered
from .tiles import groups

GRAM = 64
PIECE = 1 << 19
GROUP_ROWS = 4096
_LOW = (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C15


@remembered
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random odd value of each byte; powers of the base and of its inverse modulo 2**64."""
    values = np.random.default_rng(77).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    power = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        a = np.full(2 * PIECE, base, np.uint64)
        a[0] = 1
        power.append(np.cumprod(a))
    return values, *power


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(text: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position of at most ``2 * PIECE`` bytes."""
    values, power, inverse = _tables()
    total = np.zeros(text.size + 1, np.uint64)
    np.cumsum(values[text] * power[: text.size], out=total[1:])
    return _mix((total[width:] - total[:-width]) * inverse[: text.size - width + 1])


def runs(text: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor place and anchor hash of each run of a piece."""
    grams = hashes(text, GRAM)
    m, wide = grams.size, span - GRAM + 1
    # least hash first, then leftmost; the place is kept in the low bits
    marked = np.full(-(-m // wide) * wide, ~np.uint64(0))
    marked[:m] = (grams & ~np.uint64(_LOW)) | np.arange(m, dtype=np.uint64)
    block = marked.reshape(-1, wide)
    from_left = np.minimum.accumulate(block, axis=1).ravel()
    to_right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - wide + 1
    place = (np.minimum(to_right[:n], from_left[wide - 1 : wide - 1 + n]) & np.uint64(_LOW)).astype(np.int64)
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.r_[0, change]
    return first, np.r_[change, n] - 1, place[first], grams[place[first]]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; touching ones join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def text_runs(body: bytes, span: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Distinct runs ``(anchor, lo, hi, hash, hash, copies, start)`` of a text, and spans of runs it repeats.

    ``lo`` and ``hi`` bound the anchor's offset in the run's windows; ``start`` is the first window.
    """
    found, where = Counter(), {}
    twice: list[tuple[int, int]] = []
    for at in range(0, len(body) - span + 1, PIECE):
        piece = np.frombuffer(body, np.uint8, count=min(len(body) - at, PIECE + span - 1), offset=at)
        for a, z, p, g in zip(*(x.tolist() for x in runs(piece, span)), strict=True):
            low, high = divmod(xxhash.xxh3_128_intdigest(body[at + a : at + z + span]), 1 << 64)
            key = (g, p - z, p - a, low, high)
            found[key] += 1
            if found[key] == 1:
                where[key] = at + a
            else:
                if found[key] == 2:
                    twice.append((where[key], where[key] + z - a + span))
                twice.append((at + a, at + z + span))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(k[0]), k[1], k[2], signed(k[3]), signed(k[4]), n, where[k]) for k, n in found.items()]
    return rows, _union(twice)


def _window_ranks(texts: list[bytes], widths: np.ndarray, quarter: int) -> tuple[np.ndarray, ...]:
    """Owner and offset of every window, and its quarter, half and full rank."""
    owner, offset, ranks = [], [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        joined = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
        quarters = hashes(joined, quarter)
        starts = np.cumsum([0] + [len(t) for t in texts[at : stop - 1]])
        n = widths[at:stop]
        own = np.repeat(np.arange(at, stop), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(starts, n) + off
        owner.append(own)
        offset.append(off)
        ranks.append([quarters[pos + k * quarter] for k in range(4)])
        at = stop
    q = [np.concatenate(x) for x in zip(*ranks, strict=True)]
    return np.concatenate(owner), np.concatenate(offset), q


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0xA24BAED4963EE407) + _mix(b + np.uint64(0x9FB21C651E98DF25)))


def _shared(rank: np.ndarray) -> np.ndarray:
    """True where a rank occurs more than once."""
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    out = np.zeros(rank.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_windows(texts: list[bytes], widths: np.ndarray, anchors: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of windows of ``span`` bytes that two or more of the given runs have.

    Run i has ``widths[i]`` windows; runs of one anchor must all be given.
    """
    owner, offset, (q0, q1, q2, q3) = _window_ranks(texts, widths, span // 4)
    rank = _pair(anchors[owner], q0)
    keep = _shared(rank)
    rank, owner, offset, q1, q2, q3 = (x[keep] for x in (rank, owner, offset, q1, q2, q3))
    rank = _pair(rank, q1)
    keep = _shared(rank)
    rank, owner, offset, q2, q3 = (x[keep] for x in (rank, owner, offset, q2, q3))
    rank = _pair(rank, _pair(q2, q3))
    keep = _shared(rank)
    return owner[keep], offset[keep]


def remove_repeats(events: DataFrame, *, id_col: str = "event_id", text_col: str = "event", span: int = 400) -> DataFrame:
    """``(id_col, n_bytes long, n_removed long, n_spans long, n_kept long, kept binary)``, one row per input row.

    Texts are UTF-8 bytes (null: empty); no match crosses texts. A byte is removed if it
    lies in a string of ``span`` bytes that also starts anywhere else, in the same text
    or another, overlapping or not, judged on the input. ``n_spans`` counts maximal
    removed runs; ``kept`` is what remains, in order. Repeated rows are repeats of each
    other. ``span`` must be a multiple of four and at least 256.
    """
    if span % 4 or span < 256:
        raise ValueError("span must be a multiple of four, 256 or more")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(id_col).alias("_id"), bytes_of(text_col).alias("_body"))
    rows = rows.withColumn("_t", F.xxhash64("_body"))
    name = ["_id", "_t"]

    def scan():
        def work(bodies):
            found = [text_runs(b, span) for b in bodies]
            return [[dict(zip("glhabns", r)) for r in runs_] for runs_, _ in found], [[list(s) for s in spans] for _, spans in found]

        return work

    run_type = "array<struct<g:bigint,l:int,h:int,a:bigint,b:bigint,n:int,s:int>>"
    scanned = cut(map_texts(rows, name, "_body", [("_runs", run_type), ("_twice", "array<array<int>>")], scan), "runs")
    kind = ["g", "l", "h", "a", "b"]
    seen = scanned.select(*name, F.inline("_runs"))
    ranked = cut(
        seen.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(*name, "s")).alias("_at")), "run-ranks"
    )
    own = scanned.select(*name, F.explode("_twice").alias("_s")).select(*name, F.col("_s")[0].alias("_from"), F.col("_s")[1].alias("_to"))
    end = F.col("s") + F.col("h") - F.col("l") + span
    whole = seen.join(ranked.where("n > 1").select(*kind), kind).select(*name, F.col("s").alias("_from"), end.alias("_to"))
    # anchors with different runs of which one at least is alone
    open_anchors = ranked.groupBy("g").agg(F.count("*").alias("_m"), F.min("n").alias("_least")).where("_m > 1 and _least = 1")
    live = (
        ranked.join(open_anchors.select("g", "_m"), "g")
        .select("_at.*", "g", "l", "h", "n", "_m")
        .groupBy(F.col("_id").alias("_i"), F.col("_t").alias("_u"))
        .agg(F.collect_list(F.struct("g", "l", "h", "n", "_m", "s")).alias("_live"))
    )
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u"))
    wanted = rows.join(live, same).dropDuplicates(name).select(*name, "_live", "_body")
    cut_type = T.StructType([rows.schema["_id"], T.StructField("_t", T.LongType())])
    for field, t in (("s", "integer"), ("g", "long"), ("l", "integer"), ("h", "integer"), ("n", "long"), ("_m", "long"), ("_text", "binary")):
        cut_type = cut_type.add(field, t)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(cut_type)
        for batch in batches:
            ids, marks, lives, bodies = batch.columns
            out, size = [], 0
            for i in range(batch.num_rows):
                body, key, mark = bodies[i].as_py(), ids[i].as_py(), marks[i].as_py()
                for r in lives[i].as_py():
                    text = body[r["s"] : r["s"] + r["h"] - r["l"] + span]
                    out.append((key, mark, r["s"], r["g"], r["l"], r["h"], r["n"], r["_m"], text))
                    size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, o)) for o in out], arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, o)) for o in out], arrow)

    pieces = cut(wanted.mapInArrow(slices, cut_type), "run-texts")
    span_type = T.StructType([rows.schema["_id"], T.StructField("_t", T.LongType())]).add("_from", "integer").add("_to", "integer")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(span_type)
        for table, starts in groups(batches, 1):
            # whole anchors together, as many as make a piece
            lo = 0
            while lo < len(starts) - 1:
                hi = lo + 1
                while hi < len(starts) - 1 and starts[hi + 1] - starts[lo] <= GROUP_ROWS:
                    hi += 1
                part = table.slice(starts[lo], starts[hi] - starts[lo])
                lo = hi
                found = _resolve(part, span)
                if found is not None:
                    yield pa.RecordBatch.from_arrays(found, schema=arrow)

    cols = ["g", "_id", "_t", "s", "l", "h", "n", "_text"]
    small = pieces.where(F.col("_m") <= GROUP_ROWS).select(*cols).repartition(parts, "g").sortWithinPartitions("g")
    ends = small.mapInArrow(resolve, span_type)
    large = pieces.where(F.col("_m") > GROUP_ROWS).select(*cols)
    found = own.unionByName(whole).unionByName(ends)
    if not large.isEmpty():
        found = found.unionByName(_large_anchors(large, span, span_type))
    spans = found.groupBy(F.col("_id").alias("_i"), F.col("_t").alias("_u")).agg(
        F.collect_set(F.struct("_from", "_to")).alias("_spans")
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            ids, bodies, cuts = batch.columns
            out: list[list] = [[], [], [], [], []]
            for body, spans_ in zip(bodies.to_pylist(), cuts.to_pylist(), strict=True):
                gone = _union([(s["_from"], s["_to"]) for s in spans_ or ()])
                edges = [0, *(x for s in gone for x in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for o, x in zip(out, (len(body), len(body) - len(kept), len(gone), len(kept), kept), strict=True):
                    o.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(o, k) for o, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=result.names)

    result = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType)])
    for field, t in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("n_kept", "long"), ("kept", "binary")):
        result = result.add(field, t)
    return rows.join(spans, same, "left").select("_id", "_body", "_spans").mapInArrow(strip, result)


def _resolve(part: pa.Table, span: int) -> list[pa.Array] | None:
    texts = part.column("_text").to_pylist()
    first, low, high = (part.column(c).to_numpy().astype(np.int64) for c in ("s", "l", "h"))
    anchors = part.column("g").to_numpy().astype(np.int64).view(np.uint64)
    owner, offset = repeated_windows(texts, high - low + 1, anchors, span)
    alone = part.column("n").to_numpy()[owner] == 1  # others are removed whole already
    owner, offset = owner[alone], offset[alone]
    if not owner.size:
        return None
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(offset) != 1)) + 1
    a, b = np.r_[0, new], np.r_[new, owner.size] - 1
    rows = pa.array(owner[a])
    at = first[owner[a]]
    take = lambda c: part.column(c).take(rows).combine_chunks()
    return [take("_id"), take("_t"), pa.array((at + offset[a]).astype(np.int32)), pa.array((at + offset[b] + span).astype(np.int32))]


def _large_anchors(large: DataFrame, span: int, span_type: T.StructType) -> DataFrame:
    """Spans of repeated windows of anchors with very many runs: ranks meet in an aggregation."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s, low, high, n, g = (part.column(c).to_numpy().astype(np.int64) for c in ("s", "l", "h", "n", "g"))
                owner, offset, (q0, q1, q2, q3) = _window_ranks(part.column("_text").to_pylist(), high - low + 1, span // 4)
                rank = _pair(_pair(_pair(g.view(np.uint64)[owner], q0), q1), _pair(q2, q3))
                other = _pair(_pair(q3, q1), _pair(q0, q2))
                rows = pa.array(owner)
                cols = [part.column("_id").take(rows), part.column("_t").take(rows), part.column("g").take(rows)]
                cols += [pa.array(x) for x in (rank.view(np.int64), other.view(np.int64), (s[owner] + offset).astype(np.int32), n[owner])]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    schema = T.StructType(span_type.fields[:2]).add("g", "long").add("_rank", "long").add("_other", "long").add("_from", "integer").add("n", "long")
    windows = cut(large.mapInArrow(explode, schema), "windows")
    same = ["g", "_rank", "_other"]
    shared = windows.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").select(*same)
    found = windows.where("n = 1").join(shared, same).select("_id", "_t", "_from").distinct()
    # windows that follow each other are one span before a text's spans are collected
    run = F.col("_from") - F.row_number().over(Window.partitionBy("_id", "_t").orderBy("_from"))
    spans = found.withColumn("_run", run).groupBy("_id", "_t", "_run").agg(F.min("_from").alias("_from"), (F.max("_from") + span).alias("_to"))
    return spans.select("_id", "_t", "_from", "_to")
