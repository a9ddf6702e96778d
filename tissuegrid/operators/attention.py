"""Attention over the cells of patches or slides, with weights that are never rows.

A query's answer is a weighted mean of the values of all keys of its bag. It is kept as a
state of three parts for each head: the largest logit so far, the sum of exponentials below it and
the weighted sum of values. Bags move once, and those of up to about a block are answered where they meet.
States of disjoint sets of keys merge, so the keys of a larger bag are cut into blocks that are worked off
apart: a block of queries and a block of keys meet in one task, which gives one state a query.
n queries and n keys cost n rows for each block, not n squared.

Positions enter as decomposed terms: for each axis a table of vectors by offset, whose
product with the query is added to the logit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import key_hash, matrix, tables_of_groups, vectors, whole_groups
from ..session import cut

BLOCK_ROWS = 1024
# queries and keys that one step of a task weighs at once, so that their logits stay in its cache
STEP_QUERIES, STEP_KEYS = 64, 512
# logits below this in size need no largest one taken off before their exponentials
SAFE_LOGIT = 300.0
# pairs of a bag up to which it is worked off together with others, and pairs that one such step holds
SMALL_PAIRS, STEP_PAIRS = 1 << 12, 1 << 17
# what a row is in its bag, in the order of rows there
OFF, QUERY, BOTH, KEY = 0, 1, 2, 3


@dataclass(frozen=True)
class AttentionWeights:
    """Projections (width, C) of query, key and value, the one behind them (C, width out), and their form.

    ``scale`` defaults to the inverse root of a head's width. ``rel_rows`` and ``rel_cols`` are tables
    (offsets, C / heads) of relative positions; both or none.
    """

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray | None = None
    heads: int = 1
    scale: float | None = None
    rel_rows: np.ndarray | None = None
    rel_cols: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.query.shape[0]

    @property
    def head_width(self) -> int:
        return self.query.shape[1] // self.heads


def relative_table(table: np.ndarray, length: int) -> np.ndarray:
    """``table`` (offsets, width) stretched or shrunk to ``length`` offsets, linearly between centres."""
    n = table.shape[0]
    if n == length:
        return np.asarray(table, float)
    at = np.clip((np.arange(length) + 0.5) * n / length - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    part = (at - low)[:, None]
    return table[low] * (1 - part) + table[high] * part


def relative_offsets(query_at: np.ndarray, key_at: np.ndarray, n_query: int, n_key: int, paired: bool = False) -> np.ndarray:
    """Row of the table for every query and key position on one axis of ``n_query`` and ``n_key`` places.

    ``paired`` takes the positions pair by pair, in place of all against all. The coarser of the two grids is stretched to the finer one, so that equal places have equal offsets.
    """
    q_ratio, k_ratio = max(n_key / n_query, 1.0), max(n_query / n_key, 1.0)
    if not paired:
        query_at, key_at = query_at[:, None], key_at[None, :]
    return (query_at * q_ratio - key_at * k_ratio + (n_key - 1) * k_ratio).astype(int)


def _heads(x: np.ndarray, w: np.ndarray, heads: int) -> np.ndarray:
    return (x @ w).reshape(len(x), heads, -1)


def query_states(
    q: np.ndarray, k: np.ndarray, v: np.ndarray, scale: float, bias=None, most_bias: float = 0.0, largest: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State of each query (n, heads, head width) over all keys, ``STEP_QUERIES`` and ``STEP_KEYS`` at a time.

    ``bias(queries, keys)`` gives what is added to the logits of a slice of queries and one of keys, by head, at most
    ``most_bias`` in size. Unless ``largest`` is asked for, the state of logits that cannot reach ``SAFE_LOGIT`` is that below 0:
    exponentials neither overflow nor vanish then, and the largest logit need not be looked for.
    """
    n, heads, width = q.shape
    state = np.full((n, heads), -np.inf), np.zeros((n, heads)), np.zeros((n, heads, width))
    if not len(k) or not n:
        return state
    # by head, so that a step is a product of plain matrices; the column of ones sums the weights
    q, k = np.ascontiguousarray(q.transpose(1, 0, 2)) * scale, np.ascontiguousarray(k.transpose(1, 2, 0))
    v = np.concatenate([v.transpose(1, 0, 2), np.ones((heads, len(v), 1))], axis=2)
    reach = np.sqrt((q * q).sum(axis=2).max() * (k * k).sum(axis=1).max()) + most_bias
    if not largest and reach < SAFE_LOGIT:
        sums = np.zeros((heads, n, width + 1))
        for rows, part in _steps(n, k.shape[2]):
            logits = q[:, rows] @ k[:, :, part]
            if bias is not None:
                logits += bias(rows, part)
            sums[:, rows] += np.exp(logits, out=logits) @ v[:, part]
        return np.zeros((n, heads)), sums[:, :, width].T, sums[:, :, :width].transpose(1, 0, 2)
    for rows, part in _steps(n, k.shape[2]):
        logits = q[:, rows] @ k[:, :, part]
        if bias is not None:
            logits += bias(rows, part)
        top = logits.max(axis=2)
        logits -= top[:, :, None]
        held = np.exp(logits, out=logits) @ v[:, part]
        found = top.T, held[:, :, width].T, held[:, :, :width].transpose(1, 0, 2)
        for kept, new in zip(state, merged(tuple(x[rows] for x in state), found), strict=True):
            kept[rows] = new
    return state


def _steps(n_queries: int, n_keys: int) -> Iterator[tuple[slice, slice]]:
    for row in range(0, n_queries, STEP_QUERIES):
        for at in range(0, n_keys, STEP_KEYS):
            yield slice(row, row + STEP_QUERIES), slice(at, at + STEP_KEYS)


def pair_states(
    q: np.ndarray, k: np.ndarray, v: np.ndarray, scale: float, asked: np.ndarray, first: np.ndarray, count: np.ndarray, bias=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of queries of many small bags at once: query ``asked[i]`` over ``count[i]`` keys (one at least) from ``first[i]`` on.

    ``bias(queries, keys)`` gives what is added to the logits of pairs (row of ``q``, row of ``k``).
    """
    begin = np.r_[0, np.cumsum(count)[:-1]]
    which = np.repeat(np.arange(len(asked)), count)
    at_q, at_k = asked[which], np.arange(len(which)) + (first - begin)[which]
    logits = (q[at_q] * k[at_k]).sum(axis=2) * scale
    if bias is not None:
        logits += bias(at_q, at_k)
    top = np.maximum.reduceat(logits, begin)
    raised = np.exp(logits - top[which])
    return top, np.add.reduceat(raised, begin), np.add.reduceat(raised[:, :, None] * v[at_k], begin)


def merged(a, b):
    """The state over the keys of both states."""
    top = np.maximum(a[0], b[0])
    fa, fb = (np.exp(np.where(np.isneginf(x[0]), -np.inf, x[0] - top)) for x in (a, b))
    return top, a[1] * fa + b[1] * fb, a[2] * fa[:, :, None] + b[2] * fb[:, :, None]


def _answer(total: np.ndarray, held: np.ndarray, w: AttentionWeights) -> np.ndarray:
    some = total > 0
    mean = np.where(some[:, :, None], held / np.where(some, total, 1.0)[:, :, None], 0.0).reshape(len(held), -1)
    out = mean @ w.out
    if w.bias is not None:
        out = out + w.bias
    return np.where(some.any(axis=1)[:, None], out, 0.0)


def attend(
    queries: DataFrame,
    keys: DataFrame,
    weights: AttentionWeights,
    *,
    by: Sequence[str] = ("slide_id", "patch_id"),
    token: Sequence[str] = ("pr", "pc"),
    features: str = "features",
    mask: str | None = None,
    query_shape: tuple[int, int] | None = None,
    key_shape: tuple[int, int] | None = None,
    values: str | None = None,
) -> DataFrame:
    """``(*by, *token, features array<double>)``: the answer of every row of ``queries`` over the keys of its bag.

    A bag is a combination of ``by``, a token its place in it; ``by``, ``token`` and ``features`` are
    columns of both tables, the tokens whole numbers. Rows whose ``mask`` is false or null are no keys, and as queries
    they are answered with zeros; so is a query whose bag has no keys. A null vector counts as zeros.
    ``values`` names a column of ``keys`` with ready values (C numbers), in place of the projection of its features.
    With relative tables ``token`` is a row and a column, ``query_shape`` and ``key_shape`` are the
    grids they lie on, and tables of another length than the grids need are interpolated.

    A bag of up to one and a half ``BLOCK_ROWS`` queries and as many keys is answered where it meets. Rows of larger ones pass on
    to blocks, whose states are merged in a further step.
    """
    by, token = list(by), list(token)
    w, width = weights, weights.width
    scale = w.scale if w.scale is not None else w.head_width**-0.5
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    relative = w.rel_rows is not None
    most = BLOCK_ROWS + BLOCK_ROWS // 2
    if relative:
        if query_shape is None or key_shape is None:
            raise ValueError("relative positions need the shapes of both grids")
        lengths = [2 * max(a, b) - 1 for a, b in zip(query_shape, key_shape, strict=True)]
        tables = [relative_table(t, n) for t, n in zip((w.rel_rows, w.rel_cols), lengths, strict=True)]

    def prepared(df: DataFrame, role: int) -> DataFrame:
        on = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
        value = F.lit(None) if values is None or role == QUERY else F.col(values)
        rows = df.select(
            *by, *[F.col(c).cast("long").alias(c) for c in token], F.when(on, F.lit(role)).otherwise(F.lit(OFF)).cast("byte").alias("_role"),
            F.when(on, F.col(features).cast("array<double>")).alias("_f"), F.when(on, value.cast("array<double>")).alias("_v"),
        )
        return rows.where(F.col("_role") != OFF) if role == KEY else rows

    # a row that asks and tells is one row
    rows = prepared(queries, BOTH) if queries is keys else prepared(queries, QUERY).unionByName(prepared(keys, KEY))
    name = T.StructType([rows.schema[c] for c in (*by, *token)])
    first_type = T.StructType([*name.fields, T.StructField("_out", T.ArrayType(T.DoubleType())), *[rows.schema[c] for c in ("_role", "_f", "_v")]])
    def names_of(rows: pa.Table) -> list[pa.Array]:
        made = [rows.column(c).combine_chunks() for c in (*by, *token)]
        return [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in made]

    def answered(rows: pa.Table, out: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        rest = [pa.array(np.full(n, OFF, np.int8)), *[pa.nulls(n, pa.list_(pa.float64()))] * 2]
        return pa.RecordBatch.from_arrays([*names_of(rows), vectors(out), *rest], names=first_type.names)

    def passed_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in rows.to_batches():
            rest = [pa.nulls(b.num_rows, kind), b.column("_role"), b.column("_f").cast(kind), b.column("_v").cast(kind)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, *token)], *rest], names=first_type.names)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # blank rows of all bags come first
            n = pc.sum(pc.equal(batch.column("_role"), OFF)).as_py() or 0
            if n:
                yield answered(pa.Table.from_batches([batch.slice(0, n)]), np.zeros((n, w.out.shape[1])))
            if n < batch.num_rows:
                batches = chain([batch.slice(n)], batches)
                break
        for table, starts in tables_of_groups(batches, 2, 2 * most):
            if starts is None:  # part of a bag that is longer than any answered here
                yield from passed_on(table)
                continue
            first = starts[:-1]
            role = table.column("_role").to_numpy()
            n_q, n_k = (np.add.reduceat(role != r, first, dtype=np.int64) for r in (KEY, QUERY))
            large = (n_q > most) | (n_k > most)
            alone = (n_k == 0) & ~large
            if alone.any():
                rows = table.filter(pa.array(np.repeat(alone, np.diff(starts))))
                yield answered(rows, np.zeros((rows.num_rows, w.out.shape[1])))
            for g in np.flatnonzero(large):
                yield from passed_on(table.slice(first[g], starts[g + 1] - first[g]))
            pairs = np.where(large, 0, n_q * n_k)
            small = np.flatnonzero((pairs > 0) & (pairs <= SMALL_PAIRS))
            for step in np.split(small, np.flatnonzero(np.diff(np.cumsum(pairs[small]) // STEP_PAIRS)) + 1):
                if step.size:
                    # bags that stand between them are left out
                    own = np.repeat(first[step] - np.r_[0, np.cumsum(np.diff(starts)[step])[:-1]], np.diff(starts)[step])
                    rows = table.take(pa.array(own + np.arange(own.size)))
                    yield small_bags(rows, np.diff(starts)[step], n_q[step], n_k[step])
            for g in np.flatnonzero(pairs > SMALL_PAIRS):
                n = int(starts[g + 1] - first[g])
                group = table.slice(first[g], n)
                yield answered(group.slice(0, int(n_q[g])), _answer(*large_bag(group, int(n_q[g]), n - int(n_k[g]))[1:], w))

    def value_rows(rows: pa.Table, x: np.ndarray) -> np.ndarray:
        return _heads(x, w.value, w.heads) if values is None else matrix(rows.column("_v"), w.query.shape[1]).reshape(rows.num_rows, w.heads, -1)

    def small_bags(table: pa.Table, sizes: np.ndarray, n_q: np.ndarray, n_k: np.ndarray) -> pa.RecordBatch:
        """Bags that stand one after the other, queries before keys."""
        x = matrix(table.column("_f"), width)
        first = np.cumsum(sizes) - sizes
        asked = np.repeat(first - np.cumsum(n_q) + n_q, n_q) + np.arange(n_q.sum())
        bias = None
        if relative:
            at = [table.column(c).to_numpy() for c in token]
            place_of = np.zeros(table.num_rows, np.int64)
            place_of[asked] = np.arange(len(asked))
            q = _heads(x[asked], w.query, w.heads)
            scores = [np.einsum("qhd,od->qoh", q, t) for t in tables]

            def bias(at_q, at_k):
                offsets = [relative_offsets(a[at_q], a[at_k], nq, nk, paired=True) for a, nq, nk in zip(at, query_shape, key_shape, strict=True)]
                return sum(s[place_of[at_q], o] for s, o in zip(scores, offsets, strict=True))

        _, total, held = pair_states(
            _heads(x, w.query, w.heads), _heads(x, w.key, w.heads), value_rows(table, x), scale, asked, np.repeat(first + sizes - n_k, n_q), np.repeat(n_k, n_q), bias
        )
        return answered(table.take(pa.array(asked)), _answer(total, held, w))

    def large_bag(group: pa.Table, stop: int, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of the rows before ``stop`` over those from ``split`` on."""
        x = matrix(group.column("_f"), width)
        q, k = _heads(x[:stop], w.query, w.heads), _heads(x[split:], w.key, w.heads)
        v = value_rows(group.slice(split), x[split:])
        if not relative:
            return query_states(q, k, v, scale, largest=False)
        at = [group.column(c).to_numpy() for c in token]
        scores = [np.einsum("qhd,od->hqo", q, t) for t in tables]

        def bias(rows, part):
            out = 0.0
            for s, a, nq, nk in zip(scores, at, query_shape, key_shape, strict=True):
                offsets = relative_offsets(a[:stop][rows], a[split:][part], nq, nk)
                out = out + np.take_along_axis(s[:, rows], offsets[None].repeat(w.heads, axis=0), axis=2)
            return out

        return query_states(q, k, v, scale, bias, sum(float(np.abs(s).max()) for s in scores if s.size), largest=False)

    # the hash of a bag is worked out behind the shuffle, so that it does not move
    placed = rows.repartition(parts, *by).select(*key_hash(by), *rows.columns).sortWithinPartitions(F.col("_role") != OFF, "_g", "_h", "_role", *token)
    found = cut(placed.mapInArrow(bags, first_type), "attention")
    result = [*by, *token, F.col("_out").alias("features")]
    done, long = found.where("_out IS NOT NULL").select(*result), found.where("_out IS NULL")
    if long.isEmpty():
        return done

    rows = long.select(*key_hash(by), *[c for c in long.columns if c != "_out"])
    asks, tells = F.col("_role") != KEY, F.col("_role") != QUERY
    some = lambda on: F.ceil(F.count(F.when(on, 1)) / BLOCK_ROWS).cast("int")
    blocks = cut(rows.groupBy("_g", "_h").agg(some(asks).alias("_nq"), some(tells).alias("_nk")), "attention-blocks")
    spread = lambda n: F.pmod(F.xxhash64(*token), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(blocks.where("_nq > 0 AND _nk > 0"), ["_g", "_h"])
    q_rows = dealt.where(asks).withColumns({"_qb": spread("_nq"), "_kb": others("_nk"), "_role": F.lit(QUERY)})
    k_rows = dealt.where(tells).withColumns({"_kb": spread("_nk"), "_qb": others("_nq"), "_role": F.lit(KEY)})
    place = ["_g", "_h", "_qb", "_kb"]
    columns = [*place, "_role", "_nk", *by, *token, "_f", "_v"]
    met = q_rows.select(columns).unionByName(k_rows.select(columns)).repartition(parts, *place).sortWithinPartitions(*place, "_role", *token)
    state = T.StructType([*rows.select("_g", "_h").schema.fields, *name.fields])
    for c in ("_out", "_top", "_total", "_held"):
        state = state.add(c, T.ArrayType(T.DoubleType()))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, len(place)):
            n = int(np.count_nonzero(group.column("_role").to_numpy() == QUERY))
            if 0 < n < group.num_rows:
                yield states_of(group.slice(0, n), *large_bag(group, n, n))

    def states_of(rows: pa.Table, top: np.ndarray, total: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        none = pa.nulls(n, pa.list_(pa.float64()))
        one = rows.column("_nk")[0].as_py() == 1
        made = [vectors(_answer(total, held, w)), none, none, none] if one else [none, vectors(top), vectors(total), vectors(held.reshape(n, -1))]
        return pa.RecordBatch.from_arrays([rows.column("_g").combine_chunks(), rows.column("_h").combine_chunks(), *names_of(rows), *made], names=state.names)

    states = cut(met.mapInArrow(tile, state), "attention-states")
    key = ["_g", "_h", *token]
    apart = states.where("_out IS NULL").select(*key, *by, "_top", "_total", "_held").repartition(parts, *key).sortWithinPartitions(*key)
    merged_type = T.StructType([*name.fields]).add("features", T.ArrayType(T.DoubleType()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in tables_of_groups(batches, len(key)):
            first = starts[:-1]
            top, total = (matrix(table.column(c), w.heads) for c in ("_top", "_total"))
            held = matrix(table.column("_held"), w.query.shape[1]).reshape(table.num_rows, w.heads, -1)
            raised = np.exp(top - np.repeat(np.maximum.reduceat(top, first), np.diff(starts), axis=0))
            answer = _answer(np.add.reduceat(total * raised, first), np.add.reduceat(held * raised[:, :, None], first), w)
            yield pa.RecordBatch.from_arrays([*names_of(table.take(pa.array(first))), vectors(answer)], names=merged_type.names)

    whole = done.unionByName(states.where("_out IS NOT NULL").select(*result)).unionByName(apart.mapInArrow(join, merged_type))
    alone = rows.where(asks).join(blocks.where("_nk = 0").select("_g", "_h"), ["_g", "_h"], "left_semi")
    return whole.unionByName(alone.select(*by, *token, F.array_repeat(F.lit(0.0), w.out.shape[1]).alias("features")))


def self_attention(tokens: DataFrame, weights: AttentionWeights, *, shape: tuple[int, int] | None = None, **how) -> DataFrame:
    """Every token over all tokens of its bag; ``shape`` is the grid for relative positions. Else as ``attend``."""
    return attend(tokens, tokens, weights, query_shape=shape, key_shape=shape, **how)
