"""Attention against the plain softmax."""

import numpy as np
import pytest

from tissuegrid.operators import attention
from tissuegrid.operators.attention import AttentionWeights

SCHEMA = "slide_id long, patch_id int, pr int, pc int, features array<double>, live boolean, _qb int, _out string"


def weights(rng, width=6, inner=8, out=5, heads=2, rel=None):
    tables = {} if rel is None else {"rel_rows": rng.normal(size=(rel, inner // heads)), "rel_cols": rng.normal(size=(rel + 2, inner // heads))}
    q, k, v = (rng.normal(size=(width, inner)) for _ in range(3))
    return AttentionWeights(q, k, v, rng.normal(size=(inner, out)), rng.normal(size=out), heads, **tables)


def grid(rng, bags, rows, cols, width=6, hole=0.2):
    out = []
    for slide, patch in bags:
        for r in range(rows):
            for c in range(cols):
                f = None if rng.random() < 0.02 else rng.normal(size=width).tolist()
                out.append((slide, patch, r, c, f, bool(rng.random() > hole) if rng.random() > 0.05 else None, 1, "x"))
    return out


def plain(queries, keys, w, q_shape=None, k_shape=None, masked=True):
    out = {}
    for s, p, r, c, f, live, *_ in queries:
        own = [k for k in keys if k[:2] == (s, p) and (not masked or k[5])]
        if not own or (masked and not live):
            out[s, p, r, c] = np.zeros(w.out.shape[1])
            continue
        vec = lambda f: np.zeros(w.width) if f is None else np.array(f)
        x = np.array([vec(k[4]) for k in own])
        split = lambda m: m.reshape(*m.shape[:-1], w.heads, -1)
        q, k, v = split(vec(f) @ w.query), split(x @ w.key), split(x @ w.value)
        mean = []
        for h in range(w.heads):
            logit = k[:, h] @ q[h] * (w.scale or w.head_width**-0.5)
            if w.rel_rows is not None:
                for axis, (table, at) in enumerate(((w.rel_rows, r), (w.rel_cols, c))):
                    nq, nk = q_shape[axis], k_shape[axis]
                    t = plain_table(table, 2 * max(nq, nk) - 1)
                    for n, key in enumerate(own):
                        d = at * max(nk / nq, 1.0) - key[2 + axis] * max(nq / nk, 1.0) + (nk - 1) * max(nq / nk, 1.0)
                        logit[n] += q[h] @ t[int(d)]
            e = np.exp(logit - logit.max())
            mean.append((e / e.sum()) @ v[:, h])
        out[s, p, r, c] = np.concatenate(mean) @ w.out + w.bias
    return out


def plain_table(table, length):
    n = len(table)
    if n == length:
        return table
    at = [min(max((i + 0.5) * n / length - 0.5, 0), n - 1) for i in range(length)]
    return np.array([[np.interp(a, range(n), table[:, d]) for d in range(table.shape[1])] for a in at])


def compare(got, wanted):
    rows = got.collect()
    found = {(r["slide_id"], r["patch_id"], r["pr"], r["pc"]): np.array(r["features"]) for r in rows}
    assert len(rows) == len(found) == len(wanted) and set(found) == set(wanted)
    for at in wanted:
        assert np.allclose(found[at], wanted[at], atol=1e-9), at


@pytest.mark.parametrize("block,masked", [(1024, True), (16, True), (7, False)])
def test_self_attention_equals_plain_softmax(spark, monkeypatch, block, masked):
    monkeypatch.setattr(attention, "BLOCK_ROWS", block)
    monkeypatch.setattr(attention, "STEP_KEYS", 10)
    rng = np.random.default_rng(block)
    rows = grid(rng, [(1, 0), (1, 1), (None, 0)], 6, 8)
    rows += [(2, 0, 0, 0, [1.0] * 6, False, 1, "x"), (3, 0, 5, 5, [1.0] * 6, True, 1, "x")]
    w = weights(rng)
    got = attention.self_attention(spark.createDataFrame(rows, SCHEMA), w, mask="live" if masked else None)
    compare(got, plain(rows, rows, w, masked=masked))


@pytest.mark.parametrize("block", [1024, 9])
@pytest.mark.parametrize("q_shape,k_shape", [((4, 4), (4, 4)), ((4, 6), (2, 3)), ((3, 2), (6, 4)), ((5, 4), (2, 3))])
def test_relative_positions_of_unequal_grids(spark, monkeypatch, q_shape, k_shape, block):
    monkeypatch.setattr(attention, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    queries, keys = grid(rng, [(1, 0), (2, 3)], *q_shape), grid(rng, [(1, 0), (2, 3)], *k_shape)
    w = weights(rng, rel=7)
    frames = [spark.createDataFrame(r, SCHEMA) for r in (queries, keys)]
    compare(attention.attend(*frames, w, mask="live", query_shape=q_shape, key_shape=k_shape), plain(queries, keys, w, q_shape, k_shape))


def test_large_logits_neither_overflow_nor_vanish(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 0, i, 0, (rng.normal(size=6) * 300).tolist(), True, 1, "x") for i in range(40)]
    w = weights(rng)
    compare(attention.self_attention(spark.createDataFrame(rows, SCHEMA), w, mask="live"), plain(rows, rows, w))


def test_merging_is_independent_of_order():
    rng = np.random.default_rng(3)
    q, k, v = rng.normal(size=(5, 2, 4)), rng.normal(size=(30, 2, 4)), rng.normal(size=(30, 2, 4))
    whole = attention.query_states(q, k, v, 0.5)
    parts = [attention.query_states(q, k[a:b], v[a:b], 0.5) for a, b in ((20, 30), (0, 3), (3, 20))]
    joined = attention.merged(attention.merged(parts[0], parts[1]), parts[2])
    assert all(np.allclose(a, b) for a, b in zip(whole, joined, strict=True))
    empty = attention.query_states(q, k[:0], v[:0], 0.5)
    assert all(np.allclose(a, b) for a, b in zip(whole, attention.merged(empty, whole), strict=True))


def test_no_tokens_and_missing_shapes(spark):
    rng = np.random.default_rng(4)
    none = spark.createDataFrame([], SCHEMA)
    assert attention.self_attention(none, weights(rng)).collect() == []
    with pytest.raises(ValueError):
        attention.self_attention(none, weights(rng, rel=7))


def test_small_bags_are_answered_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    w = weights(rng, rel=7)
    queries = [r for b in range(40) for r in grid(rng, [(b % 9, b)], 3, 4)] + grid(rng, [(50, 1)], 4, 6)
    keys = [r for b in range(35) for r in grid(rng, [(b % 9, b)], 2, 3)] + grid(rng, [(50, 1), (51, 2)], 2, 3)
    monkeypatch.setattr(attention, "SMALL_PAIRS", 100)
    monkeypatch.setattr(attention, "STEP_PAIRS", 300)
    frames = [spark.createDataFrame(r, SCHEMA).coalesce(1) for r in (queries, keys)]
    for block in (1024, 5):
        monkeypatch.setattr(attention, "BLOCK_ROWS", block)
        compare(attention.attend(*frames, w, mask="live", query_shape=(4, 6), key_shape=(2, 3)), plain(queries, keys, w, (4, 6), (2, 3)))


def test_pairs_of_many_bags_equal_bags_one_by_one():
    rng = np.random.default_rng(9)
    q, k, v = (rng.normal(size=(30, 2, 4)) for _ in range(3))
    asked, first, count = np.array([0, 1, 7, 29]), np.array([2, 2, 9, 0]), np.array([3, 3, 1, 30])
    together = attention.pair_states(q, k, v, 0.5, asked, first, count)
    for i, (a, f, c) in enumerate(zip(asked, first, count, strict=True)):
        alone = attention.query_states(q[[a]], k[f : f + c], v[f : f + c], 0.5)
        assert all(np.allclose(x[i], y[0]) for x, y in zip(together, alone, strict=True))


def stored(monkeypatch):
    labels = []
    keep = attention.cut
    monkeypatch.setattr(attention, "cut", lambda df, label: labels.append(label) or keep(df, label))
    return labels


def test_only_long_bags_go_through_blocks(spark, monkeypatch):
    labels = stored(monkeypatch)
    monkeypatch.setattr(attention, "BLOCK_ROWS", 34)
    rng = np.random.default_rng(12)
    w = weights(rng)
    # a little longer than a block
    rows = grid(rng, [(1, 0), (2, 0), (2, 1)], 6, 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    compare(attention.self_attention(frame, w), plain(rows, rows, w, masked=False))
    assert labels == ["attention"]
    rows += grid(rng, [(3, 0)], 8, 8)
    compare(attention.self_attention(spark.createDataFrame(rows, SCHEMA), w, mask="live"), plain(rows, rows, w))
    assert labels == ["attention", "attention"]
    rows += grid(rng, [(4, 0), (4, 1)], 9, 12)
    compare(attention.self_attention(spark.createDataFrame(rows, SCHEMA).coalesce(1), w, mask="live"), plain(rows, rows, w))
    assert labels[2:] == ["attention", "attention-blocks", "attention-states"]


def test_long_sides_without_the_other_side(spark, monkeypatch):
    monkeypatch.setattr(attention, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(13)
    w = weights(rng)
    queries = grid(rng, [(1, 0), (2, 0), (4, 0)], 5, 6)
    keys = grid(rng, [(1, 0)], 2, 2) + grid(rng, [(2, 0), (3, 0)], 5, 6)
    frames = [spark.createDataFrame(r, SCHEMA).coalesce(1) for r in (queries, keys)]
    compare(attention.attend(*frames, w, mask="live"), plain(queries, keys, w))


def test_states_below_zero_and_below_the_largest_logit_agree():
    rng = np.random.default_rng(14)
    for size in (1.0, 4.0, 100.0):
        q, k, v = rng.normal(size=(130, 2, 3)) * size, rng.normal(size=(600, 2, 3)) * size, rng.normal(size=(600, 2, 3))
        added = rng.normal(size=(2, 130, 600))
        bias = lambda rows, part: added[:, rows, part]
        whole = attention.query_states(q, k, v, 0.5, bias)
        quick = attention.query_states(q, k, v, 0.5, bias, float(np.abs(added).max()), largest=False)
        split = attention.merged(
            attention.query_states(q, k[:90], v[:90], 0.5, lambda r, p: added[:, r, :90][:, :, p], 5.0, largest=False),
            attention.query_states(q, k[90:], v[90:], 0.5, lambda r, p: added[:, r, 90:][:, :, p], 5.0),
        )
        logits = np.einsum("qhd,khd->hqk", q, k) * 0.5 + added
        assert np.allclose(whole[0].T, logits.max(axis=2)) and ((quick[0] == 0).all() == (size < 100))
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        want = np.einsum("hqk,khd->qhd", e / e.sum(axis=2, keepdims=True), v)
        for _, total, held in (whole, quick, split):
            assert np.allclose(held / total[:, :, None], want)


def test_a_group_that_is_too_long_comes_in_parts():
    import pyarrow as pa

    from tissuegrid.functions.blocks import tables_of_groups

    keys = [1] * 3 + [2] * 30 + [3] * 2 + [4] * 11
    table = pa.table({"k": keys, "n": list(range(len(keys)))})
    for size in (1, 4, 7, 50):
        seen, parts = [], []
        for part, starts in tables_of_groups(iter(table.to_batches(max_chunksize=size)), 1, 10):
            seen += part.column("n").to_pylist()
            own = part.column("k").to_pylist()
            if starts is None:
                parts += sorted(set(own))
            else:
                assert [own[a:b] == [own[a]] * keys.count(own[a]) for a, b in zip(starts[:-1], starts[1:])] == [True] * (len(starts) - 1)
        assert sorted(seen) == list(range(len(keys))) and set(parts) <= {2, 4} and (size == 50 or 2 in parts)
