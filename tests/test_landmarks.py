"""Landmark attention and iterated inverses against plain matrices."""

import numpy as np
import pytest

from tissuegrid.operators import attention, landmarks
from tissuegrid.operators.attention import AttentionWeights

SCHEMA = "slide_id long, gx int, gy int, features array<double>, ok boolean, landmark int, _n string"


def made_up(seed=1, bags=((1, 50), (2, 7), (3, 1), (None, 20)), width=4):
    rng = np.random.default_rng(seed)
    rows = []
    for slide, n in bags:
        cells = rng.choice(400, n, replace=False)
        rows += [(slide, int(c // 20), int(c % 20), None if rng.random() < 0.03 else rng.normal(size=width).tolist(), bool(rng.random() > 0.2), 1, "x") for c in cells]
    w = AttentionWeights(*(rng.normal(size=(width, 6)) * 0.7 for _ in range(3)), rng.normal(size=(6, 5)), rng.normal(size=5), 2)
    return rows, w


def softmax(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def plain(rows, w, m, iterations):
    out = {}
    for slide in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == slide and r[4]), key=lambda r: r[1:3])
        x = np.array([r[3] or [0.0] * w.width for r in own])
        step = -(-len(own) // m)
        marks = np.array([x[i : i + step].mean(axis=0) for i in range(0, len(own), step)])
        split = lambda y: y.reshape(len(y), w.heads, -1).transpose(1, 0, 2)
        scale = w.head_width**-0.5
        q, k, v, ql, kl = (split(a) for a in (x @ w.query, x @ w.key, x @ w.value, marks @ w.query, marks @ w.key))
        a1, a2, a3 = (softmax(a @ b.transpose(0, 2, 1) * scale) for a, b in ((q, kl), (ql, kl), (ql, k)))
        z = landmarks.iterated_inverse(a2, iterations)
        y = (a1 @ z @ (a3 @ v)).transpose(1, 0, 2).reshape(len(own), -1) @ w.out + w.bias
        residual = np.abs(a2 @ z @ a2 - a2).max()
        out.update({r[:3]: (a, residual) for r, a in zip(own, y, strict=True)})
        out.update({r[:3]: (np.zeros(w.out.shape[1]), None) for r in rows if r[0] == slide and not r[4]})
    return out


@pytest.mark.parametrize("m,block", [(4, 1024), (8, 5)])
def test_equals_plain_matrices(spark, monkeypatch, m, block):
    monkeypatch.setattr(attention, "BLOCK_ROWS", block)
    rows, w = made_up()
    got = landmarks.landmark_attention(spark.createDataFrame(rows, SCHEMA), w, mask="ok", landmarks=m).collect()
    wanted = plain(rows, w, m, 6)
    assert len(got) == len(rows) == len(wanted)
    for r in got:
        vector, residual = wanted[r["slide_id"], r["gx"], r["gy"]]
        assert np.allclose(r["features"], vector, atol=1e-8)
        assert (r["residual"] is None) if residual is None else np.isclose(r["residual"], residual, atol=1e-9)


def test_error_against_full_attention_falls_with_landmarks(spark):
    rows, w = made_up(seed=2, bags=((1, 60),))
    df = spark.createDataFrame(rows, SCHEMA)
    full = {(r["gx"], r["gy"]): np.array(r["features"]) for r in attention.self_attention(df, w, by=["slide_id"], token=["gx", "gy"], mask="ok").collect()}
    error = []
    for m, iterations in ((2, 12), (60, 60)):
        got = landmarks.landmark_attention(df, w, mask="ok", landmarks=m, iterations=iterations).collect()
        error.append(max(np.abs(np.array(r["features"]) - full[r["gx"], r["gy"]]).max() for r in got))
    assert error[1] < 1e-3 < error[0]


def test_inverses_of_regular_and_singular_matrices(spark):
    rng = np.random.default_rng(7)
    regular = softmax(rng.normal(size=(5, 5)) * 2)
    cases = {"regular": regular, "equal rows": np.full((4, 4), 0.25), "zeros": np.zeros((3, 3)), "one": np.array([[2.0]])}
    rows = [(k, a.ravel().tolist(), 1) for k, a in cases.items()] + [("none", None, 1)]
    got = {r["k"]: r for r in landmarks.pseudo_inverses(spark.createDataFrame(rows, "k string, m array<double>, i int"), "m", iterations=30).collect()}
    for k, a in cases.items():
        assert np.allclose(np.array(got[k]["inverse"]).reshape(a.shape), np.linalg.pinv(a), atol=1e-6) and got[k]["residual"] < 1e-6
    assert got["none"]["inverse"] is None and got["none"]["residual"] is None
    few = landmarks.pseudo_inverses(spark.createDataFrame(rows[:1], "k string, m array<double>, i int"), "m", iterations=1).first()
    assert few["residual"] > 1e-3


def test_no_tokens(spark):
    _, w = made_up()
    assert landmarks.landmark_attention(spark.createDataFrame([], SCHEMA), w).collect() == []
