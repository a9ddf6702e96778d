"""Quality of event texts by a generalised additive model with pairwise interactions.

A text becomes a few numbers; each is cut into bins. Cyclic boosting visits one feature
after the other and adds a shallow tree over its bins to the feature's lookup table; the
same goes on over the pairs of features that explain most of what is left. A score is
the logistic of the sum of looked-up values, found for a whole batch by bin numbers.

The project has no record of text quality; the operator is general and runs on the
``event`` text of log records or any other text column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bounded_sample, labelled_sample, map_texts

FEATURES = (
    "log_bytes",
    "log_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "rare_symbol_share",
    "non_ascii_share",
    "bar_share",
    "bang_share",
    "distinct_word_share",
    "repeated_next_share",
    "symbol_end_share",
    "capital_word_share",
    "line_bytes",
    "distinct_line_share",
    "byte_entropy",
    "full_stop_share",
    "longest_word",
    "letter_share",
)
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_COMMON = np.frombuffer(b".,;:'\"-()?!", np.uint8)
_RARE = np.array([c for c in _SYMBOLS if c not in _COMMON])
_ENDS = re.compile(rb"[^\w\s.,;:'\")?!\x80-\xff](?=\s|$)")
BINS, PAIR_BINS = 32, 8


def text_features(text: bytes) -> list[float]:
    """The numbers of ``FEATURES``; all 0 for an empty text."""
    n = len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    upper, lower = count[65:91].sum(), count[97:123].sum()
    p = count[count > 0] / n
    return [
        float(x)
        for x in (
            np.log1p(n),
            np.log1p(len(words)),
            (n - count[[9, 10, 11, 12, 13, 32]].sum()) / n_words,
            upper / max(1, upper + lower),
            count[48:58].sum() / n,
            count[_SYMBOLS].sum() / n,
            count[_RARE].sum() / n,
            count[128:].sum() / n,
            count[124] / n_words,
            count[33] / n_words,
            len(set(words)) / n_words,
            sum(map(eq, words, words[1:])) / n_words,
            len(_ENDS.findall(text)) / n_words,
            sum(map(bytes.isupper, words)) / n_words,
            np.log1p(n / n_lines),
            len(set(lines)) / n_lines,
            -(p * np.log2(p)).sum(),
            count[46] / n_words,
            np.log1p(max(map(len, words), default=0)),
            (upper + lower + count[128:].sum()) / n,
        )
    ]


@dataclass(frozen=True)
class QualityModel:
    """Bin edges, lookup tables and interaction tables; ``base`` is the log odds to start from."""

    base: float
    edges: tuple[np.ndarray, ...] = ()
    tables: tuple[np.ndarray, ...] = ()
    pairs: tuple[tuple[int, int], ...] = ()
    pair_tables: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        if self.edges:
            bins = _bin(x, self.edges)
            for f, table in enumerate(self.tables):
                total += table[bins[:, f]]
            coarse = bins * PAIR_BINS // BINS
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bin(x: np.ndarray, edges) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)])


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` runs of bins, grown by best gain."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            if at.size:
                gain = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(at[k])), key=lambda z: z[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _grid_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Depth-two tree over a grid: one cut of the first side, one of the second in each part."""
    n = len(grad)
    g, h = np.cumsum(np.cumsum(grad, 0), 1), np.cumsum(np.cumsum(hess, 0), 1)
    g, h = np.pad(g, ((1, 0), (1, 0))), np.pad(h, ((1, 0), (1, 0)))
    best, out = -1.0, np.zeros_like(grad)
    for a in range(1, n):
        gain, parts = 0.0, []
        for lo, hi in ((0, a), (a, n)):
            gs, hs = g[hi] - g[lo], h[hi] - h[lo]
            split = gs[1:-1] ** 2 / (hs[1:-1] + ridge) + (gs[-1] - gs[1:-1]) ** 2 / (hs[-1] - hs[1:-1] + ridge)
            k = int(np.argmax(split))
            gain += float(split[k])
            parts.append((lo, hi, k + 1, gs, hs))
        if gain > best:
            best = gain
            for lo, hi, k, gs, hs in parts:
                out[lo:hi, :k] = gs[k] / (hs[k] + ridge)
                out[lo:hi, k:] = (gs[-1] - gs[k]) / (hs[-1] - hs[k] + ridge)
    return out, best


def boost(
    x: np.ndarray, y: np.ndarray, *, rounds: int = 150, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6
) -> QualityModel:
    """Fit by cyclic boosting; needs at least one row. One class alone gives a constant model."""
    rate_1 = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    if len(np.unique(y)) < 2:
        return QualityModel(base)
    probs = np.arange(1, BINS) / BINS
    edges = tuple(np.unique(np.quantile(x[:, f], probs)) for f in range(x.shape[1]))
    bins = _bin(x, edges)
    tables = [np.zeros(BINS) for _ in edges]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            grad, hess = slopes()
            step = rate * _tree(
                np.bincount(bins[:, f], grad, BINS), np.bincount(bins[:, f], hess, BINS), leaves, ridge=2.0
            )
            table += step
            total += step[bins[:, f]]
    coarse = bins * PAIR_BINS // BINS

    def grid(i, j, values):
        return np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    grad, hess = slopes()
    found = sorted(
        (-_grid_tree(grid(i, j, grad), grid(i, j, hess), 2.0)[1], i, j)
        for i in range(x.shape[1])
        for j in range(i + 1, x.shape[1])
    )[:n_pairs]
    pairs = tuple((i, j) for _, i, j in found)
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            grad, hess = slopes()
            step = rate * _grid_tree(grid(i, j, grad), grid(i, j, hess), 2.0)[0]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return QualityModel(base, edges, tuple(tables), pairs, tuple(pair_tables))


def fit_quality(
    events: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    label_col: str = "quality",
    usable: Column | None = None,
    max_rows: int = 8000,
) -> QualityModel:
    """Learn from at most ``max_rows`` labelled texts (whole texts, chosen by hash of the id).

    Only their features come to the driver. Rows with a null id or label teach nothing;
    null texts are empty. Without any labelled row every score is one half.
    """
    chosen = labelled_sample(labels, id_col, label_col, F.lit(True) if usable is None else usable, max_rows)
    texts = events.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = bounded_sample(texts, chosen, max_rows)

    def make():
        return lambda bodies: [[text_features(b) for b in bodies]]

    rows = sorted(map(tuple, map_texts(sample, ["_id", "_label"], "_text", [("x", "array<double>")], make).collect()))
    if not rows:
        return QualityModel(0.0)
    return boost(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))


def score_quality(
    events: DataFrame,
    model: QualityModel,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    threshold: float = 0.7,
) -> DataFrame:
    """``(id_col, score double, predicted int)``, one row per input row; null and empty texts alike are scored."""

    def make():
        def work(bodies):
            score = model.score(np.array([text_features(b) for b in bodies]))
            return score, (score >= threshold).astype(np.int32)

        return work

    return map_texts(events, [id_col], text_col, [("score", "double"), ("predicted", "int")], make)
