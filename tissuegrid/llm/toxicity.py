"""Toxicity of event texts by compression distance.

Two zstandard dictionaries are trained, one on units over-represented in toxic texts
and one on ordinary words. A window is one word, repeated twice and four times so that the coder's fixed
cost does not hide it; the shorter it comes out under the toxic dictionary compared
with the ordinary one, the likelier it is toxic. Thresholds are calibrated: the
compressed lengths of a word's windows, by the word's own length, are turned into log odds
counted on labelled texts, and the three worst windows decide on a text.

Texts that are near copies of each other count as one *family* (same smallest word
hash), so that one text copied often does not make its words look toxic.

The project has no record of toxic speech; the operator is general and runs on the
``event`` text of log records or any other text column.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .texts import bounded_sample, labelled_sample, map_texts, words_of

REPEATS = (2, 4)
DICT_BYTES = 8192
TOP = 3
SHORTEST, LONGEST = 3, 12
MAX_UNITS, MAX_WORDS = 2000, 4000
CACHE = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries (bytes), log odds of windows by lengths, calibration weights and base rate."""

    toxic: bytes = b""
    ordinary: bytes = b""
    odds: dict[tuple[int, ...], float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    base: float = 0.0


def _window(word: str, repeats: int) -> bytes:
    return ((" " + word) * repeats + " ").encode()


def measurer(model: ToxicityModel):
    """``word -> (bytes, then compressed with ordinary and toxic dictionary for each window)``."""
    import zstandard as z

    how = z.ZstdCompressionParameters.from_level(
        19,
        format=z.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_dict_id=False,
        write_checksum=False,
        window_log=15,
    )
    toxic, ordinary = (
        z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=how)
        for d in (model.toxic, model.ordinary)
    )

    def measure(word: str) -> tuple[int, ...]:
        windows = [_window(word, r) for r in REPEATS]
        return len(windows[0]), *(len(c.compress(w)) for w in windows for c in (ordinary, toxic))

    return measure


class _Cache(dict):
    """Bounded memo; ``fn`` fills misses."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def window_scorer(model: ToxicityModel):
    """``text bytes -> log odds of its TOP worst windows``, filled up with 0."""
    if not model.toxic:
        return lambda text: [0.0] * TOP
    measure, odds = measurer(model), model.odds
    cache = _Cache(lambda w: odds.get(measure(w), 0.0))

    def worst(text: bytes) -> list[float]:
        found = heapq.nlargest(TOP, map(cache.__getitem__, words_of(text)))
        return found + [0.0] * (TOP - len(found))

    return worst


def _family(words: set[str]) -> int:
    return min((xxhash.xxh64_intdigest(w) >> 1 for w in words), default=0)


def _train(samples: list[bytes]) -> bytes:
    import zstandard as z

    # a bounded list of short units; repeats give the trainer enough material
    many = samples * max(1, math.ceil(3000 / len(samples)))
    try:
        return z.train_dictionary(DICT_BYTES, many).as_bytes()
    except z.ZstdError:  # too little to train on: the units themselves serve as a dictionary
        return b"".join(samples)[-DICT_BYTES:].rjust(8)


def _calibrate(worst: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic weights (intercept first) of the ``TOP`` worst windows, by Newton steps."""
    x = np.column_stack([np.ones(len(worst)), worst])
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.5] * TOP)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (label - p) - ridge @ weights
        weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, slope)
    return tuple(float(w) for w in weights)


def fit_toxicity(
    events: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    label_col: str = "toxic",
    usable: Column | None = None,
    max_rows: int = 4000,
) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled texts (whole texts, chosen by hash of the id).

    ``usable`` is a condition on the id that label rows must meet. Rows with a null id
    or label teach nothing; null texts are empty. Without both classes in the sample the
    model scores every text with the smoothed base rate.
    """
    usable = F.lit(True) if usable is None else usable
    chosen = labelled_sample(labels, id_col, label_col, usable, max_rows)
    texts = events.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = cut(bounded_sample(texts, chosen, max_rows).select("_label", "_text"), "toxic-sample")

    def split():
        def work(bodies):
            found = [words_of(b) for b in bodies]
            return [_family(w) for w in found], [sorted(w) for w in found]

        return work

    docs = cut(map_texts(sample, ["_label"], "_text", [("fam", "long"), ("words", "array<string>")], split), "words")
    sizes = {r[0]: r[1] for r in docs.groupBy("_label").agg(F.countDistinct("fam")).collect()}
    n_toxic, n_plain = sizes.get(1, 0), sizes.get(0, 0)
    base = (n_toxic + 0.5) / (n_toxic + n_plain + 1.0)
    if not n_toxic or not n_plain:
        return ToxicityModel(base=base)
    per_word = docs.select("_label", "fam", F.explode("words").alias("w")).distinct()
    spaced = F.concat(F.lit(" "), "w")
    last = F.least(F.length("w"), F.lit(LONGEST))
    cuts = F.when(last >= SHORTEST, F.sequence(F.lit(SHORTEST), last)).otherwise(F.array().cast("array<int>"))
    units = F.concat(F.transform(cuts, lambda i: F.substr(spaced, F.lit(1), i + 1)), F.array(F.concat(spaced, F.lit(" "))))
    counted = cut(
        per_word.select("_label", "fam", F.explode(units).alias("u"))
        .distinct()
        .groupBy("u")
        .agg(F.sum("_label").alias("t"), F.sum(1 - F.col("_label")).alias("n"))
        .where("t >= 4 or n >= 4"),
        "units",
    )
    share = F.col("t") / n_toxic
    rows = (
        counted.where((F.col("t") >= F.greatest(F.lit(4), F.lit(0.02 * n_toxic))) & (share >= 20 * (F.col("n") + 1) / (n_plain + 1)))
        .orderBy(F.desc("t"), "u")
        .limit(MAX_UNITS)
        .collect()
    )
    support = {r["u"]: r["t"] for r in rows}
    # of nested units keep the longest with nearly the same support
    longer: Counter = Counter()
    for u, t in support.items():
        for k in range(SHORTEST + 1, len(u)):
            longer[u[:k]] = max(longer[u[:k]], t)
    marks = sorted(u for u, t in support.items() if longer[u] < 0.8 * t)
    plain = counted.where(F.col("u").endswith(" ") & ~F.col("u").isin(marks[:MAX_UNITS]))
    common = [r[0] for r in plain.orderBy(F.desc("n"), "u").select("u").limit(MAX_WORDS).collect()]
    if not marks or not common:
        return ToxicityModel(base=base)
    toxic_units = [(u * REPEATS[-1]).encode() for u in marks]
    ordinary_units = [(u.rstrip() * REPEATS[-1] + " ").encode() for u in common]
    model = ToxicityModel(_train(toxic_units), _train(ordinary_units), base=base)

    def lengths():
        measure = _Cache(measurer(model))

        def work(bodies):
            found = [words_of(b) for b in bodies]
            keys = [sorted({measure[w] for w in ws}) for ws in found]
            return [_family(w) for w in found], [[list(k) for k in ks] for ks in keys]

        return work

    seen = map_texts(sample, ["_label"], "_text", [("fam", "long"), ("keys", "array<array<int>>")], lengths)
    pairs = seen.select("_label", "fam", F.explode("keys").alias("k")).distinct()
    # distinct tuples of small lengths in a sample of at most max_rows texts; rare ones say nothing
    table = pairs.groupBy("k").agg(F.sum("_label").alias("t"), F.count(F.lit(1)).alias("all")).where("all >= 3").collect()
    odds = {
        tuple(r["k"]): math.log((r["t"] + 0.5) / (n_toxic + 1)) - math.log((r["all"] - r["t"] + 0.5) / (n_plain + 1))
        for r in table
    }
    model = ToxicityModel(model.toxic, model.ordinary, odds, (), base)

    def worst():
        score = window_scorer(model)
        return lambda bodies: [[score(b) for b in bodies]]

    found = map_texts(sample, ["_label"], "_text", [("w", "array<double>")], worst).collect()  # max_rows at most
    weights = _calibrate(np.array([r["w"] for r in found]), np.array([r["_label"] for r in found], float))
    return ToxicityModel(model.toxic, model.ordinary, odds, weights, base)


def _scorer(model: ToxicityModel):
    """A function from texts to their worst window's log odds, scores and predictions."""
    worst = window_scorer(model)

    def one(found: list[float]) -> float:
        if not model.weights:
            return model.base
        bias, *weights = model.weights
        odds = bias + sum(w * x for w, x in zip(weights, found, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, odds))))

    def work(bodies):
        found = [worst(b) for b in bodies]
        scores = [one(s) for s in found]
        return [f[0] for f in found], scores, [int(s >= 0.5) for s in scores]

    return work


def score_toxicity(
    events: DataFrame, model: ToxicityModel, *, id_col: str = "event_id", text_col: str = "event"
) -> DataFrame:
    """``(id_col, worst_window double, score double, predicted int)``, one row per input row.

    ``score`` is a logistic function of the three worst windows' log odds, calibrated on
    the labelled sample; 0.5 is the threshold. Empty, null and wordless texts have no window: their
    ``worst_window`` is 0 and they score low. Without a fitted dictionary the score is
    the base rate.
    """
    fields = [("worst_window", "double"), ("score", "double"), ("predicted", "int")]
    return map_texts(events, [id_col], text_col, fields, lambda: _scorer(model))


def keep_clean(events: DataFrame, model: ToxicityModel, *, text_col: str = "event") -> DataFrame:
    """The rows, with all their columns, that ``score_toxicity`` does not predict toxic."""

    def make():
        work = _scorer(model)
        return lambda bodies: [work(bodies)[2]]

    # a struct keeps any column name apart from the verdict
    row = F.struct(*[F.col(c) for c in events.columns]).alias("_row")
    return map_texts(events, [row], text_col, [("_toxic", "int")], make).where("_toxic = 0").select("_row.*")
