"""Language of event texts by hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram binds three of them, each permuted
by its place; a text bundles its trigrams by count, a language bundles its texts, and a
text goes to the language whose profile has the largest cosine.

The project has no multilingual record; the operator is general and runs on the
``event`` text of log records or any other text column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .texts import map_texts, remembered

WIDTH = 1024
SLOTS = 128
PIECE = 2048
_SHARP = 30.0


@dataclass(frozen=True)
class LanguageModel:
    """Names and unit profiles, one row each."""

    langs: tuple[str, ...]
    profiles: np.ndarray


@remembered
def _letters() -> np.ndarray:
    """Slot of every code point: 0 for all but letters, a-z apart, other letters by remainder."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = 1 + cp - 97 if 97 <= cp < 123 else 27 + cp % (SLOTS - 27)
    return table


@remembered
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Bound vectors of the first two places, and the third place's."""
    letters = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (SLOTS, WIDTH))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, :] * second[None, :, :]).reshape(SLOTS * SLOTS, WIDTH), letters


def text_vector(text: bytes) -> np.ndarray | None:
    """Unit bundle of a text's trigrams; None if it has no letter.

    Letters are lower-cased; a run of anything else is one blank. Blanks at both ends are
    supplied, so that even one letter makes a trigram.
    """
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    slots = _letters()[codes]
    slots = np.concatenate([[0], slots, [0]]).astype(np.int32)
    slots = slots[np.r_[True, (slots[1:] > 0) | (slots[:-1] > 0)]]
    if slots.size < 3:
        return None
    grams, counts = np.unique((slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:], return_counts=True)
    pairs, third = _vectors()
    total = np.zeros(WIDTH, np.float64)
    for at in range(0, grams.size, PIECE):
        g, n = grams[at : at + PIECE], counts[at : at + PIECE]
        total += n.astype(np.float32) @ (pairs[g // SLOTS] * third[g % SLOTS]).astype(np.float32)
    length = np.sqrt(total @ total)
    return total / length if length else None


def fit_languages(
    events: DataFrame,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    lang_col: str = "lang",
    usable: Column | None = None,
    rows_per_lang: int = 1000,
) -> LanguageModel:
    """Profiles from about ``rows_per_lang`` whole texts of each language, chosen by hash of the id.

    Rows with a null id, text or language teach nothing. Assumes no more languages than
    there are in the world: their counts and profiles come to the driver.
    """
    known = events.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    share = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.least(F.lit(1.0), F.lit(float(rows_per_lang)) / F.count("*")).alias("_share"))
    share = cut(share, "lang-shares")
    draw = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (
        known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
        .join(F.broadcast(share), "_lang")  # a row for each language
        .where(draw < F.col("_share"))
    )

    def make():
        def work(bodies):
            found = [text_vector(b) for b in bodies]
            # whole numbers add up alike in any order
            return [[None if v is None else np.rint(v * 1e6).astype(np.int64) for v in found]]

        return work

    vectors = map_texts(sample, ["_lang"], "_text", [("v", "array<bigint>")], make)
    sums = (
        vectors.where("v is not null")
        .select("_lang", F.posexplode("v").alias("i", "x"))
        .groupBy("_lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("_lang")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))
        .orderBy("_lang")
        .collect()
    )
    found = [(r["_lang"], np.array([p["x"] for p in r["xs"]], float)) for r in sums]
    found = [(lang, v / np.linalg.norm(v)) for lang, v in found if np.any(v)]
    profiles = np.array([v for _, v in found]) if found else np.zeros((0, WIDTH))
    return LanguageModel(tuple(lang for lang, _ in found), profiles)


def predict_language(
    events: DataFrame, model: LanguageModel, *, id_col: str = "event_id", text_col: str = "event"
) -> DataFrame:
    """``(id_col, lang_pred string, cosine double, score double)``, one row per input row.

    ``score`` is the softmax share of the winning cosine. A null text, a text without a
    letter, and any text under a model without languages get ``und``, cosine and score 0.
    Of equal cosines the first language in order wins.
    """

    def make():
        def work(bodies):
            langs, cosines, scores = [], [], []
            for body in bodies:
                v = text_vector(body) if model.langs else None
                if v is None:
                    best = ("und", 0.0, 0.0)
                else:
                    cos = model.profiles @ v
                    at = int(np.argmax(cos))
                    odds = np.exp(_SHARP * (cos - cos[at]))
                    best = (model.langs[at], float(cos[at]), float(1.0 / odds.sum()))
                for out, x in zip((langs, cosines, scores), best, strict=True):
                    out.append(x)
            return langs, cosines, scores

        return work

    return map_texts(events, [id_col], text_col, [("lang_pred", "string"), ("cosine", "double"), ("score", "double")], make)
