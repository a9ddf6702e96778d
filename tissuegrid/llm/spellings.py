r"""Spelling variants of the words in slide metadata, grouped by a reduced alphabet.

Free text fields of the slide metadata (``Mitosis``, say) hold the same term in several
spellings. Two words are near if one inserted, deleted or replaced letter turns one into the
other. A word's form is its commonest near word if that is much commoner than the word.

1. Words are counted, and rare ones left out.
2. Letters are hashed to a few symbols, so that many words share one reduced word. For every
   reduced word the whole neighbourhood of one edit is generated, the word itself included.
3. Neighbourhoods are joined with the vocabulary of reduced words: near words have reduced words that
   are equal or near, so no pair is lost. The links between reduced words are spread to the words
   behind them, and pairs are verified on the original strings.
4. Forms are followed to the last by doubling the steps taken.

How many symbols are used follows from the vocabulary: the fewest of ``SYMBOLS`` with which a
word shares its reduced word with ``LOAD`` words on average, so that buckets stay small as the vocabulary grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut

WORD = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = (4, 6, 8, 12, 16, 24, 32)
LOAD = 12.0
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CHUNK = 2_000_000


def word_counts(
    slides: DataFrame, *, id_col: str = "slide_id", text_col: str = "Mitosis", min_letters: int = 6, min_count: int = 5, drop_every: int = 0
) -> DataFrame:
    """``(word string, n long)`` of words with ``min_letters`` code points and ``min_count`` occurrences at least.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts; only A-Z are lower-cased. With ``drop_every``
    a run loses one letter if that number divides the checksum of ``<id>:<run>``, which plants known
    variants. Null texts have no words; a null id counts as empty.
    """
    runs = slides.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(WORD), F.lit(0))).alias("word"),
    ).where(F.length("word") >= min_letters)
    if drop_every:
        h = F.crc32(F.concat("_id", F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(h % drop_every == 0, less).otherwise(F.col("word"))).where(F.length("word") >= min_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_symbols(letters: np.ndarray, size: int) -> np.ndarray:
    """Symbols of code points."""
    return ((letters.astype(np.uint64) * np.uint64(0x9E37)) >> np.uint64(7)) % np.uint64(size)


def _weights(length: int) -> np.ndarray:
    steps = np.full(length + 2, _STEP, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _values(symbols: np.ndarray, length: int, size: int) -> np.ndarray:
    # mixed, so that sums of different symbols do not meet; the length is part of the key
    x = (symbols.astype(np.uint64) + np.uint64(1 + 64 * size)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def reduced_keys(letters: np.ndarray, size: int) -> np.ndarray:
    """64-bit key of the reduced word of every row of code points."""
    n, length = letters.shape
    return (_values(letter_symbols(letters, size), length, size) * _weights(length)[:length]).sum(axis=1, dtype=np.uint64)


def neighbour_keys(letters: np.ndarray, size: int) -> np.ndarray:
    """Keys, sorted in each row, of all reduced words at most one edit from the row's word.

    A key is a sum over positions, so that an edit costs one step from the sums before and after it.
    """
    n, length = letters.shape
    w = _weights(length + 1)
    symbols = letter_symbols(letters, size)

    def sums(at):
        """Terms, sums before each position, the total and the term of each symbol for words of ``at`` letters."""
        terms = _values(symbols, at, size) * w[:length]
        before = np.zeros((n, length + 1), np.uint64)
        np.cumsum(terms, axis=1, dtype=np.uint64, out=before[:, 1:])
        return terms, before, before[:, -1:], _values(np.arange(size), at, size)

    terms, _, total, choice = sums(length)
    found = [total, ((total - terms)[:, :, None] + w[:length, None] * choice).reshape(n, -1)]
    _, before, total, _ = sums(length - 1)
    found.append(before[:, :-1] + (total - before[:, 1:]) * np.uint64(_BACK))
    _, before, total, choice = sums(length + 1)
    found.append(((before + (total - before) * np.uint64(_STEP))[:, :, None] + w[: length + 1, None] * choice).reshape(n, -1))
    return np.sort(np.concatenate(found, axis=1), axis=1)


def _by_length(words: list[str]):
    order: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        order.setdefault(len(word), []).append(i)
    for length, at in order.items():
        yield length, np.array(at), np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, length)


def symbol_count(words: DataFrame) -> int:
    """The fewest symbols that keep reduced words small; the most there are if none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, letters in _by_length(batch.column(0).to_pylist()):
                for size in SYMBOLS:
                    keys = reduced_keys(letters, size).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"_s": np.full(len(keys), size, np.int32), "_r": keys})

    loads = (
        words.select("word")
        .mapInArrow(run, "_s int, _r long")
        .groupBy("_s", "_r")
        .agg(F.count("*").alias("_c"))
        .groupBy("_s")
        .agg((F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).alias("_load"))
        .collect()
    )
    return min((r["_s"] for r in loads if r["_load"] <= LOAD), default=SYMBOLS[-1])


def _keyed(words: DataFrame, size: int) -> DataFrame:
    """``words`` with the reduced word ``_red``, a text of symbols, and its key ``_key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys, reduced = np.zeros(len(texts), np.uint64), [""] * len(texts)
            for length, at, letters in _by_length(texts):
                keys[at] = reduced_keys(letters, size)
                text = (letter_symbols(letters, size) + np.uint64(48)).astype(np.uint32).tobytes().decode("utf-32-le")
                for k, i in enumerate(at):
                    reduced[i] = text[k * length : (k + 1) * length]
            columns = [*batch.columns, pa.array(reduced), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "_red", "_key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, _red string, _key long")


def _neighbourhoods(reduced: DataFrame, size: int) -> DataFrame:
    """``(_red, _key)``: each distinct reduced word (with one word behind it) and the keys of its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(1).to_pylist(), batch.column(0)
            for length, at, letters in _by_length(texts):
                rows = max(1, _CHUNK // (2 * (length + 1) * size))
                for lo in range(0, len(at), rows):
                    keys = neighbour_keys(letters[lo : lo + rows], size)
                    fresh = np.ones(keys.shape, bool)
                    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(fresh)
                    flat = keys[fresh].view(np.int64)
                    for a in range(0, len(flat), 200_000):
                        part = slice(a, a + 200_000)
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(at[lo : lo + rows][row[part]])), pa.array(flat[part])], names=["_red", "_key"]
                        )

    return reduced.select("_red", "_any").mapInArrow(run, "_red string, _key long")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every ordered pair of near words of ``words`` ``(word, n)``, each once."""
    size = symbol_count(words)
    keyed = cut(_keyed(words, size), "reduced-words")
    reduced = cut(keyed.groupBy("_red").agg(F.min("word").alias("_any"), F.first("_key").alias("_key")), "reduced-vocabulary")
    links = _neighbourhoods(reduced, size).join(reduced.select("_key", F.col("_red").alias("_to")), "_key").select("_red", "_to")
    left = links.join(keyed.select("_red", "word", "n"), "_red").select("word", "n", "_to")
    right = keyed.select(F.col("_red").alias("_to"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = left.join(right, "_to").where(F.levenshtein("word", "near", 1) == 1)
    return pairs.select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form."""
    steps = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(steps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "roots")
        drop_cut(steps)
        steps = moved.select("word", "root")
        if moved.where("_on").isEmpty():
            return steps


def group_spellings(
    slides: DataFrame,
    *,
    id_col: str = "slide_id",
    text_col: str = "Mitosis",
    min_letters: int = 6,
    min_count: int = 5,
    times: int = 5,
    drop_every: int = 0,
) -> DataFrame:
    """``(word, form, root string, n, n_near, form_n long)``, one row per word of ``word_counts``.

    ``n_near`` counts the near words, ``form`` is the near word of largest n (ties: the smallest in
    code-point order) if its n, ``form_n``, is at least ``times`` the word's own, else null. ``root`` is the last
    of the chain of forms, the word itself without one. Columns other than id and text are
    ignored, whatever their names; repeated rows count again; without words there are no rows.
    """
    counts = word_counts(slides, id_col=id_col, text_col=text_col, min_letters=min_letters, min_count=min_count, drop_every=drop_every)
    words = cut(counts, "word-counts")
    best = (
        near_words(words)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("_best"))
    )
    common = -F.col("_best.down") >= times * F.col("n")
    found = cut(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("_best.near")).alias("form"),
            F.when(common, -F.col("_best.down")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
