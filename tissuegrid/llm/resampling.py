r"""Slides drawn so that their report texts resemble a target cohort's: importance resampling on hashed n-grams.

A word run of one to ``max_n`` words is a feature and falls into one of ``buckets`` by the
checksum of its bytes. A bucket's gain is the log ratio of its share in the target's texts
and in all texts; a slide's weight is the sum of its features' gains. Slides are drawn
without replacement by the largest of weight plus Gumbel noise, the noise a function of
slide id and seed, so that reruns agree.

Texts are cut into lines first. A line that many texts carry is counted once:

1. Distinct lines with their numbers of occurrences; the features of a distinct line are
   worked out once and stored as bucket numbers.
2. A bucket's count over all texts is the sum of its counts in distinct lines times the
   occurrences. Runs that reach over a line feed are no line's own and are added separately.
3. The weight of a distinct line is worked out once and joins the places where it
   stands; a text's weight is the sum over its lines, plus its runs over line feeds.

``slide_id`` and the text field ``Mitosis`` are those of the slide metadata; any table of ids
and texts will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import bucketed_row_number, text_key
from ..session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in order: letters and digits of ASCII, A-Z lower-cased, and all characters beyond it."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _starts(words: Column, n: int) -> Column:
    """Places, from 0, where a run of ``n`` begins."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, max_n: int, buckets: int) -> Column:
    """Buckets of all runs of one to ``max_n`` of ``words``, repeats kept."""

    def of(n: int) -> Column:
        return F.transform(_starts(words, n), lambda i: _bucket(F.array_join(F.slice(words, i + 1, F.lit(n)), " "), buckets))

    found = F.transform(words, lambda w: _bucket(w, buckets))
    return found if max_n == 1 else F.concat(found, *[of(n) for n in range(2, max_n + 1)])


def _crossing(text: Column, max_n: int, buckets: int) -> Column:
    """Buckets of runs whose words stand on more than one line."""
    if max_n == 1:
        return F.array().cast("array<int>")
    placed = F.flatten(
        F.transform(F.split(text, "\n"), lambda line, i: F.transform(words_of(line), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    )

    def of(p: Column, n: int) -> Column:
        over = F.filter(_starts(p, n), lambda i: F.get(p, i)["line"] != F.get(p, i + n - 1)["line"])
        run = lambda i: F.array_join(F.transform(F.slice(p, i + 1, F.lit(n)), lambda x: x["w"]), " ")
        return F.transform(over, lambda i: _bucket(run(i), buckets))

    # the placed words are worked out once for all lengths
    return F.get(F.transform(F.array(placed), lambda p: F.concat(*[of(p, n) for n in range(2, max_n + 1)])), F.lit(0))


def _keys(col: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(col), F.xxhash64(F.lit(1), F.col(col))]


def line_features(texts: DataFrame, text_col: str, *, max_n: int, buckets: int) -> DataFrame:
    """``(_k, _m, _n, _words, _buckets)``: every distinct line that is not empty, its occurrences and its features."""
    lines = texts.select(F.explode(F.split(text_col, "\n")).alias("_line")).where(F.col("_line") != "")
    counted = lines.groupBy("_line").agg(F.count("*").alias("_n"))
    worded = counted.withColumn("_w", words_of(F.col("_line"))).where(F.size("_w") > 0)
    k, m = _keys("_line")
    return worded.select(
        k.alias("_k"), m.alias("_m"), "_n", F.size("_w").cast("long").alias("_words"), _runs(F.col("_w"), max_n, buckets).alias("_buckets")
    )


def bucket_counts(lines: DataFrame, texts: DataFrame, text_col: str, *, max_n: int, buckets: int) -> DataFrame:
    """``(_b, _count)`` of all features of ``texts``, whose distinct lines are ``lines``."""
    counts = lines.select("_n", F.explode("_buckets").alias("_b"))
    if max_n > 1:
        counts = counts.unionByName(texts.select(F.lit(1).cast("long").alias("_n"), F.explode(_crossing(F.col(text_col), max_n, buckets)).alias("_b")))
    return counts.groupBy("_b").agg(F.sum("_n").alias("_count"))


def bucket_gains(counts: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of every bucket in thousandths of a nat; as many numbers as there are buckets."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b"))
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double").alias(name)
    table = every.join(counts.withColumnRenamed("_count", "s"), "_b", "left").join(target.withColumnRenamed("_count", "t"), "_b", "left")
    table = cut(table.select("_b", count("s"), count("t")), "bucket-counts")
    total = table.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * (total["s"] + buckets) / ((F.col("s") + 1) * (total["t"] + buckets))
    return [r["g"] for r in sorted(table.select("_b", F.floor(1000 * F.log(ratio)).alias("g")).collect())]


def _gain(of: Column, gains: list[int]) -> Column:
    # one literal, folded to an array when the query is planned
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))


def gumbel_noise(slide_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the digest of seed and id; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(slide_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample_slides(
    slides: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "slide_id",
    text_col: str = "Mitosis",
    target_text_col: str | None = None,
    max_n: int = 2,
    buckets: int = 10_000,
    min_words: int = 20,
    percent: int = 10,
    seed: int = 42,
) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)``, all but the id long, one row per row of ``slides``.

    ``score`` is weight plus noise. Of the slides with ``min_words`` words or more the
    ``percent`` percent (rounded down) of highest score are drawn and ranked 1, 2, 3...; ties go to the
    smaller id, null ids first. All others have a null rank. ``target`` has the texts to resemble, in
    ``target_text_col`` (default: ``text_col``).

    A null text is empty; a text without words has no features and weight 0. Rows that repeat
    an id are rows of their own with the same noise, equal ones with ranks side by side. Other columns
    are ignored, whatever their names. With an empty target every count of it is 0; an
    empty ``slides`` has no rows.
    """
    docs = slides.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    wanted = target.select(F.coalesce(F.col(target_text_col or text_col).cast("string"), F.lit("")).alias("_text"))
    how = {"max_n": max_n, "buckets": buckets}
    lines = cut(line_features(docs, "_text", **how), "line-features")
    gains = bucket_gains(
        bucket_counts(lines, docs, "_text", **how), bucket_counts(line_features(wanted, "_text", **how), wanted, "_text", **how), buckets
    )
    weighed = lines.select("_k", "_m", "_words", F.size("_buckets").cast("long").alias("_f"), _gain(F.col("_buckets"), gains).alias("_g"))
    t, u = _keys("_text")
    keyed = docs.select("_id", t.alias("_t"), u.alias("_u"), "_text")
    k, m = _keys("_line")
    places = (
        keyed.select("_id", "_t", "_u", F.explode(F.split("_text", "\n")).alias("_line"))
        .where(F.col("_line") != "")
        .select("_id", "_t", "_u", k.alias("_k"), m.alias("_m"))
    )
    zero = F.lit(0).cast("long")
    crossing = _crossing(F.col("_text"), max_n, buckets)
    parts = (
        places.join(weighed, ["_k", "_m"])
        .select("_id", "_t", "_u", zero.alias("_rows"), "_words", "_f", "_g")
        .unionByName(
            keyed.select(
                "_id", "_t", "_u", F.lit(1).cast("long").alias("_rows"), zero.alias("_words"),
                F.size(crossing).cast("long").alias("_f"), _gain(crossing, gains).alias("_g"),
            )
        )
    )
    sums = parts.groupBy("_id", "_t", "_u").agg(*[F.sum(c).alias(c) for c in ("_rows", "_words", "_f", "_g")])
    # equal rows were summed together; each gets its own share back
    share = lambda c: (F.col(c) / F.col("_rows")).cast("long")
    scored = cut(
        sums.select(
            "_id", "_t", "_u", share("_words").alias("_words"), share("_f").alias("n_features"), share("_g").alias("weight"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_copy"),
        ).withColumn("score", F.col("weight") + gumbel_noise(F.col("_id"), seed)),
        "scored-slides",
    )
    able = scored.where(F.col("_words") >= min_words)
    drawn = percent * able.count() // 100

    def keys(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[Column]]:
        down = -F.col("score")
        if isinstance(scored.schema["_id"].dataType, T.NumericType):
            return rows, [down, F.coalesce(F.col("_id").cast("double"), F.lit(float("-inf")))]
        placed, more = text_key("_id")(rows, by)
        return placed, [down, *more]

    ranked = bucketed_row_number(
        able, "rank", by=[], keys=keys, order=[F.col("score").desc(), F.col("_id"), F.col("_t"), F.col("_u"), F.col("_copy")]
    )
    rest = scored.where(F.col("_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(
        F.col("_id").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    )
