"""Slides to patients, typed labels and balanced splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_key
from ..functions.ranking import bucketed_row_number, hash_order, text_key
from ..functions.skew import attach_by_key
from ..session import cut

# Fixed label vocabulary: field -> text -> value.
SPECIAL_BINARY = {
    "odx85": {"H": 1.0, "L": 0.0},
    "mphr": {"H": 1.0, "L": 0.0},
}
BINARY = {
    "ER_Status_By_IHC": {"positive": 1.0, "negative": 0.0},
    "pr_status_by_ihc": {"positive": 1.0, "negative": 0.0},
    "HER2Calc": {"positive": 1.0, "negative": 0.0},
    "Necrosis": {"Present": 1.0, "Absent": 0.0},
    "Lymphovascular Invasion (LVI)": {"Present": 1.0, "Absent": 0.0},
    "Overall_Survival_Status": {"dead": 1.0, "alive": 0.0},
}
REGRESSION = [
    "odx_train",
    "Grade",
    "tumor_size",
    "Overall_Survival_Months",
    "Disease_Free_Months",
    "Epithelial",
    "Pleomorph",
    "Grade.1",
    "age_at_diagnosis",
]
MITOSIS = "Mitosis"

COORDS_SUFFIX = "_coords.h5"
FEATURES_SUFFIX = "_features.h5"


# --- files to slides -------------------------------------------------------


def complete_pairs(files: DataFrame, key: str = "fkey") -> DataFrame:
    """Base keys that have both a coordinate and a feature file, with ``slide_id``.

    One aggregate with two flags instead of a self-join.
    """
    k = F.col(key)
    is_coords, is_features = k.endswith(COORDS_SUFFIX), k.endswith(FEATURES_SUFFIX)
    base = F.when(is_coords, F.expr(f"left({key}, length({key}) - {len(COORDS_SUFFIX)})")).otherwise(
        F.expr(f"left({key}, length({key}) - {len(FEATURES_SUFFIX)})")
    )
    return (
        files.where(is_coords | is_features)
        .groupBy(base.alias("base"))
        .agg(F.bool_or(is_coords).alias("_c"), F.bool_or(is_features).alias("_f"))
        .where(F.col("_c") & F.col("_f"))
        .select("base", F.substring_index("base", "/", -1).alias("slide_id"))
    )


def restrict_to_metadata(pairs: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Pairs whose slide is in the metadata; all pairs without metadata."""
    return pairs if meta is None else pairs.join(meta.select("slide_id"), "slide_id", "left_semi")


def missing_ids(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metadata ids without a complete pair."""
    return meta.select("slide_id").distinct().join(pairs.select("slide_id"), "slide_id", "left_anti")


def pairing_report(files: DataFrame, meta: DataFrame, key: str = "fkey") -> DataFrame:
    """One row of totals; evaluating it fails when no pair was found."""
    found = complete_pairs(files, key).groupBy("slide_id").agg(F.count(F.lit(1)).alias("_p"))
    known = meta.groupBy("slide_id").agg(F.count(F.lit(1)).alias("_m"))
    # one outer join gives every count about slides
    both = known.join(found, "slide_id", "full_outer").agg(
        F.sum("_m").alias("slides_in_metadata"),
        F.sum(F.when(F.col("_m").isNotNull(), F.col("_p"))).alias("slides_found"),
        F.count_if(F.col("_m").isNotNull() & F.col("_p").isNull()).alias("missing_slides"),
    )
    names = ["total_files", "slides_in_metadata", "slides_found", "missing_slides"]
    parts = files.agg(F.count(F.lit(1)).alias("total_files")).unionByName(both, allowMissingColumns=True)
    counts = parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    none = F.raise_error(F.lit("no complete feature sets found")).cast("bigint")
    return counts.withColumn(
        "slides_found", F.when(F.col("slides_found") > 0, F.col("slides_found")).otherwise(none)
    )


def slide_examples(pairs: DataFrame, meta: DataFrame, patient: str = "patient_id", root: str = "") -> DataFrame:
    """Slide to patient and its two paths."""
    return pairs.join(meta, "slide_id").select(
        "slide_id",
        F.col(patient).alias("patient_id"),
        "base",
        F.concat(F.lit(root), "base", F.lit(COORDS_SUFFIX)).alias("coords_path"),
        F.concat(F.lit(root), "base", F.lit(FEATURES_SUFFIX)).alias("features_path"),
    )


def patient_slides(examples: DataFrame) -> DataFrame:
    """Slides of each patient numbered from 0 in key order.

    Kept long: a list column would gather all slides of one patient in one row.
    """
    return bucketed_row_number(
        examples,
        "_rn",
        by=["patient_id"],
        keys=text_key("base"),
        order=[F.col("base")],
    ).select("patient_id", (F.col("_rn") - 1).alias("ord"), "slide_id", "coords_path", "features_path")


def slide_order(examples: DataFrame) -> DataFrame:
    """All slides numbered from 0 in key order (``ord``)."""
    return bucketed_row_number(examples, "_rn", by=[], keys=text_key("base"), order=[F.col("base")]).select(
        *examples.columns, (F.col("_rn") - 1).alias("ord")
    )


def patient_rollup(slides: DataFrame) -> DataFrame:
    """Patient labels from slide fields: worst case over slides, shortest disease-free time.

    Numbers must parse, as text that does not is an error in the input.
    """

    def is_text(col: str, text: str) -> Column:
        # unknown compares unequal, so a missing field counts as 0
        return F.coalesce((F.col(col) == text).cast("int"), F.lit(0))

    return slides.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_slides"),
        F.max(F.col("odx_train").cast("double")).alias("odx_train"),
        F.max(is_text("odx85", "H")).alias("odx85"),
        F.max(is_text("mphr", "H")).alias("mphr"),
        F.min(F.col("disease_free_months").cast("double")).alias("dfm"),
        F.max(is_text("necrosis", "Present")).alias("necrosis"),
        F.max(F.col("pleomorph").cast("int")).alias("pleo"),
    )


def label_lookup(meta: DataFrame, by: str, label: str, order: str) -> DataFrame:
    """First label per key in the stated order."""
    return meta.groupBy(by).agg(F.min_by(label, order).alias(label))


def distinct_patients(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    return df.select(patient).distinct()


# --- labels ----------------------------------------------------------------


def _columns(df: DataFrame, fields: Sequence[str]) -> list[str]:
    return [f for f in fields if f in df.columns]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _long(df: DataFrame, key: str, parts: Sequence[tuple[str, Column, str, int]]) -> DataFrame:
    """Unpivot in one pass: an array of structs per row, exploded, unlabelled entries dropped."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name.lower()).alias("label"),
                value.cast("float").alias("value"),
                F.lit(kind).alias("task_type"),
                F.lit(ord_).alias("ord"),
            )
            for name, value, kind, ord_ in parts
        ]
    )
    return df.select(key, F.inline(entries)).where(F.col("value").isNotNull())


def _binary_parts(df: DataFrame, spec: Mapping[str, Mapping[str, float]], first: int):
    parts = []
    for i, (field, mapping) in enumerate(spec.items()):
        if field not in df.columns:
            continue
        text = _quoted(field).cast("string")
        value = F.lit(None).cast("double")
        for word, number in mapping.items():
            # roll-ups already carry 0 and 1
            value = F.when((text == word) | (text == str(int(number))), F.lit(number)).otherwise(value)
        parts.append((field, value, "binary", first + i))
    return parts


def _regression_parts(df: DataFrame, fields: Sequence[str], first: int):
    return [
        (f, _quoted(f).cast("string").try_cast("double"), "regression", first + i)
        for i, f in enumerate(fields)
        if f in df.columns
    ]


def map_binary(df: DataFrame, key: str, spec: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Text fields to 0/1 labels; other text gives no label."""
    return _long(df, key, _binary_parts(df, spec or {**SPECIAL_BINARY, **BINARY}, 0)).drop("ord")


def map_regression(df: DataFrame, key: str, fields: Sequence[str] = tuple(REGRESSION)) -> DataFrame:
    """Numeric fields; text that does not parse gives no label."""
    return _long(df, key, _regression_parts(df, fields, 0)).drop("ord")


def mitosis_score(text: Column) -> Column:
    """Digits of ``(score = N)``, null when absent."""
    return F.nullif(F.regexp_extract(text, r"\(score = (\d+)\)", 1), F.lit("")).try_cast("double")


def patient_labels(df: DataFrame, key: str) -> DataFrame:
    """All label families in family order: ``(key, label, value, task_type, ord)``."""
    parts = _binary_parts(df, SPECIAL_BINARY, 0)
    parts += _binary_parts(df, BINARY, 100)
    parts += _regression_parts(df, REGRESSION, 200)
    if MITOSIS in df.columns:
        parts.append((MITOSIS, mitosis_score(_quoted(MITOSIS)), "regression", 300))
    return _long(df, key, parts)


def include_labels(labels: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Case-insensitive allow-list; none keeps all."""
    return labels if names is None else labels.where(F.lower("label").isin([n.lower() for n in names]))


def task_types(labels: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Task type by lower-case label name, else the family's own."""
    if not overrides:
        return labels
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return labels.withColumn("task_type", F.coalesce(table[F.lower("label")], "task_type"))


def default_label(keys: DataFrame, labels: DataFrame, key: str, prefer: str | None = None) -> DataFrame:
    """First label in family order (or the preferred one), 0.0 when there is none."""
    rank = F.col("ord") if prefer is None else F.when(F.col("label") == prefer.lower(), -1).otherwise(F.col("ord"))
    first = labels.groupBy(key).agg(F.min_by("value", rank).alias("value"))
    return keys.select(key).distinct().join(first, key, "left").select(
        key, F.coalesce("value", F.lit(0.0)).cast("float").alias("default_label")
    )


def label_map(labels: DataFrame, key: str) -> DataFrame:
    """Labels as one map per key; the number of label names bounds its size."""
    return labels.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("label", "value")))).alias("labels")
    )


# --- splits ----------------------------------------------------------------


def shuffle_order(df: DataFrame, key: str, seed: int, out: str = "rn") -> DataFrame:
    """Random permutation numbered from 1, repeatable for a seed."""
    return hash_order(df, [key], seed, out)


def head_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """First ``n`` rows of the permutation; -1 keeps all."""
    if n < 0:
        return df
    # a top-n of each task, then of these
    return df.orderBy(md5_key(seed, key), key).limit(n)


def balanced_split(
    df: DataFrame, key: str, label: str, positive, ratio: float, seed: int, out: str = "split"
) -> DataFrame:
    """``out`` = test for equally many positives and negatives, train for the rest.

    A class smaller than its share goes to test whole. Two class counts reach the driver.
    """
    marked = df.withColumn("_pos", F.coalesce(F.col(label) == F.lit(positive), F.lit(False)))
    sizes = {r["_pos"]: r["count"] for r in marked.groupBy("_pos").count().collect()}
    n = int(sum(sizes.values()) * ratio / 2)
    if n == 0:
        raise ValueError("test split ratio too low for the number of rows")
    if not sizes.get(True) or not sizes.get(False):
        raise ValueError("both classes need at least one row")
    ranked = hash_order(marked, [key], seed, "_rn", by=["_pos"])
    return ranked.withColumn(out, F.when(F.col("_rn") <= n, "test").otherwise("train")).drop("_pos", "_rn")


def three_way_split(
    df: DataFrame, key: str, label: str = "odx85", positive=1, val: float = 0.2, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """Test by ``balanced_split``, then validation of the rest at ``val / (1 - test)``; val=0 gives none."""
    first = cut(balanced_split(df, key, label, positive, test, seed), "first-split")
    if val <= 0:
        return first
    rest = first.where(F.col("split") == "train").drop("split")
    second = balanced_split(rest, key, label, positive, val / (1 - test), seed + 1)
    val_ids = second.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return first.where(F.col("split") == "test").unionByName(val_ids)


def random_split(df: DataFrame, key: str, frac: float = 0.25, seed: int = 42) -> DataFrame:
    """int(frac * N) rows of the permutation to test, the rest to train."""
    n = int(frac * df.count())
    return (
        shuffle_order(df, key, seed, "_rn")
        .withColumn("split", F.when(F.col("_rn") <= n, "test").otherwise("train"))
        .drop("_rn")
    )


def inherit_split(df: DataFrame, old: DataFrame | None, key: str) -> DataFrame:
    """Keep an earlier assignment: earlier train stays train, all else is test; none gives unassigned."""
    if old is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    before = old.select(key, F.col("split").alias("_old"))
    return (
        df.join(before, key, "left")
        .withColumn("split", F.when(F.col("_old") == "train", "train").otherwise("test"))
        .drop("_old")
    )


def histogram(df: DataFrame, col: str, by: Sequence[str], bins: int = 25) -> DataFrame:
    """Equal-width counts over each group's own range; its maximum falls in the last bin."""
    span = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    at = F.when(
        F.col("_hi") > F.col("_lo"), F.floor((F.col(col) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    ).otherwise(F.lit(bins // 2))
    return (
        attach_by_key(df.where(F.col(col).isNotNull()), span, by)
        .groupBy(*by, F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density_2d(df: DataFrame, x: str, y: str, bins: int = 25) -> DataFrame:
    """Counts on a bins x bins grid over the overall range of both columns."""
    span = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])

    def at(c: str) -> Column:
        lo, hi = span.select(f"lo_{c}").scalar(), span.select(f"hi_{c}").scalar()
        spot = F.when(hi > lo, F.floor((F.col(c) - lo) * bins / (hi - lo))).otherwise(F.lit(bins // 2))
        return F.least(spot, F.lit(bins - 1)).cast("int")

    return df.groupBy(at(x).alias("x_bin"), at(y).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def dataset_report(tiles: DataFrame, labels: DataFrame, features: str = "features") -> DataFrame:
    """Slide count, vector width and labels in use."""
    from .patches import feature_dim

    names = labels.agg(F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"))
    return tiles.agg(F.count_distinct("slide_id").alias("n_slides")).select(
        "n_slides",
        feature_dim(tiles, features).scalar().alias("feature_dim"),
        names.scalar().alias("labels"),
    )
