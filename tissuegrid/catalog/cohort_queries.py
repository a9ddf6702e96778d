"""Metadata columns, joins, labels, roll-ups and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.hashing import uniform01
from ..functions.skew import attach_by_key
from ..operators import cohort as co
from . import fixtures as fx
from .registry import query

MAG = "coalesce(TRY_CAST(replace(app_mag, ',', '.') AS DOUBLE), 20.0)"


@query("g1_magnification", fx.with_sql(f"SELECT slide_id, {MAG} AS mag FROM fx_slide_meta", fx.META))
def g1(spark, path):
    return fx.slide_meta(spark, path).select("slide_id", sc.magnification("app_mag").alias("mag"))


@query(
    "g2_sampling_size",
    fx.with_sql(
        f"SELECT slide_id, CAST(round_even((224.0 + slide_id % 7) * ({MAG} / 20.0), 0) AS INT) AS size FROM fx_slide_meta",
        fx.META,
    ),
)
def g2(spark, path):
    size = sc.sampling_size(F.lit(224) + F.col("slide_id") % 7, sc.magnification("app_mag"), 20.0)
    return fx.slide_meta(spark, path).select("slide_id", size.alias("size"))


# text fields of the other label families: values by slide number, some of them unknown
MORE_FIELDS = {
    "ER_Status_By_IHC": (3, ("positive", "negative", "equivocal")),
    "pr_status_by_ihc": (4, ("positive", "negative", None, None)),
    "HER2Calc": (5, ("positive", "negative", "n/a", None, "n/a")),
    "Lymphovascular Invasion (LVI)": (6, ("Present", "Absent", "Unknown", None, None, "Unknown")),
    "Overall_Survival_Status": (7, ("dead", "alive", None, "lost", None, None, None)),
}
MORE_NUMBERS = {
    "Grade": (4, ("1", "2", "n/a", None)),
    "Overall_Survival_Months": (6, ("12.5", "0", "200", None, "?", "31")),
    "Epithelial": (3, ("1", None, "3")),
    "Grade.1": (5, ("1", "2", "3", "x", None)),
    "age_at_diagnosis": (7, ("41", "52.25", None, "63", "unknown", "88", "30")),
}


def _case(mod: int, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE slide_id % {mod} {whens} END"


BINARY_TEXT = {"odx85": "odx85", "mphr": "mphr"}
for _name in ("ER_Status_By_IHC", "pr_status_by_ihc", "HER2Calc"):
    BINARY_TEXT[_name] = _case(*MORE_FIELDS[_name])
BINARY_TEXT["Necrosis"] = "necrosis"
for _name in ("Lymphovascular Invasion (LVI)", "Overall_Survival_Status"):
    BINARY_TEXT[_name] = _case(*MORE_FIELDS[_name])
ON, OFF = "('H', 'Present', 'positive', 'dead')", "('L', 'Absent', 'negative', 'alive')"

LABELS = f"""binary_labels AS (
  SELECT slide_id, label, CAST(CASE WHEN txt IN {ON} THEN 1 WHEN txt IN {OFF} THEN 0 END AS FLOAT) AS value
  FROM (SELECT slide_id, unnest([{', '.join(f"'{n.lower()}'" for n in BINARY_TEXT)}]) AS label,
               unnest([{', '.join(BINARY_TEXT.values())}]) AS txt FROM fx_slide_meta) t)"""


def _named_meta(spark, path):
    return fx.slide_meta(spark, path).select(
        "slide_id",
        "patient_id",
        "odx85",
        "mphr",
        F.col("necrosis").alias("Necrosis"),
        "odx_train",
        F.col("disease_free_months").alias("Disease_Free_Months"),
        F.col("pleomorph").alias("Pleomorph"),
        F.col("mitosis").alias("Mitosis"),
        # text that is not always a number
        F.col("app_mag").alias("tumor_size"),
        *[
            F.element_at(F.array(*map(F.lit, values)), (F.col("slide_id") % mod + 1).cast("int")).alias(name)
            for name, (mod, values) in {**MORE_FIELDS, **MORE_NUMBERS}.items()
        ],
    )


@query(
    "g7_map_binary",
    fx.with_sql(
        "SELECT slide_id, label, value, 'binary' AS task_type FROM binary_labels WHERE value IS NOT NULL", fx.META, LABELS
    ),
)
def g7(spark, path):
    return co.map_binary(_named_meta(spark, path), "slide_id")


NUMBER_TEXT = {
    "odx_train": "odx_train",
    "Grade": _case(*MORE_NUMBERS["Grade"]),
    "tumor_size": "app_mag",
    "Overall_Survival_Months": _case(*MORE_NUMBERS["Overall_Survival_Months"]),
    "Disease_Free_Months": "disease_free_months",
    "Epithelial": _case(*MORE_NUMBERS["Epithelial"]),
    "Pleomorph": "pleomorph",
    "Grade.1": _case(*MORE_NUMBERS["Grade.1"]),
    "age_at_diagnosis": _case(*MORE_NUMBERS["age_at_diagnosis"]),
}
REGRESSION = f"""regression_labels AS (
  SELECT slide_id, label, CAST(TRY_CAST(txt AS DOUBLE) AS FLOAT) AS value FROM (
    SELECT slide_id, unnest([{', '.join(f"'{n.lower()}'" for n in NUMBER_TEXT)}]) AS label,
           unnest([{', '.join(NUMBER_TEXT.values())}]) AS txt FROM fx_slide_meta) t)"""


@query(
    "g8_map_regression",
    fx.with_sql(
        "SELECT slide_id, label, value, 'regression' AS task_type FROM regression_labels WHERE value IS NOT NULL",
        fx.META,
        REGRESSION,
    ),
)
def g8(spark, path):
    return co.map_regression(_named_meta(spark, path), "slide_id")


MITOSIS = "TRY_CAST(nullif(regexp_extract(mitosis, '\\(score = (\\d+)\\)', 1), '') AS DOUBLE)"


@query("g9_mitosis_score", fx.with_sql(f"SELECT slide_id, {MITOSIS} AS score FROM fx_slide_meta", fx.META))
def g9(spark, path):
    return fx.slide_meta(spark, path).select("slide_id", co.mitosis_score(F.col("mitosis")).alias("score"))


@query(
    "g10_include_labels",
    fx.with_sql(
        """SELECT slide_id, label, value FROM binary_labels WHERE value IS NOT NULL AND label IN ('odx85', 'necrosis')
           UNION ALL SELECT slide_id, label, value FROM regression_labels WHERE value IS NOT NULL AND label = 'odx_train'""",
        fx.META,
        LABELS,
        REGRESSION,
    ),
)
def g10(spark, path):
    labels = co.patient_labels(_named_meta(spark, path), "slide_id")
    return co.include_labels(labels, ["ODX85", "Necrosis", "odx_TRAIN"]).select("slide_id", "label", "value")


@query(
    "g11_task_type",
    fx.with_sql(
        """SELECT slide_id, label, 'binary' AS task_type FROM binary_labels WHERE value IS NOT NULL
           UNION ALL SELECT slide_id, label, CASE WHEN label = 'pleomorph' THEN 'multiclass' ELSE 'regression' END
           FROM regression_labels WHERE value IS NOT NULL
           UNION ALL SELECT slide_id, 'mitosis', 'multiclass' FROM fx_slide_meta WHERE """
        + MITOSIS
        + " IS NOT NULL",
        fx.META,
        LABELS,
        REGRESSION,
    ),
)
def g11(spark, path):
    labels = co.patient_labels(_named_meta(spark, path), "slide_id")
    typed = co.task_types(labels, {"pleomorph": "multiclass", "mitosis": "multiclass"})
    return typed.select("slide_id", "label", "task_type")


@query(
    "g12_default_label",
    fx.with_sql(
        f"""SELECT slide_id, CAST(coalesce(
              {', '.join(f"CASE WHEN {t} IN {ON} THEN 1.0 WHEN {t} IN {OFF} THEN 0.0 END" for t in {**BINARY_TEXT, 'odx85': "(CASE WHEN slide_id % 2 = 0 THEN odx85 END)", 'mphr': "(CASE WHEN slide_id % 5 = 0 THEN mphr END)"}.values())},
              {', '.join(f"TRY_CAST({t} AS DOUBLE)" for t in NUMBER_TEXT.values())}, {MITOSIS}, 0.0) AS FLOAT) AS default_label
            FROM fx_slide_meta""",
        fx.META,
    ),
)
def g12(spark, path):
    # the first families are unknown for many slides, so that later ones decide
    key = F.col("slide_id")
    meta = _named_meta(spark, path).withColumns(
        {"odx85": F.when(key % 2 == 0, F.col("odx85")), "mphr": F.when(key % 5 == 0, F.col("mphr"))}
    )
    return co.default_label(meta, co.patient_labels(meta, "slide_id"), "slide_id")


SOFT = """CASE WHEN s <= 0.7169 THEN 0.5 * pow((s + 2.009) / (0.7169 + 2.009), 1.5)
  ELSE 1 - 0.5 * pow(1 - (s - 0.7169) / (2.744 - 0.7169), 1.5) END"""


@query(
    "g13_soft_label",
    fx.with_sql(
        f"""SELECT slide_id, round(CASE WHEN s < -2.009 THEN CAST('NaN' AS DOUBLE) ELSE {SOFT} END, 6) AS soft
            FROM (SELECT slide_id, CAST(odx_train AS DOUBLE) / 100000 AS s FROM fx_slide_meta) t""",
        fx.META,
    ),
)
def g13(spark, path):
    score = F.col("odx_train").cast("double") / 100000
    return fx.slide_meta(spark, path).select("slide_id", F.round(sc.soft_label(score), 6).alias("soft"))


@query(
    "g14_patient_from_barcode",
    fx.with_sql(
        """SELECT slide_id, concat_ws('-', split_part(barcode, '-', 1), split_part(barcode, '-', 2), split_part(barcode, '-', 3))
           AS patient FROM fx_slide_meta""",
        fx.META,
    ),
)
def g14(spark, path):
    return fx.slide_meta(spark, path).select("slide_id", sc.patient_from_barcode("barcode").alias("patient"))


# --- joins -----------------------------------------------------------------

PAIRS = """pairs AS MATERIALIZED (
  SELECT c.base, split_part(c.base, '/', -1) AS slide_id
  FROM (SELECT replace(fkey, '_coords.h5', '') AS base FROM fx_files WHERE fkey LIKE '%\\_coords.h5' ESCAPE '\\') c
  JOIN (SELECT replace(fkey, '_features.h5', '') AS base FROM fx_files WHERE fkey LIKE '%\\_features.h5' ESCAPE '\\') f
    ON c.base = f.base)"""

# metadata that leaves some processed slides out and has slides without files
PART_META = """part_meta AS MATERIALIZED (
  SELECT CAST(slide_id AS VARCHAR) AS slide_id, patient_id FROM fx_slide_meta WHERE mitosis IS NOT NULL)"""


def _part_meta(spark, path):
    return fx.keyed_meta(spark, path).where(F.col("mitosis").isNotNull())


@query("j1_complete_pairs", fx.with_sql("SELECT base, slide_id FROM pairs", fx.FILES, PAIRS))
def j1(spark, path):
    return co.complete_pairs(fx.files(spark, path))


@query(
    "j2_restrict_to_metadata",
    fx.with_sql(
        "SELECT base, slide_id FROM pairs WHERE slide_id IN (SELECT slide_id FROM part_meta)",
        fx.FILES,
        fx.META,
        PAIRS,
        PART_META,
    ),
)
def j2(spark, path):
    return co.restrict_to_metadata(co.complete_pairs(fx.files(spark, path)), _part_meta(spark, path))


@query(
    "j3_pairing_report",
    fx.with_sql(
        """SELECT (SELECT count(*) FROM fx_files) AS total_files, (SELECT count(*) FROM part_meta) AS slides_in_metadata,
             (SELECT count(*) FROM pairs WHERE slide_id IN (SELECT slide_id FROM part_meta)) AS slides_found,
             (SELECT count(*) FROM part_meta WHERE slide_id NOT IN (SELECT slide_id FROM pairs)) AS missing_slides""",
        fx.FILES,
        fx.META,
        PAIRS,
        PART_META,
    ),
)
def j3(spark, path):
    return co.pairing_report(fx.files(spark, path), _part_meta(spark, path))


EXAMPLES = """examples AS MATERIALIZED (
  SELECT p.slide_id, m.patient_id, p.base, concat('s3://slides/', p.base, '_coords.h5') AS coords_path,
         concat('s3://slides/', p.base, '_features.h5') AS features_path
  FROM pairs p JOIN part_meta m ON m.slide_id = p.slide_id)"""


# all metadata rows
ALL_META = "all_meta AS MATERIALIZED (SELECT CAST(slide_id AS VARCHAR) AS slide_id, patient_id FROM fx_slide_meta)"
ALL_EXAMPLES = EXAMPLES.replace("part_meta", "all_meta")


def _examples(spark, path, meta=None):
    pairs = co.complete_pairs(fx.files(spark, path))
    return co.slide_examples(pairs, _part_meta(spark, path) if meta is None else meta, root="s3://slides/")


@query(
    "j4_slide_examples",
    fx.with_sql("SELECT * FROM examples", fx.FILES, fx.META, PAIRS, PART_META, EXAMPLES),
)
def j4(spark, path):
    return _examples(spark, path)


@query(
    "w9_slide_order",
    fx.with_sql(
        "SELECT *, row_number() OVER (ORDER BY base) - 1 AS ord FROM examples", fx.FILES, fx.META, PAIRS, ALL_META, ALL_EXAMPLES
    ),
)
def w9(spark, path):
    return co.slide_order(_examples(spark, path, fx.keyed_meta(spark, path)))


@query(
    "a5_patient_slides",
    fx.with_sql(
        """SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY base) - 1 AS ord, slide_id, coords_path,
             features_path FROM examples""",
        fx.FILES,
        fx.META,
        PAIRS,
        ALL_META,
        ALL_EXAMPLES,
    ),
)
def a5_slides(spark, path):
    return co.patient_slides(_examples(spark, path, fx.keyed_meta(spark, path)))


@query(
    "j7_label_lookup",
    fx.with_sql(
        """SELECT m.slide_id, m.patient_id, l.odx85 FROM fx_slide_meta m JOIN (
             SELECT patient_id, arg_min(odx85, slide_id) AS odx85 FROM fx_slide_meta GROUP BY patient_id) l
           ON l.patient_id = m.patient_id""",
        fx.META,
    ),
)
def j7(spark, path):
    meta = fx.slide_meta(spark, path)
    first = co.label_lookup(meta, "patient_id", "odx85", "slide_id")
    return attach_by_key(meta.select("slide_id", "patient_id"), first, ["patient_id"])


@query("a5_patient_rollup", fx.with_sql("SELECT * FROM rollup", fx.META, fx.ROLLUP))
def a5(spark, path):
    return co.patient_rollup(fx.slide_meta(spark, path))


@query(
    "a17_histogram",
    fx.with_sql(
        """, span AS (SELECT odx85, min(CAST(disease_free_months AS DOUBLE)) AS lo, max(CAST(disease_free_months AS DOUBLE)) AS hi
             FROM fx_slide_meta GROUP BY odx85)
           SELECT m.odx85, CAST(least(floor((CAST(disease_free_months AS DOUBLE) - lo) * 25 / (hi - lo)), 24) AS INT) AS bin,
             count(*) AS n FROM fx_slide_meta m JOIN span s ON s.odx85 = m.odx85 GROUP BY 1, 2""",
        fx.META,
    ),
)
def a17(spark, path):
    meta = fx.slide_meta(spark, path).withColumn("months", F.col("disease_free_months").cast("double"))
    return co.histogram(meta, "months", ["odx85"], 25)


@query("a20_distinct_patients", fx.with_sql("SELECT DISTINCT patient_id FROM fx_slide_meta", fx.META))
def a20(spark, path):
    return co.distinct_patients(fx.slide_meta(spark, path))


@query(
    "a29_dataset_report",
    fx.with_sql(
        f""", used AS (SELECT label FROM binary_labels WHERE value IS NOT NULL UNION SELECT label FROM regression_labels WHERE value IS NOT NULL
               UNION SELECT 'mitosis' FROM fx_slide_meta WHERE {MITOSIS} IS NOT NULL)
            SELECT count(DISTINCT slide_id) AS n_slides, CAST(max(len(features)) AS INT) AS feature_dim,
              (SELECT string_agg(label, ',' ORDER BY label) FROM used) AS labels FROM fx_tiles""",
        fx.TILES,
        fx.META,
        LABELS,
        REGRESSION,
    ),
)
def a29(spark, path):
    labels = co.patient_labels(_named_meta(spark, path), "slide_id")
    return co.dataset_report(fx.tiles(spark, path), labels)


@query(
    "u2_missing_ids",
    fx.with_sql(
        "SELECT slide_id FROM part_meta EXCEPT SELECT slide_id FROM pairs", fx.FILES, fx.META, PAIRS, PART_META
    ),
)
def u2(spark, path):
    return co.missing_ids(_part_meta(spark, path), co.complete_pairs(fx.files(spark, path)))


# --- order and splits ------------------------------------------------------


@query(
    "w5_shuffle_order",
    fx.with_sql(
        f"SELECT slide_id, row_number() OVER (ORDER BY {fx.md5_sql('42', 'slide_id')}, slide_id) AS rn FROM fx_slide_meta",
        fx.META,
    ),
)
def w5(spark, path):
    return co.shuffle_order(fx.slide_meta(spark, path).select("slide_id"), "slide_id", 42)


@query(
    "w11_head_sample",
    fx.with_sql(
        f"""SELECT slide_id, patient_id FROM fx_slide_meta
            QUALIFY row_number() OVER (ORDER BY {fx.md5_sql('42', 'slide_id')}, slide_id) <= 100""",
        fx.META,
    ),
)
def w11(spark, path):
    return co.head_sample(fx.slide_meta(spark, path).select("slide_id", "patient_id"), "slide_id", 100, 42)


def _split_sql(source: str, key: str, positive: str, ratio: str, seed: str) -> str:
    return f"""SELECT {key}, odx85, CASE WHEN row_number() OVER (PARTITION BY odx85 = {positive}
        ORDER BY {fx.md5_sql(seed, key)}, {key}) <= (SELECT CAST(floor(count(*) * {ratio} / 2) AS BIGINT) FROM {source})
        THEN 'test' ELSE 'train' END AS split FROM {source}"""


def _patients(spark, path):
    return co.patient_rollup(fx.slide_meta(spark, path)).select("patient_id", "odx85")


@query(
    "c1_balanced_split",
    fx.with_sql(_split_sql("rollup", "patient_id", "1", "CAST(0.2 AS DOUBLE)", "42"), fx.META, fx.ROLLUP),
)
def c1(spark, path):
    return co.balanced_split(_patients(spark, path), "patient_id", "odx85", 1, 0.2, 42)


@query(
    "c2_three_way_split",
    fx.with_sql(
        """SELECT * FROM first WHERE split = 'test'
           UNION ALL SELECT slide_id, odx85, CASE WHEN split = 'test' THEN 'val' ELSE 'train' END FROM second""",
        fx.META,
        "first AS MATERIALIZED (" + _split_sql("fx_slide_meta", "slide_id", "'H'", "CAST(0.1 AS DOUBLE)", "42") + ")",
        "rest AS MATERIALIZED (SELECT slide_id, odx85 FROM first WHERE split = 'train')",
        "second AS MATERIALIZED ("
        + _split_sql("rest", "slide_id", "'H'", "(CAST(0.2 AS DOUBLE) / CAST(0.9 AS DOUBLE))", "43")
        + ")",
    ),
)
def c2(spark, path):
    slides = fx.slide_meta(spark, path).select("slide_id", "odx85")
    return co.three_way_split(slides, "slide_id", "odx85", "H", 0.2, 0.1, 42)


@query(
    "c3_random_split",
    fx.with_sql(
        f"""SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY {fx.md5_sql('42', 'patient_id')}, patient_id)
              <= (SELECT CAST(floor(0.25 * count(*)) AS BIGINT) FROM rollup) THEN 'test' ELSE 'train' END AS split FROM rollup""",
        fx.META,
        fx.ROLLUP,
    ),
)
def c3(spark, path):
    return co.random_split(_patients(spark, path).select("patient_id"), "patient_id", 0.25, 42)


@query(
    "c5_inherit_split",
    fx.with_sql(
        f"""SELECT patient_id, CASE WHEN n_slides > 2 AND {fx.uniform_sql('7', 'patient_id')} < 0.7 THEN 'train' ELSE 'test' END
            AS split FROM rollup""",
        fx.META,
        fx.ROLLUP,
    ),
)
def c5(spark, path):
    patients = co.patient_rollup(fx.slide_meta(spark, path))
    earlier = patients.where(F.col("n_slides") > 2).select(
        "patient_id", F.when(uniform01(7, "patient_id") < 0.7, "train").otherwise("test").alias("split")
    )
    return co.inherit_split(patients.select("patient_id"), earlier, "patient_id")
