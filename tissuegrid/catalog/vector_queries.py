"""Vectors, pooling, augmentation and stain work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import colour as co
from ..functions import scalars as sc
from ..functions.hashing import uniform01
from ..operators import augment as au
from ..operators import pooling as po
from ..operators import stain as st
from ..operators import vectors as ve
from . import fixtures as fx
from .registry import query

DIM = 64
LONG = """long AS MATERIALIZED (
  SELECT *, features[j + 1] AS x FROM (SELECT *, unnest(range(0, 64)) AS j FROM fx_tiles) t)"""


def _exploded(df, vector: str, digits: int = 6, *keys: str):
    """Vector elements as rows ``(keys, j, x)``, rounded."""
    return df.select(*keys, F.posexplode(vector).alias("j", "x")).select(
        *keys, F.col("j").cast("bigint").alias("j"), (F.round(F.col("x").cast("double"), digits) + 0.0).alias("x")
    )


def _value(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS x"


# --- statistics and pooling ------------------------------------------------

RAW = """raw AS MATERIALIZED (
  SELECT vec_id, label, j, CAST(embedding[j + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(0, 64)) AS j FROM embeddings) t)"""


@query(
    "a8_vector_stats",
    fx.with_sql(
        "SELECT label, j, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std FROM raw GROUP BY label, j",
        RAW,
    ),
)
def a8(spark, path):
    stats = po.vector_stats(fx.table(spark, path, "embeddings"), "embedding", ["label"])
    return stats.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("j", "s")).select(
        "label",
        F.col("j").cast("bigint").alias("j"),
        "n",
        (F.round("s.mean", 6) + 0.0).alias("mean"),
        F.round("s.std", 6).alias("std"),
    )


@query(
    "a9_mean_vector",
    fx.with_sql(f"SELECT j, {_value('avg(x)')} FROM long WHERE NOT blank GROUP BY j", fx.TILES, LONG),
)
def a9(spark, path):
    return _exploded(po.mean_vector(fx.tiles(spark, path).where(~F.col("blank"))), "mean")


def _masked(spark, path):
    return fx.tiles(spark, path).withColumn("on", F.col("vec_id") % 3 != 0)


ON = "CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END"


@query(
    "a10_masked_mean_pool",
    fx.with_sql(
        f"SELECT slide_id, j, {_value(f'sum(x * {ON}) / (sum({ON}) + 1e-7)')} FROM long GROUP BY slide_id, j", fx.TILES, LONG
    ),
)
def a10(spark, path):
    return _exploded(po.masked_mean_pool(_masked(spark, path), ["slide_id"], "on"), "pooled", 6, "slide_id")


@query(
    "a11_max_pool",
    fx.with_sql(
        f"SELECT slide_id, j, {_value(f'max(CASE WHEN {ON} = 1 THEN x ELSE -10000 END)')} FROM long GROUP BY slide_id, j",
        fx.TILES,
        LONG,
    ),
)
def a11(spark, path):
    return _exploded(po.max_pool(_masked(spark, path), ["slide_id"], "on"), "pooled", 6, "slide_id")


@query(
    "a12_avg_max_pool",
    fx.with_sql(
        f"""SELECT slide_id, j, {_value(f'sum(x * {ON}) / (sum({ON}) + 1e-7)')}, max({ON}) = 1 AS unmasked FROM long GROUP BY slide_id, j
            UNION ALL SELECT slide_id, j + 64, {_value('max(x)')}, max({ON}) = 1 FROM long GROUP BY slide_id, j""",
        fx.TILES,
        LONG,
    ),
)
def a12(spark, path):
    pooled = po.avg_max_pool(_masked(spark, path), ["slide_id"], "on")
    return _exploded(pooled, "pooled", 6, "slide_id", "unmasked")


def _logits(spark, path):
    return _masked(spark, path).withColumn("logit", (F.col("vec_id") % 17) / 5.0)


SOFT = """soft AS MATERIALIZED (
  SELECT slide_id, vec_id, e / sum(e) OVER (PARTITION BY slide_id) AS weight FROM (
    SELECT slide_id, vec_id, CASE WHEN vec_id % 3 <> 0 THEN exp((vec_id % 17) / 5.0) ELSE 0 END AS e FROM fx_tiles) t)"""


@query(
    "a13_attention_pool",
    fx.with_sql(
        f"""SELECT l.slide_id, j, {_value('sum(x * weight)')} FROM long l JOIN soft s ON s.vec_id = l.vec_id GROUP BY l.slide_id, j""",
        fx.TILES,
        LONG,
        SOFT,
    ),
)
def a13(spark, path):
    return _exploded(po.attention_pool(_logits(spark, path), ["slide_id"], "logit", "on"), "pooled", 6, "slide_id")


@query(
    "a13_attention_weights",
    fx.with_sql("SELECT slide_id, vec_id, round(weight, 8) AS weight FROM soft", fx.TILES, SOFT),
)
def a13_weights(spark, path):
    weighted = po.attention_weights(_logits(spark, path), ["slide_id"], "logit", "on")
    return weighted.select("slide_id", "vec_id", F.round("weight", 8).alias("weight"))


# --- vectors ---------------------------------------------------------------


@query(
    "v1_zscore",
    fx.with_sql(
        """, s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS d FROM raw GROUP BY j)
           SELECT vec_id, r.j, round((x - m) / d, 5) + 0.0 AS x FROM raw r JOIN s ON s.j = r.j""",
        RAW,
    ),
)
def v1(spark, path):
    vecs = fx.table(spark, path, "embeddings")
    return _exploded(ve.zscore(vecs, po.vector_stats(vecs, "embedding"), "embedding"), "z", 5, "vec_id")


BACKGROUND = "background AS MATERIALIZED (SELECT j, CAST(avg(x) AS FLOAT) AS m FROM long WHERE NOT blank GROUP BY j)"


@query(
    "v2_fill_blanks",
    fx.with_sql(
        f"SELECT vec_id, l.j, {_value('CASE WHEN blank THEN m ELSE x END', 5)} FROM long l JOIN background b ON b.j = l.j",
        fx.TILES,
        LONG,
        BACKGROUND,
    ),
)
def v2(spark, path):
    tiles = fx.tiles(spark, path)
    background = po.mean_vector(tiles.where(~F.col("blank")))
    return _exploded(ve.fill_blanks(tiles, background), "features", 5, "vec_id")


@query(
    "v3_foreground_mask",
    fx.with_sql(
        """SELECT slide_id, CAST(gx * 100 + gy AS INT) AS pos, NOT blank AS active FROM fx_tiles
           UNION ALL SELECT DISTINCT slide_id, -1, true FROM fx_tiles""",
        fx.TILES,
    ),
)
def v3(spark, path):
    tiles = fx.tiles(spark, path).withColumn("pos", F.col("gx") * 100 + F.col("gy"))
    return ve.foreground_mask(tiles, ["slide_id"], with_cls=True)


@query(
    "v12_select_unmasked",
    fx.with_sql(
        f"""SELECT slide_id, vec_id, row_number() OVER (PARTITION BY slide_id ORDER BY {fx.md5_sql('42', 'vec_id')}, vec_id) AS rn
            FROM fx_tiles WHERE NOT blank""",
        fx.TILES,
    ),
)
def v12(spark, path):
    return ve.select_unmasked(fx.tiles(spark, path), ["vec_id"], ["slide_id"], 42).select("slide_id", "vec_id", "rn")


def _groups(where: str, name: str) -> str:
    return f"""SELECT slide_id, vec_id, CAST(least((rn - 1) // per, 3) AS INT) AS {name} FROM (
      SELECT slide_id, vec_id, count(*) OVER (PARTITION BY slide_id) // 4 AS per,
        row_number() OVER (PARTITION BY slide_id ORDER BY {fx.md5_sql('42', 'vec_id')}, vec_id) AS rn FROM fx_tiles {where}) t"""


@query("w6_token_groups", fx.with_sql(_groups("", "grp"), fx.TILES))
def w6(spark, path):
    return ve.token_groups(fx.tiles(spark, path), 4, 42, ["vec_id"], ["slide_id"]).select("slide_id", "vec_id", "grp")


@query("w6_masked_copies", fx.with_sql(_groups("WHERE NOT blank", "copy"), fx.TILES))
def w6_copies(spark, path):
    copies = ve.masked_copies(fx.tiles(spark, path), 4, 42, ["vec_id"], ["slide_id"])
    return copies.select("slide_id", "vec_id", "copy")


@query(
    "w4_nearest_to_centers",
    fx.with_sql(
        """, centers AS (SELECT label AS center_id, j, avg(x) AS m FROM raw GROUP BY label, j),
             d AS (SELECT center_id, vec_id, sqrt(sum((x - m) * (x - m))) AS distance FROM raw r JOIN centers c ON c.j = r.j GROUP BY 1, 2)
           SELECT center_id, vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY center_id ORDER BY distance, vec_id) AS INT) AS rank
           FROM d QUALIFY rank <= 10""",
        RAW,
    ),
)
def w4(spark, path):
    vecs = fx.table(spark, path, "embeddings")
    centers = po.mean_vector(vecs, "embedding", ["label"]).select(
        F.col("label").alias("center_id"), F.col("mean").alias("center")
    )
    return ve.nearest_to_centers(vecs, centers, 10, features="embedding").withColumn("distance", F.round("distance", 6))


@query(
    "g20_positional_encoding",
    fx.with_sql(
        """SELECT vec_id, j, round(x + CASE WHEN j % 2 = 0 THEN sin(p * f) ELSE cos(p * f) END, 5) + 0.0 AS x FROM (
             SELECT vec_id, j, CAST(x AS DOUBLE) AS x, CAST(CASE WHEN j < 32 THEN gx ELSE gy END AS DOUBLE) AS p,
               pow(10000, -(((j % 32) // 2) * 2) / 32.0) AS f FROM long) t""",
        fx.TILES,
        LONG,
    ),
)
def g20(spark, path):
    return _exploded(ve.add_positions(fx.tiles(spark, path), "gx", "gy", DIM), "encoded", 5, "vec_id")


def _weights() -> np.ndarray:
    i, o = np.meshgrid(np.arange(DIM), np.arange(16), indexing="ij")
    return np.cos(i * 0.7 + o * 1.3)


@query(
    "v4_project",
    fx.with_sql(
        """, y AS (SELECT vec_id, blank, o AS j, sum(x * cos(j * 0.7::DOUBLE + o * 1.3::DOUBLE)) AS s
               FROM (SELECT *, unnest(range(0, 16)) AS o FROM long) t GROUP BY 1, 2, 3),
             u AS (SELECT *, s / sqrt(2) AS z FROM y), w AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS t FROM u)
           SELECT vec_id, j, round(CASE WHEN blank THEN 0 ELSE 0.5 * s * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t
             + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))) END, 5) + 0.0 AS x FROM w""",
        fx.TILES,
        LONG,
    ),
)
def v4(spark, path):
    tiles = fx.tiles(spark, path).withColumn("on", ~F.col("blank"))
    return _exploded(ve.project(tiles, _weights(), mask="on"), "projected", 5, "vec_id")


def _encoder():
    def encode(x):
        return np.stack([x.mean(axis=1), x.max(axis=1), (x * x).sum(axis=1)], axis=1).astype(np.float32)

    return encode


@query(
    "v5_embed_tiles",
    fx.with_sql(
        f"""SELECT vec_id, round(avg(CAST(x AS DOUBLE)), 4) + 0.0 AS e0, round(max(x)::DOUBLE, 4) + 0.0 AS e1,
              round(sum(CAST(x AS DOUBLE) * x), 4) + 0.0 AS e2 FROM long GROUP BY vec_id""",
        fx.TILES,
        LONG,
    ),
)
def v5(spark, path):
    made = ve.embed_tiles(fx.tiles(spark, path).select("vec_id", "features"), _encoder, "features", out="e", shape=[DIM])
    part = lambda i: (F.round(F.col("e")[i].cast("double"), 4) + 0.0).alias(f"e{i}")
    return made.select("vec_id", part(0), part(1), part(2))


# --- augmentation ----------------------------------------------------------

EXTENT = {"h": 10, "w": 5}


def _grid(spark, path):
    """Tiles as grids of 10 rows and 5 columns."""
    return (
        fx.tiles(spark, path)
        .select("slide_id", "vec_id", F.col("gx").alias("row"), F.col("gy").alias("col"), "features", "blank")
        .withColumn("h", F.lit(10))
        .withColumn("w", F.lit(5))
    )


@query(
    "v6_flip",
    fx.with_sql(
        f"""SELECT vec_id, CASE WHEN {fx.uniform_sql('42v', 'slide_id')} < 0.5 THEN 9 - gx ELSE gx END AS row,
              CASE WHEN {fx.uniform_sql('42h', 'slide_id')} < 0.5 THEN 4 - gy ELSE gy END AS col FROM fx_tiles""",
        fx.TILES,
    ),
)
def v6(spark, path):
    flipped = au.flip(au.flip(_grid(spark, path), "h", 0.5, 42, ["slide_id"]), "v", 0.5, 42, ["slide_id"])
    return flipped.select("vec_id", "row", "col")


@query(
    "v7_rot90",
    fx.with_sql(
        f"""SELECT vec_id, CAST(CASE k WHEN 1 THEN 4 - gy WHEN 2 THEN 9 - gx WHEN 3 THEN gy ELSE gx END AS INT) AS row,
              CAST(CASE k WHEN 1 THEN gx WHEN 2 THEN 4 - gy WHEN 3 THEN 9 - gx ELSE gy END AS INT) AS col,
              CAST(CASE WHEN k % 2 = 1 THEN 5 ELSE 10 END AS INT) AS h, CAST(CASE WHEN k % 2 = 1 THEN 10 ELSE 5 END AS INT) AS w
            FROM (SELECT *, CAST(floor({fx.uniform_sql('42rot', 'slide_id')} * 4) AS INT) AS k FROM fx_tiles) t""",
        fx.TILES,
    ),
)
def v7(spark, path):
    return au.random_rot90(_grid(spark, path), 42, ["slide_id"]).select("vec_id", "row", "col", "h", "w")


@query(
    "v8_random_apply",
    fx.with_sql(
        f"""SELECT vec_id, {fx.uniform_sql('42', 'slide_id')} < 0.4 AS per_bag, {fx.uniform_sql('43', "'batch'")} < 0.4 AS per_batch
            FROM fx_tiles""",
        fx.TILES,
    ),
)
def v8(spark, path):
    bags = au.random_apply(fx.tiles(spark, path), 0.4, 42, ["slide_id"], out="per_bag")
    return au.random_apply(bags, 0.4, 43, ["slide_id"], per="batch", out="per_batch").select("vec_id", "per_bag", "per_batch")


U_A, U_B = fx.uniform_sql("42a", "l.vec_id", "l.j"), fx.uniform_sql("42b", "l.vec_id", "l.j")


@query(
    "v9_add_noise",
    fx.with_sql(
        f"""SELECT l.vec_id, l.j, {_value(f"CASE WHEN blank THEN x ELSE CAST(x + 0.1 * sqrt(-2 * ln(1 - {U_A})) * cos(2 * pi() * {U_B}) AS FLOAT) END", 5)}
            FROM long l""",
        fx.TILES,
        LONG,
    ),
)
def v9(spark, path):
    return _exploded(au.add_noise(fx.tiles(spark, path), 0.1, 42, ["vec_id"]), "features", 5, "vec_id")


U_N, U_K = fx.uniform_sql("42n", "slide_id"), fx.uniform_sql("42k", "slide_id")


@query(
    "v10_dampen_blocks",
    fx.with_sql(
        f""", bags AS (SELECT DISTINCT slide_id, CAST(floor({U_N} * 7) AS INT) AS m, {U_K} < 0.5 AS to_background FROM fx_tiles),
              blocks AS (SELECT slide_id, b, to_background, m, row_number() OVER (PARTITION BY slide_id
                ORDER BY {fx.md5_sql('42', 'slide_id', 'b')}, slide_id, b) AS rn FROM (SELECT *, unnest(range(0, 10)) AS b FROM bags) t),
              chosen AS (SELECT slide_id, b // 2 AS br, b % 2 AS bc, to_background FROM blocks WHERE rn <= m),
              means AS (SELECT l.slide_id, br, bc, j, sum(CAST(x AS DOUBLE)) / 4 AS mean FROM long l JOIN chosen c
                ON c.slide_id = l.slide_id AND l.gx // 2 = br AND l.gy // 2 = bc GROUP BY 1, 2, 3, 4)
            SELECT l.vec_id, l.j, c.br IS NOT NULL AS dampened,
              {_value('CASE WHEN c.br IS NULL THEN x WHEN c.to_background THEN 0 ELSE n.mean END', 5)} FROM long l
            LEFT JOIN chosen c ON c.slide_id = l.slide_id AND l.gx // 2 = c.br AND l.gy // 2 = c.bc
            LEFT JOIN means n ON n.slide_id = l.slide_id AND n.br = c.br AND n.bc = c.bc AND n.j = l.j""",
        fx.TILES,
        LONG,
    ),
)
def v10(spark, path):
    return _exploded(au.dampen_blocks(_grid(spark, path), 2, 0.6, 42, "slide_id"), "features", 5, "vec_id", "dampened")


@query(
    "v11_random_crop",
    fx.with_sql(
        f""", s AS (SELECT DISTINCT slide_id, 32 + CAST(floor({fx.uniform_sql('42s', 'slide_id')} * 32) AS INT) AS side FROM fx_mask),
              k AS (SELECT slide_id, side, CAST(floor({fx.uniform_sql('42x', 'slide_id')} * greatest(64 - side, 1)) AS INT) AS x0,
                CAST(floor({fx.uniform_sql('42y', 'slide_id')} * greatest(48 - side, 1)) AS INT) AS y0 FROM s)
            SELECT m.slide_id, CAST(r - y0 AS INT) AS r, CAST(c - x0 AS INT) AS c, v FROM fx_mask m JOIN k ON k.slide_id = m.slide_id
            WHERE r >= y0 AND r < y0 + side AND c >= x0 AND c < x0 + side""",
        fx.MASK,
    ),
)
def v11(spark, path):
    sized = fx.mask(spark, path).withColumn("h", F.lit(fx.MASK_H)).withColumn("w", F.lit(fx.MASK_W))
    return au.random_crop(sized, 0.5, 42, ["slide_id"]).drop("h", "w")


# --- stain -----------------------------------------------------------------

TEMPLATE = {
    "ch0": {"avg_mean": 140.0, "avg_std": 12.0, "std_mean": 40.0, "std_std": 5.0},
    "ch1": {"avg_mean": 120.0, "avg_std": 8.0, "std_mean": 30.0, "std_std": 4.0},
    "ch2": {"avg_mean": 100.0, "avg_std": 6.0, "std_mean": 20.0, "std_std": 3.0},
}
STATS = "stats AS MATERIALIZED (SELECT image_id, " + ", ".join(
    f"avg(ch{i}) AS m{i}, stddev_pop(ch{i}) AS s{i}" for i in range(3)
) + " FROM fx_pixels GROUP BY image_id)"


@query(
    "a16_channel_stats",
    fx.with_sql(
        "SELECT image_id, "
        + ", ".join(f"round(m{i}, 6) AS ch{i}_mean, round(s{i}, 6) AS ch{i}_std" for i in range(3))
        + " FROM stats",
        fx.PIXELS,
        STATS,
    ),
)
def a16(spark, path):
    stats = st.channel_stats(fx.pixels(spark, path))
    return stats.select("image_id", *[F.round(c, 6).alias(c) for c in stats.columns if c != "image_id"])


def _draw(tag: str, distribution: str) -> str:
    if distribution == "normal":
        u1, u2 = fx.uniform_sql(f"42{tag}a", "image_id"), fx.uniform_sql(f"42{tag}b", "image_id")
        return f"sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2})"
    u = f"({fx.uniform_sql(f'42{tag}', 'image_id')} - 0.5)"
    if distribution == "laplace":
        return f"-sign({u}) * ln(greatest(1 - 2 * abs({u}), 1e-300))"
    return f"6.0 * {u}"


def _targets_sql(distribution: str, hyper: float) -> str:
    scale = 1 if distribution == "uniform" else 1 + hyper
    parts = []
    for c, t in TEMPLATE.items():
        parts.append(f"{t['avg_mean']} + ({_draw(c + 'm', distribution)}) * {t['avg_std'] * scale}::DOUBLE AS {c}_target_mean")
        parts.append(f"{t['std_mean']} + ({_draw(c + 's', distribution)}) * {t['std_std'] * scale}::DOUBLE AS {c}_target_std")
    return "targets AS MATERIALIZED (SELECT image_id, " + ", ".join(parts) + " FROM (SELECT DISTINCT image_id FROM fx_pixels) i)"


TARGET_COLS = [f"{c}_target_{k}" for c in TEMPLATE for k in ("mean", "std")]


def _template_query(distribution: str):
    sql = fx.with_sql(
        "SELECT image_id, " + ", ".join(f"round({c}, 5) AS {c}" for c in TARGET_COLS) + " FROM targets",
        fx.PIXELS,
        _targets_sql(distribution, 0.1),
    )

    @query(f"t2_virtual_template_{distribution}", sql)
    def t2(spark, path):
        made = st.virtual_template(fx.pixels(spark, path), TEMPLATE, distribution, 0.1, 42)
        return made.select("image_id", *[F.round(c, 5).alias(c) for c in TARGET_COLS])

    return t2


for _distribution in ("normal", "laplace", "uniform"):
    _template_query(_distribution)


def _moved(i: int) -> str:
    return (
        f"(ch{i} - m{i}) * (ch{i}_target_std / greatest(1e-4, least(s{i}, 255.0))) + ch{i}_target_mean"
    )


JOINED = """FROM fx_pixels p JOIN stats s ON s.image_id = p.image_id JOIN targets t ON t.image_id = p.image_id"""


@query(
    "t1_reinhard",
    fx.with_sql(
        "SELECT p.image_id, l_orderkey, l_linenumber, "
        + ", ".join(f"round({_moved(i)}, 4) + 0.0 AS ch{i}" for i in range(3))
        + f" {JOINED}",
        fx.PIXELS,
        STATS,
        _targets_sql("uniform", 0.0),
    ),
)
def t1(spark, path):
    pixels = fx.pixels(spark, path)
    targets = st.virtual_template(pixels, TEMPLATE, "uniform", 0.0, 42)
    moved = st.reinhard(pixels, targets, to_bytes=False)
    return moved.withColumns({c: F.round(c, 4) + 0.0 for c in st.CHANNELS})


@query(
    "t1_reinhard_bytes",
    fx.with_sql(
        "SELECT p.image_id, "
        + ", ".join(
            f"CAST(sum(CAST(floor(round(greatest(0.0, least({_moved(i)}, 255.0)), 7)) AS BIGINT)) AS BIGINT) AS ch{i}" for i in range(3)
        )
        + f" {JOINED} GROUP BY p.image_id",
        fx.PIXELS,
        STATS,
        _targets_sql("uniform", 0.0),
    ),
)
def t1_bytes(spark, path):
    pixels = fx.pixels(spark, path)
    targets = st.virtual_template(pixels, TEMPLATE, "uniform", 0.0, 42)
    return st.reinhard(pixels, targets).groupBy("image_id").agg(*[F.sum(c).alias(c) for c in st.CHANNELS])


U_P = fx.uniform_sql("5", "p.image_id")


@query(
    "t3_augment_with_prob",
    fx.with_sql(
        f"SELECT p.image_id, l_orderkey, l_linenumber, {U_P} < 0.3 AS augmented, "
        + ", ".join(f"round(CASE WHEN {U_P} < 0.3 THEN {_moved(i)} ELSE ch{i} END, 4) + 0.0 AS ch{i}" for i in range(3))
        + f" {JOINED}",
        fx.PIXELS,
        STATS,
        _targets_sql("normal", 0.0),
    ),
)
def t3(spark, path):
    pixels = fx.pixels(spark, path)
    targets = st.virtual_template(pixels, TEMPLATE, "normal", 0.0, 42)
    return st.augment_with_prob(pixels, targets, 0.3, 5).withColumns({c: F.round(c, 4) + 0.0 for c in st.CHANNELS})


@query(
    "g6_grayscale",
    fx.with_sql(
        """SELECT image_id, l_orderkey, l_linenumber, round(0.2125 * ch0 / 255 + 0.7154 * ch1 / 255 + 0.0721 * ch2 / 255, 6) + 0.0 AS gray
           FROM fx_pixels""",
        fx.PIXELS,
    ),
)
def g6(spark, path):
    gray = sc.grayscale(F.col("ch0") / 255, F.col("ch1") / 255, F.col("ch2") / 255)
    return fx.pixels(spark, path).select("image_id", "l_orderkey", "l_linenumber", (F.round(gray, 6) + 0.0).alias("gray"))


@query(
    "g18_background_tile",
    """WITH px AS (SELECT l_partkey AS image_id, CASE WHEN l_quantity >= 12 THEN 255 ELSE CAST(220 + l_quantity AS INT) END AS v FROM lineitem),
       c AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2),
       m AS (SELECT image_id, v AS mode_value FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, v) = 1)
       SELECT p.image_id, min(p.v) AS min_value, max(mode_value) AS mode_value, round(avg(p.v), 6) AS mean_value
       FROM px p JOIN m ON m.image_id = p.image_id GROUP BY p.image_id
       HAVING min(p.v) < 255 AND max(mode_value) = 255 AND avg(p.v) > 240""",
)
def g18(spark, path):
    q = F.col("l_quantity")
    pixels = fx.table(spark, path, "lineitem").select(
        F.col("l_partkey").alias("image_id"), F.when(q >= 12, 255).otherwise((220 + q).cast("int")).alias("v")
    )
    return st.background_tiles(pixels, "v").withColumn("mean_value", F.round("mean_value", 6))


# --- colour spaces ---------------------------------------------------------


def _lab_sql(r: str, g: str, b: str) -> list[str]:
    linear = [f"(CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END)" for c in (r, g, b)]
    xyz = ["(" + " + ".join(f"{m} * {c}" for m, c in zip(row, linear)) + f") / {w}" for row, w in zip(co.XYZ, co.WHITE)]
    f = [f"(CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0 / 3) ELSE 7.787 * ({c}) + 16.0 / 116 END)" for c in xyz]
    light = f"(CASE WHEN {xyz[1]} > 0.008856 THEN 116 * {f[1]} - 16 ELSE 903.3 * ({xyz[1]}) END) * 2.55"
    return [light, f"500 * ({f[0]} - {f[1]}) + 128", f"200 * ({f[1]} - {f[2]}) + 128"]


def _hsv_sql(r: str, g: str, b: str) -> list[str]:
    top, span = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    turn = f"(CASE WHEN {span} = 0 THEN 0 WHEN {top} = {r} THEN ({g} - {b}) / {span} WHEN {top} = {g} THEN 2 + ({b} - {r}) / {span} ELSE 4 + ({r} - {g}) / {span} END)"
    return [f"(CASE WHEN {turn} < 0 THEN {turn} + 6 ELSE {turn} END) * 30", f"CASE WHEN {top} > 0 THEN {span} / {top} * 255 ELSE 0 END", top]


def _hed_sql(r: str, g: str, b: str) -> list[str]:
    light = [f"(ln(greatest({c} / 255.0, 1e-6)) / ln(1e-6))" for c in (r, g, b)]
    unmix = np.linalg.inv(np.array(co.STAINS))
    return ["greatest(0, " + " + ".join(f"({float(unmix[i][j])}) * {light[i]}" for i in range(3)) + ")" for j in range(3)]


def _space_sql(made: list[str]) -> str:
    shown = ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for e, n in zip(made, st.CHANNELS))
    return fx.with_sql(f"SELECT image_id, l_orderkey, l_linenumber, {shown} FROM fx_pixels", fx.PIXELS)


def _space(spark, path, space: str):
    moved = st.convert(fx.pixels(spark, path), space)
    return moved.select("image_id", "l_orderkey", "l_linenumber", *[(F.round(c, 5) + 0.0).alias(c) for c in st.CHANNELS])


@query("t4_rgb_lab", _space_sql(_lab_sql("ch0", "ch1", "ch2")))
def t4_lab(spark, path):
    return _space(spark, path, "LAB")


@query("t4_rgb_hsv", _space_sql(_hsv_sql("ch0", "ch1", "ch2")))
def t4_hsv(spark, path):
    return _space(spark, path, "HSV")


@query("t4_rgb_hed", _space_sql(_hed_sql("ch0", "ch1", "ch2")))
def t4_hed(spark, path):
    return _space(spark, path, "HED")


LAB_TARGET = {"ch0": (140.0, 30.0), "ch1": (150.0, 12.0), "ch2": (120.0, 9.0)}


def _stain_sql() -> str:
    lab = ", ".join(f"{e} AS {c}" for e, c in zip(_lab_sql("ch0", "ch1", "ch2"), LAB_TARGET))
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in LAB_TARGET)
    moved = ", ".join(
        f"CAST(floor(greatest(0, least(({c} - {c}_m) * ({s} / greatest(1e-4, least({c}_s, 255))) + {m}, 255))) AS DOUBLE) AS {c}"
        for c, (m, s) in LAB_TARGET.items()
    )
    y = "((ch0 * 100 / 255 + 16) / 116)"
    roots = [f"({y} + (ch1 - 128) / 500)", y, f"({y} - (ch2 - 128) / 200)"]
    xyz = [f"((CASE WHEN {t} > 0.206893 THEN pow({t}, 3) ELSE ({t} - 16.0 / 116) / 7.787 END) * {w})" for t, w in zip(roots, co.WHITE)]
    linear = ["(" + " + ".join(f"({m}) * {c}" for m, c in zip(row, xyz)) + ")" for row in co.RGB]
    rgb = ", ".join(
        f"round(255 * greatest(0, least(1, CASE WHEN {c} > 0.0031308 THEN 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 ELSE 12.92 * {c} END)), 3) + 0.0 AS {n}"
        for c, n in zip(linear, "rgb")
    )
    return fx.with_sql(
        f""", lab AS MATERIALIZED (SELECT image_id, l_orderkey, l_linenumber, {lab} FROM fx_pixels),
              stats AS (SELECT image_id, {stats} FROM lab GROUP BY image_id),
              moved AS MATERIALIZED (SELECT l.image_id, l_orderkey, l_linenumber, {moved} FROM lab l JOIN stats s ON s.image_id = l.image_id)
            SELECT image_id, l_orderkey, l_linenumber, {rgb} FROM moved""",
        fx.PIXELS,
    )


@query("t1_normalize_stain_lab", _stain_sql())
def t1_lab(spark, path):
    pixels = fx.pixels(spark, path)
    template = {c: {"avg_mean": m, "avg_std": 0.0, "std_mean": s, "std_std": 0.0} for c, (m, s) in LAB_TARGET.items()}
    moved = st.normalize_stain(pixels, st.virtual_template(pixels, template), "LAB")
    return moved.select("image_id", "l_orderkey", "l_linenumber", *[(F.round(c, 3) + 0.0).alias(n) for c, n in zip(st.CHANNELS, "rgb")])
