"""The model's arithmetic over tiles, with weights that follow from a rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import attention as at
from ..operators import influence as inf
from ..operators import landmarks as lm
from ..operators import patches as pt
from ..operators import stencil as st
from ..plans import fitting as ft
from . import fixtures as fx
from .registry import query


def rule(*shape: int, seed: int, by: float) -> np.ndarray:
    """Weights of a shape: sevenths of a repeating pattern, small enough for the values they meet."""
    n = int(np.prod(shape))
    return (((np.arange(n) * (2 * seed + 3) + seed) % 7) - 3.0).reshape(shape) / by


def _exploded(df, *key):
    return df.select(*key, F.posexplode("features").alias("pos", "value")).withColumn("value", F.round(F.col("value") + F.lit(0.0), 6))


# --- convolution -------------------------------------------------------------

KERNELS = [rule(3, 3, 2, seed=1, by=10.0), rule(5, 5, 2, seed=2, by=20.0), rule(4, 4, 2, seed=3, by=15.0)]
POINTWISE = rule(2, 2, seed=4, by=5.0)

CELLS = """cells AS MATERIALIZED (
  SELECT slide_id, gx, gy, sum(f0) AS f0, sum(f1) AS f1 FROM fx_lattice GROUP BY ALL)"""


def _convolve_sql() -> str:
    """A stencil join: every kernel entry is a row, every cell meets the neighbour it points at."""
    entries = [
        (i - (len(k) - 1) // 2, j - (len(k) - 1) // 2, float(k[i, j, 0]), float(k[i, j, 1]))
        for k in KERNELS
        for i in range(len(k))
        for j in range(len(k))
    ]
    values = ", ".join(f"({di}, {dj}, {w0!r}::DOUBLE, {w1!r}::DOUBLE)" for di, dj, w0, w1 in entries)
    p = POINTWISE.tolist()
    mixed = lambda d: f"CASE WHEN c.f0 = 0 AND c.f1 = 0 THEN 0.0 ELSE round(c.f{d} + coalesce(a, 0) * {p[0][d]} + coalesce(b, 0) * {p[1][d]}, 6) + 0.0 END"
    return fx.with_sql(
        f""", weights(di, dj, w0, w1) AS (VALUES {values}),
        reached AS (SELECT n.slide_id, n.gx - di AS gx, n.gy - dj AS gy, sum(n.f0 * w0) AS a, sum(n.f1 * w1) AS b
          FROM cells n CROSS JOIN weights GROUP BY ALL)
        SELECT c.slide_id, c.gx, c.gy, unnest([0, 1]) AS pos, unnest([{mixed(0)}, {mixed(1)}]) AS value
        FROM cells c LEFT JOIN reached s USING (slide_id, gx, gy)""",
        fx.LATTICE,
        CELLS,
    )


@query("n1_grid_convolve", _convolve_sql())
def n1(spark, path):
    return _exploded(st.grid_convolve(fx.lattice(spark, path), KERNELS, pointwise=POINTWISE), "slide_id", "gx", "gy")


# --- attention ---------------------------------------------------------------

HEADS, INNER = 2, 4
SELF = at.AttentionWeights(
    rule(2, INNER, seed=1, by=60.0), rule(2, INNER, seed=2, by=60.0), rule(2, INNER, seed=3, by=30.0), rule(INNER, 2, seed=5, by=4.0), np.array([0.5, -0.25]), HEADS
)
RELATIVE = at.AttentionWeights(
    SELF.query, SELF.key, SELF.value, SELF.out, SELF.bias, HEADS, rel_rows=rule(15, INNER // HEADS, seed=2, by=8.0), rel_cols=rule(9, INNER // HEADS, seed=4, by=8.0)
)


def _projected(w: np.ndarray, name: str) -> str:
    return ", ".join(f"f0 * {float(w[0, c])!r} + f1 * {float(w[1, c])!r} AS {name}{c}" for c in range(w.shape[1]))


def _attend_sql(queries: str, keys: str, key: str, token: str, on: str, bias=lambda h: "0") -> str:
    """Plain softmax over all pairs of a query and a key; ``bias(h)`` is added to the logits of a head."""
    w, d = SELF, INNER // HEADS
    scale = w.head_width**-0.5
    logit = lambda h: "(" + " + ".join(f"q.q{h * d + i} * k.k{h * d + i}" for i in range(d)) + f") * {scale!r} + {bias(h)}"
    logits = ", ".join(f"{logit(h)} AS l{h}" for h in range(HEADS))
    names = ", ".join(f"q.{c}" for c in (key + ", " + token).split(", "))
    tops = ", ".join(f"max(l{h}) OVER (PARTITION BY {key}, {token}) AS t{h}" for h in range(HEADS))
    means = ", ".join(f"sum(exp(l{c // d} - t{c // d}) * v{c}) / sum(exp(l{c // d} - t{c // d})) AS m{c}" for c in range(INNER))
    outs = [f"round({float(w.bias[o])!r} + " + " + ".join(f"m{c} * {float(w.out[c, o])!r}" for c in range(INNER)) + ", 6) + 0.0" for o in range(2)]
    return f""",
    qs AS MATERIALIZED (SELECT {key}, {token}, f0, f1, {_projected(w.query, "q")} FROM {queries}),
    ks AS MATERIALIZED (SELECT {key}, {on.replace("k.", "")}, {_projected(w.key, "k")}, {_projected(w.value, "v")} FROM {keys} WHERE f0 <> 0 OR f1 <> 0),
    pairs AS (SELECT {names}, {logits}, k.v0, k.v1, k.v2, k.v3 FROM qs q JOIN ks k ON q.{key} = k.{key} WHERE q.f0 <> 0 OR q.f1 <> 0),
    means AS (SELECT {key}, {token}, {means} FROM (SELECT *, {tops} FROM pairs) t GROUP BY ALL)
    SELECT {names}, unnest([0, 1]) AS pos, unnest([coalesce({outs[0]}, 0.0), coalesce({outs[1]}, 0.0)]) AS value
    FROM qs q LEFT JOIN means m USING ({key}, {token})"""


PATIENT_CELLS = """patient_cells AS MATERIALIZED (
  SELECT patient_id, slide_id, gx, gy, sum(f0) AS f0, sum(f1) AS f1 FROM fx_lattice GROUP BY ALL)"""


@query(
    "n2_self_attention",
    fx.with_sql(_attend_sql("patient_cells", "patient_cells", "patient_id", "slide_id, gx, gy", "k.slide_id, k.gx, k.gy"), fx.LATTICE, PATIENT_CELLS),
)
def n2(spark, path):
    tiles = fx.lattice(spark, path)
    cells = pt.coalesce_cells(tiles, width=2).join(tiles.select("slide_id", "patient_id").distinct(), "slide_id")
    live = cells.withColumn("live", F.exists("features", lambda x: x != 0))
    found = at.self_attention(live, SELF, by=["patient_id"], token=["slide_id", "gx", "gy"], mask="live")
    return _exploded(found, "patient_id", "slide_id", "gx", "gy").withColumns({c: F.col(c).cast("int") for c in ("gx", "gy")})


def _relative_bias(h: int) -> str:
    """The two products of the query's part of a head with the tables' rows, chosen by offset."""
    d = INNER // HEADS
    terms = []
    for axis, table in (("gx", RELATIVE.rel_rows), ("gy", RELATIVE.rel_cols)):
        rows = at.relative_table(table, 15)
        for i in range(d):
            column = "[" + ", ".join(repr(float(x)) for x in rows[:, i]) + "]"
            terms.append(f"q.q{h * d + i} * {column}[1 + CAST(q.{axis} - k.{axis} * 2 + 6 AS INT)]")
    return " + ".join(terms)


ORDER_CELLS = """order_cells AS MATERIALIZED (
  SELECT slide_id, gx, gy, sum(f0) AS f0, sum(f1) AS f1 FROM fx_order_tiles GROUP BY ALL),
coarse AS MATERIALIZED (
  SELECT slide_id, gx // 2 AS gx, gy // 2 AS gy, sum(f0) AS f0, sum(f1) AS f1 FROM fx_order_tiles GROUP BY ALL)"""


@query(
    "n3_relative_attention",
    fx.with_sql(_attend_sql("order_cells", "coarse", "slide_id", "gx, gy", "k.gx, k.gy", _relative_bias), fx.ORDER_TILES, ORDER_CELLS),
)
def n3(spark, path):
    tiles = fx.order_tiles(spark, path)
    fine = pt.coalesce_cells(tiles, width=2)
    halves = tiles.withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in ("gx", "gy")})
    both = [df.withColumn("live", F.exists("features", lambda x: x != 0)) for df in (fine, pt.coalesce_cells(halves, width=2))]
    found = at.attend(*both, RELATIVE, by=["slide_id"], token=["gx", "gy"], mask="live", query_shape=(8, 8), key_shape=(4, 4))
    return _exploded(found, "slide_id", "gx", "gy").withColumns({c: F.col(c).cast("int") for c in ("gx", "gy")})


# --- influence of regions ------------------------------------------------------

HEAD = rule(64, 2, seed=3, by=40.0)
HEAD_BIAS = [0.2, -0.1]
# regions are the tiles of a label
LEAVE_OUT = f""",
  scored AS MATERIALIZED (SELECT patient_id, label AS region_id, list_sum(list_transform(features[1:4], lambda x: x::DOUBLE)) AS l,
    {", ".join(f"list_dot_product(features::DOUBLE[], {[float(x) for x in HEAD[:, c]]}::DOUBLE[]) AS y{c}" for c in range(2))} FROM fx_tiles),
  regions AS (SELECT patient_id, region_id, count(*) AS n_tiles FROM scored GROUP BY ALL),
  whole AS (SELECT patient_id, sum(exp(l)) AS s, sum(exp(l) * y0) / sum(exp(l)) AS m0, sum(exp(l) * y1) / sum(exp(l)) AS m1 FROM scored GROUP BY ALL),
  without AS (SELECT r.patient_id, r.region_id, sum(exp(l)) AS s, sum(exp(l) * y0) / sum(exp(l)) AS m0, sum(exp(l) * y1) / sum(exp(l)) AS m1
    FROM regions r JOIN scored x ON x.patient_id = r.patient_id AND x.region_id <> r.region_id GROUP BY ALL)
  SELECT r.patient_id, r.region_id, r.n_tiles, round((a.s - coalesce(w.s, 0)) / a.s, 6) AS share, unnest([0, 1]) AS pos,
    unnest([round(1 / (1 + exp(-a.m0 - {HEAD_BIAS[0]})), 6), round(1 / (1 + exp(-a.m1 - {HEAD_BIAS[1]})), 6)]) AS score,
    unnest([round(1 / (1 + exp(-w.m0 - {HEAD_BIAS[0]})), 6), round(1 / (1 + exp(-w.m1 - {HEAD_BIAS[1]})), 6)]) AS score_without
  FROM regions r JOIN whole a USING (patient_id) LEFT JOIN without w ON w.patient_id = r.patient_id AND w.region_id = r.region_id"""


@query("n7_dropout_influence", fx.with_sql(LEAVE_OUT, fx.TILES))
def n7(spark, path):
    tiles = fx.tiles(spark, path).withColumnRenamed("label", "region_id")
    logit = F.aggregate(F.slice("features", 1, 4), F.lit(0.0), lambda s, x: s + x)
    found = inf.dropout_influence(tiles.withColumn("logit", logit), HEAD, HEAD_BIAS, bag=["patient_id"], logit="logit")
    pairs = F.posexplode(F.arrays_zip("score", F.coalesce("score_without", F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))).alias("score_without")))
    flat = found.select("patient_id", "region_id", "n_tiles", F.round("share", 6).alias("share"), pairs.alias("pos", "z"))
    return flat.select("patient_id", "region_id", "n_tiles", "share", "pos", F.round("z.score", 6).alias("score"), F.round("z.score_without", 6).alias("score_without"))


MAP_SQL = """,
  places AS (SELECT slide_id, unnest([0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40]) AS r0 FROM (SELECT DISTINCT slide_id FROM cells) s),
  weighed AS (SELECT p.slide_id, r0 * 100 + c0 AS patch_id, ((p.slide_id + r0 + 3 * c0) % 7 + 1) / 8.0::DOUBLE AS w, r0, c0
    FROM (SELECT slide_id, r0, unnest([0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40]) AS c0 FROM places) p),
  levels AS (SELECT c.slide_id, c.gx, c.gy, count(*) AS coverage, avg((c.f0 + c.f1) / 50 * w) AS v
    FROM cells c JOIN weighed p ON p.slide_id = c.slide_id AND c.gx BETWEEN r0 AND r0 + 7 AND c.gy BETWEEN c0 AND c0 + 7 GROUP BY ALL)
  SELECT slide_id, gx, gy, coverage, round(CASE WHEN sum(v) OVER (PARTITION BY slide_id) > 0 THEN v / sum(v) OVER (PARTITION BY slide_id) ELSE 0 END, 9) AS weight FROM levels"""


@query("n8_attention_map", fx.with_sql(MAP_SQL, fx.LATTICE, CELLS))
def n8(spark, path):
    # patches of 8 x 8 cells, four apart: inner cells lie under four of them
    cells = pt.coalesce_cells(fx.lattice(spark, path), width=2)
    under = lambda c: F.explode(F.filter(F.sequence(F.lit(0), F.lit(40), F.lit(4)), lambda s: F.col(c).between(s, s + 7)))
    placed = cells.withColumn("r0", under("gx")).withColumn("c0", under("gy")).withColumn("patch_id", F.col("r0") * 100 + F.col("c0"))
    weighed = placed.withColumn("weight", (F.get("features", F.lit(0)) + F.get("features", F.lit(1))) / 50)
    side = placed.select("slide_id", "patch_id", (((F.col("slide_id") + F.col("r0") + 3 * F.col("c0")) % 7 + 1) / 8.0).alias("weight")).distinct()
    found = inf.attention_map(weighed, side)
    return found.withColumn("weight", F.round("weight", 9))


# --- landmarks and inverses ----------------------------------------------------


class Matrices:
    """CTEs of matrices as rows ``(slide_id, h, i, j, v)``."""

    def __init__(self):
        self.parts: list[str] = []

    def add(self, body: str) -> str:
        self.parts.append(f"m{len(self.parts)} AS MATERIALIZED ({body})")
        return f"m{len(self.parts) - 1}"

    def product(self, a: str, b: str, by: float = 1.0) -> str:
        return self.add(f"SELECT a.slide_id, a.h, a.i, b.j, {by!r} * sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON b.slide_id = a.slide_id AND b.h = a.h AND b.i = a.j GROUP BY ALL")

    def less(self, n: int, a: str) -> str:
        return self.add(f"SELECT slide_id, h, i, j, CASE WHEN i = j THEN {n} ELSE 0 END - v AS v FROM {a}")

    def inverse(self, a: str, iterations: int) -> str:
        size = self.add(
            f"SELECT r.slide_id, r.h, max(r.s) * max(c.s) AS s FROM (SELECT slide_id, h, i, sum(abs(v)) AS s FROM {a} GROUP BY ALL) r "
            f"JOIN (SELECT slide_id, h, j, sum(abs(v)) AS s FROM {a} GROUP BY ALL) c ON c.slide_id = r.slide_id AND c.h = r.h GROUP BY ALL"
        )
        z = self.add(f"SELECT a.slide_id, a.h, a.j AS i, a.i AS j, a.v / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM {a} a JOIN {size} s ON s.slide_id = a.slide_id AND s.h = a.h")
        for _ in range(iterations):
            az = self.product(a, z)
            z = self.product(z, self.less(13, self.product(az, self.less(15, self.product(az, self.less(7, az))))), 0.25)
        return z

    def residual(self, a: str, z: str, by: str) -> str:
        back = self.product(self.product(a, z), a)
        return self.add(f"SELECT {by}, max(abs(b.v - a.v)) AS residual FROM {a} a JOIN {back} b USING (slide_id, h, i, j) GROUP BY ALL")


def _inverse_sql() -> str:
    m = Matrices()
    a = m.add("SELECT slide_id, 0 AS h, gx % 3 AS i, gy % 3 AS j, sum(f0) / any_value(t) AS v FROM cells JOIN (SELECT slide_id, sum(f0) AS t FROM cells GROUP BY ALL) t USING (slide_id) GROUP BY ALL")
    z = m.inverse(a, 12)
    r = m.residual(a, z, "slide_id")
    return fx.with_sql(f"SELECT slide_id, i, j, round(v, 4) + 0.0 AS value, round(residual, 6) + 0.0 AS residual FROM {z} JOIN {r} USING (slide_id)", fx.LATTICE, CELLS, *m.parts)


@query("n6_pseudo_inverse", _inverse_sql())
def n6(spark, path):
    cells = pt.coalesce_cells(fx.lattice(spark, path), width=2)
    at_place = lambda i, j: F.sum(F.when((F.col("gx") % 3 == i) & (F.col("gy") % 3 == j), F.get("features", F.lit(0))).otherwise(F.lit(0.0)))
    whole = F.sum(F.get("features", F.lit(0)))
    bags = cells.groupBy("slide_id").agg(F.array(*[at_place(i, j) / whole for i in range(3) for j in range(3)]).alias("matrix"))
    found = lm.pseudo_inverses(bags, "matrix", iterations=12).select("slide_id", F.posexplode("inverse").alias("p", "v"), "residual")
    return found.select(
        "slide_id", F.floor(F.col("p") / 3).cast("int").alias("i"), (F.col("p") % 3).alias("j"), (F.round("v", 4) + 0.0).alias("value"), (F.round("residual", 6) + 0.0).alias("residual")
    )


MARKS = 4


# the iterated inverse of every slide inside a join of all its tiles does not end in SQL; tested against plain matrices
@query("n5_landmark_attention")
def n5(spark, path):
    cells = pt.coalesce_cells(fx.lattice(spark, path), width=2).withColumn("live", F.exists("features", lambda x: x != 0))
    found = lm.landmark_attention(cells, SELF, mask="live", landmarks=MARKS)
    flat = found.select("slide_id", *[F.col(c).cast("int").alias(c) for c in ("gx", "gy")], F.posexplode("features").alias("pos", "value"))
    return flat.withColumn("value", F.round("value", 5) + 0.0)


# --- fitting -------------------------------------------------------------------


# gradient descent is tested against a plain one
@query("n9_fit_head")
def n9(spark, path):
    tiles = fx.tiles(spark, path)
    labels = tiles.select("patient_id", (F.col("patient_id") % 2).alias("label"), (F.col("patient_id") % 5 != 0).alias("learn")).distinct()
    return ft.fit_head(tiles, labels, ft.FitParams(epochs=5)).select("epoch", "train_loss", "val_loss", "rate")
