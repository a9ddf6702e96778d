"""Domain tables derived from the given tables, in Spark and in SQL.

Every table reads all rows of its source. Cells without tissue are tiles with a
zero vector, so no row is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_H, MASK_W, FULL_H = 48, 64, 4800.0


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


# --- tiles from embeddings: 50 grid cells per slide ------------------------

TILES = """fx_tiles AS MATERIALIZED (
  SELECT slide_id, CAST(floor(slide_id / 2) AS BIGINT) AS patient_id,
         CAST(k % 10 AS INT) AS gx, CAST(floor(k / 10) AS INT) AS gy, vec_id, label, blank,
         CASE WHEN blank THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS features
  FROM (SELECT vec_id, embedding, label, slide_id, k,
               vec_id % 13 = 0 OR (vec_id * 7 + slide_id) % 11 = 3 OR (slide_id % 2 = 1 AND k % 10 = 6) AS blank
        FROM (SELECT vec_id, embedding, label, CAST(floor(vec_id / 50) AS BIGINT) AS slide_id,
                     vec_id % 50 AS k FROM embeddings) s) t)"""


def tiles(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("vec_id") % 50
    base = table(spark, path, "embeddings").withColumn("slide_id", F.floor(F.col("vec_id") / 50))
    blank = (
        (F.col("vec_id") % 13 == 0)
        | ((F.col("vec_id") * 7 + F.col("slide_id")) % 11 == 3)
        | ((F.col("slide_id") % 2 == 1) & (k % 10 == 6))
    )
    zeros = F.transform("embedding", lambda x: F.lit(0).cast("float"))
    return base.select(
        "slide_id",
        F.floor(F.col("slide_id") / 2).alias("patient_id"),
        (k % 10).cast("int").alias("gx"),
        F.floor(k / 10).cast("int").alias("gy"),
        "vec_id",
        "label",
        blank.alias("blank"),
        F.when(blank, zeros).otherwise(F.col("embedding")).alias("features"),
    )


# --- lattice tiles from lineitem: about 600 tiles per slide, cells repeat ---

LATTICE = """fx_lattice AS MATERIALIZED (
  SELECT l_suppkey AS slide_id, CAST(floor(l_suppkey / 2) AS BIGINT) AS patient_id,
         CAST(l_orderkey % 48 AS INT) AS gx, CAST(l_partkey % 48 AS INT) AS gy,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS f0,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount END AS f1
  FROM lineitem)"""


def lattice(spark: SparkSession, path: str) -> DataFrame:
    off = F.col("l_discount") == 0
    zero = F.lit(0.0)
    return table(spark, path, "lineitem").select(
        F.col("l_suppkey").alias("slide_id"),
        F.floor(F.col("l_suppkey") / 2).alias("patient_id"),
        (F.col("l_orderkey") % 48).cast("int").alias("gx"),
        (F.col("l_partkey") % 48).cast("int").alias("gy"),
        F.array(F.when(off, zero).otherwise(F.col("l_quantity")), F.when(off, zero).otherwise(F.col("l_discount"))).alias(
            "features"
        ),
    )


# --- a few tiles for every order, so that slide ids match files and metadata ---

ORDER_TILES = """fx_order_tiles AS MATERIALIZED (
  SELECT l_orderkey AS slide_id, CAST(l_partkey % 8 AS INT) AS gx, CAST(l_suppkey % 8 AS INT) AS gy,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS f0,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount END AS f1
  FROM lineitem)"""


def order_tiles(spark: SparkSession, path: str) -> DataFrame:
    value = lambda c: F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col(c))
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("slide_id"),
        (F.col("l_partkey") % 8).cast("int").alias("gx"),
        (F.col("l_suppkey") % 8).cast("int").alias("gy"),
        F.array(value("l_quantity"), value("l_discount")).alias("features"),
    )


# active, summed cells of the lattice; all values are at least 0
LATTICE_CELLS = """lattice_cells AS MATERIALIZED (
  SELECT slide_id, gx AS r, gy AS c FROM fx_lattice GROUP BY slide_id, gx, gy HAVING sum(f0) <> 0 OR sum(f1) <> 0)"""


# --- masks: 48 x 64 pixels per supplier ------------------------------------

MASK = """fx_mask AS MATERIALIZED (
  SELECT s_suppkey AS slide_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c,
         CASE WHEN (((r-16-s_suppkey%7)*(r-16-s_suppkey%7)*4 + (c-14-s_suppkey%5)*(c-14-s_suppkey%5) < 260
                     OR (r-30)*(r-30) + (c-46+s_suppkey%3)*(c-46+s_suppkey%3) <= 81)
                    AND NOT ((r-16-s_suppkey%7)*(r-16-s_suppkey%7) + (c-14-s_suppkey%5)*(c-14-s_suppkey%5) <= 4))
                OR (r*31 + c*17 + s_suppkey*13) % 97 = 0
                OR (s_suppkey % 4 = 0 AND r BETWEEN 42 AND 45) THEN 1 ELSE 0 END AS v
  FROM supplier CROSS JOIN range(48) AS tr(r) CROSS JOIN range(64) AS tc(c))"""


def mask(spark: SparkSession, path: str) -> DataFrame:
    s, r, c = F.col("slide_id"), F.col("r"), F.col("c")
    dr, dc = r - 16 - s % 7, c - 14 - s % 5
    blob = (dr * dr * 4 + dc * dc < 260) | ((r - 30) * (r - 30) + (c - 46 + s % 3) * (c - 46 + s % 3) <= 81)
    on = (
        (blob & ~(dr * dr + dc * dc <= 4))
        | ((r * 31 + c * 17 + s * 13) % 97 == 0)
        | ((s % 4 == 0) & r.between(42, 45))
    )
    # a slide is a few bytes before it is thousands of pixels, and one file of them one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        table(spark, path, "supplier")
        .select(F.col("s_suppkey").alias("slide_id"))
        .repartition(parts, "slide_id")
        .select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(MASK_H - 1))).alias("r"))
        .select("slide_id", "r", F.explode(F.sequence(F.lit(0), F.lit(MASK_W - 1))).alias("c"))
        .withColumn("v", F.when(on, 1).otherwise(0))
    )


# --- wide sparse grids: a bar of pixels for every line item ----------------

WIDE_H, WIDE_W = 600, 320
# 600 x 320 cells, more than two blocks high and five words wide; about 1,200 bars a slide at any scale
WIDE = f"""fx_wide AS MATERIALIZED (
  SELECT DISTINCT slide_id, CAST(CASE WHEN upright THEN r0 + k ELSE r0 END AS INT) AS r,
         CAST(CASE WHEN upright THEN c0 ELSE c0 + k END AS INT) AS c
  FROM (SELECT *, unnest(range(0, len)) AS k FROM (
    SELECT l_orderkey % 50 + 50 * (l_suppkey // 100) AS slide_id, l_linenumber % 2 = 0 AS upright,
           (l_partkey * 37 + l_orderkey * 11) % {WIDE_H - 30} AS r0, (l_partkey * 91 + l_orderkey * 7 + l_linenumber) % {WIDE_W - 30} AS c0,
           CAST(l_quantity AS BIGINT) // 2 + 1 AS len FROM lineitem) a) b)"""


def wide_bars(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all bars; cells on which bars cross repeat."""
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    bars = table(spark, path, "lineitem").select(
        (o % 50 + 50 * F.floor(F.col("l_suppkey") / 100)).alias("slide_id"),
        (n % 2 == 0).alias("upright"),
        ((p * 37 + o * 11) % (WIDE_H - 30)).alias("r0"),
        ((p * 91 + o * 7 + n) % (WIDE_W - 30)).alias("c0"),
        F.floor(F.col("l_quantity").cast("bigint") / 2).alias("last"),
    )
    # a bar is one row until it is dealt by slide
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bars.repartition(parts, "slide_id")
    bars = dealt.select("slide_id", "upright", "r0", "c0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("k"))
    up, k = F.col("upright"), F.col("k")
    return bars.select(
        "slide_id",
        F.when(up, F.col("r0") + k).otherwise(F.col("r0")).cast("int").alias("r"),
        F.when(up, F.col("c0")).otherwise(F.col("c0") + k).cast("int").alias("c"),
    )


def wide(spark: SparkSession, path: str) -> DataFrame:
    return wide_bars(spark, path).distinct()


# the same bars as a full mask
WIDE_MASK_ALL = f"""wide_mask_all AS MATERIALIZED (
  SELECT g.slide_id, g.r, g.c, CASE WHEN w.r IS NULL THEN 0 ELSE 1 END AS v
  FROM (SELECT slide_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT DISTINCT slide_id FROM fx_wide) s
        CROSS JOIN range({WIDE_H}) AS tr(r) CROSS JOIN range({WIDE_W}) AS tc(c)) g
  LEFT JOIN fx_wide w ON w.slide_id = g.slide_id AND w.r = g.r AND w.c = g.c)"""


# --- slide metadata from orders (slides) and customers (patients) ----------

META = """fx_slide_meta AS MATERIALIZED (
  SELECT o_orderkey AS slide_id, o_custkey AS patient_id,
         CAST(CAST(floor(o_totalprice) AS BIGINT) - 250000 AS VARCHAR) AS odx_train,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'H' ELSE 'L' END AS odx85,
         CASE WHEN o_orderstatus = 'F' THEN 'H' ELSE 'L' END AS mphr,
         CAST(o_orderkey % 120 AS VARCHAR) AS disease_free_months,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Present' WHEN o_orderkey % 3 = 1 THEN 'Absent' ELSE 'Unknown' END AS necrosis,
         CAST(1 + o_orderkey % 3 AS VARCHAR) AS pleomorph,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'not scored'
              ELSE concat('count (score = ', CAST(1 + o_orderkey % 3 AS VARCHAR), ')') END AS mitosis,
         CASE WHEN o_orderkey % 4 = 0 THEN '40,0' WHEN o_orderkey % 4 = 1 THEN 'n/a' ELSE '20' END AS app_mag,
         concat('TCGA-', CAST(o_custkey % 90 AS VARCHAR), '-', CAST(o_custkey AS VARCHAR), '-01Z-',
                CAST(o_orderkey AS VARCHAR)) AS barcode
  FROM orders)"""


def slide_meta(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return table(spark, path, "orders").select(
        k.alias("slide_id"),
        F.col("o_custkey").alias("patient_id"),
        text(F.floor("o_totalprice").cast("bigint") - 250000).alias("odx_train"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "H").otherwise("L").alias("odx85"),
        F.when(F.col("o_orderstatus") == "F", "H").otherwise("L").alias("mphr"),
        text(k % 120).alias("disease_free_months"),
        F.when(k % 3 == 0, "Present").when(k % 3 == 1, "Absent").otherwise("Unknown").alias("necrosis"),
        text(1 + k % 3).alias("pleomorph"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 1, "not scored")
        .otherwise(F.concat(F.lit("count (score = "), text(1 + k % 3), F.lit(")")))
        .alias("mitosis"),
        F.when(k % 4 == 0, "40,0").when(k % 4 == 1, "n/a").otherwise("20").alias("app_mag"),
        F.concat(
            F.lit("TCGA-"), text(F.col("o_custkey") % 90), F.lit("-"), text(F.col("o_custkey")), F.lit("-01Z-"), text(k)
        ).alias("barcode"),
    )


ROLLUP = """rollup AS MATERIALIZED (
  SELECT patient_id, count(*) AS n_slides, max(CAST(odx_train AS DOUBLE)) AS odx_train,
         max(CASE WHEN odx85 = 'H' THEN 1 ELSE 0 END) AS odx85, max(CASE WHEN mphr = 'H' THEN 1 ELSE 0 END) AS mphr,
         min(CAST(disease_free_months AS DOUBLE)) AS dfm,
         max(CASE WHEN necrosis = 'Present' THEN 1 ELSE 0 END) AS necrosis, max(CAST(pleomorph AS INT)) AS pleo
  FROM fx_slide_meta GROUP BY patient_id)"""


# --- file listing: processed, half processed and raw-only slides -----------

FILES = """fx_files AS MATERIALIZED (
  SELECT concat('preprocessed/enc/', CAST(o_orderkey AS VARCHAR), suffix) AS fkey, o_orderkey * 10 + n AS size
  FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, unnest([0, 1, 2, 3]) AS n,
               unnest(['_coords.h5', '_features.h5', '_thumbnail.png', '_heatmap.png']) AS suffix FROM orders) t
  WHERE o_orderstatus <> 'P' AND NOT (n = 1 AND o_orderpriority = '5-LOW')
  UNION ALL
  SELECT concat('raw/', CAST(o_orderkey AS VARCHAR), '.svs'), o_orderkey + 1000000 FROM orders)"""


def files(spark: SparkSession, path: str) -> DataFrame:
    orders = table(spark, path, "orders")
    key = F.col("o_orderkey").cast("string")
    endings = F.array(*[F.lit(s) for s in ("_coords.h5", "_features.h5", "_thumbnail.png", "_heatmap.png")])
    done = (
        orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.posexplode(endings).alias("n", "suffix"))
        .where((F.col("o_orderstatus") != "P") & ~((F.col("n") == 1) & (F.col("o_orderpriority") == "5-LOW")))
        .select(
            F.concat(F.lit("preprocessed/enc/"), key, "suffix").alias("fkey"),
            (F.col("o_orderkey") * 10 + F.col("n")).alias("size"),
        )
    )
    raw = orders.select(
        F.concat(F.lit("raw/"), key, F.lit(".svs")).alias("fkey"), (F.col("o_orderkey") + 1000000).alias("size")
    )
    return done.unionByName(raw)


def keyed_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with text slide ids, as file names have them."""
    return slide_meta(spark, path).withColumn("slide_id", F.col("slide_id").cast("string"))


# --- predictions: users are bags, events instances -------------------------

PREDS = """fx_preds AS MATERIALIZED (
  SELECT user_id AS bag_id, event_id AS instance_id, false AS is_global, (value - 50) / 50 AS score,
         CAST(user_id % 2 AS INT) AS y FROM events
  UNION ALL
  SELECT user_id, CAST(-1 AS BIGINT), true, avg((value - 50) / 50), CAST(user_id % 2 AS INT)
  FROM events GROUP BY user_id)"""


def preds(spark: SparkSession, path: str) -> DataFrame:
    events = table(spark, path, "events")
    score = (F.col("value") - 50) / 50
    y = (F.col("user_id") % 2).cast("int").alias("y")
    instances = events.select(
        F.col("user_id").alias("bag_id"), F.col("event_id").alias("instance_id"), F.lit(False).alias("is_global"), score.alias("score"), y
    )
    whole = events.groupBy("user_id").agg(F.avg(score).alias("score")).select(
        F.col("user_id").alias("bag_id"), F.lit(-1).cast("bigint").alias("instance_id"), F.lit(True).alias("is_global"), "score", y
    )
    return instances.unionByName(whole)


# --- pixels with three channels: parts are images --------------------------

PIXELS = """fx_pixels AS MATERIALIZED (
  SELECT l_partkey AS image_id, l_orderkey, l_linenumber, l_quantity * 5 AS ch0, l_discount * 2000 AS ch1,
         l_tax * 3000 AS ch2 FROM lineitem)"""


def pixels(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").select(
        F.col("l_partkey").alias("image_id"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * 5).alias("ch0"),
        (F.col("l_discount") * 2000).alias("ch1"),
        (F.col("l_tax") * 3000).alias("ch2"),
    )


def with_sql(body: str, *tables: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n" + body


def md5_sql(seed: str, *cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f", '{seed}'))"


def uniform_sql(seed: str, *cols: str) -> str:
    return f"(CAST('0x' || substr({md5_sql(seed, *cols)}, 1, 13) AS BIGINT) / 4503599627370496.0)"
