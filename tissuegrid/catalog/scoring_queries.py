"""Losses and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import scoring as so
from . import fixtures as fx
from .registry import query

BCE = "greatest(score, 0) - score * y + ln(1 + exp(-abs(score)))"

# four class scores per event, from its value
CLASSES = """cls AS MATERIALIZED (
  SELECT event_id, user_id, CAST(event_id % 4 AS INT) AS y,
         list_transform([0, 1, 2, 3], lambda j: ((event_id * (2 * j + 3) + 17 * j) % 101) / 50.0 + value / 500) AS scores FROM events)"""


def _classes(spark, path):
    e = F.col("event_id")
    scores = F.array(*[((e * (2 * j + 3) + 17 * j) % 101) / F.lit(50.0) + F.col("value") / 500 for j in range(4)])
    return fx.table(spark, path, "events").select(
        "event_id", "user_id", (e % 4).cast("int").alias("y"), scores.alias("scores")
    )


# quality and toxic predictions of labelled documents
TASKS = """tasks AS MATERIALIZED (
  SELECT doc_id AS bag_id, task, score, CAST(y AS DOUBLE) AS y FROM (
    SELECT l.doc_id, d.n_chars / 10000.0 AS score, unnest(['quality', 'toxic']) AS task, unnest([quality, toxic]) AS y
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id) t)"""


def _task_preds(spark, path):
    docs = fx.table(spark, path, "documents")
    names = F.array(F.lit("quality"), F.lit("toxic"), F.lit("unlabelled"))
    return docs.select(F.col("doc_id").alias("bag_id"), F.explode(names).alias("task"), (F.col("n_chars") / 10000.0).alias("score"))


def _task_labels(spark, path):
    return fx.table(spark, path, "labels").select(
        F.col("doc_id").alias("bag_id"),
        F.inline(
            F.array(
                F.struct(F.lit("quality").alias("task"), F.col("quality").cast("double").alias("y")),
                F.struct(F.lit("toxic").alias("task"), F.col("toxic").cast("double").alias("y")),
            )
        ),
    )


def _tasks(spark, path):
    return so.with_task_labels(_task_preds(spark, path), _task_labels(spark, path))


@query("j8_with_task_labels", fx.with_sql("SELECT * FROM tasks", TASKS))
def j8(spark, path):
    return _tasks(spark, path)


def _mean_loss(sql: str) -> str:
    return fx.with_sql(f"SELECT bag_id, round(avg({sql}), 6) AS loss FROM fx_preds GROUP BY bag_id", fx.PREDS)


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@query("a22_losses_bce_logits", _mean_loss(BCE))
def a22_logits(spark, path):
    return _rounded(so.losses(fx.preds(spark, path), "bce_logits", by=["bag_id"]), "loss")


P01 = "1 / (1 + exp(-score))"


@query("a22_losses_bce", _mean_loss(f"-(y * greatest(ln({P01}), -100) + (1 - y) * greatest(ln(1 - {P01}), -100))"))
def a22_bce(spark, path):
    df = fx.preds(spark, path).withColumn("score", sc.sigmoid(F.col("score")))
    return _rounded(so.losses(df, "bce", by=["bag_id"]), "loss")


@query("a22_losses_mse", _mean_loss("(score - y) * (score - y)"))
def a22_mse(spark, path):
    return _rounded(so.losses(fx.preds(spark, path), "mse", by=["bag_id"]), "loss")


@query(
    "a22_losses_ce",
    fx.with_sql(
        """SELECT user_id, round(avg(ln(list_sum(list_transform(scores, lambda x: exp(x)))) - scores[y + 1]), 6) AS loss
           FROM cls GROUP BY user_id""",
        CLASSES,
    ),
)
def a22_ce(spark, path):
    return _rounded(so.losses(_classes(spark, path), "ce", "scores", by=["user_id"]), "loss")


TOP = """top AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY bag_id ORDER BY score DESC, instance_id) AS BIGINT) AS rank,
         CAST(greatest(1, count(*) OVER (PARTITION BY bag_id) // 10) AS BIGINT) AS k
  FROM fx_preds WHERE NOT is_global QUALIFY rank <= k)"""


@query("w3_top_k_instances", fx.with_sql("SELECT bag_id, instance_id, rank, k FROM top", fx.PREDS, TOP))
def w3(spark, path):
    return so.top_k_instances(fx.preds(spark, path)).select("bag_id", "instance_id", "rank", "k")


REGIONAL = f"""local AS (SELECT bag_id, avg({BCE}) / max(k) AS l FROM top GROUP BY bag_id),
  whole AS (SELECT bag_id, avg({BCE}) AS g FROM fx_preds WHERE is_global GROUP BY bag_id)"""


@query(
    "a23_regional_loss",
    fx.with_sql(
        """SELECT w.bag_id, round(0.7 * g + 0.3 * coalesce(l, 0), 6) AS loss FROM whole w LEFT JOIN local l ON l.bag_id = w.bag_id""",
        fx.PREDS,
        TOP,
        REGIONAL,
    ),
)
def a23(spark, path):
    return _rounded(so.regional_loss(fx.preds(spark, path), 0.3), "loss")


TWO_TASKS = """two AS MATERIALIZED (
  SELECT bag_id, instance_id, is_global, 'toxic' AS task, score, y FROM fx_preds
  UNION ALL SELECT bag_id, instance_id, is_global, 'grade', score * 0.5 + 0.1, y FROM fx_preds)"""


@query(
    "a23_regional_loss_tasks",
    fx.with_sql(
        f""", scored AS MATERIALIZED (SELECT *, CASE task WHEN 'toxic' THEN {BCE} ELSE (score - y) * (score - y) END AS loss FROM two),
              g AS (SELECT bag_id, sum(t) AS g FROM (SELECT bag_id, task, avg(loss) AS t FROM scored WHERE is_global GROUP BY 1, 2) a GROUP BY 1),
              l AS (SELECT bag_id, sum(t) / max(k) AS l FROM (SELECT s.bag_id, s.task, avg(s.loss) AS t, max(k) AS k FROM scored s
                JOIN top p ON p.bag_id = s.bag_id AND p.instance_id = s.instance_id WHERE NOT s.is_global GROUP BY 1, 2) b GROUP BY 1)
            SELECT g.bag_id, round(0.7 * g + 0.3 * coalesce(l, 0), 6) AS loss FROM g LEFT JOIN l ON l.bag_id = g.bag_id""",
        fx.PREDS,
        TOP,
        TWO_TASKS,
    ),
)
def a23_tasks(spark, path):
    one = fx.preds(spark, path)
    grade = one.withColumn("task", F.lit("grade")).withColumn("score", F.col("score") * 0.5 + 0.1)
    both = one.withColumn("task", F.lit("toxic")).unionByName(grade)
    return _rounded(so.regional_loss_tasks(both, 0.3, {"toxic": "bce_logits", "grade": "mse"}), "loss")


@query(
    "a24_multitask_loss",
    fx.with_sql(
        f""", per AS (SELECT bag_id, task, avg({BCE}) AS loss FROM tasks GROUP BY bag_id, task)
            SELECT bag_id, round(sum(CASE task WHEN 'toxic' THEN 0.5 ELSE 1.0 END * loss), 6) AS total_loss FROM per GROUP BY bag_id""",
        TASKS,
    ),
)
def a24(spark, path):
    per_task = so.losses(_tasks(spark, path), "bce_logits", by=["bag_id", "task"])
    return _rounded(so.multitask_loss(per_task, {"toxic": 0.5}, ["bag_id"]), "total_loss")


@query(
    "a25_binary_accuracy",
    fx.with_sql(
        """, u AS (SELECT is_global, bag_id, count(*) AS n, CASE WHEN min(score) < 0 OR max(score) > 1
               THEN sum(CASE WHEN (score > 0) = (y = 1) THEN 1 ELSE 0 END)
               ELSE sum(CASE WHEN (score > 0.5) = (y = 1) THEN 1 ELSE 0 END) END AS hits FROM fx_preds GROUP BY 1, 2)
           SELECT is_global, round(sum(hits) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY is_global""",
        fx.PREDS,
    ),
)
def a25(spark, path):
    return _rounded(so.binary_accuracy(fx.preds(spark, path), by=["is_global"], update=["bag_id"]), "accuracy", digits=9)


AUROC = """SELECT {by} CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round((sum(CASE WHEN hit = 1 THEN rk END)
    - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 9) END AS auroc{counts} FROM (
  SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rk,
    CAST(sum(hit) OVER (PARTITION BY grp) AS BIGINT) AS np, CAST(sum(1 - hit) OVER (PARTITION BY grp) AS BIGINT) AS nn
  FROM ({src}) s) t GROUP BY {grp}"""


@query(
    "a26_auroc",
    fx.with_sql(
        AUROC.format(
            by="grp AS is_global,",
            counts=", max(np) AS n_pos, max(nn) AS n_neg",
            src="SELECT is_global AS grp, score, y AS hit FROM fx_preds",
            grp="grp",
        ),
        fx.PREDS,
    ),
)
def a26(spark, path):
    return _rounded(so.auroc(fx.preds(spark, path), by=["is_global"]), "auroc", digits=9)


@query(
    "a26_auroc_tasks",
    fx.with_sql(
        AUROC.format(
            by="grp AS task,",
            counts=", max(np) AS n_pos, max(nn) AS n_neg",
            src="SELECT task AS grp, score, CAST(y AS INT) AS hit FROM tasks",
            grp="grp",
        ),
        TASKS,
    ),
)
def a26_tasks(spark, path):
    return _rounded(so.auroc(_tasks(spark, path), by=["task"]), "auroc", digits=9)


@query(
    "a26_auroc_macro",
    fx.with_sql(
        "SELECT round(avg(auroc), 8) AS auroc FROM ("
        + AUROC.format(
            by="",
            counts="",
            src="SELECT j AS grp, scores[j + 1] AS score, CASE WHEN y = j THEN 1 ELSE 0 END AS hit FROM "
            "(SELECT *, unnest([0, 1, 2, 3]) AS j FROM cls) q",
            grp="grp",
        )
        + ") z",
        CLASSES,
    ),
)
def a26_macro(spark, path):
    return _rounded(so.auroc_macro(_classes(spark, path), "scores", "y", 4), "auroc", digits=8)


@query(
    "a27_multiclass_accuracy",
    fx.with_sql(
        """SELECT user_id, round(avg(CASE WHEN list_position(scores, list_max(scores)) - 1 = y THEN 1.0 ELSE 0.0 END), 9) AS accuracy
           FROM cls GROUP BY user_id""",
        CLASSES,
    ),
)
def a27_accuracy(spark, path):
    return _rounded(so.multiclass_accuracy(_classes(spark, path), "scores", "y", ["user_id"]), "accuracy", digits=9)


F1 = """, p AS (SELECT y, list_position(scores, list_max(scores)) - 1 AS q FROM cls),
  per AS (SELECT j, (SELECT count(*) FROM p WHERE y = j AND q = j) AS tp, (SELECT count(*) FROM p WHERE y <> j AND q = j) AS fp,
    (SELECT count(*) FROM p WHERE y = j AND q <> j) AS fn FROM range(4) AS g(j))"""


@query("a27_f1_micro", fx.with_sql(F1 + " SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1 FROM per", CLASSES))
def a27_f1(spark, path):
    return _rounded(so.f1(_classes(spark, path), "scores", "y"), "f1", digits=9)


@query("a27_f1_macro", fx.with_sql(F1 + " SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS f1 FROM per", CLASSES))
def a27_f1_macro(spark, path):
    return _rounded(so.f1(_classes(spark, path), "scores", "y", average="macro"), "f1", digits=9)


@query(
    "a28_mse",
    fx.with_sql("SELECT bag_id, round(avg((score - y) * (score - y)), 6) AS mse FROM fx_preds GROUP BY bag_id", fx.PREDS),
)
def a28_mse(spark, path):
    return _rounded(so.mse(fx.preds(spark, path), by=["bag_id"]), "mse")


@query("a28_mae", fx.with_sql("SELECT bag_id, round(avg(abs(score - y)), 6) AS mae FROM fx_preds GROUP BY bag_id", fx.PREDS))
def a28_mae(spark, path):
    return _rounded(so.mae(fx.preds(spark, path), by=["bag_id"]), "mae")


@query(
    "a15_ensemble_mean",
    fx.with_sql(
        "SELECT bag_id, is_global, round(avg(score) + 0.0, 6) + 0.0 AS score FROM fx_preds GROUP BY bag_id, is_global", fx.PREDS
    ),
)
def a15(spark, path):
    return _rounded(so.ensemble_mean(fx.preds(spark, path), ["bag_id", "is_global"]), "score")


@query(
    "u1_all_predictions",
    fx.with_sql("SELECT bag_id, instance_id, is_global, round(score, 6) + 0.0 AS score FROM fx_preds", fx.PREDS),
)
def u1(spark, path):
    preds = fx.preds(spark, path).select("bag_id", "instance_id", "score", "is_global")
    whole = preds.where("is_global").drop("is_global")
    return _rounded(so.all_predictions(whole, preds.where(~F.col("is_global")).drop("is_global")), "score")


@query(
    "g21_softmax",
    fx.with_sql(
        """SELECT event_id, j, round(exp(scores[j + 1]) / list_sum(list_transform(scores, lambda x: exp(x))), 6) AS p
           FROM (SELECT *, unnest([0, 1, 2, 3]) AS j FROM cls) t""",
        CLASSES,
    ),
)
def g21(spark, path):
    return _rounded(_classes(spark, path).select("event_id", F.posexplode(sc.softmax("scores")).alias("j", "p")), "p")


ERF = """(CASE WHEN z < 0 THEN -1 WHEN z > 0 THEN 1 ELSE 0 END) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t
  - 0.284496736) * t + 0.254829592) * t * exp(-z * z))"""


@query(
    "g21_sigmoid_gelu",
    fx.with_sql(
        f"""SELECT bag_id, instance_id, round(1 / (1 + exp(-score)), 6) AS sigmoid,
              round(0.5 * score * (1 + {ERF}), 6) + 0.0 AS gelu,
              round(0.5 * score * (1 + (2 / (1 + exp(-2 * u)) - 1)), 6) + 0.0 AS gelu_tanh FROM (
              SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(z)) AS t FROM (SELECT *, score / sqrt(2) AS z,
                sqrt(2 / pi()) * (score + 0.044715 * score * score * score) AS u FROM fx_preds) a) b""",
        fx.PREDS,
    ),
)
def g21_gelu(spark, path):
    s = F.col("score")
    return _rounded(
        fx.preds(spark, path).select(
            "bag_id",
            "instance_id",
            sc.sigmoid(s).alias("sigmoid"),
            sc.gelu(s).alias("gelu"),
            sc.gelu(s, "tanh").alias("gelu_tanh"),
        ),
        "sigmoid",
        "gelu",
        "gelu_tanh",
    )
