"""Losses and metrics over a table of scores.

``preds``: ``(bag_id, instance_id, is_global, score, y)``; the global row of a bag
stands before its instances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_prefix_sum, top_by_value
from ..functions.scalars import argmax
from ..functions.skew import attach_by_key
from ..session import cut


def loss_column(kind: str, score: Column, y: Column) -> Column:
    """Per-row loss: bce_logits, bce, mse, or ce (array of logits and class index)."""
    if kind == "bce_logits":
        return F.greatest(score, F.lit(0.0)) - score * y + F.log1p(F.exp(-F.abs(score)))
    if kind == "bce":
        # logarithms are bounded at -100
        log_p = F.greatest(F.coalesce(F.log(score), F.lit(-100.0)), F.lit(-100.0))
        log_q = F.greatest(F.coalesce(F.log(1 - score), F.lit(-100.0)), F.lit(-100.0))
        return -(y * log_p + (1 - y) * log_q)
    if kind == "mse":
        return (score - y) * (score - y)
    if kind == "ce":
        top = F.array_max(score)
        total = F.aggregate(score, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.log(total) + top - F.element_at(score, y.cast("int") + 1)
    raise ValueError(f"unknown loss {kind!r}")


def losses(df: DataFrame, kind: str, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean loss per group."""
    return df.groupBy(*by).agg(F.avg(loss_column(kind, F.col(score), F.col(y))).alias("loss"))


def all_predictions(global_rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Global and instance rows in one table with ``is_global``."""
    return global_rows.withColumn("is_global", F.lit(True)).unionByName(
        instances.withColumn("is_global", F.lit(False)), allowMissingColumns=True
    )


def ensemble_mean(preds: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Mean prediction over splits."""
    return preds.groupBy(*key).agg(F.avg(score).alias(score))


def top_k_instances(preds: DataFrame, frac: int = 10, bag: str = "bag_id", score: str = "score") -> DataFrame:
    """Best max(1, n // frac) instances of each bag with ``rank`` and the bag's ``k``.

    A bag is cut into score buckets first, so its size does not matter; buckets past
    the k-th row are dropped before sorting.
    """
    instances = preds.where(~F.col("is_global"))
    sizes = instances.groupBy(bag).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / frac)).cast("bigint").alias("k")
    )
    return top_by_value(attach_by_key(instances, sizes, [bag]), score, "instance_id", "k", "rank", by=[bag])


def regional_loss(
    preds: DataFrame, coeff: float, kind: str = "bce_logits", divide_by_k: bool = True, bag: str = "bag_id"
) -> DataFrame:
    """(1 - c) * global loss + c * local loss per bag.

    The local part is the mean loss of the top instances, divided once more by
    their number. Bags without instances keep the scaled global part only.
    """
    per_row = loss_column(kind, F.col("score"), F.col("y"))
    whole = preds.where("is_global").groupBy(bag).agg((F.avg(per_row) * F.lit(1 - coeff)).alias("_g"))
    if coeff == 0:
        return whole.select(bag, F.col("_g").alias("loss"))
    k = F.first("k") if divide_by_k else F.lit(1)
    local = (
        top_k_instances(preds, bag=bag).groupBy(bag).agg((F.avg(per_row) / k * F.lit(coeff)).alias("_l"))
    )
    return whole.join(local, bag, "left").select(bag, (F.col("_g") + F.coalesce("_l", F.lit(0.0))).alias("loss"))


def regional_loss_tasks(
    preds: DataFrame,
    coeff: float,
    kinds: dict[str, str],
    divide_by_k: bool = True,
    bag: str = "bag_id",
    task: str = "task",
) -> DataFrame:
    """Regional loss per bag over several tasks, each with a loss of its own.

    ``preds`` has one row per bag, instance and task; ``kinds`` names the loss of each
    task in order, other tasks are left out. Task losses add up, globally and locally. Top
    instances are those of the first task's score, and they are the same for all tasks.
    """
    first = next(iter(kinds))
    per_row = F.lit(None).cast("double")
    for name, kind in kinds.items():
        per_row = F.when(F.col(task) == name, loss_column(kind, F.col("score"), F.col("y"))).otherwise(per_row)
    used = preds.where(F.col(task).isin(*kinds)).withColumn("_loss", per_row)

    def summed(rows: DataFrame, *more: Column) -> DataFrame:
        per_task = rows.groupBy(bag, task).agg(F.avg("_loss").alias("_t"), *more)
        return per_task.groupBy(bag).agg(F.sum("_t").alias("_t"), *[F.first(c).alias(c) for c in per_task.columns[3:]])

    whole = summed(used.where("is_global")).select(bag, (F.col("_t") * F.lit(1 - coeff)).alias("_g"))
    if coeff == 0:
        return whole.select(bag, F.col("_g").alias("loss"))
    top = top_k_instances(used.where(F.col(task) == first), bag=bag).select(bag, "instance_id", "k")
    best = summed(used.where(~F.col("is_global")).join(top, [bag, "instance_id"]), F.first("k").alias("k"))
    k = F.col("k") if divide_by_k else F.lit(1)
    local = best.select(bag, (F.col("_t") / k * F.lit(coeff)).alias("_l"))
    return whole.join(local, bag, "left").select(bag, (F.col("_g") + F.coalesce("_l", F.lit(0.0))).alias("loss"))


def with_task_labels(preds: DataFrame, labels: DataFrame, bag: str = "bag_id", task: str = "task") -> DataFrame:
    """Predictions whose (bag, task) has a label; the others are skipped."""
    return attach_by_key(preds, labels, [bag, task])


def multitask_loss(
    task_losses: DataFrame, weights: dict[str, float], by: Sequence[str] = (), task: str = "task"
) -> DataFrame:
    """Weighted sum of task losses; a task without a weight counts once."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col(task) == name, F.lit(float(w))).otherwise(weight)
    return task_losses.groupBy(*by).agg(F.sum(weight * F.col("loss")).alias("total_loss"))


def binary_accuracy(
    df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), update: Sequence[str] = ()
) -> DataFrame:
    """Share of rows on the right side of 0.5.

    Scores are taken as logits when any score of the same update (``by`` plus
    ``update`` columns) is outside 0..1.
    """
    s, truth = F.col(score), F.col(y).cast("boolean")
    hit_p, hit_l = (s > 0.5) == truth, (s > 0) == truth
    per_update = df.groupBy(*by, *update).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(hit_p).alias("_p"),
        F.count_if(hit_l).alias("_l"),
        F.min(s).alias("_lo"),
        F.max(s).alias("_hi"),
    )
    logits = (F.col("_lo") < 0) | (F.col("_hi") > 1)
    hits = F.when(logits, F.col("_l")).otherwise(F.col("_p"))
    return per_update.groupBy(*by).agg((F.sum(hits) / F.sum("_n")).alias("accuracy"), F.sum("_n").alias("n"))


def auroc(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank sum; null when a class is missing.

    Rows collapse to one per distinct score first. The running count of negatives
    goes through score buckets, so neither a global sort nor one large group occurs.
    """
    by = list(by)
    per_score = cut(
        df.groupBy(*by, F.col(score).alias("_s")).agg(
            F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
        ),
        "scores",
    )
    ranked = bucketed_prefix_sum(
        per_score,
        "_neg",
        "_below",
        by=by,
        keys=[F.col("_s").cast("double")],
        order=[F.col("_s")],
    )
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(
        F.when(pairs > 0, wins / pairs).alias("auroc"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg")
    )


def auroc_macro(df: DataFrame, scores: str, y: str, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """One-versus-rest area, averaged over classes that occur."""
    by = list(by)
    long = df.select(
        *by, F.col(y).alias("_y"), F.posexplode(F.slice(scores, 1, n_classes)).alias("class", "_score")
    ).withColumn("_hit", (F.col("_y") == F.col("class")).cast("int"))
    return auroc(long, "_score", "_hit", by=[*by, "class"]).groupBy(*by).agg(F.avg("auroc").alias("auroc"))


def multiclass_accuracy(df: DataFrame, scores: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose largest score is the class."""
    hit = argmax(F.col(scores)) == F.col(y)
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, scores: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("actual"), argmax(F.col(scores)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def f1(df: DataFrame, scores: str, y: str, by: Sequence[str] = (), average: str = "micro") -> DataFrame:
    """F1 from the confusion counts: micro over all rows, or the mean over classes seen."""
    by = list(by)
    counts = confusion_counts(df, scores, y, by)
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("class"), F.lit(True).alias("is_actual")),
                F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_actual")),
            )
        ),
        (F.col("actual") == F.col("predicted")).alias("_hit"),
        "n",
    )
    per_class = sides.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("_hit") & F.col("is_actual"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("_hit") & ~F.col("is_actual"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("_hit") & F.col("is_actual"), F.col("n")).otherwise(0)).alias("fn"),
    )
    if average == "micro":
        tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
        return per_class.groupBy(*by).agg((2 * tp / (2 * tp + fp + fn)).alias("f1"))
    if average == "macro":
        one = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
        return per_class.groupBy(*by).agg(F.avg(one).alias("f1"))
    raise ValueError(f"unknown average {average!r}")


def mse(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(y), F.lit(2.0))).alias("mse"))


def mae(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(score) - F.col(y))).alias("mae"))
