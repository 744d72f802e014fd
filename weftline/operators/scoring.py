"""Scoring of model output held in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import log_minmax_by_event, ordinal_encode


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def token_cross_entropy(df: DataFrame, logits: str, target: str, into: str = "nll") -> DataFrame:
    """log-sum-exp minus the target's logit; 0 where the target is 0 (ignored)."""
    loss = log_sum_exp(F.col(logits)) - F.get(logits, F.col(target).cast("int"))
    return df.withColumn(into, F.when(F.col(target) == 0, 0.0).otherwise(loss))


def label_smoothing_ce(df: DataFrame, logits: str, target: str, eps: float = 0.1) -> DataFrame:
    """one row: eps times the mean over classes plus 1 - eps times the target's part."""
    each = df.select(log_sum_exp(F.col(logits)).alias("z"), F.col(logits).alias("x"), F.col(target).cast("int").alias("t"))
    each = each.select((F.col("z") * F.size("x") - total(F.col("x"))).alias("all"), F.size("x").alias("n"), (F.col("z") - F.get("x", F.col("t"))).alias("nll"))
    return each.agg((eps * F.avg(F.col("all") / F.col("n")) + (1 - eps) * F.avg("nll")).alias("loss"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ordinal_predict(logits: Column) -> Column:
    return F.size(F.filter(logits, lambda x: sigmoid(x) > 0.5)) + 1


def ordinal_bce(df: DataFrame, logits: str, tag: str, n_category: int, keys: list[str]) -> DataFrame:
    """(keys, duration_score): binary cross-entropy of the bits of the tag, where the tag isn't 0."""
    one = lambda x, b: F.greatest(x, F.lit(0.0)) - x * b + F.log1p(F.exp(-F.abs(x)))
    loss = total(F.zip_with(F.col(logits), ordinal_encode(F.col(tag), n_category), one))
    rows = df.select(*keys, F.when(F.col(tag) != 0, loss).otherwise(0.0).alias("l"), F.when(F.col(tag) != 0, 1).otherwise(0).alias("m"))
    return rows.groupBy(*keys).agg((F.sum("l") / (F.sum("m") + 1e-8)).alias("duration_score"))


def continuous_mse(df: DataFrame, pred: str, value: str, event: str, keys: list[str]) -> DataFrame:
    """(keys, duration_score): squared error of the duration, log-scaled by event, over positions that aren't 0."""
    rows = log_minmax_by_event(df, event, value)
    used = F.col(value) != 0
    return rows.groupBy(*keys).agg((F.sum(F.when(used, F.pow(F.col(pred) - F.col("scaled"), F.lit(2.0))).otherwise(0.0)) / (F.sum(F.when(used, 1).otherwise(0)) + 1e-8)).alias("duration_score"))


def token_eval(df: DataFrame, by: str = "dataset") -> DataFrame:
    """reads loss, pred, target, tag_pred and tag; mean loss, event accuracy, duration accuracy and mean error where tag isn't 0."""
    timed = F.col("tag") != 0
    return df.groupBy(by).agg(
        F.avg("loss").alias("loss"), F.avg((F.col("pred") == F.col("target")).cast("double")).alias("event_accuracy"),
        F.avg(F.when(timed, (F.col("tag_pred") == F.col("tag")).cast("double"))).alias("duration_accuracy"), F.avg(F.when(timed, F.abs(F.col("tag_pred") - F.col("tag")).cast("double"))).alias("duration_mae"),
    )


def duration_class_report(df: DataFrame, pred: str, true: str) -> DataFrame:
    """per true class but 0. A true negative of a class is a correct prediction of another one."""
    cells = df.where(F.col(true) != 0).groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    right = cells.agg(F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("c"))), F.lit(0)).alias("right"))
    rows = cells.groupBy(F.col("t").alias("cls")).agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("t") != F.col("p"), F.col("c")).otherwise(0)).alias("fn"))
    wrong = cells.where("t <> p").groupBy(F.col("p").alias("w")).agg(F.sum("c").alias("fp"))
    rows = rows.join(wrong, F.col("cls") == F.col("w"), "left").crossJoin(F.broadcast(right)).select("cls", "tp", F.coalesce("fp", F.lit(0)).alias("fp"), "fn", (F.col("right") - F.col("tp")).alias("tn"))
    return with_rates(rows)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def with_rates(rows: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = rows.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
