"""Novelty thresholds and their evaluation (F7-F15). Sets are few; rows of a set are many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import ngram, util
from weftline.operators.scoring import with_rates


def balanced_sets(known: DataFrame, novel: DataFrame, order: str = "id", number: str | None = None) -> DataFrame:
    """rows of (set, label, ...): per novel set the first min(known, novel) rows of each, label 0 and 1.

    number: a column with the ordinals of the known rows, and of the novel ones of each set, if they are numbered already.
    """
    if number is None:
        known, novel = util.ordinal(known, [], [order], "__rn"), util.ordinal(novel, ["set"], [order], "__rn")
    else:
        known, novel = (rows.withColumnRenamed(number, "__rn") for rows in (known, novel))
    sizes = novel.groupBy("set").agg(F.count(F.lit(1)).alias("__n")).crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("__k")))).select(F.col("set").alias("__set"), F.least("__n", "__k").alias("__m"))
    sizes = F.broadcast(util.cut(sizes))  # one row per novel set
    left = known.join(sizes, F.col("__rn") <= F.col("__m")).withColumns({"set": F.col("__set"), "label": F.lit(0)})
    right = novel.join(sizes, (F.col("set") == F.col("__set")) & (F.col("__rn") <= F.col("__m"))).withColumn("label", F.lit(1))
    return left.drop("__rn", "__set", "__m").unionByName(right.drop("__rn", "__set", "__m"))


def _range(scored: DataFrame, steps: int, by: str) -> DataFrame:
    ends = scored.groupBy(by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return ends.select(F.col(by).alias("__by"), "lo", ((F.col("hi") - F.col("lo")) / steps).alias("step"), F.when(F.col("hi") == F.col("lo"), 1).otherwise(steps).alias("steps"))


def threshold_sweep(scored: DataFrame, steps: int = 100, by: str = "set") -> DataFrame:
    """F8: (by, i, threshold, tp, fp, fn, tn, rates): predict 1 when the score is above lo + i * step.

    A score is above the first j thresholds; rows are counted by j (at most steps + 1 values a set) and summed from the top, so
    no row meets a threshold but by its own number.
    """
    ends = F.broadcast(util.cut(_range(scored, steps, by)))  # one row per set
    guess = F.greatest(F.lit(0), F.floor(F.try_divide(F.col("score") - F.col("lo"), F.col("step"))).cast("int") - 1)
    rows = scored.join(ends, F.col(by) == F.col("__by")).withColumn("__g", F.coalesce(guess, F.lit(0)))
    at = [F.col("__g") + d for d in range(4)]
    above = sum((F.when((i < F.col("steps")) & (F.col("lo") + i * F.col("step") < F.col("score")), 1).otherwise(0) for i in at), F.col("__g"))
    bins = rows.groupBy(by, above.alias("j")).agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.sum(1 - F.col("label").cast("bigint")).alias("q"))
    grid = ends.select(F.col("__by").alias(by), "lo", "step", F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("j"))
    rows = grid.join(bins, [by, "j"], "left").fillna(0, ["p", "q"])
    over = Window.partitionBy(by).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    rows = rows.withColumns({"tp": F.sum("p").over(over), "fp": F.sum("q").over(over), "__p": F.sum("p").over(whole), "__q": F.sum("q").over(whole)}).where("j > 0")
    rows = rows.select(by, (F.col("j") - 1).alias("i"), (F.col("lo") + (F.col("j") - 1) * F.col("step")).alias("threshold"), "tp", "fp", (F.col("__p") - F.col("tp")).alias("fn"), (F.col("__q") - F.col("fp")).alias("tn"))
    return with_rates(rows)


def best_threshold(sweep: DataFrame, by: str = "set") -> DataFrame:
    """(by, threshold, f1): the greatest f1, ties: the least threshold."""
    return sweep.groupBy(by).agg(F.min(F.struct((-F.col("f1")).alias("f"), "i", "threshold")).alias("b")).select(by, "b.threshold", (-F.col("b.f")).alias("f1"))


def shared_threshold(scored: DataFrame, steps: int = 200) -> DataFrame:
    """(threshold, f1) over all sets together."""
    return best_threshold(threshold_sweep(scored.withColumn("set", F.lit("all")), steps)).drop("set")


def auroc(scored: DataFrame, by: str = "set") -> DataFrame:
    """(by, auroc): share of (positive, negative) pairs in order, ties count half. Equal scores are counted first."""
    counts = scored.groupBy(by, "score").agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.sum(1 - F.col("label").cast("bigint")).alias("q"))
    rows = util.running(counts, [by], ["score"], "q", "b")
    out = rows.groupBy(by).agg(F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return out.select(by, F.try_divide(F.col("u"), F.col("np") * F.col("nq").cast("double")).alias("auroc"))


def classification_scores(scored: DataFrame, thresholds: DataFrame, by: str = "set") -> DataFrame:
    """auroc and the rates of label against score > threshold."""
    rows = scored.join(util.bounded(thresholds.select(F.col(by).alias("__by"), "threshold")), F.col(by) == F.col("__by"))
    said, label = F.col("score") > F.col("threshold"), F.col("label") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cells = rows.groupBy(by).agg(count(said & label).alias("tp"), count(said & ~label).alias("fp"), count(~said & label).alias("fn"), count(~said & ~label).alias("tn"))
    return with_rates(cells).join(auroc(scored, by).withColumnRenamed(by, "__by"), F.col(by) == F.col("__by")).drop("__by")


def apply_to_test(test: DataFrame, thresholds: DataFrame, links: DataFrame) -> DataFrame:
    """test sets under the threshold of the validation set that is linked to them."""
    linked = links.join(thresholds, F.col("valid_name") == F.col("set")).select(F.col("test_name").alias("set"), "threshold")
    return classification_scores(test, linked)


def mad_constants(balanced: DataFrame, columns: tuple[str, ...] = ("event_score", "duration_score")) -> DataFrame:
    """Per set: median and median absolute deviation of each column. All columns and sets go through one selection of ranks for the medians, and one for the deviations."""
    long = balanced.select("set", F.inline(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).alias("__v")) for c in columns]))).where("__v is not null")
    counted = util.cut(long.groupBy("set", "__c", "__v").agg(F.count(F.lit(1)).alias("__n")))
    median = util.cut(util.quantiles(counted, ["set", "__c"], "__v", "__n", [0.5], "__q").select(F.col("set").alias("__s"), F.col("__c").alias("__d"), F.col("__q")[0].alias("__m")))
    away = counted.join(util.bounded(median), F.col("set").eqNullSafe(F.col("__s")) & (F.col("__c") == F.col("__d")))
    away = away.groupBy("set", "__c", "__m", F.abs(F.col("__v") - F.col("__m")).alias("__a")).agg(F.sum("__n").alias("__n"))
    both = util.quantiles(away, ["set", "__c", "__m"], "__a", "__n", [0.5], "__q")
    of = lambda c, x, kind: F.max(F.when(F.col("__c") == c, x)).alias(f"{c}_{kind}")
    return both.groupBy("set").agg(*[of(c, x, kind) for c in columns for x, kind in ((F.col("__m"), "median"), (F.col("__q")[0], "mad"))])


def mad_combine(rows: DataFrame, constants: DataFrame, columns: tuple[str, ...] = ("event_score", "duration_score")) -> DataFrame:
    """``score``: the sum of (x - median) / MAD with the constants of the set."""
    out = rows.join(util.bounded(constants), "set")
    score = sum((F.try_divide(F.col(c) - F.col(f"{c}_median"), F.col(f"{c}_mad")) for c in columns), F.lit(0.0))
    return out.withColumn("score", score).drop(*[f"{c}_{k}" for c in columns for k in ("median", "mad")])


def detection_ngram(train: DataFrame, rows: DataFrame, links: DataFrame, n: int, epsilon: float, steps: int = 100) -> DataFrame:
    """perplexity of the requests, thresholds on validation, report on validation and test: (stage, set, rates, auroc).

    rows: (role valid or test, set, novel, rn, call); the set of known requests is not read. All are scored in one pass.
    """
    counts = ngram.ngram_count(train, n)
    scored = util.cut(ngram.ngram_perplexity(rows, counts, n, epsilon, ["role", "set", "novel", "rn"]).withColumnsRenamed({"perplexity": "score", "rn": "id"}))

    def balanced(role: str) -> DataFrame:
        own = scored.where(F.col("role") == role)
        return util.cut(balanced_sets(own.where("not novel").select("id", "score"), own.where("novel").select("set", "id", "score")))

    valid, test = balanced("valid"), balanced("test")
    best = util.cut(best_threshold(threshold_sweep(valid, steps)))
    report = classification_scores(valid, best).withColumn("stage", F.lit("valid"))
    return report.unionByName(apply_to_test(test, best, links).withColumn("stage", F.lit("test")))
