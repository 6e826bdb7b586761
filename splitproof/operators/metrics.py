"""Scoring of per-item predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    """true, pred, n for every pair of classes met, zeros kept."""
    classes = preds.select(F.explode(F.array("true", "pred")).alias("c")).distinct()
    grid = classes.select(F.col("c").alias("true")).join(F.broadcast(classes.select(F.col("c").alias("pred"))))
    if by:
        grid = preds.select(*by).distinct().join(F.broadcast(grid))
    counts = preds.groupBy(*by, "true", "pred").agg(F.count("*").alias("n"))
    return grid.join(counts, [*by, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined. One scan, one aggregate a side."""
    seen = preds.select(*by, F.explode(F.array(F.struct(F.col("true").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("true") == F.col("pred")).cast("int").alias("ok"))
    sums = seen.groupBy(*by, F.col("s.c").alias("class")).agg(
        F.sum(F.col("s.t") * F.col("ok")).alias("tp"), F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted")
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return sums.select(
        *by, "class", precision.alias("precision"), recall.alias("recall"), _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support"
    )


def summary_scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro and support-weighted F1."""
    scores = class_scores(preds, by)
    return scores.groupBy(*by).agg(
        F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
    )


def accuracy(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))


def roc_points(scored: DataFrame) -> DataFrame:
    """fpr, tpr at each distinct threshold, per class, and the origin at an infinite one; points on a straight line between their neighbours are dropped.

    ``scored``: class, score, positive (0/1). Distinct scores are aggregated before the running sums.
    """
    steps = scored.groupBy("class", "score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("q"))
    w = Window.partitionBy("class").orderBy(F.desc("score"))
    run = steps.select("class", "score", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))
    total = Window.partitionBy("class")
    run = run.withColumn("np", F.max("tp").over(total)).withColumn("nq", F.max("fp").over(total))
    next_tp, next_fp = F.lead("tp").over(w), F.lead("fp").over(w)
    last_tp, last_fp = F.coalesce(F.lag("tp").over(w), F.lit(0)), F.coalesce(F.lag("fp").over(w), F.lit(0))
    straight = (F.col("tp") - last_tp) * (next_fp - F.col("fp")) == (next_tp - F.col("tp")) * (F.col("fp") - last_fp)
    run = run.withColumn("drop", F.coalesce(straight, F.lit(False))).where("not drop")
    points = run.select(
        "class", "score", F.round(_ratio(F.col("fp"), F.col("nq")), 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("np")), 6).alias("tpr")
    )
    origin = scored.select("class").distinct().select("class", F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def auc(scored: DataFrame) -> DataFrame:
    """One-vs-rest AUC of each class by the rank sum, ties averaged, and their MACRO mean. Scores are aggregated before ranking."""
    steps = scored.groupBy("class", "score").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy("score")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy("class").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    value = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * (F.col("n") - F.col("p"))).cast("double"))
    each = sums.select("class", value.alias("auc"))
    macro = each.agg(F.avg("auc").alias("auc")).select(F.lit("MACRO").alias("class"), "auc")
    return each.unionByName(macro).select("class", F.round("auc", 6).alias("auc"))


def agreement(preds: DataFrame, by: list[str]) -> DataFrame:
    """Per item: share of the modal prediction among its models, and whether all agree."""
    votes = preds.groupBy(*by, "item_id", "pred").agg(F.count("*").alias("n"))
    return votes.groupBy(*by, "item_id").agg(
        (F.max("n") / F.sum("n")).alias("agreement"), (F.count("*") == 1).alias("unanimous")
    )


def error_rates(preds: DataFrame, by: list[str], stratum: str) -> DataFrame:
    """Error rate inside and outside a stratum, and their ratio; null where a side is empty."""
    wrong, inside = 1 - F.col("correct"), F.col(stratum)
    sums = preds.groupBy(*by).agg(
        F.avg(F.when(inside, wrong)).alias("a"), F.avg(F.when(~inside, wrong)).alias("b")
    )
    return sums.select(*by, F.round("a", 6).alias("error_in"), F.round("b", 6).alias("error_out"), F.round(F.try_divide("a", "b"), 6).alias("ratio"))


def seed_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, SD (n - 1; 0 for one seed), minimum and maximum over seeds."""
    return df.groupBy(*by).agg(
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"),
        F.round(F.min(value), 6).alias("low"),
        F.round(F.max(value), 6).alias("high"),
    )


def variance_components(cells: DataFrame, by: list[str]) -> DataFrame:
    """One-way random effects over folds with seeds as repeats. ``cells``: fold, seed, value on the full grid."""
    folds = cells.groupBy(*by, "fold").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.var_pop("value").alias("v"))
    total = folds.groupBy(*by).agg(
        F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("ss"), F.var_samp("m").alias("vm"), F.min("n").alias("n0")
    )
    within = F.try_divide(F.col("ss"), F.col("k") * (F.col("n") - 1))
    between = F.col("vm") * F.col("n")
    out = total.withColumn("msw", within).withColumn("msb", between)
    return out.select(
        *by,
        F.round(F.sqrt("msw"), 6).alias("sigma_seed"),
        F.round(F.sqrt(F.greatest((F.col("msb") - F.col("msw")) / F.col("n"), F.lit(0.0))), 6).alias("sigma_partition"),
        (F.col("n") == F.col("n0")).alias("full_grid"),
    )


def calibration_error(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi]; a confidence of 0 falls in no bin."""
    kept = scored.where("confidence > 0").withColumn("bin", F.ceil(F.col("confidence") * bins))
    cells = kept.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg("confidence").alias("conf"))
    return cells.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """Per run: the epoch where training stops and the best one. ``history``: run, epoch, val_loss."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("better", before.isNull() | (F.col("val_loss") < before))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w)
    marked = marked.withColumn("last", last)
    stop = F.coalesce(F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))), F.max("epoch"))
    stops = marked.groupBy("run").agg(stop.alias("stop_epoch"))
    return stops.join(marked.select("run", "epoch", "last"), (F.col("stop_epoch") == F.col("epoch")) & (stops["run"] == marked["run"])).select(
        stops["run"], "stop_epoch", F.col("last").alias("best_epoch")
    )
