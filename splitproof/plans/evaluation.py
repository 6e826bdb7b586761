"""Queries of the evaluation: scores (A12 on), resampling inference (I), training histories (W5, A33, A34)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..operators import inference as I
from ..operators import metrics as M
from .fixtures import LOGITS, PREDS, SCORED, SOFTMAX, h, logits, predictions, scored
from .registry import query

_CM = 'cm AS (SELECT k.event_type AS t, l.event_type AS p, count(pr.item_id) AS n FROM kinds k CROSS JOIN kinds l LEFT JOIN preds pr ON pr."true" = k.event_type AND pr.pred = l.event_type AND arm = \'patient\' AND seed = 42 GROUP BY 1, 2)'


def _model(spark, d) -> DataFrame:
    return predictions(spark, d).where("arm = 'patient' and seed = 42")


@query("A12_confusion", f"WITH {PREDS}, {_CM} SELECT t AS truth, p AS pred, n FROM cm")
def a12(spark, d):
    return M.confusion(_model(spark, d), []).select(F.col("true").alias("truth"), "pred", "n")


@query("A13_normalised_confusion", f"WITH {PREDS}, {_CM} SELECT t AS truth, p AS pred, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM cm")
def a13(spark, d):
    from pyspark.sql import Window

    cm = M.confusion(_model(spark, d), [])
    return cm.select(F.col("true").alias("truth"), "pred", F.round(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("true"))), 6).alias("share"))


def _scores_sql(where: str, by: str) -> str:
    """Class scores over a subset, grouped; true classes only count where they occur."""
    return f"""s AS (SELECT {by}, c AS class, sum(tp)::DOUBLE AS tp, sum(t)::DOUBLE AS support, sum(p)::DOUBLE AS predicted FROM (
  SELECT {by}, "true" AS c, correct AS tp, 1 AS t, 0 AS p FROM preds WHERE {where} UNION ALL SELECT {by}, pred, 0, 0, 1 FROM preds WHERE {where}) GROUP BY ALL),
  f AS (SELECT {by}, class, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support FROM s)"""


@query("A14_class_scores", f"WITH {PREDS}, {_scores_sql('true', 'arm, seed')} SELECT arm, seed, class, round(\"precision\", 6) AS prec, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f")
def a14(spark, d):
    s = M.class_scores(predictions(spark, d), ["arm", "seed"])
    return s.select("arm", "seed", "class", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), F.col("support").cast("long").alias("support"))


@query("A14_summary", f"WITH {PREDS}, {_scores_sql('true', 'arm, seed')} SELECT arm, seed, round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY 1, 2")
def a14b(spark, d):
    return M.summary_scores(predictions(spark, d), ["arm", "seed"])


_SEEDS = "sd AS (SELECT arm, seed, avg(correct) AS a FROM preds GROUP BY 1, 2)"


@query("A15_mean_of_seeds", f"WITH {PREDS}, {_SEEDS} SELECT arm, round(avg(a), 6) AS accuracy FROM sd GROUP BY 1")
def a15(spark, d):
    s = M.accuracy(predictions(spark, d), ["arm", "seed"])
    return s.groupBy("arm").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))


_SUBSET = "\"true\" <> (SELECT min(event_type) FROM kinds)"


@query("A16_subset_metrics", f"WITH {PREDS}, {_scores_sql(_SUBSET, 'arm')}, acc AS (SELECT arm, avg(correct) AS a FROM preds WHERE {_SUBSET} GROUP BY 1) SELECT f.arm, class, round(\"precision\", 6) AS prec, round(f1, 6) AS f1, round(a, 6) AS accuracy FROM f JOIN acc USING (arm) WHERE support > 0")
def a16(spark, d):
    """Only rows whose true class is in the subset: false positives from the excluded class do not count."""
    p = predictions(spark, d)
    first = p.agg(F.min("true").alias("least"))
    kept = p.join(F.broadcast(first), F.col("true") != F.col("least")).drop("least")
    scores = M.class_scores(kept, ["arm"]).where("support > 0")
    acc = M.accuracy(kept, ["arm"]).select("arm", F.round("accuracy", 6).alias("accuracy"))
    return scores.join(F.broadcast(acc), "arm").select("arm", "class", F.round("precision", 6).alias("prec"), F.round("f1", 6).alias("f1"), "accuracy")


@query("A17_seed_summary", f"WITH {PREDS}, {_SEEDS} SELECT arm, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS sd, round(min(a), 6) AS low, round(max(a), 6) AS high FROM sd GROUP BY 1")
def a17(spark, d):
    return M.seed_summary(M.accuracy(predictions(spark, d), ["arm", "seed"]), "accuracy", ["arm"])


@query(
    "A18_traced_f1",
    f"""WITH {PREDS}, {_scores_sql('true', 'seed')}, {_scores_sql('is_dup', 'seed').replace('s AS (', 's2 AS (').replace(' f AS (', ' f2 AS (').replace('FROM s)', 'FROM s2)')},
  a AS (SELECT class, avg(f1) AS a FROM f GROUP BY 1), b AS (SELECT class, avg(f1) AS b FROM f2 GROUP BY 1)
SELECT class, round(a, 6) AS f1_all, round(b, 6) AS f1_traced FROM a FULL JOIN b USING (class)""",
)
def a18(spark, d):
    p = predictions(spark, d)
    mean = lambda df, name: M.class_scores(df, ["seed"]).groupBy("class").agg(F.round(F.avg("f1"), 6).alias(name))
    return mean(p, "f1_all").join(mean(p.where("is_dup"), "f1_traced"), "class", "full")


_VOTES = "v AS (SELECT arm, item_id, is_dup, pred, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4), g AS (SELECT arm, item_id, is_dup, max(n) / sum(n) AS agreement, count(*) = 1 AS unanimous FROM v GROUP BY 1, 2, 3)"


@query("A19_agreement", f"WITH {PREDS}, {_VOTES} SELECT arm, is_dup, round(avg(agreement), 6) AS agreement, count(*) FILTER (unanimous) AS unanimous FROM g GROUP BY 1, 2")
def a19(spark, d):
    g = M.agreement(predictions(spark, d), ["arm", "is_dup"])
    return g.groupBy("arm", "is_dup").agg(F.round(F.avg("agreement"), 6).alias("agreement"), F.count_if("unanimous").alias("unanimous"))


@query("A20_error_by_stratum", f'WITH {PREDS}, e AS (SELECT arm, "true" AS class, avg(1 - correct) FILTER (is_dup) AS a, avg(1 - correct) FILTER (NOT is_dup) AS b FROM preds GROUP BY 1, 2) SELECT arm, class, round(a, 6) AS error_in, round(b, 6) AS error_out, round(a / nullif(b, 0), 6) AS ratio FROM e')
def a20(spark, d):
    return M.error_rates(predictions(spark, d).withColumn("class", F.col("true")), ["arm", "class"], "is_dup")


_CELLS = "cells AS (SELECT arm, fold, seed, avg(correct) AS v FROM preds GROUP BY 1, 2, 3)"


@query(
    "A21_variance_components",
    f"""WITH {PREDS}, {_CELLS}, fm AS (SELECT arm, fold, avg(v) AS m, count(*) AS n, var_pop(v) AS vp FROM cells GROUP BY 1, 2),
  t AS (SELECT arm, sum(vp * n) / (count(*) * (max(n) - 1)) AS msw, var_samp(m) * max(n) AS msb, max(n) AS n, min(n) AS n0 FROM fm GROUP BY 1)
SELECT arm, round(sqrt(msw), 6) AS sigma_seed, round(sqrt(greatest((msb - msw) / n, 0)), 6) AS sigma_partition, n = n0 AS full_grid FROM t""",
)
def a21(spark, d):
    cells = M.accuracy(predictions(spark, d), ["arm", "fold", "seed"]).withColumnRenamed("accuracy", "value")
    return M.variance_components(cells, ["arm"])


@query("A22_gap", f"WITH {PREDS}, a AS (SELECT avg(correct) FILTER (arm = 'random') AS r, avg(correct) FILTER (arm = 'patient') AS p FROM preds) SELECT round(0.9922::DOUBLE - r, 6) AS design, round(r - p, 6) AS grouping_gap, round((r - p) / (0.9922::DOUBLE - p), 6) AS share FROM a")
def a22(spark, d):
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    a = predictions(spark, d).agg(side("random").alias("r"), side("patient").alias("p"))
    released = F.lit(0.9922)
    return a.select(F.round(released - F.col("r"), 6).alias("design"), F.round(F.col("r") - F.col("p"), 6).alias("grouping_gap"), F.round(F.try_divide(F.col("r") - F.col("p"), released - F.col("p")), 6).alias("share"))


@query("A23_class_delta", f'WITH {PREDS} SELECT "true" AS class, round(avg(correct) FILTER (arm = \'random\') - avg(correct) FILTER (arm = \'patient\'), 6) AS delta FROM preds GROUP BY 1')
def a23(spark, d):
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    return predictions(spark, d).groupBy(F.col("true").alias("class")).agg(F.round(side("random") - side("patient"), 6).alias("delta"))


@query("A24_fold_range", f"WITH {PREDS}, fm AS (SELECT arm, fold, avg(correct) AS m FROM preds GROUP BY 1, 2) SELECT arm, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS spread FROM fm GROUP BY 1")
def a24(spark, d):
    m = M.accuracy(predictions(spark, d), ["arm", "fold"])
    return m.groupBy("arm").agg(F.round(F.min("accuracy"), 6).alias("low"), F.round(F.max("accuracy"), 6).alias("high"), F.round(F.max("accuracy") - F.min("accuracy"), 6).alias("spread"))


@query(
    "A25_roc",
    f"""WITH {SCORED}, st AS (SELECT class, score, sum(positive) AS p, sum(1 - positive) AS q FROM scored GROUP BY 1, 2),
  r AS (SELECT class, score, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM st WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
  n AS (SELECT *, max(tp) OVER (PARTITION BY class) AS np, max(fp) OVER (PARTITION BY class) AS nq, coalesce(lag(tp) OVER w, 0) AS lt, coalesce(lag(fp) OVER w, 0) AS lf, lead(tp) OVER w AS nt, lead(fp) OVER w AS nf
    FROM r WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, score, round(coalesce(fp / nullif(nq, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(np, 0), 0), 6) AS tpr FROM n
WHERE NOT coalesce((tp - lt) * (nf - fp) = (nt - tp) * (fp - lf), false)
UNION ALL SELECT DISTINCT class, 'Infinity'::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM scored""",
)
def a25(spark, d):
    return M.roc_points(scored(spark, d))


@query("A26_auc", f"WITH {SCORED}, r AS (SELECT class, positive, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r FROM scored), e AS (SELECT class, (sum(r) FILTER (positive = 1) - sum(positive) * (sum(positive) + 1) / 2.0::DOUBLE) / (sum(positive) * (count(*) - sum(positive))) AS auc FROM r GROUP BY 1) SELECT class, round(auc, 6) AS auc FROM e UNION ALL SELECT 'MACRO', round(avg(auc), 6) FROM e")
def a26(spark, d):
    return M.auc(scored(spark, d))


@query("A27_ece", f"WITH {PREDS}, b AS (SELECT arm, ceil(confidence * 10) AS bin, count(*) AS n, avg(correct) AS a, avg(confidence) AS c FROM preds WHERE confidence > 0 GROUP BY 1, 2) SELECT arm, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def a27(spark, d):
    return M.calibration_error(predictions(spark, d), ["arm"])


@query("A28_nll", f"WITH {LOGITS}, p AS (SELECT label, {SOFTMAX.format(z='z')} AS p FROM logits) SELECT label, round(avg(-ln(greatest(p[label + 1], 1e-12))), 6) AS nll FROM p GROUP BY 1")
def a28(spark, d):
    from ..functions.scalar import softmax

    p = logits(spark, d).withColumn("p", softmax(F.col("z")))
    return p.groupBy("label").agg(F.round(F.avg(-F.log(F.greatest(F.element_at("p", F.col("label") + 1), F.lit(1e-12)))), 6).alias("nll"))


@query("A29_confident_errors", f"WITH {PREDS} SELECT arm, count(*) FILTER (correct = 0 AND confidence > 0.9) AS before, count(*) FILTER (correct = 0 AND confidence * 0.95::DOUBLE > 0.9) AS after FROM preds GROUP BY 1")
def a29(spark, d):
    wrong = F.col("correct") == 0
    return predictions(spark, d).groupBy("arm").agg(F.count_if(wrong & (F.col("confidence") > 0.9)).alias("before"), F.count_if(wrong & (F.col("confidence") * 0.95 > 0.9)).alias("after"))


@query("A29_calibration")
def a29b(spark, d):
    """ECE, NLL and errors above 0.9 confidence before and after the fitted temperature (a refined grid search, no SQL)."""
    from ..functions.scalar import argmax, softmax

    z = logits(spark, d)
    best = I.fit_temperature(z).first()["temperature"]  # one row
    out = None
    for name, t in (("before", 1.0), ("after", best)):
        p = z.select(softmax(F.col("z"), t).alias("p"), "label", F.lit(name).alias("stage"))
        loss = -F.log(F.greatest(F.element_at("p", F.col("label") + 1), F.lit(1e-300)))
        p = p.select("stage", F.array_max("p").alias("confidence"), (argmax(F.col("p")) == F.col("label")).cast("int").alias("correct"), loss.alias("loss"))
        sure = p.groupBy("stage").agg(F.round(F.avg("loss"), 6).alias("nll"), F.count_if((F.col("correct") == 0) & (F.col("confidence") > 0.9)).alias("confident_errors"))
        row = M.calibration_error(p, ["stage"]).join(sure, "stage").withColumn("temperature", F.lit(t))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "A35_paired_contrast",
    f"""WITH {PREDS}, i AS (SELECT arm, seed, avg(correct) AS a FROM preds WHERE is_dup GROUP BY 1, 2), m AS (SELECT avg(a) FILTER (arm = 'random') AS seen, avg(a) FILTER (arm = 'patient') AS unseen FROM i)
SELECT round(seen, 6) AS seen, round(unseen, 6) AS unseen, round((1 - unseen) / greatest(1 - seen, 1e-12), 6) AS error_ratio FROM m""",
)
def a35(spark, d):
    """Traced items only, in both arms: the mean of seed means, and the ratio of errors."""
    from ..functions.scalar import error_ratio
    from ..operators.checks import check_same_items

    p = predictions(spark, d).where("is_dup")
    check_same_items(p.where("arm = 'random'"), p.where("arm = 'patient'"))
    i = M.accuracy(p, ["arm", "seed"])
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("accuracy")))
    m = i.agg(side("random").alias("seen"), side("patient").alias("unseen"))
    return m.select(F.round("seen", 6).alias("seen"), F.round("unseen", 6).alias("unseen"), F.round(error_ratio(F.col("unseen"), F.col("seen")), 6).alias("error_ratio"))


# ---- histories: each event type is a run, hours are epochs ------------------------------------------------

_HISTORY = "hist AS (SELECT event_type AS run, user_id % 20 AS epoch, avg(value) AS val_loss, count(*) AS n, max(value) AS val_acc FROM events GROUP BY 1, 2)"


def _history(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 20).alias("epoch")).agg(
        F.avg("value").alias("val_loss"), F.count("*").alias("n"), F.max("value").alias("val_acc")
    )


@query("A33_best_epoch", f"WITH {_HISTORY}, r AS (SELECT *, round(val_loss, 6) AS l FROM hist) SELECT run, arg_min(epoch, (l, epoch)) AS best_epoch, round(arg_min(val_acc, (l, epoch)), 6) AS val_acc, count(*) AS epochs FROM r GROUP BY 1")
def a33(spark, d):
    hst = _history(spark, d).withColumn("l", F.round("val_loss", 6))
    key = F.struct("l", "epoch")
    return hst.groupBy("run").agg(F.min_by("epoch", key).alias("best_epoch"), F.round(F.min_by("val_acc", key), 6).alias("val_acc"), F.count("*").alias("epochs"))


@query("A34_running_loss", f"WITH {_HISTORY} SELECT run, epoch, round(sum(val_loss * n) OVER w / sum(n) OVER w, 6) AS loss FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch)")
def a34(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("epoch")
    return _history(spark, d).select("run", "epoch", F.round(F.sum(F.col("val_loss") * F.col("n")).over(w) / F.sum("n").over(w), 6).alias("loss"))


@query(
    "W5_early_stop",
    f"""WITH {_HISTORY}, l AS (SELECT run, epoch, round(val_loss, 4) AS v FROM hist), b AS (SELECT *, coalesce(v < min(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM l),
  m AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b), s AS (SELECT run, coalesce(min(epoch) FILTER (epoch - last >= 5), max(epoch)) AS stop_epoch FROM m GROUP BY 1)
SELECT s.run, stop_epoch, last AS best_epoch FROM s JOIN m ON m.run = s.run AND m.epoch = stop_epoch""",
)
def w5(spark, d):
    return M.early_stop(_history(spark, d).select("run", "epoch", F.round("val_loss", 4).alias("val_loss")), 5)


# ---- inference ---------------------------------------------------------------------------------------------

RESAMPLES = 10_000


def _boot_sql(sums: str, value: str) -> str:
    return f"""{sums}, n AS (SELECT count(*) AS n FROM sm), dr AS (SELECT b.range AS draw, {h("b.range || ':' || p.range")} % n AS g FROM n, range({RESAMPLES}) b, range((SELECT n FROM n)) p),
  bt AS (SELECT draw, {value} AS value FROM dr JOIN sm USING (g) GROUP BY 1)"""


_SM = 'sm AS (SELECT row_number() OVER (ORDER BY group_id) - 1 AS g, k, n FROM (SELECT group_id, sum(correct) AS k, count(*) AS n FROM preds WHERE {w} GROUP BY 1))'
_CI = "SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM bt"


@query("I1_cluster_bootstrap", f"WITH {PREDS}, {_boot_sql(_SM.format(w=chr(39).join(['arm = ', 'patient', ' AND seed = 42'])), 'sum(k) / sum(n)')} {_CI}")
def i1(spark, d):
    return I.interval(I.cluster_bootstrap(I.group_sums(_model(spark, d)), RESAMPLES), "value")


@query("I2_pooled_bootstrap", f"WITH {PREDS}, {_boot_sql(_SM.format(w=chr(39).join(['arm = ', 'patient', ''])), 'sum(k) / sum(n)')} {_CI}")
def i2(spark, d):
    """All seeds of a group travel together: their sums are taken before the draw."""
    return I.interval(I.cluster_bootstrap(I.group_sums(predictions(spark, d).where("arm = 'patient'")), RESAMPLES), "value")


_PAIRED = "sm AS (SELECT row_number() OVER (ORDER BY group_id) - 1 AS g, ka, kb, n FROM (SELECT group_id, sum(correct) FILTER (arm = 'random') AS ka, sum(correct) FILTER (arm = 'patient') AS kb, count(*) FILTER (arm = 'random') AS n FROM preds GROUP BY 1))"


@query("I3_paired_bootstrap", f"WITH {PREDS}, {_boot_sql(_PAIRED, '(sum(ka) - sum(kb)) / sum(n)')} SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, round(avg((value <= 0)::INT), 6) AS p_not_above FROM bt")
def i3(spark, d):
    from pyspark.sql import Window

    side = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("correct"))).cast("long")
    s = predictions(spark, d).groupBy("group_id").agg(side("random").alias("ka"), side("patient").alias("kb"), F.count_if(F.col("arm") == "random").alias("n"))
    s = s.withColumn("g", F.row_number().over(Window.orderBy("group_id")) - 1).drop("group_id")
    draws = I.paired_bootstrap(s, RESAMPLES)
    p = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.agg(p.alias("p"), F.round(F.avg((F.col("value") <= 0).cast("int")), 6).alias("p_not_above"))
    return out.select(F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"), "p_not_above")


PERMUTATIONS = 10_000  # too many for SQL to sort the items by; held against brute force in the tests


def _strata(spark, d) -> DataFrame:
    """All items with the mean error over seeds."""
    p = predictions(spark, d).where("arm = 'patient'")
    return p.groupBy("item_id").agg(F.avg(1 - F.col("correct")).alias("err"), F.bool_or("is_dup").alias("inside"))


@query("I4_permutation_gap")
def i4(spark, d):
    s = _strata(spark, d)
    return I.permutation_p(I.permuted_strata(s, PERMUTATIONS), I.observed_means(s), lambda a, b: a - b, lambda v, o: F.abs(v) >= F.abs(o) - 1e-12)


@query("I5_permutation_ratio")
def i5(spark, d):
    s = _strata(spark, d)
    return I.permutation_p(I.permuted_strata(s, PERMUTATIONS), I.observed_means(s), lambda a, b: F.try_divide(a, b), lambda v, o: v >= o - 1e-12)


_DIFF = "df AS (SELECT fold, seed, avg(correct) FILTER (arm = 'random') - avg(correct) FILTER (arm = 'patient') AS d FROM preds GROUP BY 1, 2)"


def _differences(spark, d) -> DataFrame:
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    return predictions(spark, d).groupBy("fold", "seed").agg((side("random") - side("patient")).alias("d"))


_T = "round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, count(*) - 1 AS df"


@query("I6_one_sample_t", f"WITH {PREDS}, {_DIFF} SELECT {_T} FROM df")
def i6(spark, d):
    return I.one_sample_t(_differences(spark, d)).withColumn("t", F.round("t", 4))


@query("I6_t_interval")
def i6b(spark, d):
    """Two-sided p value and 95 % interval of the mean difference (incomplete beta, no SQL)."""
    r = _differences(spark, d).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n")).first()  # one row
    se = r["s"] / r["n"] ** 0.5
    half = special.t_ppf(0.975, r["n"] - 1) * se
    return spark.createDataFrame([(special.t_two_sided(r["m"] / se, r["n"] - 1), r["m"] - half, r["m"] + half)], "p double, lo double, hi double")


@query("I7_paired_t", f"WITH {PREDS}, {_DIFF} SELECT seed, {_T} FROM df GROUP BY 1")
def i7(spark, d):
    m, s, n = F.avg("d"), F.stddev_samp("d"), F.count("*")
    return _differences(spark, d).groupBy("seed").agg(F.round(m, 6).alias("mean"), F.round(m / (s / F.sqrt(n)), 4).alias("t"), (n - 1).alias("df"))


@query("I8_wilcoxon", f"WITH {PREDS}, {_DIFF}, r AS (SELECT round(d, 9) AS d, rank() OVER (ORDER BY abs(round(d, 9))) + (count(*) OVER (PARTITION BY abs(round(d, 9))) - 1) / 2.0::DOUBLE AS r FROM df WHERE round(d, 9) <> 0) SELECT round(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)), 6) AS w FROM r")
def i8(spark, d):
    return I.signed_rank(_differences(spark, d).withColumn("d", F.round("d", 9)))


@query("I8_wilcoxon_p")
def i8b(spark, d):
    """Wilcoxon's W and its exact two-sided p value over the sign patterns (no SQL). One difference a fold and seed."""
    rows = _differences(spark, d).select(F.round("d", 9).alias("d")).collect()  # folds x seeds
    return spark.createDataFrame([special.wilcoxon_exact([r["d"] for r in rows])], "w double, p double")


@query("I9_beta_interval")
def i9(spark, d):
    """95 % interval of each stratum's error rate, Beta(max(e, 1/2), max(n - e, 1/2))."""
    rows = predictions(spark, d).groupBy("arm", "is_dup").agg(F.sum(1 - F.col("correct")).alias("e"), F.count("*").alias("n")).collect()  # arms x strata
    out = [(r["arm"], r["is_dup"], *(special.beta_ppf(max(r["e"], 0.5), max(r["n"] - r["e"], 0.5), q) for q in (0.025, 0.975))) for r in rows]
    return spark.createDataFrame(out, "arm string, is_dup boolean, lo double, hi double")


@query(
    "I10_welch_t",
    f"""WITH {PREDS}, {_CELLS}, m AS (SELECT avg(v) FILTER (arm = 'random') AS ma, avg(v) FILTER (arm = 'patient') AS mb, var_samp(v) FILTER (arm = 'random') / count(*) FILTER (arm = 'random') AS x,
  var_samp(v) FILTER (arm = 'patient') / count(*) FILTER (arm = 'patient') AS y, count(*) FILTER (arm = 'random') AS na, count(*) FILTER (arm = 'patient') AS nb FROM cells)
SELECT round((ma - mb) / sqrt(x + y), 3) AS t, round((x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)), 3) AS df FROM m""",
)
def i10(spark, d):
    cells = M.accuracy(predictions(spark, d), ["arm", "fold", "seed"])
    return I.welch_t(cells, "accuracy", F.col("arm") == "random").select(F.round("t", 3).alias("t"), F.round("df", 3).alias("df"))


@query("I10_mann_whitney", f"WITH {PREDS}, {_CELLS}, r AS (SELECT arm, rank() OVER (ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY round(v, 9)) - 1) / 2.0::DOUBLE AS r FROM cells) SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE, 6) AS u FROM r WHERE arm = 'random'")
def i10b(spark, d):
    cells = M.accuracy(predictions(spark, d), ["arm", "fold", "seed"]).withColumn("accuracy", F.round("accuracy", 9))
    return I.mann_whitney_u(cells, "accuracy", F.col("arm") == "random")


_GRID = [round(0.5 + 0.1 * i, 1) for i in range(46)]


@query(
    "I11_temperature_grid",
    f"""WITH {LOGITS}, g AS (SELECT z, label, t FROM logits, (VALUES {', '.join(f'({t}::DOUBLE)' for t in _GRID)}) x(t)), s AS (SELECT label, t, list_transform(z, lambda x: x / t) AS z FROM g),
  n AS (SELECT t, avg(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label + 1]) AS nll FROM s GROUP BY 1)
SELECT t AS temperature, round(nll, 6) AS nll FROM n""",
)
def i11(spark, d):
    return I.logits_nll(logits(spark, d), _GRID).select("temperature", F.round("nll", 6).alias("nll"))


@query("I11_fit_temperature")
def i11b(spark, d):
    return I.fit_temperature(logits(spark, d))
