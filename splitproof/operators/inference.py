"""Resampling inference. Draws are a dimension of a join, never a loop: items are first summed to their groups.

mode "hash" indexes draws by an MD5 of (draw, position), the same in any SQL engine. numpy_bootstrap and
permuted_strata run a generator stream instead, dealt over tasks by draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sums(preds: DataFrame, group: str = "group_id") -> DataFrame:
    """g (index from 0 in the order of the group), k correct, n."""
    sums = preds.groupBy(group).agg(F.sum("correct").cast("long").alias("k"), F.count("*").alias("n"))
    return sums.withColumn("g", F.row_number().over(Window.orderBy(group)) - 1).drop(group)


def hash_draws(spark, draws: int, groups: int) -> DataFrame:
    """(draw, g): ``groups`` groups drawn with replacement in each draw. Spark takes this for a small table: the sums
    (one row a group) are the side to broadcast."""
    key = F.concat(F.col("draw").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    index = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(groups)
    grid = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("pos"))
    return grid.select("draw", index.alias("g"))


def interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    p = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return df.agg(p.alias("p")).select(F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"))


def cluster_bootstrap(sums: DataFrame, draws: int) -> DataFrame:
    """(draw, value): accuracy of each resample of groups. ``sums``: g, k, n."""
    spark = sums.sparkSession
    drawn = hash_draws(spark, draws, sums.count())
    return drawn.join(F.broadcast(sums), "g").groupBy("draw").agg((F.sum("k") / F.sum("n")).alias("value"))


def paired_bootstrap(sums: DataFrame, draws: int) -> DataFrame:
    """(draw, value): difference of two accuracies over the same resampled groups. ``sums``: g, ka, kb, n."""
    drawn = hash_draws(sums.sparkSession, draws, sums.count())
    return drawn.join(F.broadcast(sums), "g").groupBy("draw").agg(((F.sum("ka") - F.sum("kb")) / F.sum("n")).alias("value"))


def numpy_bootstrap(sums: DataFrame, draws: int, seed: int = 0, chunk: int = 500) -> DataFrame:
    """(draw, value) with numpy's generator; the sums of all groups must fit a task (one row a group)."""
    rows = sums.orderBy("g").select("k", "n").toPandas()
    k, n = rows["k"].to_numpy(), rows["n"].to_numpy()

    def run(batches):
        for pdf in batches:
            for first in pdf["id"]:
                rng = np.random.default_rng([seed, int(first)])
                at = rng.integers(0, len(k), (min(chunk, draws - int(first)), len(k)))
                yield pd.DataFrame({"draw": np.arange(first, first + len(at)), "value": k[at].sum(1) / n[at].sum(1)})

    return sums.sparkSession.range(0, draws, chunk).mapInPandas(run, "draw long, value double")


def permuted_means(items: DataFrame, permutations: int, seed: str) -> DataFrame:
    """(perm, a, b): mean error inside and outside a random stratum of the observed size. ``items``: item_id, err, inside."""
    size = items.where("inside").count()
    perms = items.sparkSession.range(permutations).select(F.col("id").alias("perm"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("perm").cast("string"), F.lit(":"), F.col("item_id").cast("string")))
    dealt = items.select("item_id", "err").join(F.broadcast(perms))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("perm").orderBy(order, "item_id")))
    return ranked.groupBy("perm").agg(
        F.avg(F.when(F.col("r") <= size, F.col("err"))).alias("a"), F.avg(F.when(F.col("r") > size, F.col("err"))).alias("b")
    )


def permuted_strata(items: DataFrame, permutations: int, seed: int = 0, chunk: int = 100) -> DataFrame:
    """(perm, a, b) as permuted_means, with numpy's generator, drawn from the number of items of each error.

    Items of equal error are alike, so a permutation is a hypergeometric draw of the stratum from these counts (one row
    for each distinct error, whatever the number of items; numpy takes under 10^9 items and raises beyond).
    """
    rows = items.groupBy("err").agg(F.count("*").alias("n"), F.count_if("inside").alias("k")).orderBy("err").toPandas()
    err, n = rows["err"].to_numpy(float), rows["n"].to_numpy(np.int64)
    size, rest = int(rows["k"].sum()), int(n.sum() - rows["k"].sum())

    def run(batches):
        for pdf in batches:
            for first in pdf["id"]:
                rng = np.random.default_rng([seed, int(first)])
                picked = rng.multivariate_hypergeometric(n, size, min(chunk, permutations - int(first)))
                yield pd.DataFrame({"perm": np.arange(first, first + len(picked)), "x": picked @ err, "y": (n - picked) @ err})

    sums = items.sparkSession.range(0, permutations, chunk).mapInPandas(run, "perm long, x double, y double")
    return sums.select("perm", F.try_divide("x", F.lit(float(size))).alias("a"), F.try_divide("y", F.lit(float(rest))).alias("b"))


def observed_means(items: DataFrame) -> DataFrame:
    return items.agg(F.avg(F.when(F.col("inside"), F.col("err"))).alias("oa"), F.avg(F.when(~F.col("inside"), F.col("err"))).alias("ob"))


def permutation_p(perms: DataFrame, observed: DataFrame, statistic, extreme) -> DataFrame:
    """Add-one p value. ``statistic(a, b)`` gives a column; ``extreme(value, observed)`` a condition."""
    both = perms.join(F.broadcast(observed))
    value, seen = statistic(F.col("a"), F.col("b")), statistic(F.col("oa"), F.col("ob"))
    return both.agg(F.round((F.count_if(extreme(value, seen)) + 1) / (F.count("*") + 1), 6).alias("p"), F.round(F.max(seen), 6).alias("observed"))


def one_sample_t(differences: DataFrame, value: str = "d") -> DataFrame:
    """mean, t and degrees of freedom."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    return differences.agg(F.round(m, 6).alias("mean"), F.round(F.try_divide(m, s / F.sqrt(n)), 6).alias("t"), (n - 1).alias("df"))


def welch_t(df: DataFrame, value: str, arm: Column) -> DataFrame:
    a, b = F.when(arm, F.col(value)), F.when(~arm, F.col(value))
    sums = df.agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb")
    )
    x, y = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(x + y))
    freedom = F.try_divide((x + y) * (x + y), x * x / (F.col("na") - 1) + y * y / (F.col("nb") - 1))
    return sums.select(F.round(t, 6).alias("t"), F.round(freedom, 6).alias("df"))


def signed_rank(differences: DataFrame, value: str = "d") -> DataFrame:
    """Wilcoxon's W: the smaller of the rank sums of positive and negative differences, ties averaged."""
    d = differences.where(F.col(value) != 0).withColumn("size", F.abs(value))
    w = Window.orderBy("size")
    ranked = d.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy("size")) - 1) / 2.0)
    return ranked.agg(
        F.round(F.least(F.coalesce(F.sum(F.when(F.col(value) > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col(value) < 0, F.col("rank"))), F.lit(0.0))), 6).alias("w")
    )


def mann_whitney_u(df: DataFrame, value: str, arm: Column) -> DataFrame:
    """U of the first arm, ties averaged."""
    sums = df.groupBy(value).agg(F.count_if(arm).alias("a"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sums.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    return ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").alias("na")).select(
        F.round(F.col("r") - F.col("na") * (F.col("na") + 1) / 2.0, 6).alias("u")
    )


def fit_temperature(logits: DataFrame, low: float = 0.5, high: float = 5.0, steps: int = 46, rounds: int = 3) -> DataFrame:
    """temperature, nll: the grid value with the least mean negative log likelihood, refined around it.

    ``logits``: z (array), label (index). Each round is one aggregate with the grid as a dimension.
    """
    spark = logits.sparkSession
    best = None
    for _ in range(rounds):
        grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        nll = logits_nll(logits, grid).orderBy("nll", "temperature").first()
        best = (nll["temperature"], nll["nll"])
        gap = (high - low) / (steps - 1)
        low, high = max(best[0] - gap, 1e-3), best[0] + gap
    return spark.createDataFrame([best], "temperature double, nll double")


def logits_nll(logits: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll) over a grid."""
    each = logits.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    scaled = F.transform("z", lambda x: x / F.col("temperature"))
    top = F.array_max(scaled)
    log_sum = F.log(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return each.withColumn("loss", log_sum - F.element_at(scaled, F.col("label") + 1)).groupBy("temperature").agg(F.avg("loss").alias("nll"))
