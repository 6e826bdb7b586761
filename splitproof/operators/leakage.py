"""Group leakage: groups on both sides of a split, label disagreement, dominant classes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_pivot(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Per group: training and test items, and whether it crosses."""
    return items.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(F.col("split") == "Training").alias("n_train"), F.count_if(F.col("split") == "Testing").alias("n_test")
    ).withColumn("crosses", (F.col("n_train") > 0) & (F.col("n_test") > 0))


def class_leak_rate(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Per class: test items, those whose group is also in training, and the rate."""
    crossing = group_pivot(items, group).where("crosses").select(group, F.lit(1).alias("hit"))
    test = items.where("split = 'Testing'").join(crossing, group, "left")
    return test.groupBy("class").agg(F.count("*").alias("n_test"), F.count("hit").alias("n_leaked")).withColumn(
        "rate", F.round(F.col("n_leaked") / F.col("n_test"), 6)
    )


def disagreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of differing label pairs."""
    return pairs.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count("*").alias("n"))


def dominant_class(items: DataFrame, group: str = "group_id") -> DataFrame:
    """The most frequent class of each group; of equal counts the greater name."""
    counts = items.groupBy(group, "class").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max_by("class", F.struct("n", "class")).alias("class"), F.sum("n").cast("long").alias("n_items"))


def multi_class_groups(items: DataFrame, group: str = "group_id") -> DataFrame:
    return items.groupBy(group).agg(F.countDistinct("class").alias("classes")).where("classes > 1")
