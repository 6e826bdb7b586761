"""Exact duplicates: audits within and across splits, first-wins removal, reasons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_hashes(items: DataFrame, key: str) -> DataFrame:
    return items.where("split = 'Training'").select(key).distinct()


def leaked(items: DataFrame, key: str) -> DataFrame:
    """Test rows whose key also occurs in training (left semi join)."""
    return items.where("split = 'Testing'").join(train_hashes(items, key), key, "left_semi")


def leak_report(items: DataFrame, keys: list[str]) -> DataFrame:
    """For each class: test items, and those with each key in training."""
    test = items.where("split = 'Testing'")
    for k in keys:
        test = test.join(train_hashes(items, k).withColumn(f"in_{k}", F.lit(1)), k, "left")
    return test.groupBy("class").agg(
        F.count("*").alias("n_test"), *[F.count(f"in_{k}").alias(f"leaked_{k}") for k in keys]
    )


def first_of_each(items: DataFrame, keys: list[str], order: str = "item_id") -> DataFrame:
    """One row for each key: the first in the order. An aggregate, so that a key with a large share of the rows is
    combined before the shuffle."""
    rest = [c for c in items.columns if c not in keys]
    first = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col("__first")[c].alias(c) for c in items.columns])


def surplus_copies(items: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Copies beyond the first of each key, summed."""
    return items.groupBy(*by, key).agg((F.count("*") - 1).alias("extra")).groupBy(*by).agg(F.sum("extra").cast("long").alias("surplus"))


def redundancy(items: DataFrame, key: str) -> DataFrame:
    """Files, distinct keys and surplus for each class, and a TOTAL row."""
    return (
        items.rollup("class")
        .agg(F.count("*").alias("files"), F.countDistinct(key).alias("unique"), F.grouping("class").alias("g"))
        .select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("class")).alias("class"), "files", "unique", (F.col("files") - F.col("unique")).alias("surplus"))
    )


def removal_reasons(items: DataFrame, near: DataFrame | None = None, key: str = "content_hash") -> DataFrame:
    """item_id and reason of what a clean split drops. Copies within a split come first, then test rows that training
    holds, then near-duplicates (item_id, reason); the first reason stays."""
    firsts = items.groupBy("split", key).agg(F.min("item_id").alias("__first"))
    training = firsts.where("split = 'Training'").select(F.col(key).alias("__t"))
    # each key's first item of the split, and whether training holds the key: one row a key, not an item
    known = firsts.join(training, F.col(key) == F.col("__t"), "left").select("split", F.col(key).alias("__k"), "__first", "__t")
    held = items.select("item_id", F.col("split").alias("__s"), key)
    marked = held.join(known, (F.col("__s") == F.col("split")) & F.col(key).eqNullSafe(F.col("__k")))
    own = F.when(F.col("item_id") > F.col("__first"), F.lit("duplicate within split")).when(
        (F.col("split") == "Testing") & F.col("__t").isNotNull(), F.lit("duplicate of training")
    )
    marked = marked.select("item_id", own.alias("own"))
    if near is None:
        return marked.select("item_id", F.col("own").alias("reason")).where("reason is not null")
    both = marked.join(near.select("item_id", F.col("reason").alias("near_reason")), "item_id", "left")
    return both.select("item_id", F.coalesce("own", "near_reason").alias("reason")).where("reason is not null")


def inherit_from_first(items: DataFrame, key: str, value: str) -> DataFrame:
    """Every copy takes the value of the first item with its key."""
    first = items.groupBy(F.col(key).alias("__k")).agg(F.min_by(value, "item_id").alias("__v"))
    return items.join(first, items[key].eqNullSafe(first["__k"])).select(*[F.col("__v").alias(c) if c == value else items[c] for c in items.columns])
