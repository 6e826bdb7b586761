"""Invariants as checks that raise; each is one distributed test for an empty frame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvariantError(ValueError):
    pass


def require_empty(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise InvariantError(message)


def boundary_leaks(items: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys on more than one side of the split."""
    return items.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("sides")).where("sides > 1").select(key)


def check_boundary(items: DataFrame, key: str, split: str = "split") -> None:
    require_empty(boundary_leaks(items, key, split), f"a {key} is on both sides of the split")


def fold_conflicts(assigned: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    """Groups that aren't in exactly one fold."""
    return assigned.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds <> 1")


def check_folds(assigned: DataFrame, group: str = "group_id", fold: str = "fold") -> None:
    require_empty(fold_conflicts(assigned, group, fold), "a group is not in exactly one fold")


def check_unique(df: DataFrame, key: str) -> None:
    require_empty(df.groupBy(key).count().where("count > 1"), f"{key} is not unique")


def coverage_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one frame only."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def check_same_items(a: DataFrame, b: DataFrame, key: str = "item_id") -> None:
    require_empty(coverage_gaps(a, b, key), "the arms do not cover the same items")


def where_both(a: str, b: str, value: Column) -> Column:
    """``value`` where both sides are there; a row that lacks one raises, in the task that computes it."""
    missing = F.col(a).isNull() | F.col(b).isNull()
    return F.when(missing, F.raise_error(F.lit("the arms do not cover the same items"))).otherwise(value)
