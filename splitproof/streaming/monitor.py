"""An incremental leakage monitor: the same exact-copy audit over items that arrive as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Items whose (split, hash) hasn't been seen within the watermark. ``items``: ts (timestamp), split, hash, item_id."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["split", "hash"])


def leak_events(items: DataFrame, delay: str = "1 hour", within: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Test items whose hash arrives in training within the interval; state older than the watermark is dropped."""
    test = items.where("split = 'Testing'").select(F.col("ts").alias("test_ts"), F.col("hash").alias("test_hash"), F.col("item_id").alias("test_id"))
    train = items.where("split = 'Training'").select(F.col("ts").alias("train_ts"), F.col("hash").alias("train_hash"), F.col("item_id").alias("train_id"))
    test, train = test.withWatermark("test_ts", delay), train.withWatermark("train_ts", delay)
    near = F.expr(f"test_hash = train_hash AND train_ts BETWEEN test_ts - {within} AND test_ts + {within}")
    return test.join(train, near)


def windowed_counts(items: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Arrivals per window and split."""
    return items.withWatermark("ts", delay).groupBy(F.window("ts", window), "split").agg(F.count("*").alias("n"))
