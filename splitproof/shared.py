"""The folder that all executors share: staged tables, cut lineage, ranks over a whole table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []  # tables staged by this session and not yet removed


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent on a local master (tests) a folder of our own is set; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="splitproof-")
        spark.sparkContext.setCheckpointDir(named)
    return named or jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/splitproof/{name or 'out'}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a bulky intermediate once, as Parquet in the shared folder, and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def removing(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Remove the tables that were staged within, but for those whose path is added to ``keep``."""
    before = set(_made)
    try:
        yield
    finally:
        gone = [p for p in _made if p not in before and p not in keep]
        remove(spark, gone)
        _made[:] = [p for p in _made if p not in gone]


def last_staged() -> str:
    return _made[-1]


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 1 over the whole table, in an order without ties.

    Rows are dealt over ranges of the order, staged, counted by range and numbered within it, so that no task holds more
    than a range; only the counts (one row a partition) meet in one task.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + within).drop("__range", "__start")


def ranked_within(df: DataFrame, keys: list[str], order: list, name: str = "rank", totals: str | None = None) -> DataFrame:
    """``df`` with its rank from 1 among the rows of the same keys (few, not null), however many rows a key has.

    Ranges of (keys, order) are staged and counted by (range, keys); with ``totals`` the rows of the key are added under
    that name. The counts are one row for each key and range that meet, at most keys + partitions.
    """
    dealt = stage(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__range", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__start"), F.sum("n").over(Window.partitionBy(*keys)).alias("__total"))
    within = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    out = dealt.join(F.broadcast(starts), ["__range", *keys]).withColumn(name, F.col("__start") + within)
    if totals:
        out = out.withColumn(totals, F.col("__total"))
    return out.drop("__range", "__start", "__total")
