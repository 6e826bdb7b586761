"""Sinks: splits that refuse to overwrite, prediction CSVs, one-row JSON, resumable and write-once stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(items: DataFrame, path: str) -> None:
    """Parquet partitioned by split and class; an existing folder is an error."""
    items.write.mode("errorifexists").partitionBy("split", "class").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """CSV with numbers of 6 decimals."""
    doubles = [c for c, t in preds.dtypes if t in ("double", "float")]
    preds.withColumns({c: F.format_string("%.6f", c) for c in doubles}).write.mode("errorifexists").option("header", "true").csv(path)


def write_summary(row: DataFrame, path: str) -> None:
    """One JSON document for a one-row frame."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def missing(wanted: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted if stored is None else wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def append_results(rows: DataFrame, path: str, keys: list[str], spark: SparkSession, exists: bool) -> None:
    """Append the rows whose keys are not stored yet."""
    missing(rows, spark.read.parquet(path) if exists else None, keys).write.mode("append").parquet(path)


def write_once(assigned: DataFrame, path: str, seed: int) -> None:
    assigned.withColumn("seed", F.lit(seed)).write.mode("errorifexists").parquet(path)


def read_once(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """A stored partition; raises if it was made with another seed."""
    rows = spark.read.parquet(path)
    if not rows.where(F.col("seed") != seed).isEmpty():
        raise ValueError(f"the partition at {path} was made with another seed")
    return rows.drop("seed")
