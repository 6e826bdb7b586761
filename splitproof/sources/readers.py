"""Readers: class folders of images, prediction and result files, maps and manifests. Schemas are explicit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalar import base_name
from ..operators.checks import check_unique

IMAGES = r"(?i)\.(png|jpe?g)$"


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, split, class, label, length of images under root/<split>/<class>/. Labels number the sorted classes from 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.col("path").rlike(IMAGES)).select("path", "length")
    parts = F.split("path", "/")
    items = files.select("path", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("class"), "length")
    names = items.where("split = 'Training'").select("class").distinct()
    names = names.withColumn("label", (F.row_number().over(Window.orderBy("class")) - 1).cast("int"))
    return items.join(F.broadcast(names), "class", "left").select("path", "split", "class", "label", "length")


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width and gray pixels (array of double) of every image that can be decoded."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)

    def gray(batches):
        for pdf in batches:
            out = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                out.append((x[:, :, 0] if c == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])).ravel())
            yield pd.DataFrame({"path": pdf["path"], "height": pdf["height"], "width": pdf["width"], "pixels": out})

    flat = rows.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    return flat.mapInPandas(gray, "path string, height int, width int, pixels array<double>")


def quant_sum(content: bytes) -> int | None:
    """Sum of the first 16 entries of a JPEG's first quantisation table; None for other files."""
    if content is None or content[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 4 <= len(content) and content[i] == 0xFF:
        kind, size = content[i + 1], int.from_bytes(content[i + 2 : i + 4], "big")
        if kind == 0xDB:
            wide = content[i + 4] >> 4
            table = content[i + 5 : i + 5 + 64 * (1 + wide)]
            values = [int.from_bytes(table[j : j + 1 + wide], "big") for j in range(0, 16 * (1 + wide), 1 + wide)]
            return sum(values)
        if kind == 0xDA:
            return None
        i += 2 + size
    return None


def file_metadata(spark: SparkSession, root: str) -> DataFrame:
    """path, length, height, width, mean and SD of the pixels, quantisation signature."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(IMAGES))

    @F.pandas_udf("int")
    def signature(content: pd.Series) -> pd.Series:
        return pd.Series([quant_sum(c) for c in content], dtype="Int32")

    facts = files.select("path", "length", signature("content").alias("qtable"))
    pixels = images(spark, root)
    n = F.size("pixels")
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x * x) / n
    shown = pixels.select(
        F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "height", "width", mean.alias("mean"), F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))).alias("sd")
    )
    return facts.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(shown, "path")


def json_map(df: DataFrame, column: str, value: str = "string") -> DataFrame:
    """Explode a JSON object into (path, key, value); key is the base name. Raises where base names collide."""
    rows = df.select(F.explode(F.from_json(column, f"map<string, {value}>")).alias("path", "value"))
    rows = rows.select("path", base_name(F.col("path")).alias("key"), "value")
    check_unique(rows, "key")
    return rows


def group_map(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark.read.text(path, wholetext=True), "value")


def predictions(spark: SparkSession, pattern: str, classes: list[str], fold_pattern: str = r"([0-9]+)/seed") -> DataFrame:
    """Prediction CSVs; fold and seed come from the path, probabilities become a map. Numbers keep 6 decimals."""
    kinds = schema.PREDICTION_CSV + "".join(f", `p_{c}` double" for c in classes)
    rows = spark.read.schema(kinds).option("header", "true").csv(pattern).withColumn("file", F.col("_metadata.file_path"))
    probs = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.col(f"p_{c}") for c in classes])) if classes else F.lit(None)
    return rows.select(
        base_name(F.col("path")).alias("item_key"), F.nullif("group", F.lit("")).alias("group_id"), "true", "pred", "correct", "confidence",
        probs.alias("probs"), F.nullif(F.regexp_extract("file", fold_pattern, 1), F.lit("")).cast("int").alias("fold"),
        F.nullif(F.regexp_extract("file", r"seed([0-9]+)", 1), F.lit("")).cast("int").alias("seed"),
    )


def run_results(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each seed of each results file."""
    rows = spark.read.text(pattern, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    each = rows.select("file", F.explode(F.from_json("value", schema.RUN_RESULT)).alias("run", "r"))
    return each.select("file", "run", "r.*")


def history(df: DataFrame, column: str = "value") -> DataFrame:
    """run, epoch (from 0) and the four measures of JSON histories in a column next to ``run``."""
    h = F.from_json(column, schema.HISTORY)
    rows = df.select("run", h.alias("h")).select("run", F.posexplode(F.arrays_zip("h.train_loss", "h.train_acc", "h.val_loss", "h.val_acc")).alias("epoch", "e"))
    return rows.select("run", "epoch", "e.train_loss", "e.train_acc", "e.val_loss", "e.val_acc")


def manifest_removed(df: DataFrame, column: str = "value", why: str | None = None) -> DataFrame:
    """(path, reason) of a manifest's removals, optionally of one kind of reason only."""
    rows = df.select(F.explode(F.from_json(column, schema.MANIFEST)["removed"]).alias("path", "reason"))
    return rows.where(F.col("reason").startswith(why)) if why else rows


def one_per_class(items: DataFrame, order: str = "item_id") -> DataFrame:
    return items.groupBy("class").agg(F.min(order).alias(order))
