"""Similarity joins on vectors: exact top-1 in blocks, over variants, thresholds, percentiles.

The block join deals both sides over chunks and compares each pair of chunks once with a matrix product, so that
no task holds more than two chunks and no pair is emitted: only each query's best of a chunk leaves a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def _chunked(df: DataFrame, rows: int, chunk: int) -> tuple[DataFrame, int]:
    n = max(1, math.ceil(rows / chunk))
    return df.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def best_match(queries: DataFrame, base: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(query_id, match_id, variant, sim): the base row most similar to any variant of each query.

    ``queries``: id, v (array of double), and optionally variant (int). ``base``: id, v. Similarity is the dot product,
    clamped to [-1, 1]. Ties go to the smaller variant, then to the smaller id.
    """
    if "variant" not in queries.columns:
        queries = queries.withColumn("variant", F.lit(0))
    q, nq = _chunked(queries.select(F.col("id").cast("long"), "variant", "v"), queries.count(), chunk)
    b, nb = _chunked(base.select(F.col("id").cast("long"), "v"), base.count(), chunk)
    q = q.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select(
        (F.col("chunk") * nb + F.col("tile")).alias("tile"), "id", "variant", "v"
    )
    b = b.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select(
        (F.col("tile") * nb + F.col("chunk")).alias("tile"), "id", "v"
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "match_id": [], "variant": [], "sim": []})
        if not len(left) or not len(right):
            return out.astype({"query_id": "int64", "match_id": "int64", "variant": "int32"})
        right = right.sort_values("id")
        sims = np.clip(np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T, -1, 1)
        at = sims.argmax(1)
        return pd.DataFrame(
            {
                "query_id": left["id"].to_numpy(),
                "match_id": right["id"].to_numpy()[at],
                "variant": left["variant"].to_numpy().astype("int32"),
                "sim": sims[np.arange(len(left)), at],
            }
        )

    best = (
        q.groupBy("tile")
        .cogroup(b.groupBy("tile"))
        .applyInPandas(compare, "query_id long, match_id long, variant int, sim double")
    )
    top = F.max(F.struct("sim", (-F.col("variant")).alias("v"), (-F.col("match_id")).alias("m")))
    return best.groupBy("query_id").agg(top.alias("t")).select(
        "query_id", (-F.col("t.m")).alias("match_id"), (-F.col("t.v")).cast("int").alias("variant"), F.col("t.sim").alias("sim")
    )


def leak_table(matches: DataFrame, cosine: float, bits: int) -> DataFrame:
    """Per class: tests, mean similarity, near by cosine, near by hash, both. ``matches``: class, sim, distance."""
    near, hashed = F.col("sim") >= cosine, F.col("distance") <= bits
    return matches.groupBy("class").agg(
        F.count("*").alias("n"),
        F.round(F.avg("sim"), 6).alias("mean_sim"),
        F.count_if(near).alias("near_cos"),
        F.count_if(hashed).alias("near_hash"),
        F.count_if(near & hashed).alias("both"),
    )


def percentiles(df: DataFrame, column: str, at: tuple[float, ...]) -> DataFrame:
    """Linear-interpolation percentiles, one row each."""
    values = df.agg(F.percentile(column, F.array(*[F.lit(x / 100) for x in at])).alias("p"))
    return values.select(F.posexplode("p").alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(float(x)) for x in at]), F.col("i") + 1).alias("pct"), F.round("value", 6).alias("value")
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins over [low, high], the last one closed; what lies outside is dropped. Per class."""
    inside = df.where(F.col(column).between(low, high))
    bin_ = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy("class", bin_.alias("bin")).agg(F.count("*").alias("n"))


def threshold_ladder(df: DataFrame, column: str, limits: tuple[float, ...]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.lit(x) for x in limits])).alias("threshold"), column).groupBy("threshold").agg(
        F.count_if(F.col(column) >= F.col("threshold")).alias("n")
    )
