"""Audit views over the generic tables, as DataFrames and as the SQL that defines the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import content_md5, hash_int


def h(expression: str) -> str:
    """SQL of hash_int."""
    return f"(('0x' || substr(md5({expression}), 1, 8))::BIGINT)"


def _split(prefix: str, key: str):
    return F.when(hash_int(F.lit(prefix), F.col(key).cast("string")) % 5 == 0, "Testing").otherwise("Training")


def items(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("class"),
        "source",
        _split("split:", "doc_id").alias("split"),
        F.concat("source", F.lit("|"), "lang").alias("group_id"),
        F.md5("text").alias("file_hash"),
        content_md5(F.col("text")).alias("content_hash"),
        "n_chars",
        "text",
    )


ITEMS = f"""items AS (
  SELECT doc_id AS item_id, lang AS class, source, CASE WHEN {h("'split:' || doc_id")} % 5 = 0 THEN 'Testing' ELSE 'Training' END AS split,
         source || '|' || lang AS group_id, md5(text) AS file_hash,
         md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS content_hash, n_chars, text FROM documents
)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("int").alias("class"), _split("split:", "vec_id").alias("split"), F.col("embedding").cast("array<double>").alias("v")
    )


VECS = f"""vecs AS (
  SELECT vec_id AS item_id, label::INT AS class, CASE WHEN {h("'split:' || vec_id")} % 5 = 0 THEN 'Testing' ELSE 'Training' END AS split,
         list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
)"""
#: the best training match of each test vector
BEST = (
    VECS
    + """, pairs AS (
  SELECT a.item_id, a.class, b.item_id AS match_id, b.class AS match_class,
         greatest(-1, least(1, list_inner_product(a.v, b.v))) AS sim, a.v AS av, b.v AS bv
  FROM vecs a, vecs b WHERE a.split = 'Testing' AND b.split = 'Training'
), best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, match_id) = 1)"""
)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as an 8 x 8 image of 0..255: item_id, px (array of int)."""
    from ..functions.scalar import min_max_uint8

    return vectors(spark, d).select("item_id", min_max_uint8(F.col("v")).alias("px"))


PIXELS = (
    VECS
    + """, px AS (
  SELECT item_id, list_transform(v, lambda x: CASE WHEN list_max(v) > list_min(v)
    THEN floor(255.0::DOUBLE * (x - list_min(v)) / (list_max(v) - list_min(v)))::INT ELSE 0 END) AS px FROM vecs
)"""
)


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """The perceptual hash of each vector's image, every pixel enlarged to 4 x 4: item_id, phash (64 bits)."""
    from ..functions.scalar import enlarged_hashes

    @F.pandas_udf("long")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series(enlarged_hashes(np.array(list(images), float).reshape(-1, 8, 8)))

    return pixels(spark, d).select("item_id", run("px").alias("phash"))


#: on: whether bit b (from the first, the highest) of an image's perceptual hash is set
BITS = """dct AS (
  SELECT k, i, sum(CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE 0.25::DOUBLE END * cos(pi() * (2 * (4 * i + j) + 1) * k / 64)) AS t
  FROM range(8) x(k), range(8) y(i), range(4) z(j) GROUP BY 1, 2
), dot AS (SELECT item_id, unnest(px) AS p, unnest(range(64)) AS n FROM px
), half AS (SELECT item_id, k, n % 8 AS j, sum(t * p) AS v FROM dot JOIN dct ON i = n // 8 GROUP BY 1, 2, 3
), low AS (SELECT item_id, half.k AS k, dct.k AS l, sum(v * t) AS v FROM half JOIN dct ON i = j GROUP BY 1, 2, 3
), mid AS (SELECT item_id, median(v) FILTER (k > 0 OR l > 0) AS m FROM low GROUP BY 1
), bits AS (SELECT item_id, k * 8 + l AS b, v > m AS on_ FROM low JOIN mid USING (item_id))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Events as predictions of three seeds in two arms, with folds by group or at random."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    kinds = F.array_sort(F.collect_set("event_type"))
    following = F.transform("k", lambda x, i: F.element_at("k", (F.pmod(i + 1, F.size("k")) + 1).cast("int")))
    next_class = e.agg(kinds.alias("k")).select(F.map_from_arrays("k", following).alias("after"))
    e = e.join(F.broadcast(next_class))  # one row: the classes
    e = e.withColumn("arm", F.explode(F.array(F.lit("patient"), F.lit("random")))).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (0, 1, 42)])))
    s = lambda c: F.col(c).cast("string")
    base = F.when(F.col("arm") == "patient", 8).otherwise(4) + 2 * (F.col("user_id") % 5)
    wrong = hash_int(s("event_id"), F.lit(":"), s("seed"), F.lit(":"), F.col("arm")) % 100 < base
    fold = F.when(F.col("arm") == "patient", F.col("user_id") % 5).otherwise(hash_int(F.lit("f"), s("event_id")) % 5).cast("int")
    return e.select(
        "arm", "seed", fold.alias("fold"), F.col("event_id").alias("item_id"), s("user_id").alias("group_id"), F.col("event_type").alias("true"),
        F.when(wrong, F.element_at("after", F.col("event_type"))).otherwise(F.col("event_type")).alias("pred"), (~wrong).cast("int").alias("correct"),
        (0.5 + (hash_int(F.lit("c"), s("event_id"), F.lit(":"), s("seed")) % 5000) / 10000.0).alias("confidence"), (F.col("event_id") % 6 == 0).alias("is_dup"),
    )


PREDS = f"""kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT event_type FROM events)
), after AS (SELECT a.event_type, b.event_type AS nxt FROM kinds a JOIN kinds b ON b.i = (a.i + 1) % a.k
), grid AS (
  SELECT e.event_id, e.user_id, e.event_type, nxt, arm, seed,
    {h("e.event_id || ':' || seed || ':' || arm")} % 100 < CASE arm WHEN 'patient' THEN 8 ELSE 4 END + 2 * (e.user_id % 5) AS wrong
  FROM events e JOIN after USING (event_type), (VALUES ('patient'), ('random')) a(arm), (VALUES (0), (1), (42)) s(seed)
), preds AS (
  SELECT arm, seed, (CASE arm WHEN 'patient' THEN user_id % 5 ELSE {h("'f' || event_id")} % 5 END)::INT AS fold, event_id AS item_id, user_id::VARCHAR AS group_id,
    event_type AS "true", CASE WHEN wrong THEN nxt ELSE event_type END AS pred, (NOT wrong)::INT AS correct,
    0.5::DOUBLE + ({h("'c' || event_id || ':' || seed")} % 5000) / 10000.0::DOUBLE AS confidence, event_id % 6 = 0 AS is_dup
  FROM grid
)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One-vs-rest scores of one model: class, score, positive."""
    p = predictions(spark, d).where("arm = 'patient' and seed = 42")
    classes = p.select("true").distinct().withColumnRenamed("true", "class")
    each = p.join(F.broadcast(classes))  # a handful of classes
    score = F.when(F.col("pred") == F.col("class"), F.col("confidence")).otherwise((1 - F.col("confidence")) / 5.0)
    return each.select("class", F.round(score, 6).alias("score"), (F.col("true") == F.col("class")).cast("int").alias("positive"))


SCORED = (
    PREDS
    + """, scored AS (
  SELECT c.event_type AS class, round(CASE WHEN pred = c.event_type THEN confidence ELSE (1 - confidence) / 5.0::DOUBLE END, 6) AS score,
    ("true" = c.event_type)::INT AS positive FROM preds, kinds c WHERE arm = 'patient' AND seed = 42
)"""
)


def logits(spark: SparkSession, d: str) -> DataFrame:
    """Five logits of each vector and a label."""
    v = vectors(spark, d)
    return v.select("item_id", F.transform(F.slice("v", 1, 5), lambda x: x * 10.0).alias("z"), (F.col("class") % 5).cast("int").alias("label"))


LOGITS = VECS + """, logits AS (SELECT item_id, list_transform(v[1:5], lambda x: x * 10.0::DOUBLE) AS z, (class % 5)::INT AS label FROM vecs)"""
SOFTMAX = "list_transform({z}, lambda x: exp(x - list_max({z})) / list_sum(list_transform({z}, lambda y: exp(y - list_max({z})))))"
