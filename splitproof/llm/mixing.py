"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's share of the budget goes by its weight, but never above ``max_epochs`` times its size; what is cut off
is shared again by weight among the others. Within a source every document is taken once for each complete epoch
of the target; the fraction that is left is filled in the order of exponential keys, -ln(u) / quality weight,
where u is a hash of the id (of the text, where there is no id): a document is taken when the words before it and half
its own fit. The prefix sums are taken in two steps, over buckets of the keys and inside the bucket, so that a source with
a third of all rows is dealt over many tasks. Sources may be many (web domains): they are ranked by ranges, and the level
of their shares is found by a few aggregates, never by a window over all of them.

Defined cases: a null or blank text has size 0 and is taken 0 words. A null source is a source of its own, last in
order. Ties of keys go by id, then size, then a hash of the text. Rows that repeat an id are documents of their own with
equal keys. Documents without a quality label weigh 1. Sources of size 0 have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ranked, stage
from .common import small_side

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024  # of a source's keys
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return (
        F.when(text.isNull() | (F.length(trimmed) == 0), F.lit(0))
        .otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
        .cast("long")
    )


def uniform(id_col: str, text_col: str) -> Column:
    """A number in (0, 1) that depends on the id alone, or on the text where there is no id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target: shares by weight, none above max_epochs times the source's size.

    ``sizes``: one row for each source. A level L gives each source min(cap, L * weight). It starts as if none were
    capped; sources whose cap is below their share are capped and the rest shared again, until no more are: each round is
    one aggregate.
    """
    order = [F.col("source").isNull(), F.col("source")]
    places = ranked(sizes, order, "i")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("i") - 1) % len(weights)).cast("int") + 1)
    capped = stage(places.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    whole = capped.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    level, budget = None, float(whole["n"] or 0) * share
    if whole["w"]:
        level, free = budget / whole["w"], None
        while True:
            over = F.col("cap") <= F.lit(level) * F.col("w")
            at = capped.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
            if at["w"] is None or at["w"] == free:
                level = None if at["w"] is None else level
                break
            free = at["w"]
            level = (budget - at["cap"]) / free
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return capped.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    id_col: str = "doc_id",
) -> DataFrame:
    """id, source, size, source_size, target, copies, taken and text_hash for every document. ``quality``: (id, weight > 0)."""
    rows = docs.select(
        F.col(id_col).alias("id"), "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), uniform(id_col, "text").alias("u")
    )
    if quality is not None:
        best = quality.groupBy(F.col(id_col).alias("id")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, "id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    u = F.col("u")
    rows = rows.withColumn("key", -F.log(u) / F.coalesce("weight", F.lit(1.0)))
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BUCKETS).cast("int")).drop("u", "weight")
    rows = stage(rows, "sizes")  # the texts are read once for the targets and the places

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket")
    before = F.coalesce(F.sum("bucket_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("before_bucket", before)
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, max_epochs), "targets")
    targets = small_side(targets, targets.count(), BROADCAST_SOURCES)
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(F.col("b.source").alias("s"), F.col("b.bucket").alias("b"), "before_bucket", "t.source_size", "target")
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["bucket"] == plan["b"])).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("before_bucket") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    dealt = dealt.withColumn("prefix", prefix).withColumn("epochs", epochs.cast("long"))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("prefix") + F.col("size") / 2.0 < left).cast("long")
    return dealt.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("epochs") + extra).alias("copies"),
        ((F.col("epochs") + extra) * F.col("size")).cast("long").alias("taken"),
        "text_hash",
    )


def take(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, in all their columns, each as many times as the mix takes it.

    Rows equal in id, source and text are one another's copies: what the mix takes of them together is shared among them
    as evenly as can be, so that a target is met just as by different documents.
    """
    key = ["__id", "__source", "__hash"]
    taken = mix(docs, quality, id_col=id_col, **options)
    alike = taken.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"))
    alike = stage(alike.agg(F.sum("copies").alias("__all"), F.count("*").alias("__rows")).where("__all > 0"), "taken")
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("i"), F.col("source").alias("s"), F.xxhash64("text").alias("h"))
    same = rows["i"].eqNullSafe(alike["__id"]) & rows["s"].eqNullSafe(alike["__source"]) & (rows["h"] == alike["__hash"])
    both = rows.join(alike, same)
    each, rest = F.expr("__all div __rows"), F.col("__all") % F.col("__rows")
    out = both.withColumn("__n", each)
    if alike.where(rest > 0).isEmpty() is False:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
        uneven = both.where(rest > 0).withColumn("__n", each + (place <= rest).cast("long"))
        out = out.where(rest == 0).unionByName(uneven)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))
    out = out.where("__n > 0").select("__row", copies.alias("__copy"))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents labelled good, 1/2 for those labelled bad."""
    return labels.where("doc_id is not null and quality is not null").select(
        "doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight")
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents
), q AS (
  SELECT doc_id AS qid, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix:' || name), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
           / coalesce(weight, 1.0::DOUBLE) AS key
  FROM d LEFT JOIN q ON doc_id = qid
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source
), c AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, i) AS r,
    (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), f AS (SELECT arg_min(level, r) AS level FROM l WHERE level * w < cap
), t AS (
  SELECT source, source_size, round(least(cap, coalesce(f.level * w, cap)), 6) AS target FROM l LEFT JOIN f ON true
), p AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS prefix,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN prefix + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""
