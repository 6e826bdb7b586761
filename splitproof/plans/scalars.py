"""Queries of the scalar functions (F), predicates (P) and file-shaped sources (S, K)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import checks
from ..shared import scratch
from ..sources import readers, sinks
from .fixtures import BITS, ITEMS, LOGITS, PIXELS, PREDS, SOFTMAX, VECS, h, hashes, items, logits, pixels, predictions, vectors
from .registry import query


@query("F1_file_md5", "SELECT doc_id, md5(text) AS file_hash FROM documents")
def f1(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.file_md5(F.col("text")).alias("file_hash"))


@query("F2_content_md5", f"WITH {ITEMS} SELECT item_id, content_hash FROM items")
def f2(spark, d):
    return items(spark, d).select("item_id", "content_hash")


@query("F3_phash", f"WITH {PIXELS}, {BITS}, w AS (SELECT item_id, sum(CASE WHEN on_ THEN 1::HUGEINT << (63 - b)::INT ELSE 0 END) AS s FROM bits GROUP BY 1) SELECT item_id, (s - CASE WHEN s >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)::BIGINT AS phash FROM w")
def f3(spark, d):
    return hashes(spark, d)


@query("F4_hamming", f"SELECT doc_id, bit_count(xor({h('text')}, {h('lang')}))::INT AS distance FROM documents")
def f4(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", S.hamming(S.hash_int(F.col("text")), S.hash_int(F.col("lang"))).alias("distance"))


@query("F5_l2_normalise", f"WITH {VECS}, n AS (SELECT item_id, v, sqrt(list_inner_product(v, v)) AS n FROM vecs) SELECT item_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM n")
def f5(spark, d):
    u = vectors(spark, d).select("item_id", S.l2_normalise(F.col("v")).alias("u"))
    return u.select("item_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("F6_cosine", f"WITH {VECS} SELECT a.item_id, round(list_inner_product(a.v, b.v), 6) AS sim FROM vecs a JOIN vecs b ON b.item_id = a.item_id + 1")
def f6(spark, d):
    v = vectors(spark, d)
    after = v.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("w"))
    return v.join(after, "item_id").select("item_id", F.round(S.dot(F.col("v"), F.col("w")), 6).alias("sim"))


@query("F7_min_max_uint8", f"WITH {PIXELS} SELECT item_id, list_sum(px)::BIGINT AS total, list_min(px) AS low, list_max(px) AS high FROM px")
def f7(spark, d):
    return pixels(spark, d).select("item_id", F.aggregate("px", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min("px").alias("low"), F.array_max("px").alias("high"))


@query(
    "F8_crop_box",
    f"""WITH {PIXELS}, long AS (SELECT item_id, unnest(px) AS p, unnest(range(64)) AS i FROM px)
SELECT item_id, greatest(min(i // 8) - 1, 0)::INT AS top, least(max(i // 8) + 1, 7)::INT AS bottom,
  greatest(min(i % 8) - 1, 0)::INT AS "left", least(max(i % 8) + 1, 7)::INT AS "right" FROM long WHERE p > 200 GROUP BY item_id""",
)
def f8(spark, d):
    """Long form of the crop: the box of what exceeds a threshold, with a margin of one."""
    p = pixels(spark, d).select("item_id", F.posexplode("px").alias("i", "p")).where("p > 200")
    row, col = F.floor(F.col("i") / 8), F.col("i") % 8
    return p.groupBy("item_id").agg(
        F.greatest(F.min(row) - 1, F.lit(0)).cast("int").alias("top"), F.least(F.max(row) + 1, F.lit(7)).cast("int").alias("bottom"),
        F.greatest(F.min(col) - 1, F.lit(0)).cast("int").alias("left"), F.least(F.max(col) + 1, F.lit(7)).cast("int").alias("right"),
    )


@query("F9_canonical_image")
def f9(spark, d):
    """Crop and bilinear resize to 16 x 16: mean of the canonical image."""
    @F.pandas_udf("double")
    def mean(px: pd.Series) -> pd.Series:
        return pd.Series([float(S.canonical_image(np.asarray(p, float).reshape(8, 8), 16).mean()) for p in px])

    return pixels(spark, d).select("item_id", F.round(mean("px"), 6).alias("mean"))


_TURNS = {n: i for n, i in S.dihedral_index(8).items()}


@query(
    "F10_dihedral",
    f"WITH {PIXELS} "
    + " UNION ALL ".join(
        f"SELECT item_id, '{n}' AS variant, list_sum(list_transform(range(1, 65), lambda i: i * px[{ix}[i] + 1]))::BIGINT AS checksum FROM px" for n, ix in _TURNS.items()
    ),
)
def f10(spark, d):
    """Eight orientations as index permutations."""
    table = F.explode(F.create_map(*[x for n, ix in _TURNS.items() for x in (F.lit(n), F.array(*[F.lit(i) for i in ix]))])).alias("variant", "ix")
    turned = pixels(spark, d).select("item_id", "px", table).select("item_id", "variant", F.expr("transform(ix, i -> px[i])").alias("q"))
    return turned.select("item_id", "variant", F.expr("aggregate(transform(q, (p, i) -> cast((i + 1) * p as bigint)), 0L, (s, x) -> s + x)").alias("checksum"))


@query(
    "F11_equalise",
    f"""WITH {PIXELS}, long AS (SELECT item_id, unnest(px) AS p, unnest(range(64)) AS i FROM px),
  n AS (SELECT item_id, p, count(*) AS n FROM long GROUP BY 1, 2), c AS (SELECT item_id, p, sum(n) OVER (PARTITION BY item_id ORDER BY p)::DOUBLE AS cdf FROM n),
  e AS (SELECT l.item_id, i, cdf - avg(cdf) OVER (PARTITION BY l.item_id) AS x FROM long l JOIN c ON c.item_id = l.item_id AND c.p = l.p)
SELECT item_id, round(sum(x * i) / nullif(sqrt(sum(x * x)), 0), 5) AS moment FROM e GROUP BY item_id""",
)
def f11(spark, d):
    """Histogram equalisation by the running count of values, centred and of unit norm: its first moment."""
    from pyspark.sql import Window

    p = pixels(spark, d).select("item_id", F.posexplode("px").alias("i", "p"))
    cdf = F.count("*").over(Window.partitionBy("item_id").orderBy("p"))  # range frame: all values up to this one
    e = p.withColumn("cdf", cdf.cast("double"))
    e = e.withColumn("x", F.col("cdf") - F.avg("cdf").over(Window.partitionBy("item_id")))
    return e.groupBy("item_id").agg(F.round(F.try_divide(F.sum(F.col("x") * F.col("i")), F.sqrt(F.sum(F.col("x") * F.col("x")))), 5).alias("moment"))


@query(
    "F12_mask_iou",
    f"""WITH {PIXELS}, two AS (SELECT a.item_id, unnest(a.px) > 100 AS x, unnest(b.px) > 100 AS y FROM px a JOIN px b ON b.item_id = a.item_id + 1)
SELECT item_id, coalesce(round(count(*) FILTER (x AND y) / nullif(count(*) FILTER (x OR y), 0)::DOUBLE, 6), 0) AS iou FROM two GROUP BY item_id""",
)
def f12(spark, d):
    m = pixels(spark, d).select("item_id", F.transform("px", lambda x: x > 100).alias("m"))
    after = m.select((F.col("item_id") - 1).alias("item_id"), F.col("m").alias("w"))
    return m.join(after, "item_id").select("item_id", F.round(S.iou(F.col("m"), F.col("w")), 6).alias("iou"))


_STRIP = "regexp_replace({x}, '[^A-Za-z0-9 ]', '', 'g')"
_VARIANT_SQL = {
    "identity": "text", "lower": "lower(text)", "strip": _STRIP.format(x="text"), "truncate64": "substr(text, 1, 64)",
    "lower_strip": "regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')", "lower_truncate64": "lower(substr(text, 1, 64))",
    "strip_truncate64": f"substr({_STRIP.format(x='text')}, 1, 64)", "all": f"lower(substr({_STRIP.format(x='text')}, 1, 64))",
}


@query("F13_degrade", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS variant, md5({e}) AS hash FROM documents" for n, e in _VARIANT_SQL.items()))
def f13(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.md5(f(F.col("text"))).alias("hash")) for n, f in S.DEGRADE.items()]))
    return docs.select("doc_id", each.alias("e")).select("doc_id", "e.variant", "e.hash")


@query("F14_base_name", r"SELECT page_id, string_split(replace(url, '\', '/'), '/')[-1] AS base FROM pages")
def f14(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.base_name(F.col("url")).alias("base"))


@query("F15_group_fallback", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'es' THEN '' ELSE source END, ''), '__ungrouped__' || doc_id) AS grp FROM documents")
def f15(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    group = F.when(F.col("lang") == "es", "").otherwise(F.col("source"))
    return docs.select("doc_id", S.group_or_single(group, F.col("doc_id").cast("string")).alias("grp"))


@query("F16_decode_codes", "SELECT DISTINCT source, trim(source || ' ') AS decoded FROM documents")
def f16(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source").distinct()
    codes = F.transform(F.split(F.concat("source", F.lit(" ")), ""), lambda c: F.ascii(c))
    return docs.select("source", S.decode_codes(F.filter(codes, lambda c: c > 0)).alias("decoded"))


@query("F17_softmax", f"WITH {LOGITS}, p AS (SELECT item_id, {SOFTMAX.format(z='z')} AS p FROM logits) SELECT item_id, round(p[1], 6) AS p0, round(p[5], 6) AS p4 FROM p")
def f17(spark, d):
    p = logits(spark, d).select("item_id", S.softmax(F.col("z")).alias("p"))
    return p.select("item_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[4], 6).alias("p4"))


@query("F18_argmax", f"WITH {LOGITS}, p AS (SELECT item_id, {SOFTMAX.format(z='z')} AS p, z FROM logits) SELECT item_id, (list_position(z, list_max(z)) - 1)::INT AS pred, round(list_max(p), 6) AS confidence FROM p")
def f18(spark, d):
    p = logits(spark, d).select("item_id", "z", S.softmax(F.col("z")).alias("p"))
    return p.select("item_id", S.argmax(F.col("z")).alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("F19_top_k", f"WITH {LOGITS}, e AS (SELECT item_id, unnest(z) AS x, unnest(range(5))::INT AS c FROM logits), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY x DESC, c)::INT AS rank FROM e) SELECT item_id, rank, c, round(x, 6) AS z FROM r WHERE rank <= 3")
def f19(spark, d):
    top = S.top_k(F.col("z"), F.array(*[F.lit(i) for i in range(5)]), 3)
    each = logits(spark, d).select("item_id", F.posexplode(top).alias("i", "t"))
    return each.select("item_id", (F.col("i") + 1).alias("rank"), F.col("t.name").alias("c"), F.round("t.p", 6).alias("z"))


_SCALED = "list_transform(z, lambda x: x / 2.0::DOUBLE)"


@query("F20_temperature", f"WITH {LOGITS}, s AS (SELECT item_id, z, {_SCALED} AS t FROM logits), p AS (SELECT item_id, z, t, {SOFTMAX.format(z='t')} AS p FROM s) SELECT item_id, round(list_max(p), 6) AS confidence, list_position(z, list_max(z)) = list_position(t, list_max(t)) AS same FROM p")
def f20(spark, d):
    p = logits(spark, d).select("item_id", "z", S.softmax(F.col("z"), 2.0).alias("p"))
    return p.select("item_id", F.round(F.array_max("p"), 6).alias("confidence"), (S.argmax(F.col("z")) == S.argmax(F.col("p"))).alias("same"))


@query("F21_reason", "SELECT event_id, printf('cosine %.4f >= 0.9900', value) AS reason FROM events")
def f21(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.reason("cosine", F.col("value"), 0.99).alias("reason"))


_ARMS = 'a AS (SELECT "true" AS class, avg(correct) FILTER (arm = \'random\') AS r, avg(correct) FILTER (arm = \'patient\') AS p FROM preds GROUP BY 1)'


@query("F22_points", f"WITH {PREDS}, {_ARMS} SELECT class, round(100.0 * (r - p), 6) AS points, round((1 - p) / greatest(1 - r, 1e-12), 6) AS error_ratio FROM a")
def f22(spark, d):
    p = predictions(spark, d)
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    a = p.groupBy(F.col("true").alias("class")).agg(side("random").alias("r"), side("patient").alias("p"))
    return a.select("class", F.round(S.points(F.col("r"), F.col("p")), 6).alias("points"), F.round(S.error_ratio(F.col("p"), F.col("r")), 6).alias("error_ratio"))


# ---- predicates --------------------------------------------------------------------------------------------


@query("P1_class_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND lang <> 'es'")
def p1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    return docs.where(F.col("lang").isin("de", "fr") & (F.col("lang") != "es"))


@query("P2_conjunction", "SELECT event_type, count(*) FILTER (value >= 50) AS a, count(*) FILTER (user_id % 8 <= 3) AS b, count(*) FILTER (value >= 50 AND user_id % 8 <= 3) AS both FROM events GROUP BY 1")
def p2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    x, y = F.col("value") >= 50, F.col("user_id") % 8 <= 3
    return e.groupBy("event_type").agg(F.count_if(x).alias("a"), F.count_if(y).alias("b"), F.count_if(x & y).alias("both"))


@query("P3_traced", "SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS traced, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS untraced FROM documents GROUP BY 1")
def p3(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    traced = docs.select("doc_id", "lang").join(labels.select("doc_id").distinct().withColumn("t", F.lit(1)), "doc_id", "left")
    return traced.groupBy("lang").agg(F.count("t").alias("traced"), F.count_if(F.col("t").isNull()).alias("untraced"))


@query("P4_confident_errors", f'WITH {PREDS} SELECT arm, seed, item_id, "true" AS truth, pred FROM preds WHERE "true" <> pred AND confidence > 0.9')
def p4(spark, d):
    p = predictions(spark, d).where((F.col("true") != F.col("pred")) & (F.col("confidence") > 0.9))
    return p.select("arm", "seed", "item_id", F.col("true").alias("truth"), "pred")


@query("P5_eligible", "SELECT lang AS class, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eligible' WHEN lang <> 'es' THEN 'forced_train' ELSE 'dropped' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def p5(spark, d):
    from ..operators.partition import eligibility

    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    ids = labels.select("doc_id").distinct().withColumn("group_id", F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.col("lang").alias("class")).join(ids, "doc_id", "left").withColumn("has_groups", F.col("class") != "es")
    return eligibility(rows).groupBy("class", "status").agg(F.count("*").alias("n"))


@query("P6_multi_class_groups", "SELECT source, count(DISTINCT lang) AS classes FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def p6(spark, d):
    from ..operators.leakage import multi_class_groups

    return multi_class_groups(items(spark, d), "source")


# ---- file-shaped sources and sinks ------------------------------------------------------------------------


@query("S4_json_map", "SELECT DISTINCT 'data/' || doc_id || '.txt' AS path, doc_id || '.txt' AS key, source AS value FROM documents")
def s4(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = docs.select(F.to_json(F.create_map(path, "source")).alias("value"))
    return readers.json_map(text, "value")


def _csv_predictions(spark, d) -> DataFrame:
    out = scratch(spark)
    p = predictions(spark, d).where("arm = 'patient'")
    rows = p.select(
        F.concat(F.lit("img\\"), F.col("item_id").cast("string")).alias("path"), F.col("group_id").alias("group"), "true", "pred", "correct", "confidence",
        F.concat(F.lit("cv_fold"), F.col("fold").cast("string")).alias("run"), F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("part"),
    )
    rows = rows.withColumn("confidence", F.format_string("%.6f", "confidence"))
    # one folder for each run and seed, the layout that the reader takes fold and seed from
    rows.write.partitionBy("run", "part").option("header", "true").csv(out)
    return readers.predictions(spark, f"{out}/*/*/*.csv", [], r"cv_fold([0-9]+)")


@query("S5_predictions_scan", f"WITH {PREDS} SELECT seed, fold, count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(round(confidence, 6)), 6) AS confidence FROM preds WHERE arm = 'patient' GROUP BY 1, 2")
def s5(spark, d):
    """Written as CSV in the runs' folder layout and read back; also the predictions sink (K2)."""
    p = _csv_predictions(spark, d)
    return p.groupBy("seed", "fold").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("S6_run_results", f'WITH {PREDS} SELECT seed, count(*)::INT AS n_test, sum(1 - correct)::INT AS n_errors, round(avg(correct), 6) AS test_accuracy FROM preds WHERE arm = \'random\' GROUP BY 1')
def s6(spark, d):
    """One JSON summary of all seeds, written (K3) and read back."""
    p = predictions(spark, d).where("arm = 'random'").groupBy("seed").agg(
        F.round(F.avg("correct"), 6).alias("test_accuracy"), F.count("*").cast("int").alias("n_test"), F.sum(1 - F.col("correct")).cast("int").alias("n_errors")
    )
    run = F.struct(F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("key"), F.struct("test_accuracy", "n_test", "n_errors", "seed").alias("value"))
    text = p.agg(F.to_json(F.map_from_entries(F.collect_list(run))).alias("value"))
    out = scratch(spark)
    text.write.text(out)
    return readers.run_results(spark, out).select("seed", "n_test", "n_errors", "test_accuracy")


@query("S7_history", "SELECT event_type AS run, e.i::INT AS epoch, round(e.v, 6) AS val_loss FROM (SELECT event_type, list(value ORDER BY event_id) AS vs FROM events GROUP BY 1), LATERAL (SELECT unnest(vs) AS v, unnest(range(len(vs))) AS i) e")
def s7(spark, d):
    """Histories as JSON with arrays by epoch, exploded to rows. All events of a run in the order of their ids serve as
    epochs. A history is written in pieces of 10,000 ids, so that no array grows with the table."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.expr("event_id div 10000").alias("piece"), "event_id", "value")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = e.groupBy("name", "piece").agg(F.count("*").alias("n")).select(F.col("name").alias("n1"), F.col("piece").alias("p1"), before.alias("first"))
    js = e.groupBy("name", "piece").agg(ordered.alias("val_loss")).join(first, F.col("name").eqNullSafe(F.col("n1")) & F.col("piece").eqNullSafe(F.col("p1"))).withColumn("run", F.struct("name", "first"))
    js = js.select("run", F.to_json(F.struct(F.col("val_loss").alias("train_loss"), F.col("val_loss").alias("train_acc"), "val_loss", F.col("val_loss").alias("val_acc"))).alias("value"))
    return readers.history(js).select(F.col("run.name").alias("run"), (F.col("run.first") + F.col("epoch")).cast("int").alias("epoch"), F.round("val_loss", 6).alias("val_loss"))


@query("S8_manifest", f"WITH {ITEMS}, r AS (SELECT item_id, row_number() OVER (PARTITION BY split, content_hash ORDER BY item_id) AS r FROM items) SELECT 'data/' || item_id AS path, 'duplicate within split' AS reason FROM r WHERE r > 1")
def s8(spark, d):
    from ..operators.dedup import removal_reasons

    gone = removal_reasons(items(spark, d)).select(F.concat(F.lit("data/"), F.col("item_id").cast("string")).alias("path"), "reason")
    rows = gone.select(F.to_json(F.struct(F.lit("exact").alias("mode"), F.create_map("path", "reason").alias("removed"))).alias("value"))
    return readers.manifest_removed(rows, why="duplicate within")


@query("S10_one_per_class", "SELECT lang AS class, min(doc_id) AS item_id FROM documents GROUP BY 1")
def s10(spark, d):
    return readers.one_per_class(items(spark, d))


@query("K1_write_split", f"WITH {ITEMS} SELECT split, class, count(*) AS n FROM items GROUP BY 1, 2")
def k1(spark, d):
    """Written partitioned by split and class, read back, checked to hold each item once, and counted."""
    out = scratch(spark)
    kept = items(spark, d).select("item_id", "split", "class", "content_hash")
    sinks.write_split(kept, out)
    again = spark.read.parquet(out)
    checks.check_unique(again, "item_id")
    return again.groupBy("split", "class").agg(F.count("*").alias("n"))


@query("K4_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k4(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return sinks.missing(docs.select("doc_id"), labels, ["doc_id"])


@query("K5_write_once", f"WITH {ITEMS} SELECT item_id, {h('item_id::VARCHAR')} % 5 AS fold FROM items")
def k5(spark, d):
    out = scratch(spark)
    rows = items(spark, d).select("item_id", (S.hash_int(F.col("item_id").cast("string")) % 5).alias("fold"))
    sinks.write_once(rows, out, 1234)
    again = sinks.read_once(spark, out, 1234)
    checks.check_unique(again, "item_id")
    return again
