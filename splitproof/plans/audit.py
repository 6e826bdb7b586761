"""Queries of the leakage audit: joins (J), aggregates (A), windows (W), top-n (O), sets (U), partitioning (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import checks, cluster, dedup, leakage, partition, similarity
from ..operators.contamination import contained_passages
from .fixtures import BEST, BITS, ITEMS, PIXELS, PREDS, VECS, h, hashes, items, predictions, vectors
from .registry import query

TRAIN = "split = 'Training'"


def best_train(spark, d) -> DataFrame:
    """item_id, class, match_id, match_class, sim of each test vector."""
    v = vectors(spark, d)
    test = v.where("split = 'Testing'")
    m = similarity.best_match(test.select(F.col("item_id").alias("id"), "v"), v.where(TRAIN).select(F.col("item_id").alias("id"), "v"))
    a = v.select(F.col("item_id").alias("query_id"), "class")
    b = v.select(F.col("item_id").alias("match_id"), F.col("class").alias("match_class"))
    return m.join(a, "query_id").join(b, "match_id").select(F.col("query_id").alias("item_id"), "class", "match_id", "match_class", "sim")


# ---- joins -------------------------------------------------------------------------------------------------

_SEMI = "SELECT {k} FROM items WHERE split = 'Training'"


@query(
    "J1_exact_leak",
    f"""WITH {ITEMS} SELECT class, count(*) AS n_test, count(*) FILTER (file_hash IN ({_SEMI.format(k='file_hash')})) AS leaked_file_hash,
  count(*) FILTER (content_hash IN ({_SEMI.format(k='content_hash')})) AS leaked_content_hash FROM items WHERE split = 'Testing' GROUP BY 1""",
)
def j1(spark, d):
    return dedup.leak_report(items(spark, d), ["file_hash", "content_hash"])


@query("J2_drop_leaked_test", f"WITH {ITEMS} SELECT item_id FROM items WHERE split = 'Testing' AND content_hash NOT IN ({_SEMI.format(k='content_hash')})")
def j2(spark, d):
    t = items(spark, d)
    return t.where("split = 'Testing'").join(dedup.train_hashes(t, "content_hash"), "content_hash", "left_anti").select("item_id")


@query("J3_boundary_check", f"WITH {ITEMS} SELECT content_hash FROM items GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j3(spark, d):
    return checks.boundary_leaks(items(spark, d), "content_hash")


@query("J4_group_overlap", f"WITH {ITEMS} SELECT group_id FROM items WHERE split = 'Testing' INTERSECT SELECT group_id FROM items WHERE split = 'Training'")
def j4(spark, d):
    t = items(spark, d)
    return t.where("split = 'Testing'").select("group_id").intersect(t.where(TRAIN).select("group_id"))


@query("J5_fold_disjoint", f"WITH {PREDS} SELECT group_id FROM preds WHERE arm = 'random' GROUP BY 1 HAVING count(DISTINCT fold) <> 1")
def j5(spark, d):
    return checks.fold_conflicts(predictions(spark, d).where("arm = 'random'")).select("group_id")


@query("J6_map_lookup", "SELECT d.doc_id, l.toxic, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)")
def j6(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    found = labels.select("doc_id", "toxic", F.lit(True).alias("m"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", "toxic", F.coalesce("m", F.lit(False)).alias("matched"))


@query("J7_annotate_groups", "SELECT o_orderkey, coalesce(c.c_mktsegment, '') AS grp FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def j7(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("")).alias("grp"))


@query("J8_fold_through_group", f"WITH {ITEMS}, g AS (SELECT DISTINCT group_id, {h('group_id')} % 5 AS fold FROM items) SELECT item_id, fold FROM items JOIN g USING (group_id)")
def j8(spark, d):
    t = items(spark, d).select("item_id", "group_id")
    g = t.select("group_id").distinct().withColumn("fold", S.hash_int(F.col("group_id")) % 5)
    return t.join(g, "group_id").select("item_id", "fold")


@query("J9_top1_similarity", f"WITH {BEST} SELECT item_id, match_id, round(sim, 6) AS sim FROM best")
def j9(spark, d):
    return best_train(spark, d).select("item_id", "match_id", F.round("sim", 6).alias("sim"))


_VARIANTS = {0: "av", 1: "list_reverse(av)", 2: "list_transform(av, lambda x: -x)"}


@query(
    "J10_top1_variants",
    f"WITH {BEST}, w AS ("
    + " UNION ALL ".join(f"SELECT item_id, match_id, {i} AS variant, greatest(-1, least(1, list_inner_product({e}, bv))) AS sim FROM pairs" for i, e in _VARIANTS.items())
    + "), t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, variant, match_id) = 1) SELECT item_id, match_id, variant, round(sim, 6) AS sim FROM t WHERE sim >= 0.4",
)
def j10(spark, d):
    """Three orientations of each test vector: as it is, reversed, negated. The first variant wins ties."""
    v = vectors(spark, d)
    turned = F.posexplode(F.array("v", F.reverse("v"), F.transform("v", lambda x: -x))).alias("variant", "v")
    test = v.where("split = 'Testing'").select(F.col("item_id").alias("id"), turned)
    m = similarity.best_match(test, v.where(TRAIN).select(F.col("item_id").alias("id"), "v"))
    return m.where("sim >= 0.4").select(F.col("query_id").alias("item_id"), "match_id", "variant", F.round("sim", 6).alias("sim"))


@query("J11_drop_similar", f"WITH {BEST} SELECT item_id FROM best WHERE sim < 0.4")
def j11(spark, d):
    v = vectors(spark, d).where("split = 'Testing'").select("item_id")
    return v.join(best_train(spark, d).where("sim >= 0.4"), "item_id", "left_anti")


@query(
    "J12_paired_arms",
    f"WITH {PREDS}, i AS (SELECT item_id, avg(correct) FILTER (arm = 'random') AS r, avg(correct) FILTER (arm = 'patient') AS p FROM preds GROUP BY 1) SELECT item_id, round(r - p, 6) AS diff FROM i",
)
def j12(spark, d):
    """Both arms in one aggregate. An item that one arm lacks raises when the rows are computed."""
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct")))
    both = predictions(spark, d).groupBy("item_id").agg(side("random").alias("r"), side("patient").alias("p"))
    return both.select("item_id", checks.where_both("r", "p", F.round(F.col("r") - F.col("p"), 6)).alias("diff"))


@query("J13_traced_only", f"WITH {ITEMS} SELECT split, count(*) AS n FROM items WHERE item_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def j13(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_id"))
    return items(spark, d).join(labels, "item_id", "left_semi").groupBy("split").agg(F.count("*").alias("n"))


@query("J14_degraded_compare", f"WITH {VECS} SELECT item_id, round(list_inner_product(v, w) / sqrt(list_inner_product(w, w)), 6) AS sim FROM (SELECT item_id, v, list_transform(v, lambda x: round(x * 8) / 8.0::DOUBLE) AS w FROM vecs)")
def j14(spark, d):
    """Each vector against its coarsely rounded copy, joined one to one."""
    v = vectors(spark, d).select("item_id", "v")
    w = v.select("item_id", F.transform("v", lambda x: F.round(x * 8) / 8.0).alias("w"))
    sim = S.dot(F.col("v"), F.col("w")) / F.sqrt(S.dot(F.col("w"), F.col("w")))
    return v.join(w, "item_id").select("item_id", F.round(sim, 6).alias("sim"))


_PIXELS_ONLY = PIXELS.removeprefix(VECS)  # the vectors are there already
_NEAR = f"WITH {BEST}{_PIXELS_ONLY}, {BITS}, n AS (SELECT best.item_id, any_value(match_id) AS match_id, any_value(class) AS class, any_value(sim) AS sim, count(*) FILTER (x.on_ <> y.on_)::INT AS distance FROM best JOIN bits x ON x.item_id = best.item_id JOIN bits y ON y.item_id = match_id AND y.b = x.b GROUP BY 1)"


@query("J15_hash_of_nearest", f"{_NEAR} SELECT item_id, match_id, distance FROM n")
def j15(spark, d):
    return _nearest_hash(spark, d).select("item_id", "match_id", "distance")


def _nearest_hash(spark, d) -> DataFrame:
    """Distance of the perceptual hash to that of the nearest vector only, not to the closest hash."""
    own = hashes(spark, d)
    near = best_train(spark, d).join(own.withColumnRenamed("phash", "a"), "item_id")
    near = near.join(own.select(F.col("item_id").alias("match_id"), F.col("phash").alias("b")), "match_id")
    return near.withColumn("distance", S.hamming(F.col("a"), F.col("b")))


# ---- aggregates --------------------------------------------------------------------------------------------


@query("A1_class_counts", f"WITH {ITEMS} SELECT class, count(*) FILTER (split = 'Training') AS n_train, count(*) FILTER (split = 'Testing') AS n_test FROM items GROUP BY 1")
def a1(spark, d):
    p = items(spark, d).groupBy("class").pivot("split", ["Training", "Testing"]).count()
    return p.select("class", F.coalesce("Training", F.lit(0)).alias("n_train"), F.coalesce("Testing", F.lit(0)).alias("n_test"))


@query("A2_redundancy", f"WITH {ITEMS} SELECT coalesce(class, 'TOTAL') AS class, count(*) AS files, count(DISTINCT content_hash) AS \"unique\", count(*) - count(DISTINCT content_hash) AS surplus FROM items GROUP BY ROLLUP (class)")
def a2(spark, d):
    return dedup.redundancy(items(spark, d), "content_hash")


@query("A2_clusters")
def a2b(spark, d):
    """Files, distinct vectors and leader clusters of each class, and a TOTAL with a walk of its own over all classes (one
    task, as a walk in order is; it holds the leaders, not the rows)."""
    v = vectors(spark, d).withColumn("class", F.col("class").cast("string"))
    both = v.unionByName(v.withColumn("class", F.lit("TOTAL")))
    counts = both.groupBy("class").agg(F.count("*").alias("files"), F.countDistinct("v").alias("unique"))
    walked = cluster.leader_clusters(both, 0.4).groupBy("class").agg(F.countDistinct("leader_id").alias("clusters"))
    return counts.join(walked, "class").select("class", "files", "unique", "clusters", (F.col("files") - F.col("clusters")).alias("redundant"))


@query("A3_surplus_copies", f"WITH {ITEMS}, g AS (SELECT split, file_hash, count(*) - 1 AS e FROM items GROUP BY 1, 2) SELECT split, sum(e)::BIGINT AS surplus FROM g GROUP BY 1")
def a3(spark, d):
    return dedup.surplus_copies(items(spark, d), "file_hash", ["split"])


@query("A4_leak_table", f"{_NEAR} SELECT class, count(*) AS n, round(avg(sim), 6) AS mean_sim, count(*) FILTER (sim >= 0.4) AS near_cos, count(*) FILTER (distance <= 28) AS near_hash, count(*) FILTER (sim >= 0.4 AND distance <= 28) AS both FROM n GROUP BY 1")
def a4(spark, d):
    return similarity.leak_table(_nearest_hash(spark, d), 0.4, 28)


_PCT = (5, 25, 50, 75, 95, 99)


@query("A5_percentiles", f"WITH {BEST} " + " UNION ALL ".join(f"SELECT {p}.0::DOUBLE AS pct, round(quantile_cont(sim, {p / 100}), 6) AS value FROM best" for p in _PCT))
def a5(spark, d):
    return similarity.percentiles(best_train(spark, d), "sim", _PCT)


@query("A6_histogram", f"WITH {BEST} SELECT class, least(floor((sim - 0.2::DOUBLE) / ((0.6::DOUBLE - 0.2::DOUBLE) / 50)), 49)::INT AS bin, count(*) AS n FROM best WHERE sim BETWEEN 0.2 AND 0.6 GROUP BY 1, 2")
def a6(spark, d):
    return similarity.histogram(best_train(spark, d), "sim", 0.2, 0.6, 50)


_PIVOT = "g AS (SELECT group_id, count(*) FILTER (split = 'Training') AS n_train, count(*) FILTER (split = 'Testing') AS n_test FROM items GROUP BY 1)"


@query("A7_group_pivot", f"WITH {ITEMS}, {_PIVOT} SELECT group_id, n_train, n_test, n_train > 0 AND n_test > 0 AS crosses FROM g")
def a7(spark, d):
    return leakage.group_pivot(items(spark, d))


@query("A7_class_leak_rate", f"WITH {ITEMS}, {_PIVOT} SELECT class, count(*) AS n_test, count(*) FILTER (n_train > 0) AS n_leaked, round(count(*) FILTER (n_train > 0) / count(*), 6) AS rate FROM items JOIN g USING (group_id) WHERE split = 'Testing' GROUP BY 1")
def a7b(spark, d):
    return leakage.class_leak_rate(items(spark, d))


@query("A8_disagreement", f"WITH {BEST} SELECT class, match_class, count(*) AS n FROM best WHERE class <> match_class GROUP BY 1, 2")
def a8(spark, d):
    return leakage.disagreement(best_train(spark, d), "class", "match_class")


@query("A9_variant_counts", f"SELECT variant, count(*) AS n FROM (WITH {BEST}, w AS (" + " UNION ALL ".join(f"SELECT item_id, match_id, {i} AS variant, list_inner_product({e}, bv) AS sim FROM pairs" for i, e in _VARIANTS.items()) + ") SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, variant, match_id) = 1) WHERE sim >= 0.4 GROUP BY 1")
def a9(spark, d):
    return j10(spark, d).groupBy("variant").agg(F.count("*").alias("n"))


@query("A10_dominant_class", f"WITH {ITEMS}, c AS (SELECT source, class, count(*) AS n FROM items GROUP BY 1, 2) SELECT source AS group_id, arg_max(class, (n, class)) AS class, sum(n)::BIGINT AS n_items FROM c GROUP BY 1")
def a10(spark, d):
    return leakage.dominant_class(items(spark, d).select(F.col("source").alias("group_id"), "class"))


@query("A11_first_class", f"WITH {ITEMS} SELECT source, arg_min(class, item_id) AS class FROM items GROUP BY 1")
def a11(spark, d):
    return items(spark, d).groupBy("source").agg(F.min_by("class", "item_id").alias("class"))


@query(
    "A30_top_signatures",
    f"""WITH {ITEMS}, s AS (SELECT class, item_id IN (SELECT doc_id FROM labels) AS traced, n_chars // 500 AS signature, n_chars FROM items),
  c AS (SELECT class, traced, signature, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM s GROUP BY 1, 2, 3)
SELECT class, traced, signature, n, mean, sd FROM c QUALIFY row_number() OVER (PARTITION BY class, traced ORDER BY n DESC, signature) <= 2""",
)
def a30(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("t")).dropDuplicates(["item_id"])
    s = items(spark, d).join(labels, "item_id", "left").withColumn("traced", F.coalesce("t", F.lit(False))).withColumn("signature", F.expr("n_chars div 500"))
    c = s.groupBy("class", "traced", "signature").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("sd"))
    r = F.row_number().over(Window.partitionBy("class", "traced").orderBy(F.desc("n"), "signature"))
    return c.withColumn("r", r).where("r <= 2").drop("r")


_TOP = "arg_max({s}, (n, -{s}))"


@query(
    "A30_confound",
    f"""WITH {ITEMS}, s AS (SELECT class, item_id IN (SELECT doc_id FROM labels) AS traced, n_chars // 500 AS size, length(source) AS mark, n_chars FROM items),
  m AS (SELECT class, count(*) FILTER (traced) AS n_traced, count(*) FILTER (NOT traced) AS n_untraced, avg(n_chars) FILTER (traced) AS mt, avg(n_chars) FILTER (NOT traced) AS mu,
    stddev_pop(n_chars) FILTER (traced) AS st, stddev_pop(n_chars) FILTER (NOT traced) AS su FROM s GROUP BY 1),
  a AS (SELECT class, traced, {_TOP.format(s='size')} AS size FROM (SELECT class, traced, size, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
  b AS (SELECT class, traced, {_TOP.format(s='mark')} AS mark FROM (SELECT class, traced, mark, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
  t AS (SELECT a.class, max(size) FILTER (a.traced) AS size_t, max(size) FILTER (NOT a.traced) AS size_u, max(mark) FILTER (a.traced) AS mark_t, max(mark) FILTER (NOT a.traced) AS mark_u
    FROM a JOIN b ON a.class = b.class AND a.traced = b.traced GROUP BY 1)
SELECT class, n_traced, n_untraced, round(mt, 6) AS mean_traced, round(st, 6) AS sd_traced, round(mu, 6) AS mean_untraced, round(su, 6) AS sd_untraced,
  coalesce(size_t <> size_u OR mark_t <> mark_u, false) AS dominant_differs FROM m JOIN t USING (class)""",
)
def a30b(spark, d):
    """Per class, what sets traced items apart: two signatures' most frequent values, and mean and SD of the size."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("t")).dropDuplicates(["item_id"])
    s = items(spark, d).join(labels, "item_id", "left").select("class", F.coalesce("t", F.lit(False)).alias("traced"), F.expr("n_chars div 500").alias("size"), F.length("source").alias("mark"), "n_chars")
    x, y = F.when(F.col("traced"), F.col("n_chars")), F.when(~F.col("traced"), F.col("n_chars"))
    r = lambda c, name: F.round(c, 6).alias(name)
    m = s.groupBy("class").agg(
        F.count(x).alias("n_traced"), F.count(y).alias("n_untraced"), r(F.avg(x), "mean_traced"), r(F.stddev_pop(x), "sd_traced"), r(F.avg(y), "mean_untraced"), r(F.stddev_pop(y), "sd_untraced")
    )

    def top(signature: str) -> DataFrame:
        counts = s.groupBy("class", "traced", signature).agg(F.count("*").alias("n"))
        best = lambda side: F.max_by(F.when(side, F.col(signature)), F.when(side, F.struct("n", (-F.col(signature)).alias("o"))))
        return counts.groupBy("class").agg((best(F.col("traced")) != best(~F.col("traced"))).alias(f"{signature}_differs"))

    both = m.join(top("size"), "class").join(top("mark"), "class")
    return both.withColumn("dominant_differs", F.coalesce(F.col("size_differs") | F.col("mark_differs"), F.lit(False))).drop("size_differs", "mark_differs")


@query("A31_variant_medians", f"WITH {VECS} SELECT k AS variant, round(median(sim), 6) AS median, round(min(sim), 6) AS low FROM (SELECT k, list_inner_product(v, w) / sqrt(list_inner_product(w, w)) AS sim FROM (SELECT v, k, list_transform(v, lambda x: round(x * k) / k::DOUBLE) AS w FROM vecs, (VALUES (8), (16), (32)) t(k))) GROUP BY 1")
def a31(spark, d):
    v = vectors(spark, d).withColumn("variant", F.explode(F.array(F.lit(8), F.lit(16), F.lit(32))))
    w = v.withColumn("w", F.transform("v", lambda x: F.round(x * F.col("variant")) / F.col("variant")))
    w = w.withColumn("sim", S.dot(F.col("v"), F.col("w")) / F.sqrt(S.dot(F.col("w"), F.col("w"))))
    return w.groupBy("variant").agg(F.round(F.percentile("sim", 0.5), 6).alias("median"), F.round(F.min("sim"), 6).alias("low"))


_LADDER = (0.3, 0.35, 0.4, 0.45)


@query("A32_threshold_ladder", f"WITH {BEST} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (sim >= {t}::DOUBLE) AS n FROM best" for t in _LADDER))
def a32(spark, d):
    return similarity.threshold_ladder(best_train(spark, d), "sim", _LADDER)


@query("A36_distinct_groups", "SELECT count(DISTINCT coalesce(nullif(CASE WHEN lang = 'es' THEN '' ELSE source END, ''), doc_id::VARCHAR)) AS groups FROM documents")
def a36(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    g = F.coalesce(F.nullif(F.when(F.col("lang") == "es", "").otherwise(F.col("source")), F.lit("")), F.col("doc_id").cast("string"))
    return docs.agg(F.countDistinct(g).alias("groups"))


@query("A37_coverage", f"WITH {ITEMS} SELECT class, count(*) FILTER (item_id IN (SELECT doc_id FROM labels)) AS traced, count(*) FILTER (item_id NOT IN (SELECT doc_id FROM labels)) AS untraced FROM items GROUP BY 1")
def a37(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_id"), F.lit(1).alias("t")).dropDuplicates(["item_id"])
    t = items(spark, d).join(labels, "item_id", "left")
    return t.groupBy("class").agg(F.count("t").alias("traced"), F.count_if(F.col("t").isNull()).alias("untraced"))


# ---- order-dependent ---------------------------------------------------------------------------------------


@query("W1_first_per_split", f"WITH {ITEMS} SELECT split, content_hash, min(item_id) AS item_id FROM items GROUP BY 1, 2")
def w1(spark, d):
    return dedup.first_of_each(items(spark, d).select("split", "content_hash", "item_id"), ["split", "content_hash"])


@query("W2_first_wins", f"WITH {ITEMS} SELECT content_hash, min(item_id) AS item_id, arg_min(class, item_id) AS class FROM items GROUP BY 1")
def w2(spark, d):
    return dedup.first_of_each(items(spark, d).select("content_hash", "item_id", "class"), ["content_hash"])


_GROUPS = "grp AS (SELECT group_id, class, count(*) AS n_items FROM items GROUP BY 1, 2)"


def _groups(spark, d) -> DataFrame:
    return items(spark, d).groupBy("group_id", "class").agg(F.count("*").alias("n_items"))


@query("W3_take_until", f"WITH {ITEMS}, {_GROUPS}, c AS (SELECT *, coalesce(sum(n_items) OVER (PARTITION BY class ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM grp) SELECT group_id, class, b < 60 AS taken FROM c")
def w3(spark, d):
    return partition.take_until(_groups(spark, d), ["group_id"], F.lit(60), "class").select("group_id", "class", "taken")


@query("W4_inherit", f"WITH {ITEMS} SELECT item_id, first_value(source) OVER (PARTITION BY content_hash ORDER BY item_id) AS source FROM items")
def w4(spark, d):
    return dedup.inherit_from_first(items(spark, d).select("item_id", "content_hash", "source"), "content_hash", "source").select("item_id", "source")


_REASONS = f"""r AS (SELECT item_id, split, content_hash, row_number() OVER (PARTITION BY split, content_hash ORDER BY item_id) AS r FROM items),
  o AS (SELECT item_id, CASE WHEN r > 1 THEN 'duplicate within split' WHEN split = 'Testing' AND content_hash IN ({_SEMI.format(k='content_hash')}) THEN 'duplicate of training' WHEN item_id % 7 = 0 THEN 'near' END AS reason FROM r)"""


@query("W7_reasons", f"WITH {ITEMS}, {_REASONS} SELECT item_id, reason FROM o WHERE reason IS NOT NULL")
def w7(spark, d):
    t = items(spark, d)
    near = t.where("item_id % 7 = 0").select("item_id", F.lit("near").alias("reason"))
    return dedup.removal_reasons(t, near)


@query("O1_top_pairs", f"WITH {BEST} SELECT item_id, match_id, round(sim, 6) AS sim FROM best ORDER BY sim DESC, item_id LIMIT 8")
def o1(spark, d):
    return best_train(spark, d).orderBy(F.desc("sim"), "item_id").limit(8).select("item_id", "match_id", F.round("sim", 6).alias("sim"))


@query("O2_first_errors", f'WITH {PREDS} SELECT item_id, "true" AS truth, pred FROM preds WHERE arm = \'random\' AND seed = 0 AND correct = 0 ORDER BY item_id LIMIT 16')
def o2(spark, d):
    p = predictions(spark, d).where("arm = 'random' and seed = 0 and correct = 0")
    return p.orderBy("item_id").limit(16).select("item_id", F.col("true").alias("truth"), "pred")


@query("O3_numeric_order", f"WITH {PREDS} SELECT seed, row_number() OVER (ORDER BY seed)::INT AS place FROM (SELECT DISTINCT seed FROM preds)")
def o3(spark, d):
    seeds = predictions(spark, d).select(F.col("seed").cast("string").alias("s")).distinct()
    return seeds.select(F.col("s").cast("int").alias("seed"), F.row_number().over(Window.orderBy(F.col("s").cast("int"))).alias("place"))


@query("O4_first_sources", "SELECT DISTINCT source FROM documents ORDER BY source LIMIT 6")
def o4(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().orderBy("source").limit(6)


@query("U1_union", f"WITH {ITEMS} SELECT item_id, class FROM items WHERE split = 'Training' UNION ALL SELECT item_id, class FROM items WHERE split = 'Testing'")
def u1(spark, d):
    t = items(spark, d)
    return t.where(TRAIN).select("item_id", "class").unionByName(t.where("split = 'Testing'").select("class", "item_id"))


@query("U2_intersection", f"WITH {PREDS} SELECT item_id FROM preds WHERE correct = 0 AND arm = 'patient' GROUP BY 1 HAVING count(DISTINCT seed) = 3")
def u2(spark, d):
    p = predictions(spark, d).where("correct = 0 and arm = 'patient'")
    return p.groupBy("item_id").agg(F.countDistinct("seed").alias("n")).where("n = 3").select("item_id")


@query("U3_set_equality", f"WITH {PREDS} SELECT count(*) AS gaps FROM (SELECT item_id FROM preds WHERE correct = 0 GROUP BY 1 HAVING count(DISTINCT arm) = 1)")
def u3(spark, d):
    p = predictions(spark, d).where("correct = 0")
    gaps = checks.coverage_gaps(p.where("arm = 'random'"), p.where("arm = 'patient'"), "item_id")
    return gaps.agg(F.count("*").alias("gaps"))


@query("U4_dropped", "SELECT count(*) AS dropped FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def u4(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    return docs.subtract(labels).agg(F.count("*").alias("dropped"))


# ---- clustering and partitioning ---------------------------------------------------------------------------


@query("G1_leader_clusters")
def g1(spark, d):
    return cluster.leader_clusters(vectors(spark, d), 0.4)


@query("G2_greedy_folds")
def g2(spark, d):
    return partition.greedy_folds(_groups(spark, d), 5)


@query("G3_stratified_group_folds")
def g3(spark, d):
    """Folds of sources by their dominant class."""
    groups = leakage.dominant_class(items(spark, d).select(F.col("source").alias("group_id"), "class"))
    return partition.greedy_folds(groups.select("group_id", "class", "n_items"), 5)


@query("G4_proxy_groups")
def g4(spark, d):
    """Leader clusters as groups where there are no ids; a cluster weighs its unique items."""
    clusters = cluster.leader_clusters(vectors(spark, d), 0.35)
    groups = clusters.groupBy(F.col("leader_id").alias("group_id"), "class").agg(F.count("*").alias("n_items"))
    folds = partition.greedy_folds(groups, 5)
    return clusters.join(folds.select(F.col("group_id").alias("leader_id"), "class", "fold"), ["leader_id", "class"]).select("item_id", "class", "leader_id", "fold")


_FOLDED = f"t AS (SELECT class, {h('group_id')} % 5 AS fold, count(*) AS n FROM items WHERE class <> 'es' GROUP BY 1, 2)"


def _targets(spark, d) -> DataFrame:
    fold = (S.hash_int(F.col("group_id")) % 5).alias("fold")
    return items(spark, d).where("class <> 'es'").groupBy("class", fold).agg(F.count("*").alias("n"))


@query("G5_targets", f"WITH {ITEMS}, {_FOLDED} SELECT class, fold, n FROM t")
def g5(spark, d):
    return _targets(spark, d)


@query(
    "G6_matched_random",
    f"""WITH {ITEMS}, {_FOLDED}, b AS (SELECT class, fold, sum(n) OVER (PARTITION BY class ORDER BY fold) AS high, sum(n) OVER (PARTITION BY class ORDER BY fold) - n AS low FROM t),
  r AS (SELECT item_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('1234:' || item_id), item_id) AS r FROM items)
SELECT item_id, r.class, fold FROM r JOIN b ON r.class = b.class AND r > low AND r <= high""",
)
def g6(spark, d):
    return partition.matched_random_folds(items(spark, d).select("item_id", "class"), _targets(spark, d), "1234")


@query(
    "G7_group_holdout",
    f"""WITH {ITEMS}, {_GROUPS}, c AS (SELECT *, sum(n_items) OVER (PARTITION BY class) AS total,
  coalesce(sum(n_items) OVER (PARTITION BY class ORDER BY md5('42:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM grp)
SELECT group_id, class, n_items, b < total * 0.2::DOUBLE AS taken FROM c""",
)
def g7(spark, d):
    return partition.group_holdout(_groups(spark, d), 0.2, "42")


@query("G8_group_shuffle", f"WITH {ITEMS}, g AS (SELECT DISTINCT group_id FROM items) SELECT group_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || group_id), group_id) <= ceil(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS part FROM g")
def g8(spark, d):
    return partition.group_shuffle(items(spark, d).select("group_id").distinct(), 0.2, "42")


@query("G9_stratified", f"WITH {ITEMS} SELECT item_id, class, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5('42:' || item_id), item_id) <= round(0.2 * count(*) OVER (PARTITION BY class)) THEN 'val' ELSE 'train' END AS part FROM items")
def g9(spark, d):
    return partition.stratified(items(spark, d), 0.2, "42")


@query("G10_balanced_weights", f"WITH {ITEMS} SELECT item_id, class, round(1.0::DOUBLE / count(*) OVER (PARTITION BY class), 9) AS weight FROM items")
def g10(spark, d):
    return partition.balanced_weights(items(spark, d))


@query(
    "G10_balanced_draws",
    f"""WITH {ITEMS}, c AS (SELECT class, count(*) AS n, row_number() OVER (ORDER BY class) - 1 AS c FROM items GROUP BY 1),
  d AS (SELECT range AS draw, {h("'42:c:' || range")} % (SELECT count(*) FROM c) AS c, {h("'42:m:' || range")} AS m FROM range(500)),
  r AS (SELECT item_id, class, row_number() OVER (PARTITION BY class ORDER BY item_id) AS r FROM items)
SELECT draw, class, item_id FROM d JOIN c USING (c) JOIN r USING (class) WHERE r = m % n + 1""",
)
def g10b(spark, d):
    return partition.balanced_draws(items(spark, d), 500, "42")


@query(
    "X1_contamination",
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def x1(spark, d):
    """Documents that hold a benchmark text, at any place, also within a word."""
    docs, bench = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet")
    return contained_passages(docs, bench)
