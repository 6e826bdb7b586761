"""Operators against golden figures, brute force and invariants."""

import datetime
import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitproof.functions import scalar, special
from splitproof.operators import checks, cluster, dedup, inference, metrics, partition, similarity
from splitproof.plans import evaluation, fixtures, scalars
from splitproof.sources import readers, sinks
from splitproof.streaming import monitor


def test_variance_components_golden(spark):
    """Published fold accuracies' structure: a known 2 x 2 grid by hand."""
    cells = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 0, 1, 0.8), ("a", 1, 0, 0.6), ("a", 1, 1, 0.5)], "arm string, fold int, seed int, value double")
    row = metrics.variance_components(cells, ["arm"]).first()
    within = (0.05**2 * 4) / 2  # four deviations of 0.05 on two degrees of freedom
    between = 2 * np.var([0.85, 0.55], ddof=1)
    assert row["sigma_seed"] == pytest.approx(math.sqrt(within), abs=1e-6)
    assert row["sigma_partition"] == pytest.approx(math.sqrt((between - within) / 2), abs=1e-6)


def test_class_scores_brute(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(300)]
    df = spark.createDataFrame(rows, "true string, pred string").withColumn("correct", (F.col("true") == F.col("pred")).cast("int"))
    got = {r["class"]: r for r in metrics.class_scores(df, []).collect()}
    for c in "abcd":
        tp = sum(t == p == c for t, p in rows)
        n, m = sum(t == c for t, _ in rows), sum(p == c for _, p in rows)
        assert got[c]["precision"] == pytest.approx(tp / m if m else 0)
        assert got[c]["recall"] == pytest.approx(tp / n if n else 0)


def test_auc_brute(spark):
    rng = random.Random(3)
    rows = [("x", round(rng.random(), 1), rng.randint(0, 1)) for _ in range(120)]
    got = metrics.auc(spark.createDataFrame(rows, "class string, score double, positive int")).first()["auc"]
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert got == pytest.approx(want, abs=1e-6)


def test_best_match_tiles_and_ties(spark):
    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    b[7] = b[3]
    q[0] = b[3] * 5
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, v array<double>")
    got = {r["query_id"]: r for r in similarity.best_match(frame(q), frame(b), chunk=9).collect()}
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert [got[i]["match_id"] for i in range(1, 30)] == s.argmax(1)[1:].tolist() and got[0]["match_id"] == 3


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.1, 0.95))
def test_leaders_property(seed, threshold):
    x = np.random.default_rng(seed).normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = cluster.leaders(x, threshold)
    heads = [i for i, j in enumerate(out) if i == j]
    for i, j in enumerate(out):
        earlier = [h for h in heads if h < i]
        if i != j:
            assert x[i] @ x[j] >= threshold and x[i] @ x[j] == max(x[i] @ x[h] for h in earlier)
        else:
            assert all(x[i] @ x[h] < threshold for h in earlier)
    assert all(out[j] == j for j in out)


def test_greedy_folds(spark):
    rows = [(f"g{i}", "c" if i % 3 else "d", (i * 7) % 11 + 1) for i in range(40)]
    got = partition.greedy_folds(spark.createDataFrame(rows, "group_id string, class string, n_items long"), 4).toPandas()
    assert len(got) == 40 and got.group_id.is_unique
    for _, part in got.groupby("class"):
        load = part.groupby("fold").n_items.sum()
        assert load.max() - load.min() <= part.n_items.max()
    checks.check_folds(spark.createDataFrame(got))


def test_assign_grouped_meets_target_or_raises(spark):
    groups = spark.createDataFrame([(f"g{i}", "c", 1 + (i < 3)) for i in range(10)], "group_id string, class string, n_items long")
    target = spark.createDataFrame([("c", 0, 7), ("c", 1, 6)], "class string, fold int, n long")
    got = partition.assign_grouped(groups, target).toPandas()
    assert got.groupby("fold").n_items.sum().to_dict() == {0: 7, 1: 6}
    with pytest.raises(Exception, match="composition"):
        partition.assign_grouped(groups, spark.createDataFrame([("c", 0, 3)], "class string, fold int, n long")).collect()


def test_checks_raise(spark):
    rows = spark.createDataFrame([(1, "Training", "h"), (2, "Testing", "h")], "item_id long, split string, hash string")
    with pytest.raises(checks.InvariantError):
        checks.check_boundary(rows, "hash")
    with pytest.raises(checks.InvariantError):
        checks.check_same_items(rows.where("item_id = 1"), rows)
    checks.check_unique(rows, "item_id")


def test_content_hash_reads_the_whole_text(spark, tmp_path):
    opening = "The same opening words. " * 20
    texts = [opening + "one body", opening + "another body", opening.upper() + "-- One Body!"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    by = {r["item_id"]: r["content_hash"] for r in fixtures.items(spark, str(tmp_path)).collect()}
    assert by[0] == by[2] != by[1]


def test_removal_reasons_order(spark):
    rows = [(1, "Training", "a"), (2, "Training", "a"), (3, "Testing", "a"), (4, "Testing", "b"), (5, "Testing", "b"), (6, "Testing", "c")]
    items = spark.createDataFrame(rows, "item_id long, split string, content_hash string")
    near = spark.createDataFrame([(5, "near"), (6, "near")], "item_id long, reason string")
    got = {r["item_id"]: r["reason"] for r in dedup.removal_reasons(items, near).collect()}
    assert got == {2: "duplicate within split", 3: "duplicate of training", 5: "duplicate within split", 6: "near"}


def test_distributions():
    # textbook values
    assert special.t_two_sided(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert special.t_ppf(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert special.beta_inc(2, 3, special.beta_ppf(2, 3, 0.9)) == pytest.approx(0.9)
    w, p = special.wilcoxon_exact([1, 2, 3, 4, 5])
    assert w == 0 and p == pytest.approx(2 / 32)
    assert math.isnan(special.wilcoxon_exact([0, 0])[0])


def test_numpy_bootstrap_is_reproducible(spark):
    sums = spark.createDataFrame([(i, 5 + i % 3, 10) for i in range(20)], "g int, k long, n long")
    a = inference.numpy_bootstrap(sums, 300, chunk=100).toPandas().sort_values("draw").value.to_numpy()
    b = inference.numpy_bootstrap(sums, 300, chunk=100).toPandas().sort_values("draw").value.to_numpy()
    assert (a == b).all() and len(a) == 300 and a.mean() == pytest.approx(0.595, abs=0.02)


def test_permuted_strata_equals_all_permutations(spark):
    err, inside = [0.0, 0.0, 1 / 3, 2 / 3, 1.0, 0.0, 1 / 3, 1.0], [True, False, False, True, True, False, False, False]
    items = spark.createDataFrame(list(zip(range(8), err, inside, strict=True)), "item_id int, err double, inside boolean")
    gap = lambda rows: sum(err[i] for i in rows) / 3 - sum(err[i] for i in set(range(8)) - set(rows)) / 5
    seen, every = gap((0, 3, 4)), [gap(c) for c in itertools.combinations(range(8), 3)]
    exact = sum(abs(g) >= abs(seen) - 1e-12 for g in every) / len(every)
    got = inference.permutation_p(
        inference.permuted_strata(items, 10_000), inference.observed_means(items), lambda a, b: a - b, lambda v, o: F.abs(v) >= F.abs(o) - 1e-12
    ).first()
    assert got["observed"] == pytest.approx(seen, abs=1e-6) and got["p"] == pytest.approx(exact, abs=0.02)
    none = inference.permuted_strata(items.where("not inside"), 10).agg(F.count("a").alias("a"), F.count("b").alias("b")).first()
    assert (none["a"], none["b"]) == (0, 10)


def test_permutations_take_every_item(spark, tmp_path):
    rows = [(i, i % 7, "ab"[i % 2]) for i in range(2600)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    strata = evaluation._strata(spark, str(tmp_path)).toPandas()
    assert len(strata) == 2600
    e, inside = strata["err"], strata["inside"]
    got = evaluation.i4(spark, str(tmp_path)).first()
    assert got["observed"] == pytest.approx(e[inside].mean() - e[~inside].mean(), abs=1e-6)
    assert abs(got["p"] * 10_001 - round(got["p"] * 10_001)) < 0.01 and 0 < got["p"] <= 1
    assert evaluation.i5(spark, str(tmp_path)).first()["observed"] == pytest.approx(e[inside].mean() / e[~inside].mean(), abs=1e-6)


def test_history_takes_every_event(spark, tmp_path):
    ids = [*range(0, 300, 3), *range(9_990, 10_010), 25_000, 25_001]
    rows = [(i, None if i % 5 == 4 else "ab"[i % 2], i / 8) for i in reversed(ids)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = [(run, n, v) for run in (None, "a", "b") for n, (_, v) in enumerate(sorted((i, v) for i, r, v in rows if r == run))]
    got = [tuple(r) for r in scalars.s7(spark, str(tmp_path)).select("run", "epoch", "val_loss").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_bootstrap_queries_take_10000_draws(spark, tmp_path):
    rows = [(i, i * i % 9, "ab"[i % 2]) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    p = fixtures.predictions(spark, str(tmp_path)).toPandas()
    groups = sorted(p["group_id"].unique())
    index = np.array([[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % len(groups) for i in range(len(groups))] for b in range(10_000)])
    total = lambda rows, of: rows.groupby("group_id")[of].sum().reindex(groups).to_numpy()
    p["one"] = 1
    pat, rand = p[p["arm"] == "patient"], p[p["arm"] == "random"]
    model = pat[pat["seed"] == 42]
    ratio = lambda k, n: k[index].sum(1) / n[index].sum(1)
    ends = lambda v: pytest.approx(np.percentile(v, [2.5, 97.5]).tolist(), abs=1e-6)
    d = str(tmp_path)
    assert list(evaluation.i1(spark, d).first()) == ends(ratio(total(model, "correct"), total(model, "one")))
    assert list(evaluation.i2(spark, d).first()) == ends(ratio(total(pat, "correct"), total(pat, "one")))
    diff = ratio(total(rand, "correct") - total(pat, "correct"), total(rand, "one"))
    lo, hi, p_not_above = evaluation.i3(spark, d).first()
    assert [lo, hi] == ends(diff) and p_not_above == pytest.approx((diff <= 0).mean(), abs=1e-6)


def test_temperature_recovers_scale(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 4)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    label = [int(rng.choice(4, p=q)) for q in p]
    df = spark.createDataFrame([((3 * v).tolist(), y) for v, y in zip(z, label, strict=True)], "z array<double>, label int")
    assert inference.fit_temperature(df).first()["temperature"] == pytest.approx(3.0, abs=0.3)


def test_image_functions():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 255, (32, 32)).astype(float)
    m = scalar.dct_matrix(32)
    assert np.allclose(m @ m.T, np.eye(32))
    assert scalar.perceptual_hash(x) == scalar.perceptual_hash(x * 0.5)
    blank = np.zeros((9, 9))
    assert scalar.crop_foreground(blank) is blank
    blank[4, 5] = 99
    assert scalar.crop_foreground(blank).shape == (5, 5)
    assert np.allclose(scalar.bilinear(x, 32, 32), x)
    assert len({scalar.orient(x, n).tobytes() for n in scalar.DIHEDRAL}) == 8


def test_hash_of_equal_coefficients_as_in_sql(spark, tmp_path):
    """Symmetric and mirrored images: coefficients that differ by rounding only lie on the median. One thread, as the SQL's sums change with more."""
    import duckdb

    from splitproof.plans import registry

    a = np.random.default_rng(0).integers(0, 256, (50, 8, 8))
    images = np.concatenate([a + a.transpose(0, 2, 1), a + a[:, ::-1]]).reshape(-1, 64)
    rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(images)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES["F3_phash"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["F3_phash"]).fetchall())


def _png(path, pixels):
    import struct
    import zlib

    h, w = pixels.shape
    raw = b"".join(b"\0" + bytes(r) for r in pixels.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_sources(spark, tmp_path):
    rng = np.random.default_rng(1)
    for split in ("Training", "Testing"):
        for i, c in enumerate(("glioma", "notumor")):
            _png(tmp_path / split / c / f"{i}.png", rng.integers(0, 255, (12, 10)))
    (tmp_path / "Training" / "glioma" / "notes.txt").write_text("x")
    got = readers.class_folders(spark, str(tmp_path)).toPandas()
    assert len(got) == 4 and dict(zip(got["class"], got["label"], strict=True)) == {"glioma": 0, "notumor": 1}
    meta = readers.file_metadata(spark, str(tmp_path)).toPandas()
    assert len(meta) == 4 and set(meta.height) == {12} and meta.qtable.isna().all()


def test_jpeg_signature():
    table = bytes(range(1, 65))
    body = b"\xff\xd8\xff\xdb\x00\x43\x00" + table + b"\xff\xda"
    assert readers.quant_sum(body) == sum(range(1, 17)) and readers.quant_sum(b"\x89PNG") is None


def test_json_map_collision(spark):
    ok = spark.createDataFrame([('{"a\\\\x.png": "g1", "b/y.png": "g2"}',)], "value string")
    assert {r["key"] for r in readers.json_map(ok, "value").collect()} == {"x.png", "y.png"}
    with pytest.raises(checks.InvariantError):
        readers.json_map(spark.createDataFrame([('{"a/x.png": "g1", "b/x.png": "g2"}',)], "value string"), "value")


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, "Training", "a"), (2, "Testing", "b")], "item_id long, split string, class string")
    out = str(tmp_path / "split")
    sinks.write_split(items, out)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_split(items, out)
    once = str(tmp_path / "once")
    sinks.write_once(items, once, 7)
    assert sinks.read_once(spark, once, 7).count() == 2
    with pytest.raises(ValueError, match="seed"):
        sinks.read_once(spark, once, 8)
    store = str(tmp_path / "store")
    sinks.append_results(items, store, ["item_id"], spark, False)
    sinks.append_results(items, store, ["item_id"], spark, True)
    assert spark.read.parquet(store).count() == 2
    sinks.write_summary(items.agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["n"] == 2


def test_stream_monitor(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "Training", "h1", 1), (at(1), "Training", "h1", 2), (at(5), "Testing", "h1", 3), (at(6), "Testing", "h2", 4)]
    spark.createDataFrame(rows, "ts timestamp, split string, hash string, item_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, split string, hash string, item_id long").parquet(str(tmp_path / "in"))
    for name, df in (("seen", monitor.first_seen(stream)), ("leaks", monitor.leak_events(stream))):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert {r["item_id"] for r in spark.sql("SELECT item_id FROM seen").collect()} >= {3, 4} and spark.sql("SELECT * FROM seen").count() == 3
    assert {(r["train_id"], r["test_id"]) for r in spark.sql("SELECT * FROM leaks").collect()} == {(1, 3), (2, 3)}


def test_histogram_and_early_stop(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.1), ("a", 0.5)], "class string, x double")
    assert {r["bin"]: r["n"] for r in similarity.histogram(df, "x", 0.0, 1.0, 10).collect()} == {0: 1, 9: 1, 5: 1}
    hist = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 1.0])], "run string, epoch int, val_loss double")
    row = metrics.early_stop(hist, 3).first()
    assert (row["stop_epoch"], row["best_epoch"]) == (4, 1)
    assert pd.notna(row["stop_epoch"])


def test_queries_without_sql_against_plain_versions(spark, smallest):
    from splitproof.plans import fixtures, registry

    rows = fixtures.vectors(spark, smallest).select("item_id", F.col("class").cast("string").alias("class"), "v").orderBy("item_id").collect()
    got = {r["class"]: r for r in registry.QUERIES["A2_clusters"](spark, smallest).collect()}

    def walk(part):
        heads = []
        for r in part:
            sims = [float(np.dot(r["v"], h)) for h in heads]
            if not sims or max(sims) < 0.4:
                heads.append(r["v"])
        return len(heads)

    assert set(got) == {r["class"] for r in rows} | {"TOTAL"}
    for name, r in got.items():
        part = rows if name == "TOTAL" else [x for x in rows if x["class"] == name]
        assert (r["files"], r["unique"], r["clusters"]) == (len(part), len({tuple(x["v"]) for x in part}), walk(part))

    z = fixtures.logits(spark, smallest).collect()
    zs, labels = np.array([r["z"] for r in z]), np.array([r["label"] for r in z])
    for r in registry.QUERIES["A29_calibration"](spark, smallest).collect():
        p = np.exp(zs / r["temperature"] - (zs / r["temperature"]).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top, right = p.max(1), p.argmax(1) == labels
        bins = np.ceil(top * 10)
        ece = sum((bins == b).mean() * abs(right[bins == b].mean() - top[bins == b].mean()) for b in set(bins.tolist()))
        assert r["ece"] == pytest.approx(ece, abs=1e-5) and r["nll"] == pytest.approx(-np.log(p[np.arange(len(p)), labels]).mean(), abs=1e-5)
        assert r["confident_errors"] == int(((top > 0.9) & ~right).sum())
    w = registry.QUERIES["I8_wilcoxon_p"](spark, smallest).first()
    assert w["w"] == registry.QUERIES["I8_wilcoxon"](spark, smallest).first()["w"] and 0 < w["p"] <= 1
