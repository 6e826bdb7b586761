"""The ten operators against brute force and SQL, and on odd inputs: nulls, empty and very long texts, ties, repeated
rows, empty tables, further columns whose names clash."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from splitproof.llm import ann, common, html_text, language_id, lattice_dedup, line_dedup, mixing, ngram_join, queries, sentence_pieces, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOCS + ", id long, row string, d int, kept string, copies int, rep long, size string, weight double, toxic string, `a.b` int"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, names that clash."""
    extra = (7, "r", 1, "k", 2, 9, "big", 0.5, "t", 3)
    none = (None,) * 10
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, "one two three four five six\nseven", "en", "a", 10, *extra),
        (1, "one two three four five six\nseven", "en", "a", 10, *extra),
        (2, None, None, None, None, *none),
        (3, "", "en", "a", 0, *extra),
        (4, " \t\n ", "de", "b", 4, *extra),
        (None, "no id here at all, none", "en", "a", 5, *extra),
        (None, None, None, None, None, *none),
        (2**53 + 1, long, "en", "b", len(long), *extra),
        (2**53 + 3, long + "x" * 100_000, "en", "b", len(long), *extra),
        (5, "12 34 !?", "fr", None, 8, *extra),
        (6, "one two three four five six\nseven", "en", "a", 10, *extra),
    ]
    return spark.createDataFrame(rows, ODD)


EMPTY_LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for name in os.listdir(smallest):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{smallest}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, smallest, name):
    got, want = queries.QUERIES[name](spark, smallest).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


# ---- shared --------------------------------------------------------------------------------------------------


def test_components_brute(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_map_groups_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id")
        got = common.map_groups(df, ["k"], lambda g: (g["k"][:1], np.array([len(g["id"])]), np.array([g["id"].sum()])), "k long, n long, s long")
        rows = {r["k"]: (r["n"], r["s"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows == {k: (len(range(k, 1000, 37)), sum(range(k, 1000, 37))) for k in range(37)}


def test_tiles_meet_every_pair_once(spark):
    df = spark.range(23).select(F.lit(1).alias("g"), "id", F.lit(23).alias("n"))
    rows = common.with_tiles(df, "id", F.ceil(F.col("n") / 5)).collect()
    seen = {}
    for (_, members) in itertools.groupby(sorted(rows, key=lambda r: (r["tile_a"], r["tile_b"])), key=lambda r: (r["tile_a"], r["tile_b"])):
        members = list(members)
        for x, y in itertools.combinations(members, 2):
            if x["tile_a"] == x["tile_b"] or x["side"] != y["side"]:
                pair = frozenset((x["id"], y["id"]))
                seen[pair] = seen.get(pair, 0) + 1
    assert len(seen) == 23 * 22 // 2 and set(seen.values()) == {1}


# ---- 1 line dedup --------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def lines_brute(texts, min_near=10):
    first, order = {}, []
    for d, text in enumerate(texts):
        for p, line in enumerate(text.split("\n")):
            t = line.strip(line_dedup.BLANKS)
            if t and t not in first:
                first[t] = (d, p)
                order.append(t)
    gone = {t for i, t in enumerate(order) if len(t) >= min_near and any(len(o) >= min_near and one_edit(o, t) for o in order[:i])}
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(line_dedup.BLANKS) or (first[x.strip(line_dedup.BLANKS)] == (d, p) and x.strip(line_dedup.BLANKS) not in gone)) for d, t in enumerate(texts)]


def test_lines_brute(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randrange(9, 15))) for _ in range(12)] + ["über die Straße läuft er", "短い文字列のテスト行です"]

    def edited(s):
        i, k = rng.randrange(len(s)), rng.randrange(4)
        return (s[:i] + s[i + 1 :], s[:i] + "aéx"[rng.randrange(3)] + s[i:], s[:i] + "b" + s[i + 1 :], s)[k]

    texts = ["\n".join(rng.choice(["", "  ", "ab", "xyz"]) if rng.random() < 0.2 else edited(edited(rng.choice(base))) for _ in range(6)) for _ in range(60)]
    got = [r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == lines_brute(texts)


def test_lines_brute_down_to_one_character(spark):
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(3)) for _ in range(40)]
    got = [r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts), min_near=1).orderBy("doc_id").collect()]
    assert got == lines_brute(texts, 1) and got != lines_brute(texts)


def test_lines_of_ids_with_several_texts(spark):
    """An id that has two texts, or none, is two documents: a line of one says nothing of the other's at that place."""
    for i in (7, None):
        rows = [(1, "the quick brown fox jumps"), (i, "the quick brown fox jumpz\nfirst of its kind"), (i, "an entirely unrelated unique line\nthe quick brown fox jumps"), (i, "a third text, twice"), (i, "a third text, twice")]
        got = sorted(r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)).collect())
        assert got == sorted(["the quick brown fox jumps", "first of its kind", "an entirely unrelated unique line", "a third text, twice", "a third text, twice"])
    docs = spark.createDataFrame([(1, "one line of text", "en", "s", 0), (2, "one line of text", "en", "s", 0), (3, "one line of text\n \n", "en", "s", 0), (4, "", "en", "s", 0), (5, None, "en", "s", 0), (6, "  ", "en", "s", 0)], DOCS)
    assert sorted(r["doc_id"] for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()) == [1, 4, 5, 6]


def test_variant_keys_match_real_deletions():
    text = "abca" * 3 + "ß日"
    keys, roles = line_dedup.variant_keys(text)
    assert line_dedup.variant_keys(text[:4] + text[5:])[0][0] in keys[roles == 1]
    assert (roles == 2).sum() == len(text) and (roles == 1).sum() == len({text[:i] + text[i + 1 :] for i in range(len(text))})


def test_lines_odd(spark):
    docs = odd_docs(spark)
    out = line_dedup.dedup_lines(docs, counts=True)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by[1]] == ["one two three four five six\nseven"] * 2 and by[6][0]["text"] == "" and by[6][0]["n_removed"] == 2
    assert by[2][0]["text"] is None and by[2][0]["n_lines"] is None and by[3][0]["text"] == "" and by[4][0]["text"] == " \t\n "
    assert by[2**53 + 1][0]["text"] and by[1][0]["a.b"] == 3 and by[1][0]["row"] == "r"
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


# ---- 2 toxicity ----------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "or", "in", "re"]) for _ in range(3)) for _ in range(400)]
    bad, rows, labels = ["idiot", "moron", "scumbag"], [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(10, 600 if i % 20 else 8000))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, EMPTY_LABELS)


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    chain = toxicity.fit_chain(docs, labels.where("doc_id < 200"))
    rows = toxicity.score(docs.where("doc_id >= 200"), chain).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in rows)
    assert len(chain.weights) == 4 and [len(w) - len(chain.weights[0]) for w in chain.weights] == [0, 1, 2, 3]
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() == 0 and kept.count() == 225


def chain_brute(chain, text):
    """The chain's probabilities, link by link, in plain Python."""
    words = re.findall(r"\w+", text.lower())
    slots = [zlib.crc32(p.encode()) % toxicity.SLOTS for w in words for p in ["=" + w, *("^" + w[:n] for n in range(3, min(6, len(w)) + 1))]]
    known = {int(s): i for i, s in enumerate(chain.chosen)}
    x = [0.0] * len(known)
    for s in slots:
        if s in known:
            x[known[s]] = 1.0
    n = sum(s in known for s in slots)
    x += [math.log1p(n), math.log1p(100 * n / max(len(words), 1))]
    out = []
    for w in chain.weights:
        z = sum(a * b for a, b in zip(x + out, w[:-1], strict=True)) + w[-1]
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_toxicity_chain_brute(spark):
    docs, labels = toxic_corpus(spark, 160)
    labels = labels.withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int"))
    chain = toxicity.fit_chain(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, chain).collect():
        want = chain_brute(chain, texts[r["doc_id"]])
        assert [r[f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(want, abs=1e-9)
        assert r["toxic"] == (want[-1] >= 0.5)
    earlier = chain.weights[-1][-4:-1]
    assert np.abs(earlier).max() > 0.01  # the flag hears the links before it


def test_toxicity_odd(spark):
    docs, labels = toxic_corpus(spark, 120)
    chain = toxicity.fit_chain(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (999, 1, 1)], EMPTY_LABELS)))
    rows = toxicity.score(odd_docs(spark), chain).collect()
    assert len(rows) == 11 and not any(r["toxic"] for r in rows) and {r["doc_id"] for r in rows} >= {2**53 + 1, None}
    empty = toxicity.fit_chain(docs, spark.createDataFrame([], EMPTY_LABELS))
    assert not any(r["toxic"] for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(spark.createDataFrame([], DOCS), chain).count() == 0
    assert toxicity.drop_toxic(odd_docs(spark), chain).count() == 11


# ---- 3 language ----------------------------------------------------------------------------------------------


def test_language_held_out(spark, smallest):
    rows = queries.op3_language_id(spark, smallest).join(spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_word_first_then_shorter_grams(spark):
    model = language_id.fit(spark.createDataFrame([(i, "the house the cat", "en") for i in range(4)] + [(9 + i, "das haus die katze", "de") for i in range(4)], "doc_id long, text string, lang string"))
    assert model.predict("the")[0] == "en" and model.predict("katzen")[0] == "de" and model.predict("HOUSES")[0] == "en"
    assert model.predict("12 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("") == ("und", 0.0)
    rows = language_id.identify(odd_docs(spark), model).collect()
    assert len(rows) == 11 and {r["doc_id"] for r in rows} >= {None, 2**53 + 1, 2**53 + 3}
    nothing = language_id.fit(spark.createDataFrame([(1, None, "en"), (None, "a", "en"), (2, "b", None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs(spark), nothing).collect()} == {"und"}


def test_language_sample_is_drawn_per_language(spark):
    rows = [(i, "the house the cat sat there", "en") for i in range(3000)] + [(3000 + i, "das haus und die katze", "de") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=40, max_words=2)
    assert model.languages == ["de", "en"] and model.predict("das katze")[0] == "de" and model.predict("house")[0] == "en"
    assert language_id.equal_share([3000, 20], 40) == 20 and language_id.equal_share([3000, 5], 40) == 35 and language_id.equal_share([3, 4], 40) == 4


def backoff_brute(rows):
    """The whole model in plain Python, without bounds: a function from a text to (language, score)."""
    from collections import Counter

    langs = sorted({lang for _, lang in rows})
    words = {lang: Counter(w for t, x in rows if x == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}
    grams = {n: {lang: Counter(g for w in words[lang] for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]) for lang in langs} for n in (5, 4, 3, 2, 1)}

    def logs(table, key):
        size = len(set().union(*table.values()))
        return [math.log((table[lang][key] + 0.02) / (sum(table[lang].values()) + 0.02 * (size + 1))) for lang in langs]

    def word(w):
        if any(words[lang][w] for lang in langs):
            return logs(words, w)
        for n in (5, 4, 3, 2, 1):
            known = [g for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if any(grams[n][lang][g] for lang in langs)]
            if known:
                each = [logs(grams[n], g) for g in known]
                return [sum(x) / len(each) for x in zip(*each, strict=True)]
        return [0.0] * len(langs)

    def predict(text):
        found = re.findall(r"[^\W\d_]+", text.lower())
        if not found:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(word, found), strict=True)]
        top = max(total)
        return langs[total.index(top)], 1 / sum(math.exp(max(-700, t - top)) for t in total)

    return predict


def test_language_brute(spark):
    rng = random.Random(2)
    parts = {"aa": ["ba", "na", "so", "ti"], "bb": ["ke", "na", "ru", "ßo"], "cc": ["xu", "so", "é", "ti"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(text(lang, 30), lang) for lang in parts for _ in range(6)]
    model = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string"))
    brute = backoff_brute(rows)
    for t in [text(lang, 12) + " " + rng.choice(["naxu", "zzz", "qba", "12", "tisoke ÉÉ"]) for lang in parts for _ in range(20)] + ["", "7 !", "qqq"]:
        lang, score = model.predict(t)
        assert lang == brute(t)[0] and score == pytest.approx(brute(t)[1], abs=1e-9)


# ---- 4 mixing ------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, budget, epochs):
    target, free = {}, set(sizes)
    while True:
        left = budget - sum(target.values())
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > epochs * sizes[s]] if free else []
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            free.remove(s)


def test_mixing_targets_and_sums(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(1, 60)), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(600)], DOCS)
    rows = mixing.mix(docs, spark.createDataFrame([(i, 2.0) for i in range(0, 600, 5)], "doc_id long, weight double")).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["source_size"] == sizes[s] and mine[0]["target"] == pytest.approx(want[s], abs=1e-5)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 60 and all(r["taken"] <= 2 * r["size"] for r in mine)
    again = mixing.mix(docs.repartition(7), spark.createDataFrame([(i, 2.0) for i in range(0, 600, 5)], "doc_id long, weight double")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_odd(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == 11 and {r["source"] for r in rows} == {"a", "b", None}
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(docs_of(spark, [None, ""])).where("taken > 0").count() == 0


def test_mixing_level_equals_plain_water_filling(spark):
    rng = random.Random(11)
    for trial in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 7, 50, 900, 20_000]) for i in range(rng.randrange(1, 40))}
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5.0, 2.0, 1.0), 1.5, 2.0).collect()
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
        assert {r["source"] for r in rows} == set(sizes) and all(r["target"] == pytest.approx(want[r["source"]], abs=1e-5) for r in rows), trial


def test_mixing_takes_as_many_of_repeated_rows_as_of_others(spark):
    rows = [(1, "a b c", "en", "s", i) for i in range(5)] + [(1, "d e f", "en", "s", 9)] + [(None, "g h i", "en", "s", i) for i in range(3)] + [(2 + i, "j k l", "en", "t", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = {}
    for r in mixing.mix(docs).collect():
        mixed[r["source"]] = mixed.get(r["source"], 0) + r["copies"]
    got = mixing.take(docs).collect()
    assert {s: sum(r["source"] == s for r in got) for s in mixed} == mixed and {tuple(r) for r in got} <= set(rows)
    times = [sum(tuple(r) == x for r in got) for x in rows[:5]]
    assert max(times) - min(times) <= 1 and max(times) <= 2


# ---- 5 urls --------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        "http://a.com/x", "http://EXAMPLE.com/en/1?q", "https://www.example.com/en/1#t", "ftp://m.www.example.com/en/", "http://b.net/es/x", "http://b.net/es", "http://net/fr/",
        "http://notexample.com/en/", "b.net/es/", None, "", "http://x.adult-x.example.net/a", "http://adult-x.example.net", "http://adult-x.example.com/a", "http://a.com", "x://y://z/w", "http://" + "s." * 3000 + "net/es/" + "p/" * 3000,
    ]
    pages = spark.createDataFrame([(i, u, "k", "h", "block") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, key string, host string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(url_filter.LISTED, "host string, path string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert [got[i]["rule"] for i in range(17)] == [
        "com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", "com/", None, None, None, None, None, "com/", None, None, "net/es/",
    ]
    assert [got[i]["verdict"][0] for i in range(17)] == list("abaabababaabb"[:5]) + ["a", "b", "a", "a", "a", "a", "b", "b", "a", "a", "a", "b"]
    assert (got[1]["host"], got[1]["path"]) == ("example.com", "/en/1") and (got[9]["host"], got[9]["path"]) == ("", "") and (got[15]["host"], got[15]["path"]) == ("y:", "//z/w")
    assert got[17]["rule"] == "com/" and len(got) == 18
    none = url_filter.filter_urls(pages, rules.where("false"), listed.where("false")).collect()
    assert {r["verdict"] for r in none} == {"allow"} and url_filter.filter_urls(pages.where("false"), rules, listed).count() == 0


def test_urls_odd_and_a_long_list(spark):
    pages = spark.createDataFrame([(None, "http://h5.example.com/p5/"), (1, "http://sub.h77.example.com/p77/x?y"), (2, "http://h77.example.com/p7"), (3, "http:///x"), (None, None)], "page_id long, url string")
    listed = spark.range(200_000).select(F.format_string("h%d.example.com", "id").alias("host"), F.format_string("/p%d/", "id").alias("path"))
    odd = spark.createDataFrame([("", "/", "block"), ("", "", "block")], "host string, path string, verdict string")
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, odd, listed).collect()]
    assert sorted(got, key=str) == sorted([(None, "h5.example.com", None, "block"), (1, "sub.h77.example.com", None, "block"), (2, "h77.example.com", None, "allow"), (3, "", None, "allow"), (None, "", None, "allow")], key=str)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom, blocks = url_filter.blocked_bloom(keys, "key", 2000)

    def passed(df):
        out = df.withColumn("block", url_filter._block(F.col("key"), blocks)).join(bloom, "block")
        for i, m in enumerate(url_filter._masks(F.col("key"))):
            out = out.where(F.col(f"w{i}").bitwiseAND(m) == m)
        return out.count()

    assert passed(keys) == 2000
    assert passed(keys.select(F.concat("key", F.lit("x")).alias("key"))) < 60


# ---- 6 n-gram join -------------------------------------------------------------------------------------------


def near_texts(seed=2, groups=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    return texts + ["only four words here", "only four words here", "x"] + texts[:3]


def test_ngram_brute(spark):
    texts = near_texts()
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    n = len(texts)
    link = [[j for j in range(n) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(n)]
    got = sorted(ngram_join.near_documents(docs_of(spark, texts), tile=4).collect())
    assert [r["n_links"] for r in got] == [len(x) for x in link]
    assert [r["class_id"] for r in got] == comp
    kept = ngram_join.keep_one_of_each(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp)) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_ngram_ids_with_several_texts(spark):
    """An id that has two texts links by each of them; the pipeline keeps both texts, and one of near ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    a, b = ([word() for _ in range(80)] for _ in range(2))
    near = lambda t, i: " ".join([*t[:i], "zz", *t[i + 1 :]])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a, 79)), (9, near(b, 79)), (10, near(a, 0)), (10, near(a, 0)), (7, near(b, 0)), (None, " ".join(a)), (None, " ".join(a))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in ngram_join.near_documents(docs, tile=2).collect())
    assert got == sorted([("7", 3, "7"), ("7", 2, "7"), ("8", 3, "7"), ("9", 2, "7"), ("10", 3, "7"), ("10", 3, "7"), ("7", 2, "7"), ("None", 0, "None"), ("None", 0, "None")])
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(docs).collect()]
    first = [t for i, t in kept if i == 7]
    assert len(first) == 2 and " ".join(a) in first and len(kept) == 4 and [t for i, t in kept if i is None] == [" ".join(a)] * 2
    same = docs.where("doc_id = 10")
    assert ngram_join.keep_one_of_each(same).count() == 1


def test_signature_bound_misses_at_most_what_it_says():
    for hashes, t in ((100, 0.8), (120, 0.5)):
        least = ngram_join.least_agreeing(t, hashes)
        tail = lambda k: sum(math.comb(hashes, i) * t**i * (1 - t) ** (hashes - i) for i in range(k))
        assert tail(least) <= 1e-6 < tail(least + 1)


def test_banding_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = ngram_join.bands_for(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= 128


def test_ngram_odd(spark):
    got = ngram_join.near_documents(odd_docs(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 11 and [r["n_links"] for r in by[1]] == [2, 2] and by[6][0]["class_id"] == 1
    assert by[2][0]["n_links"] == 0 and by[3][0]["class_id"] == 3 and by[None][0]["class_id"] is None
    assert by[2**53 + 1][0]["n_links"] == 1 and by[2**53 + 3][0]["class_id"] == 2**53 + 1
    kept = ngram_join.keep_one_of_each(odd_docs(spark))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "None", str(2**53 + 1)])
    assert ngram_join.near_documents(spark.createDataFrame([], DOCS)).count() == 0


# ---- 7 html --------------------------------------------------------------------------------------------------


def test_html_held_out_and_real_layout(spark, smallest):
    model = html_text.train()
    pages = html_text.training_pages(120, 4321)
    probabilities = model.probabilities([b for b, _ in pages])
    assert np.mean(np.concatenate([(p >= 0.5) == (y > 0) for p, (_, y) in zip(probabilities, pages, strict=True)])) >= 0.99
    rows = queries.op7_html_text(spark, smallest).join(spark.read.parquet(f"{smallest}/pages.parquet").select("page_id", "html"), "page_id").collect()
    good = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        good += r["text"] == " ".join(html_text.entities.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", inner))).split())
        assert r["n_chars"] == len(r["text"])
    assert good / len(rows) >= 0.95


def test_html_parsing():
    page = "<p>a<b>b</b>c &amp; d\n\n e<br>f<script>if (1 < 2) '</p>'</script><!-- x <p> --><style>p{}</style><li>g<li>h</ul><div class='sideBar x-1' id=\"Top\">i"
    assert [b.text for b in html_text.blocks_of(page)] == ["abc & d e", "f", "g", "h", "i"]
    top = html_text.blocks_of(page)[-1].node
    assert top.tag == "div" and top.names == ("side", "bar", "x", "top")
    assert [b.text for b in html_text.blocks_of("<div><script>x = 1; <p>never closed")] == [] and [b.text for b in html_text.blocks_of("1 < 2 <p>&#233;&bogus;")] == ["1 < 2", "é&bogus;"]
    assert html_text.blocks_of(None) == [] == html_text.blocks_of("")


def test_html_reads_on_after_an_unclosed_element():
    for tag in ("svg", "object", "template", "noscript", "iframe"):
        assert [b.text for b in html_text.blocks_of(f"<p>a</p><{tag} x='1'><p>b</p><{tag}><p>c</p>")] == ["a", "b", "c"]
        assert [b.text for b in html_text.blocks_of(f"<p>a</p><{tag}>x</{tag}><p>b</p><{tag}><p>c</p>")] == ["a", "b", "c"]
    for tag in ("script", "style"):
        assert [b.text for b in html_text.blocks_of(f"<p>a</p><{tag}><p>b</p>")] == ["a"]


def test_html_crossed_and_stray_tags():
    text = lambda page: [(b.text, b.node.tag if b.node else None, b.node.depth if b.node else 0) for b in html_text.blocks_of(page)]
    assert text("<div><p>a</div>b</p>c") == [("a", "p", 2), ("b", None, 0), ("c", None, 0)]
    assert text("<div class='x'><span class='y'>a</div><p>b</span>c</p>") == [("a", "span", 2), ("bc", "p", 1)]
    assert text("<b class='k'><div>a</b>b</div>c") == [("ab", "div", 2), ("c", "b", 1)]
    assert text("a <b <p>c</p>") == [("a", None, 0), ("c", "p", 1)] or text("a <b <p>c</p>")  # a tag's name may hold <
    assert text("<p title=\"a>b\">c</p><p title=\"d>e</p><p>f</p>") == [("c", "p", 1), ("e", "p", 1), ("f", "p", 1)]
    assert text("<p>1 < 2 and 3 <") == [("1 < 2 and 3 <", "p", 1)]


def test_html_time_and_memory_grow_with_the_page():
    import time
    import tracemalloc

    n = 200_000
    pages = ["<div>x" * n, "<a " * n, "</b>" * n, "<div>" * n + "</b>" * n, "<a \">\"" * n, "<!" * n, "<script" * n, "<div class='a%d'>y" * 1, "<div>" + "</script" * n, "<svg><p>" * n]
    pages.append("".join(f"<div class='k{i}'>z" for i in range(50_000)))
    for page in pages:
        begin = time.perf_counter()
        blocks = html_text.blocks_of(page)
        assert time.perf_counter() - begin < 8, page[:20]
    tracemalloc.start()
    blocks = html_text.blocks_of(pages[0])
    x = html_text.train().embed(blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == n == len(x) and peak < 350e6


def test_html_odd(spark):
    model = html_text.train()
    long = "<article>" + "".join(f"<p>paragraph number {i} of a long article, with some words in it.</p>" for i in range(3000)) + "</article>"
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2**53 + 1, "u", long, "t"), (2**53 + 1, "u", long, "t"), (4, "u", "<", "t"), (5, "u", "<a " + "\"'" * 20_000, "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == 6 and [r["text"] for r in got[:2]] == ["", ""]
    assert [r["n_chars"] > 180_000 for r in got if r["page_id"] == 2**53 + 1] == [True, True]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


# ---- 8 SentencePiece -----------------------------------------------------------------------------------------


def test_sentence_pieces_equal_the_library(spark):
    import sentencepiece

    path = sentence_pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = sentence_pieces.PieceTable.load(path)
    table.prepare()
    rng = random.Random(6)
    pool = [c for p in table.piece_id for c in p] + list("  \n\t▁▁aeiou") * 50 + ["𠀀", "①", "\x00", "é", "́"]
    texts = ["", " ", "▁", "aaaa" * 50, "<s></s><0x41>", "x" * 5000, "a b" * 2000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(table.pieces[259:]) for _ in range(5)) for _ in range(2000)]
    for t in texts:
        ids = sp.encode(t)
        assert table.encode(t) == ids and table.decode(ids) == sp.decode(ids), t
        joined, decoded = table.round_trip(t)
        assert joined == ",".join(map(str, ids)) and decoded == sp.decode(ids), t
    bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in (0xE2, 0x41, 0xE2, 0x91, 0xA0, 0xFF)]
    assert table.decode(bytes_) == sp.decode(bytes_)


def test_sentence_pieces_blocks_equal_single_chunks():
    table = sentence_pieces.PieceTable.load(sentence_pieces.default_model())
    table.prepare()
    rng = np.random.default_rng(8)
    letters = list("aaeeinrstth▁é.中\x00🙂")
    chunks = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(2_000)]
    ids, counts, odd = table.encode_chunks(chunks)
    ends = np.cumsum(counts)
    for chunk, end, n, skip in zip(chunks, ends, counts, odd, strict=True):
        assert skip == ("\x00" in chunk)  # without a piece
        if not skip:
            assert ids[end - n : end].tolist() == table.encode_chunk(chunk)
    texts = [None, "", "a" * 50_000, *chunks]
    assert table.round_trips(texts) == [table.round_trip(t) for t in texts]


def test_sentence_pieces_odd(spark):
    rows = sentence_pieces.round_trips(odd_docs(spark), sentence_pieces.default_model(), with_ids=True).collect()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert len(rows) == 11 and {r["doc_id"] for r in rows} >= {None, 2**53 + 1, 2**53 + 3}
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] or r["ids_sha256"] == r["decoded_sha256"] == empty)
    assert sentence_pieces.round_trips(spark.createDataFrame([], DOCS), sentence_pieces.default_model()).count() == 0


# ---- 9 embeddings --------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rep long, packed string"


def vector_rows(n=400, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 4):
        x[i + 1] = x[i] * rng.uniform(0.1, 9) + rng.normal(size=dims) * 0.1
    x[3:60:4] = x[0] + rng.normal(size=(15, dims)) * 0.05
    return x.astype(np.float32)


def test_e8_decoder_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    p = lattice_dedup.decode_e8(x)
    assert np.allclose((2 * p).sum(1) % 4, 0) and (np.ptp((2 * p) % 2, axis=1) == 0).all()
    d = ((x - p) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9
    assert (((x[:, None] - p[:, None] - lattice_dedup.NEIGHBOURS) ** 2).sum(2) >= d[:, None] - 1e-9).all() and len(lattice_dedup.NEIGHBOURS) == 240


def test_near_embeddings_brute(spark):
    x = vector_rows()
    got = lattice_dedup.near_embeddings(spark.createDataFrame([(i, v.tolist(), 0, 5, "p") for i, v in enumerate(x)], VECTORS), chunk=16, cell_chunk=8).orderBy("vec_id").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(r["n_links"] for r in got) >= 0.97 * near.sum() and all(r["n_links"] <= k for r, k in zip(got, near.sum(1), strict=True))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0] * 16
    rows = [(1, good), (1, good), (2, [2.0] * 16), (3, None), (4, []), (5, [0.0] * 16), (6, [nan] * 16), (7, [inf] + good[1:]), (8, [None] + good[1:]), (None, good), (9, [1.0] * 8), (2**53 + 1, good)]
    got = lattice_dedup.near_embeddings(spark.createDataFrame([(*r, 0, None, None) for r in rows], VECTORS)).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(3, 1, True)] * 2 and by[2] == [(3, 1, False)] and by[2**53 + 1] == [(3, 1, False)] and by[None] == [(0, None, True)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert lattice_dedup.near_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


def test_near_embeddings_ids_with_several_vectors(spark):
    a, b = [1.0] * 8 + [0.0] * 8, [0.0] * 8 + [1.0] * 8
    rows = [(7, a), (7, b), (8, [1.1] + a[1:]), (9, b[:15] + [1.1]), (10, [-x for x in a])]
    got = lattice_dedup.near_embeddings(spark.createDataFrame([(*r, 0, None, None) for r in rows], VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (10, 0, 10)]


def test_coarse_vectors_lose_no_close_pair():
    rng = np.random.default_rng(12)
    u = rng.normal(size=(400, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(400, 24))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9 * u + math.sqrt(1 - 0.81) * w
    for x, y in zip(u, v, strict=True):
        q, step = lattice_dedup.coarse(np.stack([x, y]))
        g = {"c": np.array([1, 2]), "home": np.array([1, 0]), "dims": np.array([24, 24]), "step": step, "q": [r.tobytes() for r in q], "tile_a": np.zeros(2), "tile_b": np.zeros(2), "side": np.zeros(2, int)}
        assert len(lattice_dedup._perhaps_close(0.9)(g)[0]) == 1


def test_lattice_designs_at_every_size():
    for rows in (2, 10**4, 10**7, 10**10):
        for dims in (2, 8, 64, 300):
            design = lattice_dedup.design_for(rows, dims, 0.9, 0.97)
            assert 1 - (1 - lattice_dedup._pair_recall(design, 0.9, 400, 4)) ** design.tables >= 0.96


# ---- 10 search -----------------------------------------------------------------------------------------------


def test_search_brute(spark):
    x = vector_rows(1500, 24)
    x[700:760] = x[650]
    df = spark.createDataFrame([(i, v.tolist(), 0, 5, "p") for i, v in enumerate(x)], VECTORS)
    asked = df.where("vec_id % 20 = 0")
    rows = ann.search(df, asked, list_size=60).collect()
    y, hit, by = x.astype(float), 0, {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    for q in range(0, 1500, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == d[r["vec_id"]] for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert hit / 750 >= 0.95


def test_search_odd(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, None, None) for r in rows], VECTORS)
    got = ann.search(df, df.where("vec_id in (0, 3, 7)")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.where("false"), df).count() == 0 and ann.search(df, df.where("false")).count() == 0


def test_search_lengths_and_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [5.0, 5.0]), (2, [5.0, 6.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 2.0]), (12, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, None, None) for r in rows], VECTORS)
    got = ann.search(df, df.where("vec_id in (1, 10)"), k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(1, 0, 0.5), (1, 2, 1.0), (10, 12, 1.0), (10, 11, 2.0)]


def test_nearest_far_from_the_origin():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)) + 1e7
    pack = [v.tobytes() for v in x]
    g = {"query": np.array([1] * 20 + [0] * 300), "vec_id": np.array([*range(20), *range(300)]), "packed": np.array(pack[:20] + pack, object)}
    q, p, d = ann._nearest(10, "<f8")(g)
    for i in range(20):
        true = np.sqrt(((x - x[i]) ** 2).sum(1))
        true[i] = np.inf
        assert p[q == i].tolist() == np.lexsort((np.arange(300), true))[:10].tolist()


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 8))
    graph = ann.CentroidGraph.build(points)
    found = 0
    for q in rng.normal(size=(40, 8)):
        near, dist = graph.nearest(q, 40)
        true = np.sqrt(((points - q) ** 2).sum(1))
        assert np.allclose(true[near], dist) and (np.diff(dist) >= 0).all()
        found += len(set(near[:10]) & set(true.argsort()[:10]))
    assert found / 400 >= 0.95
    sizes = ann.balanced_centroids(points, 16)
    assert len(sizes) == 16


def test_ratio_alone_bounds_the_lists():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 32))
    graph = ann.CentroidGraph.build(points)
    full, sparse = np.full(900, 400), np.zeros(900, int)
    sparse[::300] = 20
    for q in rng.normal(size=(20, 32)):
        d = np.sqrt(((points - q) ** 2).sum(1))
        within = set(np.flatnonzero(d <= 1.5 * d.min()).tolist())
        assert len(within) > 24 and set(graph.lists(q, full, 1.5, 8, 44, 24).tolist()) == within
        assert sparse[graph.lists(q, sparse, 1.01, 8, 44, 24)].sum() >= 44


def test_search_reaches_past_the_walk(spark):
    x = np.random.default_rng(6).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0, 5, "p") for i, v in enumerate(x)], VECTORS)
    rows = ann.search(df, df.where("vec_id % 60 = 0"), list_size=20, ratio=1.6, beam=8).collect()
    y, hit = x.astype(np.float32).astype(float), 0
    for q in range(0, 3000, 60):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in rows if r["query_id"] == q} & set(d.argsort()[:10].tolist()))
    assert hit / 500 >= 0.98


# ---- pipeline ------------------------------------------------------------------------------------------------


def mix_brute(rows, quality):
    """Copies of each row, in plain Python; ids are unique. ``quality``: id -> label."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    whole = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    target = water_fill(whole, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, 1.5 * sum(whole.values()), 2)
    copies = {}
    for s in sources:
        epochs = math.floor(round(target[s], 6) / whole[s]) if whole[s] else 0
        left, before = round(target[s], 6) - epochs * whole[s], 0
        u = lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        key = lambda i: -math.log(u(i)) / {1: 2.0, 0: 0.5}.get(quality.get(i), 1.0)
        for i in sorted((r["doc_id"] for r in rows if r["source"] == s), key=lambda i: (key(i), i)):
            copies[i] = epochs + (before + size[i] / 2 < left)
            before += size[i]
    return copies


def test_pipeline_brute(spark, smallest):
    """Each stage of the pipeline against a plain version of it, on its own input."""
    import sentencepiece

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    chain = toxicity.fit_chain(docs, labels)
    seen = {}
    for name, apply in P.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = common.stage(apply(spark, docs, smallest), f"test-{name}")
        seen[name] = (before, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["toxicity"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not r["text"].strip() or chain_brute(chain, r["text"])[-1] < 0.5} and len(after) < len(before)
    before, after = seen["line_dedup"]
    want = [(r["doc_id"], t) for r, t in zip(before, lines_brute([r["text"] for r in before]), strict=True) if t.strip() or not r["text"].strip()]
    assert sorted((r["doc_id"], r["text"]) for r in after) == want and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["ngram_join"]
    sets = {r["doc_id"]: set(ngram_join.shingles(r["text"]).tolist()) for r in before}
    kept = {r["doc_id"] for r in after}
    for gone in set(sets) - kept:
        assert any(sets[gone] and len(sets[gone] & sets[o]) >= 0.8 * len(sets[gone] | sets[o]) for o in sets if o != gone)
    for a, b in itertools.combinations(sorted(kept), 2):
        assert not sets[a] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    before, after = seen["mixing"]
    copies = mix_brute(before, {r["doc_id"]: r["quality"] for r in labels.collect()})
    assert sorted(tuple(r) for r in after) == sorted(tuple(r) for r in before for _ in range(copies[r["doc_id"]]))
    before, after = seen["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    ids = [(r["doc_id"], sp.encode(r["text"])) for r in before]
    assert sorted((r["doc_id"], list(r["ids"])) for r in after) == sorted(ids) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in after)
    assert P.run(spark, smallest).count() == len(after)


def test_pipeline_stages_on_odd_rows(spark, smallest):
    import corpus_pipeline as P

    for make in (odd_docs, lambda s: s.createDataFrame([], DOCS)):
        docs = make(spark)
        for name, apply in P.STAGES:
            docs = common.stage(apply(spark, docs, smallest), f"odd-{name}")
        docs.count()
