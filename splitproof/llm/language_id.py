"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its
character n-grams, from the longest size down: the first size of which the model knows any n-gram decides.
A document's score in a language is the mean over its words; the highest wins.

The model is fitted on the words of a bounded sample of labelled documents: ``max_docs``, an equal share of each
language drawn by a hash of the id, whole texts. It holds the ``max_words`` words and, of each size, the ``max_grams``
n-grams that are most frequent in the sample (frequency is relative to the words of the language, so that no
language crowds out another), so that its broadcast is bounded at every input size. Frequencies are taken of all words
of the sample; an n-gram counts once for each place in each different word. Words and n-grams are counted in the job;
only the tables come to the driver. All documents are predicted, over their whole texts.

Defined cases: a null text or one without a letter gives ``und`` and score 0; so does every document when there
is nothing to learn from. Ties between languages go to the smaller name. Null ids are kept, never learnt from.
Repeated rows each get their prediction. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, small_batches, stage

WORD = re.compile(r"[^\W\d_]+")
SIZES = (5, 4, 3, 2, 1)
SMOOTH = 0.02
MEMO = 150_000  # words whose scores a Python worker keeps
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class BackoffModel:
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]  # one dictionary for each of SIZES
    memo: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def word_scores(self, word: str) -> tuple[float, ...]:
        """Log frequencies of a word by language, backing off to n-grams for an unseen word."""
        known = self.words.get(word)
        if known is not None:
            return known
        known = self.memo.get(word)
        if known is not None:
            return known
        marked = f"<{word}>"
        out = (0.0,) * len(self.languages)
        for size, table in zip(SIZES, self.grams, strict=True):
            found = [g for g in map(table.get, (marked[i : i + size] for i in range(len(marked) - size + 1))) if g is not None]
            if found:
                out = tuple(sum(x) / len(found) for x in zip(*found, strict=True))
                break
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        found = words_of(text)
        if not found:
            return UNKNOWN, 0.0
        total = [0.0] * len(self.languages)
        score = self.word_scores
        counts = Counter(found)
        for word, n in counts.items():
            for i, s in enumerate(score(word)):
                total[i] += n * s
        top = max(total)
        spread = [math.exp(max(-700.0, t - top)) for t in total]
        best = total.index(top)
        return self.languages[best], spread[best] / sum(spread)


def equal_share(counts: list[int], limit: int) -> int:
    """The largest number that, taken of each count or else the whole count, sums to at most ``limit``; 1 at least."""
    left = limit
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(1, share)
        left -= n
    return max([1, *counts])


def draw_by_language(rows: DataFrame, counts: dict[str, int], limit: int, seed: int) -> DataFrame:
    """(id, lang) of an equal share of each language, those with the smallest hash of the id. What a language with few
    documents leaves goes to the others. A first cut by the hash, as in bounded_draw, keeps the order small."""
    share, whole = equal_share(list(counts.values()), limit), 1 << 40
    cuts = [(lang, int(whole * min(1.0, (2.0 * share + 50) / n))) for lang, n in counts.items()]
    near = F.broadcast(rows.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(whole))
    first = rows.select("id", "lang", draw.alias("draw")).join(near, "lang").where(F.col("draw") < F.col("cut"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    return first.withColumn("place", place).where(F.col("place") <= share).select("id", "lang").distinct()


def fit(
    labelled: DataFrame, id_col: str = "doc_id", max_docs: int = 6_000, max_words: int = 80_000, max_grams: int = 30_000
) -> BackoffModel:
    """Fit on (id, text, lang); rows with a null id, text or language are passed over."""
    small_batches(labelled.sparkSession)
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    rows = usable.select(F.col(id_col).alias("id"), "text", "lang")
    # the drawn ids are at most max_docs rows (or one a language): small enough to send to every task
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    picked = rows.join(F.broadcast(draw_by_language(rows, counts, max_docs, 41)), ["id", "lang"])

    def count(batches):
        for pdf in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in by.items():
                yield pd.DataFrame({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())})

    words = stage(
        picked.select("text", "lang")
        .mapInPandas(releasing(count), "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").cast("double").alias("n")),
        "language-words",
    )
    pieces = words.select("lang", F.concat(F.lit("<"), "word", F.lit(">")).alias("w")).withColumn("size", F.explode(F.array(*[F.lit(s) for s in SIZES])))
    pieces = pieces.where(F.length("w") >= F.col("size")).select("size", "lang", "w", F.explode(F.expr("sequence(1, length(w) - size + 1)")).alias("at"))
    grams = pieces.groupBy("size", "lang", F.expr("substring(w, at, size)").alias("key")).agg(F.count("*").cast("double").alias("n"))
    counts = stage(words.select(F.lit(0).alias("size"), "lang", F.col("word").alias("key"), "n").unionByName(grams), "language-counts")
    return _model(counts, max_words, max_grams)


def _model(counts: DataFrame, max_words: int, max_grams: int) -> BackoffModel:
    """Logs of smoothed relative frequencies, by language, of the words (size 0) and n-grams with the largest share of any
    language. ``counts``: size, lang, key, n, of the bounded sample."""
    # one row for each size and language
    totals = {(r["size"], r["lang"]): r["n"] for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})
    if not languages:
        return BackoffModel([], {}, [{} for _ in SIZES])
    known = F.create_map(*[x for (size, lang), n in totals.items() for x in (F.lit(f"{size} {lang}"), F.lit(n))])
    share = F.col("n") / F.element_at(known, F.concat(F.col("size").cast("string"), F.lit(" "), "lang"))
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0.0)) for lang in languages]
    rows = counts.withColumn("share", share).groupBy("size", "key").agg(F.max("share").alias("share"), F.array(*each).alias("n"))
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("share"), "key"))
    keep = F.when(F.col("size") == 0, max_words).otherwise(max_grams)
    top = rows.withColumn("place", place).where(F.col("place") <= keep).select("size", "key", "n").toPandas()  # what is kept

    def table(size: int) -> dict[str, tuple[float, ...]]:
        part = top[top["size"] == size]
        if not len(part):
            return {}
        whole = np.array([totals.get((size, lang), 0.0) for lang in languages]) + SMOOTH * (len(part) + 1)
        logs = np.log((np.array(part["n"].tolist(), float) + SMOOTH) / whole[None, :])
        return dict(zip(part["key"], map(tuple, logs.tolist()), strict=True))

    return BackoffModel(languages, table(0), [table(size) for size in SIZES])


def identify(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score of every document; the text is the only input of a prediction."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for pdf in batches:
            out = [m.predict(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"id": pdf["id"], "lang_pred": [o[0] for o in out], "score": np.array([o[1] for o in out], float)}
            )
        m.memo.clear()

    return (
        docs.select(F.col(id_col).cast("string").alias("id"), "text")  # as text: pandas has no whole numbers with nulls
        .mapInPandas(releasing(predict), "id string, lang_pred string, score double")
        .select(F.col("id").cast("long").alias(id_col), "lang_pred", "score")
    )


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs.where(fold != 1).select("doc_id", "text", "lang"))
    held = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
