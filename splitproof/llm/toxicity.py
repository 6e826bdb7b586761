"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: the model of each takes the text's features and the probabilities
of the categories before it. For training, those probabilities are out-of-fold predictions, so that a later model
sees them as they will be on unseen texts. The last category is the toxicity flag: a document is toxic by the last
link's probability. Features are the presence of words and word beginnings (3 to 6 letters) hashed to 2^20 slots; only
slots whose share differs between toxic and clean training texts beyond chance (``surprise`` standard errors, ``lift``
times the share) are used, so that a long text doesn't gather noise, and of these at most ``max_features``.

The models are fitted on a bounded sample of labelled rows: at most ``per_class`` toxic and clean ones, drawn by a
hash of the id, whole texts. Every document is scored over its whole text.

The chain of CATEGORIES: ``low_quality`` (the quality label is 0), ``repeated`` (toxic, and telling terms occur at least as
often as in the median toxic text) and ``dense`` (the same for their share of the words), which grade the flag where labels
hold no grades, then ``toxic``.

Defined cases: a null or empty text has no features and gets the chain's probabilities of an empty text, and is
never flagged. Without labelled rows of both classes nothing is flagged. Null ids are scored, never learnt from.
Contradicting labels of one id count as toxic, and as of low quality; no quality label counts as good. Repeated rows are
each scored; of an id with several texts one is learnt from. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_draw, releasing, small_batches

WORD = re.compile(r"\w+")
SLOTS = 1 << 20
CATEGORIES = ("low_quality", "repeated", "dense", "toxic")
FOLDS = 5
MEMO = 60_000
_memo: dict[str, tuple[int, ...]] = {}


def _slots(word: str) -> tuple[int, ...]:
    known = _memo.get(word)
    if known is None:
        parts = [f"={word}", *(f"^{word[:n]}" for n in range(3, min(6, len(word)) + 1))]
        known = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts)
        if len(_memo) >= MEMO:
            _memo.clear()
        _memo[word] = known
    return known


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(slots, their counts, number of words) of a whole text."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32), 0
    slots, counts = np.unique(np.fromiter((s for w in words for s in _slots(w)), np.int32), return_counts=True)
    return slots, counts.astype(np.int32), len(words)


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton's method from ``start``."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    if len(np.unique(y)) < 2:
        w[:] = 0.0
        w[-1] = 8.0 if len(y) and y[0] else -8.0
        return w
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class ToxicityChain:
    categories: tuple[str, ...]
    chosen: np.ndarray  # slots in use, ascending
    weights: list[np.ndarray]  # of each category's model; empty without training data

    def matrix(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Presence of the chosen slots, and how many telling terms there are, in all and to a hundred words."""
        x = np.zeros((len(rows), len(self.chosen) + 2))
        for i, (slots, counts, words) in enumerate(rows):
            at = np.searchsorted(self.chosen, slots)
            at[at == len(self.chosen)] = 0
            hit = self.chosen[at] == slots if len(self.chosen) else np.zeros(len(slots), bool)
            x[i, at[hit]] = 1.0
            n = counts[hit].sum()
            x[i, -2], x[i, -1] = np.log1p(n), np.log1p(100.0 * n / max(words, 1))
        return x

    def predict(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(rows), len(self.categories)))
        x = self.matrix(rows)
        out = np.zeros((len(rows), 0))
        for w in self.weights:  # of the features, the links before, the intercept
            z = x @ w[: x.shape[1]] + out @ w[x.shape[1] : -1] + w[-1]
            out = np.hstack([out, (1 / (1 + np.exp(-np.clip(z, -30, 30))))[:, None]])
        return out

    @classmethod
    def fit(
        cls,
        rows: list[tuple[np.ndarray, np.ndarray, int]],
        toxic: np.ndarray,
        low_quality: np.ndarray | None = None,
        max_features: int = 512,
        surprise: float = 5.0,
        lift: float = 6.0,
        seed: int = 1,
    ) -> ToxicityChain:
        """``toxic``, ``low_quality``: 0/1 flags. The graded categories are derived from the flag and the telling terms."""
        toxic = np.asarray(toxic, float)
        low_quality = np.zeros(len(toxic)) if low_quality is None else np.asarray(low_quality, float)
        n1, n0 = toxic.sum(), (1 - toxic).sum()
        if not n1 or not n0:
            return cls(CATEGORIES, np.empty(0, np.int32), [])
        in_toxic = np.zeros(SLOTS, np.int32)
        in_clean = np.zeros(SLOTS, np.int32)
        for (slots, _, _), t in zip(rows, toxic, strict=True):
            (in_toxic if t else in_clean)[slots] += 1
        pooled = (in_toxic + in_clean) / (n1 + n0)
        z = (in_toxic / n1 - in_clean / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))
        ratio = ((in_toxic + 0.5) / (n1 + 1)) / ((in_clean + 0.5) / (n0 + 1))
        telling = np.flatnonzero((z >= surprise) & (ratio >= lift))
        telling = telling[np.argsort(-z[telling], kind="stable")[:max_features]]
        chain = cls(CATEGORIES, np.sort(telling).astype(np.int32), [])
        x = chain.matrix(rows)
        amount, share = x[:, -2], x[:, -1]
        middle = [np.median(v[toxic == 1]) for v in (amount, share)]
        targets = [low_quality, toxic * (amount >= middle[0]), toxic * (share >= middle[1]), toxic]
        fold = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
        for y in targets:
            whole = _logistic(x, y)
            out_of_fold = np.zeros(len(rows))
            for k in range(FOLDS):
                train, test = fold != k, fold == k
                if test.any():
                    out_of_fold[test] = _probability(x[test], _logistic(x[train], y[train], whole))
            chain.weights.append(whole)
            x = np.hstack([x, out_of_fold[:, None]])
        return chain


def fit_chain(docs: DataFrame, labels: DataFrame, per_class: int = 2_000) -> ToxicityChain:
    """Fit on a bounded sample of the documents whose id is labelled."""
    flags = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").cast("int").alias("toxic"), F.max((F.col("quality") == 0).cast("int")).alias("low"))
    )
    drawn = bounded_draw(flags.where("toxic > 0"), "id", per_class, 23).withColumn("toxic", F.lit(1)).unionByName(
        bounded_draw(flags.where("toxic <= 0"), "id", per_class, 23).withColumn("toxic", F.lit(0))
    )
    chosen = drawn.join(flags.select("id", F.coalesce("low", F.lit(0)).alias("low")), "id")

    def extract(batches):
        for pdf in batches:
            out = [features(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "draw": pdf["draw"],
                    "toxic": pdf["toxic"],
                    "low": pdf["low"],
                    "slots": [o[0].tobytes() for o in out],
                    "counts": [o[1].tobytes() for o in out],
                    "words": [o[2] for o in out],
                }
            )

    small_batches(docs.sparkSession)
    # the sampled ids are at most 2 * per_class rows: small enough to send to every task
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    got = rows.mapInPandas(releasing(extract), "draw long, toxic int, low int, slots binary, counts binary, words int").toPandas()
    got = got.sort_values(["draw", "slots"], kind="stable").drop_duplicates("draw")
    parsed = [
        (np.frombuffer(s, np.int32), np.frombuffer(c, np.int32), w)
        for s, c, w in zip(got["slots"], got["counts"], got["words"], strict=True)
    ]
    return ToxicityChain.fit(parsed, got["toxic"].to_numpy(), got["low"].to_numpy())


def score(docs: DataFrame, chain: ToxicityChain, threshold: float = 0.5) -> DataFrame:
    """doc_id, toxic (boolean), and a probability for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    small_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        c = shared.value
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            p = c.predict(rows)
            out = pd.DataFrame(p, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "toxic", (p[:, -1] >= threshold) & (np.array([r[2] for r in rows], int) > 0))
            yield out
        _memo.clear()

    schema = "doc_id string, toxic boolean, " + ", ".join(f"{n} double" for n in names)
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(releasing(run), schema)  # as text: pandas has no whole numbers with nulls
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_toxic(docs: DataFrame, chain: ToxicityChain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, in all their columns, that the chain doesn't flag; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    small_batches(docs.sparkSession)

    def flagged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [features(t) for t in texts]
            p = shared.value.predict(rows)
            yield pd.Series((p[:, -1] >= threshold) & (np.array([r[2] for r in rows], int) > 0))
        _memo.clear()

    return docs.where(~F.pandas_udf(_series(flagged), "boolean")("text"))


def _series(fn):
    """releasing() for a function of series, with the annotations that Spark asks for."""
    inner = releasing(fn)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return inner(batches)

    return run


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
