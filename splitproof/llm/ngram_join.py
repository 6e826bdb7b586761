"""Near-duplicate documents: an n-gram Jaccard join by MinHash banding.

Two documents link if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Words are runs
of letters, digits and underscores in lower case. Band and row counts are chosen for a target recall at the
threshold. Steps:

1. Each text gives its shingles' MinHash signature and a 128-bit digest of the whole set. Documents with
   equal sets form a class (copies are never expanded into pairs). Classes have numbers of their own: an id that
   occurs with several texts is in several classes.
2. One signature a class is dealt out by band hashes. Within a bucket, signatures are compared in square tiles;
   pairs whose sizes allow the threshold and whose signatures agree in enough places join candidate components. A pair
   at the threshold agrees in fewer places with a chance of at most ``LOSS`` (the binomial tail), which adds to what
   the bands may miss. This keeps classes that only share a band, say by a common passage, from chaining everything
   together.
3. Within a candidate component the full shingle sets meet in square tiles, each pair in exactly one, and are
   compared exactly. A tile returns the number of links of each row and edges that span what is linked, never
   its pairs. The edges give the final components. Tiles are bounded in rows and in bytes; a component of n bytes is
   sent n / ``TILE_BYTES`` times, not once for each pair.

Large groups are dealt over many tiles and never gathered in one task; no partner is dropped or capped.

Defined cases: a text of one to four words has one shingle, all its words. A null text or one without words
has no shingles and links with nothing, nor does a row without an id (its class is then its own id).
Rows that repeat a doc_id each count as documents, copies of each other or not as their texts are; each row has the
links and the class of its own text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, map_groups, releasing, small_batches, small_side, stage, with_tiles

WORD = re.compile(r"\w+")
N = 5
THRESHOLD = 0.8
RECALL = 0.9995
LOSS = 1e-6
MEMO = 150_000
BUCKET_CHUNK = 512
TILE_ROWS = 1024
TILE_BYTES = 8 << 20  # of shingles on one side of a tile
BROADCAST_ROWS = 200_000  # of an id and a hash
_memo: dict[str, int] = {}


@lru_cache(maxsize=8)
def bands_for(threshold: float, recall: float, chance_at: float = 0.3, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): fewest expected wasted candidates at similarity ``chance_at`` among those that reach the recall."""
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if bands * rows <= max_hashes:
            waste = 1 - (1 - chance_at**rows) ** bands
            if best is None or waste < best[0]:
                best = (waste, bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best[1], best[2]


@lru_cache(maxsize=8)
def least_agreeing(threshold: float, hashes: int, loss: float = LOSS) -> int:
    """The largest count that a signature pair at the threshold misses with a chance of at most ``loss``."""
    tail = 0.0
    for k in range(hashes + 1):
        log = math.lgamma(hashes + 1) - math.lgamma(k + 1) - math.lgamma(hashes - k + 1)
        tail += math.exp(log + k * math.log(threshold) + (hashes - k) * math.log1p(-threshold)) if threshold < 1 else float(k == hashes)
        if tail > loss:
            return k
    return hashes


def _word_hash(word: str) -> int:
    h = _memo.get(word)
    if h is None:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(_memo) >= MEMO:
            _memo.clear()
        _memo[word] = h
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles, ascending."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    k = max(1, len(w) - n + 1)
    out = np.full(k, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(n, len(w))):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + w[i : i + k])
    return np.unique(out)


class Signer:
    def __init__(self, hashes: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 63, hashes, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def sign(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(s), 4096):
            part = (s[None, i : i + 4096] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)
            out = np.minimum(out, part.min(1).astype(np.uint32))
        return out


SAME = ["h1", "h2", "size"]  # what documents with equal sets of shingles share


def _classes_of(docs: DataFrame, id_col: str, n: int, threshold: float, recall: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, found). sketches: id, t (hash of the text) and SAME of every row. found: of every class SAME, copy_id,
    n_links, class_id and group, a number that the classes of a component share."""
    bands, rows = bands_for(threshold, recall)
    hashes = bands * rows
    small_batches(docs.sparkSession)

    def sketch(batches):
        signer = Signer(hashes)
        for pdf in batches:
            h1, h2, size, sig = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, n)
                h1.append(int(np.bitwise_xor.reduce(_mix(s + np.uint64(1)), initial=np.uint64(0)).view(np.int64)))
                h2.append(int(np.add.reduce(_mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64)))
                size.append(len(s))
                sig.append(signer.sign(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "t": pdf["t"], "h1": h1, "h2": h2, "size": size, "sig": sig})
        _memo.clear()

    texts = _with_text_hash(docs.select(F.col(id_col).cast("long").alias("id"), "text"))
    sketches = stage(texts.select(F.col("id").cast("string"), "t", "text")  # as text: pandas has no whole numbers with nulls
        .mapInPandas(releasing(sketch), "id string, t long, h1 long, h2 long, size int, sig binary")
        .withColumn("id", F.col("id").cast("long")),
        "sketches",
    )
    classes = stage(
        sketches.where("id is not null and size > 0")
        .groupBy(*SAME)
        .agg(F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("m"), F.max("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("c"), *SAME, "first.id", "first.t", "m", "sig"),
        "classes",
    )

    def bands_of(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), bands, rows).astype(np.uint64)
            h = np.full((len(pdf), bands), 0x9E3779B97F4A7C15, np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
            for r in range(rows):
                h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
            yield pd.DataFrame({"bucket": h.ravel().view(np.int64), "c": np.repeat(pdf["c"].to_numpy(), bands)})

    buckets = classes.select("c", "sig").mapInPandas(releasing(bands_of), "bucket long, c long")
    # staged, so that the join below reads plain shuffles, of which a bucket with many classes can be split
    shared = stage(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = with_tiles(buckets.join(shared, "bucket"), "c", F.ceil(F.col("n") / BUCKET_CHUNK))
    candidates = map_groups(
        met.select("bucket", "tile_a", "tile_b", "c", "side").join(classes.select("c", "size", "sig"), "c"),
        ["bucket", "tile_a", "tile_b"],
        _likely_edges(least_agreeing(threshold, hashes), threshold),
        "a long, b long",
    )
    blocks = stage(
        connected_components(candidates).withColumnRenamed("node", "c").join(classes.select("c", "id", "t", "size"), "c"), "blocks"
    )
    chunks = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.col("size") * 8) / TILE_BYTES)).alias("chunks")
    cuts = stage(blocks.groupBy("component").agg(chunks), "cuts")

    def sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"c": pdf["c"], "shingles": [shingles(t, n).tobytes() for t in pdf["text"]]})
        _memo.clear()

    wanted = blocks.select("id", "t", "c")
    wanted = small_side(wanted, wanted.count(), BROADCAST_ROWS)
    one = texts.join(wanted, ["id", "t"]).select("c", "text").dropDuplicates(["c"])
    full = stage(one.mapInPandas(releasing(sets), "c long, shingles binary"), "shingles").join(classes.select("c", "m"), "c")
    tiles = with_tiles(blocks.select("component", "c").join(cuts, "component"), "c", F.col("chunks"))
    verified = stage(
        map_groups(
            tiles.select("component", "tile_a", "tile_b", "c", "side").join(full, "c"),
            ["component", "tile_a", "tile_b"],
            _verify(threshold),
            "kind byte, a long, b long",
        ),
        "verified",
    )
    links = verified.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("links"))
    linked = connected_components(verified.where("kind = 1").select("a", "b")).withColumnRenamed("node", "c")
    linked = stage(linked.join(classes.select("c", "id"), "c"), "linked")
    least = stage(linked.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    found = (
        classes.select("c", *SAME, "id", "m")
        .join(links, "c", "left")
        .join(linked.join(least, "component").select("c", "component", "class_id"), "c", "left")
        .select(
            *SAME,
            F.col("id").alias("copy_id"),
            (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("component", "c").alias("group"),
        )
    )
    return sketches.select("id", "t", *SAME), found


def _with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("t", F.xxhash64("text"))


def near_documents(
    docs: DataFrame, id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE_ROWS
) -> DataFrame:
    """One row per input row: id, copy_id (smallest id with the same shingles), n_links (other documents linked
    directly, copies included), class_id (smallest id reachable by links)."""
    sketches, found = _classes_of(docs, id_col, n, threshold, recall, tile)
    out = sketches.select("id", *SAME).join(found, SAME, "left")
    real = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(real, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(real, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(real, F.coalesce("copy_id", "id")).alias("copy_id"),
    )


def _diagonal(g: dict[str, np.ndarray]) -> bool:
    return bool(g["tile_a"][0] == g["tile_b"][0])


def _likely_edges(least: int, threshold: float):
    """Edges that span the rows of a tile whose sizes allow the threshold and whose signatures agree in at least
    ``least`` places."""

    def fn(g: dict[str, np.ndarray]):
        k = len(g["c"])
        if k < 2:
            return None
        sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(k, -1)
        size = g["size"].astype(float)
        near = np.zeros((k, k), bool)
        step = max(1, 4_000_000 // (k * sig.shape[1]))
        for i in range(0, k, step):
            near[i : i + step] = (sig[i : i + step, None, :] == sig[None, :, :]).sum(2) >= least
        near &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
        if not _diagonal(g):
            near &= g["side"][:, None] != g["side"][None, :]
        np.fill_diagonal(near, False)
        node, root = forest(near)
        return g["c"][node], g["c"][root]

    return fn


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (or of left with left)."""
    every = left if right is None else [*left, *right]
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    values, code, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    order = order[count[code[order]] > 1]  # a shingle of one document adds nothing
    owner, code = owner[order], code[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]) if len(code) else np.array([0])
    code = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    a = len(left)
    total = np.zeros((a, a if right is None else len(right)), np.float64)
    width = max(256, 4_000_000 // max(1, len(every)))
    for begin in range(0, len(starts) - 1, width):
        lo, hi = starts[begin], starts[min(begin + width, len(starts) - 1)]
        x = np.zeros((len(every), min(width, len(starts) - 1 - begin)), np.float32)
        x[owner[lo:hi], code[lo:hi] - begin] = 1
        total += x[:a] @ (x[:a] if right is None else x[a:]).T
    return total


def _verify(threshold: float):
    """Exact similarities within a tile: kind 0, the links of each row (copies counted); kind 1, spanning edges."""

    def fn(g: dict[str, np.ndarray]):
        parsed = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
        size, m, c = np.array([len(s) for s in parsed], float), g["m"].astype(np.int64), g["c"]
        if _diagonal(g):
            common = _common(parsed, None)
            close = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(close, False)
            counts, full = close @ m, close
        else:
            a, b = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
            if not len(a) or not len(b):
                return None
            common = _common([parsed[i] for i in a], [parsed[i] for i in b])
            close = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-9
            counts = np.zeros(len(c), np.int64)
            counts[a], counts[b] = close @ m[b], close.T @ m[a]
            full = np.zeros((len(c), len(c)), bool)
            full[np.ix_(a, b)] = close
            full |= full.T
        node, root = forest(full)
        kind = np.concatenate([np.zeros(len(c), np.int8), np.ones(len(node), np.int8)])
        return kind, np.concatenate([c, c[node]]), np.concatenate([counts, c[root]])

    return fn


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE_ROWS
) -> DataFrame:
    """``docs`` without the documents that a smaller one of their component stands for.

    Of each component the row with the smallest id stays (of several texts of that id in the component, the one with
    the smallest hash; of rows equal in id and text any one). Rows without shingles or without an id all stay.
    """
    sketches, found = _classes_of(docs, id_col, n, threshold, recall, tile)
    rows = sketches.where("id is not null and size > 0").join(found.select(*SAME, "group"), SAME).select("id", "t", "group")
    rows = stage(rows, "rows")
    first = F.min(F.struct("id", "t")).alias("first")
    several = stage(rows.groupBy("group").agg(first, F.count("*").alias("n")).where("n > 1").select("group", "first"), "several")
    wins = (F.col("id") == F.col("first.id")) & (F.col("t") == F.col("first.t"))
    marks = rows.join(several, "group").groupBy("id", "t").agg(F.max(wins).alias("wins"), F.count("*").alias("n"))
    marks = stage(marks.where("not wins or n > 1").select(F.col("id").alias("__id"), F.col("t").alias("__t"), "wins"), "marks")
    counts = {r["wins"]: r["count"] for r in marks.groupBy("wins").count().collect()}  # two rows
    marks = marks.withColumnRenamed("wins", "__wins")

    hashed = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64("text").alias("__t"))
    columns = [F.col("__row")[c].alias(c) for c in docs.columns]
    known = small_side(marks, sum(counts.values()), BROADCAST_ROWS)
    both = hashed.join(known, ["__id", "__t"], "left")
    if not counts.get(True):
        return both.where("__wins is null").select(*columns)
    once = both.where("__wins").dropDuplicates(["__id", "__t"])
    return both.where("__wins is null").select(*columns).unionByName(once.select(*columns))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_documents(docs).select("doc_id", "class_id", "n_links")
