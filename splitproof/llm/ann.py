"""Approximate nearest neighbours by balanced posting lists.

A bounded sample of the vectors is split in halves again and again until the parts have equal size; their means
are the centroids. Every vector is filed under its nearest centroid and, when it lies near a boundary, under
further ones. A query walks an in-memory graph over the centroids, keeps all lists whose centroid is within a
ratio of the nearest one's distance (where the walk's ``beam`` nearest do not reach that far, it compares with every
centroid instead), and is compared with all vectors of these lists.

The number of lists grows with the table (rows / ``list_size``) up to ``max_lists``. What is held in memory is bounded
by parameters: ``sample_bytes`` (vectors the centroids are fitted on: ``sample`` of them, or eight a list) and
``centroid_bytes`` (centroids sent to every task). ``boundary`` and ``replicas`` tell which further lists a vector
is filed under, ``ratio``, ``least_lists`` and ``beam`` which lists a query reads (``beam`` is how many centroids the
walk keeps, no limit of the lists). All vectors are filed and lists may be of any length: they are dealt over tiles.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
no part. Vectors are compared with those of their own length, by an index for each length. An id that occurs with
several vectors is the set of them: it asks with each, and is as near as its nearest. With fewer than k candidates all
are returned. Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kind_of, map_groups, not_null, packed_vectors, releasing, small_batches, small_side, stack, stage

CHUNK = 4096  # vectors of a list in one tile
QUERY_CHUNK = 512  # queries in one tile


@dataclass
class CentroidGraph:
    """Centroids, each with edges to its nearest ones and to a few far ones."""

    points: np.ndarray
    edges: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, near: int = 24, far: int = 4, seed: int = 3) -> CentroidGraph:
        n = len(points)
        k = min(near, n - 1)
        if k < 1:
            return cls(points, np.zeros((n, 0), np.int64))
        rng = np.random.default_rng(seed)
        norm = (points * points).sum(1)
        edges = np.empty((n, k + far), np.int64)
        for a in range(0, n, 1024):
            d = norm[None, :] - 2.0 * points[a : a + 1024] @ points.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            edges[a : a + len(d), :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
        edges[:, k:] = rng.integers(0, n, (n, far))
        return cls(points, edges)

    def nearest(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk that keeps the ``width`` nearest centroids met: (indices, distances), nearest first."""
        n = len(self.points)
        start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        seen = np.zeros(n, bool)
        seen[start] = True
        dist = np.sqrt(((self.points[start] - query) ** 2).sum(1))
        todo = list(zip(dist.tolist(), start.tolist(), strict=True))
        heapq.heapify(todo)
        best = [(-d, i) for d, i in todo]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            step = np.unique(self.edges[i])
            step = step[~seen[step]]
            if not len(step):
                continue
            seen[step] = True
            for e, j in zip(np.sqrt(((self.points[step] - query) ** 2).sum(1)).tolist(), step.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(todo, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(todo, (e, j))
        order = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in order]), np.array([d for d, _ in order])

    def lists(self, query: np.ndarray, sizes: np.ndarray, ratio: float, least: int, rows: int, beam: int) -> np.ndarray:
        """All lists whose centroid is within ``ratio`` of the nearest one's distance, at least ``least`` lists and
        ``rows`` filed rows. The walk keeps ``beam`` centroids; if these do not settle it, all are compared."""
        near, dist = self.nearest(query, min(beam, len(self.points)))
        for _ in range(2):
            enough = int(np.searchsorted(np.cumsum(sizes[near]), rows)) + 1
            take = max(int((dist <= ratio * dist[0]).sum()), least, enough)
            if take < len(near) or len(near) == len(self.points):
                break
            dist = np.sqrt(((self.points - query) ** 2).sum(1))
            near = np.argsort(dist, kind="stable")
            dist = dist[near]
        return near[:take]


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of ``lists`` parts of nearly equal size: each split cuts a part at the median between two means."""
    rng = np.random.default_rng(seed)
    parts, done = [(np.arange(len(x)), lists)], []
    while parts:
        rows, want = parts.pop()
        if want <= 1 or len(rows) < 2 * want:
            done.append(x[rows].mean(0))
            continue
        y = x[rows]
        two = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = ((y - two[0]) ** 2).sum(1) > ((y - two[1]) ** 2).sum(1)
            if side.all() or not side.any():
                break
            two = np.array([y[~side].mean(0), y[side].mean(0)])
        left = want // 2
        order = np.argsort(y @ (two[1] - two[0]), kind="stable")
        at = len(rows) * left // want
        parts += [(rows[order[:at]], left), (rows[order[at:]], want - left)]
    return np.array(done)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 20_000,
    sample_bytes: int = 128 << 20,
    max_lists: int = 65_536,
    centroid_bytes: int = 32 << 20,
    list_size: int = 400,
    boundary: float = 1.03,
    replicas: int = 3,
    ratio: float = 1.16,
    least_lists: int = 8,
    beam: int = 192,
) -> DataFrame:
    """The k nearest rows of ``vectors`` (other than the query's own) to each row of ``queries``.

    Returns query_id, rank, vec_id, score (Euclidean distance in double precision).
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if kind_of(vectors, vector_col) == kind_of(queries, vector_col) == "<f4" else "<f8"
    width = int(kind[2:])

    def pack(batches):
        for pdf in batches:
            packed = packed_vectors(pdf["v"], kind)
            yield pd.DataFrame(
                {"vec_id": pdf["id"], "packed": packed, "dims": [len(p) // width if p else 0 for p in packed]}
            )

    def packed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
        return stage(
            rows.mapInPandas(releasing(pack), "vec_id long, packed binary, dims int").where(not_null("vec_id", "packed")), name
        )

    base, asked = packed(vectors, "base"), packed(queries, "queries")
    lengths = [(r["dims"], r["n"]) for r in base.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()]  # one row a length
    out = None
    for dims, rows in lengths:
        same = F.col("dims") == dims
        lists = max(1, min(math.ceil(rows / list_size), max_lists, centroid_bytes // (8 * dims)))
        drawn = min(max(sample, 8 * lists), sample_bytes // (8 * dims))
        found = _indexed(base.where(same), asked.where(same), kind, k, rows, lists, max(1, drawn), boundary, replicas, ratio, least_lists, beam)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _indexed(
    base: DataFrame, asked: DataFrame, kind: str, k: int, rows: int, lists: int, sample: int, boundary: float, replicas: int, ratio: float, least_lists: int, beam: int
) -> DataFrame:
    """(query_id, vec_id, score): of every tile the k nearest ids, for vectors of one length."""
    spark = base.sparkSession
    draw = F.pmod(F.xxhash64("vec_id", F.lit(99)), F.lit(1 << 40))
    near_enough = int((1 << 40) * min(1.0, 1.5 * sample / rows))
    picked = base.where(draw < near_enough).orderBy(draw, "vec_id").limit(sample).select("packed").collect()
    points = stack(np.array([bytes(r["packed"]) for r in picked], object), kind)
    graph = spark.sparkContext.broadcast(CentroidGraph.build(balanced_centroids(points, lists)))

    def file(batches):
        c = graph.value.points
        norm, r = (c * c).sum(1), min(replicas, len(c))
        step = max(1, 2_000_000 // len(c))
        for pdf in batches:
            for begin in range(0, len(pdf), step):
                part = pdf.iloc[begin : begin + step]
                x = stack(part["packed"].to_numpy(), kind)
                d = np.sqrt(np.maximum(norm[None, :] - 2.0 * x @ c.T + (x * x).sum(1)[:, None], 0))
                near = np.argpartition(d, r - 1, axis=1)[:, :r]
                value = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(value <= boundary * value.min(1, keepdims=True))
                yield pd.DataFrame({"list": near[row, col], "vec_id": part["vec_id"].to_numpy()[row], "packed": part["packed"].to_numpy()[row]})

    postings = stage(base.mapInPandas(releasing(file), "list int, vec_id long, packed binary"), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"))
    length = {r["list"]: r["n"] for r in sizes.collect()}  # one row for each list: at most max_lists

    def choose(batches):
        g = graph.value
        n = np.array([length.get(i, 0) for i in range(len(g.points))])
        for pdf in batches:
            ids, lists, rows_ = [], [], []
            for i, q in enumerate(pdf["packed"].to_numpy()):
                near = g.lists(np.frombuffer(q, kind).astype(float), n, ratio, least_lists, (k + 1) * (replicas + 1), beam)
                lists.append(near)
                rows_.append(np.full(len(near), i))
            if lists:
                at = np.concatenate(rows_)
                ids = pdf["vec_id"].to_numpy()[at]
                yield pd.DataFrame({"list": np.concatenate(lists), "vec_id": ids, "packed": pdf["packed"].to_numpy()[at]})

    probes = stage(asked.dropDuplicates(["vec_id", "packed"]).mapInPandas(releasing(choose), "list int, vec_id long, packed binary"), "probes")
    tiles = sizes.join(probes.groupBy("list").agg(F.count("*").alias("q")), "list").select(
        "list", F.ceil(F.col("n") / CHUNK).cast("int").alias("pn"), F.ceil(F.col("q") / QUERY_CHUNK).cast("int").alias("qn")
    )
    part = F.xxhash64("vec_id", "packed", F.lit(5))

    def dealt(df: DataFrame, mine: str, other: str, name: str, query: bool) -> DataFrame:
        own = F.pmod(part, F.col(mine).cast("long")).cast("int").alias(f"{name}_own")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("every")
        df = df.join(small_side(tiles, len(length), 100_000), "list").select("list", "vec_id", "packed", own, every)
        p, q = ("every", f"{name}_own") if query else (f"{name}_own", "every")
        return df.select("list", F.col(p).alias("p"), F.col(q).alias("q"), "vec_id", "packed", F.lit(int(query)).cast("byte").alias("query"))

    both = dealt(postings, "pn", "qn", "p", False).unionByName(dealt(probes, "qn", "pn", "q", True))
    return map_groups(both, ["list", "p", "q"], _nearest(k, kind), "query_id long, vec_id long, score double")


def _nearest(k: int, kind: str):
    """The k nearest ids among a tile's vectors to each of its queries, by exact distance."""

    def fn(g: dict[str, np.ndarray]):
        is_query = g["query"] == 1
        if not is_query.any() or is_query.all():
            return None
        q_id, q = g["vec_id"][is_query], stack(g["packed"][is_query], kind)
        order = np.flatnonzero(~is_query)
        order = order[np.argsort(g["vec_id"][order], kind="stable")]
        p_id, p = g["vec_id"][order], stack(g["packed"][order], kind)
        first = np.flatnonzero(np.concatenate([[True], p_id[1:] != p_id[:-1]]))  # of each id's vectors
        ids, last = p_id[first], np.append(first[1:], len(p_id))
        q_norm, p_norm = (q * q).sum(1), (p * p).sum(1)
        # what the rough distances may be off by, from the rounding of the three sums
        off = 16 * np.finfo(float).eps * q.shape[1] * (q_norm + p_norm.max())
        outs = []
        for begin in range(0, len(q), 64):
            rough = q_norm[begin : begin + 64, None] - 2.0 * q[begin : begin + 64] @ p.T + p_norm[None, :]
            rough = np.minimum.reduceat(rough, first, axis=1)
            rough[q_id[begin : begin + 64, None] == ids[None, :]] = np.inf
            for i, r in enumerate(rough, begin):
                near = np.flatnonzero(np.isfinite(r))
                if len(near) > k:
                    bound = np.partition(r, k - 1)[k - 1]
                    near = np.flatnonzero(r <= bound + 2 * off[i])
                exact = np.array([np.sqrt(((p[first[j] : last[j]] - q[i]) ** 2).sum(1)).min() for j in near]) if len(ids) < len(p) else np.sqrt(((p[near] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                outs.append((np.full(len(best), q_id[i]), ids[near][best], exact[best]))
        return tuple(np.concatenate([o[j] for o in outs]) for j in range(3))

    return fn
