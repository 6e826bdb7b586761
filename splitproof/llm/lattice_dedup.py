"""Embedding near-duplicates by lattice hashing.

Random projections to blocks of eight coordinates are decoded to the nearest E8 lattice points, in several
tables. A vector is filed under its own cell and under the neighbouring cells nearest to it; vectors that meet
in a cell are compared by a coarse copy of eight bits a component, whose error is bounded: no pair at the threshold
is lost by it, and vectors travel to the cells in an eighth of their size. Pairs that may be close join candidate
components, in which all pairs are verified by exact cosine, in square tiles. Scale, blocks, probes and tables are
designed from the number of vectors, so that the candidates of a vector stay about as many at every size.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing
and is its own component; so does a row without an id (its component is null and it is kept). Vectors of
different lengths never link. Rows with equal vectors link with each other. Rows that repeat a vec_id each
count, with the links of their own vector, and rows of one id are in one component only if their vectors are. An
empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, kind_of, map_groups, not_null, packed_vectors, releasing, small_batches, stack, stage, with_tiles

CELL_CHUNK = 512  # rows of a side of a cell's tile
CHUNK = 2048  # rows of a side of a component's tile


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(1)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    step = np.where(error[odd, worst[odd]] >= 0, 1.0, -1.0)
    near[odd, worst[odd]] += step
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 shifted by 1/2, to each row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cell_hash(points: np.ndarray) -> np.ndarray:
    """64-bit hash of lattice points (..., 8); coordinates are multiples of 1/2."""
    c = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = np.full(points.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(8):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + c[..., k])
    return h


@dataclass(frozen=True)
class Design:
    dims: int
    blocks: int
    scale: float
    probes: int
    tables: int
    seed: int = 11

    def projection(self, table: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, self.dims, table])
        return rng.standard_normal((self.dims, 8 * self.blocks)) / self.scale

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(n, 1 + probes) cell keys; the first is the vector's own cell."""
        y = unit @ self.projection(table)
        n, m = len(y), self.probes
        own, first, shift, cost = [], [], [], []
        for b in range(self.blocks):
            part = y[:, 8 * b : 8 * b + 8]
            point = decode_e8(part)
            own.append(_cell_hash(point))
            if m:
                away = -2.0 * (part - point) @ NEIGHBOURS.T  # squared distance to each neighbour, less a constant
                k = np.argpartition(away, m - 1, axis=1)[:, :m]
                first.append(_cell_hash(point[:, None, :] + NEIGHBOURS[k]))
                cost.append(np.take_along_axis(away, k, 1))
                shift.append(np.full((n, m), b))
        tag = np.uint64((table + 1) * 0x2545F4914F6CDD1D % 2**64)

        def join(parts: list[np.ndarray]) -> np.ndarray:
            h = np.full(parts[0].shape, tag, np.uint64)
            for b, p in enumerate(parts):
                h = _mix(h + p * np.uint64(2 * b + 3))
            return h

        out = [join(own)[:, None]]
        if m:
            cells, costs, blocks = np.concatenate(first, 1), np.concatenate(cost, 1), np.concatenate(shift, 1)
            best = np.argpartition(costs, m - 1, axis=1)[:, :m] if costs.shape[1] > m else np.tile(np.arange(m), (n, 1))
            cells, blocks = np.take_along_axis(cells, best, 1), np.take_along_axis(blocks, best, 1)
            out.append(join([np.where(blocks == b, cells, own[b][:, None]) for b in range(self.blocks)]))
        return np.concatenate(out, 1).view(np.int64)


def _pair_recall(design: Design, cosine: float, pairs: int, tables: int) -> float:
    """Share of pairs at exactly this cosine that meet in one table, measured on random pairs."""
    rng = np.random.default_rng(5)
    u = rng.standard_normal((pairs, design.dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((pairs, design.dims))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    v = cosine * u + math.sqrt(1 - cosine * cosine) * w
    met = 0.0
    for t in range(tables):
        a, b = design.cells(u, t), design.cells(v, t)
        met += ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() / tables
    return met


@lru_cache(maxsize=64)
def design_for(rows: int, dims: int, cosine: float, recall: float) -> Design:
    """The cheapest design that reaches the recall for pairs at exactly ``cosine``; an error where none does.

    The chance that two unrelated vectors share a cell follows from the lattice's unit volume and the density
    of projected vectors. Cost, in bytes: keys shuffled, coarse vectors sent to cells that are shared, and comparisons.
    """
    best: tuple[float, Design] | None = None
    vector = dims + 40.0
    for blocks, probes, expected in itertools.product((1, 2, 3), (2, 4, 8), (0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0)):
        chance = min(0.25, expected / (max(rows, 2) * (1 + 2 * probes)))
        scale = (chance ** (1 / blocks) * (4 * math.pi) ** 4) ** 0.125
        met = _pair_recall(Design(dims, blocks, scale, probes, 1), cosine, 400, 4)
        if met < 0.01:
            continue
        tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(met, 0.999))))
        homes = chance * rows  # of other vectors, in a cell
        shared = 1 - math.exp(-homes * (1 + probes)) + probes * (1 - math.exp(-homes))
        cost = tables * ((1 + probes) * 40 + shared * vector + expected * 0.3)
        if best is None or cost < best[0]:
            best = (cost, Design(dims, blocks, scale, probes, tables))
    if best is None:
        raise ValueError(f"no lattice design reaches recall {recall} at cosine {cosine} for {rows} vectors of {dims} components")
    return best[1]


def coarse(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, step) of each row: components to the nearest of 255 steps of the largest one."""
    step = np.abs(unit).max(1) / 127.0
    return np.rint(unit / step[:, None]).astype(np.int8), step


def near_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.9,
    recall: float = 0.97,
    chunk: int = CHUNK,
    cell_chunk: int = CELL_CHUNK,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    kind = kind_of(vectors, vector_col)
    width = int(kind[2:])

    def pack(batches):
        for pdf in batches:
            packed = packed_vectors(pdf["v"], kind)
            yield pd.DataFrame(
                {"vec_id": pdf["id"], "packed": packed, "dims": [len(p) // width if p else 0 for p in packed]}
            )

    small_batches(vectors.sparkSession)
    rows = stage(
        vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"))  # pandas has no whole numbers with nulls
        .mapInPandas(releasing(pack), "vec_id string, packed binary, dims int")
        .withColumn("vec_id", F.col("vec_id").cast("long")),
        "vectors",
    )
    usable = rows.where(not_null("vec_id", "packed"))
    # equal vectors are one class; classes have numbers of their own, since an id can have several vectors
    classes = stage(
        usable.groupBy("dims", "packed")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
        .select(F.monotonically_increasing_id().alias("c"), "*"),
        "classes",
    )
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # one row a length
    designs = {d: design_for(n, d, cosine, recall) for d, n in sizes.items()}

    def file(batches):
        for pdf in batches:
            for d, part in pdf.groupby("dims"):
                design = designs[d]
                x = _unit(part["packed"].to_numpy(), kind)
                c = part["c"].to_numpy()
                for t in range(design.tables):
                    cells = design.cells(x, t)
                    wide = cells.shape[1]
                    yield pd.DataFrame(
                        {
                            "cell": cells.ravel() ^ np.int64(d * 0x1000003),
                            "c": np.repeat(c, wide),
                            "home": np.tile((np.arange(wide) == 0).astype(np.int8), len(c)),
                        }
                    )

    def shrink(batches):
        for pdf in batches:
            for d, part in pdf.groupby("dims"):
                q, step = coarse(_unit(part["packed"].to_numpy(), kind))
                yield pd.DataFrame({"c": part["c"].to_numpy(), "dims": d, "step": step, "q": [r.tobytes() for r in q]})

    cells = classes.select("dims", "packed", "c").mapInPandas(releasing(file), "cell long, c long, home byte")
    # staged, so that the join below reads plain shuffles, of which a cell with many vectors can be split
    shared = stage(
        cells.groupBy("cell")
        .agg(F.count("*").alias("n"), F.sum("home").alias("homes"))
        .where("n > 1 and homes > 0")
        .select("cell", "n"),
        "cells",
    )
    small = classes.select("dims", "packed", "c").mapInPandas(releasing(shrink), "c long, dims int, step double, q binary")
    met = with_tiles(cells.join(shared, "cell"), "c", F.ceil(F.col("n") / cell_chunk))
    edges = map_groups(
        met.select("cell", "tile_a", "tile_b", "c", "home", "side").join(small, "c"),
        ["cell", "tile_a", "tile_b"],
        _perhaps_close(cosine),
        "a long, b long",
    )
    blocks = stage(connected_components(edges).withColumnRenamed("node", "c"), "blocks")
    cuts = stage(blocks.groupBy("component").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "cuts")
    tiles = with_tiles(blocks.join(cuts, "component"), "c", F.col("chunks"))
    verified = stage(
        map_groups(
            tiles.select("component", "tile_a", "tile_b", "c", "side").join(classes.select("c", "dims", "packed", "m"), "c"),
            ["component", "tile_a", "tile_b"],
            _verify(cosine, kind),
            "kind byte, a long, b long",
        ),
        "verified",
    )
    links = verified.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("links"))
    linked = connected_components(verified.where("kind = 1").select("a", "b")).withColumnRenamed("node", "c")
    linked = stage(linked.join(classes.select("c", "rep"), "c"), "linked")
    least = stage(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    found = (
        classes.join(links, "c", "left")
        .join(linked.join(least, "component").select("c", "component_id"), "c", "left")
        .select(
            "dims",
            "packed",
            (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    return (
        rows.join(found, ["dims", "packed"], "left")
        .select(
            "vec_id",
            F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _unit(packed: np.ndarray, kind: str) -> np.ndarray:
    x = stack(packed, kind)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _perhaps_close(cosine: float):
    """Edges that span what may be close within a tile, between rows of which one is at home in the cell.

    A coarse copy is off by at most half a step in each component, by r = step * sqrt(dims) / 2 in all; so the product of
    two copies is off by at most r_a + r_b + r_a * r_b from the cosine.
    """

    def fn(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        if len(g["c"]) < 2 or not g["home"].any():
            return None
        dims = int(g["dims"][0])
        step = g["step"].astype(float)
        x = np.frombuffer(b"".join(g["q"]), np.int8).reshape(len(step), dims) * step[:, None]
        r = step * math.sqrt(dims) / 2 * (1 + 1e-9)
        close = x @ x.T >= cosine - 1e-9 - (r[:, None] + r[None, :] + r[:, None] * r[None, :])
        close &= (g["home"][:, None] + g["home"][None, :]) > 0
        if g["tile_a"][0] != g["tile_b"][0]:
            close &= g["side"][:, None] != g["side"][None, :]
        np.fill_diagonal(close, False)
        node, root = forest(close)
        keep = g["c"][node] != g["c"][root]
        return g["c"][node][keep], g["c"][root][keep]

    return fn


def _verify(cosine: float, kind: str):
    """Exact cosines within a tile: kind 0, the input rows that each row links to; kind 1, edges that span the links."""

    def fn(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        x, m, c = _unit(g["packed"], kind), g["m"].astype(np.int64), g["c"]
        diagonal = g["tile_a"][0] == g["tile_b"][0]
        side = g["side"]
        close = np.empty((len(x), len(x)), bool)
        for i in range(0, len(x), 512):
            close[i : i + 512] = x[i : i + 512] @ x.T >= cosine
            if not diagonal:
                close[i : i + 512] &= side[i : i + 512, None] != side[None, :]
        np.fill_diagonal(close, False)
        close &= close.T  # the products of a pair may differ in the last bit
        links = np.concatenate([close[i : i + 512] @ m for i in range(0, len(x), 512)])
        node, root = forest(close)
        return (
            np.concatenate([np.zeros(len(c), np.int8), np.ones(len(node), np.int8)]),
            np.concatenate([c, c[node]]),
            np.concatenate([links, c[root]]),
        )

    return fn
