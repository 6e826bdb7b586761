"""What several operators share: shared-folder staging, group-wise numpy maps, tiles, components."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, stage

__all__ = ["cut", "stage"]
SALTS = 64  # parts that a hot node of a graph is dealt over


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: what is larger goes back as soon as it is freed
        return c.malloc_trim
    except (AttributeError, OSError):  # not with this C library
        return lambda _: 0


def releasing(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``fn`` over the batches of a task, whose memory is given back at the end: a Python worker lives on beside the
    executor's heap, and later tasks may be other operators'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim = _trim()
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Keep what Spark hands to a Python worker at once to a few MB, whatever the length of the texts."""
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
        if not 0 < now <= most:
            spark.conf.set(name, most)


def map_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...] | None],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to the rows of each key, many keys a batch.

    Groups are brought together by a shuffle and a sort, and cut out of Arrow batches with numpy, which
    costs far less a group than one pandas frame each. ``keys`` must not hold nulls. A group must fit in
    memory: callers split large groups into tiles first.
    """
    names = [c.split()[0] for c in schema.split(",")]
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def apply(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
            data = {c: pdf[c].to_numpy() for c in columns}
            outs = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                out = fn({c: v[a:b] for c, v in data.items()})
                if out is not None and len(out[0]):
                    outs.append(out)
            if not outs:
                return None
            return pd.DataFrame({n: np.concatenate([o[i] for o in outs]) for i, n in enumerate(names)})

        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                last = tuple(held[-1][k].iloc[-1] for k in keys)
                if all((pdf[k] == v).all() for k, v in zip(keys, last, strict=True)):
                    held.append(pdf)
                    continue
                pdf = pd.concat([*held, pdf], ignore_index=True)
            change = np.zeros(len(pdf) - 1, bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(starts) > 1 and (out := apply(pdf, starts)) is not None:
                yield out
            held = [pdf.iloc[starts[-1] :]]
        if held:
            pdf = pd.concat(held, ignore_index=True)
            if (out := apply(pdf, np.array([0, len(pdf)]))) is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(releasing(run), schema)


def with_tiles(df: DataFrame, member: str, chunks: Column) -> DataFrame:
    """Deal each group out over square tiles so that every pair of members meets in exactly one of them.

    ``chunks`` tells into how many chunks the group is cut, the same for all its rows. A row's chunk goes by a hash of the
    member; the row goes to the tiles of its chunk with each chunk. Adds tile_a, tile_b (tile_a <= tile_b) and side
    (0: of chunk tile_a, 1: of chunk tile_b; 0 on the diagonal).
    """
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("__n").cast("long")).cast("int")
    return (
        df.withColumn("__n", chunks.cast("int"))
        .withColumn("__c", mine)
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("tile_a", F.least("__c", "__o"))
        .withColumn("tile_b", F.greatest("__c", "__o"))
        .withColumn("side", (F.col("__c") > F.col("__o")).cast("int"))
        .drop("__n", "__c", "__o")
    )


def forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that span the components of a square boolean matrix."""
    active = np.flatnonzero(adjacent.any(1))
    if not len(active):
        return active, active
    sub = adjacent[np.ix_(active, active)] | np.eye(len(active), dtype=bool)
    label = np.arange(len(active))
    while True:
        new = np.where(sub, label[None, :], len(active)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = label != np.arange(len(active))
    return active[move], active[label[move]]


def _with_least(edges: DataFrame, least_of_own: bool) -> DataFrame:
    """``edges`` (u, v) with m, the least v of each u (or u itself, if that is less and ``least_of_own``).

    A node with a large share of all edges is dealt over SALTS parts by a hash of v, in the aggregate and in the join.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(SALTS)).cast("byte"))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("s").alias("s"))  # SALTS parts a node at most
    least = least.select("u", (F.least("u", "m") if least_of_own else F.col("m")).alias("m"), F.explode("s").alias("s"))
    return dealt.join(least, ["u", "s"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Alternates the large-star and small-star steps, each an aggregation to the minimum and a join back, until
    the edges no longer change. Only two numbers come to the driver each round. Lineage is cut every round.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _with_least(large, False)
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        last, seen = seen, mark(now)
        if last == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.unionByName(roots)


def bounded_draw(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """(key, draw) of at most ``limit`` rows, those with the smallest hash of the key.

    A first cut by the hash leaves about twice as many as are wanted, so that the final order is a small one however
    many partitions the input has.
    """
    whole = 1 << 40
    rows = df.count()
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(whole))
    first = df.select(F.col(key), draw.alias("draw")).where(F.col("draw") < int(whole * min(1.0, (2.0 * limit + 50) / max(rows, 1))))
    return first.orderBy("draw", key).limit(limit)


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast of a frame with a counted number of rows, only up to ``limit`` rows."""
    return F.broadcast(df) if rows <= limit else df


def packed_vectors(values: pd.Series, kind: str = "<f8") -> list[bytes | None]:
    """Each vector's components as bytes; None where null, empty, zero or with a null or non-finite part. ``kind`` is
    "<f8", or "<f4" for a column of floats, which that holds exactly."""
    out: list[bytes | None] = []
    for v in values:
        if v is None or not isinstance(v, (np.ndarray, list)) or not len(v):
            out.append(None)
            continue
        try:
            x = np.asarray(v, dtype=kind)
        except (TypeError, ValueError):
            out.append(None)
            continue
        out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
    return out


def kind_of(df: DataFrame, column: str) -> str:
    """The kind that holds a column of vectors exactly in the fewest bytes."""
    return "<f4" if df.schema[column].dataType.simpleString() == "array<float>" else "<f8"


def stack(packed: np.ndarray, kind: str = "<f8") -> np.ndarray:
    """Packed vectors of one length as a matrix of doubles."""
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64, copy=False)


def not_null(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
