"""Leader clustering. The result depends on the order, so exact copies are collapsed first and ids give the order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 512  # rows settled together


class LeaderWalk:
    """Rows arrive in order, in blocks. Each row joins the most similar leader so far (of equal ones the earlier) if that
    reaches the threshold, and else becomes a leader. Only leaders are held, in blocks of rows, never the rows walked."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []  # leaders' ids and vectors

    def walk(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leader's id of each row."""
        return np.concatenate([self._settle(ids[i : i + BLOCK], x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)])

    def _settle(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        score, mine = np.full(len(x), -np.inf), ids.copy()
        for known, vectors in self.blocks:
            s = x @ vectors.T
            at = s.argmax(1)
            s = s[np.arange(len(x)), at]
            better = s > score
            score[better], mine[better] = s[better], known[at[better]]
        among = x @ x.T
        fresh: list[int] = []
        for i in range(len(x)):
            if fresh:
                j = fresh[int(among[i, fresh].argmax())]
                if among[i, j] > score[i]:
                    score[i], mine[i] = among[i, j], ids[j]
            if score[i] < self.threshold:
                fresh.append(i)
                mine[i] = ids[i]
        if fresh:
            if self.blocks and len(self.blocks[-1][0]) + len(fresh) <= 8 * BLOCK:
                known, vectors = self.blocks.pop()
                self.blocks.append((np.concatenate([known, ids[fresh]]), np.concatenate([vectors, x[fresh]])))
            else:
                self.blocks.append((ids[fresh], x[fresh]))
        return mine


def leaders(x: np.ndarray, threshold: float) -> np.ndarray:
    """Index of each row's leader."""
    return LeaderWalk(threshold).walk(np.arange(len(x)), x) if len(x) else np.empty(0, int)


def leader_clusters(items: DataFrame, threshold: float, by: str = "class") -> DataFrame:
    """item_id, class, leader_id. Serial within a class by definition; classes run in parallel, and a task streams
    through its rows, so that it holds the leaders of one class and one batch.

    ``items``: item_id, class, v (unit vectors). Leaders never merge, unlike connected components.
    """

    def run(batches):
        walk, last = LeaderWalk(threshold), None
        for pdf in batches:
            for value, part in pdf.groupby(by, sort=False, dropna=False):
                value = None if pd.isna(value) else value
                if last is None or value != last[0]:
                    walk, last = LeaderWalk(threshold), (value,)
                ids = part["item_id"].to_numpy()
                yield pd.DataFrame({"item_id": ids, by: part[by].to_numpy(), "leader_id": walk.walk(ids, np.stack(part["v"].to_numpy()).astype(float))})

    kind = dict(items.dtypes)[by]
    rows = items.select("item_id", by, "v").repartition(by).sortWithinPartitions(by, "item_id")
    return rows.mapInPandas(run, f"item_id long, {by} {kind}, leader_id long")
