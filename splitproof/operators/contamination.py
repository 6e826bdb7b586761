"""Passages of a benchmark inside documents, found by an automaton over the whole text of each document.

The passages of a benchmark are few and short beside the documents: they go to every task in pieces of bounded size, one
pass over the documents for each piece. No pair of a document and a passage that it does not hold is ever formed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage

PIECE_CHARS = 16_000_000  # of the passages that one automaton holds


def contained_passages(docs: DataFrame, passages: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, item_id) for every passage that occurs in a document's text, once a pair of rows.

    ``docs``: doc_id, text. ``passages``: item_id, text; an empty or null text is in nothing. Passages are cut into
    pieces of at most ``piece_chars`` characters (and one passage more); each piece is an automaton in the Python
    workers, and the documents are read once a piece.
    """
    texts = passages.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    pieces = max(1, -(-int(size) // piece_chars))
    dealt = texts.withColumn("piece", F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)).cast("int"))
    if pieces > 1:
        dealt = stage(dealt, "passages")
    out = None
    for piece in range(pieces):
        held = [(r["item_id"], r["text"]) for r in dealt.where(F.col("piece") == piece).select("item_id", "text").collect()]  # piece_chars at most
        shared = docs.sparkSession.sparkContext.broadcast(held)
        found = _matches(docs, shared)
        out = found if out is None else out.unionByName(found)
    return out


def _matches(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        import ahocorasick

        automaton, ids = ahocorasick.Automaton(), {}
        for item, text in shared.value:
            ids.setdefault(text, []).append(item)
        for text, items in ids.items():
            automaton.add_word(text, items)
        automaton.make_automaton() if ids else None
        for pdf in batches:
            doc, item = [], []
            for d, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not ids or not text:
                    continue
                hit = {id(items): items for _, items in automaton.iter(text)}
                for items in hit.values():
                    doc += [d] * len(items)
                    item += items
            yield pd.DataFrame({"doc_id": pd.Series(doc, dtype="object"), "item_id": pd.Series(item, dtype="object")})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: pandas has no whole numbers with nulls
    out = rows.mapInPandas(run, "doc_id string, item_id long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "item_id")
