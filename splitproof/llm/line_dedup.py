"""Line deduplication by a deletion-neighbourhood join.

A line occurrence is dropped if it isn't the first of its text, or if a different line whose first occurrence
is earlier lies within one edit (a character inserted, deleted or replaced). Order: doc_id, then position. Lines
are compared after ASCII white space is trimmed from both ends; blank lines are never dropped. Lines of
fewer than ``min_near`` characters (10; 1 compares all) are only compared exactly: in them one edit is no small change.

Exact copies go by the first occurrence of each text. For near copies every variant within the edit bound is
emitted as a hashed key: the line itself, and the line with one character deleted, with and without the position.
Lines that share a variant at the same position differ in that one character; a line that equals another's variant
differs by one insertion. So each group of equal variants needs only its earliest line (or the line that equals
the variant), not its pairs, and what is found is verified by edit distance on the texts. Before variants are
emitted, lines that cannot have a partner are set aside: of two lines within one edit the first or the last
half is equal, so a line whose halves no other line has needs no variants, nor does one that equals no other outside an eighth of its
length. Nothing is lost by that.

Defined cases: a null text stays null, an empty one empty. Rows without an id come last in order. Rows that repeat an
id are documents of their own if their texts differ, in the order of a hash of the text; rows that repeat id and text
count as one document: they keep the same lines. So do rows without an id that have equal texts. Ties cannot
occur: positions differ. An empty table gives an empty result. Other columns are passed through (n_chars, if there, is
set anew). With ``drop_emptied`` rows that had a line and keep none are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, small_side, stage

MIN_NEAR = 10
BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1  # the order of rows without an id
BROADCAST_LINES = 500_000  # places of lines, four bytes each, beside their documents' keys


def _characters(text: str) -> np.ndarray:
    """A 64-bit value for each code point."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9DDFEA08EB382D69)
_INVERSE = np.uint64(pow(0x9DDFEA08EB382D69, -1, 1 << 64))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def variant_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of all variants within one deletion.

    Role 0: the text itself. Role 1: one character deleted. Role 2: the same, with the position. Keys of roles 0 and 1
    can be equal; those of role 2 are apart. All are sums of powers, so that each takes constant time.
    """
    n = len(text)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_characters(text) * powers[:n], dtype=np.uint64)])
        whole = _scramble(sums[-1:] + np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F))
        dropped = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
        plain = _scramble(dropped + np.uint64(max(n - 1, 0)) * np.uint64(0xC2B2AE3D27D4EB4F))
        placed = _scramble(plain ^ (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)))
    roles = np.concatenate([np.zeros(1, np.int8), np.ones(n, np.int8), np.full(n, 2, np.int8)])
    keys = np.concatenate([whole, plain, placed]).view(np.int64)
    once = np.unique(plain, return_index=True)[1]  # a run of one character gives the same variant again
    keep = np.concatenate([[0], 1 + once, np.arange(1 + n, 1 + 2 * n)]).astype(int)
    return keys[keep], roles[keep]


def _unit(id_col: str) -> list:
    """The order of documents: d, the id (LAST for none), then x, a hash of the text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("x")]


PLACE = ["d", "x", "pos"]


def first_lines(docs: DataFrame, id_col: str = "doc_id", min_near: int = MIN_NEAR) -> DataFrame:
    """One row for each distinct trimmed line: its first occurrence (PLACE), length n and half keys."""
    lines = docs.where("text is not null").select(*_unit(id_col), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*PLACE, F.trim("line", F.lit(BLANKS)).alias("t")).where("t <> ''")

    def half(size: str, left: bool):
        text = f"left(t, {size} div 2)" if left else f"right(t, {size} - {size} div 2)"
        return F.when(F.col("n") >= min_near - 1, F.expr(f"xxhash64({text}, {size}, {int(left)})"))

    lines = lines.withColumn("n", F.length("t")).select(
        F.xxhash64("t").alias("h"),
        F.crc32(F.col("t").cast("binary")).alias("c"),
        "n",
        *PLACE,
        *[half(size, left).alias(f"k{i}") for i, (size, left) in enumerate((s, x) for s in ("n", "(n - 1)") for x in (True, False))],
    )
    return lines.groupBy("h", "c", "n").agg(
        F.min(F.struct(*PLACE)).alias("first"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
    ).select("n", "first.*", *[f"k{i}" for i in range(4)])


def _met(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys on more than one row; staged, so that joins with them read plain shuffles, of which a hot key can be split."""
    return stage(rows.groupBy(key).agg(F.count("*").alias("m")).where("m > 1").select(key), name)


def near_copies(docs: DataFrame, firsts: DataFrame, id_col: str = "doc_id", min_near: int = MIN_NEAR) -> DataFrame:
    """PLACE of the first occurrences that have an earlier line within one edit."""
    halves = firsts.where(F.col("n") >= min_near).select(*PLACE, F.explode(F.array(*[f"k{i}" for i in range(4)])).alias("k"))
    shared = _met(halves, "k", "lines-halves")
    able = stage(halves.join(shared, "k").select(*PLACE).distinct(), "lines-able")
    wanted = able.groupBy("d", "x").agg(F.sort_array(F.collect_list("pos")).alias("wanted"))
    texts = docs.where("text is not null").select(*_unit(id_col), "text")
    texts = texts.join(small_side(wanted, able.count(), BROADCAST_LINES), ["d", "x"])

    def pick(batches):
        for pdf in batches:
            d, x, pos, out = [], [], [], []
            for i, h, text, places in zip(pdf["d"], pdf["x"], pdf["text"], pdf["wanted"], strict=True):
                lines = text.split("\n")
                for p in places:
                    if p < len(lines) and (t := lines[p].strip(BLANKS)):
                        d.append(i)
                        x.append(h)
                        pos.append(p)
                        out.append(t)
            yield pd.DataFrame({"d": np.array(d, np.int64), "x": np.array(x, np.int64), "pos": np.array(pos, np.int32), "t": out})

    # rows that repeat id and text give the same line of a place more than once
    lines = stage(texts.mapInPandas(releasing(pick), "d long, x long, pos int, t string").dropDuplicates(PLACE), "lines-text")
    lines = lines.join(_with_a_window_in_common(lines), PLACE, "left_semi")

    names = ["key", "role", *PLACE]

    def vary(batches):
        for pdf in batches:
            held, rows = [], 0
            for i, h, p, t in zip(pdf["d"], pdf["x"], pdf["pos"], pdf["t"], strict=True):
                keys, roles = variant_keys(t)
                n = len(keys)
                held.append((keys, roles, np.full(n, i, np.int64), np.full(n, h, np.int64), np.full(n, p, np.int32)))
                rows += n
                if rows > 100_000:
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*held, strict=True), strict=True)})
                    held, rows = [], 0
            if held:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*held, strict=True), strict=True)})

    variants = lines.mapInPandas(releasing(vary), "key long, role byte, d long, x long, pos int")
    variants = stage(variants.join(_met(variants, "key", "lines-keys"), "key"), "lines-variants")
    at = F.struct(*PLACE)
    groups = variants.groupBy("key").agg(
        F.min(F.when(F.col("role") == 0, at)).alias("owner"), F.min(F.when(F.col("role") != 0, at)).alias("member")
    )
    groups = stage(groups, "lines-groups")
    partner = F.when(F.col("role") == 1, F.col("owner")).otherwise(F.col("member"))
    pairs = (
        variants.join(groups, "key")
        .withColumn("partner", partner)
        .where(F.col("partner") < at)
        .select(*PLACE, *[F.col("partner")[c].alias(f"p{c}") for c in PLACE])
        .distinct()
    )
    other = lines.select(*[F.col(c).alias(f"p{c}") for c in PLACE], F.col("t").alias("pt"))
    met = pairs.join(lines, PLACE).join(other, [f"p{c}" for c in PLACE])
    return met.where(F.levenshtein("t", "pt", 1) == 1).select(*PLACE).distinct()


def _with_a_window_in_common(lines: DataFrame) -> DataFrame:
    """PLACE of the lines that equal another outside one of the eighths: two lines within one edit do."""
    cut = [
        F.expr(f"xxhash64(left(t, {size} * {w} div 8), {w}, right(t, cast({size} - {size} * {w + 1} div 8 as int)), {size})")
        for size in ("n", "(n - 1)")
        for w in range(8)
    ]
    windows = lines.withColumn("n", F.length("t")).select(*PLACE, F.explode(F.array(*cut)).alias("k"))
    return windows.join(_met(windows, "k", "lines-windows"), "k").select(*PLACE).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", counts: bool = False, min_near: int = MIN_NEAR, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines kept; with counts also n_lines and n_removed (null for a null text)."""
    small_batches(docs.sparkSession)
    firsts = stage(first_lines(docs, id_col, min_near), "lines-first")
    kept = firsts.select(*PLACE).join(near_copies(docs, firsts, id_col, min_near), PLACE, "left_anti")
    lists = kept.groupBy("d", "x").agg(F.collect_list("pos").alias("kept"))
    joined = docs.select(F.struct("*").alias("row"), *_unit(id_col)).join(lists, ["d", "x"], "left")

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def rebuild(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for text, at in zip(texts, places, strict=True):
            if text is None:
                rows.append((None, None, None))
                continue
            lines, keep = text.split("\n"), set() if at is None else set(at)
            left = [t for i, t in enumerate(lines) if i in keep or not t.strip(BLANKS)]
            rows.append(("\n".join(left), len(lines), len(lines) - len(left)))
        out = pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])
        return out.astype({"n_lines": "Int32", "n_removed": "Int32"})

    rebuild = rebuild.asNondeterministic()  # run once, though a filter and the columns read it
    built = joined.withColumn("built", rebuild(F.col("row")["text"], F.col("kept")))
    if drop_emptied:
        blank = F.trim(F.col("built.text"), F.lit(BLANKS)) == ""
        built = built.where(~F.coalesce(blank & (F.col("built.n_removed") > 0), F.lit(False)))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("built.text").alias("text"))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("built.text"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row")[c].alias(c))
    if counts:
        columns += [F.col("built.n_lines").cast("long").alias("n_lines"), F.col("built.n_removed").cast("long").alias("n_removed")]
    return built.select(*columns)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


OP1_SQL = r"""
WITH x AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), l AS (
  SELECT doc_id, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM x
), f AS (
  SELECT t, length(t) AS n, min((doc_id, pos)) AS o FROM l WHERE t <> '' GROUP BY t
), e AS (SELECT * FROM f WHERE n >= 10
), same_half AS (
  SELECT a.t AS a, b.t AS b FROM e a JOIN e b ON a.n = b.n AND left(a.t, a.n // 2) = left(b.t, b.n // 2) AND b.o < a.o
  UNION SELECT a.t, b.t FROM e a JOIN e b ON a.n = b.n AND right(a.t, a.n - a.n // 2) = right(b.t, b.n - b.n // 2) AND b.o < a.o
  UNION SELECT a.t, b.t FROM e a JOIN e b ON a.n = b.n + 1 AND left(a.t, b.n // 2) = left(b.t, b.n // 2)
  UNION SELECT a.t, b.t FROM e a JOIN e b ON a.n = b.n + 1 AND right(a.t, b.n - b.n // 2) = right(b.t, b.n - b.n // 2)
), prefix AS (
  SELECT a, b, coalesce(list_sum(list_transform(range(1, length(b) + 1), lambda i: CASE WHEN left(a, i) = left(b, i) THEN 1 ELSE 0 END)), 0)::BIGINT AS p
  FROM same_half
), near AS (
  SELECT a, b FROM prefix WHERE right(a, length(a) - p - 1) = right(b, length(b) - p - CASE WHEN length(a) = length(b) THEN 1 ELSE 0 END)
), gone AS (
  SELECT DISTINCT CASE WHEN fa.o > fb.o THEN a ELSE b END AS t FROM near JOIN e fa ON fa.t = a JOIN e fb ON fb.t = b
), k AS (
  SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN f ON l.t = f.t LEFT JOIN gone ON gone.t = l.t
  WHERE l.t = '' OR (f.o = (l.doc_id, l.pos) AND gone.t IS NULL)
), r AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM k GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
       (len(string_split(d.text, chr(10))) - coalesce(r.n, 0))::BIGINT AS n_removed,
       length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END)::BIGINT AS n_chars,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
