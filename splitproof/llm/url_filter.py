"""URL filtering by a blocked Bloom filter and an exact hash join. DataFrame functions only.

Two lists of canonical URLs (a host and a path prefix) go into one blocked Bloom filter: rules, each with its
verdict, and plainly listed URLs, which are blocked. For each distinct url the canonical prefixes that could be
listed (each parent domain of the host with each path prefix that ends at a slash, and the whole path) are
probed against the filter; what passes goes to an exact hash join with the lists, which removes the false
positives. The longest rule that fits decides; where none fits, a listed URL that fits blocks.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict. An
empty path counts as ``/`` for listed URLs, not for rules. Of rules with equal host and path the smaller verdict
holds. Repeated rows each get their verdict. Empty lists leave the default for every url. Further columns of
``pages`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side

BITS_PER_ENTRY = 16
HASHES = 6  # bits set within a block
BROADCAST_ROWS = 200_000  # blocks or entries of at most some 60 bytes each


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; ASCII letters in lower case; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """A block is four longs; each key sets HASHES of its 256 bits."""
    bits = [F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(256)) for i in range(HASHES)]
    out = []
    for word in range(4):
        parts = [
            F.when(F.floor(b / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))).otherwise(
                F.lit(0).cast("long")
            )
            for b in bits
        ]
        acc = parts[0]
        for p in parts[1:]:
            acc = acc.bitwiseOR(p)
        out.append(acc)
    return out


def blocked_bloom(entries: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the non-empty blocks, and the number of blocks."""
    blocks = max(1, -(-rows * BITS_PER_ENTRY // 256))
    words = entries.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def filter_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule (host and path of the rule that fits, or null), verdict.

    ``rules``: host, path, verdict. ``listed``: host, path. An entry fits its host and all subdomains where the url's
    path starts with the entry's path, which ends in a slash or is a whole path.
    """
    both = rules.select("host", "path", "verdict").unionByName(listed.select("host", "path", F.lit(None).cast("string").alias("verdict")))
    entries = both.groupBy("host", "path").agg(
        F.min("verdict").alias("rule_verdict"), F.max(F.col("verdict").isNull()).alias("listed")
    )
    entries = entries.withColumn("key", F.concat("host", F.lit(" "), "path"))
    shape = entries.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", "[.]"))).alias("labels"),
        F.max(F.size(F.split("path", "/"))).alias("parts"),
    ).first()
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    rows = rows.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    bloom, blocks = blocked_bloom(entries, "key", shape["n"])
    # candidates no deeper than the deepest entry, so that a url of a thousand parts costs no more
    labels, parts = max(int(shape["labels"] or 0), 1), max(int(shape["parts"] or 0), 1)
    hosts = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), i -> substring_index(host, '.', -i))")
    prefixes = F.expr(
        "array_distinct(concat(array(path), if(path = '', array('/'), array()), transform(filter(sequence(1, "
        f"greatest(1, least(size(split(path, '/')) - 1, {parts}))), i -> i < size(split(path, '/'))), "
        "i -> concat(substring_index(path, '/', i), '/'))))"
    )
    candidates = (
        urls.withColumn("h", F.explode(hosts))
        .withColumn("p", F.explode(prefixes))
        .withColumn("key", F.concat("h", F.lit(" "), "p"))
        .withColumn("block", _block(F.col("key"), blocks))
    )
    possible = candidates.join(small_side(bloom, blocks, BROADCAST_ROWS), "block")
    for i, m in enumerate(_masks(F.col("key"))):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(m) == m)
    known = entries.select("key", "rule_verdict", "listed")
    fits_rule = F.col("rule_verdict").isNotNull() & ((F.col("p") != "/") | F.col("path").startswith("/"))
    exact = (
        possible.select("host", "path", "h", "p", "key")
        .join(small_side(known, shape["n"], BROADCAST_ROWS), "key")
        .groupBy("host", "path")
        .agg(
            F.max(F.when(fits_rule, F.struct(F.length("key").alias("n"), F.concat("h", "p").alias("rule"), "rule_verdict"))).alias("best"),
            F.max("listed").alias("listed"),
        )
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"), "listed")
    )
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")), F.lit(default))
    return rows.join(exact, ["host", "path"], "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The query's list of canonical URLs: sites of advertising, gambling, pornography, pill sellers and link farms.
LISTED = [
    (f"{site}.example.{top}", "/")
    for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]


def listing(spark, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A short list as a table of literals, made in the JVM."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listing(spark, RULES, ["host", "path", "verdict"]), listing(spark, LISTED, ["host", "path"]))


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, f, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), sites(h) AS (
  SELECT s || '.example.' || t FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(s),
         (VALUES ('com'), ('net'), ('org')) y(t)
), hit AS (
  SELECT DISTINCT host, path, h || f AS rule, v FROM p JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM hit GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, CASE WHEN EXISTS (
    SELECT 1 FROM sites WHERE p.host = h OR ends_with(p.host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
