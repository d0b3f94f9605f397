"""URL filters: a blocked Bloom filter of listed canonical keys, then an exact hash join.

A rule (host, path, verdict) fits its host, all subdomains, and every path that starts with its path. The
shapes of the rules (number of host labels, length of the path) tell which keys of a URL could be listed,
so a URL is looked up under a few keys and never compared with all rules. Distinct keys are tested against
a filter of 512-bit blocks, one bit in each of a block's eight words; possible hits go to an exact join
with the list, which removes false positives. Everything is native: no Python on the data's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 19  # 64 bytes each: 32 MB at most are broadcast
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")


def _bit(word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 6 * word).bitwiseAND(63).cast("int")


def bloom_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) over the column key, and the number of blocks."""
    blocks = max(1, -(-count * BITS_PER_KEY // 512))
    words = [F.expr(f"bit_or(shiftleft(1L, b{w}))").alias(f"w{w}") for w in range(8)]
    return keys.select(_block(blocks), *[_bit(w).alias(f"b{w}") for w in range(8)]).groupBy("block").agg(*words), blocks


def possible(keys: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The keys that the filter may hold. The filter is broadcast while it has a proven size, and joined by block beyond."""
    side = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    test = None
    for w in range(8):
        hit = F.shiftrightunsigned(F.col(f"w{w}"), 0).bitwiseAND(F.expr(f"shiftleft(1L, b{w})")) != 0
        test = hit if test is None else test & hit
    return keys.select("key", _block(blocks), *[_bit(w).alias(f"b{w}") for w in range(8)]).join(side, "block").where(test).select("key")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    rules: (host, path, verdict); of the rules that fit the longest (host and path together, then the
    longer host) decides; of equal rules with both verdicts allow wins; null hosts and verdicts are left
    out, a null path is empty. listed: (url); without a fitting rule a URL is blocked when its host and path
    are those of a listed URL, else allowed. Null or malformed URLs have empty host and path. Other
    columns of pages are not read."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    ruled = rules.where("host is not null and verdict is not null").select(F.translate(F.col("host"), UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "verdict")
    ruled = ruled.groupBy("rh", "rp").agg(F.min("verdict").alias("verdict")).select(F.concat("rh", "rp").alias("key"), F.struct(F.length("rh") + F.length("rp"), F.length("rh"), F.concat("rh", "rp").alias("rule"), "verdict").alias("found"), F.size(F.split("rh", "\\.")).alias("labels"), F.length("rp").alias("chars"))
    ruled = common.keep(ruled)
    shapes = [(r.labels, r.chars) for r in ruled.select("labels", "chars").distinct().collect()]
    keys = ruled.select("key", "found")
    if listed is not None:
        lh, lp = host_and_path(F.col("url"))
        exact = listed.where("url is not null").select(F.concat(lh, lp, F.lit("#")).alias("key")).distinct()
        keys = keys.union(exact.select("key", F.struct(F.lit(-1), F.lit(-1), F.lit(None).cast("string"), F.lit("block"))))
    keys = common.keep(keys)
    count = keys.count()
    filter_, blocks = bloom_filter(keys, count)

    labels = F.split("host", "\\.")
    candidates = [F.when((F.size(labels) >= n) & (F.length("path") >= p), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, p))) for n, p in shapes]
    candidates.append(F.concat("host", "path", F.lit("#")))
    distinct = common.keep(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")))
    asked = distinct.select("host", "path", F.explode(F.array_distinct(F.array_compact(F.array(*candidates)))).alias("key"))
    maybe = possible(asked.select("key").distinct(), filter_, blocks)
    hits = maybe.join(F.broadcast(keys) if count <= BROADCAST_RULES else keys, "key")
    best = asked.join(F.broadcast(hits) if count <= BROADCAST_RULES else hits, "key").groupBy("host", "path").agg(F.max("found").alias("found"))
    told = common.keep(distinct.join(best, ["host", "path"], "left"))
    judged = common.join_hot(own, told, ["host", "path"], "rows", told.agg(F.sum("rows")).first()[0] or 0)
    return judged.select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))


#: The rules of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """pages under RULES: page_id, host, path, rule, verdict."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP3_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM own) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, own.host, own.path, fits.rule, coalesce(fits.v, 'allow') AS verdict
FROM own LEFT JOIN fits ON own.host = fits.host AND own.path = fits.path AND fits.k = 1
"""
