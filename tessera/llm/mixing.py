"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells (source, language, topic) of tokens. Raking multiplies the cells, one
dimension after the other, until the mass of each source, each language and each topic is its target
share. A cell's mass over its tokens, relative to the largest such ratio, is the probability with which
each of its documents is sampled; a document's draw depends on its id and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

BLANKS = "[\\x20\\x09-\\x0D]+"
DIMENSIONS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Number of maximal runs outside white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def format_topic(text: Column) -> Column:
    """A stand-in where the table has no topic column: what the text looks like."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", "empty").when(whole.contains("$$$") | whole.contains("###"), "symbols").when(whole.contains("\n"), "lines").otherwise("prose")


def draw(id_: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from an id: 52 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to each value's tokens to a power: 1 keeps the mix, 0 levels it."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))
    return sums.select(dimension, (F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-13, sweeps: int = 12, rounds: int = 40) -> DataFrame:
    """cells (the dimensions, tokens > 0) with mass: shares that sum to 1 and fit all targets (value, share).

    The cells, one row per combination of values, are raked in one partition, so that no sweep shuffles.
    A value without a target gets no mass. Targets that the cells cannot meet end after sweeps * rounds
    sweeps, with the last dimension's target met exactly."""
    spread = cells
    for d, target in targets.items():
        wanted = target.select(F.col(target.columns[0]).alias(d), F.col("share").cast("double").alias(f"{d}_share"))
        spread = spread.join(wanted, d, "left").fillna(0.0, [f"{d}_share"])
    fitted = common.keep(spread.withColumn("mass", F.col("tokens").cast("double") / F.sum("tokens").over(Window.partitionBy())).coalesce(1)).coalesce(1)
    for _ in range(rounds):
        for _ in range(sweeps):
            for d in targets:
                total = F.sum("mass").over(Window.partitionBy(d))
                fitted = fitted.withColumn("mass", F.when(total > 0, F.col("mass") * F.col(f"{d}_share") / total).otherwise(0.0))
        fitted = common.keep(fitted).coalesce(1)
        off = fitted
        for d in targets:
            off = off.withColumn(f"{d}_gap", F.abs(F.sum("mass").over(Window.partitionBy(d)) - F.col(f"{d}_share")))
        if (off.agg(F.max(F.greatest(*[f"{d}_gap" for d in targets], F.lit(0.0)))).first()[0] or 0.0) <= tolerance:
            break
    return fitted.select(*targets, "tokens", "mass")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: tuple[float, float, float] = (0.7, 0.7, 0.9), seed: int = 0, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, carried: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all of them by default) with mix_source, mix_lang, mix_topic, n_tokens,
    probability and sampled; columns of docs with one of these names are left out.

    Null sources and languages are the value "unknown". Texts without tokens (null ones too) carry no
    mass: probability 0, never sampled. Without targets each dimension is tempered by its power. Rows that
    repeat an id share its draw. The largest probability is 1, so expected token shares are the targets'."""
    out, mine = _mixed(docs, targets, powers, seed, id_col, text_col, topic, docs.columns if carried is None else carried)
    return out.drop(*[name for name in mine if name in out.columns and mine[name] != name]).withColumnsRenamed({own: name for name, own in mine.items()})


def _mixed(docs, targets, powers, seed, id_col, text_col, topic, carried) -> tuple[DataFrame, dict[str, str]]:
    """(carried columns and ours, under names that docs does not have, and those names)."""
    mine = {}
    for name in (*(f"mix_{d}" for d in DIMENSIONS), "n_tokens", "probability", "sampled"):
        own = name
        while own in docs.columns:
            own = f"_{own}"
        mine[name] = own
    text = F.col(text_col)
    values = [F.coalesce(F.col("source").cast("string"), F.lit("unknown")), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), format_topic(text) if topic is None else topic]
    keys = [mine[f"mix_{d}"] for d in DIMENSIONS]
    told = docs.select(*[F.col(f"`{c}`") for c in carried], *[v.alias(k) for v, k in zip(values, keys)], token_count(text).alias(mine["n_tokens"]), draw(F.col(id_col), seed).alias(mine["sampled"]))
    if text_col not in carried:
        told = common.keep(told)  # without the texts: they are read once
    tokens = F.col(mine["n_tokens"])
    cells = told.where(tokens > 0).groupBy(*[F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS)]).agg(F.sum(tokens).alias("tokens"))
    cells = common.keep(cells.coalesce(1))
    wanted = targets or {d: tempered(cells, d, p) for d, p in zip(DIMENSIONS, powers)}
    rate = rake(cells, wanted).withColumn("rate", F.col("mass") / F.col("tokens"))
    share = F.coalesce(F.col("rate") / F.nullif(F.max("rate").over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0))
    rate = common.keep(rate.select(*[F.col(d).alias(k) for k, d in zip(keys, DIMENSIONS)], share.alias(mine["probability"])))
    probability = F.when(tokens > 0, F.coalesce(F.col(mine["probability"]), F.lit(0.0))).otherwise(0.0)
    joined = told.join(rate, keys, "left").withColumn(mine["probability"], probability)
    joined = joined.withColumn(mine["sampled"], F.col(mine["sampled"]) < F.col(mine["probability"]))
    return joined.select(*carried, *mine.values()), mine


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: tuple[float, float, float] = (0.7, 0.7, 0.9), seed: int = 0, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """The sampled rows, with the columns of docs, whatever their names."""
    out, mine = _mixed(docs, targets, powers, seed, id_col, text_col, topic, docs.columns)
    return out.where(F.col(mine["sampled"])).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, source, lang, topic, n_tokens, probability (8 digits), sampled."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), carried=["doc_id"])
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), "n_tokens", F.round("probability", 8).alias("probability"), "sampled")


OP7_SQL = """
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, '$$$') OR contains(text, '###') THEN 'symbols' WHEN contains(text, chr(10)) THEN 'lines' ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM told WHERE n_tokens > 0 GROUP BY ALL),
s AS (SELECT source, pow(sum(tokens), 0.7) AS m FROM cells GROUP BY ALL), l AS (SELECT lang, pow(sum(tokens), 0.7) AS m FROM cells GROUP BY ALL), t AS (SELECT topic, pow(sum(tokens), 0.9) AS m FROM cells GROUP BY ALL),
wanted AS (SELECT cells.*, s.m / (SELECT sum(m) FROM s) AS ws, l.m / (SELECT sum(m) FROM l) AS wl, t.m / (SELECT sum(m) FROM t) AS wt FROM cells JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
fit AS (
  SELECT 0 AS k, source, lang, topic, tokens, ws, wl, wt, tokens AS mass FROM wanted
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, ws, wl, wt, mass * wt / sum(mass) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (mass * wl / sum(mass) OVER (PARTITION BY lang) AS mass) FROM (
      SELECT * REPLACE (mass * ws / sum(mass) OVER (PARTITION BY source) AS mass) FROM fit WHERE k < 120))),
rate AS (SELECT source, lang, topic, mass / tokens / max(mass / tokens) OVER () AS p FROM fit WHERE k = 120)
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END, 8) AS probability,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/0'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS sampled
FROM told LEFT JOIN rate USING (source, lang, topic)
"""
