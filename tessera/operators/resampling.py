"""Bootstrap and block permutations as relational plans: draws are hashes of what they are for.

A draw is a column of (seed, label, replicate, block), so it is the same on every partition, after a lost executor
and in any engine that knows MD5, and a resample is a join. What is drawn from is already aggregated: one row per
origin of a series, or per block of days, never a cell of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*key) -> Column:
    """An integer in [0, 2^32), evenly spread over keys: the first eight digits of the MD5 of the key's parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def block_means(rows: DataFrame, value: str, order: str, block: int, by: list[str], repetitions: int = 2000, seed: int = 20260805, alike: str = "label") -> DataFrame:
    """(by, replicate, n, mean): means of circular-block resamples of each series of by, in the order of order.

    A resample of n values is ceil(n / block) blocks that begin at draws of (seed, alike, replicate, number of the
    block) modulo n and go on at the first value after the last; the last block is cut to fit. Series of one alike
    and one length share their draws, so that their means can be compared. Null values are left out before
    anything is numbered. A block is a difference of running sums, so a resample costs its blocks, not its values."""
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(order).alias("_o_"), F.col(value).cast("double").alias("_v_"))
    series = Window.partitionBy(*by)
    # centred first: running sums then stay near zero, and the mean comes back at the end
    numbered = clean.withColumns({"n": F.count(F.lit(1)).over(series), "_m_": F.avg("_v_").over(series), "_i_": F.row_number().over(series.orderBy("_o_"))})
    upto = F.sum(F.col("_v_") - F.col("_m_")).over(series.orderBy("_i_").rowsBetween(Window.unboundedPreceding, 0))
    sums = numbered.select(*by, "n", "_m_", F.col("_i_").cast("long").alias("_i_"), upto.alias("_s_"))
    sums = sums.unionByName(sums.where("_i_ = 1").withColumns({"_i_": F.lit(0).cast("long"), "_s_": F.lit(0.0)}))
    wide = F.least(F.lit(block), F.col("n"))
    lengths = sums.where("_i_ = 0").select(alike, "n").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    blocks = lengths.withColumn("_b_", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / wide).cast("int") - 1)))
    begin = F.pmod(draw(seed, F.col(alike), F.col("replicate"), F.col("_b_")), F.col("n"))
    blocks = blocks.withColumns({"_from_": begin, "_len_": F.least(wide, F.col("n") - F.col("_b_") * wide)})
    # each end of a block is a place whose running sum is added or taken away; past the end it goes on at the first
    end = F.col("_from_") + F.col("_len_")
    ends = blocks.select(alike, "n", "replicate", F.explode(F.array(F.struct(F.col("_from_").alias("_i_"), F.lit(-1.0).alias("_w_")), F.struct(F.when(end > F.col("n"), end - F.col("n")).otherwise(end).alias("_i_"), F.lit(1.0).alias("_w_")))).alias("e"))
    ends = ends.select(alike, "n", "replicate", "e.*")
    told = sums.join(ends, [alike, "n", "_i_"]).groupBy(*by, "replicate").agg(F.first("n").alias("n"), (F.first("_m_") + F.sum(F.col("_w_") * F.col("_s_")) / F.first("n")).alias("mean"))
    return told


def block_intervals(rows: DataFrame, value: str, order: str, block: int, by: list[str], repetitions: int = 2000, seed: int = 20260805, alike: str = "label", quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(by, n, block_length_origins, blocks_effective, mean, ci_low, ci_high, excludes_zero) of each series: see
    block_means. Under two blocks the resamples are rotations, the interval has no width and excludes nothing."""
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    plain = clean.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg(value).alias("mean"))
    q = lambda p: F.expr(f"percentile(mean, {p})")
    told = block_means(rows, value, order, block, by, repetitions, seed, alike).groupBy(*by).agg(q(quantiles[0]).alias("ci_low"), q(quantiles[1]).alias("ci_high"))
    wide = F.least(F.lit(block), F.col("n"))
    out = plain.join(told, by).withColumns({"block_length_origins": wide.cast("int"), "blocks_effective": F.col("n") / wide})
    return out.withColumn("excludes_zero", (F.col("blocks_effective") >= 2) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0))).select(*by, "n", "block_length_origins", "blocks_effective", "mean", "ci_low", "ci_high", "excludes_zero")


def exchanged_days(levels: DataFrame, replicates: DataFrame, block: int, bins: int = 1, tail: str = "fixed", seed: int = 7) -> DataFrame:
    """(label, replicate, t, source): replicate's day t is day source of levels (label, t, level).

    Blocks of block days change places, days inside a block stay in order; replicate 0 is every day in its place. With
    bins above 1 whole blocks are cut into as many strata by their mean level (to 12 digits; ntile, the earlier of equal ones
    first) and change places within their stratum only. The short last block stays where it is, or, with tail "free"
    and one stratum, moves with the others. Two row numbers make a permutation: the places of a stratum by time, its
    blocks by draws of (seed, label, replicate, block). replicates: (label, replicate)."""
    if tail not in ("fixed", "free") or tail == "free" and bins > 1:
        raise ValueError("the tail is fixed, or free in one stratum")
    whole = levels.withColumn("b", F.floor(F.col("t") / block)).groupBy("label", "b").agg(F.round(F.avg("level"), 12).alias("level"), F.count(F.lit(1)).alias("days"))
    own = whole.withColumn("part", (F.col("days") < block).cast("int") if tail == "fixed" else F.lit(0))
    # ntile over the whole blocks only: the short one is a stratum by itself
    own = own.withColumn("part", F.when(F.col("part") == 1, 0).otherwise(F.ntile(bins).over(Window.partitionBy("label", "part").orderBy("level", "b"))))
    drawn = own.join(replicates.where("replicate > 0"), "label")
    stratum = Window.partitionBy("label", "replicate", "part")
    drawn = drawn.withColumn("rank", F.row_number().over(stratum.orderBy(draw(seed, F.col("label"), F.col("replicate"), F.col("b")), "b")))
    if tail == "free":  # blocks of two lengths: days are counted in the new order
        before = F.sum("days").over(Window.partitionBy("label", "replicate").orderBy("rank")) - F.col("days")
        placed = drawn.select("label", "replicate", F.col("b").alias("source_block"), before.alias("begin"), "days")
    else:
        slots = drawn.select("label", "replicate", "part", "days", (F.col("b") * block).alias("begin"), F.row_number().over(stratum.orderBy("b")).alias("rank"))
        placed = slots.join(drawn.select("label", "replicate", "part", "rank", F.col("b").alias("source_block")), ["label", "replicate", "part", "rank"])
    k = F.explode(F.sequence(F.lit(0), F.col("days").cast("int") - 1)).alias("k")
    moved = placed.select("label", "replicate", "begin", "source_block", k).select("label", "replicate", (F.col("begin") + F.col("k")).cast("int").alias("t"), (F.col("source_block") * block + F.col("k")).cast("int").alias("source"))
    still = levels.join(replicates.where("replicate = 0"), "label").select("label", "replicate", F.col("t").cast("int").alias("t"), F.col("t").cast("int").alias("source"))
    return moved.unionByName(still)
