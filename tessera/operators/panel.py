"""Long-format price panels: cleaning, returns, coverage and panel diagnostics, all native.

A price table is (label, name, day, price); a return table is (label, name, day, x). One label is one
panel, so every operator works on all panels of a table at once and partitions by (label, name). Missing
is NULL, never NaN: Spark orders NaN above every number and treats it as equal to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share-split ratios that a price step may show, by name.
SPLIT_RATIOS = [
    ("21:20", 1.05), ("11:10", 1.1), ("6:5", 1.2), ("5:4", 1.25), ("4:3", 4 / 3), ("7:5", 1.4), ("3:2", 1.5), ("5:3", 5 / 3), ("9:5", 1.8),
    ("7:4", 7 / 4), ("2:1", 2.0), ("5:2", 5 / 2), ("3:1", 3.0), ("7:2", 7 / 2), ("4:1", 4.0), ("5:1", 5.0), ("6:1", 6.0), ("7:1", 7.0), ("8:1", 8.0),
    ("10:1", 10.0), ("12:1", 12.0), ("15:1", 15.0), ("20:1", 20.0), ("25:1", 25.0), ("50:1", 50.0), ("100:1", 100.0), ("1000:1", 1000.0),
]
DEFECTS = ("split", "spike")


def _series() -> Window:
    return Window.partitionBy("label", "name").orderBy("day")


def dense_grid(prices: DataFrame) -> DataFrame:
    """Every name on every day of its label; price is NULL where the table has none. Names and days are
    the label's distinct ones, so the join is by label and its size is the panel's."""
    days = prices.select("label", "day").distinct()
    names = prices.select("label", "name").distinct()
    return names.join(days, "label").join(prices.select("label", "name", "day", "price"), ["label", "name", "day"], "left")


def forward_fill(prices: DataFrame, limit: int = 3) -> DataFrame:
    """Fill a missing price by the last one of at most limit rows before."""
    before = F.last("price", ignorenulls=True).over(_series().rowsBetween(-limit, 0))
    return prices.withColumn("price", before)


def require_positive(prices: DataFrame) -> DataFrame:
    """Fail the query on a price that has no logarithm."""
    return prices.withColumn("price", F.when(F.col("price") <= 0, F.raise_error(F.lit("prices must be positive")).cast("double")).otherwise(F.col("price")))


def log_returns(prices: DataFrame) -> DataFrame:
    """x = ln price - ln price of the row before; the label's first day goes, gaps are NULL."""
    first = prices.groupBy("label").agg(F.min("day").alias("first"))
    x = F.ln("price") - F.ln(F.lag("price").over(_series()))
    return prices.select("label", "name", "day", x.alias("x")).join(first, "label").where("day > first").drop("first")


def split_ratio(x: Column, tolerance: float = 2e-4) -> Column:
    """The first split ratio that exp(|x|) matches within a relative tolerance, else NULL."""
    level = F.exp(F.abs(x))
    return F.coalesce(*[F.when(F.abs(level - v) < tolerance * v, F.lit(name)) for name, v in SPLIT_RATIOS])


def price_breaks(prices: DataFrame, threshold: float = 0.4, window: int = 10, step: float = 0.15) -> DataFrame:
    """(label, name, day, log_return, level_ratio, kind, split_ratio) of every |log return| > threshold.

    The level before is the median of the rows from window + 1 to 2 back (the row just before is left
    out), the level after that of the next window rows. No level before: series_start; none after:
    series_end; levels that agree: spike; a split ratio: split; else large_move."""
    positive = F.when(F.col("price") > 0, F.col("price"))
    wide = prices.withColumn("x", F.ln(positive) - F.ln(F.lag(positive).over(_series())))
    low = F.expr("percentile(price, 0.5)").over(_series().rowsBetween(-window - 1, -2))
    high = F.expr("percentile(price, 0.5)").over(_series().rowsBetween(1, window))
    told = wide.withColumn("low", low).withColumn("high", high).where(F.abs("x") > threshold)
    edge = F.col("low").isNull() | F.col("high").isNull() | (F.col("high") == 0)
    ratio = F.when(~edge, F.col("low") / F.col("high"))
    named = split_ratio(F.col("x"))
    kind = F.when(F.col("low").isNull(), "series_start").when(edge, "series_end").when(F.abs(F.ln(ratio)) < step, "spike").when(named.isNotNull(), "split").otherwise("large_move")
    return told.select("label", "name", "day", F.col("x").alias("log_return"), ratio.alias("level_ratio"), kind.alias("kind"), F.coalesce(named, F.lit("")).alias("split_ratio"))


def null_defects(returns: DataFrame, breaks: DataFrame) -> DataFrame:
    """returns with NULL on the days of splits and spikes."""
    bad = breaks.where(F.col("kind").isin(*DEFECTS)).select("label", "name", "day", F.lit(True).alias("bad")).distinct()
    return returns.join(bad, ["label", "name", "day"], "left").withColumn("x", F.when(F.col("bad").isNull(), F.col("x"))).drop("bad")


def unreliable_names(breaks: DataFrame, most_defects: int = 4, most_moves: int = 20) -> DataFrame:
    """(label, name, defects, moves) of names with too many of either, the worst first when ordered by rank."""
    counts = breaks.groupBy("label", "name").agg(F.count_if(F.col("kind").isin(*DEFECTS)).alias("defects"), F.count_if(F.col("kind") == "large_move").alias("moves"))
    worst = Window.partitionBy("label").orderBy(F.desc(F.col("defects") + F.col("moves")), "name")
    return counts.where((F.col("defects") > most_defects) | (F.col("moves") > most_moves)).withColumn("rank", F.row_number().over(worst))


def stale_runs(returns: DataFrame) -> DataFrame:
    """(label, name, longest_stale_run): rows in a row whose return is zero; NULL counts as zero."""
    still = F.coalesce(F.col("x"), F.lit(0.0)) == 0
    islands = returns.withColumn("island", F.sum(F.when(still, 0).otherwise(1)).over(_series())).withColumn("still", still)
    return islands.groupBy("label", "name", "island").agg(F.count_if("still").alias("run")).groupBy("label", "name").agg(F.max("run").alias("longest_stale_run"))


def coverage_report(returns: DataFrame, least: float = 0.98, most_stale: int = 10, most_zero: float = 0.1) -> DataFrame:
    """(label, name, coverage, zero_fraction, longest_stale_run, dropped_because): the first reason of
    coverage, stale run, zero share; NULL for names that stay."""
    zero = F.coalesce(F.col("x"), F.lit(0.0)) == 0
    shares = returns.groupBy("label", "name").agg((F.count("x") / F.count(F.lit(1))).alias("coverage"), (F.count_if(zero) / F.count(F.lit(1))).alias("zero_fraction"))
    reason = F.when(F.col("coverage") < least, "coverage").when(F.col("longest_stale_run") > most_stale, "stale run").when(F.col("zero_fraction") > most_zero, "zero returns")
    return shares.join(stale_runs(returns), ["label", "name"]).withColumn("dropped_because", reason)


def complete_days(returns: DataFrame) -> DataFrame:
    """Only days on which every name has a return, numbered t = 0, 1, ... within the label."""
    day = Window.partitionBy("label", "day")
    full = returns.withColumn("holes", F.count_if(F.col("x").isNull()).over(day)).where("holes = 0").drop("holes")
    days = full.select("label", "day").distinct().withColumn("t", (F.row_number().over(Window.partitionBy("label").orderBy("day")) - 1).cast("int"))
    return full.join(days, ["label", "day"])


def clean_returns(prices: DataFrame, fill: int = 3, threshold: float = 0.4, **thresholds) -> DataFrame:
    """(label, name, day, x, t): prices to a complete panel. Breaks are found on the prices as given,
    returns come from filled ones; names that are unreliable or fail the coverage report go, then days
    with a hole."""
    grid = dense_grid(prices)
    breaks = price_breaks(grid, threshold)
    gone = unreliable_names(breaks).select("label", "name")
    returns = log_returns(require_positive(forward_fill(grid, fill))).join(gone, ["label", "name"], "left_anti")
    returns = null_defects(returns, breaks)
    kept = coverage_report(returns, **thresholds).where("dropped_because is null").select("label", "name")
    return complete_days(returns.join(kept, ["label", "name"], "left_semi"))


def variance_path(panel: DataFrame, window: int = 1) -> DataFrame:
    """(label, t, level): the day's mean square over names. A window above 1 is a centred moving average
    over reflected ends; it reads later days and is only for description."""
    daily = panel.groupBy("label", "t").agg(F.avg(F.col("x") * F.col("x")).alias("level"))
    if window == 1:
        return daily
    pad = window // 2
    told = daily.join(daily.groupBy("label").agg((F.max("t") + 1).alias("size")), "label")
    left = told.where(F.col("t") < pad).withColumn("t", -1 - F.col("t"))
    right = told.where(F.col("t") >= F.col("size") - pad).withColumn("t", 2 * F.col("size") - 1 - F.col("t"))
    ordered = Window.partitionBy("label").orderBy("t").rowsBetween(-pad, window - 1 - pad)
    smooth = told.unionByName(left).unionByName(right).withColumn("level", F.sum("level").over(ordered) / window)
    return smooth.where("t >= 0 and t < size").select("label", "t", "level")


def cv_squared(panel: DataFrame, window: int = 1) -> DataFrame:
    """(label, cv2): relative variance of the variance path."""
    level = F.col("level")
    return variance_path(panel, window).groupBy("label").agg((F.try_divide(F.avg(level * level), F.avg(level) * F.avg(level)) - 1).alias("cv2"))


def standardise_days(panel: DataFrame, window: int = 1) -> DataFrame:
    """panel with each day divided by the root of its level relative to the mean positive level; days of level zero stay."""
    path = variance_path(panel, window)
    mean = path.where("level > 0").groupBy("label").agg(F.avg("level").alias("mean_level"))
    scale = path.join(mean, "label", "left").select("label", "t", F.when(F.col("level") > 0, F.col("level") / F.col("mean_level")).otherwise(1.0).alias("scale"))
    return panel.join(scale, ["label", "t"]).withColumn("x", F.col("x") / F.sqrt("scale")).drop("scale")


def unit_variance(panel: DataFrame) -> DataFrame:
    """panel with each name divided by its sample deviation; fails on a constant name."""
    sd = F.stddev_samp("x").over(Window.partitionBy("label", "name"))
    checked = F.when(sd > 0, sd).otherwise(F.raise_error(F.lit("a name has zero variance")).cast("double"))
    return panel.withColumn("x", F.col("x") / checked)


def worst_outliers(panel: DataFrame, k: int = 5) -> DataFrame:
    """The k cells with the largest |x - mean| / sd of their name, per label."""
    name = Window.partitionBy("label", "name")
    scored = panel.withColumn("sd", F.abs(F.col("x") - F.avg("x").over(name)) / F.stddev_samp("x").over(name))
    worst = [F.desc("sd"), "name", "t"]
    ranked = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*worst))).where(F.col("rank") <= k)
    # k a name at most, so that the label's window sees few rows
    return ranked(ranked(scored, "label", "name"), "label").select("label", "name", "t", "sd", "x", "rank")


def panel_report(panel: DataFrame, periods: int = 252) -> DataFrame:
    """One row per label: names, days, their ratio, kurtosis (fourth moment over squared sample variance),
    zero share, CV2 and the median annualised deviation."""
    moments = panel.withColumn("z", F.col("x") - F.avg("x").over(Window.partitionBy("label", "name"))).groupBy("label", "name").agg(
        F.stddev_samp("z").alias("sd"), F.try_divide(F.avg(F.pow("z", F.lit(4))), F.pow(F.stddev_samp("z"), F.lit(4))).alias("kurtosis"), F.count(F.lit(1)).alias("days"), F.count_if(F.col("x") == 0).alias("zeros"))
    half = lambda c: F.expr(f"percentile({c}, 0.5)")
    wide = moments.groupBy("label").agg(F.count(F.lit(1)).alias("n_names"), F.max("days").alias("n_days"), half("kurtosis").alias("kurtosis_median"), F.max("kurtosis").alias("kurtosis_max"), (F.sum("zeros") / F.sum("days")).alias("zero_fraction"), (half("sd") * F.sqrt(F.lit(float(periods)))).alias("annualised_vol_median"))
    return wide.join(cv_squared(panel), "label").withColumn("q", F.col("n_names") / F.col("n_days")).withColumn("excess_kurtosis_median", F.col("kurtosis_median") - 3)


def rv_autocorrelation(panel: DataFrame, scales: tuple[int, ...] = (5, 10, 21)) -> DataFrame:
    """(label, scale, n_blocks, autocorrelation): lag-1 correlation of the log realised variance of whole blocks."""
    spread = panel.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn("block", F.floor(F.col("t") / F.col("scale")))
    ends = panel.groupBy("label").agg((F.max("t") + 1).alias("days"))
    blocks = spread.join(ends, "label").where(F.col("block") < F.floor(F.col("days") / F.col("scale"))).groupBy("label", "scale", "block").agg(F.ln(F.avg(F.col("x") * F.col("x"))).alias("v"))
    lagged = blocks.withColumn("before", F.lag("v").over(Window.partitionBy("label", "scale").orderBy("block")))
    return lagged.groupBy("label", "scale").agg(F.count(F.lit(1)).alias("n_blocks"), F.corr("v", "before").alias("autocorrelation"))
