"""Relational summaries of result tables: distributions, paired comparisons, p-values, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, linear quartiles, sample deviation and maximum of value."""
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.stddev_samp(value).alias("sd"), F.max(value).alias("max"))


def nearest_quantile(value: str, p: float) -> Column:
    """The order statistic nearest to p (n - 1), ties to the even one; NULLs are left out."""
    held = F.sort_array(F.collect_list(value))
    return F.element_at(held, F.bround(F.lit(p) * (F.count(value) - 1)).cast("int") + 1)


def nonoverlapping(windows: DataFrame) -> DataFrame:
    """(label, split, n_nonoverlap): windows taken greedily by their last day, none before the last one ended.

    A fold over the ordered windows of a split; a split holds one row per origin."""
    ordered = F.sort_array(F.collect_list(F.struct("target_day", "target_first_day")))
    taken = F.aggregate(ordered, F.struct(F.lit(None).cast("date").alias("last"), F.lit(0).alias("n")), lambda a, w: F.when(a["last"].isNull() | (F.to_date(w["target_first_day"]) > a["last"]), F.struct(F.to_date(w["target_day"]).alias("last"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    return windows.groupBy("label", "split").agg(taken.alias("n_nonoverlap"))


def paired(model: DataFrame, reference: DataFrame, keys: list[str], value: str, by: list[str], lower_is_better: bool) -> DataFrame:
    """Means, relative skill, improvement and win share of a model over a reference, joined one to one."""
    both = model.select(*keys, F.col(value).alias("m")).join(reference.select(*keys, F.col(value).alias("r")), keys)
    gain = F.col("r") - F.col("m") if lower_is_better else F.col("m") - F.col("r")
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    both = both.withColumn("gain", F.when(twice == 1, gain).otherwise(F.raise_error(F.lit("keys are not unique")).cast("double")))
    scale = F.greatest(F.avg("r"), F.lit(2.2250738585072014e-308))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("model_mean"), F.avg("r").alias("reference_mean"), F.avg("gain").alias("paired_improvement"), F.avg((F.col("gain") > 0).cast("int")).alias("win_fraction"), (100 * F.avg("gain") / scale).alias("skill_percent"))


def combine_panels(comparisons: DataFrame, by: str = "component") -> DataFrame:
    """Skill over panels: mean, median, worst, best and how many improved."""
    s = "skill_percent"
    return comparisons.groupBy(by).agg(F.avg(s).alias("combined"), F.expr(f"percentile({s}, 0.5)").alias("median"), F.min(s).alias("worst"), F.max(s).alias("best"), F.count_if(F.col(s) > 0).alias("panels_improved"), F.count(F.lit(1)).alias("n_panels"))


def empirical_p(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """observed with null_mean, null_q95, n_null and p = (1 + draws as large) / (draws + 1); NULL and NaN draws do not count."""
    draws = null.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("draw"))
    both = observed.join(draws, keys, "left")
    return both.groupBy(*keys, value).agg(F.avg("draw").alias("null_mean"), F.expr("percentile(draw, 0.95)").alias("null_q95"), F.count("draw").alias("n_null"), ((1 + F.count_if(F.col("draw") >= F.col(value))) / (1 + F.count("draw"))).alias("p"))


def holm(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """rows with holm: step-down adjusted p within by; NULL stays NULL."""
    family = Window.partitionBy(*by)
    rank = F.row_number().over(family.orderBy(F.col(p).asc_nulls_last(), *[c for c in rows.columns if c not in (*by, p)]))
    step = rows.withColumn("_rank_", rank).withColumn("_n_", F.count(p).over(family))
    running = F.max((F.col("_n_") - F.col("_rank_") + 1) * F.col(p)).over(family.orderBy("_rank_").rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("_rank_", "_n_")


def leaderboard(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(label, metric, estimator, n, mean, median, q25, q75, rank) from one column a metric; rank 1 is least, ties share it."""
    long = scores.unpivot(keys, metrics, "metric", "score").where(F.col("score").isNotNull() & ~F.isnan("score"))
    table = long.groupBy("label", "metric", "estimator").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.expr("percentile(score, 0.5)").alias("median"), nearest_quantile("score", 0.25).alias("q25"), nearest_quantile("score", 0.75).alias("q75"))
    return table.withColumn("rank", F.rank().over(Window.partitionBy("label", "metric").orderBy("mean")))


def ranks_wide(board: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per label and estimator, one rank column a metric."""
    return board.groupBy("label", "estimator").pivot("metric", metrics).agg(F.avg("rank"))


def winners(board: DataFrame) -> DataFrame:
    return board.groupBy("label", "metric").agg(F.min_by("estimator", F.struct("mean", "estimator")).alias("winner"), F.min("mean").alias("mean"))


def choose(grid: DataFrame, by: list[str], loss: str, value: str) -> DataFrame:
    """The value of least loss, ties to the smaller value."""
    return grid.groupBy(*by).agg(F.min_by(value, F.struct(loss, value)).alias(value), F.min(loss).alias(loss))


def choose_on_validation(losses: DataFrame, by: list[str], value: str, loss: str) -> DataFrame:
    """(by, value, validation_loss, n_validation, test_loss, n_test, selected) from rows with a split: the value of
    least mean validation loss is selected, ties to the smaller one. Fails where a group has no validation row."""
    part = lambda s: F.when(F.col("split") == s, F.col(loss))
    table = losses.groupBy(*by, value).agg(F.avg(part("validation")).alias("validation_loss"), F.count(part("validation")).alias("n_validation"), F.avg(part("test")).alias("test_loss"), F.count(part("test")).alias("n_test"))
    checked = F.when(F.col("n_validation") > 0, F.col("validation_loss")).otherwise(F.raise_error(F.lit("the validation split is empty")).cast("double"))
    table = table.withColumn("validation_loss", checked)
    best = choose(table, by, "validation_loss", value).select(*by, F.col(value).alias("best"))
    return table.join(best, by).withColumn("selected", F.col(value) == F.col("best")).drop("best")


def causal_z(value: str, order: Window, least: int = 20) -> Column:
    """A value's z-score among strictly earlier rows; 0 before there are least of them, or where they are all equal."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sd = F.stddev_samp(value).over(before)
    return F.when((F.count(value).over(before) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(before)) / sd).otherwise(0.0)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order; rows that two writers added come once."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_first_", first).where("_first_ = 1").drop("_first_")


def value_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, share), how often each combination occurs."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def example_sets(scores: DataFrame, name: str, example: str) -> DataFrame:
    """(label, name, n, expected, complete): whether each estimator of a label has exactly the label's examples."""
    ids = scores.select("label", name, example).distinct()
    whole = ids.groupBy("label").agg(F.count_distinct(example).alias("expected"))
    return ids.groupBy("label", name).agg(F.count(F.lit(1)).alias("n")).join(whole, "label").withColumn("complete", F.col("n") == F.col("expected"))


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that both tables have."""
    return left.select(*keys).intersect(right.select(*keys))


def first_crossing(curve: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """Where y, linear between neighbours in x, first reaches level."""
    order = Window.partitionBy(*by).orderBy(x)
    step = curve.withColumn("x0", F.lag(x).over(order)).withColumn("y0", F.lag(y).over(order))
    hit = F.when(F.col("y0").isNull(), F.col(x)).otherwise(F.col("x0") + (level - F.col("y0")) / (F.col(y) - F.col("y0")) * (F.col(x) - F.col("x0")))
    return step.where((F.col(y) >= level) & (F.col("y0").isNull() | (F.col("y0") < level))).groupBy(*by).agg(F.min(hit).alias("crossing"))


def lag_bins(pairs: DataFrame, tolerance: int, value: str) -> DataFrame:
    """Mean value by lag, in bins to the nearest multiple of tolerance, halves to the even one."""
    return pairs.groupBy("label", (F.bround(F.col("lag") / tolerance) * tolerance).cast("long").alias("lag_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))


def peak(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, x, y, interior, verdict): where y is largest, ties to the smaller x, and whether it falls again on both sides."""
    top = curve.groupBy(*by).agg(F.max_by(x, F.struct(F.col(y), -F.col(x))).alias(x), F.max(y).alias(y), F.min(x).alias("low"), F.max(x).alias("high"))
    verdict = F.when(F.col("low") == F.col("high"), "one point").when(F.col(x) == F.col("low"), "falls throughout").when(F.col(x) == F.col("high"), "still rises at the end").otherwise("peak inside")
    return top.select(*by, x, y, verdict.alias("verdict"))
