"""Rolling, leakage-free windows: origins, splits, scaling by the estimation window, and the grouped runner."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_length(t_in: int, t_out: int, step: int) -> int:
    """Origins whose windows overlap: the block of the bootstrap."""
    return math.ceil((t_in + t_out) / step)


def origins(panel: DataFrame, t_in: int, t_out: int, step: int) -> DataFrame:
    """(label, origin, start, target_start, origin_day, target_day, target_first_day) of disjoint
    estimation [start, start + t_in) and target windows, every step days."""
    days = panel.select("label", "t", "day").distinct()
    span = days.groupBy("label").agg((F.max("t") + 1).alias("n"))
    starts = span.where(F.col("n") >= t_in + t_out).select("label", F.posexplode(F.expr(f"sequence(0, n - {t_in + t_out}, {step})")).alias("origin", "start"))
    starts = starts.withColumn("target_start", F.col("start") + t_in)
    out = starts
    for name, at in (("origin_day", F.col("target_start") - 1), ("target_day", F.col("target_start") + t_out - 1), ("target_first_day", F.col("target_start"))):
        out = out.withColumn("t", at).join(days.withColumnRenamed("day", name), ["label", "t"]).drop("t")
    return out


def assign_windows(panel: DataFrame, t_in: int, t_out: int, step: int) -> DataFrame:
    """panel with (origin, role, k): each row once for every window that holds its day. The windows of a
    day follow from t by arithmetic, so this is an explode and no join."""
    width = t_in + t_out
    ends = panel.groupBy("label").agg((F.max("t") + 1 - width).alias("last"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - F.lit(width - 1)) / F.lit(step)))
    hi = F.least(F.floor(F.col("t") / F.lit(step)), F.floor(F.col("last") / F.lit(step)))
    spread = panel.join(ends, "label").where("last >= 0").withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    spread = spread.withColumn("origin", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int")))).withColumn("k", F.col("t") - F.col("origin") * step)
    return spread.withColumn("role", F.when(F.col("k") < t_in, "estimation").otherwise("target")).drop("last", "lo", "hi")


def chronological_splits(windows: DataFrame, train_end: str, validation_start: str, validation_end: str, test_start: str) -> DataFrame:
    """windows with split, by target_day: train, validation, test; what lies between is purged."""
    if not train_end < validation_start <= validation_end < test_start:
        raise ValueError("split dates are not in order")
    day = F.to_date("target_day")
    split = F.when(day <= F.lit(train_end).cast("date"), "train").when((day >= F.lit(validation_start).cast("date")) & (day <= F.lit(validation_end).cast("date")), "validation").when(day >= F.lit(test_start).cast("date"), "test")
    return windows.withColumn("split", F.coalesce(split, F.lit("purged")))


def split_overlaps(windows: DataFrame) -> DataFrame:
    """(label, overlaps): whether a later split's target window opens before an earlier split's last target day, or a split is empty."""
    edge = lambda s, c, f: f(F.when(F.col("split") == s, F.col(c)))
    wide = windows.groupBy("label").agg(edge("train", "target_day", F.max).alias("a"), edge("validation", "target_first_day", F.min).alias("b"), edge("validation", "target_day", F.max).alias("c"), edge("test", "target_first_day", F.min).alias("d"))
    return wide.select("label", F.coalesce((F.col("b") <= F.col("a")) | (F.col("d") <= F.col("c")), F.lit(True)).alias("overlaps"))


def day_levels(windowed: DataFrame) -> DataFrame:
    """(label, origin, k, level): mean square over names of each day of each estimation window."""
    return windowed.where("role = 'estimation'").groupBy("label", "origin", "k").agg(F.avg(F.col("x") * F.col("x")).alias("level"))


def estimation_scaling(windowed: DataFrame) -> DataFrame:
    """(label, origin, name, sigma, reference): each name's sample deviation once the days of its
    estimation window have the mean positive level."""
    level = day_levels(windowed)
    reference = F.coalesce(F.avg(F.when(F.col("level") > 0, F.col("level"))).over(Window.partitionBy("label", "origin")), F.lit(1.0))
    level = level.withColumn("reference", reference)
    flat = windowed.where("role = 'estimation'").join(level, ["label", "origin", "k"]).withColumn("y", F.col("x") / F.sqrt(F.when(F.col("level") > 0, F.col("level") / F.col("reference")).otherwise(1.0)))
    return flat.groupBy("label", "origin", "name").agg(F.stddev_samp("y").alias("sigma"), F.first("reference").alias("reference"))


def map_windows(panel: DataFrame, t_in: int, t_out: int, step: int, kernel: Callable[..., list[list]], schema: str, every: int = 1, params: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Run kernel(label, origin, names, estimation N x T_in, target N x T_out) once per window: rows of schema.

    A group is a chunk of consecutive origins with the days that their windows share, so a cell is shuffled at
    most five times however many windows hold it, and a task holds a matrix of 1.25 windows. With every, only
    each every-th origin is run. params, one row a label, travels with the label's cells: the kernel gets its columns
    as a dict in a sixth place, so that what one plan has chosen drives the next without a stop at the driver; labels
    without a row have no windows. only, (label, origin), names the origins to run; a label's are a list, since there
    are at most as many as it has days."""
    width = t_in + t_out
    per = max(1, -(-width // (4 * step)))
    ends = panel.groupBy("label").agg((F.max("t") + 1).alias("days"))
    given = [c for c in params.columns if c != "label"] if params is not None else []
    if params is not None:
        ends = ends.join(params.select("label", F.struct(*given).alias("given")), "label")
    if only is not None:
        ends = ends.join(only.groupBy("label").agg(F.collect_set(F.col("origin").cast("int")).alias("wanted")), "label")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (width - 1)) / F.lit(step)))
    last = F.least(F.floor(F.col("t") / F.lit(step)), F.floor((F.col("days") - width) / F.lit(step)))
    spread = panel.join(ends, "label").where(F.col("days") >= width).withColumn("first", first).withColumn("last", last).where("first <= last")
    low, high = F.floor(F.col("first") / per).cast("int"), F.floor(F.col("last") / per).cast("int")
    chunks = F.sequence(low, high)
    if only is not None:  # chunks without an origin to run need no cells
        chunks = F.array_intersect(chunks, F.transform("wanted", lambda o: F.floor(o / per).cast("int")))
    names_of, picks = [c.split()[0] for c in schema.split(", ")], only is not None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["name", "t"])
        names = frame["name"].unique().tolist()
        cells, begin = frame["x"].to_numpy(float).reshape(len(names), -1), int(frame["t"].min())
        label, days, k = frame["label"].iloc[0], int(frame["days"].iloc[0]), int(frame["chunk"].iloc[0])
        more = [dict(frame["given"].iloc[0])] if given else []
        wanted = set(frame["wanted"].iloc[0]) if picks else None
        rows = []
        for origin in range(k * per, (k + 1) * per):
            s = origin * step
            if s + width <= days and origin % every == 0 and (wanted is None or origin in wanted):
                rows += kernel(label, origin, names, cells[:, s - begin : s - begin + t_in], cells[:, s - begin + t_in : s - begin + width], *more)
        return pd.DataFrame(rows, columns=names_of)

    carried = ["given"] * (params is not None) + ["wanted"] * (only is not None)
    return spread.select("label", "name", "t", "x", "days", *carried, F.explode(chunks).alias("chunk")).groupBy("label", "chunk").applyInPandas(run, schema)
