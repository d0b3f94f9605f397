"""Nulls and what is held against them: replicates of a panel, statistics by component, p-values, sweeps.

A panel is packed to one array a label, once; replicates are rows of a grid that meet it by a join, so the
long table is shuffled once however many draws there are. Each draw is seeded by (seed, label, replicate)
alone: results do not depend on partitions, lost tasks are replayed, and draws that a resumable table
already holds are not made again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import flags, inference, spectra
from tessera.operators import panel as P
from tessera.operators import resampling as R
from tessera.operators import summaries as S
from tessera.sources import tables

BROADCAST_CELLS = 1 << 24  # doubles: panels of 128 MB together at most are broadcast
PRIMARY = ("market_1", "top_6", "flag_nested")
DELETION = ("addition_cosine", "previous_speed", "next_speed", "full_cosine", "deletion_cosine", "attributed", "residual_cosine")
MOTION = ("cosine", "incoming_speed", "outgoing_speed")


def packed(panel: DataFrame) -> DataFrame:
    """(label, n, x): each label's matrix, names by days, row after row."""
    cells = F.sort_array(F.collect_list(F.struct("name", "t", "x")))
    return panel.groupBy("label").agg(F.count_distinct("name").alias("n"), cells.alias("cells")).select("label", "n", F.col("cells.x").alias("x"))


def replicates(panel: DataFrame, draws: DataFrame | int, kernel: Callable[..., list[dict]], schema: str, kind: str | None = None, block: int = 6, bins: int = 3, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Rows of kernel(label, replicate, matrix) for every replicate: 0 to draws, or (label, replicate) rows. Further columns
    of draws go to the kernel as a dict in a fourth place. schema: label string, replicate int, then the kernel's columns.

    By kind, the matrices of replicates above 0 are redrawn: calendar exchanges blocks of days (the short last one with
    the others), volatility whole blocks within strata of their level, both by resampling.exchanged_days, whose draws are
    hashes; iaaft makes surrogates by a generator seeded by (seed, label, replicate)."""
    spark = panel.sparkSession
    flat = tables.cut(packed(panel))  # one row a label: read for its labels, its size and its cells
    grid = flat.select("label").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws)))) if isinstance(draws, int) else draws
    given = [c for c in grid.columns if c not in ("label", "replicate")]
    moved = kind in ("calendar", "volatility")
    if moved:
        levels = tables.cut(P.variance_path(panel))
        days = R.exchanged_days(levels, grid.select("label", "replicate").distinct(), block, bins if kind == "volatility" else 1, "fixed" if kind == "volatility" else "free", seed)
        # a replicate's days in their new order: one list of as many numbers as a label has days
        orders = days.groupBy("label", "replicate").agg(F.sort_array(F.collect_list(F.struct("t", "source"))).alias("o")).select("label", "replicate", F.col("o.source").alias("_order_"))
        grid = grid.join(orders, ["label", "replicate"])
    if (flat.agg(F.sum(F.size("x"))).first()[0] or 0) <= BROADCAST_CELLS:
        both = grid.repartition(spark.sparkContext.defaultParallelism * 2, "label", "replicate", *given).join(F.broadcast(flat), "label")
    else:  # each replicate's matrix travels by itself
        both = grid.join(flat, "label").repartition("label", "replicate", *given)
    names, order = [c.split()[0] for c in schema.split(", ")], ["_order_"] * moved

    def run(batches):
        for frame in batches:
            for label, k, n, x, *more in frame[["label", "replicate", "n", "x", *given, *order]].itertuples(index=False):
                x = np.asarray(x, float).reshape(int(n), -1)
                if moved:
                    x = x[:, np.asarray(more.pop(), int)]
                elif kind == "iaaft" and k:
                    x = inference.iaaft_panel(x, inference.generator(seed, f"{label}/iaaft", int(k)), rounds)
                rows = kernel(label, int(k), x, *[dict(zip(given, more))] * bool(given))
                yield pd.DataFrame([{"label": label, "replicate": k, **row} for row in rows], columns=names)

    return both.select("label", "replicate", "n", "x", *given, *order).mapInPandas(run, schema)


def motions(panel: DataFrame, draws: DataFrame | int, t_in: int, horizon: int, step: int, kind: str = "calendar", market: bool = True, **how) -> DataFrame:
    """(label, replicate, origin, component, cosine, incoming_speed, outgoing_speed) of every replicate."""
    kernel = lambda label, k, x: inference.motion_rows(x, t_in, horizon, step, market)
    return replicates(panel, draws, kernel, "label string, replicate int, origin int, component string, " + ", ".join(f"{c} double" for c in MOTION), kind, **how)


def deletions(panel: DataFrame, draws: DataFrame | int, t_in: int, horizon: int, step: int, kind: str = "volatility", **how) -> DataFrame:
    """(label, replicate, origin, component, and the columns DELETION) of every replicate."""
    kernel = lambda label, k, x: inference.deletion_rows(x, t_in, horizon, step)
    return replicates(panel, draws, kernel, "label string, replicate int, origin int, component string, " + ", ".join(f"{c} double" for c in DELETION), kind, **how)


def means(series: DataFrame, columns: tuple[str, ...], first: str) -> DataFrame:
    """One row a replicate and component: mean_ of each column, and n, median, quartiles and positive share of the first.
    NULL and NaN values do not count."""
    sound = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    clean = series.select("label", "replicate", "component", *[sound(c).alias(c) for c in columns])
    q = lambda p: F.expr(f"percentile({first}, {p})")
    shares = [F.count(first).alias("n"), q(0.5).alias(f"median_{first}"), q(0.25).alias(f"q25_{first}"), q(0.75).alias(f"q75_{first}"), F.avg((F.col(first) > 0).cast("double")).alias("positive_fraction")]
    return clean.groupBy("label", "replicate", "component").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *shares)


def held_against(summary: DataFrame, statistic: str, primary: tuple[str, ...] = PRIMARY) -> DataFrame:
    """The observed rows (replicate 0) with null_mean, null_q95, n_null, p, and holm over the primary components of a label."""
    summary = tables.cut(summary)  # a few numbers a replicate, read several times below
    observed = summary.where("replicate = 0").drop("replicate")
    null = summary.where("replicate > 0").select("label", "component", statistic)
    told = S.empirical_p(observed.select("label", "component", statistic), null, ["label", "component"], statistic)
    gates = S.holm(told.where(F.col("component").isin(*primary)).select("label", "component", "p"), ["label"]).select("label", "component", "holm")
    return observed.join(told.drop(statistic), ["label", "component"]).join(gates, ["label", "component"], "left")


def resumed(panel: DataFrame, path: str, draws: int, t_in: int, horizon: int, step: int, kind: str = "volatility", **how) -> DataFrame:
    """The summaries of replicates 0 to draws from a resumable table; only the missing ones are computed and added.
    Replicates that two writers added come once."""
    wanted = panel.select("label").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    left = tables.missing_keys(wanted, path, ["label", "replicate"])
    if not left.isEmpty():
        tables.append_results(means(deletions(panel, left, t_in, horizon, step, kind, **how), DELETION, "addition_cosine"), path)
    return S.first_of_each(panel.sparkSession.read.parquet(path), ["label", "replicate", "component"], ["n", "mean_addition_cosine"])


def coherence(panel: DataFrame, draws: int, t_in: int, horizon: int, step: int, market: bool = True, seed: int = 13) -> DataFrame:
    """(label, replicate, component, leading_share, spike_ratio, participation, effective_rank) of the motions of
    every component and of the nested spans together, against nulls in which each name moves at its own times
    (for the nested spans, at the same times on every level)."""
    names = ("leading_share", "spike_ratio", "participation", "effective_rank")

    def kernel(label, k, x):
        frames = inference.histories(x, t_in, horizon, step, market)[0]
        paths = [flags.components(f) for f in frames]
        rows = []
        for c in paths[0]:
            moves, bases = flags.motions([p[c] for p in paths], horizon // step)
            if k:
                moves = flags.desynchronise(moves, bases, inference.generator(seed, f"{label}/{c}", k))
            rows.append({"component": c, **flags.coherence(moves)})
        levels = [flags.motions([f[:, :d] for f in frames], horizon // step) for d in flags.DIMS]
        if k:  # one generator state for all levels: a name's shift is shared by them
            levels = [(flags.desynchronise(m, b, inference.generator(seed, f"{label}/nested", k)), b) for m, b in levels]
        whole = np.stack([flags.stack(part) for part in zip(*[m for m, _ in levels])])
        return [*rows, {"component": "flag_nested", **flags.coherence(whole)}]

    return replicates(panel, draws, kernel, "label string, replicate int, component string, " + ", ".join(f"{n} double" for n in names))


def surrogate_report(panel: DataFrame, draws: int, rounds: int = 200) -> DataFrame:
    """(label, replicate, cross_correlation, original_cross_correlation, spectrum_error, lag1_error) of iaaft surrogates."""
    kernel = lambda label, k, x: [inference.surrogate_errors(x, inference.iaaft_panel(x, inference.generator(7, f"{label}/iaaft", k), rounds))] if k else []
    return replicates(panel, draws, kernel, "label string, replicate int, cross_correlation double, original_cross_correlation double, spectrum_error double, lag1_error double")


def relative_gaps(panel: DataFrame, t_in: int, horizon: int, step: int, market: bool = True) -> DataFrame:
    """(label, dimension, gap): mean relative gap of eigenvalues at the flag's dimensions."""

    def kernel(label, k, x):
        values = inference.histories(x, t_in, horizon, step, market)[2]
        return [{"dimension": d, "gap": float(np.mean([(v[d - 1] - v[d]) / max(abs(v[d - 1]), 1e-15) for v in values]))} for d in flags.DIMS]

    return replicates(panel, 0, kernel, "label string, replicate int, dimension int, gap double").drop("replicate")


def rv_statistics(panel: DataFrame, draws: int, scales: tuple[int, ...] = (5, 10, 21), block: int = 6, bins: int = 3, seed: int = 7) -> DataFrame:
    """(label, replicate, kind, scale, value): lag-1 autocorrelation of the log realised variance of whole blocks of scale
    days, to 12 digits, of the panel (replicate 0) and under both block nulls; NULL with fewer than three blocks.

    All native: the statistic only needs each day's level, so that a replicate is a permuted column of days and the
    panel itself is read once."""
    levels = tables.cut(P.variance_path(panel))
    grid = levels.select("label").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    moved = None
    for kind, strata in (("calendar", 1), ("volatility", bins)):
        one = R.exchanged_days(levels, grid, block, strata, seed=seed).withColumn("kind", F.lit(kind))
        moved = one if moved is None else moved.unionByName(one)
    held = moved.join(levels.select("label", F.col("t").cast("int").alias("source"), "level"), ["label", "source"])
    days = levels.groupBy("label").agg(F.count(F.lit(1)).alias("days"))
    spread = held.join(days, "label").withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn("b", F.floor(F.col("t") / F.col("scale"))).where(F.col("b") < F.floor(F.col("days") / F.col("scale")))
    keys = ["label", "replicate", "kind", "scale"]
    blocks = spread.groupBy(*keys, "b").agg(F.sum("level").alias("s")).where("s > 0").withColumn("v", F.ln("s"))
    before = blocks.withColumn("before", F.lag("v").over(Window.partitionBy(*keys).orderBy("b")))
    return before.groupBy(*keys).agg(F.when(F.count("v") > 2, F.round(F.corr("v", "before"), 12)).alias("value"))


def rv_nulls(panel: DataFrame, draws: int, scales: tuple[int, ...] = (5, 10, 21), block: int = 6, bins: int = 3) -> DataFrame:
    """(label, scale, observed, calendar, volatility, n_replicates): the log realised variance's lag-1
    autocorrelation and its mean under both block nulls."""
    told = rv_statistics(panel, draws, scales, block, bins)
    null = lambda kind: F.avg(F.when((F.col("replicate") > 0) & (F.col("kind") == kind), F.col("value"))).alias(kind)
    return told.groupBy("label", "scale").agg(F.max(F.when((F.col("replicate") == 0) & (F.col("kind") == "calendar"), F.col("value"))).alias("observed"), null("calendar"), null("volatility"), F.max("replicate").alias("n_replicates"))


def combined(statistics: DataFrame, value: str, by: list[str], whole: str = "all") -> DataFrame:
    """(label, by, n_panels, observed, null_mean, null_q95, n_null, p, holm) of each panel and of all panels together.

    statistics: (label, replicate, by, value), replicate 0 observed. Panels weigh alike: replicate k of all of them is
    averaged and the observed mean is held against these averages. A replicate that some panel has no number for
    counts in no average, and without an observed number of every panel the combined one is NULL. holm is over the
    panels of a group; the combined row has none."""
    # a few numbers a replicate, read several times below
    sound = tables.cut(statistics).select("label", "replicate", *by, F.when(~F.isnan(value), F.col(value)).alias("draw"))
    panels = sound.groupBy(*by).agg(F.count_distinct("label").alias("n_panels"))
    mean = sound.groupBy(*by, "replicate").agg(F.count("draw").alias("here"), F.avg("draw").alias("draw")).join(panels, by)
    mean = mean.select(F.lit(whole).alias("label"), "replicate", *by, F.when(F.col("here") == F.col("n_panels"), F.round("draw", 12)).alias("draw"))
    both = sound.withColumn("n", F.lit(1).cast("long")).unionByName(mean.join(panels, by).withColumnRenamed("n_panels", "n"))
    keys = ["label", *by]
    observed = both.where("replicate = 0").select(*keys, F.col("n").alias("n_panels"), F.col("draw").alias("observed"))
    told = S.empirical_p(observed.select(*keys, "observed"), both.where("replicate > 0").select(*keys, F.col("draw").alias("observed")), keys, "observed").withColumn("p", F.when(F.col("observed").isNotNull(), F.col("p")))
    gates = S.holm(told.where(F.col("label") != whole).select(*keys, "p"), by).select(*keys, "holm")
    return observed.drop("observed").join(told, keys).join(gates, keys, "left").select(*keys, "n_panels", "observed", "null_mean", "null_q95", "n_null", "p", "holm")


def geometry(panel: DataFrame, cells: list[tuple[int, int]], step: int) -> DataFrame:
    """(label, t_in, horizon, names, days, windows, origins, q, deletion_fraction, block, independent_blocks) of each
    cell (t_in, horizon) of a sweep, without running anything."""
    size = panel.groupBy("label").agg(F.count_distinct("name").alias("names"), F.count_distinct("t").alias("days"))
    grid = size.withColumn("cell", F.explode(F.array(*[F.struct(F.lit(t).alias("t_in"), F.lit(h).alias("horizon")) for t, h in cells])))
    wide = grid.select("label", "names", "days", "cell.t_in", "cell.horizon").withColumn("windows", F.floor((F.col("days") - F.col("t_in")) / step) + 1)
    wide = wide.withColumn("origins", F.col("windows") - 2 * F.floor(F.col("horizon") / step)).withColumn("block", F.ceil((F.col("t_in") + 2 * F.col("horizon")) / step))
    return wide.withColumn("q", F.col("names") / F.col("t_in")).withColumn("deletion_fraction", F.col("horizon") / F.col("t_in")).withColumn("independent_blocks", F.col("origins") / F.col("block"))


def sweep(panel: DataFrame, cells: list[tuple[int, int]], step: int, draws: int, kind: str = "volatility", **how) -> DataFrame:
    """geometry with the observed nested statistics of each cell, its null and the excess that could be seen."""
    out = None
    for t_in, horizon in cells:
        nested = means(deletions(panel, draws, t_in, horizon, step, kind, **how), DELETION, "addition_cosine").where("component = 'flag_nested'")
        one = nested.withColumn("t_in", F.lit(t_in)).withColumn("horizon", F.lit(horizon))
        out = one if out is None else out.unionByName(one)
    keys = ["label", "t_in", "horizon"]
    observed = out.where("replicate = 0").select(*keys, F.col("mean_addition_cosine").alias("observed"), F.col("mean_full_cosine").alias("full_cosine"), F.col("mean_attributed").alias("attributed"), F.col("mean_residual_cosine").alias("residual_cosine"), "positive_fraction", F.col("n").alias("origins_run"))
    null = out.where("replicate > 0").select(*keys, F.col("mean_addition_cosine").alias("observed"))
    return geometry(panel, cells, step).join(observed, keys).join(detectable(observed.select(*keys, "observed"), null, keys, "observed").drop("observed"), keys, "left")


def chosen_cells(panel: DataFrame, cells: list[tuple[int, int]], step: int, least: float = 2.0) -> DataFrame:
    """geometry of the cells whose origins hold least independent blocks or more: the others' intervals would mean nothing."""
    return geometry(panel, cells, step).where(F.col("independent_blocks") >= least)


def resumed_sweep(panel: DataFrame, path: str, cells: DataFrame, draws: int, step: int, kind: str = "volatility", **how) -> DataFrame:
    """The summaries of replicates 0 to draws of every cell (label, t_in, horizon) from a resumable table at path.

    The table itself says what is done: keys (label, t_in, horizon, replicate) that it lacks go through one plan, all
    cells together, and are added, a folder a cell. A run that was killed left whole folders or none of a write; what it
    had added is not made again, and rows that two writers added come once. Labels differ in their cells."""
    keys = ["label", "t_in", "horizon", "replicate"]
    wanted = cells.select("label", F.col("t_in").cast("int"), F.col("horizon").cast("int")).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    left = tables.cut(tables.missing_keys(wanted, path, keys))
    held = "label string, replicate int, component string, n long, " + ", ".join(f"mean_{c} double" for c in DELETION) + ", positive_fraction double, t_in int, horizon int"
    if not left.isEmpty() or not tables.exists(panel.sparkSession, path):  # without any cell the table is empty, but there
        schema = "label string, replicate int, t_in int, horizon int, origin int, component string, " + ", ".join(f"{c} double" for c in DELETION)

        def kernel(label, k, x, cell):
            rows = inference.deletion_rows(x, int(cell["t_in"]), int(cell["horizon"]), step)
            return [{**cell, **row} for row in rows]

        made = replicates(panel, left, kernel, schema, kind, **how)
        clean = [F.when(~F.isnan(c), F.col(c)) for c in DELETION]
        summary = made.groupBy(*keys, "component").agg(F.count(clean[0]).alias("n"), *[F.avg(v).alias(f"mean_{c}") for c, v in zip(DELETION, clean)], F.avg((clean[0] > 0).cast("double")).alias("positive_fraction"))
        summary.write.mode("append").partitionBy("t_in", "horizon").parquet(path)
    done = panel.sparkSession.read.schema(held).parquet(path).join(wanted, keys, "left_semi")
    return S.first_of_each(done, [*keys, "component"], ["n", "mean_addition_cosine"])


def detectable(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n_null, null_mean, null_sd, null_q95, normal_excess, q95_excess, p_floor, excess, z, powered_ratio,
    p): what a null could have shown, by its spread and by its 95th percentile, and what was seen. Under three
    draws all is NULL."""
    draws = null.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.count(value).alias("n_null"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.expr(f"percentile({value}, 0.95)").alias("null_q95")).where("n_null >= 3")
    p = S.empirical_p(observed, null, keys, value).select(*keys, "p")
    told = observed.join(draws, keys, "left").join(p, keys, "left")
    told = told.withColumn("normal_excess", 1.645 * F.col("null_sd")).withColumn("q95_excess", F.col("null_q95") - F.col("null_mean")).withColumn("p_floor", 1 / (F.col("n_null") + 1)).withColumn("excess", F.col(value) - F.col("null_mean"))
    return told.withColumn("z", F.try_divide("excess", "null_sd")).withColumn("powered_ratio", F.when(F.col("q95_excess") > 0, F.col("excess") / F.col("q95_excess"))).withColumn("p", F.when(F.col("n_null").isNotNull(), F.col("p")))


def residual_panel(panel: DataFrame) -> DataFrame:
    """panel without each name's part along the equal-weight return, over the label's whole history."""
    day = panel.groupBy("label", "t").agg(F.avg("x").alias("m"))
    both = panel.join(day, ["label", "t"])
    fit = both.groupBy("label", "name").agg(F.coalesce(F.regr_slope("x", "m"), F.lit(0.0)).alias("b"), F.avg("x").alias("xm"), F.avg("m").alias("mm"))
    return both.join(fit, ["label", "name"]).withColumn("x", F.col("x") - F.col("xm") - F.col("b") * (F.col("m") - F.col("mm"))).select("label", "name", "day", "x", "t")


def window_levels(panel: DataFrame, t_in: int, step: int) -> DataFrame:
    """(label, mean_cv2, max_cv2, windows): the relative variance of the daily level inside each window."""
    from tessera.operators.windows import assign_windows

    level = F.col("level")
    daily = P.variance_path(panel)
    inside = assign_windows(daily.withColumn("name", F.lit("level")).withColumn("x", level), t_in, 0, step)
    cv2 = inside.groupBy("label", "origin").agg((F.try_divide(F.avg(level * level), F.avg(level) * F.avg(level)) - 1).alias("cv2"))
    return cv2.groupBy("label").agg(F.avg("cv2").alias("mean_cv2"), F.max("cv2").alias("max_cv2"), F.count(F.lit(1)).alias("windows"))


def spectrum_of(panel: DataFrame, t_in: int, p: int, q: int) -> DataFrame:
    """(label, above_edge, edge, bulk_variance, random_distance, null_distance): the last window against random matrices."""

    def kernel(label, k, x):
        lam = spectra.eigenpairs(spectra.covariance(spectra.adjusted(x[:, -t_in:])))[0]
        above, edge, bulk = spectra.count_above_bulk(lam.clip(0), t_in)
        return [{"above_edge": above, "edge": edge, "bulk_variance": bulk, "random_distance": spectra.random_distance(p, q, len(x), points=20_001), "null_distance": spectra.distance_null(lam, p, q, t_in)}]

    return replicates(panel, 0, kernel, "label string, replicate int, above_edge int, edge double, bulk_variance double, random_distance double, null_distance double").drop("replicate")
