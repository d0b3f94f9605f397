"""Parameters chosen on validation that drive test forecasts, in one plan.

A choice is a row a label. It travels to the windows of its label (operators.windows.map_windows, params), and the
kernel of a test window reads it there: nothing stops at the driver, and panels with different choices share the plan.
Validation and test windows are picked by (label, origin), so that neither choice nor report computes windows of
another split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import estimators, flags, spectra
from tessera.operators import summaries as S
from tessera.operators.windows import chronological_splits, map_windows, origins
from tessera.plans import jobs
from tessera.sources import tables


def split_origins(panel: DataFrame, t_in: int, t_out: int, step: int, earliest: int = 0, **dates) -> DataFrame:
    """(label, origin, split) from the earliest origin on."""
    return chronological_splits(origins(panel, t_in, t_out, step), **dates).where(F.col("origin") >= earliest).select("label", "origin", "split")


def frames(panel: DataFrame, t_in: int, step: int) -> DataFrame:
    """(label, w, frame): each window's own leading frame, kept: a label has one a step."""

    def kernel(label, origin, names, past, ahead):
        return [[label, origin, spectra.eigenpairs(spectra.covariance(spectra.adjusted(past)), 6)[1].ravel().tolist()]]

    return tables.cut(map_windows(panel, t_in, 0, step, kernel, "label string, w int, frame array<double>"))


def frame_losses(pairs: DataFrame, keys: str) -> DataFrame:
    """(keys, component, loss) of pairs (keys, prediction, target), frames as flat arrays; keys: a schema."""
    names = [c.split()[0] for c in keys.split(", ")]

    def run(batches):
        for frame in batches:
            rows = []
            for row in frame.itertuples(index=False):
                told = flags.losses(np.asarray(row.target, float).reshape(-1, 6), np.asarray(row.prediction, float).reshape(-1, 6))
                rows += [[*(getattr(row, n) for n in names), c, v] for c, v in told.items()]
            yield pd.DataFrame(rows, columns=[*names, "component", "loss"])

    return pairs.select(*names, "prediction", "target").mapInPandas(run, f"{keys}, component string, loss double")


def chosen_ewma(panel: DataFrame, states: DataFrame, validation: DataFrame, t_in: int, horizon: int, step: int, half_lives: tuple[float, ...]) -> DataFrame:
    """(label, half_life, validation_loss, n_validation, selected): mean complete-flag losses of EWMA frames at the
    validation origins, a horizon ahead; the least is selected, ties to the shorter one. Fails for a label without a
    validation origin."""

    def tried(label, origin, names, past, ahead):
        return [[label, origin, float(h), estimators.ewma_frame(past, h).ravel().tolist()] for h in half_lives]

    forecasts = map_windows(panel, t_in, 0, step, tried, "label string, origin int, half_life double, prediction array<double>", only=validation)
    pairs = forecasts.join(states.select("label", (F.col("w") - horizon // step).alias("origin"), F.col("frame").alias("target")), ["label", "origin"])
    losses = frame_losses(pairs, "label string, origin int, half_life double").where("component = 'flag_nested'")
    labels = panel.select("label").distinct()  # a label that has no validation origin must not vanish
    table = labels.join(losses.groupBy("label", "half_life").agg(F.avg("loss").alias("validation_loss"), F.count("loss").alias("n_validation")), "label", "left")
    checked = F.when(F.col("half_life").isNotNull(), F.col("validation_loss")).otherwise(F.raise_error(F.lit("the validation split is empty")).cast("double"))
    table = table.withColumn("validation_loss", checked)
    best = S.choose(table, ["label"], "validation_loss", "half_life").select("label", F.col("half_life").alias("best"))
    return table.join(best, "label").withColumn("selected", F.col("half_life") == F.col("best")).drop("best")


def ewma_losses(panel: DataFrame, t_in: int, horizon: int, step: int, half_lives: tuple[float, ...], **dates) -> tuple[DataFrame, DataFrame]:
    """(the table of the choice, (label, half_life, example, component, loss, frozen) at the test origins): EWMA frames by
    each label's chosen half-life beside the frame that is held still. Origins need a motion before them, as every
    forecaster's do; example counts from the first that has one."""
    k = horizon // step
    states = frames(panel, t_in, step)
    split = split_origins(panel, t_in, horizon, step, k, **dates)
    table = tables.cut(chosen_ewma(panel, states, split.where("split = 'validation'"), t_in, horizon, step, half_lives))
    choice = table.where("selected").select("label", "half_life")

    def told(label, origin, names, past, ahead, given):
        return [[label, origin, given["half_life"], estimators.ewma_frame(past, given["half_life"]).ravel().tolist()]]

    forecasts = map_windows(panel, t_in, 0, step, told, "label string, origin int, half_life double, prediction array<double>", params=choice, only=split.where("split = 'test'"))
    held = forecasts.select("label", "origin", "half_life").join(states.select("label", F.col("w").alias("origin"), F.col("frame").alias("prediction")), ["label", "origin"])
    target = states.select("label", (F.col("w") - k).alias("origin"), F.col("frame").alias("target"))
    both = forecasts.withColumn("kind", F.lit("loss")).unionByName(held.withColumn("kind", F.lit("frozen"))).join(target, ["label", "origin"])
    losses = frame_losses(both, "label string, origin int, half_life double, kind string")
    wide = losses.groupBy("label", "half_life", (F.col("origin") - k).alias("example"), "component").pivot("kind", ["loss", "frozen"]).agg(F.first("loss"))
    return table, wide


def compared(losses: DataFrame, block: int, by: tuple[str, ...], seed: int = 20260803) -> DataFrame:
    """(by, n, means, skill_percent, win_fraction, improvement with its interval) of loss against frozen over examples."""
    losses = tables.cut(losses.withColumn("gain", F.col("frozen") - F.col("loss")))
    means = losses.groupBy(*by).agg(F.avg("loss").alias("model_mean"), F.avg("frozen").alias("frozen_mean"), F.avg((F.col("gain") > 0).cast("double")).alias("win_fraction"))
    told = jobs.intervals(losses.withColumnRenamed("example", "origin"), block, by=by, seed=seed).withColumnRenamed("mean", "improvement")
    scale = F.greatest("frozen_mean", F.lit(2.2250738585072014e-308))
    return means.join(told, list(by)).withColumn("skill_percent", 100 * F.col("improvement") / scale)


def damping_losses(panel: DataFrame, t_in: int, horizon: int, step: int, points: int = 41, **dates) -> DataFrame:
    """(label, alpha, example, component, loss, frozen) at the test origins: every component's loss with the share of the
    last motion that each label's validation chose by the complete flag, beside the frame that is held still."""
    from tessera.plans.selection import choose_damping

    k = horizon // step
    choice = choose_damping(panel, t_in, horizon, step, points, **dates).where("selected").select("label", "alpha")
    test = split_origins(panel, t_in, horizon, step, k, **dates).where("split = 'test'").select("label", F.col("origin").alias("w"))
    places = jobs.triples(panel, t_in, horizon, step).drop("x").join(test, ["label", "w"]).join(choice, "label")

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                past, now, future = (np.asarray(f, float).reshape(-1, 6) for f in (r.past, r.now, r.future))
                moved, still = flags.losses(future, flags.damped_velocity(past, now, r.alpha)), flags.losses(future, now)
                rows += [[r.label, r.alpha, r.w - k, c, moved[c], still[c]] for c in moved]
            yield pd.DataFrame(rows, columns=["label", "alpha", "example", "component", "loss", "frozen"])

    return places.select("label", "alpha", "w", "past", "now", "future").mapInPandas(run, "label string, alpha double, example int, component string, loss double, frozen double")


def foresight(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives: tuple[int, ...], **dates) -> DataFrame:
    """(label, half_life, origin, forecast, nll, long_only_vol) of the control and four oracles at the test origins; volatilities
    by the half-life with the least likelihood loss of EWMA covariances at the validation origins."""
    split = split_origins(panel, t_in, t_out, step, **dates)
    choice = chosen_likelihood(panel, t_in, t_out, step, half_lives, split).where("selected").select("label", "half_life")

    def told(label, origin, names, past, ahead, given):
        future, target = np.hstack([past, ahead])[:, ahead.shape[1] :], spectra.covariance(ahead)
        rows = []
        for name, cov in estimators.foresight(past, future, ahead, given["half_life"]).items():
            s = estimators.scores(cov, target)
            rows.append([label, given["half_life"], origin, name, s["gaussian_nll_per_asset"], s["gmv_long_only_annualised_volatility"]])
        return rows

    return map_windows(panel, t_in, t_out, step, told, "label string, half_life double, origin int, forecast string, nll double, long_only_vol double", params=choice, only=split.where("split = 'test'"))


def chosen_likelihood(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives: tuple[int, ...], split: DataFrame) -> DataFrame:
    """(label, half_life, validation_loss, n_validation, selected) by Gaussian likelihood losses at validation origins."""

    def tried(label, origin, names, past, ahead):
        target = spectra.covariance(ahead)
        return [[label, origin, float(h), estimators.scores(estimators.ewma(past, half_life=h), target, long_only=False)["gaussian_nll_per_asset"]] for h in half_lives]

    losses = map_windows(panel, t_in, t_out, step, tried, "label string, origin int, half_life double, loss double", only=split.where("split = 'validation'"))
    table = tables.cut(losses.groupBy("label", "half_life").agg(F.avg("loss").alias("validation_loss"), F.count("loss").alias("n_validation")))
    best = S.choose(table, ["label"], "validation_loss", "half_life").select("label", F.col("half_life").alias("best"))
    return table.join(best, "label").withColumn("selected", F.col("half_life") == F.col("best")).drop("best")
