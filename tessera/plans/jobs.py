"""Jobs: whole analyses as one DataFrame plan each, parallel over windows, grids and replicates.

Every job shuffles once, to bring a window (or a window and a grid point) together; what comes back are
scalars, and the rest is relational."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import coupling, estimators, flags, inference, spectra
from tessera.operators import resampling as R
from tessera.operators.windows import block_length, chronological_splits, map_windows, origins
from tessera.sources import tables

HALF_LIVES = (10, 21, 42, 63)
FORECASTERS = {
    "frozen": lambda past, now, x, h: now,
    "constant_velocity": lambda past, now, x, h: flags.constant_velocity(past, now),
    "damped_velocity": lambda past, now, x, h: flags.damped_velocity(past, now, 0.2),
    "erse": lambda past, now, x, h: estimators.erse_frame(x),
    "retained": lambda past, now, x, h: estimators.retained_frame(x, h),
    "roll_forward": lambda past, now, x, h: estimators.roll_forward_frame(x, h),
    "ewma": lambda past, now, x, h: estimators.ewma_frame(x, 21),
    "factor_combination": lambda past, now, x, h: estimators.factor_combination_frame(x),
    "hierarchical": lambda past, now, x, h: estimators.filtered_frame(x, "hierarchical"),
    "bootstrap_hierarchical": lambda past, now, x, h: estimators.frame_of(estimators.bootstrap_hierarchical(spectra.adjusted(x))),
}


def pair_covariances(panel: DataFrame, t_in: int, t_out: int, step: int, half_life: float | None = None) -> DataFrame:
    """(label, origin, i, j, cov) for each pair of names, i <= j, of each estimation window: plain or exponentially weighted."""

    def kernel(label, origin, names, past, ahead):
        cov = spectra.covariance(past) if half_life is None else estimators.ewma(past, half_life=half_life)
        return [[label, origin, names[i], names[j], float(cov[i, j])] for i in range(len(names)) for j in range(i, len(names))]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, i string, j string, cov double")


def capture_ladder(panel: DataFrame, t_in: int, t_out: int, step: int) -> DataFrame:
    """Frozen capture, ceiling and floor of each origin. The target is in units of the estimation window only."""

    def kernel(label, origin, names, past, ahead):
        r = spectra.scaled(ahead, *spectra.scaling(past))
        held = flags.captured(spectra.frozen_frame(past), r)
        top = flags.captured(flags.ceiling_frame(r), r)
        return [[label, origin, len(names), *held.values(), top["capture_6"], 6 / len(names)]]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, n_names int, capture_1 double, capture_3 double, capture_6 double, ceiling_6 double, floor_6 double")


def neutral_capture(panel: DataFrame, t_in: int, t_out: int, step: int) -> DataFrame:
    """(label, origin, n_names, capture_1, capture_3, capture_6, market_share): what the frozen frame captures of targets
    that have lost their equal-weight market, the same known direction for every frame, and what share that was."""

    def kernel(label, origin, names, past, ahead):
        r = spectra.scaled(ahead, *spectra.scaling(past))
        market = np.full((len(names), 1), len(names) ** -0.5)
        held = flags.captured(spectra.frozen_frame(past), r, neutral=market)
        return [[label, origin, len(names), *held.values(), float(np.square(market.T @ r).sum() / np.square(r).sum())]]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, n_names int, capture_1 double, capture_3 double, capture_6 double, market_share double")


def entrants(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives=HALF_LIVES, shrunk: tuple[str, ...] = ("ledoit_wolf", "oas", "quadratic_inverse")) -> DataFrame:
    """(label, origin, entrant, capture_6): frozen, ceiling, shrinkage and EWMA frames side by side."""

    def kernel(label, origin, names, past, ahead):
        r = spectra.scaled(ahead, *spectra.scaling(past))
        y = spectra.adjusted(past)
        frames = {"frozen": spectra.frozen_frame(past), "ceiling": flags.ceiling_frame(r)}
        frames |= {f"ewma_{h}": estimators.frame_of(estimators.ewma(y, half_life=h)) for h in half_lives}
        frames |= {name: estimators.frame_of(estimators.ESTIMATORS[name](y)) for name in shrunk}
        return [[label, origin, name, flags.captured(frame, r)["capture_6"]] for name, frame in frames.items()]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, entrant string, capture_6 double")


def bias(panel: DataFrame, t_in: int, t_out: int, step: int, stride: int = 3, replicates: int = 200, seed: int = 20260805) -> DataFrame:
    """(label, origin, bias_6): ceiling bias in static worlds, at every stride-th origin."""

    def kernel(label, origin, names, past, ahead):
        cov = spectra.covariance(spectra.scaled(past, *spectra.scaling(past)))
        return [[label, origin, flags.ceiling_bias(cov, ahead.shape[1], inference.generator(seed, label, origin), replicates)["capture_6"]]]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, bias_6 double", stride)


def intervals(pairs: DataFrame, block: int, value: str = "gain", by: tuple[str, ...] = ("label", "entrant"), seed: int = 20260805) -> DataFrame:
    """Circular-block intervals (operators.resampling.block_intervals) of each group's series in the order of its origins."""
    return R.block_intervals(pairs, value, "origin", block, list(by), seed=seed)


def ladder_comparisons(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives=HALF_LIVES, shrunk: tuple[str, ...] = ("ledoit_wolf", "oas", "quadratic_inverse")) -> DataFrame:
    """Each entrant against frozen, with a block-bootstrap interval."""
    series = tables.cut(entrants(panel, t_in, t_out, step, half_lives, shrunk))  # a number an origin and entrant
    frozen = series.where("entrant = 'frozen'").select("label", "origin", F.col("capture_6").alias("r"))
    pairs = series.where("entrant <> 'frozen'").join(frozen, ["label", "origin"]).withColumn("gain", F.col("capture_6") - F.col("r"))
    return intervals(pairs, block_length(t_in, t_out, step))


def window_frames(panel: DataFrame, t_in: int, step: int) -> DataFrame:
    """(label, w, frame, x): day-flattened leading frames of rolling windows, in order, and the windows, as flat arrays."""

    def kernel(label, origin, names, past, ahead):
        frame = spectra.eigenpairs(spectra.covariance(spectra.adjusted(past)), 6)[1]
        return [[label, origin, frame.ravel().tolist(), np.ravel(past).tolist()]]

    return map_windows(panel, t_in, 0, step, kernel, "label string, w int, frame array<double>, x array<double>")


def triples(panel: DataFrame, t_in: int, horizon: int, step: int) -> DataFrame:
    """(label, w, past, now, future, x): each window's frame with those a horizon before and after.

    A window is sent to the three places that read it and they meet by (label, w): frames are computed once, no label
    is sorted as a whole, and only a window's own place gets its days."""
    k, none = horizon // step, F.lit(None).cast("array<double>")
    frame, at = F.col("frame"), F.col("w")
    place = lambda shift, **held: F.struct((at + shift).alias("w"), *[held.get(c, none).alias(c) for c in ("past", "now", "future", "x")])
    sent = window_frames(panel, t_in, step).select("label", F.explode(F.array(place(k, past=frame), place(0, now=frame, x=F.col("x")), place(-k, future=frame))).alias("p")).select("label", "p.*")
    met = sent.groupBy("label", "w").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("past", "now", "future", "x")])
    return met.where("past is not null and now is not null and future is not null")


def _frame(flat) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, 6)


def flag_losses(panel: DataFrame, t_in: int, horizon: int, step: int, names=tuple(FORECASTERS)) -> DataFrame:
    """(label, example, forecaster, component, loss, failure) of every forecaster at every triple of windows. A
    forecaster that cannot be computed has rows with a NULL loss and its message, so that examples still pair."""
    schema = "label string, example int, forecaster string, component string, loss double, failure string"

    def run(batches):
        for frame in batches:
            rows = []
            for label, w, now, x, past, future in frame[["label", "w", "now", "x", "past", "future"]].itertuples(index=False):
                past, now, future = map(_frame, (past, now, future))
                x = np.asarray(x, float).reshape(len(now), -1)
                for name in names:
                    try:
                        told = flags.losses(future, FORECASTERS[name](past, now, x, horizon)), None
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as failure:
                        told = dict.fromkeys(flags.COMPONENTS), str(failure)
                    rows += [[label, w, name, c, v, told[1]] for c, v in told[0].items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return triples(panel, t_in, horizon, step).repartition("label", "w").mapInPandas(run, schema)


def erse_states(panel: DataFrame, t_in: int, step: int, deltas: tuple[float, ...] = (0.25,)) -> DataFrame:
    """(label, delta, w, frame, target, rotations, positive_fraction, minimum) of rolling windows: the leading frame, that of
    the rotated eigenvectors whose squared sums are delta or more, how many rotations that took, and of the window's
    correlations the share that is positive and the smallest. A delta that no rotation reaches has no row. Kept."""

    def kernel(label, origin, names, past, ahead):
        corr, rows = spectra.covariance(spectra.adjusted(past)), []
        frame = spectra.eigenpairs(corr, 6)[1]
        for delta in deltas:
            try:
                told = estimators.erse(corr, delta)
            except (ValueError, ArithmeticError):
                continue
            rows.append([label, float(delta), origin, frame.ravel().tolist(), told["vectors"][:, :6].ravel().tolist(), len(told["rotations"]), told["positive_fraction"], told["minimum"]])
        return rows

    return tables.cut(map_windows(panel, t_in, 0, step, kernel, "label string, delta double, w int, frame array<double>, target array<double>, rotations int, positive_fraction double, minimum double"))


def attribution_of(states: DataFrame, k: int) -> DataFrame:
    """(label, delta, example, component, persistence, attributed, residual_cosine) of erse_states: how far the motion over the
    next k windows follows the last one, and what of it the direction to the rotated eigenvectors explains."""
    none = F.lit(None).cast("array<double>")
    place = lambda shift, **held: F.struct((F.col("w") + shift).alias("example"), *[held.get(c, none).alias(c) for c in ("past", "now", "future", "target")])
    frame = F.col("frame")
    sent = states.select("label", "delta", F.explode(F.array(place(k, past=frame), place(0, now=frame, target=F.col("target")), place(-k, future=frame))).alias("p")).select("label", "delta", "p.*")
    met = sent.groupBy("label", "delta", "example").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("past", "now", "future", "target")]).where("past is not null and now is not null and future is not null")
    names = ["label", "delta", "example", "component", "persistence", "attributed", "residual_cosine"]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                past, now, future, target = map(_frame, (r.past, r.now, r.future, r.target))
                back, on, to = (flags.component_logs(now, f) for f in (past, future, target))
                for c in on:
                    d = (on[c].shape[1],)
                    _, share, _ = flags.residual((on[c],), (to[c],), d)
                    a, b = (flags.residual((m,), (to[c],), d)[0][0] for m in (-back[c], on[c]))
                    rows.append([r.label, r.delta, r.example, c, flags.tangent_cosine(-back[c], on[c]), share, flags.tangent_cosine(a, b)])
                full = [flags.flag_log(now, f) for f in (past, future, target)]
                incoming = tuple(-h for h in full[0])
                _, share, _ = flags.residual(full[1], full[2])
                a, b = (flags.residual(m, full[2])[0] for m in (incoming, full[1]))
                rows.append([r.label, r.delta, r.example, "flag_nested", flags.cosine(incoming, full[1]), share, flags.cosine(a, b)])
            yield pd.DataFrame(rows, columns=names)

    return met.mapInPandas(run, "label string, delta double, example int, component string, persistence double, attributed double, residual_cosine double")


def attribution(panel: DataFrame, t_in: int, horizon: int, step: int) -> DataFrame:
    """(label, example, component, persistence, attributed, residual_cosine) with a delta of 0.25."""
    return attribution_of(erse_states(panel, t_in, step), horizon // step).drop("delta")


def attribution_summary(rows: DataFrame) -> DataFrame:
    """(label, delta, component, n, and of persistence, attributed and residual_cosine mean, median and positive share;
    contrast): deltas side by side. contrast is the mean of what a delta attributes beyond the smallest one at the same
    example. NaN values do not count."""
    sound = {c: F.when(~F.isnan(c), F.col(c)) for c in ("persistence", "attributed", "residual_cosine")}
    clean = rows.select("label", "delta", "example", "component", *[v.alias(c) for c, v in sound.items()])
    least = F.first("attributed").over(Window.partitionBy("label", "component", "example").orderBy("delta"))
    clean = clean.withColumn("gap", F.col("attributed") - least)
    told = [f(c).alias(f"{c}_{n}") for c in sound for n, f in (("mean", F.avg), ("median", lambda x: F.expr(f"percentile({x}, 0.5)")), ("positive", lambda x: F.avg((F.col(x) > 0).cast("double"))))]
    return clean.groupBy("label", "delta", "component").agg(F.count(F.lit(1)).alias("n"), *told, F.avg("gap").alias("contrast"))


MODES = {"standardised": spectra.adjusted, "raw": spectra.unit_variance}


def spectral_states(panel: DataFrame, t_in: int, step: int, p: int, q: int, modes: tuple[str, ...] = ("standardised",)) -> DataFrame:
    """(label, mode, w, values, vectors, null, gap_high, gap_low) of rolling windows, one eigendecomposition each: the q + 1
    leading values, q vectors (a flat N x q array), the window's part of the distance null and the ends of the gap that
    the null divides by. Mode standardised flattens days before names are scaled, raw only scales names.

    A kept table: distances, variograms and reports read it by equi-join instead of decomposing windows again."""

    def kernel(label, origin, names, past, ahead):
        rows = []
        for mode in modes:
            lam, vec = spectra.eigenpairs(spectra.covariance(MODES[mode](past)))
            rows.append([label, mode, origin, lam[: q + 1].tolist(), vec[:, :q].ravel().tolist(), spectra.distance_null(lam, p, q, t_in), float(lam[p - 1]), float(lam[q])])
        return rows

    return tables.cut(map_windows(panel, t_in, 0, step, kernel, "label string, mode string, w int, values array<double>, vectors array<double>, null double, gap_high double, gap_low double"))


def state_distances(states: DataFrame, step: int, p: int, q: int, max_lag: int) -> DataFrame:
    """(label, mode, i, j, lag, distance, null): all pairs of windows of one label and mode at most max_lag days apart."""
    lags = F.explode(F.sequence(F.lit(1), F.lit(max(1, max_lag // step))))
    keys = ["label", "mode"]
    left = states.select(*keys, F.col("w").alias("i"), F.col("vectors").alias("u"), F.col("null").alias("n1"), lags.alias("k")).withColumn("j", F.col("i") + F.col("k"))
    both = left.join(states.select(*keys, F.col("w").alias("j"), F.col("vectors").alias("v"), F.col("null").alias("n2")), [*keys, "j"])

    @F.pandas_udf("double")
    def apart(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([spectra.distance(np.asarray(a).reshape(-1, q)[:, :p], np.asarray(b).reshape(-1, q)) for a, b in zip(u, v)])

    return both.select(*keys, "i", "j", (F.col("k") * step).alias("lag"), apart("u", "v").alias("distance"), (F.col("n1") + F.col("n2")).alias("null"))


def window_distances(panel: DataFrame, t_in: int, step: int, p: int, q: int, max_lag: int) -> DataFrame:
    """(label, i, j, lag, distance, null) of standardised windows at most max_lag days apart."""
    return state_distances(spectral_states(panel, t_in, step, p, q), step, p, q, max_lag).drop("mode")


def neighbour_geometry(states: DataFrame, p: int, q: int = 6) -> DataFrame:
    """(label, w, squared_cosines, market_angle, geodesic_length, midpoint_angle, missed) of each window and the next one: the
    sum of squared principal cosines of their leading p directions, the angle between their first ones, and of the
    geodesic between these its length, how far its middle is from the start, and how far its end from the second."""
    later = states.select("label", "mode", (F.col("w") - 1).alias("w"), F.col("vectors").alias("after"))
    pairs = states.select("label", "mode", "w", "vectors").join(later, ["label", "mode", "w"])
    names = ["label", "w", "squared_cosines", "market_angle", "geodesic_length", "midpoint_angle", "missed"]

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                u, v = (np.asarray(f, float).reshape(-1, q) for f in (r.vectors, r.after))
                way = flags.log(u[:, :1], v[:, :1])
                middle, end = flags.exp(u[:, :1], way / 2), flags.exp(u[:, :1], way)
                one = lambda a, b: float(spectra.angles(a, b)[0])
                rows.append([r.label, r.w, float(np.square(np.cos(spectra.angles(u[:, :p], v[:, :p]))).sum()), one(u[:, :1], v[:, :1]), float(np.linalg.norm(way)), one(u[:, :1], middle), flags.containment(v[:, :1], end)])
            yield pd.DataFrame(rows, columns=names)

    return pairs.select("label", "w", "vectors", "after").mapInPandas(run, "label string, w int, " + ", ".join(f"{n} double" for n in names[2:]))


def state_motions(states: DataFrame, k: int, q: int = 6) -> DataFrame:
    """(label, mode, example, component, cosine, incoming_speed, outgoing_speed): how far the motion of each state's frame
    over the next k windows goes on as the one over the last k came, by mode."""
    none = F.lit(None).cast("array<double>")
    place = lambda shift, name: F.struct((F.col("w") + shift).alias("example"), *[(F.col("vectors") if c == name else none).alias(c) for c in ("past", "now", "future")])
    sent = states.select("label", "mode", F.explode(F.array(place(k, "past"), place(0, "now"), place(-k, "future"))).alias("p")).select("label", "mode", "p.*")
    met = sent.groupBy("label", "mode", "example").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("past", "now", "future")]).where("past is not null and now is not null and future is not null")
    names = ["label", "mode", "example", "component", "cosine", "incoming_speed", "outgoing_speed"]

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                past, now, future = (np.asarray(f, float).reshape(-1, q)[:, :6] for f in (r.past, r.now, r.future))
                rows += [[r.label, r.mode, r.example, m["component"], m["cosine"], m["incoming_speed"], m["outgoing_speed"]] for m in flags.motion(past, now, future)]
            yield pd.DataFrame(rows, columns=names)

    return met.mapInPandas(run, "label string, mode string, example int, component string, cosine double, incoming_speed double, outgoing_speed double")


def mode_contrast(motions: DataFrame, value: str = "cosine", modes: tuple[str, str] = ("standardised", "raw")) -> DataFrame:
    """(label, component, n, and of each mode mean, median, positive share; contrast, contrast_positive) of value: modes side
    by side, and their difference paired by example. NaN values do not count, nor do examples without both modes."""
    sound = motions.where(F.col(value).isNotNull() & ~F.isnan(value))
    wide = sound.groupBy("label", "component", "example").pivot("mode", list(modes)).agg(F.first(value)).where(" and ".join(f"`{m}` is not null" for m in modes))
    told = [f(m).alias(f"{m}_{name}") for m in modes for name, f in (("mean", F.avg), ("median", lambda c: F.expr(f"percentile(`{c}`, 0.5)")), ("positive", lambda c: F.avg((F.col(c) > 0).cast("double"))))]
    gap = F.col(modes[0]) - F.col(modes[1])
    return wide.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n"), *told, F.avg(gap).alias("contrast"), F.avg((gap > 0).cast("double")).alias("contrast_positive"))


def eigenvalues(panel: DataFrame, t_in: int, step: int, k: int) -> DataFrame:
    """(label, w, mode, value): leading eigenvalues of rolling correlation windows."""

    def kernel(label, origin, names, past, ahead):
        return [[label, origin, m + 1, v] for m, v in enumerate(spectra.eigenpairs(spectra.covariance(spectra.adjusted(past)), k)[0])]

    return map_windows(panel, t_in, 0, step, kernel, "label string, w int, mode int, value double")


def variogram(values: DataFrame, step: int, max_lag: int) -> DataFrame:
    """(label, mode, lag, n, gamma): mean squared difference of eigenvalues by lag."""
    left = values.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max(1, max_lag // step))))).withColumn("other", F.col("w") + F.col("k"))
    right = values.select("label", "mode", F.col("w").alias("other"), F.col("value").alias("later"))
    gap = F.col("later") - F.col("value")
    return left.join(right, ["label", "mode", "other"]).groupBy("label", "mode", (F.col("k") * step).alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("gamma"))


def covariance_scores(panel: DataFrame, t_in: int, t_out: int, step: int, names: tuple[str, ...], long_only: bool = True) -> DataFrame:
    """One row per origin and estimator: all scores of its forecast; without long_only that one is NaN."""
    metrics = ("relative_frobenius", "gaussian_nll_per_asset", "gmv_long_short_variance", "gmv_long_only_variance", "flag_nested_loss", "score_condition_number")

    def kernel(label, origin, _, past, ahead):
        target = spectra.covariance(ahead)
        rows = []
        for name in names:
            s = estimators.scores(estimators.ESTIMATORS[name](past), target, long_only)
            rows.append([label, origin, name, *(s[m] for m in metrics)])
        return rows

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, estimator string, " + ", ".join(f"{m} double" for m in metrics))


def shrinkage_visibility(panel: DataFrame, t_in: int, t_out: int, step: int, names: tuple[str, ...] = ("ledoit_wolf", "oas", "quadratic_inverse", "hierarchical", "ewma_21")) -> DataFrame:
    """(label, origin, estimator, visible, invisible): the size of what an estimator changes in the block that couples the
    leading six directions with the rest, relative to the window's covariance, and whether that is nothing. Estimators
    that only change eigenvalues are invisible to captures, however much they shrink."""

    def kernel(label, origin, _, past, ahead):
        y = spectra.adjusted(past)
        cov = spectra.covariance(y)
        size, axes, rows = float(np.linalg.norm(cov)), spectra.eigenpairs(cov)[1], []
        for name in names:
            told = estimators.ESTIMATORS[name](y)
            rows.append([label, origin, name, float(np.linalg.norm(coupling.visible(told - cov, axes)) / size), coupling.invisible(cov, told)])
        return rows

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, estimator string, visible double, invisible boolean")


def expert_weights(panel: DataFrame, t_in: int, step: int, rank: int = 20, recent: int = 10) -> DataFrame:
    """(label, origin, fast, middle, slow, gap): the weights of the three experts in each window's factor combination, and
    how far their likelihood is from the largest at most."""

    def kernel(label, origin, names, past, ahead):
        _, f, factors = estimators.expert_factors(spectra.adjusted(past), rank, recent)
        w, gap = estimators.combine_experts(factors, f[:, -recent:])
        return [[label, origin, *w.tolist(), gap]]

    return map_windows(panel, t_in, 0, step, kernel, "label string, origin int, fast double, middle double, slow double, gap double")


def foresight(panel: DataFrame, t_in: int, t_out: int, step: int, half_life: float = 21.0) -> DataFrame:
    """(label, origin, forecast, nll, long_only_vol) of the control and four oracles. The future rolling
    window ends with the target window."""

    def kernel(label, origin, names, past, ahead):
        future = np.hstack([past, ahead])[:, ahead.shape[1] :]
        target = spectra.covariance(ahead)
        out = []
        for name, cov in estimators.foresight(past, future, ahead, half_life).items():
            s = estimators.scores(cov, target)
            out.append([label, origin, name, s["gaussian_nll_per_asset"], s["gmv_long_only_annualised_volatility"]])
        return out

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, forecast string, nll double, long_only_vol double")


def change_shares(panel: DataFrame, t_in: int, t_out: int, step: int, width: int = 6) -> DataFrame:
    """(label, origin, cross_share): how much of the covariance's change crosses the border of the leading subspace."""

    def kernel(label, origin, names, past, ahead):
        now = spectra.covariance(past)
        return [[label, origin, flags.cross_share(spectra.eigenpairs(now, width)[1], now, spectra.covariance(ahead))]]

    return map_windows(panel, t_in, t_out, step, kernel, "label string, origin int, cross_share double")


def static_worlds(panel: DataFrame, t_in: int, step: int, p: int = 3, q: int = 6, trials: int = 40, nu: float | None = None, seed: int = 5) -> DataFrame:
    """(label, origin, trials, distance, null): in a static world with each window's own covariance, the mean distance of two
    samples of a window's length and their closed form; nu draws Student samples."""

    def kernel(label, origin, names, past, ahead):
        cov, rng = spectra.covariance(spectra.adjusted(past)) + 1e-9 * np.eye(len(names)), inference.generator(seed, label, origin)
        lam = spectra.eigenpairs(cov)[0]
        drawn = (lambda: inference.gaussian_window(cov, t_in, rng)) if nu is None else (lambda: inference.student_window(cov, t_in, nu, rng))
        apart = []
        for _ in range(trials):
            a, b = (spectra.eigenpairs(spectra.covariance(drawn()))[1] for _ in range(2))
            apart.append(spectra.distance(a[:, :p], b[:, :q]))
        return [[label, origin, trials, float(np.mean(apart)), spectra.distance_null_pair(lam, lam, p, q, t_in)]]

    return map_windows(panel, t_in, 0, step, kernel, "label string, origin int, trials int, distance double, null double")


def splits_of(panel: DataFrame, t_in: int, t_out: int, step: int, **dates) -> DataFrame:
    return chronological_splits(origins(panel, t_in, t_out, step), **dates)
