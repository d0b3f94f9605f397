"""Choices made on validation and reported on test: half-lives, damping, the coupling model; paired evidence.

No selector sees a test row. The splits are by target day (operators.windows.chronological_splits); what lies
between two splits is purged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import coupling, flags, inference, spectra
from tessera.operators import summaries as S
from tessera.operators.windows import chronological_splits, map_windows, origins
from tessera.plans import jobs
from tessera.sources import tables

FEATURES = ("fast_slow", "momentum", "stress", "hierarchy")


def example_splits(panel: DataFrame, t_in: int, horizon: int, step: int, **dates) -> DataFrame:
    """(label, example, origin, split, and the days): origins that also have a window a horizon before, numbered
    from 0. Windows whose past or future motion would leave the panel are withheld."""
    known = origins(panel, t_in, horizon, step).where(F.col("origin") >= horizon // step)
    return chronological_splits(known, **dates).withColumn("example", F.col("origin") - horizon // step)


def choose_half_life(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives: tuple[int, ...], **dates) -> DataFrame:
    """(label, half_life, validation_loss, n_validation, test_loss, n_test, selected): likelihood losses of EWMA
    forecasts; the least on validation is selected, ties to the shorter half-life."""
    scores = jobs.covariance_scores(panel, t_in, t_out, step, tuple(f"ewma_{h}" for h in half_lives))
    split = chronological_splits(origins(panel, t_in, t_out, step), **dates).select("label", "origin", "split")
    long = scores.join(split, ["label", "origin"]).select("label", F.substring_index("estimator", "_", -1).cast("int").alias("half_life"), "split", F.col("gaussian_nll_per_asset").alias("loss"))
    return S.choose_on_validation(long, ["label"], "half_life", "loss")


def choose_damping(panel: DataFrame, t_in: int, horizon: int, step: int, points: int = 41, **dates) -> DataFrame:
    """The same for the share of the last motion that a forecast goes on with, by nested loss. One task holds a
    triple of frames and tries all shares on it."""
    triples = jobs.triples(panel, t_in, horizon, step).drop("x")
    days = panel.select("label", "t", F.col("day").alias("target_day")).distinct()
    split = chronological_splits(triples.withColumn("t", F.col("w") * step + t_in + horizon - 1).join(days, ["label", "t"]).drop("t"), **dates)
    shares = np.linspace(0, 1, points)

    def run(batches):
        for frame in batches:
            for label, part, past, now, future in frame[["label", "split", "past", "now", "future"]].itertuples(index=False):
                past, now, future = (np.asarray(f, float).reshape(-1, 6) for f in (past, now, future))
                loss = [flags.losses(future, flags.damped_velocity(past, now, a))["flag_nested"] for a in shares]
                yield pd.DataFrame({"label": label, "split": part, "alpha": shares.round(6), "loss": loss})

    long = split.select("label", "w", "split", "past", "now", "future").repartition("label", "w").mapInPandas(run, "label string, split string, alpha double, loss double")
    return S.choose_on_validation(long, ["label"], "alpha", "loss")


def comparisons(scores: DataFrame, keys: list[str], name: str, reference: str, metrics: list[str], block: int, seed: int = 20260805) -> DataFrame:
    """(label, candidate, metric, n, means, percent_improvement, win_fraction and an interval): every other value of
    column name against one reference, paired by keys; a loss falls when it improves."""
    long = scores.unpivot([*keys, name], metrics, "metric", "loss")
    base = long.where(F.col(name) == reference).select(*keys, "metric", F.col("loss").alias("r"))
    both = long.where(F.col(name) != reference).join(base, [*keys, "metric"]).withColumn("gain", F.col("r") - F.col("loss"))
    means = both.groupBy("label", F.col(name).alias("candidate"), "metric").agg(F.avg("loss").alias("candidate_mean"), F.avg("r").alias("reference_mean"), (100 * F.avg("gain") / F.greatest(F.abs(F.avg("r")), F.lit(2.2250738585072014e-308))).alias("percent_improvement"), F.avg((F.col("gain") > 0).cast("double")).alias("win_fraction"))
    told = jobs.intervals(both.withColumnRenamed(name, "candidate"), block, by=("label", "candidate", "metric"), seed=seed)
    return means.join(told, ["label", "candidate", "metric"])


def loss_comparisons(losses: DataFrame, block: int, seed: int = 20260803) -> DataFrame:
    """Every forecaster's flag losses against frozen's, by component, with an interval of the paired gain and of the skill."""
    frozen = losses.where("forecaster = 'frozen'").select("label", "example", "component", F.col("loss").alias("r"))
    both = losses.where("forecaster <> 'frozen' and loss is not null").join(frozen, ["label", "example", "component"]).withColumn("gain", F.col("r") - F.col("loss")).withColumnRenamed("example", "origin")
    by = ["label", "forecaster", "component"]
    q = lambda p: F.expr(f"percentile(loss, {p})")
    stats = both.groupBy(*by).agg(F.avg("loss").alias("model_mean"), q(0.5).alias("model_median"), q(0.25).alias("model_q25"), q(0.75).alias("model_q75"), F.avg("r").alias("frozen_mean"), F.avg((F.col("gain") > 0).cast("double")).alias("win_fraction"))
    scale = F.greatest("frozen_mean", F.lit(2.2250738585072014e-308))
    told = stats.join(jobs.intervals(both, block, by=tuple(by), seed=seed), by)
    return told.withColumn("skill_percent", 100 * F.col("mean") / scale).withColumn("skill_ci_low", 100 * F.col("ci_low") / scale).withColumn("skill_ci_high", 100 * F.col("ci_high") / scale)


def losses_by_split(losses: DataFrame, split: DataFrame) -> DataFrame:
    """(label, forecaster, split, component, n and the loss's distribution): flag losses by the split of their origins
    (label, origin, split). Rows of forecasters that failed have no loss and do not count."""
    known = losses.join(split.withColumnRenamed("origin", "example"), ["label", "example"])
    return S.distribution(known.where("loss is not null"), ["label", "forecaster", "split", "component"], "loss")


def chosen_entrant(series: DataFrame, split: DataFrame, block: int, seed: int = 20260805) -> DataFrame:
    """(label, entrant, half_life, validation, n_validation, test, frozen, n, gain, ci_low, ci_high, excludes_zero): of the EWMA
    entrants of a ladder (label, origin, entrant, capture_6) the one with the largest mean validation capture, ties to
    the shorter half-life, held against frozen at the test origins."""
    known = tables.cut(series.join(split, ["label", "origin"]))
    tried = known.where("entrant like 'ewma%' and split = 'validation'").groupBy("label", "entrant").agg(F.avg("capture_6").alias("validation"), F.count(F.lit(1)).alias("n_validation")).withColumn("half_life", F.substring_index("entrant", "_", -1).cast("int"))
    best = tried.groupBy("label").agg(F.min_by("entrant", F.struct(-F.col("validation"), "half_life")).alias("entrant"))
    choice = tried.join(best, ["label", "entrant"])
    test = known.where("split = 'test'")
    pairs = test.join(choice.select("label", "entrant"), ["label", "entrant"]).join(test.where("entrant = 'frozen'").select("label", "origin", F.col("capture_6").alias("f")), ["label", "origin"]).withColumn("gain", F.col("capture_6") - F.col("f"))
    means = pairs.groupBy("label", "entrant").agg(F.avg("capture_6").alias("test"), F.avg("f").alias("frozen"))
    told = jobs.intervals(pairs, block, by=("label", "entrant"), seed=seed).withColumnRenamed("mean", "gain")
    return choice.join(means, ["label", "entrant"]).join(told, ["label", "entrant"])


# -- the coupling model ------------------------------------------------------------------------------------


def coupling_states(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives: tuple[float, ...], fast: float = 10, slow: float = 42, lag: int = 3, least: int = 5) -> DataFrame:
    """(label, half_life, origin, n, values, blocks, spread, sums): for each half-life of the base an origin's eigenvalues,
    feature blocks, the target's share in the eigenbasis (N x N) and its part of the sums that the fits need (SUMS,
    one after the other). Vectors and days stay in the kernels: captures need neither.

    Momentum looks lag origins back: frames meet by (label, origin). Stress is the z-score of the estimation window's
    last level among strictly earlier origins, a window frame over one number an origin, 0 before there are least."""

    def head(label, origin, names, past, ahead):
        return [[label, origin, float(np.log(np.square(past[:, -t_out:]).mean())), spectra.frozen_frame(past).ravel().tolist()]]

    heads = tables.cut(map_windows(panel, t_in, t_out, step, head, "label string, origin int, stress double, frame array<double>"))
    stress = heads.select("label", "origin", S.causal_z("stress", Window.partitionBy("label").orderBy("origin"), least).alias("z"))
    earlier = heads.select("label", (F.col("origin") + lag).alias("origin"), F.col("frame").alias("earlier"))

    def first(label, origin, names, past, ahead):
        r = spectra.scaled(ahead, *spectra.scaling(past))
        turn, tree, rows = coupling.speed_gap(past, fast, slow), coupling.tree_gap(past), []
        for half_life in half_lives:
            lam, v = spectra.eigenpairs(coupling.base(past, half_life))
            blocks = [coupling.unit(coupling.visible(change, v)) for change in (turn, tree)]
            rows.append([label, float(half_life), origin, len(names), *(np.ravel(x).tolist() for x in (lam, v, *blocks, coupling.spread(r, v)))])
        return rows

    windows = map_windows(panel, t_in, t_out, step, first, "label string, half_life double, origin int, n int, " + ", ".join(f"{a} array<double>" for a in ("values", "vectors", "quick", "tree", "spread")))
    wide = windows.join(stress, ["label", "origin"]).join(earlier, ["label", "origin"], "left")
    schema = "label string, half_life double, origin int, n int, values array<double>, blocks array<double>, spread array<double>, sums array<double>"

    def second(batches):
        for frame in batches:
            rows = []
            for w in frame.itertuples(index=False):
                lam, v = np.asarray(w.values, float), np.asarray(w.vectors, float).reshape(w.n, w.n)
                quick, tree = (np.asarray(b, float).reshape(w.n - 6, 6) for b in (w.quick, w.tree))
                move = coupling.momentum(np.asarray(w.earlier, float).reshape(w.n, 6), v) if w.earlier is not None else np.zeros_like(quick)
                design = np.stack([quick, move, w.z * quick, tree])
                gap, target = coupling.gaps(lam)[0], np.asarray(w.spread, float).reshape(w.n, w.n)[6:, :6]
                (g, m), (pg, pm) = coupling.gram([design], [target], [gap]), coupling.gram([design], [target], [np.ones_like(gap)])
                slopes = np.array([coupling.gradient(b, gap, target) for b in design])
                rows.append([w.label, w.half_life, w.origin, w.n, lam, design.ravel(), w.spread, np.concatenate([g.ravel(), pg.ravel(), m, pm, slopes])])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return wide.mapInPandas(second, schema)


def coupling_model(panel: DataFrame, t_in: int, t_out: int, step: int, half_lives: tuple[float, ...] = (21.0,), sizes: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2), shares: tuple[float, float] = (0.5, 0.75), count: int = 96) -> DataFrame:
    """(label, half_life, fit, size, split, n, capture, base, selected): weights of the features fitted on the first
    origins, fit and size chosen by capture on the next ones, reported on those and on the last ones.

    Fits are sums over origins; the captures of candidate weights are averages over origins. Origins whose
    windows reach over a border (t_in + t_out days) are left out before validation and before test. The states
    of all origins are read three times and therefore kept; a kernel evaluates all candidates of its origin at once."""
    by = ["label", "half_life"]
    states = coupling_states(panel, t_in, t_out, step, half_lives)
    m = len(FEATURES)
    last = F.max("origin").over(Window.partitionBy(*by))
    cut = [F.floor((last + 1) * share) for share in shares]
    reach = -(-t_out // step)  # targets of later splits open after those of earlier ones have ended
    split = F.when(F.col("origin") < cut[0], "train").when((F.col("origin") >= cut[0] + reach - 1) & (F.col("origin") < cut[1]), "validation").when(F.col("origin") >= cut[1] + reach - 1, "test").otherwise("purged")
    parts = tables.cut(states.withColumn("split", split))
    cells = parts.where("split = 'train'").select(*by, F.posexplode("sums").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"))
    sums = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")).select(*by, F.col("s.x").alias("sums"))

    def fits(batches):
        for frame in batches:
            rows = []
            for w in frame.itertuples(index=False):
                g, pg, moments, pm, slopes = np.split(np.asarray(w.sums, float), np.cumsum([m * m, m * m, m, m]))
                told = [("gradient", coupling.unit(slopes)), ("ridge", coupling.ridge(g.reshape(m, m), moments)), ("geometric", coupling.ridge(pg.reshape(m, m), pm))]
                told += [(f"direction_{k:03d}", d) for k, d in enumerate(coupling.directions(m, count))]
                rows += [[w.label, w.half_life, name, beta] for name, beta in told]
            yield pd.DataFrame(rows, columns=["label", "half_life", "fit", "beta"])

    betas = tables.cut(sums).mapInPandas(fits, "label string, half_life double, fit string, beta array<double>")

    def captures(frame: pd.DataFrame) -> list[list]:
        rows = []
        for w in frame.itertuples(index=False):
            design, share = np.asarray(w.blocks, float).reshape(m, w.n - 6, 6), np.asarray(w.spread, float).reshape(w.n, w.n)
            blocks = np.einsum("cm,mij->cij", np.array([np.asarray(b, float) for b in w.betas]), design)
            for size in w.tried:
                told = coupling.captures(np.asarray(w.values, float), size * blocks, share)
                rows += [[w.label, w.half_life, w.split, name, float(size), float(c), float(np.trace(share[:6, :6]))] for name, c in zip(w.fits, told)]
        return rows

    def measured(candidates: DataFrame, tried: tuple[float, ...], splits: tuple[str, ...]) -> DataFrame:
        schema = "label string, half_life double, split string, fit string, size double, capture double, base double"
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for frame in batches:
                yield pd.DataFrame(captures(frame), columns=names)

        asked = candidates.groupBy(*by).agg(F.collect_list(F.struct("fit", "beta")).alias("c")).select(*by, F.col("c.fit").alias("fits"), F.col("c.beta").alias("betas"), F.array(*[F.lit(t) for t in tried]).alias("tried"))
        use = parts.where(F.col("split").isin(*splits)).select(*by, "split", "n", "values", "blocks", "spread").join(asked, by)
        return use.mapInPandas(run, schema).groupBy(*by, "split", "fit", "size").agg(F.count(F.lit(1)).alias("n"), F.avg("capture").alias("capture"), F.avg("base").alias("base"))

    tried = measured(betas.where("fit like 'direction%'"), sizes[:1], ("train",))
    best = tried.groupBy(*by).agg(F.max_by("fit", F.struct("capture", "fit")).alias("fit"))
    direct = betas.join(best, [*by, "fit"]).select(*by, F.lit("direct").alias("fit"), "beta")
    told = measured(betas.where("not fit like 'direction%'").unionByName(direct), sizes, ("validation", "test"))
    chosen = S.choose(told.where("split = 'validation'").withColumn("loss", -F.col("capture")).withColumn("what", F.struct("fit", "size")), by, "loss", "what").select(*by, "what.fit", "what.size", F.lit(True).alias("selected"))
    return told.join(chosen, [*by, "fit", "size"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def feature_collinearity(states: DataFrame) -> DataFrame:
    """(label, half_life, a, b, correlation): of the features of coupling_states over the eigengaps, summed over origins; a
    feature that is zero throughout has NULL."""
    m = len(FEATURES)
    by = ["label", "half_life"]
    cells = states.select(*by, F.posexplode(F.slice("sums", 1, m * m)).alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"))
    cells = cells.select(*by, F.floor(F.col("at") / m).cast("int").alias("i"), (F.col("at") % m).alias("j"), "x")
    own = cells.where("i = j")
    wide = cells.join(own.select(*by, "i", F.col("x").alias("p")), [*by, "i"]).join(own.select(*by, "j", F.col("x").alias("q")), [*by, "j"])
    named = lambda c: F.get(F.array(*[F.lit(f) for f in FEATURES]), F.col(c))
    return wide.select(*by, named("i").alias("a"), named("j").alias("b"), F.try_divide("x", F.sqrt(F.col("p") * F.col("q"))).alias("correlation"))


def combined_reading(ladder: DataFrame, gains: DataFrame, model: DataFrame) -> DataFrame:
    """(label, frozen, ceiling, bias, headroom, ewma_share, model_share, residual_volatility_cut): what of the honest headroom
    the best EWMA and the chosen model take.

    ladder: (label, frozen, ceiling, bias); gains: (label, entrant, mean) over frozen; model: (label, capture, base)."""
    best = gains.where("entrant like 'ewma%'").groupBy("label").agg(F.max("mean").alias("ewma_gain"))
    wide = ladder.join(best, "label", "left").join(model.select("label", "capture", "base"), "label", "left").withColumn("headroom", F.col("ceiling") - F.col("frozen") - F.col("bias"))
    room = F.when(F.col("headroom") > 0, F.col("headroom"))
    cut = 100 * (1 - F.sqrt((1 - F.col("capture")) / (1 - F.col("base"))))
    return wide.withColumn("ewma_share", F.col("ewma_gain") / room).withColumn("model_share", (F.col("capture") - F.col("base")) / room).withColumn("residual_volatility_cut", cut).drop("capture", "base", "ewma_gain")


def detection_runs(cells: DataFrame, omegas: tuple[float, ...], step: int, replicates: int, seed: int = 11) -> DataFrame:
    """(n, t_in, horizon, omega, replicate, addition_cosine, addition_speed, degrees): the addition statistic in worlds
    that rotate at a known speed, for each cell (n names, days, t_in, horizon)."""
    spread = cells.select("n", "days", "t_in", "horizon").distinct()
    grid = spread.withColumn("omega", F.explode(F.array(*[F.lit(float(o)) for o in omegas]))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    schema = "n int, t_in int, horizon int, omega double, replicate int, addition_cosine double, addition_speed double, degrees double"

    def run(batches):
        for frame in batches:
            rows = []
            for n, days, t, h, o, k in frame[["n", "days", "t_in", "horizon", "omega", "replicate"]].itertuples(index=False):
                world = inference.rotating_panel(int(n), int(days), o, inference.generator(seed, f"{n}/{t}/{h}/{o:.9f}", int(k)))
                nested = [r for r in inference.deletion_rows(world, int(t), int(h), step) if r["component"] == "flag_nested"]
                rows.append([n, t, h, o, k, float(np.nanmean([r["addition_cosine"] for r in nested])), float(np.mean([r["next_speed"] for r in nested])), float(np.degrees(o * h))])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return grid.repartition(grid.sparkSession.sparkContext.defaultParallelism * 2, "n", "t_in", "horizon", "omega", "replicate").mapInPandas(run, schema)


def detection_floors(runs: DataFrame) -> DataFrame:
    """(n, t_in, horizon, n_null, null_mean, null_sd, threshold, detectable_omega, degrees, speed): each cell's first speed
    whose mean passes mean + 1.645 sd of speed 0; NULL where none does."""
    cell = ["n", "t_in", "horizon"]
    null = runs.where("omega = 0").groupBy(*cell).agg(F.count(F.lit(1)).alias("n_null"), F.avg("addition_cosine").alias("null_mean"), F.stddev_samp("addition_cosine").alias("null_sd")).withColumn("threshold", F.col("null_mean") + 1.645 * F.col("null_sd"))
    means = runs.where("omega > 0").groupBy(*cell, "omega").agg(F.avg("addition_cosine").alias("measured"), F.avg("addition_speed").alias("speed"), F.first("degrees").alias("degrees"))
    passed = means.join(null.select(*cell, "threshold"), cell).where("measured > threshold").groupBy(*cell).agg(F.min(F.struct("omega", "degrees", "speed")).alias("first"))
    return null.join(passed, cell, "left").select(*cell, "n_null", "null_mean", "null_sd", "threshold", F.col("first.omega").alias("detectable_omega"), F.col("first.degrees").alias("degrees"), F.col("first.speed").alias("speed"))
