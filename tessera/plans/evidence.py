"""More registered queries: frames and losses with SQL, nulls by component, selection, sweeps and relational checks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tessera.functions import spectra
from tessera.operators import panel as P
from tessera.operators import resampling as R
from tessera.operators import summaries as S
from tessera.operators import windows as W
from tessera.plans import evidence_sql as E
from tessera.plans import jobs, nulls, selection, tuned
from tessera.plans import queries as Q
from tessera.plans.queries import DATES, DRAWS, STEP, T_IN, T_OUT, panel_of, panel_sql, query, r
from tessera.sources import tables

# -- leading vectors of windows in SQL: squaring and deflation, as in frozen_capture ----------------------


def matrices_sql(t: int, step: int, skip: int = 0, every: int | None = None, raw: bool = False) -> str:
    """CTEs up to m (label, origin, mat): the correlation of each window of t days, adjusted by itself. skip leaves
    out the oldest days; windows are then numbered as the whole ones. raw leaves days as they are."""
    return f"""WITH RECURSIVE {panel_sql("month").strip()},
o AS (SELECT DISTINCT label, CAST(t / {step} AS INTEGER) AS origin, t AS s FROM panel WHERE t % {every or step} = 0 AND t + {t} <= (SELECT max(t) + 1 FROM panel)),
e AS (SELECT o.label, origin, name, t - s AS k, x FROM o JOIN panel p ON p.label = o.label AND p.t >= s + {skip} AND p.t < s + {t}),
lv AS (SELECT label, origin, k, avg(x * x) AS l FROM e GROUP BY ALL), rf AS (SELECT label, origin, avg(l) AS m FROM lv WHERE l > 0 GROUP BY ALL),
fl AS (SELECT label, origin, name, k, x / {"1" if raw else "sqrt(CASE WHEN l > 0 THEN l / m ELSE 1 END)"} AS x FROM e JOIN lv USING (label, origin, k) JOIN rf USING (label, origin)),
u AS (SELECT label, origin, name, k, x / stddev_samp(x) OVER (PARTITION BY label, origin, name) AS x FROM fl),
c AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, covar_pop(a.x, b.x) AS v FROM u a JOIN u b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k GROUP BY ALL),
m AS (SELECT label, origin, list(row ORDER BY i) AS mat FROM (SELECT label, origin, i, list(v ORDER BY j) AS row FROM c GROUP BY ALL) GROUP BY ALL)"""


def leading_sql(count: int, source: str = "m", name: str = "f") -> str:
    """CTEs up to name (label, origin, found, lams): the leading vectors and values of the matrices of source."""
    it = f"it_{name}"
    return f""",
{it} AS (
  SELECT label, origin, 0 AS d, 0 AS k, mat, mat AS pw, CAST([] AS DOUBLE[][]) AS found, CAST([] AS DOUBLE[]) AS lams FROM {source}
  UNION ALL
  SELECT label, origin, CASE WHEN k < 24 THEN d ELSE d + 1 END, CASE WHEN k < 24 THEN k + 1 ELSE 0 END,
         CASE WHEN k < 24 THEN mat ELSE rest END, CASE WHEN k < 24 THEN list_transform(sq, lambda r1: list_transform(r1, lambda x1: x1 / big)) ELSE rest END,
         CASE WHEN k < 24 THEN found ELSE list_append(found, unit) END, CASE WHEN k < 24 THEN lams ELSE list_append(lams, lam) END
  FROM (SELECT *, CASE WHEN k < 24 THEN NULL ELSE list_transform(mat, lambda r2, a2: list_transform(r2, lambda x2, b2: x2 - lam * unit[a2] * unit[b2])) END AS rest FROM (
    SELECT *, CASE WHEN k < 24 THEN NULL ELSE list_dot_product(unit, list_transform(mat, lambda r3: list_dot_product(r3, unit))) END AS lam FROM (
    SELECT *, CASE WHEN k < 24 THEN NULL ELSE list_transform(col, lambda x4: x4 / sqrt(list_dot_product(col, col))) END AS unit,
           CASE WHEN k < 24 THEN list_max(list_transform(sq, lambda r5: list_max(list_transform(r5, lambda x5: abs(x5))))) END AS big FROM (
    SELECT *, CASE WHEN k < 24 THEN list_transform(pw, lambda r6: list_transform(pw, lambda r7: list_dot_product(r6, r7))) END AS sq,
           CASE WHEN k < 24 THEN NULL ELSE pw[list_position(list_transform(pw, lambda r8, a8: r8[a8]), list_max(list_transform(pw, lambda r9, a9: r9[a9])))] END AS col
    FROM {it} WHERE d < {count}))))),
{name} AS (SELECT label, origin, found, lams FROM {it} WHERE d = {count})"""


@query("eigenvalue_variogram", matrices_sql(24, 6) + leading_sql(3) + """,
v AS (SELECT label, origin AS w, unnest([1, 2, 3]) AS mode, unnest(lams) AS value FROM f)
SELECT a.label, a.mode, CAST((b.w - a.w) * 6 AS INTEGER) AS lag, count(*) AS n, round(avg(pow(b.value - a.value, 2)), 6) AS gamma FROM v a JOIN v b ON a.label = b.label AND a.mode = b.mode AND b.w > a.w AND b.w - a.w <= 4 GROUP BY ALL""")
def _variogram(spark, sf):
    return jobs.variogram(jobs.eigenvalues(panel_of(spark, sf), 24, 6, 3), 6, 24).select("label", "mode", F.col("lag").cast("int").alias("lag"), "n", r("gamma"))


def distances_sql(t: int, step: int, p: int, q: int, most: int, raw: bool = False) -> str:
    """CTE apart (label, i, j, lag, distance): the product of the principal cosines is the root of a Gram determinant."""
    g = lambda a, b: f"list_sum(list_transform(range(1, {q + 1}), lambda z{a}{b}: list_dot_product(x.found[{a}], y.found[z{a}{b}]) * list_dot_product(x.found[{b}], y.found[z{a}{b}])))"
    return matrices_sql(t, step, raw=raw) + leading_sql(q) + f""",
gram AS (SELECT x.label, x.origin AS i, y.origin AS j, {g(1, 1)} AS g11, {g(2, 2)} AS g22, {g(3, 3)} AS g33, {g(1, 2)} AS g12, {g(1, 3)} AS g13, {g(2, 3)} AS g23 FROM f x JOIN f y ON x.label = y.label AND y.origin > x.origin AND (y.origin - x.origin) * {step} <= {most}),
apart AS (SELECT label, i, j, CAST((j - i) * {step} AS INTEGER) AS lag, -ln(sqrt(g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g23 * g13) + g13 * (g12 * g23 - g22 * g13))) / {p} AS distance FROM gram)"""


@query("window_distances", distances_sql(24, 6, 3, 6, 48) + " SELECT label, i, j, lag, round(distance, 6) AS distance FROM apart")
def _distances(spark, sf):
    return jobs.window_distances(panel_of(spark, sf), 24, 6, 3, 6, 48).select("label", "i", "j", F.col("lag").cast("int").alias("lag"), r("distance"))


@query("window_distances_raw", distances_sql(24, 6, 3, 6, 48, True) + " SELECT label, i, j, lag, round(distance, 6) AS distance FROM apart")
def _distances_raw(spark, sf):
    """Distances of windows whose days keep their own level."""
    states = jobs.spectral_states(panel_of(spark, sf), 24, 6, 3, 6, ("raw",))
    return jobs.state_distances(states, 6, 3, 6, 48).select("label", "i", "j", F.col("lag").cast("int").alias("lag"), r("distance"))


def _gap_sql(raw: bool) -> str:
    return f"SELECT * FROM ({matrices_sql(36, 6, raw=raw)}{leading_sql(7)} SELECT label, '{'raw' if raw else 'standardised'}' AS mode, CAST(origin AS INTEGER) AS w, round(lams[1], 6) AS first, round(lams[3], 6) AS gap_high, round(lams[7], 6) AS gap_low FROM f)"


@query("gap_ends", _gap_sql(False) + " UNION ALL " + _gap_sql(True))
def _gaps(spark, sf):
    """The largest eigenvalue and both ends of the gap between the third and the seventh, in both modes."""
    states = jobs.spectral_states(panel_of(spark, sf), 36, 6, 3, 6, ("standardised", "raw"))
    return states.select("label", "mode", "w", F.round(F.element_at("values", 1), 6).alias("first"), r("gap_high"), r("gap_low"))


@query("mode_comparison")
def _modes(spark, sf):
    """Distance over its null by lag, standardised and raw side by side, one row a lag with both modes' columns."""
    states = jobs.spectral_states(panel_of(spark, sf), 24, 6, 3, 6, ("standardised", "raw"))
    by = jobs.state_distances(states, 6, 3, 6, 48).groupBy("label", "lag", "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"), F.avg("null").alias("null"))
    ratio = by.withColumn("ratio", F.try_divide("distance", "null"))
    return ratio.groupBy("label", "lag").pivot("mode", ["standardised", "raw"]).agg(*[F.first(c).alias(c) for c in ("n", "distance", "null", "ratio")])


@query("distance_by_lag", distances_sql(24, 6, 3, 6, 48) + " SELECT label, CAST(round_even(lag / 12.0, 0) * 12 AS BIGINT) AS lag_bin, count(*) AS n, round(avg(distance), 6) AS distance FROM apart GROUP BY ALL")
def _lag(spark, sf):
    return S.lag_bins(jobs.window_distances(panel_of(spark, sf), 24, 6, 3, 6, 48), 12, "distance").select("label", "lag_bin", "n", r("distance"))


@query("distance_excess")
def _excess(spark, sf):
    """Distances over their closed-form null, by lag, with their ratio, the rotation they stand for and the sample's halves."""
    pairs = jobs.window_distances(panel_of(spark, sf), 24, 6, 3, 6, 48)
    middle = F.max("j").over(W.Window.partitionBy("label")) / 2
    halves = pairs.withColumn("early", (F.col("i") + F.col("j")) / 2 < middle)
    half = lambda early: F.avg(F.when(F.col("early") == early, F.col("distance")))
    told = halves.groupBy("label", "lag").agg(F.count(F.lit(1)).alias("pairs"), F.avg("distance").alias("distance"), F.avg("null").alias("null"), F.stddev_samp(F.col("distance") / F.col("null")).alias("ratio_sd"), half(True).alias("early"), half(False).alias("late"))
    excess = F.col("distance") - F.col("null")
    told = told.withColumn("excess", excess).withColumn("ratio", F.try_divide("distance", "null")).withColumn("angle", F.when(excess > 0, F.degrees(F.acos(F.exp(-3 * excess)))))
    return told.join(told.groupBy("label").agg(F.regr_slope("excess", "lag").alias("slope"), F.corr("excess", "lag").alias("correlation")), "label")


def losses_sql(now: str, k: int = 1) -> str:
    """losses of the frames now (label, origin, found) against f, k windows later, by component; both neighbours must be there."""
    return f""",
dot AS (SELECT a.label, a.origin AS example, i, j, pow(list_dot_product(a.found[i], b.found[j]), 2) AS s FROM {now} a JOIN f b ON a.label = b.label AND b.origin = a.origin + {k} JOIN f z ON a.label = z.label AND z.origin = a.origin - {k}, (SELECT unnest(range(1, 7)) AS i) i, (SELECT unnest(range(1, 7)) AS j) j),
parts(component, lo, hi) AS (VALUES ('market_1', 1, 1), ('block_2_3', 2, 3), ('block_4_6', 4, 6), ('top_3', 1, 3), ('top_6', 1, 6)),
single AS (SELECT label, example, component, greatest(0, hi - lo + 1 - sum(s)) / (hi - lo + 1) AS loss FROM dot, parts WHERE i BETWEEN lo AND hi AND j BETWEEN lo AND hi GROUP BY label, example, component, lo, hi),
losses AS (SELECT * FROM single UNION ALL SELECT label, example, 'flag_nested', avg(loss) FROM single WHERE component IN ('market_1', 'top_3', 'top_6') GROUP BY label, example)"""


FROZEN_SQL = matrices_sql(36, 6) + leading_sql(6) + losses_sql("f")
RETAINED_SQL = matrices_sql(36, 6) + leading_sql(6) + f""",
kept AS (WITH RECURSIVE {matrices_sql(36, 6, 6).removeprefix("WITH RECURSIVE ")}{leading_sql(6, "m", "g")} SELECT * FROM g)""" + losses_sql("kept")


@query("frozen_losses", FROZEN_SQL + " SELECT label, example, component, round(loss, 6) AS loss FROM losses")
def _frozen(spark, sf):
    return jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("frozen",)).select("label", "example", "component", r("loss"))


@query("retained_losses", RETAINED_SQL + " SELECT label, example, component, round(loss, 6) AS loss FROM losses")
def _retained(spark, sf):
    return jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("retained",)).select("label", "example", "component", r("loss"))


@query("loss_summary", FROZEN_SQL + " SELECT label, component, count(loss) AS n, round(avg(loss), 6) AS mean, round(quantile_cont(loss, 0.5), 6) AS median, round(quantile_cont(loss, 0.25), 6) AS q25, round(quantile_cont(loss, 0.75), 6) AS q75, round(stddev_samp(loss), 6) AS sd, round(max(loss), 6) AS max FROM losses GROUP BY ALL")
def _loss_summary(spark, sf):
    out = S.distribution(jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("frozen",)), ["label", "component"], "loss")
    return out.select("label", "component", "n", *[r(c) for c in ("mean", "median", "q25", "q75", "sd", "max")])


PAIRED_SQL = RETAINED_SQL.replace("losses AS", "mine AS").replace("single", "single_r").replace("dot AS", "dot_r AS").replace("FROM dot,", "FROM dot_r,").replace("parts(", "parts_r(").replace(" parts ", " parts_r ") + losses_sql("f") + ", both_ AS (SELECT label, component, example, a.loss AS m, b.loss AS rr FROM mine a JOIN losses b USING (label, component, example))"


@query("flag_skill", PAIRED_SQL + " SELECT label, component, count(*) AS n, round(avg(m), 6) AS model_mean, round(avg(rr), 6) AS reference_mean, round(avg(rr - m), 6) AS paired_improvement, round(avg(CASE WHEN rr > m THEN 1 ELSE 0 END), 6) AS win_fraction, round(100 * avg(rr - m) / greatest(avg(rr), 2.2250738585072014e-308), 4) AS skill_percent FROM both_ GROUP BY ALL")
def _skill(spark, sf):
    losses = jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("frozen", "retained"))
    one = lambda name: losses.where(F.col("forecaster") == name).drop("forecaster", "failure")
    out = S.paired(one("retained"), one("frozen"), ["label", "example", "component"], "loss", ["label", "component"], True)
    return out.select("label", "component", "n", *[r(c) for c in ("model_mean", "reference_mean", "paired_improvement", "win_fraction")], r("skill_percent", 4))


@query("combined_skill", PAIRED_SQL + ", s AS (SELECT label, component, 100 * avg(rr - m) / greatest(avg(rr), 2.2250738585072014e-308) AS k FROM both_ GROUP BY ALL) SELECT component, round(avg(k), 4) AS combined, round(quantile_cont(k, 0.5), 4) AS median, round(min(k), 4) AS worst, round(max(k), 4) AS best, count(*) FILTER (WHERE k > 0) AS panels_improved, count(*) AS n_panels FROM s GROUP BY ALL")
def _combined(spark, sf):
    losses = jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("frozen", "retained"))
    one = lambda name: losses.where(F.col("forecaster") == name).drop("forecaster", "failure")
    out = S.combine_panels(S.paired(one("retained"), one("frozen"), ["label", "example", "component"], "loss", ["label", "component"], True))
    return out.select("component", *[r(c, 4) for c in ("combined", "median", "worst", "best")], "panels_improved", "n_panels")


@query("loss_comparisons")
def _loss_comparisons(spark, sf):
    """Every forecaster against frozen, with intervals by circular blocks."""
    return selection.loss_comparisons(jobs.flag_losses(panel_of(spark, sf), 36, 6, 6), W.block_length(36, 12, 6))


# -- cleaning, windows and streams with SQL ----------------------------------------------------------------

CLEAN_SQL = Q.BREAKS_SQL.replace(f"abs(x) > {Q.BREAK}", "abs(x) > 2.0") + """,
gone AS (SELECT label, name FROM breaks GROUP BY ALL HAVING count(*) FILTER (WHERE kind IN ('split', 'spike')) > 4 OR count(*) FILTER (WHERE kind = 'large_move') > 20),
held AS (SELECT raw.label, raw.name, raw.d, CASE WHEN b.d IS NULL THEN raw.x END AS x FROM raw LEFT JOIN (SELECT DISTINCT label, name, d FROM breaks WHERE kind IN ('split', 'spike')) b ON raw.label = b.label AND raw.name = b.name AND raw.d = b.d WHERE (raw.label, raw.name) NOT IN (SELECT (label, name) FROM gone)),
z AS (SELECT label, name, d, x, coalesce(x, 0) = 0 AS still, sum(CASE WHEN coalesce(x, 0) = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY label, name ORDER BY d ROWS UNBOUNDED PRECEDING) AS island FROM held),
runs AS (SELECT label, name, max(k) AS longest FROM (SELECT label, name, island, count(*) FILTER (WHERE still) AS k FROM z GROUP BY ALL) GROUP BY ALL),
fine AS (SELECT label, name FROM z JOIN runs USING (label, name) GROUP BY ALL HAVING count(x) / count(*) >= 0.5 AND any_value(longest) <= 10 AND count(*) FILTER (WHERE still) / count(*) <= 0.1),
whole AS (SELECT held.*, count(*) FILTER (WHERE x IS NULL) OVER (PARTITION BY label, d) AS holes FROM held JOIN fine USING (label, name))
SELECT label, name, CAST(d AS VARCHAR) AS day, CAST(dense_rank() OVER (PARTITION BY label ORDER BY d) - 1 AS INTEGER) AS t, round(x, 6) AS x FROM whole WHERE holes = 0"""


@query("clean_returns", CLEAN_SQL)
def _clean(spark, sf):
    """The whole cleaning chain; the threshold suits monthly prices that move by half."""
    return P.clean_returns(Q._prices(spark, sf, "month"), threshold=2.0, least=0.5).select("label", "name", F.col("day").cast("string").alias("day"), "t", r("x"))


SPLIT_SQL = Q.ORIGINS_SQL + f", s AS (SELECT o.label, origin, b.d AS target_day, c.d AS first_day, CASE WHEN b.d <= DATE '2000-06-30' THEN 'train' WHEN b.d BETWEEN DATE '2000-08-01' AND DATE '2001-01-31' THEN 'validation' WHEN b.d >= DATE '2001-03-01' THEN 'test' ELSE 'purged' END AS split FROM o JOIN days b ON b.label = o.label AND b.t = s + {T_IN + T_OUT - 1} JOIN days c ON c.label = o.label AND c.t = s + {T_IN})"


@query("split_overlaps", SPLIT_SQL + " SELECT label, coalesce(min(first_day) FILTER (WHERE split = 'validation') <= max(target_day) FILTER (WHERE split = 'train') OR min(first_day) FILTER (WHERE split = 'test') <= max(target_day) FILTER (WHERE split = 'validation'), true) AS overlaps FROM s GROUP BY ALL")
def _overlaps(spark, sf):
    return W.split_overlaps(jobs.splits_of(panel_of(spark, sf), T_IN, T_OUT, STEP, **DATES))


@query("nonoverlapping_targets", SPLIT_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, taken AS (
  SELECT label, split, min(target_day) AS last, 1 AS n FROM s GROUP BY ALL
  UNION ALL
  SELECT t.label, t.split, (SELECT min(target_day) FROM s WHERE s.label = t.label AND s.split = t.split AND first_day > t.last), n + 1 FROM taken t
  WHERE EXISTS (SELECT 1 FROM s WHERE s.label = t.label AND s.split = t.split AND first_day > t.last))
SELECT label, split, CAST(max(n) AS INTEGER) AS n_nonoverlap FROM taken GROUP BY ALL""")
def _nonoverlap(spark, sf):
    return S.nonoverlapping(jobs.splits_of(panel_of(spark, sf), T_IN, T_OUT, STEP, **DATES))


@query("covariance_examples", Q.ORIGINS_SQL + f" SELECT o.label, CAST(origin - {T_OUT // STEP} AS INTEGER) AS example, origin, CAST(a.d AS VARCHAR) AS origin_day, CAST(b.d AS VARCHAR) AS target_day FROM o JOIN days a ON a.label = o.label AND a.t = s + {T_IN - 1} JOIN days b ON b.label = o.label AND b.t = s + {T_IN + T_OUT - 1} WHERE origin >= {T_OUT // STEP}")
def _examples(spark, sf):
    """Origins whose motions before and after are known: the first and last horizon of days are withheld."""
    out = selection.example_splits(panel_of(spark, sf), T_IN, T_OUT, STEP, **DATES)
    return out.select("label", F.col("example").cast("int").alias("example"), "origin", *[F.col(c).cast("string").alias(c) for c in ("origin_day", "target_day")])


@query("window_cv2", f"""WITH {panel_sql("month")}, v AS (SELECT label, t, avg(x * x) AS l FROM panel GROUP BY ALL), o AS (SELECT DISTINCT label, t AS s FROM panel WHERE t % 6 = 0 AND t + 24 <= (SELECT max(t) + 1 FROM panel)),
w AS (SELECT o.label, s, avg(l * l) / nullif(avg(l) * avg(l), 0) - 1 AS c FROM o JOIN v ON v.label = o.label AND v.t >= s AND v.t < s + 24 GROUP BY ALL)
SELECT label, round(avg(c), 6) AS mean_cv2, round(max(c), 6) AS max_cv2, count(*) AS windows FROM w GROUP BY ALL""")
def _cv2(spark, sf):
    return nulls.window_levels(panel_of(spark, sf), 24, 6).select("label", r("mean_cv2"), r("max_cv2"), "windows")


CELLS = [(24, 6), (36, 6), (36, 12)]


@query("sweep_geometry", f"""WITH {panel_sql("month")}, n AS (SELECT label, count(DISTINCT name) AS names, count(DISTINCT t) AS days FROM panel GROUP BY ALL), cells(t_in, horizon) AS (VALUES (24, 6), (36, 6), (36, 12)),
g AS (SELECT label, t_in, horizon, names, days, (days - t_in) // 6 + 1 AS windows FROM n, cells)
SELECT label, t_in, horizon, names, days, windows, windows - 2 * (horizon // 6) AS origins, CAST(ceil((t_in + 2 * horizon) / 6) AS BIGINT) AS block, round(names / t_in, 6) AS q, round(horizon / t_in, 6) AS deletion_fraction, round((windows - 2 * (horizon // 6)) / ceil((t_in + 2 * horizon) / 6), 6) AS independent_blocks FROM g""")
def _geometry(spark, sf):
    return nulls.geometry(panel_of(spark, sf), CELLS, 6).select("label", "t_in", "horizon", "names", "days", "windows", "origins", "block", r("q"), r("deletion_fraction"), r("independent_blocks"))


@query("residual_panel", f"""WITH {panel_sql("month")}, m AS (SELECT label, t, avg(x) AS m FROM panel GROUP BY ALL), b AS (SELECT label, name, regr_slope(x, m) AS b, regr_intercept(x, m) AS a FROM panel JOIN m USING (label, t) GROUP BY ALL)
SELECT label, name, t, round(x - a - b * m, 8) AS x FROM panel JOIN m USING (label, t) JOIN b USING (label, name)""")
def _residual(spark, sf):
    return nulls.residual_panel(panel_of(spark, sf)).select("label", "name", "t", r("x", 8))


@query("causal_stress", f"""WITH {panel_sql("month")}, v AS (SELECT label, t, ln(avg(x * x)) AS s FROM panel GROUP BY ALL), z AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS sd FROM v WINDOW w AS (PARTITION BY label ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT label, t, round(CASE WHEN n >= 20 AND sd > 0 THEN (s - m) / sd ELSE 0 END, 6) AS z FROM z""")
def _stress(spark, sf):
    """The log level of each day among strictly earlier days."""
    level = P.variance_path(panel_of(spark, sf)).withColumn("s", F.ln("level"))
    return level.select("label", "t", F.round(S.causal_z("s", W.Window.partitionBy("label").orderBy("t")), 6).alias("z"))


@query("sliding_volatility_stream", """WITH e AS (SELECT event_type, ts, value FROM events WHERE value IS NOT NULL),
w AS (SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL (3 * k) HOUR AS start, value FROM e, (VALUES (0), (1)) h(k))
SELECT event_type, CAST(start AS VARCHAR) AS start, count(*) AS n, round(var_pop(value) + 1e-9, 4) AS variance FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR GROUP BY ALL""")
def _stream(spark, sf):
    # variances of two-digit values can be exact ties: the small term decides them alike everywhere
    from tessera.streaming.volatility import run_once

    return run_once(spark, sf).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round(F.col("variance") + 1e-9, 4).alias("variance"))


# -- relational operators over plain tables ----------------------------------------------------------------

YEARS = "CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'train' WHEN o_orderdate < DATE '1997-01-01' THEN 'validation' ELSE 'test' END"


@query("validation_choice", f"WITH s AS (SELECT o_orderpriority AS label, o_orderstatus AS estimator, {YEARS} AS split, o_totalprice AS loss FROM orders), t AS (SELECT label, estimator, avg(loss) FILTER (WHERE split = 'validation') AS v, count(*) FILTER (WHERE split = 'validation') AS nv, avg(loss) FILTER (WHERE split = 'test') AS t, count(*) FILTER (WHERE split = 'test') AS nt FROM s GROUP BY ALL HAVING nv > 0) SELECT label, estimator, round(v, 4) AS validation_loss, nv AS n_validation, round(t, 4) AS test_loss, nt AS n_test, row_number() OVER (PARTITION BY label ORDER BY v, estimator) = 1 AS selected FROM t")
def _validation(spark, sf):
    """What choose_half_life and damping_grid choose by, over orders: no test row takes part in the choice."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("estimator"), F.expr(YEARS).alias("split"), F.col("o_totalprice").alias("loss"))
    some = rows.join(rows.where("split = 'validation'").select("label", "estimator").distinct(), ["label", "estimator"], "left_semi")
    return S.choose_on_validation(some, ["label"], "estimator", "loss").select("label", "estimator", r("validation_loss", 4), "n_validation", r("test_loss", 4), "n_test", "selected")


@query("detectable_excess", Q.P_SQL.replace("max(price) * 0.9", "avg(price) * 1.5") + ", d AS (SELECT label, value, count(draw) AS n_null, avg(draw) AS mean, stddev_samp(draw) AS sd, quantile_cont(draw, 0.95) AS q95, (1 + count(*) FILTER (WHERE draw >= value)) / (1 + count(draw)) AS p FROM j GROUP BY ALL) SELECT label, round(value, 4) AS value, n_null, round(mean, 4) AS null_mean, round(sd, 4) AS null_sd, round(q95, 4) AS null_q95, round(1.645 * sd, 4) AS normal_excess, round(q95 - mean, 4) AS q95_excess, round(1 / (n_null + 1), 8) AS p_floor, round(value - mean, 4) AS excess, round((value - mean) / sd, 6) AS z, round((value - mean) / (q95 - mean), 6) AS powered_ratio, round(p, 8) AS p FROM d")
def _detectable(spark, sf):
    scores = Q._order_scores(spark, sf)
    observed = scores.groupBy("label").agg((F.avg("price") * 1.5).alias("value"))
    out = nulls.detectable(observed, scores.select("label", F.col("price").alias("value")), ["label"], "value")
    return out.select("label", r("value", 4), "n_null", *[r(c, 4) for c in ("null_mean", "null_sd", "null_q95", "normal_excess", "q95_excess")], r("p_floor", 8), r("excess", 4), r("z"), r("powered_ratio"), r("p", 8))


@query("example_sets", "WITH s AS (SELECT DISTINCT o_orderpriority AS label, o_orderstatus AS estimator, month(o_orderdate) AS example FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderstatus <> 'P'), n AS (SELECT label, count(DISTINCT example) AS expected FROM s GROUP BY ALL) SELECT label, estimator, count(*) AS n, any_value(expected) AS expected, count(*) = any_value(expected) AS complete FROM s JOIN n USING (label) GROUP BY label, estimator")
def _sets(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 7 <> 0 or o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("estimator"), F.month("o_orderdate").alias("example"))
    return S.example_sets(rows, "estimator", "example")


@query("value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY ALL")
def _counts(spark, sf):
    return S.value_counts(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "n", r("share", 8))


@query("common_keys", "SELECT c_nationkey AS nation FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def _common(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("nation"))
    return S.common_keys(customers, spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("first_of_each", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def _first(spark, sf):
    return S.first_of_each(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", r("o_totalprice", 2, "price"))


@query("first_crossing", "WITH c AS (SELECT o_orderpriority AS label, CAST(month(o_orderdate) AS DOUBLE) AS x, sum(o_totalprice) AS v FROM orders GROUP BY ALL), y AS (SELECT label, x, sum(v) OVER w / sum(v) OVER (PARTITION BY label) AS y FROM c WINDOW w AS (PARTITION BY label ORDER BY x ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM y WINDOW w AS (PARTITION BY label ORDER BY x)) SELECT label, round(min(CASE WHEN y0 IS NULL THEN x ELSE x0 + (0.5 - y0) / (y - y0) * (x - x0) END), 6) AS crossing FROM s WHERE y >= 0.5 AND (y0 IS NULL OR y0 < 0.5) GROUP BY ALL")
def _crossing(spark, sf):
    """Where each priority's cumulated share of a year's value passes one half."""
    months = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderpriority").alias("label"), F.month("o_orderdate").cast("double").alias("x")).agg(F.sum("o_totalprice").alias("v"))
    label = W.Window.partitionBy("label")
    curve = months.withColumn("y", F.sum("v").over(label.orderBy("x").rowsBetween(W.Window.unboundedPreceding, 0)) / F.sum("v").over(label))
    return S.first_crossing(curve, ["label"], "x", "y", 0.5).select("label", r("crossing"))


@query("distance_slope", "SELECT o_orderpriority AS label, round(regr_slope(o_totalprice, o_orderkey % 97), 6) AS slope, round(regr_intercept(o_totalprice, o_orderkey % 97), 4) AS intercept, round(corr(o_totalprice, o_orderkey % 97), 8) AS correlation FROM orders GROUP BY ALL")
def _slope(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("label"), (F.col("o_orderkey") % 97).alias("lag"), F.col("o_totalprice").alias("v"))
    return rows.groupBy("label").agg(F.round(F.regr_slope("v", "lag"), 6).alias("slope"), F.round(F.regr_intercept("v", "lag"), 4).alias("intercept"), F.round(F.corr("v", "lag"), 8).alias("correlation"))


@query("business_days", "WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders), d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT CAST(day AS VARCHAR) AS day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS number FROM d WHERE isodow(day) < 6")
def _business(spark, sf):
    """The business calendar that the orders span."""
    return tables.business_days(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate").select(F.col("day").cast("string").alias("day"), "number")


@query("closed_forms", "WITH v AS (SELECT c_custkey AS k, 1.5 + abs(c_acctbal) / 1000 AS lam, 250 + c_custkey AS t FROM customer) SELECT k, round(4 * lam * lam / t, 8) AS variogram_null, round(lam * pow(1 + sqrt(25 / t), 2), 8) AS bulk_edge, round(-ln(cos(lam / 20)) / 3, 8) AS injected, round(degrees(acos(exp(-3 * lam / 100))), 6) AS excess_angle, round((lam + 3) / (lam + 1), 8) AS student_factor, round((lam / 100) / (0.2 - lam / 1000 - 0.01), 8) AS skill FROM v")
def _forms(spark, sf):
    """The kernels' closed forms as columns (their kernels are tested against the same formulas)."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), (1.5 + F.abs("c_acctbal") / 1000).cast("double").alias("lam"), (250 + F.col("c_custkey")).cast("double").alias("t"))
    lam, t = F.col("lam"), F.col("t")
    forms = {"variogram_null": 4 * lam * lam / t, "bulk_edge": lam * F.pow(1 + F.sqrt(25 / t), F.lit(2)), "injected": -F.ln(F.cos(lam / 20)) / 3, "excess_angle": F.degrees(F.acos(F.exp(-3 * lam / 100))), "student_factor": (lam + 3) / (lam + 1), "skill": lam / 100 / (0.2 - lam / 1000 - 0.01)}
    return rows.select("k", *[F.round(c, 6 if n == "excess_angle" else 8).alias(n) for n, c in forms.items()])


@query("sorted_orders", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 100")
def _sorted(spark, sf):
    """A report: the first hundred by several keys, ties to the smaller key."""
    first = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)
    order = W.Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")  # of a hundred rows
    return first.select("o_orderkey", F.row_number().over(order).alias("place"))


# -- motion against nulls, sweeps and combined readings ----------------------------------------------------


@query("deletion_attribution")
def _deletion(spark, sf):
    """What the days that leave a window explain of its motion, at every triple."""
    return nulls.deletions(panel_of(spark, sf), 0, 36, 6, 6).drop("replicate")


for _kind in ("calendar", "volatility"):

    @query(f"deletion_null_{_kind}")
    def _deletion_null(spark, sf, kind=_kind):
        summary = nulls.means(nulls.deletions(panel_of(spark, sf), DRAWS, 36, 6, 6, kind), nulls.DELETION, "addition_cosine")
        return nulls.held_against(summary, "mean_addition_cosine")


@query("market_residual_null")
def _market_null(spark, sf):
    """Persistence once each window has lost its equal-weight return, against calendar blocks, with coherence and gaps."""
    panel = panel_of(spark, sf)
    told = nulls.held_against(nulls.means(nulls.motions(panel, DRAWS, 36, 6, 6, "calendar", market=False), nulls.MOTION, "cosine"), "mean_cosine")
    shared = nulls.held_against(nulls.coherence(panel, DRAWS, 36, 6, 6, market=False), "leading_share").select("label", "component", "leading_share", F.col("p").alias("coherence_p"))
    gaps = nulls.relative_gaps(panel, 36, 6, 6, market=False).groupBy("label").pivot("dimension", [1, 3, 6]).agg(F.first("gap"))
    return told.join(shared, ["label", "component"]).join(gaps.toDF("label", "gap_1", "gap_3", "gap_6"), "label")


@query("surrogate_errors")
def _surrogates(spark, sf):
    return nulls.surrogate_report(panel_of(spark, sf), DRAWS)


RV_SQL = "WITH " + E.levels_sql(panel_sql("week")) + ", " + E.exchanged_sql(99, 6, 3) + ", " + E.rv_sql((5, 10, 21))


@query("rv_nulls", RV_SQL + " SELECT label, scale, round(max(value) FILTER (WHERE replicate = 0 AND kind = 'calendar'), 6) AS observed, round(avg(value) FILTER (WHERE replicate > 0 AND kind = 'calendar'), 6) AS calendar, round(avg(value) FILTER (WHERE replicate > 0 AND kind = 'volatility'), 6) AS volatility, CAST(max(replicate) AS INTEGER) AS n_replicates FROM st GROUP BY ALL")
def _rv_nulls(spark, sf):
    return nulls.rv_nulls(panel_of(spark, sf, "week"), 99).select("label", "scale", r("observed"), r("calendar"), r("volatility"), "n_replicates")


PANELS = ("month", "week", "nation", "events")


def panels_of(spark, sf):
    """The four panels of the tables as one, by label; days as text."""
    out = None
    for kind in PANELS:
        one = panel_of(spark, sf, kind).withColumn("day", F.col("day").cast("string"))
        out = one if out is None else out.unionByName(one)
    return out


@query("combined_rv_null", "WITH " + E.levels_sql(*map(panel_sql, PANELS)) + ", " + E.exchanged_sql(199, 6, 3) + ", " + E.rv_sql((5,)) + ", " + E.combined_sql("st", ("kind",)) + " SELECT label, kind, n_panels, round(observed, 8) AS observed, round(null_mean, 8) AS null_mean, round(null_q95, 8) AS null_q95, n_null, round(p, 8) AS p, round(holm, 8) AS holm FROM cb")
def _combined_rv(spark, sf):
    """Persistence of realised variance in four panels against both block nulls: each panel, Holm over panels, and all panels
    with the same weight."""
    out = nulls.combined(nulls.rv_statistics(panels_of(spark, sf), 199, (5,)), "value", ["kind"])
    return out.select("label", "kind", "n_panels", *[r(c, 8) for c in ("observed", "null_mean", "null_q95")], "n_null", r("p", 8), r("holm", 8))


@query("combined_deletion_null")
def _combined_deletion(spark, sf):
    """The headline evidence: the motion that new days add, over four panels, by panel and with equal weights, against both nulls."""
    told, panel = None, tables.cut(panels_of(spark, sf))
    for kind in ("calendar", "volatility"):
        one = nulls.means(nulls.deletions(panel, DRAWS, 36, 6, 6, kind), nulls.DELETION, "addition_cosine").select("label", "replicate", "component", F.col("mean_addition_cosine").alias("value"), F.lit(kind).alias("kind"))
        told = one if told is None else told.unionByName(one)
    return nulls.combined(told.where(F.col("component").isin(*nulls.PRIMARY)), "value", ["kind", "component"])


@query("window_sweep")
def _sweep(spark, sf):
    return nulls.sweep(tables.cut(panel_of(spark, sf)), CELLS, 6, DRAWS)


@query("resumed_null")
def _resumed(spark, sf):
    """Some draws, then all, of which the first are there already; the table is read back as one null."""
    where, panel = f"{tables.shared_folder(spark)}/null-{uuid.uuid4().hex}", tables.cut(panel_of(spark, sf))
    nulls.resumed(panel, where, DRAWS // 2, 36, 6, 6)
    summary = nulls.resumed(panel, where, DRAWS, 36, 6, 6)
    return nulls.held_against(summary, "mean_addition_cosine")


@query("resumable_results", "SELECT CAST(month(o_orderdate) AS INTEGER) AS replicate, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def _resume(spark, sf):
    """Orders by month: the first months are written, the rest are found missing and added; all are read back."""
    where = f"{tables.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    wanted = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.month("o_orderdate").alias("replicate")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    tables.append_results(wanted.where("replicate < 5"), where)
    tables.append_results(tables.missing_keys(wanted, where, ["replicate"]), where)
    return spark.read.parquet(where).select(F.col("replicate").cast("int").alias("replicate"), "n", "value")


@query("spectrum_report")
def _spectrum(spark, sf):
    return nulls.spectrum_of(panel_of(spark, sf), T_IN, 3, 6)


@query("foresight_comparisons")
def _foresight_pairs(spark, sf):
    """Each oracle against the control, paired by origin, with an interval."""
    scores = jobs.foresight(panel_of(spark, sf), T_IN, T_OUT, 4)
    return selection.comparisons(scores, ["label", "origin"], "forecast", "control", ["nll", "long_only_vol"], W.block_length(T_IN, T_OUT, 4))


@query("covariance_by_split")
def _by_split(spark, sf):
    """Scores of every estimator by chronological split; purged origins have their own rows."""
    panel = panel_of(spark, sf)
    splits = W.chronological_splits(W.origins(panel, T_IN, T_OUT, 4), **DATES).select("label", "origin", "split")
    scores = Q._scores(spark, sf).join(splits, ["label", "origin"])
    long = scores.unpivot(["label", "origin", "estimator", "split"], Q.METRICS, "metric", "score")
    return S.distribution(long, ["label", "estimator", "split", "metric"], "score")


@query("combined_reading")
def _reading(spark, sf):
    """What of the honest headroom the best EWMA and the chosen coupling model take."""
    panel = panel_of(spark, sf)
    ladder = jobs.capture_ladder(panel, 36, 6, 1).groupBy("label").agg(F.avg("capture_6").alias("frozen"), F.avg("ceiling_6").alias("ceiling")).join(jobs.bias(panel, 36, 6, 1, 6).groupBy("label").agg(F.avg("bias_6").alias("bias")), "label")
    model = selection.coupling_model(panel, 36, 6, 1).where("selected and split = 'test'")
    return selection.combined_reading(ladder, jobs.ladder_comparisons(panel, 36, 6, 1), model)


@query("ladder_long")
def _long(spark, sf):
    """The ladder's entrants on the daily panel of brands: windows of 750 days, 42 ahead, every 14."""
    return jobs.entrants(panel_of(spark, sf, "day"), 750, 42, 14).groupBy("label", "entrant").agg(F.count(F.lit(1)).alias("origins"), F.avg("capture_6").alias("capture_6"))


@query("coupling_long")
def _coupling_long(spark, sf):
    """The coupling model with every half-life on the same windows."""
    return selection.coupling_model(panel_of(spark, sf, "day"), 750, 42, 14, (10.0, 21.0, 42.0, 63.0))


# -- choices on validation that drive test forecasts -------------------------------------------------------

GRID = (6.0, 12.0, 24.0, 48.0)
TUNED_DATES = {"train_end": "1999-12-31", "validation_start": "2000-02-01", "validation_end": "2000-09-30", "test_start": "2000-11-01"}
_CUT = f"CASE WHEN b.d BETWEEN DATE '{TUNED_DATES['validation_start']}' AND DATE '{TUNED_DATES['validation_end']}' THEN 'validation' WHEN b.d >= DATE '{TUNED_DATES['test_start']}' THEN 'test' ELSE 'other' END"
TUNED_SQL = (
    matrices_sql(36, 1)
    + leading_sql(6)
    + f""",
sp AS (SELECT o.label, origin, {_CUT} AS split FROM o JOIN (SELECT DISTINCT label, t, d FROM panel) b ON b.label = o.label AND b.t = s + 41 WHERE origin >= 6),
fd AS (SELECT fl.* FROM fl JOIN sp USING (label, origin) WHERE split IN ('validation', 'test')),"""
    + E.ewma_sql("fd", 36, GRID)
    + leading_sql(6, "em", "fe")
    + """,
pr AS (SELECT split_part(label, '#', 1) AS label, origin, CAST(split_part(label, '#', 2) AS DOUBLE) AS h, found FROM fe UNION ALL SELECT label, origin, 0, found FROM f JOIN sp USING (label, origin)),
dots AS (SELECT a.label, a.origin, h, i, j, pow(list_dot_product(a.found[i], b.found[j]), 2) AS s FROM pr a JOIN f b ON a.label = b.label AND b.origin = a.origin + 6, (SELECT unnest(range(1, 7)) AS i) i, (SELECT unnest(range(1, 7)) AS j) j),
parts(component, lo, hi) AS (VALUES ('market_1', 1, 1), ('block_2_3', 2, 3), ('block_4_6', 4, 6), ('top_3', 1, 3), ('top_6', 1, 6)),
single AS (SELECT label, origin, h, component, greatest(0, hi - lo + 1 - sum(s)) / (hi - lo + 1) AS loss FROM dots, parts WHERE i BETWEEN lo AND hi AND j BETWEEN lo AND hi GROUP BY label, origin, h, component, lo, hi),
losses AS (SELECT * FROM single UNION ALL SELECT label, origin, h, 'flag_nested', avg(loss) FROM single WHERE component IN ('market_1', 'top_3', 'top_6') GROUP BY label, origin, h),
tune AS (SELECT label, h AS half_life, avg(loss) AS validation_loss, count(loss) AS n_validation FROM losses JOIN sp USING (label, origin) WHERE split = 'validation' AND component = 'flag_nested' AND h > 0 GROUP BY ALL),
pick AS (SELECT label, arg_min(half_life, (validation_loss, half_life)) AS half_life FROM tune GROUP BY ALL),
tst AS (SELECT l.label, half_life, l.origin - 6 AS example, l.component, l.loss, z.loss AS frozen, z.loss - l.loss AS gain FROM losses l JOIN pick ON pick.label = l.label AND pick.half_life = l.h JOIN losses z ON z.label = l.label AND z.origin = l.origin AND z.component = l.component AND z.h = 0 JOIN sp ON sp.label = l.label AND sp.origin = l.origin WHERE split = 'test')"""
)


@query("ewma_choice", TUNED_SQL + " SELECT label, half_life, round(validation_loss, 6) AS validation_loss, n_validation, half_life = (SELECT half_life FROM pick WHERE pick.label = tune.label) AS selected FROM tune")
def _ewma_choice(spark, sf):
    """Mean complete-flag loss of EWMA frames by half-life at the validation origins, and the choice."""
    table, _ = tuned.ewma_losses(panel_of(spark, sf), 36, 6, 1, GRID, **TUNED_DATES)
    return table.select("label", "half_life", r("validation_loss"), "n_validation", "selected")


@query("flag_losses_tuned", TUNED_SQL + " SELECT label, half_life, CAST(example AS INTEGER) AS example, component, round(loss, 6) AS loss, round(frozen, 6) AS frozen FROM tst")
def _flag_losses_tuned(spark, sf):
    """Test losses of EWMA frames by the half-life that validation chose, beside frozen's."""
    _, losses = tuned.ewma_losses(panel_of(spark, sf), 36, 6, 1, GRID, **TUNED_DATES)
    return losses.select("label", "half_life", "example", "component", r("loss"), r("frozen"))


@query("flag_skill_tuned", TUNED_SQL + ", " + E.intervals_sql("tst", ("label", "component"), W.block_length(36, 6, 1), 20260803, order="example") + """
SELECT label, component, n, round(model_mean, 6) AS model_mean, round(frozen_mean, 6) AS frozen_mean, round(win_fraction, 6) AS win_fraction, round(mean, 6) AS improvement, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(100 * mean / greatest(frozen_mean, 2.2250738585072014e-308), 4) AS skill_percent, excludes_zero
FROM iv JOIN (SELECT label, component, avg(loss) AS model_mean, avg(frozen) AS frozen_mean, avg(CASE WHEN gain > 0 THEN 1 ELSE 0 END) AS win_fraction FROM tst GROUP BY ALL) USING (label, component)""")
def _flag_skill_tuned(spark, sf):
    """Skill of the tuned EWMA frames on test by component, with intervals by circular blocks."""
    _, losses = tuned.ewma_losses(panel_of(spark, sf), 36, 6, 1, GRID, **TUNED_DATES)
    out = tuned.compared(losses, W.block_length(36, 6, 1), ("label", "component"))
    return out.select("label", "component", F.col("n").cast("long").alias("n"), *[r(c) for c in ("model_mean", "frozen_mean", "win_fraction", "improvement", "ci_low", "ci_high")], r("skill_percent", 4), "excludes_zero")


@query("damping_skill_tuned")
def _damping_skill(spark, sf):
    """The damped motion with the share that validation chose, by component on test, with intervals."""
    losses = tuned.damping_losses(panel_of(spark, sf), 36, 6, 1, **TUNED_DATES)
    return tuned.compared(losses, W.block_length(36, 6, 1), ("label", "component"))


LIKELIHOOD_SQL = Q.ORIGINS_SQL.replace("WITH", "WITH RECURSIVE", 1).replace(f"t / {STEP} AS", "t AS").replace(f"t % {STEP} = 0 AND ", "") + f""",
sp AS (SELECT o.label, origin, s, CASE WHEN b.d <= DATE '{DATES["train_end"]}' THEN 'train' WHEN b.d BETWEEN DATE '{DATES["validation_start"]}' AND DATE '{DATES["validation_end"]}' THEN 'validation' WHEN b.d >= DATE '{DATES["test_start"]}' THEN 'test' ELSE 'purged' END AS split FROM o JOIN days b ON b.label = o.label AND b.t = s + {T_IN + T_OUT - 1}),
use AS (SELECT * FROM sp WHERE split IN ('validation', 'test')),
ps AS (SELECT use.label, origin, name, t - s AS k, x, h, pow(0.5, ({T_IN} - 1 - (t - s)) / h) AS w FROM use JOIN panel p ON p.label = use.label AND p.t >= s AND p.t < s + {T_IN}, (VALUES (21.0::DOUBLE), (42.0::DOUBLE), (63.0::DOUBLE), (126.0::DOUBLE)) hl(h)),
cc AS (SELECT a.label, a.origin, a.h, a.name AS i, b.name AS j, sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * (sum(a.w * b.x) / sum(a.w)) AS v FROM ps a JOIN ps b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k AND a.h = b.h GROUP BY ALL),
tg AS (SELECT use.label, origin, name, t, x FROM use JOIN panel p ON p.label = use.label AND p.t >= s + {T_IN} AND p.t < s + {T_IN + T_OUT}),
rr AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, covar_pop(a.x, b.x) AS v FROM tg a JOIN tg b ON a.label = b.label AND a.origin = b.origin AND a.t = b.t GROUP BY ALL),
cr AS (SELECT label, origin, h, i, list(v ORDER BY j) AS row FROM cc GROUP BY ALL), rw AS (SELECT label, origin, i, list(v ORDER BY j) AS row FROM rr GROUP BY ALL),
mt AS (SELECT cr.label, cr.origin, h, CAST(count(*) AS INTEGER) AS n, list(list_concat(cr.row, rw.row) ORDER BY cr.i) AS mat FROM cr JOIN rw ON rw.label = cr.label AND rw.origin = cr.origin AND rw.i = cr.i GROUP BY cr.label, cr.origin, h),{E.likelihood_sql("mt")},
ch AS (SELECT label, CAST(h AS INTEGER) AS half_life, avg(nll) FILTER (WHERE split = 'validation') AS v, count(nll) FILTER (WHERE split = 'validation') AS nv, avg(nll) FILTER (WHERE split = 'test') AS t, count(nll) FILTER (WHERE split = 'test') AS nt FROM nl JOIN sp USING (label, origin) GROUP BY ALL)"""


Q.ORACLE_SQL["choose_half_life"] = LIKELIHOOD_SQL + " SELECT label, half_life, round(v, 6) AS validation_loss, nv AS n_validation, round(t, 6) AS test_loss, nt AS n_test, half_life = arg_min(half_life, (v, half_life)) OVER (PARTITION BY label) AS selected FROM ch"


@query("foresight_tuned")
def _foresight_tuned(spark, sf):
    """Control and oracles at the test origins, with the half-life that validation chose."""
    return tuned.foresight(panel_of(spark, sf), T_IN, T_OUT, 1, (21, 42, 63, 126), **DATES)


# -- the ladder with intervals, and without the market -----------------------------------------------------

LADDER_SQL = Q.CAPTURE_SQL[: Q.CAPTURE_SQL.index(",\nc AS (")] + f""",
ad AS (SELECT label, origin, name, CAST(k AS BIGINT) AS k, x / sqrt(CASE WHEN l > 0 THEN l / ref ELSE 1 END) / sigma AS x FROM e JOIN lv USING (label, origin, k) JOIN (SELECT label, origin, name, sigma, ref FROM sig) USING (label, origin, name)),{E.ewma_sql("ad", T_IN, jobs.HALF_LIVES)},
fz AS (SELECT label || '#frozen' AS label, origin, name, k, x / plain AS x FROM e JOIN (SELECT label, origin, name, plain FROM sig) USING (label, origin, name)),
tg AS (SELECT o.label, o.origin, p.name, t, x / sigma AS x FROM o JOIN panel p ON p.label = o.label AND p.t >= s + {T_IN} AND p.t < s + {T_IN + T_OUT} JOIN sig ON sig.label = o.label AND sig.origin = o.origin AND sig.name = p.name),
cv AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, covar_pop(a.x, b.x) AS v FROM fz a JOIN fz b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k GROUP BY ALL
       UNION ALL SELECT a.label || '#ceiling', a.origin, a.name, b.name, sum(a.x * b.x) FROM tg a JOIN tg b ON a.label = b.label AND a.origin = b.origin AND a.t = b.t GROUP BY ALL),
am AS (SELECT label, origin, list(row ORDER BY i) AS mat FROM (SELECT label, origin, i, list(v ORDER BY j) AS row FROM cv GROUP BY ALL) GROUP BY ALL UNION ALL SELECT label, origin, mat FROM em)""" + leading_sql(6, "am", "fa") + """,
en AS (SELECT split_part(label, '#', 1) AS label, origin, CASE WHEN split_part(label, '#', 2) IN ('frozen', 'ceiling') THEN split_part(label, '#', 2) ELSE 'ewma_' || CAST(CAST(split_part(label, '#', 2) AS DOUBLE) AS INTEGER) END AS entrant, found FROM fa),
yy AS (SELECT label, origin, t, list(x ORDER BY name) AS y FROM tg GROUP BY ALL),
sh AS (SELECT en.label, en.origin, entrant, sum(list_sum(list_transform(found, lambda u1: pow(list_dot_product(u1, y), 2)))) / sum(list_dot_product(y, y)) AS capture_6 FROM en JOIN yy ON yy.label = en.label AND yy.origin = en.origin GROUP BY ALL),
pa AS (SELECT a.label, a.origin, a.entrant, a.capture_6 - b.capture_6 AS gain FROM sh a JOIN sh b ON a.label = b.label AND a.origin = b.origin AND b.entrant = 'frozen' WHERE a.entrant <> 'frozen')"""


@query("ladder_captures", LADDER_SQL + " SELECT label, origin, entrant, round(capture_6, 6) AS capture_6 FROM sh")
def _ladder_captures(spark, sf):
    """Frozen, ceiling and EWMA frames side by side."""
    return jobs.entrants(panel_of(spark, sf), T_IN, T_OUT, STEP, shrunk=()).select("label", "origin", "entrant", r("capture_6"))


@query("ladder_intervals", LADDER_SQL + ", " + E.intervals_sql("pa", ("label", "entrant"), W.block_length(T_IN, T_OUT, 6), 20260805) + " SELECT label, entrant, n, block_length_origins, round(blocks_effective, 6) AS blocks_effective, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, excludes_zero FROM iv")
def _ladder_intervals(spark, sf):
    """The ceiling and every EWMA against frozen, with intervals. Blocks are those of a step of six months, so that one fits."""
    series = tables.cut(jobs.entrants(panel_of(spark, sf), T_IN, T_OUT, STEP, shrunk=()))
    frozen = series.where("entrant = 'frozen'").select("label", "origin", F.col("capture_6").alias("f"))
    pairs = series.where("entrant <> 'frozen'").join(frozen, ["label", "origin"]).withColumn("gain", F.col("capture_6") - F.col("f"))
    out = jobs.intervals(pairs, W.block_length(T_IN, T_OUT, 6))
    return out.select("label", "entrant", F.col("n").cast("long").alias("n"), F.col("block_length_origins").cast("long").alias("block_length_origins"), r("blocks_effective"), r("mean"), r("ci_low"), r("ci_high"), "excludes_zero")


@query("neutral_capture", LADDER_SQL + """,
ne AS (SELECT label, origin, t, list_transform(y, lambda v1: v1 - list_avg(y)) AS y, list_dot_product(y, y) AS whole, pow(list_sum(y), 2) / len(y) AS market FROM yy),
nc AS (SELECT en.label, en.origin, any_value(len(y)) AS n, sum(market) / sum(whole) AS market_share, sum(list_dot_product(y, y)) AS w, sum(pow(list_dot_product(found[1], y), 2)) AS c1, sum(list_sum(list_transform(found[1:3], lambda u2: pow(list_dot_product(u2, y), 2)))) AS c3, sum(list_sum(list_transform(found, lambda u3: pow(list_dot_product(u3, y), 2)))) AS c6 FROM en JOIN ne ON ne.label = en.label AND ne.origin = en.origin WHERE entrant = 'frozen' GROUP BY ALL)
SELECT label, origin, CAST(n AS INTEGER) AS n_names, round(c1 / w, 6) AS capture_1, round(c3 / w, 6) AS capture_3, round(c6 / w, 6) AS capture_6, round(market_share, 6) AS market_share FROM nc""")
def _neutral(spark, sf):
    """The frozen frame's capture of targets without their equal-weight market."""
    out = jobs.neutral_capture(panel_of(spark, sf), T_IN, T_OUT, STEP)
    return out.select("label", "origin", "n_names", *[r(c) for c in ("capture_1", "capture_3", "capture_6", "market_share")])


Q.ORACLE_SQL["capture_ladder_month"] = LADDER_SQL + """,
fr AS (SELECT en.label, en.origin, any_value(len(y)) AS n, sum(list_dot_product(y, y)) AS w, sum(pow(list_dot_product(found[1], y), 2)) AS c1, sum(list_sum(list_transform(found[1:3], lambda u4: pow(list_dot_product(u4, y), 2)))) AS c3, sum(list_sum(list_transform(found, lambda u5: pow(list_dot_product(u5, y), 2)))) AS c6 FROM en JOIN yy ON yy.label = en.label AND yy.origin = en.origin WHERE entrant = 'frozen' GROUP BY ALL)
SELECT fr.label, fr.origin, CAST(n AS INTEGER) AS n_names, round(c1 / w, 6) AS capture_1, round(c3 / w, 6) AS capture_3, round(c6 / w, 6) AS capture_6, round(top.capture_6, 6) AS ceiling_6, round(6 / n, 6) AS floor_6 FROM fr JOIN sh top ON top.label = fr.label AND top.origin = fr.origin AND top.entrant = 'ceiling'"""


@query("retained_comparisons", PAIRED_SQL + ", gn AS (SELECT *, rr - m AS gain FROM both_), " + E.intervals_sql("gn", ("label", "component"), W.block_length(36, 12, 6), 20260803, order="example") + """
SELECT label, 'retained' AS forecaster, component, n, round(model_mean, 6) AS model_mean, round(model_median, 6) AS model_median, round(model_q25, 6) AS model_q25, round(model_q75, 6) AS model_q75, round(frozen_mean, 6) AS frozen_mean, round(win_fraction, 6) AS win_fraction, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, excludes_zero, round(100 * mean / scale, 4) AS skill_percent, round(100 * ci_low / scale, 4) AS skill_ci_low, round(100 * ci_high / scale, 4) AS skill_ci_high
FROM iv JOIN (SELECT label, component, avg(m) AS model_mean, quantile_cont(m, 0.5) AS model_median, quantile_cont(m, 0.25) AS model_q25, quantile_cont(m, 0.75) AS model_q75, avg(rr) AS frozen_mean, greatest(avg(rr), 2.2250738585072014e-308) AS scale, avg(CASE WHEN gain > 0 THEN 1 ELSE 0 END) AS win_fraction FROM gn GROUP BY ALL) USING (label, component)""")
def _retained_pairs(spark, sf):
    """loss_comparisons for the forecaster that drops the oldest days, with every statistic."""
    out = selection.loss_comparisons(jobs.flag_losses(panel_of(spark, sf), 36, 6, 6, ("frozen", "retained")), W.block_length(36, 12, 6))
    return out.select("label", "forecaster", "component", F.col("n").cast("long").alias("n"), *[r(c) for c in ("model_mean", "model_median", "model_q25", "model_q75", "frozen_mean", "win_fraction", "mean", "ci_low", "ci_high")], "excludes_zero", *[r(c, 4) for c in ("skill_percent", "skill_ci_low", "skill_ci_high")])


# -- covariance forecasts in closed form -------------------------------------------------------------------

CLOSED = ("sample", "ewma_21", "ewma_63", "ledoit_wolf", "oas", "hierarchical", "bootstrap_hierarchical")
CLOSED_METRICS = ["relative_frobenius", "gaussian_nll_per_asset", "gmv_long_short_variance"]
SCORES_SQL = Q.ORIGINS_SQL.replace("WITH", "WITH RECURSIVE", 1).replace(f"t / {STEP} AS", "t / 4 AS").replace(f"t % {STEP} = 0", "t % 4 = 0") + f""",
pw AS (SELECT o.label, origin, name, t - s AS k, x FROM o JOIN panel p ON p.label = o.label AND p.t >= s AND p.t < s + {T_IN}),
ew AS (SELECT *, pow(0.5, ({T_IN} - 1 - k) / h) AS w FROM pw, (VALUES (21.0::DOUBLE), (63.0::DOUBLE)) hl(h)),
dm AS (SELECT label, origin, name, k, x - avg(x) OVER (PARTITION BY label, origin, name) AS y FROM pw),
sc AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, avg(a.y * b.y) AS v, avg(a.y * a.y * b.y * b.y) AS v4 FROM dm a JOIN dm b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k GROUP BY ALL),
sz AS (SELECT label, origin, sqrt(count(*)) AS n, sum(v) FILTER (WHERE i = j) / sqrt(count(*)) AS mean, sum(v * v) AS sq, sum(v4 - v * v) AS var4 FROM sc GROUP BY ALL),
lw AS (SELECT label, origin, mean, CASE WHEN spread > 0 THEN least(noise, spread) / spread ELSE 0 END AS lw, CASE WHEN bottom = 0 THEN 1 ELSE least(top / bottom, 1) END AS oas FROM (SELECT label, origin, mean, sq / n - mean * mean AS spread, var4 / (n * {T_IN}) AS noise, sq / (n * n) + mean * mean AS top, ({T_IN} + 1) * (sq / (n * n) - mean * mean / n) AS bottom FROM sz)),{E.linkage_sql("sc")},
bd AS (SELECT r.k AS rep, j.k AS place, {E.draw_sql("20260803", "r.k", "j.k")} % {T_IN} AS k FROM range(1, 101) r(k), range(0, {T_IN}) j(k)),
bx AS (SELECT label || '#' || rep AS label, origin, name, place, x - avg(x) OVER (PARTITION BY label, rep, origin, name) AS y FROM pw JOIN bd USING (k)),
bc AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, avg(a.y * b.y) AS v FROM bx a JOIN bx b ON a.label = b.label AND a.origin = b.origin AND a.place = b.place GROUP BY ALL),{E.linkage_sql("bc", "bf")},
cs AS (SELECT label, origin, 'sample' AS h, i, j, v FROM sc
       UNION ALL SELECT sc.label, sc.origin, u.h, i, j, (1 - CASE u.h WHEN 'oas' THEN oas ELSE lw END) * v + CASE WHEN i = j THEN CASE u.h WHEN 'oas' THEN oas ELSE lw END * mean ELSE 0 END FROM sc JOIN lw ON lw.label = sc.label AND lw.origin = sc.origin, (VALUES ('ledoit_wolf'), ('oas')) u(h)
       UNION ALL SELECT a.label, a.origin, 'ewma_' || CAST(a.h AS INTEGER), a.name, b.name, sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * (sum(a.w * b.x) / sum(a.w)) FROM ew a JOIN ew b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k AND a.h = b.h GROUP BY a.label, a.origin, a.h, a.name, b.name
       UNION ALL SELECT label, origin, 'hierarchical', i, j, v FROM hf
       UNION ALL SELECT split_part(label, '#', 1), origin, 'bootstrap_hierarchical', i, j, avg(v) FROM bf GROUP BY split_part(label, '#', 1), origin, i, j),
ah AS (SELECT o.label, origin, name, t, x FROM o JOIN panel p ON p.label = o.label AND p.t >= s + {T_IN} AND p.t < s + {T_IN + T_OUT}),
rr AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, covar_pop(a.x, b.x) AS v FROM ah a JOIN ah b ON a.label = b.label AND a.origin = b.origin AND a.t = b.t GROUP BY ALL),
fb AS (SELECT cs.label, cs.origin, h, sqrt(sum(pow(cs.v - rr.v, 2))) / sqrt(sum(rr.v * rr.v)) AS relative_frobenius FROM cs JOIN rr ON rr.label = cs.label AND rr.origin = cs.origin AND rr.i = cs.i AND rr.j = cs.j GROUP BY cs.label, cs.origin, h),
cr AS (SELECT label, origin, h, i, list(v ORDER BY j) AS row FROM cs GROUP BY ALL), rw AS (SELECT label, origin, i, list(v ORDER BY j) AS row FROM rr GROUP BY ALL),
rm AS (SELECT label, origin, list(row ORDER BY i) AS target FROM rw GROUP BY ALL),
mt AS (SELECT cr.label, cr.origin, h, CAST(count(*) AS INTEGER) AS n, list(list_concat(cr.row, rw.row, [CAST(1 AS DOUBLE)]) ORDER BY cr.i) AS mat FROM cr JOIN rw ON rw.label = cr.label AND rw.origin = cr.origin AND rw.i = cr.i GROUP BY cr.label, cr.origin, h),{E.eliminated_sql("mt")},
ws AS (SELECT label, origin, h, n, mat, logdet, list_transform(mat, lambda m1: m1[2 * n + 1]) AS raw FROM el),
wt AS (SELECT *, list_transform(raw, lambda m2: m2 / list_sum(raw)) AS w FROM ws),
scored AS (SELECT wt.label, wt.origin, wt.h AS estimator, relative_frobenius, (logdet + list_sum(list_transform(range(1, n + 1), lambda z: mat[z][n + z]))) / n AS gaussian_nll_per_asset, list_dot_product(w, list_transform(target, lambda m3: list_dot_product(m3, w))) AS gmv_long_short_variance FROM wt JOIN rm ON rm.label = wt.label AND rm.origin = wt.origin JOIN fb ON fb.label = wt.label AND fb.origin = wt.origin AND fb.h = wt.h)"""


def closed_scores(spark, sf):
    return jobs.covariance_scores(panel_of(spark, sf), T_IN, T_OUT, 4, CLOSED, long_only=False).select("label", "origin", "estimator", *CLOSED_METRICS)


@query("covariance_losses", SCORES_SQL + " SELECT label, origin, estimator, round(relative_frobenius, 6) AS relative_frobenius, round(gaussian_nll_per_asset, 6) AS gaussian_nll_per_asset, round(10000 * gmv_long_short_variance, 6) AS gmv_long_short_variance FROM scored")
def _covariance_losses(spark, sf):
    """Distance, likelihood and minimum-variance losses of the closed-form estimators and of the hierarchical filter, alone and averaged over
    100 resamples of days; variances in squared percent."""
    return closed_scores(spark, sf).select("label", "origin", "estimator", r("relative_frobenius"), r("gaussian_nll_per_asset"), F.round(10000 * F.col("gmv_long_short_variance"), 6).alias("gmv_long_short_variance"))


@query("covariance_loss_board", SCORES_SQL + f""", u AS (UNPIVOT scored ON {", ".join(CLOSED_METRICS)} INTO NAME metric VALUE score), q AS (SELECT label, metric, estimator, count(score) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median, list_sort(list(score)) AS l FROM u GROUP BY ALL)
SELECT label, metric, estimator, n, round(mean, 6) AS mean, round(median, 6) AS median, round(l[CAST(round_even(0.25 * (n - 1), 0) AS INTEGER) + 1], 6) AS q25, round(l[CAST(round_even(0.75 * (n - 1), 0) AS INTEGER) + 1], 6) AS q75, CAST(rank() OVER (PARTITION BY label, metric ORDER BY mean) AS INTEGER) AS rank FROM q""")
def _covariance_board(spark, sf):
    out = S.leaderboard(tables.cut(closed_scores(spark, sf)), ["label", "origin", "estimator"], CLOSED_METRICS)
    return out.select("label", "metric", "estimator", "n", *[r(c) for c in ("mean", "median", "q25", "q75")], "rank")


@query("covariance_comparisons", SCORES_SQL + f""", un AS (UNPIVOT scored ON {", ".join(CLOSED_METRICS)} INTO NAME metric VALUE loss), gn AS (SELECT a.label, a.origin, a.estimator AS candidate, a.metric, a.loss, b.loss AS r, b.loss - a.loss AS gain FROM un a JOIN un b ON a.label = b.label AND a.origin = b.origin AND a.metric = b.metric AND b.estimator = 'sample' WHERE a.estimator <> 'sample'), """ + E.intervals_sql("gn", ("label", "candidate", "metric"), 3, 20260805) + """
SELECT label, candidate, metric, n, round(100 * mean / greatest(abs(reference), 2.2250738585072014e-308), 4) AS percent_improvement, round(win_fraction, 6) AS win_fraction, round(mean / reference, 6) AS improvement, round(ci_low / reference, 6) AS ci_low, round(ci_high / reference, 6) AS ci_high, excludes_zero
FROM iv JOIN (SELECT label, candidate, metric, avg(r) AS reference, avg(CASE WHEN gain > 0 THEN 1 ELSE 0 END) AS win_fraction FROM gn GROUP BY ALL) USING (label, candidate, metric)""")
def _covariance_pairs(spark, sf):
    """Every estimator against the sample covariance, paired by origin, with intervals in units of the reference."""
    out = selection.comparisons(tables.cut(closed_scores(spark, sf)), ["label", "origin"], "estimator", "sample", CLOSED_METRICS, 3)
    share = lambda c, name: F.round(F.col(c) / F.col("reference_mean"), 6).alias(name)
    return out.select("label", "candidate", "metric", F.col("n").cast("long").alias("n"), r("percent_improvement", 4), r("win_fraction"), share("mean", "improvement"), share("ci_low", "ci_low"), share("ci_high", "ci_high"), "excludes_zero")


@query("expert_weights")
def _experts(spark, sf):
    """Weights of the experts in each window and the bound on what they miss of the largest likelihood."""
    return jobs.expert_weights(panel_of(spark, sf, "week"), 60, 10)


@query("shrinkage_visibility", "SELECT label, estimator, count(*) AS origins, count(*) FILTER (WHERE shrinks) AS invisible FROM (" + Q.ORIGINS_SQL + " SELECT label, origin, estimator, estimator IN ('ledoit_wolf', 'oas', 'quadratic_inverse') AS shrinks FROM o, (VALUES ('ledoit_wolf'), ('oas'), ('quadratic_inverse'), ('hierarchical'), ('ewma_21')) e(estimator)) GROUP BY ALL")
def _visibility(spark, sf):
    """At how many origins an estimator leaves the leading subspace's coupling alone: always, where it only changes eigenvalues."""
    return jobs.shrinkage_visibility(panel_of(spark, sf), T_IN, T_OUT, STEP).groupBy("label", "estimator").agg(F.count(F.lit(1)).alias("origins"), F.count_if("invisible").alias("invisible"))


@query("feature_collinearity")
def _collinearity(spark, sf):
    """Correlations of the coupling model's features by half-life."""
    return selection.feature_collinearity(tables.cut(selection.coupling_states(panel_of(spark, sf), 36, 6, 1, (10.0, 21.0, 42.0, 63.0))))


SLICE_SQL = f"WITH {panel_sql('month')} SELECT label, name, CAST(d AS VARCHAR) AS day, t, round(x, 8) AS x FROM panel WHERE d BETWEEN DATE '1997-02-15' AND DATE '1998-01-01'"


@query("panel_slice", SLICE_SQL)
def _slice(spark, sf):
    """A panel written to a store by label and month; some of its days, both ends included, read from their months alone."""
    where = f"{tables.shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    tables.write_panel(panel_of(spark, sf), where)
    return tables.read_slice(spark, where, "brand_month", "1997-02-15", "1998-01-01").select("label", "name", F.col("day").cast("string").alias("day"), "t", r("x", 8))


@query("two_header_table", f"WITH {panel_sql('month')}, g AS (SELECT year(d) AS row, avg(x) AS mean, stddev_samp(x) AS sd, avg(abs(x)) AS size, max(abs(x)) AS most FROM panel GROUP BY ALL) SELECT CAST(row AS VARCHAR) AS row, unnest(['returns', 'returns', 'sizes', 'sizes']) AS group, unnest(['mean', 'sd', 'mean', 'most']) AS field, round(unnest([mean, sd, size, most]), 6) AS value FROM g")
def _two_headers(spark, sf):
    """Yearly statistics in two groups of columns, written under two header rows and read back as rows."""
    where = f"{tables.shared_folder(spark)}/headers-{uuid.uuid4().hex}"
    years = panel_of(spark, sf).groupBy(F.year("day").alias("row")).agg(F.avg("x").alias("a"), F.stddev_samp("x").alias("b"), F.avg(F.abs("x")).alias("c"), F.max(F.abs("x")).alias("d"))
    named = {"a": ("returns", "mean"), "b": ("returns", "sd"), "c": ("sizes", "mean"), "d": ("sizes", "most")}
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(f).alias("field"), F.round(c, 6).alias("value")) for c, (g, f) in named.items()])).alias("cell")
    tables.write_two_headers(tables.cut(years.select("row", cells).select("row", "cell.*")), where)
    return tables.read_two_headers(spark, where).select("row", "group", "field", "value")


@query("appended_results", "SELECT o_orderpriority AS label, CAST(month(o_orderdate) AS INTEGER) AS replicate, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def _appended(spark, sf):
    """A summary appended to CSV files in two parts, each with its header, and read as one table."""
    where = f"{tables.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderpriority").alias("label"), F.month("o_orderdate").alias("replicate")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    for part in ("replicate <= 6", "replicate > 6"):
        tables.append_csv(rows.where(part), where)
    return tables.read_results(spark, where, "label string, replicate int, n long, value double").drop("file")


# -- modes side by side, sweeps that go on -----------------------------------------------------------------


def _market_sql(raw: bool) -> str:
    """(label, mode, example, cosine): motions of the first vector; a line's log is its angle along the rest of the other line."""
    return f"""SELECT * FROM ({matrices_sql(24, 6, raw=raw)}{leading_sql(1)},
v AS (SELECT a.label, a.origin, a.found[1] AS u, p.found[1] AS p, z.found[1] AS z FROM f a JOIN f p ON p.label = a.label AND p.origin = a.origin - 1 JOIN f z ON z.label = a.label AND z.origin = a.origin + 1),
d AS (SELECT label, origin, u, list_transform(p, lambda a1: a1 * sign(list_dot_product(u, p))) AS p, list_transform(z, lambda a2: a2 * sign(list_dot_product(u, z))) AS z FROM v),
t AS (SELECT label, origin, list_transform(p, lambda a3, b3: a3 - u[b3] * list_dot_product(u, p)) AS back, list_transform(z, lambda a4, b4: a4 - u[b4] * list_dot_product(u, z)) AS ahead FROM d)
SELECT label, '{"raw" if raw else "standardised"}' AS mode, CAST(origin AS INTEGER) AS example, -list_dot_product(back, ahead) / sqrt(list_dot_product(back, back) * list_dot_product(ahead, ahead)) AS cosine FROM t)"""


@query("market_motion_by_mode", f"""WITH a AS ({_market_sql(False)}), b AS ({_market_sql(True)}), w AS (SELECT label, example, a.cosine AS s, b.cosine AS r FROM a JOIN b USING (label, example))
SELECT label, 'market_1' AS component, count(*) AS n, round(avg(s), 6) AS standardised_mean, round(quantile_cont(s, 0.5), 6) AS standardised_median, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS standardised_positive, round(avg(r), 6) AS raw_mean, round(quantile_cont(r, 0.5), 6) AS raw_median, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS raw_positive, round(avg(s - r), 6) AS contrast, round(avg(CASE WHEN s > r THEN 1 ELSE 0 END), 6) AS contrast_positive FROM w GROUP BY ALL""")
def _market_modes(spark, sf):
    """Persistence of the market direction's motion, standardised and raw, with the paired contrast."""
    out = _contrast(spark, sf).where("component = 'market_1'")
    return out.select("label", "component", "n", *[r(c) for c in out.columns if c not in ("label", "component", "n")])


@query("motion_by_mode")
def _contrast(spark, sf):
    """The same for every component."""
    states = jobs.spectral_states(panel_of(spark, sf), 24, 6, 3, 6, ("standardised", "raw"))
    return jobs.mode_contrast(jobs.state_motions(states, 1))


def _taken_up(spark, sf):
    """A sweep that is stopped after some draws and taken up again: its cells come from geometry, its work from what is missing."""
    panel, where = tables.cut(panel_of(spark, sf, "week")), f"{tables.shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    cells = tables.cut(nulls.chosen_cells(panel, SWEEP, 6, 2.0))
    nulls.resumed_sweep(panel, where, cells, 3, 6)
    return nulls.resumed_sweep(panel, where, cells, 9, 6), cells


SWEEP = [(36, 6), (48, 12), (96, 12), (240, 48)]


@query("sweep_totals", f"""WITH {panel_sql("week")}, n AS (SELECT label, count(DISTINCT name) AS names, count(DISTINCT t) AS days FROM panel GROUP BY ALL), cells(t_in, horizon) AS (VALUES {", ".join(map(str, SWEEP))}),
g AS (SELECT label, t_in, horizon, (days - t_in) // 6 + 1 - 2 * (horizon // 6) AS origins, ceil((t_in + 2 * horizon) / 6) AS block FROM n, cells)
SELECT label, t_in, horizon, CAST(10 AS BIGINT) AS replicates, CAST(60 AS BIGINT) AS summaries, origins AS most FROM g WHERE origins / block >= 2""")
def _sweep_totals(spark, sf):
    """What the resumed sweep holds: every replicate of every chosen cell once, over all its origins."""
    told, _ = _taken_up(spark, sf)
    return told.groupBy("label", "t_in", "horizon").agg(F.count_distinct("replicate").alias("replicates"), F.count(F.lit(1)).alias("summaries"), F.max("n").alias("most"))


@query("sweep_evidence")
def _sweep_evidence(spark, sf):
    """The sweep's cells held against their nulls."""
    told, cells = _taken_up(spark, sf)
    keys = ["label", "t_in", "horizon", "component"]
    value = "mean_addition_cosine"
    out = S.empirical_p(told.where("replicate = 0").select(*keys, value), told.where("replicate > 0").select(*keys, value), keys, value)
    return out.join(cells.select("label", F.col("t_in").cast("int").alias("t_in"), F.col("horizon").cast("int").alias("horizon"), "q", "deletion_fraction", "independent_blocks"), ["label", "t_in", "horizon"])


# -- losses and the ladder by split ------------------------------------------------------------------------

BY_SPLIT_SQL = (
    matrices_sql(36, 1) + leading_sql(6) + losses_sql("f", 6)
    + f", sp AS (SELECT o.label, origin, CASE WHEN b.d <= DATE '{TUNED_DATES['train_end']}' THEN 'train' WHEN b.d BETWEEN DATE '{TUNED_DATES['validation_start']}' AND DATE '{TUNED_DATES['validation_end']}' THEN 'validation' WHEN b.d >= DATE '{TUNED_DATES['test_start']}' THEN 'test' ELSE 'purged' END AS split FROM o JOIN (SELECT DISTINCT label, t, d FROM panel) b ON b.label = o.label AND b.t = s + 41)"
)


@query("loss_by_split", BY_SPLIT_SQL + " SELECT l.label, 'frozen' AS forecaster, split, component, count(loss) AS n, round(avg(loss), 6) AS mean, round(quantile_cont(loss, 0.5), 6) AS median, round(quantile_cont(loss, 0.25), 6) AS q25, round(quantile_cont(loss, 0.75), 6) AS q75, round(stddev_samp(loss), 6) AS sd, round(max(loss), 6) AS max FROM losses l JOIN sp ON sp.label = l.label AND sp.origin = l.example GROUP BY l.label, split, component")
def _loss_by_split(spark, sf):
    """Losses of the frame that is held still, by split and component; what is purged has its own rows."""
    panel = panel_of(spark, sf)
    out = selection.losses_by_split(jobs.flag_losses(panel, 36, 6, 1, ("frozen",)), tuned.split_origins(panel, 36, 6, 1, 6, **TUNED_DATES))
    return out.select("label", "forecaster", "split", "component", "n", *[r(c) for c in ("mean", "median", "q25", "q75", "sd", "max")])


@query("all_losses_by_split")
def _all_by_split(spark, sf):
    """The same for every forecaster."""
    panel = panel_of(spark, sf)
    return selection.losses_by_split(jobs.flag_losses(panel, 36, 6, 6), tuned.split_origins(panel, 36, 6, 6, 1, **TUNED_DATES))


LADDER_SPLIT_SQL = LADDER_SQL + f""",
ls AS (SELECT o.label, origin, {_CUT.replace("'other'", "'none'")} AS split FROM o JOIN (SELECT DISTINCT label, t, d FROM panel) b ON b.label = o.label AND b.t = s + {T_IN + T_OUT - 1}),
lv2 AS (SELECT label, entrant, avg(capture_6) FILTER (WHERE split = 'validation') AS v, count(*) FILTER (WHERE split = 'validation') AS nv FROM sh JOIN ls USING (label, origin) WHERE entrant LIKE 'ewma%' GROUP BY ALL),
lp AS (SELECT label, arg_min(entrant, (-v, CAST(split_part(entrant, '_', 2) AS INTEGER))) AS entrant FROM lv2 GROUP BY ALL),
lt AS (SELECT sh.label, sh.entrant, origin, sh.capture_6 AS m, fz.capture_6 AS f, sh.capture_6 - fz.capture_6 AS gain FROM sh JOIN lp USING (label, entrant) JOIN (SELECT label, origin, capture_6 FROM sh WHERE entrant = 'frozen') fz USING (label, origin) JOIN ls USING (label, origin) WHERE split = 'test')"""


@query("ladder_tuned", LADDER_SPLIT_SQL + ", " + E.intervals_sql("lt", ("label", "entrant"), W.block_length(T_IN, T_OUT, 6), 20260805) + """
SELECT label, entrant, half_life, n_validation, n, round(validation, 6) AS validation, round(test, 6) AS test, round(frozen, 6) AS frozen, round(mean, 6) AS gain, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, excludes_zero
FROM iv JOIN (SELECT label, entrant, CAST(split_part(entrant, '_', 2) AS INTEGER) AS half_life, v AS validation, nv AS n_validation FROM lv2) USING (label, entrant) JOIN (SELECT label, entrant, avg(m) AS test, avg(f) AS frozen FROM lt GROUP BY ALL) USING (label, entrant)""")
def _ladder_tuned(spark, sf):
    """The EWMA that captures most at the validation origins, against frozen at the test origins."""
    panel = panel_of(spark, sf)
    series = jobs.entrants(panel, T_IN, T_OUT, STEP, shrunk=())
    out = selection.chosen_entrant(series, tuned.split_origins(panel, T_IN, T_OUT, STEP, **TUNED_DATES), W.block_length(T_IN, T_OUT, 6))
    return out.select("label", "entrant", "half_life", "n_validation", F.col("n").cast("long").alias("n"), *[r(c) for c in ("validation", "test", "frozen", "gain", "ci_low", "ci_high")], "excludes_zero")


# -- geometry of neighbouring windows, permutations --------------------------------------------------------

GEOMETRY_SQL = matrices_sql(24, 6) + leading_sql(3) + """,
nb AS (SELECT a.label, CAST(a.origin AS INTEGER) AS w, a.found AS u, b.found AS v FROM f a JOIN f b ON a.label = b.label AND b.origin = a.origin + 1),
sq AS (SELECT label, w, any_value(abs(list_dot_product(u[1], v[1]))) AS c1, sum(pow(list_dot_product(u[i], v[j]), 2)) AS s FROM nb, (SELECT unnest(range(1, 4)) AS i) i, (SELECT unnest(range(1, 4)) AS j) j GROUP BY ALL)"""


@query("neighbour_geometry", GEOMETRY_SQL + " SELECT label, w, round(s, 6) AS squared_cosines, round(acos(least(1, c1)), 6) AS market_angle, round(acos(least(1, c1)), 6) AS geodesic_length, round(acos(least(1, c1)) / 2, 6) AS midpoint_angle, CAST(0 AS DOUBLE) AS missed FROM sq")
def _geometry_of_neighbours(spark, sf):
    """Principal angles of neighbouring windows, and the geodesic between their market directions: its length, the angle at
    half of it, and how far its end misses the second direction."""
    states = jobs.spectral_states(panel_of(spark, sf), 24, 6, 3, 6)
    return jobs.neighbour_geometry(states, 3).select("label", "w", *[r(c) for c in ("squared_cosines", "market_angle", "geodesic_length", "midpoint_angle")], F.abs(F.round("missed", 6)).alias("missed"))


@query("least_rotation", distances_sql(24, 6, 3, 6, 48) + " SELECT label, lag, count(*) AS n, round(CASE WHEN quantile_cont(distance, 0.95) > quantile_cont(distance, 0.2) THEN degrees(acos(exp(-3 * (quantile_cont(distance, 0.95) - quantile_cont(distance, 0.2))))) END, 4) AS degrees FROM apart GROUP BY ALL")
def _least(spark, sf):
    """The rotation that would stand out of each lag's distances: their 95th less their 20th percentile, in degrees."""
    pairs = jobs.window_distances(panel_of(spark, sf), 24, 6, 3, 6, 48)
    gap = F.expr("percentile(distance, 0.95) - percentile(distance, 0.2)")
    return pairs.groupBy("label", F.col("lag").cast("int").alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(gap > 0, F.degrees(F.acos(F.exp(-3 * gap)))), 4).alias("degrees"))


@query("block_exchanges", "WITH " + E.levels_sql(panel_sql("week")) + ", " + E.exchanged_sql(3, 10, 4) + """,
fo AS (SELECT label, k AS replicate, b, days, sum(days) OVER (PARTITION BY label, k ORDER BY """ + E.draw_sql("7", "label", "k", "b") + """, b) - days AS begin FROM bl, range(1, 4) r(k)),
fr AS (SELECT label, 'free' AS kind, replicate, CAST(begin + r.k AS BIGINT) AS t, b * 10 + r.k AS source FROM fo, range(0, 10) r(k) WHERE r.k < days)
SELECT label, kind, CAST(replicate AS INTEGER) AS replicate, CAST(t AS INTEGER) AS t, CAST(source AS INTEGER) AS source FROM mv UNION ALL SELECT label, kind, CAST(replicate AS INTEGER), CAST(t AS INTEGER), CAST(source AS INTEGER) FROM fr""")
def _exchanges(spark, sf):
    """Where each day of a replicate comes from: blocks of ten weeks exchanged with the short last one fixed or free, and
    within strata of volatility."""
    levels = tables.cut(P.variance_path(panel_of(spark, sf, "week")))
    grid = levels.select("label").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(3))))
    out = None
    for kind, bins, tail in (("calendar", 1, "fixed"), ("free", 1, "free"), ("volatility", 4, "fixed")):
        one = R.exchanged_days(levels, grid, 10, bins, tail).select("label", F.lit(kind).alias("kind"), "replicate", "t", "source")
        out = one if out is None else out.unionByName(one)
    return out


@query("erse_diagnostics", matrices_sql(36, 6) + """, x AS (SELECT label, origin, i, j, v FROM c WHERE i <> j)
SELECT label, CAST(origin AS INTEGER) AS w, round(avg(CASE WHEN v > 0 THEN 1 ELSE 0 END), 6) AS positive_fraction, round(min(v), 6) AS minimum FROM x GROUP BY label, origin""")
def _erse_diagnostics(spark, sf):
    """What the rotation of eigenvectors rests on: how many correlations of a window are positive, and the smallest."""
    return jobs.erse_states(panel_of(spark, sf), 36, 6).select("label", "w", r("positive_fraction"), r("minimum"))


@query("attribution_by_delta")
def _by_delta(spark, sf):
    """What the direction to the rotated eigenvectors explains of the motions, for three deltas side by side."""
    return jobs.attribution_summary(jobs.attribution_of(jobs.erse_states(panel_of(spark, sf), 36, 6, (0.15, 0.25, 0.35)), 1))


# -- a whole null in SQL: permuted panels, their windows' first vectors, motions, p-values -------------------

_HEAD, _TAIL = matrices_sql(36, 6).split(",\no AS (", 1)
MARKET_NULL_SQL = (
    _HEAD
    + ", lv AS (SELECT label, CAST(t AS BIGINT) AS t, avg(x * x) AS level FROM panel GROUP BY ALL), "
    + E.exchanged_sql(99, 6, 3)
    + f""",
fo AS (SELECT label, k AS replicate, b, days, sum(days) OVER (PARTITION BY label, k ORDER BY {E.draw_sql("7", "label", "k", "b")}, b) - days AS begin FROM bl, range(1, 100) r(k)),
dy AS (SELECT label, 'calendar' AS kind, replicate, begin + r.k AS t, b * 6 + r.k AS source FROM fo, range(0, 6) r(k) WHERE r.k < days
       UNION ALL SELECT label, kind, replicate, t, source FROM mv WHERE kind = 'volatility'
       UNION ALL SELECT label, kind, 0, t, t FROM lv, (VALUES ('calendar'), ('volatility')) q(kind)),
rp AS (SELECT dy.label || '#' || kind || '#' || replicate AS label, name, CAST(dy.t AS INTEGER) AS t, x FROM dy JOIN panel p ON p.label = dy.label AND p.t = dy.source),
o AS ("""
    + re.sub(r"\blv\b", "wl", _TAIL.replace("FROM panel", "FROM rp").replace("JOIN panel", "JOIN rp"))
    + leading_sql(1)
    + """,
v AS (SELECT a.label, a.origin, a.found[1] AS u, p.found[1] AS p, z.found[1] AS z FROM f a JOIN f p ON p.label = a.label AND p.origin = a.origin - 1 JOIN f z ON z.label = a.label AND z.origin = a.origin + 1),
d AS (SELECT label, origin, u, list_transform(p, lambda a1: a1 * sign(list_dot_product(u, p))) AS p, list_transform(z, lambda a2: a2 * sign(list_dot_product(u, z))) AS z FROM v),
tn AS (SELECT label, origin, list_transform(p, lambda a3, b3: a3 - u[b3] * list_dot_product(u, p)) AS back, list_transform(z, lambda a4, b4: a4 - u[b4] * list_dot_product(u, z)) AS ahead FROM d),
ms AS (SELECT split_part(label, '#', 1) AS label, split_part(label, '#', 2) AS kind, CAST(split_part(label, '#', 3) AS INTEGER) AS replicate, count(*) AS n, avg(-list_dot_product(back, ahead) / sqrt(list_dot_product(back, back) * list_dot_product(ahead, ahead))) AS m FROM tn GROUP BY ALL)
SELECT a.label, a.kind, any_value(a.n) AS n, round(any_value(a.m), 6) AS mean_cosine, round(avg(b.m), 6) AS null_mean, round(quantile_cont(b.m, 0.95), 6) AS null_q95, count(b.m) AS n_null, round((1 + count(*) FILTER (WHERE b.m >= a.m)) / (1 + count(b.m)), 8) AS p
FROM ms a JOIN ms b ON a.label = b.label AND a.kind = b.kind AND a.replicate = 0 AND b.replicate > 0 GROUP BY a.label, a.kind"""
)


@query("market_motion_null", MARKET_NULL_SQL)
def _market_motion_null(spark, sf):
    """Persistence of the market direction's motion against 99 panels with exchanged blocks, of either kind."""
    panel, out = tables.cut(panel_of(spark, sf)), None
    for kind in ("calendar", "volatility"):
        series = nulls.motions(panel, 99, 36, 6, 6, kind).where("component = 'market_1'")
        told = nulls.held_against(nulls.means(series, nulls.MOTION, "cosine"), "mean_cosine").withColumn("kind", F.lit(kind))
        out = told if out is None else out.unionByName(told)
    return out.select("label", "kind", "n", r("mean_cosine"), r("null_mean"), r("null_q95"), "n_null", r("p", 8))
