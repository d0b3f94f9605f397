"""The panel operators' queries, by name, and SQL for those that SQL can express.

SQL and DataFrame sides share nothing but the definition: the SQL starts from the tables again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import panel as P
from tessera.operators import summaries as S
from tessera.operators import windows as W
from tessera.plans import jobs, nulls, selection
from tessera.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PRICE_SQL = {
    "month": "SELECT 'brand_month' AS label, p_brand AS name, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "week": "SELECT 'brand_week' AS label, p_brand AS name, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "nation": "SELECT 'nation_month' AS label, n_name AS name, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "events": "SELECT 'event_hour' AS label, 'u' || (user_id % 10) AS name, date_trunc('hour', ts) AS d, avg(value) AS price FROM events WHERE value IS NOT NULL GROUP BY ALL",
}


def panel_sql(kind: str) -> str:
    """CTEs grid (filled prices), raw (returns with holes) and panel (complete days, numbered t)."""
    return panel_ctes(PRICE_SQL[kind])


def panel_ctes(prices: str) -> str:
    """The same from any SQL for prices (label, name, d, price)."""
    return f"""
prices AS ({prices}),
dense AS (SELECT n.label, n.name, c.d, p.price FROM (SELECT DISTINCT label, name FROM prices) n JOIN (SELECT DISTINCT label, d FROM prices) c USING (label) LEFT JOIN prices p ON p.label = n.label AND p.name = n.name AND p.d = c.d),
grid AS (SELECT label, name, d, last_value(price IGNORE NULLS) OVER (PARTITION BY label, name ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS price FROM dense),
raw AS (SELECT label, name, d, x FROM (SELECT label, name, d, ln(price) - ln(lag(price) OVER (PARTITION BY label, name ORDER BY d)) AS x, min(d) OVER (PARTITION BY label) AS d0 FROM grid) WHERE d > d0),
panel AS (SELECT label, name, d, x, CAST(dense_rank() OVER (PARTITION BY label ORDER BY d) - 1 AS INTEGER) AS t FROM (SELECT *, count(*) FILTER (WHERE x IS NULL) OVER (PARTITION BY label, d) AS holes FROM raw) WHERE holes = 0)"""


def _prices(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return {"nation": tables.nation_prices, "events": tables.event_prices}[kind](spark, sf) if kind in ("nation", "events") else tables.brand_prices(spark, sf, kind)


def returns_of(spark: SparkSession, sf: str, kind: str = "month") -> DataFrame:
    """Returns with holes."""
    return P.log_returns(P.require_positive(P.forward_fill(P.dense_grid(_prices(spark, sf, kind)))))


def panel_of(spark: SparkSession, sf: str, kind: str = "month") -> DataFrame:
    """The complete panel (label, name, day, x, t)."""
    return P.complete_days(returns_of(spark, sf, kind))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(column: str, digits: int = 6, name: str | None = None):
    return F.round(F.col(column).cast("double"), digits).alias(name or column)


# -- cleaning and description ----------------------------------------------------------------------------

for _kind in ("month", "week", "nation", "events"):

    @query(f"log_returns_{_kind}", f"WITH {panel_sql(_kind)} SELECT label, name, CAST(d AS VARCHAR) AS day, t, round(x, 8) AS x FROM panel")
    def _log_returns(spark, sf, kind=_kind):
        return panel_of(spark, sf, kind).select("label", "name", F.col("day").cast("string").alias("day"), "t", r("x", 8))

    @query(f"coverage_{_kind}", f"""WITH {panel_sql(_kind)},
z AS (SELECT label, name, d, x, coalesce(x, 0) = 0 AS still, sum(CASE WHEN coalesce(x, 0) = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY label, name ORDER BY d ROWS UNBOUNDED PRECEDING) AS island FROM raw),
runs AS (SELECT label, name, max(k) AS longest FROM (SELECT label, name, island, count(*) FILTER (WHERE still) AS k FROM z GROUP BY ALL) GROUP BY ALL),
s AS (SELECT label, name, count(x) / count(*) AS cov, count(*) FILTER (WHERE still) / count(*) AS zf FROM z GROUP BY ALL)
SELECT label, name, round(cov, 8) AS coverage, round(zf, 8) AS zero_fraction, longest AS longest_stale_run,
CASE WHEN cov < 0.98 THEN 'coverage' WHEN longest > 10 THEN 'stale run' WHEN zf > 0.1 THEN 'zero returns' END AS dropped_because FROM s JOIN runs USING (label, name)""")
    def _coverage(spark, sf, kind=_kind):
        return P.coverage_report(returns_of(spark, sf, kind)).select("label", "name", r("coverage", 8), r("zero_fraction", 8), "longest_stale_run", "dropped_because")

    @query(f"panel_report_{_kind}", f"""WITH {panel_sql(_kind)},
z AS (SELECT label, name, x, x - avg(x) OVER (PARTITION BY label, name) AS z FROM panel),
m AS (SELECT label, name, stddev_samp(z) AS sd, avg(z * z * z * z) / nullif(pow(stddev_samp(z), 4), 0) AS k, count(*) AS n, count(*) FILTER (WHERE x = 0) AS zeros FROM z GROUP BY ALL),
v AS (SELECT label, avg(l * l) / nullif(avg(l) * avg(l), 0) - 1 AS cv2 FROM (SELECT label, t, avg(x * x) AS l FROM panel GROUP BY ALL) GROUP BY ALL)
SELECT label, count(*) AS n_names, max(n) AS n_days, round(count(*) / max(n), 6) AS q, round(quantile_cont(k, 0.5), 6) AS kurtosis_median, round(max(k), 6) AS kurtosis_max, round(quantile_cont(k, 0.5) - 3, 6) AS excess_kurtosis_median,
round(sum(zeros) / sum(n), 6) AS zero_fraction, round(quantile_cont(sd, 0.5) * sqrt(252), 6) AS annualised_vol_median, round(any_value(cv2), 6) AS cv2 FROM m JOIN v USING (label) GROUP BY label""")
    def _report(spark, sf, kind=_kind):
        out = P.panel_report(panel_of(spark, sf, kind))
        return out.select("label", "n_names", "n_days", *[r(c) for c in ("q", "kurtosis_median", "kurtosis_max", "excess_kurtosis_median", "zero_fraction", "annualised_vol_median", "cv2")])


def breaks_ctes(threshold: float) -> str:
    """CTEs after panel_ctes that end with breaks."""
    return f"""
w AS (SELECT label, name, d, ln(price) - ln(lag(price) OVER s) AS x, quantile_cont(price, 0.5) OVER (s ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING) AS lo, quantile_cont(price, 0.5) OVER (s ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS hi FROM dense WINDOW s AS (PARTITION BY label, name ORDER BY d)),
b AS (SELECT *, exp(abs(x)) AS level FROM w WHERE abs(x) > {threshold}),
n AS (SELECT b.*, coalesce((SELECT v.k FROM (VALUES {", ".join(f"({i}, '{k}', {v!r})" for i, (k, v) in enumerate(P.SPLIT_RATIOS))}) v(i, k, v) WHERE abs(level - v.v) < 2e-4 * v.v ORDER BY v.i LIMIT 1), '') AS ratio FROM b),
breaks AS (SELECT label, name, d, x, CASE WHEN lo IS NULL OR hi IS NULL OR hi = 0 THEN NULL ELSE lo / hi END AS lr, CASE WHEN lo IS NULL THEN 'series_start' WHEN hi IS NULL OR hi = 0 THEN 'series_end' WHEN abs(ln(lo / hi)) < 0.15 THEN 'spike' WHEN ratio <> '' THEN 'split' ELSE 'large_move' END AS kind, ratio FROM n)"""


BREAK = 0.05
BREAKS_SQL = f"WITH {panel_sql('month')}, {breaks_ctes(BREAK)}"


@query("price_breaks", BREAKS_SQL + " SELECT label, name, CAST(d AS VARCHAR) AS day, round(x, 6) AS log_return, round(lr, 6) AS level_ratio, kind, ratio AS split_ratio FROM breaks")
def _breaks(spark, sf):
    out = P.price_breaks(P.dense_grid(_prices(spark, sf, "month")), BREAK)
    return out.select("label", "name", F.col("day").cast("string").alias("day"), r("log_return"), r("level_ratio"), "kind", "split_ratio")


@query("unreliable_names", BREAKS_SQL + ", c AS (SELECT label, name, count(*) FILTER (WHERE kind IN ('split', 'spike')) AS defects, count(*) FILTER (WHERE kind = 'large_move') AS moves FROM breaks GROUP BY ALL) SELECT label, name, defects, moves, CAST(row_number() OVER (PARTITION BY label ORDER BY defects + moves DESC, name) AS INTEGER) AS rank FROM c WHERE defects > 4 OR moves > 20")
def _unreliable(spark, sf):
    return P.unreliable_names(P.price_breaks(P.dense_grid(_prices(spark, sf, "month")), BREAK))


@query("null_defects", BREAKS_SQL + " SELECT raw.label, raw.name, CAST(raw.d AS VARCHAR) AS day, round(CASE WHEN b.d IS NULL THEN raw.x END, 6) AS x FROM raw LEFT JOIN (SELECT DISTINCT label, name, d FROM breaks WHERE kind IN ('split', 'spike')) b ON raw.label = b.label AND raw.name = b.name AND raw.d = b.d")
def _defects(spark, sf):
    breaks = P.price_breaks(P.dense_grid(_prices(spark, sf, "month")), BREAK)
    return P.null_defects(returns_of(spark, sf), breaks).select("label", "name", F.col("day").cast("string").alias("day"), r("x"))


@query("variance_path_5", f"""WITH {panel_sql("month")}, v AS (SELECT label, t, avg(x * x) AS l, (SELECT max(t) + 1 FROM panel) AS n FROM panel GROUP BY label, t),
e AS (SELECT label, t, l, n FROM v UNION ALL SELECT label, -1 - t, l, n FROM v WHERE t < 2 UNION ALL SELECT label, 2 * n - 1 - t, l, n FROM v WHERE t >= n - 2)
SELECT label, CAST(t AS INTEGER) AS t, round(l, 10) AS level FROM (SELECT label, t, n, sum(l) OVER (PARTITION BY label ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS l FROM e) WHERE t >= 0 AND t < n""")
def _path(spark, sf):
    return P.variance_path(panel_of(spark, sf), 5).select("label", F.col("t").cast("int").alias("t"), r("level", 10))


@query("standardise_days", f"WITH {panel_sql('month')}, v AS (SELECT label, t, avg(x * x) AS l FROM panel GROUP BY label, t), m AS (SELECT label, avg(l) AS m FROM v WHERE l > 0 GROUP BY label) SELECT label, name, t, round(x / sqrt(CASE WHEN l > 0 THEN l / m ELSE 1 END), 8) AS x FROM panel JOIN v USING (label, t) JOIN m USING (label)")
def _standardise(spark, sf):
    return P.standardise_days(panel_of(spark, sf)).select("label", "name", "t", r("x", 8))


@query("unit_variance", f"WITH {panel_sql('month')} SELECT label, name, t, round(x / stddev_samp(x) OVER (PARTITION BY label, name), 8) AS x FROM panel")
def _unit(spark, sf):
    return P.unit_variance(panel_of(spark, sf)).select("label", "name", "t", r("x", 8))


@query("worst_outliers", f"WITH {panel_sql('month')}, z AS (SELECT label, name, t, x, abs(x - avg(x) OVER (PARTITION BY label, name)) / stddev_samp(x) OVER (PARTITION BY label, name) AS sd FROM panel) SELECT label, name, t, round(sd, 6) AS sd, round(x, 6) AS x, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY sd DESC, name, t) AS INTEGER) AS rank FROM z) WHERE rank <= 5")
def _outliers(spark, sf):
    return P.worst_outliers(panel_of(spark, sf)).select("label", "name", "t", r("sd"), r("x"), "rank")


@query("rv_autocorrelation", f"""WITH {panel_sql("week")}, n AS (SELECT label, max(t) + 1 AS n FROM panel GROUP BY label), s(scale) AS (VALUES (5), (10), (21)),
b AS (SELECT label, scale, t // scale AS block, ln(avg(x * x)) AS v FROM panel JOIN n USING (label), s WHERE t // scale < n // scale GROUP BY ALL),
l AS (SELECT *, lag(v) OVER (PARTITION BY label, scale ORDER BY block) AS before FROM b) SELECT label, scale, count(*) AS n_blocks, round(corr(v, before), 6) AS autocorrelation FROM l GROUP BY ALL""")
def _rv(spark, sf):
    return P.rv_autocorrelation(panel_of(spark, sf, "week")).select("label", "scale", "n_blocks", r("autocorrelation"))


# -- windows ---------------------------------------------------------------------------------------------

T_IN, T_OUT, STEP = 48, 12, 2
ORIGINS_SQL = f"WITH {panel_sql('month')}, days AS (SELECT DISTINCT label, t, d FROM panel), o AS (SELECT label, CAST(t / {STEP} AS INTEGER) AS origin, t AS s FROM days WHERE t % {STEP} = 0 AND t <= (SELECT max(t) + 1 - {T_IN + T_OUT} FROM days))"
DATES = {"train_end": "2000-06-30", "validation_start": "2000-08-01", "validation_end": "2001-01-31", "test_start": "2001-03-01"}


@query("origins", ORIGINS_SQL + f" SELECT o.label, origin, CAST(s AS INTEGER) AS start, CAST(s + {T_IN} AS INTEGER) AS target_start, CAST(a.d AS VARCHAR) AS origin_day, CAST(b.d AS VARCHAR) AS target_day, CAST(c.d AS VARCHAR) AS target_first_day, CASE WHEN b.d <= DATE '2000-06-30' THEN 'train' WHEN b.d BETWEEN DATE '2000-08-01' AND DATE '2001-01-31' THEN 'validation' WHEN b.d >= DATE '2001-03-01' THEN 'test' ELSE 'purged' END AS split FROM o JOIN days a ON a.label = o.label AND a.t = s + {T_IN - 1} JOIN days b ON b.label = o.label AND b.t = s + {T_IN + T_OUT - 1} JOIN days c ON c.label = o.label AND c.t = s + {T_IN}")
def _origins(spark, sf):
    out = jobs.splits_of(panel_of(spark, sf), T_IN, T_OUT, STEP, **DATES)
    return out.select("label", "origin", F.col("start").cast("int").alias("start"), F.col("target_start").cast("int").alias("target_start"), *[F.col(c).cast("string").alias(c) for c in ("origin_day", "target_day", "target_first_day")], "split")


WINDOW_SQL = ORIGINS_SQL + f""",
e AS (SELECT o.label, origin, name, t - s AS k, x FROM o JOIN panel p ON p.label = o.label AND p.t >= s AND p.t < s + {T_IN}),
lv AS (SELECT label, origin, k, avg(x * x) AS l FROM e GROUP BY ALL), ref AS (SELECT label, origin, avg(l) AS ref FROM lv WHERE l > 0 GROUP BY ALL),
sig AS (SELECT label, origin, name, stddev_samp(x / sqrt(CASE WHEN l > 0 THEN l / ref ELSE 1 END)) AS sigma, any_value(ref) AS ref, stddev_samp(x) AS plain FROM e JOIN lv USING (label, origin, k) JOIN ref USING (label, origin) GROUP BY ALL)"""


@query("estimation_scaling", WINDOW_SQL + " SELECT label, origin, name, round(sigma, 8) AS sigma, round(ref, 8) AS reference FROM sig")
def _scaling(spark, sf):
    return W.estimation_scaling(W.assign_windows(panel_of(spark, sf), T_IN, T_OUT, STEP)).select("label", "origin", "name", r("sigma", 8), r("reference", 8))


@query("sample_covariance", WINDOW_SQL + " SELECT a.label, a.origin, a.name AS i, b.name AS j, round(covar_pop(a.x, b.x), 10) AS cov FROM e a JOIN e b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k AND a.name <= b.name GROUP BY ALL")
def _cov(spark, sf):
    return jobs.pair_covariances(panel_of(spark, sf), T_IN, T_OUT, STEP).select("label", "origin", "i", "j", r("cov", 10))


@query("ewma_covariance", WINDOW_SQL + ", w AS (SELECT *, pow(0.5, -k / 21.0) AS w FROM e) SELECT a.label, a.origin, a.name AS i, b.name AS j, round(sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * (sum(a.w * b.x) / sum(a.w)), 10) AS cov FROM w a JOIN w b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k AND a.name <= b.name GROUP BY ALL")
def _ewma(spark, sf):
    return jobs.pair_covariances(panel_of(spark, sf), T_IN, T_OUT, STEP, 21.0).select("label", "origin", "i", "j", r("cov", 10))


@query("market_residual", WINDOW_SQL + ", m AS (SELECT label, origin, k, avg(x) AS m FROM e GROUP BY ALL), b AS (SELECT label, origin, name, regr_slope(x, m) AS beta, regr_intercept(x, m) AS alpha FROM e JOIN m USING (label, origin, k) GROUP BY ALL) SELECT label, origin, name, CAST(k AS INTEGER) AS k, round(x - alpha - beta * m, 8) AS residual FROM e JOIN m USING (label, origin, k) JOIN b USING (label, origin, name)")
def _market(spark, sf):
    past = W.assign_windows(panel_of(spark, sf), T_IN, T_OUT, STEP).where("role = 'estimation'")
    day = past.withColumn("m", F.avg("x").over(Window.partitionBy("label", "origin", "k")))
    name = Window.partitionBy("label", "origin", "name")
    fit = day.withColumn("b", F.regr_slope("x", "m").over(name)).withColumn("a", F.regr_intercept("x", "m").over(name))
    return fit.select("label", "origin", "name", F.col("k").cast("int").alias("k"), F.round(F.col("x") - F.col("a") - F.col("b") * F.col("m"), 8).alias("residual"))


# -- spectra: the six leading vectors by squaring and deflation in SQL ------------------------------------

CAPTURE_SQL = WINDOW_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
c AS (SELECT a.label, a.origin, a.name AS i, b.name AS j, covar_pop(a.x / a.s, b.x / b.s) AS v FROM (SELECT e.*, plain AS s FROM e JOIN sig USING (label, origin, name)) a JOIN (SELECT e.*, plain AS s FROM e JOIN sig USING (label, origin, name)) b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k GROUP BY ALL),
m AS (SELECT label, origin, list(row ORDER BY i) AS mat FROM (SELECT label, origin, i, list(v ORDER BY j) AS row FROM c GROUP BY ALL) GROUP BY ALL),
it AS (
  SELECT label, origin, 0 AS d, 0 AS k, mat, mat AS pw, CAST([] AS DOUBLE[][]) AS found FROM m
  UNION ALL
  SELECT label, origin, CASE WHEN k < 22 THEN d ELSE d + 1 END, CASE WHEN k < 22 THEN k + 1 ELSE 0 END,
         CASE WHEN k < 22 THEN mat ELSE rest END, CASE WHEN k < 22 THEN list_transform(sq, lambda r1: list_transform(r1, lambda x1: x1 / big)) ELSE rest END,
         CASE WHEN k < 22 THEN found ELSE list_append(found, unit) END
  FROM (SELECT *, CASE WHEN k < 22 THEN NULL ELSE list_transform(mat, lambda r2, a2: list_transform(r2, lambda x2, b2: x2 - lam * unit[a2] * unit[b2])) END AS rest FROM (
    SELECT *, CASE WHEN k < 22 THEN NULL ELSE list_dot_product(unit, list_transform(mat, lambda r3: list_dot_product(r3, unit))) END AS lam FROM (
    SELECT *, CASE WHEN k < 22 THEN NULL ELSE list_transform(col, lambda x4: x4 / sqrt(list_dot_product(col, col))) END AS unit,
           CASE WHEN k < 22 THEN list_max(list_transform(sq, lambda r5: list_max(list_transform(r5, lambda x5: abs(x5))))) END AS big FROM (
    SELECT *, CASE WHEN k < 22 THEN list_transform(pw, lambda r6: list_transform(pw, lambda r7: list_dot_product(r6, r7))) END AS sq,
           CASE WHEN k < 22 THEN NULL ELSE pw[list_position(list_transform(pw, lambda r8, a8: r8[a8]), list_max(list_transform(pw, lambda r9, a9: r9[a9])))] END AS col
    FROM it WHERE d < 6))))),
f AS (SELECT label, origin, found FROM it WHERE d = 6),
y AS (SELECT o.label, o.origin, t, list(x / sigma ORDER BY p.name) AS y FROM o JOIN panel p ON p.label = o.label AND p.t >= s + {T_IN} AND p.t < s + {T_IN + T_OUT} JOIN sig ON sig.label = o.label AND sig.origin = o.origin AND sig.name = p.name GROUP BY ALL),
g AS (SELECT label, origin, unnest(generate_series(1, 6)) AS j, y.y AS yy, found FROM y JOIN f USING (label, origin)),
h AS (SELECT label, origin, j, sum(pow(list_dot_product(found[j], yy), 2)) AS p, sum(list_dot_product(yy, yy)) AS w, any_value(len(yy)) AS n FROM g GROUP BY ALL)
SELECT label, origin, CAST(any_value(n) AS INTEGER) AS n_names, round(sum(p) FILTER (WHERE j = 1) / any_value(w), 6) AS capture_1, round(sum(p) FILTER (WHERE j <= 3) / any_value(w), 6) AS capture_3, round(sum(p) / any_value(w), 6) AS capture_6, round(6 / any_value(n), 6) AS floor_6 FROM h GROUP BY ALL"""


@query("frozen_capture", CAPTURE_SQL)
def _capture(spark, sf):
    out = jobs.capture_ladder(panel_of(spark, sf), T_IN, T_OUT, STEP)
    return out.select("label", "origin", "n_names", r("capture_1"), r("capture_3"), r("capture_6"), r("floor_6"))


@query("capture_ladder_month")
def _ladder(spark, sf):
    out = jobs.capture_ladder(panel_of(spark, sf), T_IN, T_OUT, STEP)
    return out.select("label", "origin", "n_names", *[r(c) for c in ("capture_1", "capture_3", "capture_6", "ceiling_6", "floor_6")])


EIGEN_SQL = f"""WITH {panel_sql("month")}, n AS (SELECT max(t) + 1 AS n FROM panel), o AS (SELECT DISTINCT label, t AS s FROM panel, n WHERE t % 12 = 0 AND t + 36 <= n),
e AS (SELECT o.label, s, name, t - s AS k, x FROM o JOIN panel p ON p.label = o.label AND p.t >= s AND p.t < s + 36), lv AS (SELECT label, s, k, avg(x * x) AS l FROM e GROUP BY ALL), rf AS (SELECT label, s, avg(l) AS m FROM lv WHERE l > 0 GROUP BY ALL),
f AS (SELECT label, s, name, k, x / sqrt(CASE WHEN l > 0 THEN l / m ELSE 1 END) AS x FROM e JOIN lv USING (label, s, k) JOIN rf USING (label, s)), u AS (SELECT label, s, name, k, x / stddev_samp(x) OVER (PARTITION BY label, s, name) AS x FROM f),
c AS (SELECT a.label, a.s, a.name AS i, b.name AS j, covar_pop(a.x, b.x) AS v FROM u a JOIN u b ON a.label = b.label AND a.s = b.s AND a.k = b.k GROUP BY ALL)
SELECT label, CAST(s / 12 AS INTEGER) AS w, round(sum(v) FILTER (WHERE i = j), 6) AS trace, round(sum(v * v), 6) AS squares FROM c GROUP BY ALL"""


@query("eigenvalue_moments", EIGEN_SQL)
def _moments(spark, sf):
    values = jobs.eigenvalues(panel_of(spark, sf), 36, 12, 25)
    return values.groupBy("label", "w").agg(F.round(F.sum("value"), 6).alias("trace"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"))


@query("back_to_back")
def _back(spark, sf):
    """Adjacent windows that share no day, for several lengths."""
    panel, out = panel_of(spark, sf), None
    for t in (12, 16, 24):
        one = jobs.window_distances(panel, t, t, 3, 6, t).groupBy("label").agg(F.lit(t).alias("length"), F.count(F.lit(1)).alias("pairs"), F.avg("distance").alias("distance"), F.avg("null").alias("null"))
        out = one if out is None else out.unionByName(one)
    return out


# -- forecasts, scores and inference ---------------------------------------------------------------------


@query("ladder_entrants")
def _entrants(spark, sf):
    return jobs.entrants(panel_of(spark, sf), T_IN, T_OUT, STEP)


@query("ladder_comparisons")
def _compare(spark, sf):
    return jobs.ladder_comparisons(panel_of(spark, sf), T_IN, T_OUT, STEP)


@query("ceiling_bias")
def _bias(spark, sf):
    return jobs.bias(panel_of(spark, sf), T_IN, T_OUT, STEP)


@query("flag_losses")
def _losses(spark, sf):
    return jobs.flag_losses(panel_of(spark, sf), 36, 6, 6)


@query("damping_grid")
def _damping(spark, sf):
    """The share of motion with the least validation loss; what it loses on test."""
    return selection.choose_damping(panel_of(spark, sf), 36, 6, 1, **DATES)


@query("flag_attribution")
def _attribution(spark, sf):
    return jobs.attribution(panel_of(spark, sf), 36, 6, 6)


SCORED = ("sample", "ewma_21", "ewma_63", "ledoit_wolf", "oas", "quadratic_inverse", "cross_validated", "hierarchical", "bootstrap_hierarchical")


@query("covariance_scores")
def _scores(spark, sf):
    return jobs.covariance_scores(panel_of(spark, sf), T_IN, T_OUT, 4, SCORED)


METRICS = ["relative_frobenius", "gaussian_nll_per_asset", "gmv_long_only_variance"]


@query("covariance_leaderboard")
def _board(spark, sf):
    return S.leaderboard(_scores(spark, sf), ["label", "origin", "estimator"], METRICS)


@query("covariance_ranks")
def _ranks(spark, sf):
    return S.ranks_wide(_board(spark, sf), METRICS)


@query("covariance_winners")
def _winners(spark, sf):
    return S.winners(_board(spark, sf))


@query("choose_half_life")
def _half_life(spark, sf):
    """Likelihood losses of EWMA covariances by half-life, on validation and test; validation alone chooses."""
    out = selection.choose_half_life(panel_of(spark, sf), T_IN, T_OUT, 1, (21, 42, 63, 126), **DATES)
    return out.select("label", "half_life", r("validation_loss"), "n_validation", r("test_loss"), "n_test", "selected")


@query("foresight")
def _foresight(spark, sf):
    return jobs.foresight(panel_of(spark, sf), T_IN, T_OUT, 4)


@query("coupling_model")
def _coupling(spark, sf):
    """Every half-life's fits: chosen on validation, reported on test."""
    return selection.coupling_model(panel_of(spark, sf), 36, 6, 1, (10.0, 21.0, 42.0, 63.0))


DRAWS = 99  # the smallest p is 1 / 100

for _null in ("calendar", "volatility", "iaaft"):

    @query(f"null_{_null}")
    def _nulls(spark, sf, kind=_null):
        """Persistence of motion by component, with Holm over the primary ones."""
        series = nulls.motions(panel_of(spark, sf), DRAWS, 36, 6, 6, kind)
        return nulls.held_against(nulls.means(series, nulls.MOTION, "cosine"), "mean_cosine")


@query("coherence_null")
def _coherence(spark, sf):
    return nulls.held_against(nulls.coherence(panel_of(spark, sf), DRAWS, 24, 6, 6), "leading_share")


@query("change_shares")
def _shares(spark, sf):
    return jobs.change_shares(panel_of(spark, sf), T_IN, T_OUT, STEP)


@query("distance_peak")
def _peak(spark, sf):
    """The window length of the largest distance over its null."""
    curve = _back(spark, sf).withColumn("excess", F.col("distance") - F.col("null"))
    return S.peak(curve, ["label"], "length", "excess")


@query("detection_power")
def _power(spark, sf):
    """What rotation the deletion statistic could see in worlds of each panel's own size."""
    size = panel_of(spark, sf).groupBy("label").agg(F.count_distinct("name").cast("int").alias("n"), (F.max("t") + 1).alias("days"))
    cells = size.withColumn("t_in", F.explode(F.array(F.lit(36), F.lit(48)))).withColumn("horizon", F.lit(6))
    return selection.detection_floors(selection.detection_runs(cells, (0.0, 4e-3, 1.6e-2, 6.4e-2), 6, 12))


@query("static_worlds")
def _worlds(spark, sf):
    """Pairs of samples of worlds with each window's own covariance: their distances over the closed form."""
    told = jobs.static_worlds(panel_of(spark, sf), T_IN, STEP * 4)
    return told.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.sum("trials").alias("trials"), (F.avg("distance") / F.avg("null")).alias("ratio"))


# -- relational summaries over plain tables, with SQL ----------------------------------------------------

SCORE_SQL = "SELECT o_orderpriority AS label, o_orderstatus AS estimator, o_orderkey AS example, o_totalprice AS price, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS age FROM orders"


def _order_scores(spark, sf) -> DataFrame:
    """Orders as a score table: priorities are panels, statuses estimators."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("estimator"), F.col("o_orderkey").alias("example"), F.col("o_totalprice").alias("price"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("age"))


LONG_SQL = f"WITH s AS ({SCORE_SQL}), u AS (UNPIVOT s ON price, age INTO NAME metric VALUE score), q AS (SELECT label, metric, estimator, count(score) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median, list_sort(list(score)) AS l FROM u GROUP BY ALL), b AS (SELECT label, metric, estimator, n, mean, median, l[CAST(round_even(0.25 * (n - 1), 0) AS INTEGER) + 1] AS q25, l[CAST(round_even(0.75 * (n - 1), 0) AS INTEGER) + 1] AS q75, CAST(rank() OVER (PARTITION BY label, metric ORDER BY mean) AS INTEGER) AS rank FROM q)"


@query("leaderboard", LONG_SQL + " SELECT label, metric, estimator, n, round(mean, 4) AS mean, round(median, 4) AS median, round(q25, 4) AS q25, round(q75, 4) AS q75, rank FROM b")
def _leaderboard(spark, sf):
    out = S.leaderboard(_order_scores(spark, sf), ["label", "example", "estimator"], ["price", "age"])
    return out.select("label", "metric", "estimator", "n", *[r(c, 4) for c in ("mean", "median", "q25", "q75")], "rank")


@query("leaderboard_ranks", LONG_SQL + " SELECT label, estimator, CAST(avg(rank) FILTER (WHERE metric = 'price') AS DOUBLE) AS price, CAST(avg(rank) FILTER (WHERE metric = 'age') AS DOUBLE) AS age FROM b GROUP BY ALL")
def _leader_ranks(spark, sf):
    return S.ranks_wide(S.leaderboard(_order_scores(spark, sf), ["label", "example", "estimator"], ["price", "age"]), ["price", "age"])


@query("leaderboard_winners", LONG_SQL + " SELECT label, metric, arg_min(estimator, (mean, estimator)) AS winner, round(min(mean), 4) AS mean FROM b GROUP BY ALL")
def _leader_winners(spark, sf):
    return S.winners(S.leaderboard(_order_scores(spark, sf), ["label", "example", "estimator"], ["price", "age"])).select("label", "metric", "winner", r("mean", 4))


@query("distribution", f"WITH s AS ({SCORE_SQL}) SELECT label, estimator, count(price) AS n, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.75), 4) AS q75, round(stddev_samp(price), 4) AS sd, round(max(price), 4) AS max FROM s GROUP BY ALL")
def _distribution(spark, sf):
    return S.distribution(_order_scores(spark, sf), ["label", "estimator"], "price").select("label", "estimator", "n", *[r(c, 4) for c in ("mean", "median", "q25", "q75", "sd", "max")])


@query("paired_skill", f"WITH s AS ({SCORE_SQL}), p AS (SELECT label, example, price AS m, avg(price) OVER (PARTITION BY label) AS r FROM s) SELECT label, count(*) AS n, round(avg(m), 4) AS model_mean, round(avg(r), 4) AS reference_mean, round(avg(r - m), 4) AS paired_improvement, round(avg(CASE WHEN r > m THEN 1 ELSE 0 END), 6) AS win_fraction, round(100 * avg(r - m) / avg(r), 4) AS skill_percent FROM p GROUP BY ALL")
def _paired(spark, sf):
    model = _order_scores(spark, sf).select("label", "example", F.col("price").alias("loss"))
    reference = model.withColumn("loss", F.avg("loss").over(Window.partitionBy("label")))
    out = S.paired(model, reference, ["label", "example"], "loss", ["label"], True)
    return out.select("label", "n", r("model_mean", 4), r("reference_mean", 4), r("paired_improvement", 4), r("win_fraction"), r("skill_percent", 4))


P_SQL = f"WITH s AS ({SCORE_SQL}), ob AS (SELECT label, max(price) * 0.9 AS value FROM s GROUP BY ALL), j AS (SELECT ob.label, ob.value, s.price AS draw FROM ob JOIN s USING (label)), pv AS (SELECT label, value, avg(draw) AS null_mean, quantile_cont(draw, 0.95) AS null_q95, count(draw) AS n_null, (1 + count(*) FILTER (WHERE draw >= value)) / (1 + count(draw)) AS p FROM j GROUP BY ALL)"


@query("empirical_p_holm", P_SQL + ", k AS (SELECT *, row_number() OVER (ORDER BY p, label, value) AS i, count(*) OVER () AS m FROM pv) SELECT label, round(value, 4) AS value, round(null_mean, 4) AS null_mean, round(null_q95, 4) AS null_q95, n_null, round(p, 8) AS p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY i)), 8) AS holm FROM k")
def _holm(spark, sf):
    scores = _order_scores(spark, sf)
    observed = scores.groupBy("label").agg((F.max("price") * 0.9).alias("value"))
    null = scores.select("label", F.col("price").alias("value"))
    pv = S.empirical_p(observed, null, ["label"], "value")
    ranked = S.holm(pv.select("label", "value", "null_mean", "null_q95", "n_null", "p"), [], "p")
    return ranked.select("label", r("value", 4), r("null_mean", 4), r("null_q95", 4), "n_null", r("p", 8), r("holm", 8))


@query("lag_bins", "WITH p AS (SELECT o_orderkey % 97 AS lag, o_totalprice AS v FROM orders) SELECT 'orders' AS label, CAST(round_even(lag / 10.0, 0) * 10 AS BIGINT) AS lag_bin, count(*) AS n, round(avg(v), 4) AS v FROM p GROUP BY ALL")
def _bins(spark, sf):
    pairs = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit("orders").alias("label"), (F.col("o_orderkey") % 97).alias("lag"), F.col("o_totalprice").alias("v"))
    return S.lag_bins(pairs, 10, "v").select("label", "lag_bin", "n", r("v", 4))


from tessera.plans import evidence  # noqa: E402, F401  registers its queries
