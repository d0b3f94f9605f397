"""SQL for draws, permutations and intervals: the definitions of operators.resampling, written out place by place."""

from __future__ import annotations


def draw_sql(*key: str) -> str:
    return f"('0x' || left(md5(concat_ws('|', {', '.join(key)})), 8))::BIGINT"


def levels_sql(*panels: str) -> str:
    """CTE lv (label, t, level): the mean square of each complete day of some panels, each by CTEs that end with panel."""
    return "lv AS (" + " UNION ALL ".join(f"SELECT * FROM (WITH {ctes} SELECT label, CAST(t AS BIGINT) AS t, avg(x * x) AS level FROM panel GROUP BY ALL)" for ctes in panels) + ")"


def exchanged_sql(draws: int, block: int, bins: int, seed: int = 7) -> str:
    """CTE moved (label, kind, replicate, t, level) after lv: blocks of days exchanged, whole ones within their stratum."""
    key = "label, kind, replicate, part"
    return f"""
reps AS (SELECT label, k AS replicate FROM (SELECT DISTINCT label FROM lv), range(1, {draws + 1}) r(k)),
bl AS (SELECT label, t // {block} AS b, round(avg(level), 12) AS level, count(*) AS days FROM lv GROUP BY ALL),
parts AS (SELECT label, b, days, 'calendar' AS kind, CASE WHEN days < {block} THEN 0 ELSE 1 END AS part FROM bl
          UNION ALL SELECT label, b, days, 'volatility', CASE WHEN days < {block} THEN 0 ELSE ntile({bins}) OVER (PARTITION BY label, days < {block} ORDER BY level, b) END FROM bl),
dr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {draw_sql(str(seed), "label", "replicate", "b")}, b) AS drawn, row_number() OVER (PARTITION BY {key} ORDER BY b) AS slot FROM parts JOIN reps USING (label)),
mv AS (SELECT a.label, a.kind, a.replicate, a.b * {block} + k AS t, s.b * {block} + k AS source FROM dr a JOIN dr s ON a.label = s.label AND a.kind = s.kind AND a.replicate = s.replicate AND a.part = s.part AND a.slot = s.drawn, range(0, {block}) r(k) WHERE k < a.days),
moved AS (SELECT mv.label, kind, replicate, mv.t, level FROM mv JOIN lv ON lv.label = mv.label AND lv.t = source UNION ALL SELECT label, kind, 0, t, level FROM lv, (VALUES ('calendar'), ('volatility')) kinds(kind))"""


def rv_sql(scales: tuple[int, ...]) -> str:
    """CTE st (label, kind, replicate, scale, value) after moved."""
    return f"""
sz AS (SELECT label, count(*) AS n FROM lv GROUP BY ALL),
sm AS (SELECT label, kind, replicate, scale, t // scale AS b, ln(sum(level)) AS v FROM moved JOIN sz USING (label), (VALUES {", ".join(f"({s})" for s in scales)}) scales(scale) WHERE t // scale < n // scale GROUP BY ALL HAVING sum(level) > 0),
bf AS (SELECT *, lag(v) OVER (PARTITION BY label, kind, replicate, scale ORDER BY b) AS before FROM sm),
st AS (SELECT label, kind, replicate, scale, CASE WHEN count(v) > 2 THEN round(corr(v, before), 12) END AS value FROM bf GROUP BY ALL)"""


def intervals_sql(source: str, by: tuple[str, ...], block: int, seed: int, repetitions: int = 2000, value: str = "gain", order: str = "origin") -> str:
    """CTE iv (by, n, block_length_origins, blocks_effective, mean, ci_low, ci_high, excludes_zero) of the series of source."""
    keys = ", ".join(by)
    return f"""
srs AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {value} IS NOT NULL),
lens AS (SELECT DISTINCT label, n, least(n, {block}) AS w FROM srs),
picks AS (SELECT label, n, r.k AS replicate, ({draw_sql(str(seed), "label", "r.k", "j.k")} % n + o.k) % n AS i FROM lens, range(1, {repetitions + 1}) r(k), range(0, 100000) j(k), range(0, {block}) o(k) WHERE j.k * w < n AND o.k < w AND j.k * w + o.k < n),
rsm AS (SELECT {", ".join(f"s.{k}" for k in by)}, replicate, avg(v) AS mean FROM srs s JOIN picks p ON p.label = s.label AND p.n = s.n AND p.i = s.i GROUP BY ALL),
iv AS (SELECT {keys}, any_value(n) AS n, least(any_value(n), {block}) AS block_length_origins, any_value(n) / least(any_value(n), {block}) AS blocks_effective, any_value(m) AS mean, any_value(lo) AS ci_low, any_value(hi) AS ci_high, any_value(n) / least(any_value(n), {block}) >= 2 AND (any_value(lo) > 0 OR any_value(hi) < 0) AS excludes_zero
       FROM (SELECT {keys}, any_value(n) AS n, avg(v) AS m FROM srs GROUP BY {keys}) JOIN (SELECT {keys}, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM rsm GROUP BY {keys}) USING ({keys}) GROUP BY {keys})"""


def combined_sql(source: str, by: tuple[str, ...]) -> str:
    """CTE cb (label, by, n_panels, observed, null_mean, null_q95, n_null, p, holm) of source (label, replicate, by, value)."""
    keys = ", ".join(by)
    return f"""
np AS (SELECT {keys}, count(DISTINCT label) AS n_panels FROM {source} GROUP BY ALL),
al AS (SELECT 'all' AS label, replicate, {keys}, any_value(n_panels) AS n_panels, CASE WHEN count(value) = any_value(n_panels) THEN round(avg(value), 12) END AS value FROM {source} JOIN np USING ({keys}) GROUP BY replicate, {keys}),
un AS (SELECT label, replicate, {keys}, 1 AS n_panels, value FROM {source} UNION ALL SELECT label, replicate, {keys}, n_panels, value FROM al),
ob AS (SELECT label, {keys}, n_panels, value AS observed FROM un WHERE replicate = 0),
jn AS (SELECT ob.*, value, value >= observed AS reached FROM ob LEFT JOIN (SELECT label, {keys}, value FROM un WHERE replicate > 0) USING (label, {keys})),
pv AS (SELECT label, {keys}, any_value(n_panels) AS n_panels, any_value(observed) AS observed, avg(value) AS null_mean, quantile_cont(value, 0.95) AS null_q95, count(value) AS n_null, CASE WHEN count(observed) > 0 THEN (1 + count(*) FILTER (WHERE reached)) / (1 + count(value)) END AS p FROM jn GROUP BY label, {keys}),
hk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p NULLS LAST, label) AS k, count(p) OVER (PARTITION BY {keys}) AS m FROM pv WHERE label <> 'all'),
hm AS (SELECT label, {keys}, CASE WHEN p IS NOT NULL THEN least(1, max((m - k + 1) * p) OVER (PARTITION BY {keys} ORDER BY k)) END AS holm FROM hk),
cb AS (SELECT pv.*, holm FROM pv LEFT JOIN hm USING (label, {keys}))"""


def ewma_sql(source: str, width: int, half_lives: tuple[float, ...], name: str = "em", columns: str = "label, origin") -> str:
    """CTE name (label, origin, mat): EWMA covariances of source (label, origin, name, k, x), k = 0 the oldest of width
    days, as correlations; label becomes label#half-life."""
    return f"""
{name}_w AS (SELECT {columns}, name, k, x, h, pow(0.5, ({width} - 1 - k) / h) AS w FROM {source}, (VALUES {", ".join(f"(CAST({h} AS DOUBLE))" for h in half_lives)}) hl(h)),
{name}_c AS (SELECT a.label, a.origin, a.h, a.name AS i, b.name AS j, sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * (sum(a.w * b.x) / sum(a.w)) AS v FROM {name}_w a JOIN {name}_w b ON a.label = b.label AND a.origin = b.origin AND a.k = b.k AND a.h = b.h GROUP BY ALL),
{name}_d AS (SELECT label, origin, h, i, sqrt(v) AS s FROM {name}_c WHERE i = j),
{name} AS (SELECT label || '#' || h AS label, origin, list(row ORDER BY i) AS mat FROM (SELECT c.label, c.origin, c.h, c.i, list(v / p.s / q.s ORDER BY c.j) AS row FROM {name}_c c JOIN {name}_d p ON p.label = c.label AND p.origin = c.origin AND p.h = c.h AND p.i = c.i JOIN {name}_d q ON q.label = c.label AND q.origin = c.origin AND q.h = c.h AND q.i = c.j GROUP BY ALL) GROUP BY ALL)"""


def eliminated_sql(source: str, name: str = "el") -> str:
    """CTE name (label, origin, h, n, mat, logdet) of source (label, origin, h, n, mat), whose rows are those of an n x n
    matrix C followed by anything: C becomes the identity and the rest C^-1 times itself, by Gauss-Jordan
    elimination, a column a step; logdet is ln det C."""
    return f"""
{name}_g AS (
  SELECT label, origin, h, n, 0 AS k, mat, CAST(0 AS DOUBLE) AS logdet FROM {source}
  UNION ALL
  SELECT label, origin, h, n, k + 1, list_transform(mat, lambda g1, a1: CASE WHEN a1 = k + 1 THEN list_transform(g1, lambda x1: x1 / piv) ELSE list_transform(g1, lambda x2, b2: x2 - g1[k + 1] / piv * prow[b2]) END), logdet + ln(piv)
  FROM (SELECT *, mat[k + 1] AS prow, mat[k + 1][k + 1] AS piv FROM {name}_g WHERE k < n)),
{name} AS (SELECT label, origin, h, n, mat, logdet FROM {name}_g WHERE k = n)"""


def likelihood_sql(source: str, name: str = "nl") -> str:
    """CTE name (label, origin, h, nll): (ln det C + trace C^-1 R) / N of source, whose rows are C's followed by R's."""
    return f"""{eliminated_sql(source, name + "_e")},
{name} AS (SELECT label, origin, h, (logdet + list_sum(list_transform(range(1, n + 1), lambda z: mat[z][n + z]))) / n AS nll FROM {name}_e)"""


def linkage_sql(source: str, name: str = "hf") -> str:
    """CTE name (label, origin, i, j, v) of source (label, origin, i, j, v): covariances with each correlation replaced by the
    mean correlation of the two clusters that joined i and j, by average linkage. The largest correlation merges
    first, of equal ones that of the first row, then of the first column; -2 marks what is gone."""
    dead = "CAST(-2 AS DOUBLE)"
    return f"""
{name}_d AS (SELECT label, origin, i, sqrt(v) AS s, row_number() OVER (PARTITION BY label, origin ORDER BY i) AS k FROM {source} WHERE i = j),
{name}_c AS (SELECT c.label, c.origin, p.k AS i, q.k AS j, p.s * q.s AS s, CASE WHEN p.k = q.k THEN {dead} ELSE v / p.s / q.s END AS r FROM {source} c JOIN {name}_d p ON p.label = c.label AND p.origin = c.origin AND p.i = c.i JOIN {name}_d q ON q.label = c.label AND q.origin = c.origin AND q.i = c.j),
{name}_0 AS (SELECT label, origin, list(row ORDER BY i) AS sim, CAST(count(*) AS INTEGER) AS n FROM (SELECT label, origin, i, list(r ORDER BY j) AS row FROM {name}_c GROUP BY ALL) GROUP BY ALL),
{name}_m AS (
  SELECT label, origin, n, 0 AS step, sim, list_transform(range(1, n + 1), lambda e0: CAST(1 AS DOUBLE)) AS size, range(1, n + 1) AS cl, {dead} AS val FROM {name}_0
  UNION ALL
  SELECT label, origin, n, step + 1, list_transform(sim, lambda e1, i1: CASE WHEN i1 = b THEN list_transform(e1, lambda e2: {dead}) WHEN i1 = a THEN fresh ELSE list_transform(e1, lambda e3, j3: CASE WHEN j3 = a THEN fresh[i1] WHEN j3 = b THEN {dead} ELSE e3 END) END),
         list_transform(size, lambda e4, i4: CASE WHEN i4 = a THEN size[a] + size[b] ELSE e4 END), list_transform(cl, lambda e5: CASE WHEN e5 = b THEN a ELSE e5 END), best
  FROM (SELECT *, list_transform(sim[a], lambda e6, i6: CASE WHEN i6 = a OR i6 = b THEN {dead} ELSE (size[a] * e6 + size[b] * sim[b][i6]) / (size[a] + size[b]) END) AS fresh FROM (
    SELECT *, least(p, q) AS a, greatest(p, q) AS b FROM (
    SELECT *, list_position(sim[p], best) AS q FROM (
    SELECT *, list_position(list_transform(sim, lambda e7: list_max(e7)), best) AS p FROM (
    SELECT *, list_max(list_transform(sim, lambda e8: list_max(e8))) AS best FROM {name}_m WHERE step < n - 1)))))),
{name}_f AS (SELECT c.label, c.origin, c.i, c.j, any_value(s) * CASE WHEN c.i = c.j THEN 1 ELSE arg_min(val, step) FILTER (WHERE step > 0 AND cl[c.i] = cl[c.j]) END AS v FROM {name}_c c JOIN {name}_m m ON m.label = c.label AND m.origin = c.origin GROUP BY c.label, c.origin, c.i, c.j),
{name} AS (SELECT f.label, f.origin, p.i, q.i AS j, f.v FROM {name}_f f JOIN {name}_d p ON p.label = f.label AND p.origin = f.origin AND p.k = f.i JOIN {name}_d q ON q.label = f.label AND q.origin = f.origin AND q.k = f.j)"""
