"""The jobs as queries: each runs its function twice into one new shared folder and reads the output back."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import panel_store, text_drift
from tessera.plans.queries import PRICE_SQL, breaks_ctes, panel_ctes
from tessera.sources import tables

HERE = os.path.dirname(os.path.abspath(__file__))


def _config(name: str) -> dict:
    with open(f"{HERE}/{name}.json") as file:
        return json.load(file)


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_panel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, month, name, day, n, log_price, x, t (-1: not a complete day) of all panels after a run that takes everything and one that finds nothing new."""
    where, config = _new_folder(spark, "job1"), _config("panel_store")
    for _ in range(2):
        panel_store.run(spark, config, sf_dir, f"{where}/out", f"{where}/state")
    out = panel_store.read_panel(spark, f"{where}/out")
    return out.select("label", "month", "name", F.col("day").cast("string").alias("day"), "n", F.round(F.ln("price"), 8).alias("log_price"), F.round("x", 8).alias("x"), F.coalesce("t", F.lit(-1)).alias("t"))


def job2_text_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, section, name, block (-1: none), metric, value, note of all text panels after two runs."""
    where, config = _new_folder(spark, "job2"), _config("text_drift")
    for _ in range(2):
        text_drift.run(spark, config, sf_dir, f"{where}/out")
    out = text_drift.read_facts(spark, f"{where}/out")
    return out.select("label", "section", "name", F.coalesce("day", F.lit(-1)).alias("block"), "metric", F.round("value", 6).alias("value"), "note")


QUERIES = {"job1_panel_store": job1_panel_store, "job2_text_drift": job2_text_drift}


def _panel_store_sql() -> str:
    parts = []
    for kind in ("events", "nation", "week"):
        prices = PRICE_SQL[kind].replace(" AS price FROM", " AS price, count(*) AS n FROM")
        parts.append(f"""SELECT * FROM (WITH {panel_ctes(prices)}
SELECT raw.label, strftime(raw.d, '%Y-%m') AS month, raw.name, CAST(CAST(raw.d AS TIMESTAMP) AS VARCHAR) AS day, coalesce(prices.n, 0) AS n, round(ln(grid.price), 8) AS log_price, round(raw.x, 8) AS x, coalesce(panel.t, -1) AS t
FROM raw JOIN grid USING (label, name, d) LEFT JOIN prices USING (label, name, d) LEFT JOIN panel USING (label, name, d))""")
    return " UNION ALL ".join(parts)


def _text_drift_sql() -> str:
    config = _config("text_drift")
    parts = []
    for spec in config["panels"]:
        prices = f"SELECT '{spec['label']}' AS label, {spec['name']} AS name, CAST(floor({spec['order']} / {spec['width']}) AS BIGINT) AS d, avg({spec['value']}) AS price FROM {spec['table'].removesuffix('.parquet')} WHERE {spec['name']} IS NOT NULL AND {spec['order']} IS NOT NULL AND {spec['value']} IS NOT NULL GROUP BY ALL"
        parts.append(f"""SELECT * FROM (WITH {panel_ctes(prices)}, {breaks_ctes(config["threshold"])},
y AS (SELECT label, name, d, x, coalesce(x, 0) = 0 AS still, sum(CASE WHEN coalesce(x, 0) = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY label, name ORDER BY d ROWS UNBOUNDED PRECEDING) AS island FROM raw),
longest AS (SELECT label, name, max(k) AS longest FROM (SELECT label, name, island, count(*) FILTER (WHERE still) AS k FROM y GROUP BY ALL) GROUP BY ALL),
cover AS (SELECT label, name, cov, zf, longest, CASE WHEN cov < 0.98 THEN 'coverage' WHEN longest > 10 THEN 'stale run' WHEN zf > 0.1 THEN 'zero returns' END AS why FROM (SELECT label, name, count(x) / count(*) AS cov, count(*) FILTER (WHERE still) / count(*) AS zf FROM y GROUP BY ALL) JOIN longest USING (label, name)),
o AS (SELECT label, name, d, t, x, abs(x - avg(x) OVER u) / stddev_samp(x) OVER u AS sd FROM panel WINDOW u AS (PARTITION BY label, name)),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sd DESC, name, t) AS rank FROM o) WHERE rank <= {config["worst"]}),
m AS (SELECT label, name, avg(pow(z, 4)) / nullif(pow(stddev_samp(z), 4), 0) AS k, count(*) AS n, count(*) FILTER (WHERE x = 0) AS zeros FROM (SELECT label, name, x, x - avg(x) OVER (PARTITION BY label, name) AS z FROM panel) GROUP BY ALL),
v AS (SELECT label, avg(l * l) / nullif(avg(l) * avg(l), 0) - 1 AS cv2 FROM (SELECT label, t, avg(x * x) AS l FROM panel GROUP BY ALL) GROUP BY ALL),
rep AS (SELECT label, CAST(count(*) AS DOUBLE) AS n_names, CAST(max(n) AS DOUBLE) AS n_days, count(*) / max(n) AS q, quantile_cont(k, 0.5) AS kurtosis_median, max(k) AS kurtosis_max, sum(zeros) / sum(n) AS zero_fraction, any_value(cv2) AS cv2 FROM m JOIN v USING (label) GROUP BY label),
facts AS (
  SELECT label, 'coverage' AS section, name, CAST(NULL AS BIGINT) AS block, unnest(['coverage', 'zero_fraction', 'longest_stale_run']) AS metric, unnest([cov, zf, CAST(longest AS DOUBLE)]) AS value, why AS note FROM cover
  UNION ALL SELECT label, 'breaks', name, d, unnest(['log_return', 'level_ratio']), unnest([x, lr]), concat_ws(' ', kind, nullif(ratio, '')) FROM breaks
  UNION ALL SELECT label, 'outliers', name, d, unnest(['sd', 'x']), unnest([sd, x]), CAST(rank AS VARCHAR) FROM worst
  UNION ALL SELECT label, 'report', NULL, NULL, unnest([{", ".join(f"'{m}'" for m in text_drift.REPORT)}]), unnest([{", ".join(text_drift.REPORT)}]), NULL FROM rep)
SELECT label, section, name, coalesce(block, -1) AS block, metric, round(value, 6) AS value, note FROM facts
UNION ALL SELECT label, section, NULL, -1, 'facts', CAST(count(facts.metric) AS DOUBLE), NULL FROM (SELECT DISTINCT label FROM prices) CROSS JOIN (VALUES ('coverage'), ('breaks'), ('outliers'), ('report')) s(section) LEFT JOIN facts USING (label, section) GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


ORACLE_SQL = {"job1_panel_store": _panel_store_sql(), "job2_text_drift": _text_drift_sql()}
