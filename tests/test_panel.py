"""Panel operators on small tables with known answers, and all queries against their SQL."""

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import panel as P
from tessera.operators import summaries as S
from tessera.operators import windows as W

SF = "/root/testdata/sf0.001"


def prices(spark, **series):
    day = dt.date(2005, 1, 3)
    rows = [("a", name, day + dt.timedelta(k), None if v is None else float(v)) for name, values in series.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "label string, name string, day date, price double")


def test_log_returns_fill_and_guard(spark):
    got = P.log_returns(P.forward_fill(prices(spark, A=[100, 110, None, 99]))).orderBy("day").collect()
    assert [round(r.x, 12) for r in got] == [round(v, 12) for v in (math.log(1.1), 0, math.log(0.9))]
    with pytest.raises(Exception, match="positive"):
        P.require_positive(prices(spark, A=[1, 0, 2])).collect()


def test_split_spike_and_edges(spark):
    steady = [100.0] * 30
    split = steady[:15] + [50.0] * 15
    spike = steady.copy()
    spike[15] = 50.0
    got = P.price_breaks(prices(spark, S=split, K=spike, E=[100.0, 30.0] + [30.0] * 20)).collect()
    kinds = sorted((r["name"], r.kind, r.split_ratio) for r in got)
    assert kinds == [("E", "series_start", ""), ("K", "spike", "2:1"), ("K", "spike", "2:1"), ("S", "split", "2:1")]


def test_ratio_whitelist(spark):
    x = spark.createDataFrame([(math.log(r),) for r in (2, 1.5, 2.5, 3, 10)] + [(-0.731,), (-0.936,), (-1.145,)], "x double")
    assert [r[0] for r in x.select(P.split_ratio(F.col("x"))).collect()] == ["2:1", "3:2", "5:2", "3:1", "10:1", None, None, None]


def test_coverage_counts_missing_as_zero(spark):
    rows = [("a", "A", dt.date(2020, 1, k + 1), v) for k, v in enumerate([0.0, None, 0.0, 0.1])] + [("a", "B", dt.date(2020, 1, k + 1), 0.1) for k in range(4)]
    got = {r["name"]: r for r in P.coverage_report(spark.createDataFrame(rows, "label string, name string, day date, x double")).collect()}
    assert (got["A"].coverage, got["A"].zero_fraction, got["A"].longest_stale_run, got["A"].dropped_because) == (0.75, 0.75, 3, "coverage")
    assert got["B"].dropped_because is None


def test_windows_hold_their_days_once(spark):
    panel = spark.range(10).select(F.lit("a").alias("label"), F.lit("A").alias("name"), F.col("id").cast("int").alias("t"), F.col("id").cast("double").alias("x"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"))
    got = W.assign_windows(panel, 4, 2, 2).groupBy("origin", "role").agg(F.sort_array(F.collect_list("t"))).collect()
    assert sorted(map(tuple, got)) == [(o, role, list(range(2 * o + a, 2 * o + b))) for o in range(3) for role, a, b in (("estimation", 0, 4), ("target", 4, 6))]
    assert W.origins(panel, 4, 2, 2).count() == 3 and W.block_length(4, 2, 2) == 3


def test_future_does_not_reach_the_estimation_scale(spark):
    from tessera.plans import jobs

    import numpy as np

    x = np.random.default_rng(0).standard_normal((8, 40))
    y = x.copy()
    y[:, 30:] *= 100
    as_panel = lambda m: spark.createDataFrame([("a", f"n{i}", t, dt.date(2020, 1, 1) + dt.timedelta(t), float(m[i, t])) for i in range(8) for t in range(40)], "label string, name string, t int, day date, x double")
    a, b = (W.estimation_scaling(W.assign_windows(as_panel(m), 20, 10, 10)).where("origin = 0").select(F.round("sigma", 10)).collect() for m in (x, y))
    assert sorted(a) == sorted(b)
    assert jobs.capture_ladder(as_panel(x), 20, 10, 10).count() == 2


def test_holm_keeps_null_and_splits_are_ordered(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", 0.03)], "k string, p double")
    got = {r.k: r.holm for r in S.holm(rows, []).collect()}
    assert got["c"] is None and got["a"] == pytest.approx(0.03) and got["b"] == got["d"] == pytest.approx(0.06)
    with pytest.raises(ValueError):
        W.chronological_splits(rows, "2020-01-02", "2020-01-01", "2020-01-03", "2020-01-04")


def test_paired_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(Exception, match="unique"):
        S.paired(a, a, ["k"], "v", ["k"], True).collect()


def test_crossing_is_interpolated(spark):
    c = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 1.0), ("a", 20.0, 3.0)], "g string, x double, y double")
    assert S.first_crossing(c, ["g"], "x", "y", 2.0).first().crossing == pytest.approx(15.0)


def test_sources_round_trip(spark, tmp_path):
    from tessera.sources import tables

    panel = spark.createDataFrame([("p", n, d, float(d)) for n in "AB" for d in range(3)], "label string, name string, day int, x double")
    tables.write_wide(panel, str(tmp_path / "wide"))
    assert sorted(map(tuple, tables.read_panel(spark, str(tmp_path / "wide"), "p").collect())) == sorted(map(tuple, panel.collect()))
    (tmp_path / "names.txt").write_text("A\n# no\n\nB # yes\n")
    assert [r.name for r in tables.read_names(spark, str(tmp_path / "names.txt")).collect()] == ["A", "B"]
    panel.write.option("header", True).csv(str(tmp_path / "out"))
    assert tables.read_results(spark, str(tmp_path / "out" / "*.csv")).count() == 6


def _queries():
    from tessera.plans.queries import ORACLE_SQL, QUERIES

    return sorted(QUERIES), ORACLE_SQL


@pytest.mark.parametrize("name", _queries()[0])
def test_query_runs_and_meets_its_sql(spark, name):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = _queries()[1].get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    text = lambda row: tuple(f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(map(text, rows)) == sorted(text([r[k] for k in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
