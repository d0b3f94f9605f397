"""Stores, slices, two header rows and appended CSV tables."""

import datetime

from pyspark.sql import functions as F

from tessera.functions import spectra
from tessera.plans import jobs, selection
from tessera.sources import tables


def test_two_headers_round_trip(spark, tmp_path):
    cells = [(f"r{k}", g, f, None if (k, g) == (2, "b") else float(10 * k + j)) for k in range(4) for j, (g, f) in enumerate((("a", "x"), ("a", "y"), ("b", "x"), ("c", "z, \"quoted\"")))]
    frame = spark.createDataFrame(cells, "row string, group string, field string, value double").repartition(3)
    tables.write_two_headers(frame, str(tmp_path / "t"))
    text = [p for p in (tmp_path / "t").glob("*.csv")]
    assert len(text) == 1 and text[0].read_text().splitlines()[0] == ",a,,b,c" and text[0].read_text().splitlines()[1].startswith("row,x,y,x,")
    got = {(r.row, r.group, r.field): r.value for r in tables.read_two_headers(spark, str(tmp_path / "t")).collect()}
    assert got == {c[:3]: c[3] for c in cells if c[3] is not None}
    again = (tmp_path / "t" / "more.csv")
    again.write_text(text[0].read_text().replace("r", "s").replace("sow", "row"))  # a second file of the same shape
    assert {r.row for r in tables.read_two_headers(spark, str(tmp_path / "t")).collect()} == {f"{c}{k}" for c in "rs" for k in range(4)}


def test_appended_csv_has_one_header_a_file(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", k / 7) for k in range(20)], "replicate int, label string, value double")
    path = str(tmp_path / "r")
    for part in ("replicate < 8", "replicate >= 8"):
        tables.append_csv(rows.where(part).coalesce(2), path)
    got = tables.read_results(spark, path, "replicate int, label string, value double")
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    assert all(p.read_text().startswith("replicate,label,value") for p in (tmp_path / "r").glob("*.csv"))
    assert got.select("file").distinct().count() >= 2


def test_a_slice_reads_only_its_months(spark, tmp_path):
    first = datetime.date(2024, 1, 1)
    rows = [(label, f"n{i}", first + datetime.timedelta(days=d), float(d)) for label in ("p", "q") for i in range(3) for d in range(200)]
    panel = spark.createDataFrame(rows, "label string, name string, day date, x double")
    tables.write_panel(panel, str(tmp_path / "s"))
    got = tables.read_slice(spark, str(tmp_path / "s"), "p", "2024-02-10", "2024-04-01")
    days = {r.day for r in got.collect()}
    assert min(days) == datetime.date(2024, 2, 10) and max(days) == datetime.date(2024, 4, 1) and got.count() == 3 * 52
    scan = got._jdf.queryExecution().executedPlan().toString()
    pushed = scan[scan.index("PartitionFilters") :].split("]")[0]
    assert "label" in pushed and "month" in pushed
    assert all("label=p" in f and ("month=2024-02" in f or "month=2024-03" in f or "month=2024-04" in f) for f in {r.f for r in got.select(F.input_file_name().alias("f")).collect()})
    tables.write_panel(panel.where("label = 'p' and day < date'2024-02-01'").withColumn("x", F.lit(-1.0)), str(tmp_path / "s"))  # months are replaced, others stay
    assert spark.read.parquet(str(tmp_path / "s")).where("x < 0").count() == 3 * 31 and spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_business_days_of_a_column(spark):
    dates = spark.createDataFrame([("2024-03-02",), ("2024-03-12",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [(str(r.day), r.number) for r in tables.business_days(dates, "d").orderBy("day").collect()]
    assert got == [(f"2024-03-{d:02d}", k) for k, d in enumerate((4, 5, 6, 7, 8, 11, 12))]


def test_visibility_and_collinearity(spark):
    import numpy as np

    from tessera.functions import coupling, estimators

    rng = np.random.default_rng(5)
    x = rng.standard_normal((9, 90)) * rng.uniform(0.5, 2, (9, 1))
    panel = spark.createDataFrame([("p", f"n{i}", t, float(x[i, t]), t) for i in range(9) for t in range(90)], "label string, name string, day int, x double, t int")
    got = {(r.origin, r.estimator): r for r in jobs.shrinkage_visibility(panel, 40, 10, 10).collect()}
    for o in range(5):
        y = spectra.adjusted(x[:, 10 * o : 10 * o + 40])
        cov = spectra.covariance(y)
        told = coupling.visible(estimators.hierarchical(y) - cov, spectra.eigenpairs(cov)[1])
        assert abs(got[o, "hierarchical"].visible - np.linalg.norm(told) / np.linalg.norm(cov)) < 1e-12
        assert got[o, "oas"].invisible and got[o, "quadratic_inverse"].invisible and not got[o, "hierarchical"].invisible
    states = selection.coupling_states(panel, 40, 10, 10, (15.0,)).collect()
    designs = [np.asarray(s.blocks).reshape(4, 3, 6) for s in states]
    want = coupling.collinearity(designs, [coupling.gaps(s["values"])[0] for s in states])
    frame = spark.createDataFrame([(s.label, s.half_life, s.sums) for s in states], "label string, half_life double, sums array<double>")
    for r in selection.feature_collinearity(frame).collect():
        i, j = selection.FEATURES.index(r.a), selection.FEATURES.index(r.b)
        size = np.sum([np.square(d[i]).sum() for d in designs]) * np.sum([np.square(d[j]).sum() for d in designs])
        assert (r.correlation is None and size == 0) or abs(r.correlation - want[i, j]) < 1e-9
