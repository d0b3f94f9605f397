"""The jobs: two runs over growing input, replayed batches, bad rows, reruns, command lines."""

import datetime
import json
import math
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from jobs import panel_store, queries, text_drift

CONFIG = {"fill": 3, "panels": [{"label": "trades", "table": "trades.parquet", "name": "n_name", "day": "date_trunc('DAY', ts)", "price": "p / q", "lookups": [{"table": "names.parquet", "on": "key = n_key"}]}]}
TRADES = "key int, ts timestamp_ntz, p double, q double"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 28) + datetime.timedelta(days=day, hours=hour)


def trades(days, keys=(1, 2, 3)):
    return [(k, at(d, h), 10.0 * k + math.sin(d * k) + h, 1.0 + h) for d in days for k in keys for h in range(2) if not (k == 3 and d % 11 == 5)]


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, TRADES).coalesce(1).write.mode("append").parquet(f"{folder}/trades.parquet")


def store(spark, tmp_path, name="a"):
    return {k: spark.read.parquet(f"{tmp_path}/{name}/out/{k}").orderBy("label", "name", *["day"] * (k != "coverage")).collect() for k in ("bars", "panel", "coverage")}


def files(tmp_path, name="a"):
    return {str(p): p.stat().st_mtime_ns for p in (tmp_path / name / "out").rglob("*.parquet") if p.is_file()}


def run(spark, tmp_path, name="a", config=CONFIG):
    return panel_store.run(spark, config, str(tmp_path / "in"), str(tmp_path / name / "out"), str(tmp_path / name / "state"))


@pytest.fixture
def source(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "n_key int, n_name string").write.parquet(str(tmp_path / "in/names.parquet"))
    deliver(spark, tmp_path / "in", trades(range(40)))
    return tmp_path


def test_panel_store_takes_only_what_is_new(spark, source):
    assert run(spark, source) == {"trades": len(trades(range(40)))}
    before, at_first = files(source), store(spark, source)
    assert run(spark, source) == {"trades": 0} and files(source) == before  # nothing new: nothing written
    # a later month, a late row for the first month, rows without a price, a name or a day
    new = trades(range(40, 70)) + [(1, at(0, 5), 99.0, 2.0), (1, at(3), None, 1.0), (9, at(3), 5.0, 1.0), (2, None, 5.0, 1.0)]
    deliver(spark, source / "in", new)
    assert run(spark, source) == {"trades": len(new)}
    after = files(source)
    february = [p for p in before if "/bars/" in p and "month=2024-02" in p]
    january = [p for p in before if "/bars/" in p and "month=2024-01" in p]
    assert february and january and all(p not in after for p in january)
    grown = store(spark, source)
    assert run(spark, source, "b") == {"trades": len(trades(range(40))) + len(new)}  # all files at once give the same store
    whole = store(spark, source, "b")
    same = lambda table: [(r.name, r.day, r.price, r.n, r.x, r.t) for r in table["panel"]]
    assert same(whole) == same(grown) != same(at_first) and whole["coverage"] == grown["coverage"]
    assert [r[:3] for r in whole["bars"]] == [r[:3] for r in grown["bars"]]
    bar = {(r.name, r.day): (r.price, r.n) for r in grown["bars"]}
    assert bar["one", at(0)] == (pytest.approx((10 + 11 / 2 + 99 / 2) / 3), 3) and bar["one", at(3)][1] == 2 and len(bar) == 3 * 70 - 6
    panel = {(r.name, r.day): r for r in grown["panel"]}
    assert panel["three", at(5)].x == 0 and panel["three", at(5)].n == 0  # filled
    assert panel["two", at(7)].x == pytest.approx(math.log(bar["two", at(7)][0] / bar["two", at(6)][0]))
    assert sorted({r.t for r in grown["panel"]}) == list(range(69))


@pytest.mark.parametrize("step", ["bars", "panel"])
def test_a_run_that_dies_is_caught_up(spark, source, monkeypatch, step):
    """Killed while the second batch writes its bars, after its parts; or between the last bars and the panel."""
    config = CONFIG | {"files_per_batch": 1}
    deliver(spark, source / "in", trades(range(40, 60)))
    real, calls = panel_store._write, []

    def dies(rows, path, *by):
        if path.endswith(step):
            calls.append(path)
            if len(calls) == (2 if step == "bars" else 1):
                raise RuntimeError("lost")
        real(rows, path, *by)

    monkeypatch.setattr(panel_store, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, source, config=config)
    monkeypatch.setattr(panel_store, "_write", real)
    again = sum(run(spark, source, config=config).values())
    assert again == (len(trades(range(40, 60))) if step == "bars" else 0)  # the batch again, or no new row at all
    run(spark, source, "b")
    assert [r[:6] for r in store(spark, source)["panel"]] == [r[:6] for r in store(spark, source, "b")["panel"]]
    assert sum(r.n for r in store(spark, source)["bars"]) == len(trades(range(60)))
    before = files(source)
    run(spark, source, config=config)
    assert files(source) == before


def test_json_with_a_schema(spark, source):
    rows = spark.read.parquet(str(source / "in/trades.parquet"))
    rows.write.json(str(source / "in/trades.json"))
    spec = CONFIG["panels"][0] | {"table": "trades.json", "format": "json", "schema": TRADES}
    panel_store.run(spark, {"panels": [spec]}, str(source / "in"), str(source / "j/out"), str(source / "j/state"))
    run(spark, source)
    assert [r[:6] for r in store(spark, source, "j")["panel"]] == [r[:6] for r in store(spark, source)["panel"]]


def test_a_batch_without_a_good_row(spark, source):
    run(spark, source)
    before = store(spark, source)
    deliver(spark, source / "in", [(None, at(1), 1.0, 1.0), (1, at(1), None, 1.0)])
    spark.createDataFrame([], TRADES).coalesce(1).write.mode("append").parquet(str(source / "in/trades.parquet"))
    assert run(spark, source) == {"trades": 2} and store(spark, source) == before


DRIFT = {"fill": 3, "threshold": 0.4, "window": 10, "worst": 3, "panels": [{"label": "lengths", "table": "notes.parquet", "name": "lang", "order": "id", "width": 10, "value": "1 + length(text)"}, {"label": "words", "table": "notes.parquet", "name": "lang", "order": "id", "width": 20, "value": "size(split(text, ' '))"}]}


def notes(spark, folder, step=True):
    rows = [(k, "ab"[k % 2], "x" * (20 + (k * 7) % 5 + (40 if step and k % 2 and k >= 300 else 0))) for k in range(600)]
    rows += [(None, "a", "x"), (5, None, "x"), (5, "a", None), (605, "c", "")]
    spark.createDataFrame(rows, "id long, lang string, text string").write.mode("overwrite").parquet(f"{folder}/in/notes.parquet")


def facts(spark, tmp_path):
    return sorted((tuple(r) for r in text_drift.read_facts(spark, f"{tmp_path}/out").collect()), key=str)


def test_text_drift_finds_a_step_and_reruns_alike(spark, tmp_path):
    notes(spark, tmp_path)
    go = lambda config=DRIFT: text_drift.run(spark, config, f"{tmp_path}/in", f"{tmp_path}/out")
    assert go() == {"lengths": 601, "words": 601}
    first = facts(spark, tmp_path)
    step = [f for f in first if f[5] == "lengths" and f[6] == "breaks" and f[2] == "log_return"]
    assert [(f[0], f[1]) for f in step] == [("b", 30)] and step[0][3] > 0.9 and step[0][4].startswith("large_move")
    assert next(f for f in first if f[0] == "c" and f[2] == "coverage" and f[5] == "lengths")[4] == "coverage"
    assert {f[6] for f in first if f[2] == "facts"} == {"coverage", "breaks", "outliers", "report"}
    go()
    assert facts(spark, tmp_path) == first
    notes(spark, tmp_path, step=False)
    go(DRIFT | {"panels": DRIFT["panels"][:1]})  # one label made anew: its old breaks go, the other label stays
    second = facts(spark, tmp_path)
    assert not [f for f in second if f[5] == "lengths" and f[6] == "breaks" and f[0]] and [f for f in second if f[5] == "words"] == [f for f in first if f[5] == "words"]


def test_command_lines(spark, source):
    notes(spark, source)
    for job, config, more in (("panel_store", CONFIG, ["--checkpoint", f"{source}/cli/state"]), ("text_drift", DRIFT, [])):
        (source / f"{job}.json").write_text(json.dumps(config))
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", f"{source}/{job}.json", "--input", f"{source}/in/", "--output", f"{source}/cli/{job}", *more], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "read" in done.stderr and "wrote" in done.stderr, done.stderr[-2000:]
    run(spark, source)
    key = ["name", "day"]
    same = spark.read.parquet(f"{source}/cli/panel_store/panel").join(spark.read.parquet(f"{source}/a/out/panel").withColumnRenamed("x", "y"), key)
    assert same.where(F.col("x").eqNullSafe(F.col("y"))).count() == len(store(spark, source)["panel"])


def test_settings_stay_and_folders_are_new(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert queries._new_folder(spark, "job1") != queries._new_folder(spark, "job1") and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    for config in ("panel_store", "text_drift"):
        assert queries._config(config)["panels"]
