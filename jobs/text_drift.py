"""Watch measures of text tables for breaks, gaps and outliers, as panels of prices are watched.

    python -m jobs.text_drift --config jobs/text_drift.json --input IN --output OUT

Each panel of the config reads one text table: a positive measure of each row, averaged by name (a language, a source,
a role) and block of consecutive ids, in the place of a day. The cleaning operators for prices then tell where a name's
level jumps and how (a spike, a lasting step, a step by a round ratio), which names are missing or stale in too many
blocks, which blocks lie farthest out and how the panel is distributed. OUT gets

    series/label                 name, block, mean value, rows
    facts/label/section          name, block, metric, value, note; sections coverage, breaks, outliers, report, rows

as partitioned Parquet under dynamic partition overwrite: a run replaces the labels of its config and no others. Every
section of a label has a row that counts its facts, so that no partition of an earlier run can outlive it. The table is
read once, with the columns that the config names; what is sorted afterwards is one row per name and block. Rows
without id, name or value are counted and left out.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panel as P

LOG = logging.getLogger("jobs.text_drift")
SERIES = "name string, day long, price double, n long, label string"
FACTS = "name string, day long, metric string, value double, note string, label string, section string"
REPORT = ("n_names", "n_days", "q", "kurtosis_median", "kurtosis_max", "zero_fraction", "cv2")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions of path that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def series(table: DataFrame, spec: dict) -> DataFrame:
    """(label, name, day, price, n, bad): the mean of the measure by name and block, bad rows under a null name."""
    cells = table.select(F.expr(spec["name"]).cast("string").alias("name"), F.floor(F.expr(spec["order"]) / spec["width"]).alias("day"), F.expr(spec["value"]).cast("double").alias("value"))
    bad = F.col("name").isNull() | F.col("day").isNull() | F.col("value").isNull()
    groups = cells.groupBy(F.when(~bad, F.col("name")).alias("name"), F.when(~bad, F.col("day")).alias("day"))
    return groups.agg(F.avg(F.when(~bad, F.col("value"))).alias("price"), F.count_if(~bad).alias("n"), F.count_if(bad).alias("bad")).withColumn("label", F.lit(spec["label"]))


def _long(rows: DataFrame, section: str, metrics: tuple[str, ...], day=None, note=None) -> DataFrame:
    """Wide rows as facts of one section."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("cell")
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    day = F.lit(None).cast("long") if day is None else day.cast("long")
    note = F.lit(None).cast("string") if note is None else note.cast("string")
    return rows.select("label", F.lit(section).alias("section"), name.alias("name"), day.alias("day"), note.alias("note"), cells).select("name", "day", "cell.metric", "cell.value", "note", "label", "section")


def facts(bars: DataFrame, config: dict) -> DataFrame:
    """All sections of bars (label, name, day, price)."""
    grid = P.dense_grid(bars)
    returns = P.log_returns(P.require_positive(P.forward_fill(grid, config["fill"])))
    panel = P.complete_days(returns)
    breaks = P.price_breaks(grid, config["threshold"], config["window"])
    worst = P.worst_outliers(panel, config["worst"]).join(panel.select("label", "name", "t", "day"), ["label", "name", "t"])
    told = [
        _long(P.coverage_report(returns), "coverage", ("coverage", "zero_fraction", "longest_stale_run"), note=F.col("dropped_because")),
        _long(breaks, "breaks", ("log_return", "level_ratio"), F.col("day"), F.concat_ws(" ", "kind", F.when(F.col("split_ratio") != "", F.col("split_ratio")))),
        _long(worst, "outliers", ("sd", "x"), F.col("day"), F.col("rank")),
        _long(P.panel_report(panel), "report", REPORT),
    ]
    whole = told[0]
    for more in told[1:]:
        whole = whole.unionByName(more)
    sections = F.explode(F.array(*[F.lit(s) for s in ("coverage", "breaks", "outliers", "report")])).alias("section")
    wanted = bars.select("label").distinct().select("label", sections)
    counts = wanted.join(whole.groupBy("label", "section").count(), ["label", "section"], "left").select("label", "section", F.coalesce("count", F.lit(0)).alias("facts"))
    counted = _long(counts.withColumnRenamed("section", "kept"), "rows", ("facts",), note=F.col("kept"))
    return whole.unionByName(counted.select("name", "day", "metric", "value", F.lit(None).cast("string").alias("note"), "label", F.col("note").alias("section")))


def run(spark: SparkSession, config: dict, source: str, output: str) -> dict[str, int]:
    """Make the series and facts of every panel of config anew; the rows read by label."""
    read = {}
    for spec in config["panels"]:
        told = Observation()
        sums = series(spark.read.parquet(f"{source}/{spec['table']}"), spec).observe(told, F.sum("n").alias("rows"), F.sum("bad").alias("bad"))
        _write(sums.where("n > 0").select("name", "day", "price", "n", "label"), f"{output}/series", "label")
        read[spec["label"]] = told.get["rows"] or 0
        LOG.info("%s: read %d rows of %s, left out %d", spec["label"], read[spec["label"]], spec["table"], told.get["bad"] or 0)
    labels = [spec["label"] for spec in config["panels"]]
    bars = spark.read.schema(SERIES).parquet(f"{output}/series").where(F.col("label").isin(labels))
    told = Observation()
    _write(facts(bars, config).observe(told, F.count(F.lit(1)).alias("rows")), f"{output}/facts", "label", "section")
    LOG.info("wrote %d facts of %d panels", told.get["rows"], len(labels))
    return read


def read_facts(spark: SparkSession, output: str) -> DataFrame:
    """The facts as they stand."""
    return spark.read.schema(FACTS).parquet(f"{output}/facts")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "input", "output"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config) as file:
        config = json.load(file)
    spark = SparkSession.builder.appName("text_drift").getOrCreate()
    try:
        run(spark, config, args.input.rstrip("/"), args.output.rstrip("/"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
