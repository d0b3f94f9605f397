"""Keep cleaned return panels up to date as new files of prices arrive.

    python -m jobs.panel_store --config jobs/panel_store.json --input IN --output OUT --checkpoint STATE

IN is a folder of tables, OUT and STATE may be anywhere that Spark reaches. Each panel of the config is a file
stream with a checkpoint of its own under STATE: a run takes the files that no run has taken before and ends when
they are read. A batch of files becomes, under OUT,

    parts/label/month/batch      sums and counts of each name and day in that batch
    bars/label/month             mean price and rows of each name and day, for the months that the batch reaches

and a run that found new bars ends with

    panel/label/month            filled prices, log returns and the number of the day in the complete panel
    coverage/label               the coverage report of the label's names

all partitioned Parquet under dynamic partition overwrite. A batch that is run again after a failure writes the same
partitions again, so nothing counts twice; a run without new files changes nothing. Bars know the last batch that made
them and a panel the last batch that it holds: a run that died between the two is caught up by the next one, new
files or not. A row that is late for its month only has that month's bars made anew from its parts; the panel, whose
day numbers depend on all months, is made from the label's bars, one row per name and day. Rows without name, day
or price are counted and left out; so are rows whose lookup has no match when they arrive, so lookups come first. A
file delivered twice under two names is two files.

A panel's table is Parquet, or what its format says (orc, json, csv), with an optional schema and reader options.
files_per_batch bounds a batch, and with it what a failure repeats; by default a run is one batch.
"""

from __future__ import annotations

import argparse
import functools
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panel as P
from tessera.sources import tables

LOG = logging.getLogger("jobs.panel_store")
PARTS = "name string, day timestamp_ntz, total double, n long, label string, month string, batch long"
BARS = "name string, day timestamp_ntz, price double, n long, batch long, label string, month string"
PANEL = "name string, day timestamp_ntz, price double, n long, x double, t int, batch long, label string, month string"
COVERAGE = "name string, coverage double, zero_fraction double, longest_stale_run long, dropped_because string, label string"


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions of path that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _month(day: str = "day"):
    return F.date_format(day, "yyyy-MM").alias("month")


def part_sums(batch: DataFrame, spec: dict, lookups: list[DataFrame]) -> DataFrame:
    """(name, day, total, n, bad) of one batch of the panel's table; bad counts rows without name, day or price."""
    rows = batch
    for lookup, told in zip(spec.get("lookups", []), lookups):
        rows = rows.join(told, F.expr(lookup["on"]), "left")
    day = F.expr(spec["day"]).cast("timestamp_ntz")
    cells = rows.select(F.expr(spec["name"]).cast("string").alias("name"), day.alias("day"), F.expr(spec["price"]).cast("double").alias("price"))
    bad = F.col("name").isNull() | F.col("day").isNull() | F.col("price").isNull()
    sums = cells.groupBy(F.when(~bad, F.col("name")).alias("name"), F.when(~bad, F.col("day")).alias("day"))
    return sums.agg(F.sum(F.when(~bad, F.col("price"))).alias("total"), F.count_if(~bad).alias("n"), F.count_if(bad).alias("bad"))


def _last(spark: SparkSession, schema: str, path: str, label: str) -> int | None:
    """The last batch that a table of the store knows of for a label; None where there is none."""
    if not tables.exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("label") == label).agg(F.max("batch")).first()[0]


def publish(spark: SparkSession, label: str, output: str, fill: int) -> None:
    """panel and coverage of label from its bars, unless they hold the last batch already. A month of the panel never
    goes: days are only added."""
    last = _last(spark, BARS, f"{output}/bars", label)
    if last is None or last == _last(spark, PANEL, f"{output}/panel", label):
        LOG.info("%s: nothing new to publish", label)
        return
    bars = spark.read.schema(BARS).parquet(f"{output}/bars").where(F.col("label") == label)
    filled = P.forward_fill(P.dense_grid(bars), fill)
    returns = P.log_returns(P.require_positive(filled))
    days = P.complete_days(returns).select("label", "name", "day", "t")
    keys = ["label", "name", "day"]
    panel = filled.join(returns, keys).join(days, keys, "left").join(bars.select(*keys, "n"), keys, "left")
    told = Observation()
    # coverage goes first: what a run left undone shows in the panel
    _write(P.coverage_report(returns).select("name", "coverage", "zero_fraction", F.col("longest_stale_run").cast("long").alias("longest_stale_run"), "dropped_because", "label"), f"{output}/coverage", "label")
    panel = panel.select("name", "day", "price", F.coalesce("n", F.lit(0)).alias("n"), "x", "t", F.lit(last).cast("long").alias("batch"), "label", _month())
    _write(panel.observe(told, F.count(F.lit(1)).alias("rows"), F.count("t").alias("complete")), f"{output}/panel", "label", "month")
    LOG.info("%s: wrote panel of %d rows, %d on complete days, through batch %d", label, told.get["rows"], told.get["complete"], last)


def take(spec: dict, lookups: list[DataFrame], output: str, read: dict[str, int], batch: DataFrame, number: int) -> None:
    """One batch of the stream: parts, then the bars of the months that it reaches. Adds its rows to read."""
    spark, label = batch.sparkSession, spec["label"]
    told = Observation()
    sums = part_sums(batch, spec, lookups).observe(told, F.sum("n").alias("rows"), F.sum("bad").alias("bad"))
    good = sums.where("n > 0").select("name", "day", "total", "n", F.lit(label).alias("label"), _month(), F.lit(number).cast("long").alias("batch"))
    _write(good, f"{output}/parts", "label", "month", "batch")
    rows, bad = (told.get.get(c) or 0 for c in ("rows", "bad"))
    read[label] += rows + bad
    LOG.info("%s: batch %d read %d rows, left out %d of them", label, number, rows + bad, bad)
    if not rows:
        return
    parts = spark.read.schema(PARTS).parquet(f"{output}/parts").where(F.col("label") == label)
    # months of a batch are calendar months: a bounded list
    months = sorted(r.month for r in parts.where(F.col("batch") == number).select("month").distinct().collect())
    cells = parts.where(F.col("month").isin(months)).groupBy("label", "month", "name", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    _write(cells.select("name", "day", (F.col("total") / F.col("n")).alias("price"), "n", F.lit(number).cast("long").alias("batch"), "label", "month"), f"{output}/bars", "label", "month")
    LOG.info("%s: batch %d wrote bars of %d months, %s to %s", label, number, len(months), months[0], months[-1])


def run(spark: SparkSession, config: dict, source: str, output: str, checkpoint: str) -> dict[str, int]:
    """Take what is new in each panel's table; the rows read by label."""
    read = {spec["label"]: 0 for spec in config["panels"]}
    for spec in config["panels"]:
        path, kind, options = f"{source}/{spec['table']}", spec.get("format", "parquet"), spec.get("options", {})
        lookups = [spark.read.parquet(f"{source}/{x['table']}") for x in spec.get("lookups", [])]
        schema = spec.get("schema") or spark.read.format(kind).options(**options).load(path).schema
        stream = spark.readStream.format(kind).schema(schema).options(**options)
        if config.get("files_per_batch"):
            stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
        each = functools.partial(take, spec, lookups, output, read)
        # the last letter as a pattern, so that a file and a folder of files both do
        new = stream.load(f"{path[:-1]}[{path[-1]}]").writeStream.foreachBatch(each)
        new.option("checkpointLocation", f"{checkpoint}/{spec['label']}").trigger(availableNow=True).start().awaitTermination()
        LOG.info("%s: took %d new rows of %s", spec["label"], read[spec["label"]], path)
        publish(spark, spec["label"], output, config.get("fill", 3))
    return read


def read_panel(spark: SparkSession, output: str) -> DataFrame:
    """The panels as they stand."""
    return spark.read.schema(PANEL).parquet(f"{output}/panel")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config) as file:
        config = json.load(file)
    spark = SparkSession.builder.appName("panel_store").getOrCreate()
    try:
        run(spark, config, args.input.rstrip("/"), args.output.rstrip("/"), args.checkpoint.rstrip("/"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
