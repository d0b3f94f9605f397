"""Sources and sinks: price panels from tables, parquet, CSV and text readers, resumable result tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def brand_prices(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """(label, name, day, price): the mean unit price of each brand by month or week."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    by = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("day"))
    return by.agg(F.avg("unit").alias("price")).select(F.lit(f"brand_{unit}").alias("label"), "name", "day", "price")


def nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, name, day, price): the mean order value of each customer nation by month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    wide = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return wide.groupBy(F.col("n_name").alias("name"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(F.avg("o_totalprice").alias("price")).select(F.lit("nation_month").alias("label"), "name", "day", "price")


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, name, day, price): the mean value of ten user groups by hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return events.groupBy(F.format_string("u%d", F.col("user_id") % 10).alias("name"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("day")).agg(F.avg("value").alias("price")).select(F.lit("event_hour").alias("label"), "name", "day", "price")


def read_panel(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A wide parquet panel (day, one column a name) as (label, name, day, x)."""
    wide = spark.read.parquet(path)
    day, *names = wide.columns
    return wide.unpivot([day], names, "name", "x").select(F.lit(label).alias("label"), "name", F.col(day).alias("day"), F.col("x").cast("double").alias("x"))


def write_wide(panel: DataFrame, path: str) -> None:
    """The reverse of read_panel, for export; names become columns."""
    panel.groupBy("day").pivot("name").agg(F.first("x")).write.mode("overwrite").parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines and # comments are left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("name")).where("name <> ''")


def read_results(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV result tables by path or glob, with the file that each row is from."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(paths).withColumn("file", F.col("_metadata.file_name"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def missing_keys(wanted: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of wanted whose keys a resumable table does not hold yet; all of them when there is none."""
    spark = wanted.sparkSession
    if not exists(spark, path):
        return wanted
    schema = ", ".join(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in keys)
    return wanted.join(spark.read.schema(schema).parquet(path).select(*keys).distinct(), keys, "left_anti")


def append_results(rows: DataFrame, path: str, by: str = "replicate") -> None:
    """Add rows to a resumable table; one folder a replicate, so a repeated run is seen by missing_keys."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files, each with the header; read_results reads them as one table."""
    rows.write.mode("append").option("header", True).csv(path)


def write_two_headers(cells: DataFrame, path: str) -> None:
    """cells (row, group, field, value) as one CSV table with two header rows, groups over their fields, rows in order. For
    reports: the columns are as many as there are groups and fields, and one file is written."""
    names = [tuple(r) for r in cells.select("group", "field").distinct().orderBy("group", "field").collect()]
    wide = cells.groupBy("row").agg(*[F.first(F.when((F.col("group") == g) & (F.col("field") == f), F.col("value")), ignorenulls=True).cast("string").alias(f"c{k}") for k, (g, f) in enumerate(names)])
    order = F.struct(F.lit(1).alias("_k_"), F.col("row").cast("string").alias("_r_"))
    body = wide.select(order.alias("_o_"), F.col("row").cast("string").alias("row"), *[c for c in wide.columns if c != "row"])
    heads = [[(0, str(k)), "row" if k else None, *(n[k] if k or not i or names[i - 1][0] != n[0] else None for i, n in enumerate(names))] for k in (0, 1)]
    top = cells.sparkSession.createDataFrame(heads, body.schema)
    top.unionByName(body).orderBy("_o_").drop("_o_").coalesce(1).write.mode("overwrite").option("header", False).csv(path)


def read_two_headers(spark: SparkSession, path: str) -> DataFrame:
    """(row, group, field, value) of CSV tables with two header rows: groups, which stand over their first field
    alone, and fields. The first column names the rows. Several files of one shape read as one table: a line that equals
    a header line is a header wherever it stands, so nothing depends on the order of partitions."""
    lines = spark.read.option("header", False).csv(path)
    columns = lines.columns
    top, fields = (list(r) for r in lines.head(2))  # of the first file
    groups, last = [], None
    for g in top:
        last = g or last
        groups.append(last)
    same = lambda head: F.array(*columns).eqNullSafe(F.array(*[F.lit(h).cast("string") for h in head]))
    body = lines.where(~same(top) & ~same(fields))
    told = [F.struct(F.lit(g).alias("group"), F.lit(f).alias("field"), F.col(c).cast("double").alias("value")) for c, g, f in zip(columns[1:], groups[1:], fields[1:])]
    return body.select(F.col(columns[0]).alias("row"), F.explode(F.array(*told)).alias("cell")).select("row", "cell.*").where("value is not null")


def write_panel(panel: DataFrame, path: str) -> None:
    """panel (label, name, day, ...) as a store partitioned by label and month; written months replace older ones."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    panel.select("*", month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "month").parquet(path)


def read_slice(spark: SparkSession, path: str, label: str, first: str, last: str) -> DataFrame:
    """The days from first to last, both included, of one label of a store: only its months' folders are read."""
    schema = spark.read.parquet(path).schema
    kinds = ", ".join(f"{f.name} {'string' if f.name in ('label', 'month') else f.dataType.simpleString()}" for f in schema)
    months = (F.col("month") >= first[:7]) & (F.col("month") <= last[:7])
    day = F.to_date("day")
    return spark.read.schema(kinds).parquet(path).where((F.col("label") == label) & months & (day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date"))).drop("month")


def business_days(dates: DataFrame, day: str) -> DataFrame:
    """(day, number): Mondays to Fridays from the first to the last value of a column of dates."""
    bounds = dates.agg(F.min(day).cast("date").alias("first"), F.max(day).cast("date").alias("last"))
    days = bounds.select("first", F.explode(F.sequence("first", "last")).alias("day")).where(F.weekday("day") < 5)
    # Mondays to Fridays number themselves: five a week from a Monday before all
    place = lambda c: F.floor(F.datediff(c, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.weekday(c), F.lit(5))
    return days.select("day", (place(F.col("day")) - place(F.col("first"))).cast("int").alias("number"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, a temporary folder of a
    single-machine session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="tessera-")).rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut by a checkpoint: computed once, however many branches of a plan read them, and there
    after a lost executor. For tables that are small beside what they come from."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()
