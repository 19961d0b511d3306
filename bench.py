"""Headline queries on stored report tables, and the group-by benchmark on generated rows.

Prints one JSON line. Every query is run once cold and then three times; the value of a query
is the median of the warm runs with a ``noop`` sink, so that all output rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.operators.measures import purchase_summary
from webmetrics.plans import event_report, event_table, newuser_report, options, product_report
from webmetrics.plans.etl import run_etl
from webmetrics.schema import STORED_COLUMNS
from webmetrics.sources import driver_tables as sample
from webmetrics.sources import scan, sink
from webmetrics.sources.purchases import gen_purchases
from webmetrics.spec import FilterSpec

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SIZES = [int(n) for n in os.environ.get("BENCH_PURCHASES", "1000000,5000000,25000000").split(",")]
WARM_RUNS = 3

RECENT = FilterSpec(start="2024-01-16", end="2024-01-30")
AUDIENCE = FilterSpec(mediums=("", "cpc"), keyword="goo")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("webmetrics bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-tables-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> tuple[float, float]:
    """(cold, warm median); planning is included each time."""
    cold = seconds(lambda: drain(build()))
    return cold, statistics.median(seconds(lambda: drain(build())) for _ in range(WARM_RUNS))


def report_queries(spark: SparkSession) -> dict:
    events = scan.open_table(spark, "events")
    products = scan.open_table(spark, "products")
    people = scan.open_table(spark, "newusers")
    everyone = FilterSpec()
    by_time = [{"column_id": "event_datetime", "direction": "asc"}]
    return {
        "kpi": lambda: event_report.kpi(events, RECENT),
        "kpi_compare": lambda: event_report.kpi_compare(events, RECENT),
        "daily_trend": lambda: event_report.daily_trend(events, RECENT),
        "device_share": lambda: event_report.device_share(events, RECENT),
        "event_composition": lambda: event_report.event_composition(events, RECENT),
        "funnel_rates": lambda: event_report.funnel_rates(event_report.funnel(events, RECENT)),
        "category_revenue_all": lambda: product_report.category_revenue(products, None, everyone),
        "category_revenue": lambda: product_report.category_revenue(products, events, AUDIENCE),
        "top_items": lambda: product_report.top_items(products, events, AUDIENCE),
        "products_page": lambda: product_report.products_page(products, events, AUDIENCE, 1),
        "events_page": lambda: event_table.events_page(events, RECENT, None, 1),
        "events_page_sorted": lambda: event_table.events_page(events, AUDIENCE, by_time, 2),
        "newuser_stats": lambda: newuser_report.newuser_stats(people, everyone),
        "newuser_medium": lambda: newuser_report.newuser_medium(people, everyone),
        "newuser_conversion": lambda: newuser_report.newuser_conversion(people, everyone),
        "filter_options": lambda: options.filter_options(events, products),
        "filter_options_in_one_scan": lambda: options.filter_options_in_one_scan(events, products),
    }


def reload_days(spark: SparkSession) -> tuple[float, float]:
    """Load all shards, then the last five days again, three times: (first load, median reload)."""
    where = tempfile.mkdtemp(prefix="bench-load-")
    spark.sql(f"CREATE DATABASE bench_load LOCATION '{where}'")
    layout = sink.StoreLayout(database="bench_load")
    raw = f"{where}/raw"
    sample.raw_events(spark, FOLDER).write.partitionBy("table_suffix").parquet(raw)
    records = spark.read.parquet(raw).withColumn("table_suffix", F.col("table_suffix").cast("string"))

    def load(start: str, end: str) -> None:
        run_etl(spark, records, f"{where}/files", start, end, layout, ["event_id"], replace="partitions")

    first = seconds(lambda: load("20240101", "20240131"))
    return first, statistics.median(seconds(lambda: load("20240126", "20240130")) for _ in range(WARM_RUNS))


def main() -> None:
    spark = session()
    warm, cold = {}, {}
    frames = [make(spark, FOLDER) for make in (sample.events, sample.products, sample.newusers)]
    layout = sink.StoreLayout(rebalance=tuple(STORED_COLUMNS))
    builds = [seconds(lambda: sink.build_warehouse(spark, *frames, layout=layout))
              for _ in range(1 + WARM_RUNS)]
    cold["build_warehouse"], warm["build_warehouse"] = builds[0], statistics.median(builds[1:])
    cold["reload_days"], warm["reload_days"] = reload_days(spark)
    in_memory = [scan.materialize(spark.table(name)) for name in STORED_COLUMNS]
    rows = {name: df.count() for name, df in zip(STORED_COLUMNS, in_memory)}
    for name, build in report_queries(spark).items():
        cold[name], warm[name] = timed(build)
    for df in in_memory:
        df.unpersist()

    for n in SIZES:
        purchases = scan.materialize(gen_purchases(spark, n), ["year", "supplier", "purchase_amount"])
        loaded = seconds(purchases.count)
        name = f"purchase_summary_{n}"
        cold[name], warm[name] = timed(lambda: purchase_summary(purchases))
        rows[name], cold[f"{name}_load"] = n, loaded
        purchases.unpersist()

    print(json.dumps({
        "metric": "total warm query time",
        "value": round(sum(warm.values()), 4),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in warm.items()},
        "cold": {k: round(v, 4) for k, v in cold.items()},
        "rows": rows,
        "sf": os.path.basename(os.path.normpath(FOLDER)),
        "cpus": int(CPUS),
        "memory": os.environ.get("BENCH_MEMORY", "16g"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
