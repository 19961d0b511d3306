"""Sources, sinks, projections, scalar functions."""

from pyspark.sql import functions as F

from checks.registry import query, rounded, shared_folder
from checks.relations import (
    EVENT_SHOWN,
    EVENTS,
    NEWUSERS,
    PRODUCT_SHOWN,
    PRODUCTS,
    RAW,
    draw,
    micros,
    with_,
)
from webmetrics.functions import scalar as sc
from webmetrics.operators.flatten import explode_items, flatten_events, prune
from webmetrics.operators.measures import conversion_summary, purchase_summary
from webmetrics.plans.etl import run_etl
from webmetrics.plans.event_table import display_events
from webmetrics.plans.newuser_report import newuser_report
from webmetrics.plans.product_report import display_products
from webmetrics.schema import STORED_COLUMNS
from webmetrics.sources import driver_tables as sample
from webmetrics.sources import scan, sink
from webmetrics.sources.purchases import fill_purchases
from webmetrics.spec import FilterSpec

# ---- scans ---------------------------------------------------------------------------------


@query("scan_shard_range", with_(RAW, """
    SELECT event_id, table_suffix, event_name FROM ga_raw
    WHERE table_suffix BETWEEN '20240105' AND '20240112'"""))
def _(spark, folder):
    stored = shared_folder(spark, "shards")
    sink.write_parquet(sample.raw_events(spark, folder).select(
        "event_id", "table_suffix", "event_name"), stored, partition_by=("table_suffix",),
        rebalance=True)
    schema = "event_id BIGINT, event_name STRING, table_suffix STRING"
    return scan.read_raw_events(spark, stored, "20240105", "20240112", schema)


@query("scan_single_shard", with_(RAW, """
    SELECT event_id, table_suffix, event_name FROM ga_raw WHERE table_suffix = '20240105'"""))
def _(spark, folder):
    return scan.in_shards(sample.raw_events(spark, folder), "20240105") \
        .select("event_id", "table_suffix", "event_name")


@query("read_source", """
    SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type""")
def _(spark, folder):
    return scan.read_source(spark, "parquet", path=f"{folder}/events.parquet") \
        .groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


@query("run_template", with_(RAW, """
    SELECT table_suffix, event_name, count(*) AS row_count,
           count(DISTINCT user_pseudo_id) AS people
    FROM ga_raw WHERE table_suffix BETWEEN '20240105' AND '20240112'
    GROUP BY table_suffix, event_name"""))
def _(spark, folder):
    sample.raw_events(spark, folder).createOrReplaceTempView("webmetrics_raw")
    return scan.run_template(spark, "shard_sizes", source="webmetrics_raw",
                             start="20240105", end="20240112")


@query("read_table_path", """
    SELECT p_brand, count(*) AS cnt FROM part GROUP BY p_brand""")
def _(spark, folder):
    return scan.read_table_path(spark, f"{folder}/part.parquet") \
        .groupBy("p_brand").agg(F.count(F.lit(1)).alias("cnt"))


@query("open_table", with_(EVENTS, """
    SELECT country, count(*) AS cnt FROM ga_events GROUP BY country"""))
def _(spark, folder):
    sample.events(spark, folder).createOrReplaceTempView("webmetrics_events")
    return scan.open_table(spark, "webmetrics_events") \
        .groupBy("country").agg(F.count(F.lit(1)).alias("cnt"))


@query("open_optional_table", with_(NEWUSERS, """
    SELECT count(*) AS total, count(*) FILTER (WHERE did_purchase) AS converted,
           round(count(*) FILTER (WHERE did_purchase) * 100.0 / count(*), 6) AS rate,
           round(avg(CASE WHEN did_purchase AND days_to_first_purchase >= 0
                          THEN days_to_first_purchase END), 6) AS avg_days
    FROM ga_newusers"""))
def _(spark, folder):
    sample.newusers(spark, folder).createOrReplaceTempView("webmetrics_newusers")
    absent = newuser_report(scan.open_optional(spark, "webmetrics_not_built"), FilterSpec())
    present = newuser_report(scan.open_optional(spark, "webmetrics_newusers"), FilterSpec())
    return rounded((absent or present)["stats"])


def _purchase_sql(ids: str, select: str) -> str:
    def pick(values, stream):
        cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {draw(stream)} % {len(values)} {cases} END"

    return with_(f"""ga_purchases AS (
        SELECT purchase_id, CAST(2020 + ((purchase_id - 1) % 1000000) % 7 AS INTEGER) AS year,
               concat('Supplier_', {draw(1)} % 50 + 1) AS supplier,
               {pick(("Raw Material", "Equipment", "Chemical", "Logistics"), 2)} AS item_category,
               CAST({draw(3)} % 999 + 1 AS INTEGER) AS quantity,
               10.0::DOUBLE + {draw(4)}::DOUBLE / 2147483647.0::DOUBLE * 490.0::DOUBLE
                   AS unit_price,
               100.0::DOUBLE + {draw(5)}::DOUBLE / 2147483647.0::DOUBLE * 49900.0::DOUBLE
                   AS purchase_amount,
               {pick(("Fab 12", "Fab 15", "Fab 18", "HQ"), 6)} AS department,
               {pick(("Completed", "Pending", "Cancelled"), 7)} AS status
        FROM ({ids}))""", select)


_ORDER_IDS = "SELECT o_orderkey + 1 AS purchase_id FROM orders"


def _order_purchases(spark, folder):
    return fill_purchases(sample.table(spark, folder, "orders")
                          .select((F.col("o_orderkey") + 1).alias("purchase_id")))


@query("gen_purchases", _purchase_sql(_ORDER_IDS, """
    SELECT purchase_id, year, supplier, item_category, quantity, round(unit_price, 6) AS unit_price,
           round(purchase_amount, 6) AS purchase_amount, department, status
    FROM ga_purchases"""))
def _(spark, folder):
    return rounded(_order_purchases(spark, folder))


@query("append_table", _purchase_sql(_ORDER_IDS, """
    SELECT status, count(*) AS cnt, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM ga_purchases GROUP BY status"""))
def _(spark, folder):
    rows = _order_purchases(spark, folder)
    where = shared_folder(spark, "appended")
    name = "webmetrics_" + where.rsplit("-", 1)[-1]
    sink.append_table(rows.where("year < 2023"), name, location=where)
    sink.append_table(rows.where("year >= 2023"), name, location=where)
    return scan.open_table(spark, name).groupBy("status").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("quantity").alias("quantity"))


# ---- sinks ---------------------------------------------------------------------------------


@query("write_parquet", with_(EVENTS, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date, {micros('event_datetime')} AS event_datetime,
           event_name, user_pseudo_id, country, transaction_id
    FROM ga_events"""))
def _(spark, folder):
    stored = shared_folder(spark, "events")
    rows = sample.events(spark, folder).select(
        "event_date", "event_datetime", "event_name", "user_pseudo_id", "country",
        "transaction_id")
    sink.write_parquet(rows, stored, partition_by=("event_date",), rebalance=True)
    return scan.read_table_path(spark, stored, rows.schema)


def _layout(spark, name):
    where = shared_folder(spark, name)
    database = "webmetrics_" + where.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{where}'")
    return sink.StoreLayout(database=database, location=where, rebalance=tuple(STORED_COLUMNS))


def _loader(spark, folder):
    return lambda: (sample.events(spark, folder), sample.products(spark, folder),
                    sample.newusers(spark, folder))


_WAREHOUSE = """
    SELECT 'events' AS name, CAST(event_date AS VARCHAR) AS day, count(*) AS cnt,
           round(sum(total_purchase_revenue), 2) AS amount FROM ga_events GROUP BY event_date
    UNION ALL
    SELECT 'products', CAST(event_date AS VARCHAR), count(*), round(sum(item_total_revenue), 2)
    FROM ga_products GROUP BY event_date
    UNION ALL
    SELECT 'newusers', CAST(first_visit_date AS VARCHAR), count(*),
           round(sum(purchase_revenue_total), 2) FROM ga_newusers GROUP BY first_visit_date"""
# New users build on the events, as products do.
_TABLES = PRODUCTS + NEWUSERS.removeprefix(EVENTS)


def _stored_sums(spark, layout):
    def sums(name, day, amount):
        return spark.table(layout.table(name)).groupBy(day).agg(
            F.count(F.lit(1)).alias("cnt"), F.round(F.sum(amount), 2).alias("amount")
        ).select(F.lit(name).alias("name"), F.col(day).cast("string").alias("day"),
                 "cnt", "amount")

    return sums("events", "event_date", "total_purchase_revenue").unionByName(
        sums("products", "event_date", "item_total_revenue")).unionByName(
        sums("newusers", "first_visit_date", "purchase_revenue_total"))


@query("build_warehouse", with_(_TABLES, _WAREHOUSE))
def _(spark, folder):
    layout = _layout(spark, "warehouse")
    sink.build_warehouse(spark, *_loader(spark, folder)(), layout=layout)
    return _stored_sums(spark, layout)


@query("ensure_warehouse", with_(_TABLES, _WAREHOUSE))
def _(spark, folder):
    layout = _layout(spark, "ensured")
    load = _loader(spark, folder)
    sink.ensure_warehouse(spark, load, layout)
    sink.ensure_warehouse(spark, load, layout)  # finds the tables and builds nothing
    return _stored_sums(spark, layout)


@query("materialize", with_(EVENTS, """
    SELECT event_name, country, count(*) AS cnt FROM ga_events GROUP BY event_name, country"""))
def _(spark, folder):
    kept = scan.materialize(sample.events(spark, folder), ["event_name", "country"])
    return kept.groupBy("event_name", "country").agg(F.count(F.lit(1)).alias("cnt"))


@query("write_csv", """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, concat('Supplier_', l_suppkey) AS supplier,
           round(sum(l_extendedprice), 2) AS total_amount,
           round(avg(l_extendedprice), 2) AS avg_amount
    FROM lineitem GROUP BY ALL""")
def _(spark, folder):
    stored = shared_folder(spark, "csv")
    sink.write_csv(_supplier_summary(spark, folder), stored)
    return scan.read_source(
        spark, "csv", "year INT, supplier STRING, total_amount DOUBLE, avg_amount DOUBLE",
        path=stored, header=True)


def _supplier_summary(spark, folder):
    lines = sample.table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.concat(F.lit("Supplier_"), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.col("l_extendedprice").alias("purchase_amount"))
    return rounded(purchase_summary(lines), total_amount=2, avg_amount=2)


@query("purchase_summary", """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, concat('Supplier_', l_suppkey) AS supplier,
           round(sum(l_extendedprice), 2) AS total_amount,
           round(avg(l_extendedprice), 2) AS avg_amount
    FROM lineitem GROUP BY ALL""")
def _(spark, folder):
    return _supplier_summary(spark, folder)


@query("extract_row_count", with_(PRODUCTS, """
    SELECT 'events' AS name, count(*) AS row_count FROM ga_events
    UNION ALL SELECT 'products', count(*) FROM ga_products"""))
def _(spark, folder):
    stored = shared_folder(spark, "extract")
    frames = {"events": sample.events(spark, folder), "products": sample.products(spark, folder)}
    counts = [(name, sink.extract(name, df.select("event_date", "event_name"),
                                  f"{stored}/{name}"))
              for name, df in frames.items()]
    return spark.createDataFrame(counts, "name STRING, row_count BIGINT")


@query("previous_month", """
    SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS run_day,
           CAST(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS VARCHAR)
               AS month_start,
           CAST(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS VARCHAR)
               AS month_end
    FROM orders""")
def _(spark, folder):
    start, end = sink.previous_month("run_day")
    return (
        sample.table(spark, folder, "orders")
        .select(F.to_date("o_orderdate").alias("run_day")).distinct()
        .select("run_day", start.alias("month_start"), end.alias("month_end"))
    )


# Item records come as further, nameless events, so that no purchase is counted twice.
_DELIVERED = _TABLES + """,
ga_delivered AS (
    SELECT event_date, total_purchase_revenue FROM ga_events
    UNION ALL SELECT event_date, NULL FROM ga_products)"""
_DELIVERED_SUMS = _WAREHOUSE.replace("FROM ga_events", "FROM ga_delivered")


def _delivered(spark, folder):
    items = sample.raw_item_records(spark, folder)
    nothing = F.lit(None).cast(items.schema["ecommerce"].dataType)
    items = items.withColumns({"event_name": F.lit(None).cast("string"), "ecommerce": nothing})
    return sample.raw_events(spark, folder).unionByName(items)


@query("run_etl", with_(_DELIVERED, _DELIVERED_SUMS))
def _(spark, folder):
    layout = _layout(spark, "etl")
    month = sink.previous_month_range("2024-02-01")
    run_etl(spark, _delivered(spark, folder), f"{layout.location}/files", *month, layout,
            tie_break=["event_id"])
    return _stored_sums(spark, layout)


@query("run_etl_incremental", with_(_DELIVERED, _DELIVERED_SUMS))
def _(spark, folder):
    layout, raw = _layout(spark, "halves"), _delivered(spark, folder)
    files = f"{layout.location}/files"
    for start, end in (("20240101", "20240115"), ("20240116", "20240131"), ("20240110", "20240120")):
        run_etl(spark, raw, files, start, end, layout, ["event_id"], replace="partitions")
    return _stored_sums(spark, layout)


@query("etl_summary", with_(NEWUSERS, """
    SELECT count(*) AS users, count(*) FILTER (WHERE did_purchase) AS buyers,
           round(count(*) FILTER (WHERE did_purchase) * 100.0 / count(*), 6) AS conversion_rate
    FROM ga_newusers"""))
def _(spark, folder):
    return rounded(conversion_summary(sample.newusers(spark, folder)))


# ---- projections ---------------------------------------------------------------------------

_DIMENSIONS = "country, continent, device_type, campaign_name, traffic_medium, traffic_source"


_EVENT_COLUMNS = ("""event_name, event_value_in_usd, user_pseudo_id, country, region, city, sub_continent,
           continent, device_type, os, browser, device_language, mobile_brand, campaign_name, traffic_medium,
           traffic_source, total_items_count, total_purchase_revenue, transaction_id, unique_items_count""")
_EVENT_TIMES = f"""CAST(event_date AS VARCHAR) AS event_date, {micros('event_datetime')} AS event_datetime"""


@query("flatten_events", with_(EVENTS, f"SELECT {_EVENT_TIMES}, {_EVENT_COLUMNS} FROM ga_events"))
def _(spark, folder):
    return sample.events(spark, folder)


@query("flatten_events_wide", with_(EVENTS, f"""
    SELECT {_EVENT_TIMES}, {_EVENT_COLUMNS}, event_previous_timestamp, user_first_touch_timestamp,
           metro_area, os_version, browser_version, mobile_model
    FROM ga_events"""))
def _(spark, folder):
    return sample.events(spark, folder, wide=True)


_ITEMS = f"""CAST(event_date AS VARCHAR) AS event_date, user_pseudo_id,
           {micros('event_datetime')} AS event_datetime, event_name, item_id, item_name, item_brand,
           item_variant, item_category, item_category2"""
_ITEM_SUMS = """item_price, item_quantity, round(item_total_revenue, 2) AS item_total_revenue,
           item_reported_revenue"""
_ITEM_TAIL = "item_coupon_code, store_affiliation, location_id"


@query("explode_items", with_(PRODUCTS, f"""
    SELECT {_ITEMS}, {_ITEM_SUMS}, {_ITEM_TAIL} FROM ga_products"""))
def _(spark, folder):
    return rounded(sample.products(spark, folder), item_total_revenue=2)


@query("explode_items_wide", with_(PRODUCTS, f"""
    SELECT {_ITEMS}, item_category3, item_category4, item_category5, {_ITEM_SUMS},
           item_refund_amount, {_ITEM_TAIL}
    FROM ga_products"""))
def _(spark, folder):
    return rounded(sample.products(spark, folder, wide=True), item_total_revenue=2)


@query("unnest_items", with_(PRODUCTS, """
    SELECT event_name, item_id, count(*) AS item_count,
           CAST(sum(item_quantity + unit) AS BIGINT) AS quantity
    FROM ga_products, (VALUES (1), (2), (3)) AS units (unit) WHERE unit <= line % 4
    GROUP BY event_name, item_id"""))
def _(spark, folder):
    # Lists of one to three items, and empty ones, which must vanish.
    records = sample.raw_bundles(spark, folder, by_field=True).unionByName(
        sample.raw_events(spark, folder, by_field=True))
    return explode_items(records, by_field=True).groupBy("event_name", "item_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("item_quantity").alias("quantity"))


@query("line_total", """
    SELECT l_orderkey, l_partkey, l_linenumber, round(p_retailprice * l_quantity, 2) AS total
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(spark, folder):
    lines = sample.table(spark, folder, "lineitem")
    part = sample.table(spark, folder, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        sc.money(sc.line_total("p_retailprice", "l_quantity")).alias("total"))


@query("stored_columns", with_(EVENTS, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date, {micros('event_datetime')} AS event_datetime,
           event_name, country, device_type, traffic_medium, traffic_source, campaign_name,
           transaction_id, total_purchase_revenue, user_pseudo_id
    FROM ga_events"""))
def _(spark, folder):
    return prune(sample.events(spark, folder), STORED_COLUMNS["events"])


@query("event_display", with_(EVENTS, f"SELECT {EVENT_SHOWN} FROM ga_events"))
def _(spark, folder):
    return display_events(sample.events(spark, folder))


@query("product_display", with_(PRODUCTS, f"SELECT {PRODUCT_SHOWN} FROM ga_products"))
def _(spark, folder):
    return display_products(sample.products(spark, folder))


# ---- scalar functions ----------------------------------------------------------------------


@query("scalar_dates", with_(RAW, """
    SELECT event_id, CAST(CAST(strptime(event_date, '%Y%m%d') AS DATE) AS VARCHAR) AS parsed_day,
           strftime(make_timestamp(event_timestamp), '%Y-%m-%d %H:%M:%S.%f') AS moment,
           CAST(CAST(make_timestamp(event_timestamp) AS DATE) AS VARCHAR) AS utc_day,
           strftime(make_timestamp(event_timestamp), '%H:%M:%S') AS time_of_day,
           CAST(date_diff('day', CAST(strptime(event_date, '%Y%m%d') AS DATE),
                          DATE '2024-01-20') AS INTEGER) AS days_left,
           CAST(CAST(strptime(event_date, '%Y%m%d') AS DATE) - 29 AS VARCHAR) AS earlier_day
    FROM ga_raw"""))
def _(spark, folder):
    day = sc.parse_day("event_date")
    moment = sc.from_micros("event_timestamp")
    return sample.raw_events(spark, folder).select(
        "event_id", sc.iso_text(day).alias("parsed_day"), moment.alias("moment"),
        sc.iso_text(sc.day_of(moment)).alias("utc_day"),
        sc.time_text(moment).alias("time_of_day"),
        sc.days_between(F.lit("2024-01-20").cast("date"), day).alias("days_left"),
        sc.shift_days(day, -29).alias("earlier_day"))


@query("scalar_text", with_(RAW, r"""
    SELECT event_id, coalesce(country, '-') AS or_else, nullif(traffic_medium, '') AS blank_to_null,
           coalesce(nullif(traffic_source, ''), '-') AS named,
           CASE WHEN regexp_matches(traffic_medium, '\S') THEN traffic_medium
                ELSE '(direct)' END AS label,
           (country IN ('CHINA', 'JAPAN')) AS listed, (transaction_id IS NOT NULL) AS present
    FROM ga_raw"""))
def _(spark, folder):
    raw = sample.raw_events(spark, folder)
    events = flatten_events(raw, keep=["event_id"])
    return events.select(
        "event_id", sc.or_else("country", "-").alias("or_else"),
        sc.blank_to_null("traffic_medium").alias("blank_to_null"),
        sc.named("traffic_source", "-").alias("named"),
        sc.medium_label("traffic_medium", "(direct)").alias("label"),
        F.col("country").isin("CHINA", "JAPAN").alias("listed"),
        sc.flag_not_null("transaction_id").alias("present"))


@query("scalar_numbers", """
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
           round(l_extendedprice / 7, 2) AS seventh,
           round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax * 100 END, 6) AS pct,
           round(coalesce(CASE WHEN l_tax <> 0 THEN l_discount / l_tax * 100 END, 0), 6)
               AS pct_or_zero,
           CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS returned
    FROM lineitem""")
def _(spark, folder):
    return sample.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        sc.money(F.col("l_extendedprice") / F.lit(7.0)).alias("seventh"),
        F.round(sc.percent("l_discount", "l_tax"), 6).alias("pct"),
        F.round(sc.percent_or_zero("l_discount", "l_tax"), 6).alias("pct_or_zero"),
        sc.flag(F.col("l_returnflag") == "R").alias("returned"))
