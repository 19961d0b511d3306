"""Reports from what is stored for them: states of people and days, joined layouts, timelines, shards."""

from pyspark.sql import functions as F

from checks.registry import query, rounded, shared_folder
from checks.relations import (
    AUDIENCE,
    EVENT_SHOWN,
    EVENTS,
    NEWUSERS,
    PRODUCT_SHOWN,
    PRODUCTS,
    RAW,
    SOLD,
    micros,
    with_,
)
from checks.report_queries import (
    DIRECT_GOO,
    EVERYTHING,
    _category_sql,
    _compare_sql,
    _compared,
    _funnel_sql,
    _items_sql,
    _kpi_sql,
    _MATCHED,
    events,
    products,
)
from checks.source_queries import _DELIVERED, _DELIVERED_SUMS, _delivered, _layout, _stored_sums
from webmetrics.operators.ordering import Cursor
from webmetrics.operators.personstate import people_of, person_state
from webmetrics.plans import colocated, day_report, event_report, event_table, options, timeline_pages
from webmetrics.plans.etl import run_etl
from webmetrics.schema import EVENT_TABLE_COLUMNS, PRODUCT_TABLE_COLUMNS, RAW_EVENT_SCHEMA
from webmetrics.sources import driver_tables as sample
from webmetrics.sources import scan, shards, sink
from webmetrics.spec import FilterSpec

# A range with days before it (and before the period before it) and behind it.
MIDDLE = "event_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"
BEFORE = "event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
MIDDLE_DAYS = FilterSpec(start="2024-01-15", end="2024-01-21")
SPLIT = ("traffic_medium", "country", "campaign_name", "traffic_source")

# ---- states of people ------------------------------------------------------------------------


@query("person_state_people", with_(NEWUSERS, f"""
    SELECT user_pseudo_id, CAST(first_visit_date AS VARCHAR) AS first_visit_date,
           {micros('first_visit_datetime')} AS first_visit_datetime, country,
           region, city, continent, device_type, os, browser, device_language, mobile_brand,
           campaign_name, traffic_medium, traffic_source, did_purchase,
           {micros('first_purchase_datetime')} AS first_purchase_datetime,
           round(purchase_revenue_total, 2) AS purchase_revenue_total, purchase_count,
           CAST(days_to_first_purchase AS INTEGER) AS days_to_first_purchase
    FROM ga_newusers"""))
def _(spark, folder):
    state = person_state(sample.raw_events(spark, folder), ["event_id"])
    stored = shared_folder(spark, "state")
    sink.write_parquet(state, stored, partition_by=("table_suffix",), rebalance=True)
    return rounded(people_of(scan.read_table_path(spark, stored, state.schema)), purchase_revenue_total=2)


@query("run_etl_reload", with_(_DELIVERED, _DELIVERED_SUMS))
def _(spark, folder):
    """A wrong delivery (half of the days' records, and shards that are empty later) is replaced."""
    layout, raw = _layout(spark, "reload"), _delivered(spark, folder)
    files = f"{layout.location}/files"
    wrong = raw.where("event_id % 2 = 0").withColumn(
        "table_suffix", F.when(F.col("event_id") % 3 == 0, "20240131").otherwise(F.col("table_suffix")))
    for delivery, start, end in ((raw, "20240101", "20240112"), (wrong, "20240113", "20240131"), (raw, "20240113", "20240131")):
        run_etl(spark, delivery, files, start, end, layout, ["event_id"], replace="partitions")
    return _stored_sums(spark, layout)


# ---- states of days --------------------------------------------------------------------------


def _days(spark, folder, name):
    """All days, loaded in three pieces of which one is loaded again."""
    layout, rows = _layout(spark, name), events(spark, folder)
    for start, end in ((None, "2024-01-10"), ("2024-01-11", "2024-01-19"), ("2024-01-20", None), ("2024-01-09", "2024-01-12")):
        day_report.load_days(spark, rows, layout, start, end, SPLIT)
    return day_report.open_days(spark, layout, SPLIT)


@query("day_state_kpi", with_(EVENTS, _kpi_sql(f"{MIDDLE} AND {AUDIENCE}")))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-15", end="2024-01-21")
    return rounded(day_report.kpi(_days(spark, folder, "kpi"), spec), revenue=2)


@query("day_state_kpi_all", with_(EVENTS, _kpi_sql("TRUE")))
def _(spark, folder):
    return rounded(day_report.kpi(_days(spark, folder, "kpi-all"), EVERYTHING), revenue=2)


@query("day_state_kpi_compare", with_(EVENTS + _compare_sql(MIDDLE, BEFORE), ""))
def _(spark, folder):
    return _compared(day_report.kpi_compare(_days(spark, folder, "compare"), MIDDLE_DAYS))


@query("day_state_trend", with_(EVENTS, f"""
    SELECT country, CAST(day AS VARCHAR) AS day, events, round(revenue, 2) AS revenue,
           round(avg(events) OVER (PARTITION BY country ORDER BY day
                                   ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
    FROM (SELECT country, event_date AS day, count(*) AS events,
                 coalesce(sum(total_purchase_revenue), 0) AS revenue
          FROM ga_events WHERE {MIDDLE} GROUP BY country, event_date)"""))
def _(spark, folder):
    return rounded(day_report.daily_trend(_days(spark, folder, "trend"), MIDDLE_DAYS, by=["country"]), revenue=2)


@query("day_state_funnel", with_(EVENTS + _funnel_sql(f"{MIDDLE} AND {AUDIENCE}"), "SELECT * FROM ga_funnel"))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", event_names=("purchase",), start="2024-01-15", end="2024-01-21")
    return day_report.funnel(_days(spark, folder, "funnel"), spec)


# ---- co-located semi-joins -------------------------------------------------------------------


def _colocated(spark, folder, name):
    return colocated.store_colocated(products(spark, folder), events(spark, folder), 8, _layout(spark, name), 20)


@query("semi_join_colocated", with_(SOLD, f"""
    SELECT user_pseudo_id, {micros('event_datetime')} AS event_datetime, item_id, item_quantity,
           round(item_total_revenue, 2) AS item_total_revenue
    FROM ga_sold s WHERE {_MATCHED}"""))
def _(spark, folder):
    rows = _colocated(spark, folder, "joined").filter(DIRECT_GOO)
    return rounded(rows.select("user_pseudo_id", "event_datetime", "item_id", "item_quantity",
                               "item_total_revenue"), item_total_revenue=2)


@query("category_revenue_colocated", with_(SOLD, _category_sql(f"{_MATCHED} AND {MIDDLE}")))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-15", end="2024-01-21")
    return rounded(colocated.category_revenue(_colocated(spark, folder, "categories"), spec), revenue=2)


@query("top_items_colocated", with_(SOLD, _items_sql(_MATCHED)))
def _(spark, folder):
    return colocated.top_items(_colocated(spark, folder, "items"), DIRECT_GOO)


# ---- timelines -------------------------------------------------------------------------------


def _timelines(spark, folder, name):
    layout = _layout(spark, name)
    return [timeline_pages.store_timeline(make(spark, folder), table, layout, 500)
            for table, make in (("products", products), ("events", events))]


@query("events_page_timeline", with_(EVENTS, f"""
    SELECT {EVENT_SHOWN} FROM (
        SELECT * FROM ga_events WHERE {MIDDLE} AND {AUDIENCE}
        ORDER BY event_datetime DESC, {", ".join(EVENT_TABLE_COLUMNS)} LIMIT 20 OFFSET 40)"""))
def _(spark, folder):
    _, seen = _timelines(spark, folder, "event-pages")
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-15", end="2024-01-21")
    return timeline_pages.events_page(seen, spec, 2)


@query("products_page_timeline", with_(SOLD, f"""
    SELECT {PRODUCT_SHOWN} FROM (
        SELECT * FROM ga_sold s WHERE {_MATCHED}
        ORDER BY event_datetime DESC, {", ".join(PRODUCT_TABLE_COLUMNS)} LIMIT 20 OFFSET 40)"""))
def _(spark, folder):
    bought, seen = _timelines(spark, folder, "product-pages")
    return timeline_pages.products_page(bought, seen, DIRECT_GOO, 2)


@query("products_page_after_timeline", with_(SOLD, f"""
    SELECT {PRODUCT_SHOWN} FROM (
        SELECT * FROM ga_sold s WHERE {_MATCHED} AND {MIDDLE}
        ORDER BY event_datetime DESC, {", ".join(PRODUCT_TABLE_COLUMNS)} LIMIT 20 OFFSET 20)"""))
def _(spark, folder):
    bought, seen = _timelines(spark, folder, "product-cursors")
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-15", end="2024-01-21")
    first = timeline_pages.products_page_after(bought, seen, spec)
    cursor = Cursor.after([r.sort_values for r in first.collect()])  # one page
    return timeline_pages.products_page_after(bought, seen, spec, cursor).drop("sort_values")


@query("event_pages", with_(EVENTS, f"""
    SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS INTEGER) AS page_count
    FROM ga_events WHERE {MIDDLE}"""))
def _(spark, folder):
    return timeline_pages.event_pages(events(spark, folder), MIDDLE_DAYS)


@query("product_pages", with_(SOLD, f"""
    SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS INTEGER) AS page_count
    FROM ga_sold s WHERE {_MATCHED}"""))
def _(spark, folder):
    return timeline_pages.product_pages(products(spark, folder), events(spark, folder), DIRECT_GOO)


# ---- options and ranges ----------------------------------------------------------------------

_BOUNDS = "SELECT min(event_date) AS a, max(event_date) AS z FROM ga_events"


@query("filter_options_one_scan", with_(PRODUCTS, f"""
    SELECT 'country' AS field, country AS value, country AS label, count(*) AS cnt FROM ga_events WHERE country IS NOT NULL GROUP BY country
    UNION ALL SELECT 'event_name', event_name, event_name, count(*) FROM ga_events GROUP BY event_name
    UNION ALL SELECT 'category', item_category, item_category, count(*) FROM ga_products
              WHERE event_name = 'purchase' AND item_category <> '' GROUP BY item_category
    UNION ALL SELECT DISTINCT 'medium', coalesce(traffic_medium, ''),
              CASE WHEN trim(traffic_medium) <> '' THEN traffic_medium ELSE '(direct)' END, NULL FROM ga_events WHERE traffic_medium IS NOT NULL
    UNION ALL SELECT DISTINCT 'medium', '', '(direct)', NULL FROM ga_events WHERE traffic_medium IS NULL
    UNION ALL SELECT 'min_date', CAST(a AS VARCHAR), CAST(a AS VARCHAR), NULL FROM ({_BOUNDS})
    UNION ALL SELECT 'max_date', CAST(z AS VARCHAR), CAST(z AS VARCHAR), NULL FROM ({_BOUNDS})
    UNION ALL SELECT 'default_start', CAST(greatest(a, z - 29) AS VARCHAR), CAST(greatest(a, z - 29) AS VARCHAR), NULL FROM ({_BOUNDS})
    UNION ALL SELECT 'default_end', CAST(z AS VARCHAR), CAST(z AS VARCHAR), NULL FROM ({_BOUNDS})"""))
def _(spark, folder):
    return options.filter_options_in_one_scan(events(spark, folder), products(spark, folder))


@query("kpi_compare_middle", with_(EVENTS + _compare_sql(MIDDLE, BEFORE), ""))
def _(spark, folder):
    return _compared(event_report.kpi_compare(events(spark, folder), MIDDLE_DAYS))


@query("events_page_after_middle", with_(EVENTS, f"""
    SELECT {EVENT_SHOWN} FROM (
        SELECT * FROM ga_events WHERE {MIDDLE} ORDER BY event_datetime DESC, {", ".join(EVENT_TABLE_COLUMNS)}
        LIMIT 50 OFFSET 50)"""))
def _(spark, folder):
    rows = events(spark, folder)
    first = event_table.events_page_after(rows, MIDDLE_DAYS, size=50)
    cursor = Cursor.after([r.sort_values for r in first.collect()])
    return event_table.events_page_after(rows, MIDDLE_DAYS, cursor, size=50).drop("sort_values")


# ---- shards as a data source -----------------------------------------------------------------


@query("read_shards", with_(RAW, """
    SELECT table_suffix, event_name, count(*) AS cnt, count(DISTINCT user_pseudo_id) AS people, count(country) AS located
    FROM ga_raw WHERE table_suffix BETWEEN '20240105' AND '20240112' AND event_name <> 'view_item'
    GROUP BY table_suffix, event_name"""))
def _(spark, folder):
    stored = shared_folder(spark, "source")
    sink.write_parquet(sample.raw_events(spark, folder).drop("event_id"), stored, partition_by=("table_suffix",), rebalance=True)
    loaded = shared_folder(spark, "loaded")
    rows = shards.read_shards(spark, stored, RAW_EVENT_SCHEMA, "20240105", "20240112")
    sink.write_parquet(rows.where("event_name <> 'view_item'"), loaded)
    some = scan.read_table_path(spark, loaded, RAW_EVENT_SCHEMA)
    return some.groupBy("table_suffix", "event_name").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_distinct("user_pseudo_id").alias("people"), F.count("geo.country").alias("located"))
