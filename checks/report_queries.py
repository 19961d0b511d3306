"""Filters, joins, aggregations, windows, pages and the reports built from them."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.relations import (
    AUDIENCE,
    EVENT_SHOWN,
    EVENTS,
    NEWUSERS,
    PRODUCT_SHOWN,
    PRODUCTS,
    RECENT,
    SOLD,
    micros,
    with_,
)
from webmetrics.functions import predicates as pred
from webmetrics.functions.scalar import flag_not_null, iso_text, named
from webmetrics.operators import measures, newusers, ordering, semijoin
from webmetrics.plans import event_report, event_table, newuser_report, options, product_report
from webmetrics.schema import (
    DIRECT,
    EVENT_TABLE_COLUMNS,
    FUNNEL_STAGES,
    PERIOD_NAMES,
    PERIOD_OF_DAYS,
    PERIOD_UNKNOWN,
    PRODUCT_TABLE_COLUMNS,
    UNCATEGORISED,
    UNKNOWN_COUNTRY,
    UNKNOWN_DEVICE,
)
from webmetrics.sources import driver_tables as sample
from webmetrics.spec import FilterSpec

EVERYTHING = FilterSpec()
RECENT_DAYS = FilterSpec(start="2024-01-16", end="2024-01-30")
DIRECT_GOO = FilterSpec(mediums=("", "cpc"), keyword="goo")


def events(spark, folder):
    """All sample events: filters are the library's work, also those of dates."""
    return sample.events(spark, folder)


def products(spark, folder):
    return sample.products(spark, folder)


def _counted(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))


# ---- filters -------------------------------------------------------------------------------


@query("filter_medium", with_(EVENTS, """
    SELECT traffic_medium, count(*) AS cnt FROM ga_events
    WHERE coalesce(traffic_medium, '') IN ('', 'cpc') GROUP BY traffic_medium"""))
def _(spark, folder):
    return _counted(events(spark, folder).where(pred.f_medium("traffic_medium", ["", "cpc"])),
                    "traffic_medium")


@query("filter_country", with_(EVENTS, """
    SELECT country, event_name, count(*) AS cnt FROM ga_events
    WHERE country IN ('CHINA', 'JAPAN', 'FRANCE', 'NATION_3', 'NATION_4')
    GROUP BY country, event_name"""))
def _(spark, folder):
    wanted = ["CHINA", "JAPAN", "FRANCE", "NATION_3", "NATION_4"]
    return _counted(events(spark, folder).where(pred.f_in("country", wanted)),
                    "country", "event_name")


@query("filter_event_name", with_(EVENTS, """
    SELECT event_name, count(*) AS cnt FROM ga_events
    WHERE event_name IN ('purchase', 'user_engagement') GROUP BY event_name"""))
def _(spark, folder):
    return _counted(
        events(spark, folder).where(pred.f_in("event_name", ["purchase", "user_engagement"])),
        "event_name")


@query("filter_keyword", with_(EVENTS, """
    SELECT campaign_name, traffic_source, country, count(*) AS cnt FROM ga_events
    WHERE campaign_name ILIKE '%_GA%c%' OR traffic_source ILIKE '%_GA%c%'
       OR country ILIKE '%_GA%c%'
    GROUP BY ALL"""))
def _(spark, folder):
    return _counted(
        events(spark, folder).where(pred.f_keyword("  _GA%c ", *pred.KEYWORD_COLUMNS)),
        *pred.KEYWORD_COLUMNS)


@query("filter_dates", with_(EVENTS, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS cnt FROM ga_events
    WHERE {RECENT} GROUP BY event_date"""))
def _(spark, folder):
    rows = events(spark, folder)
    return _counted(rows.where(pred.f_date("event_date", RECENT_DAYS.start, RECENT_DAYS.end)),
                    "event_date")


@query("filter_events", with_(EVENTS, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date, {micros('event_datetime')} AS event_datetime,
           event_name, user_pseudo_id, traffic_medium, traffic_source
    FROM ga_events
    WHERE {AUDIENCE} AND {RECENT} AND event_name IN ('purchase', 'view_item')"""))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", event_names=("purchase", "view_item"),
                      start="2024-01-16", end="2024-01-30")
    return event_report.filtered(events(spark, folder), spec).select(
        "event_date", "event_datetime", "event_name", "user_pseudo_id", "traffic_medium",
        "traffic_source")


@query("filter_newusers", with_(NEWUSERS, f"""
    SELECT user_pseudo_id, CAST(first_visit_date AS VARCHAR) AS first_visit_date, did_purchase
    FROM ga_newusers
    WHERE {AUDIENCE} AND first_visit_date <= DATE '2024-01-15'"""))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", event_names=("ignored",),
                      categories=("ignored",), end="2024-01-15")
    return newuser_report.filtered(sample.newusers(spark, folder), spec).select(
        "user_pseudo_id", "first_visit_date", "did_purchase")


@query("filter_products", with_(SOLD, """
    SELECT item_name, count(*) AS cnt FROM ga_sold GROUP BY item_name"""))
def _(spark, folder):
    return _counted(products(spark, folder).where(pred.product_filter(EVERYTHING)), "item_name")


@query("filter_products_dates_categories", with_(SOLD, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date, item_category, count(*) AS cnt
    FROM ga_sold WHERE {RECENT} AND item_category IN ('SMALL', 'PROMO')
    GROUP BY event_date, item_category"""))
def _(spark, folder):
    spec = FilterSpec(categories=("SMALL", "PROMO"), start="2024-01-16", end="2024-01-30")
    return _counted(products(spark, folder).where(pred.product_filter(spec)),
                    "event_date", "item_category")


@query("filter_non_empty", with_(PRODUCTS, """
    SELECT DISTINCT item_category FROM ga_products
    WHERE item_category IS NOT NULL AND item_category <> ''"""))
def _(spark, folder):
    return products(spark, folder).select("item_category") \
        .where(pred.non_empty("item_category")).distinct()


@query("filter_groups", with_(NEWUSERS, """
    SELECT country, count(*) AS users FROM ga_newusers
    GROUP BY country HAVING count(*) >= 20"""))
def _(spark, folder):
    return sample.newusers(spark, folder).groupBy("country") \
        .agg(F.count(F.lit(1)).alias("users")).where("users >= 20")


# ---- joins ---------------------------------------------------------------------------------

_MATCHED = f"""EXISTS (
        SELECT 1 FROM ga_events e
        WHERE e.user_pseudo_id = s.user_pseudo_id AND e.event_datetime = s.event_datetime
          AND {AUDIENCE})"""


@query("semi_join", with_(SOLD, f"""
    SELECT user_pseudo_id, {micros('event_datetime')} AS event_datetime, item_id, item_quantity,
           round(item_total_revenue, 2) AS item_total_revenue
    FROM ga_sold s WHERE {_MATCHED}"""))
def _(spark, folder):
    rows = semijoin.filter_products_by_events(
        products(spark, folder), events(spark, folder), DIRECT_GOO)
    return rounded(rows.select("user_pseudo_id", "event_datetime", "item_id", "item_quantity",
                               "item_total_revenue"), item_total_revenue=2)


@query("semi_join_elided", with_(SOLD, f"""
    SELECT user_pseudo_id, {micros('event_datetime')} AS event_datetime, item_id, item_quantity
    FROM ga_sold"""))
def _(spark, folder):
    rows = semijoin.filter_products_by_events(products(spark, folder), None, EVERYTHING)
    return rows.select("user_pseudo_id", "event_datetime", "item_id", "item_quantity")


@query("left_join_purchases", with_(NEWUSERS, f"""
    SELECT f.user_pseudo_id, {micros('b.first_purchase_datetime')} AS first_purchase_datetime,
           round(b.purchase_revenue_total, 2) AS purchase_revenue_total, b.purchase_count
    FROM ga_first f LEFT JOIN ga_bought b USING (user_pseudo_id)"""))
def _(spark, folder):
    raw = sample.raw_events(spark, folder)
    first = newusers.first_event_per_user(raw, "first_visit", ["event_id"])
    joined = first.select("user_pseudo_id").join(
        newusers.purchase_rollup(raw), "user_pseudo_id", "left")
    return rounded(joined, purchase_revenue_total=2)


# ---- new-user table ------------------------------------------------------------------------


@query("first_event_per_user", with_(EVENTS, f"""
    SELECT DISTINCT ON (user_pseudo_id)
           user_pseudo_id, event_id, {micros('event_datetime')} AS event_datetime
    FROM ga_events WHERE event_name = 'view_item'
    ORDER BY user_pseudo_id, ga_events.event_datetime, event_id"""))
def _(spark, folder):
    return newusers.first_event_per_user(sample.raw_events(spark, folder), "view_item",
                                         ["event_id"]) \
        .select("user_pseudo_id", "event_id",
                F.timestamp_micros("event_timestamp").alias("event_datetime"))


@query("purchase_rollup", with_(NEWUSERS, f"""
    SELECT user_pseudo_id, {micros('first_purchase_datetime')} AS first_purchase_datetime,
           round(purchase_revenue_total, 2) AS purchase_revenue_total, purchase_count
    FROM ga_bought"""))
def _(spark, folder):
    return rounded(newusers.purchase_rollup(sample.raw_events(spark, folder)),
                   purchase_revenue_total=2)


@query("conversion_flag", with_(NEWUSERS, """
    SELECT (purchase_revenue_total IS NOT NULL) AS has_revenue, did_purchase, count(*) AS cnt
    FROM ga_newusers GROUP BY ALL"""))
def _(spark, folder):
    people = sample.newusers(spark, folder)
    return _counted(people, flag_not_null("purchase_revenue_total").alias("has_revenue"),
                    "did_purchase")


@query("build_new_users", with_(NEWUSERS, f"""
    SELECT user_pseudo_id, CAST(first_visit_date AS VARCHAR) AS first_visit_date,
           {micros('first_visit_datetime')} AS first_visit_datetime, country,
           region, city, continent, device_type, os, browser, device_language, mobile_brand,
           campaign_name, traffic_medium, traffic_source, did_purchase,
           {micros('first_purchase_datetime')} AS first_purchase_datetime,
           round(purchase_revenue_total, 2) AS purchase_revenue_total, purchase_count,
           CAST(days_to_first_purchase AS INTEGER) AS days_to_first_purchase
    FROM ga_newusers"""))
def _(spark, folder):
    return rounded(sample.newusers(spark, folder), purchase_revenue_total=2)


# ---- event report --------------------------------------------------------------------------


def _kpi_sql(where):
    return f"""SELECT count(*) AS events, count(DISTINCT user_pseudo_id) AS users,
           round(coalesce(sum(total_purchase_revenue), 0), 2) AS revenue,
           count(DISTINCT transaction_id) AS transactions
    FROM ga_events WHERE {where}"""


@query("kpi", with_(EVENTS, _kpi_sql(RECENT)))
def _(spark, folder):
    return rounded(event_report.kpi(events(spark, folder), RECENT_DAYS), revenue=2)


@query("kpi_filtered", with_(EVENTS, _kpi_sql(AUDIENCE)))
def _(spark, folder):
    return rounded(event_report.kpi(events(spark, folder), DIRECT_GOO), revenue=2)


def _compare_sql(where, previous):
    pairs = "\n    UNION ALL ".join(
        f"SELECT '{k}' AS kpi, c.{k}::DOUBLE AS current, p.{k}::DOUBLE AS previous, "
        f"p.events AS before FROM ga_cur c, ga_prev p"
        for k in ("events", "users", "revenue", "transactions"))
    return f""", ga_cur AS ({_kpi_sql(where)}), ga_prev AS ({_kpi_sql(previous)}),
ga_pairs AS ({pairs})
    SELECT kpi, round(current, 2) AS current, round(previous, 2) AS previous,
           round((current - previous) / nullif(previous, 0) * 100, 4) AS pct,
           (current - previous) / nullif(previous, 0) >= 0 AS up,
           CASE WHEN before > 0 THEN 'has_previous' ELSE 'out_of_range' END AS status
    FROM ga_pairs"""


def _compared(df):
    return rounded(df, current=2, previous=2, pct=4)


@query("kpi_compare", with_(EVENTS + _compare_sql(
    RECENT, "event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"), ""))
def _(spark, folder):
    return _compared(event_report.kpi_compare(events(spark, folder), RECENT_DAYS))


@query("kpi_compare_no_previous", with_(EVENTS + _compare_sql(
    f"event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' AND {AUDIENCE}",
    f"event_date BETWEEN DATE '2023-12-17' AND DATE '2023-12-31' AND {AUDIENCE}"), ""))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-01", end="2024-01-15")
    return _compared(event_report.kpi_compare(events(spark, folder), spec))


_SPANS = """ga_spans AS (
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_day,
           CASE WHEN o_orderkey % 50 <> 0
                THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS end_day
    FROM orders)"""


def _spans(spark, folder):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return sample.table(spark, folder, "orders").select(
        "o_orderkey", day.alias("start_day"),
        F.when(key % 50 != 0, F.date_add(day, (key % 400).cast("int"))).alias("end_day"))


@query("previous_period", with_(_SPANS, """
    SELECT o_orderkey,
           CAST(start_day - 1 - CAST(end_day - start_day AS INTEGER) AS VARCHAR) AS previous_start,
           CASE WHEN end_day IS NOT NULL THEN CAST(start_day - 1 AS VARCHAR) END AS previous_end
    FROM ga_spans"""))
def _(spark, folder):
    first, last = event_report.previous_period("start_day", "end_day")
    return _spans(spark, folder).select(
        "o_orderkey", iso_text(first).alias("previous_start"),
        iso_text(last).alias("previous_end"))


_LENGTH = "end_day - start_day + 1"


@query("period_label", with_(_SPANS, f"""
    SELECT o_orderkey, CASE WHEN end_day IS NULL THEN '{PERIOD_UNKNOWN}' {" ".join(
        f"WHEN {_LENGTH} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in PERIOD_NAMES)}
        ELSE replace('{PERIOD_OF_DAYS}', '{{}}', CAST({_LENGTH} AS VARCHAR)) END AS label
    FROM ga_spans"""))
def _(spark, folder):
    return _spans(spark, folder).select(
        "o_orderkey", event_report.period_label("start_day", "end_day").alias("label"))


def _trend_sql(where):
    return f"""
    SELECT CAST(day AS VARCHAR) AS day, events, round(revenue, 2) AS revenue,
           round(avg(events) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
               AS ma7
    FROM (SELECT event_date AS day, count(*) AS events,
                 coalesce(sum(total_purchase_revenue), 0) AS revenue
          FROM ga_events WHERE {where} GROUP BY event_date)"""


@query("daily_trend", with_(EVENTS, _trend_sql(RECENT)))
def _(spark, folder):
    return rounded(event_report.daily_trend(events(spark, folder), RECENT_DAYS),
                   revenue=2)


@query("daily_trend_by_country", with_(EVENTS, """
    SELECT country, CAST(day AS VARCHAR) AS day, events, round(revenue, 2) AS revenue,
           round(avg(events) OVER (PARTITION BY country ORDER BY day
                                   ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
    FROM (SELECT country, event_date AS day, count(*) AS events,
                 coalesce(sum(total_purchase_revenue), 0) AS revenue
          FROM ga_events GROUP BY country, event_date)"""))
def _(spark, folder):
    return rounded(event_report.daily_trend(events(spark, folder), EVERYTHING, by=["country"]),
                   revenue=2)


@query("moving_average", """
    SELECT status, CAST(day AS VARCHAR) AS day, orders,
           round(avg(orders) OVER (PARTITION BY status ORDER BY day
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma3
    FROM (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS orders
          FROM orders GROUP BY ALL)""")
def _(spark, folder):
    daily = sample.table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count(F.lit(1)).alias("orders"))
    return rounded(measures.with_moving_average(daily, 3, "day", "orders", "ma3", ["status"]))


def _share_sql(relation, key, name, where="TRUE"):
    return f"""
    SELECT {name}, cnt, round(cnt / sum(cnt) OVER (), 6) AS share
    FROM (SELECT {key} AS {name}, count(*) AS cnt FROM {relation} WHERE {where} GROUP BY 1)"""


@query("device_share", with_(EVENTS, _share_sql(
    "ga_events", "coalesce(device_type, 'unknown')", "device", RECENT)))
def _(spark, folder):
    return rounded(event_report.device_share(events(spark, folder), RECENT_DAYS))


@query("event_composition", with_(EVENTS, f"""
    SELECT event_name AS name, count(*) AS cnt FROM ga_events WHERE {RECENT} GROUP BY 1"""))
def _(spark, folder):
    return event_report.event_composition(events(spark, folder), RECENT_DAYS)


@query("stage_flags", with_(EVENTS, "SELECT user_pseudo_id, " + ", ".join(
    f"CAST(bool_or(event_name = '{stage}') AS INTEGER) AS {stage}" for stage in FUNNEL_STAGES
) + " FROM ga_events GROUP BY user_pseudo_id"))
def _(spark, folder):
    return measures.stage_flags(events(spark, folder), FUNNEL_STAGES)


def _funnel_sql(where):
    steps = ", ".join(
        f"count(*) FILTER (WHERE list_has_all(done, {list(FUNNEL_STAGES[:i + 1])})) AS {stage}"
        for i, stage in enumerate(FUNNEL_STAGES))
    return f""",
ga_people AS (
    SELECT user_pseudo_id, list(DISTINCT event_name) AS done
    FROM ga_events WHERE {where} GROUP BY user_pseudo_id),
ga_funnel AS (SELECT {steps} FROM ga_people)"""


_FUNNEL = _funnel_sql(RECENT)


@query("funnel", with_(EVENTS + _FUNNEL, "SELECT * FROM ga_funnel"))
def _(spark, folder):
    spec = FilterSpec(event_names=("purchase",), start="2024-01-16", end="2024-01-30")
    return event_report.funnel(events(spark, folder), spec)


def _rate(part, whole):
    return f"round(CASE WHEN {whole} = 0 THEN 0.0 ELSE {part} / {whole} * 100 END, 6)"


def _stage_sql(i):
    stage, first, last = FUNNEL_STAGES[i], FUNNEL_STAGES[0], FUNNEL_STAGES[-1]
    step = _rate(stage, FUNNEL_STAGES[i - 1]) if i else "CAST(NULL AS DOUBLE)"
    return (f"SELECT {i + 1} AS position, '{stage}' AS stage, {stage} AS users, "
            f"{_rate(stage, first)} AS pct_initial, {step} AS step_rate, "
            f"{_rate(last, first)} AS overall_rate FROM ga_funnel")


@query("funnel_rates", with_(EVENTS + _FUNNEL, "\n    UNION ALL ".join(
    _stage_sql(i) for i in range(len(FUNNEL_STAGES)))))
def _(spark, folder):
    counts = event_report.funnel(events(spark, folder), RECENT_DAYS)
    return rounded(event_report.funnel_rates(counts))


@query("matched_rows", with_(EVENTS, f"""
    SELECT count(*) AS matched FROM ga_events WHERE {AUDIENCE}"""))
def _(spark, folder):
    rows, seen = event_report.matched_rows(events(spark, folder), DIRECT_GOO)
    rows.write.format("noop").mode("overwrite").save()  # the report's own action; the count comes with it
    return spark.createDataFrame([(seen.rows,)], "matched BIGINT")


# ---- product report ------------------------------------------------------------------------


def _leading_sql(relation, label, amount, names, n, where="TRUE"):
    """The n labels with the largest positive totals: totals first, then their places."""
    key, total = names
    return f""",
ga_amounts AS (SELECT {label} AS label, {amount} AS amount FROM {relation} WHERE {where}),
ga_totals AS (SELECT label, sum(amount) AS total FROM ga_amounts GROUP BY label),
ga_places AS (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS place
              FROM ga_totals WHERE total > 0)
SELECT label AS {key}, {total} FROM ga_places WHERE place <= {n}"""


def _text_or(column, other):
    return f"CASE WHEN length({column}) > 0 THEN {column} ELSE {other} END"


def _category_sql(where="TRUE"):
    return _leading_sql("ga_sold s", _text_or("s.item_category", f"'{UNCATEGORISED}'"), "s.item_total_revenue",
                        ("category", "round(total, 2) AS revenue"), 5, where)


def _items_sql(where="TRUE"):
    return _leading_sql("ga_sold s", _text_or("s.item_name", "s.item_id"), "s.item_quantity",
                        ("item", "CAST(total AS BIGINT) AS qty"), 10, where)


@query("category_revenue", with_(SOLD, _category_sql(_MATCHED)))
def _(spark, folder):
    return rounded(product_report.category_revenue(
        products(spark, folder), events(spark, folder), DIRECT_GOO), revenue=2)


@query("category_revenue_dated", with_(SOLD, _category_sql(f"{_MATCHED} AND {RECENT}")))
def _(spark, folder):
    spec = FilterSpec(mediums=("", "cpc"), keyword="goo", start="2024-01-16", end="2024-01-30")
    return rounded(product_report.category_revenue(
        products(spark, folder), events(spark, folder), spec), revenue=2)


@query("category_revenue_all", with_(SOLD, _category_sql()))
def _(spark, folder):
    return rounded(product_report.category_revenue(
        products(spark, folder), None, EVERYTHING), revenue=2)


@query("top_items", with_(SOLD, _items_sql(_MATCHED)))
def _(spark, folder):
    return product_report.top_items(products(spark, folder), events(spark, folder), DIRECT_GOO)


@query("top_items_all", with_(SOLD, _items_sql()))
def _(spark, folder):
    return product_report.top_items(products(spark, folder), None, EVERYTHING)


@query("product_total", with_(SOLD, f"SELECT count(*) AS total FROM ga_sold s WHERE {_MATCHED}"))
def _(spark, folder):
    return product_report.product_total(products(spark, folder), events(spark, folder),
                                        DIRECT_GOO)


def _page_sql(shown, relation, where, order, size, offset):
    return f"""
    SELECT {shown}, CAST((SELECT greatest(1, ceil(count(*) / {size})) FROM {relation} WHERE {where})
                         AS INTEGER) AS page_count
    FROM (SELECT * FROM {relation} WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {offset})"""


def _products_page_sql(where, offset):
    order = "event_datetime DESC, " + ", ".join(PRODUCT_TABLE_COLUMNS)
    return _page_sql(PRODUCT_SHOWN, "ga_sold s", where, order, 20, offset)


@query("products_page", with_(SOLD, _products_page_sql(_MATCHED, 40)))
def _(spark, folder):
    return product_report.products_page(products(spark, folder), events(spark, folder),
                                        DIRECT_GOO, 2)


@query("products_page_all", with_(SOLD, _products_page_sql("TRUE", 0)))
def _(spark, folder):
    return product_report.products_page(products(spark, folder), None, EVERYTHING)


@query("products_page_after", with_(SOLD, f"""
    SELECT {PRODUCT_SHOWN} FROM (
        SELECT * FROM ga_sold s WHERE {_MATCHED}
        ORDER BY event_datetime DESC, {", ".join(PRODUCT_TABLE_COLUMNS)} LIMIT 30 OFFSET 30)"""))
def _(spark, folder):
    bought, all_events = products(spark, folder), events(spark, folder)
    first = product_report.products_page_after(bought, all_events, DIRECT_GOO, size=30)
    cursor = ordering.Cursor.after([r.sort_values for r in first.collect()])  # one page
    following = product_report.products_page_after(bought, all_events, DIRECT_GOO, cursor, 30)
    return following.drop("sort_values")


# ---- new-user report -----------------------------------------------------------------------

_VISITED = "first_visit_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"
VISITED = FilterSpec(start="2024-01-03", end="2024-01-25")


def _stats_sql(where):
    return f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE did_purchase) AS converted,
           round(coalesce(count(*) FILTER (WHERE did_purchase) * 100.0 / nullif(count(*), 0), 0), 6)
               AS rate,
           round(avg(CASE WHEN did_purchase AND days_to_first_purchase >= 0
                          THEN days_to_first_purchase END), 6) AS avg_days
    FROM ga_newusers WHERE {where}"""


@query("newuser_stats", with_(NEWUSERS, _stats_sql(_VISITED)))
def _(spark, folder):
    return rounded(newuser_report.newuser_stats(sample.newusers(spark, folder), VISITED))


@query("newuser_trend", with_(NEWUSERS, f"""
    SELECT CAST(first_visit_date AS VARCHAR) AS day, count(*) AS new_users,
           count(*) FILTER (WHERE did_purchase) AS converted
    FROM ga_newusers WHERE {_VISITED} GROUP BY first_visit_date"""))
def _(spark, folder):
    return newuser_report.newuser_trend(sample.newusers(spark, folder), VISITED)


@query("newuser_device", with_(NEWUSERS, _share_sql(
    "ga_newusers", "coalesce(device_type, 'unknown')", "device", _VISITED)))
def _(spark, folder):
    return rounded(newuser_report.newuser_device(sample.newusers(spark, folder), VISITED))


@query("newuser_country", with_(NEWUSERS, _leading_sql(
    "ga_newusers", _text_or("country", f"'{UNKNOWN_COUNTRY}'"), "1",
    ("country", "CAST(total AS BIGINT) AS cnt"), 10, _VISITED)))
def _(spark, folder):
    return newuser_report.newuser_country(sample.newusers(spark, folder), VISITED)


@query("newuser_medium", with_(NEWUSERS, _share_sql(
    "ga_newusers", "coalesce(nullif(traffic_medium, ''), '(direct)')", "medium", _VISITED)))
def _(spark, folder):
    return rounded(newuser_report.newuser_medium(sample.newusers(spark, folder), VISITED))


def _conversion_sql(where):
    return f""",
ga_visitors AS (
    SELECT {_text_or("traffic_medium", f"'{DIRECT}'")} AS medium, user_pseudo_id,
           CASE WHEN did_purchase THEN user_pseudo_id END AS buyer
    FROM ga_newusers WHERE {where}),
ga_media AS (
    SELECT medium, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT buyer) AS buyers
    FROM ga_visitors GROUP BY medium)
SELECT medium, users, buyers, round(buyers * 100.0 / users, 6) AS rate
FROM ga_media WHERE users > 19"""


@query("newuser_conversion", with_(NEWUSERS, _conversion_sql(_VISITED)))
def _(spark, folder):
    return rounded(newuser_report.newuser_conversion(sample.newusers(spark, folder), VISITED))


# ---- the same reports over everything --------------------------------------------------------


@query("kpi_all", with_(EVENTS, _kpi_sql("TRUE")))
def _(spark, folder):
    return rounded(event_report.kpi(events(spark, folder), EVERYTHING), revenue=2)


@query("daily_trend_all", with_(EVENTS, _trend_sql("TRUE")))
def _(spark, folder):
    return rounded(event_report.daily_trend(events(spark, folder), EVERYTHING), revenue=2)


@query("device_share_all", with_(EVENTS, _share_sql(
    "ga_events", _text_or("device_type", f"'{UNKNOWN_DEVICE}'"), "device")))
def _(spark, folder):
    return rounded(event_report.device_share(events(spark, folder), EVERYTHING))


@query("event_composition_all", with_(EVENTS, """
    SELECT event_name AS name, count(*) AS cnt FROM ga_events GROUP BY 1"""))
def _(spark, folder):
    return event_report.event_composition(events(spark, folder), EVERYTHING)


@query("funnel_all", with_(EVENTS + _funnel_sql("TRUE"), "SELECT * FROM ga_funnel"))
def _(spark, folder):
    return event_report.funnel(events(spark, folder), EVERYTHING)


@query("newuser_stats_all", with_(NEWUSERS, _stats_sql("TRUE")))
def _(spark, folder):
    return rounded(newuser_report.newuser_stats(sample.newusers(spark, folder), EVERYTHING))


@query("newuser_conversion_all", with_(NEWUSERS, _conversion_sql("TRUE")))
def _(spark, folder):
    return rounded(newuser_report.newuser_conversion(sample.newusers(spark, folder), EVERYTHING))


# ---- event table ---------------------------------------------------------------------------


def _events_page_sql(order, where, size, offset):
    order = ", ".join([order, *EVENT_TABLE_COLUMNS])
    return _page_sql(EVENT_SHOWN, "ga_events", where, order, size, offset)


@query("events_page", with_(EVENTS, _events_page_sql("event_datetime DESC", RECENT, 20, 20)))
def _(spark, folder):
    return event_table.events_page(events(spark, folder), RECENT_DAYS, None, 1)


@query("events_page_sorted", with_(EVENTS, _events_page_sql(
    "coalesce(nullif(traffic_medium, ''), '(direct)') ASC, "
    "strftime(event_datetime, '%H:%M:%S') DESC", AUDIENCE, 50, 100)))
def _(spark, folder):
    asked = [{"column_id": "traffic_medium", "direction": "asc"},
             {"column_id": "event_id", "direction": "asc"},
             {"column_id": "event_datetime", "direction": "desc"}]
    return event_table.events_page(events(spark, folder), DIRECT_GOO, asked, 2, 50)


@query("events_page_after", with_(EVENTS, f"""
    SELECT CAST(event_date AS VARCHAR) AS event_date,
           strftime(event_datetime, '%H:%M:%S') AS event_datetime, event_name,
           coalesce(transaction_id, '-') AS transaction_id
    FROM ga_events e WHERE {RECENT}
    ORDER BY e.event_datetime DESC, e.event_name LIMIT 50 OFFSET 50"""))
def _(spark, folder):
    rows = events(spark, folder)
    first = event_table.events_page_after(rows, RECENT_DAYS, size=50)
    cursor = ordering.Cursor.after([r.sort_values for r in first.collect()])
    following = event_table.events_page_after(rows, RECENT_DAYS, cursor, size=50)
    return following.select("event_date", "event_datetime", "event_name", "transaction_id")


@query("top_k", """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders
    GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10""")
def _(spark, folder):
    spent = sample.table(spark, folder, "orders").groupBy("o_custkey") \
        .agg(F.sum("o_totalprice").alias("spent"))
    return rounded(ordering.top_k(spent, [F.desc("spent"), F.asc("o_custkey")], 10), spent=2)


@query("page_count", with_(EVENTS, """
    SELECT country, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS INTEGER) AS pages
    FROM ga_events GROUP BY country"""))
def _(spark, folder):
    totals = events(spark, folder).groupBy("country").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("pages", ordering.page_count(F.col("total")))


# ---- options -------------------------------------------------------------------------------

_COUNTRY_OPTIONS = """SELECT country AS value, count(*) AS cnt FROM ga_events
    WHERE country IS NOT NULL GROUP BY country"""
_NAME_OPTIONS = "SELECT event_name AS value, count(*) AS cnt FROM ga_events GROUP BY event_name"
_CATEGORY_OPTIONS = """SELECT item_category AS value, count(*) AS cnt FROM ga_products
    WHERE event_name = 'purchase' AND item_category IS NOT NULL AND item_category <> ''
    GROUP BY item_category"""
_MEDIUM_OPTIONS = r"""SELECT coalesce(traffic_medium, '') AS value,
           CASE WHEN regexp_matches(traffic_medium, '\S') THEN traffic_medium
                ELSE '(direct)' END AS label
    FROM (SELECT DISTINCT traffic_medium FROM ga_events)"""
_BOUNDS = """SELECT min(event_date) AS min_date, max(event_date) AS max_date,
           greatest(min(event_date), max(event_date) - 29) AS default_start,
           max(event_date) AS default_end FROM ga_events"""


@query("country_options", with_(EVENTS, _COUNTRY_OPTIONS))
def _(spark, folder):
    return options.country_options(events(spark, folder))


@query("event_name_options", with_(EVENTS, _NAME_OPTIONS))
def _(spark, folder):
    return options.event_name_options(events(spark, folder))


@query("category_options", with_(PRODUCTS, _CATEGORY_OPTIONS))
def _(spark, folder):
    return options.category_options(products(spark, folder))


@query("medium_options", with_(EVENTS, _MEDIUM_OPTIONS))
def _(spark, folder):
    return measures.medium_options(events(spark, folder))


@query("date_bounds", with_(EVENTS, f"""
    SELECT CAST(min_date AS VARCHAR) AS min_date, CAST(max_date AS VARCHAR) AS max_date,
           CAST(default_start AS VARCHAR) AS default_start,
           CAST(default_end AS VARCHAR) AS default_end
    FROM ({_BOUNDS})"""))
def _(spark, folder):
    return measures.date_bounds(events(spark, folder))


@query("count_rows", with_(EVENTS, "SELECT count(*) AS row_count FROM ga_events"))
def _(spark, folder):
    return measures.count_rows(events(spark, folder))


@query("filter_options", with_(PRODUCTS, f"""
    SELECT 'country' AS field, value, value AS label, cnt FROM ({_COUNTRY_OPTIONS})
    UNION ALL SELECT 'event_name', value, value, cnt FROM ({_NAME_OPTIONS})
    UNION ALL SELECT 'category', value, value, cnt FROM ({_CATEGORY_OPTIONS})
    UNION ALL SELECT 'medium', value, label, NULL FROM ({_MEDIUM_OPTIONS})
    UNION ALL SELECT 'min_date', CAST(min_date AS VARCHAR), CAST(min_date AS VARCHAR), NULL
              FROM ({_BOUNDS})
    UNION ALL SELECT 'max_date', CAST(max_date AS VARCHAR), CAST(max_date AS VARCHAR), NULL
              FROM ({_BOUNDS})
    UNION ALL SELECT 'default_start', CAST(default_start AS VARCHAR),
              CAST(default_start AS VARCHAR), NULL FROM ({_BOUNDS})
    UNION ALL SELECT 'default_end', CAST(default_end AS VARCHAR), CAST(default_end AS VARCHAR),
              NULL FROM ({_BOUNDS})"""))
def _(spark, folder):
    return options.filter_options(events(spark, folder), products(spark, folder))


# ---- projection of a trend -----------------------------------------------------------------


@query("linear_projection", with_(EVENTS, """
    SELECT country, round(regr_slope(events, day), 6) AS slope,
           round(regr_intercept(events, day), 4) AS intercept,
           round(regr_intercept(events, day) + regr_slope(events, day) * 60, 4) AS projected
    FROM (SELECT country, date_diff('day', DATE '2024-01-01', event_date) AS day,
                 count(*) AS events
          FROM ga_events GROUP BY ALL)
    GROUP BY country"""))
def _(spark, folder):
    daily = events(spark, folder).groupBy(
        "country", F.datediff("event_date", F.lit("2024-01-01").cast("date")).alias("day")
    ).agg(F.count(F.lit(1)).alias("events"))
    return rounded(measures.linear_projection(daily, "day", "events", 60, ["country"]),
                   intercept=4, projected=4)


@query("named_items", with_(PRODUCTS, """
    SELECT coalesce(nullif(item_name, ''), item_id) AS item, count(*) AS cnt
    FROM ga_products GROUP BY 1"""))
def _(spark, folder):
    return _counted(products(spark, folder), named("item_name", F.col("item_id")).alias("item"))
