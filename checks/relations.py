"""SQL for the sample records: the rules of FIXTURES.md as common table expressions."""


def _numbered(key: str, *columns: tuple[str, str, int]) -> str:
    """Texts that the records number: (column, field of the record, numbers below)."""
    return ",\n           ".join(
        f"CASE WHEN {key} % 8 <> 0 THEN concat('{field}_', {key} % {below}) END AS {column}"
        for column, field, below in columns)


_EVENT_EXTRA = _numbered(
    "s.item_key", ("region", "region", 5), ("city", "city", 12), ("sub_continent", "sub_continent", 4),
    ("metro_area", "metro", 9), ("os", "operating_system", 3), ("os_version", "operating_system_version", 6),
    ("browser", "browser", 3), ("browser_version", "browser_version", 7), ("device_language", "language", 5),
    ("mobile_brand", "mobile_brand_name", 4), ("mobile_model", "mobile_model_name", 10))
_ITEM_EXTRA = _numbered(
    "p.p_partkey", ("item_variant", "item_variant", 6), ("item_category2", "item_category2", 5),
    ("item_category3", "item_category3", 4), ("item_category4", "item_category4", 3),
    ("item_category5", "item_category5", 2), ("item_coupon_code", "coupon", 7),
    ("store_affiliation", "affiliation", 9), ("location_id", "location_id", 11))
_EXTRA = ("region, city, sub_continent, metro_area, os, os_version, browser, browser_version, device_language, "
          "mobile_brand, mobile_model, event_value_in_usd, event_previous_timestamp, user_first_touch_timestamp, "
          "total_items_count, unique_items_count")

# One row per event of the stream and per twin.
_STREAM = """
ga_stream AS (
    SELECT event_id, event_id AS item_key, FALSE AS twin, ts, user_id, event_type, value
    FROM events
    UNION ALL
    SELECT event_id + 1000000000, event_id, TRUE, ts, user_id, event_type, value
    FROM events WHERE event_id % 3 = 0
)"""

RAW = _STREAM + f""",
ga_raw AS (
    SELECT s.event_id, s.item_key, s.twin,
           strftime(s.ts, '%Y%m%d') AS table_suffix,
           strftime(s.ts, '%Y%m%d') AS event_date,
           epoch_us(s.ts) AS event_timestamp,
           CASE WHEN s.twin THEN 'user_engagement'
                ELSE CASE s.event_type WHEN 'signup' THEN 'first_visit' WHEN 'view' THEN 'view_item'
                     WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'begin_checkout'
                     WHEN 'purchase' THEN 'purchase' END END AS event_name,
           concat(s.user_id, '.', s.item_key % 20) AS user_pseudo_id,
           CASE WHEN s.item_key % 11 <> 0 THEN n.n_name END AS country,
           CASE WHEN s.item_key % 11 <> 0 THEN r.r_name END AS continent,
           CASE WHEN s.item_key % 7 = 0 THEN NULL WHEN s.item_key % 7 = 1 THEN 'tablet'
                WHEN s.item_key % 7 IN (2, 3) THEN 'mobile' ELSE 'desktop' END AS device_type,
           CASE s.user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'cpc'
                WHEN 3 THEN 'referral' ELSE 'organic' END AS traffic_medium,
           CASE s.user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Google'
                ELSE 'shop.example' END AS traffic_source,
           CASE s.user_id % 4 WHEN 0 THEN '(organic)' WHEN 1 THEN '(referral)' WHEN 2 THEN ''
                ELSE NULL END AS campaign_name,
           CASE WHEN NOT s.twin AND s.event_type = 'purchase' THEN
                CASE WHEN s.item_key % 13 = 0 THEN '(not set)'
                     ELSE CAST(s.item_key % 5000 AS VARCHAR) END END AS transaction_id,
           CASE WHEN NOT s.twin AND s.event_type = 'purchase' THEN s.value END
               AS total_purchase_revenue,
           {_EVENT_EXTRA},
           s.value / 2 AS event_value_in_usd,
           epoch_us(s.ts) - 1000000 * (s.item_key % 60) AS event_previous_timestamp,
           epoch_us(s.ts) - 86400000000 * (s.user_id % 30) AS user_first_touch_timestamp,
           s.item_key % 9 AS total_items_count, s.item_key % 4 AS unique_items_count
    FROM ga_stream s
    LEFT JOIN nation n ON n.n_nationkey = s.user_id % 25
    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)"""

EVENTS = RAW + f""",
ga_events AS (
    SELECT event_id, item_key, twin, table_suffix,
           CAST(strptime(event_date, '%Y%m%d') AS DATE) AS event_date,
           make_timestamp(event_timestamp) AS event_datetime,
           event_name, user_pseudo_id, country, continent, device_type, traffic_medium,
           traffic_source, campaign_name, transaction_id, total_purchase_revenue, {_EXTRA}
    FROM ga_raw
)"""

PRODUCTS = EVENTS + f""",
ga_products AS (
    SELECT e.event_date, e.user_pseudo_id, e.event_datetime, e.event_name,
           CAST(p.p_partkey AS VARCHAR) AS item_id,
           CASE WHEN p.p_partkey % 17 = 0 THEN '(not set)' WHEN p.p_partkey % 19 = 0 THEN ''
                WHEN p.p_partkey % 23 = 0 THEN NULL ELSE p.p_name END AS item_name,
           p.p_brand AS item_brand,
           CASE WHEN p.p_partkey % 29 = 0 THEN '' ELSE p.p_type END AS item_category,
           p.p_retailprice AS item_price,
           CAST(l.l_quantity AS BIGINT) AS item_quantity,
           p.p_retailprice * CAST(l.l_quantity AS BIGINT) AS item_total_revenue,
           l.l_extendedprice AS item_reported_revenue, p.p_size / 2 AS item_refund_amount,
           {_ITEM_EXTRA}, l.l_linenumber AS line
    FROM ga_events e
    JOIN lineitem l ON l.l_orderkey = e.event_id AND NOT e.twin
    JOIN part p ON p.p_partkey = l.l_partkey
)"""

# Product rows that count as sold, before any choice of dates, categories or audience.
SOLD = PRODUCTS + """,
ga_sold AS (
    SELECT * FROM ga_products
    WHERE event_name = 'purchase' AND item_name IS NOT NULL
      AND item_name NOT IN ('', '(not set)')
)"""

NEWUSERS = EVENTS + """,
ga_first AS (
    SELECT DISTINCT ON (user_pseudo_id) * FROM ga_events WHERE event_name = 'first_visit'
    ORDER BY user_pseudo_id, event_datetime, event_id
),
ga_bought AS (
    SELECT user_pseudo_id, min(event_datetime) AS first_purchase_datetime,
           sum(total_purchase_revenue) AS purchase_revenue_total,
           count(DISTINCT transaction_id) AS purchase_count
    FROM ga_events WHERE event_name = 'purchase' GROUP BY user_pseudo_id
),
ga_newusers AS (
    SELECT f.user_pseudo_id, f.event_date AS first_visit_date,
           f.event_datetime AS first_visit_datetime, f.country, f.continent, f.device_type,
           f.campaign_name, f.traffic_medium, f.traffic_source,
           f.region, f.city, f.os, f.browser, f.device_language, f.mobile_brand,
           (b.user_pseudo_id IS NOT NULL) AS did_purchase,
           b.first_purchase_datetime, b.purchase_revenue_total,
           coalesce(b.purchase_count, 0) AS purchase_count,
           date_diff('day', f.event_date, CAST(b.first_purchase_datetime AS DATE))
               AS days_to_first_purchase
    FROM ga_first f LEFT JOIN ga_bought b USING (user_pseudo_id)
)"""

# The audience most checks use: direct or paid traffic, keyword 'goo'.
AUDIENCE = """(traffic_medium IN ('', 'cpc') OR traffic_medium IS NULL)
      AND (campaign_name ILIKE '%goo%' OR traffic_source ILIKE '%goo%' OR country ILIKE '%goo%')"""
RECENT = "event_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'"


def draw(stream: int, seed: int = 42) -> str:
    """The residue that stream gives for ``purchase_id``: three rounds of BIGINT arithmetic."""
    p = 2147483647
    x = f"((purchase_id * 48271 + {seed * 69621 + stream * 1299709}) % {p})"
    for step in (7919, 104729):
        x = f"(({x} * {x} + {x} * {step} + {stream}) % {p})"
    return x


def with_(relations: str, select: str) -> str:
    return f"WITH {relations.strip()}\n{select.strip()}"


def shown(c: str, text: str, blank: bool = False) -> str:
    """A column with a text in place of NULL and, if asked, of the empty text."""
    missing = f"{c} IS NULL" + (f" OR {c} = ''" if blank else "")
    return f"CASE WHEN {missing} THEN {text} ELSE {c} END AS {c}"


def cents(c: str) -> str:
    return f"round(CASE WHEN {c} IS NULL THEN 0 ELSE {c} END, 2) AS {c}"


EVENT_SHOWN = ", ".join([
    "CAST(event_date AS VARCHAR) AS event_date",
    "strftime(event_datetime, '%H:%M:%S') AS event_datetime", "event_name",
    shown("country", "'-'"), shown("device_type", "'-'"),
    shown("traffic_medium", "'(direct)'", True), shown("traffic_source", "'-'", True),
    shown("campaign_name", "'-'", True), shown("transaction_id", "'-'"),
    cents("total_purchase_revenue"),
])
PRODUCT_SHOWN = ", ".join([
    "CAST(event_date AS VARCHAR) AS event_date", "event_name", shown("item_id", "'-'"),
    shown("item_name", "item_id", True), shown("item_brand", "'-'"),
    shown("item_category", "'(未分類)'", True), cents("item_price"),
    shown("item_quantity", "0"), cents("item_total_revenue"),
])


def micros(c: str) -> str:
    """A timestamp as text with six decimals."""
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
