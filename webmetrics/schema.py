"""Column contracts: the nested input record, the three flat tables, the benchmark table."""

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
)


def record(default: DataType, **fields: DataType | None) -> StructType:
    """A struct type; fields given as None have the default type."""
    struct = StructType()
    for name, dtype in fields.items():
        struct.add(name, dtype or default)
    return struct


TEXT, LONG, REAL = StringType(), LongType(), DoubleType()

# --- fixed values: field names and types that results must agree on -----------------------

# One raw record. ``table_suffix`` is the day partition and stays text ('20210101').
RAW_EVENT_SCHEMA = record(
    TEXT,
    event_date=TEXT,
    event_timestamp=LONG,
    event_name=TEXT,
    event_previous_timestamp=LONG,
    event_value_in_usd=REAL,
    user_pseudo_id=TEXT,
    user_first_touch_timestamp=LONG,
    geo=record(TEXT, country=None, region=None, city=None, sub_continent=None,
               continent=None, metro=None),
    device=record(TEXT, category=None, operating_system=None, operating_system_version=None,
                  language=None, mobile_brand_name=None, mobile_model_name=None,
                  web_info=record(TEXT, browser=None, browser_version=None)),
    traffic_source=record(TEXT, name=None, medium=None, source=None),
    ecommerce=record(TEXT, total_item_quantity=LONG, purchase_revenue_in_usd=REAL,
                     transaction_id=None, unique_items=LONG),
    items=ArrayType(record(
        TEXT, item_id=None, item_name=None, item_brand=None, item_variant=None,
        item_category=None, item_category2=None, item_category3=None, item_category4=None,
        item_category5=None, price=REAL, quantity=LONG, item_revenue=REAL, item_refund=REAL,
        coupon=None, affiliation=None, location_id=None)),
    table_suffix=TEXT,
)

# Nested path behind every renamed column of the flat event table.
EVENT_PATHS = {
    "country": "geo.country",
    "region": "geo.region",
    "city": "geo.city",
    "sub_continent": "geo.sub_continent",
    "continent": "geo.continent",
    "metro_area": "geo.metro",
    "device_type": "device.category",
    "os": "device.operating_system",
    "os_version": "device.operating_system_version",
    "browser": "device.web_info.browser",
    "browser_version": "device.web_info.browser_version",
    "device_language": "device.language",
    "mobile_brand": "device.mobile_brand_name",
    "mobile_model": "device.mobile_model_name",
    "campaign_name": "traffic_source.name",
    "traffic_medium": "traffic_source.medium",
    "traffic_source": "traffic_source.source",
    "total_items_count": "ecommerce.total_item_quantity",
    "total_purchase_revenue": "ecommerce.purchase_revenue_in_usd",
    "transaction_id": "ecommerce.transaction_id",
    "unique_items_count": "ecommerce.unique_items",
}

# Item field behind every renamed column of the flat product table.
ITEM_FIELDS = {
    "item_price": "price",
    "item_quantity": "quantity",
    "item_reported_revenue": "item_revenue",
    "item_refund_amount": "item_refund",
    "item_coupon_code": "coupon",
    "store_affiliation": "affiliation",
}

WIDE_EVENT_COLUMNS = [
    "event_date", "event_datetime", "event_name", "event_previous_timestamp",
    "event_value_in_usd", "user_pseudo_id", "user_first_touch_timestamp", "country", "region",
    "city", "sub_continent", "continent", "metro_area", "device_type", "os", "os_version",
    "browser", "browser_version", "device_language", "mobile_brand", "mobile_model",
    "campaign_name", "traffic_medium", "traffic_source", "total_items_count",
    "total_purchase_revenue", "transaction_id", "unique_items_count",
]
EVENT_WIDE_ONLY = [
    "event_previous_timestamp", "user_first_touch_timestamp", "metro_area", "os_version",
    "browser_version", "mobile_model",
]

WIDE_PRODUCT_COLUMNS = [
    "event_date", "user_pseudo_id", "event_datetime", "event_name", "item_id", "item_name",
    "item_brand", "item_variant", "item_category", "item_category2", "item_category3",
    "item_category4", "item_category5", "item_price", "item_quantity", "item_total_revenue",
    "item_reported_revenue", "item_refund_amount", "item_coupon_code", "store_affiliation",
    "location_id",
]
PRODUCT_WIDE_ONLY = [
    "item_category3", "item_category4", "item_category5", "item_refund_amount",
]

FIRST_VISIT_DIMENSIONS = [
    "country", "region", "city", "continent", "device_type", "os", "browser", "device_language",
    "mobile_brand", "campaign_name", "traffic_medium", "traffic_source",
]

# What the stored tables keep: only columns that a report reads.
STORED_COLUMNS = {
    "events": [
        "event_date", "event_datetime", "event_name", "country", "device_type", "traffic_medium",
        "traffic_source", "campaign_name", "transaction_id", "total_purchase_revenue",
        "user_pseudo_id",
    ],
    "products": [
        "event_date", "event_datetime", "event_name", "item_id", "item_name", "item_brand",
        "item_category", "item_price", "item_quantity", "item_total_revenue", "user_pseudo_id",
    ],
    "newusers": [
        "first_visit_date", "country", "continent", "device_type", "os", "traffic_medium",
        "traffic_source", "campaign_name", "did_purchase", "purchase_revenue_total",
        "purchase_count", "days_to_first_purchase",
    ],
}

EVENT_TABLE_COLUMNS = [
    "event_date", "event_datetime", "event_name", "country", "device_type", "traffic_medium",
    "traffic_source", "campaign_name", "transaction_id", "total_purchase_revenue",
]
PRODUCT_TABLE_COLUMNS = [
    "event_date", "event_name", "item_id", "item_name", "item_brand", "item_category",
    "item_price", "item_quantity", "item_total_revenue",
]

FUNNEL_STAGES = ("view_item", "add_to_cart", "begin_checkout", "purchase")
NOT_SET = "(not set)"
DIRECT = "(direct)"
UNKNOWN_COUNTRY = "(unknown)"
UNKNOWN_DEVICE = "unknown"
UNCATEGORISED = "(未分類)"
DASH = "-"
# Names of a previous period: (fewest days, most days, name); otherwise the day count.
PERIOD_NAMES = (
    (6, 8, "前一週"),
    (26, 31, "前一個月"),
    (84, 95, "前一季"),
    (358, 372, "前一年"),
)
PERIOD_OF_DAYS = "前 {} 天"
PERIOD_UNKNOWN = "前期"
DEFAULT_DAY = "20210101"
CHUNK_ROWS = 200_000

PURCHASES_SCHEMA = record(
    TEXT, purchase_id=LONG, year=IntegerType(), supplier=None, item_category=None,
    quantity=IntegerType(), unit_price=REAL, purchase_amount=REAL, department=None, status=None,
)
PURCHASE_CATEGORIES = ("Raw Material", "Equipment", "Chemical", "Logistics")
PURCHASE_DEPARTMENTS = ("Fab 12", "Fab 15", "Fab 18", "HQ")
PURCHASE_STATUSES = ("Completed", "Pending", "Cancelled")
# --- end of fixed values ------------------------------------------------------------------

EVENT_COLUMNS = [c for c in WIDE_EVENT_COLUMNS if c not in EVENT_WIDE_ONLY]
PRODUCT_COLUMNS = [c for c in WIDE_PRODUCT_COLUMNS if c not in PRODUCT_WIDE_ONLY]
NEWUSER_COLUMNS = [
    "user_pseudo_id", "first_visit_date", "first_visit_datetime", *FIRST_VISIT_DIMENSIONS,
    "did_purchase", "first_purchase_datetime", "purchase_revenue_total", "purchase_count",
    "days_to_first_purchase",
]
