"""Small hand-made frames. Rows name only the columns a test is about."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from webmetrics.schema import EVENT_COLUMNS, NEWUSER_COLUMNS, PRODUCT_COLUMNS, RAW_EVENT_SCHEMA

_TYPES = {
    "event_date": DateType(), "event_datetime": TimestampType(),
    "first_visit_date": DateType(), "first_visit_datetime": TimestampType(),
    "first_purchase_datetime": TimestampType(), "event_value_in_usd": DoubleType(),
    "total_items_count": LongType(), "total_purchase_revenue": DoubleType(),
    "unique_items_count": LongType(), "item_price": DoubleType(), "item_quantity": LongType(),
    "item_total_revenue": DoubleType(), "item_reported_revenue": DoubleType(),
    "did_purchase": BooleanType(), "purchase_revenue_total": DoubleType(),
    "purchase_count": LongType(), "days_to_first_purchase": IntegerType(),
}


def _frame(spark, columns, rows, defaults):
    schema = StructType([StructField(c, _TYPES.get(c, StringType())) for c in columns])
    full = [{**defaults, **row} for row in rows]
    unknown = {k for row in full for k in row} - set(columns)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in full], schema)


def at(text):
    return datetime.fromisoformat(text)


def events(spark, *rows, **defaults):
    base = {"event_date": at("2024-01-01").date(), "event_datetime": at("2024-01-01T10:00:00"),
            "event_name": "view_item", "user_pseudo_id": "u"}
    return _frame(spark, EVENT_COLUMNS, rows, {**base, **defaults})


def products(spark, *rows, **defaults):
    base = {"event_date": at("2024-01-01").date(), "event_datetime": at("2024-01-01T10:00:00"),
            "event_name": "purchase", "user_pseudo_id": "u", "item_id": "1", "item_name": "pen"}
    return _frame(spark, PRODUCT_COLUMNS, rows, {**base, **defaults})


def newusers(spark, *rows, **defaults):
    base = {"first_visit_date": at("2024-01-01").date(), "user_pseudo_id": "u",
            "did_purchase": False, "purchase_count": 0}
    return _frame(spark, NEWUSER_COLUMNS, rows, {**base, **defaults})


def raw(spark, *rows):
    """Nested records; structs are given as dicts."""
    return spark.createDataFrame(
        [{f.name: row.get(f.name) for f in RAW_EVENT_SCHEMA.fields} for row in rows],
        RAW_EVENT_SCHEMA)


def dicts(df):
    return [r.asDict() for r in df.collect()]


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def only(df):
    rows = dicts(df)
    assert len(rows) == 1
    return rows[0]


def scattered(spark, n, partitions=8):
    """``n`` numbered rows over several partitions, column ``id``."""
    return spark.range(0, n, 1, partitions).withColumn("id", F.col("id").cast("long"))
