"""Web-traffic analytics for online shops, as lazily planned Spark DataFrames.

``plans`` holds the reports and the load, ``operators`` their building blocks, ``functions``
column helpers and filters, ``sources`` readers and writers. Sessions are expected to run in
UTC (``spark.sql.session.timeZone=UTC``).
"""

from webmetrics.operators.flatten import explode_items, flatten_events
from webmetrics.operators.newusers import build_new_users
from webmetrics.operators.ordering import Cursor
from webmetrics.operators.semijoin import filter_products_by_events
from webmetrics.plans.etl import run_etl
from webmetrics.plans.event_report import event_report
from webmetrics.plans.event_table import events_page, events_page_after
from webmetrics.plans.newuser_report import newuser_report
from webmetrics.plans.options import filter_options
from webmetrics.plans.product_report import product_report, products_page
from webmetrics.sources.scan import read_raw_events
from webmetrics.sources.sink import StoreLayout, build_warehouse, ensure_warehouse
from webmetrics.spec import FilterSpec

__all__ = [
    "Cursor", "FilterSpec", "StoreLayout", "build_new_users", "build_warehouse",
    "ensure_warehouse", "event_report", "events_page", "events_page_after", "explode_items",
    "filter_options", "filter_products_by_events", "flatten_events", "newuser_report",
    "product_report", "products_page", "read_raw_events", "run_etl",
]
