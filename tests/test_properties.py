"""Invariants on random frames: reports must agree with each other and with plain Python."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests import frames
from tests.frames import dicts, only
from webmetrics.operators.semijoin import filter_products_by_events
from webmetrics.plans import event_report, event_table, product_report
from webmetrics.schema import FUNNEL_STAGES
from webmetrics.spec import FilterSpec

FEW = settings(max_examples=8, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
TEXT = st.sampled_from([None, "", "(not set)", "cpc", "Google", "a_b", "50%", "x\\y"])
DAYS = st.integers(0, 20).map(lambda n: date(2024, 1, 1) + timedelta(days=n))
MOMENTS = st.integers(0, 40).map(lambda n: datetime(2024, 1, 1) + timedelta(hours=7 * n))
USERS = st.sampled_from([None, "u", "v", "w", "x"])

EVENT = st.fixed_dictionaries({
    "event_date": DAYS, "event_datetime": MOMENTS, "user_pseudo_id": USERS,
    "event_name": st.sampled_from([*FUNNEL_STAGES, "scroll"]), "country": TEXT,
    "device_type": TEXT, "traffic_medium": TEXT, "traffic_source": TEXT, "campaign_name": TEXT,
    "transaction_id": TEXT, "total_purchase_revenue": st.one_of(st.none(), st.integers(0, 99).map(float)),
})
PRODUCT = st.fixed_dictionaries({
    "event_date": DAYS, "event_datetime": MOMENTS, "user_pseudo_id": USERS,
    "event_name": st.sampled_from(["purchase", "purchase", "view_item"]), "item_name": TEXT,
    "item_id": st.sampled_from(["1", "2"]), "item_category": TEXT,
    "item_quantity": st.one_of(st.none(), st.integers(0, 9)),
    "item_total_revenue": st.one_of(st.none(), st.integers(-5, 50).map(float)),
})
SPEC = st.builds(
    FilterSpec, mediums=st.lists(st.sampled_from(["", "cpc", "Google"]), max_size=2),
    countries=st.lists(st.sampled_from(["", "cpc", "Google"]), max_size=2),
    event_names=st.lists(st.sampled_from(FUNNEL_STAGES), max_size=2),
    keyword=st.sampled_from([None, " ", "goo", "_", "%", "\\", "A_B"]),
    start=st.one_of(st.none(), DAYS), end=st.one_of(st.none(), DAYS))


def _like(value, keyword):
    """Case-insensitive LIKE '%keyword%' by hand."""
    import re
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in keyword)
    return value is not None and re.search(pattern, value, re.I | re.S) is not None


def _audience(row, spec):
    return ((not spec.mediums or (row["traffic_medium"] or "") in spec.mediums)
            and (not spec.countries or row["country"] in spec.countries)
            and (not spec.keyword or any(_like(row[c], spec.keyword) for c in (
                "campaign_name", "traffic_source", "country"))))


def _passes(row, spec):
    return (_audience(row, spec)
            and (not spec.event_names or row["event_name"] in spec.event_names)
            and (spec.start is None or row["event_date"] >= spec.start)
            and (spec.end is None or row["event_date"] <= spec.end))


@FEW
@given(rows=st.lists(EVENT, min_size=1, max_size=40), spec=SPEC)
def test_event_reports_agree(spark, rows, spec):
    df = frames.events(spark, *rows).cache()
    kept = [r for r in rows if _passes(r, spec)]
    kpi = only(event_report.kpi(df, spec))
    assert kpi == {
        "events": len(kept),
        "users": len({r["user_pseudo_id"] for r in kept} - {None}),
        "revenue": sum(r["total_purchase_revenue"] or 0.0 for r in kept),
        "transactions": len({r["transaction_id"] for r in kept} - {None}),
    }
    trend = dicts(event_report.daily_trend(df, spec))
    assert sum(r["events"] for r in trend) == kpi["events"]
    assert sum(r["revenue"] for r in trend) == kpi["revenue"]
    assert [r["day"] for r in trend] == sorted({r["event_date"] for r in kept})
    names = dicts(event_report.event_composition(df, spec))
    assert sum(r["cnt"] for r in names) == kpi["events"]
    devices = dicts(event_report.device_share(df, spec))
    assert sum(r["cnt"] for r in devices) == kpi["events"]
    assert sum(r["share"] for r in devices) == pytest.approx(1.0 if kept else 0.0)
    rates = dicts(event_report.funnel_rates(event_report.funnel(df, spec)))
    counts = [r["users"] for r in rates]
    assert counts == sorted(counts, reverse=True)
    assert all(0 <= r["pct_initial"] <= 100 and 0 <= (r["step_rate"] or 0) <= 100 for r in rates)
    size = 7
    pages = [dicts(event_table.events_page(df, spec, None, n, size))
             for n in range(-(-len(kept) // size))]
    whole = dicts(event_table.events_page(df, spec, None, 0, 100))
    for r in [*whole, *[r for p in pages for r in p]]:
        r.pop("page_count")
    assert [r for p in pages for r in p] == whole
    assert len(whole) == len(kept)
    df.unpersist()


@FEW
@given(sold=st.lists(PRODUCT, min_size=1, max_size=40),
       seen=st.lists(EVENT, min_size=1, max_size=30), spec=SPEC)
def test_product_reports_agree(spark, sold, seen, spec):
    products, events = frames.products(spark, *sold).cache(), frames.events(spark, *seen).cache()
    keys = {(e["user_pseudo_id"], e["event_datetime"]) for e in seen if _audience(e, spec)}
    kept = [p for p in sold
            if p["event_name"] == "purchase" and p["item_name"] not in (None, "", "(not set)")
            and (spec.start is None or p["event_date"] >= spec.start)
            and (spec.end is None or p["event_date"] <= spec.end)
            and (not spec.narrows_events or (p["user_pseudo_id"] is not None and
                 (p["user_pseudo_id"], p["event_datetime"]) in keys))]
    assert filter_products_by_events(products, events, spec).count() == len(kept)
    assert only(product_report.product_total(products, events, spec))["total"] == len(kept)
    assert len(dicts(product_report.products_page(products, events, spec, 0, 50))) == len(kept)
    revenue = {}
    for p in kept:
        if p["item_total_revenue"] is not None:
            name = p["item_category"] or "(未分類)"
            revenue[name] = revenue.get(name, 0.0) + p["item_total_revenue"]
    top = [(r["category"], r["revenue"])
           for r in dicts(product_report.category_revenue(products, events, spec))]
    assert top == sorted(((c, v) for c, v in revenue.items() if v > 0),
                         key=lambda cv: (-cv[1], cv[0]))[:5]
    products.unpersist(), events.unpersist()
