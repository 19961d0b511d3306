"""Hand-made frames for the cases in which engines and readers usually disagree."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests import frames
from tests.frames import at, column, dicts, only
from webmetrics.functions import predicates as pred
from webmetrics.operators import measures, newusers, ordering
from webmetrics.operators.flatten import explode_items, flatten_events
from webmetrics.plans import event_report, event_table, newuser_report, options, product_report
from webmetrics.spec import FilterSpec, sort_keys

ALL = FilterSpec()


def day(n):
    return date(2024, 1, n)


# ---- arrays and nested fields --------------------------------------------------------------


def test_empty_and_missing_item_lists_vanish(spark):
    raw = frames.raw(
        spark,
        {"event_date": "20240101", "event_timestamp": 5, "user_pseudo_id": "a",
         "items": [{"item_id": "1", "price": 2.5, "quantity": 4},
                   {"item_id": "2", "price": None, "quantity": 4}]},
        {"event_date": "20240101", "event_timestamp": 6, "user_pseudo_id": "b", "items": []},
        {"event_date": "20240101", "event_timestamp": 7, "user_pseudo_id": "c", "items": None},
    )
    rows = dicts(explode_items(raw).orderBy("item_id"))
    assert [(r["user_pseudo_id"], r["item_id"], r["item_total_revenue"]) for r in rows] == [
        ("a", "1", 10.0), ("a", "2", None)]
    assert flatten_events(raw).count() == 3


def test_missing_structs_give_nulls_and_days_are_kept_as_given(spark):
    raw = frames.raw(spark, {"event_date": "20240102", "event_timestamp": 1704067199999999,
                             "event_name": "x", "user_pseudo_id": "a", "geo": None})
    row = only(flatten_events(raw, wide=True))
    assert row["event_date"] == day(2)          # not the day of the time stamp
    assert row["event_datetime"] == at("2023-12-31T23:59:59.999999")
    assert row["country"] is None and row["browser_version"] is None


def test_flat_columns(spark):
    raw = frames.raw(spark, {
        "event_date": "20240101", "event_timestamp": 0, "event_name": "purchase",
        "geo": {"country": "C", "metro": "M"},
        "device": {"category": "D", "mobile_model_name": "P",
                   "web_info": {"browser": "B", "browser_version": "9"}},
        "traffic_source": {"name": "N", "medium": "m", "source": "s"},
        "ecommerce": {"total_item_quantity": 3, "purchase_revenue_in_usd": 1.5,
                      "transaction_id": "T", "unique_items": 2},
        "items": [{"item_id": "1", "item_refund": 0.5, "coupon": "c", "affiliation": "a",
                   "location_id": "l", "item_category3": "k"}]})
    narrow = only(flatten_events(raw))
    assert len(narrow) == 22 and narrow["traffic_source"] == "s" and narrow["browser"] == "B"
    wide = only(flatten_events(raw, wide=True))
    assert len(wide) == 28 and wide["mobile_model"] == "P" and wide["metro_area"] == "M"
    assert len(only(explode_items(raw))) == 17
    item = only(explode_items(raw, wide=True))
    assert len(item) == 21
    assert (item["item_refund_amount"], item["item_coupon_code"], item["store_affiliation"],
            item["location_id"], item["item_category3"]) == (0.5, "c", "a", "l", "k")


# ---- filters -------------------------------------------------------------------------------


def test_empty_medium_option_takes_null_and_empty_only(spark):
    df = frames.events(spark, *[{"traffic_medium": m} for m in (None, "", " ", "cpc")])
    assert column(df.where(pred.f_medium("traffic_medium", [""])), "traffic_medium") == [None, ""]
    assert column(df.where(pred.f_medium("traffic_medium", ["cpc"])), "traffic_medium") == ["cpc"]
    labels = dicts(measures.medium_options(df))
    assert [(r["value"], r["label"]) for r in labels] == [
        ("", "(direct)"), ("", "(direct)"), (" ", "(direct)"), ("cpc", "cpc")]


@pytest.mark.parametrize("keyword, found", [
    ("GOO", ["Google"]),
    ("  goo  ", ["Google"]),
    ("a_b", ["a_b", "axb", "a\\b"]),
    ("50%", ["50% off", "500 off"]),
    ("a\\b", ["a\\b"]),
    ("\\", ["a\\b"]),
    ("é", ["CAFÉ"]),
    ("'", ["it's"]),
])
def test_keyword(spark, keyword, found):
    names = ["Google", "a_b", "axb", "50% off", "500 off", "a\\b", "CAFÉ", "it's", None]
    df = frames.events(spark, *[{"traffic_source": n} for n in names])
    spec = FilterSpec(keyword=keyword)
    assert sorted(column(event_report.filtered(df, spec), "traffic_source")) == sorted(found)


def test_blank_keyword_and_empty_spec_do_not_filter(spark):
    df = frames.events(spark, {"traffic_source": None}, {"event_date": None})
    assert event_report.filtered(df, FilterSpec(keyword="   ")).count() == 2
    assert event_report.filtered(df, ALL).count() == 2
    assert not FilterSpec(keyword=" ").narrows_events


def test_null_country_never_matches(spark):
    df = frames.events(spark, {"country": None}, {"country": "C"})
    assert event_report.filtered(df, FilterSpec(countries=["C"])).count() == 1


def test_date_bounds_are_inclusive_and_optional(spark):
    df = frames.events(spark, *[{"event_date": day(n)} for n in (1, 2, 3)])
    count = lambda **kw: event_report.filtered(df, FilterSpec(**kw)).count()
    assert count(start="2024-01-02") == 2
    assert count(end=day(2)) == 2
    assert count(start="2024-01-02T23:59:59", end="2024-01-02") == 1


def test_filter_values_are_never_code(spark):
    df = frames.events(spark, {"country": "C"})
    assert event_report.filtered(df, FilterSpec(countries=["C' OR '1'='1"])).count() == 0
    assert event_report.filtered(df, FilterSpec(keyword="x' OR 1=1 --")).count() == 0


# ---- KPI -----------------------------------------------------------------------------------


def test_no_rows(spark):
    df = frames.events(spark, {"event_date": day(1)})
    nothing = FilterSpec(start="2030-01-01", end="2030-01-02")
    assert only(event_report.kpi(df, nothing)) == {
        "events": 0, "users": 0, "revenue": 0.0, "transactions": 0}
    compared = dicts(event_report.kpi_compare(df, nothing))
    assert [r["current"] for r in compared] == [0.0] * 4
    assert {r["status"] for r in compared} == {"out_of_range"}
    assert set(only(event_report.funnel(df, nothing)).values()) == {0}
    rates = dicts(event_report.funnel_rates(event_report.funnel(df, nothing)))
    assert all(r["pct_initial"] == r["overall_rate"] == 0.0 for r in rates)
    assert event_table.events_page(df, nothing).count() == 0
    assert event_report.device_share(df, nothing).count() == 0
    people = frames.newusers(spark, {})
    assert only(newuser_report.newuser_stats(people, nothing)) == {
        "total": 0, "converted": 0, "rate": 0.0, "avg_days": None}
    assert only(measures.conversion_summary(people.where("false")))["conversion_rate"] is None
    sold = frames.products(spark, {"item_total_revenue": 1.0})
    assert only(product_report.product_total(sold, None, nothing)) == {"total": 0}


def test_not_set_orders_count_once_and_missing_ones_not(spark):
    df = frames.events(spark, *[{"transaction_id": t} for t in ("(not set)", "(not set)", None, "7")])
    assert only(event_report.kpi(df, ALL))["transactions"] == 2


def test_compare_without_a_previous_value(spark):
    df = frames.events(
        spark, {"event_date": day(1)}, {"event_date": day(2), "total_purchase_revenue": 5.0},
        {"event_date": day(2), "user_pseudo_id": None})
    rows = {r["kpi"]: r for r in dicts(
        event_report.kpi_compare(df, FilterSpec(start=day(2), end=day(2))))}
    assert rows["events"]["pct"] == 100.0 and rows["events"]["up"] is True
    assert rows["users"]["pct"] == 0.0 and rows["users"]["up"] is True
    assert rows["revenue"]["previous"] == 0.0 and rows["revenue"]["pct"] is None
    assert rows["revenue"]["up"] is None
    assert {r["status"] for r in rows.values()} == {"has_previous"}
    first = dicts(event_report.kpi_compare(df, FilterSpec(start=day(1), end=day(1))))
    assert {(r["status"], r["pct"]) for r in first} == {("out_of_range", None)}


@pytest.mark.parametrize("bounds", [{}, {"start": day(2)}, {"end": day(2)}])
def test_compare_without_both_dates(spark, bounds):
    df = frames.events(spark, {"event_date": day(1)}, {"event_date": day(2)})
    rows = dicts(event_report.kpi_compare(df, FilterSpec(**bounds)))
    assert {(r["status"], r["previous"], r["pct"]) for r in rows} == {("no_dates", None, None)}
    wanted = event_report.filtered(df, FilterSpec(**bounds)).count()
    assert rows[0]["current"] == wanted


def test_compare_keeps_all_other_filters(spark):
    df = frames.events(
        spark, {"event_date": day(1), "event_name": "a"}, {"event_date": day(1), "event_name": "b"},
        {"event_date": day(2), "event_name": "a"})
    rows = dicts(event_report.kpi_compare(
        df, FilterSpec(event_names=["a"], start=day(2), end=day(2))))
    assert (rows[0]["current"], rows[0]["previous"]) == (1.0, 1.0)


def test_spec_previous_matches_the_column_form(spark):
    spec = FilterSpec(start="2024-03-01", end="2024-03-31")
    before = spec.previous()
    assert (before.start, before.end) == (date(2024, 1, 30), date(2024, 2, 29))
    first, last = event_report.previous_period(F.lit(spec.start), F.lit(spec.end))
    row = only(spark.range(1).select(first.alias("a"), last.alias("b")))
    assert (row["a"], row["b"]) == (before.start, before.end)
    assert FilterSpec(start="2024-03-01").previous() is None


@pytest.mark.parametrize("days, name", [
    (5, "前 5 天"), (6, "前一週"), (8, "前一週"), (9, "前 9 天"), (25, "前 25 天"),
    (26, "前一個月"), (31, "前一個月"), (32, "前 32 天"), (84, "前一季"), (95, "前一季"),
    (96, "前 96 天"), (358, "前一年"), (372, "前一年"), (373, "前 373 天")])
def test_period_label(spark, days, name):
    start = date(2023, 1, 1)
    label = event_report.period_label(F.lit(start), F.lit(start + timedelta(days=days - 1)))
    assert only(spark.range(1).select(label.alias("l")))["l"] == name


def test_period_label_without_bounds_and_with_other_names(spark):
    missing = F.lit(None).cast("date")
    labels = spark.range(1).select(
        event_report.period_label(missing, F.lit(day(1))).alias("a"),
        event_report.period_label(F.lit(day(1)), F.lit(day(2)), of_days="{} days").alias("b"))
    assert only(labels) == {"a": "前期", "b": "2 days"}


# ---- trend and funnel ----------------------------------------------------------------------


def test_moving_average_counts_rows_not_days(spark):
    days = [1, 2, 9, 20, 21, 22, 23, 30]
    rows = [{"event_date": day(d)} for i, d in enumerate(days) for _ in range(i + 1)]
    trend = dicts(event_report.daily_trend(frames.events(spark, *rows), ALL))
    assert [r["events"] for r in trend] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["ma7"] for r in trend] == [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0]
    assert trend[0]["revenue"] == 0.0


def test_funnel_ignores_order_and_event_filter(spark):
    names = {"a": ["purchase", "view_item", "add_to_cart", "begin_checkout"],
             "b": ["view_item", "begin_checkout", "purchase"], "c": ["add_to_cart"],
             None: ["view_item", "add_to_cart"]}
    rows = [{"user_pseudo_id": u, "event_name": n} for u, ns in names.items() for n in ns]
    df = frames.events(spark, *rows, {"user_pseudo_id": "d", "event_name": "scroll"})
    counts = event_report.funnel(df, FilterSpec(event_names=["purchase"]))
    assert only(counts) == {"view_item": 3, "add_to_cart": 2, "begin_checkout": 1, "purchase": 1}
    rates = dicts(event_report.funnel_rates(counts))
    assert [r["step_rate"] for r in rates][1:] == pytest.approx([200 / 3, 50.0, 100.0])
    assert rates[0]["step_rate"] is None
    assert {round(r["overall_rate"], 9) for r in rates} == {round(100 / 3, 9)}


def test_funnel_with_other_stages(spark):
    df = frames.events(spark, {"event_name": "x"}, {"event_name": "y"},
                       {"event_name": "x", "user_pseudo_id": "v"})
    counts = event_report.funnel(df, ALL, ["x", "y"])
    assert only(counts) == {"x": 2, "y": 1}
    assert [r["pct_initial"] for r in dicts(event_report.funnel_rates(counts, ["x", "y"]))] == [
        100.0, 50.0]


# ---- products ------------------------------------------------------------------------------


def test_groups_without_positive_sum_are_left_out(spark):
    df = frames.products(
        spark, {"item_category": "n", "item_total_revenue": None, "item_quantity": None},
        {"item_category": "z", "item_total_revenue": 0.0, "item_quantity": 0, "item_name": "zero"},
        {"item_category": "", "item_total_revenue": 2.0, "item_quantity": 3},
        {"item_category": None, "item_total_revenue": 1.0, "item_quantity": 1},
        {"item_category": "x", "item_total_revenue": 9.0, "item_name": "(not set)"},
        {"item_category": "x", "item_total_revenue": 9.0, "item_name": ""},
        {"item_category": "x", "item_total_revenue": 9.0, "item_name": None},
        {"item_category": "x", "item_total_revenue": 9.0, "event_name": "view_item"})
    assert dicts(product_report.category_revenue(df, None, ALL)) == [
        {"category": "(未分類)", "revenue": 3.0}]
    assert dicts(product_report.category_revenue(df, None, ALL, uncategorised="none")) == [
        {"category": "none", "revenue": 3.0}]
    assert dicts(product_report.top_items(df, None, ALL)) == [{"item": "pen", "qty": 4}]


def test_ties_in_top_k_are_settled_by_name(spark):
    df = frames.products(spark, *[{"item_name": n, "item_quantity": 1} for n in "dbca"])
    assert column(product_report.top_items(df, None, ALL, n=3), "item") == ["a", "b", "c"]


def test_semi_join_does_not_multiply(spark):
    sold = frames.products(spark, {"item_total_revenue": 5.0}, {"item_total_revenue": 5.0},
                           {"item_total_revenue": 7.0, "user_pseudo_id": None})
    twice = frames.events(spark, {"country": "C"}, {"country": "C"}, {"country": "D"},
                          {"country": "C", "user_pseudo_id": None})
    spec = FilterSpec(countries=["C"], event_names=["not a product filter"])
    assert dicts(product_report.category_revenue(sold, twice, spec))[0]["revenue"] == 10.0
    assert only(product_report.product_total(sold, twice, spec))["total"] == 2
    assert product_report.products_page(sold, twice, spec).count() == 2
    with pytest.raises(ValueError, match="events table"):
        product_report.category_revenue(sold, None, spec)


def test_category_options_come_from_purchases(spark):
    df = frames.products(spark, {"item_category": "a"}, {"item_category": "a"},
                         {"item_category": "b"}, {"item_category": ""}, {"item_category": None},
                         {"item_category": "Home/a/", "event_name": "view_item"})
    assert column(options.category_options(df), "value") == ["a", "b"]


# ---- new users -----------------------------------------------------------------------------


def _visit(user, micros, name="first_visit", **more):
    return {"event_date": "20240102", "event_timestamp": micros, "event_name": name,
            "user_pseudo_id": user, **more}


def _buy(user, micros, revenue, order):
    return _visit(user, micros, "purchase", ecommerce={
        "purchase_revenue_in_usd": revenue, "transaction_id": order})


def test_build_new_users(spark):
    noon = 1704196800000000            # 2024-01-02 12:00
    one_day = 86_400_000_000
    raw = frames.raw(
        spark, _visit("a", noon, geo={"country": "first"}),
        _visit("a", noon + 1, geo={"country": "second"}), _visit("b", noon), _visit("c", noon),
        _buy("a", noon + 3 * one_day, 2.0, "x"), _buy("a", noon + 4 * one_day, 3.0, "x"),
        _buy("b", noon - one_day, None, None), _buy("nobody", noon, 9.0, "y"))
    rows = {r["user_pseudo_id"]: r for r in dicts(newusers.build_new_users(raw))}
    assert set(rows) == {"a", "b", "c"} and len(rows["a"]) == 20
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a["country"], a["did_purchase"], a["purchase_revenue_total"], a["purchase_count"],
            a["days_to_first_purchase"]) == ("first", True, 5.0, 1, 3)
    assert a["first_purchase_datetime"] == at("2024-01-05T12:00:00")
    assert (b["did_purchase"], b["purchase_revenue_total"], b["purchase_count"],
            b["days_to_first_purchase"]) == (True, None, 0, -1)
    assert (c["did_purchase"], c["purchase_count"], c["days_to_first_purchase"]) == (False, 0, None)


def test_tie_break_makes_the_first_event_definite(spark):
    rows = [(f"k{i}", 5, "first_visit", i) for i in (3, 1, 2)]
    df = spark.createDataFrame([("u", t, n, i) for _, t, n, i in rows],
                               "user_pseudo_id STRING, event_timestamp LONG, event_name STRING, event_id LONG")
    assert column(newusers.first_event_per_user(df, "first_visit", ["event_id"]), "event_id") == [1]


def test_negative_days_are_not_averaged(spark):
    df = frames.newusers(
        spark, {"did_purchase": True, "days_to_first_purchase": -3},
        {"did_purchase": True, "days_to_first_purchase": 0},
        {"did_purchase": True, "days_to_first_purchase": 5},
        {"did_purchase": False, "days_to_first_purchase": 100}, {"did_purchase": None})
    assert only(newuser_report.newuser_stats(df, ALL)) == {
        "total": 5, "converted": 3, "rate": 60.0, "avg_days": 2.5}


def test_conversion_needs_enough_people(spark):
    rows = [{"traffic_medium": m, "did_purchase": i < 5}
            for m, n in (("", 10), (None, 10), ("cpc", 20), ("few", 19)) for i in range(n)]
    found = dicts(newuser_report.newuser_conversion(frames.newusers(spark, *rows), ALL))
    assert found == [
        {"medium": "cpc", "users": 20, "buyers": 5, "rate": 25.0},
        {"medium": "(direct)", "users": 20, "buyers": 10, "rate": 50.0}]


def test_unknown_countries_share_a_group(spark):
    df = frames.newusers(spark, {"country": None}, {"country": ""}, {"country": "C"})
    assert dicts(newuser_report.newuser_country(df, ALL)) == [
        {"country": "(unknown)", "cnt": 2}, {"country": "C", "cnt": 1}]


def test_report_is_left_out_without_its_table():
    assert newuser_report.newuser_report(None, ALL) is None


# ---- pages ---------------------------------------------------------------------------------


def _forty_five(spark):
    start = at("2024-01-01T00:00:00")
    return frames.events(spark, *[
        {"event_datetime": start + timedelta(hours=7 * i), "event_date":
         (start + timedelta(hours=7 * i)).date(), "user_pseudo_id": str(i),
         "traffic_medium": ["", "cpc", None][i % 3], "total_purchase_revenue": i / 8}
        for i in range(45)])


def test_pages(spark):
    df = _forty_five(spark)
    pages = [dicts(event_table.events_page(df, ALL, None, n)) for n in range(4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    assert {r["page_count"] for p in pages for r in p} == {3}
    rows = [r for p in pages for r in p]
    assert rows[0]["event_date"] == "2024-01-13" and rows[-1]["event_date"] == "2024-01-01"
    assert [r["event_date"] + r["event_datetime"] for r in rows] == sorted(
        (r["event_date"] + r["event_datetime"] for r in rows), reverse=True)
    assert len({tuple(r.values()) for r in rows}) == 45
    assert event_table.events_page(df, ALL, number=None).count() == 20


def test_sort_uses_what_is_shown(spark):
    df = _forty_five(spark)
    by_time = dicts(event_table.events_page(
        df, ALL, [{"column_id": "event_datetime", "direction": "asc"}], 0, 45))
    assert [r["event_datetime"] for r in by_time] == sorted(r["event_datetime"] for r in by_time)
    assert by_time[0]["event_datetime"] == "00:00:00"
    by_medium = dicts(event_table.events_page(
        df, ALL, [{"column_id": "traffic_medium", "direction": "desc"}], 0, 45))
    assert [r["traffic_medium"] for r in by_medium] == ["cpc"] * 15 + ["(direct)"] * 30


@pytest.mark.parametrize("sort", [
    None,
    [{"column_id": "traffic_medium", "direction": "asc"}],
    [{"column_id": "total_purchase_revenue", "direction": "desc"},
     {"column_id": "event_datetime", "direction": "asc"}],
])
def test_following_cursors_visits_every_row_once(spark, sort):
    base = _forty_five(spark)
    copies = frames.events(spark, *[{"country": "copy"}] * 33)
    gaps = frames.events(spark, {"event_datetime": None}, {"event_date": None},
                         {"event_datetime": None, "event_name": None})
    df = base.unionByName(copies).unionByName(gaps).cache()
    whole = [list(r.values())[:-1] for r in dicts(event_table.events_page(df, ALL, sort, 0, 100))]
    assert len(whole) == 81
    seen, cursor = [], None
    while rows := event_table.events_page_after(df, ALL, cursor, sort, 10).collect():
        seen += [list(r.asDict().values())[:-1] for r in rows]
        cursor = ordering.Cursor.after([r.sort_values for r in rows], cursor)
    assert seen == whole
    df.unpersist()


def test_sort_keys_are_checked(spark):
    allowed = ["a", "b"]
    asked = [{"column_id": "a", "direction": "asc"}, {"column_id": "evil; DROP"},
             {"column_id": "b", "direction": "up"}]
    assert [(k.column, k.ascending) for k in sort_keys(asked, allowed)] == [("a", True), ("b", False)]
    assert sort_keys(None, allowed) == []
    df = _forty_five(spark)
    odd = event_table.events_page(df, ALL, [{"column_id": "user_pseudo_id", "direction": "asc"}])
    assert dicts(odd) == dicts(event_table.events_page(df, ALL))


def test_placeholders_and_rounding(spark):
    row = only(event_table.display_events(frames.events(
        spark, {"traffic_medium": "", "traffic_source": "", "campaign_name": None,
                "total_purchase_revenue": -2.345, "event_datetime": at("2024-01-01T09:08:07.9")})))
    assert row == {
        "event_date": "2024-01-01", "event_datetime": "09:08:07", "event_name": "view_item",
        "country": "-", "device_type": "-", "traffic_medium": "(direct)", "traffic_source": "-",
        "campaign_name": "-", "transaction_id": "-", "total_purchase_revenue": -2.35}
    shown = only(product_report.display_products(frames.products(spark, {"item_name": ""})))
    assert shown == {
        "event_date": "2024-01-01", "event_name": "purchase", "item_id": "1", "item_name": "1",
        "item_brand": "-", "item_category": "(未分類)", "item_price": 0.0, "item_quantity": 0,
        "item_total_revenue": 0.0}


@pytest.mark.parametrize("total, pages", [(0, 1), (1, 1), (20, 1), (21, 2), (45, 3)])
def test_page_count(spark, total, pages):
    found = spark.range(1).select(ordering.page_count(F.lit(total)).alias("n"))
    assert only(found)["n"] == pages


def test_default_range_is_clipped(spark):
    df = frames.events(spark, {"event_date": day(5)}, {"event_date": day(8)})
    assert only(measures.date_bounds(df)) == {
        "min_date": day(5), "max_date": day(8), "default_start": day(5), "default_end": day(8)}
    longer = frames.events(spark, {"event_date": day(1)}, {"event_date": date(2024, 3, 1)})
    assert only(measures.date_bounds(longer))["default_start"] == date(2024, 2, 1)


def test_cursor_is_the_same_in_any_driver_zone(spark, monkeypatch):
    """A zone whose clocks change on the day must not skip or repeat rows."""
    import time
    times = [f"2020-11-01 {h:02d}:{m:02d}:00" for h in range(4, 8) for m in (0, 15, 30, 45)]
    rows = spark.createDataFrame([(t,) for t in times], "t string")
    columns = frames.events(spark, {}).drop("event_datetime")
    df = columns.crossJoin(rows.select(F.to_timestamp("t").alias("event_datetime"))).cache()
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        shown, cursor = [], None
        while page := event_table.events_page_after(df, ALL, cursor, None, 3).collect():
            shown += [r["event_datetime"] for r in page]
            cursor = ordering.Cursor.after([r.sort_values for r in page], cursor)
    finally:
        monkeypatch.undo()
        time.tzset()
    assert shown == [t[11:] for t in reversed(times)]
    df.unpersist()


@pytest.mark.parametrize("spec", [ALL, FilterSpec(mediums=("cpc",))])
def test_product_cursors_visit_every_row_once(spark, spec):
    noon = "TIMESTAMP '2021-01-05 12:00:00'"
    rows = spark.range(30).selectExpr(
        "DATE '2021-01-05' AS event_date", "'purchase' AS event_name",
        f"{noon} + make_dt_interval(0, 0, 0, id div 7) AS event_datetime", "CAST(id % 9 AS STRING) AS item_id",
        "concat('cup ', id % 5) AS item_name", "IF(id % 3 = 0, NULL, 'mug') AS item_brand",
        "CAST(NULL AS STRING) AS item_category", "1.5D AS item_price", "id % 2 AS item_quantity",
        "1.5D * (id % 2) AS item_total_revenue", "CAST(id % 4 AS STRING) AS user_pseudo_id")
    bought = rows.unionByName(rows.where("user_pseudo_id = '1'"))  # rows that repeat
    visits = bought.where("user_pseudo_id != '3'").selectExpr(
        "event_date", "event_datetime", "event_name", "user_pseudo_id", "'JAPAN' AS country", "'cpc' AS traffic_medium",
        "'' AS traffic_source", "'' AS campaign_name")
    whole = product_report.products_page(bought, visits, spec, 0, 100).drop("page_count").collect()
    seen, cursor = [], None
    while page := product_report.products_page_after(bought, visits, spec, cursor, 4).collect():
        seen += [tuple(r)[:-1] for r in page]
        cursor = ordering.Cursor.after([r.sort_values for r in page], cursor)
    assert seen == [tuple(r) for r in whole] and len(seen) > 20
