"""Report semantics on literal frames."""

import datetime as dt
from decimal import Decimal as D

import pytest

from counterbook.functions.periods import ReportArgumentError, report_window, resolve_report_dates
from counterbook.operators import reports as R

ORDERS = "id bigint, branch_id bigint, sales_channel_id string, order_status string, total_amount decimal(12,2), " \
         "discount_amount decimal(12,2), created_at timestamp_ntz"
ITEMS = "order_id bigint, product_variant_id bigint, quantity int, subtotal decimal(12,2)"
PREPAID = "id bigint, branch_id bigint, product_id bigint, gross_amount decimal(12,2), created_at timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def frames(spark):
    orders = spark.createDataFrame([
        (1, 1, "web", "completed", D("100.00"), D("10.00"), ts("2024-01-02 10:00:00")),   # 3 items
        (2, 1, "web", "pending", D("50.00"), None, ts("2024-01-02 11:00:00")),            # 0 items
        (3, 2, "pos", "cancelled", D("999.00"), D("0.00"), ts("2024-01-02 12:00:00")),   # excluded
        (4, 2, "pos", None, D("999.00"), D("0.00"), ts("2024-01-03 12:00:00")),          # NULL status: dropped
        (5, 2, "pos", "returned", D("20.00"), D("0.00"), ts("2024-01-03 13:00:00")),     # still counted
    ], ORDERS)
    items = spark.createDataFrame([
        (1, 10, 1, D("30.00")), (1, 11, 2, D("40.00")), (1, 99, 1, D("30.00")),
        (5, 10, 1, D("20.00")), (3, 10, 5, D("999.00")),
    ], ITEMS)
    prepaid = spark.createDataFrame([
        (100, 1, 0, D("51.00"), ts("2024-01-02 09:00:00")),
        (101, 2, 1, D("76.00"), ts("2024-01-03 09:00:00")),
    ], PREPAID)
    return orders, items, prepaid


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_sales_summary_fan_out_T1(frames):
    o, i, p = frames
    out = {r["period"].date(): r for r in rows(R.sales_summary(o, i, p, "daily", "2024-01-01", "2024-01-05"))}
    d2 = out[dt.date(2024, 1, 2)]
    # order 1 counted once per item (3x), order 2 once, plus one prepaid sale
    assert d2["order_count"] == 3
    assert d2["net_sales"] == D("100.00") * 3 + D("50.00") + D("51.00")
    assert d2["gross_sales"] == D("110.00") * 3 + D("50.00") + D("51.00")
    assert d2["total_discounts"] == D("30.00")
    assert d2["items_sold"] == 4 + 1
    d3 = out[dt.date(2024, 1, 3)]
    assert d3["order_count"] == 2  # returned order + prepaid; NULL status dropped (T6)
    assert d3["net_sales"] == D("20.00") + D("76.00")


def test_sales_summary_order_grain_counts_each_order_once(frames):
    o, i, p = frames
    out = {r["period"].date(): r for r in rows(R.sales_summary_order_grain(o, i, p, "daily", "2024-01-01",
                                                                           "2024-01-05"))}
    assert out[dt.date(2024, 1, 2)]["net_sales"] == D("100.00") + D("50.00") + D("51.00")


def test_channel_filter_drops_prepaid_T2(frames):
    o, i, p = frames
    out = rows(R.sales_summary(o, i, p, "daily", "2024-01-01", "2024-01-05", channel_id="web"))
    assert sum(r["order_count"] for r in out) == 2  # orders 1 and 2 (distinct), no prepaid
    assert sum(r["net_sales"] for r in out) == D("100.00") * 3 + D("50.00")


def test_summary_branch_filter_applies_to_prepaid(frames):
    o, i, p = frames
    out = rows(R.sales_summary(o, i, p, "daily", "2024-01-01", "2024-01-05", branch_id=2))
    assert sum(r["net_sales"] for r in out) == D("20.00") + D("76.00")


def test_overview_and_zero_guard(frames, spark):
    o, i, p = frames
    ov = rows(R.sales_overview(o, i, p, "2024-01-01", "2024-01-05"))[0]
    assert ov["order_count"] == 5  # orders 1, 2, 5 + two prepaid sales
    assert ov["avg_order_value"] == pytest.approx(float(ov["net_sales"]) / 5)
    empty = rows(R.sales_overview(o, i, p, "2030-01-01", "2030-01-02"))[0]
    assert empty["order_count"] == 0 and empty["avg_order_value"] == 0.0 and empty["net_sales"] == 0


def test_payment_breakdown_always_has_cash_row_T3(spark, frames):
    o, _, p = frames
    pays = spark.createDataFrame([(1, 1, "card", D("100.00"), ts("2024-01-02 10:00:00")),
                                  (2, 3, "card", D("999.00"), ts("2024-01-02 10:00:00"))],
                                 "id bigint, order_id bigint, payment_method string, amount decimal(12,2), "
                                 "payment_date timestamp_ntz")
    out = {r["payment_method"]: r for r in rows(R.payment_breakdown(pays, o, p, "2030-01-01", "2030-01-01"))}
    assert out == {"cash": {"payment_method": "cash", "transaction_count": 0, "total_amount": D("0.00")}}
    out = {r["payment_method"]: r for r in rows(R.payment_breakdown(pays, o, p, "2024-01-01", "2024-01-05"))}
    assert out["card"]["total_amount"] == D("100.00")  # cancelled order's payment excluded
    assert out["cash"]["transaction_count"] == 2


def test_top_products_null_variant_group_T7_and_limit_T10(spark, frames):
    o, i, p = frames
    variants = spark.createDataFrame([(10, "A", "SKU-10", "S", None, "c1"), (11, "A", "SKU-11", "M", None, "c1")],
                                     "id bigint, product_id string, sku string, size string, color string, class string")
    products = spark.createDataFrame([("A", "Shirt")], "id string, product_name string")
    catalog = spark.createDataFrame([(0, "SMART_REG_50", "Smart 50"), (1, "TNT_REG_75", "TNT 75")],
                                    "id bigint, product_code string, product_name string")
    out = rows(R.top_products(i, o, variants, products, p, catalog, "2024-01-01", "2024-01-05", limit=0))
    assert len(out) == 5  # 0 -> default 10, only 5 groups exist
    by_sku = {r["sku"]: r for r in out}
    assert by_sku[None]["product_variant_id"] is None and by_sku[None]["total_revenue"] == D("30.00")
    assert by_sku["SKU-10"]["units_sold"] == 2 and by_sku["SKU-10"]["total_revenue"] == D("50.00")
    assert by_sku["TNT_REG_75"]["class"] == "prepaid_load" and by_sku["TNT_REG_75"]["size"] == ""
    assert [r["total_revenue"] for r in out] == sorted([r["total_revenue"] for r in out], reverse=True)
    assert len(rows(R.top_products(i, o, variants, products, p, catalog, "2024-01-01", "2024-01-05", limit=2))) == 2
    with pytest.raises(ReportArgumentError):
        R.top_products(i, o, variants, products, p, catalog, limit=-1)
    assert R.resolve_limit(500) == 500 and R.resolve_limit(500, cap=100) == 100 and R.resolve_limit("abc") == 10


def test_report_windows_T11_T12():
    assert report_window("daily", "2024-03-31") == ("day", dt.date(2024, 3, 2), dt.date(2024, 3, 31))
    assert report_window("weekly", "2024-03-31")[1] == dt.date(2024, 1, 8)
    assert report_window("monthly", "2024-03-31")[1] == dt.date(2023, 4, 1)  # 11 months back, 1st
    assert report_window("yearly", "2024-03-31")[1] == dt.date(2020, 1, 1)
    with pytest.raises(ReportArgumentError):
        resolve_report_dates("custom", "2024-01-01", None, "2024-03-31")
    with pytest.raises(ReportArgumentError):
        resolve_report_dates("hourly", None, None, "2024-03-31")
    with pytest.raises(ReportArgumentError):
        resolve_report_dates("daily", "2024-02-01", "2024-01-01", "2024-03-31")
    with pytest.raises(ReportArgumentError):
        resolve_report_dates("daily", "2024/02/01", None, "2024-03-31")


def test_weekly_bucket_starts_monday(frames):
    o, i, p = frames
    out = rows(R.sales_summary(o, i, p, "weekly", "2024-01-01", "2024-01-05"))
    assert [r["period"].date() for r in out] == [dt.date(2024, 1, 1)]


def test_purchase_orders_totals_and_variance_T29(spark):
    pos = spark.createDataFrame([(1, "draft"), (2, "received"), (3, "ordered")], "id bigint, status string")
    items = spark.createDataFrame([(1, 10, 2, D("5.00")), (1, 11, 1, None), (2, None, 3, D("1.50"))],
                                  "purchase_order_id bigint, product_variant_id bigint, quantity int, "
                                  "cost_price decimal(12,2)")
    est = spark.createDataFrame([(1, D("12.00")), (1, D("1.00"))],
                                "purchase_order_id bigint, estimated_total_cost decimal(12,2)")
    t = {r["id"]: r for r in rows(R.purchase_orders_with_totals(pos, items, limit=None))}
    assert t[1]["items_total"] == D("10.00") and t[1]["items_count"] == 2  # NULL cost drops the line
    assert t[3]["items_total"] == D("0.00") and t[3]["items_count"] == 0
    assert [r["id"] for r in rows(R.purchase_orders_with_totals(pos, items, where="status <> 'draft'"))] == [3, 2]
    v = {r["purchase_order_id"]: r for r in rows(R.purchase_order_variance(pos, est, items))}
    assert v[1]["variance"] == D("10.00") - D("13.00")
    assert v[3]["estimated_total"] == 0 and v[3]["actual_total"] == 0


def test_variants_page_nulls_first_T8(spark):
    v = spark.createDataFrame([(1, "A", True, ts("2024-01-01 00:00:00")), (2, "A", True, None),
                               (3, "B", False, ts("2024-02-01 00:00:00"))],
                              "id bigint, product_id string, is_active boolean, created_at timestamp_ntz")
    p = spark.createDataFrame([("A", "Shirt")], "id string, product_name string")
    out = rows(R.variants_with_product(v, p))
    assert [r["id"] for r in out] == [2, 3, 1]
    assert out[0]["product"]["name"] == "Shirt" and out[1]["product"]["name"] is None
    assert [r["id"] for r in rows(R.variants_with_product(v, p, is_active="1", limit=1, offset=1))] == [1]
    assert [r["id"] for r in rows(R.variants_with_product(v, p, is_active="yes"))] == [3]
