"""The BackOffice facade over a folder of back-office tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from counterbook.api import BackOffice
from counterbook.operators import reports as R
from counterbook.sources.adapter import Adapter

SF = "/root/testdata/sf0.001"
TABLES = {"orders": "r_orders", "order_items": "r_items", "prepaid_load_transactions": "r_prepaid",
          "payments": "r_payments", "product_variants": "r_variants", "products": "r_products",
          "prepaid_load_products": "r_prepaid_catalog", "bank_deposits": "r_deposits", "branches": "r_branches",
          "users": "r_users", "gcash_transactions": "r_gcash", "gcash_fee_rules": "r_fee_rules",
          "purchase_orders": "r_pos", "purchase_order_items": "r_po_items", "inventories": "r_inventories"}


@pytest.fixture(scope="module")
def office(spark):
    a = Adapter(spark, SF)
    root = tempfile.mkdtemp(prefix="cb-office-")
    for name, view in TABLES.items():
        a.table(view).write.parquet(f"{root}/{name}")
    return a, BackOffice(spark, root, as_of="2001-12-31 00:00:00")


def test_reports_over_table_folder(office):
    a, bo = office
    got = {r["period"]: r["net_sales"] for r in bo.sales_summary("monthly", "1995-01-01", "2001-12-31").collect()}
    want = {r["period"]: r["net_sales"] for r in
            R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "monthly", "1995-01-01", "2001-12-31").collect()}
    assert got == want and got
    assert bo.overview("1995-01-01", "2001-12-31").first()["order_count"] > 0
    assert {r["payment_method"] for r in bo.payment_breakdown("1995-01-01", "2001-12-31").collect()} >= {"cash"}
    assert bo.top_products("1995-01-01", "2001-12-31", limit=5).count() == 5
    assert bo.deposits(limit=None).count() == a.r_deposits.count()
    assert bo.purchase_orders_with_totals(limit=10).count() == 10
    assert bo.list("gcash_transactions", where="service_type = 'cash_in'", limit=3).count() == 3
    # ids are text in the declared schema
    assert dict(bo.table("orders").dtypes)["id"] == "string"


def test_postings_and_audit(office, spark):
    a, bo = office
    req = a.r_wallet_requests
    out, ledger = bo.post_gcash_transactions(req.withColumn("branch_id", F.lit(None).cast("string"))
                                     .withColumn("customer_id", F.lit(None).cast("string")))
    assert out.count() == req.count()
    assert ledger.count() == a.r_gcash.count() + out.filter("reject_reason is null").count()
    assert bo.audit().count() == 0  # the adapter tables are clean


def test_audit_finds_defects(spark):
    root = tempfile.mkdtemp(prefix="cb-audit-")
    spark.createDataFrame([("o1", "pending"), ("o2", "bogus")], "id string, order_status string") \
        .write.parquet(f"{root}/orders")
    spark.createDataFrame([("p1", "o1", "cash", 5.0), ("p2", "o9", "bitcoin", 1.0)],
                          "id string, order_id string, payment_method string, amount double") \
        .write.parquet(f"{root}/payments")
    spark.createDataFrame([("d1", "R1", 0.0), ("d2", "R1", 3.0)], "id string, reference_number string, amount double") \
        .write.parquet(f"{root}/bank_deposits")
    got = {(r["table_name"], r["check_kind"], r["check_name"], r["detail"], r["row_count"])
           for r in BackOffice(spark, root).audit().collect()}
    assert got == {("orders", "domain", "order_status", "bogus", 1),
                   ("payments", "domain", "payment_method", "bitcoin", 1),
                   ("payments", "reference", "order_id -> orders", None, 1),
                   ("bank_deposits", "check", "amount_nonzero", None, 1),
                   ("bank_deposits", "unique", "reference_number", "R1", 2)}
