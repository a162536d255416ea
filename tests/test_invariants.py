"""Invariants over the driver's smallest folder."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from counterbook.operators import cash as C
from counterbook.operators import deposits as DP
from counterbook.operators import fees as FE
from counterbook.operators import prepaid as P
from counterbook.operators import reports as R
from counterbook.operators import stock as S
from counterbook.plans import q_cash
from counterbook.sources.adapter import Adapter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def a(spark):
    return Adapter(spark, SF)


def test_period_sums_equal_overview(a):
    for fan_out in (False, True):
        summary = R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "monthly", "1995-01-01", "2001-12-31",
                                  fan_out=fan_out)
        tot = summary.agg(F.sum("net_sales").alias("n"), F.sum("order_count").alias("c"),
                          F.sum("items_sold").alias("i")).first()
        ov = R.sales_overview(a.r_orders, a.r_items, a.r_prepaid, "1995-01-01", "2001-12-31", fan_out=fan_out).first()
        assert (tot["n"], tot["c"], tot["i"]) == (ov["net_sales"], ov["order_count"], ov["items_sold"])
    grain = R.sales_overview(a.r_orders, a.r_items, a.r_prepaid, "1995-01-01", "2001-12-31", fan_out=False).first()
    fan = R.sales_overview(a.r_orders, a.r_items, a.r_prepaid, "1995-01-01", "2001-12-31").first()
    assert fan["net_sales"] > grain["net_sales"]  # T1 inflates


def test_close_days_identities(a):
    t = q_cash.recons_closed(a)
    bad = t.filter(F.col("closed_at").isNotNull() & (
        (F.col("variance_amount") != F.col("actual_cash_on_hand") - F.col("expected_cash_on_hand"))
        | (F.col("is_short") != (F.col("variance_amount") < 0))
        | (F.col("expected_cash_on_hand") != F.col("opening_cash_total") + F.col("cash_sales_amount")
           + F.col("other_cash_impact_amount"))))
    assert bad.count() == 0
    assert t.count() == q_cash.recons_opened(a).count()


def test_posting_outcomes_cover_every_request(a):
    cases = [
        (a.r_deposit_requests, DP.post_deposits(a.r_deposit_requests, q_cash.recons_opened(a), a.r_deposits)),
        (a.r_wallet_requests, FE.post_wallet_transactions(a.r_wallet_requests, a.r_fee_rules, a.r_gcash,
                                                          as_of="created_at")),
        (a.r_prepaid_requests, P.post_prepaid_sales(a.r_prepaid_requests, a.r_catalog_current, a.r_prepaid)),
        (a.r_reversal_requests, DP.reverse_deposits(a.r_reversal_requests, a.r_deposits)[0]),
    ]
    for req, out in cases:
        assert out.count() == req.count()
        assert out.select("seq").distinct().count() == req.count()
        ok = out.filter(F.col("reject_reason").isNull())
        # no accepted reference is used twice or already in the ledger
        ref = "ref_trimmed" if "ref_trimmed" in out.columns else "reference_number"
        assert ok.groupBy(ref).count().filter("count > 1").count() == 0


def test_reversal_moves_daily_nets_by_reversed_amounts(a):
    before = {(r["branch_id"], r["business_date"]): r["total_bank_deposit_amount"]
              for r in DP.deposit_net_by_day(a.r_deposits).collect()}
    outcome, ledger = DP.reverse_deposits(a.r_reversal_requests, a.r_deposits, id_expr=F.lit(None).cast("bigint"))
    after = {(r["branch_id"], r["business_date"]): r["total_bank_deposit_amount"]
             for r in DP.deposit_net_by_day(ledger).collect()}
    reversed_ids = [r["id"] for r in outcome.filter(F.col("reject_reason").isNull()).select("id").collect()]
    moved = {}
    for r in a.r_deposits.filter(F.col("id").isin(reversed_ids)).collect():
        k = (r["branch_id"], r["business_date"])
        moved[k] = moved.get(k, D(0)) + r["amount"]
    assert reversed_ids
    for k, v in before.items():
        assert after[k] == v - moved.get(k, D(0))


def test_stock_added_equals_movements(a):
    trans = a.r_pos.filter(F.col("status") == "ordered").select(F.col("id").alias("purchase_order_id"),
                                                                 F.lit("received").alias("status"))
    moves, inv, _ = S.receive_purchase_orders(a.r_pos, a.r_po_items, trans, a.r_inventories)
    before = a.r_inventories.agg(F.sum("quantity_on_hand")).first()[0]
    after = inv.agg(F.sum("quantity_on_hand")).first()[0]
    assert after - before == moves.agg(F.sum("quantity")).first()[0]


def test_daily_totals_partition_the_ledgers(a):
    t = C.daily_cash_totals(a.r_orders, a.r_payments, a.r_gcash, a.r_prepaid)
    s = t.agg(F.sum("gcash_cash_in_total").alias("ci"), F.sum("total_sales_amount").alias("ts")).first()
    g = a.r_gcash.filter(F.col("service_type") == "cash_in").agg(F.sum("gross_amount")).first()[0]
    o = a.r_orders.filter(F.col("order_status") != "cancelled").agg(F.sum("total_amount")).first()[0]
    assert s["ci"] == g and s["ts"] == o
