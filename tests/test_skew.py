"""Hot keys: one key holding a third of all rows must not change results.
AQE skew handling is forced on with tiny thresholds so skewed partitions are
actually split."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from counterbook.operators import cash as C
from counterbook.operators import deposits as DP
from counterbook.operators import reports as R
from counterbook.operators.joins import mark_first_in_key, mark_taken

N = 30000


@pytest.fixture
def skew_conf(spark):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_order_in_sales_summary(spark, skew_conf):
    orders = spark.range(1000).select(
        F.col("id"), (F.col("id") % 5).alias("branch_id"), F.lit("web").alias("sales_channel_id"),
        F.lit("completed").alias("order_status"), (F.col("id") % 97 + 1).cast("decimal(12,2)").alias("total_amount"),
        F.lit(None).cast("decimal(12,2)").alias("discount_amount"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(days=(F.col("id") % 28).cast("int"))).cast("timestamp_ntz")
        .alias("created_at"))
    # a third of all item lines belong to order 7
    items = spark.range(N).select(
        F.when(F.col("id") < N // 3, F.lit(7)).otherwise(F.col("id") % 1000).alias("order_id"),
        (F.col("id") % 50).alias("product_variant_id"), F.lit(1).alias("quantity"),
        F.lit(1).cast("decimal(12,2)").alias("subtotal"))
    prepaid = spark.createDataFrame([], "id bigint, branch_id bigint, gross_amount decimal(12,2), "
                                        "created_at timestamp_ntz")
    got = {r["period"].date(): (r["net_sales"], r["items_sold"], r["order_count"])
           for r in R.sales_summary(orders, items, prepaid, "daily", "2024-01-01", "2024-01-31").collect()}
    o, i = orders.toPandas(), items.toPandas()
    lines = i.groupby("order_id").size()
    o["lines"] = o["id"].map(lines).fillna(0).astype(int)
    o["day"] = o["created_at"].dt.date
    want = {}
    for day, g in o.groupby("day"):
        net = sum(D(str(t)) * max(n, 1) for t, n in zip(g["total_amount"], g["lines"]))
        want[day] = (net, int(g["lines"].sum()), len(g))
    assert got == want


def test_hot_reference_first_wins(spark, skew_conf):
    df = spark.range(N).select(F.col("id").alias("seq"),
                               F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
                                   F.concat(F.lit("R"), F.col("id").cast("string"))).alias("ref"))
    out = mark_first_in_key(df, "ref", "seq", F.lit(True), "first")
    hot = out.filter(F.col("ref") == "HOT").groupBy("first").count().collect()
    assert {r["first"]: r["count"] for r in hot} == {True: 1, False: N // 3 - 1}
    assert out.filter((F.col("ref") == "HOT") & F.col("first")).first()["seq"] == 0
    assert out.filter(F.col("ref") != "HOT").filter(~F.col("first")).count() == 0


def test_hot_branch_day_cash_totals(spark, skew_conf):
    ts = F.lit(dt.datetime(2024, 1, 2, 10)).cast("timestamp_ntz")
    gcash = spark.range(N).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("branch_id"),
        F.when(F.col("id") % 2 == 0, F.lit("cash_in")).otherwise(F.lit("cash_out")).alias("service_type"),
        F.lit(10).cast("decimal(12,2)").alias("principal_amount"), F.lit(11).cast("decimal(12,2)").alias("gross_amount"),
        F.lit(0).cast("decimal(12,2)").alias("cash_impact"), ts.alias("created_at"))
    empty_o = spark.createDataFrame([], "id bigint, branch_id bigint, order_status string, "
                                        "total_amount decimal(12,2), created_at timestamp_ntz")
    empty_p = spark.createDataFrame([], "id bigint, order_id bigint, payment_method string, amount decimal(12,2), "
                                        "payment_date timestamp_ntz")
    empty_pp = spark.createDataFrame([], "id bigint, branch_id bigint, cash_impact decimal(12,2), "
                                         "created_at timestamp_ntz")
    t = {r["branch_id"]: r for r in C.daily_cash_totals(empty_o, empty_p, gcash, empty_pp).collect()}
    g = gcash.toPandas()
    hot = g[g["branch_id"] == 1]
    n_in = int((hot["service_type"] == "cash_in").sum())
    n_out = len(hot) - n_in
    assert t[1]["gcash_cash_in_total"] == D(11) * n_in and t[1]["gcash_cash_out_total"] == D(10) * n_out
    assert t[1]["other_cash_impact_amount"] == D(11) * n_in - D(10) * n_out
    assert len(t) == g["branch_id"].nunique()


def _sorts_by_stage(node, counts, stage=0):
    """Sorts of each stretch of a physical plan between exchanges."""
    name = node.nodeName()
    if name == "Exchange":
        stage = max(counts) + 1
        counts[stage] = 0
    counts[stage] = counts.get(stage, 0) + (name == "Sort")
    for k in range(node.children().size()):
        _sorts_by_stage(node.children().apply(k), counts, stage)
    return counts


def test_posting_sorts_few_inputs_in_one_task(spark, skew_conf):
    """The lookups of a posting batch end in stages of their own: one task sorting all their inputs beside the wide requests had 13 sorts."""
    ledger = spark.sql("select concat('R', id) as reference_number, id as deposited_by from range(50)")
    ledger = ledger.union(spark.sql("select concat('S', id), id from range(50)"))
    recons = spark.createDataFrame([], "id bigint, branch_id bigint, business_date date")
    req = spark.sql("""select id as seq, 7L as branch_id, case when id % 10 = 0 then null when id % 3 = 0 then 'R1' else concat('N', id % 400) end as reference_number,
                       5.0 as amount, 'A' as bank_account, 'Ann' as depositor_name, 'p' as photo_proof_url from range(1000)""")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = DP.post_deposits(req, recons, ledger)
        assert max(_sorts_by_stage(out._jdf.queryExecution().executedPlan(), {0: 0}).values()) <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    used, want = {f"R{i}" for i in range(50)}, {}
    for i in range(1000):
        ref = None if i % 10 == 0 else "R1" if i % 3 == 0 else f"N{i % 400}"
        want[i] = "reference_number is required" if ref is None else DP.ERR_REFERENCE_UNIQUE if ref in used else None
        used.add(ref)
    assert {r["seq"]: r["reject_reason"] for r in out.collect()} == want


def test_taken_keys_with_odd_rows(spark, skew_conf):
    """NULL keys and NULL sequence numbers are never taken, rows that share the first number both stay, ineligible rows claim nothing, a ledger key may repeat."""
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (2, "a", True), (3, "a", True), (None, "a", True), (4, None, True), (5, "h", True), (6, "b", True)],
                               "seq int, k string, ok boolean")
    ledger = spark.createDataFrame([("h",), ("h",), (None,), ("z",)], "ref string")
    got = sorted((r["seq"] or 0, r["k"] or "", r["t"]) for r in mark_taken(df, "k", "seq", F.col("ok"), ledger, "ref", "t").filter("ok").collect())
    assert got == [(0, "a", False), (2, "a", False), (2, "a", False), (3, "a", True), (4, "", False), (5, "h", True), (6, "b", False)]
