"""Sales and purchasing reports.

Plan shape shared by the sales reports: every source is reduced to *rows of
measures* (one row per order, one row per prepaid sale), unioned, and then
aggregated once, either by period bucket or globally. Order items are
pre-aggregated per order (partial aggregation combines a hot order map-side),
so the order side joins 1:1 and no COUNT(DISTINCT) expansion is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY_OUT, money_out, zero_money
from ..functions.periods import ReportArgumentError, check_date_range, resolve_report_dates
from ..functions.predicates import day_range, not_cancelled, optional_filters, truthy_text
from ..session import cut_lineage

SALES_MEASURES = ["order_count", "gross_sales", "total_discounts", "net_sales", "items_sold"]


def _today(as_of) -> dt.date:
    if as_of is None:
        return dt.date.today()
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of)[:10])


def _items_per_order(items: DataFrame) -> DataFrame:
    """Item lines and quantity per order, combined map-side. The report's order filter
    stands on the other side of the join; which side is broadcast, and whether a
    run-time filter prunes the items, is the planner's choice from measured sizes."""
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantity").alias("line_qty"),
    )


def _order_measure_rows(orders: DataFrame, items: DataFrame, start, end, branch_id, channel_id,
                        fan_out: bool, bucket: Column | None) -> DataFrame:
    o = orders.filter(not_cancelled("order_status") & day_range("created_at", start, end))
    o = optional_filters(o, {"branch_id": branch_id, "sales_channel_id": channel_id})
    o = o.select("id", "created_at", "total_amount", "discount_amount")
    per_order = o.join(_items_per_order(items), o["id"] == F.col("order_id"), "left")
    # T1: the reference sums order amounts after joining the items, so each
    # order counts once per item line (at least once).
    mult = F.greatest(F.coalesce(F.col("n_lines"), F.lit(0)), F.lit(1)) if fan_out else F.lit(1)
    total = F.col("total_amount")
    disc = F.col("discount_amount")
    cols = [] if bucket is None else [bucket.alias("period")]
    return per_order.select(
        *cols,
        F.lit(1).cast("bigint").alias("order_count"),
        ((total + F.coalesce(disc, F.lit(0))) * mult).alias("gross_sales"),
        (disc * mult).alias("total_discounts"),
        (total * mult).alias("net_sales"),
        F.col("line_qty").cast("bigint").alias("items_sold"),
    )


def _prepaid_measure_rows(prepaid: DataFrame, start, end, branch_id, bucket: Column | None) -> DataFrame:
    p = prepaid.filter(day_range("created_at", start, end))
    p = optional_filters(p, {"branch_id": branch_id})
    cols = [] if bucket is None else [bucket.alias("period")]
    counted = F.when(F.col("id").isNotNull(), 1).otherwise(0).cast("bigint")
    return p.select(
        *cols,
        counted.alias("order_count"),
        money_out("gross_amount").alias("gross_sales"),
        zero_money().alias("total_discounts"),
        money_out("gross_amount").alias("net_sales"),
        counted.alias("items_sold"),
    )


def _sum_measures() -> list[Column]:
    return [
        F.coalesce(F.sum("order_count"), F.lit(0)).cast("bigint").alias("order_count"),
        F.coalesce(F.sum("gross_sales"), zero_money()).cast(MONEY_OUT).alias("gross_sales"),
        F.coalesce(F.sum("total_discounts"), zero_money()).cast(MONEY_OUT).alias("total_discounts"),
        F.coalesce(F.sum("net_sales"), zero_money()).cast(MONEY_OUT).alias("net_sales"),
        F.coalesce(F.sum("items_sold"), F.lit(0)).cast("bigint").alias("items_sold"),
    ]


def _bucket(unit: str) -> Column:
    """Period bucket of ``created_at``. ``date_trunc`` yields a zoned
    timestamp; casting back to TIMESTAMP_NTZ keeps the wall-clock bucket, so
    results do not depend on the session or client time zone."""
    c = F.col("created_at")
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def sales_summary(orders: DataFrame, items: DataFrame, prepaid: DataFrame, period: str = "daily",
                  start=None, end=None, branch_id=None, channel_id=None, as_of=None,
                  fan_out: bool = True) -> DataFrame:
    """Per period bucket: order_count, gross_sales, total_discounts, net_sales,
    items_sold over non-cancelled orders and prepaid sales (prepaid left out
    when a channel is given: it has no channel). ``fan_out=True`` keeps the
    reference's per-item repetition of order amounts (T1)."""
    unit, start, end = resolve_report_dates(period, start, end, _today(as_of))
    include_prepaid = channel_id is None or channel_id == ""
    rows = _order_measure_rows(orders, items, start, end, branch_id, channel_id, fan_out, _bucket(unit))
    if include_prepaid:
        rows = rows.unionByName(_prepaid_measure_rows(prepaid, start, end, branch_id, _bucket(unit)))
    return rows.groupBy("period").agg(*_sum_measures()).orderBy("period")


def sales_summary_order_grain(orders: DataFrame, items: DataFrame, prepaid: DataFrame, period: str = "daily",
                              start=None, end=None, branch_id=None, channel_id=None, as_of=None) -> DataFrame:
    """``sales_summary`` with each order counted once (T1 corrected)."""
    return sales_summary(orders, items, prepaid, period, start, end, branch_id, channel_id, as_of, fan_out=False)


def sales_overview(orders: DataFrame, items: DataFrame, prepaid: DataFrame, start=None, end=None,
                   branch_id=None, channel_id=None, as_of=None, fan_out: bool = True) -> DataFrame:
    """One KPI row: the five sales measures plus avg_order_value = net / count
    (0 when there is no order). Both sources go through one global aggregate,
    so the row exists even for an empty range."""
    s, e = check_date_range(start, end)
    today = _today(as_of)
    s, e = s or today, e or today
    include_prepaid = channel_id is None or channel_id == ""
    rows = _order_measure_rows(orders, items, s, e, branch_id, channel_id, fan_out, None)
    if include_prepaid:
        rows = rows.unionByName(_prepaid_measure_rows(prepaid, s, e, branch_id, None))
    totals = rows.agg(*_sum_measures())
    n = F.col("order_count")
    # T13: NUMERIC / BIGINT has engine-specific decimal scales; use double.
    avg = F.when(n == 0, F.lit(0.0)).otherwise(F.col("net_sales").cast("double") / n.cast("double"))
    return totals.select(*SALES_MEASURES, avg.alias("avg_order_value"))


def payment_breakdown(payments: DataFrame, orders: DataFrame, prepaid: DataFrame, start=None, end=None,
                      branch_id=None, as_of=None) -> DataFrame:
    """Per payment method: transaction_count and total_amount of payments of
    non-cancelled orders (by payment date), plus one 'cash' row for all
    prepaid sales (by sale date) that exists even with no sale (T3)."""
    s, e = check_date_range(start, end)
    today = _today(as_of)
    s, e = s or today, e or today
    o = optional_filters(orders.filter(not_cancelled("order_status")), {"branch_id": branch_id}).select("id")
    p = payments.filter(day_range("payment_date", s, e))
    # orders.id is the primary key, so an inner join is the existence test;
    # unlike a semi join it lets the planner broadcast either side, i.e. the
    # window's payments rather than the whole order table
    o = o.select(F.col("id").alias("__oid"))
    p = p.join(o, p["order_id"] == o["__oid"], "inner").drop("__oid")
    by_method = p.groupBy(F.col("payment_method").cast("string").alias("payment_method")).agg(
        F.count("id").alias("transaction_count"),
        F.coalesce(F.sum("amount"), zero_money()).cast(MONEY_OUT).alias("total_amount"),
    )
    pp = optional_filters(prepaid.filter(day_range("created_at", s, e)), {"branch_id": branch_id})
    cash = pp.agg(
        F.count("id").alias("transaction_count"),
        F.coalesce(F.sum("gross_amount"), zero_money()).cast(MONEY_OUT).alias("total_amount"),
    ).select(F.lit("cash").alias("payment_method"), "transaction_count", "total_amount")
    return (by_method.unionByName(cash)
            .groupBy("payment_method")
            .agg(F.sum("transaction_count").cast("bigint").alias("transaction_count"),
                 F.coalesce(F.sum("total_amount"), zero_money()).cast(MONEY_OUT).alias("total_amount"))
            .orderBy(F.desc("total_amount"), F.asc("payment_method")))


def resolve_limit(limit, default: int = 10, cap: int | None = None) -> int:
    """``Number(limit) || default``, at most ``cap`` where one is given (the API's rule, not a
    batch's); negative limits are refused."""
    try:
        n = int(float(limit)) if limit not in (None, "") else 0
    except (TypeError, ValueError):
        n = 0
    if n < 0:
        raise ReportArgumentError("limit must not be negative")
    return min(n or default, cap) if cap is not None else n or default


TOP_PRODUCT_KEYS = ["product_variant_id", "sku", "product_name", "size", "color", "class"]


def top_products(items: DataFrame, orders: DataFrame, variants: DataFrame, products: DataFrame,
                 prepaid: DataFrame, catalog: DataFrame, start=None, end=None, branch_id=None,
                 limit=10, as_of=None, cap: int | None = None) -> DataFrame:
    """Top-k variants by revenue: units_sold and total_revenue of items of
    non-cancelled orders, with prepaid products mixed in (class
    'prepaid_load', sku = product code, size/color ''). Items whose variant is
    gone form one NULL group (T7). Ties are broken by class then id (T9)."""
    k = resolve_limit(limit, cap=cap)
    s, e = check_date_range(start, end)
    today = _today(as_of)
    s, e = s or today, e or today
    o = optional_filters(orders.filter(not_cancelled("order_status") & day_range("created_at", s, e)),
                         {"branch_id": branch_id}).select("id")
    sold = (items.join(o, items["order_id"] == o["id"], "left_semi")
            .groupBy("product_variant_id")
            .agg(F.sum("quantity").alias("units"), F.sum("subtotal").alias("revenue")))
    pv = variants.select(F.col("id").alias("pv_id"), "sku", "size", "color", "class",
                         F.col("product_id").alias("pv_product_id"))
    pr = products.select(F.col("id").alias("p_id"), "product_name")
    variant_rows = (sold.join(pv, sold["product_variant_id"] == pv["pv_id"], "left")
                    .join(pr, F.col("pv_product_id") == pr["p_id"], "left")
                    .select(F.col("pv_id").alias("product_variant_id"), F.col("sku").cast("string").alias("sku"),
                            F.col("product_name").cast("string").alias("product_name"),
                            F.col("size").cast("string").alias("size"), F.col("color").cast("string").alias("color"),
                            F.col("class").cast("string").alias("class"), "units", "revenue"))
    pp = optional_filters(prepaid.filter(day_range("created_at", s, e)), {"branch_id": branch_id})
    pp_sold = pp.groupBy("product_id").agg(F.count("id").alias("units"), F.sum("gross_amount").alias("revenue"))
    cat = catalog.select(F.col("id").alias("c_id"), "product_code", F.col("product_name").alias("c_name"))
    prepaid_rows = (pp_sold.join(cat, pp_sold["product_id"] == cat["c_id"], "left")
                    .select(F.col("product_id").cast(variant_rows.schema["product_variant_id"].dataType)
                            .alias("product_variant_id"),
                            F.col("product_code").cast("string").alias("sku"),
                            F.col("c_name").cast("string").alias("product_name"),
                            F.lit("").alias("size"), F.lit("").alias("color"), F.lit("prepaid_load").alias("class"),
                            "units", "revenue"))
    return (variant_rows.unionByName(prepaid_rows)
            .groupBy(*TOP_PRODUCT_KEYS)
            .agg(F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("units_sold"),
                 F.coalesce(F.sum("revenue"), zero_money()).cast(MONEY_OUT).alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), F.asc_nulls_last("class"), F.asc_nulls_last("product_variant_id"),
                     F.asc_nulls_last("sku"))
            .limit(k))


#: Rows before a page's end up to which it is a top-k; beyond it, partitions are counted instead.
DEEP = 10_000


def _page(df: DataFrame, order: list[Column], limit, offset) -> DataFrame:
    """The whole frame in order, or a page of it: a top-k of ``offset + limit`` rows near the beginning, else
    ``_deep_page``. An offset without a limit is refused."""
    if limit is None:
        if offset:
            raise ReportArgumentError("offset needs a limit")
        return df.orderBy(*order)
    if int(offset or 0) + int(limit) > DEEP:
        return _deep_page(df, order, int(limit), int(offset or 0))
    df = df.orderBy(*order)
    return (df.offset(int(offset)) if offset else df).limit(int(limit))


def _deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page far into the order, no row of which passes through one task: the rows are ranged by the order into
    sorted partitions (checkpointed, so that their borders stay), the partitions are counted, and the page's rows are picked by
    partition and place in it. The driver gets one count for each partition."""
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())  # partition << 33 | place
    counts = placed.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    page, before = F.lit(False), 0
    for c in counts:
        low, high = max(offset - before, 0), min(offset + limit - before, c.n)
        if low < high:
            page = page | F.col("__at").between((c.part << 33) + low, (c.part << 33) + high - 1)
        before += c.n
    return placed.filter(page).drop("__at").orderBy(*order)


def purchase_orders_with_totals(pos: DataFrame, po_items: DataFrame, where: str | None = None,
                                limit=None, offset=0) -> DataFrame:
    """All PO columns plus items_total = Σ quantity·cost_price (a NULL cost
    drops the line, T29) and items_count, newest id first (all, or a page). ``where`` is a
    Spark boolean expression over PO columns (an expression, never a
    statement: T31). A page is taken from the orders first, and only its items are totalled."""
    p = _page(pos.filter(F.expr(where)) if where else pos, [F.desc("id")], limit, offset)
    lines = po_items
    if limit is not None:
        ids = p.select(F.col("id").alias("__pid"))
        lines = po_items.join(ids, po_items["purchase_order_id"] == ids["__pid"], "left_semi")
    agg = lines.groupBy(F.col("purchase_order_id").alias("__po")).agg(
        F.sum(F.col("quantity") * F.col("cost_price")).alias("__total"),
        F.count(F.lit(1)).alias("__count"),
    )
    out = (p.join(agg, p["id"] == agg["__po"], "left")
           .withColumn("items_total", F.coalesce(F.col("__total"), zero_money()).cast(MONEY_OUT))
           .withColumn("items_count", F.coalesce(F.col("__count"), F.lit(0)).cast("bigint"))
           .drop("__po", "__total", "__count"))
    return out.orderBy(F.desc("id"))


def purchase_order_variance(pos: DataFrame, estimates: DataFrame, po_items: DataFrame) -> DataFrame:
    """Per PO: estimated_total (Σ estimate costs), actual_total
    (Σ quantity·cost_price) and variance = actual − estimated; POs without
    estimates or items get 0."""
    est = estimates.groupBy(F.col("purchase_order_id").alias("__e_po")).agg(
        F.sum("estimated_total_cost").alias("__est"))
    act = po_items.groupBy(F.col("purchase_order_id").alias("__a_po")).agg(
        F.sum(F.col("quantity") * F.col("cost_price")).alias("__act"))
    p = pos.select(F.col("id").alias("purchase_order_id"))
    out = (p.join(est, p["purchase_order_id"] == est["__e_po"], "left")
           .join(act, p["purchase_order_id"] == act["__a_po"], "left"))
    e_tot = F.coalesce(F.col("__est"), zero_money()).cast(MONEY_OUT)
    a_tot = F.coalesce(F.col("__act"), zero_money()).cast(MONEY_OUT)
    return out.select("purchase_order_id", e_tot.alias("estimated_total"), a_tot.alias("actual_total"),
                      (a_tot - e_tot).cast(MONEY_OUT).alias("variance"))


def variants_with_product(variants: DataFrame, products: DataFrame, product_id=None, is_active=None,
                          limit=None, offset=0) -> DataFrame:
    """Variant rows (all, or a page) with a nested ``product: {name}``, newest first (NULL
    created_at first, as PostgreSQL sorts DESC), optional product and
    is_active ('true'/'1' text) filters."""
    v = variants
    if product_id not in (None, ""):
        v = v.filter(F.col("product_id") == F.lit(product_id))
    if is_active is not None:
        # any given value filters: 'true' / '1' (or True) mean active, anything else inactive
        flag = truthy_text(F.lit(str(is_active).lower() if isinstance(is_active, bool) else str(is_active)))
        v = v.filter(F.col("is_active") == flag)
    order = [F.desc_nulls_first("created_at"), F.asc("id")]
    v = _page(v, order, limit, offset)  # the join is 1:1 and adds no row
    p = products.select(F.col("id").alias("__p_id"), F.col("product_name").alias("__p_name"))
    out = (v.join(p, v["product_id"] == p["__p_id"], "left")
           .withColumn("product", F.struct(F.col("__p_name").alias("name")))
           .drop("__p_id", "__p_name"))
    return out.orderBy(*order)
