"""Driver queries for the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from .registry import register

# Whole date range of the driver tables (orders 1995-01 .. 2001-08, shipped
# to 2001-11; the ledgers are shifted into January 1996).
FROM, TO, AS_OF = "1995-01-01", "2001-12-31", "2001-12-31"


def _facts_sql(start: str, stop: str, orders: str = "", prepaid: str | None = "") -> str:
    """Facts one by one, before any grouping: ``sale`` has an order a row with its line count and units,
    ``load`` a prepaid sale a row (none when ``prepaid`` is None)."""
    window = f"created_at >= TIMESTAMP '{start} 00:00:00' AND created_at < TIMESTAMP '{stop} 00:00:00' + INTERVAL 1 DAY"
    return f"""
, per_order AS (SELECT order_id, COUNT(*) AS lines, SUM(quantity) AS units FROM r_items GROUP BY order_id),
sale AS (
  SELECT created_at AS sold_at, total_amount AS net, COALESCE(discount_amount, 0) AS disc, units,
         GREATEST(COALESCE(lines, 0), 1) AS lines
  FROM r_orders LEFT JOIN per_order ON order_id = id
  WHERE COALESCE(order_status <> 'cancelled', FALSE) AND {window} {orders}
),
load AS (SELECT created_at AS sold_at, gross_amount AS net FROM r_prepaid WHERE {window} {prepaid if prepaid is not None else 'AND FALSE'})"""


def _measures_sql(s: str, p: str, weight: str) -> str:
    """The five measures over filtered facts; ``weight`` repeats an order's money (T1)."""
    return f"""
       (SELECT COUNT(*) FROM sale {s}) + (SELECT COUNT(*) FROM load {p}) AS order_count,
       CAST(COALESCE((SELECT SUM((net + disc) * {weight}) FROM sale {s}), 0) + COALESCE((SELECT SUM(net) FROM load {p}), 0)
            AS DECIMAL(38,2)) AS gross_sales,
       CAST(COALESCE((SELECT SUM(disc * {weight}) FROM sale {s}), 0) AS DECIMAL(38,2)) AS total_discounts,
       CAST(COALESCE((SELECT SUM(net * {weight}) FROM sale {s}), 0) + COALESCE((SELECT SUM(net) FROM load {p}), 0)
            AS DECIMAL(38,2)) AS net_sales,
       CAST(COALESCE((SELECT SUM(units) FROM sale {s}), 0) AS BIGINT) + (SELECT COUNT(*) FROM load {p}) AS items_sold"""


def _summary_sql(unit: str, fan_out: bool, with_prepaid: bool, extra: str = "", start: str = FROM, stop: str = TO,
                 prepaid: str = "") -> str:
    """A spine of the periods that occur, and each measure looked up per period."""
    of = f"WHERE date_trunc('{unit}', sold_at) = spine.period"
    return f"""{_facts_sql(start, stop, extra, prepaid if with_prepaid else None)},
spine AS (SELECT DISTINCT date_trunc('{unit}', sold_at) AS period FROM (SELECT sold_at FROM sale UNION ALL SELECT sold_at FROM load))
SELECT period,{_measures_sql(of, of, "lines" if fan_out else "1")}
FROM spine"""


def _overview_sql(extra: str = "", with_prepaid: bool = True) -> str:
    return f"""{_facts_sql(FROM, TO, extra, "" if with_prepaid else None)},
kpi AS (SELECT{_measures_sql("", "", "lines")})
SELECT *, CASE WHEN order_count = 0 THEN 0.0 ELSE CAST(net_sales AS DOUBLE) / order_count END AS avg_order_value FROM kpi"""


@register("sales_summary", ["r_orders", "r_items", "r_prepaid"], _summary_sql("month", True, True))
def q_sales_summary(a):
    """Monthly sales summary over the whole order history (reference fan-out)."""
    return R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "monthly", FROM, TO, as_of=AS_OF)


@register("sales_summary_order_grain", ["r_orders", "r_items", "r_prepaid"], _summary_sql("week", False, True))
def q_sales_summary_order_grain(a):
    """Weekly sales summary with each order counted once."""
    return R.sales_summary_order_grain(a.r_orders, a.r_items, a.r_prepaid, "weekly", FROM, TO, as_of=AS_OF)


@register("sales_summary_by_channel", ["r_orders", "r_items", "r_prepaid"],
          _summary_sql("year", True, False, "AND sales_channel_id = '1-URGENT'"))
def q_sales_summary_by_channel(a):
    """Yearly summary for one sales channel: prepaid sales drop out (T2)."""
    return R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "yearly", FROM, TO, channel_id="1-URGENT",
                           as_of=AS_OF)


@register("sales_summary_daily_branch", ["r_orders", "r_items", "r_prepaid"],
          _summary_sql("day", True, True, "AND branch_id = 7", "1995-12-03", "1996-01-01", "AND branch_id = 7"))
def q_sales_summary_daily_branch(a):
    """Default 'daily' window (30 days back from as_of) for one branch."""
    return R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "daily", branch_id=7, as_of="1996-01-01")


@register("sales_overview", ["r_orders", "r_items", "r_prepaid"], _overview_sql())
def q_sales_overview(a):
    """KPI row over the whole order history."""
    return R.sales_overview(a.r_orders, a.r_items, a.r_prepaid, FROM, TO)


def _payments_sql(branch: str = "") -> str:
    """The methods that occur, cash always among them; each one's payments are counted by an EXISTS test on their order."""
    window = f">= TIMESTAMP '{FROM} 00:00:00'", f"< TIMESTAMP '{TO} 00:00:00' + INTERVAL 1 DAY"
    return f"""
, paid AS (
  SELECT payment_method AS m, amount FROM r_payments p
  WHERE payment_date {window[0]} AND payment_date {window[1]}
    AND EXISTS (SELECT 1 FROM r_orders o WHERE o.id = p.order_id AND COALESCE(o.order_status <> 'cancelled', FALSE) {branch})
), loads AS (SELECT gross_amount FROM r_prepaid WHERE created_at {window[0]} AND created_at {window[1]} {branch}),
methods AS (SELECT 'cash' AS m UNION SELECT m FROM paid)
SELECT m AS payment_method,
       COUNT(amount) + CASE WHEN m = 'cash' THEN (SELECT COUNT(*) FROM loads) ELSE 0 END AS transaction_count,
       CAST(COALESCE(SUM(amount), 0) + CASE WHEN m = 'cash' THEN COALESCE((SELECT SUM(gross_amount) FROM loads), 0) ELSE 0 END
            AS DECIMAL(38,2)) AS total_amount
FROM methods LEFT JOIN paid USING (m)
GROUP BY m"""


@register("payment_breakdown", ["r_payments", "r_orders", "r_prepaid"], _payments_sql())
def q_payment_breakdown(a):
    """Payment methods over the whole history; prepaid sales count as cash."""
    return R.payment_breakdown(a.r_payments, a.r_orders, a.r_prepaid, FROM, TO)


def _top_sql(branch: str, k: int) -> str:
    """Units and revenue per variant key alone, named afterwards: a variant that is gone counts under no key."""
    window = f"created_at >= TIMESTAMP '{FROM} 00:00:00' AND created_at < TIMESTAMP '{TO} 00:00:00' + INTERVAL 1 DAY {branch}"
    return f"""
, sold AS (
  SELECT CASE WHEN product_variant_id IN (SELECT id FROM r_variants) THEN product_variant_id END AS key,
         SUM(quantity) AS units, SUM(subtotal) AS revenue
  FROM r_items
  WHERE order_id IN (SELECT id FROM r_orders WHERE COALESCE(order_status <> 'cancelled', FALSE) AND {window})
  GROUP BY 1
), loads AS (SELECT product_id AS key, COUNT(*) AS units, SUM(gross_amount) AS revenue FROM r_prepaid WHERE {window} GROUP BY 1),
named AS (
  SELECT key AS product_variant_id, sku, product_name, size, color, class, units, revenue
  FROM sold LEFT JOIN (SELECT v.*, p.product_name FROM r_variants v LEFT JOIN r_products p ON p.id = v.product_id) d ON d.id = key
  UNION ALL BY NAME
  SELECT key AS product_variant_id, product_code AS sku, product_name, '' AS size, '' AS color, 'prepaid_load' AS class, units, revenue
  FROM loads LEFT JOIN r_prepaid_catalog d ON d.id = key
)
SELECT product_variant_id, sku, product_name, size, color, class, CAST(units AS BIGINT) AS units_sold,
       CAST(revenue AS DECIMAL(38,2)) AS total_revenue
FROM named
ORDER BY total_revenue DESC, class ASC NULLS LAST, product_variant_id ASC NULLS LAST, sku ASC NULLS LAST
LIMIT {k}"""


_TOP_VIEWS = ["r_items", "r_orders", "r_variants", "r_products", "r_prepaid", "r_prepaid_catalog"]


@register("top_products", _TOP_VIEWS, _top_sql("", 10))
def q_top_products(a):
    """Top 10 variants (and prepaid products) by revenue over the whole history."""
    return R.top_products(a.r_items, a.r_orders, a.r_variants, a.r_products, a.r_prepaid,
                          a.r_prepaid_catalog, FROM, TO)


@register("top_products_branch", _TOP_VIEWS, _top_sql("AND branch_id = 3", 500))
def q_top_products_branch(a):
    """Top 500 products of one branch (the API's cap of 100 is not the batch's)."""
    return R.top_products(a.r_items, a.r_orders, a.r_variants, a.r_products, a.r_prepaid,
                          a.r_prepaid_catalog, FROM, TO, branch_id=3, limit=500)


@register("purchase_orders_with_totals", ["r_pos", "r_po_items"], """
SELECT po.*, CAST(COALESCE(SUM(i.quantity * i.cost_price), 0) AS DECIMAL(38,2)) AS items_total,
       CAST(COUNT(i.purchase_order_id) AS BIGINT) AS items_count
FROM r_pos po LEFT JOIN r_po_items i ON i.purchase_order_id = po.id
WHERE status <> 'cancelled'
GROUP BY ALL""")
def q_purchase_orders_with_totals(a):
    """Every non-cancelled PO with its item totals (whole list, newest first)."""
    return R.purchase_orders_with_totals(a.r_pos, a.r_po_items, where="status <> 'cancelled'", limit=None)


@register("purchase_order_variance", ["r_pos", "r_estimates", "r_po_items"], """
SELECT po.id AS purchase_order_id,
       CAST(COALESCE(e.t, 0) AS DECIMAL(38,2)) AS estimated_total,
       CAST(COALESCE(a.t, 0) AS DECIMAL(38,2)) AS actual_total,
       CAST(COALESCE(a.t, 0) - COALESCE(e.t, 0) AS DECIMAL(38,2)) AS variance
FROM r_pos po
LEFT JOIN (SELECT purchase_order_id, SUM(estimated_total_cost) AS t FROM r_estimates GROUP BY 1) e
  ON e.purchase_order_id = po.id
LEFT JOIN (SELECT purchase_order_id, SUM(quantity * cost_price) AS t FROM r_po_items GROUP BY 1) a
  ON a.purchase_order_id = po.id""")
def q_purchase_order_variance(a):
    """Estimated vs actual cost for every PO."""
    return R.purchase_order_variance(a.r_pos, a.r_estimates, a.r_po_items)


@register("variants_with_product", ["r_variants", "r_products"], """
SELECT v.*, p.product_name AS product_name
FROM r_variants v LEFT JOIN r_products p ON p.id = v.product_id
WHERE v.is_active = TRUE""")
def q_variants_with_product(a):
    """Active variants with their product name (nested struct flattened for
    the comparison)."""
    out = R.variants_with_product(a.r_variants, a.r_products, is_active="true", limit=None)
    return out.select(*[c for c in out.columns if c != "product"], F.col("product.name").alias("product_name"))


@register("sales_summary_custom", ["r_orders", "r_items", "r_prepaid"], _summary_sql("day", True, True))
def q_sales_summary_custom(a):
    """'custom' period: day buckets over an explicit range (both dates required)."""
    return R.sales_summary(a.r_orders, a.r_items, a.r_prepaid, "custom", FROM, TO, as_of=AS_OF)


@register("sales_overview_by_channel", ["r_orders", "r_items", "r_prepaid"],
          _overview_sql("AND sales_channel_id = '3-MEDIUM'", False))
def q_sales_overview_by_channel(a):
    """KPI row for one sales channel: prepaid sales drop out (T2)."""
    return R.sales_overview(a.r_orders, a.r_items, a.r_prepaid, FROM, TO, channel_id="3-MEDIUM")


@register("payment_breakdown_branch", ["r_payments", "r_orders", "r_prepaid"], _payments_sql("AND branch_id = 11"))
def q_payment_breakdown_branch(a):
    """Payment methods of one branch (the branch filter applies to prepaid sales too)."""
    return R.payment_breakdown(a.r_payments, a.r_orders, a.r_prepaid, FROM, TO, branch_id=11)


def placed(df):
    """The rows with their place in the frame's own order (a page is small)."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@register("purchase_orders_page", ["r_pos", "r_po_items"], """
, page AS (SELECT * FROM r_pos WHERE status <> 'cancelled' ORDER BY id DESC LIMIT 40 OFFSET 15)
SELECT id, status, ROW_NUMBER() OVER (ORDER BY id DESC) - 1 AS place,
       CAST(COALESCE((SELECT SUM(quantity * cost_price) FROM r_po_items i WHERE i.purchase_order_id = page.id), 0)
            AS DECIMAL(38,2)) AS items_total
FROM page""")
def q_purchase_orders_page(a):
    """A page of purchase orders, in order, with the totals of its items."""
    out = R.purchase_orders_with_totals(a.r_pos, a.r_po_items, "status <> 'cancelled'", 40, 15)
    return placed(out.select("id", "status", "items_total"))


@register("variants_page", ["r_variants", "r_products"], """
, page AS (SELECT * FROM r_variants ORDER BY created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 30)
SELECT page.id, sku, product_name, ROW_NUMBER() OVER (ORDER BY page.created_at DESC NULLS FIRST, page.id) - 1 AS place
FROM page LEFT JOIN r_products p ON p.id = product_id""")
def q_variants_page(a):
    """A page of variants, newest first, unknown creation times leading."""
    out = R.variants_with_product(a.r_variants, a.r_products, limit=50, offset=30)
    return placed(out.select("id", "sku", F.col("product.name").alias("product_name")))
