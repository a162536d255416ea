"""Driver queries for table changes, audits and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NUMBER_TEXT, UUID_ANY
from ..operators import changes as CH
from ..operators import listing as L
from ..operators import partitions as PA
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir
from ..sources import tables as TB
from ..sources.schemas import ENUMS
from .q_reports import placed
from .registry import register

ORDER_STATUSES = ",".join(ENUMS["order_status"])


@register("validate_rows", ["r_order_batch"], f"""
SELECT seq, concat_ws('; ',
  CASE WHEN NOT regexp_matches(customer_id, '{UUID_ANY}')
       THEN 'orders.customer_id must be a UUID' END,
  CASE WHEN order_status IS NULL THEN 'orders.order_status cannot be null' END,
  CASE WHEN order_status NOT IN ('{"','".join(ENUMS["order_status"])}')
       THEN 'orders.order_status must be one of: {ORDER_STATUSES}' END,
  CASE WHEN NOT regexp_matches(TRIM(total_amount), '{NUMBER_TEXT}')
       THEN 'orders.total_amount must be numeric' END) AS errors
FROM r_order_batch""")
def q_validate_rows(a):
    """Incoming order batch (text ids) validated against the orders rules."""
    v = Q.validate_rows(a.r_order_batch, "orders")
    return v.select("seq", F.array_join("errors", "; ").alias("errors"))


@register("audit_domain", ["r_order_batch"], f"""
SELECT 'orders' AS table_name, 'order_status' AS column_name, order_status AS value, COUNT(*) AS row_count
FROM r_order_batch
WHERE order_status IS NOT NULL AND order_status NOT IN ('{"','".join(ENUMS["order_status"])}')
GROUP BY order_status""")
def q_audit_domain(a):
    """Order status values outside the enum."""
    return Q.audit_domain(a.r_order_batch, "orders")


@register("audit_checks", ["r_fee_candidates"], """
SELECT 'min_amount_nonnegative' AS check_name, seq AS row_key FROM r_fee_candidates WHERE min_amount < 0
UNION ALL
SELECT 'max_amount_not_below_min', seq FROM r_fee_candidates WHERE NOT (max_amount IS NULL OR max_amount >= min_amount)
UNION ALL
SELECT 'fee_amount_nonnegative', seq FROM r_fee_candidates WHERE fee_amount < 0""")
def q_audit_checks(a):
    """Fee band CHECK constraints over the proposed bands."""
    return Q.audit_checks(a.r_fee_candidates, "gcash_fee_rules", key="seq")


@register("audit_unique", ["r_deposit_requests"], """
SELECT reference_number, COUNT(*) AS row_count FROM r_deposit_requests
WHERE reference_number IS NOT NULL GROUP BY reference_number HAVING COUNT(*) > 1""")
def q_audit_unique(a):
    """Reference numbers used more than once in the deposit batch."""
    return Q.audit_unique(a.r_deposit_requests, ["reference_number"])


@register("audit_references", ["r_prepaid_requests", "r_prepaid_catalog"], """
SELECT q.seq, q.product_id FROM r_prepaid_requests q
WHERE q.product_id IS NOT NULL AND q.product_id NOT IN (SELECT id FROM r_prepaid_catalog)""")
def q_audit_references(a):
    """Prepaid sale requests naming a product that does not exist."""
    return Q.audit_references(a.r_prepaid_requests, "product_id", a.r_prepaid_catalog).select("seq", "product_id")


def _new_users(a):
    d = a.r_deposit_requests
    return d.select(F.col("seq").alias("id"), F.trim("depositor_name").alias("full_name"),
                    F.col("branch_id"),
                    F.when(F.col("seq") % 7 == 0, F.lit("bogus")).otherwise(F.lit("cashier")).alias("role"))


@register("append_rows", ["r_users", "r_deposit_requests"], """
SELECT id, full_name, phone, branch_id FROM r_users
UNION ALL
SELECT seq, TRIM(depositor_name), NULL, branch_id FROM r_deposit_requests WHERE seq % 7 <> 0""")
def q_append_rows(a):
    """Depositors appended as cashier users; a bad role is refused, the
    role key itself is not a users column and is dropped."""
    _, table = CH.append_rows(a.r_users, _new_users(a), "users")
    return table


@register("apply_patches", ["r_variants", "r_estimates"], """
, top AS (SELECT product_id, MAX(id) AS mid FROM r_estimates GROUP BY product_id),
last AS (
  SELECT e.product_id, MAX(e.estimated_total_cost) AS price, BOOL_OR(e.id % 2 <> 0) AS is_active
  FROM r_estimates e JOIN top t ON t.product_id = e.product_id AND e.id = t.mid
  GROUP BY e.product_id
)
SELECT v.id, COALESCE(l.price, v.price) AS price,
       CASE WHEN l.product_id IS NOT NULL THEN l.is_active ELSE v.is_active END AS is_active, v.sku
FROM r_variants v LEFT JOIN last l ON l.product_id = v.id""")
def q_apply_patches(a):
    """Variant price / active flag patched from the estimate rows (last patch wins)."""
    # estimate ids repeat (lineitem has no unique key): order patches by (id, price)
    p = a.r_estimates.select(F.col("product_id").alias("id"), F.col("estimated_total_cost").alias("price"),
                             (F.col("id") % 2 != 0).alias("is_active"),
                             F.struct(F.col("id"), F.col("estimated_total_cost")).alias("seq"))
    _, table = CH.apply_patches(a.r_variants, p, "id", seq="seq", table="product_variants")
    return table.select("id", "price", "is_active", "sku")


@register("delete_keys", ["r_deposits"], """
SELECT id, reference_number FROM r_deposits
WHERE id NOT IN (SELECT id FROM r_deposits WHERE status = 'reversed')""")
def q_delete_keys(a):
    """Deposits left after deleting every reversed entry."""
    kept, _ = CH.delete_keys(a.r_deposits, a.r_deposits.filter(F.col("status") == "reversed"))
    return kept.select("id", "reference_number")


CANCELLED_SQL = "(SELECT id FROM r_orders WHERE order_status = 'cancelled')"


def _after_delete(a):
    """Orders, items, payments and wallet rows after the cancelled orders are deleted: items and payments
    go with them (CASCADE), wallet rows lose the link (SET NULL)."""
    wallet = a.r_gcash.select("id", "service_type", (F.col("id") % 500).alias("order_id"))
    tables = {"orders": a.r_orders, "order_items": a.r_items, "payments": a.r_payments, "gcash_transactions": wallet}
    return CH.propagate_deletes(tables, "orders", a.r_orders.filter(F.col("order_status") == "cancelled").select("id"))


@register("propagate_deletes", ["r_orders", "r_items", "r_payments", "r_gcash"], f"""
SELECT 'orders' AS table_name, id AS row_id, NULL AS ref, total_amount AS amount FROM r_orders
WHERE id NOT IN {CANCELLED_SQL}
UNION ALL
SELECT 'order_items', order_id, product_variant_id, subtotal FROM r_items WHERE order_id NOT IN {CANCELLED_SQL}
UNION ALL
SELECT 'payments', id, order_id, amount FROM r_payments WHERE order_id NOT IN {CANCELLED_SQL}
UNION ALL
SELECT 'gcash_transactions', id, CASE WHEN id % 500 NOT IN {CANCELLED_SQL} THEN id % 500 END, NULL FROM r_gcash""")
def q_propagate_deletes(a):
    """Every row left after the cancelled orders were deleted, with the actions of the declared foreign keys."""
    out = _after_delete(a)
    money = "decimal(12,2)"

    def rows(name, row_id, ref, amount):
        return out[name].select(F.lit(name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"),
                                (F.col(ref) if ref else F.lit(None)).cast("bigint").alias("ref"),
                                (F.col(amount) if amount else F.lit(None)).cast(money).alias("amount"))

    return (rows("orders", "id", None, "total_amount").unionByName(rows("order_items", "order_id", "product_variant_id", "subtotal"))
            .unionByName(rows("payments", "id", "order_id", "amount")).unionByName(rows("gcash_transactions", "id", "order_id", None)))


@register("propagate_deletes_restrict", ["r_prepaid_catalog", "r_prepaid"], """
, used AS (SELECT DISTINCT product_id FROM r_prepaid)
SELECT c.id, c.id IN (SELECT product_id FROM used) AS refused FROM r_prepaid_catalog c
WHERE NOT EXISTS (SELECT 1 FROM used) OR c.id IS NOT NULL""")
def q_propagate_deletes_restrict(a):
    """Deleting sold catalog products is refused as a whole (RESTRICT); unsold ones go. Every product with the outcome of its own kind of delete."""
    tables = {"prepaid_load_products": a.r_prepaid_catalog, "prepaid_load_transactions": a.r_prepaid}
    sold = a.r_prepaid.select(F.col("product_id").alias("id")).distinct()
    try:
        CH.propagate_deletes(tables, "prepaid_load_products", sold)
        refused = False
    except CH.DeleteRefused:
        refused = True
    unsold = a.r_prepaid_catalog.select("id").join(sold, "id", "left_anti")
    left = CH.propagate_deletes(tables, "prepaid_load_products", unsold)["prepaid_load_products"]
    kept = left.select("id").withColumn("refused", F.lit(refused))
    return a.r_prepaid_catalog.select("id").join(kept, "id", "left").select("id", F.coalesce("refused", F.lit(False)).alias("refused"))


@register("append_rows_outcome", ["r_deposit_requests"], """
SELECT seq AS id, CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS n_errors FROM r_deposit_requests""")
def q_append_rows_outcome(a):
    """The outcome of the append: each row with the number of rules it breaks."""
    outcome, _ = CH.append_rows(a.r_users, _new_users(a), "users")
    return outcome.select("id", F.size("errors").alias("n_errors"))


@register("append_rows_defaults", ["r_deposit_requests"], """
SELECT seq AS id, branch_id, 'pending' AS order_status, CAST(0 AS DECIMAL(12,2)) AS total_amount,
       CAST(0 AS DECIMAL(12,2)) AS discount_amount
FROM r_deposit_requests""")
def q_append_rows_defaults(a):
    """Orders appended with a number and a branch only: status and amounts take the table's defaults."""
    empty = a.r_orders.select("id", "branch_id", "order_status", "total_amount", "discount_amount").limit(0)
    _, table = CH.append_rows(empty, a.r_deposit_requests.select(F.col("seq").alias("id"), "branch_id"), "orders")
    return table


@register("apply_patches_repeated", ["r_variants", "r_estimates"], """
SELECT v.id, COALESCE(MAX(e.estimated_total_cost), MAX(v.price)) AS price
FROM r_variants v LEFT JOIN r_estimates e ON e.product_id = v.id
GROUP BY v.id""")
def q_apply_patches_repeated(a):
    """Many patches of one key without an order: one row a key, the largest value wins."""
    p = a.r_estimates.select(F.col("product_id").alias("id"), F.col("estimated_total_cost").alias("price"))
    _, table = CH.apply_patches(a.r_variants, p, "id")
    return table.select("id", "price")


@register("delete_keys_returned", ["r_deposits"], """
SELECT id, reference_number, amount FROM r_deposits WHERE status = 'reversed'""")
def q_delete_keys_returned(a):
    """The rows that a delete returns."""
    _, gone = CH.delete_keys(a.r_deposits, a.r_deposits.filter(F.col("status") == "reversed"))
    return gone.select("id", "reference_number", "amount")


@register("audit_checks_missing_column", ["r_fee_candidates"], """
SELECT 'min_amount_nonnegative' AS check_name, seq AS row_key FROM r_fee_candidates WHERE min_amount < 0
UNION ALL SELECT 'max_amount_not_below_min', seq FROM r_fee_candidates WHERE max_amount < min_amount
UNION ALL SELECT 'fee_amount_nonnegative (skipped)', NULL""")
def q_audit_checks_missing_column(a):
    """CHECKs over a table that lacks a checked column: that check is reported as skipped."""
    return Q.audit_checks(a.r_fee_candidates.drop("fee_amount"), "gcash_fee_rules", key="seq")


DEPOSIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("branch_id", T.LongType()),
    T.StructField("cash_reconciliation_id", T.LongType()), T.StructField("business_date", T.DateType()),
    T.StructField("amount", T.DecimalType(12, 2)), T.StructField("bank_account", T.StringType()),
    T.StructField("reference_number", T.StringType()), T.StructField("depositor_name", T.StringType()),
    T.StructField("photo_proof_url", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("reversal_of_id", T.LongType()), T.StructField("notes", T.StringType()),
])


@register("evolve_schema", ["r_deposits_legacy"], """
SELECT id, branch_id, CAST(NULL AS BIGINT) AS cash_reconciliation_id, business_date, amount, bank_account,
       reference_number, depositor_name, photo_proof_url, status, CAST(NULL AS BIGINT) AS reversal_of_id,
       'migrated' AS notes
FROM r_deposits_legacy""")
def q_evolve_schema(a):
    """Legacy deposit rows brought to the current column set."""
    return CH.evolve_schema(a.r_deposits_legacy, DEPOSIT_SCHEMA, {"notes": "migrated"})


@register("recent_rows", ["r_gcash"], """
SELECT id, created_at, reference_number FROM r_gcash""")
def q_recent_rows(a):
    """Wallet ledger newest first (whole listing)."""
    return L.recent_rows(a.r_gcash, limit=None).select("id", "created_at", "reference_number")


@register("lookup_by_keys", ["r_orders", "r_wallet_requests"], """
SELECT id, order_number, order_status FROM r_orders
WHERE order_number IN (SELECT CONCAT('ORD-', CAST(seq AS VARCHAR)) FROM r_wallet_requests)""")
def q_lookup_by_keys(a):
    """Orders looked up by order number for a batch of keys."""
    keys = a.r_wallet_requests.select(F.concat(F.lit("ORD-"), F.col("seq").cast("string")).alias("order_number"))
    return L.lookup_by_keys(a.r_orders, keys, "order_number").select("id", "order_number", "order_status")


@register("rows_by_parent", ["r_items", "r_orders"], """
SELECT order_id, product_variant_id, quantity, subtotal FROM r_items
WHERE order_id IN (SELECT id FROM r_orders WHERE order_status = 'returned')""")
def q_rows_by_parent(a):
    """Items of all returned orders."""
    parents = a.r_orders.filter(F.col("order_status") == "returned")
    return L.rows_by_parent(a.r_items, "order_id", parents).select("order_id", "product_variant_id", "quantity",
                                                                  "subtotal")


@register("read_table", [], """
SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem""")
def q_read_table(a):
    """A table read by name with a column schema (projection reaches the scan)."""
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
                           T.StructField("l_quantity", T.DoubleType()),
                           T.StructField("l_shipdate", T.TimestampNTZType())])
    return TB.read_table(a.spark, a.sf_dir, "lineitem", schema)


ENVELOPE_FIELDS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("service_type", T.StringType()),
    T.StructField("reference_number", T.StringType()), T.StructField("principal_amount", T.StringType()),
])


@register("read_envelopes", ["r_wallet_requests"], """
SELECT seq, service_type, reference_number, principal_amount FROM r_wallet_requests""")
def q_read_envelopes(a):
    """Wallet requests written as JSON bodies in three envelope shapes (bare,
    wrapped, plural-wrapped) to the shared checkpoint folder and read back."""
    root = ensure_checkpoint_dir(a.spark)
    if not root:
        raise RuntimeError("read_envelopes needs spark.checkpoint.dir (a shared folder) to write the bodies")
    path = f"{root.rstrip('/')}/envelopes-{uuid.uuid4().hex}"
    r = a.r_wallet_requests
    body = F.struct("seq", "service_type", "reference_number", "principal_amount")
    shaped = (F.when(F.col("seq") % 3 == 0, F.to_json(body))
              .when(F.col("seq") % 3 == 1, F.to_json(F.struct(body.alias("gcash_transaction"))))
              .otherwise(F.to_json(F.struct(body.alias("gcash_transactions")))))
    r.select(shaped.alias("value")).write.text(path)
    return TB.read_envelopes(a.spark, path, "gcash_transaction", ENVELOPE_FIELDS)


@register("lookup_active_products", ["r_catalog_current", "r_prepaid_catalog", "r_prepaid", "r_prepaid_requests"], """
SELECT c.id, c.product_code FROM r_catalog_current c
WHERE c.is_active AND c.id IN (SELECT product_id FROM r_prepaid_requests)""")
def q_lookup_active_products(a):
    """Active catalog products named by the sale requests (point reads of
    active products, re-aimed at a batch of keys)."""
    keys = a.r_prepaid_requests.select(F.col("product_id").alias("id"))
    return L.lookup_by_keys(a.r_catalog_current, keys, "id", active_only=True).select("id", "product_code")


@register("recent_rows_page", ["r_gcash"], """
, page AS (SELECT * FROM r_gcash WHERE service_type = 'cash_in' ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 70 OFFSET 20)
SELECT id, reference_number, ROW_NUMBER() OVER (ORDER BY created_at DESC NULLS FIRST, id DESC) - 1 AS place FROM page""")
def q_recent_rows_page(a):
    """A page of the newest cash-in rows, in order."""
    return placed(L.recent_rows(a.r_gcash, "service_type = 'cash_in'", 70, 20).select("id", "reference_number"))


def _stored_by_day(a):
    """The deposits written in folders by business date, in the shared checkpoint folder."""
    root = ensure_checkpoint_dir(a.spark)
    path = f"{root.rstrip('/')}/deposits-{uuid.uuid4().hex}"
    a.r_deposits.select("id", "business_date", "amount", "status").write.partitionBy("business_date").parquet(path)
    return path


@register("apply_patches_partitioned", ["r_deposits"], """
SELECT id, CASE WHEN status = 'reversed' AND id % 40 = 0 THEN business_date + 3 ELSE business_date END AS business_date, amount,
       CASE WHEN status = 'reversed' THEN 'checked' ELSE status END AS status
FROM r_deposits""")
def q_apply_patches_partitioned(a):
    """Reversed deposits patched where they are stored, some moved to another day's folder; only folders with changed rows are rewritten."""
    path = _stored_by_day(a)
    gone = a.r_deposits.filter(F.col("status") == "reversed")
    moved = F.when(F.col("id") % 40 == 0, F.date_add("business_date", 3)).otherwise(F.col("business_date"))
    PA.patch_partitions(a.spark, path, ["business_date"], gone.select("id", F.lit("checked").alias("status"), moved.alias("business_date")))
    return a.spark.read.parquet(path).select("id", "business_date", "amount", "status")


@register("delete_keys_partitioned", ["r_deposits"], """
SELECT id, business_date, 'kept' AS what FROM r_deposits WHERE status <> 'reversed'
UNION ALL SELECT id, business_date, 'returned' FROM r_deposits WHERE status = 'reversed'""")
def q_delete_keys_partitioned(a):
    """Reversed deposits deleted where they are stored: the rows left and the rows returned."""
    path = _stored_by_day(a)
    gone = PA.delete_from_partitions(a.spark, path, ["business_date"], a.r_deposits.filter(F.col("status") == "reversed"))
    kept = a.spark.read.parquet(path)
    return kept.select("id", "business_date", F.lit("kept").alias("what")).unionByName(gone.select("id", "business_date", F.lit("returned").alias("what")))


@register("read_envelopes_malformed", ["r_wallet_requests"], """
SELECT CASE WHEN seq % 7 = 0 OR seq % 11 = 0 THEN NULL ELSE seq END AS seq,
       CASE WHEN seq % 7 = 0 THEN 'not a JSON object' WHEN seq % 11 = 0 THEN 'a field has another type' END AS reason
FROM r_wallet_requests""")
def q_read_envelopes_malformed(a):
    """Wallet requests as JSON bodies, some cut off and some with text for a number: each line is a row or is set aside, once."""
    root = ensure_checkpoint_dir(a.spark)
    path = f"{root.rstrip('/')}/envelopes-{uuid.uuid4().hex}"
    body = F.to_json(F.struct("seq", "service_type", "reference_number", "principal_amount"))
    body = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"gcash_transaction":'), body, F.lit("}"))).otherwise(body)
    lines = a.r_wallet_requests.select("seq", body.alias("body"))
    cut = F.expr("""CASE WHEN seq % 7 = 0 THEN substring(body, 1, length(body) - 2)
                         WHEN seq % 11 = 0 THEN regexp_replace(body, '"seq":([0-9]+)', '"seq":"no $1"') ELSE body END""")
    lines.select(cut.alias("value")).write.text(path)
    rows, malformed = TB.read_envelopes_checked(a.spark, path, "gcash_transaction", ENVELOPE_FIELDS)
    return rows.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(
        malformed.select(F.lit(None).cast("bigint").alias("seq"), "reason"))


AUDITED = [("order_items", "order_id", "orders"), ("payments", "order_id", "orders"), ("prepaid_requests", "product_id", "prepaid_catalog"),
           ("order_items", "product_variant_id", "variants"), ("deposits", "branch_id", "branches"), ("variants", "product_id", "products")]
AUDITED_VIEWS = {"order_items": "r_items", "payments": "r_payments", "orders": "r_orders", "prepaid_requests": "r_prepaid_requests",
                 "prepaid_catalog": "r_prepaid_catalog", "variants": "r_variants", "deposits": "r_deposits", "branches": "r_branches", "products": "r_products"}


@register("audit_all_references", list(AUDITED_VIEWS.values()), "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{child}' AS child, '{fk}' AS fk, '{parent}' AS parent, COUNT(*) AS row_count FROM {AUDITED_VIEWS[child]} c
WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {AUDITED_VIEWS[parent]} p WHERE p.id = c.{fk})""" for child, fk, parent in AUDITED) + ") WHERE row_count > 0")
def q_audit_all_references(a):
    """Orphans of six foreign keys over nine tables, by one shuffle."""
    return Q.audit_all_references({name: getattr(a, view) for name, view in AUDITED_VIEWS.items()}, AUDITED)


@register("recent_rows_deep", ["r_orders"], """
SELECT id, order_number FROM r_orders ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 60 OFFSET 11000""")
def q_recent_rows_deep(a):
    """A page far down the orders: partitions are counted, no task sees the rows before it."""
    return L.recent_rows(a.r_orders, None, 60, 11_000).select("id", "order_number")
