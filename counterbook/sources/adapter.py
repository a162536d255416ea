"""Adapter: the driver's TPC-H-style tables re-read as back-office tables.

The library's operators take back-office DataFrames (orders, order items,
payments, ledgers ...). The test and bench inputs are the driver's tables, so
each back-office table is one SQL view over them. The same SQL text is run by
Spark (``spark.sql`` with DataFrame arguments, no global temp views) and, as
leading CTEs, by DuckDB in the oracle, so both sides see the same inputs.

Key arithmetic (``key % n``) only shapes attribute values (status, payment
method, injected defects); no view drops rows to make anything cheaper, and
every view grows with the driver tables. Ids keep the driver's BIGINT keys:
joins on 8-byte keys are cheaper than on 36-character UUID text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .catalog import SEED_PRODUCTS

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def _catalog_values() -> str:
    rows = []
    for i, (carrier, code, name, load_type, face, validity, url) in enumerate(SEED_PRODUCTS):
        rows.append(f"({i}, '{carrier}', '{code}', '{name}', '{load_type}', {face}, {validity}, '{url}')")
    return ",\n      ".join(rows)


# The fee band table used by the tests (one open-ended band, one
# inactive band, one band expiring mid-January 1996 and its successor, touching
# bands, and two bands tied on min_amount, one with a NULL created_at).
FEE_RULE_ROWS = """
      (1, 'cash_in', 0.00, 100.00, 5.00, TRUE, NULL, NULL, TSNTZ'1995-06-01 00:00:00'),
      (2, 'cash_in', 100.01, 250.00, 10.00, TRUE, NULL, NULL, TSNTZ'1995-06-01 00:00:00'),
      (3, 'cash_in', 250.01, NULL, 20.00, TRUE, NULL, NULL, TSNTZ'1995-06-02 00:00:00'),
      (4, 'cash_in', 200.00, 300.00, 15.00, FALSE, NULL, NULL, TSNTZ'1995-06-03 00:00:00'),
      (5, 'cash_out', 0.00, 150.00, 8.00, TRUE, NULL, NULL, TSNTZ'1995-06-01 00:00:00'),
      (6, 'cash_out', 150.00, 300.00, 12.00, TRUE, NULL, NULL, TSNTZ'1995-07-01 00:00:00'),
      (7, 'cash_out', 150.00, 300.00, 11.00, TRUE, NULL, NULL, NULL),
      (8, 'cash_out', 300.01, 400.00, 18.00, TRUE, NULL, TSNTZ'1996-01-15 00:00:00', TSNTZ'1995-06-01 00:00:00'),
      (9, 'cash_out', 300.01, 450.00, 25.00, TRUE, TSNTZ'1996-01-15 00:00:00', NULL, TSNTZ'1995-08-01 00:00:00')"""

# name -> (SQL text with {placeholders}, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "r_branches": ("""
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS branch_name, n_nationkey = 0 AS is_main
FROM {nation}""", ("nation",)),

    "r_channels": ("""
SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS channel_name
FROM {orders}""", ("orders",)),

    "r_users": ("""
SELECT c_custkey AS id, c_name AS full_name,
       CONCAT('09', LPAD(CAST(c_custkey AS STRING), 9, '0')) AS phone,
       CAST(c_nationkey AS BIGINT) AS branch_id
FROM {customer}""", ("customer",)),

    "r_orders": ("""
SELECT o.o_orderkey AS id,
       CONCAT('ORD-', CAST(o.o_orderkey AS STRING)) AS order_number,
       o.o_custkey AS customer_id,
       o.o_custkey % 25 AS branch_id,
       o.o_orderpriority AS sales_channel_id,
       CASE WHEN o.o_orderkey % 10 = 0 THEN 'cancelled'
            WHEN o.o_orderkey % 97 = 0 THEN NULL
            WHEN o.o_orderkey % 13 = 0 THEN 'returned'
            WHEN o.o_orderstatus = 'F' THEN 'completed'
            WHEN o.o_orderstatus = 'O' THEN 'pending'
            ELSE 'partially_paid' END AS order_status,
       CAST(o.o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL
            ELSE CAST(o.o_orderkey % 50 AS DECIMAL(12,2)) END AS discount_amount,
       o.o_orderdate AS created_at
FROM {orders} o""", ("orders",)),

    "r_items": ("""
SELECT l_orderkey AS order_id,
       l_partkey AS product_variant_id,
       CAST(l_quantity AS INT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal
FROM {lineitem}""", ("lineitem",)),

    "r_variants": ("""
SELECT p_partkey AS id,
       p_name AS product_id,
       CONCAT('SKU-', CAST(p_partkey AS STRING)) AS sku,
       p_type AS class,
       p_brand AS brand,
       CAST(p_size AS STRING) AS size,
       CAST(NULL AS STRING) AS color,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price,
       p_partkey % 11 <> 0 AS is_active,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            ELSE TSNTZ'1995-01-01 00:00:00' + (p_partkey % 1000) * INTERVAL '1' HOUR END AS created_at
FROM {part}""", ("part",)),

    "r_products": ("""
SELECT DISTINCT p_name AS id, p_name AS product_name, 'active' AS status
FROM {part}""", ("part",)),

    "r_payments": ("""
SELECT o_orderkey AS id,
       o_orderkey AS order_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'cash' WHEN 1 THEN 'gcash' WHEN 2 THEN 'bank_transfer'
                           WHEN 3 THEN 'card' ELSE 'cod' END AS payment_method,
       CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
       o_orderdate + (o_orderkey % 3) * INTERVAL '1' DAY AS payment_date
FROM {orders}""", ("orders",)),

    "r_prepaid_catalog": ("""
SELECT CAST(id AS BIGINT) AS id, carrier, product_code, product_name, load_type,
       CAST(face_value AS DECIMAL(12,2)) AS face_value,
       CAST(0 AS DECIMAL(12,2)) AS markup_amount,
       CAST(validity_days AS INT) AS validity_days,
       TRUE AS is_active, source_url
FROM (VALUES
      """ + _catalog_values() + """
) AS t(id, carrier, product_code, product_name, load_type, face_value, validity_days, source_url)""", ()),

    "r_prepaid": ("""
SELECT event_id AS id,
       CAST(NULL AS BIGINT) AS order_id,
       user_id % 25 AS branch_id,
       user_id AS customer_id,
       CONCAT('09', LPAD(CAST(user_id AS STRING), 9, '0')) AS recipient_mobile_no,
       event_id % 41 AS product_id,
       CAST(value + 1 AS DECIMAL(12,2)) AS face_value,
       CAST(0 AS DECIMAL(12,2)) AS markup_amount,
       CAST(value + 1 AS DECIMAL(12,2)) AS gross_amount,
       CAST(value + 1 AS DECIMAL(12,2)) AS cash_impact,
       CONCAT('PL-', CAST(event_id AS STRING)) AS reference_number,
       ts - INTERVAL '28' YEAR AS created_at
FROM {events}
WHERE event_type = 'signup'""", ("events",)),

    "r_gcash": ("""
SELECT id, branch_id, customer_id, service_type, principal_amount, fee_amount,
       principal_amount + fee_amount AS gross_amount,
       CASE WHEN service_type = 'cash_in' THEN principal_amount + fee_amount
            WHEN id % 9 = 0 THEN -(principal_amount + fee_amount)
            ELSE -principal_amount END AS cash_impact,
       reference_number, created_at
FROM (
  SELECT event_id AS id,
         user_id % 25 AS branch_id,
         user_id AS customer_id,
         CASE WHEN event_type = 'purchase' THEN 'cash_in' ELSE 'cash_out' END AS service_type,
         CAST(value AS DECIMAL(12,2)) AS principal_amount,
         CAST(event_id % 4 * 5 AS DECIMAL(12,2)) AS fee_amount,
         CONCAT('GC-', CAST(event_id AS STRING)) AS reference_number,
         ts - INTERVAL '28' YEAR AS created_at
  FROM {events}
  WHERE event_type IN ('purchase', 'error')
) g""", ("events",)),

    "r_fee_rules": ("""
SELECT CAST(id AS BIGINT) AS id, service_type,
       CAST(min_amount AS DECIMAL(12,2)) AS min_amount,
       CAST(max_amount AS DECIMAL(12,2)) AS max_amount,
       CAST(fee_amount AS DECIMAL(12,2)) AS fee_amount,
       is_active, effective_from, effective_to, created_at
FROM (VALUES""" + FEE_RULE_ROWS + """
) AS t(id, service_type, min_amount, max_amount, fee_amount, is_active, effective_from, effective_to, created_at)""", ()),

    "r_deposits": ("""
SELECT event_id AS id,
       user_id % 25 AS branch_id,
       CAST(NULL AS BIGINT) AS cash_reconciliation_id,
       CAST(ts - INTERVAL '28' YEAR AS DATE) AS business_date,
       CAST(value AS DECIMAL(12,2)) AS amount,
       CONCAT('ACCT-', CAST(user_id % 25 AS STRING)) AS bank_account,
       CONCAT('BD-', CAST(event_id AS STRING)) AS reference_number,
       CONCAT('Depositor ', CAST(user_id AS STRING)) AS depositor_name,
       CONCAT('proof://', CAST(event_id AS STRING)) AS photo_proof_url,
       CASE WHEN event_id % 20 = 0 THEN 'reversed' ELSE 'posted' END AS status,
       CAST(NULL AS BIGINT) AS reversal_of_id,
       CASE WHEN event_id % 20 = 0 THEN 'bank error' END AS reversal_reason,
       CASE WHEN event_id % 20 = 0 THEN user_id END AS reversed_by,
       user_id AS deposited_by,
       ts - INTERVAL '28' YEAR AS deposited_at,
       ts - INTERVAL '28' YEAR AS created_at
FROM {events}
WHERE event_type = 'view'
UNION ALL
SELECT -(event_id + 1) AS id,
       user_id % 25 AS branch_id,
       CAST(NULL AS BIGINT) AS cash_reconciliation_id,
       CAST(ts - INTERVAL '28' YEAR AS DATE) AS business_date,
       -CAST(value AS DECIMAL(12,2)) AS amount,
       CONCAT('ACCT-', CAST(user_id % 25 AS STRING)) AS bank_account,
       CONCAT('BD-R-', CAST(event_id AS STRING)) AS reference_number,
       CONCAT('Depositor ', CAST(user_id AS STRING)) AS depositor_name,
       CONCAT('proof://r/', CAST(event_id AS STRING)) AS photo_proof_url,
       'reversed' AS status,
       event_id AS reversal_of_id,
       'bank error' AS reversal_reason,
       CAST(NULL AS BIGINT) AS reversed_by,
       user_id AS deposited_by,
       ts - INTERVAL '28' YEAR + INTERVAL '1' HOUR AS deposited_at,
       ts - INTERVAL '28' YEAR + INTERVAL '1' HOUR AS created_at
FROM {events}
WHERE event_type = 'view' AND event_id % 20 = 0""", ("events",)),

    # One opened cash drawer per (branch, business day) that saw any wallet,
    # prepaid or deposit activity. Opening counts per denomination are scalar
    # columns; the Spark side folds them into the breakdown array.
    "r_recons": ("""
SELECT branch_id * 100000000 + year(business_date) * 10000 + month(business_date) * 100 + day(business_date) AS id,
       branch_id, business_date,
       CAST(branch_id % 3 AS INT) AS open_q1000,
       CAST(day(business_date) % 4 AS INT) AS open_q500,
       CAST(branch_id % 7 AS INT) AS open_q100,
       CAST(5 AS INT) AS open_q20,
       CASE WHEN branch_id = 3 AND day(business_date) = 5 THEN CAST(-1 AS INT) ELSE CAST(day(business_date) AS INT) END AS open_q1,
       CASE WHEN branch_id % 2 = 0 THEN 'opened by shift lead' END AS notes,
       branch_id AS opened_by,
       CAST(business_date AS TIMESTAMP) + INTERVAL '8' HOUR AS opened_at
FROM (
  SELECT DISTINCT user_id % 25 AS branch_id, CAST(ts - INTERVAL '28' YEAR AS DATE) AS business_date
  FROM {events}
) d""", ("events",)),

    # Closing counts for every second business day (the rest stay open).
    "r_closings": ("""
SELECT id,
       CAST(branch_id % 4 AS INT) AS close_q1000,
       CAST(day(business_date) % 5 AS INT) AS close_q500,
       CAST(branch_id % 9 AS INT) AS close_q100,
       CAST(3 AS INT) AS close_q20,
       CAST(branch_id + day(business_date) AS INT) AS close_q1,
       CASE WHEN day(business_date) % 4 = 0 THEN 'closed late' END AS notes,
       branch_id + 100 AS closed_by,
       CAST(business_date AS TIMESTAMP) + INTERVAL '20' HOUR AS closed_at
FROM {r_recons}
WHERE day(business_date) % 2 = 0""", ("r_recons",)),

    "r_pos": ("""
SELECT po_id AS id,
       supp AS supplier_id,
       supp % 25 AS branch_id,
       CONCAT('PO-', CAST(po_id AS STRING)) AS po_number,
       CASE po_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'estimated' WHEN 2 THEN 'ordered'
                      WHEN 3 THEN 'received' ELSE 'cancelled' END AS status,
       CAST(NULL AS DECIMAL(12,2)) AS total_cost,
       first_ship AS created_at,
       CAST(0 AS DECIMAL(12,2)) AS shipping_cost,
       CAST(0 AS DECIMAL(12,2)) AS tipping_cost,
       CAST(0 AS DECIMAL(12,2)) AS miscellaneous_cost
FROM (
  SELECT l_suppkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS po_id,
         l_suppkey AS supp, MIN(l_shipdate) AS first_ship
  FROM {lineitem}
  GROUP BY l_suppkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate), l_suppkey
) p""", ("lineitem",)),

    "r_po_items": ("""
SELECT l.l_suppkey * 1000 + (year(l.l_shipdate) - 1990) * 12 + month(l.l_shipdate) AS purchase_order_id,
       CASE WHEN l.l_partkey % 19 = 0 THEN NULL ELSE l.l_partkey END AS product_variant_id,
       CAST(l.l_quantity AS INT) AS quantity,
       CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END AS cost_price
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""", ("lineitem", "part")),

    "r_estimates": ("""
SELECT l_orderkey * 8 + l_linenumber AS id,
       l_suppkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS purchase_order_id,
       l_partkey AS product_id,
       CAST(l_quantity AS INT) AS estimated_quantity,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS estimated_total_cost
FROM {lineitem}""", ("lineitem",)),

    # Stock history: one restock movement per item of a received purchase order.
    "r_movements": ("""
SELECT po.branch_id, i.product_variant_id, 'restock' AS movement_type, i.quantity,
       'purchase_order' AS reference_type, po.id AS reference_id, po.created_at
FROM {r_po_items} i JOIN {r_pos} po ON po.id = i.purchase_order_id
WHERE po.status = 'received' AND i.product_variant_id IS NOT NULL""", ("r_po_items", "r_pos")),

    "r_inventories": ("""
SELECT branch_id, product_variant_id, CAST(SUM(quantity) AS INT) AS quantity_on_hand
FROM {r_movements}
GROUP BY branch_id, product_variant_id""", ("r_movements",)),

    # ---- request batches and legacy rows (inputs of the posting / audit operators).
    # Built from the 'click' events so they grow with the data; key arithmetic
    # injects the defects each check must catch.
    "r_deposit_requests": ("""
SELECT event_id AS seq,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN (user_id + 1) % 25
            ELSE user_id % 25 END AS branch_id,
       CASE WHEN event_id % 4 = 0
            THEN (user_id % 25) * 100000000 + year(d) * 10000 + month(d) * 100 + day(d)
            WHEN event_id % 10 = 1 THEN 999 END AS cash_reconciliation_id,
       CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '1996/01/05'
            ELSE CAST(d AS STRING) END AS business_date,
       CASE WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 59 = 0 THEN '1d' WHEN event_id % 61 = 0 THEN 'NaN'
            WHEN event_id % 67 = 0 THEN '100000000000' WHEN event_id % 11 = 0 THEN CAST(-value AS STRING)
            ELSE CAST(value AS STRING) END AS amount,
       CASE WHEN event_id % 19 = 0 THEN '  ' ELSE CONCAT('ACCT-', CAST(user_id % 25 AS STRING)) END AS bank_account,
       CASE WHEN event_id % 23 = 0 THEN CONCAT('BD-', CAST(event_id - 1 AS STRING))
            ELSE CONCAT('DEP-', CAST(event_id - event_id % 2 AS STRING)) END AS reference_number,
       CONCAT(' Depositor ', CAST(user_id AS STRING)) AS depositor_name,
       CONCAT('proof://dep/', CAST(event_id AS STRING)) AS photo_proof_url,
       user_id AS deposited_by,
       ts - INTERVAL '28' YEAR AS deposited_at
FROM (SELECT event_id, user_id, value, ts, CAST(ts - INTERVAL '28' YEAR AS DATE) AS d
      FROM {events} WHERE event_type = 'click') e""", ("events",)),

    "r_reversal_requests": ("""
SELECT event_id AS seq,
       CASE WHEN event_id % 7 = 0 THEN -(event_id - event_id % 2)
            ELSE event_id - 1 - event_id % 2 END AS id,
       CASE WHEN event_id % 29 = 0 THEN '' ELSE 'customer dispute' END AS reversal_reason,
       CASE WHEN event_id % 11 = 0 THEN CONCAT('BD-', CAST(event_id - 1 AS STRING))
            WHEN event_id % 5 = 0 THEN CONCAT('REV-', CAST(event_id - 5 AS STRING))
            ELSE CONCAT('REV-', CAST(event_id AS STRING)) END AS reference_number,
       CONCAT('Teller ', CAST(user_id AS STRING)) AS depositor_name,
       CONCAT('proof://rev/', CAST(event_id AS STRING)) AS photo_proof_url,
       user_id AS deposited_by,
       ts - INTERVAL '28' YEAR + INTERVAL '2' HOUR AS deposited_at
FROM {events}
WHERE event_type = 'click'""", ("events",)),

    "r_wallet_requests": ("""
SELECT event_id AS seq,
       CASE WHEN event_id % 31 = 0 THEN 'bogus' WHEN event_id % 2 = 0 THEN 'cash_in' ELSE 'cash_out' END
         AS service_type,
       CASE WHEN event_id % 37 = 0 THEN ' '
            WHEN event_id % 9 = 0 THEN CONCAT('GC-', CAST(event_id - 1 AS STRING))
            ELSE CONCAT('W-', CAST(event_id - event_id % 3 AS STRING)) END AS reference_number,
       CASE WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 59 = 0 THEN '5d' WHEN event_id % 61 = 0 THEN ' '
            WHEN event_id % 67 = 0 THEN '100000000000000' WHEN event_id % 41 = 0 THEN CAST(-value AS STRING)
            ELSE CAST(value AS STRING) END AS principal_amount,
       user_id % 25 AS branch_id,
       user_id AS customer_id,
       ts - INTERVAL '28' YEAR AS created_at
FROM {events}
WHERE event_type = 'click'""", ("events",)),

    "r_catalog_current": ("""
SELECT id, carrier, product_code, product_name,
       CAST(NULL AS STRING) AS description, load_type,
       face_value + CAST(1 AS DECIMAL(12,2)) AS face_value,
       CAST(id % 3 AS DECIMAL(12,2)) AS markup_amount,
       validity_days,
       id % 10 <> 9 AS is_active, source_url
FROM {r_prepaid_catalog}
WHERE id IN (SELECT product_id FROM {r_prepaid})""", ("r_prepaid_catalog", "r_prepaid")),

    "r_prepaid_requests": ("""
SELECT event_id AS seq,
       CASE WHEN event_id % 43 = 0 THEN NULL ELSE event_id % 45 END AS product_id,
       CASE WHEN event_id % 37 = 0 THEN ''
            WHEN event_id % 8 = 0 THEN CONCAT('PL-', CAST(event_id - 1 AS STRING))
            ELSE CONCAT('P-', CAST(event_id - event_id % 3 AS STRING)) END AS reference_number,
       CASE event_id % 5
            WHEN 0 THEN CONCAT('+63 9', LPAD(CAST(user_id AS STRING), 9, '0'))
            WHEN 1 THEN CONCAT('09', LPAD(CAST(user_id AS STRING), 9, '0'))
            WHEN 2 THEN CONCAT('639', LPAD(CAST(user_id AS STRING), 9, '0'))
            WHEN 3 THEN CONCAT('12345', CAST(user_id AS STRING))
            ELSE '  ' END AS recipient_mobile_no,
       user_id % 25 AS branch_id,
       user_id AS customer_id
FROM {events}
WHERE event_type = 'click'""", ("events",)),

    # Proposed bands: each block of 1000 events proposes bands inside its own
    # 1000-wide amount range, so band density (and overlap pairs per band)
    # stays constant as the data grows.
    "r_fee_candidates": ("""
SELECT event_id AS seq,
       CASE WHEN event_id % 17 = 0 THEN event_id % 9 + 1 END AS id,
       CASE WHEN event_id % 34 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'bogus' WHEN event_id % 2 = 0 THEN 'cash_in'
            ELSE 'cash_out' END AS service_type,
       CASE WHEN event_id % 19 = 0 THEN -5.0 ELSE value + FLOOR(event_id / 1000) * 1000.0 END AS min_amount,
       CASE WHEN event_id % 51 = 0 THEN NULL WHEN event_id % 13 = 0 THEN value + FLOOR(event_id / 1000) * 1000.0 - 10
            ELSE value + FLOOR(event_id / 1000) * 1000.0 + event_id % 3 END AS max_amount,
       CAST(event_id % 10 AS DOUBLE) AS fee_amount,
       event_id % 3 <> 0 AS is_active
FROM {events}
WHERE event_type = 'click'""", ("events",)),

    "r_deposits_legacy": ("""
SELECT id, branch_id, amount,
       CASE WHEN id % 7 = 0 THEN '' ELSE bank_account END AS bank_account,
       CASE WHEN id % 11 = 0 THEN NULL WHEN id % 29 = 0 THEN '' ELSE reference_number END AS reference_number,
       CASE WHEN id % 19 = 0 THEN '' ELSE depositor_name END AS depositor_name,
       CASE WHEN id % 23 = 0 THEN NULL ELSE photo_proof_url END AS photo_proof_url,
       CASE WHEN id % 13 = 0 THEN NULL ELSE business_date END AS business_date,
       CASE WHEN id % 17 = 0 THEN NULL ELSE status END AS status
FROM {r_deposits}""", ("r_deposits",)),

    # Orders as an incoming JSON-like batch (text ids) with injected defects.
    "r_order_batch": ("""
SELECT id AS seq, order_number,
       CASE WHEN id % 101 = 0 THEN 'not-a-uuid'
            ELSE CONCAT(LPAD(LOWER(HEX(customer_id)), 8, '0'), '-0000-4000-8000-',
                        LPAD(LOWER(HEX(customer_id)), 12, '0')) END AS customer_id,
       CONCAT(LPAD(LOWER(HEX(branch_id)), 8, '0'), '-0000-4000-8000-', LPAD(LOWER(HEX(branch_id)), 12, '0'))
         AS branch_id,
       CASE WHEN id % 89 = 0 THEN 'bogus' ELSE order_status END AS order_status,
       CASE WHEN id % 83 = 0 THEN 'abc' WHEN id % 79 = 0 THEN ' ' WHEN id % 73 = 0 THEN '1d' WHEN id % 71 = 0 THEN 'NaN' ELSE CAST(total_amount AS STRING) END
         AS total_amount
FROM {r_orders}""", ("r_orders",)),
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name][0]
    ntz = "TIMESTAMP_NTZ'" if dialect == "spark" else "TIMESTAMP '"
    text = text.replace("TSNTZ'", ntz)
    if dialect == "spark":
        # a DATE cast to TIMESTAMP is zoned in Spark; keep the wall clock
        text = text.replace("CAST(business_date AS TIMESTAMP)", "CAST(business_date AS TIMESTAMP_NTZ)")
    return text


def _deps(name: str, seen: list[str]) -> list[str]:
    for d in VIEWS[name][1]:
        if d in VIEWS and d not in seen:
            _deps(d, seen)
    if name not in seen:
        seen.append(name)
    return seen


def duckdb_ctes(names: list[str]) -> str:
    """``WITH`` clause defining the given adapter views (and what they need)
    over the driver tables registered as DuckDB views."""
    order: list[str] = []
    for n in names:
        _deps(n, order)
    if not order:
        return ""
    parts = []
    for n in order:
        deps = {d: d for d in VIEWS[n][1]}
        parts.append(f"{n} AS ({view_sql(n, 'duckdb').format(**deps)}\n)")
    return "WITH " + ",\n".join(parts)


# Analysed view DataFrames per (application, folder): building a view parses
# and analyses SQL and reads parquet footers on the driver, so queries that
# share inputs share the analysed plans (DataFrames are immutable).
_VIEW_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Adapter:
    """Builds the back-office views for one driver folder as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        try:
            app = spark.sparkContext.applicationId
        except Exception:  # noqa: BLE001 -- Spark Connect sessions have no SparkContext
            app = f"session-{id(spark)}"
        key = (app, self.sf_dir)
        self._cache = _VIEW_CACHE.setdefault(key, {})

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                deps = {d: self.table(d) for d in VIEWS[name][1]}
                self._cache[name] = self.spark.sql(view_sql(name, "spark"), **deps)
            elif name in DRIVER_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise KeyError(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("r_") or name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)


@lru_cache(maxsize=None)
def view_names() -> tuple[str, ...]:
    return tuple(VIEWS)
