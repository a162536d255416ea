"""Driver queries for the cash-drawer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cash as C
from .q_reports import placed
from .registry import register

OPEN_AS_OF = "1996-01-01 06:00:00"
OPEN_COUNTS = {20: "open_q20", 1000: "open_q1000", 1: "open_q1", 500: "open_q500", 100: "open_q100"}
CLOSE_COUNTS = {1: "close_q1", 100: "close_q100", 1000: "close_q1000", 20: "close_q20", 500: "close_q500"}


def recon_key(branch, date):
    return (branch * F.lit(100000000) + F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("bigint")


def openings(a, day_shift: int = 0):
    r = a.r_recons
    d = F.date_add("business_date", day_shift) if day_shift else F.col("business_date")
    return r.select("branch_id", d.alias("business_date"),
                    C.breakdown_from_counts(OPEN_COUNTS).alias("opening_cash_breakdown"),
                    "notes", "opened_by", F.col("id").alias("seq"))


def recons_opened(a):
    """The reconciliation table after every opening request was applied: the
    valid openings (breakdown normalised and totalled) as stored rows. (The
    request path itself, refusals included, is the ``open_days`` query.)"""
    n = C.cash_breakdown(openings(a), "opening_cash_breakdown", "opening_cash_total")
    n = n.filter(F.col("breakdown_error").isNull())
    now = F.lit(OPEN_AS_OF).cast("timestamp_ntz")
    vals = {"id": recon_key(F.col("branch_id"), F.col("business_date")), "branch_id": F.col("branch_id"),
            "business_date": F.col("business_date"), "opening_cash_breakdown": F.col("opening_cash_breakdown"),
            "opening_cash_total": F.col("opening_cash_total"), "notes": F.col("notes"),
            "opened_by": F.col("opened_by"), "closed_by": F.when(F.lit(False), F.col("opened_by"))}
    return n.select(*[(vals[c] if c in vals else C._recon_default(c, now)).alias(c) for c in C.RECON_COLUMNS])


def closings(a):
    c = a.r_closings
    return c.select("id", C.breakdown_from_counts(CLOSE_COUNTS).alias("closing_cash_breakdown"),
                    "notes", "closed_by", "closed_at", F.col("id").alias("seq"))


def totals(a):
    return C.daily_cash_totals(a.r_orders, a.r_payments, a.r_gcash, a.r_prepaid)


def recons_closed(a):
    """Closing run: ledger totals only for the branch-days being closed, then the close itself."""
    recons, close = recons_opened(a), closings(a)
    day_totals = C.daily_cash_totals(a.r_orders, a.r_payments, a.r_gcash, a.r_prepaid, days=C.closing_days(recons, close))
    _, table = C.close_days(recons, close, day_totals)
    return table


NO_ARRAYS = [c for c in C.RECON_COLUMNS if not c.endswith("breakdown")]

# ----------------------------------------------------------------------------- oracle building blocks

TOTALS_SQL = """
, totals AS (
  SELECT branch_id, business_date,
         CAST(COALESCE(SUM(ts), 0) AS DECIMAL(38,2)) AS total_sales_amount,
         CAST(COALESCE(SUM(cs), 0) AS DECIMAL(38,2)) AS cash_sales_amount,
         CAST(COALESCE(SUM(oi), 0) AS DECIMAL(38,2)) AS other_cash_impact_amount,
         CAST(COALESCE(SUM(ci), 0) AS DECIMAL(38,2)) AS gcash_cash_in_total,
         CAST(COALESCE(SUM(co), 0) AS DECIMAL(38,2)) AS gcash_cash_out_total
  FROM (
    SELECT branch_id, CAST(created_at AS DATE) AS business_date, total_amount AS ts,
           CAST(NULL AS DECIMAL(12,2)) AS cs, CAST(NULL AS DECIMAL(12,2)) AS oi,
           CAST(NULL AS DECIMAL(12,2)) AS ci, CAST(NULL AS DECIMAL(12,2)) AS co
    FROM r_orders WHERE order_status <> 'cancelled'
    UNION ALL
    SELECT o.branch_id, CAST(p.payment_date AS DATE), NULL, p.amount, NULL, NULL, NULL
    FROM r_payments p JOIN r_orders o ON o.id = p.order_id
    WHERE p.payment_method = 'cash' AND o.order_status <> 'cancelled'
    UNION ALL
    SELECT branch_id, CAST(created_at AS DATE), NULL, NULL,
           CASE WHEN service_type = 'cash_out' THEN -ABS(COALESCE(principal_amount, 0))
                WHEN service_type = 'cash_in' THEN ABS(COALESCE(gross_amount, cash_impact, 0))
                ELSE COALESCE(cash_impact, 0) END,
           CASE WHEN service_type = 'cash_in' THEN ABS(COALESCE(gross_amount, cash_impact, 0)) ELSE 0 END,
           CASE WHEN service_type = 'cash_out' THEN ABS(COALESCE(principal_amount, cash_impact, 0)) ELSE 0 END
    FROM r_gcash
    UNION ALL
    SELECT branch_id, CAST(created_at AS DATE), NULL, NULL, cash_impact, NULL, NULL FROM r_prepaid
  ) x
  WHERE branch_id IS NOT NULL
  GROUP BY branch_id, business_date
)"""

OPENED_SQL = """
, opened AS (
  SELECT id, branch_id, business_date,
         CAST(1000 * open_q1000 + 500 * open_q500 + 100 * open_q100 + 20 * open_q20 + open_q1 AS DECIMAL(12,2))
           AS opening_cash_total,
         notes, opened_by
  FROM r_recons
  WHERE open_q1000 >= 0 AND open_q500 >= 0 AND open_q100 >= 0 AND open_q20 >= 0 AND open_q1 >= 0
)"""

CLOSED_SQL = OPENED_SQL + TOTALS_SQL + """
, closed AS (
  SELECT r.id, r.branch_id, r.business_date, r.opening_cash_total,
         CASE WHEN c.id IS NULL THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(c.total AS DECIMAL(12,2)) END AS closing_cash_total,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE COALESCE(t.total_sales_amount, 0) END AS DECIMAL(12,2)) AS total_sales_amount,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE COALESCE(t.cash_sales_amount, 0) END AS DECIMAL(12,2)) AS cash_sales_amount,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE COALESCE(t.other_cash_impact_amount, 0) END AS DECIMAL(12,2))
           AS other_cash_impact_amount,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE COALESCE(t.gcash_cash_in_total, 0) END AS DECIMAL(12,2)) AS gcash_cash_in_total,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE COALESCE(t.gcash_cash_out_total, 0) END AS DECIMAL(12,2)) AS gcash_cash_out_total,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE r.opening_cash_total + COALESCE(t.cash_sales_amount, 0)
              + COALESCE(t.other_cash_impact_amount, 0) END AS DECIMAL(12,2)) AS expected_cash_on_hand,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE c.total END AS DECIMAL(12,2)) AS actual_cash_on_hand,
         CAST(CASE WHEN c.id IS NULL THEN 0 ELSE c.total - (r.opening_cash_total + COALESCE(t.cash_sales_amount, 0)
              + COALESCE(t.other_cash_impact_amount, 0)) END AS DECIMAL(12,2)) AS variance_amount,
         CASE WHEN c.id IS NULL THEN FALSE ELSE c.total - (r.opening_cash_total + COALESCE(t.cash_sales_amount, 0)
              + COALESCE(t.other_cash_impact_amount, 0)) < 0 END AS is_short,
         COALESCE(c.notes, r.notes) AS notes, r.opened_by, c.closed_by,
         TIMESTAMP '""" + OPEN_AS_OF + """' AS opened_at, c.closed_at,
         TIMESTAMP '""" + OPEN_AS_OF + """' AS created_at,
         COALESCE(c.closed_at, TIMESTAMP '""" + OPEN_AS_OF + """') AS updated_at
  FROM opened r
  LEFT JOIN (SELECT id, notes, closed_by, closed_at,
                    1000 * close_q1000 + 500 * close_q500 + 100 * close_q100 + 20 * close_q20 + close_q1 AS total
             FROM r_closings) c ON c.id = r.id
  LEFT JOIN totals t ON t.branch_id = r.branch_id AND t.business_date = r.business_date
)"""


@register("daily_cash_totals", ["r_orders", "r_payments", "r_gcash", "r_prepaid"],
          TOTALS_SQL + "\nSELECT * FROM totals")
def q_daily_cash_totals(a):
    """Drawer totals for every branch-day with any activity."""
    return totals(a)


@register("wallet_cash_impact", ["r_gcash"], """
SELECT id, branch_id, CAST(created_at AS DATE) AS business_date,
       CAST(CASE WHEN service_type = 'cash_out' THEN -ABS(COALESCE(principal_amount, 0))
                 WHEN service_type = 'cash_in' THEN ABS(COALESCE(gross_amount, cash_impact, 0))
                 ELSE COALESCE(cash_impact, 0) END AS DECIMAL(12,2)) AS drawer_effect
FROM r_gcash""")
def q_wallet_cash_impact(a):
    """Signed drawer effect of every wallet transaction."""
    g = a.r_gcash
    return g.select("id", "branch_id", F.to_date("created_at").alias("business_date"),
                    C.wallet_cash_impact().cast("decimal(12,2)").alias("drawer_effect"))


@register("repair_cash_out_impact", ["r_gcash"], """
SELECT id, service_type, principal_amount,
       CASE WHEN service_type = 'cash_out' AND cash_impact <> -ABS(principal_amount)
            THEN CAST(-ABS(principal_amount) AS DECIMAL(12,2)) ELSE cash_impact END AS cash_impact,
       COALESCE(service_type = 'cash_out' AND cash_impact <> -ABS(principal_amount), FALSE) AS impact_repaired
FROM r_gcash""")
def q_repair_cash_out_impact(a):
    """Wallet ledger with legacy cash-out impacts repaired."""
    return C.repair_cash_out_impact(a.r_gcash).select("id", "service_type", "principal_amount", "cash_impact",
                                                      "impact_repaired")


@register("cash_breakdown", ["r_recons"], """
, checked AS (
  SELECT id, open_q1000 >= 0 AND open_q500 >= 0 AND open_q100 >= 0 AND open_q20 >= 0 AND open_q1 >= 0 AS ok,
         open_q1000, open_q500, open_q100, open_q20, open_q1
  FROM r_recons
), elems AS (
  SELECT id, 0 AS pos, 1000 AS d, open_q1000 AS q FROM checked WHERE ok
  UNION ALL SELECT id, 1, 500, open_q500 FROM checked WHERE ok
  UNION ALL SELECT id, 2, 100, open_q100 FROM checked WHERE ok
  UNION ALL SELECT id, 3, 20, open_q20 FROM checked WHERE ok
  UNION ALL SELECT id, 4, 1, open_q1 FROM checked WHERE ok
)
SELECT e.id, CAST(e.pos AS INT) AS pos, CAST(e.d AS DECIMAL(12,2)) AS denomination, CAST(e.q AS INT) AS quantity,
       CAST(e.d * e.q AS DECIMAL(12,2)) AS amount,
       CAST(1000 * c.open_q1000 + 500 * c.open_q500 + 100 * c.open_q100 + 20 * c.open_q20 + c.open_q1
            AS DECIMAL(12,2)) AS opening_cash_total,
       CAST(NULL AS VARCHAR) AS breakdown_error
FROM elems e JOIN checked c ON c.id = e.id
UNION ALL
SELECT id, NULL, NULL, NULL, NULL, NULL, '""" + C.ERR_QUANTITY + """'
FROM checked WHERE NOT ok""")
def q_cash_breakdown(a):
    """Opening breakdowns normalised (sorted, amounts, totals), one row per element."""
    r = a.r_recons.select("id", C.breakdown_from_counts(OPEN_COUNTS).alias("opening_cash_breakdown"))
    n = C.cash_breakdown(r, "opening_cash_breakdown", "opening_cash_total")
    x = n.select("id", "opening_cash_total", "breakdown_error",
                 F.posexplode_outer("opening_cash_breakdown").alias("pos", "e"))
    return x.select("id", F.col("pos").cast("int").alias("pos"), F.col("e.denomination").alias("denomination"),
                    F.col("e.quantity").alias("quantity"), F.col("e.amount").alias("amount"),
                    "opening_cash_total", "breakdown_error")


@register("open_days", ["r_recons"], OPENED_SQL + """
SELECT q.branch_id, q.business_date,
       CASE WHEN q.ok THEN CAST(1000 * q.open_q1000 + 500 * q.open_q500 + 100 * q.open_q100 + 20 * q.open_q20
                                + q.open_q1 AS DECIMAL(12,2)) END AS opening_cash_total,
       CASE WHEN NOT q.ok THEN '""" + C.ERR_QUANTITY + """'
            WHEN o.id IS NOT NULL THEN '""" + C.ERR_OPEN_EXISTS + """' END AS reject_reason
FROM (SELECT branch_id, CAST(business_date + INTERVAL 1 DAY AS DATE) AS business_date,
             open_q1000, open_q500, open_q100, open_q20, open_q1,
             open_q1000 >= 0 AND open_q500 >= 0 AND open_q100 >= 0 AND open_q20 >= 0 AND open_q1 >= 0 AS ok
      FROM r_recons) q
LEFT JOIN opened o ON o.branch_id = q.branch_id AND o.business_date = q.business_date""")
def q_open_days(a):
    """Opening requests for the next day of every drawer: existing days are refused."""
    outcome, _ = C.open_days(recons_opened(a), openings(a, 1), "insert", OPEN_AS_OF)
    return outcome.select("branch_id", "business_date", "opening_cash_total", "reject_reason")


@register("open_days_upsert", ["r_recons", "r_closings", "r_orders", "r_payments", "r_gcash", "r_prepaid"],
          CLOSED_SQL + """
, req AS (
  SELECT branch_id, CAST(business_date + INTERVAL 1 DAY AS DATE) AS business_date, notes, opened_by,
         CAST(1000 * open_q1000 + 500 * open_q500 + 100 * open_q100 + 20 * open_q20 + open_q1 AS DECIMAL(12,2)) AS total,
         open_q1000 >= 0 AND open_q500 >= 0 AND open_q100 >= 0 AND open_q20 >= 0 AND open_q1 >= 0 AS ok
  FROM r_recons
), good AS (
  SELECT q.* FROM req q LEFT JOIN closed c ON c.branch_id = q.branch_id AND c.business_date = q.business_date
  WHERE q.ok AND c.closed_at IS NULL
)
SELECT c.branch_id, c.business_date, COALESCE(g.total, c.opening_cash_total) AS opening_cash_total,
       COALESCE(g.notes, c.notes) AS notes, COALESCE(g.opened_by, c.opened_by) AS opened_by,
       c.closed_at IS NOT NULL AS is_closed
FROM closed c LEFT JOIN good g ON g.branch_id = c.branch_id AND g.business_date = c.business_date
UNION ALL
SELECT g.branch_id, g.business_date, g.total, g.notes, g.opened_by, FALSE
FROM good g LEFT JOIN closed c ON c.branch_id = g.branch_id AND c.business_date = g.business_date
WHERE c.id IS NULL""")
def q_open_days_upsert(a):
    """Upsert of next-day openings into the closed table: closed days refuse,
    open days are updated, new days inserted."""
    _, table = C.open_days(recons_closed(a), openings(a, 1), "upsert", "1996-02-01 00:00:00",
                           id_expr=recon_key(F.col("branch_id"), F.col("business_date")))
    return table.select("branch_id", "business_date", "opening_cash_total", "notes", "opened_by",
                        F.col("closed_at").isNotNull().alias("is_closed"))


@register("close_days", ["r_recons", "r_closings", "r_orders", "r_payments", "r_gcash", "r_prepaid"],
          CLOSED_SQL + "\nSELECT * FROM closed")
def q_close_days(a):
    """Every second business day closed against the day's ledger totals."""
    return recons_closed(a).select(*NO_ARRAYS)


REPORT_COLS = ["id", "branch_id", "business_date", "opening_cash_total", *C.TOTAL_COLUMNS,
               "prepaid_load_total", "total_bank_deposit_amount", "expected_cash_on_hand", "actual_cash_on_hand",
               "remaining_cash_on_register", "variance_amount", "is_short", "opened_by", "closed_by", "closed_at",
               "branch_name"]


@register("cash_reconciliation_report",
          ["r_recons", "r_closings", "r_orders", "r_payments", "r_gcash", "r_prepaid", "r_deposits", "r_branches"],
          CLOSED_SQL + """
, rep AS (
  SELECT c.*,
         CAST(COALESCE((SELECT SUM(p.gross_amount) FROM r_prepaid p WHERE p.branch_id = c.branch_id
                        AND p.created_at >= c.business_date AND p.created_at < c.business_date + INTERVAL 1 DAY), 0)
              AS DECIMAL(38,2)) AS prepaid_load_total,
         CAST(COALESCE((SELECT SUM(d.amount) FROM r_deposits d WHERE d.branch_id = c.branch_id
                        AND d.business_date = c.business_date), 0) AS DECIMAL(38,2)) AS total_bank_deposit_amount,
         b.branch_name
  FROM closed c LEFT JOIN r_branches b ON b.id = c.branch_id
)
SELECT id, branch_id, business_date, opening_cash_total, total_sales_amount, cash_sales_amount,
       other_cash_impact_amount, gcash_cash_in_total, gcash_cash_out_total, prepaid_load_total,
       total_bank_deposit_amount, expected_cash_on_hand, actual_cash_on_hand,
       CAST(CASE WHEN closed_at IS NULL THEN NULL
                 ELSE GREATEST(COALESCE(actual_cash_on_hand, 0) - total_bank_deposit_amount, 0) END AS DECIMAL(38,2))
         AS remaining_cash_on_register,
       variance_amount, is_short, opened_by, closed_by, closed_at, branch_name,
       CAST(cash_sales_amount + gcash_cash_in_total AS DECIMAL(38,2)) AS audit_total_cash_inflows,
       CAST(gcash_cash_out_total + total_bank_deposit_amount AS DECIMAL(38,2)) AS audit_total_cash_outflows,
       CAST(CASE WHEN closed_at IS NULL THEN 0
                 ELSE GREATEST(COALESCE(actual_cash_on_hand, 0) - total_bank_deposit_amount, 0) END AS DECIMAL(38,2))
         AS audit_remaining_cash_on_register,
       CAST(other_cash_impact_amount AS DECIMAL(38,2)) AS audit_net_other_cash_impact_amount,
       is_short AS audit_is_short
FROM rep""")
def q_cash_reconciliation_report(a):
    """Report + audit summary for every branch-day (re-aimed from one branch-day)."""
    rep = C.cash_reconciliation_report(recons_closed(a), a.r_branches, a.r_prepaid, a.r_deposits)
    rep = C.audit_summary(rep)
    audit = [F.col(f"audit_summary.{f}").alias(f"audit_{f}") for f in
             ("total_cash_inflows", "total_cash_outflows", "remaining_cash_on_register",
              "net_other_cash_impact_amount", "is_short")]
    return rep.select(*REPORT_COLS, *audit)


@register("reconciliation_register", ["r_recons", "r_closings", "r_orders", "r_payments", "r_gcash", "r_prepaid",
                                      "r_deposits"], CLOSED_SQL + """
, dep AS (SELECT branch_id, business_date, SUM(amount) AS amt FROM r_deposits GROUP BY 1, 2)
SELECT c.id, c.branch_id, c.business_date, c.opening_cash_total, c.actual_cash_on_hand, c.closed_at,
       CAST(COALESCE(d.amt, 0) AS DECIMAL(38,2)) AS total_bank_deposit_amount,
       CAST(CASE WHEN c.closed_at IS NULL THEN NULL
                 ELSE GREATEST(COALESCE(c.actual_cash_on_hand, 0) - COALESCE(d.amt, 0), 0) END AS DECIMAL(38,2))
         AS remaining_cash_on_register
FROM closed c LEFT JOIN dep d ON d.branch_id = c.branch_id AND d.business_date = c.business_date
WHERE c.business_date >= DATE '1996-01-10' AND c.business_date <= DATE '1996-01-20'""")
def q_reconciliation_register(a):
    """Register of all branches for 10-20 January 1996 (whole list)."""
    out = C.reconciliation_register(recons_closed(a), a.r_deposits, start="1996-01-10", end="1996-01-20", limit=None)
    return out.select("id", "branch_id", "business_date", "opening_cash_total", "actual_cash_on_hand", "closed_at",
                      "total_bank_deposit_amount", "remaining_cash_on_register")


AUDIT_SQL_FIELDS = """
       CAST(cash_sales_amount AS DECIMAL(38,2)) AS cash_sales_amount,
       CAST(gcash_cash_in_total AS DECIMAL(38,2)) AS gcash_cash_in_total,
       CAST(gcash_cash_out_total AS DECIMAL(38,2)) AS gcash_cash_out_total,
       prepaid_load_total, total_bank_deposit_amount,
       CAST(other_cash_impact_amount AS DECIMAL(38,2)) AS net_other_cash_impact_amount,
       CAST(cash_sales_amount + gcash_cash_in_total AS DECIMAL(38,2)) AS total_cash_inflows,
       CAST(gcash_cash_out_total + total_bank_deposit_amount AS DECIMAL(38,2)) AS total_cash_outflows,
       CAST(expected_cash_on_hand AS DECIMAL(38,2)) AS expected_cash_on_hand,
       CAST(actual_cash_on_hand AS DECIMAL(38,2)) AS actual_cash_on_hand,
       CAST(CASE WHEN closed_at IS NULL THEN 0
                 ELSE GREATEST(COALESCE(actual_cash_on_hand, 0) - total_bank_deposit_amount, 0) END AS DECIMAL(38,2))
         AS remaining_cash_on_register,
       CAST(variance_amount AS DECIMAL(38,2)) AS variance_amount,
       COALESCE(is_short, FALSE) AS is_short"""


@register("audit_summary",
          ["r_recons", "r_closings", "r_orders", "r_payments", "r_gcash", "r_prepaid", "r_deposits", "r_branches"],
          CLOSED_SQL + """
, rep AS (
  SELECT c.*,
         CAST(COALESCE((SELECT SUM(p.gross_amount) FROM r_prepaid p WHERE p.branch_id = c.branch_id
                        AND CAST(p.created_at AS DATE) = c.business_date), 0) AS DECIMAL(38,2)) AS prepaid_load_total,
         CAST(COALESCE((SELECT SUM(d.amount) FROM r_deposits d WHERE d.branch_id = c.branch_id
                        AND d.business_date = c.business_date), 0) AS DECIMAL(38,2)) AS total_bank_deposit_amount
  FROM closed c
)
SELECT id,""" + AUDIT_SQL_FIELDS + """
FROM rep""")
def q_audit_summary(a):
    """The 13-field audit summary of every branch-day report."""
    rep = C.audit_summary(C.cash_reconciliation_report(recons_closed(a), a.r_branches, a.r_prepaid, a.r_deposits))
    return rep.select("id", "audit_summary.*")


@register("breakdown_json", ["r_recons"], """
, checked AS (
  SELECT id, open_q1000 >= 0 AND open_q500 >= 0 AND open_q100 >= 0 AND open_q20 >= 0 AND open_q1 >= 0 AS ok,
         open_q1000, open_q500, open_q100, open_q20, open_q1
  FROM r_recons
), elems AS (
  SELECT id, 0 AS pos, 1000 AS d, open_q1000 AS q FROM checked WHERE ok
  UNION ALL SELECT id, 1, 500, open_q500 FROM checked WHERE ok
  UNION ALL SELECT id, 2, 100, open_q100 FROM checked WHERE ok
  UNION ALL SELECT id, 3, 20, open_q20 FROM checked WHERE ok
  UNION ALL SELECT id, 4, 1, open_q1 FROM checked WHERE ok
)
SELECT id, CAST(pos AS INT) AS pos, CAST(d AS DECIMAL(12,2)) AS denomination, CAST(q AS INT) AS quantity,
       CAST(d * q AS DECIMAL(12,2)) AS amount
FROM elems""")
def q_breakdown_json(a):
    """Normalised opening breakdowns written as JSON text and parsed back
    (the JSONB edge), one row per element."""
    r = a.r_recons.select("id", C.breakdown_from_counts(OPEN_COUNTS).alias("b"))
    n = C.cash_breakdown(r, "b", "total").filter(F.col("breakdown_error").isNull())
    j = n.select("id", C.breakdown_to_json("b").alias("b_json"))
    back = j.select("id", F.posexplode(C.breakdown_from_json("b_json")).alias("pos", "e"))
    return back.select("id", F.col("pos").cast("int").alias("pos"), "e.denomination", "e.quantity", "e.amount")


@register("open_days_table", ["r_recons"], OPENED_SQL + """
, asked AS (
  SELECT branch_id, CAST(business_date + INTERVAL 1 DAY AS DATE) AS business_date, opened_by,
         1000 * open_q1000 + 500 * open_q500 + 100 * open_q100 + 20 * open_q20 + open_q1 AS total,
         LEAST(open_q1000, open_q500, open_q100, open_q20, open_q1) >= 0 AS ok
  FROM r_recons
)
SELECT branch_id, business_date, opening_cash_total, opened_by FROM opened
UNION ALL
SELECT branch_id, business_date, CAST(total AS DECIMAL(12,2)), opened_by FROM asked a
WHERE ok AND NOT EXISTS (SELECT 1 FROM opened o WHERE o.branch_id = a.branch_id AND o.business_date = a.business_date)""")
def q_open_days_table(a):
    """The reconciliation table after the accepted openings were inserted."""
    _, table = C.open_days(recons_opened(a), openings(a, 1), "insert", OPEN_AS_OF)
    return table.select("branch_id", "business_date", "opening_cash_total", "opened_by")


@register("reconciliation_register_page", ["r_recons", "r_deposits"], OPENED_SQL + """
, page AS (SELECT * FROM opened ORDER BY business_date DESC NULLS FIRST, id LIMIT 45 OFFSET 10)
SELECT page.id, page.business_date, ROW_NUMBER() OVER (ORDER BY page.business_date DESC NULLS FIRST, page.id) - 1 AS place,
       CAST(COALESCE((SELECT SUM(amount) FROM r_deposits d WHERE d.branch_id = page.branch_id
                      AND d.business_date = page.business_date), 0) AS DECIMAL(38,2)) AS total_bank_deposit_amount
FROM page""")
def q_reconciliation_register_page(a):
    """A page of the reconciliation register, in order, with its branch-days' deposits."""
    out = C.reconciliation_register(recons_opened(a), a.r_deposits, limit=45, offset=10)
    return placed(out.select("id", "business_date", F.col("total_bank_deposit_amount").cast("decimal(38,2)").alias("total_bank_deposit_amount")))
