"""Driver queries for deposits, fee bands, wallet and prepaid posting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deposits as D
from ..operators import fees as FE
from ..operators import prepaid as P
from ..sources.catalog import load_catalog
from ..functions.text import NUMBER_TEXT
from .q_cash import OPENED_SQL, recons_opened
from .q_reports import placed
from .registry import ORACLE_BODY, register

POST_AS_OF = "1996-02-01 09:00:00"

NUMBER = NUMBER_TEXT
#: Request text to money in DuckDB: what is no number is 0, what is too large is NULL.
MONEY_TEXT = ("CASE WHEN regexp_matches(TRIM(COALESCE({c}, '')), '" + NUMBER + "')"
              " THEN TRY_CAST(TRY_CAST(TRIM({c}) AS DECIMAL(30,6)) AS DECIMAL(12,2)) ELSE 0 END")


def required(field: str) -> str:
    return D.ERR_REQUIRED.format(field=field)


@register("deposit_net_by_day", ["r_deposits"], """
SELECT branch_id, business_date, CAST(SUM(amount) AS DECIMAL(38,2)) AS total_bank_deposit_amount,
       COUNT(*) AS entry_count
FROM r_deposits GROUP BY branch_id, business_date""")
def q_deposit_net_by_day(a):
    """Deposits net per branch-day; reversed pairs cancel (T17)."""
    return D.deposit_net_by_day(a.r_deposits)


@register("post_deposits", ["r_deposit_requests", "r_recons", "r_deposits"], OPENED_SQL + f"""
, chk AS (
  SELECT q.*, o.id AS rid, o.branch_id AS rbranch, o.business_date AS rdate,
         {MONEY_TEXT.format(c="q.amount")} AS amt,
         NULLIF(TRIM(q.bank_account), '') AS ba, NULLIF(TRIM(q.reference_number), '') AS ref,
         NULLIF(TRIM(q.depositor_name), '') AS dn, NULLIF(TRIM(q.photo_proof_url), '') AS pp
  FROM r_deposit_requests q LEFT JOIN opened o ON o.id = q.cash_reconciliation_id
), pre AS (
  SELECT c.*,
         CASE WHEN c.cash_reconciliation_id IS NOT NULL THEN c.rbranch ELSE c.branch_id END AS fbranch,
         CASE WHEN c.cash_reconciliation_id IS NOT NULL THEN c.rdate
              WHEN regexp_matches(c.business_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(c.business_date AS DATE)
              ELSE DATE '1996-02-01' END AS fdate,
         CASE WHEN c.amt IS NULL THEN '{D.ERR_RANGE.format(field="amount")}'
              WHEN c.amt <= 0 THEN '{D.ERR_AMOUNT}'
              WHEN c.ba IS NULL THEN '{required("bank_account")}'
              WHEN c.ref IS NULL THEN '{required("reference_number")}'
              WHEN c.dn IS NULL THEN '{required("depositor_name")}'
              WHEN c.pp IS NULL THEN '{required("photo_proof_url")}'
              WHEN c.cash_reconciliation_id IS NOT NULL AND c.rid IS NULL THEN '{D.ERR_RECON_NOT_FOUND}'
              WHEN c.cash_reconciliation_id IS NOT NULL AND c.branch_id IS NOT NULL AND c.branch_id <> c.rbranch
                THEN '{D.ERR_BRANCH_MISMATCH}'
              WHEN (CASE WHEN c.cash_reconciliation_id IS NOT NULL THEN c.rbranch ELSE c.branch_id END) IS NULL
                THEN '{D.ERR_BRANCH_REQUIRED}'
              WHEN c.ref IN (SELECT reference_number FROM r_deposits) THEN '{D.ERR_REFERENCE_UNIQUE}'
         END AS why
  FROM chk c
), firsts AS (SELECT ref, MIN(seq) AS m FROM pre WHERE why IS NULL GROUP BY ref)
SELECT p.seq, p.fbranch AS branch_id, p.cash_reconciliation_id, p.fdate AS business_date, p.amt AS amount,
       p.ba AS bank_account, p.ref AS reference_number, p.dn AS depositor_name, p.pp AS photo_proof_url,
       'posted' AS status, CAST(NULL AS VARCHAR) AS notes, p.deposited_by, p.deposited_at,
       COALESCE(p.why, CASE WHEN p.seq <> f.m THEN '{D.ERR_REFERENCE_UNIQUE}' END) AS reject_reason
FROM pre p LEFT JOIN firsts f ON f.ref = p.ref""")
def q_post_deposits(a):
    """Deposit request batch checked against reconciliations and the ledger."""
    return D.post_deposits(a.r_deposit_requests, recons_opened(a), a.r_deposits, POST_AS_OF)


@register("reverse_deposits", ["r_reversal_requests", "r_deposits"], f"""
, chk AS (
  SELECT q.seq, q.id, NULLIF(TRIM(q.reference_number), '') AS ref,
         CASE WHEN NULLIF(TRIM(q.reversal_reason), '') IS NULL THEN '{required("reversal_reason")}'
              WHEN NULLIF(TRIM(q.reference_number), '') IS NULL THEN '{required("reference_number")}'
              WHEN NULLIF(TRIM(q.depositor_name), '') IS NULL THEN '{required("depositor_name")}'
              WHEN NULLIF(TRIM(q.photo_proof_url), '') IS NULL THEN '{required("photo_proof_url")}'
              WHEN o.id IS NULL THEN '{D.ERR_NOT_FOUND}'
              WHEN o.reversal_of_id IS NOT NULL THEN '{D.ERR_REVERSAL_OF_REVERSAL}'
              WHEN o.status = 'reversed' THEN '{D.ERR_ALREADY_REVERSED}'
              WHEN q.id IN (SELECT reversal_of_id FROM r_deposits WHERE reversal_of_id IS NOT NULL)
                THEN '{D.ERR_ALREADY_REVERSED}'
              WHEN TRIM(q.reference_number) IN (SELECT reference_number FROM r_deposits) THEN '{D.ERR_REFERENCE_UNIQUE}'
         END AS why,
         o.amount AS orig_amount
  FROM r_reversal_requests q LEFT JOIN r_deposits o ON o.id = q.id
), cand AS (
  SELECT seq, id, ref, ROW_NUMBER() OVER (ORDER BY seq) AS rn FROM chk WHERE why IS NULL
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS ids,
         CAST([] AS VARCHAR[]) AS refs, CAST(NULL AS VARCHAR) AS msg
  UNION ALL
  SELECT c.rn, c.seq,
         CASE WHEN list_contains(w.ids, c.id) OR list_contains(w.refs, c.ref) THEN w.ids
              ELSE list_append(w.ids, c.id) END,
         CASE WHEN list_contains(w.ids, c.id) OR list_contains(w.refs, c.ref) THEN w.refs
              ELSE list_append(w.refs, c.ref) END,
         CASE WHEN list_contains(w.ids, c.id) THEN '{D.ERR_ALREADY_REVERSED}'
              WHEN list_contains(w.refs, c.ref) THEN '{D.ERR_REFERENCE_UNIQUE}' END
  FROM walk w JOIN cand c ON c.rn = w.rn + 1
)
SELECT c.seq, c.id, c.ref AS ref_trimmed, COALESCE(c.why, w.msg) AS reject_reason,
       CASE WHEN COALESCE(c.why, w.msg) IS NULL THEN CAST(-ABS(c.orig_amount) AS DECIMAL(12,2)) END AS contra_amount
FROM chk c LEFT JOIN walk w ON w.seq = c.seq""", recursive=True)
def q_reverse_deposits(a):
    """Reversal batch: guards, in-batch serial order, contra amounts."""
    outcome, ledger = D.reverse_deposits(a.r_reversal_requests, a.r_deposits, POST_AS_OF)
    contra = ledger.filter(F.col("created_at") == F.lit(POST_AS_OF).cast("timestamp_ntz")).select(
        F.col("reference_number").alias("__cref"), F.col("amount").alias("contra_amount"))
    o = outcome.select("seq", "id", "ref_trimmed", "reject_reason")
    return o.join(contra, (o["ref_trimmed"] == contra["__cref"]) & o["reject_reason"].isNull(), "left").drop("__cref")


@register("reverse_deposits_ledger", ["r_reversal_requests", "r_deposits"], f"""
, chk AS (
  SELECT q.*, NULLIF(TRIM(q.reference_number), '') AS ref,
         CASE WHEN NULLIF(TRIM(q.reversal_reason), '') IS NULL OR NULLIF(TRIM(q.reference_number), '') IS NULL
                   OR NULLIF(TRIM(q.depositor_name), '') IS NULL OR NULLIF(TRIM(q.photo_proof_url), '') IS NULL
                   OR o.id IS NULL OR o.reversal_of_id IS NOT NULL OR o.status = 'reversed'
                   OR q.id IN (SELECT reversal_of_id FROM r_deposits WHERE reversal_of_id IS NOT NULL)
                   OR TRIM(q.reference_number) IN (SELECT reference_number FROM r_deposits) THEN 'x' END AS why
  FROM r_reversal_requests q LEFT JOIN r_deposits o ON o.id = q.id
), cand AS (SELECT seq, id, ref, ROW_NUMBER() OVER (ORDER BY seq) AS rn FROM chk WHERE why IS NULL
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS ids,
         CAST([] AS VARCHAR[]) AS refs, FALSE AS ok
  UNION ALL
  SELECT c.rn, c.seq,
         CASE WHEN list_contains(w.ids, c.id) OR list_contains(w.refs, c.ref) THEN w.ids ELSE list_append(w.ids, c.id) END,
         CASE WHEN list_contains(w.ids, c.id) OR list_contains(w.refs, c.ref) THEN w.refs ELSE list_append(w.refs, c.ref) END,
         NOT (list_contains(w.ids, c.id) OR list_contains(w.refs, c.ref))
  FROM walk w JOIN cand c ON c.rn = w.rn + 1
), acc AS (SELECT c.* FROM chk c JOIN walk w ON w.seq = c.seq AND w.ok)
SELECT d.id, d.business_date, d.amount,
       CASE WHEN a.id IS NOT NULL THEN 'reversed' ELSE d.status END AS status,
       d.reference_number, d.reversal_of_id,
       CASE WHEN a.id IS NOT NULL THEN COALESCE(d.reversal_reason, TRIM(a.reversal_reason)) ELSE d.reversal_reason END
         AS reversal_reason,
       CASE WHEN a.id IS NOT NULL THEN a.deposited_by ELSE d.reversed_by END AS reversed_by
FROM r_deposits d LEFT JOIN acc a ON a.id = d.id
UNION ALL
SELECT NULL, o.business_date, CAST(-ABS(o.amount) AS DECIMAL(12,2)), 'reversed', a.ref, o.id,
       TRIM(a.reversal_reason), NULL
FROM acc a JOIN r_deposits o ON o.id = a.id""", recursive=True)
def q_reverse_deposits_ledger(a):
    """The ledger after the reversal batch: originals flipped, contra rows added
    (new ids are generated, so they are left out of the comparison)."""
    _, ledger = D.reverse_deposits(a.r_reversal_requests, a.r_deposits, POST_AS_OF)
    is_new = F.col("created_at") == F.lit(POST_AS_OF).cast("timestamp_ntz")
    return ledger.select(F.when(~is_new, F.col("id")).alias("id"), "business_date", "amount", "status",
                         "reference_number", "reversal_of_id", "reversal_reason", "reversed_by")


@register("deposit_register", ["r_deposits", "r_branches", "r_users"], """
SELECT d.id, d.branch_id, d.business_date, d.amount, d.status, d.reference_number,
       b.branch_name, u.full_name AS deposited_by_name, ru.full_name AS reversed_by_name,
       ro.reference_number AS reversal_of_reference_number
FROM r_deposits d
LEFT JOIN r_branches b ON b.id = d.branch_id
LEFT JOIN r_users u ON u.id = d.deposited_by
LEFT JOIN r_users ru ON ru.id = d.reversed_by
LEFT JOIN r_deposits ro ON ro.id = d.reversal_of_id""")
def q_deposit_register(a):
    """The whole deposit register with branch, people and reversal links."""
    return D.deposit_register(a.r_deposits, a.r_branches, a.r_users, limit=None).select(
        "id", "branch_id", "business_date", "amount", "status", "reference_number", "branch_name",
        "deposited_by_name", "reversed_by_name", "reversal_of_reference_number")


@register("backfill_deposits", ["r_deposits_legacy"], """
SELECT id, branch_id, amount,
       COALESCE(NULLIF(bank_account, ''), 'Unspecified') AS bank_account,
       COALESCE(NULLIF(reference_number, ''), CONCAT('LEGACY-', CAST(id AS VARCHAR))) AS reference_number,
       COALESCE(NULLIF(depositor_name, ''), 'Unspecified') AS depositor_name,
       COALESCE(NULLIF(photo_proof_url, ''), 'legacy://not-provided') AS photo_proof_url,
       COALESCE(business_date, DATE '1996-02-01') AS business_date,
       COALESCE(status, 'posted') AS status
FROM r_deposits_legacy""")
def q_backfill_deposits(a):
    """Legacy deposits with blanks filled."""
    return D.backfill_deposits(a.r_deposits_legacy, POST_AS_OF)


MATCH_SQL = """
SELECT id, service_type, principal_amount, rule_id, rule_fee_amount
FROM (
  SELECT g.id, g.service_type, g.principal_amount, r.id AS rule_id, r.fee_amount AS rule_fee_amount,
         ROW_NUMBER() OVER (PARTITION BY g.id ORDER BY r.min_amount DESC NULLS LAST,
                            r.created_at DESC NULLS FIRST, r.id ASC NULLS LAST) AS rn
  FROM r_gcash g
  LEFT JOIN r_fee_rules r ON r.service_type = g.service_type AND r.is_active
       AND g.principal_amount >= r.min_amount AND (r.max_amount IS NULL OR g.principal_amount <= r.max_amount)
       AND (r.effective_from IS NULL OR r.effective_from <= g.created_at)
       AND (r.effective_to IS NULL OR r.effective_to >= g.created_at)
) x WHERE rn = 1"""


@register("match_fee_rules", ["r_gcash", "r_fee_rules"], MATCH_SQL)
def q_match_fee_rules(a):
    """Fee band of every wallet transaction at its own time."""
    m = FE.match_fee_rules(a.r_gcash, a.r_fee_rules, as_of=F.col("created_at"))
    return m.select("id", "service_type", "principal_amount", "rule_id", "rule_fee_amount")


def rules_with_candidates(a):
    c = a.r_fee_candidates
    cand = c.filter(F.col("service_type").isin("cash_in", "cash_out") & (F.col("min_amount") >= 0)).select(
        (F.col("seq") + 1000).alias("id"), "service_type",
        F.col("min_amount").cast("decimal(12,2)").alias("min_amount"),
        F.col("max_amount").cast("decimal(12,2)").alias("max_amount"),
        F.col("fee_amount").cast("decimal(12,2)").alias("fee_amount"), "is_active",
        F.lit(None).cast("timestamp_ntz").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return a.r_fee_rules.unionByName(cand)


@register("fee_rule_overlaps", ["r_fee_rules", "r_fee_candidates"], """
, rules AS (
  SELECT id, service_type, min_amount, max_amount, is_active FROM r_fee_rules
  UNION ALL
  SELECT seq + 1000, service_type, CAST(min_amount AS DECIMAL(12,2)), CAST(max_amount AS DECIMAL(12,2)), is_active
  FROM r_fee_candidates WHERE service_type IN ('cash_in', 'cash_out') AND min_amount >= 0
)
SELECT a.service_type, a.id AS rule_id, b.id AS other_rule_id, a.min_amount AS rule_min_amount,
       a.max_amount AS rule_max_amount, b.min_amount AS other_min_amount, b.max_amount AS other_max_amount
FROM rules a JOIN rules b ON a.service_type = b.service_type AND a.id < b.id AND a.is_active AND b.is_active
 AND (a.max_amount IS NULL OR a.max_amount >= b.min_amount) AND (b.max_amount IS NULL OR b.max_amount >= a.min_amount)""")
def q_fee_rule_overlaps(a):
    """Overlapping active bands among the stored rules plus the proposed ones."""
    return FE.fee_rule_overlaps(rules_with_candidates(a))


@register("match_fee_rules_many", ["r_gcash", "r_fee_rules", "r_fee_candidates"], """
, rules AS (
  SELECT id, service_type, min_amount, max_amount, fee_amount, is_active, effective_from, effective_to, created_at FROM r_fee_rules
  UNION ALL
  SELECT seq + 1000, service_type, CAST(min_amount AS DECIMAL(12,2)), CAST(max_amount AS DECIMAL(12,2)),
         CAST(fee_amount AS DECIMAL(12,2)), is_active, NULL, NULL, NULL
  FROM r_fee_candidates WHERE service_type IN ('cash_in', 'cash_out') AND min_amount >= 0
), txn AS (SELECT CASE WHEN id % 3 <> 0 THEN id % 7 END AS key, service_type, principal_amount, created_at FROM r_gcash)
SELECT t.key, t.service_type, t.principal_amount, best.id AS rule_id, best.fee_amount AS rule_fee_amount
FROM txn t LEFT JOIN LATERAL (
  SELECT r.id, r.fee_amount FROM rules r
  WHERE r.service_type = t.service_type AND r.is_active AND t.principal_amount BETWEEN r.min_amount AND COALESCE(r.max_amount, t.principal_amount)
    AND COALESCE(r.effective_from, t.created_at) <= t.created_at AND COALESCE(r.effective_to, t.created_at) >= t.created_at
  ORDER BY r.min_amount DESC, r.created_at DESC NULLS FIRST, r.id LIMIT 1) best ON TRUE""")
def q_match_fee_rules_many(a):
    """Fee bands among hundreds of rules, for transactions whose keys repeat or are NULL."""
    key = F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("key")
    txns = a.r_gcash.select(key, "service_type", "principal_amount", "created_at")
    m = FE.match_fee_rules(txns, rules_with_candidates(a), as_of=F.col("created_at"))
    return m.select("key", "service_type", "principal_amount", "rule_id", "rule_fee_amount")


# One request after the other: t is the rule table as it is by then.
SERIAL_RULES_SQL = f"""
, c AS (
  SELECT seq, id, service_type, CAST(min_amount AS DECIMAL(12,2)) AS mn, CAST(max_amount AS DECIMAL(12,2)) AS mx,
         CAST(fee_amount AS DECIMAL(12,2)) AS fee, is_active AS act, seq % 85 = 0 AS cleared,
         COALESCE(id IN (SELECT id FROM r_fee_rules), FALSE) AS upd, ROW_NUMBER() OVER (ORDER BY seq) AS rn
  FROM r_fee_candidates
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq,
         (SELECT list({{'mn': min_amount, 'cn': created_at IS NULL, 'cr': CAST(created_at AS TIMESTAMP), 'sq': CAST(0 AS BIGINT), 'id': CAST(id AS BIGINT),
                       'st': CAST(service_type AS VARCHAR), 'mx': max_amount, 'fee': fee_amount, 'act': is_active}})
          FROM r_fee_rules) AS t,
         CAST(NULL AS VARCHAR) AS st, CAST(NULL AS DECIMAL(12,2)) AS mn, CAST(NULL AS DECIMAL(12,2)) AS mx,
         CAST(NULL AS DECIMAL(12,2)) AS fee, CAST(NULL AS BOOLEAN) AS act, CAST(NULL AS BOOLEAN) AS upd, CAST(NULL AS VARCHAR) AS why
  UNION ALL
  SELECT d.rn, d.seq,
         CASE WHEN d.why IS NOT NULL OR d.hit IS NOT NULL THEN d.t
              ELSE list_append(list_filter(d.t, lambda x: NOT (d.upd AND x.id = d.id)),
                               {{'mn': d.mn, 'cn': CASE WHEN d.upd THEN d.o.cn ELSE FALSE END,
                                 'cr': CASE WHEN d.upd THEN d.o.cr ELSE TIMESTAMP '{POST_AS_OF}' END,
                                 'sq': CASE WHEN d.upd THEN d.o.sq ELSE d.seq END, 'id': CASE WHEN d.upd THEN d.id ELSE -d.seq END,
                                 'st': d.st, 'mx': d.mx, 'fee': d.fee, 'act': d.act}}) END,
         d.st, d.mn, d.mx, d.fee, d.act, d.upd,
         COALESCE(d.why, '{FE.ERR_OVERLAP.split("{min}")[0]}' || CAST(d.hit.mn AS VARCHAR) || ' - '
                         || COALESCE(CAST(d.hit.mx AS VARCHAR), '{FE.ERR_OVERLAP_OPEN_MAX}') || ')')
  FROM (
    SELECT v.*,
           CASE WHEN v.st IS NULL OR v.st NOT IN ('cash_in', 'cash_out') THEN '{FE.ERR_SERVICE_TYPE}'
                WHEN v.mn < 0 THEN '{FE.ERR_MIN_NEGATIVE}' WHEN v.mx < v.mn THEN '{FE.ERR_MAX_BELOW_MIN}' END AS why,
           CASE WHEN v.act AND v.mn >= 0 AND COALESCE(v.mx >= v.mn, TRUE)
                THEN list_sort(list_filter(v.t, lambda x: x.act AND x.st = v.st AND NOT (v.upd AND x.id = v.id)
                                           AND COALESCE(x.mx >= v.mn, TRUE) AND COALESCE(v.mx >= x.mn, TRUE)))[1] END AS hit
    FROM (
      SELECT u.rn, u.seq, u.id, u.upd, u.t, u.o, COALESCE(u.service_type, u.o.st) AS st, COALESCE(u.mn, u.o.mn) AS mn,
             CASE WHEN NOT u.cleared THEN COALESCE(u.mx, u.o.mx) END AS mx, COALESCE(u.fee, u.o.fee) AS fee,
             COALESCE(u.act, u.o.act, TRUE) AS act
      FROM (SELECT c.*, w.t, CASE WHEN c.upd THEN list_filter(w.t, lambda x: x.id = c.id)[1] END AS o
            FROM walk w JOIN c ON c.rn = w.rn + 1) u
    ) v
  ) d
)"""


def _load_fee_rules(a):
    cand = a.r_fee_candidates.withColumn("clear", F.when(F.col("seq") % 85 == 0, F.array(F.lit("max_amount"))))
    return FE.load_fee_rules(cand, a.r_fee_rules, POST_AS_OF, clear="clear")


@register("load_fee_rules", ["r_fee_candidates", "r_fee_rules"], SERIAL_RULES_SQL + """
SELECT seq, st AS service_type_final, mn AS min_amount_final, mx AS max_amount_final, fee AS fee_amount_final,
       act AS is_active_final, upd AS is_update, why AS reject_reason
FROM walk WHERE rn > 0""", recursive=True)
def q_load_fee_rules(a):
    """Proposed rules (new ones and updates), each checked against the rules as its predecessors left them."""
    outcome, _ = _load_fee_rules(a)
    return outcome.select("seq", "service_type_final", "min_amount_final", "max_amount_final", "fee_amount_final",
                          "is_active_final", "is_update", "reject_reason")


@register("load_fee_rules_table", ["r_fee_candidates", "r_fee_rules"], SERIAL_RULES_SQL + """
SELECT CASE WHEN x.id > 0 THEN x.id END AS id, x.st AS service_type, x.mn AS min_amount, x.mx AS max_amount, x.fee AS fee_amount,
       x.act AS is_active
FROM (SELECT unnest(t) AS x FROM walk WHERE rn = (SELECT MAX(rn) FROM walk))""", recursive=True)
def q_load_fee_rules_table(a):
    """The rule table after the batch: one row per rule (new ids are generated, so they are left out)."""
    _, table = _load_fee_rules(a)
    is_new = F.coalesce(F.col("created_at") == F.lit(POST_AS_OF).cast("timestamp_ntz"), F.lit(False))
    return table.select(F.when(~is_new, F.col("id")).alias("id"), "service_type", "min_amount", "max_amount", "fee_amount", "is_active")


@register("post_wallet_transactions", ["r_wallet_requests", "r_fee_rules", "r_gcash"], f"""
, m AS (
  SELECT q.*, r.id AS rule_id, r.fee_amount AS rule_fee,
         ROW_NUMBER() OVER (PARTITION BY q.seq ORDER BY r.min_amount DESC NULLS LAST,
                            r.created_at DESC NULLS FIRST, r.id ASC NULLS LAST) AS rn
  FROM (SELECT *, NULLIF(TRIM(reference_number), '') AS ref,
               CASE WHEN regexp_matches(TRIM(principal_amount), '{NUMBER}') THEN TRY_CAST(TRIM(principal_amount) AS DECIMAL(30,6)) END AS amt
        FROM r_wallet_requests) q
  LEFT JOIN r_fee_rules r ON r.service_type = q.service_type AND r.is_active
       AND q.amt >= r.min_amount AND (r.max_amount IS NULL OR q.amt <= r.max_amount)
       AND (r.effective_from IS NULL OR r.effective_from <= q.created_at)
       AND (r.effective_to IS NULL OR r.effective_to >= q.created_at)
), b AS (
  SELECT *,
         CASE WHEN service_type NOT IN ('cash_in', 'cash_out') THEN '{FE.ERR_SERVICE_TYPE}'
              WHEN ref IS NULL THEN '{FE.ERR_WALLET_REF}'
              WHEN amt IS NULL OR amt <= 0 THEN '{FE.ERR_PRINCIPAL}'
              WHEN TRY_CAST(amt + COALESCE(rule_fee, 0) AS DECIMAL(12,2)) IS NULL THEN '{FE.ERR_RANGE.format(field="principal_amount")}'
              WHEN rule_id IS NULL THEN 'No active fee rule found for ' || service_type || ' at amount '
                   || regexp_replace(regexp_replace(CAST(amt AS VARCHAR), '0+$', ''), '\\.$', '')
              WHEN ref IN (SELECT reference_number FROM r_gcash) THEN '{FE.ERR_DUPLICATE}'
         END AS why
  FROM m WHERE rn = 1
), firsts AS (SELECT ref, MIN(seq) AS s FROM b WHERE why IS NULL GROUP BY ref)
SELECT b.seq, b.service_type, b.branch_id, b.customer_id,
       TRY_CAST(b.amt AS DECIMAL(12,2)) AS principal_amount,
       CAST(b.rule_fee AS DECIMAL(12,2)) AS fee_amount,
       TRY_CAST(b.amt + b.rule_fee AS DECIMAL(12,2)) AS gross_amount,
       TRY_CAST(CASE WHEN b.service_type = 'cash_in' THEN b.amt + b.rule_fee ELSE -b.amt END AS DECIMAL(12,2)) AS cash_impact,
       b.ref AS reference_number, b.rule_id AS fee_rule_id,
       COALESCE(b.why, CASE WHEN b.seq <> f.s THEN '{FE.ERR_DUPLICATE}' END) AS reject_reason
FROM b LEFT JOIN firsts f ON f.ref = b.ref""")
def q_post_wallet_transactions(a):
    """Wallet request batch priced with fee bands at request time."""
    return FE.post_wallet_transactions(a.r_wallet_requests, a.r_fee_rules, a.r_gcash, as_of="created_at")


@register("upsert_catalog", ["r_catalog_current", "r_prepaid_catalog", "r_prepaid"], """
, seed AS (SELECT carrier, product_code, product_name, load_type, face_value, validity_days, source_url
           FROM r_prepaid_catalog)
SELECT COALESCE(c.product_code, s.product_code) AS product_code,
       CASE WHEN s.product_code IS NOT NULL THEN s.carrier ELSE c.carrier END AS carrier,
       CASE WHEN s.product_code IS NOT NULL THEN s.product_name ELSE c.product_name END AS product_name,
       c.description,
       CASE WHEN s.product_code IS NOT NULL THEN s.load_type ELSE c.load_type END AS load_type,
       CASE WHEN s.product_code IS NOT NULL THEN s.face_value ELSE c.face_value END AS face_value,
       CASE WHEN c.product_code IS NOT NULL THEN c.markup_amount ELSE CAST(0 AS DECIMAL(12,2)) END AS markup_amount,
       CASE WHEN s.product_code IS NOT NULL THEN s.validity_days ELSE c.validity_days END AS validity_days,
       CASE WHEN c.product_code IS NOT NULL THEN c.is_active ELSE TRUE END AS is_active,
       CASE WHEN s.product_code IS NOT NULL THEN s.source_url ELSE c.source_url END AS source_url
FROM r_catalog_current c FULL OUTER JOIN seed s ON s.product_code = c.product_code""")
def q_upsert_catalog(a):
    """Re-seed of the catalog of products sold so far: seed fields overwrite,
    markup / active flag / description are kept, missing products inserted."""
    out = P.upsert_catalog(a.r_catalog_current, load_catalog(a.spark), POST_AS_OF)
    return out.drop("id")


@register("post_prepaid_sales", ["r_prepaid_requests", "r_catalog_current", "r_prepaid_catalog", "r_prepaid"], f"""
, j AS (
  SELECT q.*, NULLIF(TRIM(q.reference_number), '') AS ref, NULLIF(TRIM(q.recipient_mobile_no), '') AS mraw,
         regexp_replace(COALESCE(NULLIF(TRIM(q.recipient_mobile_no), ''), ''), '[^0-9]', '', 'g') AS digits,
         c.id AS cid, c.carrier, c.face_value, c.markup_amount
  FROM r_prepaid_requests q LEFT JOIN r_catalog_current c ON c.id = q.product_id AND c.is_active
), k AS (
  SELECT *,
         CASE WHEN regexp_matches(digits, '^09[0-9]{{9}}$') THEN digits
              WHEN regexp_matches(digits, '^639[0-9]{{9}}$') THEN '0' || substr(digits, 3) END AS mobile,
         CASE WHEN product_id IS NULL THEN '{P.ERR_PRODUCT_REQUIRED}'
              WHEN ref IS NULL THEN '{P.ERR_REF}'
              WHEN mraw IS NULL THEN '{P.ERR_MOBILE_REQUIRED}'
              WHEN NOT (regexp_matches(digits, '^09[0-9]{{9}}$') OR regexp_matches(digits, '^639[0-9]{{9}}$'))
                THEN '{P.ERR_MOBILE_INVALID}'
              WHEN cid IS NULL THEN '{P.ERR_PRODUCT_INACTIVE}'
              WHEN face_value IS NULL OR face_value <= 0 THEN '{P.ERR_FACE}'
              WHEN ref IN (SELECT reference_number FROM r_prepaid) THEN '{P.ERR_DUPLICATE}'
         END AS why
  FROM j
), firsts AS (SELECT ref, MIN(seq) AS s FROM k WHERE why IS NULL GROUP BY ref)
SELECT k.seq, k.product_id, k.branch_id, k.customer_id, k.mobile AS recipient_mobile_no, k.carrier,
       CAST(k.face_value AS DECIMAL(12,2)) AS face_value,
       CAST(COALESCE(k.markup_amount, 0) AS DECIMAL(12,2)) AS markup_amount,
       CAST(k.face_value + COALESCE(k.markup_amount, 0) AS DECIMAL(12,2)) AS gross_amount,
       CAST(k.face_value + COALESCE(k.markup_amount, 0) AS DECIMAL(12,2)) AS cash_impact,
       k.ref AS reference_number,
       COALESCE(k.why, CASE WHEN k.seq <> f.s THEN '{P.ERR_DUPLICATE}' END) AS reject_reason
FROM k LEFT JOIN firsts f ON f.ref = k.ref""")
def q_post_prepaid_sales(a):
    """Prepaid sale batch against the current catalog and the ledger."""
    return P.post_prepaid_sales(a.r_prepaid_requests, a.r_catalog_current, a.r_prepaid)


@register("deposit_register_filtered", ["r_deposits", "r_branches", "r_users"], """
SELECT d.id, d.business_date, d.amount, b.branch_name, ro.reference_number AS reversal_of_reference_number
FROM r_deposits d
LEFT JOIN r_branches b ON b.id = d.branch_id
LEFT JOIN r_deposits ro ON ro.id = d.reversal_of_id
WHERE d.branch_id = 4 AND d.business_date >= DATE '1996-01-05' AND d.business_date <= DATE '1996-01-25'""")
def q_deposit_register_filtered(a):
    """Deposit register of one branch over a date range."""
    return D.deposit_register(a.r_deposits, a.r_branches, a.r_users, branch_id=4, start="1996-01-05",
                              end="1996-01-25", limit=None).select(
        "id", "business_date", "amount", "branch_name", "reversal_of_reference_number")


@register("deposit_register_page", ["r_deposits", "r_branches", "r_users"], """
, page AS (SELECT * FROM r_deposits ORDER BY deposited_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 60 OFFSET 25)
SELECT page.id, branch_name, u.full_name AS deposited_by_name, (SELECT reference_number FROM r_deposits o WHERE o.id = page.reversal_of_id)
         AS reversal_of_reference_number,
       ROW_NUMBER() OVER (ORDER BY page.deposited_at DESC NULLS FIRST, page.created_at DESC NULLS FIRST, page.id) - 1 AS place
FROM page LEFT JOIN r_branches b ON b.id = page.branch_id LEFT JOIN r_users u ON u.id = page.deposited_by""")
def q_deposit_register_page(a):
    """A page of the deposit register, in order."""
    out = D.deposit_register(a.r_deposits, a.r_branches, a.r_users, limit=60, offset=25)
    return placed(out.select("id", "branch_name", "deposited_by_name", "reversal_of_reference_number"))


def _ledger_sql(entry: str, ledger: str, columns: str) -> str:
    """The ledger, then the accepted rows of a posting entry's own oracle."""
    body = ORACLE_BODY[entry]
    cut = body.rindex("\nSELECT ")
    return f"{body[:cut]}\n, posted AS ({body[cut:]})\nSELECT {columns} FROM {ledger} UNION ALL SELECT {columns} FROM posted WHERE reject_reason IS NULL"


WALLET_COLUMNS = "service_type, branch_id, principal_amount, fee_amount, gross_amount, cash_impact, reference_number"
PREPAID_COLUMNS = "product_id, branch_id, recipient_mobile_no, face_value, markup_amount, gross_amount, cash_impact, reference_number"
DEPOSIT_COLUMNS = "branch_id, business_date, amount, bank_account, reference_number, depositor_name, status"


@register("post_wallet_ledger", ["r_wallet_requests", "r_fee_rules", "r_gcash"],
          _ledger_sql("post_wallet_transactions", "r_gcash", WALLET_COLUMNS))
def q_post_wallet_ledger(a):
    """The wallet ledger after the batch was posted."""
    return FE.append_wallet_transactions(a.r_gcash, q_post_wallet_transactions(a), as_of=POST_AS_OF).select(*WALLET_COLUMNS.split(", "))


@register("post_prepaid_ledger", ["r_prepaid_requests", "r_catalog_current", "r_prepaid_catalog", "r_prepaid"],
          _ledger_sql("post_prepaid_sales", "r_prepaid", PREPAID_COLUMNS))
def q_post_prepaid_ledger(a):
    """The prepaid ledger after the batch was posted."""
    return P.append_prepaid_sales(a.r_prepaid, q_post_prepaid_sales(a), as_of=POST_AS_OF).select(*PREPAID_COLUMNS.split(", "))


@register("post_deposits_ledger", ["r_deposit_requests", "r_recons", "r_deposits"],
          _ledger_sql("post_deposits", "r_deposits", DEPOSIT_COLUMNS))
def q_post_deposits_ledger(a):
    """The deposit ledger after the batch was posted."""
    return D.append_deposits(a.r_deposits, q_post_deposits(a), as_of=POST_AS_OF).select(*DEPOSIT_COLUMNS.split(", "))
