"""Bank deposit ledger: posting, reversal (contra entries), register, backfill.

Batch form of the per-request transactions: every request of a batch is
checked with column expressions, uniqueness against the ledger is a
left join on the reference number, and "first request wins" inside the batch
follows request order (``seq``), as serial inserts against a unique index
would. Each operator returns one outcome frame (requests + ``reject_reason``)
and, where it changes the ledger, the new ledger version (written by the
caller to a new path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import MONEY, MONEY_OUT
from ..functions.predicates import date_between, optional_filters
from ..functions.text import new_id, number, required_text
from .changes import append_accepted
from .joins import keys_present, left_join_nullable, mark_greedy_unique, mark_taken
from .reports import _page

# Rejection texts.
ERR_AMOUNT = "amount must be greater than 0"
ERR_RECON_NOT_FOUND = "cash reconciliation not found"
ERR_BRANCH_MISMATCH = "branch_id does not match the reconciliation branch"
ERR_BRANCH_REQUIRED = "branch_id is required"
ERR_REFERENCE_UNIQUE = "reference_number must be unique"
ERR_NOT_FOUND = "bank deposit not found"
ERR_REVERSAL_OF_REVERSAL = "cannot reverse a reversal entry"
ERR_ALREADY_REVERSED = "bank deposit is already reversed"
ERR_REQUIRED = "{field} is required"
ERR_RANGE = "{field} is out of range"


def _opt(df: DataFrame, name: str, dtype: T.DataType = T.StringType()) -> Column:
    """A request field; a column missing from the batch reads as not given."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _money_in(c: Column) -> Column:
    """Request amount to money: what is no number, or missing, is 0; a number too large for the ledger is NULL."""
    text = F.trim(c.cast("string"))
    exact = F.coalesce(text.try_cast("decimal(30,6)"), number(c).try_cast("decimal(30,6)"))
    return F.when(number(c).isNull(), F.lit(0).cast(MONEY)).otherwise(exact.try_cast(MONEY))


def deposit_net_by_day(deposits: DataFrame) -> DataFrame:
    """Σ amount per (branch_id, business_date) with no status filter, so a
    deposit and its reversal on one day net to zero (T17)."""
    return deposits.groupBy("branch_id", "business_date").agg(
        F.sum("amount").cast(MONEY_OUT).alias("total_bank_deposit_amount"),
        F.count(F.lit(1)).alias("entry_count"))


def _resolve_date(c: Column, dtype: T.DataType, today: Column) -> Column:
    """A valid 'YYYY-MM-DD' (or a DATE) is kept; anything else is today."""
    if isinstance(dtype, T.StringType):
        ok = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
        parsed = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
        return F.when(ok & parsed.isNotNull(), parsed).otherwise(today)
    return F.coalesce(c.cast("date"), today)


def post_deposits(requests: DataFrame, recons: DataFrame, ledger: DataFrame, as_of="1970-01-01 00:00:00",
                  seq: str = "seq") -> DataFrame:
    """Validate and price deposit requests. Checks in order: amount > 0; bank
    account, reference, depositor and proof given (trimmed); a linked
    reconciliation must exist, gives branch and business date, and must
    agree with a given branch; a branch is required; the reference must be
    new to the ledger and to earlier requests. Returns the requests with the
    row to store and ``reject_reason`` (NULL = accepted)."""
    now = _ts(as_of)
    today = F.to_date(now)
    r = requests
    rec = recons.select(F.col("id").alias("__rid"), F.col("branch_id").alias("__rbranch"),
                        F.col("business_date").alias("__rdate"))
    recon_id = _opt(r, "cash_reconciliation_id", rec.schema["__rid"].dataType)
    r = r.withColumn("__recon", recon_id)
    r = r.join(rec, r["__recon"] == rec["__rid"], "left")
    branch_in = _opt(r, "branch_id", rec.schema["__rbranch"].dataType)
    has_recon = F.col("__recon").isNotNull()
    if isinstance(rec.schema["__rid"].dataType, T.StringType):
        has_recon = has_recon & (F.col("__recon") != "")
    date_in = _opt(r, "business_date")
    date_type = r.schema["business_date"].dataType if "business_date" in r.columns else T.StringType()
    out = r.select(
        "*",
        _money_in(_opt(r, "amount")).alias("__amount"),
        required_text(_opt(r, "bank_account")).alias("__bank_account"),
        required_text(_opt(r, "reference_number")).alias("__reference_number"),
        required_text(_opt(r, "depositor_name")).alias("__depositor_name"),
        required_text(_opt(r, "photo_proof_url")).alias("__photo_proof_url"),
        F.when(has_recon, F.col("__rbranch")).otherwise(branch_in).alias("__branch"),
        F.when(has_recon, F.col("__rdate")).otherwise(_resolve_date(date_in, date_type, today)).alias("__date"),
    )
    reason = (F.when(F.col("__amount").isNull(), F.lit(ERR_RANGE.format(field="amount")))
              .when(F.col("__amount") <= 0, F.lit(ERR_AMOUNT))
              .when(F.col("__bank_account").isNull(), F.lit(ERR_REQUIRED.format(field="bank_account")))
              .when(F.col("__reference_number").isNull(), F.lit(ERR_REQUIRED.format(field="reference_number")))
              .when(F.col("__depositor_name").isNull(), F.lit(ERR_REQUIRED.format(field="depositor_name")))
              .when(F.col("__photo_proof_url").isNull(), F.lit(ERR_REQUIRED.format(field="photo_proof_url")))
              .when(has_recon & F.col("__rid").isNull(), F.lit(ERR_RECON_NOT_FOUND))
              .when(has_recon & branch_in.isNotNull() & (branch_in != F.col("__rbranch")), F.lit(ERR_BRANCH_MISMATCH))
              .when(F.col("__branch").isNull(), F.lit(ERR_BRANCH_REQUIRED)))
    out = out.withColumn("__pre", reason)
    out = mark_taken(out, "__reference_number", seq, F.col("__pre").isNull(), ledger, "reference_number", "__taken")
    out = out.withColumn("reject_reason", F.coalesce(F.col("__pre"),
                                                     F.when(F.col("__taken"), F.lit(ERR_REFERENCE_UNIQUE))))
    return out.select(
        F.col(seq),
        F.col("__branch").alias("branch_id"),
        F.when(has_recon, F.col("__recon")).alias("cash_reconciliation_id"),
        F.col("__date").alias("business_date"),
        F.col("__amount").alias("amount"),
        F.col("__bank_account").alias("bank_account"),
        F.col("__reference_number").alias("reference_number"),
        F.col("__depositor_name").alias("depositor_name"),
        F.col("__photo_proof_url").alias("photo_proof_url"),
        F.lit("posted").alias("status"),
        F.nullif(_opt(r, "notes"), F.lit("")).alias("notes"),  # an empty note is no note
        _opt(r, "deposited_by", ledger.schema["deposited_by"].dataType).alias("deposited_by"),
        F.coalesce(_opt(r, "deposited_at", T.TimestampNTZType()).cast("timestamp_ntz"), now).alias("deposited_at"),
        "reject_reason",
    )


def append_deposits(ledger: DataFrame, outcome: DataFrame, id_expr: Column | None = None,
                    as_of="1970-01-01 00:00:00") -> DataFrame:
    """New ledger version: the ledger plus the accepted rows of ``post_deposits``."""
    return append_accepted(ledger, outcome, "bank_deposit", id_expr, as_of)


def reverse_deposits(requests: DataFrame, ledger: DataFrame, as_of="1970-01-01 00:00:00", posting_date=None,
                     seq: str = "seq", id_expr: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Reverse deposits with contra entries. Checks in order: reason,
    reference, depositor and proof given; original found; original not
    itself a reversal; not reversed before (status or an existing contra
    row); reference new. Inside a batch, requests apply in ``seq`` order: a
    request is accepted only if no earlier accepted request reversed the same
    deposit or used the same reference (exact, in rounds).

    The contra row carries −|amount|, status 'reversed', the link to the
    original and the original's business date unless ``posting_date`` is
    given (T18). The original flips to 'reversed', stamped with who/when, its
    reason kept if it had one. Returns (outcome, new ledger)."""
    now = _ts(as_of)
    r = requests.select(
        "*",
        required_text(_opt(requests, "reversal_reason")).alias("__reason"),
        required_text(_opt(requests, "reference_number")).alias("__ref"),
        required_text(_opt(requests, "depositor_name")).alias("__dep_name"),
        required_text(_opt(requests, "photo_proof_url")).alias("__proof"),
    )
    orig = ledger.select(F.col("id").alias("__oid"), F.col("reversal_of_id").alias("__o_rev_of"),
                         F.col("status").alias("__o_status"))
    already = keys_present(ledger, "reversal_of_id", r, "id", "__rev_target")
    refs = keys_present(ledger, "reference_number", r, "__ref", "__lref")
    r = (r.join(orig, r["id"] == orig["__oid"], "left")
         .join(already, r["id"] == already["__rev_target"], "left")
         .join(refs, F.col("__ref") == refs["__lref"], "left"))
    reason = (F.when(F.col("__reason").isNull(), F.lit(ERR_REQUIRED.format(field="reversal_reason")))
              .when(F.col("__ref").isNull(), F.lit(ERR_REQUIRED.format(field="reference_number")))
              .when(F.col("__dep_name").isNull(), F.lit(ERR_REQUIRED.format(field="depositor_name")))
              .when(F.col("__proof").isNull(), F.lit(ERR_REQUIRED.format(field="photo_proof_url")))
              .when(F.col("__oid").isNull(), F.lit(ERR_NOT_FOUND))
              .when(F.col("__o_rev_of").isNotNull(), F.lit(ERR_REVERSAL_OF_REVERSAL))
              .when(F.col("__o_status") == "reversed", F.lit(ERR_ALREADY_REVERSED))
              .when(F.col("__rev_target").isNotNull(), F.lit(ERR_ALREADY_REVERSED))
              .when(F.col("__lref").isNotNull(), F.lit(ERR_REFERENCE_UNIQUE)))
    r = r.withColumn("__pre", reason)
    r = mark_greedy_unique(r, [("id", ERR_ALREADY_REVERSED), ("__ref", ERR_REFERENCE_UNIQUE)], seq,
                           F.col("__pre").isNull(), "__batch_reason")
    outcome = r.withColumn("reject_reason", F.coalesce(F.col("__pre"), F.col("__batch_reason")))
    ok = outcome.filter(F.col("reject_reason").isNull())

    full = ledger.alias("L")
    accepted = ok.select(F.col("id").alias("__target"), F.col("__reason").alias("__a_reason"),
                         F.col("__ref").alias("__a_ref"), F.col("__dep_name").alias("__a_dep"),
                         F.col("__proof").alias("__a_proof"),
                         F.nullif(_opt(ok, "notes"), F.lit("")).alias("__a_notes"),
                         _opt(ok, "deposited_by", ledger.schema["deposited_by"].dataType).alias("__a_by"),
                         F.coalesce(_opt(ok, "deposited_at", T.TimestampNTZType()).cast("timestamp_ntz"), now)
                         .alias("__a_at"))
    j = full.join(accepted, F.col("L.id") == accepted["__target"], "left")
    hit = F.col("__target").isNotNull()
    updated = j.select(*[
        (F.when(hit, F.lit("reversed")).otherwise(F.col("L.status")).alias(c) if c == "status" else
         F.when(hit, F.col("__a_by").cast(ledger.schema[c].dataType)).otherwise(F.col("L." + c)).alias(c)
         if c == "reversed_by" else
         F.when(hit, now).otherwise(F.col("L." + c)).alias(c) if c in ("reversed_at", "updated_at") else
         F.when(hit, F.coalesce(F.col("L.reversal_reason"), F.col("__a_reason"))).otherwise(
             F.col("L.reversal_reason")).alias(c) if c == "reversal_reason" else
         F.col("L." + c).alias(c))
        for c in ledger.columns])
    pdate = F.lit(str(posting_date)).cast("date") if posting_date is not None else F.col("L.business_date")
    contra_vals = {
        "id": (id_expr if id_expr is not None
               else new_id("bank_deposit", ledger.schema["id"].dataType, F.col("__a_ref"))),
        "business_date": pdate,
        "amount": (-F.abs(F.col("L.amount"))).cast(MONEY),
        "reference_number": F.col("__a_ref"),
        "depositor_name": F.col("__a_dep"),
        "photo_proof_url": F.col("__a_proof"),
        "status": F.lit("reversed"),
        "reversal_of_id": F.col("L.id"),
        "reversal_reason": F.col("__a_reason"),
        "reversed_by": F.lit(None),
        "reversed_at": F.lit(None),
        "notes": F.col("__a_notes"),
        "deposited_by": F.col("__a_by"),
        "deposited_at": F.col("__a_at"),
        "created_at": now,
        "updated_at": now,
    }
    contra = j.filter(hit).select(*[
        contra_vals[c].cast(ledger.schema[c].dataType).alias(c) if c in contra_vals else F.col("L." + c).alias(c)
        for c in ledger.columns])
    clean = outcome.drop("__reason", "__dep_name", "__proof", "__oid", "__o_rev_of", "__o_status",
                         "__rev_target", "__lref", "__pre", "__batch_reason").withColumnRenamed("__ref", "ref_trimmed")
    return clean, updated.unionByName(contra)


def deposit_register(deposits: DataFrame, branches: DataFrame, users: DataFrame, branch_id=None,
                     business_date=None, start=None, end=None, cash_reconciliation_id=None,
                     limit=None, offset=0) -> DataFrame:
    """Deposits with branch_name, deposited_by_name, reversed_by_name and
    reversal_of_reference_number, newest deposit first (all, or a page). The reverser and
    reversal links are NULL on most rows: those rows bypass their joins. A page is
    taken from the deposits first: the joins are 1:1 and add no row."""
    d = optional_filters(deposits, {"branch_id": branch_id, "business_date": business_date,
                                    "cash_reconciliation_id": cash_reconciliation_id})
    d = d.filter(date_between("business_date", start, end))
    order = [F.desc_nulls_first("deposited_at"), F.desc_nulls_first("created_at"), F.asc("id")]
    d = _page(d, order, limit, offset)
    b = branches.select(F.col("id").alias("__bid"), "branch_name")
    d = d.join(b, d["branch_id"] == b["__bid"], "left").drop("__bid")
    d = left_join_nullable(d, users, "deposited_by", "id", {"full_name": "deposited_by_name"})
    d = left_join_nullable(d, users, "reversed_by", "id", {"full_name": "reversed_by_name"})
    d = left_join_nullable(d, deposits, "reversal_of_id", "id", {"reference_number": "reversal_of_reference_number"})
    return d.orderBy(*order)


def backfill_deposits(deposits: DataFrame, as_of="1970-01-01 00:00:00") -> DataFrame:
    """Legacy fill: blank bank account / depositor -> 'Unspecified', blank
    reference -> 'LEGACY-<id>', blank proof -> 'legacy://not-provided', NULL
    business date -> ``as_of`` date, NULL status -> 'posted'."""
    today = F.to_date(_ts(as_of))

    def fill(c, v):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), v)
    return (deposits
            .withColumn("bank_account", fill("bank_account", F.lit("Unspecified")))
            .withColumn("reference_number", fill("reference_number",
                                                 F.concat(F.lit("LEGACY-"), F.col("id").cast("string"))))
            .withColumn("depositor_name", fill("depositor_name", F.lit("Unspecified")))
            .withColumn("photo_proof_url", fill("photo_proof_url", F.lit("legacy://not-provided")))
            .withColumn("business_date", F.coalesce(F.col("business_date"), today))
            .withColumn("status", F.coalesce(F.col("status"), F.lit("posted"))))
