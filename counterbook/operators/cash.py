"""Cash drawer operators: daily totals, opening / closing a business day,
the reconciliation report and register.

All per-(branch, business day) work is an aggregate keyed by
``(branch_id, business_date)`` over whole ledgers; the reference's correlated
sub-queries and per-day query loops become one pre-aggregation plus equi-joins
on that key (a branch-day grid is tiny next to the ledgers it summarises).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import MONEY, MONEY_OUT, zero_money
from ..functions.predicates import date_between, day_range, not_cancelled, optional_filters
from ..functions.text import new_id
from .joins import mark_first_in_key
from .reports import _page

BREAKDOWN_ELEMENT = T.StructType([
    T.StructField("denomination", MONEY),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("amount", MONEY),
])
BREAKDOWN = T.ArrayType(BREAKDOWN_ELEMENT)

# Error texts of the breakdown check.
ERR_DENOMINATION = "each denomination must be a positive number"
ERR_QUANTITY = "each quantity must be a non-negative integer"
ERR_NOT_ARRAY = "cash breakdown must be an array of { denomination, quantity }"


# ----------------------------------------------------------------------------- helpers

def wallet_cash_impact(service_type: Column | str = "service_type", principal: Column | str = "principal_amount",
                       gross: Column | str = "gross_amount", impact: Column | str = "cash_impact") -> Column:
    """Signed drawer effect of a wallet transaction: cash-out removes the
    principal, cash-in adds the gross, anything else its stored impact."""
    st, pr, gr, im = (F.col(c) if isinstance(c, str) else c for c in (service_type, principal, gross, impact))
    return (F.when(st == "cash_out", -F.abs(F.coalesce(pr, F.lit(0))))
            .when(st == "cash_in", F.abs(F.coalesce(gr, im, F.lit(0))))
            .otherwise(F.coalesce(im, F.lit(0))))


def repair_cash_out_impact(gcash: DataFrame) -> DataFrame:
    """Set ``cash_impact = -abs(principal)`` on cash-out rows where it differs
    (legacy rows that also deducted the fee); adds ``impact_repaired``."""
    target = -F.abs(F.col("principal_amount"))
    fix = (F.col("service_type") == "cash_out") & (F.col("cash_impact") != target)
    fix = F.coalesce(fix, F.lit(False))
    return (gcash.withColumn("impact_repaired", fix)
            .withColumn("cash_impact", F.when(fix, target.cast(MONEY)).otherwise(F.col("cash_impact"))))


def cash_breakdown(df: DataFrame, col: str, total_col: str, error_col: str = "breakdown_error") -> DataFrame:
    """Normalise a breakdown array in place: each element checked (denomination
    > 0, quantity a non-negative integer; the first bad element names the
    error), given ``amount = denomination × quantity`` rounded to cents,
    sorted by denomination descending (stable); ``total_col`` is the sum of
    amounts. A NULL array is an empty one. Invalid rows keep their error in
    ``error_col`` and get NULL array and total."""
    arr = F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType))
    etype = df.schema[col].dataType.elementType
    qtype = etype["quantity"].dataType
    dtype = etype["denomination"].dataType

    def bad_denom(e):
        d = e["denomination"]
        c = d.isNull() | (d <= 0)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            c = c | F.isnan(d)
        return c | d.try_cast(MONEY).isNull()

    def bad_qty(e):
        q = e["quantity"]
        c = q.isNull() | (q < 0)
        if isinstance(qtype, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c | (q != F.floor(q))
        if not isinstance(qtype, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c | q.try_cast("int").isNull()  # beyond the stored range
        return F.coalesce(c, F.lit(True))

    errors = F.filter(F.transform(arr, lambda e: F.when(bad_denom(e), F.lit(ERR_DENOMINATION))
                                  .when(bad_qty(e), F.lit(ERR_QUANTITY))), lambda m: m.isNotNull())
    normalized = F.transform(arr, lambda e: F.struct(
        e["denomination"].try_cast(MONEY).alias("denomination"),
        e["quantity"].try_cast("int").alias("quantity"),
        (e["denomination"].try_cast("decimal(18,4)") * e["quantity"].try_cast("decimal(18,4)")).try_cast(MONEY).alias("amount"),
    ))
    ordered = F.array_sort(normalized, lambda l, r: F.when(l["denomination"] > r["denomination"], -1)
                           .when(l["denomination"] < r["denomination"], 1).otherwise(0))
    total = F.aggregate(ordered, F.lit(0).cast(MONEY_OUT),
                        lambda acc, e: (acc + e["amount"]).cast(MONEY_OUT)).cast(MONEY)
    err = F.get(errors, 0)
    return (df.withColumn(error_col, err)
            .withColumn(total_col, F.when(err.isNull(), total))
            .withColumn(col, F.when(err.isNull(), ordered.cast(BREAKDOWN))))


def breakdown_to_json(c: Column | str) -> Column:
    """JSON text of a breakdown array (for a JSONB column or an HTTP body);
    inside Spark the breakdown stays ``array<struct>``."""
    return F.to_json(F.col(c) if isinstance(c, str) else c)


def breakdown_from_json(c: Column | str) -> Column:
    """Parse breakdown JSON text back into ``array<struct>``."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, BREAKDOWN)


def breakdown_from_counts(counts: dict[int | float, str]) -> Column:
    """Array of ``{denomination, quantity}`` from per-denomination count columns."""
    return F.array(*[F.struct(F.lit(d).cast(MONEY).alias("denomination"), F.col(c).cast("int").alias("quantity"))
                     for d, c in counts.items()])


# ----------------------------------------------------------------------------- daily totals

TOTAL_COLUMNS = ["total_sales_amount", "cash_sales_amount", "other_cash_impact_amount",
                 "gcash_cash_in_total", "gcash_cash_out_total"]


def daily_cash_totals(orders: DataFrame, payments: DataFrame, gcash: DataFrame, prepaid: DataFrame,
                      start=None, end=None, days: DataFrame | None = None, day_col: str | None = None) -> DataFrame:
    """Per (branch_id, business_date): total_sales_amount (orders by
    created_at), cash_sales_amount (cash payments by payment_date),
    other_cash_impact_amount (signed wallet effect + prepaid impact),
    gcash_cash_in_total and gcash_cash_out_total; cancelled orders excluded.

    The four per-day queries of the reference become one union of measure
    rows and a single aggregate (one shuffle on the branch-day key, combined
    map-side per source). ``start`` / ``end`` (inclusive days) restrict every
    ledger by its own time column with predicates that reach the scans; the
    orders a window's cash payments belong to are looked up in all orders.

    ``days`` (branch_id, business_date) restricts every ledger to those branch-days by semi-joins inside the plan, so
    that a late closing among recent ones does not read the years between. Ledgers stored in folders by day name the folder column as
    ``day_col``; Spark then prunes their folders at run time by the days asked for."""
    nul = F.lit(None).cast(MONEY)
    live_all = orders.filter(not_cancelled("order_status"))  # payments may belong to older orders
    if days is not None:
        # any comparison on this side lets the planner prune folders by it at run time; every date passes this one
        d = days.select(F.col("branch_id").alias("__db"), F.col("business_date").alias("__dd")).distinct().filter(F.col("__dd") <= F.lit("9999-12-31").cast("date"))

        def asked(df, ts, branch=None):
            day = F.col(day_col) if day_col is not None and day_col in df.columns else F.to_date(F.col(ts))
            test = day == F.col("__dd")
            return df.join(d if branch else d.select("__dd").distinct(), test & (F.col(branch) == F.col("__db")) if branch else test, "left_semi")

        orders, payments = asked(orders, "created_at", "branch_id"), asked(payments, "payment_date")
        gcash, prepaid = asked(gcash, "created_at", "branch_id"), asked(prepaid, "created_at", "branch_id")
    if start is not None or end is not None:
        orders = orders.filter(day_range("created_at", start, end))
        payments = payments.filter(day_range("payment_date", start, end))
        gcash = gcash.filter(day_range("created_at", start, end))
        prepaid = prepaid.filter(day_range("created_at", start, end))

    def rows(df, branch, ts, **measures):
        return df.select(F.col(branch).alias("branch_id"), F.to_date(F.col(ts)).alias("business_date"),
                         *[(measures.get(m, nul)).cast(MONEY_OUT).alias(m) for m in TOTAL_COLUMNS])

    live = orders.filter(not_cancelled("order_status"))
    sales = rows(live, "branch_id", "created_at", total_sales_amount=F.col("total_amount"))
    o = live_all.select(F.col("id").alias("__oid"), F.col("branch_id").alias("__branch"))
    cash_pay = payments.filter(F.col("payment_method") == "cash")
    cash_pay = cash_pay.join(o, cash_pay["order_id"] == o["__oid"], "inner")
    cash = rows(cash_pay, "__branch", "payment_date", cash_sales_amount=F.col("amount"))
    st = F.col("service_type")
    wallet = rows(gcash, "branch_id", "created_at",
                  other_cash_impact_amount=wallet_cash_impact(),
                  gcash_cash_in_total=F.when(st == "cash_in", F.abs(F.coalesce(F.col("gross_amount"),
                                                                               F.col("cash_impact"), F.lit(0))))
                  .otherwise(F.lit(0)),
                  gcash_cash_out_total=F.when(st == "cash_out", F.abs(F.coalesce(F.col("principal_amount"),
                                                                                 F.col("cash_impact"), F.lit(0))))
                  .otherwise(F.lit(0)))
    pre = rows(prepaid, "branch_id", "created_at", other_cash_impact_amount=F.col("cash_impact"))
    allrows = sales.unionByName(cash).unionByName(wallet).unionByName(pre).filter(F.col("branch_id").isNotNull())
    return allrows.groupBy("branch_id", "business_date").agg(
        *[F.coalesce(F.sum(m), zero_money()).cast(MONEY_OUT).alias(m) for m in TOTAL_COLUMNS])


# ----------------------------------------------------------------------------- opening / closing

# Rejection texts.
ERR_OPEN_EXISTS = "opening cash for this branch and date already exists"
ERR_OPEN_CLOSED = "cannot update opening cash because this day is already closed"
ERR_BRANCH_REQUIRED = "branch_id is required"
ERR_DATE_FORMAT = "business_date must be in YYYY-MM-DD format"
ERR_RECON_NOT_FOUND = "cash reconciliation not found"

RECON_COLUMNS = [
    "id", "branch_id", "business_date", "opening_cash_breakdown", "closing_cash_breakdown",
    "opening_cash_total", "closing_cash_total", *TOTAL_COLUMNS,
    "expected_cash_on_hand", "actual_cash_on_hand", "variance_amount", "is_short",
    "notes", "opened_by", "closed_by", "opened_at", "closed_at", "created_at", "updated_at",
]


def _business_date(c: Column, dtype: T.DataType, as_of: Column) -> tuple[Column, Column]:
    """(date, ok): a missing date is today (``as_of``); text must be YYYY-MM-DD."""
    if isinstance(dtype, T.StringType):
        ok = c.isNull() | (c == "") | c.rlike(r"^\d{4}-\d{2}-\d{2}$")
        d = F.when(c.isNull() | (c == ""), F.to_date(as_of)).otherwise(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
        return d, ok & d.isNotNull()
    return F.coalesce(c.cast("date"), F.to_date(as_of)), F.lit(True)


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def open_days(recons: DataFrame, openings: DataFrame, mode: str = "insert", as_of="1970-01-01 00:00:00",
              seq: str = "seq", id_expr: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Open business days. ``openings``: branch_id, business_date,
    opening_cash_breakdown, notes, opened_by and a request order ``seq``.

    insert: an existing (branch, date), or an earlier request of the batch for
    it, is refused. upsert: a closed day is refused; an open one gets the new
    opening breakdown/total while notes and opened_by keep the old value
    unless given (``COALESCE(new, old)``); requests apply in ``seq`` order.

    Returns (outcome: requests + opening_cash_total + reject_reason, new recons table)."""
    if mode not in ("insert", "upsert"):
        raise ValueError("mode must be 'insert' or 'upsert'")
    now = _ts(as_of)
    if "notes" in openings.columns:  # an empty note is no note
        openings = openings.withColumn("notes", F.nullif(F.col("notes"), F.lit("")))
    req = cash_breakdown(openings, "opening_cash_breakdown", "opening_cash_total")
    bdate, date_ok = _business_date(F.col("business_date"), openings.schema["business_date"].dataType, now)
    req = req.withColumn("__date_ok", date_ok).withColumn("business_date", bdate)
    cur = recons.select(F.col("branch_id").alias("__b"), F.col("business_date").alias("__d"),
                        F.col("closed_at").isNotNull().alias("__closed"), F.lit(True).alias("__exists"))
    req = req.join(cur, (req["branch_id"] == cur["__b"]) & (req["business_date"] == cur["__d"]), "left")
    base_reason = (F.when(F.col("branch_id").isNull(), F.lit(ERR_BRANCH_REQUIRED))
                   .when(~F.col("__date_ok"), F.lit(ERR_DATE_FORMAT))
                   .when(F.col("breakdown_error").isNotNull(), F.col("breakdown_error")))
    if mode == "insert":
        req = req.withColumn("__pre", base_reason.when(F.col("__exists"), F.lit(ERR_OPEN_EXISTS)))
        req = mark_first_in_key(req, ["branch_id", "business_date"], seq, F.col("__pre").isNull(), "__first")
        reason = F.coalesce(F.col("__pre"), F.when(~F.col("__first"), F.lit(ERR_OPEN_EXISTS)))
    else:
        reason = base_reason.when(F.coalesce(F.col("__closed"), F.lit(False)), F.lit(ERR_OPEN_CLOSED))
    req = req.withColumn("reject_reason", reason)
    outcome = req.drop("__b", "__d", "__closed", "__exists", "__date_ok", "__pre", "__first")
    ok = outcome.filter(F.col("reject_reason").isNull())

    # final state per key: last accepted request's breakdown; notes/opened_by
    # the last non-NULL value given (else the stored one)
    last = ok.groupBy("branch_id", "business_date").agg(
        F.max_by(F.struct("opening_cash_breakdown", "opening_cash_total"), F.col(seq)).alias("__last"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col(seq))).alias("__notes"),
        F.max_by("opened_by", F.when(F.col("opened_by").isNotNull(), F.col(seq))).alias("__opened_by"),
    )
    keys = (recons["branch_id"] == last["branch_id"]) & (recons["business_date"] == last["business_date"])
    updated = (recons.join(last, keys, "left")
               .select(*[
                   (F.when(F.col("__last").isNotNull(), F.col("__last.opening_cash_breakdown"))
                    .otherwise(recons["opening_cash_breakdown"]).alias(c) if c == "opening_cash_breakdown" else
                    F.when(F.col("__last").isNotNull(), F.col("__last.opening_cash_total"))
                    .otherwise(recons["opening_cash_total"]).alias(c) if c == "opening_cash_total" else
                    F.coalesce(F.col("__notes"), recons["notes"]).alias(c) if c == "notes" else
                    F.coalesce(F.col("__opened_by"), recons["opened_by"]).alias(c) if c == "opened_by" else
                    F.when(F.col("__last").isNotNull(), now).otherwise(recons["updated_at"]).alias(c)
                    if c == "updated_at" else recons[c])
                   for c in recons.columns]))
    new_keys = last.join(recons.select("branch_id", "business_date"), ["branch_id", "business_date"], "left_anti")
    id_col = (id_expr if id_expr is not None
              else new_id("cash_reconciliation", recons.schema["id"].dataType, "branch_id", "business_date"))
    inserted = new_keys.select(
        "branch_id", "business_date",
        F.col("__last.opening_cash_breakdown").alias("opening_cash_breakdown"),
        F.col("__last.opening_cash_total").alias("opening_cash_total"),
        F.col("__notes").alias("notes"), F.col("__opened_by").alias("opened_by"),
    )
    inserted = inserted.select(
        *[F.col(c) if c in inserted.columns else _recon_default(c, now).alias(c) for c in RECON_COLUMNS if c != "id"])
    inserted = inserted.withColumn("id", id_col.cast(recons.schema["id"].dataType))
    new_table = updated.unionByName(inserted.select(*recons.columns))
    return outcome, new_table


def _recon_default(c: str, now: Column) -> Column:
    if c in ("opening_cash_breakdown", "closing_cash_breakdown"):
        return F.array().cast(BREAKDOWN)
    if c in ("opened_at", "created_at", "updated_at"):
        return now
    if c == "is_short":
        return F.lit(False)
    if c in ("notes",):
        return F.lit(None).cast("string")
    if c in ("closed_at",):
        return F.lit(None).cast("timestamp_ntz")
    if c in ("opened_by", "closed_by"):
        return F.when(F.lit(False), F.col("opened_by")) if c == "closed_by" else F.lit(None)
    return F.lit(0).cast(MONEY)


def empty_recons(spark, id_type: T.DataType = T.LongType(), key_type: T.DataType = T.LongType()) -> DataFrame:
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("branch_id", key_type), T.StructField("business_date", T.DateType()),
        T.StructField("opening_cash_breakdown", BREAKDOWN), T.StructField("closing_cash_breakdown", BREAKDOWN),
        T.StructField("opening_cash_total", MONEY), T.StructField("closing_cash_total", MONEY),
        *[T.StructField(c, MONEY) for c in TOTAL_COLUMNS],
        T.StructField("expected_cash_on_hand", MONEY), T.StructField("actual_cash_on_hand", MONEY),
        T.StructField("variance_amount", MONEY), T.StructField("is_short", T.BooleanType()),
        T.StructField("notes", T.StringType()), T.StructField("opened_by", key_type),
        T.StructField("closed_by", key_type), T.StructField("opened_at", T.TimestampNTZType()),
        T.StructField("closed_at", T.TimestampNTZType()), T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ])
    return spark.createDataFrame([], schema)


def closing_days(recons: DataFrame, closings: DataFrame) -> DataFrame:
    """The branch-days of the reconciliations being closed: (branch_id, business_date). What ``daily_cash_totals`` takes as
    ``days``, so a closing run is one plan and runs no job while it is built."""
    ids = closings.select(F.col("id").alias("__cid")).distinct()
    return recons.join(ids, recons["id"] == ids["__cid"], "left_semi").select("branch_id", "business_date").distinct()


def close_days(recons: DataFrame, closings: DataFrame, totals: DataFrame, as_of="1970-01-01 00:00:00",
               seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Close business days. ``closings``: id (reconciliation), closing_cash_breakdown,
    notes, closed_by, optional closed_at (request time; else ``as_of``), ``seq``.
    ``totals`` is ``daily_cash_totals`` (or any frame with its columns).

    expected = opening + cash sales + other impact (deposits do not count,
    T16); actual = counted closing total; variance = actual − expected;
    is_short = variance < 0. Closing again recomputes (T20). Notes are kept
    unless new ones are given.

    Returns (outcome: closings + closing_cash_total + reject_reason, new recons table)."""
    now = _ts(as_of)
    if "notes" in closings.columns:  # an empty note is no note
        closings = closings.withColumn("notes", F.nullif(F.col("notes"), F.lit("")))
    req = cash_breakdown(closings, "closing_cash_breakdown", "closing_cash_total")
    if "closed_at" not in req.columns:
        req = req.withColumn("closed_at", now)
    known = recons.select(F.col("id").alias("__rid"))
    req = req.join(known, req["id"] == known["__rid"], "left")
    req = req.withColumn("reject_reason",
                         F.when(F.col("breakdown_error").isNotNull(), F.col("breakdown_error"))
                         .when(F.col("__rid").isNull(), F.lit(ERR_RECON_NOT_FOUND))).drop("__rid")
    ok = req.filter(F.col("reject_reason").isNull())
    last = ok.groupBy(F.col("id").alias("__cid")).agg(
        F.max_by(F.struct("closing_cash_breakdown", "closing_cash_total", "closed_by", "closed_at"),
                 F.col(seq)).alias("__c"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col(seq))).alias("__notes"),
    )
    t = totals.select(F.col("branch_id").alias("__tb"), F.col("business_date").alias("__td"),
                      *[F.col(c).alias("__t_" + c) for c in TOTAL_COLUMNS])
    j = (recons.join(last, recons["id"] == last["__cid"], "left")
         .join(t, (recons["branch_id"] == t["__tb"]) & (recons["business_date"] == t["__td"]), "left"))
    hit = F.col("__c").isNotNull()
    tot = {c: F.coalesce(F.col("__t_" + c), F.lit(0)).cast(MONEY) for c in TOTAL_COLUMNS}
    expected = (F.coalesce(recons["opening_cash_total"], F.lit(0)) + tot["cash_sales_amount"]
                + tot["other_cash_impact_amount"]).cast(MONEY)
    actual = F.col("__c.closing_cash_total").cast(MONEY)
    variance = (actual - expected).cast(MONEY)
    new_vals = {
        "closing_cash_breakdown": F.col("__c.closing_cash_breakdown"),
        "closing_cash_total": actual,
        **tot,
        "expected_cash_on_hand": expected,
        "actual_cash_on_hand": actual,
        "variance_amount": variance,
        "is_short": variance < 0,
        "closed_by": F.col("__c.closed_by"),
        "notes": F.coalesce(F.col("__notes"), recons["notes"]),
        "closed_at": F.col("__c.closed_at"),
        "updated_at": F.col("__c.closed_at"),
    }
    out = j.select(*[F.when(hit, new_vals[c].cast(recons.schema[c].dataType)).otherwise(recons[c]).alias(c)
                     if c in new_vals else recons[c] for c in recons.columns])
    outcome = req
    return outcome, out


# ----------------------------------------------------------------------------- reports

def _deposit_totals(deposits: DataFrame) -> DataFrame:
    # T17: no status filter -- an original and its contra entry net to zero
    return deposits.groupBy(F.col("branch_id").alias("__db"), F.col("business_date").alias("__dd")).agg(
        F.sum("amount").alias("__dep"))


def _with_deposits(recons: DataFrame, deposits: DataFrame) -> DataFrame:
    dep = _deposit_totals(deposits)
    j = recons.join(dep, (recons["branch_id"] == dep["__db"]) & (recons["business_date"] == dep["__dd"]), "left")
    total = F.coalesce(F.col("__dep"), F.lit(0)).cast(MONEY_OUT)
    remaining = F.when(F.col("closed_at").isNull(), F.lit(None)).otherwise(
        F.greatest(F.coalesce(F.col("actual_cash_on_hand"), F.lit(0)) - total, F.lit(0))).cast(MONEY_OUT)
    return (j.withColumn("total_bank_deposit_amount", total)
            .withColumn("remaining_cash_on_register", remaining)
            .drop("__db", "__dd", "__dep"))


def cash_reconciliation_report(recons: DataFrame, branches: DataFrame, prepaid: DataFrame, deposits: DataFrame,
                               branch_id=None, business_date=None) -> DataFrame:
    """Per reconciliation (all branch-days unless filtered): the stored
    snapshot plus prepaid_load_total (prepaid sales of that branch-day),
    total_bank_deposit_amount, remaining_cash_on_register (NULL while open,
    else max(actual − deposits, 0)) and branch_name."""
    r = optional_filters(recons, {"branch_id": branch_id, "business_date": business_date})
    # the same filters on the ledgers, as raw-column predicates that reach their scans
    prepaid = optional_filters(prepaid, {"branch_id": branch_id})
    deposits = optional_filters(deposits, {"branch_id": branch_id, "business_date": business_date})
    if business_date not in (None, ""):
        prepaid = prepaid.filter(day_range("created_at", business_date, business_date))
    pre = prepaid.groupBy(F.col("branch_id").alias("__pb"), F.to_date("created_at").alias("__pd")).agg(
        F.sum("gross_amount").alias("__pre"))
    r = r.join(pre, (r["branch_id"] == pre["__pb"]) & (r["business_date"] == pre["__pd"]), "left")
    r = r.withColumn("prepaid_load_total", F.coalesce(F.col("__pre"), F.lit(0)).cast(MONEY_OUT)).drop(
        "__pb", "__pd", "__pre")
    r = _with_deposits(r, deposits)
    b = branches.select(F.col("id").alias("__bid"), "branch_name")
    return r.join(b, r["branch_id"] == b["__bid"], "left").drop("__bid")


AUDIT_FIELDS = ["cash_sales_amount", "gcash_cash_in_total", "gcash_cash_out_total", "prepaid_load_total",
                "total_bank_deposit_amount", "net_other_cash_impact_amount", "total_cash_inflows",
                "total_cash_outflows", "expected_cash_on_hand", "actual_cash_on_hand",
                "remaining_cash_on_register", "variance_amount", "is_short"]


def audit_summary(report: DataFrame, out: str = "audit_summary") -> DataFrame:
    """Adds the 13-field audit struct to a reconciliation report. Inflows
    are cash sales + cash-in (prepaid not included, T22); outflows are
    cash-out + deposits. Missing values count as 0 / false."""
    def z(c):
        return F.coalesce(F.col(c), F.lit(0)).cast(MONEY_OUT)
    fields = {
        "cash_sales_amount": z("cash_sales_amount"),
        "gcash_cash_in_total": z("gcash_cash_in_total"),
        "gcash_cash_out_total": z("gcash_cash_out_total"),
        "prepaid_load_total": z("prepaid_load_total"),
        "total_bank_deposit_amount": z("total_bank_deposit_amount"),
        "net_other_cash_impact_amount": z("other_cash_impact_amount"),
        "total_cash_inflows": (z("cash_sales_amount") + z("gcash_cash_in_total")).cast(MONEY_OUT),
        "total_cash_outflows": (z("gcash_cash_out_total") + z("total_bank_deposit_amount")).cast(MONEY_OUT),
        "expected_cash_on_hand": z("expected_cash_on_hand"),
        "actual_cash_on_hand": z("actual_cash_on_hand"),
        "remaining_cash_on_register": z("remaining_cash_on_register"),
        "variance_amount": z("variance_amount"),
        "is_short": F.coalesce(F.col("is_short"), F.lit(False)),
    }
    return report.withColumn(out, F.struct(*[v.alias(k) for k, v in fields.items()]))


def reconciliation_register(recons: DataFrame, deposits: DataFrame, branch_id=None, start=None, end=None,
                            limit=None, offset=0) -> DataFrame:
    """Reconciliations (all, or a page) with deposit totals and remaining cash, newest business
    date first (then newest created, then id). A page is taken first; only its branch-days' deposits are totalled."""
    r = optional_filters(recons, {"branch_id": branch_id}).filter(date_between("business_date", start, end))
    deposits = optional_filters(deposits, {"branch_id": branch_id}).filter(date_between("business_date", start, end))
    order = [F.desc_nulls_first("business_date"), F.desc_nulls_first("created_at"), F.asc("id")]
    r = _page(r, order, limit, offset)
    if limit is not None:
        days = r.select("branch_id", "business_date").distinct()
        deposits = deposits.join(days, ["branch_id", "business_date"], "left_semi")
    return _with_deposits(r, deposits).orderBy(*order)
