"""Cash drawer semantics on literal frames."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from counterbook.operators import cash as C


def ts(s):
    return dt.datetime.fromisoformat(s)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


BD = "array<struct<denomination:decimal(12,2),quantity:int>>"


def test_cash_breakdown_sort_amount_total_and_errors(spark):
    df = spark.createDataFrame([
        (1, [(D("20.00"), 3), (D("1000.00"), 1), (D("0.25"), 4)]),
        (2, [(D("50.00"), 0)]),
        (3, []),
        (4, None),
        (5, [(D("100.00"), 1), (D("5.00"), -1), (D("0.00"), 1)]),
        (6, [(D("0.00"), 2), (D("5.00"), -1)]),
    ], f"id int, b {BD}")
    out = {r["id"]: r for r in rows(C.cash_breakdown(df, "b", "total"))}
    assert [e["denomination"] for e in out[1]["b"]] == [D("1000.00"), D("20.00"), D("0.25")]
    assert [e["amount"] for e in out[1]["b"]] == [D("1000.00"), D("60.00"), D("1.00")]
    assert out[1]["total"] == D("1061.00") and out[1]["breakdown_error"] is None
    assert out[2]["total"] == D("0.00")  # zero quantity is allowed
    assert out[3]["total"] == D("0.00") and out[4]["total"] == D("0.00")  # empty / missing -> []
    assert out[5]["breakdown_error"] == C.ERR_QUANTITY and out[5]["total"] is None  # first bad element wins
    assert out[6]["breakdown_error"] == C.ERR_DENOMINATION


def test_cash_breakdown_double_quantity_must_be_integer(spark):
    df = spark.createDataFrame([(1, [(20.0, 1.5)]), (2, [(20.0, 2.0)])],
                               "id int, b array<struct<denomination:double,quantity:double>>")
    out = {r["id"]: r for r in rows(C.cash_breakdown(df, "b", "total"))}
    assert out[1]["breakdown_error"] == C.ERR_QUANTITY
    assert out[2]["total"] == D("40.00")


def test_wallet_cash_impact_and_repair(spark):
    g = spark.createDataFrame([
        (1, "cash_out", D("100.00"), D("110.00"), D("-110.00")),
        (2, "cash_out", D("50.00"), D("55.00"), D("-50.00")),
        (3, "cash_in", D("100.00"), D("105.00"), D("105.00")),
        (4, "cash_in", D("100.00"), None, D("7.00")),
        (5, "other", None, None, D("-3.00")),
        (6, "cash_out", None, None, None),
    ], "id int, service_type string, principal_amount decimal(12,2), gross_amount decimal(12,2), "
       "cash_impact decimal(12,2)")
    eff = {r["id"]: r["e"] for r in rows(g.select("id", C.wallet_cash_impact().alias("e")))}
    assert eff == {1: D("-100.00"), 2: D("-50.00"), 3: D("105.00"), 4: D("7.00"), 5: D("-3.00"), 6: D("0.00")}
    fixed = {r["id"]: r for r in rows(C.repair_cash_out_impact(g))}
    assert fixed[1]["cash_impact"] == D("-100.00") and fixed[1]["impact_repaired"]
    assert not fixed[2]["impact_repaired"] and not fixed[6]["impact_repaired"]


def _ledgers(spark):
    orders = spark.createDataFrame([
        (1, 7, "completed", D("100.00"), ts("2024-01-02 10:00:00")),
        (2, 7, "cancelled", D("500.00"), ts("2024-01-02 11:00:00")),
        (3, 7, None, D("40.00"), ts("2024-01-02 12:00:00")),
    ], "id bigint, branch_id bigint, order_status string, total_amount decimal(12,2), created_at timestamp_ntz")
    payments = spark.createDataFrame([
        (1, 1, "cash", D("60.00"), ts("2024-01-02 10:05:00")),
        (2, 1, "card", D("40.00"), ts("2024-01-02 10:05:00")),
        (3, 2, "cash", D("500.00"), ts("2024-01-02 11:05:00")),
        (4, 1, "cash", D("5.00"), ts("2024-01-03 09:00:00")),
    ], "id bigint, order_id bigint, payment_method string, amount decimal(12,2), payment_date timestamp_ntz")
    gcash = spark.createDataFrame([
        (1, 7, "cash_in", D("100.00"), D("105.00"), D("105.00"), ts("2024-01-02 13:00:00")),
        (2, 7, "cash_out", D("80.00"), D("88.00"), D("-88.00"), ts("2024-01-02 14:00:00")),
        (3, None, "cash_in", D("10.00"), D("11.00"), D("11.00"), ts("2024-01-02 14:00:00")),
    ], "id bigint, branch_id bigint, service_type string, principal_amount decimal(12,2), gross_amount decimal(12,2), "
       "cash_impact decimal(12,2), created_at timestamp_ntz")
    prepaid = spark.createDataFrame([(1, 7, D("51.00"), D("51.00"), ts("2024-01-02 15:00:00"))],
                                    "id bigint, branch_id bigint, gross_amount decimal(12,2), cash_impact decimal(12,2), "
                                    "created_at timestamp_ntz")
    return orders, payments, gcash, prepaid


def test_daily_cash_totals(spark):
    t = {(r["branch_id"], r["business_date"]): r for r in rows(C.daily_cash_totals(*_ledgers(spark)))}
    d = t[(7, dt.date(2024, 1, 2))]
    assert d["total_sales_amount"] == D("100.00")  # cancelled and NULL-status orders excluded
    assert d["cash_sales_amount"] == D("60.00")
    assert d["other_cash_impact_amount"] == D("105.00") - D("80.00") + D("51.00")
    assert d["gcash_cash_in_total"] == D("105.00") and d["gcash_cash_out_total"] == D("80.00")
    assert t[(7, dt.date(2024, 1, 3))]["cash_sales_amount"] == D("5.00")  # by payment date
    assert all(k[0] is not None for k in t)


def _recons(spark):
    schema = C.empty_recons(spark).schema
    base = dict(closing_cash_breakdown=[], closing_cash_total=D("0"), total_sales_amount=D("0"),
                cash_sales_amount=D("0"), other_cash_impact_amount=D("0"), gcash_cash_in_total=D("0"),
                gcash_cash_out_total=D("0"), expected_cash_on_hand=D("0"), actual_cash_on_hand=D("0"),
                variance_amount=D("0"), is_short=False, closed_by=None, closed_at=None,
                created_at=ts("2024-01-02 06:00:00"), updated_at=ts("2024-01-02 06:00:00"))
    rws = [dict(base, id=1, branch_id=7, business_date=dt.date(2024, 1, 2), opening_cash_breakdown=[],
                opening_cash_total=D("1000.00"), notes="float", opened_by=3, opened_at=ts("2024-01-02 06:00:00")),
           dict(base, id=2, branch_id=7, business_date=dt.date(2024, 1, 3), opening_cash_breakdown=[],
                opening_cash_total=D("500.00"), notes=None, opened_by=3, opened_at=ts("2024-01-03 06:00:00"))]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rws], schema)


def test_close_days_and_report(spark):
    orders, payments, gcash, prepaid = _ledgers(spark)
    totals = C.daily_cash_totals(orders, payments, gcash, prepaid)
    recons = _recons(spark)
    closings = spark.createDataFrame([
        (1, [(D("1000.00"), 1), (D("20.00"), 3)], None, 9, ts("2024-01-02 20:00:00"), 1),
        (99, [], None, 9, ts("2024-01-02 20:00:00"), 2),
        (2, [(D("5.00"), -1)], None, 9, ts("2024-01-03 20:00:00"), 3),
    ], f"id bigint, closing_cash_breakdown {BD}, notes string, closed_by bigint, closed_at timestamp_ntz, seq int")
    outcome, table = C.close_days(recons, closings, totals)
    reasons = {r["id"]: r["reject_reason"] for r in rows(outcome)}
    assert reasons == {1: None, 99: C.ERR_RECON_NOT_FOUND, 2: C.ERR_QUANTITY}
    t = {r["id"]: r for r in rows(table)}
    expected = D("1000.00") + D("60.00") + (D("105.00") - D("80.00") + D("51.00"))
    assert t[1]["expected_cash_on_hand"] == expected
    assert t[1]["actual_cash_on_hand"] == D("1060.00")
    assert t[1]["variance_amount"] == D("1060.00") - expected and t[1]["is_short"]
    assert t[1]["notes"] == "float" and t[1]["closed_by"] == 9  # notes kept when none given
    assert t[2]["closed_at"] is None  # invalid closing left the day open

    # closing again recomputes (T20) and new notes replace old ones
    again = spark.createDataFrame([(1, [(D("1000.00"), 2)], "recount", 9, ts("2024-01-02 21:00:00"), 1)],
                                  f"id bigint, closing_cash_breakdown {BD}, notes string, closed_by bigint, "
                                  "closed_at timestamp_ntz, seq int")
    _, table2 = C.close_days(table, again, totals)
    t2 = {r["id"]: r for r in rows(table2)}
    assert t2[1]["actual_cash_on_hand"] == D("2000.00") and not t2[1]["is_short"] and t2[1]["notes"] == "recount"

    branches = spark.createDataFrame([(7, "Main")], "id bigint, branch_name string")
    deposits = spark.createDataFrame([
        (7, dt.date(2024, 1, 2), D("1500.00")), (7, dt.date(2024, 1, 2), D("-1500.00")),
        (7, dt.date(2024, 1, 2), D("2000.00")), (7, dt.date(2024, 1, 3), D("10.00")),
    ], "branch_id bigint, business_date date, amount decimal(12,2)")
    rep = {r["id"]: r for r in rows(C.audit_summary(C.cash_reconciliation_report(table, branches, prepaid, deposits)))}
    assert rep[1]["total_bank_deposit_amount"] == D("2000.00")  # reversal nets to 0 (T17)
    assert rep[1]["remaining_cash_on_register"] == D("0.00")  # floored at 0 (T16)
    assert rep[2]["remaining_cash_on_register"] is None  # still open
    assert rep[1]["prepaid_load_total"] == D("51.00") and rep[1]["branch_name"] == "Main"
    a = rep[1]["audit_summary"]
    assert a["total_cash_inflows"] == D("60.00") + D("105.00")  # prepaid not included (T22)
    assert a["total_cash_outflows"] == D("80.00") + D("2000.00")
    assert rep[2]["audit_summary"]["remaining_cash_on_register"] == D("0.00")
    reg = rows(C.reconciliation_register(table, deposits, branch_id=7))
    assert [r["id"] for r in reg] == [2, 1]


def test_open_days_insert_and_upsert(spark):
    recons = _recons(spark)
    _, closed = C.close_days(recons, spark.createDataFrame(
        [(1, [], None, 9, ts("2024-01-02 20:00:00"), 1)],
        f"id bigint, closing_cash_breakdown {BD}, notes string, closed_by bigint, closed_at timestamp_ntz, seq int"),
        C.empty_recons(spark).select("branch_id", "business_date", *[F.lit(0).cast("decimal(38,2)").alias(c)
                                                                     for c in C.TOTAL_COLUMNS]))
    openings = spark.createDataFrame([
        (7, dt.date(2024, 1, 2), [(D("100.00"), 1)], "late", 4, 1),   # closed day
        (7, dt.date(2024, 1, 3), [(D("100.00"), 2)], None, None, 2),  # open day
        (7, dt.date(2024, 1, 4), [(D("50.00"), 1)], None, 4, 3),      # new day
        (7, dt.date(2024, 1, 4), [(D("20.00"), 1)], "second", None, 4),
        (None, dt.date(2024, 1, 5), [], None, None, 5),
        (8, None, [], None, None, 6),                                 # missing date -> as_of day
    ], f"branch_id bigint, business_date date, opening_cash_breakdown {BD}, notes string, opened_by bigint, seq int")
    out, _ = C.open_days(closed, openings, "insert", "2024-01-09 08:00:00")
    r = {x["seq"]: x["reject_reason"] for x in rows(out)}
    assert r == {1: C.ERR_OPEN_EXISTS, 2: C.ERR_OPEN_EXISTS, 3: None, 4: C.ERR_OPEN_EXISTS,
                 5: C.ERR_BRANCH_REQUIRED, 6: None}
    assert {x["seq"]: x["business_date"] for x in rows(out)}[6] == dt.date(2024, 1, 9)

    out, table = C.open_days(closed, openings, "upsert", "2024-01-09 08:00:00",
                             id_expr=F.lit(77).cast("bigint"))
    r = {x["seq"]: x["reject_reason"] for x in rows(out)}
    assert r[1] == C.ERR_OPEN_CLOSED and r[2] is None and r[3] is None and r[4] is None
    t = {(x["branch_id"], x["business_date"]): x for x in rows(table)}
    assert t[(7, dt.date(2024, 1, 3))]["opening_cash_total"] == D("200.00")
    assert t[(7, dt.date(2024, 1, 3))]["opened_by"] == 3  # COALESCE(new, old)
    assert t[(7, dt.date(2024, 1, 4))]["opening_cash_total"] == D("20.00")  # last request wins
    assert t[(7, dt.date(2024, 1, 4))]["notes"] == "second" and t[(7, dt.date(2024, 1, 4))]["opened_by"] == 4
    assert t[(7, dt.date(2024, 1, 2))]["opening_cash_total"] == D("1000.00")  # closed day untouched


def test_report_filters_reach_the_ledgers(spark):
    orders, payments, gcash, prepaid = _ledgers(spark)
    recons = _recons(spark)
    branches = spark.createDataFrame([(7, "Main")], "id bigint, branch_name string")
    deposits = spark.createDataFrame([(7, dt.date(2024, 1, 2), D("5.00")), (7, dt.date(2024, 1, 3), D("6.00"))],
                                     "branch_id bigint, business_date date, amount decimal(12,2)")
    one = rows(C.cash_reconciliation_report(recons, branches, prepaid, deposits, branch_id=7,
                                            business_date=dt.date(2024, 1, 2)))
    assert len(one) == 1 and one[0]["total_bank_deposit_amount"] == D("5.00")
    assert one[0]["prepaid_load_total"] == D("51.00")
    reg = rows(C.reconciliation_register(recons, deposits, start="2024-01-03", end="2024-01-03"))
    assert [(r["id"], r["total_bank_deposit_amount"]) for r in reg] == [(2, D("6.00"))]


def test_windowed_totals_keep_payments_of_older_orders(spark):
    orders, payments, gcash, prepaid = _ledgers(spark)
    # payment 4 (cash, 2024-01-03) belongs to order 1 created on 2024-01-02
    t = {(r["branch_id"], r["business_date"]): r
         for r in rows(C.daily_cash_totals(orders, payments, gcash, prepaid, "2024-01-03", "2024-01-03"))}
    assert t[(7, dt.date(2024, 1, 3))]["cash_sales_amount"] == D("5.00")
    assert (7, dt.date(2024, 1, 2)) not in t


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _serial_open(stored, reqs, mode):
    """Brute force: apply opening requests one at a time."""
    state = {k: dict(v) for k, v in stored.items()}
    out = {}
    for seq, key, total, notes, by in sorted(reqs):
        cur = state.get(key)
        if mode == "insert":
            if cur is not None:
                out[seq] = C.ERR_OPEN_EXISTS
                continue
            state[key] = {"total": total, "notes": notes, "by": by, "closed": False}
        else:
            if cur is not None and cur["closed"]:
                out[seq] = C.ERR_OPEN_CLOSED
                continue
            if cur is None:
                state[key] = {"total": total, "notes": notes, "by": by, "closed": False}
            else:
                cur.update(total=total, notes=notes if notes is not None else cur["notes"],
                           by=by if by is not None else cur["by"])
        out[seq] = None
    return out, state


@settings(max_examples=8, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3), st.one_of(st.none(), st.sampled_from(["a", "b"])),
                          st.one_of(st.none(), st.integers(5, 6))), min_size=1, max_size=12),
       st.sampled_from(["insert", "upsert"]))
def test_open_days_matches_serial_model(spark, reqs, mode):
    base = _recons(spark)  # (7, Jan 2) opening 1000, notes 'float', by 3; (7, Jan 3) opening 500
    _, stored = C.close_days(base, spark.createDataFrame(
        [(1, [], None, 9, ts("2024-01-02 20:00:00"), 1)],
        f"id bigint, closing_cash_breakdown {BD}, notes string, closed_by bigint, closed_at timestamp_ntz, seq int"),
        C.empty_recons(spark).select("branch_id", "business_date", *[F.lit(0).cast("decimal(38,2)").alias(c)
                                                                     for c in C.TOTAL_COLUMNS]))
    model_stored = {dt.date(2024, 1, 2): {"total": D("1000.00"), "notes": "float", "by": 3, "closed": True},
                    dt.date(2024, 1, 3): {"total": D("500.00"), "notes": None, "by": 3, "closed": False}}
    day = {1: dt.date(2024, 1, 2), 2: dt.date(2024, 1, 3), 3: dt.date(2024, 1, 4)}
    rows_in = [(i, day[d], q, notes, by) for i, (d, q, notes, by) in enumerate(reqs)]
    df = spark.createDataFrame([(7, d, [(D("100.00"), q)], notes, by, i) for i, d, q, notes, by in rows_in],
                               f"branch_id bigint, business_date date, opening_cash_breakdown {BD}, notes string, "
                               "opened_by bigint, seq int")
    outcome, table = C.open_days(stored, df, mode, "2024-01-09 08:00:00", id_expr=F.lit(77).cast("bigint"))
    want_out, want_state = _serial_open(model_stored, [(i, d, D(100 * q), n, b) for i, d, q, n, b in rows_in],
                                        mode)
    assert {r["seq"]: r["reject_reason"] for r in outcome.collect()} == want_out
    got = {r["business_date"]: {"total": r["opening_cash_total"], "notes": r["notes"], "by": r["opened_by"],
                                "closed": r["closed_at"] is not None} for r in table.collect()}
    assert got == want_state


@settings(max_examples=8, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.sampled_from([1, 2, 99]), st.integers(-1, 3),
                          st.one_of(st.none(), st.sampled_from(["x", "y"])),
                          st.one_of(st.none(), st.integers(8, 9))), min_size=1, max_size=10))
def test_close_days_matches_serial_model(spark, reqs):
    recons = _recons(spark)
    totals = C.empty_recons(spark).select("branch_id", "business_date", *[F.lit(0).cast("decimal(38,2)").alias(c)
                                                                          for c in C.TOTAL_COLUMNS])
    df = spark.createDataFrame(
        [(rid, [(D("10.00"), q)], notes, by, ts("2024-01-05 20:00:00"), i) for i, (rid, q, notes, by) in enumerate(reqs)],
        f"id bigint, closing_cash_breakdown {BD}, notes string, closed_by bigint, closed_at timestamp_ntz, seq int")
    outcome, table = C.close_days(recons, df, totals)
    state = {1: {"actual": D(0), "notes": "float", "by": None, "closed": False, "opening": D("1000.00")},
             2: {"actual": D(0), "notes": None, "by": None, "closed": False, "opening": D("500.00")}}
    want = {}
    for i, (rid, q, notes, by) in enumerate(reqs):
        if q < 0:
            want[i] = C.ERR_QUANTITY
        elif rid not in state:
            want[i] = C.ERR_RECON_NOT_FOUND
        else:
            want[i] = None
            s = state[rid]
            s.update(actual=D(10 * q), by=by, closed=True, notes=notes if notes is not None else s["notes"])
    assert {r["seq"]: r["reject_reason"] for r in outcome.collect()} == want
    got = {r["id"]: r for r in table.collect()}
    for rid, s in state.items():
        g = got[rid]
        assert (g["closed_at"] is not None) == s["closed"]
        if s["closed"]:
            assert g["actual_cash_on_hand"] == s["actual"] and g["closed_by"] == s["by"]
            assert g["variance_amount"] == s["actual"] - s["opening"]
        assert g["notes"] == s["notes"]
