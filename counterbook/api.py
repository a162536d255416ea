"""``BackOffice``: the back office's reports, registers, postings and audits
over a folder of tables (one parquet folder per table, named as in
``sources.schemas.TABLE_DDL``). Each method builds one Spark job from the
operators; postings return ``(outcome, new table version)`` for the caller
to write with ``sources.tables.write_version``.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cash as C
from .operators import changes as CH
from .operators import deposits as DP
from .operators import fees as FE
from .operators import listing as L
from .operators import prepaid as P
from .operators import quality as Q
from .operators import reports as R
from .operators import stock as S
from .sources.schemas import CHECKS, DEFAULTS, DOMAINS, TABLE_DDL, UNIQUE, table_schema
from .sources.tables import read_table


#: The HTTP rule for the top-products report; lists and registers default to pages of 100 there too.
TOP_PRODUCTS_CAP = 100


class BackOffice:
    def __init__(self, spark: SparkSession, root: str, as_of: str | dt.datetime | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.as_of = str(as_of) if as_of is not None else dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        self._tables: dict[str, DataFrame] = {}

    # ------------------------------------------------------------------ tables
    def table(self, name: str) -> DataFrame:
        """A table read with its declared schema: stored columns are cast to
        the declared types, missing (newer) columns get their defaults."""
        if name not in self._tables:
            raw = read_table(self.spark, self.root, name)
            schema = table_schema(name)
            cast = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields
                                if f.name in raw.columns])
            self._tables[name] = CH.evolve_schema(cast, schema, DEFAULTS.get(name))
        return self._tables[name]

    def has(self, name: str) -> bool:
        """Whether the table is there; any other failure to read it is raised."""
        try:
            self.table(name)
            return True
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    # ------------------------------------------------------------------ reports
    def sales_summary(self, period="daily", from_=None, to=None, branch_id=None, sales_channel_id=None,
                      order_grain: bool = False) -> DataFrame:
        return R.sales_summary(self.table("orders"), self.table("order_items"),
                               self.table("prepaid_load_transactions"), period, from_, to, branch_id,
                               sales_channel_id, self.as_of, fan_out=not order_grain)

    def overview(self, from_=None, to=None, branch_id=None, sales_channel_id=None) -> DataFrame:
        return R.sales_overview(self.table("orders"), self.table("order_items"),
                                self.table("prepaid_load_transactions"), from_, to, branch_id, sales_channel_id,
                                self.as_of)

    def payment_breakdown(self, from_=None, to=None, branch_id=None) -> DataFrame:
        return R.payment_breakdown(self.table("payments"), self.table("orders"),
                                   self.table("prepaid_load_transactions"), from_, to, branch_id, self.as_of)

    def top_products(self, from_=None, to=None, branch_id=None, limit=10) -> DataFrame:
        return R.top_products(self.table("order_items"), self.table("orders"), self.table("product_variants"),
                              self.table("products"), self.table("prepaid_load_transactions"),
                              self.table("prepaid_load_products"), from_, to, branch_id, limit, self.as_of,
                              cap=TOP_PRODUCTS_CAP)

    def cash_reconciliation(self, branch_id=None, business_date=None) -> DataFrame:
        rep = C.cash_reconciliation_report(self.table("cash_reconciliations"), self.table("branches"),
                                           self.table("prepaid_load_transactions"), self.table("bank_deposits"),
                                           branch_id, business_date)
        return C.audit_summary(rep)

    def reconciliations(self, branch_id=None, from_=None, to=None, limit=100, offset=0) -> DataFrame:
        return C.reconciliation_register(self.table("cash_reconciliations"), self.table("bank_deposits"),
                                         branch_id, from_, to, limit, offset)

    def deposits(self, branch_id=None, business_date=None, from_=None, to=None, cash_reconciliation_id=None,
                 limit=100, offset=0) -> DataFrame:
        return DP.deposit_register(self.table("bank_deposits"), self.table("branches"), self.table("users"),
                                   branch_id, business_date, from_, to, cash_reconciliation_id, limit, offset)

    def product_variants(self, product_id=None, is_active=None, limit=100, offset=0) -> DataFrame:
        return R.variants_with_product(self.table("product_variants"), self.table("products"), product_id,
                                       is_active, limit, offset)

    def purchase_orders_with_totals(self, where=None, limit=100, offset=0) -> DataFrame:
        return R.purchase_orders_with_totals(self.table("purchase_orders"), self.table("purchase_order_items"),
                                             where, limit, offset)

    def purchase_order_variance(self) -> DataFrame:
        return R.purchase_order_variance(self.table("purchase_orders"), self.table("purchase_order_estimates"),
                                         self.table("purchase_order_items"))

    def list(self, name: str, where: str | None = None, limit=100, offset=0) -> DataFrame:
        return L.recent_rows(self.table(name), where, limit, offset)

    def children(self, name: str, fk: str, parent: str, parent_where: str | None = None) -> DataFrame:
        parents = self.table(parent).filter(F.expr(parent_where)) if parent_where else self.table(parent)
        return L.rows_by_parent(self.table(name), fk, parents)

    # ------------------------------------------------------------------ postings
    def daily_cash_totals(self, start=None, end=None) -> DataFrame:
        return C.daily_cash_totals(self.table("orders"), self.table("payments"), self.table("gcash_transactions"),
                                   self.table("prepaid_load_transactions"), start, end)

    def open_days(self, openings: DataFrame, upsert: bool = False, seq: str = "seq"):
        return C.open_days(self.table("cash_reconciliations"), openings, "upsert" if upsert else "insert",
                           self.as_of, seq)

    def close_days(self, closings: DataFrame, seq: str = "seq"):
        recons = self.table("cash_reconciliations")
        totals = C.daily_cash_totals(self.table("orders"), self.table("payments"), self.table("gcash_transactions"),
                                     self.table("prepaid_load_transactions"), days=C.closing_days(recons, closings))
        return C.close_days(recons, closings, totals, self.as_of, seq)

    def post_gcash_transactions(self, requests: DataFrame, seq: str = "seq"):
        ledger = self.table("gcash_transactions")
        outcome = FE.post_wallet_transactions(requests, self.table("gcash_fee_rules"), ledger, self.as_of, seq)
        return outcome, FE.append_wallet_transactions(ledger, outcome, as_of=self.as_of)

    def load_fee_rules(self, candidates: DataFrame, seq: str = "seq"):
        return FE.load_fee_rules(candidates, self.table("gcash_fee_rules"), self.as_of, seq=seq)

    def post_prepaid_sales(self, requests: DataFrame, seq: str = "seq"):
        ledger = self.table("prepaid_load_transactions")
        outcome = P.post_prepaid_sales(requests, self.table("prepaid_load_products"), ledger, seq)
        return outcome, P.append_prepaid_sales(ledger, outcome, as_of=self.as_of)

    def post_deposits(self, requests: DataFrame, seq: str = "seq"):
        ledger = self.table("bank_deposits")
        outcome = DP.post_deposits(requests, self.table("cash_reconciliations"), ledger, self.as_of, seq)
        return outcome, DP.append_deposits(ledger, outcome, as_of=self.as_of)

    def reverse_deposits(self, requests: DataFrame, posting_date=None, seq: str = "seq"):
        return DP.reverse_deposits(requests, self.table("bank_deposits"), self.as_of, posting_date, seq)

    def receive_purchase_orders(self, transitions: DataFrame, seq: str | None = None):
        return S.receive_purchase_orders(self.table("purchase_orders"), self.table("purchase_order_items"),
                                         transitions, self.table("inventories"), self.as_of, seq)

    def post_received_items(self, new_items: DataFrame):
        return S.post_received_items(new_items, self.table("purchase_orders"), self.table("inventories"), self.as_of)

    def guard_estimates(self, changes: DataFrame) -> DataFrame:
        return S.guard_estimates(changes, self.table("purchase_order_estimates"), self.table("purchase_orders"))

    # ------------------------------------------------------------------ table changes
    def append(self, name: str, incoming: DataFrame, key_cols: list[str] | None = None):
        return CH.append_rows(self.table(name), incoming, name, key_cols=key_cols)

    def patch(self, name: str, patches: DataFrame, seq: str | None = None):
        return CH.apply_patches(self.table(name), patches, "id", seq, name)

    def delete(self, name: str, keys: DataFrame) -> dict[str, DataFrame]:
        """New versions of the table and of every table its foreign-key actions touch."""
        tables = {t: self.table(t) for t in TABLE_DDL if self.has(t)}
        out = CH.propagate_deletes(tables, name, keys)
        return {t: df for t, df in out.items() if df is not tables[t]}

    def retire_products(self, keys: DataFrame):
        return S.retire_products(self.table("products"), self.table("product_variants"),
                                 self.table("inventory_movements"), keys)

    def retire_variants(self, keys: DataFrame):
        return S.retire_variants(self.table("product_variants"), self.table("inventory_movements"), keys)

    def upsert_catalog(self, incoming: DataFrame, seq: str | None = None) -> DataFrame:
        return P.upsert_catalog(self.table("prepaid_load_products"), incoming, self.as_of, seq)

    def repair_cash_out_impact(self) -> DataFrame:
        return C.repair_cash_out_impact(self.table("gcash_transactions"))

    def backfill_deposits(self) -> DataFrame:
        return DP.backfill_deposits(self.table("bank_deposits"), self.as_of)

    # ------------------------------------------------------------------ audits
    def audit(self) -> DataFrame:
        """One data-quality report over every table present: enum domain
        violations, CHECK violations, duplicate unique keys and orphaned
        foreign keys, as (table_name, check_kind, check_name, detail, row_count)."""
        parts = []
        present = [t for t in TABLE_DDL if self.has(t)]
        for t in present:
            df = self.table(t)
            if t in DOMAINS:
                d = Q.audit_domain(df, t)
                parts.append(d.select("table_name", F.lit("domain").alias("check_kind"),
                                      F.col("column_name").alias("check_name"), F.col("value").alias("detail"),
                                      "row_count"))
            if t in CHECKS:
                c = Q.audit_checks(df, t).groupBy("check_name").agg(F.count(F.lit(1)).alias("row_count"))
                parts.append(c.select(F.lit(t).alias("table_name"), F.lit("check").alias("check_kind"),
                                      "check_name", F.lit(None).cast("string").alias("detail"), "row_count"))
            for cols in UNIQUE.get(t, []):
                u = Q.audit_unique(df, cols)
                parts.append(u.select(F.lit(t).alias("table_name"), F.lit("unique").alias("check_kind"),
                                      F.lit(",".join(cols)).alias("check_name"),
                                      F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("detail"),
                                      "row_count"))
        orphans = Q.audit_all_references({t: self.table(t) for t in present})
        if orphans is not None:
            parts.append(orphans.select(F.col("child").alias("table_name"), F.lit("reference").alias("check_kind"),
                                        F.concat("fk", F.lit(" -> "), "parent").alias("check_name"),
                                        F.lit(None).cast("string").alias("detail"), "row_count"))
        if not parts:
            return self.spark.createDataFrame([], "table_name string, check_kind string, check_name string, "
                                                  "detail string, row_count bigint")
        return reduce(DataFrame.unionByName, parts)
