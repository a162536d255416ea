"""Prepaid phone-load catalog merge and sale posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import MONEY
from ..functions.text import id_ok, id_or_null, new_id, normalize_mobile, required_text
from .changes import append_accepted
from .joins import mark_taken

# Columns a re-seed overwrites on a product_code conflict; the others
# (markup_amount, is_active, description, ids, created_at) are kept.
SEED_OVERWRITES = ["carrier", "product_name", "load_type", "face_value", "validity_days", "source_url"]

# Rejection texts of prepaid posting.
ERR_PRODUCT_REQUIRED = "product_id is required"
ERR_PRODUCT_UUID = "product_id must be a UUID"
ERR_REF = "reference_number is required"
ERR_MOBILE_REQUIRED = "recipient_mobile_no is required"
ERR_MOBILE_INVALID = "recipient_mobile_no must be a valid Philippine mobile number"
ERR_PRODUCT_INACTIVE = "prepaid load product not found or inactive"
ERR_FACE = "face_value must be a positive number"
ERR_DUPLICATE = "reference_number already exists"
ERR_UUID = "{field} must be a UUID"


def upsert_catalog(catalog: DataFrame, incoming: DataFrame, as_of="1970-01-01 00:00:00", seq: str | None = None,
                   id_expr: Column | None = None) -> DataFrame:
    """Insert by ``product_code``; on conflict overwrite carrier, name,
    load_type, face_value, validity and source and stamp ``updated_at``, but
    keep markup_amount, is_active and description. Within ``incoming`` the
    last row of a code wins (rows apply in ``seq`` order, else input order
    is irrelevant because codes are unique). Idempotent: re-applying the same
    incoming rows changes nothing but ``updated_at``."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    inc = incoming
    if seq is not None:
        fields = [c for c in inc.columns if c not in ("product_code", seq)]
        inc = (inc.groupBy("product_code").agg(F.max_by(F.struct(*fields), F.col(seq)).alias("__v"))
               .select("product_code", *[F.col("__v." + c).alias(c) for c in fields]))
    n = inc.select(*[F.col(c).alias("__n_" + c) for c in inc.columns])
    j = catalog.join(n, catalog["product_code"] == n["__n_product_code"], "full_outer")
    in_cat = catalog["product_code"].isNotNull()
    in_new = F.col("__n_product_code").isNotNull()
    cols = []
    for c in catalog.columns:
        dt = catalog.schema[c].dataType
        new_val = F.col("__n_" + c).cast(dt) if c in inc.columns else None
        if c == "product_code":
            v = F.coalesce(catalog[c], F.col("__n_product_code"))
        elif c in SEED_OVERWRITES and new_val is not None:
            v = F.when(in_new, new_val).otherwise(catalog[c])
        elif c == "updated_at":
            v = F.when(in_new, now).otherwise(catalog[c])
        elif c == "created_at":
            v = F.when(in_cat, catalog[c]).otherwise(now)
        elif c == "id":
            v = F.when(in_cat, catalog[c]).otherwise(
                (id_expr if id_expr is not None else new_id("prepaid_load_product", dt, "__n_product_code")).cast(dt))
        elif c == "markup_amount":
            v = F.when(in_cat, catalog[c]).otherwise(F.coalesce(new_val, F.lit(0)).cast(dt) if new_val is not None
                                                     else F.lit(0).cast(dt))
        elif c == "is_active":
            v = F.when(in_cat, catalog[c]).otherwise(F.coalesce(new_val, F.lit(True)) if new_val is not None
                                                     else F.lit(True))
        else:
            v = F.when(in_cat, catalog[c]).otherwise(new_val if new_val is not None else F.lit(None).cast(dt))
        cols.append(v.cast(dt).alias(c))
    return j.select(*cols)


def post_prepaid_sales(requests: DataFrame, catalog: DataFrame, ledger: DataFrame, seq: str = "seq") -> DataFrame:
    """Price prepaid-load sale requests: product id given (and UUID-shaped if
    text), reference given, recipient mobile normalised ('09…' kept,
    '639…' → '0…', others refused), product active, face value positive,
    optional ids well-formed, reference new (ledger and earlier requests).
    gross = face + markup, cash_impact = gross. Returns requests + priced
    columns + ``reject_reason``."""
    r = requests
    pid_type = r.schema["product_id"].dataType
    pid_blank = F.col("product_id").isNull()
    if isinstance(pid_type, T.StringType):
        pid_blank = pid_blank | (F.col("product_id") == "")
    mobile_raw = required_text(F.col("recipient_mobile_no"))
    r = r.select("*", required_text(F.col("reference_number")).alias("__ref"), mobile_raw.alias("__mobile_raw"),
                 normalize_mobile(mobile_raw).alias("__mobile"))
    cat = catalog.filter(F.col("is_active") == F.lit(True)).select(
        F.col("id").alias("__cid"), F.col("carrier").alias("__carrier"), F.col("face_value").alias("__face"),
        F.col("markup_amount").alias("__markup"))
    j = r.join(cat, r["product_id"] == cat["__cid"], "left")
    reason = (F.when(~id_ok(F.col("product_id"), pid_type), F.lit(ERR_PRODUCT_UUID))
              .when(pid_blank, F.lit(ERR_PRODUCT_REQUIRED))
              .when(F.col("__ref").isNull(), F.lit(ERR_REF))
              .when(F.col("__mobile_raw").isNull(), F.lit(ERR_MOBILE_REQUIRED))
              .when(F.col("__mobile").isNull(), F.lit(ERR_MOBILE_INVALID))
              .when(F.col("__cid").isNull(), F.lit(ERR_PRODUCT_INACTIVE))
              .when(F.col("__face").isNull() | (F.col("__face") <= 0), F.lit(ERR_FACE)))
    for f in ("order_id", "branch_id", "customer_id", "received_by"):
        if f in r.columns:
            reason = reason.when(~id_ok(F.col(f), r.schema[f].dataType), F.lit(ERR_UUID.format(field=f)))
    j = j.withColumn("__pre", reason)
    j = mark_taken(j, "__ref", seq, F.col("__pre").isNull(), ledger, "reference_number", "__taken")
    markup = F.coalesce(F.col("__markup"), F.lit(0)).cast(MONEY)
    gross = (F.col("__face") + markup).cast(MONEY)
    extra = [id_or_null(F.col(f), r.schema[f].dataType).alias(f) for f in ("order_id", "branch_id", "customer_id",
                                                                         "received_by") if f in r.columns]
    return j.select(
        F.col(seq), F.col("product_id"), *extra,
        F.col("__mobile").alias("recipient_mobile_no"), F.col("__carrier").alias("carrier"),
        F.col("__face").cast(MONEY).alias("face_value"), markup.alias("markup_amount"),
        gross.alias("gross_amount"), gross.alias("cash_impact"), F.col("__ref").alias("reference_number"),
        F.coalesce(F.col("__pre"), F.when(F.col("__taken"), F.lit(ERR_DUPLICATE))).alias("reject_reason"),
    )


def append_prepaid_sales(ledger: DataFrame, outcome: DataFrame, id_expr: Column | None = None,
                         as_of="1970-01-01 00:00:00") -> DataFrame:
    """New ledger version: the ledger plus the accepted rows of ``post_prepaid_sales``."""
    return append_accepted(ledger, outcome, "prepaid_load_transaction", id_expr, as_of)
