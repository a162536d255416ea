"""Stock and purchasing operators: receiving purchase orders into inventory,
posting items added to received orders, estimate guards, and retiring
products / variants with or without stock history.

The reference posts one movement and one inventory update per item in a row
loop; here a receipt batch becomes one set of movements, one aggregate per
(branch, variant) and one full-outer merge into the inventory table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import new_id
from ..session import cut_lineage
from .joins import keys_present

# Rejection texts.
ERR_PO_REQUIRED = "purchase_order_id is required"
ERR_PO_NOT_FOUND = "purchase order not found"
ERR_PO_NOT_RECEIVED = 'purchase_order_items can only be added when purchase order status is "received"'
ERR_EST_ADD = "Cannot add estimate to a received purchase order"
ERR_EST_MODIFY = "Cannot modify estimate for a received purchase order"
ERR_EST_REMOVE = "Cannot remove estimate from a received purchase order"
ERR_EST_NOT_FOUND = "estimate not found"


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def merge_stock(inventories: DataFrame, movements: DataFrame, id_expr: Column | None = None) -> DataFrame:
    """Add movement quantities to ``quantity_on_hand`` per (branch, variant);
    a missing inventory row is created with the added quantity. Movements
    are aggregated first (a hot variant is combined map-side), then merged
    with one full outer join on the unique (branch, variant) key."""
    add = movements.groupBy(F.col("branch_id").alias("__b"), F.col("product_variant_id").alias("__v")).agg(
        F.sum("quantity").alias("__add"))
    j = inventories.join(add, (inventories["branch_id"] == add["__b"])
                         & (inventories["product_variant_id"] == add["__v"]), "full_outer")
    have = inventories["branch_id"].isNotNull() | inventories["product_variant_id"].isNotNull()
    cols = []
    for c in inventories.columns:
        dt = inventories.schema[c].dataType
        if c == "branch_id":
            v = F.when(have, inventories[c]).otherwise(F.col("__b"))
        elif c == "product_variant_id":
            v = F.when(have, inventories[c]).otherwise(F.col("__v"))
        elif c == "quantity_on_hand":
            v = F.coalesce(inventories[c], F.lit(0)) + F.coalesce(F.col("__add"), F.lit(0))
        elif c == "id":
            v = F.when(have, inventories[c]).otherwise(
                id_expr if id_expr is not None else new_id("inventory", dt, F.col("__b"), F.col("__v")))
        elif c == "reorder_level":
            v = F.when(have, inventories[c]).otherwise(F.lit(0))
        else:
            v = F.when(have, inventories[c])
        cols.append(v.cast(dt).alias(c))
    return j.select(*cols)


def _restock_rows(items: DataFrame, as_of) -> DataFrame:
    return items.filter(F.col("product_variant_id").isNotNull()).select(
        F.col("__po_branch").alias("branch_id"), "product_variant_id", F.lit("restock").alias("movement_type"),
        F.col("quantity").cast("int").alias("quantity"), F.lit("purchase_order").alias("reference_type"),
        F.col("purchase_order_id").alias("reference_id"), _ts(as_of).alias("created_at"))


def receive_purchase_orders(pos: DataFrame, po_items: DataFrame, transitions: DataFrame, inventories: DataFrame,
                            as_of="1970-01-01 00:00:00", seq: str | None = None
                            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply status changes (``transitions``: purchase_order_id, status and,
    when a PO may change more than once in a batch, a request order ``seq``).
    Every change of a PO from another status to 'received' posts one
    'restock' movement per item that has a variant (posting is not
    idempotent: received -> ordered -> received posts twice) and adds the
    quantity to the inventory of (PO branch, variant). Every item is posted
    (no 1000-item cap, T30). Returns (movements, new inventories, new
    purchase orders with each PO's last status)."""
    t = transitions.select(F.col("purchase_order_id").alias("__tid"), F.col("status").alias("__new"),
                           (F.col(seq) if seq else F.lit(0)).alias("__seq"))
    stored = pos.select(F.col("id").alias("__tid"), F.col("status").alias("__old"))
    t = t.join(stored, "__tid", "inner")  # changes to unknown POs do nothing
    # previous status of each change: the stored one, then the prior change's
    # (changes of one PO are a handful of requests, ordered per PO)
    w = Window.partitionBy("__tid").orderBy("__seq")
    t = t.withColumn("__prev", F.coalesce(F.lag("__new").over(w), F.col("__old")))
    t = cut_lineage(t) if seq else t
    posts = (t.filter((F.col("__new") == "received") & ~F.coalesce(F.col("__prev") == "received", F.lit(False)))
             .groupBy("__tid").agg(F.count(F.lit(1)).alias("__times")))
    last = t.groupBy("__tid").agg(F.max_by("__new", "__seq").alias("__last"))
    p = pos.join(last, pos["id"] == last["__tid"], "left")
    new_pos = p.select(*[F.coalesce(F.col("__last"), pos["status"]).alias(c) if c == "status" else pos[c]
                         for c in pos.columns])
    received = pos.join(posts, pos["id"] == posts["__tid"], "inner").select(
        F.col("id").alias("__po_id"), F.col("branch_id").alias("__po_branch"), "__times")
    items = po_items.join(received, po_items["purchase_order_id"] == received["__po_id"], "inner")
    items = items.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    movements = _restock_rows(items, as_of)
    return movements, merge_stock(inventories, movements), new_pos


def post_received_items(new_items: DataFrame, pos: DataFrame, inventories: DataFrame, as_of="1970-01-01 00:00:00",
                        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items may only be added to received POs; each accepted item with a
    variant posts a restock. Returns (outcome with reject_reason, movements,
    new inventories)."""
    p = pos.select(F.col("id").alias("__pid"), F.col("branch_id").alias("__po_branch"),
                   F.col("status").alias("__po_status"))
    j = new_items.join(p, new_items["purchase_order_id"] == p["__pid"], "left")
    reason = (F.when(F.col("purchase_order_id").isNull(), F.lit(ERR_PO_REQUIRED))
              .when(F.col("__pid").isNull(), F.lit(ERR_PO_NOT_FOUND))
              .when(F.col("__po_status") != "received", F.lit(ERR_PO_NOT_RECEIVED)))
    j = j.withColumn("reject_reason", reason)
    movements = _restock_rows(j.filter(F.col("reject_reason").isNull()), as_of)
    outcome = j.drop("__pid", "__po_branch", "__po_status")
    return outcome, movements, merge_stock(inventories, movements)


def guard_estimates(changes: DataFrame, estimates: DataFrame, pos: DataFrame) -> DataFrame:
    """Refuse estimate changes on received (or missing) POs. ``changes``: op
    ('create' | 'update' | 'delete'), estimate_id (update/delete),
    purchase_order_id (create). Update/delete find the PO through the stored
    estimate; deleting an estimate whose PO is gone is allowed."""
    e = estimates.select(F.col("id").alias("__eid"), F.col("purchase_order_id").alias("__epo"))
    p = pos.select(F.col("id").alias("__pid"), F.col("status").alias("__pst"))
    c = changes.join(e, changes["estimate_id"] == e["__eid"], "left")
    po_ref = F.when(F.col("op") == "create", F.col("purchase_order_id")).otherwise(F.col("__epo"))
    c = c.withColumn("__po", po_ref).join(p, F.col("__po") == p["__pid"], "left")
    received = F.coalesce(F.col("__pst") == "received", F.lit(False))
    reason = (F.when((F.col("op") == "create") & F.col("purchase_order_id").isNull(), F.lit(ERR_PO_REQUIRED))
              .when((F.col("op") == "create") & F.col("__pid").isNull(), F.lit(ERR_PO_NOT_FOUND))
              .when((F.col("op") == "create") & received, F.lit(ERR_EST_ADD))
              .when((F.col("op") != "create") & F.col("__eid").isNull(), F.lit(ERR_EST_NOT_FOUND))
              .when((F.col("op") == "update") & F.col("__pid").isNull(), F.lit(ERR_PO_NOT_FOUND))
              .when((F.col("op") == "update") & received, F.lit(ERR_EST_MODIFY))
              .when((F.col("op") == "delete") & received, F.lit(ERR_EST_REMOVE)))
    return c.withColumn("reject_reason", reason).drop("__eid", "__epo", "__po", "__pid", "__pst")


def retire_variants(variants: DataFrame, movements: DataFrame, keys: DataFrame,
                    key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Remove variants: one with stock history is deactivated, one without is
    deleted. Returns (outcome per key: action 'deactivated' | 'deleted' |
    'not_found', new variants table)."""
    k = keys.select(F.col(key).alias("__k")).distinct()
    # only movements of the batch's variants are looked at
    moved = keys_present(movements, "product_variant_id", k, "__k", "__mv")
    v = (variants.join(k, variants["id"] == k["__k"], "left")
         .join(moved, variants["id"] == moved["__mv"], "left"))
    target = F.col("__k").isNotNull()
    history = F.col("__mv").isNotNull()
    action = F.when(target & history, F.lit("deactivated")).when(target, F.lit("deleted"))
    v = v.withColumn("__action", action)
    new_variants = v.filter(F.coalesce(F.col("__action") != "deleted", F.lit(True))).select(
        *[F.when(F.col("__action") == "deactivated", F.lit(False)).otherwise(variants[c]).alias(c)
          if c == "is_active" else variants[c] for c in variants.columns])
    found = v.filter(target).select(F.col("id").alias("variant_id"), F.col("__action").alias("action"))
    missing = k.join(variants.select(F.col("id").alias("__vid")), k["__k"] == F.col("__vid"), "left_anti").select(
        F.col("__k").alias("variant_id"), F.lit("not_found").alias("action"))
    return found.unionByName(missing), new_variants


def retire_products(products: DataFrame, variants: DataFrame, movements: DataFrame, keys: DataFrame,
                    key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove products: a product any of whose variants has stock history is
    archived and all its variants deactivated; otherwise the product is
    deleted and its variants go with it (ON DELETE CASCADE). Returns (outcome
    per key, new products, new variants)."""
    k = keys.select(F.col(key).alias("__k")).distinct()
    # only movements of the batch's products' variants are looked at
    theirs = variants.join(k, variants["product_id"] == k["__k"], "left_semi").select(F.col("id").alias("__vid"))
    moved = keys_present(movements, "product_variant_id", theirs, "__vid", "__mv")
    with_history = (variants.join(moved, variants["id"] == moved["__mv"], "left_semi")
                    .select(F.col("product_id").alias("__hp")).distinct())
    p = (products.join(k, products["id"] == k["__k"], "left")
         .join(with_history, products["id"] == with_history["__hp"], "left"))
    target = F.col("__k").isNotNull()
    action = F.when(target & F.col("__hp").isNotNull(), F.lit("archived")).when(target, F.lit("deleted"))
    p = p.withColumn("__action", action)
    new_products = p.filter(F.coalesce(F.col("__action") != "deleted", F.lit(True))).select(
        *[F.when(F.col("__action") == "archived", F.lit("archived")).otherwise(products[c]).alias(c)
          if c == "status" else products[c] for c in products.columns])
    acts = p.filter(target).select(F.col("id").alias("__pid"), F.col("__action").alias("__pact"))
    vj = variants.join(acts, variants["product_id"] == acts["__pid"], "left")
    new_variants = vj.filter(F.coalesce(F.col("__pact") != "deleted", F.lit(True))).select(
        *[F.when(F.col("__pact") == "archived", F.lit(False)).otherwise(variants[c]).alias(c)
          if c == "is_active" else variants[c] for c in variants.columns])
    found = acts.select(F.col("__pid").alias("product_id"), F.col("__pact").alias("action"))
    missing = k.join(products.select(F.col("id").alias("__p")), k["__k"] == F.col("__p"), "left_anti").select(
        F.col("__k").alias("product_id"), F.lit("not_found").alias("action"))
    return found.unionByName(missing), new_products, new_variants
