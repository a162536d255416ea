"""Driver queries for purchasing and stock operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stock as S
from .registry import register

AS_OF = "2001-12-01 00:00:00"


@register("receive_purchase_orders", ["r_pos", "r_po_items", "r_inventories"], """
, added AS (
  SELECT po.branch_id, i.product_variant_id, SUM(i.quantity) AS q
  FROM r_po_items i JOIN r_pos po ON po.id = i.purchase_order_id
  WHERE po.status = 'ordered' AND i.product_variant_id IS NOT NULL
  GROUP BY po.branch_id, i.product_variant_id
)
SELECT COALESCE(v.branch_id, a.branch_id) AS branch_id,
       COALESCE(v.product_variant_id, a.product_variant_id) AS product_variant_id,
       CAST(COALESCE(v.quantity_on_hand, 0) + COALESCE(a.q, 0) AS INT) AS quantity_on_hand
FROM r_inventories v FULL OUTER JOIN added a
  ON a.branch_id = v.branch_id AND a.product_variant_id = v.product_variant_id""")
def q_receive_purchase_orders(a):
    """Every 'ordered' PO received: restock movements merged into inventory."""
    transitions = a.r_pos.filter(F.col("status") == "ordered").select(
        F.col("id").alias("purchase_order_id"), F.lit("received").alias("status"))
    _, inventories, _ = S.receive_purchase_orders(a.r_pos, a.r_po_items, transitions, a.r_inventories, AS_OF)
    return inventories


def _new_items(a):
    e = a.r_estimates
    po = (F.when(F.col("id") % 50 == 0, F.lit(None))
          .when(F.col("id") % 70 == 1, F.lit(0)).otherwise(F.col("purchase_order_id")))
    return e.select(F.col("id").alias("seq"), po.cast("bigint").alias("purchase_order_id"),
                    F.col("product_id").alias("product_variant_id"), F.col("estimated_quantity").alias("quantity"))


@register("post_received_items", ["r_estimates", "r_pos"], f"""
SELECT e.id AS seq, e.po AS purchase_order_id,
       CASE WHEN e.po IS NULL THEN '{S.ERR_PO_REQUIRED}'
            WHEN p.id IS NULL THEN '{S.ERR_PO_NOT_FOUND}'
            WHEN p.status <> 'received' THEN '{S.ERR_PO_NOT_RECEIVED}' END AS reject_reason
FROM (SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 70 = 1 THEN 0 ELSE purchase_order_id END AS po
      FROM r_estimates) e
LEFT JOIN r_pos p ON p.id = e.po""")
def q_post_received_items(a):
    """Items added to POs: only received POs accept them."""
    outcome, _, _ = S.post_received_items(_new_items(a), a.r_pos, a.r_inventories, AS_OF)
    return outcome.select("seq", "purchase_order_id", "reject_reason")


@register("post_received_items_stock", ["r_estimates", "r_pos", "r_inventories"], """
, added AS (
  SELECT p.branch_id, e.product_id AS product_variant_id, SUM(e.estimated_quantity) AS q
  FROM (SELECT *, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 70 = 1 THEN 0 ELSE purchase_order_id END AS po
        FROM r_estimates) e
  JOIN r_pos p ON p.id = e.po
  WHERE p.status = 'received' AND e.product_id IS NOT NULL
  GROUP BY p.branch_id, e.product_id
)
SELECT COALESCE(v.branch_id, a.branch_id) AS branch_id,
       COALESCE(v.product_variant_id, a.product_variant_id) AS product_variant_id,
       CAST(COALESCE(v.quantity_on_hand, 0) + COALESCE(a.q, 0) AS INT) AS quantity_on_hand
FROM r_inventories v FULL OUTER JOIN added a
  ON a.branch_id = v.branch_id AND a.product_variant_id = v.product_variant_id""")
def q_post_received_items_stock(a):
    """Inventory after the accepted added items were restocked."""
    _, _, inventories = S.post_received_items(_new_items(a), a.r_pos, a.r_inventories, AS_OF)
    return inventories


def _estimate_changes(a):
    e = a.r_estimates
    op = F.when(F.col("id") % 3 == 0, "create").when(F.col("id") % 3 == 1, "update").otherwise("delete")
    eid = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.col("id") + 1).otherwise(F.col("id"))
    return e.select(F.col("id").alias("seq"), op.alias("op"), eid.cast("bigint").alias("estimate_id"),
                    F.when(F.col("id") % 3 == 0, F.col("purchase_order_id")).alias("purchase_order_id"))


@register("guard_estimates", ["r_estimates", "r_pos"], f"""
, ch AS (
  SELECT id AS seq,
         CASE WHEN id % 3 = 0 THEN 'create' WHEN id % 3 = 1 THEN 'update' ELSE 'delete' END AS op,
         CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN id + 1 ELSE id END AS estimate_id,
         CASE WHEN id % 3 = 0 THEN purchase_order_id END AS purchase_order_id
  FROM r_estimates
)
SELECT c.seq, c.op,
       CASE WHEN c.op = 'create' AND c.purchase_order_id IS NULL THEN '{S.ERR_PO_REQUIRED}'
            WHEN c.op = 'create' AND p.id IS NULL THEN '{S.ERR_PO_NOT_FOUND}'
            WHEN c.op = 'create' AND p.status = 'received' THEN '{S.ERR_EST_ADD}'
            WHEN c.op <> 'create' AND e.id IS NULL THEN '{S.ERR_EST_NOT_FOUND}'
            WHEN c.op = 'update' AND p.id IS NULL THEN '{S.ERR_PO_NOT_FOUND}'
            WHEN c.op = 'update' AND p.status = 'received' THEN '{S.ERR_EST_MODIFY}'
            WHEN c.op = 'delete' AND p.status = 'received' THEN '{S.ERR_EST_REMOVE}' END AS reject_reason
FROM ch c
LEFT JOIN r_estimates e ON e.id = c.estimate_id
LEFT JOIN r_pos p ON p.id = CASE WHEN c.op = 'create' THEN c.purchase_order_id ELSE e.purchase_order_id END""")
def q_guard_estimates(a):
    """Estimate changes refused on received / missing POs."""
    out = S.guard_estimates(_estimate_changes(a), a.r_estimates, a.r_pos)
    return out.select("seq", "op", "reject_reason")


@register("retire_products", ["r_products", "r_variants", "r_movements"], """
SELECT p.id AS product_id,
       CASE WHEN EXISTS (SELECT 1 FROM r_variants v JOIN r_movements m ON m.product_variant_id = v.id
                         WHERE v.product_id = p.id) THEN 'archived' ELSE 'deleted' END AS action
FROM r_products p""")
def q_retire_products(a):
    """Retire every product: archived when stock history exists, else deleted."""
    outcome, _, _ = S.retire_products(a.r_products, a.r_variants, a.r_movements, a.r_products)
    return outcome


@register("retire_variants", ["r_variants", "r_movements"], """
SELECT v.id AS variant_id,
       CASE WHEN EXISTS (SELECT 1 FROM r_movements m WHERE m.product_variant_id = v.id) THEN 'deactivated'
            ELSE 'deleted' END AS action
FROM r_variants v""")
def q_retire_variants(a):
    """Retire every variant: deactivated when stock history exists, else deleted."""
    outcome, _ = S.retire_variants(a.r_variants, a.r_movements, a.r_variants)
    return outcome


@register("receive_purchase_orders_movements", ["r_pos", "r_po_items"], """
SELECT po.branch_id, i.product_variant_id, 'restock' AS movement_type, i.quantity, po.id AS reference_id
FROM r_pos po JOIN r_po_items i ON i.purchase_order_id = po.id
WHERE po.status = 'ordered' AND i.product_variant_id IS NOT NULL""")
def q_receive_purchase_orders_movements(a):
    """The restock movements that receiving posts."""
    transitions = a.r_pos.filter(F.col("status") == "ordered").select(
        F.col("id").alias("purchase_order_id"), F.lit("received").alias("status"))
    movements, _, _ = S.receive_purchase_orders(a.r_pos, a.r_po_items, transitions, a.r_inventories, AS_OF)
    return movements.select("branch_id", "product_variant_id", "movement_type", "quantity", "reference_id")


@register("receive_purchase_orders_status", ["r_pos"], """
SELECT id, po_number, CASE WHEN status = 'ordered' THEN 'received' ELSE status END AS status FROM r_pos""")
def q_receive_purchase_orders_status(a):
    """The purchase orders after receiving."""
    transitions = a.r_pos.filter(F.col("status") == "ordered").select(
        F.col("id").alias("purchase_order_id"), F.lit("received").alias("status"))
    _, _, pos = S.receive_purchase_orders(a.r_pos, a.r_po_items, transitions, a.r_inventories, AS_OF)
    return pos.select("id", "po_number", "status")


@register("post_received_items_movements", ["r_estimates", "r_pos"], """
SELECT p.branch_id, e.product_id AS product_variant_id, e.estimated_quantity AS quantity, p.id AS reference_id
FROM r_estimates e JOIN r_pos p ON p.status = 'received'
 AND p.id = CASE WHEN e.id % 50 <> 0 THEN CASE WHEN e.id % 70 = 1 THEN 0 ELSE e.purchase_order_id END END
WHERE e.product_id IS NOT NULL""")
def q_post_received_items_movements(a):
    """The restock movements of the accepted items."""
    _, movements, _ = S.post_received_items(_new_items(a), a.r_pos, a.r_inventories, AS_OF)
    return movements.select("branch_id", "product_variant_id", "quantity", "reference_id")


MOVED_SQL = "(SELECT product_variant_id FROM r_movements WHERE product_variant_id IS NOT NULL)"


@register("retire_variants_table", ["r_variants", "r_movements"], f"""
SELECT id, sku, CASE WHEN id % 3 = 0 THEN FALSE ELSE is_active END AS is_active
FROM r_variants WHERE id % 3 <> 0 OR id IN {MOVED_SQL}""")
def q_retire_variants_table(a):
    """The variants after a third of them was retired."""
    _, table = S.retire_variants(a.r_variants, a.r_movements, a.r_variants.filter(F.col("id") % 3 == 0))
    return table.select("id", "sku", "is_active")


@register("retire_products_table", ["r_products", "r_variants", "r_movements"], f"""
SELECT id, CASE WHEN LENGTH(id) % 2 = 0 THEN 'archived' ELSE status END AS status FROM r_products p
WHERE LENGTH(id) % 2 <> 0 OR EXISTS (SELECT 1 FROM r_variants v WHERE v.product_id = p.id AND v.id IN {MOVED_SQL})""")
def q_retire_products_table(a):
    """The products after a part of them was retired."""
    _, products, _ = S.retire_products(a.r_products, a.r_variants, a.r_movements, a.r_products.filter(F.length("id") % 2 == 0))
    return products.select("id", "status")


@register("retire_products_variants", ["r_products", "r_variants", "r_movements"], f"""
, kept AS (SELECT product_id FROM r_variants WHERE id IN {MOVED_SQL})
SELECT id, product_id, CASE WHEN LENGTH(product_id) % 2 = 0 THEN FALSE ELSE is_active END AS is_active FROM r_variants
WHERE LENGTH(product_id) % 2 <> 0 OR product_id IN (SELECT product_id FROM kept)""")
def q_retire_products_variants(a):
    """The variants after a part of the products was retired."""
    _, _, variants = S.retire_products(a.r_products, a.r_variants, a.r_movements, a.r_products.filter(F.length("id") % 2 == 0))
    return variants.select("id", "product_id", "is_active")
