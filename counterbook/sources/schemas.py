"""Declared data model: validation rules, enum domains, CHECK constraints,
unique keys and foreign keys of the back-office tables (metadata only)."""

from __future__ import annotations

# Enum domains of the data model.
ENUMS = {
    "user_role": ["admin", "staff", "cashier"],
    "customer_type": ["online", "walk-in"],
    "supplier_type": ["online", "physical", "both"],
    "product_status": ["active", "archived"],
    "inventory_movement_type": ["sale", "restock", "return", "transfer", "adjustment"],
    "order_status": ["pending", "partially_paid", "paid", "packed", "shipped", "completed", "cancelled", "returned"],
    "payment_method": ["cash", "gcash", "bank_transfer", "card", "cod"],
    "gcash_service_type": ["cash_in", "cash_out"],
    "prepaid_load_carrier": ["smart", "tnt", "globe", "tm", "dito", "gomo", "sun"],
    "return_status": ["pending", "approved", "rejected"],
    "purchase_order_status": ["draft", "estimated", "ordered", "received", "cancelled"],
    "bank_deposit_status": ["posted", "reversed"],
    "load_type": ["regular", "promo", "data", "combo", "unli", "starter_pack", "other"],
}

# Input validation rules per table, in check order.
# (field, type, flag[, enum]) with flag "required", "not_null" (allowNull false),
# "nullable" (allowNull true) or "" (neither given).
VALIDATION = {
    "branches": [("branch_name", "string", "required"), ("address", "text", "nullable"),
                 ("phone", "string", "nullable"), ("is_main", "boolean", "nullable")],
    "sales_channels": [("channel_name", "string", "required")],
    "users": [("full_name", "string", "nullable"), ("phone", "string", "nullable"), ("email", "string", "nullable"),
              ("password_hash", "text", "nullable"), ("role", "enum", "not_null", "user_role"),
              ("branch_id", "uuid", "nullable"), ("is_active", "boolean", "nullable")],
    "customers": [("full_name", "string", "required"), ("phone", "string", "required"),
                  ("email", "string", "nullable"), ("address", "text", "nullable"),
                  ("customer_type", "enum", "not_null", "customer_type")],
    "suppliers": [("supplier_name", "string", "nullable"), ("phone", "string", "required"),
                  ("email", "string", "nullable"), ("address", "text", "nullable"),
                  ("supplier_type", "enum", "not_null", "supplier_type"), ("notes", "text", "nullable")],
    "categories": [("category_name", "string", "nullable"), ("parent_id", "uuid", "nullable")],
    "products": [("product_name", "string", "nullable"), ("description", "text", "nullable"),
                 ("photo_url", "string", "nullable"), ("category_id", "uuid", "nullable"),
                 ("brand", "string", "nullable"), ("status", "enum", "not_null", "product_status")],
    "product_variants": [("product_id", "uuid", "required"), ("sku", "string", "nullable"),
                         ("class", "string", "nullable"), ("product_type", "string", "nullable"),
                         ("brand", "string", "nullable"), ("photo_url", "string", "nullable"),
                         ("size", "string", "nullable"), ("color", "string", "nullable"),
                         ("is_active", "boolean", "nullable"), ("price", "numeric", "nullable"),
                         ("cost_price", "numeric", "nullable")],
    "inventories": [("branch_id", "uuid", "required"), ("product_variant_id", "uuid", "required"),
                    ("quantity_on_hand", "number", "nullable"), ("reorder_level", "number", "nullable")],
    "inventory_movements": [("branch_id", "uuid", "nullable"), ("product_variant_id", "uuid", "nullable"),
                            ("movement_type", "enum", "required", "inventory_movement_type"),
                            ("quantity", "number", "required"), ("reference_type", "string", "nullable"),
                            ("reference_id", "uuid", "nullable")],
    "orders": [("order_number", "string", "nullable"), ("customer_id", "uuid", "nullable"),
               ("branch_id", "uuid", "nullable"), ("sales_channel_id", "uuid", "nullable"),
               ("order_status", "enum", "not_null", "order_status"), ("total_amount", "numeric", "nullable")],
    "order_items": [("order_id", "uuid", "required"), ("product_variant_id", "uuid", "nullable"),
                    ("quantity", "number", "required"), ("unit_price", "numeric", "nullable"),
                    ("subtotal", "numeric", "nullable")],
    "payments": [("order_id", "uuid", "required"), ("payment_method", "enum", "required", "payment_method"),
                 ("amount", "numeric", "required"), ("received_by", "uuid", "nullable"),
                 ("payment_date", "timestamp", "nullable")],
    "gcash_fee_rules": [("service_type", "enum", "required", "gcash_service_type"),
                        ("min_amount", "numeric", "required"), ("max_amount", "numeric", "nullable"),
                        ("fee_amount", "numeric", "required"), ("is_active", "boolean", "nullable"),
                        ("effective_from", "timestamp", "nullable"), ("effective_to", "timestamp", "nullable")],
    "gcash_transactions": [("order_id", "uuid", "nullable"), ("branch_id", "uuid", "nullable"),
                           ("customer_id", "uuid", "nullable"),
                           ("service_type", "enum", "required", "gcash_service_type"),
                           ("principal_amount", "numeric", "required"), ("fee_amount", "numeric", "required"),
                           ("gross_amount", "numeric", "required"), ("cash_impact", "numeric", "required"),
                           ("reference_number", "string", "required"), ("fee_rule_id", "uuid", "nullable"),
                           ("received_by", "uuid", "nullable"), ("notes", "text", "nullable"),
                           ("created_at", "timestamp", "nullable")],
    "prepaid_load_products": [("carrier", "enum", "required", "prepaid_load_carrier"),
                              ("product_code", "string", "required"), ("product_name", "string", "required"),
                              ("description", "text", "nullable"), ("load_type", "enum", "not_null", "load_type"),
                              ("face_value", "numeric", "required"), ("markup_amount", "numeric", "nullable"),
                              ("validity_days", "number", "nullable"), ("is_active", "boolean", "nullable"),
                              ("source_url", "string", "nullable"), ("updated_at", "timestamp", "nullable")],
    "prepaid_load_transactions": [("order_id", "uuid", "nullable"), ("branch_id", "uuid", "nullable"),
                                  ("customer_id", "uuid", "nullable"), ("recipient_mobile_no", "string", "required"),
                                  ("carrier", "enum", "required", "prepaid_load_carrier"),
                                  ("product_id", "uuid", "required"), ("face_value", "numeric", "required"),
                                  ("markup_amount", "numeric", "required"), ("gross_amount", "numeric", "required"),
                                  ("cash_impact", "numeric", "required"), ("reference_number", "string", "required"),
                                  ("received_by", "uuid", "nullable"), ("notes", "text", "nullable"),
                                  ("created_at", "timestamp", "nullable")],
    "returns": [("order_id", "uuid", "required"), ("branch_id", "uuid", "nullable"), ("reason", "text", "nullable"),
                ("return_status", "enum", "not_null", "return_status")],
    "return_items": [("return_id", "uuid", "required"), ("product_variant_id", "uuid", "nullable"),
                     ("quantity", "number", "required")],
    "purchase_orders": [("supplier_id", "uuid", "required"), ("branch_id", "uuid", "required"),
                        ("po_number", "string", "required"),
                        ("status", "enum", "required", "purchase_order_status"),
                        ("total_cost", "numeric", "nullable"), ("shipping_cost", "numeric", "nullable"),
                        ("tipping_cost", "numeric", "nullable"), ("miscellaneous_cost", "numeric", "nullable")],
    "purchase_order_items": [("purchase_order_id", "uuid", "required"), ("product_variant_id", "uuid", "nullable"),
                             ("quantity", "number", "required"), ("cost_price", "numeric", "nullable")],
    "expenses": [("branch_id", "uuid", "nullable"), ("expense_type", "string", "nullable"),
                 ("description", "text", "nullable"), ("amount", "numeric", "nullable"),
                 ("expense_date", "date", "nullable")],
    "bank_deposits": [("branch_id", "uuid", "required"), ("cash_reconciliation_id", "uuid", "nullable"),
                      ("business_date", "date", "required"), ("amount", "numeric", "required"),
                      ("bank_account", "string", "required"), ("reference_number", "string", "required"),
                      ("depositor_name", "string", "required"), ("photo_proof_url", "string", "required"),
                      ("status", "enum", "nullable", "bank_deposit_status"), ("reversal_of_id", "uuid", "nullable"),
                      ("reversal_reason", "text", "nullable"), ("reversed_by", "uuid", "nullable"),
                      ("reversed_at", "timestamp", "nullable"), ("notes", "text", "nullable"),
                      ("deposited_by", "uuid", "nullable"), ("deposited_at", "timestamp", "nullable")],
}

# Enum-typed columns of the stored tables (for domain audits).
# Enum of each column.
DOMAINS = {
    "users": {"role": "user_role"},
    "customers": {"customer_type": "customer_type"},
    "suppliers": {"supplier_type": "supplier_type"},
    "products": {"status": "product_status"},
    "inventory_movements": {"movement_type": "inventory_movement_type"},
    "orders": {"order_status": "order_status"},
    "payments": {"payment_method": "payment_method"},
    "gcash_fee_rules": {"service_type": "gcash_service_type"},
    "gcash_transactions": {"service_type": "gcash_service_type"},
    "prepaid_load_products": {"carrier": "prepaid_load_carrier", "load_type": "load_type"},
    "prepaid_load_transactions": {"carrier": "prepaid_load_carrier"},
    "returns": {"return_status": "return_status"},
    "purchase_orders": {"status": "purchase_order_status"},
    "bank_deposits": {"status": "bank_deposit_status"},
}

# CHECK constraints (name, Spark SQL condition). A NULL result
# passes, as in SQL.
CHECKS = {
    "gcash_fee_rules": [("min_amount_nonnegative", "min_amount >= 0"),
                        ("max_amount_not_below_min", "max_amount IS NULL OR max_amount >= min_amount"),
                        ("fee_amount_nonnegative", "fee_amount >= 0")],
    "gcash_transactions": [("principal_amount_positive", "principal_amount > 0"),
                           ("fee_amount_nonnegative", "fee_amount >= 0"),
                           ("gross_amount_nonnegative", "gross_amount >= 0")],
    "prepaid_load_products": [("face_value_positive", "face_value > 0"),
                              ("markup_amount_nonnegative", "markup_amount >= 0"),
                              ("validity_days_positive", "validity_days IS NULL OR validity_days > 0")],
    "prepaid_load_transactions": [("face_value_positive", "face_value > 0"),
                                  ("markup_amount_nonnegative", "markup_amount >= 0"),
                                  ("gross_amount_positive", "gross_amount > 0")],
    "purchase_order_estimates": [("estimated_quantity_positive", "estimated_quantity > 0"),
                                 ("estimated_total_cost_nonnegative", "estimated_total_cost >= 0")],
    "bank_deposits": [("amount_nonzero", "amount <> 0")],
    "purchase_orders": [("status_known", "status IN ('draft','estimated','ordered','received','cancelled')")],
}

# Unique keys (a partial key carries its WHERE condition).
# Unique keys.
UNIQUE = {
    "sales_channels": [["channel_name"]],
    "users": [["phone"]],
    "customers": [["phone"]],
    "product_variants": [["sku"]],
    "inventories": [["branch_id", "product_variant_id"]],
    "orders": [["order_number"]],
    "prepaid_load_products": [["product_code"]],
    "purchase_orders": [["po_number"]],
    "gcash_transactions": [["reference_number"]],
    "prepaid_load_transactions": [["reference_number"]],
    "bank_deposits": [["reference_number"], ["reversal_of_id"]],
    "cash_reconciliations": [["branch_id", "business_date"]],
}

# Foreign keys: (child table, column, parent table, on delete).
# Foreign keys with their delete actions.
FOREIGN_KEYS = [
    ("users", "branch_id", "branches", "set_null"),
    ("categories", "parent_id", "categories", "set_null"),
    ("products", "category_id", "categories", "set_null"),
    ("product_variants", "product_id", "products", "cascade"),
    ("inventories", "branch_id", "branches", "cascade"),
    ("inventories", "product_variant_id", "product_variants", "cascade"),
    ("inventory_movements", "branch_id", "branches", "set_null"),
    ("inventory_movements", "product_variant_id", "product_variants", "set_null"),
    ("orders", "customer_id", "customers", "set_null"),
    ("orders", "branch_id", "branches", "set_null"),
    ("orders", "sales_channel_id", "sales_channels", "set_null"),
    ("order_items", "order_id", "orders", "cascade"),
    ("order_items", "product_variant_id", "product_variants", "set_null"),
    ("payments", "order_id", "orders", "cascade"),
    ("payments", "received_by", "users", "set_null"),
    ("gcash_transactions", "order_id", "orders", "set_null"),
    ("gcash_transactions", "branch_id", "branches", "set_null"),
    ("gcash_transactions", "customer_id", "customers", "set_null"),
    ("gcash_transactions", "fee_rule_id", "gcash_fee_rules", "set_null"),
    ("gcash_transactions", "received_by", "users", "set_null"),
    ("prepaid_load_transactions", "order_id", "orders", "set_null"),
    ("prepaid_load_transactions", "branch_id", "branches", "set_null"),
    ("prepaid_load_transactions", "customer_id", "customers", "set_null"),
    ("prepaid_load_transactions", "product_id", "prepaid_load_products", "restrict"),
    ("prepaid_load_transactions", "received_by", "users", "set_null"),
    ("returns", "order_id", "orders", "cascade"),
    ("returns", "branch_id", "branches", "set_null"),
    ("return_items", "return_id", "returns", "cascade"),
    ("return_items", "product_variant_id", "product_variants", "set_null"),
    ("purchase_orders", "supplier_id", "suppliers", "restrict"),
    ("purchase_orders", "branch_id", "branches", "restrict"),
    ("purchase_order_items", "purchase_order_id", "purchase_orders", "cascade"),
    ("purchase_order_items", "product_variant_id", "product_variants", "set_null"),
    ("purchase_order_estimates", "purchase_order_id", "purchase_orders", "cascade"),
    ("purchase_order_estimates", "product_id", "products", "set_null"),
    ("expenses", "branch_id", "branches", "set_null"),
    ("cash_reconciliations", "branch_id", "branches", "cascade"),
    ("cash_reconciliations", "opened_by", "users", "set_null"),
    ("cash_reconciliations", "closed_by", "users", "set_null"),
    ("bank_deposits", "branch_id", "branches", "cascade"),
    ("bank_deposits", "cash_reconciliation_id", "cash_reconciliations", "set_null"),
    ("bank_deposits", "reversal_of_id", "bank_deposits", "restrict"),
    ("bank_deposits", "reversed_by", "users", "set_null"),
    ("bank_deposits", "deposited_by", "users", "set_null"),
]

# Spark schemas of the back-office tables (DDL). Ids are text (UUIDs); money
# is DECIMAL(12,2); timestamps are TIMESTAMP_NTZ in UTC; the cash breakdowns
# are arrays of {denomination, quantity, amount}.
_BREAKDOWN = "array<struct<denomination:decimal(12,2),quantity:int,amount:decimal(12,2)>>"
# Declared columns.
TABLE_DDL = {
    "branches": "id string, branch_name string, address string, phone string, is_main boolean, "
                "created_at timestamp_ntz",
    "sales_channels": "id string, channel_name string",
    "users": "id string, full_name string, phone string, email string, password_hash string, role string, "
             "branch_id string, is_active boolean, created_at timestamp_ntz",
    "customers": "id string, full_name string, phone string, email string, address string, customer_type string, "
                 "created_at timestamp_ntz",
    "suppliers": "id string, supplier_name string, phone string, email string, address string, "
                 "supplier_type string, notes string, created_at timestamp_ntz",
    "categories": "id string, category_name string, parent_id string",
    "products": "id string, product_name string, description string, photo_url string, category_id string, "
                "brand string, status string, created_at timestamp_ntz",
    "product_variants": "id string, product_id string, sku string, class string, product_type string, brand string, "
                        "photo_url string, size string, color string, price decimal(12,2), "
                        "cost_price decimal(12,2), is_active boolean, created_at timestamp_ntz",
    "inventories": "id string, branch_id string, product_variant_id string, quantity_on_hand int, reorder_level int",
    "inventory_movements": "id string, branch_id string, product_variant_id string, movement_type string, "
                           "quantity int, reference_type string, reference_id string, created_at timestamp_ntz",
    "orders": "id string, order_number string, customer_id string, branch_id string, sales_channel_id string, "
              "order_status string, total_amount decimal(12,2), discount_percentage decimal(5,2), "
              "discount_amount decimal(12,2), created_at timestamp_ntz",
    "order_items": "id string, order_id string, product_variant_id string, quantity int, unit_price decimal(12,2), "
                   "subtotal decimal(12,2)",
    "payments": "id string, order_id string, payment_method string, amount decimal(12,2), received_by string, "
                "payment_date timestamp_ntz",
    "gcash_fee_rules": "id string, service_type string, min_amount decimal(12,2), max_amount decimal(12,2), "
                       "fee_amount decimal(12,2), is_active boolean, effective_from timestamp_ntz, "
                       "effective_to timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "gcash_transactions": "id string, order_id string, branch_id string, customer_id string, service_type string, "
                          "principal_amount decimal(12,2), fee_amount decimal(12,2), gross_amount decimal(12,2), "
                          "cash_impact decimal(12,2), reference_number string, fee_rule_id string, "
                          "received_by string, notes string, created_at timestamp_ntz",
    "prepaid_load_products": "id string, carrier string, product_code string, product_name string, "
                             "description string, load_type string, face_value decimal(12,2), "
                             "markup_amount decimal(12,2), validity_days int, is_active boolean, source_url string, "
                             "created_at timestamp_ntz, updated_at timestamp_ntz",
    "prepaid_load_transactions": "id string, order_id string, branch_id string, customer_id string, "
                                 "recipient_mobile_no string, carrier string, product_id string, "
                                 "face_value decimal(12,2), markup_amount decimal(12,2), gross_amount decimal(12,2), "
                                 "cash_impact decimal(12,2), reference_number string, received_by string, "
                                 "notes string, created_at timestamp_ntz",
    "returns": "id string, order_id string, branch_id string, reason string, return_status string, "
               "created_at timestamp_ntz",
    "return_items": "id string, return_id string, product_variant_id string, quantity int",
    "purchase_orders": "id string, supplier_id string, branch_id string, po_number string, status string, "
                       "total_cost decimal(12,2), created_at timestamp_ntz, shipping_cost decimal(12,2), "
                       "tipping_cost decimal(12,2), miscellaneous_cost decimal(12,2)",
    "purchase_order_items": "id string, purchase_order_id string, product_variant_id string, quantity int, "
                            "cost_price decimal(12,2)",
    "purchase_order_estimates": "id string, purchase_order_id string, product_id string, estimated_quantity int, "
                                "estimated_total_cost decimal(12,2), notes string, created_at timestamp_ntz, "
                                "updated_at timestamp_ntz",
    "expenses": "id string, branch_id string, expense_type string, description string, amount decimal(12,2), "
                "expense_date date",
    "cash_reconciliations": f"id string, branch_id string, business_date date, "
                            f"opening_cash_breakdown {_BREAKDOWN}, closing_cash_breakdown {_BREAKDOWN}, "
                            "opening_cash_total decimal(12,2), closing_cash_total decimal(12,2), "
                            "total_sales_amount decimal(12,2), cash_sales_amount decimal(12,2), "
                            "other_cash_impact_amount decimal(12,2), gcash_cash_in_total decimal(12,2), "
                            "gcash_cash_out_total decimal(12,2), expected_cash_on_hand decimal(12,2), "
                            "actual_cash_on_hand decimal(12,2), variance_amount decimal(12,2), is_short boolean, "
                            "notes string, opened_by string, closed_by string, opened_at timestamp_ntz, "
                            "closed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "bank_deposits": "id string, branch_id string, cash_reconciliation_id string, business_date date, "
                     "amount decimal(12,2), bank_account string, reference_number string, depositor_name string, "
                     "photo_proof_url string, status string, reversal_of_id string, reversal_reason string, "
                     "reversed_by string, reversed_at timestamp_ntz, notes string, deposited_by string, "
                     "deposited_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
}

# Column defaults applied by inserts and additive migrations (literal values;
# "now" columns are filled by the operators with their ``as_of``).
# Declared column defaults.
DEFAULTS = {
    "branches": {"is_main": False},
    "users": {"role": "staff", "is_active": True},
    "customers": {"customer_type": "walk-in"},
    "suppliers": {"supplier_type": "physical"},
    "products": {"status": "active"},
    "product_variants": {"price": 0, "cost_price": 0, "is_active": True},
    "inventories": {"quantity_on_hand": 0, "reorder_level": 0},
    "orders": {"order_status": "pending", "total_amount": 0, "discount_percentage": 0, "discount_amount": 0},
    "order_items": {"quantity": 1, "unit_price": 0, "subtotal": 0},
    "gcash_fee_rules": {"is_active": True},
    "prepaid_load_products": {"load_type": "regular", "markup_amount": 0, "is_active": True},
    "returns": {"return_status": "pending"},
    "return_items": {"quantity": 1},
    "purchase_orders": {"shipping_cost": 0, "tipping_cost": 0, "miscellaneous_cost": 0},
    "purchase_order_items": {"quantity": 1, "cost_price": 0},
    "expenses": {"amount": 0},
    "cash_reconciliations": {"opening_cash_total": 0, "closing_cash_total": 0, "total_sales_amount": 0,
                             "cash_sales_amount": 0, "other_cash_impact_amount": 0, "gcash_cash_in_total": 0,
                             "gcash_cash_out_total": 0, "expected_cash_on_hand": 0, "actual_cash_on_hand": 0,
                             "variance_amount": 0, "is_short": False},
    "bank_deposits": {"amount": 0, "status": "posted"},
}


def table_schema(name: str):
    """``StructType`` of a back-office table (parsed by the active session)."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(TABLE_DDL[name])
