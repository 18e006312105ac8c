"""Declared schemas. Readers never infer.

Types: keys bigint, money decimal(12,2), quantity decimal(10,2), weight and volume
decimal(10,3), rate decimal(5,2), instalment and capacity decimal(15,2), dates
``date``, times ``timestamp_ntz``, JSON documents as string.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# The tables the tests and the bench are given.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"
_ITEM = (
    "product_id bigint, line_number bigint, description string, quantity decimal(10,2), unit_of_measure string, "
    "unit_price decimal(12,2), discount_percentage decimal(5,2), tax_percentage decimal(5,2), "
    "line_total decimal(12,2), notes string, " + _STAMPS
)
_AMOUNTS = (
    "currency string, subtotal decimal(12,2), discount_percentage decimal(5,2), discount_amount decimal(12,2), "
    "tax_percentage decimal(5,2), tax_amount decimal(12,2), shipping_cost decimal(12,2), total_amount decimal(12,2)"
)
_BANK = "bank_name string, bank_account string, bank_branch string"

# The business tables.
BUSINESS = {
    "user_roles": f"id bigint, name string, description string, permissions string, {_STAMPS}",
    "users": "id bigint, username string, email string, password_hash string, first_name string, last_name string, "
             "role_id bigint, is_active boolean, last_login timestamp_ntz, phone string, address string, "
             f"avatar_url string, preferences string, {_STAMPS}",
    "settings": f"id bigint, key string, value string, category string, description string, is_public boolean, {_STAMPS}",
    "product_families": "id bigint, code string, name string, parent_id bigint, description string, level int, "
                        f"path string, is_active boolean, created_by bigint, {_STAMPS}",
    "products": "id bigint, sku string, barcode string, name string, description string, family_id bigint, "
                "weight decimal(10,3), weight_unit string, volume decimal(10,3), volume_unit string, "
                "length decimal(10,2), width decimal(10,2), height decimal(10,2), dimension_unit string, "
                "unit_of_measure string, quantity_in_stock decimal(10,2), min_stock_level decimal(10,2), "
                "max_stock_level decimal(10,2), reorder_point decimal(10,2), reorder_quantity decimal(10,2), "
                "default_supplier_id bigint, last_purchase_price decimal(12,2), cost_price decimal(12,2), "
                "selling_price decimal(12,2), currency string, tax_rate decimal(5,2), warehouse_location string, "
                "shelf_location string, is_active boolean, is_featured boolean, image_url string, "
                "additional_images string, manufacturer string, brand string, model string, color string, "
                f"size string, tags string, custom_fields string, created_by bigint, {_STAMPS}, "
                "last_stock_check timestamp_ntz",
    "stock_movements": "id bigint, movement_type string, reference_number string, product_id bigint, "
                       "quantity decimal(10,2), unit_price decimal(12,2), total_value decimal(12,2), "
                       "quantity_before decimal(10,2), quantity_after decimal(10,2), from_location string, "
                       "to_location string, warehouse string, warehouse_id bigint, related_document_type string, "
                       "related_document_id bigint, sales_order_id bigint, reason string, notes string, "
                       "batch_number string, expiry_date date, movement_date timestamp_ntz, created_by bigint, "
                       "approved_by bigint, is_approved boolean, approved_at timestamp_ntz, created_at timestamp_ntz",
    "suppliers": "id bigint, code string, name string, contact_person string, email string, phone string, "
                 "mobile string, fax string, website string, company string, address string, city string, "
                 "state_province string, postal_code string, country string, tax_id string, "
                 "registration_number string, currency string, payment_terms string, credit_limit decimal(12,2), "
                 f"current_balance decimal(12,2), {_BANK}, iban string, swift_code string, rating decimal(3,2), "
                 "total_purchases decimal(12,2), total_orders int, is_active boolean, notes string, tags string, "
                 f"custom_fields string, created_by bigint, {_STAMPS}",
    "customers": "id bigint, code string, name string, company string, contact_person string, email string, "
                 "phone string, mobile string, fax string, website string, address string, billing_city string, "
                 "billing_state_province string, billing_postal_code string, billing_country string, "
                 "shipping_address string, shipping_city string, shipping_state_province string, "
                 "shipping_postal_code string, shipping_country string, tax_id string, registration_number string, "
                 "currency string, payment_terms string, credit_limit decimal(12,2), current_balance decimal(12,2), "
                 f"{_BANK}, customer_type string, customer_category string, loyalty_points int, "
                 "total_sales decimal(12,2), total_orders int, average_order_value decimal(12,2), "
                 "last_order_date date, is_active boolean, notes string, tags string, custom_fields string, "
                 f"created_by bigint, {_STAMPS}",
    "purchase_orders": "id bigint, order_number string, supplier_id bigint, order_date date, "
                       f"expected_delivery_date date, actual_delivery_date date, status string, {_AMOUNTS}, "
                       "payment_terms string, payment_status string, paid_amount decimal(12,2), "
                       "delivery_address string, delivery_contact string, delivery_phone string, notes string, "
                       "internal_notes string, attachments string, created_by bigint, approved_by bigint, "
                       f"received_by bigint, {_STAMPS}, approved_at timestamp_ntz, cancelled_at timestamp_ntz",
    "purchase_order_items": f"id bigint, order_id bigint, received_quantity decimal(10,2), {_ITEM}",
    "sales_quotes": "id bigint, quote_number string, customer_id bigint, quote_type string, quote_date date, "
                    f"valid_until date, status string, {_AMOUNTS}, reference string, customer_po_number string, "
                    "notes string, internal_notes string, terms string, attachments string, "
                    "converted_to_order bigint, converted_at timestamp_ntz, created_by bigint, approved_by bigint, "
                    f"{_STAMPS}, sent_at timestamp_ntz, accepted_at timestamp_ntz, rejected_at timestamp_ntz",
    "sales_quote_items": f"id bigint, quote_id bigint, {_ITEM}",
    "sales_orders": "id bigint, order_number string, customer_id bigint, quote_id bigint, order_date date, "
                    f"delivery_date date, shipped_date date, status string, fulfillment_status string, {_AMOUNTS}, "
                    "payment_method string, payment_terms string, payment_status string, "
                    "paid_amount decimal(12,2), shipping_method string, shipping_address string, "
                    "shipping_contact string, shipping_phone string, tracking_number string, "
                    "customer_po_number string, sales_person_id bigint, notes string, internal_notes string, "
                    f"attachments string, created_by bigint, approved_by bigint, {_STAMPS}, "
                    "confirmed_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz, "
                    "cancelled_at timestamp_ntz",
    "sales_order_items": "id bigint, order_id bigint, shipped_quantity decimal(10,2), "
                         f"returned_quantity decimal(10,2), {_ITEM}",
    "invoices": "id bigint, invoice_number string, customer_id bigint, sales_order_id bigint, issue_date date, "
                "due_date date, total_amount decimal(12,2), tax_amount decimal(12,2), payment_status string, "
                f"notes string, created_by bigint, {_STAMPS}",
    "accounts": "id bigint, name string, type string, balance decimal(18,2), currency string, is_active boolean, "
                "created_at timestamp_ntz",
    "financial_transactions": "id bigint, transaction_number string, type string, category string, "
                              "subcategory string, transaction_date date, amount decimal(18,2), currency string, "
                              "account_id bigint, from_account string, to_account string, "
                              "related_party_type string, related_party_id bigint, reference_type string, "
                              "reference_id bigint, reference_number string, payment_method string, "
                              "check_number string, bank_reference string, status string, is_reconciled boolean, "
                              "reconciled_at timestamp_ntz, description string, remarks string, notes string, "
                              "tags array<string>, attachments string, created_by bigint, approved_by bigint, "
                              f"{_STAMPS}, approved_at timestamp_ntz",
    "vouchers": "id bigint, voucher_number string, voucher_type string, voucher_date date, amount decimal(12,2), "
                "currency string, party_type string, party_id bigint, party_name string, reference_type string, "
                "reference_id bigint, reference_number string, payment_method string, check_number string, "
                "check_date date, bank_name string, bank_reference string, status string, description string, "
                f"narration string, notes string, created_by bigint, approved_by bigint, posted_by bigint, {_STAMPS}, "
                "approved_at timestamp_ntz, posted_at timestamp_ntz",
    "payment_schedules": "id bigint, order_id bigint, due_date date, amount decimal(15,2), percentage decimal(5,2), "
                         "description string, status string, paid_date date, paid_amount decimal(15,2), "
                         f"payment_method string, transaction_id bigint, notes string, {_STAMPS}",
    "payment_schedule_models": "id bigint, name string, description string, terms string, is_default boolean, "
                               f"status string, {_STAMPS}, created_by bigint",
    "statistical_reports": "id bigint, report_name string, report_type string, report_category string, "
                           "period_start date, period_end date, report_data string, filters string, "
                           "summary_metrics string, is_automated boolean, is_published boolean, "
                           "generated_by bigint, generated_at timestamp_ntz, created_at timestamp_ntz",
    "audit_logs": "id bigint, user_id bigint, action string, table_name string, record_id bigint, "
                  "old_values string, new_values string, ip_address string, user_agent string, "
                  "created_at timestamp_ntz",
    "warehouses": "id bigint, code string, name string, address string, city string, state string, "
                  "postal_code string, country string, phone string, email string, manager_id bigint, "
                  "status string, is_default boolean, capacity decimal(15,2), capacity_unit string, notes string, "
                  f"{_STAMPS}, created_by bigint",
    "search_templates": "id bigint, name string, description string, entity_type string, filters string, "
                        f"sort_config string, is_public boolean, {_STAMPS}, created_by bigint",
}

# (child table, column, parent table): what the integrity report checks.
FOREIGN_KEYS = [
    ("users", "role_id", "user_roles"),
    ("product_families", "parent_id", "product_families"),
    ("products", "family_id", "product_families"),
    ("stock_movements", "product_id", "products"),
    ("stock_movements", "created_by", "users"),
    ("stock_movements", "approved_by", "users"),
    ("purchase_orders", "supplier_id", "suppliers"),
    ("purchase_order_items", "order_id", "purchase_orders"),
    ("purchase_order_items", "product_id", "products"),
    ("sales_quotes", "customer_id", "customers"),
    ("sales_quote_items", "quote_id", "sales_quotes"),
    ("sales_quote_items", "product_id", "products"),
    ("sales_orders", "customer_id", "customers"),
    ("sales_order_items", "order_id", "sales_orders"),
    ("sales_order_items", "product_id", "products"),
    ("invoices", "customer_id", "customers"),
    ("financial_transactions", "account_id", "accounts"),
]

UNIQUE = {
    "user_roles": ["name"],
    "users": ["username", "email"],
    "settings": ["key"],
    "product_families": ["code"],
    "products": ["sku", "barcode"],
    "stock_movements": ["reference_number"],
    "suppliers": ["code"],
    "customers": ["code"],
    "purchase_orders": ["order_number"],
    "sales_quotes": ["quote_number"],
    "sales_orders": ["order_number"],
    "financial_transactions": ["transaction_number"],
    "vouchers": ["voucher_number"],
    "warehouses": ["code"],
}

REQUIRED = {
    "user_roles": ["name"],
    "users": ["username", "email", "password_hash"],
    "settings": ["key"],
    "product_families": ["code", "name"],
    "products": ["sku", "name"],
    "stock_movements": ["movement_type", "reference_number", "product_id", "quantity"],
    "suppliers": ["code", "name"],
    "customers": ["code", "name"],
    "purchase_orders": ["order_number", "supplier_id", "order_date"],
    "purchase_order_items": ["product_id", "quantity", "unit_price", "line_total"],
    "sales_quotes": ["quote_number", "customer_id", "quote_date"],
    "sales_quote_items": ["product_id", "quantity", "unit_price", "line_total"],
    "sales_orders": ["order_number", "customer_id", "order_date"],
    "sales_order_items": ["product_id", "quantity", "unit_price", "line_total"],
    "financial_transactions": ["type", "transaction_date", "amount"],
    "vouchers": ["voucher_number", "voucher_type", "voucher_date", "amount"],
    "payment_schedules": ["due_date", "amount"],
    "payment_schedule_models": ["name", "terms"],
    "warehouses": ["code", "name"],
    "search_templates": ["name", "entity_type", "filters"],
}

# (child items, link column, header): items go with their header.
CASCADES = [
    ("purchase_order_items", "order_id", "purchase_orders"),
    ("sales_quote_items", "quote_id", "sales_quotes"),
    ("sales_order_items", "order_id", "sales_orders"),
    ("payment_schedules", "order_id", "sales_orders"),
]

# Column defaults used when a new row leaves the column out.
DEFAULTS = {
    "users": {"is_active": True, "preferences": "{}"},
    "user_roles": {"permissions": "{}"},
    "settings": {"is_public": False},
    "product_families": {"level": 1, "is_active": True},
    "products": {"quantity_in_stock": 0, "min_stock_level": 0, "currency": "DZD", "tax_rate": 19,
                 "weight_unit": "kg", "volume_unit": "L", "dimension_unit": "cm", "is_active": True,
                 "is_featured": False},
    "suppliers": {"country": "Algeria", "currency": "DZD", "current_balance": 0, "rating": 0,
                  "total_purchases": 0, "total_orders": 0, "is_active": True},
    "customers": {"billing_country": "Algeria", "shipping_country": "Algeria", "currency": "DZD",
                  "current_balance": 0, "customer_type": "Regular", "loyalty_points": 0, "total_sales": 0,
                  "total_orders": 0, "average_order_value": 0, "is_active": True},
    "purchase_orders": {"status": "draft", "currency": "DZD", "payment_status": "unpaid", "paid_amount": 0},
    "sales_quotes": {"status": "draft", "currency": "DZD", "quote_type": "QUOTE"},
    "sales_orders": {"status": "pending", "currency": "DZD", "payment_status": "unpaid", "paid_amount": 0,
                     "fulfillment_status": "unfulfilled"},
    "invoices": {"payment_status": "unpaid", "tax_amount": 0},
    "accounts": {"balance": 0, "currency": "DZD", "is_active": True},
    "financial_transactions": {"currency": "DZD", "status": "pending", "is_reconciled": False},
    "warehouses": {"status": "active", "is_default": False},
    "payment_schedules": {"status": "pending"},
    "payment_schedule_models": {"is_default": False, "status": "active"},
    "search_templates": {"is_public": False},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL((GIVEN | BUSINESS)[table])
