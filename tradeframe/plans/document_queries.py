"""Documents D1-D3, hierarchy H1-H2, pricing P1-P4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.functions.keys import content_id as key
from tradeframe.operators import documents as docs
from tradeframe.operators import hierarchy, pricing
from tradeframe.plans.catalogue import query
from tradeframe.plans.view_sql import content_id


def _lines(headers: str, items: str, link: str, party: str, key: str, prefix: str, product: str) -> str:
    contact = ", ".join(f"c.{x} as {prefix}_{x}" for x in docs.PARTY)
    return f"""
select h.*, {contact}, i.* exclude ({link}), p.name as product_name, {product}
from {headers} h left join {party} c on c.id = h.{key}
left join {items} i on i.{link} = h.id left join products p on p.id = i.product_id"""


@query("d01_quote_lines", _lines("sales_quotes", "sales_quote_items", "quote_id", "customers", "customer_id",
                                 "customer", "p.sku, p.unit"))
def quote_lines(db):
    return docs.document_lines(db, docs.QUOTE)


@query("d02_sales_order_lines", _lines("sales_orders", "sales_order_items", "order_id", "customers", "customer_id",
                                       "customer", "p.sku, p.unit, p.quantity_in_stock"))
def sales_order_lines(db):
    return docs.document_lines(db, docs.SALES_ORDER)


@query("d03_purchase_order_lines", _lines(
    "purchase_orders", "purchase_order_items", "order_id", "suppliers", "supplier_id", "supplier",
    "p.sku, p.unit, p.quantity_in_stock, p.reorder_point"))
def purchase_order_lines(db):
    return docs.document_lines(db, docs.PURCHASE_ORDER)


#: Items of a document that come in one row.
PAGE = 1000


def _documents(headers: str, items: str, link: str, party: str, key: str) -> str:
    return f"""
with numbered as (select *, (row_number() over (partition by {link} order by line_number) - 1) // {PAGE} as page from {items})
select h.id, c.name as partner_name, coalesce(i.page, 0) as page, count(i.{link}) as item_count,
       cast(min(i.line_number) as bigint) as first_line, cast(max(i.line_number) as bigint) as last_line,
       cast(coalesce(sum(i.quantity), 0) as decimal(28,2)) as quantity
from {headers} h left join {party} c on c.id = h.{key} left join numbered i on i.{link} = h.id
group by 1, 2, 3"""


def _nested(db, kind: docs.DocumentKind):
    """The nested documents, reduced to what a flat check can compare."""
    quantity = F.aggregate("items", F.lit(0).cast("decimal(28,2)"),
                           lambda a, i: (a + i["quantity"]).cast("decimal(28,2)"))
    return docs.documents(db, kind, PAGE).select(
        "id", F.col(f"{kind.prefix}_name").alias("partner_name"), "page", F.size("items").cast("bigint").alias("item_count"),
        F.try_element_at("items", F.lit(1)).getField("line_number").cast("bigint").alias("first_line"),
        F.try_element_at("items", F.lit(-1)).getField("line_number").cast("bigint").alias("last_line"),
        quantity.alias("quantity"))


@query("d01_quote_documents", _documents("sales_quotes", "sales_quote_items", "quote_id", "customers", "customer_id"))
def quote_documents(db):
    return _nested(db, docs.QUOTE)


@query("d02_sales_order_documents", _documents("sales_orders", "sales_order_items", "order_id", "customers", "customer_id"))
def sales_order_documents(db):
    return _nested(db, docs.SALES_ORDER)


@query("d03_purchase_order_documents", _documents("purchase_orders", "purchase_order_items", "order_id", "suppliers", "supplier_id"))
def purchase_order_documents(db):
    return _nested(db, docs.PURCHASE_ORDER)


@query("h01_family_tree", """
with recursive tree as (
  select id, code, name, parent_id, id as root_id, 1 as depth, code as sort_path
  from product_families where is_active and parent_id is null
  union all
  select f.id, f.code, f.name, f.parent_id, t.root_id, t.depth + 1, t.sort_path || '/' || f.code
  from product_families f join tree t on f.parent_id = t.id where f.is_active)
select * from tree""")
def family_tree(db):
    return hierarchy.reachable_families(db["product_families"])


@query("h01_family_tree_nested", """
select p.id, p.code, p.name, p.path, count(f.id) as children, min(f.code) as first_child, max(f.code) as last_child,
       cast(coalesce(sum(n), 0) as bigint) as child_products, min(case when f.id is not null then p.name end) as parent_name
from product_families p left join product_families f on f.parent_id = p.id and f.is_active
left join (select family_id, count(*) as n from products group by 1) c on c.family_id = f.id
where p.parent_id is null and p.is_active group by 1, 2, 3, 4""")
def family_tree_nested(db):
    tree = hierarchy.nested_tree(hierarchy.families_with_counts(db["product_families"], db["products"]))
    codes = F.transform("children", lambda c: c["code"])
    counts = F.aggregate("children", F.lit(0).cast("bigint"), lambda n, c: n + c["product_count"])
    return tree.select("id", "code", "name", "path", F.size("children").cast("bigint").alias("children"),
                       F.array_min(codes).alias("first_child"), F.array_max(codes).alias("last_child"), counts.alias("child_products"),
                       F.array_min(F.transform("children", lambda c: c["parent_name"])).alias("parent_name"))


def _new_families(db):
    """A batch of families: one per part size under its type, one per (size, brand) below
    that, and some under a parent that does not exist."""
    part = db.given("part")
    size = F.concat(F.lit("S"), F.col("p_size").cast("string"))
    sizes = part.select("p_type", "p_size").distinct().select(
        key("p_type", size).alias("id"), F.concat_ws("-", "p_type", size).alias("code"), size.alias("name"),
        F.when(F.col("p_size") % 13 == 0, F.lit(-1)).otherwise(key("p_type")).cast("bigint").alias("parent_id"))
    below = part.select("p_type", "p_size", "p_brand").distinct().select(
        key("p_type", size, "p_brand").alias("id"), F.concat_ws("-", "p_type", size, "p_brand").alias("code"),
        F.col("p_brand").alias("name"), key("p_type", size).alias("parent_id"))
    return sizes.unionAll(below)


_SIZE = "'S' || p_size"
_BATCH = f"""
batch as (
  select {content_id('p_type', _SIZE)} as id, p_type || '-S' || p_size as code, 'S' || p_size as name,
         case when p_size % 13 = 0 then -1 else {content_id('p_type')} end as parent_id
  from part group by p_type, p_size
  union all
  select {content_id('p_type', _SIZE, 'p_brand')}, p_type || '-S' || p_size || '-' || p_brand, p_brand,
         {content_id('p_type', _SIZE)}
  from part group by p_type, p_size, p_brand),
placed as (
  select b.id, b.code, b.name, b.parent_id, k.level + 1 as level, k.path || '/' || b.code as path
  from batch b join product_families k on b.parent_id = k.id
  union all
  select b.id, b.code, b.name, b.parent_id, p.level + 1, p.path || '/' || b.code
  from batch b join placed p on b.parent_id = p.id)"""


@query("h02_placed_families", f"with recursive {_BATCH} select * from placed")
def placed_families(db):
    return hierarchy.place_families(db["product_families"], _new_families(db))[0]


@query("h02_rejected_families", f"""
with recursive {_BATCH}
select *, 'parent family not found' as reason from batch where id not in (select id from placed)""")
def rejected_families(db):
    return hierarchy.place_families(db["product_families"], _new_families(db))[1]


@query("p01_document_totals", """
with sums as (select order_id, cast(sum(quantity * unit_price) as decimal(20,4)) as s from sales_order_items group by 1),
parts as (select order_id, s, s * 0.05 as d, cast(s - s * 0.05 as decimal(26,8)) as t from sums)
select order_id, cast(round(s, 2) as decimal(28,2)) as subtotal, cast(round(d, 2) as decimal(28,2)) as discount_amount,
       cast(round(t, 2) as decimal(28,2)) as taxable_amount,
       cast(round(t * 0.19, 2) as decimal(28,2)) as tax_amount,
       cast(round(t * 1.19, 2) as decimal(28,2)) as total_amount
from parts""")
def document_totals(db):
    return pricing.document_totals(db["sales_order_items"], "order_id", F.lit("5"), F.lit("19"))


_RATED = """
rated as (
  select id, customer_id, cast((id % 4) * 2.5 as decimal(5,2)) as discount_percentage,
         cast(case when status = 'pending' then 9 when status = 'completed' then 19 end as decimal(5,2)) as tax_percentage
  from sales_orders)"""


def _new_documents(db):
    """Every order as a new document with rates of its own; cancelled ones name no tax."""
    status = F.col("status")
    headers = db["sales_orders"].select(
        "id", "customer_id", ((F.col("id") % 4) * F.lit("2.5").cast("decimal(3,1)")).cast("decimal(5,2)").alias("discount_percentage"),
        F.when(status == "pending", 9).when(status == "completed", 19).cast("decimal(5,2)").alias("tax_percentage"))
    return pricing.new_document(headers, db["sales_order_items"].drop("tax_percentage"), "id", "order_id")


@query("p01_new_documents", f"""
with {_RATED},
sums as (select r.*, cast(coalesce(sum(quantity * i.unit_price), 0) as decimal(20,4)) as s
         from rated r left join sales_order_items i on i.order_id = r.id group by all),
parts as (select *, s * discount_percentage * 0.01 as d, cast(s - s * discount_percentage * 0.01 as decimal(26,8)) as t from sums),
taxed as (select *, t * (coalesce(tax_percentage, 0) * 0.01) as x from parts)
select id, customer_id, discount_percentage, tax_percentage, cast(round(s, 2) as decimal(28,2)) as subtotal,
       cast(round(d, 2) as decimal(28,2)) as discount_amount, cast(round(x, 2) as decimal(28,2)) as tax_amount,
       cast(round(t + x, 2) as decimal(28,2)) as total_amount
from taxed""")
def new_documents(db):
    return _new_documents(db)[0]


@query("p01_new_document_lines", """
select order_id, product_id, line_number, quantity, unit_price, cast(coalesce(discount_percentage, 0) as decimal(5,2)) as discount_percentage,
       cast(round(quantity * unit_price * (100 - coalesce(discount_percentage, 0)) * 0.01, 2) as decimal(28,2)) as line_total
from sales_order_items""")
def new_document_lines(db):
    return _new_documents(db)[1]


@query("p02_line_totals", """
select order_id, product_id, line_number, quantity, unit_price, discount_percentage,
       cast(round(quantity * unit_price * (100 - coalesce(discount_percentage, 0)) * 0.01, 2) as decimal(28,2))
         as line_total
from (select * replace (nullif(discount_percentage, 0) as discount_percentage) from sales_order_items)""")
def line_totals(db):
    items = db["sales_order_items"].withColumn("discount_percentage", F.nullif("discount_percentage", F.lit(0)))
    return pricing.priced_lines(items).drop("tax_percentage")


@query("p03_line_numbers_flat", """
select default_supplier_id as supplier_id, id as product_id,
       row_number() over (partition by default_supplier_id order by id) as line_number
from products_with_supplier where default_supplier_id is not null""")
def line_numbers_flat(db):
    lines = db["products_with_supplier"].filter("default_supplier_id is not null").select(
        F.col("default_supplier_id").alias("supplier_id"), F.col("id").alias("product_id"))
    return pricing.number_flat(lines, "supplier_id", "product_id")


@query("p03_line_numbers_nested", """
select doc, line_number, product_id, quantity from (
  select id * 10 as doc, 1 as line_number, id as product_id, reorder_point as quantity from products
  union all
  select id * 10, 2, id + 1, min_stock_level from products)""")
def line_numbers_nested(db):
    """Documents of two items each, made from the product table, flattened again."""
    item = lambda key, quantity: F.struct(key.alias("product_id"), F.col(quantity).alias("quantity"))
    nested = db["products"].select(
        (F.col("id") * 10).alias("doc"),
        F.array(item(F.col("id"), "reorder_point"), item(F.col("id") + 1, "min_stock_level")).alias("items"))
    return pricing.number_nested(nested, "doc").withColumn("line_number", F.col("line_number").cast("int"))


@query("p04_movement_values", """
select id, quantity, unit_price, total_value,
       cast(coalesce(nullif(total_value, 0), round(quantity * coalesce(unit_price, 0), 2)) as decimal(18,2)) as movement_value
from (select id, quantity, case when movement_type <> 'TRANSFER' then unit_price end as unit_price,
             case movement_type when 'IN' then cast(0 as decimal(12,2)) when 'OUT' then cast(quantity * 2 as decimal(12,2))
                  end as total_value
      from stock_movements)""")
def movement_values(db):
    kind = F.col("movement_type")
    rows = db["stock_movements"].select(
        "id", "quantity", F.when(kind != "TRANSFER", F.col("unit_price")).alias("unit_price"),
        F.when(kind == "IN", F.lit(0)).when(kind == "OUT", F.col("quantity") * 2).cast("decimal(12,2)")
        .alias("total_value"))
    return rows.withColumn("movement_value", pricing.movement_value())
