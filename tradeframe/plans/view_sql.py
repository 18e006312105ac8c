"""The business views as ANSI SQL, for the side-by-side check. Written separately
from the DataFrame views, so that a slip in one of them shows."""

from __future__ import annotations

import re


def content_id(*parts: str) -> str:
    text = " || '-' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


_PO_KEY = ("cast(l_suppkey * 1000 + (extract(year from l_shipdate) - 1990) * 12 + extract(month from l_shipdate) "
           "as bigint)")

VIEWS = {
    "customers": """
select c_custkey as id, 'CUST-' || c_custkey as code, c_name as name,
       case when c_custkey % 4 = 0 then null else lower(c_mktsegment) || '@example.com' end as email,
       case when c_custkey % 3 = 0 then null else '555-' || c_custkey end as phone,
       case when c_custkey % 2 = 0 then null else n_name || ' Trading' end as company,
       c_mktsegment as customer_type, n_name as billing_country,
       cast(c_acctbal as decimal(12,2)) as current_balance, c_acctbal >= 0 as is_active,
       cast(date '1998-01-01' + cast(c_custkey % 300 as int) as date) as created_at
from customer join nation on c_nationkey = n_nationkey""",
    "suppliers": """
select s_suppkey as id, 'SUPP-' || s_suppkey as code, s_name as name,
       case when s_suppkey % 3 = 0 then null else 'sales' || s_suppkey || '@example.com' end as email,
       '777-' || s_suppkey as phone,
       case when s_suppkey % 2 = 0 then null else n_name || ' Supplies' end as company,
       n_name as country, cast(s_acctbal as decimal(12,2)) as current_balance,
       s_suppkey % 10 <> 0 as is_active,
       cast(date '1998-01-01' + cast(s_suppkey % 300 as int) as date) as created_at
from supplier join nation on s_nationkey = n_nationkey""",
    "user_roles": """
select cast(r_regionkey + 1 as bigint) as id,
       case r_regionkey when 0 then 'super_admin' when 1 then 'admin' when 2 then 'manager'
            when 3 then 'accountant' when 4 then 'sales' end as name,
       '{"region": "' || r_name || '"}' as permissions
from region""",
    "users": """
select user_id as id, 'user' || user_id as username, 'user' || user_id || '@example.com' as email,
       'First' || (user_id % 10) as first_name, 'Last' || (user_id % 7) as last_name,
       case when user_id % 5 = 0 then null else '555-9' || user_id end as phone,
       user_id % 6 + 1 as role_id, user_id % 9 <> 0 as is_active, max(ts) as last_login, min(ts) as created_at
from events group by user_id""",
    "product_families": f"""
select {content_id('p_type')} as id, p_type as code, p_type as name, cast(null as bigint) as parent_id,
       1 as level, '/' || p_type as path, p_type <> 'PROMO' as is_active,
       {content_id('p_type')} % 200 as created_by
from (select distinct p_type from part)
union all
select id, code, p_brand, {content_id('p_type')}, 2,
       case when id % 7 = 0 then null else '/' || p_type || '/' || code end, id % 11 <> 0, id % 200
from (select p_type, p_brand, p_type || '-' || p_brand as code, {content_id('p_type', 'p_brand')} as id
      from part group by p_type, p_brand)""",
    "products": f"""
select p_partkey as id, 'SKU-' || p_partkey as sku,
       case when p_partkey % 5 = 0 then null else '613' || p_partkey end as barcode, p_name as name,
       'piece' as unit, {content_id('p_type', 'p_brand')} as family_id,
       cast(p_partkey * 37 % 200 as decimal(10,2)) as quantity_in_stock,
       cast(p_size as decimal(10,2)) as min_stock_level, cast(p_size * 2 as decimal(10,2)) as reorder_point,
       case when p_partkey % 3 = 0 then null else cast(p_size * 4 as decimal(10,2)) end as reorder_quantity,
       cast(round(cast(p_retailprice as decimal(12,2)) * 0.60, 2) as decimal(12,2)) as cost_price,
       cast(p_retailprice as decimal(12,2)) as selling_price,
       case when p_partkey % 4 = 0 then null else cast(p_retailprice as decimal(12,2)) end as last_purchase_price,
       p_partkey % 10 <> 0 as is_active,
       cast(date '1998-01-01' + cast(p_partkey % 300 as int) as date) as created_at
from part""",
    "products_with_supplier": """
select p.*, s.default_supplier_id
from products p left join (select l_partkey, min(l_suppkey) as default_supplier_id from lineitem group by l_partkey) s
  on s.l_partkey = p.id""",
    "sales_orders": """
select o_orderkey as id, 'SO-' || o_orderkey as order_number, o_custkey as customer_id,
       cast(o_orderdate as date) as order_date,
       case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end as status,
       cast(o_totalprice as decimal(12,2)) as total_amount, o_custkey % 200 as created_by,
       cast(o_orderdate as date) as created_at
from orders""",
    "sales_order_items": """
select l_orderkey as order_id, l_partkey as product_id, cast(l_linenumber as bigint) as line_number,
       cast(l_quantity as decimal(10,2)) as quantity, cast(p_retailprice as decimal(12,2)) as unit_price,
       cast(l_discount * 100 as decimal(5,2)) as discount_percentage,
       cast(l_tax * 100 as decimal(5,2)) as tax_percentage
from lineitem join part on l_partkey = p_partkey""",
    "sales_quotes": """
select id, 'QT-' || id as quote_number, customer_id, order_date as quote_date,
       case when id % 5 = 0 then null else cast(order_date + 30 as date) end as valid_until,
       case status when 'completed' then 'approved' when 'pending' then 'draft' else 'rejected' end as status,
       total_amount, order_date as created_at
from sales_orders""",
    "sales_quote_items": """
select order_id as quote_id, product_id, line_number, quantity, unit_price, discount_percentage, tax_percentage
from sales_order_items""",
    "purchase_orders": f"""
select {_PO_KEY} as id, 'PO-' || {_PO_KEY} as order_number, l_suppkey as supplier_id,
       cast(min(l_shipdate) as date) as order_date,
       case when l_suppkey % 4 = 0 then null else cast(max(l_shipdate) as date) end as actual_delivery_date,
       case extract(month from l_shipdate) % 4 when 0 then 'completed' when 1 then 'pending'
            when 2 then 'received' else 'cancelled' end as status,
       cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(18,2)) as total_amount,
       cast(min(l_shipdate) as date) as created_at
from lineitem group by l_suppkey, extract(year from l_shipdate), extract(month from l_shipdate)""",
    "purchase_order_items": f"""
select {_PO_KEY} as order_id, l_partkey as product_id, l_orderkey * 10 + l_linenumber as line_number,
       cast(l_quantity as decimal(10,2)) as quantity,
       cast(round(cast(l_extendedprice as decimal(12,2)) * 0.02, 2) as decimal(12,2)) as unit_price,
       cast(l_discount * 100 as decimal(5,2)) as discount_percentage
from lineitem""",
    "invoices": """
select id, 'INV-' || id as invoice_number, customer_id, id as sales_order_id, order_date as issue_date,
       cast(order_date + 30 as date) as due_date, total_amount,
       case when id % 6 = 0 then null else cast(round(total_amount * 0.19, 2) as decimal(12,2)) end as tax_amount,
       case o_orderpriority when '1-URGENT' then 'paid' when '2-HIGH' then 'unpaid' when '3-MEDIUM' then 'partial'
            when '5-LOW' then 'cancelled' else 'overdue' end as payment_status,
       order_date as created_at
from sales_orders join orders on id = o_orderkey""",
    "accounts": """
select cast(n_nationkey as bigint) as id, n_name as name, r_name as type,
       cast(coalesce(b.balance, 0) as decimal(18,2)) as balance, 'DZD' as currency, n_nationkey % 8 <> 0 as is_active
from nation join region on n_regionkey = r_regionkey
left join (select c_nationkey, sum(cast(c_acctbal as decimal(12,2))) as balance from customer group by c_nationkey) b
  on b.c_nationkey = n_nationkey""",
    "financial_transactions": """
select id, case when status = 'cancelled' then 'transfer' else 'income' end as type,
       cast(total_amount as decimal(18,2)) as amount, order_date as transaction_date,
       cast(id % 25 as bigint) as account_id
from sales_orders
union all
select -id - 1, 'expense', total_amount, order_date, cast(null as bigint) from purchase_orders""",
    "stock_movements": f"""
select {content_id('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'cast(l_shipdate as date)',
                    'cast(l_quantity as int)')} as id,
       case when l_returnflag = 'R' then 'IN' when l_returnflag = 'N' and l_linenumber = 1 then 'RETURN'
            when l_returnflag = 'N' and l_linenumber = 2 then 'ADJUSTMENT'
            when l_linenumber = 3 then 'TRANSFER' else 'OUT' end as movement_type,
       l_partkey as product_id, l_orderkey as sales_order_id,
       cast(case when l_returnflag = 'N' and l_linenumber = 2 then -l_quantity else l_quantity end
            as decimal(10,2)) as quantity,
       cast(round(cast(l_extendedprice as decimal(12,2)) * 0.02, 2) as decimal(12,2)) as unit_price,
       cast(l_shipdate as date) as movement_date, cast(l_shipdate as date) as created_at,
       case when l_suppkey % 7 = 0 then null else l_suppkey end as created_by,
       case when l_linestatus = 'F' then l_suppkey + 60 end as approved_by, l_linestatus = 'F' as is_approved,
       case l_returnflag when 'A' then 'WH-A' when 'R' then 'WH-R' end as warehouse
from lineitem""",
}


def _uses(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def with_views(sql: str) -> str:
    """The query with the views it needs, directly or through another, in front."""
    needed: list[str] = []

    def add(text: str) -> None:
        for view in _uses(text):
            if view not in needed:
                add(VIEWS[view])
                needed.append(view)

    add(sql)
    heads = [f"{v} as ({VIEWS[v]})" for v in needed]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(heads + [body[len("with recursive "):]])
    if body.lower().startswith("with "):
        return "with " + ",\n".join(heads + [body[len("with "):]])
    return ("with " + ",\n".join(heads) + "\n" if heads else "") + body


def total(x: str) -> str:
    return f"cast(sum({x}) as decimal(28,2))"


def total0(x: str) -> str:
    return f"cast(coalesce(sum({x}), 0) as decimal(28,2))"


def hundredths(x: str) -> str:
    """An integer number of hundredths as a decimal."""
    return f"cast(cast({x} as decimal(28,0)) * 0.01 as decimal(18,2))"


def average(x: str) -> str:
    """Mean of values with two places, rounded half away from zero by integer steps."""
    s, n = f"sum(cast({x} * 100 as bigint))", f"count({x})"
    return hundredths(f"sign({s}) * ((2 * abs({s}) + {n}) // (2 * {n}))")
