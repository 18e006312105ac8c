"""Listings L1-L14: a page beside its totals, and whole filtered listings; keyed lookups D4, D5; saved search X2."""

from __future__ import annotations

from tradeframe.operators.listing import list_rows
from tradeframe.plans.catalogue import END, START, query
from tradeframe.plans.listings import LISTINGS, enrich, family_details, matching, product_history, saved_search


def page_sql(rows: str, order: str, page: int = 1, limit: int = 20) -> str:
    return f"select * from ({rows}) order by {order} limit {limit} offset {(page - 1) * limit}"


def totals_sql(rows: str, limit: int = 20) -> str:
    return (f"select count(*) as total_count, (count(*) + {limit} - 1) // {limit} as total_pages "
            f"from ({rows})")


def listing(name: str, listed, rows: str, order: str, page: int = 1, limit: int = 20) -> None:
    """Register a page and its totals. ``listed(db, page=.., limit=..)`` gives the listing."""
    query(f"{name}_page", page_sql(rows, order, page, limit))(lambda db: listed(db, page=page, limit=limit).rows)
    query(f"{name}_totals", totals_sql(rows, limit))(lambda db: listed(db, page=page, limit=limit).totals)


def of(entity: str, **arguments):
    return lambda db, **paging: list_rows(LISTINGS[entity], db, **paging, **arguments)


NEWEST = "created_at desc nulls first, id"

PRODUCTS = """
select p.*, f.name as family_name, f.code as family_code
from products p left join product_families f on f.id = p.family_id"""
_PRODUCT_FILTER = """ where (p.name ilike '%re_ w%' or p.sku ilike '%re_ w%' or p.barcode ilike '%re_ w%')
and p.is_active and quantity_in_stock <= min_stock_level"""


listing("l01_products_search", of("products", search="re_ w", is_active=True, low_stock=True, sort_by="name",
                                  sort_order="asc"), PRODUCTS + _PRODUCT_FILTER, "name asc nulls last, id")


listing("l01_products", of("products", sort_by="no_such_field"), PRODUCTS, NEWEST, page=3, limit=50)


@query("l01_products_matching", PRODUCTS + _PRODUCT_FILTER)
def products_matching(db):
    return matching(db, "products", search="re_ w", is_active=True, low_stock=True)


@query("l02_low_stock", """
select p.*, f.name as family_name, cast(min_stock_level - quantity_in_stock as decimal(10,2)) as shortage
from products p left join product_families f on f.id = p.family_id
where p.is_active and quantity_in_stock <= min_stock_level""")
def low_stock(db):
    return matching(db, "low_stock")


FAMILIES = """
select f.*, parent.name as parent_name, count(distinct p.id) as product_count
from product_families f left join product_families parent on f.parent_id = parent.id
left join products p on p.family_id = f.id where f.is_active group by all"""


@query("l03_families", FAMILIES)
def families(db):
    return matching(db, "families")


listing("l03_families", of("families"), FAMILIES, "path asc nulls last, id", page=6)


MOVEMENTS = """
select m.*, p.name as product_name, p.sku as product_sku, u.username as created_by_username,
       a.username as approved_by_username
from stock_movements m join products p on m.product_id = p.id
left join users u on u.id = m.created_by left join users a on a.id = m.approved_by"""
_MOVEMENT_FILTER = f""" where movement_type = 'OUT' and warehouse = 'WH-A'
and movement_date >= date '{START}' and movement_date <= date '{END}'"""


@query("l04_movements", MOVEMENTS + _MOVEMENT_FILTER)
def movements(db):
    return matching(db, "movements", movement_type="OUT", warehouse="WH-A", start=START, end=END)


listing("l04_movements", of("movements"), MOVEMENTS, "movement_date desc nulls first, " + NEWEST, page=2)


@query("l04_movements_deep_page", page_sql(MOVEMENTS, "movement_date desc nulls first, " + NEWEST, 250))
def deep_page(db):
    """A page far from the start, located by ranges of the sort key."""
    return list_rows(LISTINGS["movements"], db, page=250).rows


@query("l05_product_history", """
select t.*, u.username as created_by_username, a.username as approved_by_username
from (select m.*, row_number() over (partition by product_id order by movement_date desc, id desc) as rank
      from stock_movements m) t
left join users u on u.id = t.created_by left join users a on a.id = t.approved_by where rank <= 10""")
def history(db):
    return product_history(db, 10).selectExpr("* except (rank)", "cast(rank as bigint) as rank")


@query("l05_one_product_history", """
select m.*, u.username as created_by_username, a.username as approved_by_username
from (select * from stock_movements where product_id = 7 order by movement_date desc, id desc limit 10) m
left join users u on u.id = m.created_by left join users a on a.id = m.approved_by""")
def one_history(db):
    return product_history(db, 10, product_id=7)


listing("l06_customers", of("customers", search="mach"),
        "select * from customers where name ilike '%mach%' or email ilike '%mach%' or company ilike '%mach%'", NEWEST)


listing("l07_suppliers", of("suppliers", search="nation_1"), """
select * from suppliers where name ilike '%nation_1%' or email ilike '%nation_1%' or company ilike '%nation_1%'""", NEWEST)


def _party_sql(table: str, party: str, key: str, prefix: str) -> str:
    columns = ", ".join(f"c.{x} as {prefix}_{x}" for x in ("name", "email", "phone", "company"))
    return f"select t.*, {columns} from {table} t left join {party} c on c.id = t.{key}"


QUOTES = _party_sql("sales_quotes", "customers", "customer_id", "customer")
ORDERS = _party_sql("sales_orders", "customers", "customer_id", "customer")
PURCHASES = _party_sql("purchase_orders", "suppliers", "supplier_id", "supplier")


@query("l08_quotes", QUOTES + f" where status = 'approved' and quote_date between date '{START}' and date '{END}'")
def quotes(db):
    return matching(db, "quotes", status="approved", start=START, end=END)


listing("l08_quotes", of("quotes", status="draft"), QUOTES + " where status = 'draft'", NEWEST, page=4)


@query("l09_sales_orders", ORDERS + f" where status = 'pending' and order_date <= date '{END}'")
def sales_orders(db):
    return matching(db, "sales_orders", status="pending", end=END)


listing("l09_sales_orders", of("sales_orders", customer_id=8), ORDERS + " where customer_id = 8", NEWEST, limit=5)


@query("l10_purchase_orders", PURCHASES + f" where status = 'received' and order_date >= date '{START}'")
def purchase_orders(db):
    return matching(db, "purchase_orders", status="received", start=START)


listing("l10_purchase_orders", of("purchase_orders", supplier_id=3), PURCHASES + " where supplier_id = 3", NEWEST, page=2)


INVOICES = "select i.*, c.name as customer_name from invoices i left join customers c on c.id = i.customer_id"
_INVOICE_FILTER = " where (invoice_number ilike '%77%' or c.name ilike '%77%') and payment_status = 'unpaid'"


@query("l11_invoices", INVOICES + _INVOICE_FILTER)
def invoices(db):
    return matching(db, "invoices", search="77", payment_status="unpaid")


listing("l11_invoices", of("invoices", search="77", payment_status="unpaid"), INVOICES + _INVOICE_FILTER, NEWEST)


TRANSACTIONS = "select t.*, a.name as account_name from financial_transactions t left join accounts a on a.id = account_id"


@query("l12_transactions", TRANSACTIONS + f" where t.type = 'expense' and transaction_date >= date '{START}'")
def transactions(db):
    return matching(db, "transactions", type="expense", start=START)


listing("l12_transactions", of("transactions", account_id=5), TRANSACTIONS + " where account_id = 5",
        "transaction_date desc nulls first, id")


@query("l13_accounts", "select * from accounts where type = 'ASIA' and is_active")
def accounts(db):
    return matching(db, "accounts", type="ASIA", is_active=True)


USERS = "select u.*, r.name as role_name from users u left join user_roles r on r.id = u.role_id"


listing("l14_users", of("users", search="r1", role="manager", is_active=True), USERS + """
where (username ilike '%r1%' or email ilike '%r1%' or first_name ilike '%r1%' or last_name ilike '%r1%')
and r.name = 'manager' and u.is_active""", NEWEST, limit=5)


@query("d04_movement_details", MOVEMENTS)
def movement_details(db):
    return enrich(db, "movements")


@query("d04_invoice_details", INVOICES)
def invoice_details(db):
    return enrich(db, "invoices")


@query("d04_transaction_details", TRANSACTIONS)
def transaction_details(db):
    return enrich(db, "transactions")


@query("d04_user_details", USERS)
def user_details(db):
    return enrich(db, "users")


@query("d04_products_by_key", PRODUCTS + " where p.id in (select product_id from sales_order_items where quantity >= 50)")
def products_by_key(db):
    keys = db["sales_order_items"].filter("quantity >= 50").select("product_id")
    return enrich(db, "products", keys)


@query("d05_family_details", """
select f.*, parent.name as parent_name, u.username as created_by_username, count(distinct p.id) as product_count
from product_families f left join product_families parent on f.parent_id = parent.id
left join users u on u.id = f.created_by left join products p on p.family_id = f.id group by all""")
def families_detail(db):
    return family_details(db)


listing("x02_saved_search",
        lambda db, **paging: saved_search(db, "sales_orders", f'{{"status": "completed", "start": "{START}"}}', **paging),
        ORDERS + f" where status = 'completed' and order_date >= date '{START}'", NEWEST, limit=30)
