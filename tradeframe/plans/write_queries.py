"""Batch writes and integrity U1-U9, audit trail X6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeframe.operators import integrity, writes
from tradeframe.plans.catalogue import query
from tradeframe.plans.workflow_queries import STAMP, at
from tradeframe.session import shared_folder
from tradeframe.sources import commits

# --- partial updates ------------------------------------------------------------------


def _customer_updates(db):
    """One update per event: the user is the customer, each kind of event sets other
    fields; clicks name a customer that does not exist."""
    kind = F.col("event_type")
    return db.given("events").select(
        F.when(kind == "click", -F.col("event_id") - 1).otherwise(F.col("user_id")).alias("id"),
        F.when(kind == "signup", F.concat(F.lit("Name "), F.col("event_id").cast("string"))).alias("name"),
        F.when(kind.isin("signup", "view"), F.concat(F.lit("mail"), F.col("event_id").cast("string"))).alias("email"),
        F.when(kind == "error", F.lit(False)).when(kind == "purchase", F.lit(True)).alias("is_active"),
        F.col("ts").alias("updated_at"))


_UPDATES = """
updates as (
  select case when event_type = 'click' then -event_id - 1 else user_id end as id,
         case when event_type = 'signup' then 'Name ' || event_id end as name,
         case when event_type in ('signup', 'view') then 'mail' || event_id end as email,
         case event_type when 'error' then false when 'purchase' then true end as is_active, ts as updated_at
  from events)"""


def _updated(db):
    return writes.upsert_coalesce(db["customers"], _customer_updates(db), "id", ["name", "email", "is_active"])


@query("u01_updated_customers", f"""
with {_UPDATES}
select c.* exclude (name, email, is_active), coalesce(u.name, c.name) as name, coalesce(u.email, c.email) as email,
       coalesce(u.is_active, c.is_active) as is_active, u.updated_at
from customers c left join (
  select id, arg_max(name, updated_at) filter (where name is not null) as name,
         arg_max(email, updated_at) filter (where email is not null) as email,
         arg_max(is_active, updated_at) filter (where is_active is not null) as is_active,
         max(updated_at) as updated_at from updates group by 1) u on u.id = c.id""")
def updated_customers(db):
    return _updated(db).table


@query("u01_rejected_updates", f"""
with {_UPDATES} select *, 'not found' as reason from updates where id not in (select id from customers)""")
def rejected_updates(db):
    return _updated(db).rejected


@query("u01_updated_invoices", f"""
select i.* exclude (due_date, total_amount, tax_amount),
       case when payment_status = 'unpaid' then cast(due_date + 15 as date) else due_date end as due_date,
       case when payment_status = 'partial' then cast(total_amount + 1 as decimal(12,2)) else total_amount end
         as total_amount,
       coalesce(tax_amount, case when payment_status in ('unpaid', 'partial') then cast(7 as decimal(12,2)) end)
         as tax_amount,
       case when payment_status in ('unpaid', 'partial') then {STAMP} end as updated_at
from invoices i""")
def updated_invoices(db):
    invoices, state = db["invoices"], F.col("payment_status")
    updates = invoices.filter(state.isin("unpaid", "partial")).select(
        "id", F.when(state == "unpaid", F.date_add("due_date", 15)).alias("due_date"),
        F.when(state == "partial", F.col("total_amount") + 1).cast("decimal(12,2)").alias("total_amount"),
        F.when(F.col("tax_amount").isNull(), 7).cast("decimal(12,2)").alias("tax_amount"), at().alias("updated_at"))
    return writes.upsert_coalesce(invoices, updates, "id", ["due_date", "total_amount", "tax_amount"]).table


# --- inserts ----------------------------------------------------------------------------


def _new_transactions(db):
    """Requests from the invoices; some lack the type, the amount or the account."""
    state, amount = F.col("payment_status"), F.col("total_amount")
    return db["invoices"].select(
        "id", F.when(state != "cancelled", "income").alias("type"),
        F.when(amount < 50000, 0).otherwise(amount).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("tax_amount").isNotNull(), F.col("id") % 25).alias("account_id"),
        F.when(state == "overdue", "EUR").alias("currency"))


_NEW = """
requests as (
  select id, case when payment_status <> 'cancelled' then 'income' end as type,
         cast(case when total_amount < 50000 then 0 else total_amount end as decimal(12,2)) as amount,
         case when tax_amount is not null then id % 25 end as account_id,
         case when payment_status = 'overdue' then 'EUR' end as currency
  from invoices)"""


def _required(db):
    return writes.check_required(_new_transactions(db), ["type", "amount", "account_id"], non_zero=["amount"])


@query("u02_accepted_transactions", f"""
with {_NEW}
select * exclude (currency), coalesce(currency, 'DZD') as currency, 'pending' as status, false as is_reconciled
from requests where type is not null and amount <> 0 and account_id is not null""")
def accepted_transactions(db):
    return writes.with_defaults(_required(db).accepted, "financial_transactions")


@query("u02_rejected_transactions", f"""
with {_NEW}
select *, case when type is null then 'type is required' when amount = 0 then 'amount is required'
               else 'account_id is required' end as reason
from requests where type is null or amount = 0 or account_id is null""")
def rejected_transactions(db):
    return _required(db).rejected


def _new_users(db):
    """Sign-ups from orders: name and mail by customer, so many repeat; some are taken."""
    return db["sales_orders"].select(
        F.col("id").alias("request"), F.concat(F.lit("user"), F.col("customer_id").cast("string")).alias("username"),
        F.concat(F.lit("user"), (F.col("customer_id") + (F.col("status") == "pending").cast("bigint")).cast("string"), F.lit("@example.com"))
        .alias("email"))


# One request after the other: a step takes the next pair of values, with what was accepted so far.
_SIGNUPS = """
signups as (
  select id as request, 'user' || customer_id as username, 'user' || (customer_id + (status = 'pending')::bigint) || '@example.com' as email
  from sales_orders),
pairs as (
  select username, email, min(request) as request, row_number() over (order by min(request)) as step
  from signups where username not in (select username from users where username is not null)
    and email not in (select email from users where email is not null) group by username, email),
fold as (
  select 0::bigint as step, false as ok, ''::varchar as username, ''::varchar as email, 0::bigint as request, []::varchar[] as names, []::varchar[] as mails
  union all
  select step, ok, username, email, request, case when ok then list_append(names, username) else names end,
         case when ok then list_append(mails, email) else mails end
  from (select p.*, f.names, f.mails, not list_contains(f.names, p.username) and not list_contains(f.mails, p.email) as ok
        from fold f join pairs p on p.step = f.step + 1)),
won as (select request, username, email from fold where ok),
judged as (
  select s.*, case
    when s.username in (select username from users) then 'username exists already'
    when s.request > n.request then 'username repeated in the batch'
    when s.email in (select email from users) then 'email exists already'
    when s.request > m.request then 'email repeated in the batch' end as reason
  from signups s left join won n on n.username = s.username left join won m on m.email = s.email)"""


def _signups(db):
    return writes.check_unique(db["users"], _new_users(db), ["username", "email"], "request")


@query("u03_accepted_users", f"with recursive {_SIGNUPS} select request, username, email from judged where reason is null")
def accepted_users(db):
    return _signups(db).accepted


@query("u03_rejected_users", f"with recursive {_SIGNUPS} select * from judged where reason is not null")
def rejected_users(db):
    return _signups(db).rejected


# --- deletes ----------------------------------------------------------------------------


def _order_deletes(db):
    orders = db["sales_orders"]
    asked = orders.filter("status = 'cancelled'").select("id").unionAll(
        orders.filter("status = 'pending'").select(-F.col("id") - 1))
    return writes.delete_by_key(orders, asked)


@query("u04_deleted_orders", "select * from sales_orders where status = 'cancelled'")
def deleted_orders(db):
    return _order_deletes(db).deleted


@query("u04_kept_orders", "select * from sales_orders where status <> 'cancelled'")
def kept_orders(db):
    return _order_deletes(db).kept


@query("u04_rejected_deletes", "select -id - 1 as id, 'not found' as reason from sales_orders where status = 'pending'")
def rejected_deletes(db):
    return _order_deletes(db).rejected


@query("u04_user_deletes_rejected", """
select id, id as requested_by, 'cannot delete own record' as reason from users where role_id = 1
union all select -id - 1, id, 'not found' from users where role_id = 2""")
def user_deletes(db):
    users = db["users"]
    own = users.filter("role_id = 1").select("id", F.col("id").alias("requested_by"))
    unknown = users.filter("role_id = 2").select(-F.col("id") - 1, "id")
    fine = users.filter("role_id = 3").select("id", F.col("id") + 1)
    return writes.delete_by_key(users, own.unionAll(unknown).unionAll(fine), actor="requested_by").rejected


def _family_deletes(db):
    """Ask to delete all families, stored ones and a new one per part size (without products
    yet), and some that do not exist."""
    part = db.given("part").select("p_size").distinct()
    families = db["product_families"].select("id", "code", "name", "parent_id", "level")
    new = part.select((F.col("p_size") + 10).cast("bigint").alias("id"), F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("code"),
                      F.col("p_size").cast("string").alias("name"),
                      F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 9).cast("bigint").alias("parent_id"), F.lit(1).alias("level"))
    families = families.unionByName(new)
    asked = families.select("id").unionAll(families.filter("level = 1").select(-F.col("id")))
    return writes.delete_families(families, db["products"], asked)


_FAMILIES = """
families as (
  select id, code, name, parent_id, level from product_families
  union all
  select distinct cast(p_size + 10 as bigint), 'S' || p_size, cast(p_size as varchar), cast(case when p_size % 2 = 0 then p_size + 9 end as bigint), 1 from part)"""
_FREE = """
id not in (select family_id from products where family_id is not null)
and id not in (select parent_id from families where parent_id is not null)"""


@query("u05_kept_families", f"with {_FAMILIES} select * from families where not ({_FREE})")
def kept_families(db):
    return _family_deletes(db).kept


@query("u05_deleted_families", f"with {_FAMILIES} select * from families where {_FREE}")
def deleted_families(db):
    return _family_deletes(db).deleted


@query("u05_refused_families", f"""
with {_FAMILIES}
select id, case when id in (select family_id from products) then 'family has products'
                else 'family has child families' end as reason
from families where not ({_FREE})
union all select -id, 'not found' from families where level = 1""")
def refused_families(db):
    return _family_deletes(db).rejected


def _ordered_deletes(db):
    """A family per part size, below the one of half that size. Each is asked for once in an order that mixes
    parents and children, and most once more from the largest size down; so are families that do not exist and
    the stored ones, which have products or child families."""
    sizes = db.given("part").select(F.col("p_size").cast("bigint").alias("size")).distinct()
    stored = db["product_families"].select("id", "code", "name", "parent_id", "level")
    new = sizes.select((F.col("size") + 10).alias("id"), F.concat(F.lit("S"), F.col("size").cast("string")).alias("code"), F.col("size").cast("string").alias("name"),
                       F.when(F.col("size") > 1, F.floor(F.col("size") / 2) + 10).cast("bigint").alias("parent_id"), F.lit(1).alias("level"))
    first = sizes.select((F.col("size") * 37 % 101).alias("request"), (F.col("size") + 10).alias("id"))
    again = sizes.filter("size % 7 <> 3").select((300 - F.col("size")).alias("request"), (F.col("size") + 10).alias("id"))
    unknown = sizes.select((400 + F.col("size")).alias("request"), (-F.col("size")).alias("id"))
    others = stored.select((F.col("id") + 1000).alias("request"), "id")
    return writes.delete_families_in_order(stored.unionByName(new), db["products"], first.unionAll(again).unionAll(unknown).unionAll(others))


#: The requests one after the other; what is deleted so far travels along.
_ORDERED = """
sizes as (select distinct cast(p_size as bigint) as size from part),
families as (
  select id, code, name, parent_id, level from product_families
  union all
  select size + 10, 'S' || size, cast(size as varchar), case when size > 1 then size // 2 + 10 end, 1 from sizes),
requests as (
  select size * 37 % 101 as request, size + 10 as id from sizes
  union all select 300 - size, size + 10 from sizes where size % 7 <> 3
  union all select 400 + size, -size from sizes
  union all select id + 1000, id from product_families),
steps as (
  select r.*, row_number() over (order by request) as n, f.id is not null as known,
         r.id in (select family_id from products where family_id is not null) as used,
         coalesce((select list(c.id) from families c where c.parent_id = r.id), []) as children
  from requests r left join families f on f.id = r.id),
run as (
  select cast(0 as bigint) as n, cast(0 as bigint) as request, cast(0 as bigint) as id, cast([] as bigint[]) as gone, cast(null as varchar) as reason
  union all
  select n, request, id, case when reason is null then list_append(gone, id) else gone end, reason
  from (
    select s.n, s.request, s.id, r.gone,
           case when s.used then 'family has products' when not list_has_all(r.gone, s.children) then 'family has child families'
                when not s.known or list_contains(r.gone, s.id) then 'not found' end as reason
    from run r join steps s on s.n = r.n + 1))"""


@query("u05_ordered_deletes", f"with recursive {_ORDERED} select request, id, reason from run where reason is not null")
def ordered_deletes(db):
    return _ordered_deletes(db).rejected


@query("u05_ordered_deleted_families", f"""
with recursive {_ORDERED}
select * from families where id in (select id from run where n > 0 and reason is null)""")
def ordered_deleted_families(db):
    return _ordered_deletes(db).deleted


@query("u06_deactivated_suppliers", f"""
select s.* exclude (is_active), case when email is null then false else is_active end as is_active,
       case when email is null then {STAMP} end as updated_at
from suppliers s""")
def deactivated_suppliers(db):
    suppliers = db["suppliers"]
    return writes.deactivate(suppliers, suppliers.filter("email is null").select("id"), at()).table


# --- integrity ----------------------------------------------------------------------------

_KEYS = [("stock_movements", "product_id", "products"), ("stock_movements", "created_by", "users"),
         ("stock_movements", "approved_by", "users"), ("users", "role_id", "user_roles"),
         ("products", "family_id", "product_families"), ("sales_order_items", "order_id", "sales_orders"),
         ("invoices", "customer_id", "customers")]
_UNIQUE = {"customers": ["code", "email"], "users": ["username"], "products": ["sku", "barcode"]}
_REQUIRED = {"customers": ["email"], "products": ["barcode", "reorder_quantity"], "sales_quotes": ["valid_until"]}
_TYPED = [("suppliers", "phone", "bigint"), ("products", "barcode", "bigint")]


def _violations_sql(keys, unique, required, typed) -> str:
    parts = []

    def add(table, column, kind, value, rows, source):
        parts.append(f"select '{table}' as table_name, '{column}' as column_name, '{kind}' as violation, "
                     f"cast({value} as varchar) as value, {rows} as row_count, "
                     f"'{integrity.MESSAGES[kind]}' as message from {source}")

    for child, column, parent in keys:
        add(child, column, "foreign_key", column, "count(*)",
            f"{child} where {column} is not null and {column} not in (select id from {parent}) group by {column}")
    for table, columns in unique.items():
        for c in columns:
            add(table, c, "unique", c, "count(*)", f"{table} where {c} is not null group by {c} having count(*) > 1")
    for table, columns in required.items():
        for c in columns:
            add(table, c, "not_null", "id", "cast(1 as bigint)", f"{table} where {c} is null")
    for table, c, kind in typed:
        add(table, c, "invalid_text", c, "count(*)",
            f"{table} where {c} is not null and try_cast({c} as {kind}) is null group by {c}")
    return " union all ".join(parts)


@query("u07_violations", _violations_sql(_KEYS, _UNIQUE, _REQUIRED, _TYPED))
def violations(db):
    return integrity.violations(db, _KEYS, _UNIQUE, _REQUIRED, _TYPED)


# The columns of the views that the declared constraints name.
_DECLARED = {
    "users": ["id", "username", "role_id"], "user_roles": ["id", "name"], "product_families": ["id", "code", "name", "parent_id"],
    "products": ["id", "sku", "name", "barcode", "family_id"], "suppliers": ["id", "code", "name"], "customers": ["id", "code", "name"],
    "stock_movements": ["id", "movement_type", "product_id", "quantity", "created_by", "approved_by"],
    "sales_quotes": ["id", "quote_number", "customer_id", "quote_date"], "sales_orders": ["id", "order_number", "customer_id", "order_date"],
    "sales_order_items": ["order_id", "product_id", "quantity", "unit_price"], "invoices": ["id", "invoice_number", "customer_id"],
}


def _declared():
    keys, unique, required = integrity.declared_constraints(_DECLARED)
    required.pop("sales_order_items", None)  # the view has no key of its own to report
    return keys, unique, required


@query("u07_declared_violations", _violations_sql(*_declared(), []))
def declared_violations(db):
    return integrity.violations(db, *_declared())


def _cascade(db):
    return writes.cascade(db["sales_order_items"], "order_id", _order_deletes(db).deleted)


@query("u08_items_kept", """select * from sales_order_items
where order_id not in (select id from sales_orders where status = 'cancelled')""")
def items_kept(db):
    return _cascade(db).kept


@query("u08_items_deleted", """select * from sales_order_items
where order_id in (select id from sales_orders where status = 'cancelled')""")
def items_deleted(db):
    return _cascade(db).deleted


@query("u09_update_stamps", f"""
with {_UPDATES} select c.id, max(u.updated_at) as updated_at from customers c left join updates u on u.id = c.id group by 1""")
def update_stamps(db):
    return _updated(db).table.select("id", "updated_at")


# --- audit trail ----------------------------------------------------------------------------


@query("x06_row_changes", """
select case status when 'cancelled' then 'DELETE' else 'UPDATE' end as action, 'sales_orders' as table_name,
       id as record_id,
       case when status = 'pending' then 'status,total_amount' when status = 'completed' then 'total_amount' end
         as changed_columns
from sales_orders where status <> 'completed' or total_amount > 250000
union all select 'INSERT', 'sales_orders', -id - 1, null from sales_orders where status = 'pending'""")
def row_changes(db):
    """Cancelled orders go; pending ones are completed, change their amount and are copied
    under a new key; large completed ones change their amount."""
    old = db["sales_orders"].select("id", "status", "total_amount")
    raised = (F.col("status") == "pending") | (F.col("total_amount") > 250000)
    changed = old.filter("status <> 'cancelled'").select(
        "id", F.lit("completed").alias("status"),
        F.when(raised, F.col("total_amount") + 1).otherwise(F.col("total_amount")).cast("decimal(12,2)")
        .alias("total_amount"))
    new = changed.unionAll(old.filter("status = 'pending'").select(-F.col("id") - 1, "status", "total_amount"))
    return writes.row_changes(old, new, "sales_orders").drop("old_values", "new_values")


# --- several tables at once ------------------------------------------------------------------


def _committed(db):
    """Orders that are not pending are stored with their items and the stock of products; then the pending ones
    come with theirs and with the stock they take. The second job runs twice, as after a lost answer, and
    another one dies after its first table."""
    root = shared_folder(db.spark, "commits")
    orders, items, products = db["sales_orders"], db["sales_order_items"], db["products"].select("id", "quantity_in_stock")
    pending = orders.filter("status = 'pending'")
    is_pending = items.join(pending.select(F.col("id").alias("_order")), F.col("order_id") == F.col("_order"), "left_semi")
    others = items.join(pending.select(F.col("id").alias("_order")), F.col("order_id") == F.col("_order"), "left_anti")
    base = commits.commit(db.spark, root, "opening", 0, whole={
        "sales_orders": orders.filter("status <> 'pending'"), "sales_order_items": others, "products": products})
    taken = is_pending.groupBy(F.col("product_id").alias("_product")).agg(F.sum("quantity").cast("decimal(28,2)").alias("_taken"))
    left = commits.read(db.spark, root, "products").join(taken, F.col("id") == F.col("_product"), "left").select(
        "id", (F.col("quantity_in_stock") - F.coalesce("_taken", F.lit(0).cast("decimal(28,2)"))).cast("decimal(28,2)").alias("quantity_in_stock"))
    for _ in range(2):
        commits.commit(db.spark, root, "pending", base, whole={"products": left}, more={"sales_orders": pending, "sales_order_items": is_pending})
    commits.inserted(db.spark, root, "sales_orders", "pending").write.mode("overwrite").parquet(f"{root}/sales_orders/died")
    return root


@query("s03_committed_order", """
select o.id, o.customer_id, o.order_date, o.status, o.total_amount, coalesce(i.lines, 0) as item_lines, coalesce(i.quantity, 0) as quantity
from sales_orders o left join (
  select order_id, count(*) as lines, cast(sum(quantity) as decimal(28,2)) as quantity from sales_order_items group by 1) i on i.order_id = o.id""")
def committed_order(db):
    """Orders with what their committed items say."""
    root = _committed(db)
    items = commits.read(db.spark, root, "sales_order_items").groupBy(F.col("order_id").alias("_order")).agg(
        F.count("*").alias("_lines"), F.sum("quantity").cast("decimal(28,2)").alias("_quantity"))
    orders = commits.read(db.spark, root, "sales_orders").join(items, F.col("id") == F.col("_order"), "left")
    return orders.select("id", "customer_id", "order_date", "status", "total_amount", F.coalesce("_lines", F.lit(0).cast("bigint")).alias("item_lines"),
                         F.coalesce("_quantity", F.lit(0).cast("decimal(28,2)")).alias("quantity"))


@query("s03_committed_stock", """
select p.id, cast(p.quantity_in_stock - coalesce(t.taken, 0) as decimal(28,2)) as quantity_in_stock
from products p left join (
  select product_id, sum(quantity) as taken from sales_order_items i join sales_orders o on o.id = i.order_id
  where o.status = 'pending' group by 1) t on t.product_id = p.id""")
def committed_stock(db):
    return commits.read(db.spark, _committed(db), "products")
