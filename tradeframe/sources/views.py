"""Business tables derived from the given tables, so that every operator can run on
whole given tables. A view is a projection or an aggregation with a map-side part;
none numbers rows or needs a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.functions.keys import content_id
from tradeframe.functions.money import MONEY, QUANTITY, RATE
from tradeframe.sources.tables import read_table


def _ref(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _null_every(n: int, key: str, value: Column) -> Column:
    return F.when(F.col(key) % n == 0, None).otherwise(value)


class BusinessViews:
    """Lazily built business tables over one directory: ``db["sales_orders"]``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def given(self, table: str) -> DataFrame:
        return read_table(self.spark, self.directory, table)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, "_" + name)()

    def _customers(self) -> DataFrame:
        joined = self.given("customer").join(self.given("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("id"),
            _ref("CUST-", "c_custkey").alias("code"),
            F.col("c_name").alias("name"),
            _null_every(4, "c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))).alias("email"),
            _null_every(3, "c_custkey", _ref("555-", "c_custkey")).alias("phone"),
            _null_every(2, "c_custkey", F.concat("n_name", F.lit(" Trading"))).alias("company"),
            F.col("c_mktsegment").alias("customer_type"),
            F.col("n_name").alias("billing_country"),
            F.col("c_acctbal").cast(MONEY).alias("current_balance"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("created_at"),
        )

    def _suppliers(self) -> DataFrame:
        joined = self.given("supplier").join(self.given("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("s_suppkey").alias("id"),
            _ref("SUPP-", "s_suppkey").alias("code"),
            F.col("s_name").alias("name"),
            _null_every(3, "s_suppkey", F.concat(_ref("sales", "s_suppkey"), F.lit("@example.com"))).alias("email"),
            _ref("777-", "s_suppkey").alias("phone"),
            _null_every(2, "s_suppkey", F.concat("n_name", F.lit(" Supplies"))).alias("company"),
            F.col("n_name").alias("country"),
            F.col("s_acctbal").cast(MONEY).alias("current_balance"),
            (F.col("s_suppkey") % 10 != 0).alias("is_active"),
            F.date_add(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")).alias("created_at"),
        )

    def _user_roles(self) -> DataFrame:
        name = F.create_map(*[F.lit(x) for pair in enumerate(
            ["super_admin", "admin", "manager", "accountant", "sales"]) for x in pair])
        return self.given("region").select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("id"),
            name[F.col("r_regionkey")].alias("name"),
            F.concat(F.lit('{"region": "'), F.col("r_name"), F.lit('"}')).alias("permissions"),
        )

    def _users(self) -> DataFrame:
        seen = self.given("events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        return seen.select(
            F.col("user_id").alias("id"),
            _ref("user", "user_id").alias("username"),
            F.concat(_ref("user", "user_id"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("First"), (F.col("user_id") % 10).cast("string")).alias("first_name"),
            F.concat(F.lit("Last"), (F.col("user_id") % 7).cast("string")).alias("last_name"),
            _null_every(5, "user_id", _ref("555-9", "user_id")).alias("phone"),
            (F.col("user_id") % 6 + 1).alias("role_id"),
            (F.col("user_id") % 9 != 0).alias("is_active"),
            F.col("last").alias("last_login"),
            F.col("first").alias("created_at"),
        )

    def _product_families(self) -> DataFrame:
        """Types are roots, (type, brand) pairs their children; keys come from the code."""
        roots = self.given("part").select("p_type").distinct().select(
            content_id("p_type").alias("id"),
            F.col("p_type").alias("code"),
            F.col("p_type").alias("name"),
            F.lit(None).cast("bigint").alias("parent_id"),
            F.lit(1).alias("level"),
            F.concat(F.lit("/"), "p_type").alias("path"),
            (F.col("p_type") != "PROMO").alias("is_active"),
            (content_id("p_type") % 200).alias("created_by"),
        )
        code = F.concat_ws("-", "p_type", "p_brand")
        kids = self.given("part").select("p_type", "p_brand").distinct().withColumn("id", content_id("p_type", "p_brand"))
        kids = kids.select(
            "id",
            code.alias("code"),
            F.col("p_brand").alias("name"),
            content_id("p_type").alias("parent_id"),
            F.lit(2).alias("level"),
            _null_every(7, "id", F.concat(F.lit("/"), "p_type", F.lit("/"), code)).alias("path"),
            (F.col("id") % 11 != 0).alias("is_active"),
            (F.col("id") % 200).alias("created_by"),
        )
        return roots.unionAll(kids)

    def _products(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.given("part").select(
            key.alias("id"),
            _ref("SKU-", "p_partkey").alias("sku"),
            _null_every(5, "p_partkey", _ref("613", "p_partkey")).alias("barcode"),
            F.col("p_name").alias("name"),
            F.lit("piece").alias("unit"),
            content_id("p_type", "p_brand").alias("family_id"),
            (key * 37 % 200).cast(QUANTITY).alias("quantity_in_stock"),
            size.cast(QUANTITY).alias("min_stock_level"),
            (size * 2).cast(QUANTITY).alias("reorder_point"),
            _null_every(3, "p_partkey", (size * 4).cast(QUANTITY)).alias("reorder_quantity"),
            F.round(F.col("p_retailprice").cast(MONEY) * F.lit("0.60").cast("decimal(3,2)"), 2)
            .cast(MONEY).alias("cost_price"),
            F.col("p_retailprice").cast(MONEY).alias("selling_price"),
            _null_every(4, "p_partkey", F.col("p_retailprice").cast(MONEY)).alias("last_purchase_price"),
            (key % 10 != 0).alias("is_active"),
            F.date_add(F.lit("1998-01-01").cast("date"), (key % 300).cast("int")).alias("created_at"),
        )

    def _products_with_supplier(self) -> DataFrame:
        """Products with their preferred supplier (the lowest that ever delivered)."""
        first = self.given("lineitem").groupBy(F.col("l_partkey").alias("supplied_product")).agg(
            F.min("l_suppkey").alias("default_supplier_id"))
        products = self["products"]
        return products.join(first, products.id == F.col("supplied_product"), "left").drop("supplied_product")

    def _sales_orders(self) -> DataFrame:
        return self.given("orders").select(
            F.col("o_orderkey").alias("id"),
            _ref("SO-", "o_orderkey").alias("order_number"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("cancelled").alias("status"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            (F.col("o_custkey") % 200).alias("created_by"),
            F.col("o_orderdate").cast("date").alias("created_at"),
        )

    def _sales_order_items(self) -> DataFrame:
        joined = self.given("lineitem").join(self.given("part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").cast("bigint").alias("line_number"),
            F.col("l_quantity").cast(QUANTITY).alias("quantity"),
            F.col("p_retailprice").cast(MONEY).alias("unit_price"),
            (F.col("l_discount") * 100).cast(RATE).alias("discount_percentage"),
            (F.col("l_tax") * 100).cast(RATE).alias("tax_percentage"),
        )

    def _sales_quotes(self) -> DataFrame:
        return self["sales_orders"].select(
            "id",
            _ref("QT-", "id").alias("quote_number"),
            "customer_id",
            F.col("order_date").alias("quote_date"),
            _null_every(5, "id", F.date_add("order_date", 30)).alias("valid_until"),
            F.when(F.col("status") == "completed", "approved").when(F.col("status") == "pending", "draft")
            .otherwise("rejected").alias("status"),
            "total_amount",
            F.col("order_date").alias("created_at"),
        )

    def _sales_quote_items(self) -> DataFrame:
        return self["sales_order_items"].withColumnRenamed("order_id", "quote_id")

    def _purchase_key(self) -> Column:
        ship = F.col("l_shipdate")
        return (F.col("l_suppkey") * 1000 + (F.year(ship) - 1990) * 12 + F.month(ship)).cast("bigint")

    def _purchase_orders(self) -> DataFrame:
        lines = self.given("lineitem").groupBy(
            self._purchase_key().alias("id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.month("l_shipdate").alias("month"),
        ).agg(
            F.min("l_shipdate").cast("date").alias("order_date"),
            F.max("l_shipdate").cast("date").alias("last_date"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(18,2)").alias("total_amount"),
        )
        month = F.col("month") % 4
        return lines.select(
            "id",
            _ref("PO-", "id").alias("order_number"),
            "supplier_id",
            "order_date",
            _null_every(4, "supplier_id", F.col("last_date")).alias("actual_delivery_date"),
            F.when(month == 0, "completed").when(month == 1, "pending").when(month == 2, "received")
            .otherwise("cancelled").alias("status"),
            "total_amount",
            F.col("order_date").alias("created_at"),
        )

    def _purchase_order_items(self) -> DataFrame:
        return self.given("lineitem").select(
            self._purchase_key().alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_number"),
            F.col("l_quantity").cast(QUANTITY).alias("quantity"),
            F.round(F.col("l_extendedprice").cast(MONEY) * F.lit("0.02").cast("decimal(3,2)"), 2)
            .cast(MONEY).alias("unit_price"),
            (F.col("l_discount") * 100).cast(RATE).alias("discount_percentage"),
        )

    def _invoices(self) -> DataFrame:
        orders = self.given("orders")
        amount = F.col("o_totalprice").cast(MONEY)
        issued = F.col("o_orderdate").cast("date")
        priority = F.col("o_orderpriority")
        return orders.select(
            F.col("o_orderkey").alias("id"),
            _ref("INV-", "o_orderkey").alias("invoice_number"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").alias("sales_order_id"),
            issued.alias("issue_date"),
            F.date_add(issued, 30).alias("due_date"),
            amount.alias("total_amount"),
            _null_every(6, "o_orderkey", F.round(amount * F.lit("0.19").cast("decimal(3,2)"), 2).cast(MONEY))
            .alias("tax_amount"),
            F.when(priority == "1-URGENT", "paid").when(priority == "2-HIGH", "unpaid")
            .when(priority == "3-MEDIUM", "partial").when(priority == "5-LOW", "cancelled")
            .otherwise("overdue").alias("payment_status"),
            issued.alias("created_at"),
        )

    def _accounts(self) -> DataFrame:
        balances = self.given("customer").groupBy(F.col("c_nationkey").alias("owner")).agg(
            F.sum(F.col("c_acctbal").cast(MONEY)).alias("balance"))
        joined = (
            self.given("nation")
            .join(self.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(balances, F.col("n_nationkey") == F.col("owner"), "left")
        )
        return joined.select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("type"),
            F.coalesce("balance", F.lit(0)).cast("decimal(18,2)").alias("balance"),
            F.lit("DZD").alias("currency"),
            (F.col("n_nationkey") % 8 != 0).alias("is_active"),
        )

    def _financial_transactions(self) -> DataFrame:
        sales = self["sales_orders"].select(
            "id",
            F.when(F.col("status") == "cancelled", "transfer").otherwise("income").alias("type"),
            F.col("total_amount").cast("decimal(18,2)").alias("amount"),
            F.col("order_date").alias("transaction_date"),
            (F.col("id") % 25).alias("account_id"),
        )
        purchases = self["purchase_orders"].select(
            -F.col("id") - 1,
            F.lit("expense"),
            F.col("total_amount"),
            "order_date",
            F.lit(None).cast("bigint"),
        )
        return sales.unionAll(purchases)

    def _stock_movements(self) -> DataFrame:
        flag, line, key = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_suppkey")
        kind = (
            F.when(flag == "R", "IN").when((flag == "N") & (line == 1), "RETURN")
            .when((flag == "N") & (line == 2), "ADJUSTMENT").when(line == 3, "TRANSFER").otherwise("OUT")
        )
        signed = F.when((flag == "N") & (line == 2), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        return self.given("lineitem").select(
            content_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date"),
                       F.col("l_quantity").cast("int")).alias("id"),
            kind.alias("movement_type"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_orderkey").alias("sales_order_id"),
            signed.cast(QUANTITY).alias("quantity"),
            F.round(F.col("l_extendedprice").cast(MONEY) * F.lit("0.02").cast("decimal(3,2)"), 2)
            .cast(MONEY).alias("unit_price"),
            F.col("l_shipdate").cast("date").alias("movement_date"),
            F.col("l_shipdate").cast("date").alias("created_at"),
            _null_every(7, "l_suppkey", key).alias("created_by"),
            F.when(F.col("l_linestatus") == "F", key + 60).alias("approved_by"),
            (F.col("l_linestatus") == "F").alias("is_approved"),
            F.when(flag == "A", "WH-A").when(flag == "R", "WH-R").alias("warehouse"),
        )
