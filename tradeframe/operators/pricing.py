"""Line totals, document totals, line numbers, movement values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.money import MONEY, QUANTITY, RATE, TOTAL
from tradeframe.functions.ranking import line_numbers


def line_total(quantity: str = "quantity", price: str = "unit_price",
               discount: str = "discount_percentage") -> Column:
    """``quantity * price * (1 - discount / 100)``, rounded once; a null discount is
    none. Tax is not part of a line."""
    rate = F.coalesce(F.col(discount), F.lit(0).cast(RATE))
    # (100 - rate) / 100 as an exact decimal with four places
    keep = (F.lit(100).cast(RATE) - rate).cast("decimal(6,2)") * F.lit("0.01").cast("decimal(3,2)")
    gross = (F.col(quantity) * F.col(price)).cast("decimal(24,4)")
    return F.round(gross * keep.cast("decimal(8,4)"), 2).cast(TOTAL)


def priced_lines(items: DataFrame) -> DataFrame:
    return items.withColumn("line_total", line_total())


def _share(rate: Column) -> Column:
    """A percentage as an exact factor."""
    return (rate * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(7,4)")


def _rounded(column: str) -> Column:
    return F.round(F.col(column), 2).cast(TOTAL)


def document_totals(items: DataFrame, document: str, discount_rate: Column | None = None,
                    tax_rate: Column | None = None, headers: DataFrame | None = None,
                    header_key: str = "id") -> DataFrame:
    """Subtotal, discount, tax and total per document.

    The subtotal ignores line discounts. The document's rates come from ``headers``
    (columns ``discount_percentage``, ``tax_percentage``) or from the two constants.
    Every amount is computed exactly and rounded to two places once, so the total may
    differ by a cent from the sum of the rounded parts."""
    sums = items.groupBy(document).agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("_gross"))
    if headers is not None:
        rates = headers.select(F.col(header_key).alias("_key"), "discount_percentage", "tax_percentage")
        sums = rates.join(sums, F.col("_key") == F.col(document), "left").withColumn(document, F.col("_key"))
        discount_rate, tax_rate = F.col("discount_percentage"), F.col("tax_percentage")
    zero = F.lit(0).cast(RATE)
    discount_rate = zero if discount_rate is None else F.coalesce(discount_rate.cast(RATE), zero)
    tax_rate = zero if tax_rate is None else F.coalesce(tax_rate.cast(RATE), zero)
    gross = F.coalesce(F.col("_gross"), F.lit(0)).cast("decimal(20,4)")
    out = sums.withColumn("_subtotal", gross)
    out = out.withColumn("_discount", F.col("_subtotal") * _share(discount_rate))
    out = out.withColumn("_taxable", (F.col("_subtotal") - F.col("_discount")).cast("decimal(26,8)"))
    out = out.withColumn("_tax", F.col("_taxable") * _share(tax_rate))
    return out.select(
        document,
        _rounded("_subtotal").alias("subtotal"),
        _rounded("_discount").alias("discount_amount"),
        _rounded("_taxable").alias("taxable_amount"),
        _rounded("_tax").alias("tax_amount"),
        F.round(F.col("_taxable") + F.col("_tax"), 2).cast(TOTAL).alias("total_amount"),
    )


def number_nested(documents: DataFrame, key: str, items: str = "items") -> DataFrame:
    """Flatten documents that carry their items as an array; the line number is the
    position in the array plus one."""
    lines = documents.select(key, F.posexplode(items).alias("_position", "_item"))
    return lines.select(key, (F.col("_position") + 1).cast("bigint").alias("line_number"), "_item.*")


def number_flat(items: DataFrame, document: str, position: str) -> DataFrame:
    """Line numbers for flat items from a unique integer position per document."""
    return line_numbers(items, document, position)


def movement_value(value: str = "total_value", quantity: str = "quantity", price: str = "unit_price") -> Column:
    """The given value, else quantity times price. A given zero counts as not given,
    and a missing price as zero."""
    product = F.round(F.col(quantity) * F.coalesce(F.col(price), F.lit(0).cast(MONEY)), 2)
    return F.coalesce(F.nullif(F.col(value), F.lit(0)).cast("decimal(18,2)"), product.cast("decimal(18,2)"))


def new_document(header: DataFrame, items: DataFrame, key: str, link: str) -> tuple[DataFrame, DataFrame]:
    """Header rows with their totals, and items with line totals. The header's own
    rate columns apply to the totals; a header without items totals zero."""
    totals = document_totals(items, link, headers=header, header_key=key)
    amounts = ["subtotal", "discount_amount", "tax_amount", "total_amount"]
    joined = header.drop(*amounts).join(
        totals.select(F.col(link).alias("_doc"), *amounts), F.col(key) == F.col("_doc"), "left").drop("_doc")
    lines = items.withColumn("discount_percentage", F.coalesce("discount_percentage", F.lit(0).cast(RATE)))
    return joined, priced_lines(lines).withColumn("quantity", F.col("quantity").cast(QUANTITY))
