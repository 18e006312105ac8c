"""Constraint checks over whole tables: one row per violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.sources.schemas import FOREIGN_KEYS, REQUIRED, UNIQUE

# The message for each kind of violation.
MESSAGES = {
    "unique": "Duplicate entry. This record already exists.",
    "foreign_key": "Referenced record not found or cannot be deleted due to dependencies.",
    "not_null": "Required field is missing.",
    "invalid_text": "Invalid data format.",
}




def table_violations(db, table: str, foreign_keys=(), unique=(), required=(), typed=(), key: str = "id") -> DataFrame:
    """All checks of one table: one scan of it, one count of its values, one scan of each table
    its keys point to.

    The checked columns become rows (column, value), counted before anything is joined, so a
    value that fills a third of the table is a single row from then on. A dangling or repeated
    value, or one that its type cannot read, is one row; a record without a required value is
    one row with the record's key as ``value``. Nulls may repeat and need no parent."""
    df = db[table]
    parents: dict[str, list[str]] = {}
    for column, parent in foreign_keys:
        parents.setdefault(parent, []).append(column)
    kinds = dict(typed)
    checked = list(dict.fromkeys([c for c, _ in foreign_keys] + list(unique) + list(kinds)))
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(False).alias("_missing"), F.col(c).cast("string").alias("value")) for c in checked]
    cells += [F.struct(F.lit(c).alias("column_name"), F.lit(True).alias("_missing"), F.when(F.col(c).isNull(), F.col(key).cast("string")).alias("value"))
              for c in required]
    values = df.select(F.explode(F.array(*cells)).alias("_cell")).select("_cell.*").filter("value is not null")
    counts = values.groupBy("column_name", "value", "_missing").agg(F.count(F.lit(1)).alias("row_count"))
    known = [db[parent].select(F.col("id").cast("string").alias("_value"), F.explode(F.array(*map(F.lit, columns))).alias("_column"))
             for parent, columns in parents.items()]
    if known:
        known = reduce(DataFrame.unionByName, known).distinct().withColumn("_known", F.lit(True))
        counts = counts.join(known, (F.col("column_name") == F.col("_column")) & (F.col("value") == F.col("_value")), "left")
    else:
        counts = counts.withColumn("_known", F.lit(True))
    def among(columns):
        return ~F.col("_missing") & F.col("column_name").isin(*columns)
    unreadable = reduce(lambda other, c: other | (among([c]) & F.col("value").try_cast(kinds[c]).isNull()), kinds, F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("_missing"), "not_null"),
        F.when(among([c for c, _ in foreign_keys]) & F.col("_known").isNull(), "foreign_key"),
        F.when(among(unique) & (F.col("row_count") > 1), "unique"),
        F.when(unreadable, "invalid_text")))
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return counts.select("column_name", "value", "row_count", F.explode(found).alias("violation")).select(
        F.lit(table).alias("table_name"), "column_name", "violation", "value", F.col("row_count").cast("bigint").alias("row_count"),
        message[F.col("violation")].alias("message"))


def violations(db, foreign_keys=(), unique=None, required=None, typed=()) -> DataFrame:
    """All checks in one report. ``foreign_keys`` lists (table, column, parent), ``typed``
    (table, text column, type)."""
    unique, required = unique or {}, required or {}
    tables = dict.fromkeys([t for t, *_ in foreign_keys] + list(unique) + list(required) + [t for t, *_ in typed])
    return reduce(DataFrame.unionByName, [
        table_violations(db, t, [(c, p) for child, c, p in foreign_keys if child == t], unique.get(t, ()), required.get(t, ()),
                         [(c, kind) for table, c, kind in typed if table == t])
        for t in tables if any(x[0] == t for x in (*foreign_keys, *typed)) or unique.get(t) or required.get(t)])


def declared_constraints(columns: dict[str, list[str]]) -> tuple[list, dict, dict]:
    """The declared keys, unique and required columns of tables with the given columns."""
    def has(table: str, column: str) -> bool:
        return column in columns.get(table, ())

    return ([k for k in FOREIGN_KEYS if has(k[0], k[1]) and k[2] in columns],
            {t: [c for c in cs if has(t, c)] for t, cs in UNIQUE.items()}, {t: [c for c in cs if has(t, c)] for t, cs in REQUIRED.items()})


def declared_violations(db, tables: list[str] | None = None) -> DataFrame:
    """All declared constraints of the tables (of all in ``db`` without a list), as far as their
    columns are there."""
    return violations(db, *declared_constraints({t: db[t].columns for t in tables or db}))
