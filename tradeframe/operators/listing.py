"""Listing: filters, search, lookup joins, sorted pages and totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.functions.dates import within
from tradeframe.functions.text import matches_any
from tradeframe.session import cut

#: A page that starts further on is located by ranges; before that each task keeps all rows up to its end.
DEEP = 2_000


class Listing(NamedTuple):
    rows: DataFrame     # one page, sorted
    totals: DataFrame   # one row: total_count, total_pages


@dataclass(frozen=True)
class Lookup:
    """Named columns of another table, joined by key: ``columns`` maps the new name to
    the other table's column. The key is unique there, so a left lookup neither adds
    nor drops rows; an inner one drops the rows without a match."""

    on: str
    table: str
    columns: dict[str, str]
    how: str = "left"
    key: str = "id"

    def join(self, df: DataFrame, db) -> DataFrame:
        right = db[self.table].select(
            F.col(self.key).alias("_lookup"), *[F.col(c).alias(new) for new, c in self.columns.items()])
        return df.join(right, F.col(self.on) == F.col("_lookup"), self.how).drop("_lookup")

    def exists(self, df: DataFrame, db) -> DataFrame:
        """The rows that have a match, without its columns."""
        right = db[self.table].select(F.col(self.key).alias("_lookup"))
        return df.join(right, F.col(self.on) == F.col("_lookup"), "left_semi")


@dataclass(frozen=True)
class ListSpec:
    """How one kind of record is listed.

    ``base`` gives the records and ``lookups`` what is shown beside them. ``filters``
    maps an argument to the column it must equal, ``flags`` to a fixed condition that
    the argument turns on. A lookup is joined to the whole table only if a filter, the
    search or the sort needs its columns; otherwise only to the rows of the page."""

    base: Callable[[object], DataFrame]
    lookups: tuple[Lookup, ...] = ()
    search: tuple[str, ...] = ()
    filters: dict[str, str] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)
    period: str | None = None
    sortable: tuple[str, ...] = ()
    sort: tuple[tuple[str, str], ...] = (("created_at", "desc"),)
    key: str = "id"


def sort_key(column: str, direction: str = "asc") -> Column:
    """Nulls are the largest values: last when ascending, first when descending."""
    if direction.lower() == "asc":
        return F.col(column).asc_nulls_last()
    return F.col(column).desc_nulls_first()


def split_lookups(spec: ListSpec, columns: set[str]) -> tuple[list[Lookup], list[Lookup]]:
    """The lookups that must come before filtering and sorting on the columns, and the
    others."""
    first = [x for x in spec.lookups if columns & set(x.columns)]
    return first, [x for x in spec.lookups if x not in first]


def join_lookups(df: DataFrame, db, lookups) -> DataFrame:
    for lookup in lookups:
        df = lookup.join(df, db)
    return df


def filter_rows(spec: ListSpec, df: DataFrame, search: str | None = None, start=None, end=None, **filters) -> DataFrame:
    """The rows that pass the given filters. A filter that is not given costs nothing."""
    for name, value in filters.items():
        if value is None:
            continue
        if name in spec.filters:
            df = df.filter(F.col(spec.filters[name]) == F.lit(value))
        elif value:
            df = df.filter(spec.flags[name])
    if spec.period is not None:
        df = within(df, spec.period, start, end)
    if search:
        df = df.filter(matches_any(search, list(spec.search)))
    return df


def _check_arguments(spec: ListSpec, start=None, end=None, search=None, **filters) -> set[str]:
    """The columns that the arguments look at; an argument the listing does not have is an error."""
    unknown = set(filters) - set(spec.filters) - set(spec.flags)
    if unknown:
        raise ValueError(f"unknown filter: {sorted(unknown)}")
    if spec.period is None and (start is not None or end is not None):
        raise ValueError("this listing has no period")
    used = {spec.filters[n] for n, v in filters.items() if v is not None and n in spec.filters}
    return used | (set(spec.search) if search else set())


def select_rows(spec: ListSpec, db, **arguments) -> DataFrame:
    """All rows that pass the given filters, with their lookups."""
    _check_arguments(spec, **arguments)
    return filter_rows(spec, join_lookups(spec.base(db), db, spec.lookups), **arguments)


def sorting(spec: ListSpec, sort_by: str | None = None, sort_order: str = "desc") -> list[tuple[str, str]]:
    """Columns to sort by with their directions; a field that is not sortable falls back to the default.
    The key comes last, so the order is total and pages do not overlap."""
    if sort_by in spec.sortable:
        keys = [(sort_by, "asc" if sort_order.lower() == "asc" else "desc")]
    else:
        keys = list(spec.sort)
    return [*keys, (spec.key, "asc")]


def order_of(spec: ListSpec, sort_by: str | None = None, sort_order: str = "desc") -> list[Column]:
    return [sort_key(c, d) for c, d in sorting(spec, sort_by, sort_order)]


def deep_page(rows: DataFrame, keys: list[tuple[str, str]], offset: int, limit: int) -> DataFrame:
    """The rows of a page far from the start, unsorted. The sort keys alone are dealt to ranges; the counts of the
    ranges (a number each) say which of them the page lies in, and only those are sorted. The last of
    ``keys`` is unique."""
    order = [sort_key(c, d) for c, d in keys]
    laid = cut(rows.select(*dict.fromkeys(c for c, _ in keys)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = laid.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    chosen, skipped, before = [], offset, 0
    for r in counts:
        if before + r["n"] > offset and before < offset + limit:
            chosen.append(r["_range"])
            skipped = offset - before if len(chosen) == 1 else skipped
        before += r["n"]
    found = laid.filter(F.col("_range").isin(*chosen)).orderBy(*order).offset(skipped).limit(limit)
    wanted = F.broadcast(found.select(F.col(keys[-1][0]).alias("_wanted")))  # as many rows as the page has
    return rows.join(wanted, F.col(keys[-1][0]) == F.col("_wanted"), "left_semi")


def list_rows(spec: ListSpec, db, page: int = 1, limit: int = 20, sort_by: str | None = None,
              sort_order: str = "desc", **arguments) -> Listing:
    """One page and the totals. The page is a distributed top-k over the records alone, or, far from the start,
    found by ranges of the sort key; what is shown beside them is joined to the page. The total is its own count, right
    on every page and free of a window over the whole table."""
    used = _check_arguments(spec, **arguments)
    sort_columns = {sort_by} if sort_by in spec.sortable else {c for c, _ in spec.sort}
    before, after = split_lookups(spec, used | sort_columns)
    records = spec.base(db)
    for lookup in after:
        if lookup.how == "inner":  # a condition on the records; its columns wait for the page
            records = lookup.exists(records, db)
    rows = filter_rows(spec, join_lookups(records, db, before), **arguments)
    order = order_of(spec, sort_by, sort_order)
    offset = (page - 1) * limit
    if offset > DEEP:
        paged = deep_page(rows, sorting(spec, sort_by, sort_order), offset, limit)
        shown = join_lookups(paged, db, after).orderBy(*order)
    else:
        paged = rows.orderBy(*order).offset(offset).limit(limit)
        shown = join_lookups(paged, db, after).orderBy(*order) if after else paged
    totals = rows.agg(F.count(F.lit(1)).alias("total_count")).withColumn(
        "total_pages", F.ceil(F.col("total_count") / limit).cast("bigint"))
    return Listing(shown, totals)
