"""Batch writes: each takes the stored table and a batch of requests and returns the
new rows, with what was refused and why. Nothing is written here."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.session import cut
from tradeframe.sources.schemas import DEFAULTS, schema

#: Open requests for unique values that one task settles in order.
FEW = 200_000


class Changed(NamedTuple):
    table: DataFrame      # the whole table after the change
    rejected: DataFrame   # requests without effect


class Split(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame   # same columns plus ``reason``


class Deleted(NamedTuple):
    kept: DataFrame
    deleted: DataFrame
    rejected: DataFrame


def latest_values(updates: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """Many updates of one key as one: the last value given per column (of two at the
    same time the larger). Partial aggregation makes a much-updated key one row per
    task before the shuffle."""
    return updates.groupBy(F.col(key).alias("_key")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(at, c))).alias(f"_new_{c}") for c in columns],
        F.max(at).alias("_at"),
    )


def upsert_coalesce(target: DataFrame, updates: DataFrame, key: str, columns: list[str], at: str = "updated_at",
                    stamp: str | None = "updated_at") -> Changed:
    """Partial update: a null field keeps the stored value; ``stamp`` takes the time of
    the last update. Updates of unknown keys come back as rejected."""
    combined = latest_values(updates, key, columns, at)
    joined = target.join(combined, F.col(key) == F.col("_key"), "left")
    kept = [c for c in target.columns if c not in columns and c != stamp]
    out = [F.col(c) for c in kept] + [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in columns]
    if stamp is not None:
        old = F.col(stamp) if stamp in target.columns else F.lit(None).cast("timestamp_ntz")
        out.append(F.coalesce(F.col("_at"), old).alias(stamp))
    known = target.select(F.col(key).alias("_known"))
    unknown = updates.join(known, F.col(key) == F.col("_known"), "left_anti")
    return Changed(joined.select(*out), unknown.withColumn("reason", F.lit("not found")))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The message of the first failed check, null when all hold."""
    return F.coalesce(*[F.when(failed, F.lit(text)) for failed, text in checks])


def split_by(df: DataFrame, reason: Column) -> Split:
    marked = df.withColumn("reason", reason)
    return Split(marked.filter("reason is null").drop("reason"), marked.filter("reason is not null"))


def missing(column: str, zero_counts: bool = False) -> Column:
    """Null or empty; with ``zero_counts`` also zero."""
    test = F.col(column).isNull() | (F.col(column).cast("string") == "")
    return test | (F.col(column) == 0) if zero_counts else test


def check_required(df: DataFrame, required: list[str], non_zero: list[str] = ()) -> Split:
    """Rows with all required fields, and the others with the first missing one."""
    checks = [(missing(c, c in non_zero), f"{c} is required") for c in required]
    return split_by(df, first_reason(*checks))


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill absent values with the table's defaults."""
    types = {f.name: f.dataType for f in schema(table).fields}
    for column, value in DEFAULTS.get(table, {}).items():
        default = F.lit(value).cast(types[column])
        df = df.withColumn(column, F.coalesce(F.col(column), default) if column in df.columns else default)
    return df


def _in_order(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of a few rows those that are accepted one by one: no value of theirs is an accepted one's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[set] = [set() for _ in columns]
        for batch in batches:
            accepted = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                ok = not any(v is not None and v in seen for v, seen in zip(values, taken))
                if ok:
                    for v, seen in zip(values, taken):
                        seen.add(v)
                accepted.append(ok)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return rows.coalesce(1).sortWithinPartitions(order).mapInArrow(run, rows.schema)


def check_unique(target: DataFrame, batch: DataFrame, columns: list[str], order: str) -> Split:
    """Accept a row only if none of its unique values is stored already or used by an
    earlier accepted row (``order``, unique). Each column is one anti join; there is no OR join.

    As if the requests came one by one, settled in rounds: of the rows still open, those that
    are first in all their values are accepted, and rows that share a value with them leave.
    A refused row blocks nothing. Every round settles at least the first open row; chains, in which each
    row waits for the one before, would take a round for each, so once at most ``FEW`` rows are open one
    task takes them in order."""
    open_rows = batch.select(order, *columns)
    stored = {c: target.select(F.col(c).alias("_value")).filter("_value is not null").distinct() for c in columns}
    for c in columns:
        open_rows = open_rows.join(stored[c], F.col(c) == F.col("_value"), "left_anti")
    open_rows, rounds = cut(open_rows), []
    while not open_rows.isEmpty():
        marked = open_rows
        for c in columns:
            firsts = open_rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_value")).agg(F.min(order).alias(f"_first_{c}"))
            marked = marked.join(firsts, F.col(c) == F.col("_value"), "left").drop("_value")
        first = reduce(Column.__and__, [F.col(c).isNull() | (F.col(order) == F.col(f"_first_{c}")) for c in columns])
        won = cut(marked.filter(first).select(order, *columns))
        rounds.append(won)
        left = open_rows.join(won.select(F.col(order).alias("_won")), F.col(order) == F.col("_won"), "left_anti")
        for c in columns:
            left = left.join(won.select(F.col(c).alias("_value")).filter("_value is not null").distinct(), F.col(c) == F.col("_value"), "left_anti")
        open_rows = cut(left)
        if 0 < open_rows.count() <= FEW:
            rounds.append(cut(_in_order(open_rows, columns, order)))
            break
    accepted = union_all(rounds) if rounds else open_rows
    marked, checks = batch, []
    for c in columns:
        users = accepted.filter(F.col(c).isNotNull()).select(F.col(c).alias("_value"), F.col(order).alias(f"_user_{c}"))
        marked = marked.join(stored[c].withColumn(f"_taken_{c}", F.lit(True)), F.col(c) == F.col("_value"), "left").drop("_value")
        marked = marked.join(users, F.col(c) == F.col("_value"), "left").drop("_value")
        checks += [(F.col(f"_taken_{c}"), f"{c} exists already"), (F.col(order) > F.col(f"_user_{c}"), f"{c} repeated in the batch")]
    split = split_by(marked, first_reason(*checks))
    helper = [f"_{kind}_{c}" for kind in ("taken", "user") for c in columns]
    return Split(split.accepted.drop(*helper), split.rejected.drop(*helper))


def delete_by_key(target: DataFrame, requests: DataFrame, key: str = "id",
                  actor: str | None = None) -> Deleted:
    """Delete by key. With ``actor`` (a request column) a request for one's own key is
    refused. Unknown keys are reported."""
    asked = requests.withColumn("reason", F.when(F.col(key) == F.col(actor), F.lit("cannot delete own record"))
                                if actor else F.lit(None).cast("string"))
    wanted = asked.filter("reason is null").select(F.col(key).alias("_wanted"))
    known = target.select(F.col(key).alias("_known"))
    unknown = asked.filter("reason is null").join(known, F.col(key) == F.col("_known"), "left_anti").withColumn(
        "reason", F.lit("not found"))
    match = F.col(key) == F.col("_wanted")
    return Deleted(
        target.join(wanted, match, "left_anti"),
        target.join(wanted, match, "left_semi"),
        asked.filter("reason is not null").unionByName(unknown),
    )


def delete_families(families: DataFrame, products: DataFrame, requests: DataFrame) -> Deleted:
    """Delete families; one with products or with child families is refused."""
    used = products.filter("family_id is not null").select(F.col("family_id").alias("_used")).distinct()
    parents = families.filter("parent_id is not null").select(F.col("parent_id").alias("_parent")).distinct()
    known = families.select(F.col("id").alias("_known"))
    marked = (
        requests.join(used, F.col("id") == F.col("_used"), "left")
        .join(parents, F.col("id") == F.col("_parent"), "left")
        .join(known, F.col("id") == F.col("_known"), "left")
    )
    split = split_by(marked, first_reason(
        (F.col("_used").isNotNull(), "family has products"),
        (F.col("_parent").isNotNull(), "family has child families"),
        (F.col("_known").isNull(), "not found"),
    ))
    done = delete_by_key(families, split.accepted.select("id"))
    return Deleted(done.kept, done.deleted, split.rejected.select("id", "reason"))


def _deletions(families: DataFrame, used: DataFrame, requests: DataFrame) -> DataFrame:
    """``_family`` and ``_at``, the request that deletes it, for every family that one does.

    A family goes with its first request after all its children have gone. So it is settled from the leaves up,
    a round for every level of the tree of families that are asked for and have no products; each round
    hands the latest deletion of the children on to the parents. A family that never goes keeps its
    ancestors, and so does a circle of parents."""
    asked = requests.select(F.col("id").alias("_asked"), "request")
    candidates = (families.select("id", "parent_id").distinct()
                  .join(asked.select("_asked").distinct(), F.col("id") == F.col("_asked"), "left_semi")
                  .join(used, F.col("id") == F.col("_used"), "left_anti"))
    names = candidates.select(F.col("id").alias("_candidate"))
    stays = families.join(names, F.col("id") == F.col("_candidate"), "left_anti").select(F.col("parent_id").alias("_above")).filter("_above is not null").distinct()
    order = dict(requests.dtypes)["request"]
    # a family with a child that stays can't go either, nor can what is above it; the others wait for their children
    open_rows = cut(candidates.join(stays, F.col("id") == F.col("_above"), "left").select(
        "id", "parent_id", F.col("_above").isNotNull().alias("_never"), F.lit(None).cast(order).alias("_after")))
    settled = []
    while not open_rows.isEmpty():
        above = open_rows.filter("parent_id is not null").select(F.col("parent_id").alias("_above")).distinct()
        ready = open_rows.join(above, F.col("id") == F.col("_above"), "left_anti")
        late = F.col("_after").isNull() | (F.col("request") > F.col("_after"))
        found = ready.join(asked, (F.col("id") == F.col("_asked")) & late & ~F.col("_never"), "left").groupBy("id", "parent_id").agg(F.min("request").alias("_at"))
        found = cut(found)
        if found.isEmpty():  # only circles are left
            break
        settled.append(found)
        news = found.groupBy(F.col("parent_id").alias("_above")).agg(F.max("_at").alias("_last"), (F.count("_at") < F.count("*")).alias("_stuck"))
        done = found.select(F.col("id").alias("_done"))
        left = open_rows.join(done, F.col("id") == F.col("_done"), "left_anti")
        open_rows = cut(left.join(news, F.col("id") == F.col("_above"), "left").select(
            "id", "parent_id", (F.col("_never") | F.coalesce("_stuck", F.lit(False))).alias("_never"), F.greatest("_after", "_last").alias("_after")))
    if not settled:
        return families.select(F.col("id").alias("_family"), F.lit(None).cast(order).alias("_at")).filter(F.lit(False))
    return union_all(settled).filter("_at is not null").select(F.col("id").alias("_family"), "_at")


def delete_families_in_order(families: DataFrame, products: DataFrame, requests: DataFrame) -> Deleted:
    """Delete families by requests (``request``, unique, and ``id``) that are carried out one after the other: a
    family with products, or with child families at that time, is refused, and a request that frees its
    parent lets a later request for the parent pass. Refused requests come with their reason."""
    used = products.filter("family_id is not null").select(F.col("family_id").alias("_used")).distinct()
    gone = cut(_deletions(families, used, requests))
    known = families.select(F.col("id").alias("_known")).distinct()
    marked = (
        requests.join(used, F.col("id") == F.col("_used"), "left")
        .join(known, F.col("id") == F.col("_known"), "left")
        .join(gone, F.col("id") == F.col("_family"), "left")
    )
    refused = F.when(F.col("_at") == F.col("request"), None).otherwise(first_reason(
        (F.col("_used").isNotNull(), "family has products"),
        (F.col("_known").isNull() | (F.col("_at") < F.col("request")), "not found"),
        (F.lit(True), "family has child families")))
    match = F.col("id") == F.col("_family")
    return Deleted(families.join(gone, match, "left_anti"), families.join(gone, match, "left_semi"),
                   marked.withColumn("reason", refused).filter("reason is not null").select("request", "id", "reason"))


def deactivate(target: DataFrame, requests: DataFrame, at: Column, key: str = "id") -> Changed:
    """Soft delete: ``is_active`` becomes false."""
    updates = requests.select(key).withColumn("is_active", F.lit(False)).withColumn("updated_at", at)
    return upsert_coalesce(target, updates, key, ["is_active"])


def cascade(items: DataFrame, link: str, deleted_headers: DataFrame, key: str = "id") -> Deleted:
    """Items go with their header."""
    gone = deleted_headers.select(F.col(key).alias("_gone"))
    match = F.col(link) == F.col("_gone")
    none = items.filter(F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    return Deleted(items.join(gone, match, "left_anti"), items.join(gone, match, "left_semi"), none)


def set_status(target: DataFrame, requests: DataFrame, column: str = "status", allowed: list[str] | None = None,
               at: str = "updated_at", key: str = "id") -> Changed:
    """Status changes; the last one per key counts. A missing status, or one outside
    ``allowed``, is refused."""
    checks = [(missing(column), f"{column} is required")]
    if allowed is not None:
        checks.append((~F.col(column).isin(*allowed), f"{column} must be one of: {', '.join(allowed)}"))
    split = split_by(requests, first_reason(*checks))
    changed = upsert_coalesce(target, split.accepted, key, [column], at=at)
    return Changed(changed.table, split.rejected.unionByName(changed.rejected))


def row_changes(old: DataFrame, new: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Audit trail between two snapshots: one row per inserted, updated or deleted key
    with the old and new values as JSON."""
    columns = [c for c in old.columns if c in new.columns]
    before = old.select(F.col(key).alias("_old_key"), F.struct(*columns).alias("_old"))
    after = new.select(F.col(key).alias("_new_key"), F.struct(*columns).alias("_new"))
    joined = before.join(after, F.col("_old_key") == F.col("_new_key"), "full_outer")
    action = (
        F.when(F.col("_old_key").isNull(), "INSERT").when(F.col("_new_key").isNull(), "DELETE")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE")
    )
    changed = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns]
    return joined.withColumn("action", action).filter("action is not null").select(
        "action",
        F.lit(table).alias("table_name"),
        F.coalesce("_old_key", "_new_key").alias("record_id"),
        F.when(F.col("action") == "UPDATE", F.concat_ws(",", *changed)).alias("changed_columns"),
        F.to_json("_old").alias("old_values"),
        F.to_json("_new").alias("new_values"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
