"""The product family tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.session import cut


def _lifted(rows: DataFrame) -> DataFrame:
    """For ``id``, ``parent_id`` and ``path`` (the node's own part): how far up the rows a node's ancestors go.
    ``top`` is the highest of them, ``above`` its parent (null at a root, else not among the rows), ``depth`` the
    number of nodes from ``top`` to the node, ``path`` their parts.

    Every round doubles the stretch that each node knows, by joining what its ``above`` knows: a tree of depth
    d takes log2(d) rounds. Nodes on or below a circle of parents are left out."""
    known = cut(rows.select("id", F.col("id").alias("top"), F.col("parent_id").alias("above"), F.lit(1).alias("depth"), "path",
                            F.col("parent_id").isNotNull().alias("_open")))
    rounds = max(known.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if known.filter("_open").isEmpty():
            break
        upper = known.select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("above").alias("_above"), F.col("depth").alias("_depth"),
                             F.col("path").alias("_path"), F.col("_open").alias("_more"))
        found = F.col("_id").isNotNull()
        grown = known.filter("_open").join(upper, F.col("above") == F.col("_id"), "left").select(
            "id", F.coalesce("_top", "top").alias("top"), F.when(found, F.col("_above")).otherwise(F.col("above")).alias("above"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.concat_ws("/", "_path", "path").alias("path"),
            F.coalesce("_more", F.lit(False)).alias("_open"))
        known = cut(known.filter("not _open").unionByName(grown))
    return known.filter("not _open").drop("_open")


def _reachable(families: DataFrame) -> DataFrame:
    """Active families below a root, all columns, with ``root_id``, ``depth`` and ``sort_path``."""
    active = families.filter("is_active")
    lifted = _lifted(active.select("id", "parent_id", F.col("code").alias("path"))).filter("above is null").select(
        F.col("id").alias("_id"), F.col("top").alias("root_id"), "depth", F.col("path").alias("sort_path"))
    return active.join(lifted, F.col("id") == F.col("_id")).drop("_id")


def reachable_families(families: DataFrame) -> DataFrame:
    """The tree of active families, flat: ``root_id``, ``depth`` and ``sort_path`` per
    node. A node below an inactive or missing parent is left out with its subtree."""
    return _reachable(families).select("id", "code", "name", "parent_id", "root_id", "depth", "sort_path")


def nested_tree(families: DataFrame) -> DataFrame:
    """Root rows with ``children`` nested as deep as the tree is, ordered by code; every node has
    all columns of ``families``. Built from the lowest level up; each step joins the children
    of the next level onto their parents. The type follows from the depth."""
    columns, below = families.columns, None
    flat = cut(_reachable(families))
    for depth in range(flat.agg(F.max("depth")).first()[0] or 1, 0, -1):
        here = flat.filter(F.col("depth") == depth).select(*columns)
        if below is not None:
            fields = [c for c in below.columns if c != "code"]
            grouped = below.groupBy(F.col("parent_id").alias("_parent")).agg(
                F.sort_array(F.collect_list(F.struct("code", *fields))).alias("children"))
            empty = F.array().cast(grouped.schema["children"].dataType)
            here = here.join(grouped, F.col("id") == F.col("_parent"), "left").drop("_parent").withColumn(
                "children", F.coalesce("children", empty))
        below = here
    return below


def place_families(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level and path for a batch of new families: (placed, rejected).

    A root has level 1 and path ``/code``; a child is one level below its parent and
    its path is the parent's path plus ``/code``. The parent may be stored already or
    be part of the batch. Rows whose parent is neither are rejected, and so are the
    rows that hang below a rejected one, or in a circle."""
    batch = new.select("id", "code", "name", "parent_id")
    lifted = _lifted(batch.select("id", "parent_id", F.col("code").alias("path"))).withColumnRenamed("id", "_id").withColumnRenamed("path", "_part")
    stored = existing.select(F.col("id").alias("_stored"), F.col("level").alias("_level"), F.col("path").alias("_path"))
    placed = batch.join(lifted, F.col("id") == F.col("_id")).join(stored, F.col("above") == F.col("_stored"), "left").filter(
        "above is null or _stored is not null").select(
        "id", "code", "name", "parent_id", (F.coalesce("_level", F.lit(0)) + F.col("depth")).cast("int").alias("level"),
        F.when(F.col("above").isNull(), F.concat(F.lit("/"), "_part")).otherwise(F.concat("_path", F.lit("/"), "_part")).alias("path"))
    done = placed.select(F.col("id").alias("_done"))
    rejected = batch.join(done, F.col("id") == F.col("_done"), "left_anti").withColumn(
        "reason", F.lit("parent family not found"))
    return placed, rejected


def families_with_counts(families: DataFrame, products: DataFrame, active_only: bool = True) -> DataFrame:
    """Families with parent name and product count. Products are counted per family
    before the join, so nothing fans out."""
    counts = products.groupBy(F.col("family_id").alias("_family")).agg(F.count(F.lit(1)).alias("_count"))
    parents = families.select(F.col("id").alias("_parent"), F.col("name").alias("parent_name"))
    rows = families.filter("is_active") if active_only else families
    return (
        rows.join(parents, F.col("parent_id") == F.col("_parent"), "left")
        .join(counts, F.col("id") == F.col("_family"), "left")
        .withColumn("product_count", F.coalesce("_count", F.lit(0).cast("bigint")))
        .drop("_parent", "_family", "_count")
    )
