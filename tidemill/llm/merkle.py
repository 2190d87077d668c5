"""A Merkle manifest of a dataset: one root for all rows, a subroot for each group, a proof for each row.

A row's leaf is the SHA-256 of its encoded columns.  Leaves of a group stand in order of their
id; every ``fanout`` consecutive ones become their parent, the SHA-256 of their digests, until
one node remains, the group's subroot.  Subroots in order of the group become the root in the
same way.  A level is one window: partitioned by group and parent index, its ordered
full-frame list is both the parent's preimage and a child's siblings.  The parents, one row of each
window, are the next level, a third as large, so all levels together cost half as much again as
the first.

Positions come from range partitions and the sizes of groups in them, so a group of any size is
numbered in parallel.  Paths come from the top down: each level joins its parents' paths,
which are joined once for each parent and never walked leaf by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize

FANOUT = 3
#: The group that the subroots stand in.
_TOP = "top"


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """The SHA-256, as lowercase hex, of the encoded columns."""
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (_group, _order, _digest and more) staged with _pos, the place in the group from 0, and _size, the group's rows.

    The place is that by _order, then _digest.
    """
    keys = ["_group", "_order", "_digest"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}), name)
    runs = held.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row for each group and partition: a group has as many as its size in partitions
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy("_group"))})
    placed = held.join(starts, ["_group", "_part"]).withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))
    out = materialize(placed.drop("_part", "_at", "_n", "_first", "_before"), name)
    discard(held)
    return out


def levels(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels over ``nodes`` (_group, _pos, _size, _digest), and the top node of each group: _group, _height, _digest.

    Level k has _group, _pos, _parent, _before and _after (the digests of the siblings, joined)
    and _above, the parent's digest; level 0 also the other columns of ``nodes``.
    """
    run = Window.partitionBy("_group", "_parent").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("_pos") % fanout).cast("int")
    most = nodes.agg(F.max("_size")).first()[0] or 0
    found, tops, height = [], [], 0
    while True:
        tops.append(nodes.where("_size = 1").select("_group", F.lit(height).alias("_height"), "_digest"))
        if most <= 1:
            break
        children = nodes.where("_size > 1").withColumn("_parent", F.floor(F.col("_pos") / fanout).cast("long"))
        with_run = children.withColumn("_run", F.collect_list("_digest").over(run))
        level = with_run.withColumns(
            {
                "_before": F.array_join(F.slice("_run", 1, at), ""),
                "_after": F.array_join(F.slice("_run", at + 2, fanout), ""),
                "_above": F.sha2(F.array_join("_run", ""), 256),
            }
        )
        level = materialize(level.drop("_run"), f"{name}-{height}")
        found.append(level)
        size = F.ceil(F.col("_size") / fanout).cast("long").alias("_size")
        # the first child of each run stands for the parent
        nodes = level.where(at == 0).select("_group", F.col("_parent").alias("_pos"), size, F.col("_above").alias("_digest"))
        most = -(-most // fanout)
        height += 1
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return found, roots


def _paths(found: list[DataFrame], roots: DataFrame) -> DataFrame:
    """_group, _pos, _path, _root of all nodes of the lowest level; ``roots`` has _group, _height, _path, _root of the top nodes."""
    held = None
    for height in range(len(found), -1, -1):
        own = roots.where(F.col("_height") == height).select("_group", F.lit(0).cast("long").alias("_pos"), "_path", "_root")
        if height < len(found):
            above = held.select("_group", F.col("_pos").alias("_parent"), F.col("_path").alias("_rest"), "_root")
            path = F.concat(F.array(F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))), F.col("_rest")).alias("_path")
            joined = found[height].select("_group", "_pos", "_parent", "_before", "_after").join(above, ["_group", "_parent"]).select("_group", "_pos", path, "_root")
            own = joined.unionByName(own)
        held = own
    return held


def siblings(path: Column) -> Column:
    """The digests of all siblings on the way to the root, joined: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    fanout: int = FANOUT,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """For each row its id, ``leaf``, ``subroot``, ``root`` and ``path``, and what ``also`` computes of the row.

    A path is an array of (before, after), the siblings' digests on either side at each level
    from the leaf to the root, for :func:`fold` and :func:`siblings`.  Leaves of a group go by
    id, null first; rows of the same id by their digests.  The null group comes first, the others by their
    bytes.  Repeated rows are leaves each.  An empty table gives an empty manifest.
    """
    also = also or {}
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    made = {f"_also_{k}": v for k, v in also.items()}
    rows = docs.select(group.alias("_group"), F.col(id_col).alias("_order"), leaf_digest([F.col(c) for c in columns]).alias("_digest"), *(v.alias(k) for k, v in made.items()))
    # digests take the place of texts before anything is sorted
    rows = materialize(rows, "merkle-leaves")
    leaves = numbered(rows, "merkle-numbered")
    discard(rows)
    found, tops = levels(leaves, fanout, "merkle-level")
    tops = materialize(tops, "merkle-subroots")
    groups = numbered(tops.select(F.lit(_TOP).alias("_group"), F.col("_group").alias("_order"), "_digest", "_height"), "merkle-groups")
    upper, root = levels(groups, fanout, "merkle-top")
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    root = root.select("_group", "_height", nothing.alias("_path"), F.col("_digest").alias("_root"))
    top = _paths(upper, root)
    above = groups.select("_pos", F.col("_order").alias("_name"), F.col("_digest").alias("_subroot"), F.col("_height").alias("_up")).join(top.select("_pos", "_path", "_root"), "_pos")
    ends = above.select(F.col("_name").alias("_group"), F.col("_up").alias("_height"), "_path", F.struct(F.col("_subroot").alias("subroot"), F.col("_root").alias("root")).alias("_root"))
    paths = _paths(found, materialize(ends, "merkle-ends"))
    out = leaves.join(paths, ["_group", "_pos"])
    return out.select(F.col("_order").alias(id_col), F.col("_digest").alias("leaf"), "_root.subroot", "_root.root", F.col("_path").alias("path"), *(F.col(f"_also_{k}").alias(k) for k in also))
