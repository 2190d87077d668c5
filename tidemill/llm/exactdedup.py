"""Exact deduplication with DataFrame functions only.

Rows are counted by a 128-bit content hash first.  Only texts whose hash occurs twice or more are
compared: they are grouped by the text itself, so two different texts under one hash show up as two
groups, and such hashes are split by their texts.  A group of copies is combined before each shuffle,
however large it is, and texts that occur once mostly never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fold_ascii, materialize


def content_hash(text: Column) -> list[Column]:
    """128 bits as two longs; the second half starts from another seed."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second half"), text)]


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = fold_ascii,
    hashes: Callable[[Column], list[Column]] = content_hash,
) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` says whether the smallest or largest id of equal texts stays.  Null text counts
    as empty text.  Null ids never stay while the group has another id; when all ids of a
    group are null, its rows stay.  Rows that repeat an id share its decision, and each of
    them counts in ``group_size``.  Other columns of ``docs`` are not read.
    """
    best = {"min": F.min, "max": F.max}[keep]
    base = docs.select(F.col(id_col).alias("_id"), normalise(F.col(text_col)).alias("_text"))
    first, second = hashes(F.col("_text"))
    keyed = base.withColumns({"_h1": first, "_h2": second})
    keys = ["_h1", "_h2"]
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), best("_id").alias("_keep")).where("_size > 1")
    groups = materialize(groups, "exact-groups")
    # bytes decide: the different texts of each hash, copies combined before they move
    split = _marked(keyed, groups).select(*keys, "_text").distinct()
    mixed = materialize(split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select(*keys), "exact-mixed")
    joined = keyed.select("_id", *keys, F.sha2(F.col("_text"), 256).alias("text_sha256")).join(groups, keys, "left")
    if mixed.isEmpty():
        found = joined
    else:
        apart = materialize(keyed.join(mixed, keys, "left_semi"), "exact-collisions")
        sizes = apart.groupBy(*keys, "_text").agg(F.count(F.lit(1)).alias("_size"), best("_id").alias("_keep"))
        apart = apart.join(sizes, [*keys, "_text"]).withColumn("text_sha256", F.sha2(F.col("_text"), 256))
        found = joined.join(mixed, keys, "left_anti").unionByName(apart.select(joined.columns))
    alone = F.col("_size").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


#: Bitmaps of 32,768 bits each that mark hashes; 4 KB each, so 16 MB in all whatever the input.
BITMAPS = 1 << 12


def _marked(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose hash may be one of ``groups``, found before anything is shuffled.

    The groups' hashes mark bits of a fixed number of bitmaps, which go to all tasks.  Rows that
    share a bit with another hash pass too, so with very many groups more rows pass, and none is lost.
    """
    place = lambda h: F.pmod(h, F.lit(BITMAPS << 15))
    number, bit = F.floor(place(F.col("_h1")) / (1 << 15)).cast("int"), (place(F.col("_h1")) % (1 << 15)).cast("int")
    maps = groups.select(number.alias("_map"), bit.alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = keyed.withColumn("_map", number).join(F.broadcast(maps), "_map")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(_h1, 8) AS int))")) != 0).select(keyed.columns)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with all its columns, without the rows that :func:`exact_duplicates` drops.

    Rows without an id can't be told apart and stay.
    """
    gone = exact_duplicates(docs, id_col, text_col, keep).where(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
