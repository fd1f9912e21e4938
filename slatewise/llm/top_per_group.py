"""Problem 4: the N best items of every group, in two salted stages.

Each group is hashed into subgroups by the item's identity, so that repeats of
an item meet in one subgroup. There the best row of each item is kept (an
aggregate that combines before the shuffle), items are ranked and N kept; the
survivors, at most N times the number of subgroups, are ranked once more.

Order is total: the given keys, then the id. Defined cases: null keys come
last, NaN counts as null; a null group is a group of its own; rows with equal
identity (null equal to null) count once, by their best row; a group with
fewer than N items gives them all; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.text import known_number


def ascending(c: Column) -> list[Column]:
    """Sort fields for ``c`` ascending, null last."""
    return [c.isNull(), c]


def descending(c: Column) -> list[Column]:
    """Sort fields for a number descending, null and NaN last as equals."""
    known = known_number(c.cast("double"))
    return [known.isNull(), F.lit(0.0) - known]


def top_items(df: DataFrame, group: str, identity: list[Column], order: list[Column], item: str, n: int = 5, subgroups: int = 16) -> DataFrame:
    """``(group, item id, rank)`` of the first ``n`` distinct items of each group."""
    digest = F.unhex(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in identity))))
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col(item).alias("item"))
    rows = df.select(F.col(group).alias("g"), digest.alias("who"), keys.alias("best"))
    salt = F.pmod(F.xxhash64("who"), F.lit(subgroups)).cast("int")
    distinct = rows.groupBy("g", salt.alias("salt"), "who").agg(F.min("best").alias("best"))
    within = Window.partitionBy("g", "salt").orderBy("best")
    kept = distinct.withColumn("r", F.row_number().over(within)).filter(F.col("r") <= n)
    over = Window.partitionBy("g").orderBy("best")
    final = kept.withColumn("r", F.row_number().over(over)).filter(F.col("r") <= n)
    return final.select(F.col("g").alias(group), F.col("best.item").alias(item), F.col("r").alias("item_rank"))
