"""Running sums and positions in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.shared import written


def running(df: DataFrame, part: list[str], ordinal: list[str], value: Column, before: str, total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over earlier rows of its group (and over the whole group).

    Rows are range-partitioned by (group, ordinal) and written; each range sums
    up alone, the ranges' totals (as many as there are partitions and groups) are accumulated,
    and no task ever holds more than one range. Null groups are groups.
    """
    ranged = df.withColumn("_running_v", value).repartitionByRange(*part, *ordinal).withColumn("_running_range", F.spark_partition_id())
    held = written(ranged, "ranges")
    sums = held.groupBy(*part, "_running_range").agg(F.sum("_running_v").alias("_running_sum"))
    across = Window.partitionBy(*part)
    sums = sums.withColumn("_running_base", F.sum("_running_sum").over(across.orderBy("_running_range")) - F.col("_running_sum")).withColumn("_running_all", F.sum("_running_sum").over(across)).drop("_running_sum")
    sums = sums.withColumnsRenamed({p: f"_running_by_{p}" for p in part})
    own = F.sum("_running_v").over(Window.partitionBy(*part, "_running_range").orderBy(*ordinal).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_running_v")
    on = [held["_running_range"] == sums["_running_range"], *(F.col(p).eqNullSafe(F.col(f"_running_by_{p}")) for p in part)]
    # ranges times the groups that meet in one: the optimiser broadcasts it only below its own size limit
    joined = held.withColumn("_running_own", own).join(sums, on).withColumn(before, F.col("_running_base") + F.col("_running_own"))
    if total:
        joined = joined.withColumn(total, F.col("_running_all"))
    return joined.select(*df.columns, before, *([total] if total else []))
