"""Joins and groupings that stay even when one key holds a third of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_counted(left: DataFrame, right: DataFrame, key: str, count: str, share: float = 1 / 64, total: float | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``key`` is unique and whose
    ``count`` says how many rows of ``left`` hold that key.

    Keys with at least ``share`` of all counted rows are at most ``1 / share``
    many, so those rows of ``right`` are broadcast whatever the data's size.
    Rows of ``left`` with such a key get a hash of the row as key for the shuffled join and
    are thus spread evenly. ``right`` should be a written table: it is read
    three times. Columns of ``right`` other than key and count are added.
    """
    extra = [c for c in right.columns if c not in (key, count)]
    tag = uuid.uuid4().hex[:8]
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    value = F.struct(*extra)
    hot = right.filter(F.col(count) >= F.lit(total * share)).select(F.col(key).alias(f"_hk{tag}"), value.alias(f"_hv{tag}"))
    rest = right.filter(F.col(count) < F.lit(total * share)).select(F.col(key).alias(f"_rk{tag}"), value.alias(f"_rv{tag}"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col(f"_hk{tag}"), "left")
    spread = F.when(F.col(f"_hk{tag}").isNull(), F.col(key)).otherwise(_spread(left, key))
    marked = marked.withColumn(f"_jk{tag}", spread)
    joined = marked.join(rest, F.col(f"_jk{tag}") == F.col(f"_rk{tag}"), "left")
    joined = joined.withColumn(f"_v{tag}", F.coalesce(F.col(f"_hv{tag}"), F.col(f"_rv{tag}"))).filter(F.col(f"_v{tag}").isNotNull())
    return joined.select(*left.columns, *(F.col(f"_v{tag}.{c}").alias(c) for c in extra))


def join_spread(left: DataFrame, right: DataFrame, key: str, share: float = 1 / 64, salts: int = 64) -> DataFrame:
    """Inner join on ``key`` where one key may hold a third of ``left``, and ``right`` may repeat keys.

    Keys with at least ``share`` of the rows of ``left`` are at most ``1 / share`` many and
    are broadcast; their rows of ``left`` go to ``salts`` places by a hash of the row, and those of
    ``right`` to each of them. ``left`` is read twice and should be a written table. Columns of both, ``key`` once.
    """
    tag = uuid.uuid4().hex[:8]
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    least = left.agg(F.greatest(F.count("*") * share, F.lit(1000.0)).alias("least")).scalar()
    heavy = F.broadcast(counts.filter(F.col("n") >= least).select(F.col(key).alias(f"_k{tag}")))

    def marked(df: DataFrame, salt) -> DataFrame:
        return df.join(heavy, F.col(key) == F.col(f"_k{tag}"), "left").withColumn(f"_s{tag}", salt).drop(f"_k{tag}")

    is_heavy = F.col(f"_k{tag}").isNotNull()
    spread = marked(left, F.when(is_heavy, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0))
    copied = marked(right, F.explode(F.sequence(F.lit(0), F.when(is_heavy, salts - 1).otherwise(0))))
    return spread.join(copied, [key, f"_s{tag}"]).drop(f"_s{tag}")


def _spread(left: DataFrame, key: str):
    # a value that no table holds, the same whenever a lost task is run again
    noise = F.concat(F.lit("\x00spread\x00"), F.xxhash64(*left.columns).cast("string"))
    kind = left.schema[key].dataType.simpleString()
    if kind == "binary":
        return F.encode(noise, "utf-8")
    if kind == "string":
        return noise
    raise TypeError(f"keys are binary or text, not {kind}")
