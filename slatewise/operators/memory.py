"""Context libraries and memories: A1 to A8, A31, A32, J11, Q7, W10.

A context is a pair of label cells; its support is its share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.labels import label_tokens
from slatewise.functions.text import known_number


def group_memory(df: DataFrame, keys: list[str], yield_: str, temperature: str) -> DataFrame:
    """A1 to A3: count, mean yield, mean and population deviation of temperature; missing numbers left out."""
    y, t = known_number(F.col(yield_)), known_number(F.col(temperature))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean_yield"), F.avg(t).alias("mean_temperature"), F.stddev_pop(t).alias("sd_temperature"))


def context_library(df: DataFrame, context: list[str], yield_: str) -> DataFrame:
    """Count, support and mean yield (0 where none) of each context."""
    rows = df.groupBy(*context).agg(F.count("*").alias("context_count"), F.coalesce(F.avg(known_number(F.col(yield_))), F.lit(0.0)).alias("mean_yield"))
    # contexts are few against rows: the one total is made from the aggregate
    total = rows.agg(F.sum("context_count").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("support", F.col("context_count") / F.col("total")).drop("total")


def most_frequent(library: DataFrame, context: list[str], k: int) -> DataFrame:
    """The first k contexts by count, then text."""
    return library.orderBy(F.col("context_count").desc(), *context).limit(k)


def leave_one_out(df: DataFrame, group: str | list[str], context: list[str], yield_: str | None = None) -> DataFrame:
    """Per group (a canonical reaction) and context it holds, the count, support and mean yield without the group's own rows.

    Contexts that nobody else holds vanish; a mean yield of no yields is 0; ``remaining`` is the
    number of other rows, at least 1. Without ``yield_`` no yield is known. Only contexts that a group itself holds change; for the others the
    library's count stands over ``remaining``. Null groups are groups.
    """
    group = [group] if isinstance(group, str) else group
    y = known_number(F.col(yield_)) if yield_ else F.lit(None).cast("double")
    own = df.groupBy(*group, *context).agg(F.count("*").alias("own"), F.sum(y).alias("own_sum"), F.count(y).alias("own_yields"))
    per_context = own.groupBy(*context).agg(F.sum("own").alias("all"), F.sum("own_sum").alias("all_sum"), F.sum("own_yields").alias("all_yields"))
    per_group = own.groupBy(*group).agg(F.sum("own").alias("group_rows"))
    total = per_group.agg(F.sum("group_rows").alias("total"))
    joined = _joined(_joined(own, per_context, context), per_group, group).crossJoin(F.broadcast(total))
    count, yields = F.col("all") - F.col("own"), F.col("all_yields") - F.col("own_yields")
    rest = F.coalesce("all_sum", F.lit(0.0)) - F.coalesce("own_sum", F.lit(0.0))
    left = joined.filter(count > 0).withColumn("remaining", F.greatest(F.col("total") - F.col("group_rows"), F.lit(1)))
    return left.select(
        *group, *context, count.alias("context_count"), (count / F.col("remaining")).alias("support"), F.when(yields > 0, rest / yields).otherwise(0.0).alias("mean_yield"), "remaining"
    )


def without_own_group(neighbors: DataFrame, groups: DataFrame, query: str, neighbor: str, key: str, group: str) -> DataFrame:
    """Neighbors that are not of the query's own group; ``groups`` gives the ``group`` of each ``key``."""
    of = {c: groups.select(F.col(key).alias(c), F.col(group).alias(f"_{c}")) for c in (query, neighbor)}
    joined = neighbors.join(of[query], query).join(of[neighbor], neighbor)
    return joined.filter(~F.col(f"_{query}").eqNullSafe(F.col(f"_{neighbor}"))).select(*neighbors.columns)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    return left.join(renamed, on).drop(*(f"_by_{k}" for k in keys))


def token_frequency(df: DataFrame, cell: str) -> DataFrame:
    """Count of each label."""
    found = df.select(F.explode(label_tokens(F.col(cell))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(frequency: DataFrame) -> DataFrame:
    """Dense index from 0 by falling count. One task orders the vocabulary, which is small against the rows."""
    return frequency.withColumn("token_index", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) - 1)


def union_per_group(df: DataFrame, group: str, cell: str) -> DataFrame:
    """Sorted union of a group's labels."""
    each = df.select(group, F.explode(label_tokens(F.col(cell))).alias("token")).distinct()
    return each.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("token")), "; ").alias("tokens"))


def ordered_union(df: DataFrame, group: str, cell: str, ordinal: str) -> DataFrame:
    """A group's tokens in the order they are first seen."""
    each = df.select(group, ordinal, F.posexplode(label_tokens(F.col(cell))).alias("pos", "token"))
    first = each.groupBy(group, "token").agg(F.min(F.struct(ordinal, "pos")).alias("at"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "token")))
    return first.groupBy(group).agg(F.array_join(F.transform(in_order, lambda x: x["token"]), "; ").alias("tokens"))


def neighbor_contexts(neighbors: DataFrame, rows: DataFrame, query: str, neighbor: str, similarity: str, context: list[str], yield_: str) -> DataFrame:
    """Contexts of a query's neighbors: sum and maximum of similarity, number of rows, yield weighted by similarity."""
    y = known_number(F.col(yield_))
    s = F.col(similarity)
    weight = F.sum(F.when(y.isNotNull(), s))
    return (
        neighbors.join(rows, neighbor)
        .groupBy(query, *context)
        .agg(F.sum(s).alias("similarity_sum"), F.max(s).alias("similarity_max"), F.count("*").alias("neighbor_count"), F.coalesce(F.sum(s * y) / F.nullif(weight, F.lit(0.0)), F.lit(0.0)).alias("weighted_yield"))
    )


def neighbor_precedents(neighbors: DataFrame, memory: DataFrame, query: str, neighbor: str, similarity: str, context: list[str]) -> DataFrame:
    """Precedents of a query's neighbors by context; ``memory`` (see ``group_memory``) has one row per neighbor and context.

    Support, yield and temperature are weighted by similarity times the number of rows; a mean without
    any known value is null. Neighbors without similarity are left out.
    """
    s = F.col(similarity)
    weight = s * F.col("n")

    def mean(c: str) -> Column:
        known = known_number(F.col(c))
        return F.sum(weight * known) / F.nullif(F.sum(F.when(known.isNotNull(), weight)), F.lit(0.0))

    return (
        neighbors.filter(s > 0)
        .join(memory, neighbor)
        .groupBy(query, *context)
        .agg(
            F.sum(s).alias("similarity_sum"), F.sum(weight).alias("weighted_support"), F.max(s).alias("similarity_max"), F.count("*").alias("neighbor_count"),
            mean("mean_yield").alias("mean_yield"), mean("mean_temperature").alias("mean_temperature"),
        )
    )


def with_fallback(queries: DataFrame, found: DataFrame, fallback: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Q7: rows found, and for queries without any the (few) fallback rows."""
    lost = queries.select(key).join(found.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(fallback.select(*columns)))
    return found.select(key, *columns, F.lit(False).alias("is_fallback")).unionByName(lost.select(key, *columns, F.lit(True).alias("is_fallback")))


def cluster_contexts(df: DataFrame, cluster: str, context: list[str], temperature: str | None = None) -> DataFrame:
    """Count and support of each context within its cluster or family, and its mean temperature (null where none is known)."""
    mean = [F.avg(known_number(F.col(temperature))).alias("mean_temperature")] if temperature else []
    rows = df.groupBy(cluster, *context).agg(F.count("*").alias("n"), *mean)
    return rows.withColumn("support", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))


def overlap_support(rows: DataFrame, candidates: DataFrame, row_id: str, candidate_id: str, cell: str) -> DataFrame:
    """Rows whose tokens meet a candidate's tokens, as a share of all rows; by an equality join on tokens."""
    left = rows.select(row_id, F.explode(F.array_distinct(label_tokens(F.col(cell)))).alias("token"))
    right = candidates.select(candidate_id, F.explode(F.array_distinct(label_tokens(F.col(cell)))).alias("token"))
    met = left.join(right, "token").select(row_id, candidate_id).distinct().groupBy(candidate_id).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return candidates.select(candidate_id).join(met, candidate_id, "left").crossJoin(F.broadcast(total)).select(candidate_id, (F.coalesce("n", F.lit(0)) / F.col("total")).alias("support"))


def mean_prior(df: DataFrame, key: str, cell: str, weights: DataFrame, unknown: float = 0.0) -> DataFrame:
    """Mean weight of a row's distinct labels; unknown ones count as ``unknown``; no labels give 0."""
    each = df.select(key, F.explode_outer(F.array_distinct(label_tokens(F.col(cell)))).alias("token"))
    value = F.when(F.col("token").isNotNull(), F.coalesce(F.col("weight"), F.lit(unknown)))
    return each.join(weights, "token", "left").groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("score"))


def normalized_context(df: DataFrame, normal, *cells: str) -> DataFrame:
    """F1 applied to label cells in place."""
    return df.withColumns({c: normal(F.col(c)) for c in cells})
