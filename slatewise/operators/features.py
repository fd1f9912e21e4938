"""Feature tables: P1 to P8, P12, J1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_mapped(df: DataFrame, column: str, name: str, provider: Callable[[Column], Column]) -> DataFrame:
    """A costly function applied once per distinct value and joined back."""
    each = df.select(F.col(column).alias("_distinct")).distinct().withColumn(name, provider(F.col("_distinct")))
    return df.join(each, F.col(column).eqNullSafe(F.col("_distinct")), "left").drop("_distinct")


def filled(known: Column, computed: Column) -> Column:
    """The known value, computed only where that is empty."""
    return F.when(F.coalesce(F.trim(known), F.lit("")) == "", computed).otherwise(known)


def text(name: str) -> Column:
    """Text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def zero_support(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of zeros where absent."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def feature_columns(df: DataFrame, keys: list[str], allowed: list[str], forbidden: tuple[str, ...] = ("label", "label_type", "rank_relevance", "temperature_gold", "yield_gold")) -> DataFrame:
    """Keys and allowed features only; absent, null and NaN features are 0; targets may not be features."""
    if leak := {*allowed} & {*forbidden}:
        raise ValueError(f"targets among the features: {sorted(leak)}")
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.select(*keys, *(value(c).alias(c) for c in allowed))


def with_embedding(df: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Embedding columns by key, 0 where there are none."""
    columns = [c for c in embeddings.columns if c not in keys]
    return df.join(embeddings, keys, "left").fillna(0.0, columns)


def flattened(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """The fields of a struct as columns."""
    return df.select(*keys, f"{record}.*")


def descriptor_columns(df: DataFrame, keys: list[str], vector: str, names: list[str]) -> DataFrame:
    """P5: the first elements of a vector as columns; an absent element is 0."""
    return df.select(*keys, *(F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0)).alias(n) for i, n in enumerate(names)))


def reaction_key(df: DataFrame, key: str, reactants: str, product: str, molecules: DataFrame) -> DataFrame:
    """F8: ``(key, side_key, reaction_key)`` from a supplied table ``(raw, canonical)``: the canonical components of the
    reactants in text order, and the same with the product behind ``>>``. A side with an unknown component has the empty key, as has its reaction."""
    sides = df.select(key, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(reactants).alias("x")), F.struct(F.lit("b").alias("side"), F.col(product).alias("x")))).alias("s"))
    each = sides.select(key, "s.side", F.explode(F.split(F.coalesce("s.x", F.lit("")), "[.]")).alias("raw"))
    known = each.join(molecules.select("raw", "canonical").distinct(), "raw", "left")
    good = F.min(F.coalesce(F.col("canonical"), F.lit("")) != "")
    side = known.groupBy(key, "side").agg(F.when(good, F.array_join(F.array_sort(F.collect_list("canonical")), ".")).otherwise("").alias("k"))
    per = side.groupBy(key).agg(*(F.max(F.when(F.col("side") == n, F.col("k"))).alias(n) for n in "ab"))
    return per.select(key, F.col("a").alias("side_key"), F.when((F.col("a") != "") & (F.col("b") != ""), F.concat_ws(">>", "a", "b")).otherwise("").alias("reaction_key"))
