"""Audits: U1 to U4, U6, V3 to V8, V11, J2, J4, J20, A35, F44."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_counts(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Size of each set of keys and of each pair's intersection, in one pass over all keys; nulls are no keys."""
    names = sorted(sets)
    every = reduce(DataFrame.unionByName, (sets[n].select(F.col(key).alias("key")).withColumn("name", F.lit(n)) for n in names))
    per = every.filter("key IS NOT NULL").groupBy("key").agg(*(F.max((F.col("name") == n).cast("int")).alias(n) for n in names))
    sums = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias("n")) for i, a in enumerate(names) for b in names[i:]]
    return per.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, counted as a multiset, that only one side has."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def identity_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and an order-free fingerprint of a multiset of rows: the sum of 64-bit parts of row digests."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def same_identities(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number differs between the sides, or that are repeated; empty when aligned."""
    n = a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys, "full_outer")
    return n.fillna(0, ["n_a", "n_b"]).filter("n_a <> n_b OR n_a > 1")


def checked_lookup(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails in the job itself if a right key is repeated."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in right.columns if c not in keys))
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the right side is repeated")).cast("int"))
    guarded = one.withColumn("_n", F.coalesce(guard, F.lit(1))).filter("_n = 1").drop("_n")
    return df.join(guarded, keys, "left")


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], relative: float = 0.0, absolute: float = 0.0) -> DataFrame:
    """V5, V8: per column the rows that differ (NaN equals NaN, null equals null) and the largest gap."""
    both = a.alias("a").join(b.alias("b"), keys)
    out = []
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        gap = F.abs(x - y)
        close = x.eqNullSafe(y) | F.coalesce(gap <= absolute + relative * F.abs(y), F.lit(False))
        out.append(F.struct(F.lit(c).alias("column_name"), F.sum((~close).cast("int")).cast("bigint").alias("differing"), F.max(F.nanvl(gap.cast("double"), F.lit(None).cast("double"))).alias("max_gap")))
    return both.agg(F.array(*out).alias("x")).select(F.inline("x"))


def held_out_overlap(rows: DataFrame, owners: DataFrame, identity: Column, owner_identity: Column, owner: str) -> DataFrame:
    """V4: rows per owner whose hashed identity stands among the held-out ones."""
    a = rows.select(F.sha2(identity, 256).alias("h"))
    b = owners.select(F.sha2(owner_identity, 256).alias("h"), F.col(owner)).distinct()
    return a.join(b, "h").groupBy(owner).agg(F.count("*").alias("n"))


def guarded(candidate: Column, original: Column, same: Column) -> Column:
    """V3: the candidate where it keeps the identity, else the original."""
    return F.when(F.coalesce(same, F.lit(False)), candidate).otherwise(original)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """V7: number of rows that break each rule; null breaks it."""
    each = [F.struct(F.lit(n).alias("rule"), F.sum((~F.coalesce(c, F.lit(False))).cast("int")).cast("bigint").alias("n")) for n, c in rules.items()]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


def first_cases(df: DataFrame, predicates: dict[str, Column], ordinal: list[str], columns: list[str]) -> DataFrame:
    """The first row for each predicate, in one pass."""
    order = F.struct(*ordinal)
    each = [F.struct(F.lit(n).alias("slot"), F.min_by(F.struct(*columns), F.when(p, order)).alias("row")) for n, p in predicates.items()]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x")).filter("row IS NOT NULL").select("slot", "row.*")
