"""Cleaning and splits: F10 to F20, F23, A9, A10, U5, T7 to T9, J18, J19."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.labels import label_tokens
from slatewise.plans.running import running


def without_footer(df: DataFrame, column: str, marks: list[str]) -> DataFrame:
    """rows whose text holds none of the marks; null stays."""
    held = F.lit(False)
    for m in marks:
        held = held | F.col(column).contains(m)
    return df.filter(~F.coalesce(held, F.lit(False)))


def within_complexity(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """rows with at most so many tokens in each cell."""
    for cell, most in limits.items():
        df = df.filter(F.size(label_tokens(F.col(cell))) <= most)
    return df


def without_rare_labels(df: DataFrame, row_id: str, cells: list[str], least: int, family: str | None = None) -> DataFrame:
    """rows without any token seen fewer than ``least`` times, per cell, over all or within a family."""
    scope = [family] if family else []
    each = df.select(row_id, *scope, F.explode(F.array(*(F.struct(F.lit(c).alias("cell"), label_tokens(F.col(c)).alias("ts")) for c in cells))).alias("x"))
    each = each.select(row_id, *scope, "x.cell", F.explode("x.ts").alias("token"))
    rare = each.groupBy(*scope, "cell", "token").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    bad = each.join(rare, [*scope, "cell", "token"], "left_semi").select(row_id).distinct()
    return df.join(bad, row_id, "left_anti")


def token_roles(df: DataFrame, reagent: str, solvent: str) -> DataFrame:
    """Each token's role, the one it is seen in more often; a tie makes a solvent."""
    each = df.select(F.explode(F.array(F.struct(F.lit(1).alias("r"), label_tokens(F.col(reagent)).alias("ts")), F.struct(F.lit(0).alias("r"), label_tokens(F.col(solvent)).alias("ts")))).alias("x"))
    counted = each.select("x.r", F.explode("x.ts").alias("token")).groupBy("token").agg(F.sum("r").alias("as_reagent"), F.count("*").alias("n"))
    return counted.select("token", (F.col("as_reagent") * 2 > F.col("n")).alias("is_reagent"))


def reassigned(df: DataFrame, row_id: str, reagent: str, solvent: str) -> DataFrame:
    """Tokens moved to the cell of their role, sorted and distinct; rows left without solvent are dropped."""
    roles = token_roles(df, reagent, solvent)
    each = df.select(row_id, F.explode(F.array_distinct(F.concat(label_tokens(F.col(reagent)), label_tokens(F.col(solvent))))).alias("token")).join(roles, "token")

    def cell(own: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(own, F.col("token")))), "; ")

    return each.groupBy(row_id).agg(cell(F.col("is_reagent")).alias(reagent), cell(~F.col("is_reagent")).alias(solvent)).filter(F.col(solvent) != "")


def representatives(df: DataFrame, canonical: Column, spelling: str, ordinal: str) -> DataFrame:
    """A10: the most frequent spelling of each canonical form; a tie goes to the one seen first."""
    seen = df.select(canonical.alias("canonical"), F.col(spelling).alias("spelling"), ordinal).filter("canonical IS NOT NULL")
    each = seen.groupBy("canonical", "spelling").agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return each.groupBy("canonical").agg(F.min_by("spelling", F.struct(-F.col("n"), "first")).alias("spelling"), F.sum("n").cast("bigint").alias("n"))


def first_of_each(df: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """The first row of each key by an explicit ordinal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordinal))).filter("_n = 1").drop("_n")


def hash_split(key: Column, shares: list[tuple[str, float]], seed: int = 0) -> Column:
    """Split of a key by its hash; equal keys share a split on any cluster."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    upto, out = 1.0, F.lit(shares[-1][0])
    for i in range(len(shares) - 1, 0, -1):
        upto -= shares[i][1]
        out = F.when(place < upto, F.lit(shares[i - 1][0])).otherwise(out)
    return out


def classwise_split(df: DataFrame, group: str, ordinal: list[str]) -> DataFrame:
    """The first 80 % of each class in order, then 10 % and 10 %."""
    placed = running(df, [group], ordinal, F.lit(1), "_i", "_n")
    split = F.when(F.col("_i") < F.floor(F.col("_n") * 0.8), "train").when(F.col("_i") < F.floor(F.col("_n") * 0.9), "val").otherwise("test")
    return placed.withColumn("split", split).drop("_i", "_n")


def exclusions(df: DataFrame, reasons: dict[str, Column], identity: Column, ordinal: str) -> DataFrame:
    """all reasons of each row; ``duplicate`` only against earlier rows that no other reason excludes."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons.items())), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", found).withColumn("_identity", identity)
    kept = marked.filter(F.size("reasons") == 0).groupBy("_identity").agg(F.min(ordinal).alias("_first"))
    joined = marked.join(kept, "_identity", "left")
    again = F.when(F.col(ordinal) > F.col("_first"), F.array_append("reasons", F.lit("duplicate"))).otherwise(F.col("reasons"))
    return joined.withColumn("reasons", again).drop("_identity", "_first")


def confident(df: DataFrame, column: str, least: float) -> DataFrame:
    """at least so confident; null and NaN are kept."""
    return df.filter(F.col(column).isNull() | F.isnan(column) | (F.col(column) >= least))


def nonempty_pairs(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """pairs with text on both sides, and the others."""
    good = F.coalesce((F.trim(a) != "") & (F.trim(b) != ""), F.lit(False))
    return df.filter(good), df.filter(~good)


def single_step(df: DataFrame, steps: str) -> DataFrame:
    """rows of one step; a number that cannot be read is none."""
    return df.filter(F.col(steps).cast("string").try_cast("double") == 1)


def positive_temperatures(df: DataFrame, label: str, temperature: str) -> DataFrame:
    """F16: positives with a finite temperature."""
    t = F.col(temperature)
    return df.filter((F.col(label) > 0.5) & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))


def reported_families(df: DataFrame, family: str, measures: list[str]) -> DataFrame:
    """rows of families with any measure other than zero."""
    some = F.greatest(*(F.max(F.abs(F.coalesce(F.col(m), F.lit(0.0)))) for m in measures), F.lit(0.0))
    live = df.groupBy(family).agg(some.alias("_most")).filter("_most > 0")
    return df.join(live.select(family), family, "left_semi")


def route_prefix(df: DataFrame, ordinal: str, most: int) -> DataFrame:
    """The first queries by their dense number; a filter on it, so nothing is sorted."""
    return df.filter(F.col(ordinal) < most)


def merged_names(df: DataFrame, name: str, token: str, score: str, priority: str, overrides: DataFrame | None = None) -> DataFrame:
    """per lower-case name the token of the highest score, then the lowest source priority, then the least text; overrides win."""
    rows = df.select(F.lower(F.trim(name)).alias("name"), F.col(token).alias("token"), F.col(score).alias("s"), F.col(priority).alias("p")).filter("name <> '' AND token <> ''")
    best = rows.groupBy("name").agg(F.min(F.struct((-F.col("s")).alias("s"), "p", "token")).getField("token").alias("token"))
    if overrides is None:
        return best
    fixed = overrides.select(F.lower(F.trim(name)).alias("name"), F.col(token).alias("token"))
    return best.join(fixed.select("name"), "name", "left_anti").unionByName(fixed)


def valid_sides(df: DataFrame, sides: dict[str, str], molecules: DataFrame) -> DataFrame:
    """rows all of whose sides are valid by a supplied table (raw, is_valid); unknown is invalid."""
    for side, flag in sides.items():
        known = molecules.filter("is_valid").select(F.col("raw").alias("_raw")).distinct().withColumn(flag, F.lit(True))
        df = df.join(known, df[side] == F.col("_raw"), "left").drop("_raw").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df


def product_rows(df: DataFrame, products: str, separator: str = "[.]") -> DataFrame:
    """V2: one row per product of a row; rows without one vanish."""
    parts = F.filter(F.split(products, separator), lambda x: x != "")
    return df.select(*(c for c in df.columns if c != products), F.posexplode(parts).alias("product_number", products))


def augmented(df: DataFrame, reactants: str, product: str, n: int, most: int = 1000) -> DataFrame:
    """V1: up to ``n`` variants of a row, its components in rotated order, and a status for each row that gives none.

    Rotation keeps the molecules as they are; other spellings of a molecule need a provider.
    """
    a, b = F.coalesce(F.col(reactants), F.lit("")), F.coalesce(F.col(product), F.lit(""))
    status = F.when(a == "", "no_reactants").when(b == "", "no_product").when(F.length(a) > most, "long_reactants").when(F.length(b) > most, "long_product").when(a == b, "unchanged").otherwise("ok")
    parts = F.split(a, "[.]")
    turns = F.sequence(F.lit(0), F.least(F.size(parts), F.lit(n)) - 1)
    variant = F.transform(turns, lambda i: F.array_join(F.concat(F.slice(parts, i + 1, F.size(parts) - i), F.slice(parts, F.lit(1), i)), "."))
    rows = df.withColumn("status", status)
    return rows.select("*", F.posexplode_outer(F.when(F.col("status") == "ok", variant)).alias("variant", "source"))


def valid_entries(df: DataFrame, parseable: Column, yield_: str, solvent: str, least_yield: float = 25.0) -> DataFrame:
    """rows with both sides parseable, a known yield of at least ``least_yield``, and a solvent label."""
    y = F.nanvl(F.col(yield_), F.lit(None).cast("double"))
    return df.filter(parseable & (y >= least_yield) & (F.size(label_tokens(F.col(solvent))) > 0))
