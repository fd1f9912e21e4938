"""Candidate pools: J5 to J7, J12 to J15, Q1, Q9 to Q13, W11, F39."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import numbers as N
from slatewise.functions.labels import label_tokens
from slatewise.functions.text import known_number
from slatewise.plans.skew import join_spread
from slatewise.shared import written


def marked(df: DataFrame, gold: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether the keys stand in ``gold``; null keys stand nowhere."""
    known = gold.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def labelled(df: DataFrame, gold: DataFrame, route: list[str], context: list[str], temperature: str, yield_: str) -> DataFrame:
    """Route, context and exact agreement with their mean temperature and yield (0 without one)."""
    keys = [*dict.fromkeys([*route, *context])]
    exact = gold.groupBy(*keys).agg(F.avg(known_number(F.col(temperature))).alias("temperature_gold"), F.avg(known_number(F.col(yield_))).alias("yield_gold"), F.lit(True).alias("exact"))
    rows = marked(marked(df, gold, route, "route_match"), gold, context, "context_match").join(exact, keys, "left")
    kind = N.label_type(F.col("route_match"), F.col("context_match"), F.coalesce("exact", F.lit(False)))
    return (
        rows.withColumn("label", F.coalesce("exact", F.lit(False)).cast("int"))
        .withColumn("label_type", kind)
        .withColumn("sample_weight", N.sample_weight(F.col("label_type")))
        .withColumn("rank_relevance", N.relevance(F.col("label_type")))
        .withColumn("yield_gold", F.coalesce("yield_gold", F.lit(0.0)))
        .drop("exact")
    )


def each_with_top(rows: DataFrame, top: DataFrame, most: int = 1000) -> DataFrame:
    """Every row with each of a few top contexts; their number is checked."""
    if top.limit(most + 1).count() > most:
        raise ValueError("too many contexts to pair with every row")
    return rows.crossJoin(F.broadcast(top))


def distinct_routes(routes: DataFrame, slate: str, route: str, order: list[Column]) -> DataFrame:
    """A query's distinct routes, the first row by order of each."""
    return routes.withColumn("_n", F.row_number().over(Window.partitionBy(slate, route).orderBy(*order))).filter("_n = 1").drop("_n")


def joint_candidates(routes: DataFrame, contexts: DataFrame, slate: str, route: str, order: list[Column]) -> DataFrame:
    """A query's distinct routes (first by order) with each of its contexts; the routes of a query that holds many are spread."""
    first = written(distinct_routes(routes, slate, route, order), "routes")
    return join_spread(first, contexts, slate)


def joint_counts(routes: DataFrame, contexts: DataFrame, slate: str, route: str, id_: str, order: list[Column]) -> DataFrame:
    """J13, counted: the rows and distinct route ids that ``joint_candidates`` gives for each query.

    Each route meets each context of its query, so the rows are the product of two counts and no pair is formed.
    """
    own = distinct_routes(routes, slate, route, order).groupBy(slate).agg(F.count("*").alias("_routes"), F.countDistinct(id_).alias("routes"))
    there = contexts.groupBy(slate).agg(F.count("*").alias("_contexts"))
    return own.join(there, slate).select(slate, (F.col("_routes") * F.col("_contexts")).alias("candidates"), "routes")


def full_union(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both candidate lists by key, values of ``a`` first, with where each came from; keys are compared null-safe."""
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    here, there = F.col("x._here").isNotNull(), F.col("y._here").isNotNull()
    x, y = a.withColumn("_here", F.lit(1)).alias("x"), b.withColumn("_here", F.lit(1)).alias("y")
    joined = x.join(y, on, "full_outer")
    return joined.select(
        *(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys), *(F.coalesce(f"x.{v}", f"y.{v}").alias(v) for v in values),
        *(F.col(f"y.{v}").alias(f"other_{v}") for v in values), here.alias("from_first"), there.alias("from_second"),
    )


def fused(first: Column, second: Column, weight: float) -> Column:
    """Q1: weight * first + (1 - weight) * second, absent scores as 0."""
    return weight * F.coalesce(first, F.lit(0.0)) + (1 - weight) * F.coalesce(second, F.lit(0.0))


def fusion_order() -> list[Column]:
    """Score, neighbor rank (0, absent, last), history, similarity, labels."""
    rank = F.when(F.col("knn_rank") > 0, F.col("knn_rank")).otherwise(10**9)
    return [F.col("score").desc(), rank, F.col("is_historical").desc(), F.col("similarity_sum").desc(), F.col("reagent_norm"), F.col("solvent_norm")]


def by_priority(tiers: list[tuple[int, DataFrame]], keys: list[str], support: str) -> DataFrame:
    """One row per key over several tiers, the best by (tier priority, support)."""
    parts = [df.select(*keys, F.lit(p).alias("priority"), F.col(support).cast("double").alias("support")) for p, df in tiers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("priority", "support"))
    return out.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("tiers")).select(*keys, "best.priority", "best.support", "tiers")


# Weights of a precedent's evidence.
PRECEDENT_WEIGHTS = {"exact": 1e9, "exact_count": 1e6, "scaffold": 1e5, "scaffold_count": 1e3, "weighted_support": 10.0, "similarity_max": 1.0, "mean_yield": 1e-3}


def precedent_score() -> Column:
    """Q12."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in PRECEDENT_WEIGHTS.items()), F.lit(0.0))


def frequency_score(count: Column, route_rank: Column, probability: Column, context_rank: Column) -> Column:
    """Q13: count first, then the route's rank and probability, then the context's rank."""
    return count * 1_000_000.0 + F.greatest(F.lit(0.0), 1000.0 - route_rank) + F.greatest(F.lit(0.0), probability) * 1e-3 - context_rank * 1e-6


def best_then_capped(df: DataFrame, key: list[str], route: list[str], score: str, tie: list[str], cap: int) -> DataFrame:
    """Best row per key, then the first ``cap`` per route."""
    order = [F.col(score).desc_nulls_last(), *map(F.col, tie)]
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1")
    return best.withColumn("_n", F.row_number().over(Window.partitionBy(*route).orderBy(*order))).filter(F.col("_n") <= cap).withColumnRenamed("_n", "place")


def contexts_within(contexts: DataFrame, cell: str, selected: list[str]) -> DataFrame:
    """Q9: contexts whose tokens are all selected."""
    return contexts.filter(F.size(F.array_except(label_tokens(F.col(cell)), F.array(*map(F.lit, selected)))) == 0)


def combinations(token_rows: DataFrame, most: int, largest: int, limit: int = 200) -> DataFrame:
    """Q10: all sets of up to ``largest`` of the first ``most`` tokens (token, weight), with their mean weight; the first ``limit`` by weight."""
    if most > 200 or largest > 4:
        raise ValueError("combinations are bounded")
    base = token_rows.orderBy(F.col("weight").desc(), "token").limit(most)
    level = base.select(F.array("token").alias("set"), "weight", F.col("token").alias("last"))
    every = level
    for _ in range(largest - 1):
        # each set grows by later tokens only, so every set is made once
        level = level.join(F.broadcast(base.select(F.col("token").alias("t"), F.col("weight").alias("w"))), F.col("t") > F.col("last"))
        level = level.select(F.array_append("set", F.col("t")).alias("set"), (F.col("weight") + F.col("w")).alias("weight"), F.col("t").alias("last"))
        every = every.unionByName(level)
    scored = every.select(F.array_join("set", "; ").alias("tokens"), F.size("set").alias("n"), (F.col("weight") / F.size("set")).alias("score"))
    return scored.orderBy(F.col("score").desc(), "n", "tokens").limit(limit)


def refined(df: DataFrame, slate: str, anchor: Column, correction: Column, order: list[Column], cap: int) -> DataFrame:
    """Q11: the score moves by a correction around its anchor; the first ``cap`` stay, with a flag where the order changed."""
    moved = df.withColumn("refined_score", anchor + correction)
    w, v = Window.partitionBy(slate).orderBy(F.col("refined_score").desc(), *order), Window.partitionBy(slate).orderBy(anchor.desc(), *order)
    both = moved.withColumn("refined_rank", F.row_number().over(w)).withColumn("anchor_rank", F.row_number().over(v))
    return both.filter(F.col("refined_rank") <= cap).withColumn("moved", F.col("refined_rank") != F.col("anchor_rank"))


# Parts of a context's score.
PRIOR_WEIGHT, SIZE_PENALTY, HISTORY_BONUS, SUPPORT_WEIGHT, NOVELTY_PENALTY = 0.05, 0.02, 0.40, 0.15, 0.60


def composed_score(reagent: Column, solvent: Column, reagent_prior: Column, solvent_prior: Column, n_reagents: Column, n_solvents: Column, support: Column, historical: Column) -> Column:
    """Q8: token scores and priors of both sides, a bonus and support for contexts seen before, a penalty for new and for large ones."""
    size = SIZE_PENALTY * (F.greatest(n_reagents - 1, F.lit(0)) + F.greatest(n_solvents - 1, F.lit(0)))
    seen = F.when(historical, HISTORY_BONUS + SUPPORT_WEIGHT * support).otherwise(-NOVELTY_PENALTY)
    return (reagent + solvent) / 2 + PRIOR_WEIGHT * (reagent_prior + solvent_prior) / 2 + seen - size


def correction_grid_hits(df: DataFrame, slate: str, score: Column, prior: Column, residual: Column, corrections: DataFrame, weights: DataFrame, tie: list[Column], most: float = 0.5) -> DataFrame:
    """Q4: hits for every pair of a correction weight ``c`` and a fusion weight ``w``, in one job: score + w * (prior + clip(c * residual))."""
    if corrections.count() * weights.count() > 10_000:
        raise ValueError("a grid is small")
    place = F.row_number().over(Window.partitionBy(slate).orderBy(*tie))
    base = df.select(slate, "label", score.alias("s"), prior.alias("p"), residual.alias("d"), place.alias("t"))
    grid = F.broadcast(corrections.crossJoin(weights))
    value = F.col("s") + F.col("w") * (F.col("p") + F.least(F.greatest(F.col("c") * F.col("d"), F.lit(-most)), F.lit(most)))
    rows = base.crossJoin(grid).select("c", "w", slate, "label", value.alias("v"), "t")
    at = rows.withColumn("r", F.row_number().over(Window.partitionBy(slate, "c", "w").orderBy(F.col("v").desc(), "t"))).filter("r <= 10")
    per = at.groupBy(slate, "c", "w").agg(F.max(F.when(F.col("r") == 1, F.col("label")).otherwise(0)).alias("hit1"), F.max("label").alias("hit10"))
    return per.groupBy("c", "w").agg(F.sum("hit1").cast("bigint").alias("hit1"), F.sum("hit10").cast("bigint").alias("hit10"))
