"""Ranking inside slates: W1 to W12, A19 to A24, J17, Q3, Q5, Q6.

A slate is all candidates of one query; a manifest lists every query, with or
without candidates. Orders given here must be total: Spark's sort is not stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def ranked(df: DataFrame, slate: str, order: list[Column], name: str = "slate_rank") -> DataFrame:
    """Position from 1 within the slate."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(slate).orderBy(*order)))


def first_k(df: DataFrame, slate: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each slate; Spark prunes to k per task before the shuffle."""
    return ranked(df, slate, order).filter(F.col("slate_rank") <= k)


def rank_prior(df: DataFrame, slate: str, order: list[Column]) -> DataFrame:
    """1 for the first down to 0 for the last; 1 for a lone candidate; and score minus rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy(slate))
    prior = 1.0 - (F.col("slate_rank") - 1) / F.greatest(n - 1, F.lit(1))
    return ranked(df, slate, order).withColumn("prior", prior).withColumn("rank_score", -F.col("slate_rank").cast("double"))


def z_sample(x: Column, slate: str) -> Column:
    """By sample deviation; divisor 1 where that is null or 0."""
    w = Window.partitionBy(slate)
    return (x - F.avg(x).over(w)) / F.coalesce(F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(1.0))


def z_population(x: Column, slate: str) -> Column:
    """By population deviation; 0 where that is at most 1e-12."""
    w = Window.partitionBy(slate)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd <= 1e-12, 0.0).otherwise((x - F.avg(x).over(w)) / sd)


def share_within(x: Column, slate: str | None = None) -> Column:
    """X over the sum of its slate (or of all); a sum of 0 counts as 1."""
    w = Window.partitionBy(slate) if slate else Window.partitionBy()
    return x / F.coalesce(F.nullif(F.sum(x).over(w), F.lit(0.0)), F.lit(1.0))


def slate_hits(df: DataFrame, slate: str, rank: str = "slate_rank", label: str = "label", ks: tuple[int, ...] = KS) -> DataFrame:
    """A19, A20 per slate: hit@k, covered, reciprocal rank, nDCG@10 of a 0/1 label."""
    r, hit = F.col(rank), F.coalesce(F.col(label), F.lit(0)) > 0.5
    gain = F.sum(F.when(hit & (r <= 10), 1.0 / F.log2(r + 1.0)).otherwise(0.0))
    n = F.least(F.sum(hit.cast("int")), F.lit(10)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    return df.groupBy(slate).agg(
        *(F.max((hit & (r <= k)).cast("int")).alias(f"hit{k}") for k in ks),
        F.max(hit.cast("int")).alias("covered"),
        F.coalesce(1.0 / F.min(F.when(hit, r)), F.lit(0.0)).alias("rr"),
        F.when(n > 0, gain / ideal).otherwise(0.0).alias("ndcg10"),
    )


def over_manifest(manifest: DataFrame, slates: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Means over all queries of the manifest; queries without candidates are misses."""
    every = manifest.select(key).join(slates, key, "left")
    return every.agg(F.count("*").alias("n_queries"), *(F.avg(F.coalesce(F.col(m), F.lit(0)).cast("double")).alias(m) for m in measures))


def temperature_error(df: DataFrame, slate: str, rank: str, label: str, reference: str, predicted: str, within: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Error at the first positive, in rank order over the whole slate, that has both temperatures."""
    usable = df.filter((F.col(label) > 0.5) & F.col(reference).isNotNull() & F.col(predicted).isNotNull() & ~F.isnan(reference) & ~F.isnan(predicted))
    first = usable.groupBy(slate).agg(F.min_by(F.struct(F.col(reference).alias("a"), F.col(predicted).alias("b")), rank).alias("x"))
    gap = F.abs(F.col("x.b") - F.col("x.a"))
    return first.agg(
        F.count("*").alias("n"), F.avg(gap).alias("mae"), F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        *(F.avg((gap <= w).cast("double")).alias(f"within_{w}") for w in within),
    )


def key_recall(queries: DataFrame, predictions: DataFrame, key: str, gold: str, predicted: str, rank: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall@k of a gold key; queries with an empty gold key leave the count."""
    asked = queries.filter(F.coalesce(F.col(gold), F.lit("")) != "").select(key, gold)
    found = asked.join(predictions.select(key, predicted, rank), key, "left")
    per = found.groupBy(key).agg(*(F.max(F.coalesce((F.col(gold) == F.col(predicted)) & (F.col(rank) <= k), F.lit(False)).cast("int")).alias(f"recall{k}") for k in ks))
    return per.agg(F.count("*").alias("n"), *(F.avg(F.col(f"recall{k}").cast("double")).alias(f"recall{k}") for k in ks))


def weight_grid_hits(df: DataFrame, slate: str, score: Column, prior: Column, weights: DataFrame, tie: list[Column], ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """Q3 to Q5: hits of score + w * prior for every w of a small grid, in one job."""
    n = weights.count()
    if n > 10_000:
        raise ValueError("a grid is small")
    # ties are settled once, so that the rows of the grid carry numbers only; rows are
    # shuffled once, by slate, before the grid spreads them: (w, slate) is then already together
    placed = df.select(slate, "label", score.alias("s"), prior.alias("p"), F.row_number().over(Window.partitionBy(slate).orderBy(*tie)).alias("t"))
    rows = placed.crossJoin(F.broadcast(weights)).select("w", slate, "label", (F.col("s") + F.col("w") * F.col("p")).alias("v"), "t")
    at = rows.withColumn("r", F.row_number().over(Window.partitionBy(slate, "w").orderBy(F.col("v").desc(), "t"))).filter(F.col("r") <= max(ks))
    per = at.groupBy(slate, "w").agg(*(F.max(((F.col("r") <= k) & (F.col("label") > 0.5)).cast("int")).alias(f"hit{k}") for k in ks))
    return per.groupBy("w").agg(*(F.sum(f"hit{k}").cast("bigint").alias(f"hit{k}") for k in ks))


def best_weight(grid: DataFrame, measures: list[str], larger_on_tie: bool) -> DataFrame:
    """Q2 to Q5: the row that is best by the measures in turn; ties by the larger or the smaller weight."""
    order = [*(F.col(m).desc() for m in measures), F.col("w").desc() if larger_on_tie else F.col("w").asc()]
    return grid.orderBy(*order).limit(1)
