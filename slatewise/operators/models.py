"""Closed-form and Spark ML models: A28 to A30, A37, L1 to L8, L11, L12.

What Spark ML has no equal for is named where it stands in: the ranking
objective is replaced by a regression on graded relevance, the multi-label
network by the closed-form Bernoulli model or by one logistic regression per token.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bernoulli_fit(features: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Per (label, feature) the log odds of presence, and per label its prior and base term.

    ``features`` is (id, feature), distinct; ``labels`` is (id, label). Only present features
    are counted; the base term holds the absent ones of the whole vocabulary.
    """
    total = labels.agg(F.count("*").alias("total"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    names = features.select("feature").distinct()
    seen = labels.join(features, "id").groupBy("label", "feature").agg(F.count("*").alias("c"))
    grid = sizes.crossJoin(names).join(seen, ["label", "feature"], "left")
    p = (F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + 2 * alpha)
    odds = grid.select("label", "feature", "n", "total", (F.log(p) - F.log(1 - p)).alias("log_odds"), F.log(1 - p).alias("absent"))
    base = F.sum("absent").over(Window.partitionBy("label")) + F.log(F.col("n") / F.col("total"))
    return odds.select("label", "feature", "log_odds", base.alias("base"))


def bernoulli_logits(model: DataFrame, features: DataFrame, ids: DataFrame) -> DataFrame:
    """Log score of each label for each id: its base plus the odds of the features present."""
    present = features.join(model, "feature").groupBy("id", "label").agg(F.sum("log_odds").alias("s"))
    labels = model.select("label", "base").distinct()
    return ids.select("id").crossJoin(F.broadcast(labels)).join(present, ["id", "label"], "left").select("id", "label", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("logit"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Others over own, within [1, 20]."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select(label, F.least(F.greatest((total - F.col("n")) / F.col("n"), F.lit(1.0)), F.lit(20.0)).alias("weight"))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation below 1e-6 counts as 1."""
    stats = df.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    wide = df.crossJoin(F.broadcast(stats))
    z = {c: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") < 1e-6, 1.0).otherwise(F.col(f"_s{i}")) for i, c in enumerate(columns)}
    return wide.select(*(z[c].alias(c) if c in z else F.col(c) for c in df.columns))


def neighbor_mean(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """L4: one step of message passing: mean of a node's neighbors (edges ``src``, ``dst`` both ways), 0 without any."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = edges.select("src", "dst").unionByName(back)
    found = every.join(nodes.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(*(F.avg(f).alias(f"mean_{f}") for f in features))
    return nodes.join(found, "id", "left").fillna(0.0, [f"mean_{f}" for f in features])


def list_mle(df: DataFrame, slate: str, score: str, relevance: str, tie: list[str]) -> DataFrame:
    """Per slate the negative log likelihood of the order by relevance: sum of log(sum of exp of the rest) - score."""
    w = Window.partitionBy(slate).orderBy(F.col(relevance).desc(), *tie).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    top = F.max(score).over(Window.partitionBy(slate))
    each = df.withColumn("_e", F.exp(F.col(score) - top)).withColumn("_top", top)
    return each.withColumn("_t", F.log(F.sum("_e").over(w)) + F.col("_top") - F.col(score)).groupBy(slate).agg(F.sum("_t").alias("loss"))


def list_net(df: DataFrame, slate: str, score: str, relevance: str) -> DataFrame:
    """Cross entropy of the softmax of relevance and of score."""
    w = Window.partitionBy(slate)
    e = lambda c: F.exp(F.col(c) - F.max(c).over(w))
    both = df.select(slate, e(score).alias("s"), e(relevance).alias("r"))
    share = both.select(slate, (F.col("s") / F.sum("s").over(w)).alias("s"), (F.col("r") / F.sum("r").over(w)).alias("r"))
    return share.groupBy(slate).agg((-F.sum(F.col("r") * F.log("s"))).alias("loss"))


def slate_partitions(df: DataFrame, slate: str, n: int | None = None) -> DataFrame:
    """Whole slates per partition."""
    return df.repartition(n, slate) if n else df.repartition(slate)


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def boosted_scores(train: DataFrame, rows: DataFrame, features: list[str], target: str, seed: int = 7, iterations: int = 10, forest: bool = False) -> DataFrame:
    """Boosted trees (or a forest) regressed on a target; for ranking this is a stand-in objective.

    Predictions are clipped to the range of the training target.
    """
    kind = RandomForestRegressor if forest else GBTRegressor
    size = {"numTrees": iterations} if forest else {"maxIter": iterations}
    model = kind(featuresCol="_features", labelCol=target, predictionCol="prediction", seed=seed, maxDepth=4, **size).fit(_vectors(train, features))
    ends = train.agg(F.min(target).alias("_low"), F.max(target).alias("_high"))
    out = model.transform(_vectors(rows, features)).crossJoin(F.broadcast(ends))
    return out.withColumn("prediction", F.least(F.greatest("prediction", "_low"), "_high")).drop("_features", "_low", "_high")


def clustered(df: DataFrame, vector: Column, k: int, dimensions: int, seed: int = 7) -> DataFrame:
    """Principal components, then k-means; each row's cluster."""
    rows = df.withColumn("_v", array_to_vector(vector.cast("array<double>")))
    reduced = PCA(k=dimensions, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="cluster").fit(reduced).transform(reduced).drop("_v", "_p")
