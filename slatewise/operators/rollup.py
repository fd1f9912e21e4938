"""Reports over runs: A14 to A18, A25 to A27, A33, A34, A36, U7, U8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.plans.running import running
from slatewise.shared import written


def macro_average(per_family: DataFrame, run: list[str], measures: list[str], totals: list[str]) -> DataFrame:
    """Unweighted mean over families, nulls left out; counts are summed."""
    aggs = [*(F.avg(m).alias(m) for m in measures), *(F.sum(c).cast("bigint").alias(c) for c in totals)]
    return per_family.groupBy(*run).agg(*aggs) if run else per_family.agg(*aggs)


def with_averages(per_family: DataFrame, family: str, measures: list[str], weight: str) -> DataFrame:
    """The families, then a macro and a weighted row; null measures are left out of both."""
    known = {m: F.when(F.col(m).isNotNull(), F.col(weight)) for m in measures}
    macro = per_family.agg(*(F.avg(m).alias(m) for m in measures), F.sum(weight).cast("bigint").alias(weight)).withColumn(family, F.lit("MACRO-AVG"))
    mean = per_family.agg(*((F.sum(F.col(m) * F.col(weight)) / F.sum(known[m])).alias(m) for m in measures), F.sum(weight).cast("bigint").alias(weight)).withColumn(family, F.lit("WEIGHTED-AVG"))
    columns = [family, weight, *measures]
    return per_family.select(*columns).unionByName(macro.select(*columns)).unionByName(mean.select(*columns))


def category_counts(df: DataFrame, family: str, category: str, categories: list[str], every: str = "ALL-FAMILIES") -> DataFrame:
    """Count of each of ``categories`` per family (null is one) and over all, zeros kept."""
    spark = df.sparkSession
    per = df.groupBy(family, category).agg(F.count("*").alias("n"))
    whole = per.groupBy(category).agg(F.sum("n").alias("n")).withColumn(family, F.lit(every))
    found = per.select(family, category, "n").unionByName(whole.select(family, category, "n"))
    per = per.select(family, category, "n")
    # each family counted brings its own grid of zeros: nothing is read twice, and a null family is a family
    names = per.select(family).unionAll(spark.createDataFrame([(every,)], f"{family} string"))
    zeros = names.distinct().select(family, F.explode(F.array(*map(F.lit, categories))).alias(category), F.lit(0).cast("bigint").alias("n"))
    counted = found.filter(F.col(category).isin(*categories)).unionByName(zeros)
    return counted.groupBy(family, category).agg(F.sum("n").cast("bigint").alias("n"))


def spread(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Mean, sample deviation (null for one run) and number of runs."""
    return df.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"), F.count(measure).alias("n"))


def budget(df: DataFrame, slate: str, route: str) -> DataFrame:
    """Mean and largest number of candidates per slate and per route."""
    per_route = df.groupBy(slate, route).agg(F.count("*").alias("n"))
    per_slate = per_route.groupBy(slate).agg(F.sum("n").alias("n"), F.count("*").alias("routes"), F.max("n").alias("most"))
    return per_slate.agg(
        F.avg("n").alias("mean_per_slate"), F.max("n").cast("bigint").alias("max_per_slate"), (F.sum("n") / F.sum("routes")).alias("mean_per_route"), F.max("most").cast("bigint").alias("max_per_route")
    )


def fallback_rate(df: DataFrame, route: list[str], similarity: str) -> DataFrame:
    """Share of routes whose largest similarity is not above 0 (null is not)."""
    per = df.groupBy(*route).agg(F.max(F.nanvl(similarity, F.lit(None).cast("double"))).alias("s"))
    return per.agg(F.count("*").alias("routes"), F.avg((F.coalesce("s", F.lit(0.0)) <= 0).cast("double")).alias("fallback_rate"))


def failure_category(has_route: Column, has_candidate: Column, hit: Column) -> Column:
    """The first stage that lost a query."""
    return F.when(~has_route, "route_miss").when(~has_candidate, "pool_miss").when(~hit, "ranking_miss").otherwise("hit")


def subgroup_means(df: DataFrame, flags: list[str], measures: list[str]) -> DataFrame:
    """Means for each value of each flag; empty subgroups have null means."""
    spark = df.sparkSession
    each = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("boolean").alias("value")) for f in flags))).alias("g"), *measures)
    found = each.groupBy("g.flag", "g.value").agg(F.count("*").alias("n"), *(F.avg(F.col(m).cast("double")).alias(m) for m in measures))
    grid = spark.createDataFrame([(f, v) for f in flags for v in (True, False)], "flag string, value boolean")
    return grid.join(found, ["flag", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left after each step, in one pass; a row counts for a step if it passes it and all before."""
    passed, out = F.lit(True), [F.count("*").alias("raw")]
    for name, step in steps.items():
        passed = passed & F.coalesce(step, F.lit(False))
        out.append(F.count(F.when(passed, 1)).alias(name))
    return df.agg(*out)


def bootstrap_interval(per_cluster: DataFrame, cluster: str, total: str, size: str, draws: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a ratio of sums under resampling of whole clusters.

    Each cluster's weight in a draw is a Poisson(1) count from a hash of (cluster, draw): the limit of
    resampling with replacement, with no draw table and no join, the same on any number of
    tasks. Only draws (a parameter) are shuffled.
    """
    each = per_cluster.select(cluster, total, size, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col(cluster).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    weight, upto = F.lit(0), 0.0
    for k in range(12):  # cumulative probabilities of Poisson(1)
        upto += 2.718281828459045**-1 / _factorial(k)
        weight = weight + (u > upto).cast("int")
    drawn = each.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col(total)) / F.nullif(F.sum(F.col("w") * F.col(size)).cast("double"), F.lit(0.0))).alias("value"))
    return drawn.agg(F.avg("value").alias("mean"), F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"), F.count("value").alias("draws"))


def _factorial(k: int) -> int:
    return 1 if k < 2 else k * _factorial(k - 1)


def bootstrap_macro(per_cluster: DataFrame, family: str, cluster: str, sums: dict[str, str], size: str, draws: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """For each system the mean and percentile interval of the mean over families, and of the difference from the first system.

    In a draw each family picks as many clusters as it has, with replacement, by a hash of (family, draw, place); all
    systems see the same picks. ``sums`` names each system's column of sums per cluster, ``size`` that of
    rows per cluster. Clusters are numbered by ``running``, so no task orders a family.
    """
    numbered = running(per_cluster, [family], [cluster], F.lit(1), "_place", "_all").withColumn("_place", F.col("_place").cast("bigint"))
    stats = written(numbered.select(family, "_place", "_all", size, *dict.fromkeys(sums.values())), "numbered-clusters")
    each = stats.select(family, "_place", "_all", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    part = F.substring(F.md5(F.concat_ws(":", family, "draw", "_place")), 1, 8)
    picks = each.select(family, "draw", F.pmod(F.conv(part, 16, 10).cast("bigint"), F.col("_all").cast("bigint")).alias("_place")).groupBy(family, "draw", "_place").agg(F.count("*").alias("_times"))
    met = picks.join(stats.drop("_all").withColumnsRenamed({family: "_family", "_place": "_of"}), F.col(family).eqNullSafe(F.col("_family")) & (F.col("_place") == F.col("_of")))
    rows = F.sum(F.col("_times") * F.col(size))
    per_draw = met.groupBy("draw", family).agg(*((F.sum(F.col("_times") * F.col(c)) / rows).alias(s) for s, c in sums.items())).groupBy("draw").agg(*(F.avg(s).alias(s) for s in sums))
    first = next(iter(sums))
    values = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("value"), (F.col(s) - F.col(first)).alias("delta")) for s in sums)))
    flat = per_draw.select(values.alias("x")).select("x.*")
    ends = [F.percentile(c, q).alias(f"{c}_{name}") for c in ("value", "delta") for q, name in ((low, "low"), (high, "high"))]
    return flat.groupBy("system").agg(F.avg("value").alias("mean"), F.avg("delta").alias("mean_delta"), *ends, F.count("*").alias("draws"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def grid_mismatch(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """U8: keys missing, unexpected, or repeated; empty when the grid is complete."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = expected.select(*keys).distinct().withColumn("wanted", F.lit(1)).join(seen, keys, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return joined.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def joined_runs(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Two runs side by side with the difference of each measure."""
    left = a.select(*keys, *(F.col(m).alias(f"{m}_a") for m in measures))
    right = b.select(*keys, *(F.col(m).alias(f"{m}_b") for m in measures))
    return left.join(right, keys).select("*", *((F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in measures))


def averaged(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element-wise mean over checkpoints; every key must be in each of them."""
    return parts.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n"))

