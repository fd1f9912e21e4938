"""Families are order priorities; measures come from slates of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import rollup as U
from slatewise.registry import Tables, query

_LABELLED = """q AS (SELECT o_orderkey, o_orderpriority AS family, count(l_orderkey) AS n, max((l_returnflag = 'R')::INT) AS hit, max((l_linestatus = 'F')::INT) AS cand, avg(l_discount) AS d
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
_FAMILY = f"{_LABELLED}, f AS (SELECT family, count(*) AS n_queries, avg(coalesce(hit, 0)::DOUBLE) AS hit, avg(d) AS d FROM q GROUP BY family)"


def _per_query(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("hit"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("cand"), F.avg("l_discount").alias("d")
    )
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("family")).join(lines, "o_orderkey", "left")


def _per_family(t: Tables) -> DataFrame:
    return _per_query(t).groupBy("family").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("hit"), F.avg("d").alias("d"))


@query(f"WITH {_FAMILY}, u AS (SELECT family, n_queries, hit, d FROM f UNION ALL SELECT 'MACRO-AVG', sum(n_queries), avg(hit), avg(d) FROM f UNION ALL SELECT 'WEIGHTED-AVG', sum(n_queries), sum(hit * n_queries) / sum(n_queries), sum(d * n_queries) / sum(n_queries) FROM f) SELECT family, n_queries::BIGINT AS n_queries, round(hit, 9) AS hit, round(d, 9) AS d FROM u")
def group_macro_weighted(t: Tables) -> DataFrame:
    """A14 A15."""
    out = U.with_averages(_per_family(t), "family", ["hit", "d"], "n_queries")
    return out.select("family", "n_queries", F.round("hit", 9).alias("hit"), F.round("d", 9).alias("d"))


@query(f"WITH {_FAMILY} SELECT round(avg(hit), 9) AS hit, round(avg(d), 9) AS d, sum(n_queries)::BIGINT AS n_queries FROM f")
def macro_average(t: Tables) -> DataFrame:
    """A14."""
    out = U.macro_average(_per_family(t), [], ["hit", "d"], ["n_queries"])
    return out.select(F.round("hit", 9).alias("hit"), F.round("d", 9).alias("d"), "n_queries")


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, count(v) AS n,
printf('%.2f', avg(v) * 100) || '%' AS shown FROM s GROUP BY l_returnflag""")
def seed_mean_sd(t: Tables) -> DataFrame:
    """Line numbers stand for seeds."""
    from slatewise.functions.numbers import percent_text

    per = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    out = U.spread(per, ["l_returnflag"], "v")
    return out.select("l_returnflag", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n", percent_text(F.col("mean")).alias("shown"))


_CATEGORY = "CASE WHEN n = 0 THEN 'route_miss' WHEN coalesce(cand, 0) = 0 THEN 'pool_miss' WHEN coalesce(hit, 0) = 0 THEN 'ranking_miss' ELSE 'hit' END"


def _categories(t: Tables) -> DataFrame:
    n, cand, hit = (F.coalesce(c, F.lit(0)) > 0 for c in ("n", "cand", "hit"))
    return _per_query(t).withColumn("category", U.failure_category(n, cand, hit))


@query(f"""WITH {_LABELLED}, c AS (SELECT family, {_CATEGORY} AS category FROM q), k AS (SELECT unnest(['route_miss', 'pool_miss', 'ranking_miss', 'hit', 'never']) AS category), f AS (SELECT DISTINCT family FROM c UNION ALL SELECT 'ALL-FAMILIES')
SELECT f.family, k.category, count(c.family) AS n FROM f CROSS JOIN k LEFT JOIN c ON (c.family = f.family OR f.family = 'ALL-FAMILIES') AND c.category = k.category GROUP BY ALL""")
def category_counts_rollup(t: Tables) -> DataFrame:
    """Zero rows kept."""
    return U.category_counts(_categories(t), "family", "category", ["route_miss", "pool_miss", "ranking_miss", "hit", "never"])


@query(f"WITH {_LABELLED} SELECT o_orderkey, {_CATEGORY} AS category FROM q")
def failure_categories(t: Tables) -> DataFrame:
    """A33."""
    return _categories(t).select("o_orderkey", "category")


@query(f"""WITH {_LABELLED}, e AS (SELECT 'seen' AS flag, n > 3 AS value, coalesce(hit, 0) AS h FROM q UNION ALL SELECT 'always' , true, coalesce(hit, 0) FROM q), g AS (SELECT * FROM (VALUES ('seen', true), ('seen', false), ('always', true), ('always', false)) v(flag, value))
SELECT g.flag, g.value, count(e.h) AS n, round(avg(e.h::DOUBLE), 9) AS hit FROM g LEFT JOIN e ON e.flag = g.flag AND e.value = g.value GROUP BY ALL""")
def subgroup_means(t: Tables) -> DataFrame:
    """An empty subgroup has a null mean."""
    rows = _per_query(t).select((F.coalesce("n", F.lit(0)) > 3).alias("seen"), F.lit(True).alias("always"), F.coalesce("hit", F.lit(0)).alias("hit"))
    return U.subgroup_means(rows, ["seen", "always"], ["hit"]).select("flag", "value", "n", F.round("hit", 9).alias("hit"))


@query("""SELECT count(*) AS raw, count(*) FILTER (yield_value IS NOT NULL AND NOT isnan(yield_value)) AS has_yield, count(*) FILTER (yield_value >= 25 AND NOT isnan(yield_value)) AS good_yield,
count(*) FILTER (yield_value >= 25 AND NOT isnan(yield_value) AND coalesce(solvent_norm, '') <> '') AS has_solvent FROM condition_rows""")
def funnel_counts(t: Tables) -> DataFrame:
    """A34 F11."""
    y = F.nanvl("yield_value", F.lit(None).cast("double"))
    return U.funnel(t.condition_rows, {"has_yield": y.isNotNull(), "good_yield": y >= 25, "has_solvent": F.coalesce("solvent_norm", F.lit("")) != ""})


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, sum(n) AS n FROM r GROUP BY l_orderkey)
SELECT round((SELECT avg(n) FROM s), 9) AS mean_per_slate, (SELECT max(n) FROM s)::BIGINT AS max_per_slate, round((SELECT avg(n) FROM r), 9) AS mean_per_route, (SELECT max(n) FROM r)::BIGINT AS max_per_route""")
def budget_stats(t: Tables) -> DataFrame:
    """A25."""
    out = U.budget(t.lineitem, "l_orderkey", "l_suppkey")
    return out.withColumns({"mean_per_slate": F.round("mean_per_slate", 9), "mean_per_route": F.round("mean_per_route", 9)})


@query("""WITH r AS (SELECT sample_index, max(CASE WHEN isnan(max_similarity) THEN NULL ELSE max_similarity END) AS s FROM context_predictions GROUP BY sample_index) SELECT count(*) AS routes, round(avg((coalesce(s, 0) <= 0.5)::INT::DOUBLE), 9) AS fallback_rate FROM r""")
def fallback_rate(t: Tables) -> DataFrame:
    """A26, similarity above one half counting as found."""
    out = U.fallback_rate(t.context_predictions.withColumn("s", F.col("max_similarity") - 0.5), ["sample_index"], "s")
    return out.withColumn("fallback_rate", F.round("fallback_rate", 9))


_U = "((('0x' || substr(md5(o_custkey::VARCHAR || ':' || draw::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _poisson_sql(u: str) -> str:
    upto, out = 0.0, []
    for k in range(12):
        upto += 2.718281828459045**-1 / U._factorial(k)
        out.append(f"({u} > {upto!r}::DOUBLE)::INT")
    return " + ".join(out)


@query(f"""WITH c AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS size FROM orders GROUP BY o_custkey), e AS (SELECT c.*, draw FROM c, range(1, 201) t(draw)), v AS (SELECT *, {_U} AS u FROM e),
d AS (SELECT draw, sum(({_poisson_sql('u')}) * total) / sum(({_poisson_sql('u')}) * size) AS value FROM v GROUP BY draw) SELECT round(avg(value), 3) AS mean, round(quantile_cont(value, 0.025), 3) AS low, round(quantile_cont(value, 0.975), 3) AS high, count(value) AS draws FROM d""")
def bootstrap_ci(t: Tables) -> DataFrame:
    """Customers are the clusters."""
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("size"))
    out = U.bootstrap_interval(per, "o_custkey", "total", "size", 200)
    return out.select(F.round("mean", 3).alias("mean"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "draws")


@query("WITH n AS (SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 100, 'NEW', 1) SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n) UNION ALL SELECT * FROM n")
def upsert_rows(t: Tables) -> DataFrame:
    """U7."""
    changed = t.nation.filter("n_nationkey % 5 = 0").withColumn("n_name", F.concat("n_name", F.lit("!")))
    new = changed.unionByName(t.spark.createDataFrame([(100, "NEW", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    return U.upsert(t.nation, new, ["n_nationkey"])


@query("""WITH e AS (SELECT r_regionkey AS a, i::INT AS b FROM region, range(0, 6) t(i)), o AS (SELECT n_regionkey AS a, (n_nationkey % 7)::INT AS b, count(*) AS n FROM nation GROUP BY ALL)
SELECT coalesce(e.a, o.a) AS a, coalesce(e.b, o.b) AS b, CASE WHEN n IS NULL THEN 'missing' WHEN e.a IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM e FULL JOIN o ON e.a = o.a AND e.b = o.b WHERE n IS NULL OR e.a IS NULL OR n > 1""")
def complete_grid_check(t: Tables) -> DataFrame:
    """U8."""
    grid = t.region.select(F.col("r_regionkey").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("b"))
    return U.grid_mismatch(t.nation.select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 7).alias("b")), grid, ["a", "b"])


@query("""WITH a AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), b AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)
SELECT l_suppkey, round(a.m, 9) AS m_a, round(b.m, 9) AS m_b, round(b.m - a.m, 9) AS m_delta FROM a JOIN b USING (l_suppkey)""")
def paired_runs_delta(t: Tables) -> DataFrame:
    """Two runs and their gaps."""
    run = lambda f: t.lineitem.filter(f).groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    out = U.joined_runs(run("l_linenumber <= 3"), run("l_linenumber > 3"), ["l_suppkey"], ["m"])
    return out.select("l_suppkey", *(F.round(c, 9).alias(c) for c in ("m_a", "m_b", "m_delta")))


@query("SELECT label, i::INT AS pos, round(avg(embedding[i + 1]::DOUBLE), 6) AS value, count(*) AS n FROM embeddings, range(0, 64) t(i) GROUP BY ALL")
def checkpoint_average(t: Tables) -> DataFrame:
    """Vectors of a label averaged by element."""
    parts = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return U.averaged(parts, ["label", "pos"], "value").withColumn("value", F.round("value", 6))


@query(f"WITH {_FAMILY} SELECT family, round(1 - hit, 9) AS coverage_loss, round((SELECT max(hit) FROM f) - hit, 9) AS gap_to_best, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS suppliers FROM f")
def loss_gaps(t: Tables) -> DataFrame:
    """A18 A36."""
    f = _per_family(t)
    top = f.agg(F.max("hit").alias("best")).crossJoin(t.lineitem.agg(F.countDistinct("l_suppkey").alias("suppliers")))
    return f.crossJoin(F.broadcast(top)).select("family", F.round(1 - F.col("hit"), 9).alias("coverage_loss"), F.round(F.col("best") - F.col("hit"), 9).alias("gap_to_best"), "suppliers")
