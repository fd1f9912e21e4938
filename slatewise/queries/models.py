"""Closed forms with SQL twins; Spark ML models, which have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import models as M
from slatewise.registry import Tables, query


@query("""WITH f AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS feature FROM part), l AS (SELECT p_partkey AS id, p_brand AS label FROM part), n AS (SELECT label, count(*) AS n FROM l GROUP BY label), v AS (SELECT DISTINCT feature FROM f),
c AS (SELECT label, feature, count(*) AS c FROM l JOIN f USING (id) GROUP BY ALL), g AS (SELECT n.label, v.feature, (coalesce(c, 0) + 1.0::DOUBLE) / (n + 2) AS p, n FROM n CROSS JOIN v LEFT JOIN c ON c.label = n.label AND c.feature = v.feature),
b AS (SELECT label, sum(ln(1 - p)) + ln(any_value(n) / (SELECT count(*) FROM l)) AS base FROM g GROUP BY label), s AS (SELECT f.id, g.label, sum(ln(p) - ln(1 - p)) AS s FROM f JOIN g USING (feature) GROUP BY ALL)
SELECT l.id, b.label, round(base + coalesce(s.s, 0), 5) AS logit FROM l CROSS JOIN b LEFT JOIN s ON s.id = l.id AND s.label = b.label""")
def bernoulli_nb_logits(t: Tables) -> DataFrame:
    """Brands from the words of names."""
    features = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("feature")).distinct()
    labels = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return M.bernoulli_logits(M.bernoulli_fit(features, labels), features, labels).withColumn("logit", F.round("logit", 5))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, round(least(greatest(((SELECT sum(n) FROM n) - n) / n, 1), 20), 9)::DOUBLE AS weight FROM n")
def class_weights(t: Tables) -> DataFrame:
    """A29."""
    return M.class_weights(t.embeddings, "label").withColumn("weight", F.round("weight", 9))


@query("WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 5) AS l_quantity, round((l_discount - md) / sd, 5) AS l_discount FROM lineitem, s")
def standardize_columns(t: Tables) -> DataFrame:
    """A30 A37."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    out = M.standardized(rows, ["l_quantity", "l_discount"])
    return out.withColumns({c: F.round(c, 5) for c in ("l_quantity", "l_discount")})


@query("""WITH e AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey), d AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT n_nationkey AS id, n_regionkey::DOUBLE AS x FROM nation)
SELECT n.id, n.x, round(coalesce(m.v, 0), 9) AS mean_x FROM n LEFT JOIN (SELECT dst, avg(x) AS v FROM d JOIN n ON n.id = d.src GROUP BY dst) m ON m.dst = n.id""")
def graph_mean_aggregate(t: Tables) -> DataFrame:
    """L4: one step."""
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("double").alias("x"))
    edges = t.nation.filter("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return M.neighbor_mean(nodes, edges, ["x"]).withColumn("mean_x", F.round("mean_x", 9))


@query("""WITH x AS (SELECT l_orderkey, l_discount * 10 AS s, l_quantity AS r, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem), y AS (SELECT *, ln(sum(exp(s)) OVER (PARTITION BY l_orderkey ORDER BY r DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - s AS t FROM x)
SELECT l_orderkey, round(sum(t), 5) AS loss FROM y GROUP BY l_orderkey""")
def list_mle_loss(t: Tables) -> DataFrame:
    """L11."""
    rows = t.lineitem.withColumn("s", F.col("l_discount") * 10)
    return M.list_mle(rows, "l_orderkey", "s", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "s"]).withColumn("loss", F.round("loss", 5))


@query("""WITH x AS (SELECT l_orderkey, exp(l_discount * 10) AS s, exp(l_tax * 10) AS r FROM lineitem), y AS (SELECT l_orderkey, s / sum(s) OVER w AS s, r / sum(r) OVER w AS r FROM x WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, round(-sum(r * ln(s)), 5) AS loss FROM y GROUP BY l_orderkey""")
def list_net_loss(t: Tables) -> DataFrame:
    """L11."""
    rows = t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("r"))
    return M.list_net(rows, "l_orderkey", "s", "r").withColumn("loss", F.round("loss", 5))


@query()
def gbt_rank_rows(t: Tables) -> DataFrame:
    """L1: regression on relevance stands in for the ranking objective."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_returnflag") == "R", 3.0).otherwise(0.0).alias("relevance"))
    return M.boosted_scores(rows, rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "relevance", iterations=5).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")


@query()
def temperature_regression(t: Tables) -> DataFrame:
    """A forest on condition rows with a known temperature, clipped to the seen range."""
    none = F.lit(None).cast("double")
    rows = t.condition_rows.select("row_id", F.coalesce(F.nanvl("yield_value", none), F.lit(0.0)).alias("y"), F.length("product").cast("double").alias("n"), F.nanvl("temperature", none).alias("t")).filter("t <= 500 AND n IS NOT NULL")
    return M.boosted_scores(rows, rows, ["y", "n"], "t", forest=True).select("row_id", "prediction")


@query()
def kmeans_rows(t: Tables) -> DataFrame:
    """L7 J21."""
    return M.clustered(t.embeddings, F.col("embedding"), 8, 8).select("vec_id", F.col("cluster").cast("int").alias("cluster"))
