"""Filters, names, augmentation, grids and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import cleaning as C
from slatewise.operators import memory as M
from slatewise.operators import models as ML
from slatewise.operators import pool as P
from slatewise.operators import ranking as R
from slatewise.operators import sequences as S
from slatewise.registry import Tables, query


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1")
def single_step_filter(t: Tables) -> DataFrame:
    """line number 1 stands for one step."""
    return C.single_step(t.lineitem, "l_linenumber").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT row_id, temperature FROM condition_rows WHERE yield_value > 50 AND NOT isnan(yield_value) AND temperature IS NOT NULL AND NOT isnan(temperature)")
def positive_temperature_rows(t: Tables) -> DataFrame:
    """F16: a yield above one half is a positive."""
    rows = t.condition_rows.withColumn("label", F.nanvl("yield_value", F.lit(0.0)) / 100)
    return C.positive_temperatures(rows, "label", "temperature").select("row_id", "temperature")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY ALL HAVING max(abs(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END)) > 0)")
def reported_families(t: Tables) -> DataFrame:
    """a segment whose measures are all zero is not reported."""
    rows = t.customer.withColumn("m", F.when(F.col("c_mktsegment") == "BUILDING", 0.0).otherwise(F.col("c_acctbal")))
    return C.reported_families(rows, "c_mktsegment", ["m"]).select("c_custkey", "c_mktsegment")


@query("SELECT proposal_id FROM route_proposals WHERE sample_index < 50")
def route_prefix(t: Tables) -> DataFrame:
    """The feature is a limit on the number of the query."""
    return C.route_prefix(t.route_proposals, "sample_index", 50).select("proposal_id")


@query("""WITH n AS (SELECT lower(label_name) AS name, label_token AS token, 1.0 AS s, 2 AS p FROM label_reference UNION ALL SELECT lower(short_name), label_token, 1.0, 1 FROM label_reference WHERE short_name IS NOT NULL UNION ALL SELECT lower(label_name), 'X', 0.5, 0 FROM label_reference),
b AS (SELECT name, token FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, p, token) AS r FROM n) WHERE r = 1) SELECT name, token FROM b WHERE name <> 'water' UNION ALL SELECT 'water', 'fixed'""")
def name_priority_merge(t: Tables) -> DataFrame:
    """Names from three sources, one override."""
    ref = t.label_reference
    rows = ref.select(F.col("label_name").alias("n"), F.col("label_token").alias("k"), F.lit(1.0).alias("s"), F.lit(2).alias("p")).unionByName(
        ref.filter("short_name IS NOT NULL").select(F.col("short_name").alias("n"), F.col("label_token").alias("k"), F.lit(1.0).alias("s"), F.lit(1).alias("p"))
    )
    rows = rows.unionByName(ref.select(F.col("label_name").alias("n"), F.lit("X").alias("k"), F.lit(0.5).alias("s"), F.lit(0).alias("p")))
    return C.merged_names(rows, "n", "k", "s", "p", t.spark.createDataFrame([("Water", "fixed")], "n string, k string"))


@query("SELECT record_id, coalesce(product IN (SELECT product FROM condition_rows WHERE yield_value > 50), false) AS product_valid FROM condition_records")
def valid_sides(t: Tables) -> DataFrame:
    """validity from a supplied table."""
    molecules = t.condition_rows.select(F.col("product").alias("raw"), (F.col("yield_value") > 50).alias("is_valid"))
    return C.valid_sides(t.condition_records.select("record_id", "product"), {"product": "product_valid"}, molecules).select("record_id", "product_valid")


@query("SELECT row_id, (unnest(range(0, len(p))))::INT AS product_number, unnest(p) AS reactants FROM (SELECT row_id, list_filter(string_split(reactants, '.'), lambda x: x <> '') AS p FROM condition_rows)")
def multi_product_rows(t: Tables) -> DataFrame:
    """V2: one row per component."""
    return C.product_rows(t.condition_rows.select("row_id", "reactants"), "reactants")


@query("""WITH s AS (SELECT row_id, string_split(coalesce(reactants, ''), '.') AS p, CASE WHEN coalesce(reactants, '') = '' THEN 'no_reactants' WHEN coalesce(product, '') = '' THEN 'no_product' WHEN length(reactants) > 150 THEN 'long_reactants' WHEN length(product) > 150 THEN 'long_product' WHEN reactants = product THEN 'unchanged' ELSE 'ok' END AS status FROM condition_rows)
SELECT status, count(*) AS rows, sum(CASE WHEN status = 'ok' THEN least(len(p), 3) ELSE 0 END)::BIGINT AS variants FROM s GROUP BY status""")
def augmentation_status(t: Tables) -> DataFrame:
    """V1: rows and variants per status."""
    out = C.augmented(t.condition_rows.select("row_id", "reactants", "product"), "reactants", "product", 3, 150)
    return out.groupBy("status").agg(F.countDistinct("row_id").alias("rows"), F.count("source").alias("variants"))


@query("""SELECT prediction_id, round((max_similarity + support) / 2 + 0.05 * (support + 1) / 2 + CASE WHEN neighbor_count % 2 = 0 THEN 0.40 + 0.15 * support ELSE -0.60 END - 0.02 * (greatest(neighbor_count - 1, 0) + greatest(context_rank - 1, 0)), 9)::DOUBLE AS score FROM context_predictions
WHERE max_similarity IS NOT NULL AND NOT isnan(max_similarity) AND support IS NOT NULL AND NOT isnan(support)""")
def context_score_composed(t: Tables) -> DataFrame:
    """Q8: all parts, on stand-in columns."""
    c = F.col
    rows = t.context_predictions.filter("max_similarity IS NOT NULL AND NOT isnan(max_similarity) AND support IS NOT NULL AND NOT isnan(support)")
    score = P.composed_score(c("max_similarity"), c("support"), c("support"), F.lit(1.0), c("neighbor_count"), c("context_rank"), c("support"), c("neighbor_count") % 2 == 0)
    return rows.select("prediction_id", F.round(score, 9).alias("score"))


@query("""WITH g AS (SELECT i / 4.0::DOUBLE AS c, j / 20.0::DOUBLE AS w FROM range(0, 8) a(i), range(0, 41) b(j)), x AS (SELECT g.c, g.w, p_brand, (p_size % 7 = 0)::INT AS label, row_number() OVER (PARTITION BY g.c, g.w, p_brand
  ORDER BY p_retailprice / 1000 + g.w * (p_size / 50.0::DOUBLE + least(greatest(g.c * (p_partkey % 11 - 5) / 5.0::DOUBLE, -0.5), 0.5)) DESC, p_partkey) AS r FROM part, g)
SELECT c, w, sum(h1)::BIGINT AS hit1, sum(h10)::BIGINT AS hit10 FROM (SELECT c, w, p_brand, max((r = 1 AND label = 1)::INT) AS h1, max((r <= 10 AND label = 1)::INT) AS h10 FROM x GROUP BY ALL) GROUP BY c, w""")
def correction_weight_grid(t: Tables) -> DataFrame:
    """Q4: eight corrections by 41 fusion weights."""
    c = F.col
    rows = t.part.withColumn("label", (c("p_size") % 7 == 0).cast("int"))
    corrections, weights = t.spark.range(8).select((c("id") / 4.0).alias("c")), t.spark.range(41).select((c("id") / 20.0).alias("w"))
    return P.correction_grid_hits(rows, "p_brand", c("p_retailprice") / 1000, c("p_size") / F.lit(50.0), (c("p_partkey") % 11 - 5) / F.lit(5.0), corrections, weights, [c("p_partkey")])


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 8)::INT AS shard, floor((row_number() OVER (ORDER BY event_id) - 1) / 100)::BIGINT AS batch FROM events")
def shard_rows(t: Tables) -> DataFrame:
    """Dense positions without one task ordering all rows."""
    from slatewise.plans.running import running

    placed = running(t.events.select("event_id").withColumn("one", F.lit(0)), ["one"], ["event_id"], F.lit(1), "position")
    return placed.select("event_id", S.sharded(F.col("position"), 8).alias("shard"), S.grouped_batches(F.col("position"), 100).alias("batch"))


@query("SELECT 0 AS part, s_suppkey AS k, count(*) AS n FROM supplier, range(0, 3) GROUP BY ALL UNION ALL SELECT 1, n_nationkey, 1 FROM nation")
def concatenated_parts(t: Tables) -> DataFrame:
    """Suppliers three times, nations once."""
    a, b = t.supplier.select(F.col("s_suppkey").cast("bigint").alias("k")), t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"))
    return S.concatenated([(a, 3), (b, 1)]).groupBy("part", "k").agg(F.count("*").alias("n"))


@query()
def source_draws(t: Tables) -> DataFrame:
    """A source by probability from Spark's hash."""
    return t.documents.select("doc_id", S.source_of_draw(F.col("doc_id"), [("a", 0.5), ("b", 0.3), ("c", 0.2)]).alias("drawn"))


@query()
def cluster_lookup(t: Tables) -> DataFrame:
    """The labels of each vector's cluster; k-means starts from Spark's own seeds."""
    rows = ML.clustered(t.embeddings, F.col("embedding"), 8, 8).select("vec_id", "label", "cluster")
    return rows.select("vec_id", "cluster").join(M.cluster_contexts(rows, "cluster", ["label"]), "cluster")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def lexicographic_order(t: Tables) -> DataFrame:
    """Several keys with a full tie rule."""
    out = R.ranked(t.orders, "o_custkey", [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return out.select("o_orderkey", F.col("slate_rank").cast("bigint").alias("place"))
