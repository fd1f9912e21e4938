"""Slates of order lines: price is the score, returned lines are the positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import ranking as R
from slatewise.registry import Tables, query

_TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ORDER = "l_extendedprice DESC, " + ", ".join(_TIE)
_RANKED = f"""ranked AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r FROM lineitem)"""
_SLATES = f"""{_RANKED}, slates AS (
  SELECT l_orderkey, max(CASE WHEN label = 1 AND r <= 1 THEN 1 ELSE 0 END) AS hit1, max(CASE WHEN label = 1 AND r <= 3 THEN 1 ELSE 0 END) AS hit3,
    max(CASE WHEN label = 1 AND r <= 5 THEN 1 ELSE 0 END) AS hit5, max(CASE WHEN label = 1 AND r <= 10 THEN 1 ELSE 0 END) AS hit10,
    max(label) AS covered, coalesce(1.0 / min(CASE WHEN label = 1 THEN r END), 0) AS rr,
    coalesce(sum(CASE WHEN label = 1 AND r <= 10 THEN 1.0 / log2(r + 1) END) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(sum(label), 10)::BIGINT + 1) t(i)), 0) AS ndcg10
  FROM ranked GROUP BY l_orderkey)"""


def _order() -> list:
    return [F.col("l_extendedprice").desc(), *map(F.col, _TIE)]


def _candidates(t: Tables) -> DataFrame:
    return R.ranked(t.lineitem.withColumn("label", (F.col("l_returnflag") == "R").cast("int")), "l_orderkey", _order())


_IDEAL = "CASE least(sum(label), 10) " + " ".join(f"WHEN {n} THEN {sum(1.0 / __import__('math').log2(i + 1) for i in range(1, n + 1))!r}" for n in range(1, 11)) + " END"
_SLATES = _SLATES.replace("(SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(sum(label), 10)::BIGINT + 1) t(i))", _IDEAL)
_MEASURES = ["hit1", "hit3", "hit5", "hit10", "covered", "rr", "ndcg10"]


@query(f"WITH {_SLATES} SELECT count(*) AS n_queries, " + ", ".join(f"round(avg(coalesce(s.{m}, 0)::DOUBLE), 9) AS {m}" for m in _MEASURES) + " FROM orders o LEFT JOIN slates s ON s.l_orderkey = o.o_orderkey")
def slate_metrics_manifest(t: Tables) -> DataFrame:
    """W1 A19 A20 J17 A22."""
    slates = R.slate_hits(_candidates(t), "l_orderkey")
    out = R.over_manifest(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), slates, "l_orderkey", _MEASURES)
    return out.select("n_queries", *(F.round(m, 9).alias(m) for m in _MEASURES))


@query(f"WITH {_SLATES} SELECT l_orderkey, hit1::INT AS hit1, hit3::INT AS hit3, hit5::INT AS hit5, hit10::INT AS hit10, covered::INT AS covered, round(rr::DOUBLE, 9) AS rr, round(ndcg10::DOUBLE, 9) AS ndcg10 FROM slates")
def slate_metrics_per_query(t: Tables) -> DataFrame:
    """A19, A20 per slate."""
    return R.slate_hits(_candidates(t), "l_orderkey").withColumns({"rr": F.round("rr", 9), "ndcg10": F.round("ndcg10", 9)})


@query(f"""WITH {_RANKED}, first AS (SELECT l_orderkey, l_quantity AS a, l_discount * 500 AS b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS p FROM ranked WHERE label = 1) WHERE p = 1)
SELECT count(*) AS n, round(avg(abs(b - a)), 6) AS mae, round(avg((b - a) * (b - a)), 6) AS mse, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse,
  round(avg((abs(b - a) <= 5)::INT::DOUBLE), 6) AS within_5, round(avg((abs(b - a) <= 10)::INT::DOUBLE), 6) AS within_10, round(avg((abs(b - a) <= 20)::INT::DOUBLE), 6) AS within_20 FROM first""")
def slate_temperature_error(t: Tables) -> DataFrame:
    """A21 with quantity as reference and discount * 500 as prediction."""
    rows = _candidates(t).withColumn("predicted", F.col("l_discount") * 500)
    out = R.temperature_error(rows, "l_orderkey", "slate_rank", "label", "l_quantity", "predicted")
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns if c != "n"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, r AS slate_rank FROM (WITH {_RANKED} SELECT * FROM ranked) WHERE r <= 3")
def first_k_per_slate(t: Tables) -> DataFrame:
    """W5, T2, K6."""
    rows = R.first_k(t.lineitem, "l_orderkey", _order(), 3)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("slate_rank").cast("bigint").alias("slate_rank"))


@query(f"""WITH {_RANKED} SELECT l_orderkey, r AS slate_rank, round(1.0 - (r - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY l_orderkey) - 1, 1), 9) AS prior, -r::DOUBLE AS rank_score FROM ranked""")
def rank_prior(t: Tables) -> DataFrame:
    """W2 W7 W12."""
    rows = R.rank_prior(t.lineitem, "l_orderkey", _order())
    return rows.select("l_orderkey", F.col("slate_rank").cast("bigint").alias("slate_rank"), F.round("prior", 9).alias("prior"), "rank_score")


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""SELECT {_KEYS}, round((l_extendedprice - avg(l_extendedprice) OVER w) / coalesce(nullif(stddev_samp(l_extendedprice) OVER w, 0), 1), 5) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def zscore_fusion_sample(t: Tables) -> DataFrame:
    """W3."""
    return t.lineitem.select(*_KEYS.split(", "), F.round(R.z_sample(F.col("l_extendedprice"), "l_orderkey"), 5).alias("z"))


@query(f"""WITH z AS (SELECT {_KEYS}, stddev_pop(l_extendedprice) OVER w AS sp, stddev_pop(l_quantity) OVER w AS sq, l_extendedprice - avg(l_extendedprice) OVER w AS dp, l_quantity - avg(l_quantity) OVER w AS dq,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT {_KEYS}, round(CASE WHEN sp <= 1e-12 THEN 0 ELSE dp / sp END + 0.5 * CASE WHEN sq <= 1e-12 THEN 0 ELSE dq / sq END - 1e-9 * r, 5) AS fused FROM z""")
def zscore_fusion_pop(t: Tables) -> DataFrame:
    """Z + w * z with the rank as a tie-break of 1e-9."""
    rows = R.ranked(t.lineitem, "l_orderkey", _order())
    fused = R.z_population(F.col("l_extendedprice"), "l_orderkey") + 0.5 * R.z_population(F.col("l_quantity"), "l_orderkey") - 1e-9 * F.col("slate_rank")
    return rows.select(*_KEYS.split(", "), F.round(fused, 5).alias("fused"))


_GRID = "SELECT i / 20.0 AS w FROM range(0, 41) t(i)"


def _grid(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("label", (F.col("l_returnflag") == "R").cast("int")).select("l_orderkey", "label", *(c for c in ["l_extendedprice", *_TIE]))
    weights = t.spark.range(41).select((F.col("id") / 20.0).alias("w"))
    return R.weight_grid_hits(rows, "l_orderkey", F.col("l_quantity"), F.col("l_discount") * 100, weights, _order())


_GRID_SQL = f"""WITH grid AS (SELECT i / 20.0::DOUBLE AS w FROM range(0, 41) t(i)), spread AS (
  SELECT w, l_orderkey, (l_returnflag = 'R')::INT AS label, row_number() OVER (PARTITION BY w, l_orderkey ORDER BY l_quantity + w * (l_discount * 100) DESC, {_ORDER}) AS r FROM lineitem, grid),
per AS (SELECT w, l_orderkey, max((r <= 1 AND label = 1)::INT) AS hit1, max((r <= 10 AND label = 1)::INT) AS hit10 FROM spread GROUP BY ALL),
hits AS (SELECT w, sum(hit1)::BIGINT AS hit1, sum(hit10)::BIGINT AS hit10 FROM per GROUP BY w)"""


@query(_GRID_SQL + " SELECT w, hit1, hit10 FROM hits")
def fusion_weight_grid(t: Tables) -> DataFrame:
    """Q2 Q3 Q4: all weights in one job."""
    return _grid(t)


@query(_GRID_SQL + " SELECT * FROM (SELECT w, hit1, hit10 FROM hits ORDER BY hit10 DESC, hit1 DESC, w LIMIT 1)")
def route_weight_grid(t: Tables) -> DataFrame:
    """Q3 Q5: the best weight, the smaller one on a tie."""
    return R.best_weight(_grid(t), ["hit10", "hit1"], larger_on_tie=False)


@query(_GRID_SQL + " SELECT * FROM (SELECT w, hit1, hit10 FROM hits ORDER BY hit10 DESC, w DESC LIMIT 1)")
def coverage_weight_grid(t: Tables) -> DataFrame:
    """Q2: the best weight by coverage, the larger one on a tie."""
    return R.best_weight(_grid(t), ["hit10"], larger_on_tie=True)


@query("""WITH gold AS (SELECT sample_index, max(reaction_id) AS g FROM route_proposals GROUP BY sample_index),
p AS (SELECT sample_index, reaction_id AS pr, row_number() OVER (PARTITION BY sample_index ORDER BY retro_rank NULLS LAST, proposal_id) AS r FROM route_proposals),
per AS (SELECT g.sample_index, max(coalesce(g = pr AND r <= 1, false)::INT) AS recall1, max(coalesce(g = pr AND r <= 3, false)::INT) AS recall3, max(coalesce(g = pr AND r <= 5, false)::INT) AS recall5, max(coalesce(g = pr AND r <= 10, false)::INT) AS recall10
  FROM gold g LEFT JOIN p USING (sample_index) WHERE coalesce(g, '') <> '' GROUP BY g.sample_index)
SELECT count(*) AS n, round(avg(recall1::DOUBLE), 9) AS recall1, round(avg(recall3::DOUBLE), 9) AS recall3, round(avg(recall5::DOUBLE), 9) AS recall5, round(avg(recall10::DOUBLE), 9) AS recall10 FROM per""")
def recall_and_condition_at_k(t: Tables) -> DataFrame:
    """Gold key is the greatest reaction of the query."""
    gold = t.route_proposals.groupBy("sample_index").agg(F.max("reaction_id").alias("gold"))
    p = R.ranked(t.route_proposals, "sample_index", [F.col("retro_rank").asc_nulls_last(), F.col("proposal_id")])
    out = R.key_recall(gold, p.select("sample_index", F.col("reaction_id").alias("predicted"), "slate_rank"), "sample_index", "gold", "predicted", "slate_rank")
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns if c != "n"))


@query("""WITH s AS (SELECT prediction_id, sample_index, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM context_predictions)
SELECT prediction_id, round(s / coalesce(nullif(sum(s) OVER (PARTITION BY sample_index), 0), 1), 9) AS probability, count(*) OVER (PARTITION BY sample_index) AS group_size FROM s""")
def score_probability(t: Tables) -> DataFrame:
    """Scores as shares of their query."""
    from pyspark.sql import Window

    rows = t.context_predictions.withColumn("s", F.nanvl("score", F.lit(None).cast("double")))
    return rows.select("prediction_id", F.round(R.share_within(F.col("s"), "sample_index"), 9).alias("probability"), F.count("*").over(Window.partitionBy("sample_index")).alias("group_size"))
