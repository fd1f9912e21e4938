"""Condition rows as the library; order lines where a large table is wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.functions import numbers as N
from slatewise.operators import memory as M
from slatewise.registry import Tables, query, sql_labels



def _norm(cell: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({sql_labels(cell)})), '; '), '')"


_ROWS = f"""rows AS (SELECT row_id, reaction_id, family, product, CASE WHEN isnan(yield_value) THEN NULL ELSE yield_value END AS y, CASE WHEN isnan(temperature) THEN NULL ELSE temperature END AS t,
  {_norm('reagent_norm')} AS reagent_norm, {_norm('solvent_norm')} AS solvent_norm FROM condition_rows)"""
_C = ["reagent_norm", "solvent_norm"]


def _rows(t: Tables) -> DataFrame:
    return M.normalized_context(t.condition_rows, L.normalize_labels, *_C)


@query(f"WITH {_ROWS} SELECT row_id, reagent_norm, solvent_norm FROM rows")
def label_normalize(t: Tables) -> DataFrame:
    """F1."""
    return _rows(t).select("row_id", *_C)


@query(f"WITH {_ROWS} SELECT reagent_norm, solvent_norm, count(*) AS context_count, round(coalesce(avg(y), 0), 6) AS mean_yield, round(count(*) / (SELECT count(*) FROM rows), 9) AS support FROM rows GROUP BY ALL")
def context_library(t: Tables) -> DataFrame:
    """A4 A32 W10."""
    return M.context_library(_rows(t), _C, "yield_value").select(*_C, "context_count", F.round("mean_yield", 6).alias("mean_yield"), F.round("support", 9).alias("support"))


@query(f"WITH {_ROWS} SELECT * FROM (SELECT reagent_norm, solvent_norm, count(*) AS context_count FROM rows GROUP BY ALL ORDER BY context_count DESC, reagent_norm, solvent_norm LIMIT 20)")
def frequent_contexts(t: Tables) -> DataFrame:
    """The feature is the first 20."""
    return M.most_frequent(M.context_library(_rows(t), _C, "yield_value"), _C, 20).select(*_C, "context_count")


@query(f"WITH {_ROWS} SELECT product, reagent_norm, solvent_norm, count(*) AS n, round(avg(y), 6) AS mean_yield, round(avg(t), 6) AS mean_temperature, round(stddev_pop(t), 5) AS sd_temperature FROM rows GROUP BY ALL")
def product_memory_stats(t: Tables) -> DataFrame:
    """A1 A3."""
    out = M.group_memory(_rows(t), ["product", *_C], "yield_value", "temperature")
    return out.withColumns({"mean_yield": F.round("mean_yield", 6), "mean_temperature": F.round("mean_temperature", 6), "sd_temperature": F.round("sd_temperature", 5)})


@query(f"""SELECT product_scaffold, count(*) AS n, round(avg(CASE WHEN isnan(yield_value) THEN NULL ELSE yield_value END), 6) AS mean_yield, round(avg(CASE WHEN isnan(temperature) THEN NULL ELSE temperature END), 6) AS mean_temperature,
  round(stddev_pop(CASE WHEN isnan(temperature) THEN NULL ELSE temperature END), 5) AS sd_temperature FROM system_records WHERE coalesce(product_scaffold, '') <> '' GROUP BY ALL""")
def scaffold_memory_stats(t: Tables) -> DataFrame:
    """A2: empty scaffolds left out."""
    out = M.group_memory(t.system_records.filter(F.coalesce("product_scaffold", F.lit("")) != ""), ["product_scaffold"], "yield_value", "temperature")
    return out.withColumns({"mean_yield": F.round("mean_yield", 6), "mean_temperature": F.round("mean_temperature", 6), "sd_temperature": F.round("sd_temperature", 5)})


@query(f"""WITH {_ROWS}, own AS (SELECT reaction_id, reagent_norm, solvent_norm, count(*) AS own FROM rows WHERE reaction_id IS NOT NULL GROUP BY ALL), c AS (SELECT reagent_norm, solvent_norm, sum(own) AS n FROM own GROUP BY ALL),
g AS (SELECT reaction_id, sum(own) AS n FROM own GROUP BY ALL)
SELECT own.reaction_id, own.reagent_norm, own.solvent_norm, (c.n - own.own)::BIGINT AS context_count, round((c.n - own.own) / greatest((SELECT sum(own) FROM own) - g.n, 1), 9) AS support
FROM own JOIN c ON c.reagent_norm = own.reagent_norm AND c.solvent_norm = own.solvent_norm JOIN g ON g.reaction_id = own.reaction_id WHERE c.n - own.own > 0""")
def leave_one_out_support(t: Tables) -> DataFrame:
    """J11 V6."""
    rows = _rows(t).filter("reaction_id IS NOT NULL")
    out = M.leave_one_out(rows, ["reaction_id"], _C, "yield_value").withColumn("support", F.round("support", 9))
    return out.select("reaction_id", *_C, "context_count", "support")


_TOKENS = f"unnest({sql_labels('reagent_norm')})"


@query(f"WITH x AS (SELECT {_TOKENS} AS token FROM condition_rows), f AS (SELECT token, count(*) AS n FROM x GROUP BY token) SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) - 1)::BIGINT AS token_index FROM f")
def token_frequency(t: Tables) -> DataFrame:
    """A8 W8 D16 K4."""
    return M.vocabulary(M.token_frequency(t.condition_rows, "reagent_norm")).withColumn("token_index", F.col("token_index").cast("bigint"))


@query(f"WITH x AS (SELECT reaction_id, {_TOKENS} AS token FROM condition_rows) SELECT reaction_id, array_to_string(list_sort(list(DISTINCT token)), '; ') AS tokens FROM x GROUP BY reaction_id")
def token_union_per_group(t: Tables) -> DataFrame:
    """A7 K2."""
    return M.union_per_group(t.condition_rows, "reaction_id", "reagent_norm")


@query(f"""WITH x AS (SELECT reaction_id, row_id, {_TOKENS} AS token, generate_subscripts({sql_labels('reagent_norm')}, 1) AS pos FROM condition_rows),
f AS (SELECT reaction_id, token, min((row_id, pos)) AS place FROM x GROUP BY ALL) SELECT reaction_id, string_agg(token, '; ' ORDER BY place) AS tokens FROM f GROUP BY reaction_id""")
def token_union_in_order(t: Tables) -> DataFrame:
    """A11 F5."""
    return M.ordered_union(t.condition_rows, "reaction_id", "reagent_norm", "row_id")


@query(f"WITH {_ROWS} SELECT family, reagent_norm, solvent_norm, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY family), 9) AS support FROM rows GROUP BY family, reagent_norm, solvent_norm")
def cluster_context_support(t: Tables) -> DataFrame:
    """Contexts within a family."""
    return M.cluster_contexts(_rows(t), "family", _C).withColumn("support", F.round("support", 9))


@query("""WITH n AS (SELECT p.vec_id AS a, q.vec_id AS b, round(greatest(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 7) AS s
  FROM embeddings p JOIN embeddings q ON p.vec_id % 50 = 0 AND p.vec_id <> q.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM n WHERE s > 0) WHERE r <= 16)
SELECT k.a AS query_id, e.label, round(sum(s), 5) AS similarity_sum, round(max(s), 5) AS similarity_max, count(*) AS neighbor_count, round(sum(s * (b % 100)) / sum(s), 4) AS weighted_yield FROM k JOIN embeddings e ON e.vec_id = k.b GROUP BY k.a, e.label""")
def knn_context_aggregate(t: Tables) -> DataFrame:
    """The label of a neighbor is its context; its id modulo 100 stands for a yield."""
    from slatewise.queries.retrieve import top_cosine

    rows = t.embeddings.select(F.col("vec_id").alias("neighbor_id"), "label", (F.col("vec_id") % 100).cast("double").alias("y"))
    out = M.neighbor_contexts(top_cosine(t, 16), rows, "query_id", "neighbor_id", "similarity", ["label"], "y")
    return out.withColumns({"similarity_sum": F.round("similarity_sum", 5), "similarity_max": F.round("similarity_max", 5), "weighted_yield": F.round("weighted_yield", 4)})


@query(f"""WITH {_ROWS}, top AS (SELECT reagent_norm, solvent_norm FROM (SELECT reagent_norm, solvent_norm, count(*) AS n FROM rows GROUP BY ALL ORDER BY n DESC, reagent_norm, solvent_norm LIMIT 5)), q AS (SELECT DISTINCT sample_index FROM route_proposals),
f AS (SELECT DISTINCT sample_index, coalesce(reagent_norm, '') AS reagent_norm, coalesce(solvent_norm, '') AS solvent_norm FROM context_predictions WHERE max_similarity > 0 AND NOT isnan(max_similarity))
SELECT sample_index, reagent_norm, solvent_norm, false AS is_fallback FROM f UNION ALL SELECT q.sample_index, top.reagent_norm, top.solvent_norm, true FROM q, top WHERE q.sample_index NOT IN (SELECT sample_index FROM f WHERE sample_index IS NOT NULL)""")
def fallback_union(t: Tables) -> DataFrame:
    """Q7: queries without a similar context get the five most frequent ones."""
    found = t.context_predictions.filter("max_similarity > 0 AND NOT isnan(max_similarity)").select("sample_index", *(F.coalesce(c, F.lit("")).alias(c) for c in _C)).distinct()
    top = M.most_frequent(M.context_library(_rows(t), _C, "yield_value"), _C, 5)
    return M.with_fallback(t.route_proposals.select("sample_index").distinct(), found, top, "sample_index", _C)


@query(f"""WITH r AS (SELECT row_id, unnest(list_distinct({sql_labels('solvent_norm')})) AS token FROM condition_rows),
c AS (SELECT ref_id, label_name AS token FROM label_reference WHERE label_role = 'solvent')
SELECT c.ref_id, round(count(DISTINCT r.row_id) / (SELECT count(*) FROM condition_rows), 9) AS support FROM c LEFT JOIN r ON r.token = c.token GROUP BY c.ref_id""")
def token_overlap_support(t: Tables) -> DataFrame:
    """Share of rows that meet each solvent of the list."""
    wanted = t.label_reference.filter("label_role = 'solvent'").select("ref_id", F.col("label_name").alias("solvent_norm"))
    return M.overlap_support(t.condition_rows.select("row_id", "solvent_norm"), wanted, "row_id", "ref_id", "solvent_norm").withColumn("support", F.round("support", 9))


@query(f"""WITH y AS (SELECT row_id, {_TOKENS} AS token FROM condition_rows), f AS (SELECT token, ln(1 + count(*)) AS weight FROM y GROUP BY token), x AS (SELECT DISTINCT row_id, token FROM y),
s AS (SELECT x.row_id, avg(coalesce(f.weight, -12)) AS score FROM x LEFT JOIN f USING (token) GROUP BY x.row_id) SELECT r.row_id, round(coalesce(s.score, 0), 6) AS score FROM condition_rows r LEFT JOIN s USING (row_id)""")
def context_scores(t: Tables) -> DataFrame:
    """Mean log prior of a row's distinct labels."""
    weights = M.token_frequency(t.condition_rows, "reagent_norm").select("token", N.log_prior(F.col("n")).alias("weight"))
    return M.mean_prior(t.condition_rows, "row_id", "reagent_norm", weights, -12.0).withColumn("score", F.round("score", 6))
