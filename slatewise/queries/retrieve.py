"""Neighbors of embeddings and of parts; queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import vectors as V
from slatewise.operators import retrieve as R
from slatewise.registry import Tables, query

_COS = """n AS (SELECT p.vec_id AS query_id, q.vec_id AS neighbor_id, round(greatest(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))
  / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 7) AS similarity FROM embeddings p JOIN embeddings q ON p.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)"""


def top_cosine(t: Tables, k: int) -> DataFrame:
    return R.cosine_top_k(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", k)


@query(f"WITH {_COS} SELECT query_id, neighbor_id, similarity, r AS neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS r FROM n WHERE similarity > 0) WHERE r <= 64")
def knn_topk_cosine(t: Tables) -> DataFrame:
    """J8 W5 T3."""
    return top_cosine(t, 64).withColumn("neighbor_rank", F.col("neighbor_rank").cast("bigint"))


@query("""SELECT p.vec_id AS query_id, q.vec_id AS neighbor_id, round(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS dot FROM embeddings p JOIN embeddings q ON p.vec_id % 50 = 0""")
def knn_postings_equals_dense(t: Tables) -> DataFrame:
    """Through postings, the same as the dense product."""
    q = R.postings(t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    return R.sparse_dot(q, R.postings(t.embeddings, "vec_id", "embedding")).withColumn("dot", F.round("dot", 5))


_WORDS = "w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ')) AS token FROM part)"


@query(f"""WITH {_WORDS}, n AS (SELECT id, count(*) AS n FROM w GROUP BY id), b AS (SELECT q.id AS query_id, r.id AS neighbor_id, count(*) AS c FROM w q JOIN w r ON q.token = r.token AND q.id % 50 = 0 AND q.id <> r.id GROUP BY ALL),
s AS (SELECT query_id, neighbor_id, c / (x.n + y.n - c) AS similarity FROM b JOIN n x ON x.id = query_id JOIN n y ON y.id = neighbor_id)
SELECT query_id, neighbor_id, round(similarity, 9) AS similarity, r AS neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS r FROM s) WHERE r <= 10""")
def tanimoto_token_topk(t: Tables) -> DataFrame:
    """J10 J16."""
    words = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type")), " ")).alias("token"))
    out = R.token_tanimoto(words.filter("id % 50 = 0"), words, 10)
    return out.withColumns({"similarity": F.round("similarity", 9), "neighbor_rank": F.col("neighbor_rank").cast("bigint")})


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 5) AS unit_sum,
round(list_inner_product(e, list_reverse(e)) / list_inner_product(e, e), 5) AS reversed_cosine FROM v""")
def vector_scalar_suite(t: Tables) -> DataFrame:
    """F31 F32 P5."""
    e = V.as_doubles(F.col("embedding"))
    back = V.dot(V.unit(e), V.unit(F.reverse(e)))
    total = F.aggregate(V.unit(e), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.round(F.sqrt(V.dot(e, e)), 6).alias("norm"), F.round(total, 5).alias("unit_sum"), F.round(back, 5).alias("reversed_cosine"))


@query("""WITH b AS (SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0::HUGEINT END), lambda x, y: x + y) AS w FROM embeddings),
n AS (SELECT p.vec_id AS query_id, q.vec_id AS neighbor_id, round(CASE WHEN (p.w | q.w) = 0 THEN 0 ELSE bit_count(p.w & q.w) / bit_count(p.w | q.w) END, 9) AS similarity FROM b p JOIN b q ON p.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, neighbor_id, similarity, r AS neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS r FROM n WHERE similarity > 0) WHERE r <= 16""")
def tanimoto_bit_words(t: Tables) -> DataFrame:
    """Packed signs of the stated queries against all rows."""
    on = F.transform(F.filter(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"] > 0), lambda p: p["i"])
    rows = t.embeddings.select("vec_id", V.bit_words(on, 1).alias("w"))
    return R.tanimoto_top_k(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "w", 16).withColumn("neighbor_rank", F.col("neighbor_rank").cast("bigint"))
