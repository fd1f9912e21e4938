"""Leave-one-out evidence, precedents, family contexts and resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.operators import cleaning as C
from slatewise.operators import features as X
from slatewise.operators import memory as M
from slatewise.operators import rollup as U
from slatewise.operators import sequences as S
from slatewise.queries.memory import _C, _ROWS, _rows
from slatewise.registry import Tables, query, sql_labels

_NEIGHBORS = """n AS (SELECT p.vec_id AS a, q.vec_id AS b, p.label AS own, q.label AS other,
  round(greatest(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))
    / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 7) AS s
  FROM embeddings p JOIN embeddings q ON p.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM n WHERE s > 0) WHERE r <= 16)"""


@query(f"""WITH {_ROWS}, keyed AS (SELECT r.*, c.reactants FROM rows r JOIN condition_rows c USING (row_id)),
own AS (SELECT reactants, product, reagent_norm, solvent_norm, count(*) AS own, coalesce(sum(y), 0) AS s, count(y) AS n FROM keyed GROUP BY ALL),
c AS (SELECT reagent_norm, solvent_norm, sum(own) AS own, sum(s) AS s, sum(n) AS n FROM own GROUP BY ALL), g AS (SELECT reactants, product, sum(own) AS own FROM own GROUP BY ALL)
SELECT own.reactants, own.product, own.reagent_norm, own.solvent_norm, (c.own - own.own)::BIGINT AS context_count,
  round((c.own - own.own) / greatest((SELECT count(*) FROM rows) - g.own, 1), 9) AS support,
  round(CASE WHEN c.n > own.n THEN (c.s - own.s) / (c.n - own.n) ELSE 0 END, 5) AS mean_yield, greatest((SELECT count(*) FROM rows) - g.own, 1)::BIGINT AS remaining
FROM own JOIN c ON c.reagent_norm = own.reagent_norm AND c.solvent_norm = own.solvent_norm
JOIN g ON g.reactants IS NOT DISTINCT FROM own.reactants AND g.product IS NOT DISTINCT FROM own.product WHERE c.own > own.own""")
def leave_one_reaction_out(t: Tables) -> DataFrame:
    """Contexts without the rows of the same reactants and product, with support and mean yield."""
    out = M.leave_one_out(_rows(t), ["reactants", "product"], _C, "yield_value")
    return out.withColumns({"support": F.round("support", 9), "mean_yield": F.round("mean_yield", 5)})


@query(f"""WITH {_NEIGHBORS} SELECT a AS query_id, other AS label, round(sum(s), 5) AS similarity_sum, round(max(s), 5) AS similarity_max, count(*) AS neighbor_count,
  round(sum(s * (b % 100)) / sum(s), 4) AS weighted_yield FROM k WHERE own IS DISTINCT FROM other GROUP BY a, other""")
def leave_one_out_neighbors(t: Tables) -> DataFrame:
    """Neighbors of the query's own group (its label) are removed before their contexts are added up."""
    from slatewise.queries.retrieve import top_cosine

    left = M.without_own_group(top_cosine(t, 16), t.embeddings, "query_id", "neighbor_id", "vec_id", "label")
    rows = t.embeddings.select(F.col("vec_id").alias("neighbor_id"), "label", (F.col("vec_id") % 100).cast("double").alias("y"))
    out = M.neighbor_contexts(left, rows, "query_id", "neighbor_id", "similarity", ["label"], "y")
    return out.withColumns({"similarity_sum": F.round("similarity_sum", 5), "similarity_max": F.round("similarity_max", 5), "weighted_yield": F.round("weighted_yield", 4)})


@query(f"""WITH {_NEIGHBORS}, m AS (SELECT l_partkey AS b, l_returnflag, l_linestatus, count(*) AS n, avg(CASE WHEN l_quantity > 5 THEN l_discount END) AS y, avg(CASE WHEN l_linenumber <> 1 THEN l_tax END) AS t FROM lineitem GROUP BY ALL),
j AS (SELECT k.a, l_returnflag, l_linestatus, s, m.n, s * m.n AS w, y, t FROM k JOIN m USING (b))
SELECT a AS query_id, l_returnflag, l_linestatus, round(sum(s), 5) AS similarity_sum, round(sum(w), 4) AS weighted_support, round(max(s), 5) AS similarity_max, count(*) AS neighbor_count,
  round(sum(w * y) / sum(w) FILTER (y IS NOT NULL), 6) AS mean_yield, round(sum(w * t) / sum(w) FILTER (t IS NOT NULL), 6) AS mean_temperature FROM j GROUP BY a, l_returnflag, l_linestatus""")
def knn_precedents(t: Tables) -> DataFrame:
    """Part keys stand for neighboring products, their order lines for precedents."""
    from slatewise.queries.retrieve import top_cosine

    lines = t.lineitem.select(
        F.col("l_partkey").alias("neighbor_id"), "l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 5, F.col("l_discount")).alias("y"), F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("t")
    )
    memory = M.group_memory(lines, ["neighbor_id", "l_returnflag", "l_linestatus"], "y", "t")
    out = M.neighbor_precedents(top_cosine(t, 16), memory, "query_id", "neighbor_id", "similarity", ["l_returnflag", "l_linestatus"])
    places = {"similarity_sum": 5, "weighted_support": 4, "similarity_max": 5, "mean_yield": 6, "mean_temperature": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"""WITH {_ROWS} SELECT family, reagent_norm, solvent_norm, count(*) AS n, round(avg(t), 6) AS mean_temperature,
  round(count(*) / sum(count(*)) OVER (PARTITION BY family), 9) AS support FROM rows GROUP BY family, reagent_norm, solvent_norm""")
def family_contexts(t: Tables) -> DataFrame:
    """Contexts of each family with their mean temperature."""
    out = M.cluster_contexts(_rows(t), "family", _C, "temperature")
    return out.withColumns({"support": F.round("support", 9), "mean_temperature": F.round("mean_temperature", 6)})


@query("""WITH c AS (SELECT o_orderpriority AS family, o_custkey, sum((o_totalprice > 150000)::INT) AS a, sum((o_orderstatus = 'F')::INT) AS b, count(*) AS n FROM orders GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY o_custkey) - 1 AS place, count(*) OVER (PARTITION BY family) AS m FROM c),
p AS (SELECT family, draw, ('0x' || substr(md5(family || ':' || draw || ':' || place), 1, 8))::BIGINT % m AS place FROM z, range(1, 51) r(draw)),
d AS (SELECT p.draw, p.family, sum(a) / sum(n) AS a, sum(b) / sum(n) AS b FROM p JOIN z ON z.family = p.family AND z.place = p.place GROUP BY ALL),
f AS (SELECT draw, avg(a) AS a, avg(b) AS b FROM d GROUP BY draw),
v AS (SELECT 'a' AS system, a AS value, 0.0::DOUBLE AS delta FROM f UNION ALL SELECT 'b', b, b - a FROM f)
SELECT system, round(avg(value), 9) AS mean, round(avg(delta), 9) AS mean_delta, round(quantile_cont(value, 0.025), 9) AS value_low, round(quantile_cont(value, 0.975), 9) AS value_high,
  round(quantile_cont(delta, 0.025), 9) AS delta_low, round(quantile_cont(delta, 0.975), 9) AS delta_high, count(*) AS draws FROM v GROUP BY system""")
def bootstrap_macro(t: Tables) -> DataFrame:
    """Customers are resampled within each order priority, two systems see the same picks."""
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count_if(F.col("o_totalprice") > 150000).alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"), F.count("*").alias("n"))
    out = U.bootstrap_macro(per, "o_orderpriority", "o_custkey", {"a": "a", "b": "b"}, "n", 50)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("system", "draws")})


@query(f"""WITH f AS (SELECT family, CASE WHEN isnan(yield_value) OR yield_value IS NULL THEN 'none' WHEN yield_value < 50 THEN 'low' ELSE 'high' END AS category FROM condition_rows),
n AS (SELECT DISTINCT family FROM f UNION ALL SELECT 'ALL-FAMILIES'), k AS (SELECT unnest(['none', 'low', 'high', 'never']) AS category)
SELECT n.family, k.category, count(f.category) AS n FROM n CROSS JOIN k LEFT JOIN f ON f.category = k.category AND (n.family = 'ALL-FAMILIES' OR f.family IS NOT DISTINCT FROM n.family) GROUP BY ALL""")
def family_categories(t: Tables) -> DataFrame:
    """With the rows of no family as a family of their own."""
    y = F.nanvl("yield_value", F.lit(None).cast("double"))
    rows = t.condition_rows.select("family", F.when(y.isNull(), "none").when(y < 50, "low").otherwise("high").alias("category"))
    return U.category_counts(rows, "family", "category", ["none", "low", "high", "never"])


@query(f"""SELECT row_id FROM condition_rows WHERE coalesce(reactants, '') <> '' AND coalesce(product, '') <> '' AND NOT isnan(yield_value) AND yield_value >= 25 AND len({sql_labels('solvent_norm')}) > 0""")
def valid_entries(t: Tables) -> DataFrame:
    """text on both sides stands for parseable molecules."""
    sides = (F.coalesce("reactants", F.lit("")) != "") & (F.coalesce("product", F.lit("")) != "")
    return C.valid_entries(t.condition_rows, sides, "yield_value", "solvent_norm").select("row_id")


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(8)) + " FROM embeddings")
def descriptor_columns(t: Tables) -> DataFrame:
    """P5: eight elements of a vector as columns."""
    return X.descriptor_columns(t.embeddings, ["vec_id"], "embedding", [f"d{i}" for i in range(8)])


@query("""SELECT row_id, coalesce(reagent_norm, '') || ' ||| ' || coalesce(solvent_norm, '') AS context, string_split(coalesce(reagent_norm, '') || ' ||| ' || coalesce(solvent_norm, ''), ' ||| ')[1] AS first,
  string_split(coalesce(reagent_norm, '') || ' ||| ' || coalesce(solvent_norm, ''), ' ||| ')[2] AS second FROM condition_rows""")
def composite_keys(t: Tables) -> DataFrame:
    """Contexts as one text and back."""
    key = S.composite_key(F.col("reagent_norm"), F.col("solvent_norm"))
    parts = t.condition_rows.select("row_id", key.alias("context"))
    return parts.select("row_id", "context", F.get(S.key_parts(F.col("context")), F.lit(0)).alias("first"), F.get(S.key_parts(F.col("context")), F.lit(1)).alias("second"))


@query("""WITH m AS (SELECT raw, upper(raw) AS canonical FROM (SELECT DISTINCT unnest(string_split(reactants, '.')) AS raw FROM condition_records) WHERE raw <> ''),
a AS (SELECT record_id, unnest(string_split(coalesce(reactants, ''), '.')) AS raw FROM condition_records), b AS (SELECT record_id, unnest(string_split(coalesce(product, ''), '.')) AS raw FROM condition_records),
s AS (SELECT record_id, CASE WHEN bool_and(canonical IS NOT NULL) THEN string_agg(canonical, '.' ORDER BY canonical) ELSE '' END AS k FROM a LEFT JOIN m USING (raw) GROUP BY record_id),
p AS (SELECT record_id, CASE WHEN bool_and(canonical IS NOT NULL) THEN string_agg(canonical, '.' ORDER BY canonical) ELSE '' END AS k FROM b LEFT JOIN m USING (raw) GROUP BY record_id)
SELECT record_id, s.k AS side_key, CASE WHEN s.k <> '' AND p.k <> '' THEN s.k || '>>' || p.k ELSE '' END AS reaction_key FROM s JOIN p USING (record_id)""")
def reaction_keys(t: Tables) -> DataFrame:
    """F8: keys of sides and reactions; the supplied table knows the components of reactants (in upper case, to tell them apart)."""
    raw = t.condition_records.select(F.explode(F.split("reactants", "[.]")).alias("raw")).filter("raw <> ''").distinct()
    return X.reaction_key(t.condition_records, "record_id", "reactants", "product", raw.withColumn("canonical", F.upper("raw")))


@query(rf"SELECT row_id, regexp_extract_all(product, '{L.MOLECULE_TOKEN}') AS tokens FROM condition_rows WHERE product IS NOT NULL")
def molecule_token_lists(t: Tables) -> DataFrame:
    """the tokens themselves."""
    return t.condition_rows.filter("product IS NOT NULL").select("row_id", L.molecule_tokens(F.col("product")).alias("tokens"))


_U = "((('0x' || substr(md5({0} || ':{1}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {_U.format('event_id', 3)}, event_id) AS r FROM events) WHERE r <= ceil((SELECT count(*) FROM events) * 0.3)")
def hashed_subsample(t: Tables) -> DataFrame:
    """Three tenths of the events; sampling is the feature."""
    return S.subsample(t.events.select("event_id"), "event_id", 0.3, 3)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY round(-ln({_U.format('doc_id', 1)}) / n_chars, 12), doc_id) AS r FROM documents WHERE n_chars > 0) WHERE r <= (SELECT count(*) // 5 FROM documents)")
def weighted_draw_once(t: Tables) -> DataFrame:
    """A fifth of the documents, weighted by length, without replacement."""
    order = F.round(-F.log(S.unit_hash(F.col("doc_id"), 1)) / F.col("n_chars"), 12)
    return S.first_by(t.documents.filter("n_chars > 0").select("doc_id", "n_chars"), order, "doc_id", t.documents.count() // 5).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS drawn FROM (SELECT doc_id, {_U.format('doc_id', 0)} AS u FROM documents)")
def source_by_hash(t: Tables) -> DataFrame:
    """A source by probability."""
    return t.documents.select("doc_id", S.source_of_draw(F.col("doc_id"), [("a", 0.5), ("b", 0.3), ("c", 0.2)]).alias("drawn"))
