"""Cleaning of condition rows and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.functions import numbers as N
from slatewise.operators import cleaning as C
from slatewise.registry import Tables, query, sql_labels

_R, _S = sql_labels("reagent_norm"), sql_labels("solvent_norm")


@query(f"SELECT row_id FROM condition_rows WHERE len({_R}) <= 3 AND len({_S}) <= 2")
def complexity_cap(t: Tables) -> DataFrame:
    """F14 F2."""
    return C.within_complexity(t.condition_rows, {"reagent_norm": 3, "solvent_norm": 2}).select("row_id")


_EACH = f"e AS (SELECT row_id, family, 'r' AS cell, unnest({_R}) AS token FROM condition_rows UNION ALL SELECT row_id, family, 's', unnest({_S}) FROM condition_rows)"


@query(f"WITH {_EACH}, rare AS (SELECT cell, token FROM e GROUP BY ALL HAVING count(*) < 6) SELECT row_id FROM condition_rows WHERE row_id NOT IN (SELECT row_id FROM e JOIN rare USING (cell, token))")
def rare_label_filter(t: Tables) -> DataFrame:
    """F15, over all families."""
    return C.without_rare_labels(t.condition_rows, "row_id", ["reagent_norm", "solvent_norm"], 6).select("row_id")


@query(f"WITH {_EACH}, f AS (SELECT * FROM e WHERE family IS NOT NULL), rare AS (SELECT family, cell, token FROM f GROUP BY ALL HAVING count(*) < 6) SELECT row_id FROM condition_rows WHERE family IS NOT NULL AND row_id NOT IN (SELECT row_id FROM f JOIN rare USING (family, cell, token))")
def rare_label_filter_by_family(t: Tables) -> DataFrame:
    """F15, within families."""
    return C.without_rare_labels(t.condition_rows.filter("family IS NOT NULL"), "row_id", ["reagent_norm", "solvent_norm"], 6, "family").select("row_id")


@query(f"""WITH {_EACH}, role AS (SELECT token, sum((cell = 'r')::INT) * 2 > count(*) AS is_reagent FROM e GROUP BY token), d AS (SELECT DISTINCT row_id, token FROM e)
SELECT row_id, coalesce(string_agg(token, '; ' ORDER BY token) FILTER (is_reagent), '') AS reagent_norm, string_agg(token, '; ' ORDER BY token) FILTER (NOT is_reagent) AS solvent_norm FROM d JOIN role USING (token) GROUP BY row_id HAVING count(*) FILTER (NOT is_reagent) > 0""")
def role_reassign(t: Tables) -> DataFrame:
    """A9."""
    return C.reassigned(t.condition_rows, "row_id", "reagent_norm", "solvent_norm")


@query(f"""WITH e AS (SELECT row_id, unnest({_R}) AS spelling FROM condition_rows), g AS (SELECT lower(spelling) AS canonical, spelling, count(*) AS n, min(row_id) AS first FROM e GROUP BY ALL)
SELECT canonical, spelling, total AS n FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, first, spelling) AS r, sum(n) OVER (PARTITION BY canonical)::BIGINT AS total FROM g) WHERE r = 1""")
def mode_representative(t: Tables) -> DataFrame:
    """A10."""
    each = t.condition_rows.select("row_id", F.explode(L.label_tokens(F.col("reagent_norm"))).alias("spelling"))
    return C.representatives(each, F.lower("spelling"), "spelling", "row_id")


@query("SELECT user_id, event_type, event_id, row_number() OVER (ORDER BY event_id) - 1 AS sample_index FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def ordered_distinct_first(t: Tables) -> DataFrame:
    """First event of each kind, numbered in order; the number is made from a few distinct keys."""
    from pyspark.sql import Window

    first = C.first_of_each(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", (F.row_number().over(Window.orderBy("event_id")) - 1).cast("bigint").alias("sample_index"))


@query("""SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def classwise_split(t: Tables) -> DataFrame:
    """T9."""
    return C.classwise_split(t.documents.select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "split")


@query()
def key_hash_split(t: Tables) -> DataFrame:
    """The hash is Spark's, so there is no SQL twin; tests hold shares and togetherness."""
    return t.condition_records.select("record_id", C.hash_split(F.lower(F.trim("reaction_id")), [("train", 0.8), ("val", 0.1), ("test", 0.1)]).alias("split"))


@query("""WITH x AS (SELECT row_id, list_filter([CASE WHEN reactants IS NULL OR trim(reactants, ' ') = '' THEN 'no_reactants' END, CASE WHEN yield_value < 25 THEN 'low_yield' END, CASE WHEN family IS NULL THEN 'no_family' END], lambda r: r IS NOT NULL) AS reasons, product FROM condition_rows),
k AS (SELECT product, min(row_id) AS first FROM x WHERE len(reasons) = 0 GROUP BY product)
SELECT row_id, array_to_string(CASE WHEN row_id > k.first THEN list_append(reasons, 'duplicate') ELSE reasons END, ',') AS reasons FROM x LEFT JOIN k USING (product) WHERE len(reasons) > 0 OR row_id > k.first""")
def exclusion_reasons(t: Tables) -> DataFrame:
    """All reasons of each excluded row."""
    reasons = {"no_reactants": F.col("reactants").isNull() | (F.trim("reactants") == ""), "low_yield": F.col("yield_value") < 25, "no_family": F.col("family").isNull()}
    out = C.exclusions(t.condition_rows, reasons, F.col("product"), "row_id").filter(F.size("reasons") > 0)
    return out.select("row_id", F.array_join("reasons", ",").alias("reasons"))


_WORDS = "('nan', 'none', 'not given', 'unknown', '-')"
_PRESENT = "CASE WHEN {0} <> '' AND lower(trim({0}, ' ')) NOT IN " + _WORDS + " THEN {0} END"


@query(f"""SELECT row_id, CASE WHEN isnan(temperature) OR temperature > 500 THEN NULL ELSE temperature END AS temperature, coalesce(lower(trim(reagent_norm, ' ')) IN {_WORDS}, true) AS reagent_missing,
nullif(concat_ws('; ', {_PRESENT.format('reagent_norm')}, {_PRESENT.format('solvent_norm')}), '') AS merged FROM condition_rows""")
def null_and_sentinel_rules(t: Tables) -> DataFrame:
    """The empty text is no sentinel."""
    return t.condition_rows.select("row_id", N.sane_temperature(F.col("temperature")).alias("temperature"), L.is_missing(F.col("reagent_norm")).alias("reagent_missing"), L.merge_cells(F.col("reagent_norm"), F.col("solvent_norm")).alias("merged"))


@query("SELECT count(*) FILTER (NOT contains(text, 'Copied from page')) + count(*) FILTER (text IS NULL) AS kept, count(*) FILTER (length(trim(text, ' ')) > 0 AND length(trim(lang, ' ')) > 0) AS paired, count(*) FILTER (n_chars IS NULL OR n_chars >= 200) AS confident FROM documents")
def filter_suite(t: Tables) -> DataFrame:
    """F10 F19 F20."""
    d = t.documents
    kept = C.without_footer(d, "text", ["Copied from page"]).agg(F.count("*").alias("kept"))
    paired = C.nonempty_pairs(d, "text", "lang")[0].agg(F.count("*").alias("paired"))
    sure = C.confident(d.withColumn("x", F.col("n_chars").cast("double")), "x", 200).agg(F.count("*").alias("confident"))
    return kept.crossJoin(paired).crossJoin(sure)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)")
def semi_join_subset(t: Tables) -> DataFrame:
    """F17 F23."""
    wanted = t.lineitem.filter("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH held AS (SELECT DISTINCT reaction_id FROM condition_rows WHERE reaction_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY reaction_id ORDER BY record_id) AS n FROM condition_records WHERE reaction_id IS NOT NULL AND reaction_id NOT IN (SELECT reaction_id FROM held))
SELECT record_id, reaction_id FROM r WHERE n = 1""")
def recovered_rows(t: Tables) -> DataFrame:
    """First record of each reaction that the rows do not hold."""
    rest = t.condition_records.filter("reaction_id IS NOT NULL").join(t.condition_rows.select("reaction_id"), "reaction_id", "left_anti")
    return C.first_of_each(rest, ["reaction_id"], ["record_id"]).select("record_id", "reaction_id")
