"""Leakage and identity audits over documents, records and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.operators import audit as A
from slatewise.registry import Tables, query


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM subject_samples WHERE text IS NOT NULL)")
def anti_leakage(t: Tables) -> DataFrame:
    """Documents that are no labelled sample."""
    return t.documents.filter("text IS NOT NULL").join(t.subject_samples.select("text"), "text", "left_anti").select("doc_id")


_SETS = {"train": "split_name = 'train'", "val": "split_name = 'val'", "test": "split_name = 'test'"}


@query("""WITH k AS (SELECT DISTINCT split_name AS s, product_canonical AS key FROM system_records WHERE split_name IN ('train', 'val', 'test') AND product_canonical IS NOT NULL), n AS (SELECT * FROM (VALUES ('test', 'test'), ('test', 'train'), ('test', 'val'), ('train', 'train'), ('train', 'val'), ('val', 'val')) v(a, b))
SELECT n.a, n.b, count(x.key) AS n FROM n LEFT JOIN (SELECT p.s AS a, q.s AS b, p.key FROM k p JOIN k q ON p.key = q.key) x ON x.a = n.a AND x.b = n.b GROUP BY ALL""")
def overlap_counts(t: Tables) -> DataFrame:
    """Keys shared by splits."""
    return A.overlap_counts({n: t.system_records.filter(f) for n, f in _SETS.items()}, "product_canonical")


@query("""WITH a AS (SELECT reaction_id FROM condition_records WHERE record_id % 2 = 0), b AS (SELECT reaction_id FROM condition_records WHERE record_id % 3 = 0)
SELECT reaction_id, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT reaction_id, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def symmetric_difference(t: Tables) -> DataFrame:
    """As multisets."""
    r = t.condition_records
    return A.symmetric_difference(r.filter("record_id % 2 = 0").select("reaction_id"), r.filter("record_id % 3 = 0").select("reaction_id"))


@query("""SELECT count(*) AS n, sum(('0x' || substr(sha256('=' || l_orderkey || chr(31) || '=' || l_linenumber || chr(31) || '=' || l_partkey || chr(31) || '=' || l_returnflag), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM lineitem""")
def identity_fingerprint(t: Tables) -> DataFrame:
    """U6 F44."""
    return A.identity_digest(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query("""WITH a AS (SELECT l_orderkey, l_partkey, count(*) AS n_a FROM lineitem WHERE l_discount < 0.08 GROUP BY ALL), b AS (SELECT l_orderkey, l_partkey, count(*) AS n_b FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL)
SELECT * FROM (SELECT l_orderkey, l_partkey, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (l_orderkey, l_partkey)) WHERE n_a <> n_b OR n_a > 1""")
def identity_multiset_diff(t: Tables) -> DataFrame:
    """J4 J20 U6."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_discount")
    return A.same_identities(rows.filter("l_discount < 0.08"), rows.filter("l_discount > 0.02"), ["l_orderkey", "l_partkey"])


@query("""WITH a AS (SELECT row_id AS id, yield_value AS y, temperature AS t FROM condition_rows), b AS (SELECT row_id AS id, CASE WHEN row_id % 10 = 0 THEN yield_value + 0.5 ELSE yield_value END AS y, CASE WHEN row_id % 7 = 0 THEN NULL ELSE temperature END AS t FROM condition_rows)
SELECT 'y' AS column_name, sum((a.y IS DISTINCT FROM b.y)::INT)::BIGINT AS differing, round(max(CASE WHEN isnan(a.y) THEN NULL ELSE abs(a.y - b.y) END), 9) AS max_gap FROM a JOIN b USING (id) UNION ALL
SELECT 't', sum((a.t IS DISTINCT FROM b.t)::INT)::BIGINT, round(max(CASE WHEN isnan(a.t) THEN NULL ELSE abs(a.t - b.t) END), 9) FROM a JOIN b USING (id)""")
def table_diff(t: Tables) -> DataFrame:
    """V5 V8."""
    a = t.condition_rows.select(F.col("row_id").alias("id"), F.col("yield_value").alias("y"), F.col("temperature").alias("t"))
    b = a.select("id", F.when(F.col("id") % 10 == 0, F.col("y") + 0.5).otherwise(F.col("y")).alias("y"), F.when(F.col("id") % 7 != 0, F.col("t")).alias("t"))
    return A.table_difference(a, b, ["id"], ["y", "t"]).withColumn("max_gap", F.round("max_gap", 9))


@query("SELECT s.split_name AS owner, count(*) AS n FROM condition_rows c JOIN (SELECT DISTINCT split_name, product_canonical FROM system_records WHERE split_name IN ('val', 'test')) s ON s.product_canonical = c.product GROUP BY ALL")
def held_out_overlap(t: Tables) -> DataFrame:
    """Rows that are a held-out product, by hashed identity."""
    held = t.system_records.filter("split_name IN ('val', 'test')").withColumn("owner", F.col("split_name"))
    return A.held_out_overlap(t.condition_rows, held, F.col("product"), F.col("product_canonical"), "owner")


@query("SELECT 'priced' AS rule, sum((NOT coalesce(l_extendedprice > 1000, false))::INT)::BIGINT AS n FROM lineitem UNION ALL SELECT 'discounted', sum((NOT coalesce(l_discount <= 0.09, false))::INT)::BIGINT FROM lineitem")
def rule_violations(t: Tables) -> DataFrame:
    """V7."""
    return A.violations(t.lineitem, {"priced": F.col("l_extendedprice") > 1000, "discounted": F.col("l_discount") <= 0.09})


@query("""SELECT slot, o_orderkey, o_totalprice FROM (SELECT 'open' AS slot, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'dear', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 1)""")
def case_selection(t: Tables) -> DataFrame:
    """V11."""
    return A.first_cases(t.orders, {"open": F.col("o_orderstatus") == "O", "dear": F.col("o_totalprice") > 100000}, ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def checked_lookup(t: Tables) -> DataFrame:
    """Many-to-one, checked in the job."""
    return A.checked_lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"]).select("c_custkey", "n_name", "n_regionkey")


@query("SELECT record_id, CASE WHEN lower(trim(product, ' ')) = lower(trim(product_canonical, ' ')) THEN product ELSE product_canonical END AS guarded FROM condition_records")
def identity_guard(t: Tables) -> DataFrame:
    """V3."""
    same = F.lower(F.trim("product")) == F.lower(F.trim("product_canonical"))
    return t.condition_records.select("record_id", A.guarded(F.col("product"), F.col("product_canonical"), same).alias("guarded"))


@query("SELECT family AS source, count(*) AS n FROM (SELECT family FROM condition_rows UNION ALL SELECT family FROM route_proposals UNION ALL SELECT NULL FROM system_records) GROUP BY family")
def union_all(t: Tables) -> DataFrame:
    """Missing columns become null."""
    parts = t.condition_rows.select("family").unionByName(t.route_proposals.select("family")).unionByName(t.system_records.select("record_id"), allowMissingColumns=True)
    return parts.groupBy(F.col("family").alias("source")).agg(F.count("*").alias("n"))
