"""Plan shapes: skew, running sums, buckets, pruning."""

import ast
import random
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from slatewise import catalog
from slatewise.operators import pool, ranking, retrieve
from slatewise.plans.bucketed import BucketedTable
from slatewise.plans.running import running
from slatewise.plans.skew import join_on_counted, join_spread
from slatewise.shared import new_folder, written

ROOT = Path(__file__).resolve().parents[1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counted_join_with_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    left = left.unionByName(spark.createDataFrame([(-1, None)], "id bigint, k string"))
    right = written(left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1 OR first < 100"), "right")
    got = join_on_counted(left, right, "k", "n")
    want = left.join(right.drop("n"), "k").select(*got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.filter("k = 'hot'").count() == 1000


def test_counted_join_on_empty_tables(spark):
    left = spark.createDataFrame([], "id bigint, k string")
    right = spark.createDataFrame([], "k string, n bigint, v int")
    assert join_on_counted(left, right, "k", "n").count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([("a", i, 2) for i in range(100)] + [(None, 1, 5), (None, 2, 7)], "g string, i int, v int")
    got = {(r["g"], r["i"]): (r["b"], r["t"]) for r in running(df, ["g"], ["i"], F.col("v"), "b", "t").collect()}
    assert all(got["a", i] == (2 * i, 200) for i in range(100))
    assert got[None, 1] == (0, 12) and got[None, 2] == (5, 12)


def test_bucketed_merge_keeps_untouched_buckets(spark):
    path = new_folder(spark, "bucketed")
    schema = spark.createDataFrame([], "k string, n bigint").schema

    def add(old, new):
        return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    table = BucketedTable(spark, path, schema, ["k"], buckets=8)
    table.merge(spark.createDataFrame([(str(i), 1) for i in range(50)], schema), add, rows=50)
    before = dict(table.folders)
    table.merge(spark.createDataFrame([("7", 5)], schema), add, rows=1)
    assert sum(before[b] != table.folders[b] for b in before) == 1
    again = BucketedTable(spark, path, schema, ["k"])
    assert {r["k"]: r["n"] for r in again.read().collect()} == {str(i): 1 + 5 * (i == 7) for i in range(50)}
    assert again.totals == {"rows": 51} and again.buckets == 8
    again.merge(spark.createDataFrame([], schema), add)
    assert again.read().count() == 50


def test_top_k_is_cut_before_the_shuffle(spark, small):
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    text = plan(ranking.first_k(rows.select("l_orderkey", "l_extendedprice"), "l_orderkey", [F.col("l_extendedprice").desc()], 3))
    assert "WindowGroupLimit" in text
    assert "l_comment" not in text and "l_shipdate" not in text


def test_filters_reach_the_scan(spark, small):
    rows = spark.read.parquet(f"{small}/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey")
    text = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "o_orderdate" not in text


def test_postings_equal_dense(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").filter("vec_id < 60")
    dense = {(r["query_id"], r["neighbor_id"]): r["similarity"] for r in retrieve.cosine_top_k(e.filter("vec_id < 3"), e, "vec_id", "embedding", 100).collect()}
    from slatewise.functions import vectors as V

    unit = e.select("vec_id", V.unit(F.col("embedding")).alias("u"))
    p = retrieve.postings(unit, "vec_id", "u")
    for r in retrieve.sparse_dot(p.filter("id < 3"), p).collect():
        if r["query_id"] != r["neighbor_id"]:
            assert abs(dense.get((r["query_id"], r["neighbor_id"]), 0.0) - max(r["dot"], 0)) < 1e-6


def test_core_does_not_import_llm():
    for path in (ROOT / "slatewise").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_no_local_checkpoint_or_cross_product_of_rows():
    for path in (ROOT / "slatewise").rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text(), path


def test_spread_join_with_a_hot_key_on_both_sides(spark):
    left = written(spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k")), "left")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("2", 3), (None, 4), ("none", 5)], "k string, v int")
    got = join_spread(left, right, "k")
    want = left.join(right, "k").select(*got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.count() == 4001
    assert join_spread(left.limit(0), right, "k").count() == 0


def test_joint_candidates_of_a_hot_query_are_counted_without_pairs(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") < 39_000, 3).otherwise(F.col("id") % 50 + 10).cast("bigint").alias("sample_index"), "id")
    routes = rows.select("sample_index", F.concat(F.lit("r"), "id").alias("reactants"), F.col("id").alias("proposal_id"), (F.col("id") % 7).cast("int").alias("retro_rank"))
    contexts = rows.select("sample_index", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("reagent_norm"), F.lit("water").alias("solvent_norm"))
    routes.unionByName(routes).write.parquet(f"{tmp_path}/route_proposals.parquet")
    contexts.write.parquet(f"{tmp_path}/context_predictions.parquet")
    out = catalog.QUERIES["joint_candidates"](spark, str(tmp_path))
    steps = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= steps.find("Join") < steps.find("Aggregate"), "pairs are formed before they are counted"
    got = {r["sample_index"]: (r["candidates"], r["routes"]) for r in out.collect()}
    assert got[3] == (39_000 * 31_201, 39_000) and got[10] == (20 * 1, 20) and got[11] == (20 * 20, 20) and len(got) == 51


def test_joint_counts_equal_the_counted_pairs(spark):
    routes = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 40).cast("bigint").alias("s"), F.concat(F.lit("r"), F.col("id") % 1500).alias("route"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 700).alias("p"), F.when(F.col("id") % 4 > 0, F.col("id") % 9).alias("rank"),
    )
    contexts = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (5, "b"), (None, "c"), (777, "d")], "s bigint, c string")
    order = [F.col("rank").asc_nulls_last(), F.col("p")]
    pairs = pool.joint_candidates(routes, contexts, "s", "route", order)
    assert pairs.columns == ["s", "route", "p", "rank", "c"]
    plain = pool.distinct_routes(routes, "s", "route", order).join(contexts, "s")
    assert pairs.exceptAll(plain).count() == plain.exceptAll(pairs).count() == 0
    want = {tuple(r) for r in plain.groupBy("s").agg(F.count("*"), F.countDistinct("p")).collect()}
    assert {tuple(r) for r in pool.joint_counts(routes, contexts, "s", "route", "p", order).collect()} == want and len(want) == 3


def test_token_neighbors_of_a_hot_word_shuffle_no_pairs(spark, tmp_path):
    i = F.col("id")
    parts = spark.range(20_000).select(
        (i - F.when(i % 1000 == 1, 1).otherwise(0)).alias("p_partkey"), F.concat(F.lit("Hot ring"), F.when(i % 3 > 0, F.concat(F.lit(" v"), i % 5000, F.lit("  w"), i % 700)).otherwise("")).alias("p_name"),
        F.when(i % 100 != 50, F.concat(F.lit("Brand#"), i % 25)).alias("p_brand"), F.when(i % 2 == 0, "SMALL").otherwise("hot").alias("p_type"),
    )
    parts.write.parquet(f"{tmp_path}/part.parquet")

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    began = shuffled()
    got = sorted(tuple(r) for r in catalog.QUERIES["tanimoto_token_topk"](spark, str(tmp_path)).collect())
    assert shuffled() - began < 8_000_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT query_id, neighbor_id, similarity, neighbor_rank FROM ({catalog.ORACLE['tanimoto_token_topk']})").fetchall())
    assert len(got) == 2000 and got == want


def test_token_neighbors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "MAX_BLOCK", 17)
    monkeypatch.setattr(retrieve, "TOKEN_CELLS", 200)
    monkeypatch.setattr(retrieve, "OFTEN", 2)
    rng = random.Random(7)
    sets = {f"i{n}": {"one"} if n % 3 == 0 else {rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))} | ({"one"} if n % 2 else set()) for n in range(300)}
    tokens = [(i, t) for i, held in sets.items() for t in held] + [("i1", "one"), ("lone", "zz"), (None, "a"), ("i2", None)]
    rows = spark.createDataFrame(tokens, "id string, token string")
    for k in (1, 4, 400):
        got = sorted(tuple(r) for r in retrieve.token_tanimoto(rows.filter("id LIKE 'i%5' OR id LIKE 'i%6' OR id IN ('i3', 'lone')"), rows, k).collect())
        want = []
        for q in (i for i in sets if i[-1] in "56" or i == "i3"):
            near = sorted((-len(sets[q] & sets[i]) / len(sets[q] | sets[i]), i) for i in sets if i != q and sets[q] & sets[i])
            want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(near[:k])]
        assert got == sorted(want)
    assert retrieve.token_tanimoto(rows.limit(0), rows, 3).count() == 0
    assert retrieve.token_tanimoto(rows, rows.limit(0), 3).count() == 0
