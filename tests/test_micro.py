"""Hand-computed cases of the rules on order, ties and missing values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from slatewise import catalog
from slatewise.functions import labels as L
from slatewise.functions import numbers as N
from slatewise.functions import vectors as V
from slatewise.functions.let import let
from slatewise.operators import audit, cleaning, memory, models, pool, ranking, rollup, sequences


def values(spark, texts, build):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_labels(spark):
    assert values(spark, ["b; a;nan ;b;; Z", None, "", "   ;None"], L.normalize_labels) == ["Z; a; b", "", "", ""]
    assert values(spark, ["b; a; b", None], L.distinct_in_string) == ["b; a", ""]
    assert values(spark, ["NaN", " - ", "", None, "x"], L.is_missing) == [True, True, False, True, False]
    assert values(spark, ["copper(l) iodide", "iron(iii) chloride  hydrate", "beta?x", "zinc acetate DIHYDRATE", "x(ab)", "-", None], L.standard_label) == [
        "copper(I) iodide", "iron(III) chloride", "beta-x", "zinc acetate", "x(ab)", None, None,
    ]
    assert values(spark, ["C.C", "", None, "CC"], L.component_count) == [2, 0, 0, 1]
    assert values(spark, ["[CH3:1]Br", "c1ccccc1Cl"], lambda c: F.array_join(L.molecule_tokens(c), " ")) == ["[CH3:1] Br", "c 1 c c c c c 1 Cl"]


def test_temperatures(spark):
    got = values(spark, ["80; 100", "20 - 30", "80; x", "nan", None, "", "7"], N.highest_temperature)
    assert got == [100.0, 25.0, None, None, None, None, 7.0]
    df = spark.createDataFrame([(1110.0,), (500.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(N.sane_temperature(F.col("x"))).collect()] == [None, 500.0, None, None]


def test_rank_prior_and_z(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 2.0), (3, 2.0)], "s int, x double")
    rows = df.withColumns({"a": ranking.z_sample(F.col("x"), "s"), "b": ranking.z_population(F.col("x"), "s")}).orderBy("s", "x").collect()
    assert [round(r["a"], 8) for r in rows] == [-0.70710678, 0.70710678, 0.0, 0.0, 0.0]
    assert [r["b"] for r in rows] == [-1.0, 1.0, 0.0, 0.0, 0.0]
    three = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 0)], "s int, i int")
    got = ranking.rank_prior(three, "s", [F.col("i")]).orderBy("s", "i").collect()
    assert [r["prior"] for r in got] == [1.0, 0.5, 0.0, 1.0]


def test_manifest_metrics(spark):
    rows = [(1, r, 0) for r in range(1, 12)] + [(2, r, int(r == 11)) for r in range(1, 12)] + [(3, 1, 1)]
    slates = ranking.slate_hits(spark.createDataFrame(rows, "q int, slate_rank int, label int"), "q")
    manifest = spark.createDataFrame([(0,), (1,), (2,), (3,)], "q int")
    r = ranking.over_manifest(manifest, slates, "q", ["hit10", "covered", "rr", "ndcg10"]).first()
    assert (r["n_queries"], r["hit10"], r["covered"], r["ndcg10"]) == (4, 0.25, 0.5, 0.25)
    assert math.isclose(r["rr"], (1 / 11 + 1) / 4)


def test_failure_categories(spark):
    df = spark.createDataFrame([(0, False, False, False), (1, True, False, False), (2, True, True, False), (3, True, True, True)], "q int, a boolean, b boolean, c boolean")
    got = df.orderBy("q").select(rollup.failure_category(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["route_miss", "pool_miss", "ranking_miss", "hit"]


def test_temperature_error_looks_below_rank_ten(spark):
    rows = [(1, r, int(r == 11), 30.0, 31.0) for r in range(1, 12)] + [(2, 1, 1, float("nan"), 3.0), (2, 2, 1, 40.0, 60.0)]
    r = ranking.temperature_error(spark.createDataFrame(rows, "q int, r int, l int, a double, b double"), "q", "r", "l", "a", "b").first()
    assert (r["n"], r["mae"], r["within_5"], r["within_20"]) == (2, 10.5, 0.5, 1.0)


def test_reciprocal_votes(spark):
    rows = [("q", 1, "A", 0, True), ("q", 1, "?", 1, False), ("q", 1, "B", 2, True), ("q", 2, "B", 0, True), ("q", 2, "A", 1, True)]
    df = spark.createDataFrame(rows, "q string, run int, h string, i int, ok boolean")
    got = {r["h"]: r for r in sequences.reciprocal_votes(df, "q", "run", "h", [F.col("i")], F.col("ok")).collect()}
    assert set(got) == {"A", "B"}
    assert all(math.isclose(r["score"], 1 + 1 / 1.1) and math.isclose(r["probability"], 0.5) for r in got.values())


def test_neighbor_contexts(spark):
    near = spark.createDataFrame([("q", 1, 0.8), ("q", 2, 0.5)], "q string, n int, s double")
    rows = spark.createDataFrame([(1, "X", 50.0), (2, "X", None), (2, "Y", 90.0)], "n int, c string, y double")
    got = {r["c"]: r for r in memory.neighbor_contexts(near, rows, "q", "n", "s", ["c"], "y").collect()}
    assert (round(got["X"]["similarity_sum"], 9), got["X"]["similarity_max"], got["X"]["neighbor_count"], got["X"]["weighted_yield"]) == (1.3, 0.8, 2, 50.0)
    assert (got["Y"]["similarity_sum"], got["Y"]["neighbor_count"], got["Y"]["weighted_yield"]) == (0.5, 1, 90.0)


def test_leave_one_out(spark):
    rows = [("r", "X")] * 3 + [("s", "X")] + [("r", "Y")] + [("s", "Y")] * 5
    got = {(r["g"], r["c"]): r for r in memory.leave_one_out(spark.createDataFrame(rows, "g string, c string"), "g", ["c"]).collect()}
    assert got["r", "X"]["context_count"] == 1 and math.isclose(got["r", "X"]["support"], 1 / 6)
    assert got["r", "Y"]["context_count"] == 5 and math.isclose(got["r", "Y"]["support"], 5 / 6)


def test_roles_tie_makes_a_solvent(spark):
    df = spark.createDataFrame([(1, "a; b", "a"), (2, "b", "c")], "i int, reagent string, solvent string")
    roles = {r["token"]: r["is_reagent"] for r in cleaning.token_roles(df, "reagent", "solvent").collect()}
    assert roles == {"a": False, "b": True, "c": False}
    got = {r["i"]: (r["reagent"], r["solvent"]) for r in cleaning.reassigned(df, "i", "reagent", "solvent").collect()}
    assert got == {1: ("b", "a"), 2: ("b", "c")}


def test_classwise_split(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [(None, 5)], "g string, i int")
    got = cleaning.classwise_split(df, "g", ["i"]).filter("g = 'a'").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 8, "val": 1, "test": 1}


def test_weight_ties(spark):
    grid = spark.createDataFrame([(0.5, 3, 1), (0.7, 3, 1), (0.9, 2, 2)], "w double, hit10 int, hit1 int")
    assert ranking.best_weight(grid, ["hit10"], True).first()["w"] == 0.7
    assert ranking.best_weight(grid, ["hit10", "hit1"], False).first()["w"] == 0.5


def test_full_union_and_order(spark):
    a = spark.createDataFrame([("x", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([(None, 3.0), ("y", 4.0)], "k string, v double")
    got = {r["k"]: (r["v"], r["from_first"], r["from_second"]) for r in pool.full_union(a, b, ["k"], ["v"]).collect()}
    assert got == {"x": (1.0, True, False), None: (2.0, True, True), "y": (4.0, False, True)}


def test_alignment_errors(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert {(r["k"], r["n_a"], r["n_b"]) for r in audit.same_identities(a, a.filter("k = 1"), ["k"]).collect()} == {(2, 2, 0)}
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated"):
        audit.checked_lookup(a, right, ["k"]).collect()


def test_exclusions_forget_excluded_rows(spark):
    df = spark.createDataFrame([(1, "p", True), (2, "p", False), (3, "p", False)], "i int, p string, bad boolean")
    got = {r["i"]: r["reasons"] for r in cleaning.exclusions(df, {"bad": F.col("bad")}, F.col("p"), "i").collect()}
    assert got == {1: ["bad"], 2: [], 3: ["duplicate"]}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("a")).alias("c")).first()
    assert r["u"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and math.isclose(r["c"], 1.0)
    w = spark.createDataFrame([([0, 63, 64],)], "n array<int>").select(V.bit_words(F.col("n"), 2).alias("w")).first()["w"]
    assert w == [-(2**63) + 1, 1]


def test_sequences(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    r = df.select(sequences.token_levenshtein(F.col("a"), F.col("b")).alias("d"), sequences.rolled(F.col("a"), 1).alias("r"), sequences.padded(F.col("a"), F.lit(5), F.lit("-"), left=True).alias("p")).first()
    assert (r["d"], r["r"], r["p"]) == (2, ["c", "a", "b"], ["-", "-", "a", "b", "c"])
    rows = spark.createDataFrame([("p", i, [0] * n) for i, n in enumerate((3, 3, 5, 1))], "p string, i int, ids array<int>")
    got = {r["i"]: r["batch"] for r in sequences.budget_batches(rows, "p", "i", "ids", 6).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_resampling_keeps_the_expected_numbers(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(300)], "k int, w double")
    got = sequences.resampled(df, "k", "w", 600).collect()
    assert abs(sum(r["times"] for r in got) - 600) <= 1
    assert all(abs(r["times"] - r["w"]) <= 1 for r in got)


def test_bernoulli_model(spark):
    features = spark.createDataFrame([(1, "a"), (2, "b")], "id int, feature string")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "id int, label string")
    got = {(r["id"], r["label"]): r["logit"] for r in models.bernoulli_logits(models.bernoulli_fit(features, labels), features, labels).collect()}
    assert math.isclose(got[1, "x"], math.log(0.5) + 2 * math.log(2 / 3))
    assert math.isclose(got[1, "y"], math.log(0.5) + 2 * math.log(1 / 3))


def test_grid_and_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    want = spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r["k"], r["problem"]) for r in rollup.grid_mismatch(a, want, ["k"]).collect()} == {(2, "unexpected"), (3, "missing")}
    got = rollup.upsert(a, spark.createDataFrame([(2, "z")], "k int, v string"), ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(1, "a"), (2, "z")]


def test_subgroups_without_rows_are_null(spark):
    df = spark.createDataFrame([(True, 1)], "f boolean, m int")
    got = {r["value"]: (r["n"], r["m"]) for r in rollup.subgroup_means(df, ["f"], ["m"]).collect()}
    assert got == {True: (1, 1.0), False: (0, None)}


def test_let_binds_once(spark):
    df = spark.createDataFrame([(3,)], "x int")
    assert df.select(let(F.col("x") + 1, lambda v: v * v).alias("y")).first()["y"] == 16


def test_hydrate_standard_covers_every_cell(spark, small):
    def standard(x):
        x = x.strip().replace("?", "-")
        x = re.sub(r"\([ivxl]+\)", lambda m: m.group(0).replace("l", "I").replace("L", "I").upper(), x, flags=re.I)
        for word in (*L.HYDRATES[:-1], ""):
            x = re.sub(rf"\s+{word}hydrate", "", x, flags=re.I)
        return re.sub(r"\s+", " ", x.strip())

    cells = {r[0]: r[1] for r in spark.read.parquet(f"{small}/condition_rows.parquet").select("row_id", "reagent_norm").collect()}
    wanted = {i: standard(x) for i, x in cells.items() if x and x.strip().lower() not in ("nan", "none", "not given", "unknown", "-")}
    got = {r["row_id"]: r["standard"] for r in catalog.QUERIES["hydrate_standard"](spark, small).collect()}
    assert got == wanted
    assert any(re.search(r"\([ivxl]+\)|[?]", cells[i], re.I) for i in got)


def test_hydrate_standard_repairs_and_strips(spark, tmp_path):
    cells = ["copper(l) iodide", "cerium(iii) chloride; nickel(iI) acetate", "beta?x", "zinc acetate Dihydrate", "a hydrate; b  monohydrate ", "x(ab)", " - ", "", None, "\u00a0zinc\u2009bromide\u00a0dihydrate"]
    spark.createDataFrame(list(enumerate(cells)), "row_id int, reagent_norm string").write.parquet(str(tmp_path / "condition_rows.parquet"))
    got = {r["row_id"]: r["standard"] for r in catalog.QUERIES["hydrate_standard"](spark, str(tmp_path)).collect()}
    assert got == {0: "copper(I) iodide", 1: "cerium(III) chloride; nickel(II) acetate", 2: "beta-x", 3: "zinc acetate", 4: "a; b", 5: "x(ab)", 9: "zinc bromide"}


def test_context_windows_of_long_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    texts = ["a b  c", " ".join(words), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["pos"]): r["before"] for r in catalog.QUERIES["context_windows_all"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): "", (0, 1): "a", (0, 2): "a b"} | {(1, i): " ".join(words[max(i - 3, 0) : i]) for i in range(500)}


def test_weighted_resample_draws_as_often_as_there_are_documents(spark, tmp_path):
    for n in (7, 2500):
        docs = [(i, i % 5 * 10) for i in range(n - 1)] + [(n - 1, None)]
        spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        got = {r["doc_id"]: r["times"] for r in catalog.QUERIES["weighted_resample"](spark, str(tmp_path / f"{n}")).collect()}
        weight = sum(w or 0 for _, w in docs)
        assert sum(got.values()) == n
        # systematic draws: each document is drawn its share of n, rounded up or down
        assert all(abs(got.get(i, 0) - n * (w or 0) / weight) < 1 for i, w in docs)


def test_missing_words_are_no_labels(spark):
    df = spark.createDataFrame([(1, "g", "water; Not Given; -; unknown"), (2, "g", "NaN;none; thf ;water"), (3, "g", None)], "i int, g string, c string")
    got = [r[0] for r in df.orderBy("i").select(L.normalize_labels(F.col("c"))).collect()]
    assert got == ["water", "thf; water", ""]
    assert {r["token"]: r["n"] for r in memory.token_frequency(df, "c").collect()} == {"water": 2, "thf": 1}
    assert [tuple(r) for r in memory.union_per_group(df, "g", "c").collect()] == [("g", "thf; water")]
    # a rare missing word drops no row
    assert sorted(r["i"] for r in cleaning.without_rare_labels(df, "i", ["c"], 2).collect()) == [1, 3]


def test_first_by_takes_exactly_n(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    for n in (0, 1, 700, 4999, 6000):
        got = sorted(r["id"] for r in sequences.first_by(df, F.col("k"), "id", n).collect())
        assert got == sorted(sorted(range(5000), key=lambda i: (i % 7, i))[:n])


def test_a_null_family_is_counted(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("x", "b")], "f string, c string")
    got = {(r["f"], r["c"]): r["n"] for r in rollup.category_counts(df, "f", "c", ["a", "b"]).collect()}
    assert got == {(None, "a"): 2, (None, "b"): 0, ("x", "a"): 0, ("x", "b"): 1, ("ALL-FAMILIES", "a"): 2, ("ALL-FAMILIES", "b"): 1}
