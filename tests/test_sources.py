"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from slatewise.provider import ColumnProvider
from slatewise.sources import readers as S
from slatewise.sources import sinks as K
from slatewise.streaming import windows as W


def test_split_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("r1\tC\tCC\t50\tb; a\tnan\t80\textra\nshort\tline\nr2\tC\tCC\tx\t\twater\t1_0\n")
    rows = S.split_rows(spark, str(tmp_path / "a.tsv")).collect()
    assert [r["reaction_id"] for r in rows] == ["r1", "r2"] and rows[0]["temperature"] == "80"
    typed = {r["reaction_id"]: r for r in S.condition_rows(spark, str(tmp_path / "a.tsv")).collect()}
    assert typed["r1"]["reagent_norm"] == "a; b" and typed["r1"]["solvent_norm"] == "" and typed["r1"]["yield_value"] == 50.0
    assert typed["r2"]["yield_value"] is None and typed["r2"]["temperature"] is None
    routes = S.routes_from_split(spark, str(tmp_path / "a.tsv")).orderBy("sample_index").collect()
    assert [(r["reaction_id"], r["sample_index"]) for r in routes] == [("r1", 0), ("r2", 1)]


def test_route_cache(spark, tmp_path):
    route = {"reactants": "C", "retro_rank": 1, "retro_score": 0.5, "retro_probability": 0.5}
    cache = {"family": "f", "reactions": [{"sample_index": 0, "routes": []}, {"sample_index": 1, "product": "P", "routes": [route, route]}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(cache))
    assert S.route_cache(spark, str(path)).count() == 2
    assert {r["sample_index"] for r in S.route_manifest(spark, str(path)).collect()} == {0, 1}
    cache["reactions"][0]["sample_index"] = 1
    path.write_text(json.dumps(cache))
    with pytest.raises(Exception, match="twice"):
        S.route_manifest(spark, str(path)).collect()


def test_encodings_and_columns(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes("Reaction ID,Reaction,Other\n1,é>>b,x\n".encode("cp1252"))
    rows = S.raw_export(spark, str(path)).collect()
    assert rows[0]["Reaction"] == "é>>b" and rows[0]["Reagent"] is None and len(rows[0]) == 8


def test_name_map_last_wins(spark, tmp_path):
    path = tmp_path / "names.tsv"
    path.write_text("Water\tO\nWATER\t[OH2]\nx\tnone\n")
    names = S.name_map(spark, str(path))
    assert {r["name"]: r["token"] for r in names.collect()} == {"water": "[OH2]"}
    table = spark.createDataFrame([(1, "Water; thf"), (2, None)], "i int, c string")
    assert {r["i"]: r["standard"] for r in S.mapped_tokens(table, F.col("c"), names).collect()} == {1: "[OH2]; thf", 2: ""}


def test_directory_skips_lock_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "~$a.csv").write_text("x\n2\n")
    assert [r["x"] for r in S.directory(spark, str(tmp_path)).collect()] == ["1"]


def test_bad_lines_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    (tmp_path / "s.csv").write_text("k,score\na,1\nb,NaN\n")
    with pytest.raises(Exception, match="no number"):
        S.score_columns(spark, str(tmp_path / "s.csv"), ["k", "score"], "score").collect()
    with pytest.raises(ValueError, match="absent"):
        S.score_columns(spark, str(tmp_path / "s.csv"), ["z"], "score")


def test_paired_files(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n")
    (tmp_path / "b").write_text("x\ny\n")
    assert [(r["first"], r["second"]) for r in S.paired_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("line").collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "b").write_text("x\n")
    with pytest.raises(Exception, match="differ in length"):
        S.paired_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{i:05d}\n" for i in range(5000)))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = S.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert [(r["line"], r["value"]) for r in got] == [(i, f"{'ab'[i // 5000]}{i % 5000:05d}") for i in range(10000)]


def test_generation_log(spark, tmp_path):
    (tmp_path / "g.txt").write_text("S-0\tx\nH-0\t-0.5\tC C\nP-0\t-1.0 -2.0\nH-0\t-0.7\tC O\nP-0\t-3.0\nE-0_1\tfoo\n")
    rows = S.generation_log(spark, str(tmp_path / "g.txt")).orderBy("line").collect()
    assert [(r["hypothesis"], r["mean_log_prob"]) for r in rows] == [("C C", -1.5), ("C O", -3.0)]


def test_manifest_is_strict(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a")
    path, inputs = f"file://{tmp_path}/m.json", {"in": f"file://{tmp_path}/in.txt"}
    with pytest.raises(FileNotFoundError):
        K.require_manifest(spark, path, {}, inputs)
    K.save_manifest(spark, path, {"seed": 1}, inputs)
    K.require_manifest(spark, path, {"seed": 1}, inputs)
    with pytest.raises(ValueError):
        K.require_manifest(spark, path, {"seed": 2}, inputs)
    (tmp_path / "in.txt").write_text("b")
    with pytest.raises(ValueError):
        K.require_manifest(spark, path, {"seed": 1}, inputs)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "token string, n int")
    K.frequency_table(df, str(tmp_path / "f"))
    lines = [x for p in sorted((tmp_path / "f").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == ["c\t5", "a\t2", "b\t2"]
    K.write_json_lines(df.limit(1), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part*.json")).read_text()) == {"n": 2, "token": "b"}
    assert [r["text"] for r in K.markdown(df.limit(1)).orderBy("line").collect()] == ["| token | n |", "|---|---|", "| b | 2 |"]


def test_column_provider_never_guesses(spark):
    table = spark.createDataFrame([("C1.C1", "CC", True), ("CC.C1", None, False)], "raw string, canonical string, is_valid boolean")
    rows = spark.createDataFrame([("C1.C1",), ("CC.C1",), ("unknown",), (None,)], "m string")
    assert [r["key"] for r in ColumnProvider(table).canonical(rows, "m", "key").collect()].count("CC") == 1


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = W.read_events(spark, f"{small}/event[s].parquet", schema)
    best = W.run_to_end(W.running_best(events), "best", "update", str(tmp_path / "c"))
    want = {r["user_id"]: r["v"] for r in spark.read.parquet(f"{small}/events.parquet").groupBy("user_id").agg(F.max("value").alias("v")).collect()}
    assert {r["user_id"]: r["v"] for r in best.groupBy("user_id").agg(F.max("best").alias("v")).collect()} == want
    assert W.sessions(events).isStreaming
