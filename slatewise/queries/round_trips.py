"""What the readers and writers hold: tables written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.functions.numbers import mean_sd_text
from slatewise.operators import features as X
from slatewise.operators import memory as M
from slatewise.operators import models as ML
from slatewise.registry import Tables, query, sql_labels, sql_tokens
from slatewise.shared import new_folder
from slatewise.sources import readers as S
from slatewise.sources import sinks as K


def _caches(rows: DataFrame, part: str, path: str, routes) -> None:
    """Cache documents of bounded size, one per line."""
    reaction = F.struct(F.col("sample").alias("sample_index"), F.lit("r").alias("reaction_id"), F.lit("p").alias("product"), F.lit("g").alias("gold_reactants"), routes.alias("routes"))
    rows.groupBy("family", part).agg(F.collect_list(reaction).alias("reactions")).select("family", "reactions").write.json(path)


@query("SELECT o_orderpriority AS family, o_orderkey::INT AS sample_index, o_custkey::VARCHAR AS reactants, 1::INT AS retro_rank, o_totalprice AS retro_score FROM orders WHERE o_orderstatus <> 'O'")
def route_cache_scan(t: Tables) -> DataFrame:
    """Nested route documents; queries without routes (open orders) vanish."""
    path = new_folder(t.spark, "route-cache")
    route = F.struct(F.col("o_custkey").cast("string").alias("reactants"), F.lit(1).alias("retro_rank"), F.col("o_totalprice").alias("retro_score"), F.lit(0.5).alias("retro_probability"))
    rows = t.orders.select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").cast("int").alias("sample"), F.when(F.col("o_orderstatus") != "O", F.array(route)).otherwise(F.array().cast(f"array<{'struct<reactants:string,retro_rank:int,retro_score:double,retro_probability:double>'}>")).alias("routes"), F.floor(F.col("o_orderkey") / 64).alias("part"))
    _caches(rows, "part", path, F.col("routes"))
    return S.route_cache(t.spark, path, lines=True).select("family", "sample_index", "reactants", "retro_rank", "retro_score")


@query("SELECT o_orderpriority AS family, o_orderkey::INT AS sample_index FROM orders")
def route_manifest_scan(t: Tables) -> DataFrame:
    """Every query of the documents once."""
    path = new_folder(t.spark, "route-manifest")
    none = F.array().cast("array<struct<reactants:string,retro_rank:int,retro_score:double,retro_probability:double>>")
    rows = t.orders.select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").cast("int").alias("sample"), F.floor(F.col("o_orderkey") / 64).alias("part"))
    _caches(rows, "part", path, none)
    return S.route_manifest(t.spark, path, lines=True)


@query("SELECT p_partkey::VARCHAR AS id, p_name AS reaction, p_size::VARCHAR AS yield, NULL::VARCHAR AS solvent FROM part")
def raw_export_scan(t: Tables) -> DataFrame:
    """Wanted columns of an export, absent ones as null."""
    path = new_folder(t.spark, "raw-export")
    K.write_csv(t.part.select(F.col("p_partkey").alias("Reaction ID"), F.col("p_name").alias("Reaction"), F.col("p_size").alias("Yield (numerical)"), F.lit(1).alias("other")), path)
    out = S.raw_export(t.spark, path)
    return out.select(F.col("`Reaction ID`").alias("id"), F.col("Reaction").alias("reaction"), F.col("`Yield (numerical)`").alias("yield"), F.col("`Solvent (Reaction Details)`").alias("solvent"))


@query("SELECT lower(trim(label_name, ' ')) AS name, max_by(label_token, ref_id) AS token FROM label_reference WHERE trim(label_name, ' ') <> '' AND lower(label_token) NOT IN ('', 'none') GROUP BY ALL")
def name_map_scan(t: Tables) -> DataFrame:
    """The last line of a name counts; the list is fixed and small, so one file holds it in order."""
    path = new_folder(t.spark, "name-map")
    t.label_reference.orderBy("ref_id").coalesce(1).select(F.concat_ws("\t", "label_name", "label_token")).write.text(path)
    return S.name_map(t.spark, path)


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def directory_scan(t: Tables) -> DataFrame:
    """A folder of files beside a lock file, which is left out."""
    path = new_folder(t.spark, "directory")
    K.write_csv(t.supplier.select("s_suppkey", "s_name").repartition(3, "s_suppkey"), path)
    K.write_csv(t.supplier.select("s_suppkey", F.lit("locked").alias("s_name")), f"{path}-other")
    target, fs, jvm = K._fs(t.spark, path)
    for n, status in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}-other/part-*.csv"))):
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/~$lock{n}.csv"))
    return S.directory(t.spark, path).select("s_suppkey", "s_name")


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_discount FROM lineitem")
def score_columns_scan(t: Tables) -> DataFrame:
    """Two columns of a wider table, the score checked to be a number."""
    path = new_folder(t.spark, "scores")
    K.write_csv(t.lineitem.select("l_orderkey", "l_discount", "l_tax", "l_returnflag"), path)
    return S.score_columns(t.spark, path, ["l_orderkey", "l_discount"], "l_discount")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey::VARCHAR AS first, o_orderstatus AS second FROM orders")
def paired_files_scan(t: Tables) -> DataFrame:
    """Two files zipped line by line."""
    rows, a, b = t.orders.select("o_orderkey", "o_orderstatus"), new_folder(t.spark, "first"), new_folder(t.spark, "second")
    ordered = rows.orderBy("o_orderkey")
    ordered.select(F.col("o_orderkey").cast("string")).write.text(a)
    ordered.select("o_orderstatus").write.text(b)
    return S.paired_files(t.spark, a, b).select(F.col("line").cast("bigint").alias("line"), "first", "second")


@query("""SELECT o_orderkey AS sample, -o_custkey / 4.0::DOUBLE AS score, o_orderpriority AS hypothesis,
  round_even((-(o_custkey % 7) / 8.0::DOUBLE - (o_custkey % 5) / 4.0::DOUBLE - 0.5) / 3, 4) AS mean_log_prob FROM orders""")
def generation_log_scan(t: Tables) -> DataFrame:
    """Hypotheses with their positional scores among other lines."""
    path = new_folder(t.spark, "generation")
    k = F.col("o_custkey")
    scores = F.concat_ws(" ", *(c.cast("string") for c in (-(k % 7) / 8.0, -(k % 5) / 4.0, F.lit(-0.5))))
    key = F.col("o_orderkey").cast("string")
    lines = F.array(F.concat(F.lit("S-"), key, F.lit("\tx")), F.concat(F.lit("H-"), key, F.lit("\t"), (-k / 4.0).cast("string"), F.lit("\t"), F.col("o_orderpriority")), F.concat(F.lit("P-"), key, F.lit("\t"), scores))
    t.orders.select(F.explode(lines)).write.text(path)
    return S.generation_log(t.spark, path).select("sample", "score", "hypothesis", "mean_log_prob")


@query("SELECT doc_id AS id, list_transform(range(0, doc_id % 5), lambda i: (doc_id * i)::INT) AS ids FROM documents")
def token_dataset_scan(t: Tables) -> DataFrame:
    """Encoded sequences."""
    path = new_folder(t.spark, "tokens")
    ids = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda i: (F.col("doc_id") * i).cast("int"))
    K.write_table(t.documents.select(F.col("doc_id").alias("id"), ids.alias("ids")), path)
    return S.token_dataset(t.spark, path)


@query("SELECT o_orderkey::VARCHAR AS reaction_id, o_orderstatus AS reactants, o_orderpriority AS product, o_custkey::VARCHAR AS temperature FROM orders")
def split_rows_scan(t: Tables) -> DataFrame:
    """Lines of seven fields, tab between them, no head."""
    path = new_folder(t.spark, "tabs")
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.lit("a"), F.lit("b"), "o_custkey"]
    K.write_csv(t.orders.select(*columns), path, separator="\t", header=False)
    return S.split_rows(t.spark, path).select("reaction_id", "reactants", "product", "temperature")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_labels('reagent_norm')}) AS token FROM condition_rows WHERE feed IS NOT NULL) GROUP BY token")
def frequency_table_scan(t: Tables) -> DataFrame:
    """K4: label counts of the rows with a feed, as lines of token and count."""
    path = new_folder(t.spark, "frequencies")
    K.frequency_table(M.token_frequency(t.condition_rows.filter("feed IS NOT NULL"), "reagent_norm"), path)
    return t.spark.read.csv(path, sep="\t", schema="token string, n bigint")


@query("SELECT n_nationkey, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_digest_scan(t: Tables) -> DataFrame:
    """digests of files, one per nation."""
    path = new_folder(t.spark, "digests")
    t.nation.select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    found = S.file_digests(t.spark, f"{path}/*", "part-*")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.col("length").cast("bigint").alias("length"), "sha256")


@query("SELECT * FROM (VALUES ('same', 'accepted'), ('other configuration', 'refused'), ('other inputs', 'refused'), ('no manifest', 'refused')) v(tried, outcome)")
def manifest_checks(t: Tables) -> DataFrame:
    """K5 V9: a cache is accepted only with the configuration and the input files it was made of."""
    path, other = new_folder(t.spark, "inputs"), new_folder(t.spark, "inputs")
    K.write_csv(t.region.select("r_name"), path)
    K.write_csv(t.region.select(F.upper("r_name").alias("R")), other)
    manifest = f"{path}.manifest.json"
    K.save_manifest(t.spark, manifest, {"k": 1}, {"in": path})
    K.save_manifest(t.spark, manifest, {"k": 2}, {"in": path})
    out = []
    for tried, args in (("same", (manifest, {"k": 2}, {"in": path})), ("other configuration", (manifest, {"k": 1}, {"in": path})), ("other inputs", (manifest, {"k": 2}, {"in": other})), ("no manifest", (f"{path}.none", {}, {}))):
        try:
            K.require_manifest(t.spark, *args)
            out.append((tried, "accepted"))
        except (ValueError, FileNotFoundError):
            out.append((tried, "refused"))
    return t.spark.createDataFrame(out, "tried string, outcome string")


@query("SELECT l_returnflag, avg(l_discount) AS mean, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag")
def flat_metrics(t: Tables) -> DataFrame:
    """The fields of a record as columns."""
    wide = t.lineitem.groupBy("l_returnflag").agg(F.struct(F.avg("l_discount").alias("mean"), F.max("l_tax").alias("most")).alias("metrics"))
    return X.flattened(wide, ["l_returnflag"], "metrics")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, coalesce(max(label), 0)::DOUBLE AS code FROM lineitem LEFT JOIN embeddings ON vec_id = l_partkey GROUP BY ALL")
def with_embedding_columns(t: Tables) -> DataFrame:
    """Embedding columns by key, 0 where there are none."""
    known = t.embeddings.select(F.col("vec_id").alias("l_partkey"), F.col("label").cast("double").alias("code"))
    rows = X.with_embedding(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_partkey"])
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.max("code").alias("code"))


@query(f"""WITH e AS (SELECT row_id, unnest({sql_tokens('reagent_norm')}) AS x, generate_subscripts({sql_tokens('reagent_norm')}, 1) AS i FROM condition_rows), d AS (SELECT row_id, x, min(i) AS i FROM e GROUP BY ALL)
SELECT r.row_id, coalesce(string_agg(x, '; ' ORDER BY i), '') AS cell FROM condition_rows r LEFT JOIN d USING (row_id) GROUP BY r.row_id""")
def distinct_in_cell(t: Tables) -> DataFrame:
    """a cell's tokens once, in the order first seen."""
    return t.condition_rows.select("row_id", L.distinct_in_string(F.col("reagent_norm")).alias("cell"))


@query("SELECT count(DISTINCT l_orderkey) AS slates, count(DISTINCT l_orderkey) AS places FROM lineitem")
def slate_batches(t: Tables) -> DataFrame:
    """Each slate stands in one partition only."""
    placed = ML.slate_partitions(t.lineitem.select("l_orderkey"), "l_orderkey", 16).withColumn("place", F.spark_partition_id())
    return placed.agg(F.countDistinct("l_orderkey").alias("slates"), F.countDistinct("l_orderkey", "place").alias("places"))


@query("""WITH s AS (SELECT l_linestatus, avg(l_tax) AS m, stddev_samp(l_tax) AS d FROM (SELECT l_linestatus, l_linenumber, avg(l_tax) * 100 AS l_tax FROM lineitem GROUP BY ALL) GROUP BY l_linestatus)
SELECT l_linestatus, printf('%.2f', m) || ' ± ' || printf('%.2f', d) AS shown FROM s""")
def mean_sd_shown(t: Tables) -> DataFrame:
    """F42 A17."""
    per = t.lineitem.groupBy("l_linestatus", "l_linenumber").agg((F.avg("l_tax") * 100).alias("v")).groupBy("l_linestatus").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("d"))
    return per.select("l_linestatus", mean_sd_text(F.col("m"), F.col("d")).alias("shown"))
