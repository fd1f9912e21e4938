"""Sinks: K1 to K7, V9."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.shared import replace_file
from slatewise.sources.readers import file_digests


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, by folders where wanted."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, gzip: bool = False, mode: str = "errorifexists") -> None:
    """K1, K2, K6: CSV or TSV, gzipped where wanted; null is the empty field."""
    df.write.mode(mode).csv(path, sep=separator, header=header, compression="gzip" if gzip else "none", nullValue="", emptyValue="")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3: one object per line, keys sorted."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path, ignoreNullFields=False)


def frequency_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K4: (token, n) in falling order; range-partitioned, so the files are in order as well."""
    df.orderBy(F.col("n").desc(), "token").write.mode(mode).csv(path, sep="\t")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def save_manifest(spark: SparkSession, path: str, config: dict, inputs: dict[str, str]) -> None:
    """K5: JSON of the configuration and the digests of all input files, written aside and renamed."""
    found = {label: {r["path"]: r["sha256"] for r in file_digests(spark, p).collect()} for label, p in inputs.items()}
    target, fs, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"schema": 1, "config": config, "inputs": found}, sort_keys=True).encode()))
    out.close()
    replace_file(spark, path + ".part", path)


def require_manifest(spark: SparkSession, path: str, config: dict, inputs: dict[str, str]) -> None:
    """K5, V9: fail unless the manifest is there and says the same of configuration and inputs."""
    target, fs, _ = _fs(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    held = json.loads(spark.read.text(path, wholetext=True).first()[0])
    found = {label: {r["path"]: r["sha256"] for r in file_digests(spark, p).collect()} for label, p in inputs.items()}
    if held.get("config") != json.loads(json.dumps(config)) or held.get("inputs") != found:
        raise ValueError(f"{path} was made of another configuration or other inputs")


def markdown(df: DataFrame, digits: int = 2) -> DataFrame:
    """K7: the rows of a report as lines of a Markdown table, head first (``line``, ``text``)."""
    cells = [F.coalesce(F.format_number(c, digits) if t in ("double", "float") else F.col(c).cast("string"), F.lit("NA")) for c, t in df.dtypes]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "line int, text string")
    return head.unionByName(body.select(F.lit(2).alias("line"), "text"))
