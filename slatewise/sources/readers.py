"""Sources: S1 to S16. All lazy unless said otherwise, with stated schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise import schema
from slatewise.functions import labels as L
from slatewise.functions import numbers as N


def _fields(name: str) -> list[str]:
    return [f.split()[0] for f in name.split(", ")]


def split_rows(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Seven text fields per line; shorter lines are dropped, further fields ignored."""
    parts = spark.read.text(path).select(F.split("value", separator).alias("f")).filter(F.size("f") >= 7)
    return parts.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(_fields(schema.SPLIT_ROW))))


def condition_rows(spark: SparkSession, path: str) -> DataFrame:
    """Split rows with normalized labels and numbers."""
    r = split_rows(spark, path)
    return r.select(
        "reaction_id", "reactants", "product", N.safe_float(F.col("yield")).alias("yield_value"), L.normalize_labels(F.col("reagent")).alias("reagent_norm"),
        L.normalize_labels(F.col("solvent")).alias("solvent_norm"), N.safe_float(F.col("temperature")).alias("temperature"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a dense number from 0 in file order: files by name, lines by place.

    A file is read in blocks, in any order; one count per block is gathered, never the lines.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("m"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    w = Window.partitionBy().orderBy("file", "block")
    starts = counts.select("file", "block", "first", (F.sum("n").over(w) - F.col("n")).alias("base"))
    return lines.join(starts, ["file", "block"]).select((F.col("base") + F.col("m") - F.col("first")).alias("line"), "value")


def routes_from_split(spark: SparkSession, path: str) -> DataFrame:
    """S3: first line of each (reaction, reactants, product), numbered densely in order."""
    from slatewise.operators.cleaning import first_of_each
    from slatewise.plans.running import running

    lines = numbered_lines(spark, path).select("line", F.split("value", "\t").alias("f")).filter(F.size("f") >= 7)
    rows = lines.select("line", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(_fields(schema.SPLIT_ROW)[:3])))
    first = first_of_each(rows, ["reaction_id", "reactants", "product"], ["line"]).withColumn("_all", F.lit(0))
    return running(first, ["_all"], ["line"], F.lit(1), "sample_index").drop("_all", "line").withColumn("sample_index", F.col("sample_index").cast("bigint"))


def route_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per predicted route; queries without routes vanish. A file is one document, or with ``lines`` one per line."""
    cache = spark.read.schema(schema.ROUTE_CACHE).json(path, multiLine=not lines)
    each = cache.select("family", F.explode("reactions").alias("q"))
    return each.select("family", "q.sample_index", "q.reaction_id", "q.product", "q.gold_reactants", F.inline("q.routes"))


def route_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Each query once; the job fails on a repeated number."""
    cache = spark.read.schema(schema.ROUTE_CACHE).json(path, multiLine=not lines)
    each = cache.select("family", F.explode("reactions").alias("q")).groupBy("family", "q.sample_index").agg(F.count("*").alias("n"))
    bad = F.when(F.col("n") > 1, F.raise_error(F.lit("a query is listed twice")).cast("int"))
    return each.withColumn("n", F.coalesce(bad, F.lit(1))).filter("n = 1").select("family", "sample_index")


def raw_export(spark: SparkSession, path: str, columns: tuple[str, ...] = schema.RAW_COLUMNS) -> DataFrame:
    """A CSV export with its wanted columns, as UTF-8 or, where that leaves replacement signs, as Windows-1252.

    Spark reads ISO-8859-1, which takes every byte; the signs that Windows-1252 has in
    the place of control characters are put in afterwards. Spreadsheets must be converted beforehand.
    """

    def read(encoding: str) -> DataFrame:
        return spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')

    table = read("utf-8")
    if table.filter(F.concat_ws("", *(F.col(f"`{c}`") for c in table.columns)).contains("\ufffd")).limit(1).count():
        control = "".join(map(chr, range(0x80, 0xA0)))
        windows = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace").replace("\ufffd", " ")
        table = read("iso-8859-1")
        table = table.select(*(F.translate(F.col(f"`{c}`"), control, windows).alias(c) for c in table.columns))
    return table.select(*(F.col(f"`{c}`") if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns))


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case names to tokens; of repeated names the last line counts, ``none`` is no token."""
    rows = numbered_lines(spark, path).select("line", F.split("value", "\t").alias("f")).filter(F.size("f") >= 2)
    each = rows.select("line", F.lower(F.trim(F.get("f", F.lit(0)))).alias("name"), F.trim(F.get("f", F.lit(1))).alias("token"))
    return each.filter("name <> '' AND lower(token) NOT IN ('', 'none')").groupBy("name").agg(F.max_by("token", "line").alias("token"))


def directory(spark: SparkSession, path: str, pattern: str = "[!~]*.csv", **options) -> DataFrame:
    """All files of a folder but lock files (``~$...``)."""
    return spark.read.csv(path, pathGlobFilter=pattern, header=True, **options)


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One object per line; a bad line fails the job and is shown in the error."""
    return spark.read.schema(ddl).json(path, mode="FAILFAST")


def packed_bits(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints as arrays of 64-bit words."""
    return spark.read.schema("id bigint, words array<bigint>").parquet(path)


def score_columns(spark: SparkSession, path: str, columns: list[str], score: str) -> DataFrame:
    """Wanted columns of a CSV table; fails if one is absent, or in the job if a score is no number."""
    table = spark.read.csv(path, header=True)
    if absent := [c for c in columns if c not in table.columns]:
        raise ValueError(f"columns absent: {absent}")
    value = table[score].try_cast("double")
    checked = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("a score is no number")).cast("double")).otherwise(value)
    return table.select(*(checked.alias(c) if c == score else F.col(f"`{c}`") for c in columns))


def paired_files(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Two files line by line; fails in the job if their lengths differ."""
    from slatewise.operators.sequences import paired_lines

    return paired_lines(numbered_lines(spark, a).withColumnRenamed("value", "first"), numbered_lines(spark, b).withColumnRenamed("value", "second"), "line")


def generation_log(spark: SparkSession, path: str) -> DataFrame:
    """Hypothesis lines ``H-n<tab>score<tab>tokens`` with their positional scores ``P-n<tab>scores``, in order of the file."""
    lines = numbered_lines(spark, path).filter(F.col("value").rlike("^[HP]-[0-9]+\t"))
    f = F.split("value", "\t")
    rows = lines.select("line", F.substring("value", 1, 1).alias("kind"), F.regexp_extract("value", "^.-([0-9]+)", 1).cast("bigint").alias("sample"), f.alias("f"))
    # a hypothesis's scores follow it: both get the same place among their kind within the sample
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("sample", "kind").orderBy("line")))
    h = placed.filter("kind = 'H'").select("sample", "place", "line", F.get("f", F.lit(1)).try_cast("double").alias("score"), F.get("f", F.lit(2)).alias("hypothesis"))
    p = placed.filter("kind = 'P'").select("sample", "place", F.transform(F.split(F.get("f", F.lit(1)), " "), lambda x: x.try_cast("double")).alias("positional"))
    return h.join(p, ["sample", "place"], "left").withColumn("mean_log_prob", N.mean_log_prob(F.col("positional")))


def token_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Encoded sequences as arrays."""
    return spark.read.schema("id bigint, ids array<int>").parquet(path)


def gzip_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Gzipped CSV with a stated schema."""
    return spark.read.schema(ddl).csv(path, header=True)


def partitioned(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """A table laid out by family, split and seed; only the folders wanted are read."""
    out = spark.read.parquet(path)
    for c, v in wanted.items():
        out = out.filter(F.col(c) == v)
    return out


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def mapped_tokens(table: DataFrame, cell: Column, names: DataFrame, most: int = 100_000) -> DataFrame:
    """``table`` with the cell's tokens standardized through a name map, whose size is checked before it becomes one value."""
    if names.limit(most + 1).count() > most:
        raise ValueError("the name map is too large for one value; join it instead")
    one = names.agg(F.map_from_entries(F.collect_list(F.struct("name", "token"))).alias("_map"))
    return table.crossJoin(F.broadcast(one)).withColumn("standard", L.map_tokens(cell, F.col("_map"))).drop("_map")
