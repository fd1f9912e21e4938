"""Round trips through sources and sinks in the shared folder, nested tables, providers, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.functions.text import BLANK
from slatewise.operators.features import distinct_mapped
from slatewise.provider import supplied_keys
from slatewise.registry import SQL_BLANK, Tables, query, sql_labels, sql_tokens
from slatewise.shared import new_folder
from slatewise.sources import readers as S
from slatewise.sources import sinks as K
from slatewise.streaming import windows as W

_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"


@query(f"""SELECT reaction_id, reactants, product, {_NUM.format('yield_value')} AS yield_value, coalesce(array_to_string(list_sort(list_distinct({sql_labels('reagent_norm')})), '; '), '') AS reagent_norm,
coalesce(array_to_string(list_sort(list_distinct({sql_labels('solvent_norm')})), '; '), '') AS solvent_norm, {_NUM.format('temperature')} AS temperature
FROM condition_records WHERE concat_ws('', reactants, product, reagent_norm, solvent_norm, reaction_id) NOT SIMILAR TO '(.|\\n)*[\\t\\r\\n](.|\\n)*' AND reactants IS NOT NULL AND product IS NOT NULL AND reaction_id IS NOT NULL""".replace("\\\\", "\\"))
def split_row_roundtrip(t: Tables) -> DataFrame:
    """Records written as headerless lines and read with types."""
    columns = ["reaction_id", "reactants", "product", "yield_value", "reagent_norm", "solvent_norm", "temperature"]
    clean = t.condition_records.filter("reactants IS NOT NULL AND product IS NOT NULL AND reaction_id IS NOT NULL")
    clean = clean.filter(~F.concat_ws("", "reactants", "product", "reagent_norm", "solvent_norm", "reaction_id").rlike("[\\t\\r\\n]"))
    path = new_folder(t.spark, "split-rows")
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))
    clean.select(line).write.text(path)
    return S.condition_rows(t.spark, path)


@query("SELECT o_orderpriority AS family, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def partitioned_table(t: Tables) -> DataFrame:
    """Only one family's folder is read."""
    path = new_folder(t.spark, "by-family")
    K.write_table(t.orders.select(F.col("o_orderpriority").alias("family"), "o_orderkey"), path, ("family",))
    return S.partitioned(t.spark, path, family="1-URGENT").select("family", "o_orderkey")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_lines_roundtrip(t: Tables) -> DataFrame:
    """K3 S9."""
    path = new_folder(t.spark, "json")
    K.write_json_lines(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return S.json_lines(t.spark, path, "p_partkey bigint, p_name string, p_retailprice double").select("p_partkey", "p_name", "p_retailprice")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def gzip_roundtrip(t: Tables) -> DataFrame:
    """K6 S15."""
    path = new_folder(t.spark, "gzip")
    K.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, gzip=True)
    return S.gzip_table(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT sample_index, proposal_id FROM route_proposals WHERE sample_index IS NOT NULL")
def nested_explode(t: Tables) -> DataFrame:
    """Routes nested per query, then taken apart again."""
    nested = t.route_proposals.filter("sample_index IS NOT NULL").groupBy("sample_index", F.pmod(F.xxhash64("proposal_id"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("proposal_id", "retro_rank")).alias("routes"))
    return nested.select("sample_index", F.inline("routes")).select("sample_index", "proposal_id")


@query("SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(t: Tables) -> DataFrame:
    """Fields of a JSON text by a stated schema."""
    return t.events.select(F.from_json("props", "k bigint").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT record_id, coalesce(m.c, '') AS canonical FROM condition_records r LEFT JOIN (SELECT product, min(CASE WHEN product_canonical <> '' THEN product_canonical END) AS c FROM system_records WHERE product IS NOT NULL GROUP BY product) m ON m.product = r.product")
def supplied_canonical(t: Tables) -> DataFrame:
    """Canonical keys from a supplied table; unknown molecules are invalid, never guessed."""
    provider = supplied_keys(t.system_records, "product", "product_canonical")
    return provider.canonical(t.condition_records.select("record_id", "product"), "product", "canonical").select("record_id", "canonical")


@query("SELECT row_id, upper(coalesce(family, 'none')) AS shown FROM condition_rows")
def distinct_mapping(t: Tables) -> DataFrame:
    """A function once per distinct value."""
    return distinct_mapped(t.condition_rows.select("row_id", "family"), "family", "shown", lambda c: F.upper(F.coalesce(c, F.lit("none")))).select("row_id", "shown")


@query(f"""WITH m AS (SELECT lower(short_name) AS name, max(label_name) AS token FROM label_reference WHERE short_name IS NOT NULL GROUP BY ALL), e AS (SELECT row_id, unnest({sql_tokens('solvent_norm')}) AS x, generate_subscripts({sql_tokens('solvent_norm')}, 1) AS i FROM condition_rows)
SELECT r.row_id, coalesce(s.cell, '') AS standard FROM condition_rows r LEFT JOIN (SELECT row_id, string_agg(coalesce(m.token, x), '; ' ORDER BY i) AS cell FROM e LEFT JOIN m ON m.name = lower(x) GROUP BY row_id) s USING (row_id)""")
def standard_labels(t: Tables) -> DataFrame:
    """Short names replaced by names."""
    names = t.label_reference.filter("short_name IS NOT NULL").groupBy(F.lower("short_name").alias("name")).agg(F.max("label_name").alias("token"))
    return S.mapped_tokens(t.condition_rows.select("row_id", "solvent_norm"), F.col("solvent_norm"), names).select("row_id", "standard")


@query("""SELECT l_returnflag, '| ' || l_returnflag || ' | ' || format('{:,.2f}', avg(l_discount)) || ' |' AS text FROM lineitem GROUP BY l_returnflag""")
def markdown_report(t: Tables) -> DataFrame:
    """K7: the body lines of a report."""
    out = K.markdown(t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"))).filter("line = 2")
    return out.select(F.substring("text", 3, 1).alias("l_returnflag"), "text")


@query("SELECT count(*) AS n, count(DISTINCT sample_index) AS numbers, min(sample_index)::BIGINT AS first, max(sample_index)::BIGINT AS last FROM (SELECT row_number() OVER () - 1 AS sample_index FROM (SELECT DISTINCT reaction_id, reactants, product FROM condition_rows WHERE reactants IS NOT NULL AND product IS NOT NULL AND reaction_id IS NOT NULL AND NOT regexp_matches(concat(reactants, product, reaction_id), '[\\t\\r\\n]')))")
def route_scan(t: Tables) -> DataFrame:
    """First line of each route, numbered densely in file order."""
    rows = t.condition_rows.filter("reactants IS NOT NULL AND product IS NOT NULL AND reaction_id IS NOT NULL").filter(~F.concat("reactants", "product", "reaction_id").rlike("[\\t\\r\\n]"))
    path = new_folder(t.spark, "routes")
    rows.select(F.concat_ws("\t", "reaction_id", "reactants", "product", F.lit("1"), F.lit("a"), F.lit("b"), F.lit("2"))).write.text(path)
    return S.routes_from_split(t.spark, path).agg(F.count("*").alias("n"), F.countDistinct("sample_index").alias("numbers"), F.min("sample_index").alias("first"), F.max("sample_index").alias("last"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    """Extension: hourly windows over the events as a stream, all batches run to the end (complete output)."""
    events = W.read_events(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)
    name = f"windows_{uuid.uuid4().hex}"
    out = W.run_to_end(W.windowed_counts(events), name, "complete", new_folder(t.spark, "stream"))
    return out.select("start", "event_type", "n", F.round("value", 6).alias("value"))


@query("SELECT row_id, regexp_replace(regexp_replace(trim(reagent_norm, ' '), '\\s+(mono|di|tri|tetra|penta|hexa|hepta|octa|nona|deca|)hydrate', '', 'gi'), '\\s+', ' ', 'g') AS standard FROM condition_rows WHERE reagent_norm IS NOT NULL AND reagent_norm <> '' AND lower(trim(reagent_norm, ' ')) NOT IN ('nan', 'none', 'not given', 'unknown', '-') AND NOT regexp_matches(reagent_norm, '\\([ivxlIVXL]+\\)|[?]|hydrate *$')")
def hydrate_strip(t: Tables) -> DataFrame:
    """F6, on cells that need no repair and do not end in a hydrate word, as its SQL has it; ``hydrate_standard`` runs over all cells."""
    rows = t.condition_rows.filter("reagent_norm <> ''").filter(~L.is_missing(F.col("reagent_norm"))).filter(~F.col("reagent_norm").rlike(r"\([ivxlIVXL]+\)|[?]|hydrate *$"))
    return rows.select("row_id", L.standard_label(F.col("reagent_norm")).alias("standard"))


@query(rf"""WITH b AS (SELECT row_id, trim(regexp_replace(reagent_norm, '{SQL_BLANK}', ' ', 'g'), ' ') AS x FROM condition_rows WHERE reagent_norm IS NOT NULL AND reagent_norm <> ''),
c AS (SELECT row_id, replace(x, '?', '-') AS x FROM b WHERE lower(x) NOT IN ('nan', 'none', 'not given', 'unknown', '-')),
r AS (SELECT row_id, list_reduce(list_distinct(regexp_extract_all(x, '\([ivxlIVXL]+\)')), lambda acc, y: replace(acc, y, upper(translate(y, 'lL', 'II'))), x) AS x FROM c)
SELECT row_id, regexp_replace(trim(regexp_replace(x, ' +(mono|di|tri|tetra|penta|hexa|hepta|octa|nona|deca|)hydrate', '', 'gi'), ' '), ' +', ' ', 'g') AS standard FROM r""")
def hydrate_standard(t: Tables) -> DataFrame:
    """all cells that are not missing, any Unicode blank being one, with the repair of ``?`` and of numbers in brackets and with hydrate words anywhere."""
    rows = t.condition_rows.filter("reagent_norm <> ''").select("row_id", F.regexp_replace("reagent_norm", BLANK, " ").alias("cell"))
    return rows.filter(~L.is_missing(F.col("cell"))).select("row_id", L.standard_label(F.col("cell")).alias("standard"))
