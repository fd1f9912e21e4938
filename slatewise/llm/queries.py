"""The pN queries, each over its whole tables with production parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.canonical_labels import Wording, label_mapping
from slatewise.llm.format_duplicates import DuplicateLedger, canonical_key
from slatewise.llm.linked_splits import assign_splits, condition_groups, groups_of_two, yield_band
from slatewise.llm.mixing import draw, shares_reached
from slatewise.llm.oracle import ORACLE
from slatewise.llm.split_overlap import split_overlap
from slatewise.llm.subjects import document_subjects
from slatewise.llm.term_frequency import TermCounts
from slatewise.llm.tokenizer import decode, encode, token_counts
from slatewise.llm.top_per_group import ascending, descending, top_items
from slatewise.shared import new_folder, written

# Words that say how a substance is delivered, not which it is.
TRADE_WORDS = (
    "aq", "aqueous", "cat", "catalytic", "sat", "saturated", "dry", "anhydrous", "excess", "degassed", "distilled", "conc",
    "concentrated", "dilute", "fresh", "freshly", "powder", "powdered", "solution", "soln", "monohydrate", "dihydrate", "trihydrate",
    "hydrate", "hemihydrate", "pellets", "granular", "solid", "neat", "crude", "pure", "reagent grade", "technical", "grade a", "x[ -]?h2o",
)
# Other spellings of the same word.
SPELLINGS = {"sulph": "sulf", "aluminum": "aluminium", "cesium": "caesium", "hcl salt": "hydrochloride", "hbr salt": "hydrobromide"}
# An amount or strength, as `2 M`, `10 mol%`, `99%`, `1.5 equiv`.
AMOUNT = r"[0-9]+([.,][0-9]+)?([ -]?mol ?%| ?wt ?%| ?vol ?%| ?%|[ -](m|n|mm|ml|mg|g|eq|equiv)[.]?)(?![a-z0-9])"
TRADE = Wording(TRADE_WORDS, SPELLINGS, AMOUNT)
MOST_NAMES = 1000
LABEL_FIELDS = ["reagent_norm", "solvent_norm"]
LABEL_ROLES = {"reagent_norm": "reagent", "solvent_norm": "solvent"}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _few(table: DataFrame) -> list:
    """The rows of a table of names; fails where they are more than a plan can hold."""
    rows = table.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return rows


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups_of_two(condition_groups(_table(spark, sf, "condition_records")), "record_id")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its group and split; strata are bands of yield."""
    records = _table(spark, sf, "condition_records")
    labels = records.select("record_id", yield_band(F.col("yield_value")).alias("label"))
    shares = [(r["split_name"], r["target_share"]) for r in sorted(_few(_table(spark, sf, "split_shares").select("split_name", "target_share")))]
    return assign_splits(condition_groups(records).join(labels, "record_id"), shares).select("record_id", "group_id", "label", "split_name")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Share of all records per split, and of each label within it, beside the targets."""
    rows = p1_splits(spark, sf).groupBy("split_name", "label").agg(F.count("*").alias("records"))
    shares = _table(spark, sf, "split_shares")
    by_split, by_label, whole = Window.partitionBy("split_name"), Window.partitionBy("label"), Window.partitionBy()
    share = F.sum("records").over(by_split) / F.sum("records").over(whole)
    shift = F.col("records") / F.sum("records").over(by_split) - F.sum("records").over(by_label) / F.sum("records").over(whole)
    return rows.withColumns({"reached_share": share, "label_shift": shift}).join(F.broadcast(shares), "split_name", "left")


def _term_counts(spark: SparkSession, sf: str) -> TermCounts:
    """Two loads: the rows with a load time, then those delivered without one."""
    rows = _table(spark, sf, "condition_rows").select(*LABEL_FIELDS, "loaded_at")
    counts = TermCounts(spark, new_folder(spark, "term-counts"), LABEL_FIELDS)
    counts.apply(added=rows.filter("loaded_at IS NOT NULL"))
    counts.apply(added=rows.filter("loaded_at IS NULL"))
    return counts


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _term_counts(spark, sf).marked().filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _term_counts(spark, sf).marked()


def _ledger(spark: SparkSession, sf: str) -> tuple[DuplicateLedger, DataFrame]:
    rows = _table(spark, sf, "condition_rows")
    keyed = written(rows.select(F.col("row_id").alias("id"), canonical_key().alias("key"), F.col("loaded_at").isNull().alias("late")), "row-keys")
    ledger = DuplicateLedger(spark, new_folder(spark, "duplicate-ledger"))
    ledger.apply(keyed.filter("NOT late"))
    ledger.apply(keyed.filter("late"))
    return ledger, keyed


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    ledger, keyed = _ledger(spark, sf)
    return ledger.copies_of(keyed).select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))


def p3_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return _ledger(spark, sf)[0].entries().select(F.col("first_id").alias("first_row_id"), "copies")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    routes = top_items(
        _table(spark, sf, "route_proposals"), "sample_index", [F.col("reactants")],
        [*ascending(F.col("retro_rank")), *descending(F.col("retro_score")), F.col("proposal_id")], "proposal_id",
    )
    reagent, solvent = (F.coalesce(c, F.lit("")) for c in LABEL_FIELDS)
    contexts = top_items(
        _table(spark, sf, "context_predictions"), "sample_index", [reagent, solvent],
        [*descending(F.col("score")), reagent, solvent, F.col("prediction_id")], "prediction_id",
    )
    return routes.select(F.lit("route").alias("item_kind"), "sample_index", F.col("proposal_id").alias("item_id")).unionAll(
        contexts.select(F.lit("context"), "sample_index", "prediction_id")
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """With the words of delivery of this trade as the caller's wording."""
    return label_mapping(_table(spark, sf, "condition_rows"), _table(spark, sf, "label_reference"), LABEL_ROLES, wording=TRADE)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = split_overlap(_table(spark, sf, "system_records"))
    return pairs.select(F.least("train_id", "evaluation_id").alias("record_id_1"), F.greatest("train_id", "evaluation_id").alias("record_id_2")).distinct()


def p6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per overlapping evaluation record: its train partners and the best coverage of its values."""
    pairs = split_overlap(_table(spark, sf, "system_records"))
    return pairs.groupBy(F.col("evaluation_id").alias("record_id"), "split_name", "source").agg(
        F.count("*").alias("links"), F.max("product_coverage").alias("product_coverage"), F.max("route_coverage").alias("route_coverage")
    )


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping records and mean coverage per split and source."""
    return p6_coverage(spark, sf).groupBy("split_name", "source").agg(
        F.count("*").alias("records"), F.sum("links").alias("links"), F.avg("product_coverage").alias("product_coverage"), F.avg("route_coverage").alias("route_coverage")
    )


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(_table(spark, sf, "documents"))


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts come back from their ids as they were."""
    documents = _table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    back = decode(encode(_table(spark, sf, "documents"))).join(documents, "doc_id")
    return back.agg(F.count("*").alias("documents"), F.sum((F.col("text") == F.col("original")).cast("bigint")).alias("restored"), F.sum(F.size("ids")).alias("tokens"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of the documents of the sources asked for."""
    documents, mix = _table(spark, sf, "documents"), _table(spark, sf, "source_mix")
    wanted = documents.join(F.broadcast(mix.select("source").distinct()), "source", "left_semi").select("doc_id", "source", "text")
    return written(token_counts(wanted, carry=("source",)), "sized-documents")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The largest draw that keeps all targets and limits: the exponent is 0."""
    return draw(_sized(spark, sf), _table(spark, sf, "source_mix"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return shares_reached(p8_mix(spark, sf), _table(spark, sf, "source_mix"))


def p8_larger_report(spark: SparkSession, sf: str) -> DataFrame:
    """A draw of a hundredth more tokens than the targets and limits allow: the least exponent at which the limits allow it is bisected."""
    sized, mix = _sized(spark, sf), _table(spark, sf, "source_mix")
    total = draw(sized, mix).agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0
    return shares_reached(draw(sized, mix, 1.01 * total), mix)


def p8_entropy_report(spark: SparkSession, sf: str) -> DataFrame:
    """A draw by natural shares to the exponent at which their entropy is that of the targets."""
    sized, mix = _sized(spark, sf), _table(spark, sf, "source_mix")
    shares = [r["target_share"] for r in _few(mix.select("target_share")) if r["target_share"] and r["target_share"] > 0]
    return shares_reached(draw(sized, mix, entropy=-sum(s * math.log(s) for s in shares)), mix)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    subjects = sorted(r["subject"] for r in _few(_table(spark, sf, "subject_areas").select("subject")))
    return document_subjects(_table(spark, sf, "documents"), _table(spark, sf, "subject_samples"), subjects)


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per subject, and their share of all documents."""
    total = _table(spark, sf, "documents").count()
    return p9_found(spark, sf).groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / total)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_report, p2_found, p2_counts, p3_found, p3_collapsed, p4_found, p5_found, p6_found, p6_coverage, p6_report, p7_ids, p7_roundtrip, p8_mix, p8_report, p8_larger_report, p8_entropy_report, p9_found, p9_composition)
}

__all__ = ["ORACLE", "QUERIES"]
