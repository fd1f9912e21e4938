"""Problem 2: how often each distinct term occurs, kept by signed deltas.

Only added, changed or deleted records are aggregated, into signed changes of
occurrences and of records per term; those are merged into persistent counts
kept in buckets. A changed record is its old form removed and its new form added.

Defined cases: a null, blank or missing-word label is no term, and a null cell
holds none; a term repeated within a cell counts each time as an occurrence and
once as a record; repeated rows are records of their own; an empty batch
changes nothing; an empty table has no terms and no marks; extra columns, of
whatever name, are ignored. A term both rare and common (tables of under 60
rows) is marked rare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.text import MISSING_WORDS, collapse_blank, label_parts
from slatewise.plans.bucketed import BucketedTable

SCHEMA = "field_name string, term string, occurrences bigint, records bigint"


def cell_terms(cell: Column) -> Column:
    """The terms of a label cell, repeats kept."""
    return F.filter(F.transform(label_parts(cell), lambda x: F.lower(collapse_blank(x))), lambda x: ~x.isin("", *MISSING_WORDS))


def term_changes(records: DataFrame, fields: list[str], sign: int = 1) -> DataFrame:
    """Signed occurrences and records per (field, term) of ``records``."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), cell_terms(F.col(f)).alias("terms")) for f in fields)))
    term = F.explode(F.array_distinct("cell.terms"))
    rows = records.select(cells.alias("cell")).select("cell", term.alias("term"))
    times = F.size(F.filter("cell.terms", lambda x: x == F.col("term")))
    return (
        rows.select("cell.field_name", "term", times.alias("times"))
        .groupBy("field_name", "term")
        .agg((F.sum("times") * sign).alias("occurrences"), (F.count("*") * sign).alias("records"))
    )


def added_up(parts: list[DataFrame]) -> DataFrame:
    """The sum of several tables of changes; terms that come to nothing vanish."""
    total = reduce(DataFrame.unionByName, parts).groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.filter("occurrences <> 0 OR records <> 0")


class TermCounts:
    """Persistent counts of the terms of ``fields`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int | None = None):
        schema = spark.createDataFrame([], SCHEMA).schema
        self.fields = fields
        self.table = BucketedTable(spark, path, schema, ["field_name", "term"], buckets)

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Count a batch; ``removed`` must hold records as they were when added."""
        given = [(d, s) for d, s in ((added, 1), (removed, -1)) if d is not None]
        changes = [term_changes(d, self.fields, s) for d, s in given]
        total = sum(s * d.count() for d, s in given)
        batch = added_up(changes) if len(changes) > 1 else changes[0]
        self.table.merge(batch, lambda old, new: added_up([old, new]), records=total)

    def counts(self) -> DataFrame:
        return self.table.read().select("field_name", "term", "occurrences", "records")

    def marked(self, rare_below: int = 3, common_share: float = 1 / 20) -> DataFrame:
        """The counts with ``mark``: ``rare``, ``common``, or null for a useful term."""
        total = self.table.totals.get("records", 0)
        mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.lit(total * common_share), "common")
        return self.counts().withColumn("mark", mark)
