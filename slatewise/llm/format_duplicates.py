"""Problem 3: records that say the same in other writing, kept in a ledger.

The ledger holds, per canonical key, the number of copies and the earliest
representative. A new batch is aggregated by key, full-outer-joined with the
ledger's matching buckets, counts are added and the earlier representative
stays.

Two records are copies when ``product`` is identical (null equals null),
``yield_value`` and ``temperature`` are equal (null and NaN are one value, as
are 0.0 and -0.0), ``reactants`` hold the same components, each as often
(blanks, order and empty components ignored), and each label cell holds the same set of
labels, a label being its ASCII letters and digits in lower case.

Defined cases: null, empty and blank reactants or label cells hold nothing and
are equal; a missing word is no label, whether before or after the reduction;
ties cannot arise as the smallest id is the representative, and a repeated id
is still one more copy; an empty table has an empty ledger; extra columns are
ignored. Keys are MD5 digests of the canonical text, 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.text import MISSING_WORDS, drop_blank, known_number, label_parts
from slatewise.plans.bucketed import BucketedTable
from slatewise.plans.skew import join_on_counted

SCHEMA = "key binary, copies bigint, first_id bigint"
_REDUCED_MISSING = sorted({"".join(ch for ch in w if ch.isalnum()) for w in MISSING_WORDS})


def label_set(cell: Column) -> Column:
    """The cell's labels reduced to ASCII letters and digits, sorted, as one text."""
    reduced = F.transform(label_parts(cell), lambda x: F.lower(F.regexp_replace(x, "[^0-9A-Za-z]+", "")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(reduced, lambda x: ~x.isin(*_REDUCED_MISSING)))), ";")


def component_bag(c: Column) -> Column:
    """The components between dots, without blanks, sorted, as one text."""
    parts = F.split(drop_blank(F.coalesce(c, F.lit(""))), "[.]")
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), ".")


def number_text(c: Column) -> Column:
    """A number as text; null and NaN alike, one zero."""
    return F.coalesce((known_number(c) + F.lit(0.0)).cast("string"), F.lit(""))


def canonical_key() -> Column:
    """Digest of what makes a condition row, from its columns."""
    parts = [
        F.coalesce(F.concat(F.lit("="), F.col("product")), F.lit("")),
        number_text(F.col("yield_value")),
        number_text(F.col("temperature")),
        component_bag(F.col("reactants")),
        label_set(F.col("reagent_norm")),
        label_set(F.col("solvent_norm")),
    ]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def batch_counts(keyed: DataFrame) -> DataFrame:
    """Copies and earliest id per key of rows ``(id, key)``; counted before the shuffle."""
    return keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


def combine(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of the ledger's rows with a batch's."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(
        F.coalesce("o.key", "n.key").alias("key"),
        (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
        F.least("o.first_id", "n.first_id").alias("first_id"),
    )


class DuplicateLedger:
    """Persistent ledger under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.table = BucketedTable(spark, path, spark.createDataFrame([], SCHEMA).schema, ["key"], buckets)

    def apply(self, keyed: DataFrame) -> None:
        """Enter a batch of ``(id, key)`` rows."""
        self.table.merge(batch_counts(keyed), combine)

    def entries(self) -> DataFrame:
        """One row per distinct record: key, copies, first_id."""
        return self.table.read()

    def copies_of(self, keyed: DataFrame) -> DataFrame:
        """``(first_id, id)`` of each entered row that is not its record's representative."""
        repeated = self.entries().filter("copies > 1")
        return join_on_counted(keyed.select("id", "key"), repeated, "key", "copies").filter("id <> first_id").select("first_id", "id")
