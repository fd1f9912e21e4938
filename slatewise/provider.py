"""Molecule providers: F8, F9, F21, F30. No text rule stands in for chemistry.

A provider gives canonical keys, fingerprints and descriptors. ``ColumnProvider``
takes them from a table made elsewhere; ``ToolkitProvider`` computes
them with RDKit where that can be imported. An unknown or invalid molecule gives the empty
key, and a side with one invalid part is invalid as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MoleculeProvider(Protocol):
    def canonical(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the canonical key of ``column`` as ``name``."""
        ...


class ColumnProvider:
    """Keys from a table ``(raw, canonical, is_valid, ...)``, one row per raw text."""

    def __init__(self, table: DataFrame):
        self.table = table

    def canonical(self, df: DataFrame, column: str, name: str) -> DataFrame:
        known = self.table.select(F.col("raw").alias("_raw"), F.when(F.col("is_valid"), F.col("canonical")).alias("_key"))
        return df.join(known, df[column] == F.col("_raw"), "left").withColumn(name, F.coalesce("_key", F.lit(""))).drop("_raw", "_key")

    def attached(self, df: DataFrame, column: str, extra: list[str]) -> DataFrame:
        """``df`` with further columns of the table (fingerprints, descriptors, scaffolds)."""
        return df.join(self.table.select(F.col("raw").alias("_raw"), *extra), df[column] == F.col("_raw"), "left").drop("_raw")


class ToolkitProvider:
    """Keys computed once per distinct text; needs RDKit."""

    def __init__(self):
        from rdkit import Chem  # noqa: F401

    def canonical(self, df: DataFrame, column: str, name: str) -> DataFrame:
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from rdkit import Chem

            def key(text: str) -> str:
                mols = [Chem.MolFromSmiles(p) for p in text.split(".") if p]
                return "" if not mols or None in mols else ".".join(sorted(Chem.MolToSmiles(m) for m in mols))

            for b in batches:
                yield pd.DataFrame({"_raw": b["_raw"], "_key": [key(x or "") for x in b["_raw"]]})

        each = df.select(F.col(column).alias("_raw")).distinct().mapInPandas(keys, "_raw string, _key string")
        return df.join(each, df[column].eqNullSafe(each["_raw"]), "left").withColumn(name, F.coalesce("_key", F.lit(""))).drop("_raw", "_key")


def supplied_keys(table: DataFrame, raw: str, canonical: str) -> ColumnProvider:
    """A provider from two columns of a table: the least non-empty key of each raw text."""
    rows = table.filter(F.col(raw).isNotNull()).groupBy(F.col(raw).alias("raw")).agg(F.min(F.when(F.col(canonical) != "", F.col(canonical))).alias("canonical"))
    return ColumnProvider(rows.withColumn("is_valid", F.col("canonical").isNotNull()))
