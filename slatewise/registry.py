"""Queries by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Unicode blanks as a class of DuckDB's regular expressions
SQL_BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_tokens(cell: str) -> str:
    """DuckDB text for the trimmed, non-empty tokens of a label cell."""
    return f"list_filter(list_transform(string_split(coalesce({cell}, ''), ';'), lambda x: regexp_replace(x, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')), lambda x: x <> '')"


def sql_labels(cell: str) -> str:
    """DuckDB text for the tokens of a label cell that are no missing words."""
    return f"list_filter({sql_tokens(cell)}, lambda w: lower(w) NOT IN ('nan', 'none', 'not given', 'unknown', '-'))"


class Tables:
    """Tables of a folder as attributes, each read with its own schema and only the columns used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(tables) -> DataFrame`` with its SQL twin, or without one where SQL cannot say it."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register
