"""Text conventions of the tables: blanks, missing words, label cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Unicode's White_Space property, as a Java class.
BLANK = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Words that stand for a missing value, in any letter case.
MISSING_WORDS = ("nan", "none", "not given", "unknown", "-")


def trim_blank(c: Column) -> Column:
    """``c`` without blanks at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def drop_blank(c: Column) -> Column:
    """``c`` without any blank."""
    return F.regexp_replace(c, f"{BLANK}+", "")


def collapse_blank(c: Column) -> Column:
    """``c`` trimmed, each inner run of blanks made one space."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def is_missing_text(c: Column) -> Column:
    """True for null, empty, blank, or a missing word."""
    word = F.lower(collapse_blank(c))
    return F.coalesce(word.isin("", *MISSING_WORDS), F.lit(True))


def not_missing(c: Column) -> Column:
    """``c`` without outer blanks, or null where it is missing."""
    trimmed = trim_blank(c)
    return F.when(~F.lower(F.regexp_replace(trimmed, f"{BLANK}+", " ")).isin("", *MISSING_WORDS), trimmed)


def label_parts(cell: Column) -> Column:
    """The raw pieces of a label cell, cut at ``;`` and ``|``; empty array for null."""
    return F.split(F.coalesce(cell, F.lit("")), "[;|]")


def known_number(c: Column) -> Column:
    """A double with NaN made null."""
    return F.nanvl(c, F.lit(None).cast("double"))
