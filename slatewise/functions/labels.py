"""Label cells and tokens: F1, F2, F5, F6, F7, F22, F33, F34, F38, P4, P9, P10, P14."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.text import MISSING_WORDS, trim_blank


def tokens(cell: Column, separator: str = ";") -> Column:
    """trimmed, non-empty tokens of a cell in order; empty array for null."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda x: trim_blank(x)), lambda x: x != "")


def label_tokens(cell: Column) -> Column:
    """the tokens that are labels: none of the missing words, in any letter case. Repeats stay."""
    return F.filter(tokens(cell), lambda x: ~F.lower(x).isin(*MISSING_WORDS))


def token_count(cell: Column) -> Column:
    return F.size(tokens(cell))


def normalize_labels(cell: Column) -> Column:
    """distinct labels without missing words in code-point order, joined by ``'; '``."""
    return F.array_join(F.array_sort(F.array_distinct(label_tokens(cell))), "; ")


def distinct_in_string(cell: Column) -> Column:
    """distinct tokens in first-seen order, joined by ``'; '``."""
    return F.array_join(F.array_distinct(tokens(cell)), "; ")


def is_missing(c: Column) -> Column:
    """null or one of the missing words; the empty text is not missing."""
    return F.coalesce(F.lower(F.trim(c)).isin(*MISSING_WORDS), F.lit(True))


def merge_cells(a: Column, b: Column) -> Column:
    """P10: both cells by ``'; '``, the one that is present, or null."""
    present = [F.when(~is_missing(c) & (c != ""), c) for c in (a, b)]
    return F.nullif(F.concat_ws("; ", *present), F.lit(""))


def map_tokens(cell: Column, mapping: Column) -> Column:
    """each token replaced through a map keyed in lower case, unknown ones kept."""
    return F.array_join(F.transform(tokens(cell), lambda x: F.coalesce(F.element_at(mapping, F.lower(x)), x)), "; ")


# Hydrate words cut off a label.
HYDRATES = ("mono", "di", "tri", "tetra", "penta", "hexa", "hepta", "octa", "nona", "deca", "")


def strip_hydrate(c: Column) -> Column:
    """a label without hydrate words after blanks."""
    return F.trim(F.regexp_replace(c, rf"(?i)\s+({'|'.join(HYDRATES)})hydrate", ""))


def repair_oxidation(c: Column) -> Column:
    """``?`` as ``-``; a number in brackets of i, v, x, l becomes Roman, ``l`` read as I."""
    dashed = F.translate(c, "?", "-")
    found = F.array_distinct(F.regexp_extract_all(dashed, F.lit(r"\([ivxlIVXL]+\)"), F.lit(0)))
    return F.aggregate(found, dashed, lambda acc, x: F.replace(acc, x, F.upper(F.translate(x, "lL", "II"))))


def standard_label(c: Column) -> Column:
    """trimmed, repaired, without hydrate, blanks collapsed; null where missing."""
    cleaned = F.regexp_replace(strip_hydrate(repair_oxidation(F.trim(c))), r"\s+", " ")
    return F.when(~is_missing(c) & (c != ""), cleaned)


def component_count(c: Column) -> Column:
    """Parts between dots; 0 for null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "[.]")))


def reaction_sides(c: Column, separator: str = ">>") -> Column:
    """``reactants>>product`` as a struct; null product where the separator is absent."""
    sides = F.split(c, separator, 2)
    return F.struct(F.get(sides, F.lit(0)).alias("reactants"), F.get(sides, F.lit(1)).alias("product"))


def strip_atom_maps(c: Column) -> Column:
    """without atom-map numbers."""
    return F.regexp_replace(c, r":\d+", "")


# The tokens of molecule strings.
MOLECULE_TOKEN = (
    r"(\[[^\[\]]+\]|Br|Cl|Si|Na|Li|Mg|Al|Ca|Fe|Zn|Cu|Pd|Pt|Ag|Au|Sn|Pb|Hg|Mn|Cr|Ni|Co|As|Se|Te|[A-Z][a-z]?|[bcnops]"
    r"|%\d{2}|\d|\(|\)|\.|=|#|-|\+|\\|/|:|@|\?|\*|\$)"
)


def molecule_tokens(c: Column) -> Column:
    """tokens of a molecule string."""
    return F.regexp_extract_all(c, F.lit(MOLECULE_TOKEN), F.lit(0))


def is_lossless(c: Column) -> Column:
    """whether the tokens make up the whole string."""
    return F.array_join(molecule_tokens(c), "") == c


def same_components(a: Column, b: Column) -> Column:
    """equal sets of dot-separated components."""

    def bag(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.split(c, "[.]")))

    return bag(a) == bag(b)


def row_code(prefix: str, n: Column) -> Column:
    """``R0007``."""
    return F.format_string(f"{prefix}%04d", n)
