"""Problem 5: labels typed by hand mapped to a reference list. SQL only.

A partition-based pigeonhole join finds the entry of each distinct label within its role:
each reference string is cut into k + 1 segments, at least one of which stands
unchanged, slightly shifted, in any string within k edits; an equality join on (role,
length, segment number, substring) finds the candidates, and the built-in ``levenshtein``
verifies them. Strings of an entry are its name as letters and digits only, and its words in
order (``of`` ignored), both with k = 0 up to 2 signs, 1 up to 4, then 2, 3 from 8, 4 from 12,
and its short name with k = 0. Strings of a label are the same two, and the label without
the caller's words of delivery (``Wording``). An edit and its neighbour exchanged count as two.
The one match that the join cannot find is a label cut off with a dot, the beginning of a name.

Of the matches of a label the best kind decides:

0. the same letters and digits as a name or a short name;
1. the same once words of delivery are left out;
2. the same words in another order;
3. a label that ends in a dot and is cut off: the beginning of a name;
4. at most k edits from a name, in either word order.

Ties within a kind: fewer edits, then the same first sign, then the nearer
length, then the smaller ref_id. A label of no kind is found by the anti-join
and reported as -1.

Defined cases: null, blank and missing-word labels are no labels; a label equal
to an entry's name letter for letter, outer blanks aside, is no case; equal
results of one row count once; an empty reference list gives -1 throughout;
repeated reference rows do no harm; extra columns are ignored. The reference
list is broadcast only while it has at most ``BROADCAST_ROWS`` entries.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions.text import BLANK, MISSING_WORDS
from slatewise.plans.skew import join_on_counted
from slatewise.shared import written

BROADCAST_ROWS = 20_000



@dataclass(frozen=True)
class Wording:
    """What a label may say besides the name. Empty by default; a caller's table of words adds to what is found, the join does without."""

    #: Words, in lower case, that say how a thing is delivered and not which it is; regular expressions.
    decorations: tuple[str, ...] = ()
    #: Other spellings of the same word.
    spellings: dict[str, str] = field(default_factory=dict)
    #: A regular expression of amounts and strengths.
    amount: str = ""


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _forms(source: str, wording: Wording) -> str:
    """SQL of the labels of ``source`` with ``plain``, ``stripped`` and ``sorted``."""
    bare = f"lower(regexp_replace(translate(label, '‐‑‒–—−·', '------,'), {_sql('(?:' + BLANK + '|[_/]|,(?=' + BLANK + '))+')}, ' '))"
    for old, new in wording.spellings.items():
        bare = f"replace({bare}, {_sql(old)}, {_sql(new)})"
    cut = "bare"
    for words in (wording.amount, "(?<![a-z0-9])(" + "|".join(wording.decorations) + ")(?![a-z0-9])" if wording.decorations else ""):
        cut = f"regexp_replace({cut}, {_sql(words)}, ' ')" if words else cut
    return f"""
      SELECT *, regexp_replace(bare, '[^a-z0-9]', '') AS plain, regexp_replace(cut, '[^a-z0-9]', '') AS stripped,
             array_join(array_sort(filter(split(cut, '[^a-z0-9]+'), w -> w NOT IN ('', 'of'))), '') AS sorted
      FROM (SELECT *, {cut} AS cut FROM (SELECT *, {bare} AS bare FROM {source}))
    """


_MAP = """
WITH ref_rows AS (
  SELECT DISTINCT label_role, ref_id, label_name AS label, short_name FROM {reference} WHERE label_name IS NOT NULL
), ref AS (
  SELECT label_role, ref_id, label, plain, sorted, regexp_replace(lower(short_name), '[^a-z0-9]', '') AS short FROM ({ref_forms})
), lab AS (
  SELECT label_role, label, plain, stripped, sorted FROM ({label_forms})
), by_start AS (
  SELECT l.label_role, l.label, struct(3 AS kind, 0 AS edits, false AS other_start, length(r.plain) - length(l.plain) AS far, r.ref_id) AS rating
  FROM lab l JOIN ref r ON r.label_role = l.label_role AND left(r.plain, 4) = left(l.plain, 4)
  WHERE l.label RLIKE '[.][^a-zA-Z0-9]*$' AND length(l.plain) >= 4 AND startswith(r.plain, l.plain)
), ref_text AS (
  SELECT *, length(s) AS n, CASE WHEN NOT is_name OR length(s) <= 2 THEN 0 WHEN length(s) <= 4 THEN 1 WHEN length(s) < 8 THEN 2 WHEN length(s) < 12 THEN 3 ELSE 4 END AS k
  FROM (SELECT label_role, ref_id, x.s, bool_or(x.what = 0) AS is_plain, bool_or(x.what = 1) AS is_sorted, bool_or(x.what = 2) AS is_short, bool_or(x.what < 2) AS is_name
        FROM (SELECT label_role, ref_id, explode(array(struct(plain AS s, 0 AS what), struct(sorted AS s, 1 AS what), struct(short AS s, 2 AS what))) AS x FROM ref)
        WHERE x.s <> '' GROUP BY label_role, ref_id, x.s)
), ref_cut AS (
  SELECT *, n div (k + 1) AS base, n % (k + 1) AS larger FROM ref_text
), ref_segment AS (
  SELECT label_role, ref_id, s, n, k, i, is_plain, is_sorted, is_short,
         substring(s, cast(i * base + greatest(0, i - (k + 1 - larger)) + 1 AS int), cast(base + if(i >= k + 1 - larger, 1, 0) AS int)) AS piece
  FROM (SELECT *, explode(sequence(0, k)) AS i FROM ref_cut)
), lengths AS (
  SELECT DISTINCT label_role, n, k, base, larger FROM ref_cut
), lab_text AS (
  SELECT label_role, label, x.t, length(x.t) AS m, bool_or(x.what = 0) AS as_plain, bool_or(x.what = 1) AS as_stripped, bool_or(x.what = 2) AS as_sorted
  FROM (SELECT label_role, label, explode(array(struct(plain AS t, 0 AS what), struct(stripped AS t, 1 AS what), struct(sorted AS t, 2 AS what))) AS x FROM lab)
  WHERE x.t <> '' GROUP BY label_role, label, x.t
), lab_segment AS (
  SELECT label_role, label, t, n, k, i, as_plain, as_stripped, as_sorted, substring(t, p, len) AS piece
  FROM (SELECT label_role, label, t, m, n, k, i, len, as_plain, as_stripped, as_sorted, explode(sequence(low, high)) AS p
        FROM (SELECT label_role, label, t, m, n, k, i, len, as_plain, as_stripped, as_sorted,
                     cast(greatest(1, start - i, start + (m - n) - (k - i)) AS int) AS low,
                     cast(least(m - len + 1, start + i, start + (m - n) + (k - i)) AS int) AS high
              FROM (SELECT t.*, g.n, g.k, g.i, cast(g.i * g.base + greatest(0, g.i - (g.k + 1 - g.larger)) + 1 AS int) AS start,
                           cast(g.base + if(g.i >= g.k + 1 - g.larger, 1, 0) AS int) AS len
                    FROM lab_text t JOIN (SELECT *, explode(sequence(0, k)) AS i FROM lengths) g
                      ON g.label_role = t.label_role AND t.m BETWEEN g.n - g.k AND g.n + g.k))
        WHERE high >= low)
), by_edits AS (
  SELECT label_role, label,
         struct(CASE WHEN edits > 0 THEN 4 WHEN as_plain AND (is_plain OR is_short) THEN 0 WHEN as_stripped AND (is_plain OR is_short) THEN 1 WHEN as_sorted AND is_sorted THEN 2 ELSE 4 END AS kind,
                edits + if(edits = 0 AND NOT is_plain AND is_short, 1, 0) AS edits, other_start, far, ref_id) AS rating
  FROM (SELECT DISTINCT a.label_role, a.label, a.t, b.s, b.ref_id, b.k, as_plain, as_stripped, as_sorted, is_plain, is_sorted, is_short, levenshtein(a.t, b.s, b.k) AS edits,
               left(a.t, 1) <> left(b.s, 1) AS other_start, abs(length(a.t) - b.n) AS far
        FROM lab_segment a JOIN ref_segment b
          ON b.label_role = a.label_role AND b.n = a.n AND b.k = a.k AND b.i = a.i AND b.piece = a.piece)
  WHERE edits >= 0 AND (is_plain OR is_sorted OR as_plain OR as_stripped)
), rated AS (
  SELECT label_role, label, min(rating) AS best
  FROM (SELECT * FROM by_start UNION ALL SELECT * FROM by_edits)
  GROUP BY label_role, label
), mapped AS (
  SELECT label_role, label, best.ref_id AS ref_id, best.kind AS kind FROM rated
)
SELECT * FROM mapped
UNION ALL
SELECT l.label_role, l.label, -1, 5 FROM lab l LEFT ANTI JOIN mapped m ON m.label_role = l.label_role AND m.label = l.label
"""


def typed_labels(rows: DataFrame, reference: DataFrame, roles: dict[str, str], row_id: str) -> DataFrame:
    """``(row_id, label_role, label)`` of each label that is not a name of its role as it stands."""
    spark, view = rows.sparkSession, f"typed_{uuid.uuid4().hex}"
    cells = ", ".join(f"struct({_sql(role)} AS label_role, `{column}` AS cell)" for column, role in roles.items())
    missing = ", ".join(map(_sql, ("", *MISSING_WORDS)))
    rows.select(row_id, *roles).createOrReplaceTempView(view)
    reference.select("label_role", "label_name").createOrReplaceTempView(f"{view}_ref")
    hint = "/*+ BROADCAST(r) */" if reference.count() <= BROADCAST_ROWS else ""
    return spark.sql(f"""
      SELECT {hint} t.* FROM (
        SELECT row_id, label_role, label FROM (
          SELECT row_id, label_role, explode(transform(split(cell, '[;|]'), x -> regexp_replace(x, {_sql(f'^{BLANK}+|{BLANK}+$')}, ''))) AS label
          FROM (SELECT `{row_id}` AS row_id, inline(array({cells})) FROM {view}) WHERE cell IS NOT NULL)
        WHERE lower(regexp_replace(label, {_sql(f'{BLANK}+')}, ' ')) NOT IN ({missing})) t
      LEFT ANTI JOIN {view}_ref r ON r.label_role = t.label_role AND r.label_name = t.label
    """)


def map_labels(labels: DataFrame, reference: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """``(label_role, label, ref_id, kind)`` of distinct labels; kind 5 and ref_id -1 where none fits."""
    spark, view = labels.sparkSession, f"labels_{uuid.uuid4().hex}"
    labels.select("label_role", "label").createOrReplaceTempView(view)
    reference = reference.select("ref_id", "label_role", "label_name", "short_name")
    (F.broadcast(reference) if reference.count() <= BROADCAST_ROWS else reference).createOrReplaceTempView(f"{view}_ref")
    return spark.sql(_MAP.format(reference=f"{view}_ref", ref_forms=_forms("ref_rows", wording), label_forms=_forms(view, wording)))


def label_mapping(rows: DataFrame, reference: DataFrame, roles: dict[str, str], row_id: str = "row_id", wording: Wording = Wording()) -> DataFrame:
    """``(row_id, label_role, ref_id)`` for each typed label of each row."""
    typed = written(typed_labels(rows, reference, roles, row_id), "typed-labels")
    counted = written(typed.groupBy("label_role", "label").agg(F.count("*").alias("n")), "distinct-labels")
    key = F.concat_ws("\x1f", "label_role", "label").alias("key")
    mapping = written(map_labels(counted, reference, wording).join(counted, ["label_role", "label"]).select(key, "ref_id", "n"), "label-mapping")
    found = join_on_counted(typed.select("row_id", "label_role", key), mapping, "key", "n")
    return found.select("row_id", "label_role", "ref_id").distinct()
