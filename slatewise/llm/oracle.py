"""DuckDB SQL for those pN queries that SQL can state over whole tables, written apart from the operators."""

from __future__ import annotations

# Unicode blanks as a class of DuckDB's regular expressions
_BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MISSING = "('', 'nan', 'none', 'not given', 'unknown', '-')"


def _one_space(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_BLANK}+', ' ', 'g'), ' ')"


def _known(c: str) -> str:
    return f"CASE WHEN lower({_one_space(c)}) NOT IN {_MISSING} THEN regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g') END"


_P1 = f"""
WITH RECURSIVE base AS (SELECT record_id, upper({_known('reaction_id')}) AS r, {_known('product_canonical')} AS p FROM condition_records),
link AS (SELECT DISTINCT 'r' || a.r AS x, 'r' || b.r AS y FROM base a JOIN base b ON a.p = b.p WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
reach(x, y) AS (SELECT DISTINCT 'r' || r, 'r' || r FROM base WHERE r IS NOT NULL UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
least AS (SELECT x, min(y) AS label FROM reach GROUP BY x),
of_p AS (SELECT p, min(label) AS label FROM base JOIN least ON x = 'r' || r WHERE p IS NOT NULL GROUP BY p),
grouped AS (SELECT record_id, coalesce(least.label, of_p.label, 'p' || base.p, 'i' || record_id) AS g FROM base LEFT JOIN least ON x = 'r' || r LEFT JOIN of_p ON of_p.p = base.p)
SELECT record_id, CASE WHEN g[1] = 'r' THEN g[2:] END AS group_key FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM grouped) WHERE n > 1
"""


def _terms(field: str) -> str:
    terms = f"list_filter(list_transform(string_split_regex(coalesce({field}, ''), '[;|]'), lambda x: lower({_one_space('x')})), lambda x: x NOT IN {_MISSING})"
    return f"SELECT '{field}' AS field_name, row_id, unnest({terms}) AS term FROM condition_rows"


_P2 = f"""
WITH terms AS ({_terms('reagent_norm')} UNION ALL {_terms('solvent_norm')}),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM terms GROUP BY ALL),
marked AS (SELECT *, CASE WHEN occurrences < 3 THEN 'rare' WHEN records > (SELECT count(*) FROM condition_rows) / 20 THEN 'common' END AS mark FROM counts)
"""


def _label_set(field: str) -> str:
    reduced = f"list_transform(string_split_regex(coalesce({field}, ''), '[;|]'), lambda x: lower(regexp_replace(x, '[^0-9A-Za-z]', '', 'g')))"
    return f"list_sort(list_distinct(list_filter({reduced}, lambda x: x NOT IN ('', 'nan', 'none', 'notgiven', 'unknown'))))"


def _number(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} + 0.0 END"


_P3 = f"""
WITH keyed AS (SELECT row_id, product AS a, {_number('yield_value')} AS b, {_number('temperature')} AS c, list_sort(list_filter(string_split(regexp_replace(coalesce(reactants, ''), '{_BLANK}', '', 'g'), '.'), lambda x: x <> '')) AS d,
  {_label_set('reagent_norm')} AS e, {_label_set('solvent_norm')} AS f FROM condition_rows),
grouped AS (SELECT row_id, min(row_id) OVER w AS first_row_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY a, b, c, d, e, f))
"""

_P4 = """
WITH r AS (SELECT sample_index, proposal_id AS id, reactants AS who, retro_rank AS x, CASE WHEN isnan(retro_score) THEN NULL ELSE retro_score END AS s FROM route_proposals),
r1 AS (SELECT *, row_number() OVER (PARTITION BY sample_index, who ORDER BY x NULLS LAST, s DESC NULLS LAST, id) AS own FROM r),
r2 AS (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY x NULLS LAST, s DESC NULLS LAST, id) AS place FROM r1 WHERE own = 1),
c AS (SELECT sample_index, prediction_id AS id, coalesce(reagent_norm, '') AS x, coalesce(solvent_norm, '') AS y, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM context_predictions),
c1 AS (SELECT *, row_number() OVER (PARTITION BY sample_index, x, y ORDER BY s DESC NULLS LAST, id) AS own FROM c),
c2 AS (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY s DESC NULLS LAST, x, y, id) AS place FROM c1 WHERE own = 1)
SELECT 'route' AS item_kind, sample_index, id AS item_id FROM r2 WHERE place <= 5 UNION ALL SELECT 'context', sample_index, id FROM c2 WHERE place <= 5
"""


def _pieces(v: str) -> str:
    parts = f"list_filter(string_split(regexp_replace({v}, '{_BLANK}', '', 'g'), '.'), lambda c: c <> '')"
    each = "CASE WHEN length(c) <= 5 THEN [c] ELSE list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5)) END"
    return f"list_distinct(flatten(list_transform({parts}, lambda c: {each})))"


_P6 = f"""
WITH rows AS (SELECT record_id, split_name = 'train' AS is_train, product_canonical AS p, route_canonical AS r FROM system_records WHERE split_name IN ('train', 'val', 'test')),
p AS (SELECT p, {_pieces('p')} AS x FROM (SELECT DISTINCT p FROM rows WHERE p IS NOT NULL)), q AS (SELECT p, len(x) AS n, unnest(x) AS piece FROM p),
shared AS (SELECT a.p AS p1, b.p AS p2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS common FROM q a JOIN q b ON a.piece = b.piece WHERE a.p IN (SELECT p FROM rows WHERE is_train) AND b.p IN (SELECT p FROM rows WHERE NOT is_train) GROUP BY a.p, b.p),
near AS (SELECT p1, p2 FROM shared WHERE common * 100 >= 65 * (n1 + n2 - common)),
t AS (SELECT r, {_pieces('r')} AS x FROM (SELECT DISTINCT r FROM rows WHERE r IS NOT NULL)),
pairs AS (SELECT a.record_id AS i, b.record_id AS j, u.x AS x, v.x AS y FROM near JOIN rows a ON a.is_train AND a.p = p1 JOIN rows b ON NOT b.is_train AND b.p = p2 JOIN t u ON u.r = a.r JOIN t v ON v.r = b.r WHERE len(u.x) > 0 AND len(v.x) > 0)
SELECT least(i, j) AS record_id_1, greatest(i, j) AS record_id_2 FROM pairs WHERE len(list_intersect(x, y)) * 100 >= 65 * (len(x) + len(y) - len(list_intersect(x, y)))
"""

ORACLE = {
    "p1_found": _P1,
    "p2_found": f"{_P2} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_counts": f"{_P2} SELECT field_name, term, occurrences, records, mark FROM marked",
    "p3_found": f"{_P3} SELECT first_row_id, row_id FROM grouped WHERE row_id <> first_row_id",
    "p3_collapsed": f"{_P3} SELECT first_row_id, copies FROM grouped WHERE row_id = first_row_id",
    "p4_found": _P4,
    "p6_found": _P6,
}
