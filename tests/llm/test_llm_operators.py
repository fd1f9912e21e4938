"""Each dealt operator against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.llm import canonical_labels, format_duplicates, linked_splits, mixing, split_overlap, subjects, term_frequency, tokenizer, top_per_group
from slatewise.llm import queries as Q
from slatewise.shared import new_folder

MISSING = {"nan", "none", "not given", "unknown", "-", ""}
CLASH = {"n": 1, "key": "x", "value": "y", "side": "z", "label": "l", "_row": 3, "pos": 4, "salt": 5}


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items() if c not in df.columns})


def rows(df):
    return {tuple(r) for r in df.collect()}


# 1


def brute_groups(records):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def known(v):
        return None if v is None or " ".join(v.split()).lower() in MISSING else v.strip()

    groups, key = collections.defaultdict(list), {}
    for i, r, p in records:
        find(("i", i))
        for kind, v in (("r", known(r) and known(r).upper()), ("p", known(p))):
            if v:
                parent[find((kind, v))] = find(("i", i))
    for i, r, _ in records:
        g = find(("i", i))
        groups[g].append(i)
        if known(r):
            key[g] = min(key.get(g, known(r).upper()), known(r).upper())
    return {(i, key.get(g)) for g, members in groups.items() if len(members) > 1 for i in members}


def condition_records(spark, data):
    return clashing(spark.createDataFrame(data, "record_id bigint, reaction_id string, product_canonical string"))


def test_groups_of_a_long_chain(spark):
    data = [(i, f"R{(i * 7919) % 400:03d}", f"p{((i * 7919) % 400 + i % 2) % 400}") for i in range(800)]
    chain = [(1000 + i, f"C{i:03d}", f"c{i + j}") for i in range(60) for j in (0, 1)]
    data += [(2000 + i, r, p) for i, (_, r, p) in enumerate(chain)]
    got = rows(linked_splits.groups_of_two(linked_splits.condition_groups(condition_records(spark, data)), "record_id"))
    assert got == brute_groups(data)


def test_groups_with_dirt(spark):
    data = [
        (1, " rx1 ", "A"), (2, "RX1", None), (3, None, "A"), (4, "nan", "A"), (5, None, None), (6, "", " "), (7, "Not Given", "b"), (8, None, "b"), (9, "RX2", "a"), (10, "-", "NONE"),
        (11, "　RX3", "C\n"), (12, "RX4", "C"), (12, "RX4", "C"),
    ]
    got = rows(linked_splits.groups_of_two(linked_splits.condition_groups(condition_records(spark, data)), "record_id"))
    assert got == {(1, "RX1"), (2, "RX1"), (3, "RX1"), (4, "RX1"), (7, None), (8, None), (11, "RX3"), (12, "RX3")}


def test_groups_and_splits_of_nothing(spark):
    empty = linked_splits.condition_groups(condition_records(spark, []))
    assert linked_splits.groups_of_two(empty, "record_id").count() == 0
    labelled = empty.withColumn("label", F.lit("x"))
    assert linked_splits.assign_splits(labelled, [("train", 1.0)]).count() == 0


def test_splits_keep_groups_and_shares(spark, small):
    got = Q.p1_splits(spark, small).collect()
    records = spark.read.parquet(f"{small}/condition_records.parquet")
    assert sorted(r["record_id"] for r in got) == sorted(r[0] for r in records.select("record_id").collect())
    by_group = collections.defaultdict(set)
    for r in got:
        by_group[r["group_id"]].add(r["split_name"])
    assert all(len(s) == 1 for s in by_group.values())
    n = collections.Counter(r["split_name"] for r in got)
    assert set(n) == {"train", "val", "test"} and abs(n["train"] / len(got) - 0.8) < 0.05


def test_splits_are_stratified(spark):
    data = [(f"g{i}", "a" if i % 4 else "b") for i in range(4000)] + [("big", "a")] * 500 + [("nul", None)] * 3
    out = linked_splits.assign_splits(spark.createDataFrame(data, "group_id string, label string"), [("train", 0.5), ("test", 0.5)])
    n = {(r["split_name"], r["label"]): r["count"] for r in out.groupBy("split_name", "label").count().collect()}
    for label, total in (("a", 3500), ("b", 1000)):
        assert abs(n["train", label] / total - 0.5) < 0.03
    assert out.filter("group_id = 'big'").select("split_name").distinct().count() == 1
    assert out.filter("split_name IS NULL").count() == 0 and out.count() == len(data)


def test_splits_without_shares_are_null(spark):
    out = linked_splits.assign_splits(spark.createDataFrame([("g", "a")], "group_id string, label string"), [])
    assert [r["split_name"] for r in out.collect()] == [None]


# 2


def test_terms(spark):
    data = [(1, " A ;a; B  c|", "x"), (2, None, "x;x"), (3, "nan; - ;None", ""), (4, "a", " X")]
    table = clashing(spark.createDataFrame(data, "i int, reagent_norm string, solvent_norm string"))
    counts = term_frequency.TermCounts(spark, new_folder(spark, "t"), ["reagent_norm", "solvent_norm"])
    counts.apply(added=table)
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["records"]) for r in counts.counts().collect()}
    assert got == {("reagent_norm", "a"): (3, 2), ("reagent_norm", "b c"): (1, 1), ("solvent_norm", "x"): (4, 3)}
    marks = {r["term"]: r["mark"] for r in counts.marked().collect()}
    assert marks == {"a": "common", "b c": "rare", "x": "common"}
    # a changed record: removed as it was, added as it is; a deleted one; nothing
    old = table.filter("i = 1")
    counts.apply(added=old.withColumn("reagent_norm", F.lit("b c")), removed=old)
    counts.apply(removed=table.filter("i = 4"))
    counts.apply(added=table.limit(0))
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["records"]) for r in counts.counts().collect()}
    assert got == {("reagent_norm", "b c"): (1, 1), ("solvent_norm", "x"): (3, 2)}
    assert counts.table.totals["records"] == 3
    again = term_frequency.TermCounts(spark, counts.table.path, ["reagent_norm", "solvent_norm"])
    assert again.counts().count() == 2


def test_terms_of_nothing(spark):
    counts = term_frequency.TermCounts(spark, new_folder(spark, "t"), ["a"])
    counts.apply(added=spark.createDataFrame([], "a string"))
    assert counts.marked().count() == 0


def test_increments_equal_one_load(spark, small):
    table = spark.read.parquet(f"{small}/condition_rows.parquet")
    whole = term_frequency.TermCounts(spark, new_folder(spark, "t"), Q.LABEL_FIELDS)
    whole.apply(added=table)
    parts = term_frequency.TermCounts(spark, new_folder(spark, "t"), Q.LABEL_FIELDS)
    for i in range(3):
        parts.apply(added=table.filter(F.col("row_id") % 3 == i))
    assert rows(whole.marked()) == rows(parts.marked())
    assert rows(whole.marked().filter("mark IS NOT NULL").select("field_name", "term", "mark")) == rows(Q.p2_found(spark, small))


# 3


def brute_copies(data):
    def number(x):
        return None if x is None or math.isnan(x) else x + 0.0

    def bag(v):
        return tuple(sorted(c for c in (re.sub(r"\s", "", c) for c in (v or "").split(".")) if c))

    def labels(v):
        reduced = (re.sub("[^0-9A-Za-z]", "", x).lower() for x in re.split("[;|]", v or ""))
        return frozenset(x for x in reduced if x not in {"nan", "none", "notgiven", "unknown", ""})

    first, out = {}, set()
    for i, reactants, product, y, reagent, solvent, t in sorted(data, key=lambda r: r[0]):
        key = (product, number(y), number(t), bag(reactants), labels(reagent), labels(solvent))
        if key in first:
            out.add((first[key], i))
        else:
            first[key] = i
    return out


COLUMNS = "row_id bigint, reactants string, product string, yield_value double, reagent_norm string, solvent_norm string, temperature double"


def copies(spark, data, batches=2):
    table = clashing(spark.createDataFrame(data, COLUMNS)).select(F.col("row_id").alias("id"), format_duplicates.canonical_key().alias("key"))
    ledger = format_duplicates.DuplicateLedger(spark, new_folder(spark, "l"))
    for i in range(batches):
        ledger.apply(table.filter(F.col("id") % batches == i))
    return rows(ledger.copies_of(table)), ledger


def test_copies_in_other_writing(spark):
    nan = float("nan")
    data = [
        (9, "A.B", "P", 1.0, "a; b", None, None), (2, " B . A.", "P", 1.0, "B|A;a", "-", nan), (5, "A.B", "p", 1.0, "a; b", "", None), (6, "A.B.B", "P", 1.0, "a;b", "", None),
        (7, None, None, None, None, None, None), (8, "", None, nan, "Not given", " ", nan), (1, "x", "", 0.0, "a-b", "", 0.0), (3, "x", "", -0.0, "A B", "", -0.0), (4, "x", None, 0.0, "ab", "", 0.0),
    ]
    got, ledger = copies(spark, data)
    assert got == brute_copies(data) == {(2, 9), (7, 8), (1, 3)}
    assert sum(r["copies"] for r in ledger.entries().collect()) == len(data)


def test_copies_with_a_hot_group_and_repeated_ids(spark):
    data = [(i, "A", "P", 1.0, "a", "b", None) for i in range(600)] + [(1000 + i, f"C{i}", "P", 1.0, "a", "b", None) for i in range(600)] + [(1000, "C0", "P", 1.0, "a", "b", None)]
    got, ledger = copies(spark, data, 3)
    assert got == {(0, i) for i in range(1, 600)}
    assert ledger.entries().filter("first_id = 1000").first()["copies"] == 2
    assert copies(spark, [])[0] == set()


def test_copies_on_the_tables(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/condition_rows.parquet").select("row_id", "reactants", "product", "yield_value", "reagent_norm", "solvent_norm", "temperature").collect()]
    assert rows(Q.p3_found(spark, small)) == brute_copies(data)


# 4


def brute_top(data, n=5):
    def score(s):
        return (1, 0) if s is None or math.isnan(s) else (0, -s)

    out = set()
    groups = collections.defaultdict(list)
    for i, g, who, rank, s in data:
        groups[g].append(((rank is None, rank or 0, *score(s), i), who, i))
    for g, items in groups.items():
        seen, place = set(), 0
        for _, who, i in sorted(items, key=lambda x: x[0]):
            if who not in seen and place < n:
                seen.add(who)
                place += 1
                out.add((g, i, place))
    return out


def test_top_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", "c", None, *map(str, range(40))]), rng.choice([None, 1, 2, 3]), rng.choice([None, float("nan"), 0.0, -0.0, 0.5])) for i in range(1500)]
    data = [(i, g, w, r, s) for i, g, w, r, s in data]
    table = clashing(spark.createDataFrame(data, "i bigint, g int, who string, rank int, s double"))
    got = top_per_group.top_items(table, "g", [F.col("who")], [*top_per_group.ascending(F.col("rank")), *top_per_group.descending(F.col("s")), F.col("i")], "i")
    assert rows(got) == brute_top(data)
    assert top_per_group.top_items(table.limit(0), "g", [F.col("who")], [F.col("i")], "i").count() == 0


def test_top_on_the_tables(spark, small):
    routes = [tuple(r) for r in spark.read.parquet(f"{small}/route_proposals.parquet").select("proposal_id", "sample_index", "reactants", "retro_rank", "retro_score").collect()]
    got = {(r["sample_index"], r["item_id"]) for r in Q.p4_found(spark, small).filter("item_kind = 'route'").collect()}
    assert got == {(g, i) for g, i, _ in brute_top(routes)}


# 5


def mapped(spark, cells, reference=None):
    reference = reference or [(1, "solvent", "toluene", "PhMe"), (2, "solvent", "tetrahydrofuran", "THF"), (3, "solvent", "water", None), (4, "solvent", "iron(II) chloride", None), (5, "solvent", "iron(III) chloride", None), (6, "reagent", "acetone", None)]
    table = clashing(spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_id bigint, solvent_norm string"))
    ref = spark.createDataFrame(reference, "ref_id int, label_role string, label_name string, short_name string")
    got = canonical_labels.label_mapping(table, ref, {"solvent_norm": "solvent"}, wording=Q.TRADE)
    out = collections.defaultdict(set)
    for r in got.collect():
        assert r["label_role"] == "solvent"
        out[r["row_id"]].add(r["ref_id"])
    return [out.get(i, set()) for i in range(len(cells))]


def test_labels_meant(spark):
    cells = [
        "toluene", " toluene ;nan| - ", None, "", "TOLUENE", "tolnuee", "phme", "P.h.M.e", "dry THF (99%)", "chloride iron(II)", "chloride of iron(III)", "iron(III) chl.", "tetrahydr.", "quartz sand",
        "acetone", "tolueen; water; watter", "...", "x" * 5000,
    ]
    assert mapped(spark, cells) == [set(), set(), set(), set(), {1}, {1}, {1}, {1}, {2}, {4}, {5}, {5}, {2}, {-1}, {-1}, {1, 3}, {-1}, {-1}]


def test_labels_of_empty_tables(spark):
    assert mapped(spark, []) == []
    empty = spark.createDataFrame([], "ref_id int, label_role string, label_name string, short_name string")
    table = spark.createDataFrame([(1, "a; a"), (1, "a")], "row_id bigint, solvent_norm string")
    assert rows(canonical_labels.label_mapping(table, empty, {"solvent_norm": "solvent"})) == {(1, "solvent", -1)}


def test_labels_without_a_wording(spark):
    ref = spark.createDataFrame([(1, "solvent", "toluene", "PhMe"), (2, "solvent", "DI", None), (3, "solvent", "iron(II) chloride", None)], "ref_id int, label_role string, label_name string, short_name string")
    labels = spark.createDataFrame([("solvent", x) for x in ("TOLUENE", "tolueen", "ph-me", "di", "d", "chloride of iron(II)", "dry toluene")], "label_role string, label string")
    got = {r["label"]: (r["ref_id"], r["kind"]) for r in canonical_labels.map_labels(labels, ref).collect()}
    # names of one or two signs are found by the same join, without edits
    assert got == {"TOLUENE": (1, 0), "tolueen": (1, 4), "ph-me": (1, 0), "di": (2, 0), "d": (-1, 5), "chloride of iron(II)": (3, 2), "dry toluene": (-1, 5)}


def test_pigeonhole_misses_no_near_entry(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdef") for _ in range(n)) for n in range(4, 24) for _ in range(6)]

    def edit(s):
        s = list(s)
        for _ in range({0: 1, 1: 2}.get(len(s) // 5, 3) if len(s) < 12 else 4):
            at, kind = rng.randrange(len(s)), rng.randrange(3)
            if kind == 0:
                s[at] = rng.choice("abcdef")
            elif kind == 1:
                s.insert(at, rng.choice("abcdef"))
            elif len(s) > 3:
                del s[at]
        return "".join(s)

    typed = sorted({edit(n) for n in names for _ in range(4)} - set(names))
    ref = spark.createDataFrame([(i, "s", n, None) for i, n in enumerate(dict.fromkeys(names))], "ref_id int, label_role string, label_name string, short_name string")
    labels = spark.createDataFrame([("s", t) for t in typed], "label_role string, label string")

    def limit(n):
        return 1 if n <= 4 else 2 if n < 8 else 3 if n < 12 else 4

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {t: min((d for n in names if (d := distance(t, n)) <= limit(len(n))), default=None) for t in typed}
    found = {r["label"]: r["ref_id"] for r in canonical_labels.map_labels(labels, ref).collect()}
    index = list(dict.fromkeys(names))
    for t in typed:
        assert (found[t] == -1) == (want[t] is None), t
        if found[t] != -1:
            assert distance(t, index[found[t]]) == want[t], t


# 6


def piece_set(v):
    out = set()
    for c in re.sub(r"\s", "", v or "").split("."):
        if c:
            out.update([c] if len(c) < 5 else [c[i : i + 5] for i in range(len(c) - 4)])
    return out


def brute_overlap(data):
    def near(a, b):
        return bool(a and b) and len(a & b) * 100 >= 65 * len(a | b)

    cut = [(i, s, piece_set(p), piece_set(r)) for i, s, _, p, r in data]
    return {tuple(sorted((a[0], b[0]))) for a in cut if a[1] == "train" for b in cut if b[1] in ("val", "test") and near(a[2], b[2]) and near(a[3], b[3])}


def overlap(spark, data):
    table = clashing(spark.createDataFrame(data, "record_id bigint, split_name string, source string, product_canonical string, route_canonical string"))
    return split_overlap.split_overlap(table)


def found_pairs(df):
    return {tuple(sorted((r["train_id"], r["evaluation_id"]))) for r in df.collect()}


def test_overlap_of_random_edits(spark):
    rng = random.Random(3)

    def value(n):
        return ".".join("".join(rng.choice("CNO()=c1n2[]") for _ in range(rng.choice([3, 8, 20, 45, 90]))) for _ in range(n))

    def edited(v):
        v = list(v)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(v))
            v[at : at + rng.randrange(3)] = rng.choice(["", "C", " ", "Br"])
        parts = "".join(v).split(".")
        rng.shuffle(parts)
        return ".".join(parts)

    data = []
    for i in range(150):
        p, r = value(rng.choice([1, 1, 2])), value(rng.choice([1, 2, 3]))
        data.append((2 * i, "train", "a", p, r))
        data.append((2 * i + 1, rng.choice(["val", "test"]), "b", edited(p), edited(r)))
    want = brute_overlap(data)
    assert len(want) > 40
    assert found_pairs(overlap(spark, data)) == want


def test_overlap_of_scattered_edits(spark):
    """Every component changed at one sign: no long run is common, at any number of pieces."""
    rng, data = random.Random(4), []

    def word(n):
        return "".join(rng.choice("CNOSPFIclnos()=#123[]@+-") for _ in range(n))

    for i in range(240):
        n, size = rng.choice([6, 8, 10, 12]), (6, 14, 30, 60, 120, 400)[i % 6]
        parts = [word(n) for _ in range(max(1, size // (n - 4)))]
        at = rng.choice([0, n - 1, n - 1, 1, n - 2])
        changed = [p[:at] + "Z" + p[at + 1 :] if rng.random() < rng.choice([0.7, 1.0]) else p for p in parts]
        data += [(2 * i, "train", "a", ".".join(parts), ".".join(parts)), (2 * i + 1, "test", "b", ".".join(changed), ".".join(changed))]
    want = brute_overlap(data)
    assert all(sum((i // 2) % 6 == k for i, _ in want) > 5 for k in range(6))
    assert found_pairs(overlap(spark, data)) == want


def test_close_values_share_a_fingerprint():
    rng = random.Random(8)
    order = np.random.default_rng(1).permutation(split_overlap.SLOTS).astype(np.int32)
    met = 0
    for _ in range(400):
        n = rng.choice([1, 3, 8, 11, 12, 13, 30, 47, 48, 50, 100, 190, 195, 700])
        mine = {"".join(rng.choice("CNOclno=()12") for _ in range(4)) for _ in range(n)}
        theirs = {x for x in mine if rng.random() > rng.choice([0.0, 0.1, 0.2, 0.3])} | {"".join(rng.choice("XYZ") for _ in range(4)) for _ in range(rng.randrange(1 + n // 4))}
        if not theirs or len(mine & theirs) * 100 < 65 * len(mine | theirs):
            continue
        met += 1
        t = split_overlap.fingerprints([".".join(sorted(mine))], order, False)[0]
        e = split_overlap.fingerprints([".".join(sorted(theirs))], order, True)[0]
        assert set(t.tolist()) & set(e.tolist())
    assert met > 100
    assert split_overlap.fingerprints([], order, True) == []


def test_overlap_with_dirt(spark):
    p, r = "CCOC(=O)c1ccccc1N", "CCO.OC(=O)c1ccccc1N"
    data = [
        (1, "train", "a", p, r), (2, "test", "b", " CCOC(=O) c1ccccc1N", "OC(=O)c1ccccc1N.CCO."), (3, "val", None, p, None), (4, "val", None, "", r), (5, None, "a", p, r), (6, "", "a", p, r),
        (7, "train", "a", p, r), (8, "val", None, p, r), (9, "val", "c", ".", r), (10, "train", "a", "C", "O"), (11, "test", "a", "C", "O"), (12, "val", "x", "C" * 20000, "C" * 20000), (13, "train", "x", "C" * 20001, "C" * 20000),
    ]
    got = overlap(spark, data)
    assert found_pairs(got) == brute_overlap(data) == {(1, 2), (2, 7), (1, 8), (7, 8), (10, 11), (12, 13)}
    assert overlap(spark, data[:0]).count() == 0


def test_overlap_of_many_copies(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("CNOcn1()") for _ in range(80))
    data = [(i, "train" if i % 4 else "test", "s", p, "".join(rng.choice("CNOcn1()") for _ in range(90)) if i % 5 else "X" * 30) for i in range(200)]
    assert found_pairs(overlap(spark, data)) == brute_overlap(data)


def test_coverage(spark):
    df = spark.createDataFrame([("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234"), ("ABCDEFGHIJKLMNOPQRST", "QQQABCDEFGHIJKLMNO_____")], "a string, b string")
    got = [r[0] for r in df.select(split_overlap.chained_coverage(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - 11 / 16) < 1e-9


def chain_length(runs, text, n):
    """Longest common subsequence by the plain table."""
    other = [text[j : j + n] for j in range(len(text) - n + 1)]
    best = [0] * (len(other) + 1)
    for run in runs:
        new = [0]
        for j, x in enumerate(other):
            new.append(best[j] + 1 if x == run else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_longest_chain_against_the_table():
    rng = random.Random(6)
    for k in range(200):
        letters, n = rng.choice(["C", "CO", "CNO", "CNOcn1()"]), rng.choice([1, 2, 5])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n, 40))) for _ in range(2))
        runs = [a[i : i + n] for i in range(len(a) - n + 1)]
        chain = split_overlap.longest_chain(runs, split_overlap._places(b, n), len(b))
        assert len(chain) == chain_length(runs, b, n)
        assert all(runs[i] == b[j : j + n] for i, j in chain)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))


def test_coverage_of_moved_components_and_short_values(spark):
    a, b, c = "CC(=O)Nc1ccc(O)cc1Br", "OC1CCN(CC1)c2ncccn2", "N#Cc1ccc(cc1)S(=O)C"
    pairs = [
        (f"{a}.{b}.{c}", f"{b}.{c}.{a}"),  # moved: only the runs across dots may differ
        (f"{a}{a}x", f"{a}y{a}x"),  # a repeated seed: its first place is not the one of the chain
        ("CCOC(=O)C", "CCOC(=O)N"),  # under SEED signs, almost equal
        ("CCN.Cl.O", "CCN.Cl.O.S"),
        ("CC", "NN"),
    ]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(1)
    got = [r[0] for r in df.orderBy("k").select(split_overlap.chained_coverage(F.col("a"), F.col("b"))).collect()]
    n = len(pairs[0][0]) - 4
    assert got[0] >= (n - 10) / n
    assert got[1] == (len(pairs[1][0]) - 4 - 4) / (len(pairs[1][0]) - 4)
    assert got[2:] == [4 / 5, 1.0, 0.0]
    # no component holds the seed, the value does
    assert split_overlap.coverage("xxxxxABCDEFG.HIJKLMNyyyyy", "zzABCDEFG.HIJKLMNww") == 11 / 21


def test_overlap_on_the_tables(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/system_records.parquet").select("record_id", "split_name", "source", "product_canonical", "route_canonical").collect()]
    assert rows(Q.p6_found(spark, small)) == brute_overlap(data)
    assert Q.p6_report(spark, small).count() > 0


# 7

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary file here")
ODD = [
    "", None, "a" * 3000, "-" * 2000, "  \n\n  x  ", "\x00\x1c\x85\xa0 é😀👩‍🔬", " 　 ", "<|endoftext|>", "don't DON'T we'll 'S", "١٢٣ ㎏ ​", "日本語テキスト", " " * 999 + "x", "\r\n\t", "ab" * 700, "x",
]


def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@pytest.mark.parametrize("most", [tokenizer.BROADCAST_BYTES, 0])
def test_ids_and_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(tokenizer, "BROADCAST_BYTES", most)
    encoding = reference_encoding()
    table = spark.createDataFrame([*enumerate(ODD), (0, "repeated")], "doc_id bigint, text string").withColumns({"word": F.lit("w"), "ids": F.lit(1), "ranks": F.lit(2)})
    got = tokenizer.decode(tokenizer.encode(table)).collect()
    want = sorted((i, encoding.encode_ordinary(x) if x else [], x or "") for i, x in [*enumerate(ODD), (0, "repeated")])
    assert sorted((r["doc_id"], r["ids"], r["text"]) for r in got) == want
    assert sorted(rows(tokenizer.token_counts(table))) == sorted({(i, len(ids)) for i, ids, _ in want})
    assert tokenizer.encode(table.limit(0)).count() == 0
    carried = tokenizer.token_counts(table.withColumn("source", F.lit("s")), carry=("source",))
    assert carried.columns == ["doc_id", "source", "tokens"] and carried.count() == len(want)


@needs_vocabulary
def test_long_words_are_encoded_in_windows(spark):
    encoding, rng = reference_encoding(), random.Random(2)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (256, 257, 400, 5000)] + ["abc" * 400, "=-" * 300, "the" * 500, "é漢字" * 200]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFG") for _ in range(30_000)))
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()}
    assert got == {i: encoding.encode_ordinary(x) for i, x in enumerate(texts)}


@needs_vocabulary
def test_ids_on_the_tables(spark, small):
    encoding = reference_encoding()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in Q.p7_ids(spark, small).collect()}
    assert got == {i: encoding.encode_ordinary(x) if x else [] for i, x in texts.items()}


# 8


def test_budgets():
    target, tokens, limits = {"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 1000, "b": 10}, {"a": 1, "b": 4, "c": 9}
    exact = mixing.token_budgets(target, tokens, limits)
    assert exact == {"a": 40.0, "b": 40.0}
    forced = mixing.token_budgets(target, tokens, limits, total=500)
    assert forced["b"] <= 40 + 1e-6 and abs(sum(forced.values()) - 500) < 1e-6
    assert mixing.token_budgets({}, {}, {}) == {}
    flat = mixing.temperature_shares({"a": 0.9, "b": 0.1}, math.log(2))
    assert abs(flat["a"] - 0.5) < 0.01
    half = mixing.temperature_shares({"a": 0.9, "b": 0.1}, 0.5)
    assert abs(-sum(v * math.log(v) for v in half.values()) - 0.5) < 1e-6


def test_the_exponent_is_bisected():
    target, tokens, limits = {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 10}, {"a": 1, "b": 4}
    budgets, exponent = mixing.budgets_and_exponent(target, tokens, limits, total=500)
    # weight of b: 0.5 * (2 * 10 / 1010) ** x over the sum of both is 40 / 500
    assert 0 < exponent < 1 and abs(budgets["b"] - 40) < 1e-6
    raw = {s: 0.5 * (2 * n / 1010) ** exponent for s, n in tokens.items()}
    assert abs(raw["b"] / sum(raw.values()) - 40 / 500) < 1e-9
    assert mixing.budgets_and_exponent(target, tokens, limits)[1] < 1e-9
    flat, exponent = mixing.shares_and_exponent({"a": 0.9, "b": 0.1}, 0.6)
    assert 0 < exponent < 1 and abs(-sum(v * math.log(v) for v in flat.values()) - 0.6) < 1e-9


def test_nearest_sum():
    rng = random.Random(4)
    for _ in range(60):
        sizes, most = [rng.randrange(1, 200) for _ in range(rng.randrange(0, 7))], rng.choice([1, 2])
        goal = rng.uniform(0, sum(sizes) * most + 1)
        got = mixing.nearest_sum(sizes, goal, most)
        sums = [0]
        for n in sizes:
            sums = [x + k * n for x in sums for k in range(most + 1)]
        assert all(0 <= k <= most for k in got)
        assert abs(abs(sum(k * n for k, n in zip(got, sizes)) - goal) - min(abs(x - goal) for x in sums)) < 1e-9


def test_draws(spark):
    rng = random.Random(2)
    sized = [(i, rng.choice(["a", "a", "a", "b", None, "z"]), rng.choice([0, 1, 5, 20])) for i in range(4000)] + [(9000, "b", 4000), (9001, "b", 10)]
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("empty", 0.2, 2)], "source string, target_share double, max_repeats int")
    table = spark.createDataFrame(sized, "doc_id bigint, source string, tokens bigint")
    drawn = mixing.draw(table, mix)
    got = drawn.collect()
    assert {r["source"] for r in got} == {"a", "b"} and all(1 <= r["repeats"] <= {"a": 1, "b": 3}[r["source"]] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got)
    report = {r["source"]: r for r in mixing.shares_reached(drawn, mix).collect()}
    assert abs(report["a"]["reached_share"] - 0.625) < 0.02 and report["empty"]["reached_share"] == 0.0
    assert mixing.draw(table.limit(0), mix).count() == 0 and mixing.draw(table, mix.limit(0)).count() == 0


@needs_vocabulary
def test_mix_on_the_tables(spark, small):
    report = {r["source"]: r for r in Q.p8_report(spark, small).collect()}
    present = [r for r in report.values() if r["tokens"]]
    total = sum(r["target_share"] for r in present)
    for r in present:
        assert r["most_repeats"] <= r["max_repeats"]
        if r["documents"] > 20:
            assert abs(r["reached_share"] - r["target_share"] / total) < 0.06


# 9


def test_sentences():
    got = subjects.sentences("The office -\nsays this. Kali-\nbration fails.\n\n12) the seminar starts The next one ends.\r\nlast")
    assert got == ["The office says this.", "Kalibration fails.", "12) the seminar starts", "The next one ends.", "last"]
    assert subjects.sentences("-- 3/4 -- The end. 3) das Haus brennt Die Uhr steht", "Der|Die|Das") == ["-- 3/4 --", "The end.", "3) das Haus brennt", "Die Uhr steht"]
    assert subjects.sentences("3) das Haus brennt Die Uhr steht") == ["3) das Haus brennt Die Uhr steht"]
    assert subjects.sentences("5) it was warmed to 80 °C  As noted, it fell. 6) IT IS A TEST") == ["5) it was warmed to 80 °C", "As noted, it fell.", "6) IT IS A TEST"]
    assert subjects.sentences("x = [y]  # sharp Note: it runs.") == ["x = [y]  # sharp", "Note: it runs."]
    assert subjects.sentences(" \n ") == []


def test_terms_of_sentences():
    hashes, counts = subjects.terms([["page 3 of 4", "As bb 12 cc dd"], [], ["AS BB 7 cc dd as bb", ""]])
    # words and pairs; scraps have none; repeats count once; numbers are alike
    assert counts.tolist() == [0, 9, 10, 0] and len(hashes) == 19
    assert set(hashes[:9].tolist()) <= set(hashes[9:].tolist())
    assert subjects.terms([])[1].tolist() == [] and subjects.terms([[""]])[1].tolist() == [0]
    kept = np.unique(hashes[:9])
    numbers, known = subjects.numbered(hashes, counts, kept)
    assert known.tolist() == [0, 9, 9, 0] and len(numbers) == 18
    assert subjects.numbered(hashes, counts, kept[:0])[1].tolist() == [0, 0, 0, 0]


def test_subjects_held_out(spark, small):
    samples = spark.read.parquet(f"{small}/subject_samples.parquet")
    names = sorted(r["subject"] for r in spark.read.parquet(f"{small}/subject_areas.parquet").collect())
    held = samples.filter("sample_id % 5 = 0")
    got = collections.defaultdict(set)
    for r in subjects.document_subjects(clashing(held.withColumnRenamed("sample_id", "doc_id")), samples.filter("sample_id % 5 <> 0"), names).collect():
        got[r["doc_id"]].add(r["subject"])
    hit = wrong = lost = 0
    for r in held.collect():
        own, found = set(r["subjects"]), got[r["sample_id"]]
        hit, wrong, lost = hit + len(own & found), wrong + len(found - own), lost + len(own - found)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + lost) > 0.93


def test_subjects_of_odd_texts(spark, small):
    samples = spark.read.parquet(f"{small}/subject_samples.parquet")
    texts = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "The patent was filed. The licence shall survive termination."), (4, "qqq"), (5, "The claim shall survive termination. " * 3000)], "doc_id bigint, text string")
    got = subjects.document_subjects(texts, samples, ["law", "medicine"])
    assert {r["doc_id"] for r in got.filter("subject = 'law'").collect()} == {4, 5} and got.filter("doc_id < 4").count() == 0
    assert subjects.document_subjects(texts.limit(0), samples, ["law"]).count() == 0
    assert subjects.document_subjects(texts, samples.limit(0), ["law"]).count() == 0
