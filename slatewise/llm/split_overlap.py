"""Problem 6: records of evaluation splits that also stand, exactly or almost, in train.

A value is cut at dots into components, blanks removed; its pieces are all runs
of five adjacent signs within a component (a shorter component is one piece).
Two values are almost equal when common distinct pieces are at least 65 % of
all distinct pieces of both.

1. Fingerprints. Every piece has a rolling hash. As in winnowing the least hashes are
   selected, but of the whole value and not of a run of neighbours, so that no pair can be
   missed however its edits are scattered: hashes are ordered by how many values hold them
   (counted in ``SLOTS`` slots; any order will do, the rare first are the cheapest), and the first
   are selected until they hold ``a - ceil(0.65 a) + 1`` *repeats*, ``a`` being the number
   of pieces and a repeat a piece whose family has been met before. The families are
   ``4 ** level`` even parts of all pieces. A fingerprint is a pair of selected pieces of one family.

   This is exact. Two values at 65 % miss at most ``a - ceil(0.65 a)`` of each other's
   pieces. Take the value whose selection ends first in the order: what the other has of it
   is selected there too. Had each family at most one common piece there, it would miss all
   repeats, one more than it can. So a family has two common pieces, and their
   pair is a fingerprint of both. Values of under 12 pieces have single pieces for fingerprints.
   The level goes with the number of pieces of the train value; an evaluation value has
   the fingerprints of each level that a partner may have.
2. Join. Fingerprints are joined across splits, over distinct values only, so that copies
   are not multiplied. Within the join an upper bound of the overlap, from 256-bit maps
   of the pieces, drops nearly all false pairs before anything is shuffled; maps of 1024 bits
   drop most of the others. Fingerprints held by many train values are salted.
   Products are compared first, then the routes of what is left, and the two kinds of pairs are
   joined through the records' values.
3. Chains. For an evaluation value and each of its components the longest collinear chain of
   seeds (runs of ``SEED`` signs; what is shorter has its pieces for seeds), over all their
   places in the train value, is extended along its diagonals. The share of the value's places so
   aligned is its coverage; the distinct pieces so aligned are common to both. Where they
   reach the 65 % the pair is found; the others are checked by the exact rule.

Defined cases: null, empty, blank or dots-only values and null or other splits
give no case; repeated rows each give their pairs; component order does not
matter; very long values are used whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from slatewise.functions.let import let
from slatewise.functions.text import BLANK
from slatewise.plans.skew import join_on_counted, join_spread
from slatewise.shared import written

PIECE, SEED, SHARE = 5, 14, 65
SLOTS = 1 << 18
HELD, SIEVE = 256, 16
CHUNK = 500_000
CHAIN_BITS = 1 << 28


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def pieces(value: Column) -> Column:
    """Distinct pieces of an ordered value."""
    return F.array_distinct(F.flatten(F.transform(F.split(value, "[.]"), lambda c: _grams(c, PIECE))))


def _mixed(h: np.ndarray) -> np.ndarray:
    # the finisher of splitmix64: orders hashes evenly
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` signs of each component (of the whole of a shorter one).

    ``codes`` holds all components, each followed by a separator. Gives the hashes in
    order and the component of each.
    """
    base = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for j in range(n):
        rolled = rolled * base + codes[j : len(codes) - n + 1 + j]
    count = np.maximum(lengths - n + 1, 1)
    own = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(starts, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    short = lengths < n
    out = rolled[np.minimum(at, max(len(rolled) - 1, 0))] if len(rolled) else np.zeros(len(at), np.uint64)
    if short.any():
        whole, where = np.zeros(int(short.sum()), np.uint64), starts[short]
        for j in range(n - 1):
            inside = j < lengths[short]
            whole = np.where(inside, whole * base + codes[np.minimum(where + j, len(codes) - 1)], whole)
        out[short[own]] = whole + lengths[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(out + np.uint64(n)), own


def _distinct(values: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, values))
    values, hashes = values[order], hashes[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (hashes[1:] != hashes[:-1])
    return values[new], hashes[new]


def piece_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces of ordered values: number of the value, hash of the piece."""
    parts = [t.split(".") for t in texts]
    value = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    lengths = np.array([len(c) for p in parts for c in p], np.int64)
    codes = np.frombuffer((".".join(texts) + ".").encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes, own = rolling_hashes(codes, np.cumsum(lengths + 1) - lengths - 1, lengths, PIECE)
    return _distinct(value[own], hashes)


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with about CHUNK signs of ``value``."""
    for part in parts:
        ends = part["value"].str.len().cumsum().to_numpy()
        first = 0
        while first < len(part):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")), first + 1)
            yield part.iloc[first:last].reset_index(drop=True)
            first = last


def described(values: DataFrame) -> DataFrame:
    """``values`` (with ``value``) plus an id, the number of distinct pieces, and maps of them in 256 and 1024 bits; a written table.

    The rolling hashes are NumPy over Arrow batches: a run of vector operations
    for a whole batch, where expressions would take a call per sign.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(parts):
            v, h = piece_sets(part["value"].tolist())
            maps = []
            for width in (8, 10):
                bits = np.zeros((len(part), 1 << width), bool)
                bits[v, (h >> np.uint64(64 - width)).astype(np.int64)] = True
                maps.append(np.packbits(bits, axis=1, bitorder="little"))
            words = maps[0].view(np.int64)
            yield part.assign(n=np.bincount(v, minlength=len(part)).astype(np.int32), **{f"b{j}": words[:, j] for j in range(4)}, map=[m.tobytes() for m in maps[1]])

    kinds = ", ".join(f"`{c}` {t}" for c, t in values.dtypes)
    rows = values.mapInPandas(batches, f"{kinds}, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, map binary")
    return written(rows.withColumn("id", F.monotonically_increasing_id()), "described")


def piece_order(values: DataFrame) -> np.ndarray:
    """The place of each slot of pieces in the order: those of few values first. Its size does not grow with the data."""

    def held(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for part in _chunks(parts):
            total += np.bincount((piece_sets(part["value"].tolist())[1] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at.astype(np.int32), "held": total[at]})

    found = values.select("value").mapInPandas(held, "slot int, held bigint").groupBy("slot").agg(F.sum("held").alias("held")).toPandas()
    total = np.zeros(SLOTS, np.int64)
    total[found["slot"].to_numpy(int)] = found["held"].to_numpy()
    order = np.empty(SLOTS, np.int32)
    order[np.lexsort((_mixed(np.arange(SLOTS, dtype=np.uint64)), total))] = np.arange(SLOTS, dtype=np.int32)
    return order


def level_of(n: np.ndarray) -> np.ndarray:
    """0 for under 12 pieces, 1 from 12, 2 from 48, 3 from 192, ..."""
    return np.sum([n >= 3 * 4**k for k in range(1, 16)], axis=0)


def fingerprints(texts: list[str], order: np.ndarray, every_level: bool) -> list[np.ndarray]:
    """Keys of each ordered value, at its own level or at every level that a partner may have."""
    v, h = piece_sets(texts)
    place = order[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
    first = np.lexsort((h, place, v))
    v, h, place = v[first], h[first], place[first]
    n = np.bincount(v, minlength=len(texts))
    wanted = n - (SHARE * n + 99) // 100 + 1
    low, high = (level_of((SHARE * n + 99) // 100), level_of(100 * n // SHARE)) if every_level else (level_of(n), level_of(n))
    own, keys = [], []
    for level in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        there = ((low <= level) & (level <= high))[v]
        w, g, f = v[there], h[there], place[there] % 4**level
        begin = np.searchsorted(w, np.arange(len(texts)))
        if level == 0:
            kept = np.arange(len(w)) - begin[w] < wanted[w]
            own.append(w[kept])
            keys.append(_mixed(g[kept]))
            continue
        by_family = np.lexsort((np.arange(len(w)), f, w))
        new = np.ones(len(w), bool)
        new[1:] = (w[by_family][1:] != w[by_family][:-1]) | (f[by_family][1:] != f[by_family][:-1])
        begins = np.flatnonzero(new)
        met = np.arange(len(w)) - np.repeat(begins, np.diff(np.append(begins, len(w))))  # earlier pieces of the family
        repeat = np.zeros(len(w), np.int64)
        repeat[by_family] = met > 0
        so_far = np.cumsum(repeat) - repeat
        kept = so_far - so_far[np.minimum(begin, max(len(w) - 1, 0))][w] < wanted[w] if len(w) else np.zeros(0, bool)
        # of a family the first pieces are selected, so that the earlier ones of a selected piece are too
        at = np.flatnonzero(kept[by_family])
        many = met[at]
        right = np.repeat(at, many)
        left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(many) - many, many))
        a, b = by_family[left], by_family[right]
        own.append(w[b])
        keys.append(_mixed(g[a] * np.uint64(0x9E3779B97F4A7C15) + _mixed(g[b] + np.uint64(level))))
    if not own:
        return []
    own, keys = np.concatenate(own), np.concatenate(keys)
    by_value = np.argsort(own, kind="stable")
    return np.split(keys[by_value].view(np.int64), np.cumsum(np.bincount(own, minlength=len(texts)))[:-1])


def fingerprint_rows(values: DataFrame, order, every_level: bool) -> DataFrame:
    """One row per fingerprint: ``key``, and what is needed to bound an overlap."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(parts):
            keys = fingerprints(part["value"].tolist(), order.value, every_level)
            yield part[["id", "n", "b0", "b1", "b2", "b3"]].assign(keys=keys)

    columns = ["id", "n", "b0", "b1", "b2", "b3"]
    found = values.select(*columns, "value").mapInPandas(batches, "id bigint, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, keys array<bigint>")
    return found.select(F.explode("keys").alias("key"), *columns)


def candidates(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Distinct pairs ``(t_id, e_id)`` of described values that share a fingerprint and may reach the share."""
    spark = train.sparkSession
    order = spark.sparkContext.broadcast(piece_order(train.select("value").unionByName(evaluation.select("value"))))
    t, e = fingerprint_rows(train, order, False), fingerprint_rows(evaluation, order, True)
    # fingerprints held that often; found among one value in SIEVE, as they only shape the
    # plan: one that is missed, or salted needlessly, meets the same partners. A value has some hundred, so they are bounded
    least = max(HELD, train.count() // 200)
    sieved = fingerprint_rows(train.filter(F.pmod(F.xxhash64("id"), F.lit(SIEVE)) == 0), order, False).groupBy("key").agg((F.count("*") * SIEVE).alias("held"))
    heavy = F.broadcast(written(sieved.filter(F.col("held") >= least).select("key", F.ceil(F.col("held") / F.lit(least)).cast("int").alias("salts")), "heavy-fingerprints"))
    salt_t = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    columns = ["id", "n", "b0", "b1", "b2", "b3"]
    # the salt goes into the key: one number is sorted and compared
    salted = F.when(F.col("salts").isNull(), F.col("key")).otherwise(F.xxhash64("key", "salt")).alias("key")
    t = t.join(heavy, "key", "left").withColumn("salt", salt_t).select(salted, *[F.col(c).alias(f"t_{c}") for c in columns])
    e = e.join(heavy, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select(salted, *[F.col(c).alias(f"e_{c}") for c in columns])

    def fits(x: str, y: str, words: range) -> Column:
        # bits of x not in y: at least so many pieces of x are not in y; |A and B| / |A or B| >= s <=> |A and B| * (1 + s) >= s * (|A| + |B|)
        only = sum((F.bit_count(F.col(f"{x}_b{j}").bitwiseAND(F.bitwise_not(f"{y}_b{j}"))) for j in words), F.lit(0))
        return (F.col(f"{x}_n") - only) * (100 + SHARE) >= (F.col("t_n") + F.col("e_n")) * SHARE

    # half of the map drops most pairs
    bound = fits("t", "e", range(2)) & fits("e", "t", range(2, 4)) & fits("t", "e", range(4)) & fits("e", "t", range(4))
    return t.join(e, "key").filter(bound).select("t_id", "e_id").distinct()


def almost_equal(a: Column, b: Column) -> Column:
    """The exact rule on two ordered values."""
    both = F.struct(pieces(a).alias("a"), pieces(b).alias("b"))
    sizes = let(both, lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("common"), (F.size(x["a"]) + F.size(x["b"])).alias("both")))
    return F.when(a == b, True).otherwise(let(sizes, lambda s: s["common"] * 100 >= (s["both"] - s["common"]) * SHARE))


def longest_chain(runs: list[str], places: dict[str, list[int]], end: int) -> list[tuple[int, int]]:
    """The longest chain of (index of a run, place below ``end`` where it stands), both strictly increasing.

    A longest common subsequence, bit-parallel: one number of ``end`` bits per run, whatever the repeats.
    """
    full, state, states = (1 << end) - 1, (1 << end) - 1, []
    masks: dict[str, int] = {}
    for run in runs:
        if run not in masks:
            masks[run] = sum(1 << j for j in places.get(run, ()))
        held = state & masks[run]
        state = ((state + held) | (state - held)) & full
        states.append(state)
    chain, i, j = [], len(runs) - 1, end - 1
    while i >= 0 and j >= 0:
        if states[i] >> j & 1:
            j -= 1
        elif i and not states[i - 1] >> j & 1:
            i -= 1
        else:
            chain.append((i, j))
            i, j = i - 1, j - 1
    return chain[::-1]


def _places(text: str, n: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for j in range(len(text) - n + 1):
        out.setdefault(text[j : j + n], []).append(j)
    return out


def diagonals_of(value: str, train_value: str) -> list[int]:
    """The diagonals of the chains of ``value`` and of each of its components, with all places of their seeds in ``train_value``,
    so that a component that moved is found. What has fewer than SEED signs has its pieces for seeds. A very long
    run is chained in parts, which bounds the memory."""
    held = {n: _places(train_value, n) for n in (SEED, PIECE)}
    whole: dict[str, list[int]] = {}
    start = 0
    for c in train_value.split("."):
        whole.setdefault(c, []).append(start)
        start += len(c) + 1
    found: dict[int, None] = {}
    parts = value.split(".")
    starts = [0, *itertools.accumulate(len(c) + 1 for c in parts[:-1])]
    step = max(1, CHAIN_BITS // max(1, len(train_value)))
    # the value as one run as well, for seeds across a dot
    for start, c in dict.fromkeys([(0, value), *zip(starts, parts)]):
        n = SEED if len(c) >= SEED else min(PIECE, len(c))
        runs = [c[i : i + n] for i in range(len(c) - n + 1)]
        for low in range(0, len(runs), step):
            for i, j in longest_chain(runs[low : low + step], held[n] if len(c) >= PIECE else whole, len(train_value)):
                found[j - i - low - start] = None
    return list(found)


def aligned_places(value: str, train_value: str) -> list[int]:
    """The places of ``value`` from which PIECE signs stand in ``train_value`` too, on a diagonal of a chain."""
    diagonals = diagonals_of(value, train_value)
    places = range(max(1, len(value) - PIECE + 1))
    return [i for i in places if any(i + d >= 0 and train_value[i + d : i + d + PIECE] == value[i : i + PIECE] for d in diagonals)]


def coverage(value: str, train_value: str) -> float:
    """Share of ``value``'s places aligned with ``train_value``."""
    return len(aligned_places(value, train_value)) / max(1, len(value) - PIECE + 1)


def aligned(value: str, train_value: str) -> tuple[int, float]:
    """Distinct pieces of ``value`` that the alignment shows to be common, and the coverage."""
    at = aligned_places(value, train_value)
    runs = {value[i : i + PIECE] for i in at}
    common = {r for r in runs if len(r) == PIECE and "." not in r}
    return len(common) + len({c for c in value.split(".") if len(c) < PIECE} & set(train_value.split("."))), len(at) / max(1, len(value) - PIECE + 1)


def _coverages(values: pd.Series, train_values: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float | None] = {}
    for pair in zip(values, train_values):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else 1.0 if pair[0] == pair[1] else coverage(*pair)
    return pd.Series([known[pair] for pair in zip(values, train_values)], dtype="float64")


def chained_coverage(value: Column, train_value: Column) -> Column:
    """Share of ``value``'s places aligned with ``train_value``; the longest chain takes a table over both, which expressions would build per sign."""
    return F.pandas_udf(_coverages, DoubleType())(value, train_value)


def close_values(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Pairs ``(t_id, e_id, coverage)`` of described values that are almost equal, by fingerprints, chains and extension."""

    def align(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            t, e = (np.frombuffer(b"".join(part[f"{s}_map"]), np.uint64).reshape(-1, 16) for s in "te")
            least = (part["t_n"].to_numpy() + part["e_n"].to_numpy()) * SHARE
            enough = [(n.to_numpy() - np.bitwise_count(x & ~y).sum(1, dtype=np.int64)) * (100 + SHARE) >= least for n, x, y in ((part["t_n"], t, e), (part["e_n"], e, t))]
            part = part[enough[0] & enough[1]].drop(columns=["t_map", "e_map"])
            both = [(n, 1.0) if e == t else aligned(e, t) for e, t, n in zip(part["e_value"], part["t_value"], part["e_n"])]
            yield part.assign(common=np.array([c for c, _ in both], np.int32), coverage=np.array([c for _, c in both], float))

    texts = {s: d.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "value", "n", "map")]) for s, d in (("t", train), ("e", evaluation))}
    pairs = candidates(train, evaluation).join(texts["t"], "t_id").join(texts["e"], "e_id")
    # by both ids: a value with many partners is the work of many tasks, each as many as the session has partitions
    pairs = pairs.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("t_id", "e_id"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes if not c.endswith("_map"))
    pairs = pairs.mapInPandas(align, f"{kinds}, common int, coverage double")
    shown = F.col("common") * 100 >= (F.col("t_n") + F.col("e_n") - F.col("common")) * SHARE
    found = pairs.filter(F.when(shown, True).otherwise(almost_equal(F.col("t_value"), F.col("e_value"))))
    return found.select("t_id", "e_id", "coverage")


def ordered_records(table: DataFrame, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    """The records of the splits with their values without blanks and empty components, components in order."""
    blanks = {ord(ch): None for ch in map(chr, range(0x3001)) if re.match(BLANK, ch)}

    def ordered(value: str | None) -> str | None:
        return ".".join(sorted(c for c in value.translate(blanks).split(".") if c)) or None if value is not None else None

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(product=part["product"].map(ordered), route=part["route"].map(ordered))

    side = F.col("split_name") == train
    rows = table.select("record_id", "split_name", "source", side.alias("is_train"), F.col("product_canonical").cast("string").alias("product"), F.col("route_canonical").cast("string").alias("route"))
    rows = rows.filter(F.col("split_name").isin(train, *evaluation) & F.col("product").isNotNull() & F.col("route").isNotNull())
    rows = rows.mapInPandas(batches, rows.schema).filter("product IS NOT NULL AND route IS NOT NULL")
    return written(rows, "split-records")


def close_pairs(records: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values of ``column`` with an id, and the pairs of them that are almost equal, ``(t_id, e_id, coverage)``; written tables."""
    counted = records.groupBy(F.col(column).alias("value")).agg(F.count_if("is_train").alias("in_train"), F.count_if(~F.col("is_train")).alias("in_evaluation"))
    values = described(counted)
    return values, written(close_values(values.filter("in_train > 0"), values.filter("in_evaluation > 0")), f"close-{column}s")


def numbered(records: DataFrame, column: str, values: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records whose value of ``column`` has a close one, with its id instead."""
    kept = []
    for side, rows, own in (("is_train", "in_train", "t_id"), ("NOT is_train", "in_evaluation", "e_id")):
        close = values.join(pairs.select(F.col(own).alias("id")).distinct(), "id", "left_semi").select(F.col("value").alias(column), F.col(rows).alias("rows"), F.col("id").alias(f"{column}_id"))
        kept.append(join_on_counted(records.filter(side), written(close, "close-values"), column, "rows").drop(column))
    return written(kept[0].unionByName(kept[1]), "numbered-records")


def split_overlap(table: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """One row per pair of a train and an evaluation record: ``train_id, evaluation_id, split_name, source, product_coverage, route_coverage``."""
    records = ordered_records(table, train, evaluation)
    products, close_products = close_pairs(records, "product")
    records = numbered(records, "product", products, close_products)
    routes, close_routes = close_pairs(records, "route")
    records = numbered(records, "route", routes, close_routes)
    # pairs of values first, records last; each step goes from what was found and is spread where a value is hot
    t = written(records.filter("is_train").select(F.col("product_id").alias("t_product"), F.col("route_id").alias("t_route")).distinct(), "train-values")
    e = records.filter("NOT is_train").select(F.col("product_id").alias("e_product"), F.col("route_id").alias("e_route")).distinct()
    near = close_products.select(F.col("t_id").alias("t_product"), F.col("e_id").alias("e_product"), F.col("coverage").alias("product_coverage"))
    same = close_routes.select(F.col("t_id").alias("t_route"), F.col("e_id").alias("e_route"), F.col("coverage").alias("route_coverage"))
    found = written(join_spread(t, near, "t_product"), "products-met")
    found = join_spread(found, same, "t_route").join(e, ["e_product", "e_route"])
    found = written(found.withColumn("t_key", F.xxhash64("t_product", "t_route")).withColumn("e_key", F.xxhash64("e_product", "e_route")), "overlapping-values")
    train_rows, evaluation_rows = (
        records.filter(side).select(F.xxhash64("product_id", "route_id").alias(f"{s}_key"), F.col("product_id").alias(f"{s}_p"), F.col("route_id").alias(f"{s}_r"), F.col("record_id").alias(name), *more)
        for s, side, name, more in (("t", "is_train", "train_id", ()), ("e", "NOT is_train", "evaluation_id", ("split_name", "source")))
    )
    pairs = join_spread(train_rows, found, "t_key").filter("t_p = t_product AND t_r = t_route")
    pairs = join_spread(evaluation_rows, pairs, "e_key").filter("e_p = e_product AND e_r = e_route")
    return pairs.select("train_id", "evaluation_id", "split_name", "source", "product_coverage", "route_coverage")
