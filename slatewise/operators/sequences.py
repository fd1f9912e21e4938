"""Dataset combinators over token arrays and positions: D1 to D17, F35, P11, P13, S12, A12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.let import let
from slatewise.plans.running import running


def repeated(df: DataFrame, times: int | Column) -> DataFrame:
    """Each row so many times."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy") if not isinstance(times, int) or times > 0 else df.limit(0)


def subsample(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """D3: exactly ceil(n * ratio) rows, those of smallest MD5 hash; sampling is the feature, the order is total."""
    return first_by(df, unit_hash(F.col(key), seed), key, -int(-(df.count() * ratio) // 1))


def resampled(df: DataFrame, key: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """Weighted draws with replacement; a row's number of draws is the number of seeded points in its stretch of weight.

    Stretches are accumulated by hash blocks first, so no task orders all rows.
    """
    rows = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(1024)).cast("int"))
    sums = rows.groupBy("_block").agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    order = Window.partitionBy().orderBy("_block")
    starts = sums.select("_block", (F.sum("_w").over(order) - F.col("_w")).alias("_from"), F.sum("_w").over(Window.partitionBy()).alias("_all"))
    own = F.sum(F.col(weight).cast("double")).over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    low = F.col("_from") + F.col("_own") - F.col(weight)
    placed = rows.withColumn("_own", own).join(F.broadcast(starts), "_block").withColumn("_a", low / F.col("_all")).withColumn("_b", (low + F.col(weight)) / F.col("_all"))
    # systematic draws: points (i + shift) / draws
    shift = (seed * 2654435761 % 2**32 + 0.5) / 2**32
    n = F.floor(F.col("_b") * draws - shift + 1) - F.floor(F.col("_a") * draws - shift + 1)
    return placed.withColumn("times", n.cast("bigint")).filter("times > 0").drop("_block", "_own", "_from", "_all", "_a", "_b")


def drawn_once(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` weighted draws without replacement: the rows of the largest ``log(u) / weight``, ``u`` from a hash of the key (Efraimidis and Spirakis).

    """
    return first_by(df.filter(F.col(weight) > 0), -F.log(unit_hash(F.col(key), seed)) / F.col(weight), key, n)


def unit_hash(key: Column, seed: int = 0) -> Column:
    """A number above 0 and below 1 from the MD5 digest of a key and a seed."""
    part = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 12)
    return (F.conv(part, 16, 10).cast("double") + 0.5) / float(2**48)


def first_by(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The ``n`` rows of least ``order``, then key. Rows are counted in bins of the order's quantiles; whole bins
    are taken, and only those of the bin at the border are ranked."""
    rows = df.withColumn("_o", order)
    cuts = rows.agg(F.percentile_approx("_o", [i / 256 for i in range(257)], 10_000).alias("cuts"))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("_bin", F.size(F.filter("cuts", lambda c: c <= F.col("_o")))).drop("cuts")
    held = placed.groupBy("_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy().orderBy("_bin")
    starts = held.select("_bin", "_n", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(starts), "_bin").filter(F.col("_before") < n)
    whole = joined.filter(F.col("_before") + F.col("_n") <= n)
    border = joined.filter(F.col("_before") + F.col("_n") > n).withColumn("_r", F.row_number().over(Window.partitionBy("_bin").orderBy("_o", key)))
    border = border.filter(F.col("_r") + F.col("_before") <= n).drop("_r")
    return whole.unionByName(border).drop("_o", "_bin", "_n", "_before")


def zip_by_position(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Rows of ``a`` with the rows of ``b`` at the same place, ``b`` wrapping around; both have a dense position from 0."""
    n = b.agg(F.count("*").alias("_n"))
    left = a.crossJoin(F.broadcast(n)).withColumn("_p", F.pmod(F.col(position), F.col("_n"))).drop("_n")
    return left.join(b.withColumnRenamed(position, "_p"), "_p").drop("_p")


def paired_lines(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Two files line by line; the job fails if a line has no partner."""
    joined = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), position, "full_outer")
    bad = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the files differ in length")).cast("int"))
    return joined.withColumn("_a", F.coalesce(bad, F.lit(1))).filter("_a = 1").drop("_a", "_b")


def source_of_draw(key: Column, shares: list[tuple[str, float]], seed: int = 0) -> Column:
    """A source by probability, from a seeded hash."""
    u = unit_hash(key, seed)
    out, upto = F.lit(shares[-1][0]), sum(p for _, p in shares[:-1])
    for name, p in reversed(shares[:-1]):
        out = F.when(u < upto, F.lit(name)).otherwise(out)
        upto -= p
    return out


def framed(a: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """Tokens put before and after."""
    parts = [F.array(begin)] if begin is not None else []
    return F.concat(*parts, a, *([F.array(end)] if end is not None else []))


def stripped(a: Column, token: Column) -> Column:
    """Without the token."""
    return F.filter(a, lambda x: x != token)


def truncated(a: Column, most: int) -> Column:
    """The first tokens."""
    return F.slice(a, 1, most)


def offset(a: Column, by: int) -> Column:
    """All ids moved."""
    return F.transform(a, lambda x: x + by)


def replaced(a: Column, old: Column, new: Column) -> Column:
    """One id for another."""
    return F.transform(a, lambda x: F.when(x == old, new).otherwise(x))


def rolled(a: Column, by: int) -> Column:
    """Rotated to the right."""
    n = F.size(a)
    k = F.pmod(F.lit(by), F.greatest(n, F.lit(1)))
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k)))


def composite_key(*parts: Column) -> Column:
    """Parts joined by a triple pipe between spaces."""
    return F.concat_ws(" ||| ", *(F.coalesce(p, F.lit("")) for p in parts))


def key_parts(c: Column) -> Column:
    """The parts of a composite key."""
    return F.split(c, r" \|\|\| ")


def padded(a: Column, width: Column, pad: Column, left: bool = False) -> Column:
    """Filled up to ``width``."""
    fill = F.array_repeat(pad, F.greatest(width - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def token_blocks(df: DataFrame, part: str, ordinal: str, ids: str, block: int) -> DataFrame:
    """The tokens of a part, in order, cut into blocks of fixed size across rows."""
    placed = running(df, [part], [ordinal], F.size(ids), "_start")
    each = placed.select(part, "_start", F.posexplode(ids).alias("_i", "token")).withColumn("_at", F.col("_start") + F.col("_i"))
    grouped = each.groupBy(part, F.floor(F.col("_at") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", "token"))).alias("x"))
    return grouped.select(part, "block", F.transform("x", lambda t: t["token"]).alias(ids))


def context_windows(ids: Column, before: int) -> Column:
    """For each token, up to ``before`` tokens that precede it."""
    return F.transform(ids, lambda x, i: F.slice(ids, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))))


def length_filtered(df: DataFrame, ids: str, most: int) -> DataFrame:
    """Rows with at most so many tokens."""
    return df.filter(F.size(ids) <= most)


def budget_batches(df: DataFrame, part: str, ordinal: str, ids: str, most: int) -> DataFrame:
    """Rows in order cut into batches whose tokens, with each row padded to the longest so far, fit a budget.

    The cut is greedy and so sequential; it runs in the fold of an array per part. Parts must be of bounded size.
    """
    rows = df.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.size(ids).alias("n")))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<o:bigint,b:int>>").alias("out"), F.lit(0).alias("b"), F.lit(0).alias("rows"), F.lit(0).alias("longest"))

    def step(acc: Column, r: Column) -> Column:
        longest = F.greatest(acc["longest"], r["n"])
        fits = ((acc["rows"] + 1) * longest <= most) | (acc["rows"] == 0)
        b = F.when(fits, acc["b"]).otherwise(acc["b"] + 1)
        out = F.array_append(acc["out"], F.struct(r["o"].cast("bigint").alias("o"), b.alias("b")))
        return F.struct(out.alias("out"), b.alias("b"), F.when(fits, acc["rows"] + 1).otherwise(1).alias("rows"), F.when(fits, longest).otherwise(r["n"]).alias("longest"))

    return rows.select(part, F.inline(F.aggregate("rows", start, step, lambda acc: acc["out"]))).withColumnsRenamed({"o": ordinal, "b": "batch"})


def dropped_out(a: Column, key: Column, share: float, seed: int = 0) -> Column:
    """Tokens left out by a seeded coin; at least the first stays."""
    kept = F.filter(a, lambda x, i: unit_hash(F.concat_ws(":", key.cast("string"), i.cast("string")), seed) >= share)
    return F.when((F.size(kept) == 0) & (F.size(a) > 0), F.slice(a, 1, 1)).otherwise(kept)


def masked(a: Column, key: Column, share: float, mask: Column, seed: int = 0) -> Column:
    """Tokens masked by a seeded coin."""
    return F.transform(a, lambda x, i: F.when(unit_hash(F.concat_ws(":", key.cast("string"), i.cast("string")), seed) < share, mask).otherwise(x))


def shuffled(a: Column, key: Column, reach: int, seed: int = 0) -> Column:
    """Tokens moved by less than ``reach`` places."""
    keyed = F.transform(a, lambda x, i: F.struct((i + unit_hash(F.concat_ws(":", key.cast("string"), i.cast("string")), seed) * reach).alias("at"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda t: t["x"])


def token_levenshtein(a: Column, b: Column) -> Column:
    """edits between token arrays: each distinct token of the pair becomes one sign, then the built-in distance."""

    def spelled(tokens: Column, known: Column) -> Column:
        # U+4E00 and on: one code point per token, below the surrogates
        return F.array_join(F.transform(tokens, lambda x: F.decode(F.unhex(F.hex(F.array_position(known, x) + 0x4E00)), "UTF-16BE")), "")

    return let(F.array_union(a, b), lambda known: F.levenshtein(spelled(a, known), spelled(b, known)))


def reciprocal_votes(df: DataFrame, query: str, run: str, hypothesis: str, order: list[Column], valid: Column, alpha: float = 0.1) -> DataFrame:
    """Sum over runs of 1 / (alpha * k + 1), k being the place among a run's valid hypotheses; and its share within the query."""
    placed = df.filter(valid).withColumn("_k", F.row_number().over(Window.partitionBy(query, run).orderBy(*order)) - 1)
    votes = placed.groupBy(query, hypothesis).agg(F.sum(1.0 / (alpha * F.col("_k") + 1.0)).alias("score"))
    total = F.sum("score").over(Window.partitionBy(query))
    return votes.withColumn("probability", F.col("score") / F.when(total == 0, 1.0).otherwise(total))


def encoded_labels(df: DataFrame, row_id: str, tokens: Column, vocabulary: DataFrame, unknown: int, none: int) -> DataFrame:
    """Ids of a row's tokens in order; unknown ones get ``unknown``, a row without tokens gets ``none``."""
    each = df.select(row_id, F.posexplode_outer(tokens).alias("_i", "token")).join(vocabulary, "token", "left")
    value = F.when(F.col("token").isNull(), none).otherwise(F.coalesce(F.col("token_index"), F.lit(unknown)))
    return each.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))), lambda x: x["v"]).alias("ids"))


def decoded_labels(ids: Column, names: Column) -> Column:
    """Names of ids, those without a name left out."""
    return F.filter(F.transform(ids, lambda i: F.get(names, i)), lambda x: x.isNotNull())


def sharded(position: Column, shards: int) -> Column:
    """The shard of a dense position, round robin."""
    return F.pmod(position, F.lit(shards)).cast("int")


def grouped_batches(position: Column, size: int) -> Column:
    """The batch of a dense position, ``size`` neighbours each."""
    return F.floor(position / size).cast("bigint")


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Tables one after the other, each repeated a whole number of times, with the number of its part."""
    out = None
    for i, (df, times) in enumerate(parts):
        one = repeated(df, times).withColumn("part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out
