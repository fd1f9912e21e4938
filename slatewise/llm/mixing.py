"""Problem 8: sources mixed to target weights.

Weights are a temperature mix: target shares times (natural share / target
share) to an exponent. The exponent is bisected to the least value at which the wanted
total can be drawn without repeating any source beyond its limit: 0 gives the targets, 1
the corpus itself. Without a wanted total the largest is taken that the targets and
limits allow, at which the bisection ends at 0. With a wanted entropy the targets are themselves a
temperature mix: natural shares to an exponent, bisected until they have that entropy; that exponent is then the one reported.

A source's weight is its budget of tokens. It is drawn in blocks: whole passes over the
source, then the beginning of one seeded permutation, up to the budget. The
permutation is cut into ``BLOCKS`` hash blocks whose sums are accumulated
first, so that no task holds a whole source. Of documents with at least 1 / LARGE
of a source's tokens, at most LARGE of them, those get one pass more whose sum is nearest their own
share of the budget (if need be with one pass less for others), and the small ones fill what is left, so that no
large document makes a source miss its budget.

Defined cases: null sources and sources without a target are not drawn; a
source with a target but no tokens reaches 0 and the other targets are scaled up;
null and empty texts have no tokens and are never drawn; repeated rows are
documents of their own; an empty table gives no draws; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BLOCKS = 1024
LARGE = 50
GRID = 1000
MAX_SOURCES = 10_000


def temperature_shares(natural: dict[str, float], entropy: float, steps: int = 60) -> dict[str, float]:
    """Natural shares raised to an exponent in [0, 1] so that their entropy is ``entropy`` nats, as near as may be."""
    return shares_and_exponent(natural, entropy, steps)[0]


def shares_and_exponent(natural: dict[str, float], entropy: float, steps: int = 60) -> tuple[dict[str, float], float]:
    """``temperature_shares`` and the exponent."""

    def mix(a: float) -> dict[str, float]:
        raw = {s: v**a for s, v in natural.items() if v > 0}
        return {s: v / sum(raw.values()) for s, v in raw.items()}

    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if -sum(v * math.log(v) for v in mix(mid).values()) > entropy else (low, mid)
    return mix(high), high


def token_budgets(target: dict[str, float], tokens: dict[str, int], limits: dict[str, int], total: float | None = None, steps: int = 60) -> dict[str, float]:
    """Tokens to draw per source that has some."""
    return budgets_and_exponent(target, tokens, limits, total, steps)[0]


def budgets_and_exponent(target: dict[str, float], tokens: dict[str, int], limits: dict[str, int], total: float | None = None, steps: int = 60) -> tuple[dict[str, float], float]:
    """Tokens to draw per source that has some, and the exponent at which they fit."""
    usable = {s: t for s, t in target.items() if t > 0 and tokens.get(s, 0) > 0 and limits.get(s, 0) > 0}
    if not usable:
        return {}, 0.0
    whole = sum(tokens[s] for s in usable)
    goal = {s: t / sum(usable.values()) for s, t in usable.items()}
    if total is None:
        total = min(limits[s] * tokens[s] / goal[s] for s in goal)

    def weights(a: float) -> dict[str, float]:
        raw = {s: g * (tokens[s] / whole / g) ** a for s, g in goal.items()}
        return {s: v / sum(raw.values()) for s, v in raw.items()}

    def fits(a: float) -> bool:
        return all(w * total <= limits[s] * tokens[s] * (1 + 1e-9) for s, w in weights(a).items())

    # a source's share rises and then falls with the exponent, so the exponents that fit need not be one stretch:
    # the first of a grid that fits is refined by bisection; if none does, the one that leaves least undrawn is taken
    grid = [i / GRID for i in range(GRID + 1)]
    high = next((a for a in grid if fits(a)), None)
    if high is None:
        high = min(grid, key=lambda a: sum(max(0.0, w * total - limits[s] * tokens[s]) for s, w in weights(a).items()))
    elif high:
        low = high - 1 / GRID
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    return {s: min(w * total, limits[s] * tokens[s]) for s, w in weights(high).items()}, high


def nearest_sum(sizes: list[int], goal: float, most: int = 1, units: int = 1 << 15) -> list[int]:
    """How often (0 to ``most``) to take each of a few sizes so that their sum is nearest ``goal``, to within a part in ``units`` per size."""
    unit = max(1, -(-sum(sizes) * most // units))
    steps = [max(1, round(n / unit)) if n else 0 for n in sizes]
    reach = [1]
    for n in steps:
        now = reach[-1]
        for _ in range(most):
            now |= now << n
        reach.append(now)
    sums = [i for i in range(reach[-1].bit_length()) if reach[-1] >> i & 1]
    left, taken = min(sums, key=lambda x: (abs(x * unit - goal), x)), []
    for n, before in zip(reversed(steps), reversed(reach[:-1])):
        times = next(k for k in range(most + 1) if left >= k * n and before >> (left - k * n) & 1)
        taken.append(times)
        left -= times * n
    return taken[::-1]


def draw(sized: DataFrame, mix: DataFrame, total: float | None = None, seed: int = 0, entropy: float | None = None) -> DataFrame:
    """``(doc_id, source, tokens, repeats, exponent)`` of the documents drawn, ``repeats`` times each.

    ``sized`` has doc_id, source, tokens, and should be a written table; ``mix`` has source, target_share, max_repeats,
    one row per source and at most ``MAX_SOURCES``.
    """
    wanted = mix.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError("too many sources")
    wanted = [r for r in wanted if r["source"] is not None]
    names = F.broadcast(sized.sparkSession.createDataFrame([(r["source"],) for r in wanted], "source string"))
    rows = sized.filter("tokens > 0").join(names, "source", "left_semi").select("doc_id", "source", "tokens", F.xxhash64("doc_id", F.lit(seed)).alias("at"))
    tokens = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    target = {r["source"]: r["target_share"] or 0.0 for r in wanted}
    limits = {r["source"]: r["max_repeats"] or 0 for r in wanted}
    if entropy is not None:
        target, exponent = shares_and_exponent({s: tokens[s] for s in tokens if target.get(s, 0) > 0}, entropy)
    budgets, found = budgets_and_exponent(target, tokens, limits, total)
    exponent = found if entropy is None else exponent
    spark = sized.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(s, tokens[s]) for s in budgets], "source string, whole bigint"))
    rows = rows.join(sizes, "source").withColumn("large", F.col("tokens") * LARGE >= F.col("whole"))
    # at most LARGE documents per source: how often each is drawn is settled first
    large = rows.filter("large").groupBy("source", "doc_id").agg(F.min("at").alias("at"), F.sum("tokens").alias("n")).collect()
    plans, chosen = [], []
    for s, budget in budgets.items():
        own = sorted((r for r in large if r["source"] == s), key=lambda r: (r["at"], r["doc_id"]))
        held = [r["n"] for r in own]
        others = tokens[s] - sum(held)
        passes = min(int(budget // tokens[s]), limits[s])
        # the small documents fill what is left, as often as they may
        goal = min(max(budget * sum(held) / tokens[s], budget - limits[s] * others), budget)
        times = [passes + k for k in nearest_sum(held, goal - passes * sum(held), min(1, limits[s] - passes))]
        filled = sum(k * n for k, n in zip(times, held))
        if passes and max(filled - budget, budget - limits[s] * others - filled) * 500 > budget:
            times = [passes - 1 + k for k in nearest_sum(held, goal - (passes - 1) * sum(held), min(2, limits[s] - passes + 1))]
            filled = sum(k * n for k, n in zip(times, held))
        chosen += [(s, r["doc_id"], k) for k, r in zip(times, own)]
        left = max(0.0, budget - filled)
        full = min(int(left // others), limits[s]) if others else 0
        plans.append((s, full, left - full * others if full < limits[s] else 0.0))
    more = F.broadcast(spark.createDataFrame(plans, "source string, passes int, rest double"))
    chosen_rows = F.broadcast(spark.createDataFrame(chosen, StructType([sized.schema["source"], sized.schema["doc_id"], StructField("repeats", IntegerType())])))
    big = rows.filter("large").join(chosen_rows, ["source", "doc_id"]).select("doc_id", "source", "tokens", "repeats")
    small = rows.filter("NOT large").withColumn("block", F.floor((F.col("at") / 2.0**64 + 0.5) * BLOCKS).cast("int"))
    # sources times blocks: bounded
    blocks = small.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    before = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("block_tokens")
    starts = blocks.withColumn("before", before).drop("block_tokens")
    within = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = small.withColumn("within", within).join(F.broadcast(starts), ["source", "block"]).join(more, "source")
    # a document is in the last, partial pass if its middle lies within the budget
    middle = F.col("before") + F.col("within") - F.col("tokens") / 2
    placed = placed.select("doc_id", "source", "tokens", (F.col("passes") + F.when(middle < F.col("rest"), 1).otherwise(0)).alias("repeats"))
    return placed.unionByName(big).withColumn("exponent", F.lit(exponent)).filter("repeats > 0")


def shares_reached(drawn: DataFrame, mix: DataFrame) -> DataFrame:
    """Per source of ``mix``: its target, the share reached, tokens drawn, most repeats, and the exponent of the mix."""
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.max("exponent").alias("exponent"))
    share = F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0))
    joined = mix.select("source", "target_share", "max_repeats").join(sums, "source", "left").withColumn("reached_share", share).withColumn("exponent", F.max("exponent").over(Window.partitionBy()))
    return joined.fillna(0, ["tokens", "documents", "most_repeats"])
