"""Problem 1: splits that keep linked records together.

Records and entities (reactions, products) form a bipartite graph. Each record
is an edge between its two entities, so the graph is first reduced to the distinct
pairs of entities; repeats of a hot entity collapse there. Then the smallest
label spreads: each product takes the least label of its reactions, each
reaction the least of its products, and labels jump to the label of their
label, until nothing changes.

Linked groups are then assigned to splits by strata of a label. Groups with at
least ``1 / heavy`` of all records are at most ``heavy`` many; they are placed
one by one, largest first, where the squared deviation of the label counts from
their targets grows least. The others are spread into ``BUCKETS`` hash buckets
per dominant label, and runs of buckets fill what each split still lacks.

Defined cases: a missing entity (null, blank, missing word) links nothing; a
record with neither entity is a group of its own; repeated rows are linked
through what they share; labels that are null form a stratum; an empty
table gives no rows; with no shares given every split is null; extra columns are
ignored. A group without any reaction has a null ``group_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.text import known_number, not_missing
from slatewise.plans.skew import join_on_counted
from slatewise.shared import written

BUCKETS = 4096


def least_labels(pairs: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Labels ``(a, label)`` and ``(b, label)`` of the components of distinct pairs ``(a, b)``.

    The label of a component is its least ``a``. Raises if ``max_rounds`` do not suffice;
    with jumps the number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(pairs, "entity-pairs")
    total = edges.count()
    of_a = written(edges.groupBy("a").agg(F.count("*").alias("n")).withColumn("label", F.col("a")), "labels-a")
    for _ in range(max_rounds):
        seen = join_on_counted(edges, of_a, "a", "n", total=total)
        of_b = written(seen.groupBy("b").agg(F.count("*").alias("n"), F.min("label").alias("label")), "labels-b")
        back = join_on_counted(edges, of_b, "b", "n", total=total)
        met = written(back.groupBy("a").agg(F.count("*").alias("n"), F.min("label").alias("label")), "labels-met")
        # how many jump to one label is not known beforehand; it is counted for the even join
        jumps = written(met.groupBy("label").agg(F.count("*").alias("m")).join(met.select(F.col("a").alias("label"), F.col("label").alias("jumped")), "label"), "label-jumps")
        new = join_on_counted(met, jumps, "label", "m").select("a", "n", F.col("jumped").alias("label"))
        new = written(new, "labels-a")
        changed = new.join(of_a.select("a", F.col("label").alias("was")), "a").filter("label <> was").limit(1).count()
        of_a = new
        if not changed:
            return of_a.select("a", "label"), of_b.select("b", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def linked_groups(records: DataFrame, record_id: str, main: Column, other: Column) -> DataFrame:
    """``(record_id, group_id, group_key)``: groups linked by two entities.

    ``group_key`` is the least main entity of the group, null if it has none;
    ``group_id`` is never null.
    """
    base = written(records.select(F.col(record_id).alias("id"), main.alias("a"), other.alias("b")), "entities")
    label_a, label_b = least_labels(base.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    all_a = base.filter("a IS NOT NULL").groupBy("a").agg(F.count("*").alias("n")).join(label_a, "a", "left")
    all_a = written(all_a.select("a", "n", F.coalesce("label", "a").alias("label")), "reactions")
    only_b = base.filter("a IS NULL AND b IS NOT NULL")
    all_b = written(only_b.groupBy("b").agg(F.count("*").alias("n")).join(label_b, "b", "left").select("b", "n", "label"), "products")
    with_a = join_on_counted(base.filter("a IS NOT NULL"), all_a, "a", "n").select("id", F.concat(F.lit("a:"), "label").alias("group_id"), F.col("label").alias("group_key"))
    with_b = join_on_counted(only_b, all_b, "b", "n").select(
        "id", F.coalesce(F.concat(F.lit("a:"), F.col("label")), F.concat(F.lit("b:"), "b")).alias("group_id"), F.col("label").alias("group_key")
    )
    alone = base.filter("a IS NULL AND b IS NULL").select("id", F.concat(F.lit("i:"), F.col("id").cast("string")).alias("group_id"), F.lit(None).cast("string").alias("group_key"))
    return with_a.unionByName(with_b).unionByName(alone).withColumnRenamed("id", record_id)


def groups_of_two(grouped: DataFrame, record_id: str) -> DataFrame:
    """The records of groups with two or more, ``(record_id, group_key)``."""
    kept = written(grouped, "grouped")
    sizes = written(kept.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "group-sizes")
    return join_on_counted(kept, sizes, "group_id", "n").select(record_id, "group_key")


def yield_band(c: Column) -> Column:
    """A stratum label from a yield: quarters of 0 to 100, or ``none``."""
    known = known_number(c)
    return F.when(known.isNull(), "none").otherwise(F.least(F.lit(3), F.greatest(F.lit(0), F.floor(known / 25))).cast("string"))


def assign_splits(grouped: DataFrame, shares: list[tuple[str, float]], heavy: int = 1000) -> DataFrame:
    """``grouped`` (group_id, label, ...) with ``split_name``, whole groups kept together.

    ``label`` must have few distinct values (at most ``heavy``). ``shares`` are
    the splits and their target shares; they need not add up to one.
    """
    weight = sum(s for _, s in shares)
    kept = written(grouped, "labelled")
    cells = written(kept.groupBy("group_id", "label").agg(F.count("*").alias("n")), "group-labels")
    sums = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).limit(heavy + 1).collect()}
    if len(sums) > heavy:
        raise ValueError("too many distinct labels for strata")
    total = sum(sums.values())
    if not shares or weight <= 0 or not total:
        return kept.withColumn("split_name", F.lit(None).cast("string"))
    target = {(s, x): share / weight * n for s, share in shares for x, n in sums.items()}
    groups = written(
        cells.groupBy("group_id").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "label")).getField("label").alias("main"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("label", F.lit("")), "n"))).alias("counts")
        ),
        "groups",
    )
    # at most `heavy` groups can hold that share each
    large = sorted(groups.filter(F.col("n") * heavy >= total).collect(), key=lambda r: (-r["n"], r["group_id"]))
    have = dict.fromkeys(target, 0.0)
    placed = []
    for g in large:
        counts = {x: g["counts"].get(x or "", 0) for x in sums}

        def cost(s: str, counts=counts) -> float:
            return sum((have[s, x] + c - target[s, x]) ** 2 - (have[s, x] - target[s, x]) ** 2 for x, c in counts.items())

        best = min((s for s, _ in shares), key=lambda s: (cost(s), s))
        placed.append((g["group_id"], g["n"], best))
        for x, c in counts.items():
            have[best, x] += c
    spark = grouped.sparkSession
    placed_rows = spark.createDataFrame(placed, "group_id string, n bigint, split_name string")
    small = groups.filter(F.col("n") * heavy < total).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS)).cast("int"))
    # bounded: labels times buckets
    sizes = small.groupBy("main", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("main").orderBy("bucket")
    place = (F.sum("n").over(order) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy("main"))
    choice = F.lit(None).cast("string")
    for x in sums:
        lack = [(s, max(0.0, target[s, x] - have[s, x])) for s, _ in shares]
        whole = sum(n for _, n in lack) or 1.0
        run, pick = 0.0, F.lit(max(lack, key=lambda v: v[1])[0])
        for s, n in reversed(lack):
            pick = F.when(F.col("place") >= 1 - (run + n) / whole, F.lit(s)).otherwise(pick) if run == 0 else F.when(F.col("place") >= 1 - run / whole, pick).otherwise(F.when(F.col("place") >= 1 - (run + n) / whole, F.lit(s)).otherwise(pick))
            run += n
        choice = F.when(F.col("main").eqNullSafe(F.lit(x)), pick).otherwise(choice)
    filled = sizes.withColumn("place", place).select("main", "bucket", choice.alias("split_name"))
    small = small.join(F.broadcast(filled), small["main"].eqNullSafe(filled["main"]) & (small["bucket"] == filled["bucket"])).select("group_id", "n", "split_name")
    return join_on_counted(kept, written(small.unionByName(placed_rows), "group-splits"), "group_id", "n", total=total)


def condition_groups(records: DataFrame) -> DataFrame:
    """Groups of condition records: reactions in upper case, products as written."""
    return linked_groups(records, "record_id", F.upper(not_missing(F.col("reaction_id"))), not_missing(F.col("product_canonical")))
