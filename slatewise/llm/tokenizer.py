"""Problem 7: byte-level BPE of a whole corpus with a public vocabulary.

Texts are cut into words by the vocabulary's public pattern. Each distinct word
is encoded once, by higher-order functions: a fold over its bytes that merges,
step by step, the adjacent pair of least rank, at all its places. The ranks are
a literal map, read from the vocabulary file and held in a scalar subquery, so
that plans stay readable; its 50 thousand pairs lie in ``SLOTS`` small maps, as
a lookup in one large map would be linear. A word of more than ``LONG`` bytes is
encoded in windows: each begins where the tokens taken from the last one end, and what lies within
``MARGIN`` of its end is not taken. A sequence of tokens is the encoding of a text just when each two
neighbours are that of their own bytes, so it is enough that the first token of a window is the
one that the last window had there; should it differ, the word is folded as a whole. Decoding concatenates the binary
pieces of the ids.

Word codes go back to the texts by a broadcast while the dictionary of distinct
words is at most ``BROADCAST_BYTES``; a larger one is joined by shuffle, with
only its most frequent words (a bounded number) broadcast.

Defined cases: null and empty texts give an empty list; strings of special
tokens are ordinary text; every text is encoded whole, however long; repeated
rows give repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.let import let
from slatewise.functions.text import BLANK
from slatewise.plans.skew import join_on_counted
from slatewise.shared import written

VOCABULARY = os.environ.get("SLATEWISE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# The public pattern that cuts a text before the merges, its blanks spelled out for Java.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", "[^" + BLANK[1:-1]).replace(r"\S", "[^" + BLANK[1:]).replace(r"\s", BLANK)
SLOTS = 1 << 15
LONG, MARGIN = 256, 64
BROADCAST_BYTES = 32 << 20


@cache
def load_vocabulary(path: str = VOCABULARY) -> tuple[tuple[bytes, ...], tuple[tuple[int, int, int], ...]]:
    """The pieces in order of their ids, and the merges ``(left id, right id, id)``.

    The merge of a piece is the pair left when its bytes are merged by lesser ranks only.
    """
    ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}
    merges = []
    for piece, rank in ranks.items():
        if len(piece) < 2:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank, i))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return tuple(pieces), tuple(merges)


def _slot(a: int, b: int) -> int:
    return (a * 40503 + b) % SLOTS


def rank_table(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """One row: ``ranks`` (ids of single bytes; merges by slot)."""
    pieces, merges = load_vocabulary(path)
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for a, b, rank in merges:
        slots[_slot(a, b)][str(a << 20 | b)] = rank
    single = {p: i for i, p in enumerate(pieces) if len(p) == 1}
    text = json.dumps({"bytes": [single[bytes([i])] for i in range(256)], "slots": slots, "lengths": [len(p) for p in pieces]}, separators=(",", ":"))
    # one text cell, parsed by Spark: far quicker than a hundred thousand Python values
    row = spark.createDataFrame([(text,)], "text string")
    return row.select(F.from_json("text", "bytes array<int>, slots array<map<string,int>>, lengths array<int>").alias("x")).select(
        F.struct("x.bytes", F.transform("x.slots", lambda m: F.transform_keys(m, lambda k, _: k.cast("bigint"))).alias("slots"), "x.lengths").alias("ranks")
    )


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word."""
    return let(
        F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"),
        lambda b: F.when(F.length(b) <= LONG, encode_bytes(b, ranks)).otherwise(F.coalesce(encode_windows(b, ranks), encode_bytes(b, ranks))),
    )


def encode_windows(latin: Column, ranks: Column) -> Column:
    """The ids of many bytes, window by window, or null where two windows do not agree."""

    def step(acc: Column, _: Column) -> Column:
        last = acc["at"] + LONG >= F.length(latin)

        def taken(ids: Column) -> Column:
            ends = F.aggregate(ids, F.array(F.lit(0)), lambda e, i: F.array_append(e, F.element_at(e, -1) + F.get(ranks["lengths"], i)))
            whole = let(ends, lambda e: F.struct(e.alias("ends"), F.when(last, F.size(ids)).otherwise(F.size(F.filter(e, lambda x: x <= LONG - MARGIN)) - 1).alias("n")))
            agrees = (acc["next"] < 0) | (F.get(ids, F.lit(0)) == acc["next"])
            return let(
                whole,
                lambda w: F.struct(
                    (acc["at"] + F.get(w["ends"], w["n"])).alias("at"), F.concat(acc["ids"], F.slice(ids, F.lit(1), w["n"])).alias("ids"), F.coalesce(F.get(ids, w["n"]), F.lit(-1)).alias("next"),
                    (agrees & (w["n"] > 0)).alias("good"), last.alias("done"),
                ),
            )

        return F.when(acc["done"] | ~acc["good"], acc).otherwise(let(encode_bytes(F.substring(latin, acc["at"] + 1, F.lit(LONG)), ranks), taken))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("next"), F.lit(True).alias("good"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(latin) / MARGIN).cast("int")), start, step, lambda acc: F.when(acc["good"] & acc["done"], acc["ids"]))


def encode_bytes(latin: Column, ranks: Column) -> Column:
    """The ids of bytes given as Latin-1 text, by a fold over them."""
    start = F.transform(F.regexp_extract_all(latin, F.lit("(?s)."), F.lit(0)), lambda ch: F.get(ranks["bytes"], F.ascii(ch)))

    def rank(a: Column, b: Column) -> Column:
        slot = F.pmod(a * F.lit(40503) + b, F.lit(SLOTS)).cast("int")
        return F.element_at(F.get(ranks["slots"], slot), F.call_function("shiftleft", a.cast("bigint"), F.lit(20)).bitwiseOR(b.cast("bigint")))

    def pair_ranks(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: rank(F.get(ids, i - 1), F.get(ids, i)))

    def merged(ids: Column, of_pairs: Column, best: Column) -> Column:
        place = F.array_position(of_pairs, best).cast("int")
        # every id between its own commas: `replace` then merges all places, left to right, without overlap
        spelled = F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",,"), F.lit(","))
        pair = F.concat(F.lit(","), F.get(ids, place - 1).cast("string"), F.lit(",,"), F.get(ids, place).cast("string"), F.lit(","))
        after = F.replace(spelled, pair, F.concat(F.lit(","), best.cast("string"), F.lit(",")))
        return F.transform(F.split(F.btrim(after, F.lit(",")), ",,"), lambda x: x.cast("int"))

    def state(ids: Column, done: Column) -> Column:
        return F.struct(ids.alias("ids"), done.alias("done"))

    def step(acc: Column, _: Column) -> Column:
        ids = acc["ids"]
        move = let(
            pair_ranks(ids),
            lambda found: let(F.array_min(found), lambda best: F.when(best.isNull(), state(ids, F.lit(True))).otherwise(state(merged(ids, found, best), F.lit(False)))),
        )
        return F.when(acc["done"] | (F.size(ids) < 2), acc).otherwise(move)

    return let(start, lambda ids: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), state(ids, F.lit(False)), step, lambda acc: acc["ids"]))


def words_of(text: Column) -> Column:
    """The words of a text, whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def dictionary(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(word, n, ids)`` of ``(word)`` rows: each distinct word, its count and ids."""
    counted = written(words.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")), "words")
    # spread by words: encoding one costs far more than its few bytes make the planner think
    spread = counted.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    bound = spread.withColumn("ranks", rank_table(words.sparkSession, path).scalar())
    return written(bound.select("word", "n", let(F.col("ranks"), lambda r: encode_word(F.col("word"), r)).alias("ids")), "word-ids")


def coded_words(texts: DataFrame, key: str, text: str, path: str = VOCABULARY, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``(key, carry..., _row, pos, ids)`` per word, null ids for a text without words, and the keys of one text.

    Where the dictionary is broadcast, a text's words stay in one partition.
    """
    one = [key, *carry, "_row"]
    base = texts.select(key, *carry, F.col(text).alias("_text"))
    codes = dictionary(base.select(F.explode(words_of(F.col("_text"))).alias("word")), path)
    size = codes.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 64)).first()[0] or 0
    rows = base.repartition(key).withColumn("_row", F.monotonically_increasing_id())
    if size > BROADCAST_BYTES:
        rows = written(rows, "numbered-texts")
    words = rows.select(*one, F.posexplode_outer(words_of(F.col("_text"))).alias("pos", "word"))
    if size <= BROADCAST_BYTES:
        return words.join(F.broadcast(codes.select("word", "ids")), "word", "left").select(*one, "pos", "ids"), one
    coded = join_on_counted(words.filter("word IS NOT NULL"), codes, "word", "n", share=1 / 1000).select(*one, "pos", "ids")
    without = words.filter("word IS NULL").select(*one, "pos", F.lit(None).cast("array<int>").alias("ids"))
    return coded.unionByName(without), one


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` of each text."""
    coded, one = coded_words(texts, key, text, path)
    in_order = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    none = F.array().cast("array<int>")
    return coded.groupBy(*one).agg(F.flatten(F.transform(in_order, lambda x: F.coalesce(x["ids"], none))).alias("ids")).select(key, "ids")


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, carry..., tokens)`` of each text, without building its list."""
    coded, one = coded_words(texts, key, text, path, carry)
    return coded.groupBy(*one).agg(F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), F.size("ids"))), F.lit(0)).cast("bigint").alias("tokens")).select(key, *carry, "tokens")


def decode(coded: DataFrame, ids: str = "ids", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``coded`` with ``text``: the concatenated binary pieces of the ids, as UTF-8."""
    spark = coded.sparkSession
    pieces = json.dumps([p.hex() for p in load_vocabulary(path)[0]], separators=(",", ":"))
    table = spark.createDataFrame([(pieces,)], "text string").select(F.from_json("text", "array<string>").alias("pieces"))
    bound = coded.withColumn("_pieces", table.scalar())
    whole = let(F.col("_pieces"), lambda p: F.array_join(F.transform(F.col(ids), lambda i: F.get(p, i)), ""))
    return bound.select(*coded.columns, F.decode(F.unhex(whole), "UTF-8").alias(text))
