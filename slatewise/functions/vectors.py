"""Vectors: F31, F32, F46, J8 to J10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.let import let


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """F32: inner product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    return let(as_doubles(v), lambda d: let(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped at 0 from below."""
    return F.greatest(dot(unit(a), unit(b)), F.lit(0.0))


def multi_hot(numbers: Column, width: int) -> Column:
    """0/1 vector of ``width`` with ones at the numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(numbers, i).cast("int"))


def bit_words(numbers: Column, words: int) -> Column:
    """Set bits as an array of 64-bit words."""

    def word(w: Column) -> Column:
        own = F.filter(numbers, lambda n: F.floor(n / 64) == w)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, n: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (n % 64).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def tanimoto(a: Column, b: Column) -> Column:
    """Of bit words; 0 when both are empty."""

    def bits(op) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(op(x, y)).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    pair = F.struct(bits(lambda x, y: x.bitwiseAND(y)).alias("both"), bits(lambda x, y: x.bitwiseOR(y)).alias("either"))
    return let(pair, lambda p: F.when(p["either"] > 0, p["both"] / p["either"]).otherwise(0.0))
