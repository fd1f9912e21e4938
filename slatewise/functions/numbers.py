"""Numbers: F3, F4, F13, F37, F39 to F43."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.labels import is_missing
from slatewise.functions.text import known_number


def safe_float(c: Column) -> Column:
    """a number, or null where the text is none or NaN."""
    return known_number(F.trim(c).try_cast("double"))


def highest_temperature(c: Column) -> Column:
    """the highest of the stages ``a; b``, a range ``a - b`` being its mean; null if any part fails."""

    def stage(s: Column) -> Column:
        ends = F.transform(F.split(s, " - "), lambda x: F.trim(x).try_cast("double"))
        return F.when(F.forall(ends, lambda x: x.isNotNull() & ~F.isnan(x)), F.aggregate(ends, F.lit(0.0), lambda a, x: a + x) / F.size(ends))

    stages = F.transform(F.split(c, ";"), lambda s: stage(F.trim(s)))
    return F.when(~is_missing(c) & F.forall(stages, lambda x: x.isNotNull()), F.array_max(stages))


def sane_temperature(c: Column, most: float = 500.0) -> Column:
    """null above ``most``; the row stays."""
    known = known_number(c)
    return F.when(known <= most, known)


def mean_log_prob(scores: Column) -> Column:
    """mean of the scores, rounded half-even to four places."""
    return F.bround(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores), 4)


# Weight and relevance by agreement of a candidate with the record.
AGREEMENT = {"positive": (1.0, 3.0), "route_only": (1.0, 2.0), "context_only": (0.75, 1.0), "negative": (0.25, 0.0)}


def label_type(route: Column, context: Column, exact: Column) -> Column:
    """``positive``, ``route_only``, ``context_only`` or ``negative``."""
    return F.when(exact, "positive").when(route, "route_only").when(context, "context_only").otherwise("negative")


def _by_agreement(kind: Column, which: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in AGREEMENT.items():
        out = F.when(kind == name, F.lit(values[which])).otherwise(out)
    return out


def sample_weight(kind: Column) -> Column:
    """weight of a training row."""
    return _by_agreement(kind, 0)


def relevance(kind: Column) -> Column:
    """graded relevance."""
    return _by_agreement(kind, 1)


def log_prior(count: Column) -> Column:
    """log(1 + count)."""
    return F.log1p(count)


def log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def clipped(c: Column, weight: float | Column, most: float) -> Column:
    """c * weight within [-most, most]."""
    return F.least(F.greatest(c * weight, F.lit(-most)), F.lit(most))


def percent_text(c: Column) -> Column:
    """a share as per cent with two places, ``NA`` for null."""
    return F.coalesce(F.format_string("%.2f%%", c * 100), F.lit("NA"))


def mean_sd_text(mean: Column, sd: Column) -> Column:
    """``mean ± sd``; without ``± sd`` where that is null."""
    return F.when(mean.isNull(), "NA").when(sd.isNull(), F.format_string("%.2f", mean)).otherwise(F.format_string("%.2f ± %.2f", mean, sd))


def yield_relevance(c: Column) -> Column:
    """0 for none, else 2 + 2 * yield / 100."""
    return F.when(c <= 0, 0.0).otherwise(2 * c / 100 + 2)
