"""Relevance parsing, evidence arithmetic, probability hygiene and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import _col

# The shape of the v1 evidence score (weight, column, scale).
EVIDENCE_TERMS = (
    (0.3, "rel7_ratio", 10.0),
    (0.25, "rel5_ratio", 6.0),
    (0.15, "rel3_ratio", 3.0),
)
EVIDENCE_LEVELS = ((0.15, "top10_avg_relevance", 7.0), (0.15, "max_relevance", 7.0))
EVIDENCE_VERSION = "v1"


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def relevance_value(c: Column | str) -> Column:
    """Whole number in 0..10; NULL, NaN and unreadable values count as 0."""
    c = _col(c)
    number = c.try_cast("double")
    truncated = F.when(F.isnan(number), F.lit(0.0)).otherwise(number)
    return F.coalesce(F.least(F.greatest(truncated, F.lit(0.0)), F.lit(10.0)).cast("int"), F.lit(0))


def relevance_raw(c: Column | str) -> Column:
    """Digits only, otherwise NULL."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def relevance_score(c: Column | str) -> Column:
    """Clipped companion of :func:`relevance_raw`: non-digits score 0, digits clip to 10."""
    text = F.trim(_col(c).cast("string"))
    # `least` skips NULL, so non-digits branch off first. A digit run too long for BIGINT is a number above 10.
    clipped = F.least(F.coalesce(text.try_cast("bigint"), F.lit(10)), F.lit(10))
    return F.when(F.coalesce(text.rlike("^[0-9]+$"), F.lit(False)), clipped).otherwise(F.lit(0)).cast("int")


def evidence_score() -> Column:
    """Evidence score v1 over the marker columns of the row."""
    terms = [F.lit(w) * clamp(F.col(c).cast("double") * F.lit(s)) for w, c, s in EVIDENCE_TERMS]
    terms += [F.lit(w) * clamp(F.col(c).cast("double") / F.lit(s)) for w, c, s in EVIDENCE_LEVELS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return clamp(total)


def log_count(c: Column | str) -> Column:
    """``log1p(max(x, 0))`` with NULL read as 0."""
    return F.log1p(F.greatest(F.coalesce(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio_floor1(numerator: Column, total: Column) -> Column:
    return numerator.cast("double") / F.greatest(total.cast("double"), F.lit(1.0))


def is_finite(c: Column | str) -> Column:
    """NULL counts as not finite."""
    c = _col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def probabilities_valid(*columns: Column | str) -> Column:
    """Finite, within 1e-8 of [0, 1], and summing to 1 within 1e-4."""
    cols = [_col(c).cast("double") for c in columns]
    ok = F.lit(True)
    total = F.lit(0.0)
    for c in cols:
        ok = ok & is_finite(c) & (c >= F.lit(-1e-8)) & (c <= F.lit(1 + 1e-8))
        total = total + c
    return F.coalesce(ok & (F.abs(total - F.lit(1.0)) <= F.lit(1e-4)), F.lit(False))


def _finite_or(c: Column | str, fill: float) -> Column:
    """NaN or NULL becomes ``fill``, +inf becomes 1, -inf becomes 0."""
    c = _col(c).cast("double")
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(fill))
        .when(c == F.lit(float("inf")), F.lit(1.0))
        .when(c == F.lit(float("-inf")), F.lit(0.0))
        .otherwise(c)
    )


def clean_probabilities(*columns: Column | str, floor: float = 1e-9) -> list[Column]:
    """Fill non-finite entries with an equal share, clip to [floor, 1], renormalise to sum 1."""
    clipped = [clamp(_finite_or(c, 1.0 / len(columns)), floor, 1.0) for c in columns]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    return [c / total for c in clipped]


def clean_score(c: Column | str) -> Column:
    """Binary counterpart of :func:`clean_probabilities`."""
    return clamp(_finite_or(c, 0.5))


def baseline_probabilities(evidence: Column | str) -> list[Column]:
    """Relevance-only ternary baseline: (e + .05, .25, 1 - e), normalised."""
    e = clamp(_col(evidence))
    return clean_probabilities(e + F.lit(0.05), F.lit(0.25), F.lit(1.0) - e)


def gated_probabilities(positive: Column | str, gate: Column | str) -> list[Column]:
    """Hierarchical gate: P(pos) * P(diag | pos), 1 - P(pos), P(pos) * (1 - P(diag | pos))."""
    p, g = _col(positive), _col(gate)
    return clean_probabilities(p * g, F.lit(1.0) - p, p * (F.lit(1.0) - g))


def fixed_number(c: Column | str, digits: int = 8) -> Column:
    """Whole numbers print without a fraction, others with ``digits`` decimals."""
    c = _col(c).cast("double")
    return F.when(c == F.rint(c), c.cast("decimal(38,0)").cast("string")).otherwise(F.format_string(f"%.{digits}f", c))


def channel(relevance: Column | str, scale: float = 7.0) -> Column:
    """Relevance channel ``clip(rel / scale, 0, 1)`` of one post."""
    return clamp(_col(relevance).cast("double") / F.lit(scale))


def ordered_key(c: Column) -> Column:
    """A long that orders and equals as the double does, from sign, exponent and fraction; both zeros give 0, NaN the largest.

    Powers of two and divisions by them are exact, so different doubles never share a key. NULL stays NULL.
    """
    two = F.lit(2.0)
    size = F.abs(c.cast("double"))
    rough = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("double")
    # The logarithm may be rounded across a power of two.
    exponent = F.when(F.pow(two, rough) > size, rough - 1).when((rough < 1023) & (F.pow(two, rough + 1) <= size), rough + 1).otherwise(rough)
    fraction = (size / F.pow(two, exponent) - 1) * F.lit(2.0**52)
    normal = (exponent + 1023).cast("bigint") * F.lit(2**52) + fraction.cast("bigint")
    subnormal = (size * F.lit(2.0**1022) * F.lit(2.0**52)).cast("bigint")
    top = 2047 * 2**52
    positive = F.when(F.isnan(size), F.lit(top + 1)).when(size == float("inf"), F.lit(top)).when(size < F.lit(2.0**-1022), subnormal).otherwise(normal)
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when((c < 0) & ~F.isnan(size), -positive).otherwise(positive)
