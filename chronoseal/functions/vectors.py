"""Vector columns are ``ARRAY<FLOAT>``; sums are carried as DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import _col


def parse_vector(c: Column | str) -> Column:
    """``"[1,2,3]"`` to ``ARRAY<FLOAT>``."""
    return F.from_json(_col(c), "array<float>")


def count_dimensions(c: Column | str) -> Column:
    """Number of entries in a vector text; 0 for ``[]`` and for blank text."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"^\[", ""), r"\]$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, ",", -1)))


def all_finite(c: Column | str) -> Column:
    """True when no entry is NULL, NaN or infinite."""
    return F.coalesce(
        F.forall(_col(c), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))),
        F.lit(False),
    )


def any_nonzero(c: Column | str) -> Column:
    return F.coalesce(F.exists(_col(c), lambda x: x != 0), F.lit(False))


def zero_vector(dim: int, element: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(element), dim)


def squared_norm(c: Column | str) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def truncate_and_normalize(c: Column | str, dim: int) -> Column:
    """First ``dim`` entries scaled to unit length; NULL when shorter than ``dim``.

    A zero vector stays zero.
    """
    head = F.slice(_col(c), 1, dim)
    norm = F.sqrt(squared_norm(head))
    unit = F.transform(head, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)).cast("float"))
    return F.when(F.size(_col(c)) >= dim, unit)


def impute_zero(c: Column | str, dim: int) -> Column:
    """Zero vector where a left join found nothing."""
    return F.coalesce(_col(c), zero_vector(dim))
