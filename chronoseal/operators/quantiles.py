"""Exact linear-interpolated quantiles by radix selection.

``percentile`` keeps every distinct value of a group in one task. Here a double
is a 64-bit key of the same order. Rows are counted by the leading digit of the
key; only digits that hold a wanted rank are opened and counted by their next
digit, until few rows are left or the digits are used up. Neither an outlier nor
a crowd of close values makes a window larger than the stated numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ordered_key
from ..session import written

#: Bits right of each digit: the first has 20 bits (sign, exponent and 8 of the fraction), the others 11 each.
SHIFTS = (44, 33, 22, 11, 0)
#: An opened digit with no more rows than this is sorted by value.
LEAF_ROWS = 65_536


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, qs: Sequence[float], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows ``keys, q, value`` with ``value = v[lo] + (v[hi] - v[lo]) * (pos - lo)``, ``pos = (n - 1) * q``.

    ``keys`` are a handful of groups such as labels or models. NULL values are left out; NaN counts as the largest.
    A window holds at most 2^20 digits of a group, or ``leaf_rows`` values.
    """
    if any(q < 0 or q > 1 for q in qs):
        raise ValueError("quantiles must lie between 0 and 1")
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    # Written once: every level scans the bare values, not the plan that made them.
    rows = written(df.select(F.lit(0).alias("__k"), *keys, v.cast("double").alias("__v")).where("__v IS NOT NULL"))
    rows = rows.withColumn("__key", ordered_key(F.col("__v")))
    by = ["__k", *keys]

    counts = rows.groupBy(*by, F.shiftright("__key", SHIFTS[0]).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    position = (F.col("__n") - 1).cast("double")
    ranks = F.array_distinct(F.array(*[f(position * F.lit(float(q))).cast("bigint") for q in qs for f in (F.floor, F.ceil)]))
    total = counts.withColumn("__n", F.sum("__c").over(W.partitionBy(*by)))
    opened = written(_with_ranks(total.withColumn("__start", F.lit(0).cast("bigint")).withColumn("__ranks", ranks), by, "__p"))

    level = 0
    while level + 1 < len(SHIFTS) and (opened.agg(F.max("__c")).first()[0] or 0) > leaf_rows:
        inside = rows.withColumn("__p", F.shiftright("__key", SHIFTS[level])).join(opened.select(*by, "__p"), [*by, "__p"], "left_semi")
        level += 1
        counts = inside.groupBy(*by, "__p", F.shiftright("__key", SHIFTS[level]).alias("__next")).agg(F.count(F.lit(1)).alias("__c"))
        parent = opened.select(*by, "__p", "__n", "__start", "__ranks")
        opened = written(_with_ranks(counts.join(parent, [*by, "__p"]), [*by, "__p"], "__next").drop("__p").withColumnRenamed("__next", "__p"))

    inside = rows.withColumn("__p", F.shiftright("__key", SHIFTS[level])).join(opened.select(*by, "__p"), [*by, "__p"], "left_semi")
    values = inside.groupBy(*by, "__p", "__v").agg(F.count(F.lit(1)).alias("__c")).join(opened.drop("__c"), [*by, "__p"])
    hit = _with_ranks(values, [*by, "__p"], "__v").select(*by, "__n", "__v", F.explode("__ranks").alias("__rank"))
    each = hit.select(*by, "__v", "__rank", position.alias("__pos"), F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    at = F.col("__pos") * F.col("q")
    picked = each.where((F.col("__rank") == F.floor(at)) | (F.col("__rank") == F.ceil(at)))
    low, high = F.min("__v"), F.max("__v")
    fraction = F.max(at) - F.floor(F.max(at))
    return picked.groupBy(*by, "q").agg(F.when(fraction > 0, low + (high - low) * fraction).otherwise(low).alias("value")).drop("__k")


def _with_ranks(counted: DataFrame, part: list[str], order: str) -> DataFrame:
    """Parts of a digit that hold a wanted rank, with the number of rows before them (``__start``) and those ranks."""
    up = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("__start", F.col("__start") + F.coalesce(F.sum("__c").over(up), F.lit(0)))
    mine = F.filter("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c")))
    return placed.withColumn("__ranks", mine).where(F.size("__ranks") > 0)
