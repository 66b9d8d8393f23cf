"""Ranking, prefix sums and per-key lookups that survive hot keys.

A window over one key puts all rows of that key into one task. Where a key may
hold a large part of the table the work is cut into blocks that follow the sort
order: rank inside a block, then add the row count of the earlier blocks. Only
the block totals (one row per key and block) meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with more rows than this counts as hot. At most rows / HOT_ROWS keys
# can be hot, which bounds every broadcast of hot keys.
HOT_ROWS = 1_000_000


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add running totals (current row included) of ``sums`` per key along ``order``.

    ``block`` must never decrease along ``order``; rows that tie on ``order``
    must share a block. Keys and block may not be NULL.
    """
    keys = list(keys)
    blocked = df.withColumn("__block", block)
    for name, value in sums.items():
        blocked = blocked.withColumn(f"__v_{name}", value)
    # Stated outright: rows that arrive partitioned by the keys alone would otherwise stay
    # together and one task would get all blocks of a hot key.
    spread = blocked.repartition(*keys, "__block")
    inside = W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = spread.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__in_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(*keys, "__block")
        .agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
        .select(*keys, "__block", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums])
    )
    joined = ranked.join(totals, [*keys, "__block"])
    return joined.select(*_cols(df.columns), *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    name: str = "rank",
) -> DataFrame:
    """``row_number()`` per key (from 1) without gathering a key in one task."""
    return running_sums(df, keys, order, block, {name: F.lit(1).cast("bigint")})


def hash_block(hash_column: Column, hex_digits: int = 3) -> Column:
    """Block id from the leading hex digits of a hash that is also the sort key."""
    return F.conv(F.substring(hash_column, 1, hex_digits), 16, 10).cast("int")


def hot_copies(totals: DataFrame, key: str, total: str = "total", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot keys with the number of parts to split them into; at most rows / hot_rows of them."""
    return totals.where(F.col(total) > hot_rows).select(key, F.ceil(F.col(total) / F.lit(hot_rows)).cast("int").alias("__copies"))


def _with_salt(df: DataFrame, hot: DataFrame, key: str, spread_on: Sequence[str]) -> DataFrame:
    salt = F.when(F.col("__copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread_on), F.col("__copies")).cast("int"))
    return df.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__copies")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank; Spark keeps ``n`` rows per key and task before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= n)


def top_n_of_hot(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    n: int,
    totals: DataFrame,
    spread_on: Sequence[str],
    rank_name: str = "rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """:func:`top_n` for wide rows: a hot key is first reduced in parallel parts.

    Tasks times ``n`` rows of one key may still be too many for one task. The
    second pass sees at most ``n`` rows per part.
    """
    salted = _with_salt(df, hot_copies(totals, key, hot_rows=hot_rows), key, spread_on)
    parts = top_n(salted, [key, "__salt"], order, n, "__part").drop("__part", "__salt")
    return top_n(parts, [key], order, n, rank_name)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key under a metric order."""
    if not keys:
        return df.orderBy(*order).limit(1)
    return top_n(df, keys, order, 1, rank_name="__best").drop("__best")


def with_totals(
    df: DataFrame,
    totals: DataFrame,
    key: str,
    spread_on: Sequence[str],
    total: str = "total",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join per-key totals onto the rows; a hot key is spread over several tasks.

    ``totals`` has one row per key with its row count in ``total``. The totals
    row of a hot key is repeated once per ``hot_rows`` rows and its rows pick one
    repeat by hash. The broadcast holds hot keys only, at most rows / hot_rows.
    """
    copies = F.ceil(F.col(total) / F.lit(hot_rows)).cast("int")
    left = _with_salt(df, hot_copies(totals, key, total, hot_rows), key, spread_on)
    last = F.when(F.col(total) > hot_rows, copies - 1).otherwise(F.lit(0))
    right = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return left.join(right, [key, "__salt"]).drop("__salt")
