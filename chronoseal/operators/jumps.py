"""Greedy subsequence match of long runs by composed jump tables.

A greedy walk over the source holds one number, the next wanted target. So a
block of the source is a function from that number to that number, and the
function of two neighbouring blocks is their composition. Blocks are tabulated
in parallel, composed pairwise in a tree, and the tree read downwards gives the
number with which each block starts. Then every block is walked on its own.

A walk that is to reach the end has dropped at most ``source - target`` posts,
so only that many starting numbers are tabulated per block; a number outside
means failure. Tables are rows keyed by (user, run, block, number): no task
holds more than one block of the source and as much of the target, whatever the
length of a run. Runs of one block need no table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..session import materialize, written
from .ranking import row_numbers

POSITIONS = ArrayType(IntegerType())


def jump(source: np.ndarray, wanted: np.ndarray, states: int) -> np.ndarray:
    """Next wanted position after ``source``, for each start ``0 .. states - 1`` in ``wanted``."""
    codes, _ = pd.factorize(np.concatenate([source, wanted]))
    posts = codes[: len(source)]
    # The end of the target wants nothing; starts that meet move together from then on.
    targets = np.append(codes[len(source) :], -1)
    at = np.arange(states)
    for code in posts:
        at += targets[at] == code
    return at


def walk(source: np.ndarray, wanted: np.ndarray) -> list[int]:
    """Greedy positions in ``source`` of the leading texts of ``wanted``; shorter than ``wanted`` if it runs out."""
    found: list[int] = []
    n = len(wanted)
    for position, text in enumerate(source):
        if len(found) == n:
            break
        if text == wanted[len(found)]:
            found.append(position)
    return found


@F.pandas_udf(POSITIONS)
def _jumps(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for source, wanted, states in parts:
        yield pd.Series([jump(s, w, n).tolist() for s, w, n in zip(source, wanted, states)])


@F.pandas_udf(POSITIONS)
def _walks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for source, wanted in parts:
        yield pd.Series([walk(s, w) for s, w in zip(source, wanted)])


def _texts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Texts of a group in order; callers group by block, so a list holds at most two blocks."""
    listed = F.array_sort(F.collect_list(F.struct("__j", "__text")))
    return rows.groupBy(*by).agg(F.transform(listed, lambda p: p["__text"]).alias(name))


def _tables(blocks: DataFrame, targets: DataFrame, shape: DataFrame, run: list[str], size: int) -> DataFrame:
    """Jump tables ``run, __block, __from, __to`` of the runs in ``shape`` (more than one block each)."""
    first = F.col("__block") * size
    low = F.greatest(first - (F.col("__s") - F.col("__t")), F.lit(0))
    high = F.least(first, F.col("__t"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__s") - 1) / F.lit(size))))
    spans = shape.select(*run, "__s", "__t", every.alias("__block")).select(*run, "__block", "__t", low.alias("__low"), high.alias("__high"))
    # A wide band is cut, so that a piece has at most `size` starts and needs at most two blocks of the target.
    starts = F.explode(F.sequence(F.col("__low"), F.col("__high"), F.lit(size).cast("bigint")))
    pieces = spans.where("__low <= __high").select(*run, "__block", "__t", "__high", starts.alias("__first"))
    pieces = pieces.withColumn("__states", F.least(F.lit(size).cast("bigint"), F.col("__high") - F.col("__first") + 1).cast("int"))
    last = F.least(F.col("__first") + F.col("__states") + F.lit(size), F.col("__t")) - 1
    inside = F.when(F.col("__first") <= last, F.sequence(F.col("__first"), last)).otherwise(F.array().cast("array<bigint>"))
    asked = pieces.select(*run, "__block", "__first", "__states", F.explode_outer(inside).alias("__j"))
    named = asked.join(targets.select(*run, "__j", "__text"), [*run, "__j"], "left")
    # The end of the target has no text; NULL is no list entry there.
    entry = F.when(F.col("__text").isNotNull(), F.struct("__j", "__text"))
    listed = named.groupBy(*run, "__block", "__first", "__states").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda p: p["__text"]).alias("__wanted"))
    jumped = listed.join(blocks, [*run, "__block"]).select(*run, "__block", "__first", _jumps("__source", "__wanted", "__states").alias("__next"))
    return jumped.select(*run, "__block", "__first", F.posexplode("__next").alias("__i", "__n")).select(
        *run, "__block", (F.col("__first") + F.col("__i")).alias("__from"), (F.col("__first") + F.col("__n")).alias("__to")
    )


def _composed(table: DataFrame, run: list[str]) -> DataFrame:
    """Tables of pairs of neighbouring blocks; a last block without neighbour stays as it is."""
    pair = F.floor(F.col("__block") / F.lit(2))
    left = table.where("__block % 2 = 0").select(*run, pair.alias("__pair"), "__from", F.col("__to").alias("__mid"))
    right = table.where("__block % 2 = 1").select(*run, pair.alias("__pair"), F.col("__from").alias("__mid"), "__to", F.lit(True).alias("__met"))
    paired = right.select(*run, "__pair").distinct().withColumn("__has", F.lit(True))
    joined = left.join(right, [*run, "__pair", "__mid"], "left").join(paired, [*run, "__pair"], "left")
    # A start whose middle lies outside the next table cannot reach the end.
    kept = joined.where("__met OR __has IS NULL")
    return kept.select(*run, F.col("__pair").alias("__block"), "__from", F.coalesce("__to", "__mid").alias("__to"))


def _starts(table: DataFrame, run: list[str], longest: int) -> DataFrame:
    """``run, __block, __from, __to`` of the one walk that begins with 0; ``longest`` is the largest number of blocks."""
    levels = [table]
    while longest > 1:
        levels.append(written(_composed(levels[-1], run)))
        longest = (longest + 1) // 2
    at = levels[-1].where("__block = 0 AND __from = 0")
    for level in reversed(levels[:-1]):
        # The even child starts where its parent does, the odd one where the even one ends.
        even = at.select(*run, (F.col("__block") * 2).alias("__block"), "__from").join(level, [*run, "__block", "__from"])
        even = written(even.select(*run, "__block", "__from", "__to"))
        odd = even.select(*run, (F.col("__block") + 1).alias("__block"), F.col("__to").alias("__from")).join(level, [*run, "__block", "__from"])
        at = written(even.unionByName(odd.select(*run, "__block", "__from", "__to")))
    return at


def walk_runs(rows: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """Greedy match of runs: ``key, target_index, source_index``, NULL for all targets of a run that does not match.

    ``rows`` has ``key, __run, side`` ('s' or 't'), ``position`` and ``__text``; positions are unique in a side of a
    run. Texts are compared whole; NULL texts must be replaced before. ``size`` bounds the posts a task takes as one group.
    """
    run = [key, "__run"]
    by_index = F.floor(F.col("position") / F.lit(size))
    numbered = materialize(row_numbers(rows, [*run, "side"], [F.col("position")], by_index, "__n").withColumn("__j", F.col("__n") - 1).drop("__n"))
    source, targets = numbered.where("side = 's'"), numbered.where("side = 't'")
    shape = numbered.groupBy(*run).agg(F.count_if(F.col("side") == "s").alias("__s"), F.count_if(F.col("side") == "t").alias("__t"))
    shape = written(shape.where("__t > 0 AND __s >= __t"))
    longest = shape.agg(F.max("__s")).first()[0] or 0
    block = F.floor(F.col("__j") / F.lit(size))
    blocks = _texts(source.withColumn("__block", block), [*run, "__block"], "__source")

    zero = F.lit(0).cast("bigint")
    parts = shape.where(F.col("__s") <= size).select(*run, zero.alias("__block"), zero.alias("__from"), F.col("__t").alias("__to"))
    if longest > size:
        long = shape.where(F.col("__s") > size)
        table = written(_tables(blocks, targets, long, run, size))
        ways = _starts(table, run, -(-longest // size))
        # A run counts only if its last block ends with the end of the target.
        ends = ways.groupBy(*run).agg(F.max("__to").alias("__t")).join(long, [*run, "__t"], "left_semi").select(*run)
        parts = parts.unionByName(ways.where("__to > __from").join(ends, run, "left_semi"))
    parts = written(parts)
    # Each target belongs to one block, the one during which it was wanted.
    own = parts.select(*run, "__block", F.explode(F.sequence("__from", F.col("__to") - 1)).alias("__j"))
    wanted = _texts(targets.join(own, [*run, "__j"]), [*run, "__block"], "__wanted")
    found = parts.join(blocks, [*run, "__block"]).join(wanted, [*run, "__block"]).select(*run, "__block", "__from", "__to", _walks("__source", "__wanted").alias("__at"))
    whole = found.where(F.size("__at") == F.col("__to") - F.col("__from"))
    pairs = whole.select(*run, "__block", "__from", F.posexplode("__at").alias("__i", "__p")).select(
        *run, (F.col("__from") + F.col("__i")).alias("__j"), (F.col("__block") * size + F.col("__p")).alias("__sj")
    )
    placed = pairs.join(source.select(*run, F.col("__j").alias("__sj"), F.col("position").alias("source_index")), [*run, "__sj"])
    matched = targets.select(*run, "__j", F.col("position").alias("target_index")).join(placed.select(*run, "__j", "source_index"), [*run, "__j"], "left")
    return matched.select(key, "target_index", "source_index")
