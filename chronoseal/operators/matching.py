"""Ordered-subsequence match of a retained timeline to its source.

The reference semantics are greedy: walk the source once and take a post when it
equals the next wanted text. That is sequential, so a user is cut at *anchors*
first. A text that occurs equally often in source and target must use all its
occurrences in order, which fixes its k-th target post to its k-th source post
without looking at any other post. Between two anchors only texts that occur
more often in the source than in the target are open. A run with one open text
is matched by occurrence number. Only runs that mix several open texts need the
greedy pass, and :mod:`.jumps` splits that pass into blocks, so that even one
user with one run is matched by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .jumps import walk_runs
from .ranking import row_numbers, running_sums

INDEX_BLOCK = 4096


def greedy_positions(source: list[str], target: list[str]) -> list[int] | None:
    """Source positions of the target posts, or ``None`` when it is not a subsequence."""
    found: list[int] = []
    wanted = iter(target)
    nxt = next(wanted, None)
    for position, text in enumerate(source):
        if nxt is None:
            break
        if text == nxt:
            found.append(position)
            nxt = next(wanted, None)
    return found if nxt is None else None


def _occurrences(df: DataFrame, key: str, index: str, name: str) -> DataFrame:
    """Occurrence number of each text within a user, by index blocks."""
    block = F.floor(F.col(index) / F.lit(INDEX_BLOCK))
    return row_numbers(df, [key, "__text"], [F.col(index)], block, name)


def _prepare(df: DataFrame, key: str, index: str, text: str, out: str) -> DataFrame:
    # Texts are compared by 256-bit digest so whole posts are not shuffled again and again.
    return df.select(key, F.col(index).cast("bigint").alias(out), F.sha2(F.coalesce(F.col(text), F.lit("\u0000")), 256).alias("__text"))


def match_ordered_posts(
    source: DataFrame,
    target: DataFrame,
    key: str = "user_id",
    index: str = "tweet_index",
    text: str = "tweet_text",
) -> DataFrame:
    """One row per target post: ``key, target_index, source_index``.

    ``source_index`` is NULL where no source post fits. A user is matched only
    if none is NULL and the source indexes rise with the target index; see
    :func:`match_findings`.
    """
    src = _prepare(source, key, index, text, "source_index")
    tgt = _prepare(target, key, index, text, "target_index")
    # Each (user, text) side is counted with partial sums before the shuffle.
    s_count = src.groupBy(key, "__text").agg(F.count(F.lit(1)).alias("s_n"))
    t_count = tgt.groupBy(key, "__text").agg(F.count(F.lit(1)).alias("t_n"))
    kinds = t_count.join(s_count, [key, "__text"], "left").select(
        key,
        "__text",
        F.when(F.col("s_n").isNull() | (F.col("s_n") < F.col("t_n")), F.lit("missing"))
        .when(F.col("s_n") == F.col("t_n"), F.lit("anchor"))
        .otherwise(F.lit("open"))
        .alias("kind"),
    )
    t_kind = tgt.join(kinds, [key, "__text"])
    s_kind = src.join(kinds, [key, "__text"])
    t_anchor = _occurrences(t_kind.where("kind = 'anchor'").select(key, "__text", "target_index"), key, "target_index", "occurrence")
    s_anchor = _occurrences(s_kind.where("kind = 'anchor'").select(key, "__text", "source_index"), key, "source_index", "occurrence")
    # Both tables below are read several times; checkpoints keep the plan from growing with each use.
    anchors = materialize(t_anchor.join(s_anchor, [key, "__text", "occurrence"]).select(key, "target_index", "source_index"))
    missing = t_kind.where("kind = 'missing'").select(key, "target_index", F.lit(None).cast("bigint").alias("source_index"))

    runs = _open_runs(
        t_kind.where("kind = 'open'").select(key, F.lit("t").alias("side"), F.col("target_index").alias("position"), "__text"),
        s_kind.where("kind = 'open'").select(key, F.lit("s").alias("side"), F.col("source_index").alias("position"), "__text"),
        anchors,
        key,
    )
    opened = materialize(runs)
    shape = opened.groupBy(key, "__run").agg((F.min("__text") == F.max("__text")).alias("single"), F.count_if(F.col("side") == "t").alias("wanted"))
    shaped = opened.join(shape.where("wanted > 0"), [key, "__run"])
    single = _single_text_runs(shaped.where("single").select(key, "__run", "side", "position"), key)
    walked = walk_runs(shaped.where("NOT single").select(key, "__run", "side", "position", "__text"), key, INDEX_BLOCK)
    return anchors.unionByName(missing).unionByName(single).unionByName(walked)


def _single_text_runs(rows: DataFrame, key: str) -> DataFrame:
    """Runs with one open text: the k-th target post takes the k-th source post, by number and without Python."""
    block = F.floor(F.col("position") / F.lit(INDEX_BLOCK))
    numbered = row_numbers(rows, [key, "__run", "side"], [F.col("position")], block, "occurrence")
    t = numbered.where("side = 't'").select(key, "__run", "occurrence", F.col("position").alias("target_index"))
    s = numbered.where("side = 's'").select(key, "__run", "occurrence", F.col("position").alias("source_index"))
    return t.join(s, [key, "__run", "occurrence"], "left").select(key, "target_index", "source_index")


def _open_runs(t_open: DataFrame, s_open: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Tag open posts of both sides with the number of anchors before them."""

    def tag(rows: DataFrame, marks: Column) -> DataFrame:
        marked = rows.withColumn("__mark", F.lit(0)).unionByName(
            anchors.select(key, F.lit("a").alias("side"), marks.alias("position"), F.lit(None).cast("string").alias("__text"), F.lit(1).alias("__mark"))
        )
        block = F.floor(F.col("position") / F.lit(INDEX_BLOCK))
        counted = running_sums(marked, [key], [F.col("position"), F.col("__mark")], block, {"__run": F.col("__mark").cast("bigint")})
        return counted.where("__mark = 0").drop("__mark")

    return tag(t_open, F.col("target_index")).unionByName(tag(s_open, F.col("source_index"))).where(F.col("side").isin("s", "t"))


def match_findings(matches: DataFrame, key: str = "user_id") -> DataFrame:
    """Users whose target is not an ordered subsequence: a post without a source, or indexes that fall back."""
    block = F.floor(F.col("target_index") / F.lit(INDEX_BLOCK))
    # Order check by blocks: inside a block each index must exceed the one before it, and
    # the lowest index of a block must exceed the highest of all earlier blocks.
    blocked = matches.withColumn("__block", block)
    inside = W.partitionBy(key, "__block").orderBy("target_index")
    stepped = blocked.withColumn("__prev", F.lag("source_index").over(inside))
    per_block = stepped.groupBy(key, "__block").agg(
        F.count_if(F.col("source_index").isNull()).alias("missing"),
        F.count_if(F.col("source_index") <= F.col("__prev")).alias("falls"),
        F.min("source_index").alias("low"),
        F.max("source_index").alias("high"),
    )
    across = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    linked = per_block.withColumn("__before", F.max("high").over(across))
    per_user = linked.groupBy(key).agg(
        F.sum("missing").alias("missing"),
        F.sum(F.col("falls") + F.when(F.col("low") <= F.col("__before"), F.lit(1)).otherwise(F.lit(0))).alias("falls"),
    )
    code = F.when(F.col("missing") > 0, F.lit("match-missing-post")).otherwise(F.lit("match-not-ordered"))
    return per_user.where("missing > 0 OR falls > 0").select(code.alias("code"), F.col(key).cast("string").alias("detail"))


def require_matched(matches: DataFrame, key: str = "user_id") -> DataFrame:
    """``matches``, or an error that names a user whose target is no ordered part of the source.

    The error comes when the rows are read. Rows of a sound user pass unchanged.
    """
    failed = match_findings(matches, key).select(F.col("detail").alias("__failed"), "code").distinct()
    joined = matches.join(failed, F.col(key).cast("string") == F.col("__failed"), "left")
    message = F.concat("code", F.lit(": user "), F.col("__failed"))
    checked = F.when(F.col("__failed").isNull(), F.col(key)).otherwise(F.raise_error(message).cast(matches.schema[key].dataType))
    return joined.withColumn(key, checked).select(*matches.columns)


def matched_posts(source: DataFrame, matches: DataFrame, key: str = "user_id", index: str = "tweet_index", strict: bool = False) -> DataFrame:
    """Source rows of the matched users, re-indexed by their target position.

    A user whose target is no ordered part of the source is an error if ``strict``. Otherwise it has no rows, and
    :func:`match_findings` lists it.
    """
    if strict:
        sound = require_matched(matches, key)
    else:
        failed = match_findings(matches, key).select(F.col("detail").alias("__failed")).distinct()
        sound = matches.join(failed, F.col(key).cast("string") == F.col("__failed"), "left_anti")
    wanted = sound.select(key, F.col("source_index").alias(index), "target_index")
    joined = source.withColumn(index, F.col(index).cast("bigint")).join(wanted, [key, index])
    return joined.drop(index).withColumnRenamed("target_index", index)
