"""Artifact chains: hashes recorded by each artifact for what it was made from.

``artifacts`` has ``artifact, digest`` (the digest it has now). ``links`` has
``artifact, depends_on, recorded``: ``artifact`` was made from ``depends_on``,
whose digest was ``recorded`` then. A link is broken if the artifact it names is
gone, has no recorded hash, or has another digest now. An artifact is only as
sound as everything below it, so breaks are carried upwards.

Both walks go one level a round and keep one row per artifact, never one per
pair of artifact and ancestor, so they hold for wide and shared chains. Levels
are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .alignment import finding, or_pass

_BREAK = ("broken", "depends_on", "code")


def broken_links(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """``artifact, depends_on, code`` of each broken link: ``artifact-missing``, ``hash-missing`` or ``hash-changed``."""
    now = artifacts.select(F.col("artifact").alias("depends_on"), F.col("digest").alias("__now"), F.lit(True).alias("__known"))
    joined = links.select("artifact", "depends_on", "recorded").join(now, "depends_on", "left")
    code = (
        F.when(F.col("__known").isNull(), F.lit("artifact-missing"))
        .when(F.col("recorded").isNull(), F.lit("hash-missing"))
        .when(~F.col("recorded").eqNullSafe(F.col("__now")), F.lit("hash-changed"))
    )
    return joined.select("artifact", "depends_on", code.alias("code")).where("code IS NOT NULL")


def first_breaks(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """The nearest broken link at or below each unsound artifact: ``artifact, steps, broken, depends_on, code``.

    ``broken`` is the artifact that holds the link, ``steps`` the number of links from ``artifact`` down to it. Among
    equally near ones the first by name is taken. Sound artifacts have no row; cycles end the walk where they close.
    """
    edges = written(links.select("artifact", F.col("depends_on").alias("__below")).distinct())
    own = broken_links(artifacts, links).select("artifact", F.struct(F.col("artifact").alias("broken"), "depends_on", "code").alias("b"))
    level = written(own.groupBy("artifact").agg(F.min("b").alias("b")))
    levels = [level.withColumn("steps", F.lit(0))]
    while not levels[-1].isEmpty():
        below = levels[-1].select(F.col("artifact").alias("__below"), "b")
        above = edges.join(below, "__below").groupBy("artifact").agg(F.min("b").alias("b"))
        seen = reduce(DataFrame.unionByName, [known.select("artifact") for known in levels])
        level = written(above.join(seen, "artifact", "left_anti"))
        levels.append(level.withColumn("steps", F.lit(len(levels))))
    found = reduce(DataFrame.unionByName, levels)
    return found.select("artifact", F.col("steps").cast("bigint").alias("steps"), *[F.col(f"b.{c}").alias(c) for c in _BREAK])


def unrooted(links: DataFrame) -> DataFrame:
    """Artifacts that lie on a cycle of links or above one: ``artifact``. Their hashes cannot all be true."""
    left = written(links.select("artifact", "depends_on").distinct())
    open_links = left.count()
    while open_links:
        # What depends on nothing any more is settled, and so are the links to it.
        settled = left.select(F.col("depends_on")).distinct().join(left.select(F.col("artifact").alias("depends_on")).distinct(), "depends_on", "left_anti")
        left = written(left.join(settled, "depends_on", "left_anti"))
        before, open_links = open_links, left.count()
        if open_links == before:
            break
    return left.select("artifact").distinct()


def chain_findings(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """One failed finding per unsound artifact that names its first broken link, or one passing row."""
    breaks = first_breaks(artifacts, links)
    named = F.concat(F.col("artifact"), F.lit(": "), F.col("broken"), F.lit(" -> "), F.col("depends_on"))
    cycles = finding(unrooted(links), "chain-cycle", F.col("artifact"))
    return or_pass(finding(breaks, F.col("code"), named).unionByName(cycles), "artifact-chain", "all links sound")


def require_chain(artifacts: DataFrame, links: DataFrame, top: str) -> None:
    """Raise unless ``top`` exists and everything below it is sound; the error names the first broken link."""
    if artifacts.where(F.col("artifact") == top).isEmpty():
        raise ValueError(f"artifact-missing: {top}")
    found = first_breaks(artifacts, links).where(F.col("artifact") == top).first()
    if found is not None:
        raise ValueError(f"{found['code']}: {found['broken']} -> {found['depends_on']}")
    if not unrooted(links).where(F.col("artifact") == top).isEmpty():
        raise ValueError(f"chain-cycle: {top}")
