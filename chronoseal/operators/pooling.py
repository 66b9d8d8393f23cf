"""Vector pooling per user.

A post belongs to exactly one relevance band, so each vector is added once, by
Spark ML's vector summariser (JVM, partial sums before the shuffle). The pools
"relevance >= t" are then sums over at most ``len(thresholds) + 1`` band rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import vectors as V

# Pools besides the plain mean.
POOL_LEVELS = (3, 6, 7)


def _band(relevance: Column, levels: Sequence[int]) -> Column:
    band = F.lit(0)
    for level in sorted(levels):
        band = F.when(relevance >= level, F.lit(level)).otherwise(band)
    return band


def mean_pool(posts: DataFrame, key: str = "user_id", embedding: str = "embedding") -> DataFrame:
    """Plain mean vector and post count per user."""
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    pooled = posts.groupBy(key).agg(F.count(F.lit(1)).alias("count"), Summarizer.mean(vector).alias("__mean"))
    return pooled.select(key, vector_to_array("__mean").alias("embedding"), "count")


def _weighted_mean(bands: Column, dim: int, level: int) -> tuple[Column, Column]:
    kept = F.filter(bands, lambda b: b["band"] >= level)
    count = F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"])
    total = F.aggregate(
        kept,
        V.zero_vector(dim, "double"),
        lambda acc, b: F.zip_with(acc, b["mean"], lambda x, y: x + y * b["n"]),
    )
    mean = F.when(count > 0, F.transform(total, lambda x: x / count)).otherwise(V.zero_vector(dim, "double"))
    return mean, count


def pool_vectors(
    posts: DataFrame,
    dim: int,
    levels: Sequence[int] = POOL_LEVELS,
    key: str = "user_id",
    embedding: str = "embedding",
    relevance: str = "relevance",
) -> DataFrame:
    """``mean`` plus one pool per level with its post count; the zero vector where a pool is empty."""
    banded = posts.select(
        key,
        _band(N.relevance_value(relevance), levels).alias("band"),
        array_to_vector(F.col(embedding).cast("array<double>")).alias("__v"),
    )
    partial = banded.groupBy(key, "band").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("__v")).alias("__m"))
    rows = partial.select(key, F.struct("band", "n", vector_to_array("__m").alias("mean")).alias("b"))
    bands = rows.groupBy(key).agg(F.sort_array(F.collect_list("b")).alias("bands"))
    out = [F.col(key)]
    for name, level in [("mean", 0), *[(f"rel{t}", t) for t in levels]]:
        mean, count = _weighted_mean(F.col("bands"), dim, level)
        out += [mean.cast("array<float>").alias(name), count.alias(f"{name}_count")]
    return bands.select(*out)


def pool_support(pools: DataFrame, names: Sequence[str] = ("mean", "rel3", "rel6", "rel7")) -> DataFrame:
    """Users with any nonzero entry per pool; a pool without any is collapsed."""
    counted = pools.agg(F.count(F.lit(1)).alias("users"), *[F.count_if(V.any_nonzero(n)).alias(n) for n in names])
    entries = F.array(*[F.struct(F.lit(n).alias("pool"), F.col(n).alias("nonzero_rows")) for n in names])
    return counted.select("users", F.inline(entries)).withColumn("collapsed", F.col("nonzero_rows") == 0)


def pool_findings(pools: DataFrame, dim: int, embedding: str = "embedding", key: str = "user_id", count: str = "count") -> DataFrame:
    """Rows breaking the pool contract, one row per broken rule and user."""
    checks = {
        "pool-dimension": F.coalesce(F.size(embedding) != dim, F.lit(True)),
        "pool-nonfinite": ~V.all_finite(embedding),
        "pool-count": F.coalesce(F.col(count) <= 0, F.lit(True)),
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    broken = pools.select(F.explode(codes).alias("code"), F.col(key).cast("string").alias("detail"))
    twice = pools.groupBy(key).count().where("count > 1").select(F.lit("pool-duplicate-user").alias("code"), F.col(key).cast("string").alias("detail"))
    return broken.unionByName(twice)


def coverage_findings(pools: DataFrame, targets: DataFrame, key: str = "user_id", count: str = "count", expected: str = "expected") -> DataFrame:
    """Users whose pooled post count differs from the target length, or who are missing."""
    joined = targets.select(key, F.col(expected).alias("__want")).join(pools.select(key, F.col(count).alias("__have")), key, "left")
    wrong = joined.where(F.coalesce(F.col("__have"), F.lit(-1)) != F.col("__want"))
    code = F.when(F.col("__have").isNull(), F.lit("pool-missing-user")).otherwise(F.lit("pool-count-mismatch"))
    return wrong.select(code.alias("code"), F.col(key).cast("string").alias("detail"))
