"""Vector queries: parsing, pooling, pool checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import matching, pooling
from ..operators.alignment import align_to_manifest
from .base import query, table
from .inputs import VECTOR_DIM, VECTORS_SQL, rounded, vectors

_ENTRIES = "SELECT user_id, tweet_index, relevance, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM vec"


def _pool(level: int) -> str:
    inside = f"relevance >= {level}"
    return f"coalesce(avg(CASE WHEN {inside} THEN CAST(x AS DOUBLE) END), 0e0)"


@query(
    "A4 K5",
    f"""WITH {VECTORS_SQL}, e AS ({_ENTRIES})
    SELECT user_id, pos, round(CAST(CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) + 0e0 AS mean,
    round(CAST(CAST({_pool(3)} AS FLOAT) AS DOUBLE), 4) + 0e0 AS rel3, round(CAST(CAST({_pool(6)} AS FLOAT) AS DOUBLE), 4) + 0e0 AS rel6,
    round(CAST(CAST({_pool(7)} AS FLOAT) AS DOUBLE), 4) + 0e0 AS rel7,
    count(*) AS mean_count, count(*) FILTER (WHERE relevance >= 7) AS rel7_count FROM e GROUP BY user_id, pos""",
)
def pooled_vectors(spark, sf_dir):
    """Mean and relevance pools per user, shown entry by entry."""
    pools = pooling.pool_vectors(vectors(spark, sf_dir), VECTOR_DIM)
    rows = F.inline(F.arrays_zip("mean", "rel3", "rel6", "rel7", F.sequence(F.lit(1), F.lit(VECTOR_DIM)).alias("pos")))
    flat = pools.select("user_id", "mean_count", "rel7_count", rows)
    out = flat.select("user_id", F.col("pos").cast("bigint").alias("pos"), "mean", "rel3", "rel6", "rel7", "mean_count", "rel7_count")
    return rounded(out, 4)


@query(
    "A4",
    f"""WITH {VECTORS_SQL}, e AS ({_ENTRIES}), m AS (SELECT user_id, pos, avg(CAST(x AS DOUBLE)) AS v, count(*) AS n FROM e GROUP BY user_id, pos)
    SELECT user_id, max(n) AS count, round(sum(v), 4) + 0e0 AS total FROM m GROUP BY user_id""",
)
def mean_pools(spark, sf_dir):
    p = pooling.mean_pool(vectors(spark, sf_dir))
    return rounded(p.select("user_id", "count", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query(
    "A27",
    f"""WITH {VECTORS_SQL}, v AS (SELECT user_id, CASE WHEN user_id < 4 THEN 0 ELSE relevance END AS relevance, embedding FROM vec),
    u AS (SELECT user_id, max(relevance) AS m FROM v GROUP BY user_id), t(pool, t) AS (VALUES ('mean', 0), ('rel3', 3), ('rel6', 6), ('rel7', 7), ('rel9', 11))
    SELECT (SELECT count(*) FROM u) AS users, pool, count(*) FILTER (WHERE m >= t) AS nonzero_rows, count(*) FILTER (WHERE m >= t) = 0 AS collapsed FROM t CROSS JOIN u GROUP BY pool""",
)
def pool_support(spark, sf_dir):
    """Four users without relevant posts, and a level no post reaches."""
    posts = vectors(spark, sf_dir).withColumn("relevance", F.when(F.col("user_id") < 4, F.lit(0)).otherwise(F.col("relevance")))
    pools = pooling.pool_vectors(posts, VECTOR_DIM, (3, 6, 7, 11))
    return pooling.pool_support(pools.withColumnRenamed("rel11", "rel9"), ("mean", "rel3", "rel6", "rel7", "rel9"))


@query(
    "S11 G18",
    f"""WITH {VECTORS_SQL} SELECT 'pool-dimension' AS code, CAST(tweet_index AS VARCHAR) AS detail FROM vec WHERE tweet_index % 50 = 1
    UNION ALL SELECT 'pool-nonfinite', CAST(tweet_index AS VARCHAR) FROM vec WHERE tweet_index % 50 = 2
    UNION ALL SELECT 'pool-count', CAST(tweet_index AS VARCHAR) FROM vec WHERE tweet_index % 50 = 3
    UNION ALL SELECT 'pool-duplicate-user', CAST(tweet_index AS VARCHAR) FROM vec WHERE tweet_index % 50 = 4""",
)
def pool_contract(spark, sf_dir):
    """Vectors with planted faults; every fault has its own finding."""
    kind = F.col("user_id") % 50
    pools = vectors(spark, sf_dir).select(F.col("tweet_index").alias("user_id"), "embedding")
    faulty = pools.select(
        "user_id",
        F.when(kind == 1, F.slice("embedding", 1, 63)).when(kind == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("embedding"),
        F.when(kind == 3, F.lit(0)).otherwise(F.lit(1)).alias("count"),
    )
    twice = faulty.unionByName(faulty.where(F.col("user_id") % 50 == 4))
    return pooling.pool_findings(twice, VECTOR_DIM).distinct()


@query(
    "A5 J12",
    "WITH t AS (SELECT conv_id AS user_id, count(*) AS n FROM conversations GROUP BY conv_id), k AS (SELECT conv_id AS user_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id)"
    " SELECT CASE WHEN k.n IS NULL THEN 'pool-missing-user' ELSE 'pool-count-mismatch' END AS code, CAST(t.user_id AS VARCHAR) AS detail FROM t LEFT JOIN k USING (user_id) WHERE coalesce(k.n, -1) <> t.n",
)
def pool_coverage(spark, sf_dir):
    """Pools over matched turns against the number of all turns of a user."""
    from .posts import _retained

    source, target = _retained(spark, sf_dir)
    n = F.char_length("tweet_text").cast("float")
    posts = matching.matched_posts(source, matching.match_ordered_posts(source, target), strict=True).withColumn("embedding", F.array(n, F.lit(1.0).cast("float")))
    pools = pooling.mean_pool(posts)
    targets = source.groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"))
    return pooling.coverage_findings(pools, targets)


@query(
    "P16",
    f"""WITH {VECTORS_SQL}, e AS ({_ENTRIES}), n AS (SELECT tweet_index, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm FROM e WHERE pos <= 16 GROUP BY tweet_index)
    SELECT e.tweet_index, e.pos, round(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) * 1e0, 4) + 0e0 AS x FROM e JOIN n USING (tweet_index) WHERE pos <= 16""",
)
def unit_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("tweet_index", F.posexplode(V.truncate_and_normalize("embedding", 16)).alias("pos", "x"))
    return rounded(v.select("tweet_index", (F.col("pos") + 1).cast("bigint").alias("pos"), "x"), 4)


@query("S9", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(round(x * 1000) AS INT) AS DOUBLE))), 3) + 0e0 AS total FROM embeddings")
def vector_texts(spark, sf_dir):
    """Vectors written as text and parsed again; entries are scaled in single precision, as they are stored."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int").cast("string")), ","), F.lit("]"))
    t = table(spark, sf_dir, "embeddings").select("vec_id", text.alias("t"))
    total = F.aggregate(V.parse_vector("t"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(t.select("vec_id", V.count_dimensions("t").cast("bigint").alias("dims"), total.alias("total")), 3)


@query(
    "J3 J2 S10",
    """WITH p AS (SELECT c_custkey AS user_id FROM customer)
    SELECT p.user_id, CAST(coalesce(len(e.embedding), 64) AS BIGINT) AS dims, e.vec_id IS NULL AS imputed FROM p LEFT JOIN embeddings e ON p.user_id = e.vec_id""",
)
def imputed_vectors(spark, sf_dir):
    """Customers without a vector get the zero vector."""
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    feats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    filled = align_to_manifest(manifest, feats, fill_dim=VECTOR_DIM)
    return filled.select("user_id", F.size("embedding").cast("bigint").alias("dims"), (~V.any_nonzero("embedding")).alias("imputed"))
