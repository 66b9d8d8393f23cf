"""Hashes, redaction, folds, manifests and ordered digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..operators import splits as SP
from .base import query
from .inputs import PEOPLE_SQL, TALK_SQL, TIMELINE_SQL, people, talk, timeline

_ROW_HASH = "sha256('timeline|' || split || '|' || label || '|' || user_id)"
_FOLD = "CASE WHEN split = 'train' THEN (row_number() OVER (PARTITION BY split, label ORDER BY sha256('42|' || label || '|' || user_id), user_id) - 1) % 5 + 1 END"
MANIFEST_SQL = f"""{PEOPLE_SQL}, man AS (SELECT 'timeline' AS dataset, split, label, user_id, {_ROW_HASH} AS row_hash, {_FOLD} AS fold FROM people)"""


def manifest(spark, sf_dir):
    return SP.build_manifest(people(spark, sf_dir).select("user_id", "label", "split"), "timeline", 5, 42)


def _wide(df):
    return df.withColumn("fold", F.col("fold").cast("bigint"))


@query("W5 P5 S15", f"WITH {MANIFEST_SQL} SELECT * FROM man")
def split_manifest(spark, sf_dir):
    """Stratified folds by seeded hash order, row hashes, blank test folds."""
    return _wide(manifest(spark, sf_dir))


@query("S16", f"WITH {MANIFEST_SQL} SELECT dataset, split, label, user_id, row_hash, fold FROM man")
def rebased_manifest(spark, sf_dir):
    """Zero-based folds read back as one-based."""
    zero = manifest(spark, sf_dir).withColumn("fold", F.col("fold") - 1)
    return _wide(SP.rebase_folds(zero))


_REDACTED = "SELECT dataset, split, user_id, CASE WHEN split = 'train' THEN label ELSE '-1' END AS label, fold, CASE WHEN split = 'train' THEN row_hash ELSE sha256('timeline|raw|test|-1|' || user_id) END AS row_hash FROM man"


@query("P6", f"WITH {MANIFEST_SQL} {_REDACTED}")
def redacted_manifest(spark, sf_dir):
    """Test rows without label, fold and label-derived hash."""
    return _wide(SP.redact(manifest(spark, sf_dir), "timeline", "raw"))


@query("P6 S15", f"WITH {MANIFEST_SQL} SELECT user_id, label AS binary_label, CAST(label = 'diagnosed' AS BIGINT) AS label_code, row_hash FROM man WHERE split = 'test'")
def sealed_labels(spark, sf_dir):
    s = SP.sealed_labels(manifest(spark, sf_dir))
    return s.withColumn("label_code", F.col("label_code").cast("bigint"))


@query("S15 U1", f"WITH {MANIFEST_SQL} SELECT * FROM man WHERE split = 'train' UNION ALL SELECT '' AS dataset, 'test', 'control', user_id, '', NULL FROM man WHERE split = 'test'")
def audit_manifest(spark, sf_dir):
    """Train manifest with placeholder test rows."""
    m = manifest(spark, sf_dir)
    test_users = SP.inference_manifest(SP.redact(m, "timeline", "raw"))
    return _wide(SP.audit_manifest(SP.train_manifest(m), test_users))


@query("P7", f"WITH {MANIFEST_SQL} SELECT dataset, split, user_id, row_hash, fold FROM man")
def sanitized_inputs(spark, sf_dir):
    """Model inputs without the label column."""
    return _wide(SP.drop_columns_for_models(manifest(spark, sf_dir)))


def _tree_sql(source: str, entry: str, fan: int, levels: int) -> str:
    """CTEs t0..tn: tree digests per user."""
    ctes = [f"t0 AS (SELECT user_id, tweet_index AS o, {entry} AS d FROM {source})"]
    for i in range(levels):
        ctes.append(f"t{i + 1} AS (SELECT user_id, o // {fan} AS o, sha256(string_agg(CAST(o AS VARCHAR) || ':' || d, '|' ORDER BY o)) AS d FROM t{i} GROUP BY user_id, o // {fan})")
    return ", ".join(ctes)


@query("P30", f"WITH {TIMELINE_SQL}, {_tree_sql('tl', 'CAST(tweet_index AS VARCHAR)', 16, 2)} SELECT user_id, d AS digest FROM t2")
def index_digests(spark, sf_dir):
    """Digest of each user's post order."""
    return SP.timeline_digests(timeline(spark, sf_dir), fan=16, levels=2)


@query("P30 S21", f"WITH {TALK_SQL}, {_tree_sql('talk', 'sha256(strlen(tweet_text) || chr(58) || tweet_text)', 1024, 1)} SELECT user_id, d AS digest FROM t1")
def text_digests(spark, sf_dir):
    """Digest of each user's length-prefixed texts."""
    return SP.timeline_digests(talk(spark, sf_dir), text="tweet_text", levels=1)


@query(
    "P36",
    f"""WITH {MANIFEST_SQL}, k AS (SELECT sha256(split || '|' || user_id) AS h, sha256(concat_ws(',', dataset, split, label, user_id, row_hash, coalesce(CAST(fold AS VARCHAR), ''))) AS d FROM man),
    b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h || ':' || d, '|' ORDER BY h || ':' || d)) AS d FROM k GROUP BY 1)
    SELECT sha256(string_agg(d, '|' ORDER BY b)) AS digest FROM b""",
)
def manifest_digest(spark, sf_dir):
    """One digest for the whole manifest."""
    return SP.manifest_digest(manifest(spark, sf_dir))


@query(
    "S21",
    f"WITH {TALK_SQL} SELECT false AS ok, 'sidecar-mismatch' AS code, CAST(user_id AS VARCHAR) AS detail FROM talk GROUP BY user_id HAVING count(*) <> count(*) FILTER (WHERE role <> 'system')",
)
def sidecar_check(spark, sf_dir):
    """A side table that lost the system turns is refused for exactly the users concerned."""
    posts = talk(spark, sf_dir)
    parts = []
    for rows in (posts, posts.where("role <> 'system'")):
        n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(SP.timeline_digests(rows, levels=1).join(n, "user_id"))
    return SP.sidecar_findings(*parts)


@query("J21", f"WITH {MANIFEST_SQL} SELECT h AS fold, count(*) FILTER (WHERE fold <> h) AS train_rows, count(*) FILTER (WHERE fold = h) AS validation_rows FROM man, range(1, 6) r(h) WHERE split = 'train' GROUP BY h")
def fold_sizes(spark, sf_dir):
    """Rows on both sides of every fold split: one count per fold, then arithmetic."""
    counts = manifest(spark, sf_dir).where("split = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("validation_rows"))
    total = counts.agg(F.sum("validation_rows")).scalar()
    return counts.select(F.col("fold").cast("bigint").alias("fold"), (total - F.col("validation_rows")).alias("train_rows"), "validation_rows")


@query("P5", f"WITH {PEOPLE_SQL} SELECT user_id, sha256('timeline|raw|' || split || '|' || CAST(label = 'diagnosed' AS INT) || '|' || user_id) AS lane_hash FROM people")
def lane_hashes(spark, sf_dir):
    """Row hash with a lane and a numeric label code."""
    code = F.when(F.col("label") == "diagnosed", F.lit(1)).otherwise(F.lit(0))
    return people(spark, sf_dir).select("user_id", row_hash("timeline", "raw", F.col("split"), code, F.col("user_id")).alias("lane_hash"))
