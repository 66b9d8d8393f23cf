"""Fold assignment, redaction, manifests, label policies and ordered digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_order, redacted_hash, row_hash
from ..functions.labels import LabelPolicy, policy_label
from .quantiles import quantiles
from .ranking import hash_block, row_numbers

MANIFEST = ("dataset", "split", "label", "user_id", "row_hash", "fold")


def stratified_folds(users: DataFrame, k: int, seed: int, label: str = "label", key: str = "user_id", first: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``fold``: position in a seeded hash order within the label, modulo ``k``.

    A label holds most of the table, so positions come from hash blocks rather
    than one sort per label.
    """
    ordered = users.withColumn("__h", hash_order(seed, F.col(label), F.col(key)))
    ranked = row_numbers(ordered, [*keys, label], [F.col("__h"), F.col(key)], hash_block(F.col("__h")), "__r")
    return ranked.withColumn("fold", (F.pmod(F.col("__r") - 1, F.lit(k)) + F.lit(first)).cast("int")).drop("__h", "__r")


def rebase_folds(manifest: DataFrame, split: str = "split") -> DataFrame:
    """Make zero-based train folds one-based; other manifests stay as they are."""
    lowest = manifest.where(F.col(split) == "train").agg(F.min("fold"))
    shift = F.when(lowest.scalar() == 0, F.lit(1)).otherwise(F.lit(0))
    return manifest.withColumn("fold", F.when(F.col(split) == "train", F.col("fold") + shift).cast("int"))


def build_manifest(users: DataFrame, dataset: str, k: int, seed: int, key: str = "user_id") -> DataFrame:
    """Manifest of labelled users: train rows get folds, test rows none."""
    hashed = users.withColumn("dataset", F.lit(dataset)).withColumn("row_hash", row_hash(dataset, F.col("split"), F.col("label"), F.col(key)))
    train = stratified_folds(hashed.where("split = 'train'"), k, seed, key=key)
    test = hashed.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
    return train.select(*MANIFEST).unionByName(test.select(*MANIFEST))


def redact(manifest: DataFrame, dataset: str, lane: str, key: str = "user_id") -> DataFrame:
    """Label -1, blank fold and a label-free hash on test rows."""
    train = F.col("split") == "train"
    return manifest.select(
        F.lit(dataset).alias("dataset"),
        "split",
        key,
        F.when(train, F.col("label")).otherwise(F.lit("-1")).alias("label"),
        F.when(train, F.col("fold")).alias("fold"),
        F.when(train, F.col("row_hash")).otherwise(redacted_hash(dataset, lane, key)).alias("row_hash"),
    )


def train_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.where("split = 'train'").select(*MANIFEST)


def inference_manifest(redacted: DataFrame) -> DataFrame:
    return redacted.where("split = 'test'")


def sealed_labels(manifest: DataFrame, positive: str = "diagnosed", key: str = "user_id") -> DataFrame:
    """The only table that keeps test labels."""
    return manifest.where("split = 'test'").select(
        key,
        F.col("label").alias("binary_label"),
        F.when(F.col("label") == positive, F.lit(1)).otherwise(F.lit(0)).alias("label_code"),
        "row_hash",
    )


def audit_manifest(train: DataFrame, test_users: DataFrame, negative: str = "control") -> DataFrame:
    """Train manifest plus placeholder test rows, for audits that must not see test labels."""
    test = test_users.select(
        F.lit(None).cast("string").alias("dataset"),
        F.lit("test").alias("split"),
        F.lit(negative).alias("label"),
        "user_id",
        F.lit("").alias("row_hash"),
        F.lit(None).cast("int").alias("fold"),
    )
    filled = test.withColumn("dataset", F.lit("")).select(*MANIFEST)
    return train.select(*MANIFEST).unionByName(filled)


def drop_columns_for_models(df: DataFrame, forbidden: Sequence[str] = ("label", "actual", "predicted", "threshold")) -> DataFrame:
    """Model inputs without label columns."""
    return df.drop(*forbidden)


def policy_cutoffs(train: DataFrame, policies: Sequence[LabelPolicy], label: str = "binary_label", positive: str = "diagnosed") -> DataFrame:
    """Cutoff rows ``policy_id, binary_label, cutoff`` of the quantile policies, from train rows only."""
    quantile_policies = [p for p in policies if p.kind == "evidence_quantile"]
    if not quantile_policies:
        spark = train.sparkSession
        return spark.createDataFrame([], "policy_id STRING, binary_label STRING, cutoff DOUBLE")
    qs = sorted({p.quantile for p in quantile_policies})
    values = quantiles(train, [label], "evidence_score", qs)
    table = F.array(*[F.struct(F.lit(p.policy_id).alias("policy_id"), F.lit(p.scope).alias("scope"), F.lit(float(p.quantile)).alias("pq")) for p in quantile_policies])
    spread = values.select(F.col(label).alias("binary_label"), "q", "value", F.inline(table)).where("q = pq")
    kept = spread.where((F.col("scope") == "per_binary_label") | (F.col("binary_label") == positive))
    pooled = F.when(F.col("scope") == "per_binary_label", F.col("binary_label"))
    return kept.select("policy_id", pooled.alias("binary_label"), F.col("value").alias("cutoff"))


def cutoff_map(cutoffs: DataFrame) -> dict[tuple[str, str | None], float]:
    """Cutoffs as driver values: one entry per quantile policy and label, part of the policy lock."""
    return {(r["policy_id"], r["binary_label"]): r["cutoff"] for r in cutoffs.collect()}


def label_per_policy(rows: DataFrame, policies: Sequence[LabelPolicy], cutoffs: Mapping[tuple[str, str | None], float]) -> DataFrame:
    """Repeat rows per policy with ``label_policy_id`` and the derived ``label``."""
    made = []
    for p in policies:
        cutoff = F.lit(cutoffs.get((p.policy_id, None)))
        per_label = F.lit(None).cast("double")
        for (policy_id, label), value in cutoffs.items():
            if policy_id == p.policy_id and label is not None:
                per_label = F.when(F.col("binary_label") == label, F.lit(value)).otherwise(per_label)
        value = F.coalesce(per_label, cutoff.cast("double"))
        made += [F.lit(p.policy_id), policy_label("binary_label", p, value)]
    return rows.select("*", F.stack(F.lit(len(policies)), *made).alias("label_policy_id", "label"))


def policy_hash(policy: LabelPolicy, seed: int, manifest_digest: Column, cutoff: Column | None = None) -> Column:
    """Hash of a policy lock: policy settings, seed, manifest digest and cutoff."""
    parts = [policy.policy_id, policy.kind, str(policy.relevance_threshold), repr(policy.density_threshold), repr(policy.top10_avg_threshold), repr(policy.quantile), policy.applies_to, policy.scope, str(seed)]
    return row_hash(*parts, manifest_digest, F.coalesce((cutoff if cutoff is not None else F.lit(None)).cast("string"), F.lit("")))


def ternary_manifests(
    train: DataFrame,
    markers: DataFrame,
    policies: Sequence[LabelPolicy],
    k: int,
    seed: int,
    key: str = "user_id",
    cutoffs: Mapping[tuple[str, str | None], float] | None = None,
) -> DataFrame:
    """Labels, folds and row hashes of every policy in one job.

    Needs ``dataset, split, label, user_id, row_hash`` on ``train``.
    """
    binary = train.select("dataset", "split", key, F.col("label").alias("binary_label"), F.col("row_hash").alias("__parent"))
    joined = binary.join(markers.drop("label"), key)
    if cutoffs is None:
        cutoffs = cutoff_map(policy_cutoffs(joined, policies))
    labelled = label_per_policy(joined.select("dataset", "split", key, "binary_label", "__parent", *[c for c in markers.columns if c not in (key, "label")]), policies, cutoffs)
    hashed = labelled.withColumn("row_hash", row_hash(F.col("__parent"), F.col("label_policy_id"), F.col("label")))
    slim = hashed.select("dataset", "split", "label", "binary_label", key, "row_hash", "label_policy_id")
    return stratified_folds(slim, k, seed, key=key, keys=["label_policy_id"])


# --- digests -------------------------------------------------------------------------


def _fold_up(rows: DataFrame, keys: Sequence[str], order: str, value: str, fan: int, levels: int) -> DataFrame:
    """Tree digest: ``fan`` neighbours at a time, so no task ever holds a whole key."""
    keys = list(keys)
    current = rows.select(*keys, F.col(order).cast("bigint").alias("__o"), F.col(value).alias("__d"))
    for _ in range(levels):
        current = current.withColumn("__b", F.floor(F.col("__o") / F.lit(fan)))
        parts = F.array_sort(F.collect_list(F.struct("__o", "__d")))
        current = current.groupBy(*keys, "__b").agg(F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["__o"].cast("string"), p["__d"])), "|"), 256).alias("__d"))
        current = current.withColumnRenamed("__b", "__o")
    return current


def timeline_digests(posts: DataFrame, key: str = "user_id", index: str = "tweet_index", text: str | None = None, fan: int = 1024, levels: int = 3) -> DataFrame:
    """Ordered digest per user over indexes, or over length-prefixed texts.

    The tree has ``levels`` levels, or as many more as the largest index needs. Posts with the same index must not
    occur (see :func:`chronoseal.operators.timeline.index_health`).
    """
    largest = posts.agg(F.max(F.col(index).cast("bigint"))).first()[0] or 0
    while fan**levels <= largest:
        levels += 1
    if text is None:
        entry = F.col(index).cast("string")
    else:
        body = F.coalesce(F.col(text), F.lit(""))
        entry = F.sha2(F.concat_ws(":", F.octet_length(body).cast("string"), body), 256)
    rows = posts.select(key, F.col(index).alias("__i"), entry.alias("__e"))
    return _fold_up(rows, [key], "__i", "__e", fan, levels).select(key, F.col("__d").alias("digest"))


def table_digest(rows: DataFrame, key: str, digest: str, buckets_hex: int = 3) -> DataFrame:
    """One digest for a table of keyed digests, independent of row order.

    Keys are spread over hash buckets; each bucket is sorted by key, then the
    buckets are combined in order.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    entry = F.concat_ws(":", h, F.col(digest))
    bucketed = rows.select(F.substring(h, 1, buckets_hex).alias("__b"), entry.alias("__e"))
    per = bucketed.groupBy("__b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__e")), "|"), 256).alias("__d"))
    parts = F.array_sort(F.collect_list(F.struct("__b", "__d")))
    return per.agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["__d"]), "|"), 256).alias("digest"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """Digest over the CSV form of manifest rows, keyed by split and user."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MANIFEST])
    rows = manifest.select(F.concat_ws("|", "split", F.col("user_id").cast("string")).alias("k"), F.sha2(line, 256).alias("d"))
    return table_digest(rows, "k", "d")


def sidecar_findings(recorded: DataFrame, recomputed: DataFrame, key: str = "user_id") -> DataFrame:
    """Side table accepted only where row count and digest agree per key."""
    r = recorded.select(key, F.col("digest").alias("__r"), F.col("rows").alias("__rn"))
    a = recomputed.select(key, F.col("digest").alias("__a"), F.col("rows").alias("__an"))
    bad = r.join(a, key, "full_outer").where(~(F.col("__r").eqNullSafe(F.col("__a")) & F.col("__rn").eqNullSafe(F.col("__an"))))
    return bad.select(F.lit(False).alias("ok"), F.lit("sidecar-mismatch").alias("code"), F.col(key).cast("string").alias("detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
