"""Leakage audits and gates. Every audit returns findings rows ``ok, code, detail``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import vectors as V
from ..functions.hashing import row_hash
from ..functions.labels import NEGATIVE, POSITIVE, TERNARY, parse_boolean
from .alignment import agreement_check, disjoint_check, finding, or_pass, set_equality, union_findings

# Columns that must not, or must, occur in score and decision tables.
SCORE_FORBIDDEN = ("label", "actual", "predicted", "threshold", "tp", "fp", "tn", "fn", "macro_f1", "macroF1")
SCORE_REQUIRED = ("user_id", "score", "model_id")
TERNARY_FORBIDDEN = ("label", "actual", "predicted", "fold", "threshold", "macro_f1", "macroF1")
TERNARY_REQUIRED = ("user_id", "prob_diagnosed", "prob_control", "prob_no_evidence", "model_id", "label_policy_id")
DECISION_FORBIDDEN = ("label", "actual", "actual_label", "fold", "metric", "macro_f1", "macroF1", "diagnosedF1")
DECISION_REQUIRED = (
    "user_id",
    "base_decision",
    "llm_true_depression",
    "llm_confidence",
    "llm_reason",
    "prompt_hash",
    "request_hash",
    "cache_hit",
    "requested_model",
    "api_model",
    "label_policy_id",
    "lock_basename",
)


def static_findings(spark: SparkSession, rows: Iterable[tuple[bool, str, str]]) -> DataFrame:
    """Findings about schemas and settings, known without reading data."""
    return spark.createDataFrame(list(rows), "ok BOOLEAN, code STRING, detail STRING")


def column_findings(df: DataFrame, name: str, forbidden: Sequence[str], required: Sequence[str], prefix: str) -> DataFrame:
    present = df.columns
    rows = [(False, f"{prefix}-forbidden-column", f"{name}: forbidden column {c}") for c in present if c in set(forbidden)]
    rows += [(False, f"{prefix}-missing-column", f"{name}: missing {c}") for c in required if c not in present]
    return static_findings(df.sparkSession, rows)


def _explode_codes(rows: DataFrame, checks: Mapping[str, Column], detail: Column) -> DataFrame:
    """One finding per broken check and row, in a single pass."""
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return finding(rows.withColumn("__code", F.explode(codes)), F.col("__code"), detail)


def _oof_rows(manifest: DataFrame, scores: DataFrame) -> DataFrame:
    split_rows = manifest.groupBy("user_id").agg(
        F.max(F.col("split") == "test").alias("__test"),
        F.max(F.col("split") == "train").alias("__train"),
        F.max(F.when(F.col("split") == "train", F.col("label"))).alias("__label"),
        F.max(F.when(F.col("split") == "train", F.col("fold"))).alias("__fold"),
    )
    return scores.join(split_rows, "user_id", "left")


def or_counts(findings: DataFrame, code: str, rows: DataFrame, prefix: str = "") -> DataFrame:
    """The findings, or one passing row that states how many rows, users and models were checked."""
    models = F.count_distinct("model_id") if "model_id" in rows.columns else F.lit(0)
    users = F.count_distinct("user_id") if "user_id" in rows.columns else F.lit(0)
    counted = rows.agg(F.format_string(f"{prefix}rows=%d users=%d models=%d", F.count(F.lit(1)), users, models)).scalar()
    passed = findings.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return findings.unionByName(passed.select(F.lit(True).alias("ok"), F.lit(code).alias("code"), counted.alias("detail")))


def _missing_users(manifest: DataFrame, scores: DataFrame, models: Sequence[str], code: str) -> DataFrame:
    """Train users without a row from a model: expected pairs are generated beside each user."""
    train = manifest.where("split = 'train'").select("user_id").distinct()
    expected = train.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    missing = expected.join(scores.select("user_id", "model_id").distinct(), ["user_id", "model_id"], "left_anti")
    return finding(missing, code, F.format_string("%s: missing %s", F.col("model_id"), F.col("user_id").cast("string")))


def _duplicates(scores: DataFrame, code: str) -> DataFrame:
    """One finding per user and model that occurs more than once."""
    twice = scores.groupBy("model_id", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, code, F.format_string("%s: duplicate %s", F.col("model_id"), F.col("user_id").cast("string")))


def audit_oof(manifest: DataFrame, scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Out-of-fold scores against the manifest: test users, unknown users, label, fold, finiteness, duplicates, gaps."""
    rows = _oof_rows(manifest, scores)
    known = F.coalesce(F.col("__train"), F.lit(False))
    checks = {
        "oof-test-user": F.coalesce(F.col("__test"), F.lit(False)),
        "oof-unknown-user": ~known,
        "oof-label-mismatch": known & ~F.col("label").eqNullSafe(F.col("__label")),
        "oof-fold-mismatch": known & ~F.col("fold").eqNullSafe(F.col("__fold")),
        "oof-nonfinite-score": ~N.is_finite("score"),
    }
    detail = F.format_string("%s: %s", F.col("model_id"), F.col("user_id").cast("string"))
    parts = [_explode_codes(rows, checks, detail), _duplicates(scores, "oof-duplicate-user"), _missing_users(manifest, scores, models, "oof-missing-user")]
    return or_counts(union_findings(parts), "oof-integrity", scores)


def audit_ternary_oof(manifest: DataFrame, scores: DataFrame, models: Sequence[str], policy_id: str) -> DataFrame:
    """As :func:`audit_oof` with policy id and probability checks."""
    rows = _oof_rows(manifest, scores)
    known = F.coalesce(F.col("__train"), F.lit(False))
    checks = {
        "ternary-oof-test-user": F.coalesce(F.col("__test"), F.lit(False)),
        "ternary-oof-unknown-user": ~known,
        "ternary-oof-label-mismatch": known & ~F.col("label").eqNullSafe(F.col("__label")),
        "ternary-oof-fold-mismatch": known & ~F.col("fold").eqNullSafe(F.col("__fold")),
        "ternary-oof-policy-mismatch": ~F.col("label_policy_id").eqNullSafe(F.lit(policy_id)),
        "ternary-oof-invalid-probs": ~N.probabilities_valid("prob_diagnosed", "prob_control", "prob_no_evidence"),
    }
    detail = F.format_string("%s: %s", F.col("model_id"), F.col("user_id").cast("string"))
    parts = [
        _explode_codes(rows, checks, detail),
        _duplicates(scores, "ternary-oof-duplicate-user"),
        _missing_users(manifest, scores, models, "ternary-oof-missing-user"),
    ]
    return or_counts(union_findings(parts), "ternary-oof-integrity", scores, f"{policy_id}: ")


def audit_test_scores(scores: DataFrame, name: str) -> DataFrame:
    """Label-free test scores: column rules and finite scores."""
    found = column_findings(scores, name, SCORE_FORBIDDEN, SCORE_REQUIRED, "test-score")
    if "score" in scores.columns:
        bad = scores.where(~N.is_finite("score"))
        who = F.col("user_id").cast("string") if "user_id" in scores.columns else F.lit("?")
        found = found.unionByName(finding(bad, "test-score-nonfinite-score", F.concat(F.lit(f"{name}: "), who)))
    return or_counts(found, "test-score-schema", scores, f"{name}: ")


def audit_ternary_test_scores(scores: DataFrame, name: str) -> DataFrame:
    found = column_findings(scores, name, TERNARY_FORBIDDEN, TERNARY_REQUIRED, "ternary-test")
    if set(TERNARY_REQUIRED) <= set(scores.columns):
        bad = scores.where(~N.probabilities_valid("prob_diagnosed", "prob_control", "prob_no_evidence"))
        found = found.unionByName(finding(bad, "ternary-test-invalid-probs", F.concat(F.lit(f"{name}: "), F.col("user_id").cast("string"))))
    return or_counts(found, "ternary-test-score-schema", scores, f"{name}: ")


def audit_decisions(decisions: DataFrame, name: str) -> DataFrame:
    """Label-free override decisions: column rules, decision, boolean and confidence values."""
    found = column_findings(decisions, name, DECISION_FORBIDDEN, DECISION_REQUIRED, "llm-test")
    if set(DECISION_REQUIRED) <= set(decisions.columns):
        confidence = F.col("llm_confidence").try_cast("double")
        unreadable = ~F.coalesce(F.col("base_decision").isin(*TERNARY), F.lit(False)) | parse_boolean(F.col("llm_true_depression").cast("string")).isNull() | F.coalesce(F.trim(F.col("llm_confidence").cast("string")) == "", F.lit(True))
        checks = {
            "llm-test-invalid-row": unreadable,
            "llm-test-invalid-confidence": ~unreadable & ~(N.is_finite(confidence) & (confidence >= 0) & (confidence <= 1)),
        }
        found = found.unionByName(_explode_codes(decisions, checks, F.concat(F.lit(f"{name}: "), F.col("user_id").cast("string"))))
    return or_counts(found, "llm-test-decision-schema", decisions, f"{name}: ")


def audit_model_manifests(manifests: DataFrame, digest: Column | str, allowed_tables: Sequence[str], policy_hash: str | None = None) -> DataFrame:
    """Model manifests: ``path, manifest_hash, tables ARRAY, uses_test_labels, uses_test_scores, policy_hash``."""
    expected = F.lit(digest) if isinstance(digest, str) else digest
    allowed = F.array(*[F.lit(t) for t in allowed_tables]) if allowed_tables else F.array().cast("array<string>")
    foreign = F.array_except(F.coalesce(F.col("tables"), F.array().cast("array<string>")), allowed)
    checks = {
        "model-manifest-hash": ~F.col("manifest_hash").eqNullSafe(expected),
        "model-manifest-test-labels": F.coalesce(F.col("uses_test_labels"), F.lit(False)),
        "model-manifest-test-scores": F.coalesce(F.col("uses_test_scores"), F.lit(False)),
        "model-manifest-table": F.size(foreign) > 0,
    }
    if policy_hash is not None:
        checks["model-manifest-policy"] = ~F.col("policy_hash").eqNullSafe(F.lit(policy_hash))
    return or_pass(_explode_codes(manifests, checks, F.col("path")), "model-manifest", "model manifests OK")


def audit_redacted_manifest(redacted: DataFrame, dataset: str, lane: str, expected_rows: int | None = None) -> DataFrame:
    """Test manifest: label -1, blank fold, and a hash that reveals neither label."""
    test = redacted.where("split = 'test'")
    user = F.col("user_id")
    codes = [row_hash(dataset, lane, "test", F.lit(code), user) for code in ("0", "1")]
    names = [row_hash(dataset, "test", F.lit(label), user) for label in (POSITIVE, NEGATIVE)]
    checks = {
        "redacted-label": F.col("label").cast("string") != "-1",
        "redacted-fold": F.col("fold").isNotNull(),
        "redacted-hash-leak": F.col("row_hash").isin(*codes, *names),
    }
    found = _explode_codes(test, checks, user.cast("string"))
    if expected_rows is not None:
        n = test.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_rows)
        found = found.unionByName(finding(n, "redacted-row-count", F.format_string("expected=%d actual=%d", F.lit(expected_rows), "n")))
    return or_pass(found, "redacted-manifest", "test manifest carries no labels")


def audit_scores_exact(
    manifest: DataFrame,
    scores: DataFrame,
    model_id: str,
    columns: Sequence[str] = ("user_id", "label", "fold", "score", "model_id"),
) -> DataFrame:
    """Strict table audit: exact columns, one model id, scores in [0, 1], coverage, no test users."""
    spark = scores.sparkSession
    if sorted(scores.columns) != sorted(columns):
        return static_findings(spark, [(False, "score-columns", f"expected {sorted(columns)} got {sorted(scores.columns)}")])
    value = F.col("score").cast("double")
    checks = {
        "score-model-id": ~F.col("model_id").eqNullSafe(F.lit(model_id)),
        "score-range": ~(N.is_finite(value) & (value >= 0) & (value <= 1)),
    }
    rows = _explode_codes(scores, checks, F.col("user_id").cast("string"))
    integrity = audit_oof(manifest, scores, [model_id]).where("NOT ok")
    return or_pass(rows.unionByName(integrity), "score-audit", f"{model_id}: exact score table")


def audit_test_scores_exact(inference: DataFrame, scores: DataFrame, model_id: str) -> DataFrame:
    """Label-free table: exact columns, one model id, range, and exactly the inference users."""
    spark = scores.sparkSession
    if sorted(scores.columns) != sorted(SCORE_REQUIRED):
        return static_findings(spark, [(False, "score-columns", f"expected {sorted(SCORE_REQUIRED)} got {sorted(scores.columns)}")])
    value = F.col("score").cast("double")
    checks = {
        "score-model-id": ~F.col("model_id").eqNullSafe(F.lit(model_id)),
        "score-range": ~(N.is_finite(value) & (value >= 0) & (value <= 1)),
    }
    parts = [
        _explode_codes(scores, checks, F.col("user_id").cast("string")),
        _duplicates(scores, "score-duplicate-user"),
        set_equality(inference, scores, ["user_id"], "score-user-set").where("NOT ok"),
    ]
    return or_pass(union_findings(parts), "test-score-audit", f"{model_id}: label-free test scores")


def audit_lock(lock: DataFrame, models: Sequence[str], step: float, minimum: float) -> DataFrame:
    """Lock weights: exact model set, minimum, step alignment and sum 1. ``weights`` is a map."""
    values = F.map_values("weights")
    units = F.transform(values, lambda w: w / F.lit(step))
    checks = {
        "lock-model-set": F.array_sort(F.map_keys("weights")) != F.array_sort(F.array(*[F.lit(m) for m in models])),
        "lock-minimum": F.exists(values, lambda w: w < F.lit(minimum - 1e-9)),
        "lock-step": F.exists(units, lambda u: F.abs(u - F.round(u)) > F.lit(1e-6)),
        "lock-sum": F.abs(F.aggregate(values, F.lit(0.0), lambda a, w: a + w) - F.lit(1.0)) > F.lit(1e-6),
    }
    return or_pass(_explode_codes(lock, checks, F.to_json("weights")), "lock-weights", "lock weights are valid")


def audit_model_set(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Exactly the expected model ids, no more and no fewer."""
    found = scores.select("model_id").distinct()
    foreign = finding(found.where(~F.col("model_id").isin(*models)), "model-unexpected", F.col("model_id"))
    expected = F.array(*[F.lit(m) for m in models])
    absent = found.agg(F.collect_set("model_id").alias("s")).select(F.explode(F.array_except(expected, F.col("s"))).alias("m"))
    return or_pass(foreign.unionByName(finding(absent, "model-missing", F.col("m"))), "model-set", "model set is exact")


def forbidden_artifacts(files: DataFrame, patterns: Sequence[str], code: str = "artifact-premature") -> DataFrame:
    """Files that must not exist at this stage, by path pattern."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(p)
    return finding(files.where(hit), code, F.col("path"))


def nested_fit_check(records: DataFrame) -> DataFrame:
    """Nested fits: fit folds contain neither the outer nor the inner validation fold, and records exist."""
    bad = F.array_contains("fit_folds", F.col("outer_fold")) | F.array_contains("fit_folds", F.col("inner_validation_fold"))
    n = records.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("violations"))
    return finding(n, "nested-fit", F.format_string("records=%d violations=%d", "records", "violations"), (F.col("records") > 0) & (F.col("violations") == 0))


def audit_paired_arms(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both arms of a paired experiment share users and folds."""
    both = set_equality(first, second, ["user_id", "fold"], "paired-users-folds")
    return or_pass(both.where("NOT ok"), "paired-arms", "both arms share users and folds")


def source_contract(
    tables: Mapping[str, DataFrame | None],
    required: Mapping[str, Sequence[str]],
    vector_table: str | None = None,
    dim: int | None = None,
    embedding: str = "embedding",
) -> DataFrame:
    """Logical tables exist, carry their columns, and vectors have the stated dimension."""
    rows, spark = [], None
    for name, df in tables.items():
        rows.append((df is not None, f"table:{name}", name))
        if df is None:
            continue
        spark = df.sparkSession
        rows += [(c in df.columns, f"column:{name}.{c}", f"{name}.{c}") for c in required.get(name, ())]
    if spark is None:
        spark = SparkSession.getActiveSession()
    found = static_findings(spark, rows)
    if vector_table and tables.get(vector_table) is not None:
        wrong = tables[vector_table].agg(F.count_if(F.coalesce(F.size(embedding), F.lit(-1)) != dim).alias("n"))
        found = found.unionByName(finding(wrong, f"embedding-dim:{vector_table}", F.format_string("expected=%d wrong=%d", F.lit(dim), "n"), F.col("n") == 0))
    return found


def source_pair_contract(train: DataFrame, test: DataFrame, train_features: DataFrame, test_features: DataFrame) -> DataFrame:
    """Disjoint users and agreeing labels of the vector and feature tables."""
    return union_findings(
        [
            disjoint_check(train, test),
            agreement_check(train, train_features, "user_id", "label", "actual", "label-agreement:train"),
            agreement_check(test, test_features, "user_id", "label", "actual", "label-agreement:test"),
        ]
    )


def corpus_gate(corpus: DataFrame, expected: DataFrame, key: str = "user_id", texts: str = "texts", split: str = "split", label: str = "label") -> DataFrame:
    """Users and posts per split and label against an expected table, plus the list-of-text check.

    ``expected`` has ``split, label, users, posts``.
    """
    bad = corpus.where(F.col(texts).isNull() | (F.size(texts) == 0) | F.exists(texts, lambda t: t.isNull()))
    lists = finding(bad, "corpus-texts", F.col(key))
    actual = corpus.groupBy(split, label).agg(F.count(F.lit(1)).alias("__u"), F.sum(F.size(texts)).alias("__p"))
    joined = actual.join(expected, [split, label], "full_outer")
    off = joined.where(~(F.col("__u").eqNullSafe(F.col("users")) & F.col("__p").eqNullSafe(F.col("posts"))))
    counts = finding(off, "corpus-counts", F.concat_ws(":", split, label))
    twice = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return or_pass(union_findings([lists, counts, finding(twice, "corpus-duplicate-user", F.col(key))]), "corpus", "corpus matches its contract")


def provenance_check(record: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One-row provenance record against expected values."""
    checks = {f"provenance-{k}": ~F.col(k).cast("string").eqNullSafe(F.lit(str(v))) for k, v in expected.items()}
    return or_pass(_explode_codes(record, checks, F.lit("provenance")), "provenance", "provenance matches")


def input_findings(inputs: DataFrame, allowed: Sequence[str], dim: int, embedding: str = "embedding") -> DataFrame:
    """Sanitised inputs: exact column set and vector dimension."""
    extra = [(False, "input-column", c) for c in inputs.columns if c not in allowed]
    absent = [(False, "input-missing-column", c) for c in allowed if c not in inputs.columns]
    found = static_findings(inputs.sparkSession, extra + absent)
    if embedding in inputs.columns:
        checks = {"input-dimension": F.coalesce(F.size(embedding), F.lit(-1)) != dim, "input-nonfinite": ~V.all_finite(embedding)}
        found = found.unionByName(_explode_codes(inputs, checks, F.col("user_id").cast("string")))
    return or_pass(found, "inputs", "inputs are sanitised")


def require(findings: DataFrame, stage: str) -> None:
    """Stage gate: raise when a finding failed. Reads one count and a few examples."""
    failed = findings.where("NOT ok")
    examples = failed.limit(3).collect()
    if examples:
        raise RuntimeError(f"{stage}: " + "; ".join(f"{r['code']} {r['detail']}" for r in examples))


def require_lock(lock: DataFrame, recorded_hash: str | None = None) -> None:
    """Gate before test features or scores: exactly one lock row, unchanged when a hash is recorded."""
    rows = lock.limit(2).collect()
    if len(rows) != 1:
        raise RuntimeError(f"expected one lock, found {len(rows)}")
    if recorded_hash is not None and lock_hash(lock).first()["sha256"] != recorded_hash:
        raise RuntimeError("lock changed after it was recorded")


def lock_hash(lock: DataFrame) -> DataFrame:
    """SHA-256 of the lock row as JSON with columns in name order."""
    return lock.select(F.sha2(F.to_json(F.struct(*sorted(lock.columns))), 256).alias("sha256"))
