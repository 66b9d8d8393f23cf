"""Joins with a contract: alignment, disjointness, agreement, set and table equality.

A broken contract becomes findings rows (``ok, code, detail``); nothing is dropped in silence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

FINDING = "ok BOOLEAN, code STRING, detail STRING"


def finding(rows: DataFrame, code: str | Column, detail: Column, ok: Column | bool = False) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    flag = F.lit(ok) if isinstance(ok, bool) else ok
    return rows.select(flag.alias("ok"), code.alias("code"), detail.cast("string").alias("detail"))


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def or_pass(findings: DataFrame, code: str, detail: str) -> DataFrame:
    """The findings, or one passing row when there are none."""
    passed = findings.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return findings.unionByName(passed.select(F.lit(True).alias("ok"), F.lit(code).alias("code"), F.lit(detail).alias("detail")))


def report_ok(findings: DataFrame) -> DataFrame:
    """One row: overall verdict and number of failures."""
    return findings.agg(F.coalesce(F.every("ok"), F.lit(True)).alias("ok"), F.count_if(~F.col("ok")).alias("failures"))


def join_labelled(vectors: DataFrame, features: DataFrame, key: str = "user_id", label: str = "label", actual: str = "actual") -> DataFrame:
    """Vector rows with features of the same user whose label text agrees without regard to case."""
    f = features.withColumnRenamed(actual, "__actual")
    joined = vectors.join(f, key).where(F.lower(F.col(label).cast("string")) == F.lower(F.col("__actual").cast("string")))
    return joined.drop("__actual")


def missing_keys(left: DataFrame, right: DataFrame, key: str = "user_id", code: str = "missing-user") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return finding(left.select(key).join(right.select(key), key, "left_anti").distinct(), code, F.col(key))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("user_id",), code: str = "duplicate-user") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, code, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def align_to_manifest(manifest: DataFrame, features: DataFrame, key: str = "user_id", fill_dim: int | None = None, embedding: str = "embedding") -> DataFrame:
    """Manifest rows with their features, one row per user of the manifest.

    A user without features fails the job (:func:`missing_keys` lists all of them first), unless ``fill_dim`` asks for a
    zero vector in place of the missing one.
    """
    if fill_dim is None:
        return _matched(manifest, features, key, "features")
    joined = manifest.join(features, key, "left")
    return joined.withColumn(embedding, V.impute_zero(embedding, fill_dim))


def assemble_blocks(manifest: DataFrame, blocks: Sequence[DataFrame], key: str = "user_id") -> DataFrame:
    """Only the requested feature tables, joined per user. All share one partitioning by the key.

    A user of the manifest that a block lacks fails the job: leaving it out would change every later count.
    """
    return reduce(lambda left, block: _matched(left, block[1], key, f"block {block[0]}"), enumerate(blocks, 1), manifest)


def _matched(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Left join whose rows all find a partner, or the job fails and names a user without one."""
    joined = left.join(right.withColumn("__found", F.lit(True)), key, "left")
    message = F.concat(F.lit(f"missing-user: {what} lacks "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    # The checked column is the key itself, which no reader of the rows can leave out unnoticed.
    checked = F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(message).cast(left.schema[key].dataType))
    return joined.withColumn(key, checked).drop("__found")


def disjoint_check(left: DataFrame, right: DataFrame, key: str = "user_id", name: str = "train-test-user-disjoint") -> DataFrame:
    """One finding with the number of shared keys."""
    overlap = left.select(key).join(right.select(key), key, "left_semi").agg(F.count_distinct(key).alias("n"))
    return finding(overlap, name, F.format_string("overlap=%d", "n"), F.col("n") == 0)


def agreement_check(left: DataFrame, right: DataFrame, key: str, left_label: str, right_label: str, name: str) -> DataFrame:
    """One finding with the number of joined rows whose labels differ."""
    a = left.select(key, F.lower(F.col(left_label).cast("string")).alias("__a"))
    b = right.select(key, F.lower(F.col(right_label).cast("string")).alias("__b"))
    n = a.join(b, key).agg(F.count_if(F.col("__a") != F.col("__b")).alias("n"))
    return finding(n, name, F.format_string("mismatches=%d", "n"), F.col("n") == 0)


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only left and only right, counted as multisets (``exceptAll`` both ways in one shuffle)."""
    names = left.columns
    both = left.select(*names, F.lit(1).alias("__d")).unionByName(right.select(*names, F.lit(-1).alias("__d")))
    net = both.groupBy(*names).agg(F.sum("__d").alias("__d"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("only_left"),
        F.coalesce(-F.sum(F.when(F.col("__d") < 0, F.col("__d"))), F.lit(0)).alias("only_right"),
    )


def set_equality(left: DataFrame, right: DataFrame, keys: Sequence[str], code: str = "set-equal") -> DataFrame:
    counts = difference_counts(left.select(*keys).distinct(), right.select(*keys).distinct())
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    return finding(counts, code, F.format_string("only_left=%d only_right=%d", "only_left", "only_right"), ok)


def table_equality(left: DataFrame, right: DataFrame, columns: Sequence[str], code: str = "columns-unchanged") -> DataFrame:
    counts = difference_counts(left.select(*columns), right.select(*columns))
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    return finding(counts, code, F.format_string("only_left=%d only_right=%d", "only_left", "only_right"), ok)


def exact_partition(whole: DataFrame, first: DataFrame, second: DataFrame, key: str = "user_id", code: str = "exact-partition") -> DataFrame:
    """``first`` and ``second`` cover ``whole`` without overlap; one aggregate over tagged keys."""
    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.lit(name).alias("__side")).distinct()

    tagged = tag(whole, "w").unionByName(tag(first, "a")).unionByName(tag(second, "b"))
    per = tagged.groupBy(key).agg(*[F.max(F.col("__side") == s).alias(s) for s in ("w", "a", "b")])
    bad = per.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("w") & ~F.col("a") & ~F.col("b")).alias("uncovered"),
        F.count_if(~F.col("w")).alias("foreign"),
    )
    ok = (F.col("both") == 0) & (F.col("uncovered") == 0) & (F.col("foreign") == 0)
    return finding(bad, code, F.format_string("both=%d uncovered=%d foreign=%d", "both", "uncovered", "foreign"), ok)


def alignment_findings(scores: DataFrame, models: Sequence[str], keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Users without exactly one score per model, or with label or fold differing between models."""
    wanted = scores.where(F.col("model_id").isin(*models))
    seen = [f"__m{i}" for i in range(len(models))]
    # Counted by label and fold first, so that a row per user, not per score and distinct count, is sorted.
    first = wanted.groupBy(*keys, "label", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col("model_id") == m).alias(c) for m, c in zip(models, seen)])
    per = first.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.min("label") != F.max("label")).alias("labels"),
        (F.min("fold") != F.max("fold")).alias("folds"),
        reduce(lambda a, b: a & b, [F.max(c) for c in seen]).alias("__all"),
    )
    code = (
        F.when(~F.col("__all"), F.lit("align-missing-score"))
        .when(F.col("n") > len(models), F.lit("align-duplicate-score"))
        .when(F.col("labels"), F.lit("align-label-mismatch"))
        .when(F.col("folds"), F.lit("align-fold-mismatch"))
    )
    return finding(per.withColumn("__code", code).where("__code IS NOT NULL"), F.col("__code"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def wanted_rows(posts: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Posts of the wanted users. Spark broadcasts the list when its size allows, else shuffles."""
    return posts.join(users.select(key), key, "left_semi")


def flagged_users(tables: Sequence[DataFrame], key: str = "user_id") -> DataFrame:
    """Distinct users over several score tables."""
    return reduce(DataFrame.unionByName, [t.select(key) for t in tables]).distinct()


def shard_assignment(users: DataFrame, shards: DataFrame, position: str = "position", start: str = "start", end: str = "end") -> DataFrame:
    """Shard of each user position in ``[start, end)``; a user outside all ranges has no row (see :func:`missing_keys`).

    Shard ranges are cut into fixed blocks, so the range test becomes an equality
    join on the block and a filter, with no nested loop.
    """
    block = 64
    cut = F.sequence(F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block))
    blocks = shards.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(cut))
    placed = users.withColumn("__b", F.floor(F.col(position) / block)).join(blocks, "__b")
    return placed.where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("__b")


def sealed_join(scores: DataFrame, sealed: DataFrame, key: str = "user_id") -> DataFrame:
    """Scores with their sealed labels. Check :func:`set_equality` on the users first."""
    return scores.join(sealed, key)


def second_labels(first: DataFrame, second: DataFrame, key: str = "user_id") -> DataFrame:
    """Both annotators' labels per user."""
    return first.join(second, key)


def attach_predictions(corpus: DataFrame, predictions: DataFrame, column: str = "prediction", key: str = "user_id", split: str = "split") -> DataFrame:
    """Corpus with one nullable prediction column, NULL on train rows."""
    p = predictions.select(key, F.col(column).alias("__p"))
    joined = corpus.join(p, key, "left")
    return joined.withColumn(column, F.when(F.col(split) == "test", F.col("__p"))).drop("__p")


def prediction_findings(derived: DataFrame, column: str = "prediction", split: str = "split", key: str = "user_id") -> DataFrame:
    train = derived.where((F.col(split) == "train") & F.col(column).isNotNull())
    test = derived.where((F.col(split) == "test") & F.col(column).isNull())
    return finding(train, "prediction-on-train", F.col(key)).unionByName(finding(test, "prediction-missing", F.col(key)))


def hash_chain(recorded: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Recorded against recomputed size and digest per artifact."""
    r = recorded.select(key, F.col("sha256").alias("__r"), F.col("size").alias("__rs"))
    a = actual.select(key, F.col("sha256").alias("__a"), F.col("size").alias("__as"))
    code = (
        F.when(F.col("__a").isNull(), F.lit("artifact-missing"))
        .when(F.col("__r").isNull(), F.lit("artifact-unrecorded"))
        .when(F.col("__rs") != F.col("__as"), F.lit("artifact-size"))
        .when(F.col("__r") != F.col("__a"), F.lit("artifact-sha256"))
    )
    joined = r.join(a, key, "full_outer").withColumn("__code", code)
    return finding(joined.where("__code IS NOT NULL"), F.col("__code"), F.col(key))


def fold_train(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def fold_validation(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def policy_labels_for(sealed: DataFrame, markers: DataFrame, policies: Sequence, cutoffs: dict | None = None, key: str = "user_id") -> DataFrame:
    """Every policy's label for every sealed user; policies are configuration and expand beside the row."""
    from .splits import label_per_policy

    return label_per_policy(sealed.join(markers, key), policies, cutoffs or {})
