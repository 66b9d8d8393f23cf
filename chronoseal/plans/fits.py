"""Model queries. Scores of iterative fits have no SQL twin; their coverage and folds have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import audits as AU
from ..operators import models as MD
from ..operators import timeline as TL
from ..session import materialize
from .base import query, table
from .inputs import EVENT_LEXICON, MODEL_IDS, SCORES_SQL, event_totals, people, rounded, scores, timeline

SCALARS = ("evidence_score", "rel5_ratio", "rel7_ratio", "top10_avg_relevance", "fp_ratio", "neg_ratio")


def user_features(spark, sf_dir):
    """Users with events: label, fold, scalar features and a short vector block.

    Written once, because the fitting loops read it many times.
    """
    posts = timeline(spark, sf_dir)
    f = TL.timeline_features(posts, lexicon=EVENT_LEXICON, totals=event_totals(spark, sf_dir))
    flat = f.select(
        "user_id",
        "evidence.evidence_score",
        "evidence.rel5_ratio",
        "evidence.rel7_ratio",
        "evidence.top10_avg_relevance",
        "stylistic.fp_ratio",
        "stylistic.neg_ratio",
        F.array(*[F.col(f"temporal.{w}_{c}").cast("float") for w in ("final10", "final50", "final_third") for c in ("mean_relevance", "rel5_ratio", "rel7_ratio")]).alias("recent"),
    )
    label = F.when(F.col("balance") < 3000, F.lit("diagnosed")).otherwise(F.lit("control"))
    who = people(spark, sf_dir).select("user_id", label.alias("label"), "fold", "split", F.when(F.col("balance") < 4500, F.lit("diagnosed")).otherwise(F.lit("control")).alias("second_label"))
    return materialize(who.join(flat, "user_id"))


def _shown(df, *keys):
    return rounded(df.select(*keys, "score"), 4)


def _train(spark, sf_dir):
    return user_features(spark, sf_dir).where("split = 'train'")


LOGREG = MD.Candidate("logreg_pca", "logreg", ("recent",), SCALARS, pca=4)
# Rounds, trees, depths, units and epochs are the defaults of the operators, which are those of the reference.
TREES = MD.Candidate("trees", "trees", (), SCALARS)
BOOST = MD.Candidate("boost", "boost", (), SCALARS)
MLP = MD.Candidate("mlp", "mlp", (), SCALARS)
FOCAL = MD.Candidate("focal", "focal", ("recent",), SCALARS, pca=4)
NESTED_BASES = (LOGREG, BOOST, TREES, MLP)


@query("M1 M2 M10 J21")
def oof_logreg(spark, sf_dir):
    """PCA block, scaling and balanced logistic regression, out of fold."""
    return _shown(MD.oof_scores(_train(spark, sf_dir), LOGREG), "user_id", "label", "fold", "model_id")


@query("M13 K2")
def full_fit_scores(spark, sf_dir):
    """Fit on all train users, score label-free test users."""
    rows = user_features(spark, sf_dir)
    fitted = MD.fit_full(rows.where("split = 'train'"), LOGREG)
    return _shown(MD.score_test(fitted, rows.where("split = 'test'")), "user_id", "model_id")


@query("M14")
def paired_targets(spark, sf_dir):
    """Two label columns under the same folds and features."""
    return _shown(MD.paired_oof(_train(spark, sf_dir), LOGREG, ["label", "second_label"]), "user_id", "target", "label", "fold")


@query("M6 A24")
def fold_model_averages(spark, sf_dir):
    """Tree ensemble per fold, averaged over folds on test users."""
    rows = user_features(spark, sf_dir)
    return _shown(MD.fold_model_scores(rows.where("split = 'train'"), rows.where("split = 'test'"), TREES), "user_id", "model_id", "scored", "complete")


@query("M5")
def oof_boosted(spark, sf_dir):
    return _shown(MD.oof_scores(_train(spark, sf_dir), BOOST), "user_id", "label", "fold", "model_id")


@query("M7")
def oof_mlp(spark, sf_dir):
    return _shown(MD.oof_scores(_train(spark, sf_dir), MLP), "user_id", "label", "fold", "model_id")


@query("M8 F5")
def full_fit_focal(spark, sf_dir):
    """Focal linear model by distributed full-batch gradients."""
    rows = user_features(spark, sf_dir)
    fitted = MD.fit_full(rows.where("split = 'train'"), FOCAL)
    return _shown(MD.score_test(fitted, rows.where("split = 'test'")), "user_id", "model_id")


def _ternary_train(spark, sf_dir):
    rows = user_features(spark, sf_dir).where("split = 'train'")
    label = F.when((F.col("label") == "diagnosed") & (F.col("evidence_score") <= 0.3), F.lit("no-evidence")).otherwise(F.col("label"))
    return rows.withColumn("label", label)


def _ternary_shown(df):
    return rounded(df.select("user_id", "label", "fold", "prob_diagnosed", "prob_control", "prob_no_evidence", "model_id", "label_policy_id"), 4)


@query("M3 M10")
def oof_multinomial(spark, sf_dir):
    candidate = MD.Candidate("multinomial", "logreg", (), SCALARS)
    return _ternary_shown(MD.ternary_oof(_ternary_train(spark, sf_dir), candidate, "low_evidence"))


@query("M4")
def oof_hierarchical(spark, sf_dir):
    candidate = MD.Candidate("hierarchical", "hierarchical", (), SCALARS)
    return _ternary_shown(MD.ternary_oof(_ternary_train(spark, sf_dir), candidate, "low_evidence"))


_STACKED = ("m1_linear", "m2_boost", "m3_trees")


@query("M11 J4")
def oof_stack(spark, sf_dir):
    """Stacking on out-of-fold scores with the doubled class weights."""
    rows = materialize(scores(spark, sf_dir).where("split = 'train'"))
    return _shown(MD.stack_oof(rows, _STACKED, MD.Candidate("stack")), "user_id", "label", "fold", "model_id")


@query("M13 M11")
def stack_test_scores(spark, sf_dir):
    """Final stack fitted on all out-of-fold scores, applied to test scores."""
    s = materialize(scores(spark, sf_dir))
    test = s.where("split = 'test'").select("user_id", "score", "model_id")
    return _shown(MD.stack_test(s.where("split = 'train'"), test, _STACKED, MD.Candidate("stack")), "user_id", "model_id")


@query("M12 G13")
def nested_stack(spark, sf_dir):
    """Strict nested stacking over all folds and several bases; its provenance must pass the audit."""
    out, provenance = MD.nested_stack(_train(spark, sf_dir), NESTED_BASES, MD.Candidate("nested"))
    AU.require(AU.nested_fit_check(provenance), "nested stack")
    return _shown(out, "user_id", "label", "fold", "model_id")


@query("M10 G1", f"WITH {SCORES_SQL} SELECT true AS ok, 'oof-integrity' AS code, format('rows={{}} users={{}} models={{}}', count(*), count(DISTINCT user_id), count(DISTINCT model_id)) AS detail FROM scores WHERE split = 'train' AND model_id = 'm1_linear'")
def oof_stack_audit(spark, sf_dir):
    """Out-of-fold scores of a fitted stack pass the leakage audit: every train user once, in its own fold."""
    s = materialize(scores(spark, sf_dir))
    made = MD.stack_oof(s.where("split = 'train'"), MODEL_IDS[:2], MD.Candidate("stack"))
    return AU.audit_oof(people(spark, sf_dir), made, ["stack"])


def letter_encoder(texts: list[str]) -> np.ndarray:
    """Toy encoder: text length, spaces, letters e, and a constant."""
    return np.array([[len(t), t.count(" "), t.count("e"), 1.0] for t in texts], dtype=np.float32)


@query(
    "M15 P15 P16",
    """WITH t AS (SELECT conv_id AS user_id, turn AS tweet_index, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS b, length(text) - length(replace(text, 'e', '')) AS c FROM conversations
      WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')),
    n AS (SELECT *, sqrt(CAST(a * a + b * b + c * c AS DOUBLE)) AS m FROM t)
    SELECT user_id, tweet_index, round(CAST(CAST(a / m AS FLOAT) AS DOUBLE), 4) + 0e0 AS x, round(CAST(CAST(b / m AS FLOAT) AS DOUBLE), 4) + 0e0 AS y, round(CAST(CAST(c / m AS FLOAT) AS DOUBLE), 4) + 0e0 AS z FROM n""",
)
def encoded_posts(spark, sf_dir):
    """Batch encoder on the posts of users not yet written (users with a system turn count as written)."""
    c = table(spark, sf_dir, "conversations")
    posts = c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("tweet_index"), F.col("text").alias("tweet_text"))
    written = c.where("role = 'system'").select(F.col("conv_id").alias("user_id")).distinct()
    e = MD.encode_posts(MD.remaining_posts(posts, written), letter_encoder, 3)
    return rounded(e.select("user_id", "tweet_index", *[F.col("embedding")[i].alias(n) for i, n in enumerate("xyz")]), 4)
