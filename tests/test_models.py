from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoseal.operators import audits as AU
from chronoseal.operators import models as MD
from chronoseal.plans import fits

from .conftest import rows


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(3)
    data = []
    for u in range(90):
        y = u % 3 == 0
        label = "diagnosed" if y else "control"
        data.append((f"u{u:02d}", label, u % 3 + 1 if u % 2 else (u // 3) % 3 + 1, rng.gauss(1.5 if y else 0, 1), float("nan") if u % 17 == 0 else rng.gauss(0, 1), [float(rng.gauss(1 if y else 0, 1)) for _ in range(6)], min(max(rng.gauss(0.6 if y else 0.3, 0.2), 0.0), 1.0)))
    return spark.createDataFrame(data, "user_id string, label string, fold int, x double, z double, v array<float>, evidence_score double").cache()


CANDIDATE = MD.Candidate("lr", "logreg", ("v",), ("x", "z"), pca=3)


def auc(scored):
    data = [(r["score"], r["label"] == "diagnosed") for r in scored.collect()]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_oof_covers_each_user_once_in_its_fold(spark, train):
    scores = MD.oof_scores(train, CANDIDATE)
    manifest = train.select("user_id", "label", "fold", F.lit("train").alias("split"))
    assert [r["code"] for r in AU.audit_oof(manifest, scores, ["lr"]).collect()] == ["oof-integrity"]
    assert auc(scores) > 0.8


def test_single_class_fallback(train):
    only = train.where("label = 'diagnosed'")
    fitted = MD.fit_full(only, CANDIDATE)
    assert {r["score"] for r in MD.score_test(fitted, train).collect()} == {1.0}


def test_test_scores_never_select_labels(train):
    fitted = MD.fit_full(train, CANDIDATE)
    scored = MD.score_test(fitted, train.drop("label"))
    assert scored.columns == ["user_id", "score", "model_id"] and scored.count() == 90


def test_baseline(train):
    got = MD.oof_scores(train, MD.Candidate("b", "baseline")).join(train.select("user_id", "evidence_score"), "user_id")
    assert got.where("score <> evidence_score").count() == 0


@pytest.mark.parametrize("outputs", [1, 3])
def test_focal_gradient_matches_differences(outputs):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(20, 3)), rng.uniform(0.5, 2, size=20)
    y = rng.integers(0, 2 if outputs == 1 else 3, size=20)
    params = rng.normal(size=(outputs, 4))

    def loss(p):
        z = x @ p[:, :-1].T + p[:, -1]
        if outputs == 1:
            ce = np.where(y > 0.5, np.logaddexp(0, -z[:, 0]), np.logaddexp(0, z[:, 0]))
            return float((w * (1 - np.exp(-ce)) ** 2 * ce).sum())
        soft = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        ce = -w * np.log(soft[np.arange(20), y])
        return float(((1 - np.exp(-ce)) ** 2 * ce).sum())

    grad = MD.focal_gradient(x, y.astype(float), w, params, 2.0)
    for i in range(outputs):
        for j in range(4):
            step = np.zeros_like(params)
            step[i, j] = 1e-6
            assert grad[i, j] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-6, rel=1e-4, abs=1e-6)


def test_focal_fit_learns(train):
    candidate = MD.Candidate("f", "focal", (), ("x",), params={"epochs": 15, "learning_rate": 0.05})
    scored = MD.fit_full(train, candidate).score(train)
    assert auc(scored) > 0.75


def test_ternary_models_give_valid_probabilities(train):
    three = train.withColumn("label", F.when((F.col("label") == "diagnosed") & (F.col("x") < 1), F.lit("no-evidence")).otherwise(F.col("label")))
    for family in ("hierarchical", "logreg"):
        out = MD.ternary_oof(three, MD.Candidate(family, family, (), ("x", "z")), "p")
        manifest = three.select("user_id", "label", "fold", F.lit("train").alias("split"))
        assert [r["code"] for r in AU.audit_ternary_oof(manifest, out, [family], "p").collect()] == ["ternary-oof-integrity"]


def test_nested_stack_provenance(train):
    scores, provenance = MD.nested_stack(train, [MD.Candidate("b", "logreg", (), ("x",))], MD.Candidate("meta"))
    assert AU.nested_fit_check(provenance).first()["ok"] and provenance.count() == 6
    assert scores.count() == 90 and auc(scores) > 0.7


def test_encoder_resume(spark):
    posts = spark.createDataFrame([("a", 0, "xx"), ("b", 0, "  "), ("b", 1, "yyy")], "user_id string, tweet_index int, tweet_text string")
    written = spark.createDataFrame([("a",)], "user_id string")
    out = MD.encode_posts(MD.remaining_posts(posts, written), lambda texts: np.array([[3.0 * len(t), 4.0 * len(t), 9.0] for t in texts]), 2, batch=1)
    got = rows(out, "user_id", "tweet_index", F.round(F.col("embedding")[0], 4), F.round(F.col("embedding")[1], 4))
    assert [g[:2] for g in got] == [("b", 0), ("b", 1)]
    assert all(g[2:] == pytest.approx((0.6, 0.8)) for g in got)


def test_registered_fits_use_full_settings(spark, monkeypatch):
    used = {}

    def keep(name):
        def call(*args, **_):
            used[name] = args
            raise StopIteration

        monkeypatch.setattr(MD, name, call)

    for name in ("oof_scores", "fold_model_scores", "fit_full", "nested_stack"):
        keep(name)
    data = spark.createDataFrame([(fold, "train") for fold in range(1, 6)], "fold int, split string")
    monkeypatch.setattr(fits, "user_features", lambda *_: data)
    tuned = {}
    for query, name, at in ((fits.oof_boosted, "oof_scores", 1), (fits.oof_mlp, "oof_scores", 1), (fits.fold_model_averages, "fold_model_scores", 2), (fits.full_fit_focal, "fit_full", 1), (fits.nested_stack, "nested_stack", 1)):
        with pytest.raises(StopIteration):
            query(spark, "")
        tuned[query.__name__] = used[name][at]
    boost, mlp, trees = (MD.estimator(tuned[n], 100, 6) for n in ("oof_boosted", "oof_mlp", "fold_model_averages"))
    assert (boost.getMaxIter(), boost.getMaxDepth()) == (250, 3)
    assert (mlp.getMaxIter(), mlp.getLayers()) == (500, [6, 32, 2])
    assert (trees.getNumTrees(), trees.getMaxDepth(), trees.getMinInstancesPerNode()) == (400, 5, 10)
    assert tuned["full_fit_focal"].params.get("epochs", 250) == 250
    bases = tuned["nested_stack"]
    assert len(bases) > 1 and all(set(b.scalars) == set(fits.SCALARS) and not b.params for b in bases)
    assert {r.fold for r in used["nested_stack"][0].select("fold").distinct().collect()} == {1, 2, 3, 4, 5}
