"""Models of all left-out folds from the same scans, against direct fits on the rows they may see."""

from __future__ import annotations

import numpy as np
import pytest

from chronoseal.operators import audits as AU
from chronoseal.operators import fold_fits as FF
from chronoseal.operators import models as MD

FOLDS = 4


def made(seed=3, n=240):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.8 * x[:, 1] * x[:, 2] + 0.4 * rng.normal(size=n) > 0.2).astype(float)
    return x, y, np.arange(n) % FOLDS + 1


def frame(spark, x, y, fold):
    rows = [(f"u{i}", "diagnosed" if y[i] else "control", int(fold[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "user_id string, label string, fold int, a double, b double, c double, d double").repartition(3)


def packed(spark, x, y, fold):
    return FF.pack(frame(spark, x, y, fold), "diagnosed", ["a", "b", "c", "d"])


@pytest.fixture(scope="module")
def data(spark):
    x, y, fold = made()
    blocks = packed(spark, x, y, fold)
    return x, y, fold, blocks, FF.Exclusions([(1,), (2, 3)], FF.fold_counts(blocks))


def auc(y, score):
    pos, neg = score[y == 1], score[y == 0]
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


def whole(blocks):
    """All rows as one block, in the order of their keys."""
    held = blocks.collect()
    order = np.argsort([int(k[1:]) for b in held for k in b.keys])
    stack = lambda name: np.concatenate([getattr(b, name) for b in held])[order]
    return FF.Block([], stack("fold"), stack("y"), stack("h"), stack("x"), stack("bins"))


def test_moments_of_a_model_are_the_total_without_its_folds(data):
    x, _, fold, blocks, _ = data
    per_fold = FF.moments(blocks)
    a, b = FF.standardised(per_fold, (2, 3), (0, 3), (((1, 2), 1),))
    kept = x[(fold != 2) & (fold != 3)]
    values, vectors = np.linalg.eigh(np.cov(kept[:, 1:3].T))
    first = (kept[:, 1:3] - kept[:, 1:3].mean(axis=0)) @ vectors[:, values.argmax()]
    z = kept @ a + b
    assert np.allclose(np.abs(z[:, 0]), np.abs(first / first.std(ddof=1)))
    assert np.allclose(z[:, 1:], (kept[:, [0, 3]] - kept[:, [0, 3]].mean(axis=0)) / kept[:, [0, 3]].std(axis=0, ddof=1))


def test_linear_fit_has_a_zero_gradient_on_its_rows(data):
    x, y, fold, blocks, ex = data
    per_fold = FF.moments(blocks)
    maps = [FF.standardised(per_fold, s, (0, 1, 2, 3)) for s in ex.sets]
    model = FF.fit_linear(blocks, ex, maps, c=0.5)
    for m, left_out in enumerate(ex.sets):
        kept = ~np.isin(fold, left_out)
        z, t = x[kept] @ maps[m][0] + maps[m][1], y[kept]
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
        p = FF.sigmoid(z @ model.beta[m][:-1] + model.beta[m][-1])
        slope = z.T @ (w * (p - t)) / w.sum() + model.beta[m][:-1] / (0.5 * len(t))
        assert np.abs(slope).max() < 1e-7 and abs((w * (p - t)).sum() / w.sum()) < 1e-7


FITS = {
    "boost": lambda b, ex: FF.fit_boosted(b, ex, rounds=60, seed=5),
    "trees": lambda b, ex: FF.fit_forest(b, ex, trees=60, min_leaf=3, seed=5),
    "mlp": lambda b, ex: FF.fit_perceptron(b, ex, [FF.standardised(FF.moments(b), s, (0, 1, 2, 3)) for s in ex.sets], steps=150, seed=5),
}


@pytest.mark.parametrize("family", FITS)
def test_left_out_folds_are_never_seen_and_blocks_do_not_matter(spark, data, family, monkeypatch):
    x, y, fold, blocks, ex = data
    model = FITS[family](blocks, ex)
    block = whole(blocks)
    for m, left_out in enumerate(ex.sets):
        rows = np.isin(fold, left_out)
        assert auc(y[rows], model.score(m, block)[rows]) > 0.8
    # Other labels in the left-out folds, other blocks and stores: the same models.
    monkeypatch.setattr(FF, "BLOCK_ROWS", 17)
    monkeypatch.setattr(FF, "KEPT_ROUNDS", 7)
    monkeypatch.setattr(FF, "FOREST_BATCH", 23)
    turned = np.where(np.isin(fold, (2, 3)), 1 - y, y)
    other = packed(spark, x, turned, fold).repartition(5)
    again = FITS[family](other, FF.Exclusions(ex.sets, FF.fold_counts(other)))
    assert np.allclose(again.score(1, block), model.score(1, block), atol=1e-9)


def test_boosting_equals_a_plain_loop(data):
    """One round on the rows of one model, with every feature and row."""
    x, y, fold, blocks, ex = data
    model = FF.fit_boosted(blocks, ex, rounds=1, depth=1, subsample=1.0, columns=1.0, rate=1.0)
    block, tree = whole(blocks), model.trees[1][0]
    kept = ~np.isin(fold, (2, 3))
    bins, t = block.bins[kept], y[kept]
    w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
    g, h = w * (0.5 - t), w * 0.25
    best = (-np.inf,)
    for f in range(4):
        for cut in range(FF.BINS):
            left = bins[:, f] <= cut
            if 2 <= left.sum() <= len(t) - 2:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
                best = max(best, (gain, -g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)))
    assert np.allclose(tree.value, best[1:])


def test_one_class_gives_a_constant(spark):
    x, _, fold = made(n=40)
    y = (fold == 1).astype(float)
    blocks = packed(spark, x, y, fold)
    scores, records = FF.nested_scores(spark, blocks, [FF.Base("b", "boost", (0, 1), params={"rounds": 3}), FF.Base("l", "logreg", (0,))])
    got = scores.collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got) and len(records) == 4 * 3 * 2


def test_nested_stack_with_several_bases(spark):
    x, y, fold = made()
    train = frame(spark, x, y, fold)
    features = ("a", "b", "c", "d")
    bases = [MD.Candidate("l", "logreg", (), features), MD.Candidate("g", "boost", (), features, params={"rounds": 40}), MD.Candidate("t", "trees", (), features, params={"trees": 40, "min_leaf": 3})]
    scores, provenance = MD.nested_stack(train, bases, MD.Candidate("meta"))
    got = {r.user_id: r for r in scores.collect()}
    assert len(got) == scores.count() == 240 and all(got[f"u{i}"].fold == fold[i] and got[f"u{i}"].label == ("diagnosed" if y[i] else "control") for i in range(240))
    assert AU.nested_fit_check(provenance).first()["ok"] and provenance.count() == 4 * 3 * 3
    assert auc(y, np.array([got[f"u{i}"].score for i in range(240)])) > 0.8
    with pytest.raises(ValueError):
        MD.nested_stack(train.selectExpr("*", "array(a, b) AS v"), [MD.Candidate("g", "boost", ("v",), ("a",))], MD.Candidate("meta"))


def test_tree_steps_carry_bins_and_stores_add_new_rounds_only(data, monkeypatch):
    _, _, _, blocks, ex = data
    narrow = FF._restricted(blocks.first(), (0, 2))
    assert narrow.keys == [] and narrow.x.size == 0 and narrow.bins.shape == (len(narrow.fold), 2)
    monkeypatch.setattr(FF, "KEPT_ROUNDS", 5)
    added, store = [], FF._with_margins
    monkeypatch.setattr(FF, "_with_margins", lambda held, model: added.append(len(model.trees[0])) or store(held, model))
    model = FF.fit_boosted(blocks, ex, rounds=17, seed=5)
    assert added == [5, 5, 5] and len(model.trees[0]) == 17
