from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoseal.functions.labels import TERNARY, DecisionRule, LabelPolicy
from chronoseal.operators import bootstrap as B
from chronoseal.operators import metrics as M
from chronoseal.operators import selection as S
from chronoseal.operators import splits as SP
from chronoseal.operators import sweep as SW
from chronoseal.operators.quantiles import quantiles

from .conftest import rows


def binary(tp, fp, tn, fn):
    div = lambda a, b: a / b if b else 0.0
    p, r, q, s = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    d, c = div(2 * p * r, p + r), div(2 * q * s, q + s)
    return {"macro_f1": (d + c) / 2, "diagnosed_f1": d, "precision": p, "recall": r}


def brute_sweep(pairs, mode):
    scores = sorted({s for s, _ in pairs})
    if mode == "gt":
        cuts = [(-SW.EPSILON, lambda s, t: s > t)] + [(v, lambda s, t: s > t) for v in scores]
        keys, digits = M.THRESHOLD_ORDER, 12
    elif mode == "ge_mid":
        values = {-SW.EPSILON, 1 + SW.EPSILON, *scores, *[(a + b) / 2 for a, b in zip(scores, scores[1:])]}
        cuts = [(v, lambda s, t: s >= t) for v in sorted(values)]
        keys, digits = M.THRESHOLD_ORDER, 15
    else:
        cuts = [(v, lambda s, t: s >= t) for v in [*scores, float(np.nextafter(scores[-1], np.inf))]]
        keys, digits = M.SELECTION_ORDER, 15
    best = None
    for t, above in cuts:
        tp = sum(above(s, t) and y for s, y in pairs)
        fp = sum(above(s, t) and not y for s, y in pairs)
        fn = sum(y for _, y in pairs) - tp
        m = binary(tp, fp, len(pairs) - tp - fp - fn, fn)
        key = tuple(round(m[k], digits) for k in keys)
        if best is None or key > best[0]:
            best = (key, t)
    return best[1]


@pytest.mark.parametrize("mode", SW.MODES)
def test_sweeps_equal_brute_force(spark, mode):
    rng = random.Random(7)
    data, want = [], {}
    for model in range(12):
        pairs = []
        for _ in range(rng.randrange(2, 60)):
            y = rng.random() < 0.4
            pairs.append((rng.choice([0.0, 1.0, round(rng.random(), rng.choice([1, 2, 6]))]), y))
        data += [(f"m{model}", s, "diagnosed" if y else "control") for s, y in pairs]
        want[f"m{model}"] = brute_sweep(pairs, mode)
    df = spark.createDataFrame(data, "model_id string, score double, label string")
    order, digits = (M.SELECTION_ORDER, None) if mode == "ge" else (M.THRESHOLD_ORDER, 12 if mode == "gt" else None)
    for bins in (4, 1024):
        got = {r["model_id"]: r["threshold"] for r in SW.best_threshold(df, ["model_id"], mode, order, digits, bins=bins).collect()}
        assert got == pytest.approx(want, abs=1e-15)


def test_perfect_split_golden(spark):
    df = spark.createDataFrame([("m", s, y) for s, y in [(0.1, "control"), (0.4, "control"), (0.6, "diagnosed"), (0.9, "diagnosed")]], "model_id string, score double, label string")
    best = SW.best_threshold(df, ["model_id"], "ge_mid", digits=None).first()
    assert best["macro_f1"] == 1.0 and best["threshold"] == pytest.approx(0.5)


def test_next_up(spark):
    values = [0.0, 0.1, 0.5, 0.75, 0.9999999, 1.0, 1.5, 1.9999, 3.7e-5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(SW.next_up(F.col("v"))).collect()] == [float(np.nextafter(v, np.inf)) for v in values]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(x)) for x in rng.normal(size=101)] + [("b", 1.0)] * 5 + [("c", float(x)) for x in (1, 2)]
    df = spark.createDataFrame(data, "k string, v double")
    qs = [0.0, 0.025, 0.3, 0.5, 1.0]
    for bins in (3, 4096):
        got = {(r["k"], r["q"]): r["value"] for r in quantiles(df, ["k"], "v", qs, bins).collect()}
        for key in "abc":
            for q in qs:
                assert got[key, q] == pytest.approx(np.quantile([v for k, v in data if k == key], q), abs=1e-12)
    assert {r["value"] for r in quantiles(df.where("k = 'c'"), [], "v", [0.5]).collect()} == {1.5}
    with pytest.raises(ValueError):
        quantiles(df, ["k"], "v", [1.5])


def test_ternary_golden(spark):
    df = spark.createDataFrame([("diagnosed", "diagnosed"), ("control", "no-evidence"), ("no-evidence", "no-evidence")], "label string, predicted string")
    m = M.ternary_metrics(df).first()
    assert m["macro_f1"] == pytest.approx(5 / 9) and m["no_evidence_f1"] == pytest.approx(2 / 3)


def test_policy_cutoffs_golden(spark):
    def marked(rows_):
        return spark.createDataFrame(rows_, "binary_label string, evidence_score double")

    mixed = marked([("diagnosed", v) for v in (0.1, 0.3, 0.9)] + [("control", 0.8)])
    one = SP.policy_cutoffs(mixed, [LabelPolicy("q", "evidence_quantile", quantile=0.5)]).collect()
    assert [(r["policy_id"], r["binary_label"], r["cutoff"]) for r in one] == [("q", None, pytest.approx(0.3))]
    both = marked([("diagnosed", v) for v in (0.1, 0.5, 0.9)] + [("control", v) for v in (0.2, 0.4, 0.8)])
    two = SP.policy_cutoffs(both, [LabelPolicy("q", "evidence_quantile", quantile=0.5, applies_to="both_classes")]).collect()
    assert {r["binary_label"]: r["cutoff"] for r in two} == pytest.approx({"diagnosed": 0.5, "control": 0.4})


def test_policies_never_change_controls_unless_asked(spark):
    df = spark.createDataFrame([("control", 0, 0.0, 0.0, 0.0), ("diagnosed", 0, 0.0, 0.0, 0.0)], "binary_label string, rel3_count long, rel3_ratio double, top10_avg_relevance double, evidence_score double")
    policies = [LabelPolicy("a", "rel_count_zero"), LabelPolicy("b", "low_density"), LabelPolicy("c", "top10_avg_lt"), LabelPolicy("d", "evidence_quantile"), LabelPolicy("e", "low_density", applies_to="both_classes")]
    got = rows(SP.label_per_policy(df, policies, {("d", None): 0.0}), "label_policy_id", "binary_label", "label")
    assert {g for g in got if g[1] == "control" and g[2] == "no-evidence"} == {("e", "control", "no-evidence")}
    assert {g[0] for g in got if g[1] == "diagnosed" and g[2] == "no-evidence"} == set("abcde")


def test_stratified_folds(spark):
    users = spark.createDataFrame([(f"u{i}", "diagnosed" if i < 10 else "control") for i in range(40)], "user_id string, label string")
    folds = SP.stratified_folds(users, 5, 42)
    counts = {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()}
    assert counts == {**{("diagnosed", f): 2 for f in range(1, 6)}, **{("control", f): 6 for f in range(1, 6)}}
    assert rows(folds) == rows(SP.stratified_folds(users.repartition(3), 5, 42))
    assert rows(folds) != rows(SP.stratified_folds(users, 5, 43))


def score_rows(models, users=24, seed=1):
    rng = random.Random(seed)
    labels = ["diagnosed" if rng.random() < 0.4 else "control" for _ in range(users)]
    return [(f"u{u:02d}", labels[u], u % 5 + 1, m, round(min(max(rng.gauss(0.6 if labels[u] == "diagnosed" else 0.4, 0.2), 0.0), 1.0), 4)) for u in range(users) for m in models]


SCORES = "user_id string, label string, fold int, model_id string, score double"


@pytest.mark.parametrize("exact", [False, True])
def test_grid_selection_equals_brute_force(spark, exact):
    models = ["a", "b", "c"]
    data = score_rows(models)
    users = sorted({r[0] for r in data})
    value = {(r[0], r[3]): r[4] for r in data}
    label = {r[0]: r[1] == "diagnosed" for r in data}
    best = None
    for units in itertools.product(range(5), repeat=3):
        if sum(units) != 4:
            continue
        pairs = [(0.0 + sum(value[u, m] * (k / 4) for m, k in zip(models, units)), label[u]) for u in users]
        t = brute_sweep(pairs, "ge" if exact else "gt")
        hit = [s >= t if exact else s > t for s, _ in pairs]
        tp = sum(h and y for h, (_, y) in zip(hit, pairs))
        fp = sum(h and not y for h, (_, y) in zip(hit, pairs))
        fn = sum(y for _, y in pairs) - tp
        m = binary(tp, fp, len(pairs) - tp - fp - fn, fn)
        key = tuple(round(m[k], 15 if exact else 12) for k in M.SELECTION_ORDER) + ((-t,) if exact else ())
        if best is None or key > best[0]:
            best = (key, units, t)
    df = spark.createDataFrame(data, SCORES)
    lock = S.select_weights(S.align_scores(df, models), models, 0.25, mode="ge" if exact else "gt", exact_ties=exact, bins=8).first()
    assert tuple(round(lock[f"w_{m}"] * 4) for m in models) == best[1]
    assert lock["threshold"] == pytest.approx(best[2], abs=1e-12)
    assert sum(lock["weights"].values()) == pytest.approx(1.0, abs=1e-5)


def test_fixed_set_weights(spark):
    models = list("abcde")
    df = spark.createDataFrame(score_rows(models, 20), SCORES)
    lock = S.select_weights(S.align_scores(df, models), models, 0.05, 0.15, mode="ge", exact_ties=True).first()
    weights = [lock[f"w_{m}"] for m in models]
    assert min(weights) >= 0.15 - 1e-9 and sum(weights) == pytest.approx(1)
    assert all(abs(w / 0.05 - round(w / 0.05)) < 1e-6 for w in weights)
    with pytest.raises(ValueError, match="infeasible"):
        S.simplex(5, 20, 5)


def test_many_models_use_ranked_prefixes(spark):
    models = [f"m{i}" for i in range(8)]
    lock = S.select_ensemble(spark.createDataFrame(score_rows(models, 12), SCORES), models, 0.25, "ranked-prefix", max_models=3).first()
    assert lock["strategy"].startswith("ranked-prefix-pruned") and 1 <= len(lock["weights"]) <= 3
    assert all(w > 0 for w in lock["weights"].values())


def test_refinement_golden(spark):
    probs = [
        ("a1", "diagnosed", (0.9, 0.1, 0.0), (0.3, 0.7, 0.0)),
        ("a2", "diagnosed", (0.1, 0.9, 0.0), (0.65, 0.35, 0.0)),
        ("a3", "control", (0.9, 0.1, 0.0), (0.35, 0.65, 0.0)),
        ("a4", "control", (0.1, 0.9, 0.0), (0.3, 0.7, 0.0)),
        ("a5", "no-evidence", (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)),
        ("a6", "no-evidence", (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)),
    ]
    data = [(u, y, 1, m, *p) for u, y, a, b in probs for m, p in (("a", a), ("b", b))]
    df = spark.createDataFrame(data, "user_id string, label string, fold int, model_id string, prob_diagnosed double, prob_control double, prob_no_evidence double")
    aligned = S.align_probabilities(df, ["a", "b"])
    rules = [DecisionRule("argmax")]
    coarse = S.select_ternary(aligned, ["a", "b"], rules, 0.5)
    best = S.refine_ternary(aligned, ["a", "b"], rules, coarse, 0.25, 0.25, 4).first()
    assert best["macro_f1"] >= coarse.first()["macro_f1"]
    fine = S.select_ternary(aligned, ["a", "b"], rules, 0.25).first()
    assert best["macro_f1"] == pytest.approx(fine["macro_f1"])


def test_fold_subsets(spark):
    rng = random.Random(4)
    data = []
    for u in range(60):
        p = [rng.random() + 0.01 for _ in range(3)]
        data.append((f"u{u}", rng.choice(TERNARY), u % 3 + 1, *[x / sum(p) for x in p]))
    df = spark.createDataFrame(data, "user_id string, label string, fold int, prob_diagnosed double, prob_control double, prob_no_evidence double")
    rule = DecisionRule("argmax")
    counts = M.decision_counts(df.withColumn("model_id", F.lit("m")), [rule], ["model_id", "fold"])
    subsets = {r["subset"]: r["macro_f1"] for r in M.fold_subset_metrics(counts, ["model_id"], [1, 2, 3]).collect()}
    assert set(subsets) == set(range(1, 8))
    for mask in subsets:
        folds = [f for f in (1, 2, 3) if mask >> (f - 1) & 1]
        part = M.diagnostic_rows(df.where(F.col("fold").isin(*folds)), rule)
        assert subsets[mask] == pytest.approx(M.ternary_metrics(part).first()["macro_f1"])


def test_bootstrap_is_deterministic_and_contains_the_point(spark):
    rng = random.Random(9)
    data = [("diagnosed" if rng.random() < 0.3 else "control", "diagnosed" if rng.random() < 0.4 else "control") for _ in range(200)]
    df = spark.createDataFrame(data, "label string, predicted string")
    first, again = (rows(B.bootstrap_intervals(df, 200, 42)) for _ in range(2))
    assert first == again
    point = M.binary_metrics(df).first()
    for name, low, high in first:
        assert low <= point[name] <= high


def test_identical_targets_have_no_delta(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (0, 1, 0, 1), (0, 0, 0, 0), (1, 0, 1, 0), (1, 1, 1, 1), (0, 0, 0, 0)], "first int, first_predicted int, second int, second_predicted int")
    r = B.paired_delta(df, 25, 42).first()
    assert (r["delta"], r["low"], r["high"]) == (0.0, 0.0, 0.0)


def test_empty_bins_are_kept(spark):
    df = spark.createDataFrame([("u", "control", 1, 0.1, 0.85, 0.05)], "user_id string, label string, fold int, prob_diagnosed double, prob_control double, prob_no_evidence double")
    bins = M.confidence_bins(M.diagnostic_rows(df, DecisionRule("argmax"))).collect()
    assert len(bins) == 7 and [b["n"] for b in bins] == [0, 0, 0, 0, 0, 1, 0]
    assert M.expected_calibration_error(M.confidence_bins(M.diagnostic_rows(df, DecisionRule("argmax")))).first()["ece"] == pytest.approx(0.15)


def test_a_missing_score_is_no_decision(spark):
    from chronoseal.functions import labels as L

    df = spark.createDataFrame([(1, 0.9), (2, None), (3, 0.1)], "id int, score double")
    assert dict(rows(df.withColumn("p", L.decide("score", 0.5)), "id", "p")) == {1: "diagnosed", 2: None, 3: "control"}
    three = spark.createDataFrame([(1, 0.6, 0.3, 0.1), (2, 0.6, None, 0.1)], "id int, d double, c double, n double")
    for kind in ("argmax", "diagnosed_margin", "no_evidence_gate"):
        assert dict(rows(three.withColumn("p", L.decide_ternary("d", "c", "n", L.DecisionRule("r", kind))), "id", "p")) == {1: "diagnosed", 2: None}


def test_incomplete_scores_are_refused(spark):
    good = [(u, "diagnosed" if u == "a" else "control", 1, 0.5, m) for u in "ab" for m in ("x", "y")]
    schema = "user_id string, label string, fold int, score double, model_id string"
    assert S.align_scores(spark.createDataFrame(good, schema), ["x", "y"]).count() == 2
    for bad, code in (
        (good[:-1], "align-missing-score b"),
        ([*good, good[0]], "align-duplicate-score a"),
        ([*good[:-1], ("b", "diagnosed", 1, 0.5, "y")], "align-label-mismatch b"),
        ([*good[:-1], ("b", "control", 2, 0.5, "y")], "align-fold-mismatch b"),
    ):
        with pytest.raises(Exception, match=code):
            S.align_scores(spark.createDataFrame(bad, schema), ["x", "y"]).collect()
    with pytest.raises(ValueError, match="strategy"):
        S.select_ensemble(spark.createDataFrame(good, schema), ["x", "y"], 0.5, "some")


def test_paired_report_shares_its_draws(spark):
    made = [(a, p, b, q) for a in (0, 1) for p in (0, 1) for b in (0, 1) for q in (0, 1) for _ in range(3 + 5 * (a == p) + 2 * (b == q))]
    df = spark.createDataFrame(made, "first int, first_predicted int, second int, second_predicted int")
    cells = B.paired_cells(df, "first", "first_predicted", "second", "second_predicted")
    got = {(r.target, r.metric): r for r in B.paired_report(cells, 300, 7).collect()}
    assert len(got) == 15 and all(r.low <= r.point <= r.high for r in got.values())
    delta = B.paired_delta(df, 300, 7).first()
    macro = got["delta", "macro_f1"]
    assert (macro.point, macro.low, macro.high) == pytest.approx((delta.delta, delta.low, delta.high))
    same = B.paired_report(B.paired_cells(df, "first", "first_predicted", "first", "first_predicted"), 50, 7).where("target = 'delta'")
    assert {(r.point, r.low, r.high) for r in same.collect()} == {(0.0, 0.0, 0.0)}


def test_ordered_key_orders_doubles(spark):
    from chronoseal.functions.numeric import ordered_key

    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**64, size=3000, dtype=np.uint64).view(np.float64)
    edges = np.array([0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1e300, np.finfo(float).max, np.inf])
    powers = np.exp2(np.arange(-1074, 1024).astype(float))
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    values = np.concatenate([bits[~np.isnan(bits)], edges, -edges, near, -near])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(ordered_key(F.col("v"))).collect()]
    plain = np.abs(values).view(np.int64)
    assert got == np.where(values < 0, -plain, plain).tolist()
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(ordered_key(F.col("v"))).collect()
    assert odd[0][0] is None and odd[1][0] > odd[2][0]


def _crowded(n):
    rng = np.random.default_rng(n)
    scores = np.where(rng.random(n) < 0.95, 0.5 + rng.random(n) * 1e-6, rng.random(n) * 1e-3)
    scores[0] = 1e300
    scores[1:4] = scores[5]
    return scores


@pytest.mark.parametrize("leaf_rows", [1, 20, 65_536])
def test_quantiles_of_a_crowd_and_an_outlier(spark, leaf_rows):
    scores = _crowded(700)
    qs = [0.0, 0.04, 0.05, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(float(v),) for v in scores], "v double")
    got = {r["q"]: r["value"] for r in quantiles(df, [], "v", qs, leaf_rows).collect()}
    assert [got[q] for q in qs] == pytest.approx([np.quantile(scores, q) for q in qs], rel=1e-12)


@pytest.mark.parametrize("prune", [None, "key", "all"])
def test_sweep_of_a_crowded_bin_equals_a_full_sweep(spark, prune):
    scores = _crowded(400)
    rng = np.random.default_rng(8)
    labels = rng.random(400) < np.where(scores > 0.5 + 5e-7, 0.7, 0.2)
    data = [(k, float(v), "diagnosed" if y else "control") for k in "ab" for v, y in zip(scores, labels)]
    df = spark.createDataFrame(data, "k string, score double, label string")
    for mode in ("gt", "ge_mid", "ge"):
        whole = SW.sweep_cuts(df, ["k"], mode=mode, prune=None)
        split = SW.sweep_cuts(df, ["k"], mode=mode, prune=prune, leaf_rows=10)
        full = {tuple(r) for r in whole.collect()}
        part = {tuple(r) for r in split.collect()}
        assert part <= full
        if prune is None:
            assert part == full and len(part) == 2 * (len(set(scores)) + 1)
        else:
            assert len(part) < len(full)
        best = {tuple(r) for r in SW.pick_best(split, ["k"]).collect()}
        assert best == {tuple(r) for r in SW.pick_best(whole, ["k"]).collect()}
