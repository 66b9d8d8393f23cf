"""Searches per key against the same searches over the rows of one key."""

from __future__ import annotations

import pytest

from chronoseal.operators import selection as S
from chronoseal.plans.inputs import FOLDS, MODEL_IDS, POLICIES, RULES, ternary

KEYS = ["label_policy_id"]


@pytest.fixture(scope="module")
def rows(spark):
    return ternary(spark, "/root/testdata/sf0.001").where("split = 'train'").cache()


def of(df, policy):
    return df.where(df.label_policy_id == policy).drop("label_policy_id")


def test_ranked_prefixes_per_key(rows):
    keyed = S.select_ternary_pruned(rows, MODEL_IDS, RULES, keys=KEYS).collect()
    assert sorted(r.label_policy_id for r in keyed) == sorted(POLICIES)
    for r in keyed:
        alone = S.select_ternary_pruned(of(rows, r.label_policy_id), MODEL_IDS, RULES).first()
        assert (alone["size"], alone.kind, alone.rule_id, alone.weights) == (r["size"], r.kind, r.rule_id, r.weights)


def test_nested_selection_per_key(rows):
    aligned = S.align_probabilities(rows, MODEL_IDS[:3], keys=[*KEYS, "user_id"])
    keyed = S.nested_selection(aligned, MODEL_IDS[:3], RULES, 0.25, FOLDS, KEYS)
    for policy in POLICIES:
        alone = S.nested_selection(of(aligned, policy), MODEL_IDS[:3], RULES, 0.25, FOLDS)
        assert sorted(map(tuple, of(keyed, policy).select(*alone.columns).collect())) == sorted(map(tuple, alone.collect()))


def test_large_groups_are_selected_per_key(rows):
    locks = S.select_groups(rows, {"all_models": MODEL_IDS}, MODEL_IDS, RULES, 0.25, KEYS, exhaustive_limit=2).collect()
    assert sorted(r.label_policy_id for r in locks) == sorted(POLICIES)


def test_a_binary_grid_repeats_different_rows_only(spark, monkeypatch):
    rows = [(u, "diagnosed" if u % 3 == 0 else "control", [(u % 3) / 4, (u % 3 == 0) * 0.5]) for u in range(300)]
    aligned = spark.createDataFrame(rows, "user_id long, label string, scores array<double>")
    grown, grid = [], S.with_grid
    monkeypatch.setattr(S, "with_grid", lambda df, *a: grown.append(df.count()) or grid(df, *a))
    lock = S.select_weights(aligned, ["a", "b"], 0.5).first()
    assert grown == [3]
    assert (lock["tp"], lock["fp"], lock["tn"], lock["fn"]) == (100, 0, 200, 0)
