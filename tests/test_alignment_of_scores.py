"""Alignment hashes the scores; texts are sorted only after one row per user is left."""

from __future__ import annotations

import re

import pytest

from chronoseal.operators import alignment as A
from chronoseal.operators import selection as S

MODELS = ["a", "b"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "user_id long, label string, fold int, model_id string, score double")


def whole(user, label, fold):
    return [(user, label, fold, m, 0.5) for m in MODELS]


CASES = {
    "align-duplicate-score": whole(1, "x", 1) + whole(1, "y", 1),
    "align-label-mismatch": [(1, "x", 1, "a", 0.5), (1, "y", 1, "b", 0.5)],
    "align-fold-mismatch": [(1, "x", 1, "a", 0.5), (1, "x", 2, "b", 0.5)],
    "align-missing-score": [(1, "x", 1, "a", 0.5), (1, "y", 1, "a", 0.5)],
}


@pytest.mark.parametrize("code", CASES)
def test_contracts_hold_over_several_label_groups(spark, code):
    rows = scores(spark, CASES[code] + whole(2, "x", 3))
    assert [(r.code, r.detail) for r in A.alignment_findings(rows, MODELS).collect()] == [(code, "1")]
    with pytest.raises(Exception, match=code):
        S.align_scores(rows, MODELS).collect()


def test_a_missing_label_takes_the_other_models_label(spark):
    rows = scores(spark, [(1, None, 1, "a", 0.25), (1, "x", 1, "b", 0.75)])
    assert [tuple(r) for r in S.align_scores(rows, MODELS).collect()] == [(1, "x", 1, [0.25, 0.75])]
    assert A.alignment_findings(rows, MODELS).count() == 0


def first_aggregate(df):
    """The aggregate nearest to the rows, as the plan names it."""
    return re.findall(r"(\w*Aggregate)\(", df._jdf.queryExecution().executedPlan().toString())[-1]


def test_scores_are_hashed_not_sorted_or_expanded(spark):
    rows = scores(spark, whole(1, "x", 1))
    for df in (S.align_scores(rows, MODELS), A.alignment_findings(rows, MODELS)):
        assert first_aggregate(df) == "HashAggregate"
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
