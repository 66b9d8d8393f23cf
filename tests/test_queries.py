"""A few registered queries against DuckDB on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from chronoseal.plans import load_all
from chronoseal.plans.inputs import MODEL_IDS, POLICIES
from tools.check import duck, normal

SF = "/root/testdata/sf0.001"
PICKED = [
    "evidence_markers",
    "temporal_features",
    "lexical_relevance",
    "pooled_vectors",
    "split_manifest",
    "oof_audit",
    "threshold_sweep",
    "fold_robustness",
    "select_fixed_set",
    "policy_labels",
    "parsed_responses",
    "artifact_chain",
    "rejected_records",
    "ordered_match",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, name):
    query = load_all()[name]
    df = query.run(spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(query.sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == normal(columns, result.fetchall())


def test_every_query_names_its_survey_items():
    registry = load_all()
    assert len(registry) > 150
    assert all(q.covers for q in registry.values())


def test_refinement_covers_all_policies_and_models(spark):
    got = load_all()["refine_ternary"].run(spark, SF)
    assert {f"w_{m}" for m in MODEL_IDS} <= set(got.columns)
    assert sorted(r.label_policy_id for r in got.collect()) == sorted(POLICIES)
