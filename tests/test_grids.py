"""Grid counts of numpy against the column expressions, and the plan of the search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoseal.functions.labels import TERNARY, DecisionRule
from chronoseal.operators import grids as G
from chronoseal.operators import metrics as M
from chronoseal.operators import selection as S

RULES = [DecisionRule("argmax"), DecisionRule("margin", "diagnosed_margin", diagnosed_margin=0.05), DecisionRule("gate", "no_evidence_gate", no_evidence_min=0.35)]


def by_columns(aligned, ranges, precision, keys):
    grown = S.with_grid(aligned, ranges, precision)
    ws, n = S._unit_weights(len(ranges), precision, False), len(ranges)
    blended = grown.select(*keys, "label", S._code(n, precision).alias("code"), *[S.blend(p, ws).alias(p) for p in S.PROBABILITIES])
    return M.ternary_confusion(M.decision_counts(blended, RULES, [*keys, "code"]), [*keys, "code", "rule_id"], n=F.col("n"))


def shown(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    # Twentieths make many exact ties; the odd values must be decided as Spark orders them.
    value = lambda: draw.choice([draw.random(), draw.randrange(21) / 20])
    made = [(f"k{i % 2}", draw.choice(TERNARY), *[[value() for _ in range(4)] for _ in range(3)]) for i in range(160)]
    for odd in (float("nan"), float("inf"), None):
        for at in range(3):
            made.append(("k0", TERNARY[at], *[[odd if k == at and m == 1 else value() for m in range(4)] for k in range(3)]))
    made.append(("k1", "other", *[[0.1] * 4] * 3))
    made.append(("k2", None, *[[0.1] * 4] * 3))
    return spark.createDataFrame(made, "k string, label string, " + ", ".join(f"{p} array<double>" for p in S.PROBABILITIES))


@pytest.mark.parametrize("ranges, precision", [([(0, 6)] * 4, 6), ([(1, 4), (0, 2), (0, 5)], 5), ([(0, 10), (3, 7)], 10), ([(0, 4)], 4)])
def test_counts_equal_the_expressions(rows, ranges, precision, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 7)
    got = G.ternary_grid_cells(rows, RULES, ranges, precision, ["k"], S.PROBABILITIES)
    assert shown(got) == shown(by_columns(rows, ranges, precision, ["k"]))


def test_no_rows_give_no_points(rows):
    assert G.ternary_grid_cells(rows.where("false"), RULES, [(0, 2)] * 2, 2, ["k"], S.PROBABILITIES).count() == 0


def test_rows_are_not_repeated_per_point(rows):
    found = S.select_ternary(rows, list("abcd"), RULES, 0.05, ["k"])
    assert "Generate" not in found._jdf.queryExecution().toString()
