"""Out-of-fold fits run side by side, and a stack aligns its scores once."""

from __future__ import annotations

import threading

from chronoseal.operators import models as MD


def table(spark):
    return spark.createDataFrame([(u, ("control", "diagnosed")[u % 2], u % 4 + 1, (u * 7 % 11) / 11) for u in range(40)], "user_id long, label string, fold int, s double")


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    together = threading.Barrier(4, timeout=60)
    fit = MD.fit_binary

    def waiting(*args, **kwargs):
        together.wait()
        return fit(*args, **kwargs)

    monkeypatch.setattr(MD, "fit_binary", waiting)
    got = MD.oof_scores(table(spark), MD.Candidate("m", "logreg", (), ("s",))).collect()
    assert sorted((r.user_id, r.fold) for r in got) == [(u, u % 4 + 1) for u in range(40)]


def test_stack_reads_aligned_scores(spark):
    rows = table(spark)
    scores = rows.selectExpr("user_id", "label", "fold", "s AS score", "'a' AS model_id").unionByName(rows.selectExpr("user_id", "label", "fold", "1 - s AS score", "'b' AS model_id"))
    out = MD.stack_oof(scores, ["a", "b"], MD.Candidate("stack"))
    assert out.count() == 40
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
