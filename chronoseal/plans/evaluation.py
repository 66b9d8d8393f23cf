"""Metrics, sweeps, calibration, robustness and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from ..operators import metrics as M
from ..operators import selection as S
from ..operators import sweep as SW
from ..operators import timeline as TL
from ..operators.quantiles import quantiles
from ..operators.ranking import best_per_key
from .base import query, table
from .inputs import EVENT_LEXICON, FOLDS, PEOPLE_SQL, RULES, SCORES_SQL, TERNARY_SQL, TIMELINE_SQL, event_totals, people, r6, rounded, scores, ternary, timeline
from .posts import _flags_cte, _select, _temporal_parts, _EVIDENCE_PARTS, markers_cte

# --- SQL fragments -------------------------------------------------------------------


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0e0 END)"


def binary_sql(source: str, keys: str = "") -> str:
    """CTE body: metrics beside tp, fp, tn, fn of ``source``."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT *, (diagnosed_f1 + control_f1) / 2 AS macro_f1 FROM (
      SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS diagnosed_f1, {ratio('2 * np * nr', 'np + nr')} AS control_f1 FROM (
        SELECT {k}tp, fp, tn, fn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('tn', 'tn + fn')} AS np, {ratio('tn', 'tn + fp')} AS nr,
               {ratio('tp + tn', 'tp + fp + tn + fn')} AS accuracy{', ' + 'threshold' if 'threshold' in source else ''} FROM {source}))"""


BINARY_OUT = ", ".join(r6(c, c) for c in ("precision", "recall", "diagnosed_f1", "control_f1", "macro_f1", "accuracy"))
CELLS = {f"n_{a}{p}": (la, lp) for a, la in zip("dcn", L.TERNARY) for p, lp in zip("dcn", L.TERNARY)}


def cells_sql(weight: str = "1") -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN label = '{a}' AND predicted = '{p}' THEN {weight} END), 0) AS BIGINT) AS {c}" for c, (a, p) in CELLS.items())


def ternary_sql(source: str) -> str:
    """CTE body: ternary metrics beside the nine cells of ``source``."""
    def f1(x: str, others: str) -> str:
        o1, o2 = others
        tp, fp, fn = f"n_{x}{x}", f"(n_{o1}{x} + n_{o2}{x})", f"(n_{x}{o1} + n_{x}{o2})"
        return f"{ratio(tp, f'{tp} + {fp}')} AS {x}p, {ratio(tp, f'{tp} + {fn}')} AS {x}r"

    total = " + ".join(CELLS)
    return f"""SELECT * EXCLUDE (dp, dr, cp, cr, np, nr), dp AS diagnosed_precision, dr AS diagnosed_recall,
      (diagnosed_f1 + control_f1 + no_evidence_f1) / 3 AS macro_f1 FROM (
      SELECT *, {ratio('2 * dp * dr', 'dp + dr')} AS diagnosed_f1, {ratio('2 * cp * cr', 'cp + cr')} AS control_f1, {ratio('2 * np * nr', 'np + nr')} AS no_evidence_f1,
             {ratio('n_dd + n_cc + n_nn', total)} AS accuracy FROM (
        SELECT *, {f1('d', 'cn')}, {f1('c', 'dn')}, {f1('n', 'dc')} FROM {source}))"""


def rule_sql(rule: L.DecisionRule, d: str = "prob_diagnosed", c: str = "prob_control", n: str = "prob_no_evidence") -> str:
    argmax = f"CASE WHEN {c} > {d} + 1e-12 THEN CASE WHEN {n} > {c} + 1e-12 THEN 'no-evidence' ELSE 'control' END WHEN {n} > {d} + 1e-12 THEN 'no-evidence' ELSE 'diagnosed' END"
    if rule.kind == "diagnosed_margin":
        return f"CASE WHEN {d} >= greatest({c}, {n}) + {rule.diagnosed_margin!r}e0 THEN 'diagnosed' WHEN {c} >= {n} THEN 'control' ELSE 'no-evidence' END"
    if rule.kind == "no_evidence_gate":
        return f"CASE WHEN {n} >= {rule.no_evidence_min!r}e0 AND {n} >= greatest({d}, {c}) THEN 'no-evidence' ELSE {argmax} END"
    return argmax


def rules_union(source: str, columns: str) -> str:
    """Rows of ``source`` once per rule with ``rule_id``, ``rule_order`` and ``predicted``."""
    return " UNION ALL ".join(f"SELECT {columns}, '{r.rule_id}' AS rule_id, {i + 1} AS rule_order, {rule_sql(r)} AS predicted FROM {source}" for i, r in enumerate(RULES))


TERNARY_OUT = ", ".join(r6(c, c) for c in ("macro_f1", "accuracy", "diagnosed_f1", "diagnosed_precision", "diagnosed_recall", "control_f1", "no_evidence_f1"))
TERNARY_COLS = ("macro_f1", "accuracy", "diagnosed_f1", "diagnosed_precision", "diagnosed_recall", "control_f1", "no_evidence_f1")
EPS = "2.220446049250313e-16"


def sweep_sql(source: str, keys: str, mode: str) -> str:
    """CTE list ``states``: all cuts of ``source(keys, score, pos)``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    threshold = {
        "gt": f"coalesce(lower_score, -{EPS})",
        "ge_mid": f"CASE WHEN lower_score IS NULL THEN -{EPS} ELSE (lower_score + score) / 2e0 END",
        "ge": "score",
    }[mode]
    empty = {"gt": "max(score)", "ge_mid": f"1e0 + {EPS}", "ge": "nextafter(max(score), CAST('infinity' AS DOUBLE))"}[mode]
    return f"""
sw_d AS (SELECT {k}score, sum(pos) AS p, count(*) AS n FROM {source} GROUP BY {k}score),
sw_c AS (SELECT {k}score, lag(score) OVER ({part}ORDER BY score) AS lower_score,
   sum(p) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
   sum(n - p) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
   sum(p) OVER ({part}) AS pa, sum(n - p) OVER ({part}) AS na FROM sw_d),
states AS (
  SELECT {k}{threshold} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(na - fp AS BIGINT) AS tn, CAST(pa - tp AS BIGINT) AS fn FROM sw_c
  UNION ALL
  SELECT {k}{empty}, 0, 0, CAST(sum(n - p) AS BIGINT), CAST(sum(p) AS BIGINT) FROM sw_d {group})
"""


def best_sql(keys: str, order: tuple[str, ...], digits: int | None = 12) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    terms = [f"round({m}, {digits}) DESC" if digits else f"{m} DESC" for m in order]
    return f"row_number() OVER ({part}ORDER BY {', '.join(terms)}, threshold ASC)"


BINARY_SCORED = "scored AS (SELECT model_id, score, CAST(label = 'diagnosed' AS INT) AS pos FROM scores WHERE split = 'train')"


def _train(spark, sf_dir):
    return scores(spark, sf_dir).where("split = 'train'")


# --- binary metrics and sweeps -------------------------------------------------------


@query(
    "A9 P17",
    f"""WITH {SCORES_SQL}, c AS (SELECT model_id, count(*) FILTER (WHERE label = 'diagnosed' AND score > 0.5e0) AS tp, count(*) FILTER (WHERE label <> 'diagnosed' AND score > 0.5e0) AS fp,
      count(*) FILTER (WHERE label <> 'diagnosed' AND score <= 0.5e0) AS tn, count(*) FILTER (WHERE label = 'diagnosed' AND score <= 0.5e0) AS fn FROM scores GROUP BY model_id)
    SELECT model_id, tp, fp, tn, fn, {BINARY_OUT} FROM ({binary_sql('c', 'model_id')})""",
)
def binary_metrics(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("predicted", L.decide("score", 0.5))
    return rounded(M.binary_metrics(rows, ["model_id"]))


def _sweep_query(mode: str, order: tuple[str, ...], digits: int | None) -> str:
    return f"""WITH {SCORES_SQL}, {BINARY_SCORED}, {sweep_sql('scored', 'model_id', mode)},
    m AS ({binary_sql('(SELECT model_id, threshold, tp, fp, tn, fn FROM states)', 'model_id')}), b AS (SELECT *, {best_sql('model_id', order, digits)} AS rk FROM m)
    SELECT model_id, round(threshold, 9) AS threshold, tp, fp, tn, fn, {BINARY_OUT} FROM b WHERE rk = 1"""


def _swept(spark, sf_dir, mode, order, digits):
    best = SW.best_threshold(_train(spark, sf_dir), ["model_id"], mode, order, digits)
    return rounded(rounded(best, 6, skip=("threshold",)), 9)


@query("A12 A11 W6", _sweep_query("gt", M.THRESHOLD_ORDER, 12))
def threshold_sweep(spark, sf_dir):
    """Best strict threshold per model."""
    return _swept(spark, sf_dir, "gt", M.THRESHOLD_ORDER, 12)


@query("A11 W7", _sweep_query("ge_mid", M.THRESHOLD_ORDER, None))
def threshold_sweep_midpoints(spark, sf_dir):
    """Inclusive thresholds between the scores, exact metric comparison."""
    return _swept(spark, sf_dir, "ge_mid", M.THRESHOLD_ORDER, None)


@query("A12", _sweep_query("ge", M.SELECTION_ORDER, None))
def threshold_sweep_inclusive(spark, sf_dir):
    """Inclusive thresholds at the scores, lower threshold wins ties."""
    return _swept(spark, sf_dir, "ge", M.SELECTION_ORDER, None)


@query("A11", _sweep_query("gt", ("diagnosed_f1", "macro_f1", "precision", "recall"), 12))
def threshold_sweep_positive(spark, sf_dir):
    """Sweep that optimises the F1 of the positive class."""
    return _swept(spark, sf_dir, "gt", ("diagnosed_f1", "macro_f1", "precision", "recall"), 12)


@query(
    "W6",
    f"""WITH {SCORES_SQL}, {BINARY_SCORED}, {sweep_sql('scored', 'model_id', 'gt')}
    SELECT model_id, round(threshold, 9) + 0e0 AS threshold, tp, fp, tn, fn FROM states""",
)
def running_confusion(spark, sf_dir):
    """Confusion counts at every cut."""
    cuts = SW.sweep_cuts(_train(spark, sf_dir), ["model_id"], prune=None)
    return rounded(cuts, 9)


@query(
    "W7",
    f"""WITH {SCORES_SQL}, d AS (SELECT DISTINCT model_id, score FROM scores)
    SELECT model_id, round(score, 9) AS score, round((score + lead(score) OVER (PARTITION BY model_id ORDER BY score)) / 2e0, 9) AS midpoint FROM d""",
)
def score_midpoints(spark, sf_dir):
    return rounded(SW.midpoints(scores(spark, sf_dir), ["model_id"]), 9)


@query(
    "A13 A14",
    f"""WITH {SCORES_SQL}, {BINARY_SCORED},
    q AS (SELECT model_id, unnest(quantile_cont(score, [{', '.join(repr(i / 40) for i in range(41))}])) AS t FROM scored GROUP BY model_id),
    t AS (SELECT model_id, t FROM q UNION SELECT model_id, i / 100e0 FROM (SELECT DISTINCT model_id FROM scored), range(101) r(i)),
    c AS (SELECT model_id, t AS threshold, count(*) FILTER (WHERE pos = 1 AND score > t) AS tp, count(*) FILTER (WHERE pos = 0 AND score > t) AS fp,
          count(*) FILTER (WHERE pos = 0 AND score <= t) AS tn, count(*) FILTER (WHERE pos = 1 AND score <= t) AS fn FROM t JOIN scored USING (model_id) GROUP BY model_id, t)
    SELECT model_id, round(max(macro_f1), 6) + 0e0 AS macro_f1 FROM ({binary_sql('c', 'model_id')}) GROUP BY model_id""",
)
def coarse_threshold_sweep(spark, sf_dir):
    return rounded(SW.coarse_sweep(_train(spark, sf_dir), ["model_id"]))


@query(
    "A14",
    f"""WITH {SCORES_SQL}, q AS (SELECT model_id, unnest([0.1e0, 0.25e0, 0.5e0, 0.975e0]) AS q, unnest(quantile_cont(score, [0.1, 0.25, 0.5, 0.975])) AS value FROM scores GROUP BY model_id)
    SELECT model_id, q, round(value, 6) + 0e0 AS value FROM q""",
)
def score_quantiles(spark, sf_dir):
    return rounded(quantiles(scores(spark, sf_dir), ["model_id"], "score", [0.1, 0.25, 0.5, 0.975]))


# --- ternary -------------------------------------------------------------------------


@query(
    "A10 P18",
    f"""WITH {TERNARY_SQL}, p AS (SELECT *, {rule_sql(RULES[1])} AS predicted FROM tern),
    c AS (SELECT label_policy_id, model_id, {cells_sql()} FROM p GROUP BY label_policy_id, model_id)
    SELECT label_policy_id, model_id, {', '.join(CELLS)}, {TERNARY_OUT} FROM ({ternary_sql('c')})""",
)
def ternary_metrics(spark, sf_dir):
    rows = ternary(spark, sf_dir).withColumn("predicted", L.decide_ternary(*S.PROBABILITIES, RULES[1]))
    out = M.ternary_metrics(rows, ["label_policy_id", "model_id"])
    return rounded(out.select("label_policy_id", "model_id", *CELLS, *TERNARY_COLS))


@query("P18", f"WITH {TERNARY_SQL} SELECT user_id, label_policy_id, model_id, " + ", ".join(f"{rule_sql(r)} AS {r.rule_id}" for r in RULES) + " FROM tern")
def ternary_decisions(spark, sf_dir):
    return ternary(spark, sf_dir).select("user_id", "label_policy_id", "model_id", *[L.decide_ternary(*S.PROBABILITIES, r).alias(r.rule_id) for r in RULES])


LEADERBOARD_CTE = f"""{TERNARY_SQL}, pr AS ({rules_union('tern', 'label_policy_id, model_id, family, source, fold, label')}),
    lc AS (SELECT label_policy_id, model_id, family, source, rule_id, rule_order, {cells_sql()} FROM pr GROUP BY ALL),
    lb AS ({ternary_sql('lc')})"""
TERNARY_ORDER_SQL = "round(macro_f1, 12) DESC, round(diagnosed_f1, 12) DESC, round(diagnosed_precision, 12) DESC, round(accuracy, 12) DESC"


@query("E11 J14 W9", f"WITH {LEADERBOARD_CTE} SELECT label_policy_id, model_id, rule_id, row_number() OVER (ORDER BY {TERNARY_ORDER_SQL}, label_policy_id, model_id, rule_id) AS rank, {TERNARY_OUT} FROM lb")
def leaderboard(spark, sf_dir):
    """Models x policies x rules, ranked."""
    board = S.leaderboard(ternary(spark, sf_dir), RULES)
    return rounded(board.select("label_policy_id", "model_id", "rule_id", F.col("rank").cast("bigint").alias("rank"), *TERNARY_COLS))


@query("T3", f"WITH {LEADERBOARD_CTE} SELECT label_policy_id, model_id, rule_id, row_number() OVER (ORDER BY {TERNARY_ORDER_SQL}, label_policy_id, model_id, rule_id) AS rank, {TERNARY_OUT} FROM lb QUALIFY rank <= 20")
def leaderboard_report(spark, sf_dir):
    """The first twenty rows of the board, as the report shows them."""
    return leaderboard(spark, sf_dir).where("rank <= 20")


@query(
    "A23 W8 P32",
    f"""WITH {LEADERBOARD_CTE}, b AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY label_policy_id, model_id ORDER BY {TERNARY_ORDER_SQL}, rule_id) = 1)
    SELECT source || ':' || family AS family, count(*) AS entries, {r6('max(macro_f1)', 'best_macro_f1')}, {r6('avg(macro_f1)', 'mean_macro_f1')}, {r6('avg(diagnosed_f1)', 'mean_diagnosed_f1')}, {r6('avg(diagnosed_precision)', 'mean_diagnosed_precision')}
    FROM b GROUP BY 1""",
)
def leaderboard_families(spark, sf_dir):
    """Best rule per model and policy, summarised by model family."""
    keys = ["label_policy_id", "model_id", "family", "source"]
    board = S.leaderboard(ternary(spark, sf_dir), RULES, keys)
    best = best_per_key(board, ["label_policy_id", "model_id"], M.order_by_metrics(M.TERNARY_ORDER, F.col("rule_id").asc()))
    named = best.withColumn("family", F.concat_ws(":", "source", "family"))
    return rounded(S.board_summary(named, "family"))


@query(
    "A21 T5",
    f"""WITH {TERNARY_SQL}, pr AS ({rules_union("tern WHERE split = 'train'", 'label_policy_id, model_id, fold, label')}),
    fc AS (SELECT label_policy_id, model_id, rule_id, fold, {cells_sql()} FROM pr GROUP BY ALL),
    sc AS (SELECT label_policy_id, model_id, rule_id, s AS subset, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in CELLS)} FROM fc, range(1, 32) r(s) WHERE (s >> (fold - 1)) & 1 = 1 GROUP BY ALL),
    sm AS ({ternary_sql('sc')})
    SELECT label_policy_id, model_id, rule_id, count(*) AS combinations, {r6('avg(macro_f1)', 'macro_f1_mean')}, {r6('min(macro_f1)', 'macro_f1_min')}, {r6('max(macro_f1)', 'macro_f1_max')}, {r6('stddev_pop(macro_f1)', 'macro_f1_std')}
    FROM sm GROUP BY ALL ORDER BY round(avg(macro_f1), 12) DESC, round(min(macro_f1), 12) DESC, label_policy_id, model_id, rule_id""",
)
def fold_robustness(spark, sf_dir):
    """Metrics on all 31 fold subsets, per policy, model and rule."""
    keys = ["label_policy_id", "model_id"]
    train = ternary(spark, sf_dir).where("split = 'train'")
    subsets = M.fold_subset_metrics(M.decision_counts(train, RULES, [*keys, "fold"]), keys, FOLDS)
    stats = M.scalar_stats(subsets, [*keys, "rule_id"], ["macro_f1"])
    return rounded(stats)


# --- diagnostics ---------------------------------------------------------------------

_WEIGHTS = {"m1_linear": 0.5, "m2_boost": 0.3, "m5_stack": 0.2}
_LOCKED_SQL = f"""{TERNARY_SQL}, w(model_id, w) AS (VALUES {', '.join(f"('{m}', {w}e0)" for m, w in _WEIGHTS.items())}),
    lk AS (SELECT user_id, fold, any_value(label) AS label, sum(prob_diagnosed * w) AS prob_diagnosed, sum(prob_control * w) AS prob_control, sum(prob_no_evidence * w) AS prob_no_evidence
      FROM tern JOIN w USING (model_id) WHERE label_policy_id = 'p_half' AND split = 'train' GROUP BY user_id, fold),
    dg0 AS (SELECT *, {rule_sql(RULES[1])} AS predicted FROM lk),
    dg AS (SELECT *, CASE predicted WHEN 'diagnosed' THEN prob_diagnosed WHEN 'control' THEN prob_control ELSE prob_no_evidence END AS pp,
      CASE label WHEN 'diagnosed' THEN prob_diagnosed WHEN 'control' THEN prob_control ELSE prob_no_evidence END AS ap, predicted = label AS correct,
      power(prob_diagnosed - CAST(label = 'diagnosed' AS INT), 2) + power(prob_control - CAST(label = 'control' AS INT), 2) + power(prob_no_evidence - CAST(label = 'no-evidence' AS INT), 2) AS brier FROM dg0)"""


def _diagnostics(spark, sf_dir):
    rows = ternary(spark, sf_dir).where("label_policy_id = 'p_half' AND split = 'train'")
    models = sorted(_WEIGHTS)
    locked = S.locked_probabilities(S.align_probabilities(rows, models), models, _WEIGHTS)
    return M.diagnostic_rows(locked, RULES[1])


@query("A17 P34 E8", f"WITH {_LOCKED_SQL} SELECT count(*) AS rows, {r6('avg(brier)', 'brier')}, {r6('avg(-ln(greatest(ap, 1e-12)))', 'nll')}, {r6('avg(prob_diagnosed)', 'mean_diagnosed')}, {r6('avg(prob_control)', 'mean_control')}, {r6('avg(prob_no_evidence)', 'mean_no_evidence')} FROM dg")
def probability_quality(spark, sf_dir):
    return rounded(M.probability_summary(_diagnostics(spark, sf_dir)))


_EDGES = M.ECE_EDGES
_BINS_SQL = f"""bins(lower, upper, hi) AS (VALUES {', '.join(f'({a!r}e0, {min(b, 1.0)!r}e0, {b!r}e0)' for a, b in zip(_EDGES, _EDGES[1:]))}),
    cb AS (SELECT lower, upper, count(pp) AS n, coalesce(avg(CAST(correct AS INT)), 0) AS accuracy, coalesce(avg(pp), 0) AS average_confidence FROM bins LEFT JOIN dg ON pp >= lower AND pp < hi GROUP BY lower, upper)"""


@query("A18", f"WITH {_LOCKED_SQL}, {_BINS_SQL} SELECT lower, upper, n, {r6('accuracy', 'accuracy')}, {r6('average_confidence', 'average_confidence')}, {r6('average_confidence - accuracy', 'calibration_gap')} FROM cb")
def confidence_bins(spark, sf_dir):
    return rounded(M.confidence_bins(_diagnostics(spark, sf_dir)))


@query("A18", f"WITH {_LOCKED_SQL}, {_BINS_SQL} SELECT {r6('sum(n * abs(average_confidence - accuracy)) / sum(n)', 'ece')} FROM cb")
def calibration_error(spark, sf_dir):
    return rounded(M.expected_calibration_error(M.confidence_bins(_diagnostics(spark, sf_dir))))


@query(
    "A19",
    f"WITH {_LOCKED_SQL} SELECT fold, count(*) AS n, {r6('avg(CAST(correct AS INT))', 'accuracy')}, {r6('avg(brier)', 'brier')}, "
    + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{M.SHORT[v]}" for c in ("predicted", "label") for v in L.TERNARY)
    + " FROM dg GROUP BY fold",
)
def fold_summaries(spark, sf_dir):
    return rounded(M.fold_summaries(_diagnostics(spark, sf_dir)))


@query(
    "A19",
    f"""WITH {_LOCKED_SQL}, d(label) AS (VALUES ('diagnosed'), ('control'), ('no-evidence'))
    SELECT d.label, (SELECT count(*) FROM dg WHERE dg.label = d.label) AS actual_count, (SELECT count(*) FROM dg WHERE dg.predicted = d.label) AS predicted_count,
    {r6('coalesce((SELECT avg(ap) FROM dg WHERE dg.label = d.label), 0)', 'average_actual_probability')}, {r6('coalesce((SELECT avg(pp) FROM dg WHERE dg.predicted = d.label), 0)', 'average_predicted_probability')} FROM d""",
)
def class_summaries(spark, sf_dir):
    return rounded(M.class_summaries(_diagnostics(spark, sf_dir)))


@query("T2", f"WITH {_LOCKED_SQL} SELECT sha256(CAST(user_id AS VARCHAR)) AS user_hash, fold, label AS actual, predicted, round(pp, 9) AS predicted_probability, round(ap, 9) AS actual_probability FROM dg WHERE NOT correct ORDER BY round(pp, 9) DESC, user_id LIMIT 25")
def confident_errors(spark, sf_dir):
    d = _diagnostics(spark, sf_dir).withColumn("predicted_probability", F.round("predicted_probability", 9))
    return rounded(M.confident_errors(d), 9)


@query("A7", f"WITH {TERNARY_SQL}, d(label) AS (VALUES ('diagnosed'), ('control'), ('no-evidence')), g AS (SELECT DISTINCT split, fold FROM people) SELECT g.split, g.fold, d.label, (SELECT count(*) FROM tern t WHERE t.model_id = 'm1_linear' AND t.label_policy_id = 'p_half' AND t.split = g.split AND t.fold = g.fold AND t.label = d.label) AS n FROM g CROSS JOIN d")
def dense_label_counts(spark, sf_dir):
    rows = ternary(spark, sf_dir).where("model_id = 'm1_linear' AND label_policy_id = 'p_half'")
    return M.label_counts(rows, ["split", "fold"], "label", L.TERNARY)


_PAIRS = "SELECT CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS original, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS specialist FROM labels"


@query("A8 J16", f"WITH p AS ({_PAIRS}), d(v) AS (VALUES ('no'), ('yes')) SELECT a.v AS original, b.v AS specialist, (SELECT count(*) FROM p WHERE p.original = a.v AND p.specialist = b.v) AS n FROM d a CROSS JOIN d b")
def label_pairs(spark, sf_dir):
    yes_no = [F.when(F.col(c) == 1, F.lit("yes")).otherwise(F.lit("no")).alias(n) for c, n in (("quality", "original"), ("toxic", "specialist"))]
    return M.pair_counts(table(spark, sf_dir, "labels").select(*yes_no), "original", "specialist", ["no", "yes"])


@query(
    "A20",
    f"""WITH {TIMELINE_SQL}, {markers_cte('tl')}, {PEOPLE_SQL} SELECT label, count(*) AS n, {r6('avg(total_tweets)', 'avg_total_tweets')}, {r6('avg(evidence_score)', 'avg_evidence_score')}, {r6('avg(top10_avg_relevance)', 'avg_top10_avg_relevance')}
    FROM markers JOIN people USING (user_id) GROUP BY label""",
)
def marker_averages(spark, sf_dir):
    joined = TL.evidence_markers(timeline(spark, sf_dir, indexed=False)).join(people(spark, sf_dir).select("user_id", "label"), "user_id")
    return rounded(M.marker_averages(joined, "label", ["total_tweets", "evidence_score", "top10_avg_relevance"]))


@query("A28", f"WITH {PEOPLE_SQL}, c AS (SELECT label, count(*) AS c FROM people GROUP BY label) SELECT user_id, {r6('(SELECT count(*) FROM people) / (2e0 * c)', 'weight')}, {r6('power((SELECT count(*) FROM people) / (2e0 * c), 2)', 'weight_squared')} FROM people JOIN c USING (label)")
def balanced_weights(spark, sf_dir):
    once = M.balanced_weights(people(spark, sf_dir))
    return rounded(M.balanced_weights(once, power=2, name="weight_squared").select("user_id", "weight", "weight_squared"))


@query(
    "A24",
    f"""WITH {SCORES_SQL}, f AS (SELECT user_id, model_id, k AS fold, score * (1 + k / 10e0) AS score FROM scores s, range(1, 6) r(k) WHERE split = 'test' AND NOT (s.fold = 1 AND k = 5))
    SELECT user_id, model_id, {r6('avg(score)', 'score')}, count(*) AS scored, count(*) = 5 AND count(DISTINCT fold) = 5 AS complete FROM f GROUP BY user_id, model_id""",
)
def fold_averages(spark, sf_dir):
    """Five fold models per test user; the fifth is missing for the users of fold 1."""
    test = scores(spark, sf_dir).where("split = 'test'").withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    made = test.where(~((F.col("own") == 1) & (F.col("fold") == 5))).withColumn("score", F.col("score") * (1 + F.col("fold") / F.lit(10.0)))
    return rounded(M.fold_average(made, 5))


@query("A29", f"WITH {SCORES_SQL}, a AS (SELECT user_id, score FROM scores WHERE model_id = 'm1_linear' AND fold <> 1), b AS (SELECT user_id, score FROM scores WHERE model_id = 'm2_boost' AND fold <> 2) SELECT count(*) AS rows, {r6('max(abs(a.score - b.score))', 'max_abs_difference')}, count(*) FILTER (WHERE a.score IS NULL OR b.score IS NULL) AS unmatched FROM a FULL JOIN b USING (user_id)")
def score_differences(spark, sf_dir):
    s = scores(spark, sf_dir)
    a = s.where("model_id = 'm1_linear' AND fold <> 1")
    b = s.where("model_id = 'm2_boost' AND fold <> 2")
    return rounded(M.score_difference(a, b))


@query(
    "P29 T3",
    f"""WITH {TIMELINE_SQL}, {markers_cte('tl')}, {_flags_cte()}, tf AS (SELECT user_id, {_select(_temporal_parts())} FROM fl GROUP BY user_id),
    ef AS (SELECT user_id, {_select(_EVIDENCE_PARTS)} FROM markers), {SCORES_SQL},
    j AS (SELECT s.user_id, s.label, s.score, rel7_count_log, last_rel7_normalized_position AS pos, final50_rel7_ratio AS r50,
      final50_indirect_anxiety_ratio + final50_indirect_sleep_ratio + final50_indirect_fatigue_ratio + final50_indirect_cry_sad_ratio AS sig
      FROM scores s JOIN tf USING (user_id) JOIN ef USING (user_id) WHERE s.model_id = 'm1_linear'),
    p AS (SELECT *, CASE WHEN label = 'control' AND score > 0.3e0 AND exp(rel7_count_log) - 1 >= 1 AND pos < 0.75 AND r50 < 0.02 THEN 'fp_historical_recent_quiet'
      WHEN label = 'control' AND score > 0.3e0 THEN 'fp_other' WHEN label = 'diagnosed' AND score <= 0.3e0 AND sig >= 0.08 AND score < 0.3e0 THEN 'fn_recent_indirect_low_score'
      WHEN label = 'diagnosed' AND score <= 0.3e0 THEN 'fn_other' END AS pattern FROM j)
    SELECT pattern, count(*) AS n, min(user_id) AS first_user FROM p WHERE pattern IS NOT NULL GROUP BY pattern""",
)
def error_patterns(spark, sf_dir):
    features = TL.timeline_features(timeline(spark, sf_dir), lexicon=EVENT_LEXICON, totals=event_totals(spark, sf_dir)).select("user_id", "temporal.*", F.col("evidence.rel7_count_log"))
    rows = scores(spark, sf_dir).where("model_id = 'm1_linear'").join(rounded(features), "user_id")
    return M.error_patterns(rows, 0.3).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first_user"))


@query(
    "P20 P21 M9 M4",
    f"""WITH {TERNARY_SQL}, r AS (SELECT user_id, model_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE prob_diagnosed * 2 END AS a, prob_control AS b, CASE WHEN user_id % 7 = 0 THEN -1e0 ELSE prob_no_evidence END AS c FROM tern WHERE label_policy_id = 'p_half'),
    k AS (SELECT *, least(greatest(coalesce(a, 1 / 3e0), 1e-9), 1) AS ka, least(greatest(b, 1e-9), 1) AS kb, least(greatest(c, 1e-9), 1) AS kc FROM r)
    SELECT user_id, model_id, {r6('ka / (ka + kb + kc)', 'd')}, {r6('kb / (ka + kb + kc)', 'c')}, {r6('kc / (ka + kb + kc)', 'n')},
    coalesce(a BETWEEN -1e-8 AND 1 + 1e-8 AND b BETWEEN -1e-8 AND 1 + 1e-8 AND c BETWEEN -1e-8 AND 1 + 1e-8 AND abs(a + b + c - 1) <= 1e-4, false) AS valid FROM k""",
)
def cleaned_probabilities(spark, sf_dir):
    """Doubled, missing and negative probabilities, cleaned and judged."""
    t = ternary(spark, sf_dir).where("label_policy_id = 'p_half'")
    user = F.col("user_id")
    raw = t.select(
        "user_id",
        "model_id",
        F.when(user % 10 != 0, F.col("prob_diagnosed") * 2).alias("a"),
        F.col("prob_control").alias("b"),
        F.when(user % 7 == 0, F.lit(-1.0)).otherwise(F.col("prob_no_evidence")).alias("c"),
    )
    d, c, n = N.clean_probabilities("a", "b", "c")
    return rounded(raw.select("user_id", "model_id", d.alias("d"), c.alias("c"), n.alias("n"), N.probabilities_valid("a", "b", "c").alias("valid")))


@query(
    "M9",
    f"""WITH {TIMELINE_SQL}, {markers_cte('tl')}, e AS (SELECT user_id, evidence_score AS e, evidence_score + 0.05e0 AS a, greatest(1 - evidence_score, 1e-9) AS n FROM markers)
    SELECT user_id, {r6('e', 'score')}, {r6('least(a, 1) / (least(a, 1) + 0.25 + n)', 'd')}, {r6('0.25 / (least(a, 1) + 0.25 + n)', 'c')}, {r6('n / (least(a, 1) + 0.25 + n)', 'n')} FROM e""",
)
def relevance_baseline(spark, sf_dir):
    m = TL.evidence_markers(timeline(spark, sf_dir, indexed=False))
    d, c, n = N.baseline_probabilities("evidence_score")
    return rounded(m.select("user_id", N.clean_score("evidence_score").alias("score"), d.alias("d"), c.alias("c"), n.alias("n")))


@query(
    "P35 P33",
    f"""WITH {SCORES_SQL}, c AS (SELECT model_id, count(*) FILTER (WHERE label = 'diagnosed' AND score >= 0.4e0) AS tp, count(*) FILTER (WHERE label <> 'diagnosed' AND score >= 0.4e0) AS fp,
      count(*) FILTER (WHERE label <> 'diagnosed' AND score < 0.4e0) AS tn, count(*) FILTER (WHERE label = 'diagnosed' AND score < 0.4e0) AS fn FROM scores GROUP BY model_id)
    SELECT model_id, {r6('diagnosed_f1', 'positive_f1')}, {r6('control_f1', 'negative_f1')}, {r6('macro_f1', 'macro_f1')} FROM ({binary_sql('c', 'model_id')})""",
)
def generic_metrics(spark, sf_dir):
    """Inclusive decisions; flat and nested metric reports normalised to generic names."""
    m = M.binary_metrics(scores(spark, sf_dir).withColumn("predicted", L.decide("score", 0.4, inclusive=True)), ["model_id"])
    nested = m.select("model_id", F.when(F.substring("model_id", 2, 1) < "3", F.col("macro_f1")).alias("macro_f1"), F.struct("macro_f1", "diagnosed_f1", "control_f1").alias("report"))
    flat = M.normalize_metrics(nested, ["macro_f1", "diagnosed_f1", "control_f1"], {n: f"report.{n}" for n in ("macro_f1", "diagnosed_f1", "control_f1")})
    return rounded(M.rename_metrics(flat, {"diagnosed_f1": "positive_f1", "control_f1": "negative_f1"}))
