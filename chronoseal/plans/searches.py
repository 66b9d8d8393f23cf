"""Weight grids, ensemble selection, policies and nested selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LabelPolicy
from ..operators import metrics as M
from ..operators import selection as S
from ..operators import splits as SP
from ..operators import timeline as TL
from .base import query
from .evaluation import BINARY_OUT, CELLS, TERNARY_ORDER_SQL, best_sql, binary_sql, cells_sql, rule_sql, rules_union, sweep_sql, ternary_sql
from .inputs import FOLDS, MODEL_IDS, PEOPLE_SQL, POLICIES, RULES, SCORES_SQL, TERNARY_SQL, TIMELINE_SQL, people, r6, rounded, scores, ternary, timeline
from .posts import markers_cte

ORDER_OUT = ", ".join(r6(c, c) for c in M.TERNARY_ORDER)


def _train_scores(spark, sf_dir):
    return scores(spark, sf_dir).where("split = 'train'")


def _train_ternary(spark, sf_dir):
    return ternary(spark, sf_dir).where("split = 'train'")


# --- grids ---------------------------------------------------------------------------


@query(
    "E1",
    """WITH u AS (SELECT range AS u FROM range(0, 11)), p AS (SELECT c_custkey AS user_id FROM customer)
    SELECT user_id, a.u AS u0, b.u AS u1, 10 - a.u - b.u AS u2 FROM p, u a, u b WHERE a.u >= 1 AND b.u >= 1 AND 10 - a.u - b.u >= 1""",
)
def weight_grid(spark, sf_dir):
    """Every customer with the 36 weight vectors of three models in tenths, at least one tenth each."""
    grid = S.with_grid(people(spark, sf_dir).select("user_id"), S.simplex(3, 10, 1), 10)
    return grid.select("user_id", *[F.col(f"u{i}").cast("bigint").alias(f"u{i}") for i in range(3)])


_WIDE = "wide AS (SELECT user_id, any_value(label) AS label, " + ", ".join(f"max(score) FILTER (WHERE model_id = '{m}') AS s{i}" for i, m in enumerate(MODEL_IDS)) + " FROM scores WHERE split = 'train' GROUP BY user_id)"


def _binary_grid_sql(n: int, precision: int, minimum: int, product: bool, mode: str) -> str:
    names = [f"u{i}" for i in range(n - 1)]
    rest = f"{precision} - " + " - ".join(names)
    grid = ", ".join(f"range({minimum}, {precision + 1}) r{i}(u{i})" for i in range(n - 1))
    weight = (lambda u: f"CAST({u} AS DOUBLE) * {1.0 / precision!r}e0") if product else (lambda u: f"CAST({u} AS DOUBLE) / {precision}e0")
    blend = " + ".join(f"s{i} * ({weight(f'u{i}')})" for i in range(n))
    code = "0"
    for i in range(n):
        code = f"({code}) * {precision + 1} + u{i}"
    order = M.THRESHOLD_ORDER if mode == "gt" else M.SELECTION_ORDER
    digits = 12 if mode == "gt" else None
    final = [f"round({m}, 12) DESC" for m in M.SELECTION_ORDER] if mode == "gt" else [f"{m} DESC" for m in M.SELECTION_ORDER] + ["threshold"]
    weights = ", ".join(r6(weight(f"((code // {(precision + 1) ** (n - 1 - i)}) % {precision + 1})"), f"w_{MODEL_IDS[i]}") for i in range(n))
    return f"""WITH {SCORES_SQL}, {_WIDE}, g AS (SELECT {', '.join(names)}, {rest} AS u{n - 1} FROM {grid} WHERE {rest} >= {minimum}),
    sg AS (SELECT {code} AS code, 0e0 + {blend} AS score, CAST(label = 'diagnosed' AS INT) AS pos FROM wide, g),
    {sweep_sql('sg', 'code', mode)},
    m AS ({binary_sql('(SELECT code, threshold, tp, fp, tn, fn FROM states)', 'code')}), b AS (SELECT *, {best_sql('code', order, digits)} AS rk FROM m)
    SELECT round(threshold, 9) AS threshold, tp, fp, tn, fn, {BINARY_OUT}, {weights} FROM b WHERE rk = 1 ORDER BY {', '.join(final)}, code LIMIT 1"""


def _lock_row(lock, models):
    out = lock.select("threshold", "tp", "fp", "tn", "fn", *M.BINARY_METRICS, *[f"w_{m}" for m in models])
    return rounded(rounded(out, 6, skip=("threshold",)), 9)


@query("E2 J4 J15 P22", _binary_grid_sql(len(MODEL_IDS), 10, 0, False, "gt"))
def select_exhaustive(spark, sf_dir):
    """Full grid over all models with a threshold sweep per grid point."""
    aligned = S.align_scores(_train_scores(spark, sf_dir), MODEL_IDS)
    return _lock_row(S.select_weights(aligned, MODEL_IDS, 0.1), MODEL_IDS)


@query("E3", _binary_grid_sql(len(MODEL_IDS), 20, 1, True, "ge"))
def select_fixed_set(spark, sf_dir):
    """All models kept at 0.05 or more, exact ties, inclusive threshold."""
    aligned = S.align_scores(_train_scores(spark, sf_dir), MODEL_IDS)
    return _lock_row(S.select_weights(aligned, MODEL_IDS, 0.05, 0.05, mode="ge", exact_ties=True, strategy="fixed-model-set"), MODEL_IDS)


@query(
    "W9 T6",
    f"""WITH {SCORES_SQL}, scored AS (SELECT model_id, score, CAST(label = 'diagnosed' AS INT) AS pos FROM scores WHERE split = 'train'), {sweep_sql('scored', 'model_id', 'gt')},
    m AS ({binary_sql('(SELECT model_id, threshold, tp, fp, tn, fn FROM states)', 'model_id')}), b AS (SELECT * FROM m QUALIFY {best_sql('model_id', M.THRESHOLD_ORDER)} = 1)
    SELECT model_id, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, round(diagnosed_f1, 12) DESC, round(precision, 12) DESC, model_id) AS rank, {r6('macro_f1', 'macro_f1')} FROM b QUALIFY rank <= 4""",
)
def ranked_models(spark, sf_dir):
    """Single models ranked, pruned to the top four."""
    ranked = S.rank_models(_train_scores(spark, sf_dir)).where("rank <= 4")
    return rounded(ranked.select("model_id", F.col("rank").cast("bigint").alias("rank"), "macro_f1"))


_RANKED = f"""{SCORES_SQL}, scored AS (SELECT model_id, score, CAST(label = 'diagnosed' AS INT) AS pos FROM scores WHERE split = 'train'), {sweep_sql('scored', 'model_id', 'gt')},
    rm AS ({binary_sql('(SELECT model_id, threshold, tp, fp, tn, fn FROM states)', 'model_id')}), rb AS (SELECT * FROM rm QUALIFY {best_sql('model_id', M.THRESHOLD_ORDER)} = 1),
    rk AS (SELECT model_id, macro_f1, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, round(diagnosed_f1, 12) DESC, round(precision, 12) DESC, model_id) AS rank FROM rb),
    pf AS (SELECT size, rank, model_id, 1e0 / size AS equal, power(macro_f1, 4) / sum(power(macro_f1, 4)) OVER (PARTITION BY size) AS metric FROM rk, range(1, 5) r(size) WHERE rank <= size)"""


@query("W10", f"WITH {_RANKED} SELECT size, rank, model_id, {r6('equal', 'equal')}, {r6('metric', 'metric')} FROM pf")
def prefix_weights(spark, sf_dir):
    """Ranked-prefix ensembles of one to four models with both weightings."""
    c = S.prefix_candidates(S.rank_models(_train_scores(spark, sf_dir)), 4)
    flat = c.select("size", "kind", F.inline("items"))
    out = flat.groupBy("size", "rank", "model_id").agg(F.max(F.when(F.col("kind") == 0, F.col("weight"))).alias("equal"), F.max(F.when(F.col("kind") == 1, F.col("weight"))).alias("metric"))
    return rounded(out.select(F.col("size").cast("bigint").alias("size"), F.col("rank").cast("bigint").alias("rank"), "model_id", "equal", "metric"))


_PRUNED_SQL = f"""WITH {_RANKED.replace('range(1, 5)', 'range(1, 6)')},
    cd AS (SELECT size, rank, model_id, 0 AS kind, equal AS weight FROM pf UNION ALL SELECT size, rank, model_id, 1, metric FROM pf),
    bl AS (SELECT user_id, any_value(label) AS label, size * 2 + kind AS code, sum(score * weight ORDER BY rank) AS score FROM scores JOIN cd USING (model_id) WHERE split = 'train' GROUP BY user_id, size, kind),
    ps AS (SELECT code, score, CAST(label = 'diagnosed' AS INT) AS pos FROM bl),
    {sweep_sql('ps', 'code', 'gt').replace('sw_d', 'sx_d').replace('sw_c', 'sx_c').replace('states', 'pstates')},
    pm AS ({binary_sql('(SELECT code, threshold, tp, fp, tn, fn FROM pstates)', 'code')}), pb AS (SELECT * FROM pm QUALIFY {best_sql('code', M.THRESHOLD_ORDER)} = 1),
    win AS (SELECT * FROM pb ORDER BY round(macro_f1, 12) DESC, round(diagnosed_f1, 12) DESC, round(precision, 12) DESC, code LIMIT 1)
    SELECT w.code // 2 AS size, w.code % 2 AS kind, round(threshold, 6) + 0e0 AS threshold, tp, fp, tn, fn, {r6('macro_f1', 'macro_f1')},
      (SELECT string_agg(model_id || '=' || printf('%.6f', round(weight, 6)), ',' ORDER BY rank) FROM cd WHERE cd.size = w.code // 2 AND cd.kind = w.code % 2) AS weights FROM win w"""


def _weights_text(weights):
    return F.array_join(F.transform(F.map_entries(weights), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ",")


@query("E4 E7", _PRUNED_SQL)
def select_pruned(spark, sf_dir):
    """More models than the grid limit: ranked prefixes decide."""
    lock = S.select_ensemble(_train_scores(spark, sf_dir), ["m1_linear", "m2_boost", "m3_trees", "m4_seq", "m5_stack"], 0.1, "ranked-prefix")
    shown = lock.select(F.col("size").cast("bigint").alias("size"), F.col("kind").cast("bigint").alias("kind"), "threshold", "tp", "fp", "tn", "fn", "macro_f1", _weights_text("weights").alias("weights"))
    return rounded(shown)


@query(
    "E8 P22 J11",
    f"""WITH {SCORES_SQL}, w AS (SELECT user_id, max(score) FILTER (WHERE model_id = 'm1_linear') AS a, max(score) FILTER (WHERE model_id = 'm3_trees') AS b FROM scores WHERE split = 'test' GROUP BY user_id),
    s AS (SELECT user_id, (0e0 + a * 0.6e0 + b * 0.3e0) / 0.9e0 AS score FROM w) SELECT user_id, {r6('score', 'score')}, CASE WHEN score > 0.35e0 THEN 'diagnosed' ELSE 'control' END AS predicted FROM s""",
)
def locked_predictions(spark, sf_dir):
    """Lock applied to test scores, normalised by the weight sum."""
    test = scores(spark, sf_dir).where("split = 'test'")
    return rounded(S.locked_scores(test, {"m1_linear": 0.6, "m3_trees": 0.3}, 0.35, divide=True))


@query("E7", "SELECT c_custkey AS user_id, round(w0 / (w0 + w1 + w2), 6) + 0e0 AS a, CASE WHEN w1 > 1e-12 THEN round(w1 / (w0 + w1 + w2), 6) + 0e0 END AS b FROM (SELECT c_custkey, 1 + c_custkey % 7 AS w0, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END AS w1, 3 AS w2 FROM customer)")
def compacted_weights(spark, sf_dir):
    c = people(spark, sf_dir)
    w = [(1 + F.col("user_id") % 7).cast("double"), F.when(F.col("user_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(2.0)), F.lit(3.0)]
    m = c.select("user_id", S.compact_weights(["a", "b", "c"], w).alias("m"))
    return rounded(m.select("user_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")))


# --- ternary selection ---------------------------------------------------------------


def _ternary_wide(models: tuple[str, ...], keys: str) -> str:
    cols = ", ".join(f"max({p}) FILTER (WHERE model_id = '{m}') AS {p[5]}{i}" for i, m in enumerate(models) for p in S.PROBABILITIES)
    return f"tw AS (SELECT {keys}user_id, any_value(fold) AS fold, any_value(label) AS label, {cols} FROM tern WHERE split = 'train' GROUP BY ALL)"


def _ternary_grid_sql(models: tuple[str, ...], precision: int, keys: str, extra: str = "") -> str:
    """CTEs ending in ``tm``: metrics per keys, code and rule."""
    n = len(models)
    k = f"{keys}, " if keys else ""
    names = [f"u{i}" for i in range(n - 1)]
    rest = f"{precision} - " + " - ".join(names)
    code = "0"
    for i in range(n):
        code = f"({code}) * {precision + 1} + u{i}"

    def blend(letter: str) -> str:
        return "0e0 + " + " + ".join(f"{letter}{i} * (CAST(u{i} AS DOUBLE) / {precision}e0)" for i in range(n))

    rules = " UNION ALL ".join(f"SELECT {k}{extra}code, label, '{r.rule_id}' AS rule_id, {i + 1} AS rule_order, {rule_sql(r, 'd', 'c', 'n')} AS predicted FROM tb" for i, r in enumerate(RULES))
    return f"""{_ternary_wide(models, k.replace('fold, ', ''))},
    tg AS (SELECT {', '.join(names)}, {rest} AS u{n - 1} FROM {', '.join(f'range(0, {precision + 1}) r{i}(u{i})' for i in range(n - 1))} WHERE {rest} >= 0),
    tb AS (SELECT {k}{extra}{code} AS code, label, {blend('d')} AS d, {blend('c')} AS c, {blend('n')} AS n FROM tw, tg),
    tp AS ({rules}),
    tcells AS (SELECT {k}{extra}code, rule_id, rule_order, {cells_sql()} FROM tp GROUP BY ALL),
    tm AS ({ternary_sql('tcells')})"""


def _weights_out(models: tuple[str, ...], precision: int) -> str:
    n = len(models)
    return ", ".join(r6(f"((code // {(precision + 1) ** (n - 1 - i)}) % {precision + 1}) / {precision}e0", f"w_{m}") for i, m in enumerate(models))


# `no` starts with the same letter in all three names after "prob_": d, c, n.
@query("E5 E9", f"WITH {TERNARY_SQL}, {_ternary_grid_sql(MODEL_IDS, 20, 'label_policy_id')} SELECT label_policy_id, rule_id, {ORDER_OUT}, {_weights_out(MODEL_IDS, 20)} FROM tm QUALIFY row_number() OVER (PARTITION BY label_policy_id ORDER BY {TERNARY_ORDER_SQL}, code, rule_order) = 1")
def select_ternary(spark, sf_dir):
    """Best weights and rule per label policy in one job."""
    aligned = S.align_probabilities(_train_ternary(spark, sf_dir), MODEL_IDS, keys=["label_policy_id", "user_id"])
    best = S.select_ternary(aligned, MODEL_IDS, RULES, 0.05, ["label_policy_id"])
    return rounded(best.select("label_policy_id", "rule_id", *M.TERNARY_ORDER, *[f"w_{m}" for m in MODEL_IDS]))


@query("E6")
def refine_ternary(spark, sf_dir):
    """Coarse lock of all models per label policy, refined in a finer box."""
    rows = _train_ternary(spark, sf_dir)
    parts = []
    for policy in POLICIES:
        aligned = S.align_probabilities(rows.where(F.col("label_policy_id") == policy), MODEL_IDS)
        coarse = S.select_ternary(aligned, MODEL_IDS, RULES, 0.25)
        best = S.refine_ternary(aligned, MODEL_IDS, RULES, coarse, 0.05, 0.15, len(MODEL_IDS))
        parts.append(best.select(F.lit(policy).alias("label_policy_id"), "rule_id", "refined", *M.TERNARY_ORDER, *[f"w_{m}" for m in MODEL_IDS]))
    return rounded(reduce(DataFrame.unionByName, parts))


_TERNARY_PRUNED_SQL = f"""WITH {TERNARY_SQL}, tt AS (SELECT * FROM tern WHERE split = 'train'),
    r1 AS ({rules_union('tt', 'label_policy_id, model_id, label')}), r2 AS (SELECT label_policy_id, model_id, rule_id, rule_order, {cells_sql()} FROM r1 GROUP BY ALL), r3 AS ({ternary_sql('r2')}),
    r4 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY label_policy_id, model_id ORDER BY {TERNARY_ORDER_SQL}, rule_order) = 1),
    rk AS (SELECT label_policy_id, model_id, macro_f1, row_number() OVER (PARTITION BY label_policy_id ORDER BY {TERNARY_ORDER_SQL}, model_id) AS rank FROM r4),
    pf AS (SELECT label_policy_id, size, rank, model_id, 1e0 / size AS equal, power(macro_f1, 4) / sum(power(macro_f1, 4)) OVER (PARTITION BY label_policy_id, size) AS metric FROM rk, range(1, 6) r(size) WHERE rank <= size),
    cd AS (SELECT label_policy_id, size, rank, model_id, 0 AS kind, equal AS weight FROM pf UNION ALL SELECT label_policy_id, size, rank, model_id, 1, metric FROM pf),
    bl AS (SELECT label_policy_id, user_id, any_value(label) AS label, size, kind, {', '.join(f'sum({c} * weight ORDER BY rank) AS {c}' for c in S.PROBABILITIES)} FROM tt JOIN cd USING (label_policy_id, model_id) GROUP BY label_policy_id, user_id, size, kind),
    b1 AS ({rules_union('bl', 'label_policy_id, size, kind, label')}), b2 AS (SELECT label_policy_id, size, kind, rule_id, rule_order, {cells_sql()} FROM b1 GROUP BY ALL), b3 AS ({ternary_sql('b2')}),
    win AS (SELECT * FROM b3 QUALIFY row_number() OVER (PARTITION BY label_policy_id ORDER BY {TERNARY_ORDER_SQL}, size, kind, rule_order) = 1)
    SELECT label_policy_id, CAST(size AS BIGINT) AS size, CAST(kind AS BIGINT) AS kind, rule_id, {ORDER_OUT}, (SELECT string_agg(model_id || '=' || printf('%.6f', round(weight, 6)), ',' ORDER BY rank) FROM cd WHERE cd.label_policy_id = win.label_policy_id AND cd.size = win.size AND cd.kind = win.kind) AS weights FROM win"""


@query("E5", _TERNARY_PRUNED_SQL)
def select_ternary_pruned(spark, sf_dir):
    """Ranked prefixes of all models, per label policy."""
    lock = S.select_ternary_pruned(_train_ternary(spark, sf_dir), MODEL_IDS, RULES, keys=["label_policy_id"])
    shown = lock.select("label_policy_id", F.col("size").cast("bigint").alias("size"), F.col("kind").cast("bigint").alias("kind"), "rule_id", *M.TERNARY_ORDER, _weights_text("weights").alias("weights"))
    return rounded(shown)


GROUPS = {
    "all_models": list(MODEL_IDS),
    "boosting": ["m2_boost"],
    "linear_and_trees": ["m1_linear", "m3_trees"],
    "absent": ["m9_none"],
}


def _group_sql(group: str, models: tuple[str, ...], precision: int) -> str:
    """Best lock of one group per policy, as a subquery with its own CTEs."""
    if len(models) == 1:
        body = f"gp AS ({rules_union(f'(SELECT * FROM tern WHERE split = {chr(39)}train{chr(39)} AND model_id = {chr(39)}{models[0]}{chr(39)})', 'label_policy_id, 0 AS code, label')}), gc AS (SELECT label_policy_id, code, rule_id, rule_order, {cells_sql()} FROM gp GROUP BY ALL), tm AS ({ternary_sql('gc')})"
    else:
        body = _ternary_grid_sql(models, precision, "label_policy_id")
    return f"(WITH {body} SELECT label_policy_id, '{group}' AS group_id, rule_id, {', '.join(M.TERNARY_ORDER)} FROM tm QUALIFY row_number() OVER (PARTITION BY label_policy_id ORDER BY {TERNARY_ORDER_SQL}, code, rule_order) = 1)"


_LOCKS_SQL = f"WITH {TERNARY_SQL}, locks AS (" + " UNION ALL ".join(f"SELECT * FROM {_group_sql(g, tuple(sorted(m)), 4)}" for g, m in GROUPS.items() if g != "absent") + ")"


@query("E9 E12", f"{_LOCKS_SQL} SELECT l.label_policy_id, l.group_id, l.rule_id, {', '.join(r6('l.' + c, c) for c in M.TERNARY_ORDER)}, {r6('l.macro_f1 - f.macro_f1', 'delta_macro_f1')} FROM locks l JOIN locks f ON f.label_policy_id = l.label_policy_id AND f.group_id = 'all_models'")
def family_ablation(spark, sf_dir):
    """Selection per group and policy with the difference to all models."""
    locks = S.select_groups(_train_ternary(spark, sf_dir), GROUPS, MODEL_IDS, RULES, 0.25, ["label_policy_id"])
    out = S.ablation(locks, ["label_policy_id"])
    return rounded(out.select("label_policy_id", "group_id", "rule_id", *M.TERNARY_ORDER, "delta_macro_f1"))


@query("E9", f"{_LOCKS_SQL} SELECT label_policy_id, group_id, rule_id, {ORDER_OUT} FROM locks ORDER BY {TERNARY_ORDER_SQL}, label_policy_id, group_id LIMIT 1")
def champion_lock(spark, sf_dir):
    """Best lock over policies and groups."""
    locks = S.select_groups(_train_ternary(spark, sf_dir), GROUPS, MODEL_IDS, RULES, 0.25, ["label_policy_id"])
    return rounded(S.champion(locks, ["label_policy_id", "group_id"]).select("label_policy_id", "group_id", "rule_id", *M.TERNARY_ORDER))


_NESTED_SQL = f"""WITH {TERNARY_SQL}, {_ternary_grid_sql(MODEL_IDS, 10, 'label_policy_id, fold')},
    inner_c AS (SELECT label_policy_id, h AS heldout_fold, code, rule_id, rule_order, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in CELLS)} FROM tcells, range(1, 6) r(h) WHERE fold <> h GROUP BY ALL),
    inner_m AS ({ternary_sql('inner_c')}), ch AS (SELECT label_policy_id, heldout_fold, code, rule_id, macro_f1 AS inner_macro FROM inner_m QUALIFY row_number() OVER (PARTITION BY label_policy_id, heldout_fold ORDER BY {TERNARY_ORDER_SQL}, code, rule_order) = 1)
    SELECT ch.label_policy_id, ch.heldout_fold, ch.rule_id, {r6('inner_macro', 'inner_macro_f1')}, {_weights_out(MODEL_IDS, 10).replace('(code //', '(ch.code //')}, {ORDER_OUT} FROM ch JOIN tm ON tm.label_policy_id = ch.label_policy_id AND tm.fold = ch.heldout_fold AND tm.code = ch.code AND tm.rule_id = ch.rule_id"""


def _nested(spark, sf_dir):
    rows = S.align_probabilities(_train_ternary(spark, sf_dir), MODEL_IDS, keys=["label_policy_id", "user_id"])
    return S.nested_selection(rows, MODEL_IDS, RULES, 0.1, FOLDS, ["label_policy_id"])


@query("E10 A22 J21", _NESTED_SQL)
def nested_selection(spark, sf_dir):
    """Choose weights of all models on four folds, evaluate on the fifth, for every fold and label policy."""
    out = _nested(spark, sf_dir)
    return rounded(out.withColumn("heldout_fold", F.col("heldout_fold").cast("bigint")))


@query("A22", f"WITH ns AS ({_NESTED_SQL}) SELECT label_policy_id, 'macro_f1' AS what, printf('%.4f', avg(macro_f1)) AS value, count(*) AS n FROM ns GROUP BY label_policy_id UNION ALL SELECT label_policy_id, 'rule_id', rule_id, count(*) FROM ns GROUP BY label_policy_id, rule_id")
def nested_selection_summary(spark, sf_dir):
    """Held-out statistics over folds per label policy and how often each rule was chosen."""
    out, keys = _nested(spark, sf_dir), ["label_policy_id"]
    stats = M.scalar_stats(out, keys, ["macro_f1"]).select(*keys, F.lit("macro_f1").alias("what"), F.format_string("%.4f", "macro_f1_mean").alias("value"), F.col("combinations").alias("n"))
    return stats.unionByName(S.selection_counts(out, ["rule_id"], keys))


# --- policies ------------------------------------------------------------------------

LABEL_POLICIES = (
    LabelPolicy("rel7_zero", "rel_count_zero", relevance_threshold=7),
    LabelPolicy("thin", "low_density", density_threshold=0.4),
    LabelPolicy("weak_top", "top10_avg_lt", top10_avg_threshold=7.0, applies_to="both_classes"),
    LabelPolicy("q30", "evidence_quantile", quantile=0.3),
    LabelPolicy("q50_both", "evidence_quantile", quantile=0.5, applies_to="both_classes"),
)

_MARKED = f"""{TIMELINE_SQL}, {markers_cte('tl')}, {PEOPLE_SQL},
    lm AS (SELECT markers.*, CASE WHEN balance < 4000 THEN 'diagnosed' ELSE 'control' END AS binary_label FROM markers JOIN people USING (user_id))"""


def _marked(spark, sf_dir):
    label = F.when(F.col("balance") < 4000, F.lit("diagnosed")).otherwise(F.lit("control"))
    return TL.evidence_markers(timeline(spark, sf_dir, indexed=False)).join(people(spark, sf_dir).select("user_id", label.alias("binary_label")), "user_id")


@query(
    "A15",
    f"""WITH {_MARKED} SELECT 'q30' AS policy_id, NULL AS binary_label, {r6('quantile_cont(evidence_score, 0.3)', 'cutoff')} FROM lm WHERE binary_label = 'diagnosed'
    UNION ALL SELECT 'q50_both', binary_label, round(quantile_cont(evidence_score, 0.5), 6) + 0e0 FROM lm GROUP BY binary_label""",
)
def policy_cutoffs(spark, sf_dir):
    return rounded(SP.policy_cutoffs(_marked(spark, sf_dir), LABEL_POLICIES))


@query(
    "P19 J20 J14",
    f"""WITH {_MARKED}, c AS (SELECT *, (SELECT quantile_cont(evidence_score, 0.3) FROM lm WHERE binary_label = 'diagnosed') AS q30,
      quantile_cont(evidence_score, 0.5) OVER (PARTITION BY binary_label) AS q50 FROM lm),
    l AS (SELECT user_id, binary_label, 'rel7_zero' AS label_policy_id, rel7_count = 0 AND binary_label <> 'control' AS ne FROM c
      UNION ALL SELECT user_id, binary_label, 'thin', rel3_ratio <= 0.4 AND binary_label <> 'control' FROM c
      UNION ALL SELECT user_id, binary_label, 'weak_top', top10_avg_relevance < 7 FROM c
      UNION ALL SELECT user_id, binary_label, 'q30', evidence_score <= q30 AND binary_label <> 'control' FROM c
      UNION ALL SELECT user_id, binary_label, 'q50_both', evidence_score <= q50 FROM c)
    SELECT user_id, binary_label, label_policy_id, CASE WHEN ne THEN 'no-evidence' ELSE binary_label END AS label FROM l""",
)
def policy_labels(spark, sf_dir):
    """Every user's label under every policy."""
    rows = _marked(spark, sf_dir)
    cutoffs = SP.cutoff_map(SP.policy_cutoffs(rows, LABEL_POLICIES))
    return SP.label_per_policy(rows, LABEL_POLICIES, cutoffs).select("user_id", "binary_label", "label_policy_id", "label")


_HASHED = f"""mf AS (SELECT user_id, binary_label, sha256('timeline|train|' || binary_label || '|' || user_id) AS parent, rel7_count, top10_avg_relevance FROM lm),
    tl2 AS (SELECT *, 'rel7_zero' AS label_policy_id, CASE WHEN rel7_count = 0 AND binary_label <> 'control' THEN 'no-evidence' ELSE binary_label END AS label FROM mf
      UNION ALL SELECT *, 'weak_top', CASE WHEN top10_avg_relevance < 7 THEN 'no-evidence' ELSE binary_label END FROM mf)"""


@query(
    "E13 W5 P5",
    f"""WITH {_MARKED}, {_HASHED}
    SELECT 'timeline' AS dataset, 'train' AS split, label, binary_label, user_id, sha256(parent || '|' || label_policy_id || '|' || label) AS row_hash, label_policy_id,
      (row_number() OVER (PARTITION BY label_policy_id, label ORDER BY sha256('42|' || label || '|' || user_id), user_id) - 1) % 5 + 1 AS fold FROM tl2""",
)
def ternary_manifests(spark, sf_dir):
    """Labels, folds and hashes for two policies in one job."""
    from ..functions.hashing import row_hash

    rows = _marked(spark, sf_dir)
    train = rows.select(F.lit("timeline").alias("dataset"), F.lit("train").alias("split"), "user_id", F.col("binary_label").alias("label"), row_hash("timeline", "train", F.col("binary_label"), F.col("user_id")).alias("row_hash"))
    policies = [p for p in LABEL_POLICIES if p.policy_id in ("rel7_zero", "weak_top")]
    out = SP.ternary_manifests(train, rows.drop("binary_label"), policies, 5, 42)
    return out.withColumn("fold", F.col("fold").cast("bigint"))
