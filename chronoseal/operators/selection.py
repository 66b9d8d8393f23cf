"""Weight grids, blends and ensemble selection on out-of-fold scores.

Scores come in long form (``user_id, label, fold, model_id, score`` or three
probabilities). They are aligned once per user into arrays in model order; every
grid point is generated beside the row, never joined, and only counts leave the
map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import DecisionRule, decide, decide_ternary
from ..session import written
from .grids import ternary_grid_cells
from .metrics import (
    EQUAL_DIGITS,
    SELECTION_ORDER,
    TERNARY_ORDER,
    add_ternary_metrics,
    decision_counts,
    order_by_metrics,
    rule_metrics,
)
from .ranking import best_per_key
from .sweep import best_threshold, pick_best, sweep_cuts

PROBABILITIES = ("prob_diagnosed", "prob_control", "prob_no_evidence")


# --- alignment -----------------------------------------------------------------------


def align_scores(
    scores: DataFrame,
    models: Sequence[str],
    values: Sequence[str] = ("score",),
    keep: Sequence[str] = ("label", "fold"),
    keys: Sequence[str] = ("user_id",),
) -> DataFrame:
    """One row per user: each value column becomes an array in the order of ``models``.

    Every user needs exactly one score of every model, and one value of each kept column. The plan raises at the
    first user where that fails; :func:`chronoseal.operators.alignment.alignment_findings` lists them all.
    """
    wanted = scores.where(F.col("model_id").isin(*models))
    names = [v if v != "score" else "scores" for v in values]
    cells = [(f"__v{i}_{j}", v, m) for i, v in enumerate(values) for j, m in enumerate(models)]
    # Grouped by the kept columns first: numbers alone are hashed, and only a row per user, not per score, is sorted for
    # the largest and smallest text.
    first = wanted.groupBy(*keys, *keep).agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.when(F.col("model_id") == m, F.col(v))).alias(c) for c, v, m in cells])
    highs, lows = [F.max(k).alias(f"__high_{k}") for k in keep], [F.min(k).alias(f"__low_{k}") for k in keep]
    whole = first.groupBy(*keys).agg(*highs, *lows, F.sum("__n").alias("__n"), *[F.max(c).alias(c) for c, _, _ in cells])
    arrays = [F.array(*[F.col(f"__v{i}_{j}") for j in range(len(models))]).alias(n) for i, n in enumerate(names)]
    per = whole.select(*keys, *[F.col(f"__high_{k}").alias(k) for k in keep], *arrays, "__n", *[f"__low_{k}" for k in keep])
    missing = F.lit(False)
    for n in names:
        missing = missing | F.exists(n, lambda x: x.isNull())
    code = F.when(missing, F.lit("align-missing-score")).when(F.col("__n") > len(models), F.lit("align-duplicate-score"))
    for k in keep:
        code = code.when(F.col(f"__low_{k}") != F.col(k), F.lit(f"align-{k}-mismatch"))
    who = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    checked = [F.when(code.isNull(), F.col(n)).otherwise(F.raise_error(F.concat(code, F.lit(" "), who)).cast(per.schema[n].dataType)).alias(n) for n in names]
    return per.select(*keys, *keep, *checked)


# --- grids ---------------------------------------------------------------------------


def grid_size(models: int, precision: int, minimum: int = 0) -> int:
    free = precision - models * minimum
    return comb(free + models - 1, models - 1) if free >= 0 else 0


def _check_step(step: float) -> int:
    precision = round(1 / step)
    if abs(precision * step - 1) > 1e-9:
        raise ValueError(f"weight step must divide 1 exactly: {step}")
    return precision


def with_grid(df: DataFrame, ranges: Sequence[tuple[int, int]], precision: int) -> DataFrame:
    """Add unit columns ``u0..`` for every integer point of the box that sums to ``precision``.

    The points are generated row by row in lexicographic order.
    """
    used = F.lit(0)
    out = df
    for i, (low, high) in enumerate(ranges[:-1]):
        low_after = sum(r[0] for r in ranges[i + 1 :])
        first = F.lit(low)
        last = F.least(F.lit(high), F.lit(precision - low_after) - used)
        points = F.when(last >= first, F.sequence(first, F.greatest(last, first)))
        out = out.withColumn(f"u{i}", F.explode(points))
        used = used + F.col(f"u{i}")
    rest = (F.lit(precision) - used).cast("int")
    n = len(ranges) - 1
    low, high = ranges[n]
    return out.withColumn(f"u{n}", rest).where((F.col(f"u{n}") >= low) & (F.col(f"u{n}") <= high))


def simplex(models: int, precision: int, minimum: int = 0) -> list[tuple[int, int]]:
    if minimum * models > precision:
        raise ValueError("minimum ensemble weight is infeasible")
    return [(minimum, precision)] * models


def weight_grid(spark, models: int, step: float, minimum: float = 0.0) -> DataFrame:
    """All weight vectors of the simplex as a table ``u0.., w0..``."""
    precision = _check_step(step)
    grid = with_grid(spark.range(1).select(), simplex(models, precision, round(minimum * precision)), precision)
    return grid.select("*", *[(F.col(f"u{i}") / F.lit(float(precision))).alias(f"w{i}") for i in range(models)])


def _code(models: int, precision: int) -> Column:
    """Grid point as one number whose order is the lexicographic order of the units."""
    if models * log2(precision + 1) >= 62:
        raise ValueError("grid too fine for this many models")
    code = F.lit(0).cast("bigint")
    for i in range(models):
        code = code * F.lit(precision + 1) + F.col(f"u{i}")
    return code


def _decode(models: int, precision: int) -> list[Column]:
    return [F.expr(f"CAST((code DIV {(precision + 1) ** (models - 1 - i)}) % {precision + 1} AS INT)") for i in range(models)]


def blend(array: str, weights: Sequence[Column]) -> Column:
    """Weighted sum in model order (a fixed order keeps the sum reproducible)."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.col(array)[i] * w
    return total


def _unit_weights(models: int, precision: int, product: bool) -> list[Column]:
    if product:
        return [F.col(f"u{i}").cast("double") * F.lit(1.0 / precision) for i in range(models)]
    return [F.col(f"u{i}").cast("double") / F.lit(float(precision)) for i in range(models)]


def compact_weights(models: Sequence[str], weights: Sequence[Column], digits: int = 6) -> Column:
    """Map of the weights above 1e-12, renormalised and rounded."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(m).alias("m"), w.alias("w")) for m, w in zip(models, weights)]),
        lambda e: e["w"] > 1e-12,
    )
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"])
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["m"], F.round(e["w"] / total, digits))))


# --- binary --------------------------------------------------------------------------


def _binary_grid(aligned: DataFrame, models: Sequence[str], precision: int, ranges: Sequence[tuple[int, int]], product: bool) -> DataFrame:
    """Blends of every grid point; users with the same label and scores are one row of weight ``n``.

    The rows are counted and written once, so that neither the alignment nor equal rows are repeated per point and pass.
    """
    n = len(models)
    merged = written(aligned.groupBy("label", "scores").agg(F.count(F.lit(1)).alias("n")))
    # The work per row is thousands of blends, so a few megabytes of rows are dealt to all cores, not read by one task.
    dealt = merged.repartition(2 * aligned.sparkSession.sparkContext.defaultParallelism, "label", "scores")
    grown = with_grid(dealt, ranges, precision)
    return grown.select("label", "n", _code(n, precision).alias("code"), blend("scores", _unit_weights(n, precision, product)).alias("score"))


def select_weights(
    aligned: DataFrame,
    models: Sequence[str],
    step: float,
    minimum: float = 0.0,
    mode: str = "gt",
    exact_ties: bool = False,
    strategy: str = "exhaustive",
    bins: int = 128,
) -> DataFrame:
    """One-row lock: best grid weights and threshold for binary scores.

    ``exact_ties`` follows the corpus variant: metrics compare exactly, then the
    lower threshold wins, then the smaller weight vector. Otherwise metrics
    within 1e-12 tie and the first weight vector wins.
    """
    n, precision = len(models), _check_step(step)
    ranges = simplex(n, precision, round(minimum * precision))
    scored = _binary_grid(aligned, models, precision, ranges, exact_ties)
    cuts = sweep_cuts(scored, ["code"], mode=mode, weight=F.col("n"), prune="all", bins=bins)
    if exact_ties:
        per = pick_best(cuts, ["code"], SELECTION_ORDER, None)
        best = pick_best(per.select("code", "threshold", "tp", "fp", "tn", "fn"), [], SELECTION_ORDER, None, prefer=[-F.col("threshold"), -F.col("code")])
    else:
        per = pick_best(cuts, ["code"])
        best = pick_best(per.select("code", "threshold", "tp", "fp", "tn", "fn"), [], SELECTION_ORDER, prefer=[-F.col("code")])
    units = best.select("*", *[u.alias(f"u{i}") for i, u in enumerate(_decode(n, precision))])
    weights = _unit_weights(n, precision, exact_ties)
    lock = units.select("*", *[w.alias(f"w_{m}") for m, w in zip(models, weights)])
    return lock.withColumn("weights", compact_weights(models, weights)).withColumn("strategy", F.lit(strategy)).drop("code", *[f"u{i}" for i in range(n)])


def rank_models(scores: DataFrame) -> DataFrame:
    """Best threshold of each model, ranked by the selection order and model id."""
    best = best_threshold(scores, ["model_id"])
    order = order_by_metrics(SELECTION_ORDER, F.col("model_id").asc())
    # One row per model.
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def prefix_candidates(ranked: DataFrame, max_models: int, prune_to: int = 16, metric: str = "macro_f1", keys: Sequence[str] = ()) -> DataFrame:
    """Ranked prefixes of size 1..max with equal and macroF1^4 weights, per ``keys``.

    Rows: the keys, ``size, kind, items`` with ``items`` in rank order; ``kind`` 0 is equal, 1 is metric weighted.
    """
    kept = ranked.where(F.col("rank") <= min(prune_to, max_models))
    limit = F.lit(min(prune_to, max_models)).cast("int")
    grown = kept.withColumn("size", F.explode(F.sequence(F.col("rank").cast("int"), limit)))
    raw = F.pow(F.greatest(F.col(metric), F.lit(1e-12)), F.lit(4.0))
    per_size = W.partitionBy(*keys, "size")
    full = F.count(F.lit(1)).over(per_size) == F.col("size")
    weighted = grown.select(*keys, "size", "rank", "model_id", (F.lit(1.0) / F.col("size")).alias("equal"), (raw / F.sum(raw).over(per_size)).alias("metric"), full.alias("full")).where("full")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("equal").alias("weight")), F.struct(F.lit(1).alias("kind"), F.col("metric").alias("weight"))))
    spread = weighted.select(*keys, "size", "rank", "model_id", kinds.alias("k")).select(*keys, "size", "rank", "model_id", "k.kind", "k.weight")
    return spread.groupBy(*keys, "size", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "model_id", "weight"))).alias("items"))


def _with_candidates(aligned: DataFrame, candidates: DataFrame, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Repeat each row per candidate of its ``keys``; the candidate list of a key is one small row (2 * max models)."""
    position = F.map_from_arrays(F.array(*[F.lit(m) for m in models]), F.array(*[F.lit(i + 1) for i in range(len(models))]))
    items = F.transform("items", lambda i: F.struct(position[i["model_id"]].alias("at"), i["weight"].alias("w")))
    listed = F.array_sort(F.collect_list(F.struct("size", "kind", "items"))).alias("__c")
    packed = candidates.select(*keys, "size", "kind", items.alias("items")).groupBy(*keys).agg(listed)
    grown = aligned.join(packed, list(keys)) if keys else aligned.withColumn("__c", packed.scalar())
    return grown.withColumn("__one", F.explode("__c")).select("*", "__one.*").drop("__c", "__one")


def _blend_items(array: str) -> Column:
    return F.aggregate("items", F.lit(0.0), lambda acc, i: acc + F.element_at(F.col(array), i["at"]) * i["w"])


def select_pruned(scores: DataFrame, aligned: DataFrame, models: Sequence[str], max_models: int = 8, prune_to: int = 16) -> DataFrame:
    """One-row lock from ranked prefixes, for more models than a full grid can hold."""
    ranked = rank_models(scores.where(F.col("model_id").isin(*models)))
    candidates = prefix_candidates(ranked, min(max_models, len(models)), prune_to)
    scored = _with_candidates(aligned.select("label", "scores"), candidates, models).select("label", "size", "kind", _blend_items("scores").alias("score"))
    per = pick_best(sweep_cuts(scored, ["size", "kind"]), ["size", "kind"])
    best = pick_best(per.select("size", "kind", "threshold", "tp", "fp", "tn", "fn"), [], SELECTION_ORDER, prefer=[-F.col("size"), -F.col("kind")])
    chosen = best.join(candidates, ["size", "kind"])
    weights = F.map_from_entries(F.transform("items", lambda i: F.struct(i["model_id"], F.round(i["weight"], 6))))
    return chosen.select("*", weights.alias("weights")).drop("items").withColumn("strategy", F.lit(f"ranked-prefix-pruned(max={max_models})"))


def select_ensemble(
    scores: DataFrame,
    models: Sequence[str],
    step: float,
    strategy: str,
    max_models: int = 8,
    prune_to: int = 16,
) -> DataFrame:
    """One-row lock by the full grid (``exhaustive``) or by ranked prefixes (``ranked-prefix``), as the caller says."""
    if strategy not in ("exhaustive", "ranked-prefix"):
        raise ValueError(f"unknown strategy: {strategy}")
    ordered = sorted(models)
    aligned = align_scores(scores, ordered)
    if strategy == "exhaustive":
        return select_weights(aligned, ordered, step)
    return select_pruned(scores, aligned, ordered, max_models, prune_to)


def locked_scores(
    scores: DataFrame,
    weights: dict[str, float],
    threshold: float,
    keep: Sequence[str] = (),
    inclusive: bool = False,
    divide: bool = False,
) -> DataFrame:
    """Score and predict with a lock. ``divide`` normalises by the weight sum."""
    models = sorted(weights)
    aligned = align_scores(scores, models, keep=keep)
    score = blend("scores", [F.lit(float(weights[m])) for m in models])
    if divide:
        score = score / F.lit(float(sum(weights.values())))
    scored = aligned.select("user_id", *keep, score.alias("score"))
    return scored.withColumn("predicted", decide("score", threshold, inclusive))


# --- ternary -------------------------------------------------------------------------


def align_probabilities(scores: DataFrame, models: Sequence[str], keep: Sequence[str] = ("label", "fold"), keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return align_scores(scores, models, PROBABILITIES, keep, keys)


def locked_probabilities(aligned: DataFrame, models: Sequence[str], weights: dict[str, float], keep: Sequence[str] = ("label", "fold"), keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Blended probabilities of a locked ternary ensemble."""
    ws = [F.lit(float(weights.get(m, 0.0))) for m in models]
    return aligned.select(*keys, *keep, *[blend(p, ws).alias(p) for p in PROBABILITIES])


def predict_locked_ternary(aligned: DataFrame, models: Sequence[str], weights: dict[str, float], rule: DecisionRule, keep: Sequence[str] = ()) -> DataFrame:
    blended = locked_probabilities(aligned, models, weights, keep)
    return blended.withColumn("predicted", decide_ternary(*PROBABILITIES, rule))


def _ternary_grid_metrics(
    aligned: DataFrame,
    models: Sequence[str],
    rules: Sequence[DecisionRule],
    ranges: Sequence[tuple[int, int]],
    precision: int,
    keys: Sequence[str],
) -> DataFrame:
    _code(len(models), precision)
    metrics = add_ternary_metrics(ternary_grid_cells(aligned, rules, ranges, precision, keys, PROBABILITIES))
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    return metrics.withColumn("rule_order", F.array_position(ids, F.col("rule_id")).cast("int"))


def _best_ternary(metrics: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best row per keys under the ternary order, by one ``max_by``."""
    payload = [c for c in metrics.columns if c not in keys]
    order = F.struct(
        *[F.round(F.col(m), EQUAL_DIGITS).alias(f"o{i}") for i, m in enumerate(TERNARY_ORDER)],
        *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(tie)],
    )
    return metrics.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("b")).select(*keys, "b.*")


def select_ternary(
    aligned: DataFrame,
    models: Sequence[str],
    rules: Sequence[DecisionRule],
    step: float,
    keys: Sequence[str] = (),
    ranges: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Best weights and rule per ``keys`` (for example per policy, or per held-out fold)."""
    n, precision = len(models), _check_step(step)
    metrics = _ternary_grid_metrics(aligned, models, rules, ranges or simplex(n, precision), precision, keys)
    best = _best_ternary(metrics, keys, ["code", "rule_order"])
    units = best.select("*", *[u.alias(f"u{i}") for i, u in enumerate(_decode(n, precision))])
    weights = _unit_weights(n, precision, False)
    out = units.select("*", *[w.alias(f"w_{m}") for m, w in zip(models, weights)])
    return out.withColumn("weights", compact_weights(models, weights)).drop("code", "rule_order", *[f"u{i}" for i in range(n)])


def refine_ternary(
    aligned: DataFrame,
    models: Sequence[str],
    rules: Sequence[DecisionRule],
    coarse: DataFrame,
    step: float,
    radius: float,
    max_models: int,
) -> DataFrame:
    """Search a finer box around a coarse one-row lock; keep the coarse lock unless beaten.

    A lock of one model has nothing to refine, and one of more than ``max_models`` is left as it is; either way the
    row states so in ``refined``.

    The lock is one row and is read to the driver to size the box.
    """
    row = coarse.first()
    kept = {m: w for m, w in row["weights"].items() if w > 1e-12}
    if not 2 <= len(kept) <= max_models:
        return coarse.withColumn("refined", F.lit(0))
    precision = _check_step(step)
    names = [m for m in models if m in kept]
    at = [list(models).index(m) for m in names]
    total = sum(row[f"w_{m}"] for m in names)
    ranges = []
    for m in names:
        w = row[f"w_{m}"] / total
        low, high = (w - radius) * precision, (w + radius) * precision
        ranges.append((max(0, int(low // 1)), min(precision, -int(-high // 1))))
    narrowed = aligned.select("label", *[F.array(*[F.col(p)[i] for i in at]).alias(p) for p in PROBABILITIES])
    refined = select_ternary(narrowed, names, rules, step, ranges=ranges)
    padded = refined.select("*", *[F.lit(0.0).alias(f"w_{m}") for m in models if m not in kept]).withColumn("refined", F.lit(1))
    both = coarse.withColumn("refined", F.lit(0)).unionByName(padded)
    return _best_ternary(both, [], ["refined"])


def rank_ternary_models(scores: DataFrame, rules: Sequence[DecisionRule], keys: Sequence[str] = ()) -> DataFrame:
    """Best rule of each model, ranked within ``keys``."""
    counts = decision_counts(scores, rules, [*keys, "model_id"])
    metrics = rule_metrics(counts, [*keys, "model_id"])
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    best = _best_ternary(metrics.withColumn("rule_order", F.array_position(ids, F.col("rule_id")).cast("int")), [*keys, "model_id"], ["rule_order"])
    order = order_by_metrics(TERNARY_ORDER, F.col("model_id").asc())
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def select_ternary_pruned(scores: DataFrame, models: Sequence[str], rules: Sequence[DecisionRule], max_models: int = 8, prune_to: int = 16, keys: Sequence[str] = ()) -> DataFrame:
    """Ranked-prefix selection for more models than a full grid can hold, per ``keys``."""
    ordered = sorted(models)
    ranked = rank_ternary_models(scores.where(F.col("model_id").isin(*ordered)), rules, keys)
    candidates = prefix_candidates(ranked, min(max_models, len(ordered)), prune_to, keys=keys)
    grown = _with_candidates(align_probabilities(scores, ordered, keys=[*keys, "user_id"]).select(*keys, "label", *PROBABILITIES), candidates, ordered, keys)
    blended = grown.select(*keys, "label", "size", "kind", *[_blend_items(p).alias(p) for p in PROBABILITIES])
    metrics = rule_metrics(decision_counts(blended, rules, [*keys, "size", "kind"]), [*keys, "size", "kind"])
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    best = _best_ternary(metrics.withColumn("rule_order", F.array_position(ids, F.col("rule_id")).cast("int")), keys, ["size", "kind", "rule_order"])
    weights = F.map_from_entries(F.transform("items", lambda i: F.struct(i["model_id"], F.round(i["weight"], 6))))
    return best.join(candidates, [*keys, "size", "kind"]).select("*", weights.alias("weights")).drop("items", "rule_order")


def select_groups(
    scores: DataFrame,
    groups: dict[str, Sequence[str]],
    available: Sequence[str],
    rules: Sequence[DecisionRule],
    step: float,
    keys: Sequence[str] = (),
    exhaustive_limit: int = 6,
) -> DataFrame:
    """Best lock per selection group (and per ``keys``, such as the policy).

    Groups are configuration; those without an available model are skipped. A
    group above ``exhaustive_limit`` models is selected by ranked prefixes.
    """
    out = None
    for group_id in sorted(groups):
        models = sorted(m for m in groups[group_id] if m in set(available))
        if not models:
            continue
        if len(models) > exhaustive_limit:
            lock = select_ternary_pruned(scores, models, rules, keys=keys)
        else:
            lock = select_ternary(align_probabilities(scores, models, keys=[*keys, "user_id"]), models, rules, step, keys)
        row = lock.select(
            *keys,
            F.lit(group_id).alias("group_id"),
            "rule_id",
            *TERNARY_ORDER,
            "weights",
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no selection group has an available model")
    return out


def champion(locks: DataFrame, ties: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Best lock over policies and groups."""
    return best_per_key(locks, keys, order_by_metrics(TERNARY_ORDER, *[F.col(t).asc() for t in ties]))


def ablation(locks: DataFrame, keys: Sequence[str] = (), full: str = "all_models") -> DataFrame:
    """Macro F1 difference of each group to the group of all models."""
    base = locks.where(F.col("group_id") == full).select(*keys, F.col("macro_f1").alias("__full"))
    joined = locks.join(F.broadcast(base), list(keys)) if keys else locks.withColumn("__full", base.select("__full").scalar())
    return joined.withColumn("delta_macro_f1", F.col("macro_f1") - F.col("__full")).drop("__full")


def leaderboard(scores: DataFrame, rules: Sequence[DecisionRule], keys: Sequence[str] = ("label_policy_id", "model_id")) -> DataFrame:
    """Metrics of every key and rule with a rank inside the whole board (one row per key and rule)."""
    metrics = rule_metrics(decision_counts(scores, rules, keys), keys)
    order = order_by_metrics(TERNARY_ORDER, *[F.col(k).asc() for k in keys], F.col("rule_id").asc())
    return metrics.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def board_summary(board: DataFrame, key: str) -> DataFrame:
    """Per key: entries, best macro F1 and the means over entries."""
    return board.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"),
        F.max("macro_f1").alias("best_macro_f1"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.avg("diagnosed_f1").alias("mean_diagnosed_f1"),
        F.avg("diagnosed_precision").alias("mean_diagnosed_precision"),
    )


def robustness_order(policy: str = "label_policy_id", model: str = "model_id") -> list[Column]:
    """Mean, then minimum over fold subsets, then the overall order, then the ids."""
    head = [F.round(F.col(c), EQUAL_DIGITS).desc() for c in ("macro_f1_mean", "macro_f1_min")]
    return head + order_by_metrics(TERNARY_ORDER, F.col(policy).asc(), F.col(model).asc(), F.col("rule_id").asc())


def nested_selection(
    aligned: DataFrame,
    models: Sequence[str],
    rules: Sequence[DecisionRule],
    step: float,
    folds: Sequence[int],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per held-out fold: choose weights and rule on the other folds, evaluate on the held-out one,
    for each of ``keys``.

    Confusion counts add up over folds, so the grid runs once over all rows; the
    counts of the other folds choose, those of the held-out fold evaluate.
    """
    n, precision = len(models), _check_step(step)
    _code(n, precision)
    cells = ternary_grid_cells(aligned, rules, simplex(n, precision), precision, [*keys, "fold"], PROBABILITIES)
    cell_names = [c for c in cells.columns if c.startswith("n_")]
    outer = F.explode(F.array(*[F.lit(f) for f in folds]))
    spread = cells.withColumn("heldout_fold", outer)
    inner = spread.where("fold <> heldout_fold").groupBy(*keys, "heldout_fold", "code", "rule_id").agg(*[F.sum(c).alias(c) for c in cell_names])
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    ranked = add_ternary_metrics(inner).withColumn("rule_order", F.array_position(ids, F.col("rule_id")).cast("int"))
    chosen = _best_ternary(ranked, [*keys, "heldout_fold"], ["code", "rule_order"]).select(*keys, "heldout_fold", "code", "rule_id", F.col("macro_f1").alias("inner_macro_f1"))
    held = add_ternary_metrics(spread.where("fold = heldout_fold").drop("fold"))
    joined = held.join(F.broadcast(chosen), [*keys, "heldout_fold", "code", "rule_id"])
    units = joined.select("*", *[u.alias(f"u{i}") for i, u in enumerate(_decode(n, precision))])
    return units.select(
        *keys,
        "heldout_fold",
        "rule_id",
        "inner_macro_f1",
        *[w.alias(f"w_{m}") for m, w in zip(models, _unit_weights(n, precision, False))],
        *TERNARY_ORDER,
    )


def selection_counts(results: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How often each value was chosen, per ``keys`` and chosen thing."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns]))
    return results.select(*keys, pairs).groupBy(*keys, "what", "value").agg(F.count(F.lit(1)).alias("n"))
