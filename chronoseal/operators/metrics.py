"""Confusion counts, metrics, calibration, robustness and summaries.

Rows are reduced to counts by map-side combined aggregates; metric arithmetic
runs on the few aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NEGATIVE, NO_EVIDENCE, POSITIVE, TERNARY, DecisionRule, decide_ternary
from ..functions.numeric import safe_ratio

BINARY_METRICS = ("precision", "recall", "diagnosed_f1", "control_f1", "macro_f1", "accuracy")
# Metric orders and the digits that make two metrics equal.
SELECTION_ORDER = ("macro_f1", "diagnosed_f1", "precision")
THRESHOLD_ORDER = ("macro_f1", "diagnosed_f1", "precision", "recall")
TERNARY_ORDER = ("macro_f1", "diagnosed_f1", "diagnosed_precision", "accuracy")
EQUAL_DIGITS = 12
SHORT = {POSITIVE: "d", NEGATIVE: "c", NO_EVIDENCE: "n"}
CELLS = tuple(f"n_{SHORT[a]}{SHORT[p]}" for a in TERNARY for p in TERNARY)
ECE_EDGES = (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0000001)


def order_by_metrics(names: Sequence[str], *ties: Column) -> list[Column]:
    """Descending metric order; values closer than 1e-12 tie and fall to the next key."""
    return [F.round(F.col(n), EQUAL_DIGITS).desc() for n in names] + list(ties)


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(F.lit(2.0) * p * r, p + r)


def binary_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    n_precision, n_recall = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    d_f1, c_f1 = f1(precision, recall), f1(n_precision, n_recall)
    return {
        "precision": precision,
        "recall": recall,
        "diagnosed_f1": d_f1,
        "control_f1": c_f1,
        "macro_f1": (d_f1 + c_f1) / F.lit(2.0),
        "accuracy": safe_ratio(tp + tn, tp + fp + tn + fn),
    }


def add_binary_metrics(counts: DataFrame) -> DataFrame:
    """Metrics beside ``tp, fp, tn, fn``."""
    columns = binary_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return counts.select("*", *[c.alias(n) for n, c in columns.items()])


def binary_confusion(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", predicted: str = "predicted") -> DataFrame:
    a, p = F.col(actual) == POSITIVE, F.col(predicted) == POSITIVE
    return rows.groupBy(*keys).agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(a & ~p).alias("fn"),
    )


def binary_metrics(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return add_binary_metrics(binary_confusion(rows, keys, actual, predicted))


def ternary_confusion(
    rows: DataFrame,
    keys: Sequence[str] = (),
    actual: str = "label",
    predicted: str = "predicted",
    n: Column | None = None,
) -> DataFrame:
    """Nine cells ``n_<actual><predicted>`` with d, c, n for the classes."""
    cells = []
    for a in TERNARY:
        for p in TERNARY:
            hit = (F.col(actual) == a) & (F.col(predicted) == p)
            value = F.count_if(hit) if n is None else F.coalesce(F.sum(F.when(hit, n)), F.lit(0))
            cells.append(value.alias(f"n_{SHORT[a]}{SHORT[p]}"))
    return rows.groupBy(*keys).agg(*cells)


def ternary_columns() -> dict[str, Column]:
    def cell(a: str, p: str) -> Column:
        return F.col(f"n_{SHORT[a]}{SHORT[p]}").cast("double")

    out: dict[str, Column] = {}
    f1s, correct, total = [], F.lit(0.0), F.lit(0.0)
    for label in TERNARY:
        others = [x for x in TERNARY if x != label]
        tp = cell(label, label)
        fp = cell(others[0], label) + cell(others[1], label)
        fn = cell(label, others[0]) + cell(label, others[1])
        precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
        name = label.replace("-", "_")
        out[f"{name}_precision"], out[f"{name}_recall"], out[f"{name}_f1"] = precision, recall, f1(precision, recall)
        out[f"{name}_support"] = (tp + fn).cast("bigint")
        f1s.append(out[f"{name}_f1"])
        correct, total = correct + tp, total + tp + fn
    out["macro_f1"] = (f1s[0] + f1s[1] + f1s[2]) / F.lit(3.0)
    out["accuracy"] = safe_ratio(correct, total)
    return out


def add_ternary_metrics(cells: DataFrame) -> DataFrame:
    return cells.select("*", *[c.alias(n) for n, c in ternary_columns().items()])


def ternary_metrics(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return add_ternary_metrics(ternary_confusion(rows, keys, actual, predicted))


def label_counts(rows: DataFrame, keys: Sequence[str], label: str, domain: Sequence[str]) -> DataFrame:
    """Dense counts: every label of the domain appears, with 0 if need be."""
    counted = rows.groupBy(*keys).agg(*[F.count_if(F.col(label) == v).alias(v) for v in domain])
    pairs = F.array(*[F.struct(F.lit(v).alias(label), F.col(f"`{v}`").alias("n")) for v in domain])
    return counted.select(*keys, F.inline(pairs))


def pair_counts(rows: DataFrame, first: str, second: str, domain: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Contingency table of two label columns with its zero cells."""
    cells = [(a, b) for a in domain for b in domain]
    counted = rows.groupBy(*keys).agg(*[F.count_if((F.col(first) == a) & (F.col(second) == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    pairs = F.array(*[F.struct(F.lit(a).alias(first), F.lit(b).alias(second), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(cells)])
    return counted.select(*keys, F.inline(pairs))


# --- ternary rules -------------------------------------------------------------------


def decision_counts(
    scores: DataFrame,
    rules: Sequence[DecisionRule],
    keys: Sequence[str],
    label: str = "label",
    probabilities: Sequence[str] = ("prob_diagnosed", "prob_control", "prob_no_evidence"),
) -> DataFrame:
    """Row counts per keys, rule, label and prediction.

    All rules are decided in one pass and rows are counted by their vector of
    predictions, so neither rows nor the shuffle grow with the number of rules.
    """
    names = [f"__r{i}" for i in range(len(rules))]
    made = scores.select(*keys, F.col(label).alias("label"), *[decide_ternary(*probabilities, r).alias(n) for r, n in zip(rules, names)])
    counted = made.groupBy(*keys, "label", *names).agg(F.count(F.lit(1)).alias("n"))
    pairs = [x for r, n in zip(rules, names) for x in (F.lit(r.rule_id), F.col(n))]
    spread = counted.select(*keys, "label", "n", F.stack(F.lit(len(rules)), *pairs).alias("rule_id", "predicted"))
    return spread.groupBy(*keys, "rule_id", "label", "predicted").agg(F.sum("n").alias("n"))


def rule_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ternary metrics from :func:`decision_counts` rows."""
    return add_ternary_metrics(ternary_confusion(counts, [*keys, "rule_id"], n=F.col("n")))


def fold_subset_metrics(counts: DataFrame, keys: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """Metrics on every non-empty fold subset; ``subset`` is a bit mask over ``folds``.

    Confusion counts add up over folds, so each fold row joins the subsets that
    contain it after aggregation.
    """
    ordered = sorted(folds)
    if len(ordered) > 16:
        raise ValueError("fold subsets are limited to 16 folds")
    bit = F.array_position(F.array(*[F.lit(f) for f in ordered]), F.col("fold")) - 1
    masks = F.sequence(F.lit(1), F.lit(2 ** len(ordered) - 1))
    inside = counts.withColumn("__bit", bit.cast("int")).withColumn("subset", F.explode(masks))
    kept = inside.where(F.expr("(shiftright(subset, __bit) & 1) = 1"))
    return add_ternary_metrics(ternary_confusion(kept, [*keys, "rule_id", "subset"], n=F.col("n")))


def scalar_stats(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, minimum, maximum and population deviation of each metric."""
    aggs = [F.count(F.lit(1)).alias("combinations")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.stddev_pop(m).alias(f"{m}_std")]
    return rows.groupBy(*keys).agg(*aggs)


# --- diagnostics ---------------------------------------------------------------------


def label_probability(label: Column | str, probabilities: Sequence[str] = ("prob_diagnosed", "prob_control", "prob_no_evidence")) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    out = F.lit(None).cast("double")
    for name, p in zip(TERNARY, probabilities):
        out = F.when(label == name, F.col(p)).otherwise(out)
    return out


def diagnostic_rows(rows: DataFrame, rule: DecisionRule) -> DataFrame:
    """Prediction, its probability, the actual label's probability and correctness per row."""
    probs = ("prob_diagnosed", "prob_control", "prob_no_evidence")
    return (
        rows.withColumn("predicted", decide_ternary(*probs, rule))
        .withColumn("predicted_probability", label_probability("predicted"))
        .withColumn("max_probability", F.greatest(*probs))
        .withColumn("actual_probability", label_probability("label"))
        .withColumn("correct", F.col("predicted") == F.col("label"))
    )


def brier_term() -> Column:
    total = F.lit(0.0)
    for name, p in zip(TERNARY, ("prob_diagnosed", "prob_control", "prob_no_evidence")):
        gap = F.col(p) - F.when(F.col("label") == name, F.lit(1.0)).otherwise(F.lit(0.0))
        total = total + gap * gap
    return total


def probability_summary(diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score, negative log likelihood (floor 1e-12) and mean probabilities."""
    nll = -F.log(F.greatest(F.col("actual_probability"), F.lit(1e-12)))
    return diagnostics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(brier_term()).alias("brier"),
        F.avg(nll).alias("nll"),
        F.avg("prob_diagnosed").alias("mean_diagnosed"),
        F.avg("prob_control").alias("mean_control"),
        F.avg("prob_no_evidence").alias("mean_no_evidence"),
    )


def confidence_bins(diagnostics: DataFrame, edges: Sequence[float] = ECE_EDGES) -> DataFrame:
    """Accuracy and confidence per bin, empty bins included."""
    p = F.col("predicted_probability")
    hit = F.when(F.col("correct"), F.lit(1.0)).otherwise(F.lit(0.0))
    aggs, structs = [], []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (p >= F.lit(low)) & (p < F.lit(high))
        aggs += [
            F.count_if(inside).alias(f"n{i}"),
            F.coalesce(F.avg(F.when(inside, hit)), F.lit(0.0)).alias(f"a{i}"),
            F.coalesce(F.avg(F.when(inside, p)), F.lit(0.0)).alias(f"p{i}"),
        ]
        structs.append(
            F.struct(
                F.lit(float(low)).alias("lower"),
                F.lit(min(float(high), 1.0)).alias("upper"),
                F.col(f"n{i}").alias("n"),
                F.col(f"a{i}").alias("accuracy"),
                F.col(f"p{i}").alias("average_confidence"),
                (F.col(f"p{i}") - F.col(f"a{i}")).alias("calibration_gap"),
            )
        )
    return diagnostics.agg(*aggs).select(F.inline(F.array(*structs)))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    weighted = F.sum(F.col("n") * F.abs("calibration_gap")) / F.sum("n")
    return bins.agg(F.coalesce(weighted, F.lit(0.0)).alias("ece"))


def fold_summaries(diagnostics: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col(c) == v).alias(f"{c}_{SHORT[v]}") for c in ("predicted", "label") for v in TERNARY]
    return diagnostics.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(brier_term()).alias("brier"),
        *counts,
    )


def class_summaries(diagnostics: DataFrame) -> DataFrame:
    aggs, structs = [], []
    for v in TERNARY:
        s = SHORT[v]
        aggs += [
            F.count_if(F.col("label") == v).alias(f"a_{s}"),
            F.count_if(F.col("predicted") == v).alias(f"p_{s}"),
            F.coalesce(F.avg(F.when(F.col("label") == v, F.col("actual_probability"))), F.lit(0.0)).alias(f"ap_{s}"),
            F.coalesce(F.avg(F.when(F.col("predicted") == v, F.col("predicted_probability"))), F.lit(0.0)).alias(f"pp_{s}"),
        ]
        structs.append(
            F.struct(
                F.lit(v).alias("label"),
                F.col(f"a_{s}").alias("actual_count"),
                F.col(f"p_{s}").alias("predicted_count"),
                F.col(f"ap_{s}").alias("average_actual_probability"),
                F.col(f"pp_{s}").alias("average_predicted_probability"),
            )
        )
    return diagnostics.agg(*aggs).select(F.inline(F.array(*structs)))


def confident_errors(diagnostics: DataFrame, n: int = 25, key: str = "user_id") -> DataFrame:
    """Most confident wrong rows with hashed ids."""
    wrong = diagnostics.where(~F.col("correct"))
    top = wrong.orderBy(F.col("predicted_probability").desc(), F.col(key).asc()).limit(n)
    return top.select(
        F.sha2(F.col(key).cast("string"), 256).alias("user_hash"),
        "fold",
        F.col("label").alias("actual"),
        "predicted",
        "predicted_probability",
        "actual_probability",
    )


def error_patterns(rows: DataFrame, threshold: float) -> DataFrame:
    """Two error patterns: old high relevance with a quiet recent window, recent indirect tone with a low score.

    Needs label, score and the marker / recency feature columns used below.
    """
    predicted = F.col("score") > F.lit(threshold)
    fp = (F.col("label") == NEGATIVE) & predicted
    fn = (F.col("label") == POSITIVE) & ~predicted
    signal = F.col("final50_indirect_anxiety_ratio") + F.col("final50_indirect_sleep_ratio")
    signal = signal + F.col("final50_indirect_fatigue_ratio") + F.col("final50_indirect_cry_sad_ratio")
    quiet = (F.expm1("rel7_count_log") >= 1) & (F.col("last_rel7_normalized_position") < 0.75) & (F.col("final50_rel7_ratio") < 0.02)
    pattern = (
        F.when(fp & quiet, F.lit("fp_historical_recent_quiet"))
        .when(fp, F.lit("fp_other"))
        .when(fn & (signal >= 0.08) & (F.col("score") < threshold), F.lit("fn_recent_indirect_low_score"))
        .when(fn, F.lit("fn_other"))
    )
    return rows.withColumn("pattern", pattern).where("pattern IS NOT NULL")


def override_comparison(rows: DataFrame, keys: Sequence[str] = (), actual: str = "label", base: str = "predicted", final: str = "final") -> DataFrame:
    """Base and overridden binary metrics side by side, with switched, fixed and lost counts."""
    a, b, f = F.col(actual) == POSITIVE, F.col(base) == POSITIVE, F.col(final) == POSITIVE
    cells = []
    for name, p in (("base", b), ("final", f)):
        cells += [F.count_if(a & p).alias(f"{name}_tp"), F.count_if(~a & p).alias(f"{name}_fp"), F.count_if(~a & ~p).alias(f"{name}_tn"), F.count_if(a & ~p).alias(f"{name}_fn")]
    counted = rows.groupBy(*keys).agg(
        *cells,
        F.count_if(b).alias("base_positive"),
        F.count_if(b & ~f).alias("switched"),
        F.count_if(b & ~f & ~a).alias("fp_fixed"),
        F.count_if(b & ~f & a).alias("tp_lost"),
    )
    out = [*keys, "base_positive", "switched", "fp_fixed", "tp_lost"]
    for name in ("base", "final"):
        m = binary_columns(*[F.col(f"{name}_{x}") for x in ("tp", "fp", "tn", "fn")])
        out += [m[k].alias(f"{name}_{k}") for k in ("macro_f1", "diagnosed_f1", "precision", "recall")]
    return counted.select(*out)


def score_difference(left: DataFrame, right: DataFrame, key: str = "user_id", score: str = "score") -> DataFrame:
    """Largest absolute score difference and rows present on one side only."""
    joined = left.select(key, F.col(score).alias("__l")).join(right.select(key, F.col(score).alias("__r")), key, "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.abs(F.col("__l") - F.col("__r"))).alias("max_abs_difference"),
        F.count_if(F.col("__l").isNull() | F.col("__r").isNull()).alias("unmatched"),
    )


def marker_averages(rows: DataFrame, label: str, markers: Sequence[str]) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in markers])


def balanced_weights(rows: DataFrame, label: str = "label", classes: int = 2, power: int = 1, name: str = "weight") -> DataFrame:
    """Weight n / (classes * class count); ``power`` 2 repeats the weighting as the plain stackers do."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    # One entry per class: the number of classes bounds this row and the broadcast below.
    packed = counts.agg(F.sum("__c").alias("__n"), F.collect_list(F.struct(label, "__c")).alias("__rows"))
    ratio = F.col("__n") / (F.lit(float(classes)) * F.col("__c"))
    per_class = packed.select("__n", F.inline("__rows")).select(label, F.pow(ratio, F.lit(float(power))).alias(name))
    return rows.join(per_class, label)


def fold_average(scores: DataFrame, folds: int, keys: Sequence[str] = ("user_id", "model_id")) -> DataFrame:
    """Mean over the fold models; ``complete`` tells whether every fold scored the user once."""
    mean = scores.groupBy(*keys).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("scored"), F.count_distinct("fold").alias("__d"))
    return mean.withColumn("complete", (F.col("scored") == folds) & (F.col("__d") == folds)).drop("__d")


def rename_metrics(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Generic class names for a target, e.g. ``diagnosed_f1`` to ``positive_f1``."""
    return df.withColumnsRenamed(dict(mapping))


def normalize_metrics(report: DataFrame, flat: Sequence[str], nested: Mapping[str, str]) -> DataFrame:
    """One flat row per report: flat column where present, else the nested path."""
    present = set(report.columns)
    out = []
    for name in flat:
        options = ([F.col(name)] if name in present else []) + ([F.col(nested[name])] if name in nested else [])
        out.append((F.coalesce(*options) if options else F.lit(None).cast("double")).alias(name))
    keep = [c for c in report.columns if c not in flat and c not in {p.split(".")[0] for p in nested.values()}]
    return report.select(*keep, *out)
