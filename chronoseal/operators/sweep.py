"""Exact threshold sweeps that do not sort all rows of a candidate in one task.

Every threshold rule used here predicts "positive" for the rows at or above one
of the distinct scores, or for none. The sweep works on score bins first:

1. count positives and rows per (candidate, bin): partial sums, tiny shuffle;
2. running totals over bins give exact metrics at every bin edge, and an upper
   bound for all cuts inside a bin (metrics rise with true and fall with false
   positives);
3. only bins whose bound reaches the best edge are opened; their distinct
   scores are cumulated inside the bin.

An opened bin with many rows is split by the next digits of its scores' 64-bit
keys, and only parts that can still hold the best cut are kept, as often as the
digits allow. So a crowded bin, or scores that all lie in an outer bin because
they are no probabilities, never meet in one window.

No cut is dropped that could win or tie, so the result is that of a full sweep.
Equal scores are merged before the shuffle. Scores must be finite.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ordered_key
from ..session import written
from .metrics import BINARY_METRICS, EQUAL_DIGITS, THRESHOLD_ORDER, binary_columns
from .quantiles import LEAF_ROWS, SHIFTS
from .quantiles import quantiles as quantiles_of

# Fixed value: distance of the outer thresholds from 0 and 1.
EPSILON = 2.220446049250313e-16
_TINY = 5e-324
MODES = ("gt", "ge_mid", "ge")


def next_up(c: Column) -> Column:
    """Smallest double above a value >= 0."""
    return F.when(c == 0, F.lit(_TINY)).otherwise(c + c * F.lit(0.75 * EPSILON))


def _bin(score: Column, bins: int) -> Column:
    return F.floor(F.least(F.greatest(score * F.lit(float(bins)), F.lit(-1.0)), F.lit(float(bins)))).cast("int")


def _counts(tp: Column, fp: Column) -> tuple[Column, Column, Column, Column]:
    return tp, fp, F.col("neg_all") - fp, F.col("pos_all") - tp


def _histogram(scored: DataFrame, keys: list[str]) -> DataFrame:
    hist = scored.groupBy(*keys, "__bin").agg(
        F.sum("__p").alias("p"),
        F.sum("__n").alias("n"),
        F.max("__s").alias("high"),
    )
    down = W.partitionBy(*keys).orderBy(F.col("__bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    return hist.select(
        *keys,
        "__bin",
        "p",
        "n",
        F.coalesce(F.sum("p").over(down), F.lit(0)).alias("above_p"),
        F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above_n"),
        F.sum("p").over(every).alias("pos_all"),
        (F.sum("n").over(every) - F.sum("p").over(every)).alias("neg_all"),
        F.lag("high").over(W.partitionBy(*keys).orderBy("__bin")).alias("below"),
        F.max("high").over(every).alias("top"),
    )


def _parts(rows: DataFrame, bins: DataFrame, part: list[str], shift: int) -> DataFrame:
    """Bins split by the digit of the scores' keys above ``shift`` bits; same columns, the digit added to ``part``."""
    counted = rows.join(bins.select(*part), part, "left_semi").groupBy(*part, F.shiftright("__key", shift).alias("__digit"))
    hist = counted.agg(F.sum("__p").alias("p"), F.sum("__n").alias("n"), F.max("__s").alias("high"))
    joined = hist.join(bins.drop("p", "n"), part)
    order = W.partitionBy(*part).orderBy("__digit")
    down = W.partitionBy(*part).orderBy(F.col("__digit").desc()).rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        *part,
        "__digit",
        "p",
        "n",
        (F.col("above_p") + F.coalesce(F.sum("p").over(down), F.lit(0))).alias("above_p"),
        (F.col("above_n") + F.coalesce(F.sum("n").over(down), F.lit(0))).alias("above_n"),
        "pos_all",
        "neg_all",
        F.coalesce(F.lag("high").over(order), F.col("below")).alias("below"),
        "top",
        *[c for c in bins.columns if c == "__best"],
    )


def _graded(bins: DataFrame) -> DataFrame:
    """Macro F1 at the lower edge of each bin and the largest any cut inside can reach."""
    edge = binary_columns(*_counts(F.col("above_p") + F.col("p"), F.col("above_n") - F.col("above_p") + F.col("n") - F.col("p")))
    bound = binary_columns(*_counts(F.col("above_p") + F.col("p"), F.col("above_n") - F.col("above_p")))
    return bins.withColumn("__edge", edge["macro_f1"]).withColumn("__bound", bound["macro_f1"])


def _still_open(bins: DataFrame, keys: list[str], prune: str | None) -> DataFrame:
    """Bins that may hold a best cut, with the best edge seen so far in ``__best``."""
    if prune is None:
        return bins
    graded = _graded(bins)
    if prune == "key":
        best = F.max("__edge").over(W.partitionBy(*keys))
    else:
        best = graded.agg(F.max("__edge")).scalar()
    if "__best" in bins.columns:
        best = F.greatest(best, F.col("__best"))
    return graded.withColumn("__best", best).where(F.col("__bound") >= F.col("__best") - F.lit(1e-9)).drop("__edge", "__bound")


def _thresholds(mode: str) -> Column:
    lower, score = F.col("lower"), F.col("score")
    if mode == "gt":
        return F.coalesce(lower, F.lit(-EPSILON))
    if mode == "ge_mid":
        return F.when(lower.isNull(), F.lit(-EPSILON)).otherwise((lower + score) / F.lit(2.0))
    if mode == "ge":
        return score
    raise ValueError(f"unknown sweep mode: {mode}")


def _empty_threshold(mode: str) -> Column:
    if mode == "gt":
        return F.col("top")
    return F.lit(1.0 + EPSILON) if mode == "ge_mid" else next_up(F.col("top"))


def _inside(rows: DataFrame, bins: DataFrame, part: list[str]) -> DataFrame:
    """Counts at each distinct score of the bins; exact scores are grouped only for rows of these."""
    keys = [c for c in part if not c.startswith("__")]
    kept = rows.join(bins.select(*part), part, "left_semi")
    merged = kept.groupBy(*part, "__s").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    joined = merged.join(bins.drop("p", "n"), part)
    one = W.partitionBy(*part)
    down = one.orderBy(F.col("__s").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    tp = F.sum("__p").over(down) + F.col("above_p")
    seen = F.sum("__n").over(down) + F.col("above_n")
    return joined.select(
        *keys,
        F.col("__s").alias("score"),
        F.coalesce(F.lag("__s").over(one.orderBy("__s")), F.col("below")).alias("lower"),
        tp.alias("tp"),
        (seen - tp).alias("fp"),
        "pos_all",
        "neg_all",
    )


def sweep_cuts(
    scored: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    positive: Column | None = None,
    mode: str = "gt",
    weight: Column | None = None,
    bins: int = 1024,
    prune: str | None = "key",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Cuts with ``threshold, tp, fp, tn, fn`` per candidate ``keys``.

    ``prune=None`` returns every cut. ``"key"`` keeps the cuts that may be best
    within a candidate, ``"all"`` those that may be best over all candidates.

    Modes: ``gt`` predicts score > threshold with thresholds at the scores;
    ``ge_mid`` predicts score >= threshold with thresholds between the scores;
    ``ge`` predicts score >= threshold with thresholds at the scores.

    A bin with more than ``leaf_rows`` rows (weights included) is split; key names must not begin with ``__``.
    """
    keys = list(keys)
    positive = F.col("label") == "diagnosed" if positive is None else positive
    n = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    s = F.col(score).cast("double")
    rows = scored.select(*keys, s.alias("__s"), F.when(positive, n).otherwise(F.lit(0)).alias("__p"), n.alias("__n"), _bin(s, bins).alias("__bin"))
    hist = written(_histogram(rows, keys))
    opened = written(_still_open(hist, keys, prune))
    part = [*keys, "__bin"]
    # The lambda binds the score once; it may be a long expression and the key names it often.
    rows = rows.withColumn("__key", F.transform(F.array("__s"), ordered_key)[0])
    inside = []
    for shift in SHIFTS:
        if (opened.agg(F.max("n")).first()[0] or 0) <= leaf_rows:
            break
        inside.append(_inside(rows, opened.where(F.col("n") <= leaf_rows), part))
        opened = written(_still_open(_parts(rows, opened.where(F.col("n") > leaf_rows), part, shift), keys, prune))
        # The digit includes all digits before it, so that it takes their place.
        opened = opened.withColumnRenamed("__digit", f"__digit{shift}")
        rows = rows.withColumn(f"__digit{shift}", F.shiftright("__key", shift))
        part = [*keys, "__bin", f"__digit{shift}"]
    inside.append(_inside(rows, opened, part))
    cuts = reduce(DataFrame.unionByName, inside)
    out = cuts.select(*keys, _thresholds(mode).alias("threshold"), "tp", "fp", "pos_all", "neg_all")
    none = hist.groupBy(*keys).agg(F.max("top").alias("top"), F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"))
    zero = F.lit(0).cast("bigint")
    out = out.unionByName(none.select(*keys, _empty_threshold(mode).alias("threshold"), zero.alias("tp"), zero.alias("fp"), "pos_all", "neg_all"))
    return out.select(*keys, "threshold", "tp", "fp", (F.col("neg_all") - F.col("fp")).alias("tn"), (F.col("pos_all") - F.col("tp")).alias("fn"))


def pick_best(
    cuts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = THRESHOLD_ORDER,
    digits: int | None = EQUAL_DIGITS,
    prefer: Sequence[Column] = (),
) -> DataFrame:
    """Best cut per keys: metric order, then ``prefer`` (larger wins), then the lowest threshold.

    One ``max_by``, so each task sends one row per key.
    """
    metrics = binary_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    ranked = [F.round(metrics[m], digits) if digits is not None else metrics[m] for m in order]
    payload = [c for c in cuts.columns if c not in keys]
    rank = F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate(ranked)],
        *[c.alias(f"q{i}") for i, c in enumerate(prefer)],
        (-F.col("threshold")).alias("t"),
    )
    best = cuts.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("b")).select(*keys, "b.*")
    after = binary_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return best.select("*", *[after[m].alias(m) for m in BINARY_METRICS])


def best_threshold(
    scored: DataFrame,
    keys: Sequence[str],
    mode: str = "gt",
    order: Sequence[str] = THRESHOLD_ORDER,
    digits: int | None = EQUAL_DIGITS,
    **options: object,
) -> DataFrame:
    """One row per candidate: the best threshold with its counts and metrics."""
    prune = "key" if order[0] == "macro_f1" else None
    return pick_best(sweep_cuts(scored, keys, mode=mode, prune=prune, **options), keys, order, digits)


def midpoints(scored: DataFrame, keys: Sequence[str], score: str = "score", bins: int = 1024) -> DataFrame:
    """Distinct scores with the midpoint to the next higher one (NULL at the top)."""
    s = F.col(score).cast("double")
    distinct = scored.select(*keys, s.alias("score"), _bin(s, bins).alias("__bin")).distinct()
    lowest = distinct.groupBy(*keys, "__bin").agg(F.min("score").alias("__low"))
    nxt = lowest.select(*keys, "__bin", F.lead("__low").over(W.partitionBy(*keys).orderBy("__bin")).alias("__next"))
    inside = F.lead("score").over(W.partitionBy(*keys, "__bin").orderBy("score"))
    joined = distinct.join(nxt, [*keys, "__bin"]).withColumn("higher", F.coalesce(inside, F.col("__next")))
    return joined.select(*keys, "score", ((F.col("score") + F.col("higher")) / F.lit(2.0)).alias("midpoint"))


def coarse_sweep(
    scored: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    positive: Column | None = None,
    grid: int = 101,
    steps: int = 41,
) -> DataFrame:
    """Best macro F1 over an even grid and score quantiles, predicting score > threshold.

    A row is only told how many thresholds lie below its score; the counts per
    interval are cumulated afterwards.
    """
    keys = list(keys)
    positive = F.col("label") == "diagnosed" if positive is None else positive
    probabilities = [i / (steps - 1) for i in range(steps)]
    even = [i / (grid - 1) for i in range(grid)]
    marks = quantiles_of(scored, keys, score, probabilities).groupBy(*keys).agg(F.collect_list("value").alias("__q"))
    cut = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(v) for v in even]), F.col("__q"))))
    cuts = marks.select(*keys, cut.alias("__cuts"))
    joined = scored.join(cuts, keys) if keys else scored.withColumn("__cuts", cuts.scalar())
    below = F.size(F.filter("__cuts", lambda t: t < F.col(score)))
    counted = joined.select(*keys, below.alias("__i"), positive.alias("__pos")).groupBy(*keys, "__i").agg(F.count_if("__pos").alias("p"), F.count_if(~F.col("__pos")).alias("n"))
    up = W.partitionBy(*keys).orderBy(F.col("__i").desc())
    every = W.partitionBy(*keys)
    states = counted.select(
        *keys,
        "__i",
        F.sum("p").over(up).alias("tp"),
        F.sum("n").over(up).alias("fp"),
        F.sum("p").over(every).alias("pos"),
        F.sum("n").over(every).alias("neg"),
    )
    # Interval 0 lies below every threshold and is no cut of its own; "no positives" always is one.
    real = states.where("__i > 0").select(*keys, "tp", "fp", "pos", "neg")
    none = states.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg")).select(*keys, F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "pos", "neg")
    both = real.unionByName(none)
    macro = binary_columns(F.col("tp"), F.col("fp"), F.col("neg") - F.col("fp"), F.col("pos") - F.col("tp"))["macro_f1"]
    return both.groupBy(*keys).agg(F.max(macro).alias("macro_f1"))
