"""Stratified bootstrap intervals.

Metrics depend on confusion counts only, and a resample within a stratum of a
fixed size draws those counts from a multinomial. So replicates are drawn from
one row of cell counts: the work is ``samples`` small draws, spread over tasks,
whatever the number of users.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import add_binary_metrics, binary_columns, binary_confusion

INTERVAL_METRICS = ("macro_f1", "diagnosed_f1", "precision", "recall", "accuracy")


def _replicates(cells: DataFrame, samples: int, cell_names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Cell counts per replicate row; ``cells`` has one row per key."""
    return cells.select(*keys, *cell_names).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).repartition("replicate")


def _draw(strata: Sequence[Sequence[str]], seed: int, columns: Sequence[str]):
    names = [n for s in strata for n in s]
    spans = np.cumsum([0, *[len(s) for s in strata]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf[names].to_numpy(dtype=np.int64)
            drawn = np.zeros_like(counts)
            for row, replicate in enumerate(pdf["replicate"].to_numpy()):
                rng = np.random.default_rng([seed, int(replicate)])
                for low, high in zip(spans, spans[1:]):
                    stratum = counts[row, low:high]
                    size = stratum.sum()
                    if size:
                        drawn[row, low:high] = rng.multinomial(size, stratum / size)
            out = pdf[list(columns)].copy()
            out[names] = drawn
            yield out

    return run


def resample(cells: DataFrame, strata: Sequence[Sequence[str]], samples: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """``samples`` stratified resamples of each row of cell counts; deterministic in ``seed``."""
    names = [n for s in strata for n in s]
    source = _replicates(cells, samples, names, keys)
    columns = [*keys, "replicate", *names]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return source.select(*columns).mapInPandas(_draw(strata, seed, columns), schema)


def bootstrap_intervals(
    rows: DataFrame,
    samples: int = 2000,
    seed: int = 42,
    keys: Sequence[str] = (),
    actual: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """2.5 and 97.5 percent points of five metrics under class-stratified resampling."""
    cells = binary_confusion(rows, keys, actual, predicted)
    drawn = add_binary_metrics(resample(cells, [["tp", "fn"], ["tn", "fp"]], samples, seed, keys))
    # `samples` values per metric and key: small enough for exact percentiles.
    ends = [F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in INTERVAL_METRICS]
    wide = drawn.groupBy(*keys).agg(*ends)
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("high")) for m in INTERVAL_METRICS])
    return wide.select(*keys, F.inline(entries))


def _joint_cells() -> list[tuple[str, int, int, int, int]]:
    return [(f"c{a}{b}{p}{q}", a, b, p, q) for a in (0, 1) for b in (0, 1) for p in (0, 1) for q in (0, 1)]


def paired_cells(rows: DataFrame, first: str, first_predicted: str, second: str, second_predicted: str) -> DataFrame:
    """Counts of the sixteen combinations of two 0/1 labels and two 0/1 predictions."""
    def hit(a: int, b: int, p: int, q: int) -> Column:
        return (F.col(first) == a) & (F.col(second) == b) & (F.col(first_predicted) == p) & (F.col(second_predicted) == q)

    return rows.agg(*[F.count_if(hit(a, b, p, q)).alias(n) for n, a, b, p, q in _joint_cells()])


def _macro(cells: list[tuple[str, int, int]]) -> Column:
    """Macro F1 from ``(name, actual, predicted)`` cells."""
    def total(a: int, p: int) -> Column:
        out = F.lit(0)
        for n, x, y in cells:
            if (x, y) == (a, p):
                out = out + F.col(n)
        return out

    return binary_columns(total(1, 1), total(0, 1), total(0, 0), total(1, 0))["macro_f1"]


def paired_delta(
    rows: DataFrame,
    samples: int = 2000,
    seed: int = 42,
    first: str = "first",
    first_predicted: str = "first_predicted",
    second: str = "second",
    second_predicted: str = "second_predicted",
) -> DataFrame:
    """Macro F1 of the second minus the first target with its interval, strata = joint labels."""
    cells = paired_cells(rows, first, first_predicted, second, second_predicted)
    joint = _joint_cells()
    a = _macro([(n, x, p) for n, x, _, p, _ in joint])
    b = _macro([(n, y, q) for n, _, y, _, q in joint])
    strata = [[n for n, x, y, _, _ in joint if (x, y) == s] for s in ((0, 0), (0, 1), (1, 0), (1, 1))]
    drawn = resample(cells, strata, samples, seed).select((b - a).alias("delta"))
    ends = drawn.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    point = cells.select((b - a).alias("delta"))
    return point.select("delta", ends.select(F.col("e")[0]).scalar().alias("low"), ends.select(F.col("e")[1]).scalar().alias("high"))


TARGETS = ("first", "second")


def _joint_metrics() -> dict[str, dict[str, Column]]:
    """The interval metrics of both targets from the sixteen joint cells."""
    joint, out = _joint_cells(), {}
    for target, pick in zip(TARGETS, (lambda a, b, p, q: (a, p), lambda a, b, p, q: (b, q))):
        sums = {s: sum((F.col(n) for n, *c in joint if pick(*c) == s), F.lit(0)) for s in ((1, 1), (0, 1), (0, 0), (1, 0))}
        columns = binary_columns(*[sums[s] for s in ((1, 1), (0, 1), (0, 0), (1, 0))])
        out[target] = {m: columns[m] for m in INTERVAL_METRICS}
    return out


def _report_columns(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``target_metric`` columns of both targets and of their difference (second minus first)."""
    by = _joint_metrics()
    named = {f"{t}__{m}": by[t][m] for t in TARGETS for m in INTERVAL_METRICS}
    both = cells.select(*keep, *[c.alias(n) for n, c in named.items()])
    return both.select("*", *[(F.col(f"second__{m}") - F.col(f"first__{m}")).alias(f"delta__{m}") for m in INTERVAL_METRICS])


def _report_rows(wide: DataFrame, values: dict[str, dict[str, Column]]) -> DataFrame:
    entries = [F.struct(F.lit(n.split("__")[0]).alias("target"), F.lit(n.split("__")[1]).alias("metric"), *[c.alias(k) for k, c in v.items()]) for n, v in values.items()]
    return wide.select(F.inline(F.array(*entries)))


def paired_points(cells: DataFrame) -> DataFrame:
    """``target, metric, point`` for both targets and their difference, from the joint cells of :func:`paired_cells`."""
    wide = _report_columns(cells)
    return _report_rows(wide, {n: {"point": F.col(n)} for n in wide.columns})


def paired_report(cells: DataFrame, samples: int = 2000, seed: int = 42) -> DataFrame:
    """``target, metric, point, low, high``: every interval and the difference come from the same resamples.

    A resample draws the joint cells of (label a, label b, prediction a, prediction b) within the strata of the joint labels, so
    the two targets vary together. The work does not depend on the number of users.
    """
    joint = _joint_cells()
    strata = [[n for n, x, y, _, _ in joint if (x, y) == s] for s in ((0, 0), (0, 1), (1, 0), (1, 1))]
    drawn = _report_columns(resample(cells, strata, samples, seed))
    ends = drawn.agg(*[F.percentile(n, F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in drawn.columns])
    spans = _report_rows(ends, {n: {"low": F.col(n)[0], "high": F.col(n)[1]} for n in ends.columns})
    return paired_points(cells).join(spans, ["target", "metric"])
