"""Confusion counts of every point of a weight grid, counted by numpy inside the tasks.

A grid of thousands of points makes thousands of blends of each row. A task takes
its rows in blocks of one label, adds the models up in their order with the sums
of a prefix of weights shared by all points that begin with it, and decides the
last two models of all such points at once. Only counts per point leave a task.

The arithmetic is that of the column expressions: products with ``u / precision``
added in model order in double precision, and the comparisons of
:func:`chronoseal.functions.labels.decide_ternary`, NaN being the largest value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.labels import ARGMAX_EPS, TERNARY, DecisionRule
from .metrics import CELLS

# Rows of a block: enough to outweigh the calls of a run of points, few enough for the cache of a core.
BLOCK_ROWS = 4096


def _points(ranges: Sequence[tuple[int, int]], precision: int) -> list[tuple[int, ...]]:
    """Units of every point in lexicographic order."""
    points: list[tuple[int, ...]] = [()]
    for i, (low, high) in enumerate(ranges[:-1]):
        after = sum(r[0] for r in ranges[i + 1 :])
        points = [p + (u,) for p in points for u in range(low, min(high, precision - after - sum(p)) + 1)]
    low, high = ranges[-1]
    return [p + (precision - sum(p),) for p in points if low <= precision - sum(p) <= high]


def _runs(points: Sequence[tuple[int, ...]]) -> Iterator[tuple[int, int, tuple[int, ...], int, int, int]]:
    """Points that differ in their last two units only: ``first, end, prefix, low, high, rest``."""
    first = 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i][:-2] != points[first][:-2]:
            p = points[first]
            yield first, i, p[:-2], p[-2], points[i - 1][-2], p[-2] + p[-1]
            first = i


def _blends(products: Sequence[np.ndarray], points: Sequence[tuple[int, ...]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first, end, sums``: blends of a run of points, one line per point and class.

    ``products`` has an array (class, unit, row) per model.
    """
    if len(products) == 1:
        yield 0, 1, products[0][:, [points[0][0]]]
        return
    kept: list[tuple[int, np.ndarray]] = []
    for first, end, prefix, low, high, rest in _runs(points):
        same = 0
        while same < len(kept) and kept[same][0] == prefix[same]:
            same += 1
        del kept[same:]
        for i in range(same, len(prefix)):
            term = products[i][:, prefix[i]]
            kept.append((prefix[i], kept[-1][1] + term if kept else term))
        sums = products[-2][:, low : high + 1]
        if kept:
            sums = kept[-1][1][:, None] + sums
        yield first, end, sums + products[-1][:, rest - high : rest - low + 1][:, ::-1]


def _decisions(sums: np.ndarray, rules: Sequence[DecisionRule], finite: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows predicted as the first and as the second class, per rule."""
    gt, ge = np.greater, np.greater_equal
    if not finite:
        gt = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))
        ge = lambda a, b: (a >= b) | np.isnan(a)
    d, c, n = sums
    plain = None
    for rule in rules:
        if rule.kind == "diagnosed_margin":
            first = ge(d, np.maximum(c, n) + float(rule.diagnosed_margin))
            yield first, ge(c, n) & ~first
            continue
        if plain is None:
            raised = d + ARGMAX_EPS
            control = gt(c, raised)
            plain = ~(control | gt(n, raised)), control & ~gt(n, c + ARGMAX_EPS)
        if rule.kind == "argmax":
            yield plain
        elif rule.kind == "no_evidence_gate":
            shut = ~(ge(n, float(rule.no_evidence_min)) & ge(n, np.maximum(d, c)))
            yield plain[0] & shut, plain[1] & shut
        else:
            raise ValueError(f"unknown decision rule kind: {rule.kind}")


def _count(block: np.ndarray, points: Sequence[tuple[int, ...]], units: np.ndarray, rules: Sequence[DecisionRule]) -> np.ndarray:
    """Predictions of a block (class, model, row) as counts (point, rule, predicted class)."""
    out = np.empty((len(points), len(rules), 3), np.int64)
    finite = bool(np.isfinite(block).all())
    with np.errstate(invalid="ignore", over="ignore"):
        products = [block[:, m, None, :] * units[None, :, None] for m in range(block.shape[1])]
        for first, end, sums in _blends(products, points):
            for r, chosen in enumerate(_decisions(sums, rules, finite)):
                for k, hits in enumerate(chosen):
                    out[first:end, r, k] = [np.count_nonzero(line) for line in hits]
    out[:, :, 2] = block.shape[2] - out[:, :, 0] - out[:, :, 1]
    return out


def ternary_grid_cells(
    aligned: DataFrame,
    rules: Sequence[DecisionRule],
    ranges: Sequence[tuple[int, int]],
    precision: int,
    keys: Sequence[str],
    probabilities: Sequence[str],
) -> DataFrame:
    """The nine confusion cells per ``keys``, ``code`` and ``rule_id`` of all points of the grid.

    ``code`` numbers the points as the search does. Keys are configuration (policies, folds): a task keeps the counts
    of each. Rows with a missing probability have no decision and are in no cell.
    """
    points, models, rules = _points(ranges, precision), len(ranges), list(rules)
    codes = np.array([sum(u * (precision + 1) ** (models - 1 - i) for i, u in enumerate(p)) for p in points], np.int64)
    units = np.arange(precision + 1) / float(precision)
    names = [f"__p{k}_{m}" for k in range(3) for m in range(models)]
    label = F.array_position(F.array(*[F.lit(t) for t in TERNARY]), F.col("label")) - 1
    whole = F.lit(True)
    for p in probabilities:
        whole = whole & F.col(p).isNotNull() & ~F.exists(F.slice(p, 1, models), lambda x: x.isNull())
    flat = aligned.select(
        *keys,
        F.when(whole, F.coalesce(label, F.lit(-1))).otherwise(F.lit(-1)).cast("int").alias("__label"),
        *[F.col(p)[m].alias(f"__p{k}_{m}") for k, p in enumerate(probabilities) for m in range(models)],
    )
    # The work per row is thousands of blends, so a few megabytes of rows are dealt to all cores, not merged into one task.
    dealt = flat.repartition(2 * aligned.sparkSession.sparkContext.defaultParallelism, *names)
    fields = [flat.schema[k] for k in keys]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    schema = StructType([*fields, StructField("code", LongType()), StructField("rule_id", StringType()), *[StructField(c, LongType()) for c in CELLS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}

        def add(key: tuple, label: int, block: np.ndarray) -> None:
            for at in range(0, block.shape[2], BLOCK_ROWS):
                part = np.ascontiguousarray(block[:, :, at : at + BLOCK_ROWS])
                totals[key][:, :, label] += _count(part, points, units, rules)

        for batch in batches:
            if not batch.num_rows:
                continue
            by = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys) + 1)]))
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(by):
                groups.setdefault(g, []).append(i)
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(np.float64)
            for g, rows in groups.items():
                key, label = g[:-1], g[-1]
                if key not in totals:
                    totals[key] = np.zeros((len(points), len(rules), 3, 3), np.int64)
                if label < 0:
                    continue
                held = waiting.setdefault(g, [])
                held.append(values[:, rows].reshape(3, models, -1))
                if sum(h.shape[2] for h in held) >= BLOCK_ROWS:
                    block = np.concatenate(held, axis=2)
                    full = block.shape[2] // BLOCK_ROWS * BLOCK_ROWS
                    waiting[g] = [block[:, :, full:]]
                    add(key, label, block[:, :, :full])
        for g, held in waiting.items():
            add(g[:-1], g[-1], np.concatenate(held, axis=2))
        for key, cells in totals.items():
            size = len(points) * len(rules)
            columns = {f.name: pa.array([v] * size, types[f.name]) for f, v in zip(fields, key)}
            columns["code"] = pa.array(np.repeat(codes, len(rules)))
            columns["rule_id"] = pa.array([r.rule_id for r in rules] * len(points))
            flat_cells = cells.reshape(size, 9)
            columns.update({c: pa.array(np.ascontiguousarray(flat_cells[:, i])) for i, c in enumerate(CELLS)})
            yield pa.RecordBatch.from_pydict(columns)

    counted = dealt.mapInArrow(count, schema)
    return counted.groupBy(*keys, "code", "rule_id").agg(*[F.sum(c).alias(c) for c in CELLS])
