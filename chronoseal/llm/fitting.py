"""Bounded samples of labelled rows and the small logistic fits that run in one task on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_row(doc_id: Column) -> Column:
    """True for rows that a fit may learn from: CRC-32 of the id as text, modulo 4, is not 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label``: the label most rows of an id have (a tie counts as 1); null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))


def draw(key: str) -> Column:
    """Whole number in 0 .. 2^62 from a hash of ``key``: its low 20 bits lead, the next 42 follow."""
    h = F.xxhash64(F.lit(11), key)
    low = h.bitwiseAND(F.lit((1 << 20) - 1))
    return F.shiftleft(low, 42) + F.shiftright(h, 20).bitwiseAND(F.lit((1 << 42) - 1))


def share_limit(most: int, n: int) -> int:
    """Bound of ``draw`` that about ``most`` of ``n`` rows stay below; not 0 at any number of rows that a table can have."""
    return min(1 << 62, (most << 62) // max(1, n))


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows at most, picked by a hash of ``key``; all rows if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(draw(key) < share_limit(most, n))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def logistic(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, label: np.ndarray, width: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression over sparse rows, by Adam; both classes weigh the same."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    balance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[index], minlength=len(sizes)) + b
        slope = (sigmoid(z) - label) * balance
        g = np.append(np.bincount(index, value * slope[row], minlength=width) + l2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def calibration(z: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Newton steps, slightly smoothed targets)."""
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    design, w = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(design @ w)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, design.T @ (p - target)), -2, 2)
    return float(w[0]), float(w[1])
