"""Quality rules: fixed text measures, and a hashed n-gram classifier trained on labelled rows.

Words, word pairs and character triples are hashed into one weight table each. A text's features are the shares of its
words, pairs and triples, so the score of a text is a sum of three mean weights. The weights are fitted on a
bounded sample of labelled rows (``SAMPLE`` documents, in one task), a part that the fit does not see turns scores into
probabilities, and texts are scored in Arrow batches against a fixed threshold. Long texts are whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .fitting import bounded_sample, calibration, logistic, one_label, sigmoid
from .pretokens import code_points

SAMPLE = 6_000
BITS = 17
SLICE = 1 << 18
THRESHOLD = 0.5
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


class Texts:
    """Words, lines and counts of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~_BLANK[data]
        self.starts, ends = A.runs(solid, offsets)
        self.sizes = ends - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.bounds)
        self.hashes = A.span_hashes(data, self.starts, self.sizes)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.n_words)
        self.solid = solid

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all runs of ``size`` words that stay in a text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        first = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        table = A.powers(size + 1)
        return first, A.mix(sum((self.hashes[first + k] * table[k + 1] for k in range(size)), np.zeros(len(first), _U)))

    def measures(self) -> dict[str, np.ndarray]:
        lead = (self.data & 0xC0) != 0x80
        first, window = self.windows(3)
        # Windows of different texts never meet: the text takes part in the key.
        _, code, count = np.unique(A.mix(window + self.text[first].astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        repeated = np.zeros(len(self.hashes) + 1, bool)
        twice = first[count[code] >= 2] if len(first) else first
        for k in range(3):
            repeated[twice + k] = True
        starts, ends = A.runs(self.data != 10, self.offsets)
        words_before = np.concatenate(([0], np.cumsum(self.solid)))
        real = words_before[ends] > words_before[starts]
        starts, ends = starts[real], ends[real]
        line_text = np.searchsorted(self.offsets, starts, "right") - 1
        key = A.mix(A.span_hashes(self.data, starts, ends - starts) + line_text.astype(_U) * _U(0x9E3779B97F4A7C15))
        _, once = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[once] = False
        return {
            "n_words": self.n_words,
            "word_chars": _per_text(self.solid & lead, self.offsets),
            "n_symbols": _per_text(_SYMBOL[self.data], self.offsets),
            "n_dup_lines": np.bincount(line_text[again], minlength=len(self.n_words)),
            "n_repeat_words": _per_text(repeated[:-1], self.bounds),
        }

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(table index, text) of all words, all word pairs and all character triples."""
        shift = _U(64 - BITS)
        yield (self.hashes >> shift).astype(np.int64), self.text
        first, pairs = self.windows(2)
        yield (pairs >> shift).astype(np.int64) + (1 << BITS), self.text[first]
        points = code_points(self.data).astype(_U)
        if len(points) < 3:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        place = np.flatnonzero((self.data & 0xC0) != 0x80)
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(np.searchsorted(place, self.offsets)))
        table = A.powers(4)
        triple = points[:-2] * table[1] + points[1:-1] * table[2] + points[2:] * table[3]
        inside = text[:-2] == text[2:]
        triple = ((triple ^ (triple >> _U(29))) * table[1] >> shift).astype(np.int64) + (2 << BITS)
        yield triple[inside], text[:-2][inside]

    def scores(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        z = np.full(len(self.n_words), intercept)
        for index, text in self.features():
            n = np.bincount(text, minlength=len(z))
            z += np.bincount(text, weights[index], minlength=len(z)) / np.maximum(n, 1)
        return z


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = A.utf8(batch.column(0))
        for i, j in A.slices(offsets, SLICE):
            texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys, values = [], []
            for index, text in texts.features():
                n = np.bincount(text, minlength=j - i)
                key, count = np.unique(text << (BITS + 2) | index, return_counts=True)
                keys.append(key)
                values.append(count / n[key >> (BITS + 2)])
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key)
            key, value = key[order], value[order]
            sizes = np.bincount(key >> (BITS + 2), minlength=j - i)
            index = pa.array(key & ((1 << (BITS + 2)) - 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), A.list_array(index, sizes), A.list_array(pa.array(value, pa.float32()), sizes), *(batch.column(k).slice(i, j - i) for k in (2, 3))],
                names=["label", "index", "value", "h", "doc"],
            )


SCALE = 50.0  # shares are small numbers; so scaled, a step of the fit moves all weights alike


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:  # the fit must not depend on the order in which rows arrive
        table = pa.Table.from_batches(held).combine_chunks()
        order = np.lexsort((table.column(4).to_numpy(), table.column(3).to_numpy()))
        held = table.take(pa.array(order)).combine_chunks().to_batches()
    label = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0, int)
    if len(np.unique(label)) < 2:
        return
    sizes = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
    index = np.concatenate([b.column(1).values.to_numpy() for b in held])
    value = np.concatenate([b.column(2).values.to_numpy() for b in held]) * SCALE
    # Every fifth row of each class calibrates; with few rows all do both.
    order = np.zeros(len(label), int)
    for kind in (0, 1):
        order[label == kind] = np.arange((label == kind).sum())
    fit = order % 5 != 4 if np.bincount(label, minlength=2).min() >= 10 else np.ones(len(label), bool)
    row = np.repeat(fit, sizes)
    w, b = logistic(index[row], value[row], sizes[fit], label[fit], 3 << BITS, l2=1e-4, steps=120, rate=0.05)
    rest = ~fit if not fit.all() else fit
    row = np.repeat(rest, sizes)
    which = np.repeat(np.arange(rest.sum()), sizes[rest])
    z = np.bincount(which, value[row] * w[index[row]], minlength=rest.sum()) + b
    slope, shift = calibration(z, label[rest])
    weights = np.append(w * SCALE * slope, b * slope + shift).astype(np.float32)
    yield pa.RecordBatch.from_arrays([A.list_array(pa.array(weights), np.array([len(weights)]))], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> np.ndarray | None:
    """Calibrated weights, the intercept last, from at most about ``most`` labelled documents with text.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). None if either class is missing.
    """
    picked = bounded_sample(one_label(labels, "quality"), most)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", "label", F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("bigint").alias("doc"))
    prepared = rows.mapInArrow(A.released(_train_rows), "label int, index array<int>, value array<float>, h bigint, doc bigint")
    got = prepared.repartition(1).mapInArrow(A.released(_fit), "weights array<float>").toArrow()
    return got.column("weights").combine_chunks().values.to_numpy() if got.num_rows else None


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets, SLICE):
                texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = texts.measures()
                w = weights.value
                score = np.ones(j - i) if w is None else sigmoid(texts.scores(w[:-1], float(w[-1])))
                columns = [pa.array(found[k].astype(np.int64)) for k in MEASURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns, pa.array(score)], names=["doc_id", *MEASURES, "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, the measures, ``base_failed``, ``score`` (probability of good) and ``kept``.

    The base rules fail texts under 50 words and texts where more than half of the words stand in repeated windows
    of three. Null is an empty text, which fails. Without labels of both classes the classifier accepts everything.
    Repeated rows give repeated rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))  # of fixed size
    measured = rows.mapInArrow(A.released(_judge(weights)), f"doc_id bigint, {', '.join(f'{m} bigint' for m in MEASURES)}, score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def _filter(weights, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column(text_at))
            w = weights.value
            for i, j in A.slices(offsets, SLICE):
                texts = Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = texts.measures()
                kept = (found["n_words"] >= 50) & (100 * found["n_repeat_words"] <= 50 * found["n_words"])
                if w is not None:
                    kept &= sigmoid(texts.scores(w[:-1], float(w[-1]))) >= threshold
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps, each by its own text, whatever its id; nothing is shuffled."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))  # of fixed size
    return docs.mapInArrow(A.released(_filter(weights, docs.columns.index("text"), threshold)), docs.schema)
