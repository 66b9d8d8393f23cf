"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding puts letters in lower case, drops accents and invisible characters, and maps look-alike letters and the digits that
stand for letters to one letter each (1, l and i become one letter). The lexicon is learned from labelled rows: word
beginnings and whole words that stand in toxic documents far more often than in others, weighted by the smoothed
logarithm of the odds. Phrases (a matched word with a neighbour) that stand in clean documents are exceptions:
a match inside one does not count. The weights of a text are added up and set against its number of words; a
logistic curve over the sum and the rate, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .fitting import bounded_sample, one_label, sigmoid
from .pretokens import code_points

SAMPLE = 12_000
BEGINNINGS = (4, 5, 6, 8)
LEAST_DOCS = 4
LEAST_GAIN = 14.0
LEAST_WEIGHT = 3.0
MOST_WEIGHT = 8.0
#: Letters of other scripts that look like Latin letters.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "д": "d", "ӏ": "i",
    "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e",
}
#: Digits and signs that stand for letters; l shares the letter of 1 and i.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
SIGNS = {"@": "a", "$": "s"}
_GONE, _BREAK = 0, 32
_TABLE: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Folded code point of every code point: a letter or digit, a blank for a word break, 0 for nothing."""
    if not _TABLE:
        table = np.full(0x110000, _BREAK, np.uint32)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN":
                base = unicodedata.normalize("NFKD", chr(c))[0].lower()[0] if c > 127 else chr(c).lower()
                base = LOOK_ALIKE.get(base, base)
                table[c] = ord(STANDS_FOR.get(base, base))
            elif kind in ("Mn", "Me", "Cf"):
                table[c] = _GONE
        _TABLE.append(table)
    return _TABLE[0]


def fold(text: str | None) -> str:
    """Folded words of a text, one blank before, between and after them."""
    if not text:
        return " "
    points = code_points(np.frombuffer(text.encode(), np.uint8))
    folded = fold_table()[points]
    for sign, letter in SIGNS.items():  # inside a word only
        at = np.flatnonzero(points == ord(sign))
        at = at[(at > 0) & (at < len(points) - 1)]
        at = at[(folded[at - 1] > 32) & (folded[at + 1] > 32)]
        folded[at] = ord(letter)
    folded = folded[folded != _GONE]
    blank = folded == _BREAK
    folded = folded[~(blank & np.concatenate(([True], blank[:-1])))]
    body = folded.astype("<u4").tobytes().decode("utf-32-le").strip(" ")
    return f" {body} " if body else " "


@dataclass(frozen=True)
class Model:
    """Patterns with weights, exception phrases (all folded) and the curve of the score."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


class Matcher:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase in model.exceptions:
            self.machine.add_word(phrase, (len(phrase), None))
        for pattern, weight in model.lexicon:
            if pattern not in self.machine:
                self.machine.add_word(pattern, (len(pattern), weight))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(first, last, weight) of the matches outside exception phrases."""
        if self.empty:
            return []
        found, excused = [], []
        for last, (size, weight) in self.machine.iter(folded):
            (excused if weight is None else found).append((last - size + 1, last, weight))
        if not excused:
            return found
        excused.sort()
        starts = [e[0] for e in excused]
        reach = list(accumulate((e[1] for e in excused), max))  # farthest end of the phrases that start so early
        at = [bisect_right(starts, h[0]) for h in found]
        return [h for h, k in zip(found, at) if not k or reach[k - 1] < h[1]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(fold(text).split())
            seen = {f" {w} " for w in words}
            seen.update(f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k)
            counts[label].update(seen)
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([counts[1][k] for k in names], pa.int64()), pa.array([counts[0][k] for k in names], pa.int64())], names=["pattern", "toxic", "clean"]
    )


def _select(counted: Sequence[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """Patterns by length; one that starts with a chosen one adds nothing."""
    chosen: dict[str, float] = {}
    for pattern, toxic, clean in sorted(counted, key=lambda r: (len(r[0].rstrip()), r[0])):
        weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        # Log-likelihood gained over the share of all documents: rare patterns are toxic by chance.
        n, share = toxic + clean, n_toxic / (n_toxic + n_clean)
        gain = sum(k * np.log(k / (n * p)) for k, p in ((toxic, share), (clean, 1 - share)) if k)
        if weight >= LEAST_WEIGHT and gain >= LEAST_GAIN and not any(pattern[:k] in chosen for k in range(2, len(pattern))):
            chosen[pattern] = float(min(weight, MOST_WEIGHT))
    return sorted(chosen.items())


def _contexts(model):
    """Per text: label, sum of weights, words; and the phrases around each match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.value)
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                phrases, total = set(), 0.0
                for first, last, weight in matcher.hits(folded):
                    end = folded.index(" ", last) if folded[last] != " " else last
                    total += weight
                    before, after = folded.rfind(" ", 0, first), folded.find(" ", end + 1)
                    if before >= 0:
                        phrases.add(folded[before : end + 1])
                    if after >= 0:
                        phrases.add(folded[first : after + 1])
                out.append({"label": label, "total": total, "words": folded.count(" ") - 1 if len(folded) > 1 else 0, "phrases": sorted(phrases)})
            yield pa.RecordBatch.from_pylist(
                out, schema=pa.schema([("label", pa.int32()), ("total", pa.float64()), ("words", pa.int64()), ("phrases", pa.list_(pa.string()))])
            )

    return run


def _design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], axis=1)


def _curve(total: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slightly ridged."""
    x, w = _design(total, words), np.zeros(3)
    for _ in range(60):
        p = sigmoid(x @ w)
        slope = x.T @ (p - label) + 0.1 * w
        w = w - np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), slope), -2, 2)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, exceptions: Sequence[str] = ()) -> Model:
    """Model from at most about ``most`` labelled documents; ``labels`` has ``doc_id`` and ``toxic``.

    Further exception phrases may be given in plain text. Without labels of both classes nothing matches and every
    score is 0. What reaches the driver is bounded by the sample.
    """
    spark = docs.sparkSession
    picked = bounded_sample(one_label(labels, "toxic"), most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label").dropDuplicates(["text"])
    given = tuple(fold(e) for e in exceptions)
    counted = rows.mapInArrow(_candidates, "pattern string, toxic bigint, clean bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    # Less odds than these are under the least weight.
    odds = (F.col("toxic") + 0.5) * (n_clean + 1) >= (F.col("clean") + 0.5) * (n_toxic + 1) * float(np.exp(LEAST_WEIGHT))
    found = {r[0]: (r[1], r[2]) for r in counted.where((F.col("toxic") >= LEAST_DOCS) & odds).collect()} if n_toxic and n_clean else {}
    if not found:
        return Model((), given, (-30.0, 0.0, 0.0))
    lexicon = tuple(_select([(k, *v) for k, v in found.items()], n_toxic, n_clean))
    first = spark.sparkContext.broadcast(Model(lexicon, given, (0.0, 0.0, 0.0)))
    seen = rows.mapInArrow(_contexts(first), "label int, total double, words bigint, phrases array<string>")
    around = seen.select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    excused = [r[0] for r in around.where((F.col("clean") >= 3) & (F.col("clean") >= 4 * F.col("toxic"))).collect()]
    model = spark.sparkContext.broadcast(Model(lexicon, (*given, *sorted(excused)), (0.0, 0.0, 0.0)))
    points = rows.mapInArrow(_contexts(model), "label int, total double, words bigint, phrases array<string>").select("label", "total", "words").toArrow()
    curve = _curve(points.column("total").to_numpy(), points.column("words").to_numpy(), points.column("label").to_numpy())
    return Model(lexicon, model.value.exceptions, curve)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.value)
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets):
                folded = [fold(t) for t in batch.column(1).slice(i, j - i).to_pylist()]
                hits = [matcher.hits(f) for f in folded]
                total = np.array([sum(h[2] for h in found) for found in hits])
                words = np.array([max(0, f.count(" ") - 1) for f in folded])
                score = sigmoid(_design(total, words) @ np.array(model.value.curve))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array([len(h) for h in hits], pa.int64()), pa.array(total, pa.float64())],
                    names=["doc_id", "score", "n_matches", "weight"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1), ``n_matches``, ``weight``. Null and empty texts match nothing.

    Whole texts are matched; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_score(shared), "doc_id bigint, score double, n_matches bigint, weight double")
