"""Languages of a text as a mixture: proportions by expectation-maximisation over word likelihoods.

Character triples of lower-cased words (with a blank at both ends) are hashed into ``2 ** BITS`` bins; the counts of each
bin and language over labelled documents give smoothed triple probabilities. Every word of a text has a likelihood
under each language; the proportions of the languages maximise the likelihood of all words. The set of languages
is found by leaving out the weakest one as long as the likelihood, penalised by the size of the set, does not fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .fitting import draw, share_limit
from .pretokens import classes, code_points

SAMPLE = 8_000
BITS = 16
SMOOTHING = 0.5
ROUNDS = 6
STRENGTH = 3.0
_LETTER = 1
_U = np.uint64
_LOWER: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """Lower-case form of every letter, 0 for other code points."""
    if not _LOWER:
        letter = np.flatnonzero(classes() == _LETTER)
        table = np.zeros(0x110000, np.uint32)
        table[letter] = [ord(chr(c).lower()[0]) for c in letter]
        _LOWER.append(table)
    return _LOWER[0]


def triples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of the triple around each letter, the letters of each word, and the words of each text."""
    points = lower_letters()[code_points(data)] if len(data) else np.zeros(0, np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(place, offsets)
    starts, ends = A.runs(points != 0, bounds)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = points[A.ragged(starts, sizes)].astype(_U)
    before, after = np.concatenate(([_U(0)], letters[:-1])), np.concatenate((letters[1:], [_U(0)]))
    before[first] = 0
    after[first + sizes - 1] = 0
    table = A.powers(4)
    h = before * table[1] + letters * table[2] + after * table[3]
    h = (h ^ (h >> _U(31))) * table[1]
    return (h >> _U(64 - BITS)).astype(np.int64), sizes, np.diff(np.searchsorted(starts, bounds))


@dataclass(frozen=True)
class Languages:
    names: tuple[str, ...]
    log_p: np.ndarray  # bins x languages


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = A.utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for i, j in A.slices(offsets):
            bins, sizes, words = triples(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text = np.repeat(np.repeat(np.arange(j - i), words), sizes)
            names, code = np.unique(langs[i:j], return_inverse=True)
            for k, name in enumerate(names):
                sums.setdefault(name, np.zeros(1 << BITS, np.int64))
                sums[name] += np.bincount(bins[code[text] == k], minlength=1 << BITS)
    for name, n in sums.items():
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held), pa.array(n[held])], names=["lang", "bin", "n"])


def learn(docs: DataFrame, most: int = SAMPLE) -> Languages:
    """Triple probabilities of each language that a document has, from at most about ``most`` of each.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; rows with a null in any of them are left out. At most ``2 ** BITS`` numbers
    of each language reach the driver.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Languages((), np.zeros((1 << BITS, 0), np.float32))
    names = tuple(sorted(sizes))
    limits = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(share_limit(most, sizes[name])).cast("bigint"))])
    picked = known.where(draw("doc_id") < limits[F.col("lang")])
    summed = picked.select("text", "lang").mapInArrow(_counts, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BITS, len(names)))
    column = np.searchsorted(names, summed.column("lang").to_pylist()) if summed.num_rows else np.zeros(0, np.int64)
    counts[summed.column("bin").to_numpy(), column] = summed.column("n").to_numpy()
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts))
    return Languages(names, np.log(p).astype(np.float32))


def _weighted(words: np.ndarray, share: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One EM step: new shares of each text and the log-likelihood of each text under the old ones."""
    joint = words * share[text]
    total = joint.sum(axis=1)
    new = np.add.reduceat(joint / total[:, None], first, axis=0)
    return new / new.sum(axis=1, keepdims=True), np.add.reduceat(np.log(total), first)


def mixture(likelihood: np.ndarray, n: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Shares of the languages of each text. ``likelihood``: words x languages, each row scaled; ``n``: words per text, all > 0."""
    languages = likelihood.shape[1]
    share = np.full((len(n), languages), 1.0 / languages)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    for _ in range(ROUNDS):
        share, _ = _weighted(likelihood, share, text, first)
    fit = _weighted(likelihood, share, text, first)[1]
    open_ = np.arange(len(n))
    for _ in range(languages - 1):
        tried = share[open_].copy()
        size = (tried > 0).sum(axis=1)
        weakest = np.where(tried > 0, tried, np.inf).argmin(axis=1)
        more = size > 1
        open_, tried, weakest = open_[more], tried[more], weakest[more]
        if not len(open_):
            break
        tried[np.arange(len(open_)), weakest] = 0
        # The others take over in proportion; a floor lets them come back from nothing.
        tried = np.where(share[open_] > 0, np.maximum(tried, 1e-6), 0)
        tried[np.arange(len(open_)), weakest] = 0
        tried /= tried.sum(axis=1, keepdims=True)
        rows = A.ragged(first[open_], n[open_])
        part, part_text = likelihood[rows], np.repeat(np.arange(len(open_)), n[open_])
        part_first = np.cumsum(n[open_]) - n[open_]
        for _ in range(2):
            tried, _ = _weighted(part, tried, part_text, part_first)
        now = _weighted(part, tried, part_text, part_first)[1]
        better = now + strength * (1 + 0.5 * np.log(n[open_])) >= fit[open_]
        kept = open_[better]
        share[kept], fit[kept] = tried[better], now[better]
        open_ = kept
    return share


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = model.value.names, model.value.log_p
        label = pa.array([*names, "und"], pa.string())
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets):
                bins, sizes, words = triples(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                shares = np.zeros((j - i, len(names)))
                full = np.flatnonzero(words > 0)
                if len(full) and names:
                    each = np.add.reduceat(log_p[bins], np.cumsum(sizes) - sizes, axis=0).astype(np.float64)
                    # Scaling a word's likelihoods leaves shares and comparisons as they are; the floor bounds one word.
                    likelihood = np.exp(np.maximum(each - each.max(axis=1, keepdims=True), -30.0))
                    shares[full] = mixture(likelihood, words[full])
                best = shares.argmax(axis=1) if names else np.zeros(j - i, np.int64)
                score = shares[np.arange(j - i), best] if names else np.zeros(j - i)
                best = np.where(score > 0, best, len(names))
                row, column = np.nonzero(shares)
                found = pa.StructArray.from_arrays([label.take(pa.array(column)), pa.array(shares[row, column])], names=["lang", "share"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), label.take(pa.array(best)), pa.array(np.minimum(score, 1.0)), A.list_array(found, np.bincount(row, minlength=j - i))],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    return run


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred`` (the language of the largest share), ``score`` (that share), ``languages``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when no language was learned.
    Equal shares go to the first name. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers per language
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
