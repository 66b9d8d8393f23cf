"""Resampling of documents towards a target distribution of hashed n-grams.

The texts of a batch are joined with a separator byte between them, and one pass of a regular expression over the joined
bytes finds all words. The document of a word follows from its position by binary search; neighbours in different
documents form no pair. Buckets are checksums (CRC-32) of words and word pairs, computed for all words at once, byte by
byte, and counted with ``bincount``. A text longer than ``PART`` bytes is cut between words; a part starts with
the last word of the one before it, for the pair that crosses the cut.

Both corpora are counted in full: each task sends at most one row per bucket. The gains, one number per bucket, go back to
the tasks. Scores are whole numbers plus seeded Gumbel noise, so the best of them are a draw without replacement.
Ranks come from the number of documents per score, of which there are some ten thousands whatever the corpus; only the
documents of the draw are shuffled, by score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import stored

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
PART = 1 << 20
LONG_WORD = 48
SPACE = 0x20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> np.uint32(1)) ^ np.uint32(0xEDB88320), _TABLE >> np.uint32(1)).astype(np.uint32)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def span_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of every span; with ``before`` that of the bytes of those checksums, a space and the span."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32) if before is None else _step(~before, np.uint32(SPACE))
    long = np.flatnonzero(sizes > LONG_WORD)
    order = np.argsort(-np.minimum(sizes, LONG_WORD), kind="stable")[len(long) :]
    at, left, running = starts[order], sizes[order], state[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # spans longer than k come first
        running[:n] = _step(running[:n], data[at[:n] + k])
    out = np.empty(len(starts), np.uint32)
    out[order] = ~running
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(~state[i]))
    return out


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of some texts with one zero byte after each, and where each text starts."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(sizes))
    out = np.zeros(len(data) + len(sizes), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER[data]
    return out, starts


def _spans(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter(chain.from_iterable(map(re.Match.span, _WORD.finditer(joined.tobytes()))), np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1] - flat[:, 0]


def _parts(data: np.ndarray, part: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Cuts of one long text between words, and whether the first word only leads into the pair across the cut."""
    lower = _LOWER[data]
    word = np.zeros(len(lower) + 2, bool)
    word[1:-1] = (lower >= 0x80) | ((lower >= 0x61) & (lower <= 0x7A)) | ((lower >= 0x30) & (lower <= 0x39))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + part, "right")), i + 1)
        lead = i > 0
        yield data[starts[i - lead] : ends[j - 1]], lead
        i = j


def _buckets(data: np.ndarray, offsets: np.ndarray, lead: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the words and of the word pairs of some texts."""
    joined, text_starts = _joined(data, offsets)
    starts, sizes = _spans(joined)
    text = np.searchsorted(text_starts, starts, "right") - 1
    words = span_checksums(joined, starts, sizes)
    yield text[lead:], (words[lead:] % np.uint32(BUCKETS)).astype(np.int64)
    inside = np.flatnonzero(text[1:] == text[:-1])
    pairs = span_checksums(joined, starts[inside + 1], sizes[inside + 1], words[inside])
    yield text[inside], (pairs % np.uint32(BUCKETS)).astype(np.int64)


def features(column: pa.Array, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of a column of whole texts, slice after slice."""
    data, offsets = A.utf8(column)
    for i, j in A.slices(offsets, part):
        piece = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(piece) > part:
            for cut, lead in _parts(piece, part):
                for text, bucket in _buckets(cut, np.array([0, len(cut)]), lead):
                    yield text + i, bucket
        else:
            for text, bucket in _buckets(piece, offsets[i : j + 1] - offsets[i]):
                yield text + i, bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, bucket in features(batch.column(0)):
            counts += np.bincount(bucket, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; at most ``BUCKETS`` rows reach the driver."""
    got = texts.select(F.col("text").cast("string")).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target to source frequency, rounded down, by bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weigh(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for text, bucket in features(batch.column(1)):
                n += np.bincount(text, minlength=len(batch))
                total += np.bincount(text, gain.value[bucket], minlength=len(batch)).astype(np.int64)  # whole numbers far below 2**53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_features, weight, score, rank`` (null if not drawn).

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; further columns are not read. Of the documents with at
    least ``least_words`` words ``share`` percent (rounded down) are drawn, by score, ties to the smaller id.

    Null and empty texts have no features and weight 0. Rows with a null id have no score, are not drawn and do not count
    among the documents drawn from. Repeated rows are rows of their own, with neighbouring ranks. An empty target gives
    the gains of smoothing alone; an empty ``docs`` gives an empty table.
    """
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))  # BUCKETS numbers
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    weighed = rows.mapInArrow(_weigh(gain), "doc_id bigint, n_features bigint, weight bigint")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scored")
    # n words have 2 n - 1 features.
    able = (F.col("n_features") >= 2 * least_words - 1) & F.col("score").isNotNull()
    per_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    higher = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One row per score: some ten thousands, as weights and noise are bounded.
    starts = per_score.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"), F.floor(F.sum("n").over(all_rows) * share / 100).alias("drawn"))
    open_scores = stored(starts.where("above < drawn").select(F.col("score").alias("__score"), "above", "drawn"), "scores")
    joined = scored.withColumn("__able", able).join(F.broadcast(open_scores), F.col("__able") & (F.col("score") == F.col("__score")), "left")
    within = W.partitionBy("score").orderBy("doc_id", "n_features")
    place = F.col("above") + F.row_number().over(within)
    ranked = joined.where(F.col("above").isNotNull()).withColumn("rank", place)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("bigint").alias("rank"))
    return joined.where(F.col("above").isNull()).select(*columns, F.lit(None).cast("bigint").alias("rank")).unionByName(drawn)
