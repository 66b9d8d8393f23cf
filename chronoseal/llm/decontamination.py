"""Distributed positional inverted index and benchmark decontamination.

The index has one row per segment: some hundred thousand words of whole documents, with a sorted term list, the end
of each posting list and the word positions of all terms, list after list. Segments are built where the documents
are scanned, without a shuffle, and written as Parquet in the shared folder, so that a lost executor costs single tasks.
The lists are bytes of little-endian numbers and each segment is a row group, because Spark decodes a row group at once and
keeps two levels beside each number of a list column.
A search sends its phrases, in blocks of a fixed size, to every segment. There the lists of a phrase are intersected
from the rarest term on: the positions of the rarest term, less its offset, are the candidates; each further
list, shifted by its own offset, keeps those it contains. A phrase with a term that the segment lacks ends at once.
Every task holds one segment and one block at a time, whatever the key frequencies are.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import stored
from .leavers import row_key, without

SEGMENT_WORDS = 1 << 18
BLOCK_PHRASES = 200_000
SLICE = 1 << 18

INDEX = "segment bigint, doc_ids array<bigint>, doc_words array<int>, doc_starts binary, terms binary, ends binary, postings binary"
#: Kinds of numbers in the binary columns.
PACKED = {"doc_starts": "<i4", "terms": "<i8", "ends": "<i4", "postings": "<i4"}
#: Without the limit a row group ends at its first check of size, after 100 segments.
ROW_GROUP = {"parquet.block.row.count.limit": "1"}
MATCHES = "segment bigint, slot int, doc_id bigint, item_id bigint, spans array<struct<start:int,stop:int>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words of some texts, and the words of each text."""
    lower = _LOWER[data]
    starts, ends = A.runs(_WORD[lower], offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    return A.span_hashes(lower, starts, ends - starts).view(np.int64), counts


def _segment(segment: int, ids: list[pa.Array], terms: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    doc_ids = pa.concat_arrays(ids)
    flat, n = np.concatenate(terms), np.concatenate(counts)
    # One free position after each document keeps phrases from crossing into the next.
    first = np.cumsum(n) - n + np.arange(len(n))
    positions = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    last = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(0, np.int64)
    one = lambda values: A.list_array(values, np.array([len(values)]))
    packed = {"doc_starts": first, "terms": ordered[last], "ends": last + 1, "postings": positions[order]}
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segment], pa.int64()),
            one(doc_ids),
            one(pa.array(n, pa.int32())),
            *(pa.array([values.astype(PACKED[name]).tobytes()], pa.binary()) for name, values in packed.items()),
        ],
        names=["segment", "doc_ids", "doc_words", *packed],
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, terms, counts, total, made = [], [], [], 0, 0
    base = None
    for batch in batches:
        texts = batch.column(2)
        if base is None and len(batch):
            base = batch.column(0)[0].as_py()
        data, offsets = A.utf8(texts)
        for i, j in A.slices(offsets, SLICE):
            found, n = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(batch.column(1).slice(i, j - i))
            terms.append(found)
            counts.append(n)
            total += len(found) + j - i
            if total >= SEGMENT_WORDS:
                yield _segment(base + made, ids, terms, counts)
                ids, terms, counts, total, made = [], [], [], 0, made + 1
    if ids:
        yield _segment(base + made, ids, terms, counts)


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of whole texts (null: no words) as a stored table, one row per segment.

    Repeated rows and repeated ids are documents of their own; ids may be null. Further columns are not read.
    """
    # Unique per partition and row, hence a unique base for the segments of a task.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "text")
    return stored(rows.mapInArrow(A.released(_build), INDEX), "index", **ROW_GROUP)


def index_documents(index: DataFrame) -> DataFrame:
    """One row per indexed document: ``segment, slot, doc_id, n_words``; reads neither terms nor postings."""
    flat = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("slot", "d"))
    return flat.select("segment", "slot", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("bigint").alias("n_words"))


def _phrases(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets, SLICE):
                found, n = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                length = np.minimum(n, window)
                per_item = np.where(n > 0, n - length + 1, 0)
                first = A.ragged(np.cumsum(n) - n, per_item)
                sizes = np.repeat(length, per_item)
                ids = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), per_item)))
                yield pa.RecordBatch.from_arrays(
                    [ids, A.list_array(pa.array(found[A.ragged(first, sizes)]), sizes)], names=["item_id", "terms"]
                )

    return cut


def phrases(items: DataFrame, window: int) -> DataFrame:
    """All runs of ``window`` words of each item (``item_id``, ``text``); a shorter item, not empty, is one run."""
    cut = items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(A.released(_phrases(window)), "item_id bigint, terms array<bigint>")
    return cut.distinct()


class Segment:
    """Posting lists of one segment. ``keys`` holds (list number, position) pairs in ascending order."""

    def __init__(self, row: dict[str, np.ndarray]) -> None:
        self.terms, self.ends, self.postings = row["terms"], row["ends"].astype(np.int64), row["postings"].astype(np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.doc_starts, self.doc_words = row["doc_starts"].astype(np.int64), row["doc_words"].astype(np.int64)
        self.span = int(self.doc_starts[-1] + self.doc_words[-1] + 2) if len(self.doc_starts) else 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.starts) * self.span + self.postings

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """List numbers of terms; -1 where the segment lacks the term."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def size(self, lists: np.ndarray) -> np.ndarray:
        return self.ends[lists] - self.starts[lists]

    def contains(self, lists: np.ndarray, positions: np.ndarray) -> np.ndarray:
        key = lists * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (positions >= 0) & (positions < self.span) & (self.keys[at] == key)

    def rarest_first(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of list numbers) whose terms all occur, and their word offsets by list size."""
        alive = np.flatnonzero((phrases >= 0).all(axis=1))
        lists = phrases[alive]
        return alive, lists, np.argsort(self.size(lists), axis=1, kind="stable")

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all places where the words of a phrase follow each other."""
        alive, lists, order = self.rarest_first(phrases)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.arange(len(alive))
        rare = lists[rows, order[:, 0]]
        n = self.size(rare)
        which = np.repeat(rows, n)
        start = self.postings[A.ragged(self.starts[rare], n)] - np.repeat(order[:, 0], n)
        for k in range(1, lists.shape[1]):
            offset = order[which, k]
            keep = self.contains(lists[which, offset], start + offset)
            which, start = which[keep], start[keep]
        return alive[which], start

    def near(self, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first, last) of the span around each occurrence of the rarest word, if every other word
        has an occurrence at most ``slop`` words away in the same document."""
        alive, lists, order = self.rarest_first(phrases)
        if not len(alive):
            return (np.zeros(0, np.int64),) * 3
        rows = np.arange(len(alive))
        rare = lists[rows, order[:, 0]]
        n = self.size(rare)
        which = np.repeat(rows, n)
        anchor = self.postings[A.ragged(self.starts[rare], n)]
        first, last = anchor.copy(), anchor.copy()
        for k in range(1, lists.shape[1]):
            other = lists[which, order[which, k]]
            doc = np.searchsorted(self.doc_starts, anchor, "right") - 1
            low = np.maximum(anchor - slop, self.doc_starts[doc])
            high = np.minimum(anchor + slop, self.doc_starts[doc] + self.doc_words[doc] - 1)
            after = np.searchsorted(self.keys, other * self.span + anchor)
            right = self.keys[np.minimum(after, len(self.keys) - 1)] - other * self.span
            left = self.keys[np.maximum(after - 1, 0)] - other * self.span
            on_right, on_left = (right >= anchor) & (right <= high) & (after < len(self.keys)), (left <= anchor) & (left >= low) & (after > 0)
            near = np.where(on_right & (~on_left | (right - anchor <= anchor - left)), right, left)
            keep = on_right | on_left
            which, anchor = which[keep], anchor[keep]
            first, last = np.minimum(first, near)[keep], np.maximum(last, near)[keep]
        return alive[which], first, last


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, dict[str, np.ndarray]]]:
    for i in range(len(batch)):
        value = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: E731, B023
        arrays = {k: np.frombuffer(value(k).as_buffer(), kind) for k, kind in PACKED.items()}
        arrays["doc_words"] = value("doc_words").values.to_numpy(zero_copy_only=False)
        yield batch.column(0)[i].as_py(), value("doc_ids").values, arrays


def _merged(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each group."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    shift = (int(stop.max()) + 2) * group  # so that one running maximum serves all groups
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(group), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    ends = reach[np.concatenate((at[1:] - 1, [len(group) - 1]))] - shift[at]
    return group[at], start[at], ends


def _search(block, slop: int | None):
    """``block``: broadcast list of (item ids, phrase terms), one for each phrase length."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, doc_ids, row in _rows(batch):
                if not len(row["terms"]):
                    continue
                lists = Segment(row)
                items, starts, stops = [], [], []
                for item_ids, terms in block.value:
                    coded = lists.lists(terms)
                    if slop is None:
                        which, start = lists.exact(coded)
                        stop = start + terms.shape[1]
                    else:
                        which, start, stop = lists.near(coded, slop)
                        stop = stop + 1
                    items.append(item_ids[which])
                    starts.append(start)
                    stops.append(stop)
                item, start, stop = map(np.concatenate, (items, starts, stops))
                if not len(item):
                    continue
                slot = np.searchsorted(lists.doc_starts, start, "right") - 1
                names, code = np.unique(item, return_inverse=True)
                group, start, stop = _merged(slot * len(names) + code, start, stop)
                pairs, n = np.unique(group, return_counts=True)
                slots = pairs // len(names)
                base = np.repeat(lists.doc_starts[slots], n)
                spans = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(stop - base, pa.int32())], names=["start", "stop"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs), segment)),
                        pa.array(slots, pa.int32()),
                        doc_ids.take(pa.array(slots)),
                        pa.array(names[pairs % len(names)]),
                        A.list_array(spans, n),
                    ],
                    names=["segment", "slot", "doc_id", "item_id", "spans"],
                )

    return search


def _blocks(table: DataFrame, most: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    n = -(-table.count() // most)
    for b in range(n):
        picked = table.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == b) if n > 1 else table
        got = picked.toArrow()
        terms = got.column("terms").combine_chunks()
        ids, sizes = got.column("item_id").to_numpy(), np.diff(terms.offsets.to_numpy())
        flat, first = terms.values.to_numpy(), terms.offsets.to_numpy()[:-1].astype(np.int64)
        yield [(ids[sizes == s], flat[A.ragged(first[sizes == s], sizes[sizes == s])].reshape(-1, s)) for s in np.unique(sizes)]


def _matches(index: DataFrame, wanted: DataFrame, slop: int | None, most: int) -> DataFrame:
    spark: SparkSession = index.sparkSession
    found = None
    for block in _blocks(stored(wanted, "phrases"), most):
        if not block:
            continue
        part = index.mapInArrow(A.released(_search(spark.sparkContext.broadcast(block), slop)), MATCHES)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], MATCHES) if found is None else found


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, most: int = BLOCK_PHRASES) -> DataFrame:
    """Exact matches of all windows of the items: one row per document, item and block of at most about ``most`` windows.

    ``spans`` are the merged word ranges of the document inside any occurrence. Items without words match nowhere.
    """
    return _matches(index, phrases(items, window), None, most)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, window: int = 10, most: int = BLOCK_PHRASES) -> DataFrame:
    """As :func:`phrase_matches`, but in any order: all words of a window stand at most ``slop`` words from an
    occurrence of its rarest word. A span runs from the first to the last of the nearest occurrences."""
    return _matches(index, phrases(items, window), slop, most)


def _hit_words() -> Column:
    every = F.flatten(F.collect_list("spans"))
    positions = F.flatten(F.transform(every, lambda s: F.sequence(s["start"], s["stop"] - 1)))
    return F.size(F.array_distinct(positions)).cast("bigint")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, item_ids`` (sorted as text), ``contaminated``.

    A word is hit if it lies in an occurrence of any window of an item. Null or empty text has no words. Items that
    repeat count once by id. Empty tables on either side give rows without hits, or no rows.
    """
    index = build_index(docs)
    per_doc = phrase_matches(index, items, window).groupBy("segment", "slot").agg(
        _hit_words().alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    rows = index_documents(index).join(per_doc, ["segment", "slot"], "left")
    hits = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (hits > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Rows of ``docs`` without a window of any item, each judged by its own text, whatever its id."""
    key = row_key(F.col("doc_id"), F.col("text"))
    dirty = contamination(docs.select(key.alias("doc_id"), "text"), items, window).where("contaminated")
    return without(docs, key, stored(dirty.select("doc_id").distinct(), "dirty"))


#: DuckDB SQL: ``{name}`` has one row per document of ``{docs}``.
SQL = """{name}_d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
    {name}_i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    {name}_g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM {name}_i WHERE len(w) > 0)),
    {name}_n AS (SELECT DISTINCT n FROM {name}_g),
    {name}_p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM {name}_d, {name}_n WHERE len(w) >= n),
    {name}_m AS (SELECT doc_id, item_id, p, {name}_p.n FROM {name}_p JOIN {name}_g ON {name}_g.n = {name}_p.n AND gram = array_to_string(w[p:p + {name}_p.n - 1], ' ')),
    {name}_h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM {name}_m) GROUP BY doc_id),
    {name}_s AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM {name}_m) GROUP BY doc_id),
    {name} AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated FROM {name}_d LEFT JOIN {name}_h USING (doc_id) LEFT JOIN {name}_s USING (doc_id))"""
