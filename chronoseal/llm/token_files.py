"""Token ids as Parquet list columns that can be read in part.

A written folder holds one row per document in ascending ``doc_id`` order, file after file: ``doc_id``, further columns
of the documents, ``part`` (the file), ``at`` (ids before it in the file), ``n_tokens`` and ``ids``. Ids are dictionary
or delta encoded, the ascending columns delta encoded. Row groups and pages are small and carry page indexes, so
that a filter on ``doc_id`` reads few pages, and columns other than ``ids`` are read without touching the ids.

Texts are encoded by the tokenizers library. With a plain byte-level tokenizer the words of a text are encoded
independently, so each task sends every different word to the library once and reuses its ids; with any other
tokenizer whole texts are sent. The order is made by range partitioning (ties split by a hash of the text), so no
task gets more than its share; the ids before each file follow from one number per file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .bpe import cut_words
from .hashtable import HashMap

OWN = ("part", "at", "n_tokens", "ids")
CACHED_WORDS = 1_000_000


class LibraryEncoder:
    """Encodes many texts with the tokenizers library, each different word once where words are independent."""

    def __init__(self, config: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        stated = json.loads(config)
        split = stated.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        added = stated["added_tokens"]
        self.by_word = bool(plain and not stated.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        self.specials = {t["content"]: t["id"] for t in added}
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.starts, self.counts = HashMap(16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(g) for g in got], np.int64)
        return np.fromiter((i for g in got for i in g), np.int64, int(counts.sum())), counts

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        if self.known.n + len(hashes) > CACHED_WORDS:
            self._forget()
        new, at = np.unique(hashes, return_index=True)
        fresh = self.known.get(new) < 0
        new, at = new[fresh], at[fresh]
        raw = data.tobytes()
        ids, counts = self._library([raw[s : s + n].decode() for s, n in zip(starts[at].tolist(), sizes[at].tolist())])
        self.known.add(new, np.arange(len(self.counts), len(self.counts) + len(new)))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if not self.by_word:
            raw = data.tobytes()
            return self._library([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
        starts, sizes, _ = cut_words(data, offsets, self.specials)
        hashes = A.span_hashes(data, starts, sizes)
        word = self.known.get(hashes)
        if (word < 0).any():
            self._learn(data, starts, sizes, hashes)  # all words of the slice: the cache may start anew
            word = self.known.get(hashes)
        counts = self.counts[word]
        ids = self.ids[A.ragged(self.starts[word], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)]
        return ids, np.diff(ends)


_OPEN: dict[int, LibraryEncoder] = {}


def _encoder(config) -> LibraryEncoder:
    key = hash(config.value)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = LibraryEncoder(config.value)
    return _OPEN[key]


def _encode(config, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(config), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = A.utf8(batch.column(batch.schema.get_field_index("text")))
            rest = batch.drop_columns(["text"])
            for i, j in A.slices(offsets):
                ids, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                before = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                own = [pa.array(np.full(j - i, part), pa.int32()), pa.array(before), pa.array(counts), A.list_array(pa.array(ids, pa.int32()), counts)]
                part_rows = rest.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part_rows.columns, *own], names=[*part_rows.schema.names, *OWN])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Encode ``text`` (null: empty) of ``docs`` and write the ids, with all other columns, in ``doc_id`` order.

    ``end_id`` is added to each document. ``encoding`` of the ids is ``dictionary`` or ``delta``. Rows with a null id come
    first; rows of equal id follow each other in the order of a hash of their text. Columns named like those that
    this function adds are replaced. An empty table gives an empty folder of files with the same columns.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())  # one tokenizer file
    rows = docs.drop(*OWN)
    order = ["doc_id", "__tie"]
    ordered = rows.withColumn("__tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    schema = A.schema_with(rows.drop("text"), part=A.INT, at=A.LONG, n_tokens=A.LONG, ids=A.IDS)
    writer = (
        ordered.mapInArrow(_encode(config, end_id), schema)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
    )
    for column in ("doc_id", "at"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with ``first <= doc_id <= last``; the bounds reach the page indexes."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Add ``start``, the ids of all documents before a row. Reads ``part`` and ``n_tokens`` of the folder only.

    One row per file meets in the running sum.
    """
    files = rows.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("ids_of_part"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = files.select("part", F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("__before"))
    return rows.join(begins, "part").withColumn("start", F.col("__before") + F.col("at")).drop("__before")


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids ``start .. stop - 1`` of the whole stream as ``doc_id, start, ids``, one row per document touched."""
    rows = with_starts(spark.read.parquet(path), path).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    high = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    cut = F.slice("ids", (low + 1).cast("int"), (high - low).cast("int"))
    return rows.select("doc_id", (F.col("start") + low).alias("start"), cut.alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        column = batch.column(at)
        raw = memoryview(np.ascontiguousarray(column.values.to_numpy().astype("<u4"))).cast("B")
        ends = (4 * column.offsets.to_numpy().astype(np.int64)).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        rest = batch.drop_columns(["ids"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sums, pa.int64())], names=[*rest.schema.names, "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    rows = rows.drop("ids_crc32")
    return rows.mapInArrow(_checksums, A.schema_with(rows.drop("ids"), ids_crc32=A.LONG))
