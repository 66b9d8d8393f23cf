"""File tables, archive summaries and results rollups."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.hash_state import RunningSha256
from .alignment import hash_chain, or_pass
from .ranking import best_per_key, row_numbers

# Fixed value: digests joined into one at each level of a file's tree digest.
FAN = 4096
# Files above this are hashed in splits; so many of them at a time.
WHOLE_BYTES = 1 << 27
SIDE_BY_SIDE = 16
# Names that the text source unpacks, and the mark it skips.
CODECS = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"
BOM = b"\xef\xbb\xbf"


def file_table(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, name, size, sha256`` of every file, hashed on the executors.

    A file of up to ``WHOLE_BYTES`` is one row of the ``binaryFile`` source. A larger one is read in splits: a task hashes one
    split from the hash state that the task before left, so no task reads a whole file. Its rounds follow each other, files go side by side.
    Larger files whose names end like a codec's (``.gz``) would be read unpacked in splits, so they stay one row (2 GB at most).
    """

    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path if isinstance(path, str) else list(path))
    # The source does not open files that a plain condition on the length leaves out.
    whole = [files.where(F.col("length") <= WHOLE_BYTES)]
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length", F.lower("path").rlike(CODECS).alias("packed")).collect()
    if any(f["packed"] for f in large):
        whole.append(files.where((F.col("length") > WHOLE_BYTES) & F.lower("path").rlike(CODECS)))
    hashed = reduce(DataFrame.unionByName, whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    cut = [f for f in large if not f["packed"]]
    if cut:
        with ThreadPoolExecutor(min(len(cut), SIDE_BY_SIDE)) as pool:
            digests = list(pool.map(inheritable_thread_target(spark)(lambda f: _chained(spark, f["path"], f["length"])), cut))
        rows = [(f["path"], f["length"], d) for f, d in zip(cut, digests)]
        hashed = hashed.unionByName(spark.createDataFrame(rows, "path string, size bigint, sha256 string"))
    return hashed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


def _fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a batch of consecutive pieces as one value."""
    for batch in batches:
        pieces = batch.column(0)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        if len(pieces):
            yield pa.RecordBatch.from_arrays([pa.array([pieces.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()], pa.binary())], names=["bytes"])


def _chained(spark: SparkSession, path: str, size: int) -> str:
    """SHA-256 of one file; round k is a job of one task, which reads split k alone.

    The pieces between line feeds come with the line feed before them, so that the bytes of a split need no look at the next.
    A piece is one value, and an Arrow batch holds many, so a file should have line feeds, as tables with compressed pages do.
    """
    literal = re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
    pieces = spark.read.option("lineSep", "\n").text(literal).select(F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("bytes"))
    # A file alone is cut into splits of one size, one for each partition, in their order.
    splits = pieces.mapInArrow(_fed, "bytes binary").rdd

    def digest(opened: bytes) -> tuple[int, str]:
        state = RunningSha256().update(opened)
        read = len(opened)
        begun = False
        for k in range(splits.getNumPartitions()):

            def hashed(rows: Iterator[Row], state: bytes = state.saved(), begun: bool = begun) -> Iterator[tuple[bytes, int]]:
                running, n = RunningSha256(state), 0
                for row in rows:
                    part = bytes(row[0]) if begun or n else bytes(row[0])[1:]
                    running.update(part)
                    n += len(row[0])
                yield running.saved(), n

            ((after, n),) = spark.sparkContext.runJob(splits, hashed, [k])
            state = RunningSha256(after)
            read += n if begun or not n else n - 1
            begun = begun or n > 0
        return read, state.update(b"\n" if read == size - 1 else b"").hexdigest()

    read, out = digest(b"")
    if size - len(BOM) - 1 <= read <= size - len(BOM):
        # The text source skips a byte order mark.
        read, out = digest(BOM)
    if not size - 1 <= read <= size:
        raise RuntimeError(f"{path}: {read} bytes read of {size}")
    return out


def _joined() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("__n", "__d")))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["__d"]), ""), 256).alias("__d")


def split_digests(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, name, size, digest`` of every file, each file read in splits by many tasks.

    The digest is a tree over the hashes of the pieces between line feed bytes, in their order; it depends on the bytes
    alone, not on the splits, and is no plain SHA-256 (see :func:`file_table`). A piece may have up to 2 GB. Files
    whose names end like a codec's (``.gz``) are read unpacked. Compare it together with the size. As in
    :func:`file_table`, Spark skips empty files.
    """
    pieces = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    hashed = pieces.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        F.sha2(F.col("value").cast("binary"), 256).alias("__d"),
    )
    level = row_numbers(hashed, ["path", "size"], [F.col("__at")], F.col("__block"), "__n")
    for _ in range(2):
        level = level.groupBy("path", "size", F.floor(F.col("__n") / FAN).alias("__g")).agg(_joined()).withColumnRenamed("__g", "__n")
    digests = level.groupBy("path", "size").agg(_joined())
    return digests.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", F.col("__d").alias("digest"))


def list_files(spark: SparkSession, path: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Files by name prefix and suffix; contents are not read (the column is pruned)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def shard_range(name: Column | str, pattern: str = r"(\d+)[-_](\d+)\.[A-Za-z0-9.]+$") -> tuple[Column, Column]:
    """Start and end user position in a shard file name; NULL when the name has none."""
    name = F.col(name) if isinstance(name, str) else name
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2)]
    return tuple(F.when(p != "", p.cast("bigint")) for p in parts)  # type: ignore[return-value]


def verify_archive(recorded: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Every recorded file present with its size and digest."""
    return or_pass(hash_chain(recorded, actual, key), "archive", "all recorded files verified")


def archive_summary(files: DataFrame, keys: Sequence[str] = ("codec",), source: str = "source_bytes", stored: str = "stored_bytes") -> DataFrame:
    """Files, bytes and ratio per codec."""
    totals = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum(source).alias(source), F.sum(stored).alias(stored))
    return totals.withColumn("ratio", F.when(F.col(source) > 0, F.col(stored) / F.when(F.col(source) > 0, F.col(source))))


def inventory(files: DataFrame, pattern: str = r"/([^/]+)/[^/]+$", durable: str = r"\.(json|csv|parquet)$") -> DataFrame:
    """Durable files and bytes per experiment, the experiment being a path part."""
    named = files.withColumn("experiment", F.regexp_extract("path", pattern, 1))
    return named.where(F.col("path").rlike(durable)).groupBy("experiment").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def results_rollup(locks: DataFrame, reports: DataFrame, keys: Sequence[str], metric: str = "macro_f1", baseline: float | None = None) -> DataFrame:
    """Each lock with its report and the metric's distance to a baseline; locks without a report stay."""
    joined = locks.join(reports, list(keys), "left")
    if baseline is None:
        return joined
    return joined.withColumn(f"delta_{metric}", F.col(metric) - F.lit(float(baseline)))


def best_results(results: DataFrame, keys: Sequence[str], metric: str = "macro_f1", ties: Sequence[str] = ()) -> DataFrame:
    return best_per_key(results.where(F.col(metric).isNotNull()), keys, [F.round(F.col(metric), 12).desc(), *[F.col(t).asc() for t in ties]])


def against_published(results: DataFrame, published: DataFrame, key: str, metric: str = "macro_f1") -> DataFrame:
    """Difference to the best published value of the same key."""
    best = published.groupBy(key).agg(F.max(metric).alias("published"), F.max_by("name", metric).alias("published_name"))
    return results.join(best, key, "left").withColumn("delta", F.col(metric) - F.col("published"))
