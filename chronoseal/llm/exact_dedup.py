"""Exact deduplication in two passes around a Bloom filter, with DataFrame functions only.

The first pass reads every text once and stores its digest. Each digest owns two bits of a block of 32,768 bits; bits that
two or more digests own make up the filter of possibly repeated digests. The second pass looks both bits of every digest
up. A digest with a bit that nobody else owns has no copy: its row goes straight to the result, without a shuffle. Only
the others are shuffled, grouped by the whole digest (SHA-256) and resolved exactly, so a false alarm of the filter costs
one shuffled row and never changes a result.

The filter has ``BITS_PER_ROW`` bits a row, at most ``MOST_BLOCKS`` blocks (128 MB), which bounds what is broadcast. With
more rows than that serves (67 million) it fills up and more rows are shuffled, in the end all of them; results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_totals
from .arrays import stored
from .line_dedup import LOWER, UPPER

BLOCK_BITS = 1 << 15
BITS_PER_ROW = 16
MOST_BLOCKS = 1 << 15
#: A group with more rows than the larger of this number and a ten-thousandth of all rows is spread over tasks.
HOT_ROWS = 1_000
DECISIONS = ("keep_id", "group_size", "kept", "text_sha256")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def filter_blocks(rows: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-rows * BITS_PER_ROW // BLOCK_BITS)))


def _bits(blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bits of ``__hash``; the digits of the hash that they use do not overlap."""
    block = F.pmod(F.shiftrightunsigned("__hash", 30), F.lit(blocks)).cast("int")
    mask = F.lit(BLOCK_BITS - 1)
    return block, F.col("__hash").bitwiseAND(mask).cast("bigint"), F.shiftrightunsigned("__hash", 15).bitwiseAND(mask).cast("bigint")


def repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """The filter: ``__block, __bitmap`` with the bits that at least two rows of ``digests`` (``__hash``) own."""
    block, one, two = _bits(blocks)
    # The two bits of one digest may coincide; it owns that bit once.
    owned = digests.select(block.alias("__block"), F.explode(F.array_distinct(F.array(one, two))).alias("__bit"))
    shared = owned.groupBy("__block", "__bit").agg(F.count("*").alias("n")).where("n > 1")
    return shared.groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))


def _is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr("__bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


def possibly_repeated(digests: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """``digests`` with ``__maybe``: false means that no other row has the digest."""
    block, one, two = _bits(blocks)
    probed = digests.withColumn("__at", block).join(F.broadcast(bits), F.col("__at") == F.col("__block"), "left")
    return probed.withColumn("__maybe", F.coalesce(_is_set(one) & _is_set(two), F.lit(False))).drop("__at", "__block", "__bitmap")


def mark_copies(docs: DataFrame, carry: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``docs`` has ``doc_id`` and ``text``; the columns named in ``carry`` (all if not given) come with the row, except
    that columns named like the four new ones are replaced. They are written once to the shared folder.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest ``doc_id`` stays. Of rows that share that id as well exactly one stays. A null id counts as smaller than any
    other; where all ids of a group are null one row stays and ``keep_id`` is null. An empty table gives an empty table.
    """
    columns = [c for c in (carry if carry is not None else docs.columns) if c not in DECISIONS]
    # The row number is fixed by writing it, so that ties are decided alike in every later job.
    rows = docs.select(
        *[F.col(c) for c in columns],
        F.col("doc_id").alias("__id"),
        F.monotonically_increasing_id().alias("__row"),
        text_digest(F.col("text")).alias("__sha"),
    )
    keys = stored(rows, "digests")
    n = keys.count()
    blocks = filter_blocks(n)
    hashed = keys.withColumn("__hash", F.xxhash64("__sha"))
    bits = stored(repeated_bits(hashed.select("__hash"), blocks), "repeated-bits")
    probed = possibly_repeated(hashed, bits, blocks).drop("__hash")
    shuffled = probed.where("__maybe")
    groups = stored(
        shuffled.groupBy("__sha").agg(F.count("*").alias("group_size"), F.max(F.struct("__id", "__row")).alias("__keep")), "groups"
    )
    resolved = with_totals(shuffled, groups, "__sha", ["__row"], "group_size", max(hot_rows, n // 10_000))
    digest = F.lower(F.hex("__sha")).alias("text_sha256")
    copies = resolved.select(
        *columns, F.col("__keep.__id").alias("keep_id"), F.col("group_size"), (F.col("__row") == F.col("__keep.__row")).alias("kept"), digest
    )
    single = probed.where(~F.col("__maybe")).select(
        *columns, F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    return single.unionByName(copies)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`mark_copies` picks it."""
    marked = docs.select("*", F.struct("*").alias("__doc"))
    return mark_copies(marked, ["__doc"]).where("kept").select("__doc.*")


#: DuckDB SQL of the query over ``documents``.
SQL = """SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
      doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)"""
