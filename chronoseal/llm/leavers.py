"""Dropping rows by key without shuffling the rows that stay.

The keys of the rows to drop make up a Bloom filter of bounded size, which is broadcast. A row whose key misses the filter
stays for certain and goes straight on; only the others meet the keys in a join. A false alarm costs one shuffled row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored
from .exact_dedup import _bits, filter_blocks, possibly_repeated


def row_key(*columns: Column) -> Column:
    """64-bit key of a row's content; rows with the same key count as the same content."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0null")) for c in columns])


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``keys`` (stored, one column). Columns of ``docs`` stay as they are."""
    name = keys.columns[0]
    blocks = filter_blocks(keys.count())
    block, one, two = _bits(blocks)
    hashed = keys.select(F.xxhash64(name).alias("__hash"))
    owned = hashed.select(block.alias("__block"), F.explode(F.array(one, two)).alias("__bit"))
    bits = stored(owned.groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bitmap")), "leavers")
    keyed = docs.withColumn("__key", key).withColumn("__hash", F.xxhash64("__key"))
    probed = possibly_repeated(keyed, bits, blocks)
    kept = probed.where("__maybe").join(keys.select(F.col(name).alias("__gone")), F.col("__key") == F.col("__gone"), "left_anti")
    return probed.where("NOT __maybe").select(*docs.columns).unionByName(kept.select(*docs.columns))
