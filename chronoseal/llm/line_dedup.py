"""Line deduplication with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash; lines found in too many
documents go, except in the largest ``doc_id`` that holds them; the rest is put together by position.

Only hashes, ids and positions are shuffled for the counts. A line that stands in a third of all documents is
counted in parts (Spark counts distinct ids by line and id first), and the join back to the lines has
plain exchanges on both sides, so that adaptive execution can split a hot line. The texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hashed long lines (``h1, h2, doc_id, th, pos``) and the keys to drop (``h1, h2, keep_doc``).

    ``th`` is a hash of the text, so that rows which share an id but not a text are kept apart.
    """
    exploded = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = exploded.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    lines = keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos"
    )
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keep_doc"))
    return lines, counted.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keep_doc")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents without their repeated lines: the columns of ``docs``, ``n_lines`` and ``n_dropped``.

    ``docs`` has ``doc_id`` and ``text``; further columns stay, whatever their names, except that ``n_lines`` and
    ``n_dropped`` are replaced. A line counts if its key has at least ``min_chars`` code points. A key found in
    at least ``min_docs`` different documents loses all its lines but those of the largest id holding it.

    Null or empty text is one empty line. Rows with a null id keep all lines and count as no document. Rows that
    share an id are one document for the counts and are each cleaned. An empty table gives an empty table.
    """
    lines, hot = repeated_lines(docs, min_chars, min_docs)
    hot = stored(hot, "line-keys")
    drops = (
        lines.join(hot, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keep_doc"))
        .groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"))
        .agg(F.collect_set("pos").alias("__drop"))
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    wide = docs.select(*rest).withColumn("__h", F.xxhash64("text"))
    joined = wide.join(drops, (F.col("doc_id") == F.col("__doc")) & (F.col("__h") == F.col("__th")), "left")
    parts = joined.withColumn("__lines", _lines(F.col("text")))
    # Positions are different numbers, so that array_except is a linear filter that keeps their order.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    columns = [text.alias(c) if c == "text" else F.col(c) for c in rest]
    return parts.select(
        *columns,
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


#: DuckDB SQL of the cleaned documents of a table or common table expression ``{docs}``.
SQL = """{name}_lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
    {name}_keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM {name}_lines),
    {name}_hot AS (SELECT key, max(doc_id) AS keep_doc FROM {name}_keys WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    {name} AS (SELECT k.doc_id, count(*) AS n_lines,
      count(*) FILTER (WHERE h.key IS NOT NULL AND k.doc_id <> h.keep_doc) AS n_dropped,
      coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE h.key IS NULL OR k.doc_id = h.keep_doc), '') AS text
      FROM {name}_keys k LEFT JOIN {name}_hot h USING (key) GROUP BY k.doc_id)"""
