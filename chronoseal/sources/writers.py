"""Writers. Tables go to Parquet in parallel; CSV and JSON are for reports and exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_number
from ..operators.splits import MANIFEST
from ..operators.timeline import MARKER_COLUMNS

SCORE_TRAIN = ("user_id", "label", "fold", "score", "model_id")
SCORE_TEST = ("user_id", "score", "model_id")
# Spark's CSV writer trims cells unless told not to.
CSV_TEXT = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = (), single: bool = False) -> None:
    """CSV with a fixed header; quotes only where needed, NULL as blank.

    Ordered output is range-partitioned, so part files in name order form the
    whole. ``single`` is for exchange files whose size is known to be small.
    """
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    if single:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**CSV_TEXT).csv(path)


def score_columns(df: DataFrame, labelled: bool, digits: int = 8) -> DataFrame:
    """Score table as text: labels and folds only for train rows."""
    text = df.withColumn("score", F.format_string(f"%.{digits}f", F.col("score").cast("double")))
    return text.select(*(SCORE_TRAIN if labelled else SCORE_TEST))


def write_scores(df: DataFrame, path: str, labelled: bool, digits: int = 8, single: bool = False) -> None:
    columns = SCORE_TRAIN if labelled else SCORE_TEST
    write_csv(score_columns(df, labelled, digits), path, columns, ["user_id"], single)


def marker_columns(df: DataFrame) -> DataFrame:
    """Markers as text: whole numbers plain, others with eight decimals."""
    counts = {"total_tweets", "rel3_count", "rel5_count", "rel6_count", "rel7_count"}
    return df.select("user_id", *[(F.col(c).cast("string") if c in counts else fixed_number(c)).alias(c) for c in MARKER_COLUMNS])


def write_markers(df: DataFrame, path: str, single: bool = False) -> None:
    write_csv(marker_columns(df), path, ["user_id", *MARKER_COLUMNS], ["user_id"], single)


def write_manifest(df: DataFrame, path: str, columns: Sequence[str] = MANIFEST, single: bool = False) -> None:
    write_csv(df, path, columns, ["split", "user_id"], single)


def write_posts(df: DataFrame, path: str, by: str = "split", files: int | None = None, mode: str = "append") -> None:
    """Tweet-level Parquet, zstd, one folder per split, users kept together for row-group pruning."""
    out = df.repartitionByRange(files, by, "user_id", "tweet_index") if files else df.repartitionByRange(by, "user_id", "tweet_index")
    out.sortWithinPartitions(by, "user_id", "tweet_index").write.mode(mode).option("compression", "zstd").partitionBy(by).parquet(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Feature blocks, pools and sequences."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def jsonl_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, keys in name order."""
    return df.select(F.to_json(_sorted_struct(df), {"ignoreNullFields": "false"}).alias("value"))


def _sorted_struct(df: DataFrame) -> Column:
    return F.struct(*[_sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def _sorted_fields(c: Column, kind: object) -> Column:
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted_fields(x, kind.elementType))
    return c


def write_jsonl(df: DataFrame, path: str) -> None:
    jsonl_lines(df).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """One-row report. Spark's commit protocol replaces the folder only when the job succeeds."""
    df.coalesce(1).write.mode("overwrite").json(path)
