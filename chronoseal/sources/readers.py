"""Typed readers. Schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import numeric as N
from ..functions.vectors import parse_vector
from ..operators.alignment import finding
from ..operators.timeline import explode_delimited

POSTS = "user_id STRING, tweet_index INT, tweet_text STRING, gpt5_relevance SMALLINT, embedding ARRAY<FLOAT>"
PACKS = "user_id STRING, split STRING, total_selected INT, selected_tweets ARRAY<STRUCT<tweet_index: INT, tweet_text: STRING, gpt5_relevance: INT>>"
MARKER_NUMBERS = (
    "total_tweets",
    "max_relevance",
    "rel3_count",
    "rel5_count",
    "rel6_count",
    "rel7_count",
    "rel3_ratio",
    "rel5_ratio",
    "rel6_ratio",
    "rel7_ratio",
    "top10_avg_relevance",
)


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV as text columns: quoted fields, doubled quotes and embedded newlines; blanks become ``""``.

    Short rows are padded and rows of blanks only are dropped. ``columns`` must
    be the header; a differing header raises.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=True, enforceSchema=False, mode="PERMISSIVE")
    rows = reader.csv(path if isinstance(path, str) else list(path)).na.fill("")
    blank = F.lit(True)
    for c in columns:
        blank = blank & (F.col(f"`{c}`") == "")
    return rows.where(~blank)


def read_labels(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = ("User_ID", "Diagnosed_YN", "Text")) -> DataFrame:
    """``;`` CSV files of one split (a BOM is tolerated): ``user_id, label, text``.

    Unknown labels are NULL; see :func:`label_findings` for them and for duplicates.
    """
    rows = read_csv(spark, list(paths), columns, sep=";")
    return rows.select(L.normalize_user_id("User_ID").alias("user_id"), L.normalize_label("Diagnosed_YN").alias("label"), F.col("Text").alias("text"))


def label_findings(users: DataFrame) -> DataFrame:
    twice = users.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, "duplicate-user", F.col("user_id")).unionByName(finding(users.where("label IS NULL"), "unknown-label", F.col("user_id")))


def read_delimited(spark: SparkSession, paths: Sequence[str], delimiter: str = " # ") -> DataFrame:
    """Delimited timelines: one row per post, blank segments kept."""
    users = read_labels(spark, paths)
    return explode_delimited(users, "text", delimiter, user_id=F.col("user_id"), label=F.col("label"))


def read_posts(spark: SparkSession, path: str, columns: Sequence[str] = ("user_id", "tweet_index", "tweet_text", "gpt5_relevance")) -> DataFrame:
    """Tweet-level Parquet; only the named columns are scanned."""
    fields = T.StructType([f for f in T.StructType.fromDDL(POSTS).fields if f.name in columns])
    return spark.read.schema(fields).parquet(path).select(*columns)


def read_posts_of(spark: SparkSession, path: str, users: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Posts of wanted users, by semi-join; Spark broadcasts a short list and may prune the scan with it."""
    return read_posts(spark, path, columns).join(users.select("user_id"), "user_id", "left_semi")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    fetch_size: int = 2000,
    **options: str,
) -> DataFrame:
    """Database table, fetched in batches and split over tasks by a numeric column."""
    settings: dict[str, object] = {"url": url, "dbtable": table, "fetchsize": fetch_size, **options}
    if partition_column and bounds:
        settings |= {"partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.format("jdbc").options(**settings).load().select(*columns)


def numeric_table(df: DataFrame, columns: Sequence[str], log_columns: Sequence[str] = (), key: str = "user_id") -> DataFrame:
    """NULL reads as 0; log columns become ``log1p(max(x, 0))``."""
    out = [F.col(key)]
    for c in columns:
        value = N.log_count(c) if c in set(log_columns) else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out.append(value.alias(c))
    return df.select(*out)


def vector_table(df: DataFrame, text: str = "embedding", key: str = "user_id") -> DataFrame:
    """Vector text column to ``ARRAY<FLOAT>``."""
    return df.select(key, *[c for c in df.columns if c not in (key, text)], parse_vector(text).alias("embedding"))


def _typed(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return rows.select(*[F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) for c, t in types.items()])


def required_findings(raw: DataFrame, typed: DataFrame | None, required: Sequence[str], code: str = "missing-value", numeric: Sequence[str] = ()) -> DataFrame:
    """Blank required values, and numbers that do not parse, one finding per cell."""
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    checks += [F.when((F.coalesce(F.col(c), F.lit("")) != "") & ~N.is_finite(F.col(c).try_cast("double")), F.lit(f"invalid {c}")) for c in numeric]
    problems = F.filter(F.array(*checks), lambda x: x.isNotNull())
    rows = raw.withColumn("__p", F.explode(problems))
    who = F.col("user_id") if "user_id" in raw.columns else F.lit("?")
    return finding(rows, code, F.concat_ws(": ", who, "__p"))


OOF = {"user_id": "string", "label": "string", "fold": "int", "score": "double", "model_id": "string"}
TEST = {"user_id": "string", "score": "double", "model_id": "string"}
TERNARY_OOF = {"user_id": "string", "label": "string", "fold": "int", "prob_diagnosed": "double", "prob_control": "double", "prob_no_evidence": "double", "model_id": "string", "label_policy_id": "string"}
TERNARY_TEST = {k: v for k, v in TERNARY_OOF.items() if k not in ("label", "fold")}
MANIFEST = {"dataset": "string", "split": "string", "label": "string", "user_id": "string", "row_hash": "string", "fold": "int"}
TERNARY_MANIFEST = {"dataset": "string", "split": "string", "label": "string", "binary_label": "string", "user_id": "string", "row_hash": "string", "fold": "int", "label_policy_id": "string"}
SEALED = {"user_id": "string", "binary_label": "string", "label_code": "int", "row_hash": "string"}


def read_scores(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str] = OOF) -> DataFrame:
    """Score table with typed columns and normalised labels."""
    rows = _typed(read_csv(spark, path, list(types)), types)
    if "label" not in types:
        return rows
    label = L.normalize_ternary_label("label") if "prob_diagnosed" in types else L.normalize_label("label", "manifest")
    return rows.withColumn("label", label)


def read_manifest(spark: SparkSession, path: str, types: Mapping[str, str] = MANIFEST) -> DataFrame:
    rows = _typed(read_csv(spark, path, list(types)), types)
    if "binary_label" in types and "label_policy_id" in types:
        return rows.withColumn("label", L.normalize_ternary_label("label")).withColumn("binary_label", L.normalize_label("binary_label", "manifest"))
    if "binary_label" in types:
        return rows.withColumn("binary_label", L.normalize_label("binary_label", "coded"))
    # -1 marks a redacted label and stays as it is.
    label = F.when(F.col("label") == "-1", F.lit("-1")).otherwise(F.coalesce(L.normalize_label("label", "manifest"), L.normalize_label("label", "coded")))
    return rows.withColumn("label", label)


_WHOLE = ("total_tweets", "rel3_count", "rel5_count", "rel6_count", "rel7_count")
MARKERS = {n: "string" if n == "user_id" else "bigint" if n in _WHOLE else "double" for n in ("user_id", *MARKER_NUMBERS, "evidence_score")}


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Evidence markers; a blank score is recomputed."""
    rows = _typed(read_csv(spark, path, list(MARKERS)), MARKERS)
    return rows.withColumn("evidence_score", F.coalesce(F.col("evidence_score"), N.evidence_score()))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Override decision sheet with booleans and confidence typed."""
    from ..operators.overrides import TEST_SHEET

    rows = read_csv(spark, path, list(TEST_SHEET))
    return rows.withColumns(
        {
            "llm_true_depression": L.parse_boolean("llm_true_depression"),
            "cache_hit": L.parse_boolean("cache_hit"),
            "llm_confidence": F.col("llm_confidence").try_cast("double"),
        }
    )


def read_jsonl(spark: SparkSession, path: str, schema: str = PACKS) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_files(spark: SparkSession, path: str, types: Mapping[str, str], prefix: str, suffix: str = ".csv") -> DataFrame:
    """Several score files found by name, with their file name."""
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in types]))
    raw = rows.options(header=True, quote='"', escape='"', multiLine=True, pathGlobFilter=f"{prefix}*{suffix}").csv(path)
    named = raw.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"))
    cast: list[Column] = [F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) for c, t in types.items()]
    return named.select(*cast, "file_name")
