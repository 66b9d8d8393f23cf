"""Readers over text that Spark writes from the given tables, with faults planted by rule."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from ..operators import timeline as TL
from ..operators.overrides import TEST_SHEET
from ..session import checkpoint_dir
from ..sources import quarantine as Q
from ..sources import readers as R
from ..sources import writers as WR
from .base import query, table
from .inputs import PEOPLE_SQL, SCORES_SQL, TIMELINE_SQL, people, rounded, scores, timeline
from .posts import MARKER_SELECT, markers_cte


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"


def _through_csv(df: DataFrame) -> DataFrame:
    """Rows written as CSV and read back as text columns."""
    path = _folder(df.sparkSession)
    WR.write_csv(df, path, df.columns)
    return R.read_csv(df.sparkSession, path, df.columns)


@query("S1 K1", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, sha256(coalesce(text, '')) AS digest, coalesce(source, '') AS source FROM documents")
def csv_records(spark, sf_dir):
    """Whole texts with quotes, separators and line ends through CSV and back."""
    rows = _through_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", F.char_length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"), "source")


@query("S6", f"WITH {TIMELINE_SQL}, {PEOPLE_SQL} SELECT CAST(user_id AS VARCHAR) AS user_id, tweet_index, relevance FROM tl WHERE user_id IN (SELECT user_id FROM people WHERE label = 'diagnosed')")
def posts_of_users(spark, sf_dir):
    """Posts of wanted users from partitioned Parquet; the texts are not scanned."""
    user = F.col("user_id").cast("string").alias("user_id")
    split = F.when(F.col("user_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train"))
    posts = timeline(spark, sf_dir).select(user, F.col("tweet_index").cast("int"), "tweet_text", F.col("relevance").cast("smallint").alias("gpt5_relevance"), split.alias("split"))
    path = _folder(spark)
    WR.write_posts(posts, path)
    wanted = people(spark, sf_dir).where("label = 'diagnosed'").select(user)
    found = R.read_posts_of(spark, path, wanted, ["user_id", "tweet_index", "gpt5_relevance"])
    return found.select("user_id", F.col("tweet_index").cast("bigint").alias("tweet_index"), F.col("gpt5_relevance").cast("bigint").alias("relevance"))


# --- quarantine ----------------------------------------------------------------------


def _scores(spark, sf_dir) -> Q.Quarantined:
    user, rest = F.col("user_id"), F.col("user_id") % 11
    first = F.col("model_id") == "m1_linear"
    faulty = scores(spark, sf_dir).select(
        user.cast("string").alias("user_id"),
        F.when(rest == 2, F.lit("maybe")).when(user % 22 == 0, F.lit("")).otherwise(F.col("label")).alias("label"),
        F.when((rest == 3) & first, F.lit("first")).otherwise(F.col("fold").cast("string")).alias("fold"),
        F.when(rest == 0, F.lit("x")).when(rest == 1, F.lit("")).when(rest == 4, F.lit("NaN")).otherwise(F.col("score").cast("string")).alias("score"),
        F.when((rest == 5) & first, F.lit("")).otherwise(F.col("model_id")).alias("model_id"),
    )
    return Q.quarantine_rows(_through_csv(faulty), Q.score_contract())


_SCORE_FAULTS = f"""{SCORES_SQL}, sf AS (SELECT *, list_filter([
  CASE WHEN user_id % 11 = 5 AND model_id = 'm1_linear' THEN 'missing model_id' END,
  CASE WHEN user_id % 22 = 0 THEN 'missing label' WHEN user_id % 11 = 2 THEN 'invalid label' END,
  CASE WHEN user_id % 11 = 3 AND model_id = 'm1_linear' THEN 'invalid fold' END,
  CASE WHEN user_id % 11 = 1 THEN 'missing score' WHEN user_id % 11 IN (0, 4) THEN 'invalid score' END], lambda x: x IS NOT NULL) AS reasons FROM scores)"""


@query("S14", f"WITH {_SCORE_FAULTS} SELECT CAST(user_id AS VARCHAR) AS user_id, label, CAST(fold AS BIGINT) AS fold, round(score, 6) + 0e0 AS score, model_id FROM sf WHERE len(reasons) = 0")
def score_records(spark, sf_dir):
    """Score rows that keep the contract, typed."""
    return rounded(_scores(spark, sf_dir).accepted).withColumn("fold", F.col("fold").cast("bigint"))


def _markers(spark, sf_dir) -> Q.Quarantined:
    user = F.col("user_id")
    markers = TL.evidence_markers(timeline(spark, sf_dir, indexed=False))
    text = markers.select(
        user.cast("string").alias("user_id"),
        F.when(user % 13 == 0, F.lit("n/a")).otherwise(F.col("total_tweets").cast("string")).alias("total_tweets"),
        *[F.col(c).cast("bigint" if R.MARKERS[c] == "bigint" else "double").cast("string").alias(c) for c in R.MARKER_NUMBERS if c != "total_tweets"],
        F.when(user % 2 == 1, F.lit("0.25")).otherwise(F.lit("")).alias("evidence_score"),
    )
    return Q.quarantine_rows(_through_csv(text), Q.Contract(R.MARKERS, optional=("evidence_score",)))


@query(
    "S20 P10",
    f"WITH {TIMELINE_SQL}, {markers_cte('tl', 'made')}, markers AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 1 THEN 0.25e0 ELSE evidence_score END AS evidence_score) FROM made WHERE user_id % 13 <> 0) SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) FROM (SELECT {MARKER_SELECT} FROM markers)",
)
def marker_records(spark, sf_dir):
    """Marker rows from text; a blank score is computed, a recorded one kept."""
    kept = _markers(spark, sf_dir).accepted
    return rounded(kept.withColumn("evidence_score", F.coalesce("evidence_score", N.evidence_score())))


def _decisions(spark, sf_dir) -> Q.Quarantined:
    user = F.col("user_id")
    told = {
        "user_id": user.cast("string"),
        "base_decision": F.lit("diagnosed"),
        "llm_true_depression": F.when(user % 6 == 1, F.lit("yes")).when(user % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        "llm_confidence": F.when(user % 9 == 4, F.lit("")).when(user % 9 == 5, F.lit("high")).otherwise(F.format_string("%.2f", (user % 100) / 100)),
        "cache_hit": F.lit("true"),
    }
    sheet = people(spark, sf_dir).select(*[told.get(c, F.lit("x")).alias(c) for c in TEST_SHEET])
    types = {c: {"llm_confidence": "double", "llm_true_depression": "boolean", "cache_hit": "boolean"}.get(c, "string") for c in TEST_SHEET}
    flags = {c: L.parse_boolean(c) for c in ("llm_true_depression", "cache_hit")}
    return Q.quarantine_rows(_through_csv(sheet), Q.Contract(types, labels=flags))


_DECISION_FAULTS = f"""{PEOPLE_SQL}, df AS (SELECT *, list_filter([
  CASE WHEN user_id % 6 = 1 THEN 'invalid llm_true_depression' END,
  CASE WHEN user_id % 9 = 4 THEN 'missing llm_confidence' WHEN user_id % 9 = 5 THEN 'invalid llm_confidence' END], lambda x: x IS NOT NULL) AS reasons FROM people)"""


@query("S17", f"WITH {_DECISION_FAULTS} SELECT CAST(user_id AS VARCHAR) AS user_id, user_id % 2 = 0 AS llm_true_depression, CAST(user_id % 100 AS DOUBLE) / 100e0 AS llm_confidence FROM df WHERE len(reasons) = 0")
def decision_records(spark, sf_dir):
    """Decision rows that keep the contract, typed."""
    return _decisions(spark, sf_dir).accepted.select("user_id", "llm_true_depression", "llm_confidence")


_PACK_ID = "conv_id || '-' || turn"
_PACK_FAULTS = f"""pf AS (SELECT *, {_PACK_ID} AS id, CASE WHEN turn % 5 = 4 THEN ['malformed record'] WHEN (conv_id + turn) % 7 = 0 THEN ['missing split'] ELSE [] END AS reasons FROM conversations)"""


def _packs(spark, sf_dir) -> Q.Quarantined:
    """One pack per turn as a JSON line: some are cut off, some lack a field, and blank lines lie between them."""
    post = F.struct(F.col("turn").cast("int").alias("tweet_index"), F.col("text").alias("tweet_text"), F.lit(5).alias("gpt5_relevance"))
    split = F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.lit("test"))
    packs = table(spark, sf_dir, "conversations").select(
        "turn", F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("user_id"), split.alias("split"), F.lit(1).alias("total_selected"), F.array(post).alias("selected_tweets"))).alias("line")
    )
    cut = F.when(F.col("turn") % 5 == 4, F.expr("left(line, char_length(line) - 2)")).otherwise(F.col("line"))
    path = _folder(spark)
    packs.select(F.concat(cut, F.when(F.col("turn") % 3 == 0, F.lit("\n  ")).otherwise(F.lit(""))).alias("value")).write.text(path)
    return Q.quarantine_json(spark.read.text(path), R.PACKS, ["user_id", "split", "selected_tweets"])


@query("S12", f"WITH {_PACK_FAULTS} SELECT id AS user_id, CAST(1 AS BIGINT) AS total_selected, CAST(turn AS BIGINT) AS tweet_index, sha256(text) AS digest FROM pf WHERE len(reasons) = 0")
def json_records(spark, sf_dir):
    """Packs from JSON lines that are whole and have all fields."""
    post = F.col("selected_tweets")[0]
    return _packs(spark, sf_dir).accepted.select("user_id", F.col("total_selected").cast("bigint").alias("total_selected"), post["tweet_index"].cast("bigint").alias("tweet_index"), F.sha2(post["tweet_text"], 256).alias("digest"))


_ALL = (("scores", _scores), ("markers", _markers), ("decisions", _decisions), ("packs", _packs))

_FAULTS_SQL = f"""{_SCORE_FAULTS}, {_DECISION_FAULTS.removeprefix(PEOPLE_SQL + ', ')}, {_PACK_FAULTS}, {TIMELINE_SQL},
judged AS (
  SELECT 'scores' AS reader, CAST(user_id AS VARCHAR) AS id, reasons FROM sf
  UNION ALL SELECT 'markers', CAST(user_id AS VARCHAR), CASE WHEN user_id % 13 = 0 THEN ['invalid total_tweets'] ELSE [] END FROM (SELECT DISTINCT user_id FROM tl)
  UNION ALL SELECT 'decisions', CAST(user_id AS VARCHAR), reasons FROM df
  UNION ALL SELECT 'packs', id, reasons FROM pf)"""


@query("S12 S14 S17 S20", f"WITH {_FAULTS_SQL} SELECT reader, CASE WHEN reasons = ['malformed record'] THEN '?' ELSE id END AS id, array_to_string(list_sort(reasons), '; ') AS reasons FROM judged WHERE len(reasons) > 0")
def rejected_records(spark, sf_dir):
    """Rows that break a reader's contract, with every reason."""
    parts = []
    for reader, judge in _ALL:
        rejected = judge(spark, sf_dir).rejected
        broken = F.array_contains("reasons", Q.MALFORMED)
        who = F.when(broken, F.lit("?")).otherwise(F.get_json_object("record", "$.user_id"))
        parts.append(rejected.select(F.lit(reader).alias("reader"), who.alias("id"), F.array_join(F.array_sort("reasons"), "; ").alias("reasons")))
    return reduce(DataFrame.unionByName, parts)


@query(
    "S12 S14 S17 S20 U1",
    f"WITH {_FAULTS_SQL} SELECT reader, 'rows' AS measure, count(*) AS n FROM judged GROUP BY reader UNION ALL SELECT reader, 'rejected', count(*) FROM judged WHERE len(reasons) > 0 GROUP BY reader "
    "UNION ALL SELECT reader, reason, count(*) FROM (SELECT reader, unnest(reasons) AS reason FROM judged) GROUP BY reader, reason",
)
def reader_counts(spark, sf_dir):
    """Rows, rejected rows and rows per reason, observed while the readers ran."""
    counted = [(reader, measure, n) for reader, judge in _ALL for measure, n in judge(spark, sf_dir).counts.items() if n]
    return spark.createDataFrame(counted, "reader string, measure string, n bigint")
