"""The reference's inputs, derived from the driver tables by Spark, with the same rules as SQL text.

timeline   events, one post per event, relevance from the value
talk       conversations as posts
vectors    embeddings as posts of the users named by ``label``
people     customers as labelled users
scores     binary model scores of the customers
ternary    ternary probabilities of the customers under two label policies
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import DecisionRule
from ..operators.timeline import index_posts, post_totals
from .base import table

VECTOR_DIM = 64
FOLDS = (1, 2, 3, 4, 5)

# A lexicon that occurs in the generated event texts, in syntax both engines read alike.
EVENT_LEXICON = {
    "fp": "(click|view)",
    "neg": '"k": [0-4]',
    "active": "error",
    "caregiver": '"k": 7',
    "third_party": '(signup[^.]{0,12}"k": 8|purchase)',
    "sleep": '"k": 1',
    "fatigue": '"k": 2',
    "cry_sad": '"k": 3',
    "anxiety": "error.*[5-9]}",
    "treatment": "purchase.*[02468]}",
    "grief": '"k": 9[0-9]',
    "help_seeking": "signup.*5",
    "support_outreach": '"k": 6',
}

RULES = (
    DecisionRule("argmax", "argmax"),
    DecisionRule("margin05", "diagnosed_margin", diagnosed_margin=0.05),
    DecisionRule("gate35", "no_evidence_gate", no_evidence_min=0.35),
)

# model id, multiplier, offset, balance cut, family, source
MODELS = (
    ("m1_linear", 37, 11, 900.0, "logreg", "tabular"),
    ("m2_boost", 101, 5, 600.0, "xgboost", "tabular"),
    ("m3_trees", 53, 29, 1500.0, "extra_trees", "tabular"),
    ("m4_seq", 17, 71, 300.0, "cnn", "sequence"),
    ("m5_stack", 211, 3, 1200.0, "logreg", "stacking"),
)
MODEL_IDS = tuple(m[0] for m in MODELS)
POLICIES = ("p_half", "p_third")

TIMELINE_SQL = """
tl AS (
  SELECT user_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS tweet_index,
         least(10, CAST(floor(value / 45) AS BIGINT)) AS relevance,
         event_type || ' ' || props AS tweet_text
  FROM events)
"""

PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_acctbal < 0 THEN 'diagnosed' ELSE 'control' END AS label,
         CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CAST((c_custkey // 7) % 5 + 1 AS INTEGER) AS fold,
         c_acctbal AS balance
  FROM customer)
"""

_MODEL_VALUES = ", ".join(f"('{m}', {a}, {b}, {cut}e0, '{f}', '{s}')" for m, a, b, cut, f, s in MODELS)

SCORES_SQL = (
    PEOPLE_SQL
    + f""",
models(model_id, a, b, cut, family, source) AS (VALUES {_MODEL_VALUES}),
scores AS (
  SELECT user_id, label, fold, split, model_id,
         CAST((user_id * a + b) % 1009 AS DOUBLE) / 1009e0 * 0.7e0 + CASE WHEN balance < cut THEN 0.3e0 ELSE 0e0 END AS score
  FROM people CROSS JOIN models)
"""
)

TERNARY_SQL = (
    PEOPLE_SQL
    + f""",
models(model_id, a, b, cut, family, source) AS (VALUES {_MODEL_VALUES}),
policies(label_policy_id, k) AS (VALUES ('p_half', 2), ('p_third', 3)),
parts AS (
  SELECT user_id, fold, split, label AS binary_label, label_policy_id, model_id, family, source,
         CASE WHEN balance < 2500 AND user_id % k = 0 THEN 'no-evidence' WHEN balance < 2500 THEN 'diagnosed' ELSE 'control' END AS label,
         (user_id * a + b) % 97 + CASE WHEN balance < cut + 1500 THEN 60 ELSE 5 END AS x,
         (user_id * b + a) % 89 + CASE WHEN balance < cut + 1500 THEN 5 ELSE 70 END AS y,
         (user_id * (a + b)) % 83 + CASE WHEN user_id % k = 0 THEN 40 ELSE 3 END AS z
  FROM people CROSS JOIN models CROSS JOIN policies),
tern AS (
  SELECT user_id, fold, split, binary_label, label_policy_id, model_id, family, source, label,
         CAST(x AS DOUBLE) / (x + y + z) AS prob_diagnosed,
         CAST(y AS DOUBLE) / (x + y + z) AS prob_control,
         CAST(z AS DOUBLE) / (x + y + z) AS prob_no_evidence
  FROM parts)
"""
)

TALK_SQL = """
talk AS (
  SELECT conv_id AS user_id, turn AS tweet_index, text AS tweet_text, role,
         CAST(length(text) % 11 AS BIGINT) AS relevance
  FROM conversations)
"""

VECTORS_SQL = """
vec AS (
  SELECT CAST(label AS BIGINT) AS user_id, vec_id AS tweet_index, CAST(vec_id % 11 AS BIGINT) AS relevance, embedding
  FROM embeddings)
"""


def timeline(spark: SparkSession, sf_dir: str, indexed: bool = True) -> DataFrame:
    """Events as posts; callers that ignore the post order leave the index out."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.least(F.lit(10), F.floor(F.col("value") / 45).cast("int")).alias("relevance"),
        F.concat_ws(" ", "event_type", "props").alias("tweet_text"),
    )
    if not indexed:
        return events.drop("ts", "event_id")
    # Blocks follow the time order, so a user with a large share of all events is split by hour.
    return index_posts(events, "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts")).drop("ts", "event_id")


def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts per user, from one column."""
    return post_totals(table(spark, sf_dir, "events"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
    return c.select(
        "user_id",
        F.when(F.col("balance") < 0, F.lit("diagnosed")).otherwise(F.lit("control")).alias("label"),
        F.when(F.col("user_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        (F.floor(F.col("user_id") / 7) % 5 + 1).cast("int").alias("fold"),
        "balance",
    )


def _models() -> Column:
    rows = [
        F.struct(
            F.lit(m).alias("model_id"),
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.lit(cut).alias("cut"),
            F.lit(family).alias("family"),
            F.lit(source).alias("source"),
        )
        for m, a, b, cut, family, source in MODELS
    ]
    return F.inline(F.array(*rows))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir).select("*", _models())
    base = ((F.col("user_id") * F.col("a") + F.col("b")) % 1009).cast("double") / F.lit(1009.0) * F.lit(0.7)
    score = base + F.when(F.col("balance") < F.col("cut"), F.lit(0.3)).otherwise(F.lit(0.0))
    return rows.select("user_id", "label", "fold", "split", "model_id", score.alias("score"))


def ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = F.inline(F.array(*[F.struct(F.lit(p).alias("label_policy_id"), F.lit(k).alias("k")) for p, k in zip(POLICIES, (2, 3))]))
    rows = people(spark, sf_dir).select("*", _models()).select("*", policies)
    user, a, b, k = F.col("user_id"), F.col("a"), F.col("b"), F.col("k")
    low = F.col("balance") < F.col("cut") + 1500
    marked = user % k == 0
    x = (user * a + b) % 97 + F.when(low, F.lit(60)).otherwise(F.lit(5))
    y = (user * b + a) % 89 + F.when(low, F.lit(5)).otherwise(F.lit(70))
    z = (user * (a + b)) % 83 + F.when(marked, F.lit(40)).otherwise(F.lit(3))
    label = F.when((F.col("balance") < 2500) & marked, F.lit("no-evidence")).when(F.col("balance") < 2500, F.lit("diagnosed")).otherwise(F.lit("control"))
    parts = rows.select("user_id", "fold", "split", F.col("label").alias("binary_label"), "label_policy_id", "model_id", "family", "source", label.alias("label"), x.alias("x"), y.alias("y"), z.alias("z"))
    total = F.col("x") + F.col("y") + F.col("z")
    names = zip("xyz", ("prob_diagnosed", "prob_control", "prob_no_evidence"))
    return parts.select(*[c for c in parts.columns if c not in "xyz"], *[(F.col(c).cast("double") / total).alias(n) for c, n in names])


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("user_id"),
        F.col("turn").alias("tweet_index"),
        F.col("text").alias("tweet_text"),
        "role",
        (F.char_length("text") % 11).alias("relevance"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("user_id"),
        F.col("vec_id").alias("tweet_index"),
        (F.col("vec_id") % 11).alias("relevance"),
        "embedding",
    )


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round double columns so both engines print the same value; -0.0 becomes 0.0."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.simpleString() in ("double", "float") and field.name not in skip:
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(field.name)
        out.append(c)
    return df.select(*out)


def r6(expression: str, alias: str) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0e0 AS {alias}"
