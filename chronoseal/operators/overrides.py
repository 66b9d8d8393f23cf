"""Post-lock override of positive predictions: requests, responses, application, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import json_hash
from ..functions.labels import POSITIVE, override_decision
from ..functions.text import collapse_spaces
from .alignment import finding

# The tool name and the decision sheet columns.
DECISION_TOOL = "classify_true_depression"
TRAIN_SHEET = (
    "user_id",
    "actual_label",
    "fold",
    "base_decision",
    "final_decision",
    "llm_true_depression",
    "llm_confidence",
    "llm_reason",
    "prompt_hash",
    "request_hash",
    "cache_hit",
    "requested_model",
    "api_model",
    "label_policy_id",
    "lock_basename",
)
TEST_SHEET = tuple(c for c in TRAIN_SHEET if c not in ("actual_label", "fold", "final_decision"))

VERDICT = "struct<true_depression:string,confidence:string,reason:string>"
RESPONSE = f"struct<content:array<struct<type:string,name:string,text:string,input:{VERDICT}>>>"


def flagged_rows(predictions: DataFrame) -> DataFrame:
    """Only predicted-positive rows are ever sent out."""
    return predictions.where(F.col("predicted") == POSITIVE)


def user_message(user: Column | str = "user_id", total: Column | str = "total_selected", posts: Column | str = "selected_tweets") -> Column:
    """Request text of one pack: a header and one line per post."""
    user, total, posts = (F.col(c) if isinstance(c, str) else c for c in (user, total, posts))
    lines = F.transform(
        posts,
        lambda p: F.concat(F.lit("- idx="), p["tweet_index"].cast("string"), F.lit(" rel="), p["gpt5_relevance"].cast("string"), F.lit(": "), collapse_spaces(p["tweet_text"])),
    )
    head = F.concat(F.lit("Classify this user's timeline.\n\nuser_id: "), user.cast("string"), F.lit("\nselected_tweets: "), total.cast("string"), F.lit("\n\n"))
    return F.concat(head, F.array_join(lines, "\n"))


def api_model(requested: Column | str) -> Column:
    """Model name without its context-size suffix."""
    return F.regexp_replace(F.col(requested) if isinstance(requested, str) else requested, r"(?i)\[1m\]$", "")


def request_hash(model: Column, prompt_hash: Column | str, user: Column | str = "user_id", posts: Column | str = "selected_tweets") -> Column:
    """Hash of the request with keys in sorted order on every level."""
    posts = F.col(posts) if isinstance(posts, str) else posts
    user = F.col(user) if isinstance(user, str) else user
    ordered = F.transform(posts, lambda p: F.struct(p["gpt5_relevance"].alias("gpt5_relevance"), p["tweet_index"].alias("tweet_index"), p["tweet_text"].alias("tweet_text")))
    prompt = F.lit(prompt_hash) if isinstance(prompt_hash, str) else prompt_hash
    return json_hash(apiModel=model, promptHash=prompt, tweets=ordered, userId=user.cast("string"))


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached response."""
    return requests.join(cache.select("request_hash"), "request_hash", "left_anti")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached response (NULL when absent) and a cache flag."""
    joined = requests.join(cache.select("request_hash", "response"), "request_hash", "left")
    return joined.withColumn("cache_hit", F.col("response").isNotNull())


def _verdict_columns(verdict: Column) -> dict[str, Column]:
    confidence = F.coalesce(verdict["confidence"], F.lit("0")).try_cast("double")
    reason = collapse_spaces(F.coalesce(verdict["reason"], F.lit("")))
    truth = F.when(verdict["true_depression"] == "true", F.lit(True)).when(verdict["true_depression"] == "false", F.lit(False))
    error = (
        F.when(verdict.isNull(), F.lit("no-json"))
        .when(truth.isNull(), F.lit("no-boolean"))
        .when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), F.lit("bad-confidence"))
        .when(reason == "", F.lit("no-reason"))
    )
    return {"true_depression": truth, "confidence": confidence, "reason": reason, "error": error}


def parse_json_response(text: Column | str) -> dict[str, Column]:
    """Verdict columns and an ``error`` code from an answer text; text around the braces is dropped."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    body = F.when(text.startswith("{"), text).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    verdict = F.when(body.startswith("{") & body.endswith("}"), F.from_json(body, VERDICT))
    return _verdict_columns(verdict)


def parse_tool_response(text: Column | str) -> dict[str, Column]:
    """Verdict columns from a content list: the tool call if present, else the first text."""
    text = F.col(text) if isinstance(text, str) else text
    content = F.from_json(text, RESPONSE)["content"]
    tool = F.try_element_at(F.filter(content, lambda c: (c["type"] == "tool_use") & (c["name"] == DECISION_TOOL)), F.lit(1))
    answer = F.try_element_at(F.filter(content, lambda c: (c["type"] == "text") & (F.coalesce(c["text"], F.lit("")) != "")), F.lit(1))["text"]
    by_tool, by_text = _verdict_columns(tool["input"]), parse_json_response(F.coalesce(answer, F.lit("")))
    return {k: F.when(tool.isNotNull(), by_tool[k]).otherwise(by_text[k]) for k in by_tool}


def apply_decisions(predictions: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Final labels: positive predictions follow the one-way override, all others stay.

    Each positive prediction needs exactly one decision, made on a positive base; the plan raises at the first one
    without. :func:`decision_findings` lists them all.
    """
    d = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.coalesce(F.col("base_decision") == POSITIVE, F.lit(False))).alias("__base"),
        F.max("llm_true_depression").alias("__verdict"),
    )
    joined = predictions.join(d, list(keys), "left")
    code = (
        F.when(F.col("__n").isNull(), F.lit("decision-missing"))
        .when(F.col("__n") > 1, F.lit("decision-duplicate"))
        .when(~F.col("__base"), F.lit("decision-base"))
    )
    who = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    refused = F.when((F.col("predicted") == POSITIVE) & code.isNotNull(), F.raise_error(F.concat(code, F.lit(" "), who)).cast("string"))
    final = F.coalesce(refused, override_decision("predicted", "__verdict"))
    return joined.withColumn("final", final).drop("__n", "__base", "__verdict")


def decision_findings(predictions: DataFrame, decisions: DataFrame, key: str = "user_id") -> DataFrame:
    """Positive predictions without a decision, with one made on another base, or with two."""
    d = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max("base_decision").alias("__base"))
    joined = flagged_rows(predictions).select(key).join(d, key, "left")
    code = (
        F.when(F.col("__n").isNull(), F.lit("decision-missing"))
        .when(F.col("__n") > 1, F.lit("decision-duplicate"))
        .when(F.col("__base") != POSITIVE, F.lit("decision-base"))
    )
    return finding(joined.withColumn("__code", code).where("__code IS NOT NULL"), F.col("__code"), F.col(key))


def _sheet(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "llm_true_depression": F.col("llm_true_depression").cast("string"),
            "llm_confidence": F.format_string("%.4f", F.col("llm_confidence").cast("double")),
            "cache_hit": F.col("cache_hit").cast("string"),
        }
    )


def test_sheet(decisions: DataFrame) -> DataFrame:
    """Twelve label-free columns as text."""
    return _sheet(decisions).select(*TEST_SHEET)


def train_sheet(decisions: DataFrame, labels: DataFrame, key: str = "user_id") -> DataFrame:
    """Fifteen columns including actual label, fold and final decision."""
    joined = decisions.join(labels.select(key, F.col("label").alias("actual_label"), "fold"), key)
    final = joined.withColumn("final_decision", override_decision("base_decision", "llm_true_depression"))
    return _sheet(final).select(*TRAIN_SHEET)


test_sheet.__test__ = False
