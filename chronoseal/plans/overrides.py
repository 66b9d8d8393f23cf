"""Post-lock override: packs, requests, cached verdicts, application and comparison; bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import overrides as O
from ..operators import timeline as TL
from ..sources import writers
from .base import query, table
from .evaluation import binary_sql
from .inputs import PEOPLE_SQL, SCORES_SQL, TIMELINE_SQL, event_totals, people, r6, rounded, scores, timeline

PROMPT = "prompt-v1"
_SPACES = "trim(regexp_replace(tweet_text, '\\s+', ' ', 'g'))"
_PACKED = f"""{TIMELINE_SQL}, pk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, tweet_index DESC) AS rk FROM tl), sel AS (SELECT * FROM pk WHERE rk <= 6)"""


def _packs(spark, sf_dir):
    return TL.pack_rows(TL.evidence_pack(timeline(spark, sf_dir), 6, totals=event_totals(spark, sf_dir)), split=F.lit("test"))


@query(
    "P24 W3",
    f"""WITH {_PACKED} SELECT user_id, 'Classify this user''s timeline.' || chr(10) || chr(10) || 'user_id: ' || user_id || chr(10) || 'selected_tweets: ' || count(*) || chr(10) || chr(10)
    || string_agg('- idx=' || tweet_index || ' rel=' || relevance || ': ' || {_SPACES}, chr(10) ORDER BY tweet_index) AS message FROM sel GROUP BY user_id""",
)
def request_messages(spark, sf_dir):
    return _packs(spark, sf_dir).select("user_id", O.user_message().alias("message"))


_JSON = """'{"apiModel":"model-a","promptHash":"prompt-v1","tweets":[' || string_agg('{"gpt5_relevance":' || relevance || ',"tweet_index":' || tweet_index || ',"tweet_text":' || to_json(tweet_text) || '}', ',' ORDER BY tweet_index) || '],"userId":"' || user_id || '"}'"""


@query("P25 J9", f"WITH {_PACKED} SELECT user_id, sha256({_JSON}) AS request_hash FROM sel GROUP BY user_id")
def request_hashes(spark, sf_dir):
    """Canonical request hash of every pack; the model suffix is dropped first."""
    model = O.api_model(F.lit("model-a[1M]"))
    return _packs(spark, sf_dir).select("user_id", O.request_hash(model, PROMPT).alias("request_hash"))


@query("K7", f"""WITH {_PACKED} SELECT '{{"selected_tweets":[' || string_agg('{{"gpt5_relevance":' || relevance || ',"tweet_index":' || tweet_index || ',"tweet_text":' || to_json(tweet_text) || '}}', ',' ORDER BY tweet_index) || '],"split":"test","total_selected":' || count(*) || ',"user_id":' || user_id || '}}' AS value FROM sel GROUP BY user_id""")
def pack_lines(spark, sf_dir):
    """Packs as JSON lines with sorted keys."""
    return writers.jsonl_lines(_packs(spark, sf_dir))


def _answer(kind):
    """Responses of four kinds: tool call, wrapped text, bad confidence, no verdict."""
    tool = F.format_string('{"content":[{"type":"text","text":"thinking"},{"type":"tool_use","name":"%s","input":{"true_depression":%s,"confidence":0.%d,"reason":"turn  %d"}}]}', F.lit(O.DECISION_TOOL), F.when(F.col("n") % 2 == 0, F.lit("true")).otherwise(F.lit("false")), (F.col("n") % 9 + 1).cast("int"), F.col("n").cast("int"))
    text = F.format_string('{"content":[{"type":"text","text":"Answer: {\\"true_depression\\": false, \\"confidence\\": 0.25, \\"reason\\": \\"n %d\\"} done"}]}', F.col("n").cast("int"))
    wide = F.lit('{"content":[{"type":"text","text":"{\\"true_depression\\": true, \\"confidence\\": 7, \\"reason\\": \\"x\\"}"}]}')
    none = F.lit('{"content":[{"type":"text","text":"no idea"}]}')
    return F.when(kind == 0, tool).when(kind == 1, text).when(kind == 2, wide).otherwise(none)


@query(
    "P26",
    """WITH t AS (SELECT conv_id AS user_id, turn, length(text) AS n FROM conversations)
    SELECT user_id, turn, CASE n % 4 WHEN 0 THEN n % 2 = 0 WHEN 1 THEN false WHEN 2 THEN true END AS true_depression,
    CASE n % 4 WHEN 0 THEN round((n % 9 + 1) / 10e0, 6) WHEN 1 THEN 0.25e0 WHEN 2 THEN 7e0 ELSE 0e0 END AS confidence,
    CASE n % 4 WHEN 0 THEN 'turn ' || n WHEN 1 THEN 'n ' || n WHEN 2 THEN 'x' ELSE '' END AS reason,
    CASE n % 4 WHEN 2 THEN 'bad-confidence' WHEN 3 THEN 'no-json' END AS error FROM t""",
)
def parsed_responses(spark, sf_dir):
    """Response texts built from every turn, parsed to verdicts or error codes."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", F.char_length("text").alias("n"))
    answered = t.withColumn("response", _answer(F.col("n") % 4))
    return rounded(answered.select("user_id", "turn", *[c.alias(k) for k, c in O.parse_tool_response("response").items()]))


_PRED = f"""{SCORES_SQL}, pr AS (SELECT user_id, model_id, label, fold, CASE WHEN score > 0.35e0 THEN 'diagnosed' ELSE 'control' END AS predicted FROM scores WHERE split = 'test'),
    dec AS (SELECT DISTINCT user_id, fold <= 2 AS verdict FROM pr)"""


def _predictions(spark, sf_dir):
    return scores(spark, sf_dir).where("split = 'test'").withColumn("predicted", L.decide("score", 0.35))


def _decisions(spark, sf_dir):
    t = people(spark, sf_dir).where("split = 'test' AND fold <> 4")
    return t.select("user_id", F.when(F.col("fold") == 5, F.lit("control")).otherwise(F.lit("diagnosed")).alias("base_decision"), (F.col("fold") <= 2).alias("llm_true_depression"), "label", "fold")


def _all_decisions(spark, sf_dir):
    t = people(spark, sf_dir).where("split = 'test'")
    return t.select("user_id", F.lit("diagnosed").alias("base_decision"), (F.col("fold") <= 2).alias("llm_true_depression"))


@query("P27 J11 E14", f"WITH {_PRED} SELECT pr.user_id, model_id, predicted, CASE WHEN predicted = 'diagnosed' AND verdict = false THEN 'control' ELSE predicted END AS final FROM pr LEFT JOIN dec USING (user_id)")
def overridden_predictions(spark, sf_dir):
    out = O.apply_decisions(_predictions(spark, sf_dir), _all_decisions(spark, sf_dir))
    return out.select("user_id", "model_id", "predicted", "final")


@query("J11 S17", f"WITH {_PRED} SELECT false AS ok, CASE WHEN fold = 4 THEN 'decision-missing' ELSE 'decision-base' END AS code, CAST(user_id AS VARCHAR) AS detail FROM pr WHERE model_id = 'm3_trees' AND predicted = 'diagnosed' AND fold IN (4, 5)")
def decision_findings(spark, sf_dir):
    """Flagged users without a decision or with one on another base."""
    return O.decision_findings(_predictions(spark, sf_dir).where("model_id = 'm3_trees'"), _decisions(spark, sf_dir))


def _side(name: str, column: str) -> str:
    tp, fp, tn, fn = (f"count(*) FILTER (WHERE label {a} 'diagnosed' AND {column} {p} 'diagnosed')" for a, p in (("=", "="), ("<>", "="), ("<>", "<>"), ("=", "<>")))
    return f"{tp} AS {name}tp, {fp} AS {name}fp, {tn} AS {name}tn, {fn} AS {name}fn"


def _side_metrics(name: str) -> str:
    return f"(SELECT model_id, {r6('macro_f1', name + '_macro_f1')}, {r6('diagnosed_f1', name + '_diagnosed_f1')}, {r6('precision', name + '_precision')}, {r6('recall', name + '_recall')} FROM ({binary_sql(f'(SELECT model_id, {name}tp AS tp, {name}fp AS fp, {name}tn AS tn, {name}fn AS fn FROM cc)', 'model_id')}))"


@query(
    "A31 E14",
    f"""WITH {_PRED}, fin AS (SELECT pr.*, CASE WHEN predicted = 'diagnosed' AND verdict = false THEN 'control' ELSE predicted END AS final FROM pr LEFT JOIN dec USING (user_id)),
    cc AS (SELECT model_id, {_side('base', 'predicted')}, {_side('final', 'final')}, count(*) FILTER (WHERE predicted = 'diagnosed') AS base_positive, count(*) FILTER (WHERE predicted = 'diagnosed' AND final <> 'diagnosed') AS switched,
      count(*) FILTER (WHERE predicted = 'diagnosed' AND final <> 'diagnosed' AND label <> 'diagnosed') AS fp_fixed, count(*) FILTER (WHERE predicted = 'diagnosed' AND final <> 'diagnosed' AND label = 'diagnosed') AS tp_lost FROM fin GROUP BY model_id)
    SELECT cc.model_id, base_positive, switched, fp_fixed, tp_lost, b.* EXCLUDE (model_id), f.* EXCLUDE (model_id) FROM cc JOIN {_side_metrics('base')} b USING (model_id) JOIN {_side_metrics('final')} f USING (model_id)""",
)
def override_comparison(spark, sf_dir):
    """Base against overridden metrics per model."""
    out = O.apply_decisions(_predictions(spark, sf_dir), _all_decisions(spark, sf_dir))
    return rounded(M.override_comparison(out, ["model_id"]))


def _sheet_rows(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.select(
        F.col("user_id").cast("string").alias("user_id"),
        "base_decision",
        "llm_true_depression",
        (F.col("fold") / F.lit(8.0)).alias("llm_confidence"),
        F.lit("r").alias("llm_reason"),
        F.lit(PROMPT).alias("prompt_hash"),
        F.md5(F.col("user_id").cast("string")).alias("request_hash"),
        (F.col("fold") == 1).alias("cache_hit"),
        F.lit("model-a[1m]").alias("requested_model"),
        O.api_model(F.lit("model-a[1m]")).alias("api_model"),
        F.lit("p").alias("label_policy_id"),
        F.lit("lock").alias("lock_basename"),
    )


_SHEET = "base_decision, CAST(verdict AS VARCHAR) AS llm_true_depression, printf('%.4f', fold / 8e0) AS llm_confidence, 'r' AS llm_reason, 'prompt-v1' AS prompt_hash, md5(CAST(user_id AS VARCHAR)) AS request_hash, CAST(fold = 1 AS VARCHAR) AS cache_hit, 'model-a[1m]' AS requested_model, 'model-a' AS api_model, 'p' AS label_policy_id, 'lock' AS lock_basename"
_SHEET_FROM = f"WITH {PEOPLE_SQL}, d AS (SELECT user_id, label, fold, CASE WHEN fold = 5 THEN 'control' ELSE 'diagnosed' END AS base_decision, fold <= 2 AS verdict FROM people WHERE split = 'test' AND fold <> 4)"


@query("K10 S17", f"{_SHEET_FROM} SELECT CAST(user_id AS VARCHAR) AS user_id, {_SHEET} FROM d")
def test_decision_sheet(spark, sf_dir):
    return O.test_sheet(_sheet_rows(spark, sf_dir))


@query("K10", f"{_SHEET_FROM} SELECT CAST(user_id AS VARCHAR) AS user_id, label AS actual_label, CAST(fold AS BIGINT) AS fold, CASE WHEN base_decision = 'diagnosed' AND NOT verdict THEN 'control' ELSE base_decision END AS final_decision, {_SHEET} FROM d")
def train_decision_sheet(spark, sf_dir):
    labels = _decisions(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), "label", F.col("fold").cast("bigint").alias("fold"))
    return O.train_sheet(_sheet_rows(spark, sf_dir), labels)


@query(
    "E14 P25",
    f"""WITH {_PACKED}, rq AS (SELECT user_id, sha256({_JSON}) AS h FROM sel GROUP BY user_id) SELECT user_id FROM rq JOIN customer ON user_id = c_custkey WHERE c_acctbal >= 3000""",
)
def uncached_requests(spark, sf_dir):
    """Requests of users above a balance are not in the cache and remain to be sent."""
    requests = _packs(spark, sf_dir).select("user_id", O.request_hash(F.lit("model-a"), PROMPT).alias("request_hash"))
    known = requests.join(people(spark, sf_dir).select("user_id", "balance"), "user_id")
    cache = known.where("balance < 3000").select("request_hash", F.lit("{}").alias("response"))
    return O.uncached(known.select("user_id", "request_hash"), cache).select("user_id")


# --- intervals -----------------------------------------------------------------------


@query("A25 F5")
def bootstrap_intervals(spark, sf_dir):
    """Class-stratified intervals per model, 2000 replicates each."""
    return rounded(B.bootstrap_intervals(_predictions(spark, sf_dir), keys=["model_id"]))


@query("A26 A35")
def paired_delta(spark, sf_dir):
    """Macro F1 difference of two label columns with its paired interval."""
    return rounded(B.paired_delta(_paired_rows(spark, sf_dir)))


def _paired_rows(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(
        F.col("quality").alias("first"),
        (F.col("n_chars") % 3 > 0).cast("int").alias("first_predicted"),
        F.col("toxic").alias("second"),
        (F.col("n_chars") % 5 == 0).cast("int").alias("second_predicted"),
    )


def _paired_cells(spark, sf_dir):
    return B.paired_cells(_paired_rows(spark, sf_dir), "first", "first_predicted", "second", "second_predicted")


@query("A25 A26 A35")
def paired_report(spark, sf_dir):
    """Five metrics of two label columns and of their difference, all intervals from the same resamples."""
    return rounded(B.paired_report(_paired_cells(spark, sf_dir)))


@query(
    "A35",
    """WITH j AS (SELECT quality AS a, CAST(n_chars % 3 > 0 AS INT) AS p, toxic AS b, CAST(n_chars % 5 = 0 AS INT) AS q FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT 'first' AS target, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp,
      count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM j
      UNION ALL SELECT 'second', count(*) FILTER (WHERE b = 1 AND q = 1), count(*) FILTER (WHERE b = 0 AND q = 1),
      count(*) FILTER (WHERE b = 0 AND q = 0), count(*) FILTER (WHERE b = 1 AND q = 0) FROM j),
    m AS (SELECT target, unnest(['precision', 'recall', 'diagnosed_f1', 'macro_f1', 'accuracy']) AS metric,
      unnest([coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0),
        (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2,
        coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0)]) AS v FROM c)
    SELECT target, metric, round(v, 6) + 0e0 AS point FROM m
    UNION ALL SELECT 'delta', metric, round(y.v - x.v, 6) + 0e0 FROM m x JOIN m y USING (metric) WHERE x.target = 'first' AND y.target = 'second'""",
)
def paired_report_points(spark, sf_dir):
    """The point estimates of the paired report."""
    return rounded(B.paired_points(_paired_cells(spark, sf_dir)))


