"""Timeline queries: markers, feature blocks, recency windows, sequences, packs, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from ..functions import text as T
from ..operators import matching, timeline as TL
from .base import query, table
from .inputs import EVENT_LEXICON, PEOPLE_SQL, TIMELINE_SQL, event_totals, people, r6, rounded, talk, timeline

# --- SQL fragments -------------------------------------------------------------------


def markers_cte(source: str, name: str = "markers") -> str:
    return f"""
{name}_ranked AS (SELECT user_id, relevance, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, tweet_index DESC) AS rk FROM {source}),
{name}_base AS (
  SELECT user_id, count(*) AS total_tweets, CAST(max(relevance) AS DOUBLE) AS max_relevance,
         count(*) FILTER (WHERE relevance >= 3) AS rel3_count, count(*) FILTER (WHERE relevance >= 5) AS rel5_count,
         count(*) FILTER (WHERE relevance >= 6) AS rel6_count, count(*) FILTER (WHERE relevance >= 7) AS rel7_count,
         avg(CASE WHEN rk <= 10 THEN CAST(relevance AS DOUBLE) END) AS top10_avg_relevance
  FROM {name}_ranked GROUP BY user_id),
{name}_ratio AS (
  SELECT *, CAST(rel3_count AS DOUBLE) / total_tweets AS rel3_ratio, CAST(rel5_count AS DOUBLE) / total_tweets AS rel5_ratio,
         CAST(rel6_count AS DOUBLE) / total_tweets AS rel6_ratio, CAST(rel7_count AS DOUBLE) / total_tweets AS rel7_ratio
  FROM {name}_base),
{name} AS (
  SELECT *, least(greatest(0.3e0 * least(greatest(rel7_ratio * 10, 0), 1) + 0.25e0 * least(greatest(rel5_ratio * 6, 0), 1)
         + 0.15e0 * least(greatest(rel3_ratio * 3, 0), 1) + 0.15e0 * least(greatest(top10_avg_relevance / 7, 0), 1)
         + 0.15e0 * least(greatest(max_relevance / 7, 0), 1), 0), 1) AS evidence_score
  FROM {name}_ratio)
"""


MARKER_SELECT = "user_id, total_tweets, max_relevance, rel3_count, rel5_count, rel6_count, rel7_count, " + ", ".join(
    r6(c, c) for c in ("rel3_ratio", "rel5_ratio", "rel6_ratio", "rel7_ratio", "top10_avg_relevance", "evidence_score")
)


def _flag(name: str) -> str:
    return f"regexp_matches(tweet_text, '(?i){EVENT_LEXICON[name]}')"


def _flags_cte() -> str:
    cols = ", ".join(f"{_flag(n)} AS f_{n}" for n in EVENT_LEXICON)
    return f"""
flagged AS (SELECT tl.*, count(*) OVER (PARTITION BY user_id) AS total, {cols} FROM tl),
fl AS (SELECT *, f_fp AND f_neg AS f_selfneg, f_caregiver OR f_third_party OR f_support_outreach AS f_ctp,
       f_neg OR f_active OR f_caregiver AS f_life_tone,
       f_sleep OR f_fatigue OR f_cry_sad OR f_anxiety OR f_treatment OR f_grief OR f_help_seeking AS f_tone FROM flagged)
"""


def _ratio(condition: str, total: str = "count(*)") -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE) / greatest({total}, 1)"


def _log(condition: str) -> str:
    return f"ln(1 + CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE))"


_STYLE = [("fp_ratio", _ratio("f_fp")), ("neg_ratio", _ratio("f_neg")), ("selfneg_ratio", _ratio("f_selfneg")), ("active_ratio", _ratio("f_active")), ("caregiver_ratio", _ratio("f_caregiver")), ("active_log", _log("f_active")), ("caregiver_log", _log("f_caregiver"))]
_RELCOUNTS = [(f"rel{t}_ratio", _ratio(f"relevance >= {t}")) for t in (3, 5, 6, 7)] + [(f"rel{t}_log", _log(f"relevance >= {t}")) for t in (3, 5, 6, 7)]
_WINDOW_START = {"final10": "greatest(total - 10, 0)", "final50": "greatest(total - 50, 0)", "final128": "greatest(total - 128, 0)", "final_third": "floor(total * 2 / 3)"}


def _window_parts(w: str) -> list[tuple[str, str]]:
    inside = f"tweet_index >= {_WINDOW_START[w]}"
    n = f"count(*) FILTER (WHERE {inside})"

    def both(condition: str) -> str:
        return f"{inside} AND {condition}"

    rel_sum = f"coalesce(sum(CASE WHEN {inside} THEN CAST(relevance AS DOUBLE) END), 0)"
    parts = [
        ("tweet_count_log", _log(inside)),
        ("mean_relevance", f"{rel_sum} / greatest({n}, 1)"),
        ("max_relevance", f"coalesce(max(CASE WHEN {inside} THEN relevance END), 0)"),
        ("rel5_count_log", _log(both("relevance >= 5"))),
        ("rel7_count_log", _log(both("relevance >= 7"))),
        ("rel5_ratio", _ratio(both("relevance >= 5"), n)),
        ("rel7_ratio", _ratio(both("relevance >= 7"), n)),
        ("first_person_negative_ratio", _ratio(both("f_selfneg"), n)),
        ("active_ideation_count_log", _log(both("f_active"))),
        ("caregiver_third_party_count_log", _log(both("f_ctp"))),
    ]
    for name, flag in (("indirect_sleep", "sleep"), ("indirect_fatigue", "fatigue"), ("indirect_cry_sad", "cry_sad"), ("indirect_anxiety", "anxiety"), ("indirect_treatment", "treatment"), ("indirect_grief", "grief"), ("indirect_help_seeking", "help_seeking"), ("support_outreach", "support_outreach")):
        parts.append((f"{name}_ratio", _ratio(both(f"f_{flag}"), n)))
    return [(f"{w}_{c}", e) for c, e in parts]


def _temporal_parts() -> list[tuple[str, str]]:
    parts = [p for w in _WINDOW_START for p in _window_parts(w)]
    inside = f"tweet_index >= {_WINDOW_START['final50']}"
    n = f"count(*) FILTER (WHERE {inside})"
    rel_sum = f"coalesce(sum(CASE WHEN {inside} THEN CAST(relevance AS DOUBLE) END), 0)"
    last = "max(CASE WHEN relevance >= 7 THEN tweet_index END)"
    parts += [
        ("recent50_minus_lifetime_mean_relevance", f"{rel_sum} / greatest({n}, 1) - sum(CAST(relevance AS DOUBLE)) / greatest(count(*), 1)"),
        ("recent50_minus_lifetime_rel7_ratio", f"{_ratio(inside + ' AND relevance >= 7', n)} - {_ratio('relevance >= 7')}"),
        ("recent50_minus_lifetime_first_person_negative_ratio", f"{_ratio(inside + ' AND f_selfneg', n)} - {_ratio('f_selfneg')}"),
        ("recent50_minus_lifetime_indirect_tone_ratio", f"{_ratio(inside + ' AND f_tone', n)} - {_ratio('f_life_tone')}"),
        (
            "last_rel7_normalized_position",
            f"CASE WHEN {last} IS NULL THEN 0e0 WHEN count(*) > 1 THEN least(CAST({last} AS DOUBLE) / (count(*) - 1), 1) ELSE 1e0 END",
        ),
    ]
    return parts


def _select(parts: list[tuple[str, str]]) -> str:
    return ", ".join(r6(e, n) for n, e in parts)


# --- features ------------------------------------------------------------------------


@query("A2 P4 P10 T4 F3 S5", f"WITH {TIMELINE_SQL}, {markers_cte('tl')} SELECT {MARKER_SELECT} FROM markers")
def evidence_markers(spark, sf_dir):
    """Flagship: evidence markers of every user."""
    return rounded(TL.evidence_markers(timeline(spark, sf_dir, indexed=False)))


_EVIDENCE_PARTS = [("log_total_tweets", "ln(1 + CAST(total_tweets AS DOUBLE))"), ("max_relevance", "max_relevance")]
_EVIDENCE_PARTS += [(f"rel{t}_count_log", f"ln(1 + CAST(rel{t}_count AS DOUBLE))") for t in (3, 5, 6, 7)]
_EVIDENCE_PARTS += [(f"rel{t}_ratio", f"rel{t}_ratio") for t in (3, 5, 6, 7)] + [("top10_avg_relevance", "top10_avg_relevance"), ("evidence_score", "evidence_score")]


@query("P11 S8", f"WITH {TIMELINE_SQL}, {markers_cte('tl')} SELECT user_id, {_select(_EVIDENCE_PARTS)} FROM markers")
def evidence_features(spark, sf_dir):
    return rounded(TL.evidence_features(TL.evidence_markers(timeline(spark, sf_dir, indexed=False))))


@query("A1 A3 P9", f"WITH {TIMELINE_SQL}, {_flags_cte()} SELECT user_id, count(*) AS total_tweets, {_select(_STYLE + _RELCOUNTS)} FROM fl GROUP BY user_id")
def post_blocks(spark, sf_dir):
    return rounded(TL.post_blocks(timeline(spark, sf_dir, indexed=False), lexicon=EVENT_LEXICON))


@query("A6 W4 W12 P8", f"WITH {TIMELINE_SQL}, {_flags_cte()} SELECT user_id, {_select(_temporal_parts())} FROM fl GROUP BY user_id")
def temporal_features(spark, sf_dir):
    """77 recency features."""
    return rounded(TL.temporal_features(timeline(spark, sf_dir), lexicon=EVENT_LEXICON, totals=event_totals(spark, sf_dir)))


@query(
    "K6 A33",
    f"""WITH {TIMELINE_SQL}, {markers_cte('tl')}, {_flags_cte()},
    blocks AS (SELECT user_id, {_select([("fp_ratio", _ratio("f_fp")), ("rel7_log", _log("relevance >= 7")), *_window_parts("final10")[:2]])} FROM fl GROUP BY user_id)
    SELECT m.user_id, m.total_tweets, {r6("m.evidence_score", "evidence_score")}, b.fp_ratio, b.rel7_log, b.final10_tweet_count_log, b.final10_mean_relevance
    FROM markers m JOIN blocks b USING (user_id)""",
)
def timeline_blocks(spark, sf_dir):
    """All blocks as structs from one aggregate; a few fields of each are shown."""
    f = TL.timeline_features(timeline(spark, sf_dir), lexicon=EVENT_LEXICON, totals=event_totals(spark, sf_dir))
    return rounded(
        f.select(
            "user_id",
            "total_tweets",
            F.col("evidence.evidence_score"),
            F.col("stylistic.fp_ratio"),
            F.col("relevance_counts.rel7_log"),
            F.col("temporal.final10_tweet_count_log"),
            F.col("temporal.final10_mean_relevance"),
        )
    )


@query(
    "W12",
    f"""WITH {TIMELINE_SQL} SELECT user_id, max(CASE WHEN relevance >= 7 THEN tweet_index END) AS last_index,
    {r6("CASE WHEN max(CASE WHEN relevance >= 7 THEN tweet_index END) IS NULL THEN 0e0 WHEN count(*) > 1 THEN least(CAST(max(CASE WHEN relevance >= 7 THEN tweet_index END) AS DOUBLE) / (count(*) - 1), 1) ELSE 1e0 END", "position")}
    FROM tl GROUP BY user_id""",
)
def last_high_relevance(spark, sf_dir):
    last = F.max(F.when(F.col("relevance") >= 7, F.col("tweet_index").cast("bigint")))
    g = timeline(spark, sf_dir).groupBy("user_id").agg(last.alias("last_index"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("user_id", "last_index", TL.last_high_position(F.col("last_index"), F.col("n")).alias("position")))


# --- text ----------------------------------------------------------------------------

_FOLDED = "replace(strip_accents(lower(text)), 'ß', 'ss')"


@query("P12 F1", f"SELECT doc_id, length({_FOLDED}) AS n, md5({_FOLDED}) AS digest FROM documents")
def folded_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.fold_accents("text").alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


# No token overlaps another, so "start within" has an RE2 form.
DOC_LEXICON = {
    "direct": "ungen|atin|rean",
    "self_token": "the",
    "acute": "ition|lich|que",
    "treatment": "ing ",
    "recent": "ment",
    "third_party": "lichk|shth|que la",
}


def _near(left: list[str], right: list[str], window: int = 80) -> str:
    """RE2 form of "starts within" for literal tokens."""
    parts = []
    for a in left:
        for b in right:
            parts += [f"{a}.{{0,{window - len(a)}}}{b}", f"{b}.{{0,{window - len(b)}}}{a}"]
    return "(?s)(" + "|".join(parts) + ")"


def _has(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


_DIRECT, _ACUTE = DOC_LEXICON["direct"], DOC_LEXICON["acute"]
_NEAR = _near(["the"], (_DIRECT + "|" + _ACUTE).split("|"))


@query("P13 F1", f"WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents) SELECT doc_id, {_has(_near(['the'], _ACUTE.split('|')))} AS near FROM d")
def near_terms(spark, sf_dir):
    docs = T.with_folded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "t")
    return docs.select("doc_id", T.within_window("t", "the", DOC_LEXICON["acute"]).alias("near"))


@query(
    "P14 A34",
    f"""WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
    h AS (SELECT doc_id, {_has(_DIRECT)} AS direct, {_has(_ACUTE)} AS acute, {_has(_NEAR)} AS self, {_has(DOC_LEXICON['treatment'])} AS treat,
          {_has(DOC_LEXICON['recent'])} AS recent, {_has(DOC_LEXICON['third_party'])} AS third FROM d)
    SELECT doc_id, CASE WHEN direct OR acute THEN least(greatest(3 * CAST(direct AS INT) + 2 * CAST(self AS INT) + 2 * CAST(acute AS INT) + CAST(treat AS INT)
      + CAST(recent AS INT) + CAST(direct AND acute AS INT) - 4 * CAST(third AS INT), 0), 10) ELSE 0 END AS relevance FROM h""",
)
def lexical_relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.with_lexical_relevance(docs, "text", lexicon=DOC_LEXICON).select("doc_id", "relevance")


@query(
    "A34",
    f"""WITH d AS (SELECT source, doc_id, {_FOLDED} AS t FROM documents),
    h AS (SELECT source AS user_id, doc_id AS tweet_index, {_has(_DIRECT)} AS direct, {_has(_ACUTE)} AS acute, {_has(_NEAR)} AS self, {_has(DOC_LEXICON['treatment'])} AS treat,
          {_has(DOC_LEXICON['recent'])} AS recent, {_has(DOC_LEXICON['third_party'])} AS third FROM d),
    px AS (SELECT user_id, tweet_index, CASE WHEN direct OR acute THEN least(greatest(3 * CAST(direct AS INT) + 2 * CAST(self AS INT) + 2 * CAST(acute AS INT) + CAST(treat AS INT)
      + CAST(recent AS INT) + CAST(direct AND acute AS INT) - 4 * CAST(third AS INT), 0), 10) ELSE 0 END AS relevance FROM h),
    {markers_cte('px')} SELECT {MARKER_SELECT} FROM markers""",
)
def proxy_markers(spark, sf_dir):
    """Lexical proxy per post, then evidence markers; a document source plays the user."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("tweet_index"), "text")
    return rounded(TL.evidence_markers(T.with_lexical_relevance(docs, "text", lexicon=DOC_LEXICON)))


@query(
    "P8 P9",
    f"WITH {TIMELINE_SQL}, {_flags_cte()} SELECT "
    + ", ".join(f"count(*) FILTER (WHERE f_{n}) AS n_{n}" for n in [*EVENT_LEXICON, "selfneg"])
    + ", count(*) FILTER (WHERE f_ctp) AS n_caregiver_third_party, count(*) FILTER (WHERE f_tone) AS n_window_tone, count(*) FILTER (WHERE f_life_tone) AS n_lifetime_tone FROM fl",
)
def lexicon_flag_counts(spark, sf_dir):
    posts = timeline(spark, sf_dir, indexed=False)
    flags = T.lexicon_flags("tweet_text", EVENT_LEXICON)
    window, life = T.post_flags(flags), T.lifetime_flags(flags)
    counts = [F.count_if(window[n]).alias(f"n_{n}") for n in [*EVENT_LEXICON, "selfneg", "caregiver_third_party"]]
    return posts.agg(*counts, F.count_if(window["indirect_tone"]).alias("n_window_tone"), F.count_if(life["indirect_tone"]).alias("n_lifetime_tone"))


@query("P15", "SELECT conv_id AS user_id, turn AS tweet_index, CASE WHEN trim(regexp_replace(text, '[A-Za-z .,]', '', 'g')) = '' THEN ' ' ELSE regexp_replace(text, '[A-Za-z .,]', '', 'g') END AS input FROM conversations")
def encoder_inputs(spark, sf_dir):
    """Posts with plain letters removed, so that some of them become blank."""
    stripped = talk(spark, sf_dir).withColumn("t", F.regexp_replace("tweet_text", "[A-Za-z .,]", ""))
    return stripped.select("user_id", "tweet_index", T.blank_to_space("t").alias("input"))


@query(
    "P28",
    """SELECT conv_id AS user_id, bool_or(regexp_matches(text, '(?i)(tionth|ungen|eaux la)')) AS verdict
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) % 11 >= 7) DESC, length(text) % 11 DESC, turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id""",
)
def keyword_verdicts(spark, sf_dir):
    packs = TL.pack_rows(TL.evidence_pack(talk(spark, sf_dir), 3))
    texts = F.transform("selected_tweets", lambda t: t["tweet_text"])
    return packs.select("user_id", T.keyword_verdict(texts, "(tionth|ungen|eaux la)").alias("verdict"))


# --- ranking, sequences and packs ----------------------------------------------------


@query("W1 T4", f"WITH {TIMELINE_SQL}, r AS (SELECT user_id, tweet_index, relevance, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, tweet_index DESC) AS rank FROM tl) SELECT * FROM r WHERE rank <= 10")
def top_posts(spark, sf_dir):
    top = TL.select_sequence(timeline(spark, sf_dir), 10, totals=event_totals(spark, sf_dir))
    return top.select("user_id", F.col("tweet_index").cast("bigint"), F.col("relevance").cast("bigint"), F.col("rank").cast("bigint"))


@query(
    "W2 K6 P23",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, tweet_index DESC) AS rk FROM tl)
    SELECT user_id, CAST(count(*) AS BIGINT) AS length, string_agg(CAST(tweet_index AS VARCHAR), ',' ORDER BY rk) AS indexes,
    {r6("sum(least(1e0, relevance / 7e0))", "channel_sum")} FROM r WHERE rk <= 32 GROUP BY user_id""",
)
def relevance_sequences(spark, sf_dir):
    seq = TL.sequence_table(TL.select_sequence(timeline(spark, sf_dir), 32, totals=event_totals(spark, sf_dir)), values=())
    channel = F.aggregate(F.transform("steps", lambda s: N.channel(s["relevance"])), F.lit(0.0), lambda a, x: a + x)
    return rounded(
        seq.select(
            "user_id",
            F.col("length").cast("bigint").alias("length"),
            F.array_join(F.transform("steps", lambda s: s["tweet_index"].cast("string")), ",").alias("indexes"),
            channel.alias("channel_sum"),
        )
    )


@query(
    "W2",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tweet_index DESC) AS rk FROM tl)
    SELECT user_id, string_agg(CAST(tweet_index AS VARCHAR), ',' ORDER BY tweet_index) AS indexes FROM r WHERE rk <= 24 GROUP BY user_id""",
)
def recent_sequences(spark, sf_dir):
    seq = TL.sequence_table(TL.select_sequence(timeline(spark, sf_dir), 24, "recent_chronological", totals=event_totals(spark, sf_dir)), values=())
    return seq.select("user_id", F.array_join(F.transform("steps", lambda s: s["tweet_index"].cast("string")), ",").alias("indexes"))


@query(
    "W11 P23",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, tweet_index DESC) AS rk FROM tl)
    SELECT user_id, CAST(least(count(*), 8) AS BIGINT) AS length, string_agg(CASE WHEN rk <= 8 THEN CAST(tweet_index AS VARCHAR) END, ',' ORDER BY rk) AS indexes,
           repeat('1', CAST(least(count(*), 8) AS INT)) || repeat('0', CAST(8 - least(count(*), 8) AS INT)) AS mask
    FROM r WHERE rk <= 32 GROUP BY user_id""",
)
def shortened_sequences(spark, sf_dir):
    longer = TL.sequence_table(TL.select_sequence(timeline(spark, sf_dir), 32, totals=event_totals(spark, sf_dir)), values=())
    short = TL.shorten_sequences(longer, 8)
    return short.select(
        "user_id",
        F.col("length").cast("bigint").alias("length"),
        F.array_join(F.transform("steps", lambda s: s["tweet_index"].cast("string")), ",").alias("indexes"),
        F.array_join(TL.sequence_mask("length", 8).cast("array<string>"), "").alias("mask"),
    )


@query(
    "W3 K7",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (relevance >= 7) DESC, relevance DESC, tweet_index DESC) AS rk FROM tl)
    SELECT user_id, count(*) AS total_selected, string_agg(tweet_index || '=' || relevance || ':' || tweet_text, '|' ORDER BY tweet_index) AS tweets FROM r WHERE rk <= 12 GROUP BY user_id""",
)
def evidence_packs(spark, sf_dir):
    packs = TL.pack_rows(TL.evidence_pack(timeline(spark, sf_dir), 12, totals=event_totals(spark, sf_dir)))
    line = F.transform("selected_tweets", lambda t: F.concat(t["tweet_index"].cast("string"), F.lit("="), t["gpt5_relevance"].cast("string"), F.lit(":"), t["tweet_text"]))
    return packs.select("user_id", F.col("total_selected").cast("bigint").alias("total_selected"), F.array_join(line, "|").alias("tweets"))


@query(
    "W13",
    """SELECT conv_id AS user_id, count(*) AS posts, count(DISTINCT turn) AS distinct_indexes, min(turn) AS first_index, max(turn) AS last_index,
    count(*) = count(DISTINCT turn) AS unique_index, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM conversations GROUP BY conv_id""",
)
def index_health(spark, sf_dir):
    return TL.index_health(talk(spark, sf_dir))


@query(
    "G17 W13",
    """WITH p AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 7 <> 3 UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 1
        UNION ALL SELECT conv_id, turn + 100000 FROM conversations WHERE conv_id % 11 = 0 AND turn = 0),
      d AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
      c AS (SELECT conv_id, count(turn) AS posts, count(DISTINCT turn) FILTER (WHERE turn < n) AS covered FROM d LEFT JOIN p USING (conv_id) GROUP BY conv_id)
    SELECT conv_id AS user_id, posts, covered, n - covered AS gaps, posts - covered AS excess, 0 AS invalid FROM c JOIN d USING (conv_id)""",
)
def index_coverage(spark, sf_dir):
    """Post indexes against the declared number of posts, with planted gaps, repeats and posts beyond it."""
    whole = talk(spark, sf_dir).select("user_id", "tweet_index")
    at = F.col("tweet_index")
    posts = whole.where((F.col("user_id") + at) % 7 != 3).unionByName(whole.where((F.col("user_id") % 5 == 0) & (at == 1)))
    posts = posts.unionByName(whole.where((F.col("user_id") % 11 == 0) & (at == 0)).withColumn("tweet_index", at + 100_000))
    return TL.index_coverage(posts, whole.groupBy("user_id").agg((F.max("tweet_index") + 1).alias("posts")))


@query(
    "W14",
    f"WITH {PEOPLE_SQL}, r AS (SELECT user_id, split, row_number() OVER (PARTITION BY split ORDER BY user_id) AS k FROM people) SELECT user_id, split FROM r WHERE k <= 7",
)
def first_users(spark, sf_dir):
    return TL.first_users(people(spark, sf_dir).select("user_id", "split"), 7)


# --- shapes of timelines -------------------------------------------------------------


@query(
    "S3 F4",
    """WITH s AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)
    SELECT doc_id AS user_id, CAST(i - 1 AS BIGINT) AS tweet_index, md5(parts[i]) AS text_md5 FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM s)""",
)
def delimited_posts(spark, sf_dir):
    """Documents as delimited timelines: every sentence is a post, blanks included."""
    posts = TL.explode_delimited(table(spark, sf_dir, "documents"), "text", ". ", user_id=F.col("doc_id"))
    return posts.select("user_id", F.col("tweet_index").cast("bigint").alias("tweet_index"), F.md5(F.col("tweet_text").cast("binary")).alias("text_md5"))


_REL_TEXT = "CASE WHEN length(text) % 7 = 0 THEN 'n/a' ELSE CAST(length(text) % 14 AS VARCHAR) END"
_SENTENCES = "sn AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS tweet_index, parts[i] AS text FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)))"


def _relevance_text(t):
    n = F.char_length(t)
    return F.when(n % 7 == 0, F.lit("n/a")).otherwise((n % 14).cast("string"))


def _nested(spark, sf_dir):
    """Documents as nested timelines: parallel lists of sentences and relevance texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.split("text", r"\. ", -1).alias("texts"))
    return docs.withColumn("rels", F.transform("texts", _relevance_text))


@query(
    "S4 P3",
    f"""WITH {_SENTENCES} SELECT doc_id AS user_id, tweet_index, md5(text) AS text_md5,
    TRY_CAST({_REL_TEXT} AS BIGINT) AS raw, CASE WHEN TRY_CAST({_REL_TEXT} AS BIGINT) IS NULL THEN 0 ELSE least(TRY_CAST({_REL_TEXT} AS BIGINT), 10) END AS score FROM sn""",
)
def nested_posts(spark, sf_dir):
    """Parallel text and relevance lists, zipped into posts and parsed."""
    posts = TL.explode_nested(_nested(spark, sf_dir), "user_id", "texts", "rels")
    return posts.select(
        "user_id",
        F.col("tweet_index").cast("bigint").alias("tweet_index"),
        F.md5(F.col("tweet_text").cast("binary")).alias("text_md5"),
        N.relevance_raw("relevance_text").alias("raw"),
        N.relevance_score("relevance_text").cast("bigint").alias("score"),
    )


@query(
    "A16 P3",
    f"""WITH {_SENTENCES}, p AS (SELECT doc_id, text, {_REL_TEXT} AS rel FROM sn),
    u AS (SELECT doc_id, count(*) AS posts, count(*) FILTER (WHERE trim(text) = '') AS blanks, count(*) FILTER (WHERE rel <> 'n/a') AS digits, count(*) FILTER (WHERE rel = 'n/a') AS bad,
          count(*) FILTER (WHERE TRY_CAST(rel AS INT) > 10) AS oor FROM p GROUP BY doc_id)
    SELECT count(*) AS users, CAST(sum(posts) AS BIGINT) AS posts, min(posts) AS min_posts, max(posts) AS max_posts, CAST(sum(blanks) AS BIGINT) AS blank_posts,
    CAST(sum(digits) AS BIGINT) AS digit_relevance, CAST(sum(bad) AS BIGINT) AS non_digit_relevance, CAST(sum(oor) AS BIGINT) AS out_of_range_relevance,
    count(*) FILTER (WHERE bad > 0) AS users_with_non_digit, count(*) FILTER (WHERE oor > 0) AS users_with_out_of_range FROM u""",
)
def quality_report(spark, sf_dir):
    posts = TL.explode_nested(_nested(spark, sf_dir), "user_id", "texts", "rels")
    return TL.quality_report(posts, relevance_text="relevance_text")


@query(
    "A38 A16",
    f"""WITH {_SENTENCES}, p AS (SELECT TRY_CAST({_REL_TEXT} AS BIGINT) AS value FROM sn UNION ALL SELECT least(10, CAST(floor(value / 45) AS BIGINT)) FROM events)
    SELECT value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY value""",
)
def merged_histograms(spark, sf_dir):
    first = TL.relevance_digits(TL.explode_nested(_nested(spark, sf_dir), "user_id", "texts", "rels"), "relevance_text")
    return TL.merge_counts(first, TL.relevance_digits(timeline(spark, sf_dir, indexed=False), "relevance"))


@query("S4", f"WITH {_SENTENCES} SELECT DISTINCT doc_id AS user_id FROM sn WHERE length(text) % 7 = 0")
def length_mismatches(spark, sf_dir):
    """Users whose two lists differ in length once unreadable relevance entries are dropped."""
    lists = _nested(spark, sf_dir).withColumn("rels", F.filter("rels", lambda r: r != "n/a"))
    return TL.length_mismatches(lists, "user_id", "texts", "rels")


# --- matching ------------------------------------------------------------------------


def _retained(spark, sf_dir):
    source = talk(spark, sf_dir)
    kept = source.where("role <> 'system'").select("user_id", "tweet_text", F.col("tweet_index").alias("turn"))
    return source, TL.index_posts(kept, "user_id", ["turn"], F.floor(F.col("turn") / 4096)).drop("turn")


@query(
    "J12 F2",
    """WITH t AS (SELECT conv_id AS user_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS target_index FROM conversations WHERE role <> 'system')
    SELECT user_id, target_index, turn AS source_index FROM t""",
)
def ordered_match(spark, sf_dir):
    """Turns kept after dropping system turns, matched back to all turns."""
    source, target = _retained(spark, sf_dir)
    return matching.match_ordered_posts(source, target)


@query("J12", "SELECT 'match-not-ordered' AS code, CAST(conv_id AS VARCHAR) AS detail FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def ordered_match_failures(spark, sf_dir):
    """Reversed targets: every user with two or more posts must fail."""
    source = talk(spark, sf_dir)
    reverse = source.select("user_id", (F.lit(1000) - F.col("tweet_index")).alias("tweet_index"), "tweet_text")
    return matching.match_findings(matching.match_ordered_posts(source, reverse))


@query(
    "A33",
    f"""WITH m AS (SELECT conv_id AS user_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS tweet_index, CAST(length(text) % 11 AS BIGINT) AS relevance FROM conversations WHERE role <> 'system'),
    {markers_cte('m')} SELECT {MARKER_SELECT} FROM markers""",
)
def matched_markers(spark, sf_dir):
    """Match, keep the matched source posts, then evidence markers."""
    source, target = _retained(spark, sf_dir)
    kept = matching.matched_posts(source, matching.match_ordered_posts(source, target), strict=True)
    return rounded(TL.evidence_markers(kept))


# --- ids and labels ------------------------------------------------------------------


@query(
    "P1",
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'NO' WHEN 2 THEN 'D' WHEN 3 THEN 'not diagnosed' WHEN 4 THEN '1' WHEN 5 THEN 'control' WHEN 6 THEN 'signal' WHEN 7 THEN 'no_signal' ELSE 'maybe' END AS raw FROM customer),
    n AS (SELECT c_custkey, lower(trim(raw)) AS x FROM r)
    SELECT c_custkey AS user_id,
      CASE WHEN x IN ('1','true','yes','y','diagnosed','d','depressed') THEN 'diagnosed' WHEN x IN ('0','false','no','n','control','c','not diagnosed') THEN 'control' END AS corpus,
      CASE WHEN x IN ('diagnosed','yes') THEN 'diagnosed' WHEN x IN ('control','no') THEN 'control' END AS manifest,
      CASE WHEN x IN ('1','diagnosed') THEN 'diagnosed' WHEN x IN ('0','control') THEN 'control' END AS coded,
      CASE WHEN x = 'signal' THEN 'yes' WHEN x = 'no_signal' THEN 'no' END AS specialist FROM n""",
)
def normalized_labels(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(v) for v in (" Yes ", "NO", "D", "not diagnosed", "1", "control", "signal", "no_signal", "maybe")]), (F.col("c_custkey") % 9 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), raw.alias("raw"))
    return c.select(
        "user_id",
        *[L.normalize_label("raw", v).alias(v) for v in ("corpus", "manifest", "coded")],
        L.normalize_label("raw", "specialist", "yes", "no").alias("specialist"),
    )


@query("P2", "SELECT c_custkey, regexp_replace(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_custkey || '.0 ' ELSE c_custkey || '.00' END), '^(\\d+)\\.0$', '\\1') AS user_id FROM customer")
def normalized_ids(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), key, F.lit(".0 "))).otherwise(F.concat(key, F.lit(".00")))
    return table(spark, sf_dir, "customer").select("c_custkey", L.normalize_user_id(raw).alias("user_id"))


@query(
    "P31",
    "SELECT c_custkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.8f', v) END AS text FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN floor(c_acctbal) ELSE c_acctbal / 7 END AS v FROM customer)",
)
def fixed_numbers(spark, sf_dir):
    v = F.when(F.col("c_custkey") % 3 == 0, F.floor("c_acctbal").cast("double")).otherwise(F.col("c_acctbal") / 7)
    return table(spark, sf_dir, "customer").select("c_custkey", N.fixed_number(v).alias("text"))
