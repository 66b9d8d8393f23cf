"""Per-user features of post timelines.

Input posts: ``user_id, tweet_index, tweet_text, relevance``. Every feature is a
map-side combined aggregate over ``user_id``; text is reduced to one bit mask per
post before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.lexicons import POST_LEXICON
from .ranking import HOT_ROWS, row_numbers, top_n, top_n_of_hot, with_totals

# Relevance thresholds, recency windows and feature order.
RELEVANCE_LEVELS = (3, 5, 6, 7)
WINDOWS = (("final10", 10), ("final50", 50), ("final128", 128), ("final_third", None))
MARKER_COLUMNS = (
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
    "evidence_score",
)
EVIDENCE_COLUMNS = (
    "log_total_tweets",
    "max_relevance",
    "rel3_count_log",
    "rel5_count_log",
    "rel6_count_log",
    "rel7_count_log",
    "rel3_ratio",
    "rel5_ratio",
    "rel6_ratio",
    "rel7_ratio",
    "top10_avg_relevance",
    "evidence_score",
)
STYLISTIC_COLUMNS = ("fp_ratio", "neg_ratio", "selfneg_ratio", "active_ratio", "caregiver_ratio", "active_log", "caregiver_log")
RELEVANCE_COUNT_COLUMNS = tuple(f"rel{t}_ratio" for t in RELEVANCE_LEVELS) + tuple(f"rel{t}_log" for t in RELEVANCE_LEVELS)
TEMPORAL_BASE_COLUMNS = (
    "tweet_count_log",
    "mean_relevance",
    "max_relevance",
    "rel5_count_log",
    "rel7_count_log",
    "rel5_ratio",
    "rel7_ratio",
    "first_person_negative_ratio",
    "active_ideation_count_log",
    "caregiver_third_party_count_log",
    "indirect_sleep_ratio",
    "indirect_fatigue_ratio",
    "indirect_cry_sad_ratio",
    "indirect_anxiety_ratio",
    "indirect_treatment_ratio",
    "indirect_grief_ratio",
    "indirect_help_seeking_ratio",
    "support_outreach_ratio",
)
TEMPORAL_DELTA_COLUMNS = (
    "recent50_minus_lifetime_mean_relevance",
    "recent50_minus_lifetime_rel7_ratio",
    "recent50_minus_lifetime_first_person_negative_ratio",
    "recent50_minus_lifetime_indirect_tone_ratio",
    "last_rel7_normalized_position",
)
TEMPORAL_COLUMNS = tuple(f"{w}_{c}" for w, _ in WINDOWS for c in TEMPORAL_BASE_COLUMNS) + TEMPORAL_DELTA_COLUMNS

LEXICON_BITS = tuple(POST_LEXICON)


def index_posts(df: DataFrame, key: str, order: Sequence[str], block: Column, name: str = "tweet_index") -> DataFrame:
    """Number the posts of a user from 0 in time order, hot users included."""
    ranked = row_numbers(df, [key], [F.col(c) for c in order], block, "__rank")
    return ranked.withColumn(name, (F.col("__rank") - 1).cast("int")).drop("__rank")


def explode_delimited(df: DataFrame, text: str, delimiter: str = " # ", **keep: Column) -> DataFrame:
    """Delimited text to ordered posts; blank segments are posts too."""
    pieces = F.split(F.col(text), rf"\Q{delimiter}\E", -1)
    return df.select(*[c.alias(n) for n, c in keep.items()], F.posexplode(pieces).alias("tweet_index", "tweet_text"))


def explode_nested(df: DataFrame, key: str, texts: str, relevances: str | None = None) -> DataFrame:
    """Parallel text and relevance arrays to ordered posts. Check lengths with :func:`length_mismatches` first."""
    if relevances is None:
        return df.select(key, F.posexplode(texts).alias("tweet_index", "tweet_text"))
    zipped = F.arrays_zip(F.col(texts).alias("t"), F.col(relevances).alias("r"))
    posts = df.select(key, F.posexplode(zipped).alias("tweet_index", "post"))
    return posts.select(key, "tweet_index", F.col("post")["t"].alias("tweet_text"), F.col("post")["r"].alias("relevance_text"))


def length_mismatches(df: DataFrame, key: str, texts: str, relevances: str) -> DataFrame:
    return df.where(F.coalesce(F.size(texts) != F.size(relevances), F.lit(True))).select(key)


def flag_mask(text: Column, lexicon: Mapping[str, str] = POST_LEXICON) -> Column:
    """All lexicon flags of one post in one integer."""
    mask = F.lit(0)
    for bit, name in enumerate(LEXICON_BITS):
        mask = mask + F.when(T.matches(text, lexicon[name]), F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def mask_flags(mask: Column) -> dict[str, Column]:
    return {name: mask.bitwiseAND(F.lit(1 << bit)) != 0 for bit, name in enumerate(LEXICON_BITS)}


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def relevance_histogram(relevance: Column) -> list[Column]:
    """Count per relevance value 0..10: counts, maximum, sum and top-10 mean all follow from it."""
    return [_n(relevance == v).alias(f"__h{v}") for v in range(11)]


def _at_least(level: int) -> Column:
    total = F.col("__h10")
    for v in range(9, level - 1, -1):
        total = total + F.col(f"__h{v}")
    return total


def _histogram_max() -> Column:
    out = F.lit(0)
    for v in range(1, 11):
        out = F.when(F.col(f"__h{v}") > 0, F.lit(v)).otherwise(out)
    return out.cast("double")


def _top_mean(n: int = 10) -> Column:
    """Mean of the n highest relevance values."""
    total, above = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for v in range(10, 0, -1):
        here = F.col(f"__h{v}")
        total = total + F.greatest(F.least(here, F.lit(n) - above), F.lit(0)) * F.lit(v)
        above = above + here
    return total.cast("double") / F.greatest(F.least(F.col("total_tweets"), F.lit(n)), F.lit(1)).cast("double")


def _marker_columns(key: str) -> list[Column]:
    counts = [_at_least(t).alias(f"rel{t}_count") for t in RELEVANCE_LEVELS]
    ratios = [N.ratio_floor1(_at_least(t), F.col("total_tweets")).alias(f"rel{t}_ratio") for t in RELEVANCE_LEVELS]
    return [F.col(key), F.col("total_tweets"), _histogram_max().alias("max_relevance"), *counts, *ratios, _top_mean().alias("top10_avg_relevance")]


def evidence_markers(posts: DataFrame, key: str = "user_id", relevance: str = "relevance") -> DataFrame:
    """Evidence markers: one shuffle of eleven counters per user, no sort and no window."""
    rel = N.relevance_value(relevance)
    counted = posts.groupBy(key).agg(F.count(F.lit(1)).alias("total_tweets"), *relevance_histogram(rel))
    return counted.select(*_marker_columns(key)).withColumn("evidence_score", N.evidence_score())


def evidence_features(markers: DataFrame, key: str = "user_id") -> DataFrame:
    """Twelve evidence features from markers."""
    values = [N.log_count("total_tweets"), F.col("max_relevance")]
    values += [F.log1p(F.col(f"rel{t}_count").cast("double")) for t in RELEVANCE_LEVELS]
    values += [F.col(f"rel{t}_ratio") for t in RELEVANCE_LEVELS]
    values += [F.col("top10_avg_relevance"), F.col("evidence_score")]
    return markers.select(key, *[v.alias(n) for n, v in zip(EVIDENCE_COLUMNS, values)])


def _slim(posts: DataFrame, key: str, lexicon: Mapping[str, str], indexed: bool = True) -> DataFrame:
    return posts.select(
        key,
        *([F.col("tweet_index").cast("bigint").alias("tweet_index")] if indexed else []),
        N.relevance_value("relevance").alias("__rel"),
        flag_mask(F.col("tweet_text"), lexicon).alias("__mask"),
    )


def _lifetime_aggregates() -> list[Column]:
    flags = T.lifetime_flags(mask_flags(F.col("__mask")))
    return [
        F.count(F.lit(1)).alias("total_tweets"),
        *relevance_histogram(F.col("__rel")),
        *[_n(flags[f]).alias(f"__life_{f}") for f in ("fp", "neg", "selfneg", "active", "caregiver", "indirect_tone")],
    ]


def _stylistic() -> dict[str, Column]:
    total = F.col("total_tweets")
    ratios = [N.ratio_floor1(F.col(f"__life_{f}"), total) for f in ("fp", "neg", "selfneg", "active", "caregiver")]
    logs = [F.log1p(F.col(f"__life_{f}").cast("double")) for f in ("active", "caregiver")]
    return dict(zip(STYLISTIC_COLUMNS, ratios + logs))


def _relevance_counts() -> dict[str, Column]:
    ratios = [N.ratio_floor1(_at_least(t), F.col("total_tweets")) for t in RELEVANCE_LEVELS]
    logs = [F.log1p(_at_least(t).cast("double")) for t in RELEVANCE_LEVELS]
    return dict(zip(RELEVANCE_COUNT_COLUMNS, ratios + logs))


def post_blocks(posts: DataFrame, key: str = "user_id", lexicon: Mapping[str, str] = POST_LEXICON) -> DataFrame:
    """Stylistic (7) and relevance-count (8) blocks in one aggregate."""
    counted = _slim(posts, key, lexicon, indexed=False).groupBy(key).agg(*_lifetime_aggregates())
    columns = {**_stylistic(), **_relevance_counts()}
    return counted.select(key, "total_tweets", *[c.alias(n) for n, c in columns.items()])


def post_totals(posts: DataFrame, key: str = "user_id") -> DataFrame:
    """Posts per user; reads one column."""
    return posts.groupBy(key).agg(F.count(F.lit(1)).alias("total"))


def window_start(size: int | None, total: Column) -> Column:
    """First ``tweet_index`` inside a recency window. The index is compared, not a rank."""
    if size is None:
        return F.floor(total * F.lit(2) / F.lit(3))
    return F.greatest(total - F.lit(size), F.lit(0))


_WINDOW_FLAGS = (
    "selfneg",
    "active",
    "caregiver_third_party",
    "sleep",
    "fatigue",
    "cry_sad",
    "anxiety",
    "treatment",
    "grief",
    "help_seeking",
    "support_outreach",
    "indirect_tone",
)


def _window_aggregates() -> list[Column]:
    flags = T.post_flags(mask_flags(F.col("__mask")))
    rel = F.col("__rel")
    out = []
    for name, size in WINDOWS:
        inside = F.col("tweet_index") >= window_start(size, F.col("total"))
        out += [
            _n(inside).alias(f"__{name}_total"),
            F.coalesce(F.sum(F.when(inside, rel)), F.lit(0)).alias(f"__{name}_sum_rel"),
            F.coalesce(F.max(F.when(inside, rel)), F.lit(0)).alias(f"__{name}_max_rel"),
            _n(inside & (rel >= 5)).alias(f"__{name}_rel5"),
            _n(inside & (rel >= 7)).alias(f"__{name}_rel7"),
        ]
        out += [_n(inside & flags[f]).alias(f"__{name}_{f}") for f in _WINDOW_FLAGS]
    return out


def _window_features(name: str) -> list[Column]:
    def c(part: str) -> Column:
        return F.col(f"__{name}_{part}")

    def ratio(part: str) -> Column:
        return N.ratio_floor1(c(part), c("total"))

    def log(part: str) -> Column:
        return F.log1p(c(part).cast("double"))

    values = [log("total"), ratio("sum_rel"), c("max_rel").cast("double"), log("rel5"), log("rel7"), ratio("rel5"), ratio("rel7")]
    values += [ratio("selfneg"), log("active"), log("caregiver_third_party")]
    values += [ratio(f) for f in ("sleep", "fatigue", "cry_sad", "anxiety", "treatment", "grief", "help_seeking", "support_outreach")]
    return [v.alias(f"{name}_{column}") for v, column in zip(values, TEMPORAL_BASE_COLUMNS)]


def last_high_position(last_index: Column, total: Column) -> Column:
    """Position of the last high-relevance post in 0..1; 1 for a single post, 0 when there is none."""
    return (
        F.when(last_index.isNotNull() & (total > 1), N.clamp(last_index.cast("double") / (total - F.lit(1)).cast("double")))
        .when(last_index.isNotNull(), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def _delta_features() -> list[Column]:
    total = F.col("total_tweets")
    sum_rel = F.lit(0)
    for v in range(1, 11):
        sum_rel = sum_rel + F.col(f"__h{v}") * F.lit(v)
    recent_total = F.col("__final50_total")

    def recent(part: str) -> Column:
        return N.ratio_floor1(F.col(f"__final50_{part}"), recent_total)

    values = [
        recent("sum_rel") - N.ratio_floor1(sum_rel, total),
        recent("rel7") - N.ratio_floor1(_at_least(7), total),
        recent("selfneg") - N.ratio_floor1(F.col("__life_selfneg"), total),
        recent("indirect_tone") - N.ratio_floor1(F.col("__life_indirect_tone"), total),
        last_high_position(F.col("__last_rel7"), total),
    ]
    return [v.alias(n) for v, n in zip(values, TEMPORAL_DELTA_COLUMNS)]


def _windowed(posts: DataFrame, key: str, lexicon: Mapping[str, str], hot_rows: int, totals: DataFrame | None) -> DataFrame:
    totals = post_totals(posts, key) if totals is None else totals
    slim = with_totals(_slim(posts, key, lexicon), totals, key, ["tweet_index"], hot_rows=hot_rows)
    last = F.max(F.when(F.col("__rel") >= 7, F.col("tweet_index"))).alias("__last_rel7")
    return slim.groupBy(key).agg(*_lifetime_aggregates(), last, *_window_aggregates())


def temporal_features(
    posts: DataFrame,
    key: str = "user_id",
    lexicon: Mapping[str, str] = POST_LEXICON,
    hot_rows: int = HOT_ROWS,
    totals: DataFrame | None = None,
) -> DataFrame:
    """77 recency features per user. ``totals`` saves counting where post counts exist already."""
    counted = _windowed(posts, key, lexicon, hot_rows, totals)
    windows = [c for name, _ in WINDOWS for c in _window_features(name)]
    return counted.select(key, *windows, *_delta_features())


def timeline_features(
    posts: DataFrame,
    key: str = "user_id",
    lexicon: Mapping[str, str] = POST_LEXICON,
    hot_rows: int = HOT_ROWS,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Markers, stylistic, relevance-count and recency features from one shared aggregate.

    Blocks come back as structs: ``evidence``, ``stylistic``, ``relevance_counts``, ``temporal``.
    """
    counted = _windowed(posts, key, lexicon, hot_rows, totals)
    marked = counted.select("*", *_marker_columns(key)[2:]).withColumn("evidence_score", N.evidence_score())
    evidence = [N.log_count("total_tweets"), F.col("max_relevance")]
    evidence += [F.log1p(F.col(f"rel{t}_count").cast("double")) for t in RELEVANCE_LEVELS]
    evidence += [F.col(f"rel{t}_ratio") for t in RELEVANCE_LEVELS] + [F.col("top10_avg_relevance"), F.col("evidence_score")]
    temporal = [c for name, _ in WINDOWS for c in _window_features(name)] + _delta_features()
    return marked.select(
        key,
        "total_tweets",
        F.struct(*[v.alias(n) for n, v in zip(EVIDENCE_COLUMNS, evidence)]).alias("evidence"),
        F.struct(*[v.alias(n) for n, v in _stylistic().items()]).alias("stylistic"),
        F.struct(*[v.alias(n) for n, v in _relevance_counts().items()]).alias("relevance_counts"),
        F.struct(*temporal).alias("temporal"),
    )


def select_sequence(
    posts: DataFrame,
    n: int,
    order: str = "relevance_desc",
    key: str = "user_id",
    hot_rows: int = HOT_ROWS,
    totals: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` posts per user with a 1-based ``rank`` in sequence order."""
    index, rel = F.col("tweet_index"), N.relevance_value("relevance")
    totals = post_totals(posts, key) if totals is None else totals
    if order == "relevance_desc":
        return top_n_of_hot(posts, key, [rel.desc(), index.desc()], n, totals, ["tweet_index"], hot_rows=hot_rows)
    if order == "recent_chronological":
        recent = top_n_of_hot(posts, key, [index.desc()], n, totals, ["tweet_index"], "__recent", hot_rows)
        # At most n rows per user are left, so this window is bounded.
        return recent.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(index))).drop("__recent")
    raise ValueError(f"unknown sequence order: {order}")


def sequence_table(selected: DataFrame, key: str = "user_id", scale: float = 7.0, values: Sequence[str] = ("embedding",)) -> DataFrame:
    """One row per user: unpadded steps in rank order, length and relevance channel."""
    step = F.struct("rank", "tweet_index", N.relevance_value("relevance").alias("relevance"), *[F.col(v) for v in values])
    grouped = selected.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return grouped.select(
        key,
        F.size("steps").alias("length"),
        "steps",
        F.transform("steps", lambda s: N.channel(s["relevance"], scale).cast("float")).alias("channel"),
    )


def shorten_sequences(sequences: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Smaller top-n tables are prefixes of a larger relevance-ordered one."""
    return sequences.select(
        key,
        F.least(F.col("length"), F.lit(n)).alias("length"),
        F.slice("steps", 1, n).alias("steps"),
        F.slice("channel", 1, n).alias("channel"),
    )


def sequence_mask(length: Column | str, n: int) -> Column:
    """1 for a real step and 0 for padding, ``n`` entries."""
    size = F.col(length) if isinstance(length, str) else length
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= size, F.lit(1)).otherwise(F.lit(0)))


def evidence_pack(posts: DataFrame, n: int, key: str = "user_id", high: int = 7, hot_rows: int = HOT_ROWS, totals: DataFrame | None = None) -> DataFrame:
    """High-relevance posts first, then the rest, each by (relevance, index) descending; ``n`` at most."""
    rel = N.relevance_value("relevance")
    order = [(rel >= high).desc(), rel.desc(), F.col("tweet_index").desc()]
    totals = post_totals(posts, key) if totals is None else totals
    return top_n_of_hot(posts, key, order, n, totals, ["tweet_index"], hot_rows=hot_rows)


def pack_rows(selected: DataFrame, key: str = "user_id", **extra: Column) -> DataFrame:
    """One row per user: selected posts in index order."""
    post = F.struct(
        F.col("tweet_index").cast("int").alias("tweet_index"),
        F.coalesce(F.col("tweet_text"), F.lit("")).alias("tweet_text"),
        N.relevance_value("relevance").alias("gpt5_relevance"),
    )
    grouped = selected.groupBy(key).agg(F.array_sort(F.collect_list(post)).alias("selected_tweets"))
    return grouped.select(F.col(key), *[c.alias(n) for n, c in extra.items()], F.size("selected_tweets").alias("total_selected"), "selected_tweets")


def index_health(posts: DataFrame, key: str = "user_id") -> DataFrame:
    """Per user: posts, distinct indexes, lowest and highest index, and whether they run 0..n-1.

    Rows are reduced to (user, index) first, so a repeated index costs nothing extra.
    """
    pairs = posts.groupBy(key, "tweet_index").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(key).agg(
        F.sum("n").alias("posts"),
        F.count(F.lit(1)).alias("distinct_indexes"),
        F.min("tweet_index").alias("first_index"),
        F.max("tweet_index").alias("last_index"),
    )
    return out.withColumn("unique_index", F.col("posts") == F.col("distinct_indexes")).withColumn(
        "contiguous",
        F.col("unique_index") & (F.col("first_index") == 0) & (F.col("last_index") == F.col("posts") - 1),
    )


BITMAP_POSTS = 1 << 15


def index_coverage(posts: DataFrame, declared: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """Per user: ``posts, covered, gaps, excess, invalid`` of the post index, from bitmaps.

    Each task sets one bit per (user, index) in bitmaps of 32,768 posts, so posts are neither sorted nor kept apart; ``covered``
    counts bits. ``gaps`` are indexes below ``declared`` (``key``, ``posts``; without it: up to the largest index) that no post has.
    ``excess`` are posts that repeat an index or lie beyond the declared number. ``invalid`` are null and negative indexes, which
    count nowhere else. A declared user without posts has only gaps; an undeclared one only excess.
    """
    at = F.col("tweet_index").cast("bigint")
    seen = posts.select(key, F.when(at >= 0, at).alias("__at"))
    if declared is not None:
        whole = declared.select(key, F.col("posts").cast("bigint").alias("__declared"))
    else:
        whole = seen.groupBy(key).agg(F.coalesce(F.max("__at") + 1, F.lit(0)).alias("__declared"))
    bits = seen.groupBy(key, F.floor(F.col("__at") / BITMAP_POSTS).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("__at") % BITMAP_POSTS).alias("__bits"), F.count("__at").alias("__n"), F.count_if(F.col("__at").isNull()).alias("__bad")
    )
    held = bits.join(whole, key, "full").withColumn("__declared", F.coalesce("__declared", F.lit(0)))
    # Only the bucket that the declared number cuts must be looked into bit by bit: its bytes before the cut, and a part of one byte.
    room = F.greatest(F.lit(0), F.least(F.lit(BITMAP_POSTS), F.col("__declared") - F.col("__bucket") * BITMAP_POSTS)).cast("int")
    whole_bytes, rest = F.floor(room / 8).cast("int"), (room % 8).cast("int")
    last = F.conv(F.hex(F.substr("__bits", whole_bytes + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND((F.pow(F.lit(2), rest) - 1).cast("int"))
    cut = F.bitmap_count(F.substr("__bits", F.lit(1), whole_bytes)) + F.coalesce(F.bit_count(last), F.lit(0))
    inside = F.when(room == BITMAP_POSTS, F.bitmap_count("__bits")).otherwise(F.coalesce(cut, F.lit(0)))
    per_user = held.groupBy(key, "__declared").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("posts"), F.coalesce(F.sum(F.when(F.col("__bucket").isNotNull(), inside)), F.lit(0)).alias("covered"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("invalid")
    )
    return per_user.select(key, "posts", "covered", (F.col("__declared") - F.col("covered")).alias("gaps"), (F.col("posts") - F.col("covered")).alias("excess"), "invalid")


def quality_report(posts: DataFrame, key: str = "user_id", relevance_text: str | None = None) -> DataFrame:
    """One row: users, posts, posts per user, blank posts and, where given, relevance tallies."""
    blank = F.count_if(F.trim(F.coalesce("tweet_text", F.lit(""))) == "")
    parts = [F.count(F.lit(1)).alias("posts"), blank.alias("blanks")]
    if relevance_text is not None:
        raw = N.relevance_raw(relevance_text)
        digits = F.trim(F.col(relevance_text).cast("string")).rlike("^[0-9]+$")
        parts += [
            F.count_if(digits).alias("digits"),
            F.count_if(~F.coalesce(digits, F.lit(False))).alias("non_digits"),
            F.count_if(F.coalesce(digits & (F.coalesce(raw, F.lit(11)) > 10), F.lit(False))).alias("out_of_range"),
        ]
    per_user = posts.groupBy(key).agg(*parts)
    out = [
        F.count(F.lit(1)).alias("users"),
        F.sum("posts").alias("posts"),
        F.min("posts").alias("min_posts"),
        F.max("posts").alias("max_posts"),
        F.sum("blanks").alias("blank_posts"),
    ]
    if relevance_text is not None:
        out += [
            F.sum("digits").alias("digit_relevance"),
            F.sum("non_digits").alias("non_digit_relevance"),
            F.sum("out_of_range").alias("out_of_range_relevance"),
            F.count_if(F.col("non_digits") > 0).alias("users_with_non_digit"),
            F.count_if(F.col("out_of_range") > 0).alias("users_with_out_of_range"),
        ]
    return per_user.agg(*out)


def relevance_digits(posts: DataFrame, relevance_text: str) -> DataFrame:
    """Histogram of digit relevance values."""
    return posts.select(N.relevance_raw(relevance_text).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*histograms: DataFrame, value: str = "value", n: str = "n") -> DataFrame:
    """Sum histograms over their values."""
    merged = histograms[0]
    for other in histograms[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(value).agg(F.sum(n).alias(n))


def first_users(users: DataFrame, n: int, split: str = "split", order: Sequence[str] = ("user_id",)) -> DataFrame:
    """First ``n`` users per split; all users when ``n`` is 0 or less."""
    if n <= 0:
        return users
    return top_n(users, [split], [F.col(c) for c in order], n, rank_name="__r").drop("__r")
