"""Post text: lexicon flags, accent folding, proximity and lexical relevance.

Flags are ``rlike`` columns and stay in the JVM. Two things have no exact
built-in: Unicode accent folding and "two matches start within n characters".
Both are Arrow functions that receive only the rows a built-in test could not
settle, every other row is passed as NULL.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .labels import _col
from .lexicons import IDEATION_PATTERN, POST_LEXICON, RELEVANCE_LEXICON, RELEVANCE_POINTS

# Unicode-aware case and word boundaries, as the source lexicon assumes.
_JAVA_FLAGS = "(?iuU)"

INDIRECT_PARTS = ("sleep", "fatigue", "cry_sad", "anxiety", "treatment", "grief", "help_seeking")


def matches(c: Column | str, pattern: str) -> Column:
    """Case-insensitive search; NULL text never matches."""
    return F.coalesce(_col(c).rlike(_JAVA_FLAGS + pattern), F.lit(False))


def lexicon_flags(c: Column | str, lexicon: Mapping[str, str] = POST_LEXICON) -> dict[str, Column]:
    """One boolean column per lexicon entry."""
    return {name: matches(c, pattern) for name, pattern in lexicon.items()}


def post_flags(flags: Mapping[str, Column]) -> dict[str, Column]:
    """Recency-window flags from lexicon flags."""
    tone = flags[INDIRECT_PARTS[0]]
    for name in INDIRECT_PARTS[1:]:
        tone = tone | flags[name]
    return {
        **flags,
        "selfneg": flags["fp"] & flags["neg"],
        "caregiver_third_party": flags["caregiver"] | flags["third_party"] | flags["support_outreach"],
        "indirect_tone": tone,
    }


def lifetime_flags(flags: Mapping[str, Column]) -> dict[str, Column]:
    """Lifetime flags; ``indirect_tone`` has another meaning here than in :func:`post_flags`."""
    return {
        "fp": flags["fp"],
        "neg": flags["neg"],
        "selfneg": flags["fp"] & flags["neg"],
        "active": flags["active"],
        "caregiver": flags["caregiver"],
        "indirect_tone": flags["neg"] | flags["active"] | flags["caregiver"],
    }


def blank_to_space(c: Column | str) -> Column:
    """Encoders get a single space instead of a blank post."""
    return F.when(F.trim(F.coalesce(_col(c), F.lit(""))) == "", F.lit(" ")).otherwise(_col(c))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


# Accented Latin letters and their base letters, in the same order.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


@cache
def _combining_marks() -> re.Pattern[str]:
    marks = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)))
    return re.compile("[" + re.escape(marks) + "]+")


def fold_text(value: str) -> str:
    """Case-fold, decompose, drop combining marks."""
    return _combining_marks().sub("", unicodedata.normalize("NFKD", value.casefold()))


@F.pandas_udf(StringType())
def _fold_arrow(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold_accents(c: Column | str) -> Column:
    """Accent-folded text.

    Lower-casing and replacing the accented Latin letters settles every text
    made of those letters and ASCII; only the others leave the JVM.
    """
    c = _col(c)
    known = _ACCENTED + _ACCENTED.upper().replace("Ÿ", "") + "ß"
    simple = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _ACCENTED, _PLAIN)
    plain = ~c.rlike(rf"[^\x00-\x7F{known}]")
    return F.coalesce(_fold_arrow(F.when(~plain, c)), simple)


def with_folded(df: DataFrame, text: str, name: str) -> DataFrame:
    """Folded text as a column of its own, so that several tests share one evaluation."""
    return df.withColumn(name, fold_accents(text))


def starts_within(text: str, left: re.Pattern[str], right: re.Pattern[str], window: int) -> bool:
    """Does any match of ``left`` start within ``window`` characters of one of ``right``?

    Both match lists are in order, so one merge pass is enough.
    """
    rights = [m.start() for m in right.finditer(text)]
    at = 0
    for match in left.finditer(text):
        while at < len(rights) and rights[at] < match.start() - window:
            at += 1
        if at == len(rights):
            return False
        if rights[at] <= match.start() + window:
            return True
    return False


def within_window(c: Column | str, left: str, right: str, window: int = 80) -> Column:
    """Exact proximity test.

    The look-ahead form accepts every row the exact test accepts (it also sees
    starts inside a longer match), so only its candidates go to Python.
    """
    c = _col(c)
    near = f"(?s)(?:(?={left}).{{0,{window}}}(?={right})|(?={right}).{{0,{window}}}(?={left}))"
    candidate = F.coalesce(c.rlike("(?U)" + near), F.lit(False))
    left_re, right_re = re.compile(left), re.compile(right)

    @F.pandas_udf(BooleanType())
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: starts_within(t, left_re, right_re, window), na_action="ignore").astype("boolean")

    return F.coalesce(exact(F.when(candidate, c)), F.lit(False))


def lexical_relevance(
    folded: Column | str,
    lexicon: Mapping[str, str] = RELEVANCE_LEXICON,
    points: Mapping[str, int] = RELEVANCE_POINTS,
    window: int = 80,
) -> Column:
    """Relevance 0..10 of folded text from lexicon hits; 0 unless a direct or an acute term occurs."""
    text = _col(folded)
    hit = {name: F.coalesce(text.rlike("(?U)" + pattern), F.lit(False)) for name, pattern in lexicon.items() if name != "self_token"}
    relevant = hit["direct"] | hit["acute"]
    evidence = f"(?:{lexicon['direct']})|(?:{lexicon['acute']})"
    hit["self_experience"] = within_window(F.when(relevant, text), f"(?:{lexicon['self_token']})", f"(?:{evidence})", window)
    hit["direct_and_acute"] = hit["direct"] & hit["acute"]
    total = F.lit(0)
    for name, value in points.items():
        total = total + hit[name].cast("int") * F.lit(int(value))
    return F.when(relevant, F.least(F.greatest(total, F.lit(0)), F.lit(10))).otherwise(F.lit(0))


def with_lexical_relevance(df: DataFrame, text: str = "tweet_text", name: str = "relevance", **options: object) -> DataFrame:
    """Add the lexical relevance of a raw text column."""
    scored = with_folded(df, text, "__folded").withColumn(name, lexical_relevance("__folded", **options))
    return scored.drop("__folded")


def keyword_verdict(texts: Column | str, pattern: str = IDEATION_PATTERN) -> Column:
    """Baseline override column: does any selected post match the pattern?"""
    return F.exists(_col(texts), lambda t: F.coalesce(t.rlike(_JAVA_FLAGS + pattern), F.lit(False)))
