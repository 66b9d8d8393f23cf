from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoseal.functions import hashing as H
from chronoseal.functions import labels as L
from chronoseal.functions import numeric as N
from chronoseal.functions import text as T
from chronoseal.functions import vectors as V


def one(spark, column, *values, types=None):
    names = [f"c{i}" for i in range(len(values[0]))] if values else []
    df = spark.createDataFrame(list(values), types or names)
    return [r[0] for r in df.select(column).collect()]


def test_accents_case_and_unicode_boundaries(spark):
    got = one(spark, T.matches("c0", r"\bnão\b"), ("NÃO sei",), ("anão",), ("nao",))
    assert got == [True, False, False]


def test_fold_accents_matches_python(spark):
    texts = ["Pânico", "STRASSE ß", "ﬁm ½", "日本", "Ångström Ÿ", "œuvre", "é", "plain"]
    got = one(spark, T.fold_accents("c0"), *[(t,) for t in texts])
    assert got == [T.fold_text(t) for t in texts]


@pytest.mark.parametrize(
    "text, score",
    [
        ("bom dia a todos", 0),
        ("ansiedade", 3),
        ("eu tenho ansiedade hoje", 6),
        ("EU TENHO ANSIEDADE HOJE", 6),
        ("eu tive uma crise de ansiedade com falta de ar agora, preciso de ajuda", 10),
        ("falta de ar", 2),
        ("minha mãe tem ansiedade", 0),
    ],
)
def test_lexical_relevance(spark, text, score):
    df = spark.createDataFrame([(text,)], ["tweet_text"])
    assert T.with_lexical_relevance(df).first()["relevance"] == score


def test_within_window_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .") for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    left, right = r"\ba+\b", r"b a"

    def brute(t):
        return any(abs(x.start() - y.start()) <= 7 for x in re.finditer(left, t) for y in re.finditer(right, t))

    got = one(spark, T.within_window("c0", left, right, 7), *[(t,) for t in texts])
    assert got == [brute(t) for t in texts]


def test_flag_meanings_of_indirect_tone(spark):
    flags = T.lexicon_flags("c0")
    window, life = T.post_flags(flags)["indirect_tone"], T.lifetime_flags(flags)["indirect_tone"]
    df = spark.createDataFrame([("sem sono",), ("estou triste",), ("quero morrer",)], ["c0"])
    assert [tuple(r) for r in df.select(window, life).collect()] == [(True, False), (True, True), (False, True)]


def test_relevance_parsing(spark):
    df = spark.createDataFrame([("7",), (" 12 ",), ("n/a",), ("-3",), (None,), ("99999999999999999999",)], "c0 string")
    got = [tuple(r) for r in df.select(N.relevance_raw("c0"), N.relevance_score("c0")).collect()]
    assert got == [(7, 7), (12, 10), (None, 0), (None, 0), (None, 0), (None, 10)]
    nums = spark.createDataFrame([(3.0,), (float("nan"),), (None,), (-2.0,), (40.0,)], "c0 double")
    assert [r[0] for r in nums.select(N.relevance_value("c0")).collect()] == [3, 0, 0, 0, 10]


def test_probability_hygiene(spark):
    df = spark.createDataFrame([(float("nan"), 0.5, 0.5), (float("inf"), 0.0, float("-inf")), (0.2, 0.3, 0.5)], "a double, b double, c double")
    out = df.select(*[c.alias(n) for n, c in zip("abc", N.clean_probabilities("a", "b", "c"))]).collect()
    assert all(math.isclose(sum(r), 1.0) for r in out)
    assert out[0]["a"] == pytest.approx((1 / 3) / (4 / 3))
    assert out[1]["a"] == pytest.approx(1.0)
    assert [r[0] for r in df.select(N.probabilities_valid("a", "b", "c")).collect()] == [False, False, True]
    assert [r[0] for r in df.select(N.clean_score("a")).collect()] == [0.5, 1.0, 0.2]


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.floats(0, 1) for _ in range(3)]))
def test_argmax_rule_prefers_the_first_within_tolerance(probs):
    best, value = 0, probs[0]
    for i in (1, 2):
        if probs[i] > value + 1e-12:
            best, value = i, probs[i]
    d, c, n = probs
    lead = c > d + 1e-12
    picked = ("no-evidence" if n > c + 1e-12 else "control") if lead else ("no-evidence" if n > d + 1e-12 else "diagnosed")
    assert picked == L.TERNARY[best]


def test_decision_rules(spark):
    df = spark.createDataFrame([(0.4, 0.35, 0.25), (0.34, 0.33, 0.33), (0.3, 0.3, 0.4), (1 / 3, 1 / 3, 1 / 3)], "d double, c double, n double")

    def run(rule):
        return [r[0] for r in df.select(L.decide_ternary("d", "c", "n", rule)).collect()]

    assert run(L.DecisionRule("a")) == ["diagnosed", "diagnosed", "no-evidence", "diagnosed"]
    assert run(L.DecisionRule("m", "diagnosed_margin", diagnosed_margin=0.1)) == ["control", "control", "no-evidence", "control"]
    assert run(L.DecisionRule("g", "no_evidence_gate", no_evidence_min=0.33)) == ["diagnosed", "diagnosed", "no-evidence", "no-evidence"]


def test_threshold_inclusive_or_strict(spark):
    assert one(spark, L.decide("c0", 0.5), (0.5,), (0.6,)) == ["control", "diagnosed"]
    assert one(spark, L.decide("c0", 0.5, inclusive=True), (0.5,), (0.4,)) == ["diagnosed", "control"]


def test_labels_and_ids(spark):
    assert one(spark, L.normalize_user_id("c0"), (" 12.0 ",), ("12.00",), ("ab.0",)) == ["12", "12.00", "ab.0"]
    assert one(spark, L.normalize_label("c0"), ("Depressed",), ("Not Diagnosed",), ("?",)) == ["diagnosed", "control", None]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, L.normalize_label("c0", strict=True), ("?",))
    assert one(spark, L.normalize_ternary_label("c0"), (" No_Evidence",), ("x",)) == ["no-evidence", None]


def test_one_way_override(spark):
    df = spark.createDataFrame([("diagnosed", False), ("diagnosed", True), ("diagnosed", None), ("control", False), ("no-evidence", False)], "p string, v boolean")
    assert [r[0] for r in df.select(L.override_decision("p", "v")).collect()] == ["control", "diagnosed", "diagnosed", "control", "no-evidence"]


def test_vectors(spark):
    assert one(spark, V.count_dimensions("c0"), ("[1,2,3]",), ("[]",), ("",)) == [3, 0, 0]
    assert one(spark, V.parse_vector("c0"), ("[1,2.5]",)) == [[1.0, 2.5]]
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([1.0],), ([0.0, 0.0],)], "e array<float>")
    assert [r[0] for r in df.select(V.truncate_and_normalize("e", 2)).collect()] == [pytest.approx([0.6, 0.8]), None, [0.0, 0.0]]
    bad = spark.createDataFrame([([1.0, float("nan")],), ([1.0, None],), ([1.0],), (None,)], "e array<float>")
    assert [r[0] for r in bad.select(V.all_finite("e")).collect()] == [False, False, True, False]


def test_hashes_do_not_mix_label_and_redaction(spark):
    import hashlib

    df = spark.createDataFrame([("u1", "diagnosed")], ["user_id", "label"])
    r = df.select(H.row_hash("ds", "train", F.col("label"), F.col("user_id")), H.redacted_hash("ds", "raw", "user_id")).first()
    assert r[0] == hashlib.sha256(b"ds|train|diagnosed|u1").hexdigest()
    assert r[1] == hashlib.sha256(b"ds|raw|test|-1|u1").hexdigest()


def test_number_text(spark):
    assert one(spark, N.fixed_number("c0"), (3.0,), (0.125,), (1e20,)) == ["3", "0.12500000", "100000000000000000000"]
