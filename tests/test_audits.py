from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoseal.operators import alignment as A
from chronoseal.operators import audits as AU
from chronoseal.operators import overrides as O
from chronoseal.operators import splits as SP

from .conftest import rows

MAN = "user_id string, label string, split string, fold int"
OOF = "user_id string, label string, fold int, score double, model_id string"


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame([("D1", "diagnosed", "train", 1), ("C1", "control", "train", 2), ("TC1", "control", "test", None)], MAN)


def codes(findings):
    return sorted(r["code"] for r in findings.collect())


def test_clean_scores_pass(spark, manifest):
    good = spark.createDataFrame([("D1", "diagnosed", 1, 0.9, "m"), ("C1", "control", 2, 0.1, "m")], OOF)
    report = AU.audit_oof(manifest, good, ["m"])
    assert codes(report) == ["oof-integrity"] and A.report_ok(report).first()["ok"]


def test_every_oof_fault_has_a_code(spark, manifest):
    bad = spark.createDataFrame([("D1", "control", 2, float("nan"), "m"), ("D1", "diagnosed", 1, 0.5, "m"), ("TC1", "control", None, 0.2, "m")], OOF)
    assert codes(AU.audit_oof(manifest, bad, ["m"])) == [
        "oof-duplicate-user",
        "oof-fold-mismatch",
        "oof-label-mismatch",
        "oof-missing-user",
        "oof-nonfinite-score",
        "oof-test-user",
        "oof-unknown-user",
    ]


def test_test_tables_must_not_carry_labels(spark):
    ok = spark.createDataFrame([("a", 0.5, "m")], "user_id string, score double, model_id string")
    assert codes(AU.audit_test_scores(ok, "t")) == ["test-score-schema"]
    assert codes(AU.audit_test_scores(ok.withColumn("label", F.lit("x")), "t")) == ["test-score-forbidden-column"]
    assert codes(AU.audit_test_scores(ok.drop("model_id"), "t")) == ["test-score-missing-column"]
    assert codes(AU.audit_test_scores(ok.withColumn("score", F.lit(float("nan"))), "t")) == ["test-score-nonfinite-score"]


def test_redaction_hides_labels(spark):
    users = spark.createDataFrame([(f"u{i}", "diagnosed" if i % 3 == 0 else "control", "test" if i % 4 == 0 else "train") for i in range(40)], "user_id string, label string, split string")
    full = SP.build_manifest(users, "ds", 5, 1)
    red = SP.redact(full, "ds", "raw")
    assert codes(AU.audit_redacted_manifest(red, "ds", "raw", 10)) == ["redacted-manifest"]
    assert set(r["label"] for r in red.where("split = 'test'").collect()) == {"-1"}
    assert "redacted-row-count" in codes(AU.audit_redacted_manifest(red, "ds", "raw", 11))
    assert codes(AU.audit_redacted_manifest(red.where("split = 'test'").limit(1).drop("row_hash").join(full.select("user_id", "row_hash"), "user_id"), "ds", "raw")) == ["redacted-hash-leak"]
    assert SP.sealed_labels(full).count() == 10


def test_digests_see_order_but_not_partitions(spark):
    posts = spark.createDataFrame([("u", i, f"t{i}") for i in range(50)], "user_id string, tweet_index int, tweet_text string")
    one = SP.timeline_digests(posts, text="tweet_text", fan=4, levels=3).first()["digest"]
    assert one == SP.timeline_digests(posts.repartition(5), text="tweet_text", fan=4, levels=3).first()["digest"]
    moved = posts.withColumn("tweet_text", F.when(F.col("tweet_index") == 7, F.lit("t8")).when(F.col("tweet_index") == 8, F.lit("t7")).otherwise(F.col("tweet_text")))
    assert one != SP.timeline_digests(moved, text="tweet_text", fan=4, levels=3).first()["digest"]


def test_nested_fit_records(spark):
    schema = "outer_fold int, inner_validation_fold int, fit_folds array<int>"

    def ok(*records):
        return AU.nested_fit_check(spark.createDataFrame(list(records), schema)).first()["ok"]

    assert ok((1, 2, [3, 4, 5]))
    assert not ok((1, 2, [1, 3]))
    assert not ok((1, 2, [2, 3]))
    assert not ok()


def test_gates_raise(spark, manifest):
    with pytest.raises(RuntimeError, match="stage: oof-missing-user"):
        AU.require(AU.audit_oof(manifest, spark.createDataFrame([], OOF), ["m"]), "stage")
    lock = spark.createDataFrame([(0.5, "a")], "threshold double, strategy string")
    recorded = AU.lock_hash(lock).first()["sha256"]
    AU.require_lock(lock, recorded)
    with pytest.raises(RuntimeError, match="changed"):
        AU.require_lock(lock.withColumn("threshold", F.lit(0.6)), recorded)
    with pytest.raises(RuntimeError, match="expected one lock"):
        AU.require_lock(lock.where("false"))


def test_lock_weights(spark):
    def check(weights):
        return codes(AU.audit_lock(spark.createDataFrame([(weights,)], "weights map<string,double>"), ["a", "b"], 0.05, 0.05))

    assert check({"a": 0.55, "b": 0.45}) == ["lock-weights"]
    assert check({"a": 0.52, "b": 0.48}) == ["lock-step"]
    assert check({"a": 1.0, "b": 0.0}) == ["lock-minimum"]
    assert check({"a": 0.5, "c": 0.5}) == ["lock-model-set"]


def test_archive_chain(spark):
    rec = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, size long, sha256 string")
    act = spark.createDataFrame([("a", 1, "x"), ("b", 2, "q"), ("d", 4, "w")], "path string, size long, sha256 string")
    assert rows(A.hash_chain(rec, act), "code", "detail") == [("artifact-missing", "c"), ("artifact-sha256", "b"), ("artifact-unrecorded", "d")]


def test_shards(spark):
    users = spark.range(300).select(F.col("id").alias("position"))
    shards = spark.createDataFrame([(0, 10, "a"), (10, 200, "b"), (200, 200, "empty"), (250, 300, "c")], "start long, end long, shard string")
    got = {r["shard"]: r["count"] for r in A.shard_assignment(users, shards).groupBy("shard").count().collect()}
    assert got == {"a": 10, "b": 190, "c": 50}


# --- overrides -----------------------------------------------------------------------


def test_override_needs_a_decision_for_each_flagged_row(spark):
    p = spark.createDataFrame([("a", "diagnosed"), ("b", "control"), ("c", "diagnosed"), ("d", "diagnosed")], "user_id string, predicted string")
    d = spark.createDataFrame([("a", "diagnosed", False), ("c", "control", False)], "user_id string, base_decision string, llm_true_depression boolean")
    assert rows(O.decision_findings(p, d), "code", "detail") == [("decision-base", "c"), ("decision-missing", "d")]
    with pytest.raises(Exception, match="decision-(base|missing)"):
        O.apply_decisions(p, d).collect()
    twice = spark.createDataFrame([("a", "diagnosed", False), ("a", "diagnosed", True)], "user_id string, base_decision string, llm_true_depression boolean")
    with pytest.raises(Exception, match="decision-duplicate a"):
        O.apply_decisions(p.where("user_id = 'a'"), twice).collect()
    full = d.where("user_id = 'a'").unionByName(spark.createDataFrame([("c", "diagnosed", True), ("d", "diagnosed", False)], d.schema))
    assert dict(rows(O.apply_decisions(p, full), "user_id", "final")) == {"a": "control", "b": "control", "c": "diagnosed", "d": "control"}


def test_message_and_hash(spark):
    schema = "user_id string, total_selected int, selected_tweets array<struct<tweet_index:int,tweet_text:string,gpt5_relevance:int>>"
    pack = spark.createDataFrame([("u", 1, [(7, " a \n b ", 8)])], schema)
    assert pack.select(O.user_message()).first()[0].endswith("- idx=7 rel=8: a b")
    a, b = (pack.select(O.request_hash(O.api_model(F.lit(m)), "p")).first()[0] for m in ("x", "x[1M]"))
    assert a == b


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"content":[{"type":"tool_use","name":"classify_true_depression","input":{"true_depression":true,"confidence":0.91,"reason":"a  b"}}]}', (True, 0.91, "a b", None)),
        ('{"content":[{"type":"text","text":"see {\\"true_depression\\": false, \\"confidence\\": 0.2, \\"reason\\": \\"r\\"}."}]}', (False, 0.2, "r", None)),
        ('{"content":[{"type":"text","text":"{\\"true_depression\\": \\"maybe\\", \\"confidence\\": 0.2, \\"reason\\": \\"r\\"}"}]}', (None, 0.2, "r", "no-boolean")),
        ('{"content":[{"type":"text","text":"{\\"true_depression\\": true, \\"confidence\\": 2, \\"reason\\": \\"r\\"}"}]}', (True, 2.0, "r", "bad-confidence")),
        ('{"content":[{"type":"text","text":"{\\"true_depression\\": true, \\"confidence\\": 0.5, \\"reason\\": \\" \\"}"}]}', (True, 0.5, "", "no-reason")),
        ('{"content":[]}', (None, 0.0, "", "no-json")),
    ],
)
def test_parse(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[c.alias(k) for k, c in O.parse_tool_response("t").items()]).first()
    assert tuple(got) == want


def test_cache(spark):
    requests = spark.createDataFrame([("a", "h1"), ("b", "h2")], "user_id string, request_hash string")
    cache = spark.createDataFrame([("h1", "r")], "request_hash string, response string")
    assert rows(O.uncached(requests, cache), "user_id") == [("b",)]
    assert rows(O.cached(requests, cache), "user_id", "cache_hit") == [("a", True), ("b", False)]


def test_users_that_fail_the_match_have_no_posts(spark):
    from chronoseal.operators import matching

    source = spark.createDataFrame([("u", 0, "a"), ("u", 1, "b"), ("u", 2, "c"), ("v", 0, "a"), ("v", 1, "b")], "user_id string, tweet_index bigint, tweet_text string")
    target = spark.createDataFrame([("u", 0, "c"), ("u", 1, "a"), ("u", 2, "zz"), ("v", 0, "b")], "user_id string, tweet_index bigint, tweet_text string")
    matches = matching.match_ordered_posts(source, target)
    assert rows(matching.matched_posts(source, matches), "user_id", "tweet_text") == [("v", "b")]
    assert rows(matching.match_findings(matches), "detail") == [("u",)]


def test_deep_timelines_have_one_digest(spark):
    posts = spark.createDataFrame([("u", 0), ("u", 70)], "user_id string, tweet_index bigint")
    assert SP.timeline_digests(posts, fan=8, levels=2).count() == 1


def test_a_missing_user_fails_alignment_and_assembly(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, fold int")
    full = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 3.0)], "user_id string, x double")
    part = full.where("user_id <> 'b'").withColumnRenamed("x", "y")
    assert rows(A.align_to_manifest(manifest, full)) == [("a", 1, 1.0), ("b", 2, 2.0)]
    assert rows(A.assemble_blocks(manifest, [full, full.withColumnRenamed("x", "y")])) == [("a", 1, 1.0, 1.0), ("b", 2, 2.0, 2.0)]
    for broken in (A.align_to_manifest(manifest, part), A.assemble_blocks(manifest, [full, part])):
        with pytest.raises(Exception, match="missing-user.*lacks b"):
            broken.collect()
    assert A.align_to_manifest(manifest.limit(0), part).count() == 0
