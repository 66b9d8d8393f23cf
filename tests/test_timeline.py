from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoseal.functions.lexicons import POST_LEXICON
from chronoseal.operators import matching, pooling, ranking
from chronoseal.operators import timeline as TL

from .conftest import rows


def make_posts(spark, seed=3, users=6, gaps=False):
    rng = random.Random(seed)
    words = ["eu", "triste", "sono", "ansiedade", "terapia", "cvv", "quero morrer", "bom", "dia", "meu pai tem depress", "saudade", "socorro"]
    data = []
    for u in range(users):
        index = 0
        for _ in range(rng.choice([1, 9, 60, 140])):
            data.append((f"u{u}", index, " ".join(rng.choice(words) for _ in range(3)), rng.choice([None, 0, 2, 3, 5, 6, 7, 9, 15])))
            index += rng.choice([1, 3]) if gaps else 1
    return data, spark.createDataFrame(data, "user_id string, tweet_index int, tweet_text string, relevance int")


def by_user(data):
    out = {}
    for u, i, t, r in data:
        out.setdefault(u, []).append((i, t, min(max(r or 0, 0), 10)))
    return out


def test_markers_against_a_loop(spark):
    data, posts = make_posts(spark)
    got = {r["user_id"]: r for r in TL.evidence_markers(posts).collect()}
    for user, items in by_user(data).items():
        rels = [r for _, _, r in items]
        top = sorted(rels, reverse=True)[:10]
        assert got[user]["total_tweets"] == len(items)
        assert got[user]["max_relevance"] == max(rels)
        assert got[user]["top10_avg_relevance"] == pytest.approx(sum(top) / len(top))
        for level in (3, 5, 6, 7):
            assert got[user][f"rel{level}_count"] == sum(r >= level for r in rels)


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_recency_features_against_a_loop(spark, gaps, hot_rows):
    import re

    data, posts = make_posts(spark, gaps=gaps)
    patterns = {k: re.compile(v, re.I) for k, v in POST_LEXICON.items()}
    got = {r["user_id"]: r for r in TL.temporal_features(posts, hot_rows=hot_rows).collect()}
    for user, items in by_user(data).items():
        total = len(items)
        for name, size in TL.WINDOWS:
            start = math.floor(total * 2 / 3) if size is None else max(total - size, 0)
            inside = [(t, r) for i, t, r in items if i >= start]
            n = max(len(inside), 1)
            assert got[user][f"{name}_tweet_count_log"] == pytest.approx(math.log1p(len(inside)))
            assert got[user][f"{name}_mean_relevance"] == pytest.approx(sum(r for _, r in inside) / n)
            assert got[user][f"{name}_indirect_sleep_ratio"] == pytest.approx(sum(bool(patterns["sleep"].search(t)) for t, _ in inside) / n)
            ctp = sum(any(patterns[k].search(t) for k in ("caregiver", "third_party", "support_outreach")) for t, _ in inside)
            assert got[user][f"{name}_caregiver_third_party_count_log"] == pytest.approx(math.log1p(ctp))
        high = [i for i, _, r in items if r >= 7]
        want = 0.0 if not high else 1.0 if total == 1 else min(max(high) / (total - 1), 1.0)
        assert got[user]["last_rel7_normalized_position"] == pytest.approx(want)
    assert len(TL.TEMPORAL_COLUMNS) == 77


def test_ranks_by_blocks_equal_row_number(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(1000), k) for k in range(500)]
    df = spark.createDataFrame(data, "k string, v int, id int")
    got = rows(ranking.row_numbers(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 100), "r"), "k", "v", "id", "r")
    want = []
    for key in "ab":
        want += [(key, v, i, n) for n, (v, i) in enumerate(sorted((v, i) for k, v, i in data if k == key), 1)]
    assert got == sorted(want)


def test_split_top_n_equals_plain(spark):
    df = spark.range(400).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").desc()]
    totals = df.groupBy("k").agg(F.count(F.lit(1)).alias("total"))
    plain = rows(ranking.top_n(df, ["k"], order, 7), "k", "v", "id", "rank")
    assert rows(ranking.top_n_of_hot(df, "k", order, 7, totals, ["id"], hot_rows=20), "k", "v", "id", "rank") == plain


def test_sequences_and_packs(spark):
    posts = spark.createDataFrame([("u", i, f"t{i}", r) for i, r in enumerate([8, 1, 7, 3, 9, 0])], "user_id string, tweet_index int, tweet_text string, relevance int")
    seq = TL.sequence_table(TL.select_sequence(posts, 4), values=()).first()
    assert [s["tweet_index"] for s in seq["steps"]] == [4, 0, 2, 3]
    assert list(seq["channel"]) == pytest.approx([1.0, 1.0, 1.0, 3 / 7])
    recent = TL.sequence_table(TL.select_sequence(posts, 3, "recent_chronological"), values=()).first()
    assert [s["tweet_index"] for s in recent["steps"]] == [3, 4, 5]
    short = TL.shorten_sequences(TL.sequence_table(TL.select_sequence(posts, 4), values=()), 2).first()
    assert [s["tweet_index"] for s in short["steps"]] == [4, 0] and short["length"] == 2
    pack = TL.pack_rows(TL.evidence_pack(posts, 4)).first()
    assert [p["tweet_index"] for p in pack["selected_tweets"]] == [0, 2, 3, 4] and pack["total_selected"] == 4


def test_pools_with_empty_levels(spark):
    rng = np.random.default_rng(1)
    data = [(f"u{i % 4}", int(rng.integers(0, 6 if i % 4 == 0 else 11)), [float(x) for x in rng.normal(size=5)]) for i in range(80)]
    posts = spark.createDataFrame(data, "user_id string, relevance int, embedding array<float>")
    for r in pooling.pool_vectors(posts, 5).collect():
        mine = [(rel, np.float32(e)) for u, rel, e in data if u == r["user_id"]]
        for name, level in (("mean", 0), ("rel3", 3), ("rel6", 6), ("rel7", 7)):
            kept = [e.astype(float) for rel, e in mine if rel >= level]
            want = np.mean(kept, axis=0) if kept else np.zeros(5)
            assert list(r[name]) == pytest.approx(list(want), abs=1e-6)
            assert r[f"{name}_count"] == len(kept)
    support = {r["pool"]: r["nonzero_rows"] for r in pooling.pool_support(pooling.pool_vectors(posts, 5)).collect()}
    assert support["mean"] == 4 and support["rel7"] == 3


def frame(spark, texts, user="u"):
    return spark.createDataFrame([(user, i, t) for i, t in enumerate(texts)], "user_id string, tweet_index int, tweet_text string")


def test_ordered_match_golden(spark):
    got = rows(matching.match_ordered_posts(frame(spark, "axab"), frame(spark, "aab")), "target_index", "source_index")
    assert got == [(0, 0), (1, 2), (2, 3)]


@pytest.mark.parametrize("target", ["abz", "ba", "aabb"])
def test_ordered_match_failures(spark, target):
    matches = matching.match_ordered_posts(frame(spark, "axab"), frame(spark, target))
    assert matching.match_findings(matches).count() == 1


def test_ordered_match_equals_greedy(spark):
    rng = random.Random(11)
    sources, targets, want = [], [], []
    for u in range(40):
        source = [rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 40))]
        target = [t for t in source if rng.random() < 0.6]
        if u % 4 == 0 and target:
            rng.shuffle(target)
        positions = matching.greedy_positions(source, target)
        sources += [(f"u{u}", i, t) for i, t in enumerate(source)]
        targets += [(f"u{u}", i, t) for i, t in enumerate(target)]
        want.append((f"u{u}", positions))
    schema = "user_id string, tweet_index int, tweet_text string"
    matches = matching.match_ordered_posts(spark.createDataFrame(sources, schema), spark.createDataFrame(targets, schema))
    failed = {r["detail"] for r in matching.match_findings(matches).collect()}
    got = {}
    for user, target, source in rows(matches, "user_id", "target_index", F.coalesce("source_index", F.lit(-1)).alias("s")):
        got.setdefault(user, []).append(source)
    for user, positions in want:
        if positions is None:
            assert user in failed
        else:
            assert user not in failed
            assert got.get(user, []) == positions


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_jump_tables_equal_greedy(spark, size):
    from chronoseal.operators.jumps import walk_runs

    rng = random.Random(size)
    data, want = [], {}
    for u in range(30):
        source = [rng.choice("abc"[: rng.randrange(2, 4)]) for _ in range(rng.randrange(1, 60))]
        target = [t for t in source if rng.random() < rng.choice([0.3, 0.9])]
        if u % 3 == 0:
            rng.shuffle(target)
        if u % 7 == 0:
            target = target + ["c"] * (len(source) - len(target) + u % 2)
        data += [(u, 0, "s", 10 * i, t) for i, t in enumerate(source)] + [(u, 0, "t", i, t) for i, t in enumerate(target)]
        positions = matching.greedy_positions(source, target)
        for i in range(len(target)):
            want[(u, i)] = None if positions is None else 10 * positions[i]
    frame_of = spark.createDataFrame(data, "user_id int, __run long, side string, position long, __text string")
    got = {(r["user_id"], r["target_index"]): r["source_index"] for r in walk_runs(frame_of, "user_id", size).collect()}
    assert got == want


def test_one_user_with_one_run_is_split(spark):
    from chronoseal.operators.jumps import walk_runs

    rng = random.Random(5)
    source = [rng.choice("abcd") for _ in range(6000)]
    target = [t for t in source if rng.random() < 0.9]
    data = [("u", 0, "s", i, t) for i, t in enumerate(source)] + [("u", 0, "t", i, t) for i, t in enumerate(target)]
    df = spark.createDataFrame(data, "user_id string, __run long, side string, position long, __text string")
    found = walk_runs(df, "user_id", 256)
    assert [r["source_index"] for r in found.orderBy("target_index").collect()] == matching.greedy_positions(source, target)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert walk_runs(df.where("side = 's'"), "user_id", 256).count() == 0
    assert walk_runs(df.limit(0), "user_id", 256).count() == 0


def test_a_user_without_ordered_match_is_an_error(spark):
    source = frame(spark, "axab")
    good = matching.match_ordered_posts(source, frame(spark, "aab"))
    assert matching.matched_posts(source, good, strict=True).count() == 3
    bad = matching.match_ordered_posts(source, frame(spark, "ba"))
    with pytest.raises(Exception, match="match-missing-post"):
        matching.matched_posts(source, bad, strict=True).collect()


def test_quality_and_health(spark):
    posts = spark.createDataFrame([("a", 0, " ", "7"), ("a", 1, "x", "n/a"), ("b", 1, "y", "11"), ("b", 1, "y", "3")], "user_id string, tweet_index int, tweet_text string, rel string")
    q = TL.quality_report(posts, relevance_text="rel").first()
    assert (q["users"], q["posts"], q["blank_posts"], q["digit_relevance"], q["non_digit_relevance"], q["out_of_range_relevance"]) == (2, 4, 1, 3, 1, 1)
    health = {r["user_id"]: (r["unique_index"], r["contiguous"]) for r in TL.index_health(posts).collect()}
    assert health == {"a": (True, True), "b": (False, False)}


def test_index_coverage_against_sets(spark):
    import random

    from chronoseal.operators import timeline as coverage

    rnd = random.Random(4)
    posts = {u: [rnd.choice([None, -1, *range(n)]) for _ in range(n)] for u, n in (("a", 50), ("b", 9), ("c", 1))}
    posts["d"] = [*range(32_760, 32_776), 70_000, 70_000]
    posts["e"] = [None]
    flat = spark.createDataFrame([(u, i) for u, p in posts.items() for i in p], "user_id string, tweet_index int").repartition(3)
    declared = {"a": 40, "b": 9, "c": 3, "d": 32_771, "z": 5}

    def expected(u, n):
        known = [i for i in posts.get(u, []) if i is not None and i >= 0]
        covered = len({i for i in known if i < n})
        return u, len(known), covered, n - covered, len(known) - covered, len(posts.get(u, [])) - len(known)

    got = coverage.index_coverage(flat, spark.createDataFrame(list(declared.items()), "user_id string, posts bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(expected(u, declared.get(u, 0)) for u in {*posts, *declared})
    own = {u: max([i for i in p if i is not None and i >= 0], default=-1) + 1 for u, p in posts.items()}
    assert sorted(map(tuple, coverage.index_coverage(flat).collect())) == sorted(expected(u, n) for u, n in own.items())
