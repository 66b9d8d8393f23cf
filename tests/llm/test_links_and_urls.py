"""Near-duplicate classes, components, url filters and the pipeline."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chronoseal.llm import arrays as A
from chronoseal.llm import components as C
from chronoseal.llm import url_templates as U
from chronoseal.llm import weighted_minhash as M


def classes_by_hand(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rnd = random.Random(2)
    pairs = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(60, i) for i in range(60)],
        "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(3, 3)],
    }[kind]
    got = {r.node: r.label for r in C.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {k: v for k, v in classes_by_hand(pairs, {n for p in pairs for n in p}).items() if k in nodes}


def near_copies(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for group in range(12):
        base = [word() for _ in range(150)]
        for copy in range(6):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                words[rnd.randrange(150)] = word()
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, shared + " " + " ".join(word() for _ in range(60))) for k in range(30)]
    return rows


def brute_classes(rows, idf, threshold=0.8):
    data, offsets = A.utf8(pa.array([t for _, t in rows]))
    found, counts, n, _ = M.shingles(data, offsets)
    weight = M.weights(found, counts, idf).astype(float)
    ends = np.concatenate(([0], np.cumsum(n)))
    sets = [dict(zip(found[a:b].tolist(), weight[a:b])) for a, b in zip(ends[:-1], ends[1:])]
    links = []
    for i, s in enumerate(sets):
        for j in range(i):
            common = sum(min(w, sets[j][h]) for h, w in s.items() if h in sets[j])
            if common and common / (sum(s.values()) + sum(sets[j].values()) - common) >= threshold:
                links.append((rows[i][0], rows[j][0]))
    return classes_by_hand(links, [i for i, _ in rows])


def test_classes_match_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in M.classes(docs).collect()}
    want = brute_classes(rows, M.idf_table(docs))
    assert got == want and 12 < len(set(want.values())) < len(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    rows = near_copies(6)
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "CHUNK", 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in M.classes(docs).collect()} == brute_classes(rows, M.idf_table(docs))


def test_samples_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    sampler = M.Sampler()
    shared, own = rng.integers(0, 2**63, 80).astype(np.uint64), rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = np.concatenate((shared, own[:20])), np.concatenate((shared, own[20:]))
    weight = rng.uniform(1, 3, 100).astype(np.float32)
    other = np.concatenate((weight[:80] * rng.uniform(0.8, 1.2, 80), weight[80:])).astype(np.float32)
    agree = []
    for trial in range(60):
        taken = sampler.samples(np.concatenate((A.mix(a + np.uint64(trial)), A.mix(b + np.uint64(trial)))), np.concatenate((weight, other)), np.array([100, 100]))
        agree.append((taken[0] == taken[1]).mean())
    low, high = np.minimum(weight[:80], other[:80]).sum(), np.maximum(weight[:80], other[:80]).sum()
    assert abs(np.mean(agree) - low / (high + weight[80:].sum() + other[80:].sum())) < 0.03


@pytest.mark.parametrize("similarity, most", [(0.8, 2.5e-4), (0.82, 1e-4), (0.85, 2e-5)])
def test_few_pairs_share_no_band(similarity, most):
    rng, members, pairs, missed = np.random.default_rng(1), M.Sampler().members, 500_000, 0
    for _ in range(pairs // 50_000):
        equal = (rng.random((50_000, M.SAMPLES), dtype=np.float32) < similarity).astype(np.float32)
        missed += int((equal @ members < M.ROWS - 0.5).all(axis=1).sum())
    assert missed <= most * pairs


def test_odd_rows(spark, odd_docs, no_docs):
    got = M.classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.class_id)
    assert by_id[1] == {1} and by_id[2] == {2} and by_id[3] == {3} and by_id[4] == {4} and by_id[20] == {20}
    assert M.classes(no_docs).count() == 0
    kept = M.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 1


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"))


def test_url_rules_and_parts(spark):
    urls = [
        ("https://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/1#t", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com?u=http://b.org/x", "example.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://x.org/a\nb/é", "x.org", "/a\nb/é", None, "allow"),
        ("http://x.org/" + "/".join("abcdefghijklmnop"), "x.org", "/" + "/".join("abcdefghijklmnop"), None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id bigint, url string, label int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert U.judge(pages.where("false"), RULES).count() == 0


def test_bad_templates_are_rejected_and_variable_segments_merge(spark):
    rows = []
    for k in range(200):
        rows.append((f"http://h.org/blog/{'abcdefghij'[k % 10]}{'qrstuvwxyz'[k // 10 % 10]}{k}x/post", 0))
        rows.append((f"http://h.org/ads/{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}y{chr(97 + k % 26)}{chr(97 + k // 26)}/item", 1))
    pages = spark.createDataFrame([(i, u, label if i % 3 else None) for i, (u, label) in enumerate(rows)], "page_id bigint, url string, label int")
    got = {r.page_id: r for r in U.judge(pages, ()).collect()}
    assert all(got[i].verdict == ("block" if label else "allow") for i, (_, label) in enumerate(rows))
    assert {r.template for r in got.values()} == {"blog/*/post", "ads/*/item"}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = A.stored(stage(spark, docs, sf), name), docs
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        assert stage(spark, empty, sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("bad", [500, 900, 3000])
def test_frequent_branches_are_judged_apart_from_rare_siblings(spark, bad):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"http://h.org/{letters[k % 26]}{letters[k // 26]}slug/{k}", 0) for k in range(600)] + [(f"http://h.org/casino/{k}", 1) for k in range(bad)]
    pages = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id bigint, url string, label int")
    got = U.judge(pages, ()).groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict, r["count"]) for r in got} == {("*/{n}", "allow", 600), ("casino/{n}", "block", bad)}


def plain_templates(counts, wide=U.WIDE, fresh=U.FRESH, support=U.SUPPORT):
    """Template of each (host, segments) of ``counts`` (urls, labelled, bad), by recursion over a plain tree."""
    made = {}

    def descend(keys, prefix):
        level, children = len(prefix), defaultdict(list)
        for key in keys:
            if len(key[1]) == level:
                made[key] = prefix
            else:
                children[key[1][level]].append(key)
        urls = {c: sum(counts[k][0] for k in ks) for c, ks in children.items()}
        rare = {c for c, n in urls.items() if n < support}
        if not (len(rare) >= wide and len(rare) >= fresh * sum(urls[c] for c in rare)):
            rare = set()
        families = defaultdict(list)
        for c, ks in children.items():
            families["*" if c in rare else c] += ks
        for step, ks in families.items():
            descend(ks, (*prefix, step))

    for host in {h for h, _ in counts}:
        descend([k for k in counts if k[0] == host], ())
    return made


def plain_purities(counts, made, smoothing=U.SMOOTHING, similar=U.SIMILAR):
    leaves = defaultdict(lambda: [0, 0])
    for key, (_, labelled, bad) in counts.items():
        leaf = leaves[key[0], made[key]]
        leaf[0] += bad
        leaf[1] += labelled
    purity, all_bad, everything = {}, sum(v[0] for v in leaves.values()), sum(v[1] for v in leaves.values())

    def smooth(bad, labelled, base):
        return (bad + smoothing * base) / (labelled + smoothing)

    def descend(names, level, base):
        branches = defaultdict(list)
        for name in names:
            if len(name[1]) == level:
                purity[name] = base
            else:
                branches[name[1][level]].append(name)
        sums = {b: [sum(leaves[x][i] for x in group) for i in (0, 1)] for b, group in branches.items()}
        bad, labelled = (sum(v[i] for v in sums.values()) for i in (0, 1))
        share = bad / max(1, labelled)
        like = {b for b, (x, n) in sums.items() if n == 0 or abs(x / max(1, n) - share) <= similar * (max(share * (1 - share), 1e-9) / max(1, n)) ** 0.5}
        together = [sum(sums[b][i] for b in like) for i in (0, 1)]
        for b, group in branches.items():
            descend(group, level + 1, smooth(*(together if b in like else sums[b]), base))

    for host in {h for h, _ in leaves}:
        names = [x for x in leaves if x[0] == host]
        descend(names, 0, smooth(*(sum(leaves[x][i] for x in names) for i in (0, 1)), all_bad / max(1, everything)))
    return purity


def test_tree_matches_a_plain_one_at_any_depth(spark):
    rnd, letters = random.Random(4), "abcdefghijklmnopqrst"
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    deep, rows = tuple("p" + c for c in letters[:12]), []
    for host, odds in (("a.org", 0.1), ("b.org", 0.6), ("c.org", 0.3)):
        for k in range(300):
            body = rnd.choice([("blog", word(5)), ("tag", rnd.choice(letters[:4])), (*deep, "good", word(4)), (*deep, "casino", word(4), "end"), (), ("one",), (word(3), word(3), word(3))])
            bad = 0.95 if "casino" in body else odds
            rows += [(host, list(body), rnd.choice([None, 1 if rnd.random() < bad else 0]))] * rnd.choice([1, 1, 1, 3])
    counts = defaultdict(lambda: [0, 0, 0])
    for host, segs, label in rows:
        held = counts[host, tuple(segs)]
        held[0] += 1
        held[1] += label is not None
        held[2] += label or 0
    tree = A.stored(U.template_tree(spark.createDataFrame(rows, "host string, segs array<string>, label int")), "tree")
    made = plain_templates(counts)
    assert {(r.host, tuple(r.segs)): tuple(r.template) for r in tree.collect()} == made
    want = plain_purities(counts, made)
    got = {(r.host, tuple(r.template)): r.purity for r in U.purities(tree).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any("casino" in t and p > U.LIMIT for (_, t), p in got.items()) and any("good" in t and p < U.LIMIT for (_, t), p in got.items())


def test_odd_pages(spark):
    rows = [(1, "http://h.org/a", 1, "x", 0.5)] * 3 + [(None, "http://h.org/a", None, "x", None), (2, None, 7, None, None), (3, "://", 0, "x", 1.0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label int, template string, purity double")
    got = U.judge(pages, ()).collect()
    assert len(got) == len(rows) and [r.page_id for r in got].count(1) == 3
    assert len({r.purity for r in got if r.page_id in (1, None)}) == 1
