"""Collocations, exact copies and importance resampling against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoseal.llm import collocations, exact_dedup, importance_resampling
from tests.conftest import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(docs, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(1000 * a * n[lang] // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            inside = any(
                c >= a and len(other) > len(phrase) and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
                for other, c in counts.items()
                if c >= least
            )
            if not inside:
                found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def story(rng, words):
    parts = rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n"], words)
    return "".join(f"{w}{p}" for w, p in zip(rng.choice(["The", "cat", "of", "New", "York", "é", "a-b", "x"], words, p=[0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]), parts))


def story_docs(spark):
    rng = np.random.default_rng(5)
    long = story(rng, 9000)
    data = [("en", story(rng, 200)) for _ in range(20)] + [(None, story(rng, 150)), ("und", story(rng, 150)), ("fr", "again " * 5000)]
    data += [("en", long)] * 3 + [("de", long.upper() + "tail"), ("en", None), ("en", ""), ("en", "...\n \t"), ("en", "one")]
    return spark.createDataFrame(data, "lang string, text string").repartition(3), data


@pytest.mark.parametrize("chunk_words, most_words", [(64, 1024), (4, 16), (1, 1)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, chunk_words, most_words):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk_words)
    monkeypatch.setattr(collocations, "MOST_WORDS", most_words)
    docs, data = story_docs(spark)
    got = collocations.collocations(docs, least=12, top=150)
    assert rows(got) == plain_collocations(data, 12, 5, 150)


def test_collocations_with_a_full_filter_and_shorter_phrases(spark, monkeypatch):
    # A filter with every bit set passes everything on to the exact count.
    monkeypatch.setattr(collocations, "hash_filter", lambda *_: np.full(8, 255, np.uint8))
    docs, data = story_docs(spark)
    assert rows(collocations.collocations(docs, least=20, longest=3, top=40)) == plain_collocations(data, 20, 3, 40)
    assert rows(collocations.collocations(docs, least=20, longest=2, top=40)) == plain_collocations(data, 20, 2, 40)


def test_the_parse_holds_every_start_once(spark):
    docs, data = story_docs(spark)
    chunks = collocations.dictionary(docs)
    words = sum(len(re.findall(r"[^ \t.,;:!?\n]+", text or "")) for _, text in data)
    total = chunks.selectExpr("sum(core * freq)", "count(*)", "sum(freq)").first()
    assert total[0] == words
    assert total[1] < total[2]  # copies share their chunks


def test_collocations_of_odd_rows(spark, odd_docs, no_docs):
    data = [(r.lang, r.text) for r in odd_docs.collect()]
    assert rows(collocations.collocations(odd_docs, least=2, top=60)) == plain_collocations(data, 2, 5, 60)
    assert collocations.collocations(no_docs).count() == 0


def test_scores_beyond_64_bits_stay_exact(spark):
    a, n = 3 * 10**12 + 7, 9 * 10**12 + 1
    frequent = spark.createDataFrame([("x", 1, "p", a + 1), ("x", 1, "q", a + 2), ("x", 2, "p q", a)], "lang string, words int, phrase string, f bigint")
    got = collocations._scored(frequent, spark.createDataFrame([("x", n)], "lang string, n bigint")).first()
    assert got.score == 1000 * a * n // ((a + 1) * (a + 2))


def plain_copies(docs):
    """(id, keep id, size, digest) sorted; and the rows that stay, by text."""
    groups = defaultdict(list)
    for doc, text in docs:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, digest = max(known) if known else None, hashlib.sha256(text.encode()).hexdigest()
        out += [(-1 if i is None else i, -1 if keep is None else keep, len(ids), digest) for i in ids]
    return sorted(out), len(groups)


def copies(got):
    found = got.collect()
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in found), sum(r.kept for r in found)


@pytest.mark.parametrize("blocks", [None, 1])
def test_copies_equal_a_plain_grouping(spark, monkeypatch, blocks):
    if blocks:  # far too small a filter: more false alarms, the same rows
        monkeypatch.setattr(exact_dedup, "filter_blocks", lambda n: blocks)
    data = [(i, f"Text {i % 700}") for i in range(1500)] + [(i, f"own {i}") for i in range(2000, 9000)]
    data += [(i, "hot COPY") for i in range(10_000, 13_000)] + [(None, "hot copy"), (None, "nobody"), (None, "NOBODY"), (7, "Text 7"), (7, "text 7")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    assert copies(exact_dedup.mark_copies(docs, hot_rows=200)) == plain_copies(data)


def test_copies_of_odd_rows(spark, odd_docs, no_docs):
    data = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert copies(exact_dedup.mark_copies(odd_docs)) == plain_copies(data)
    assert exact_dedup.mark_copies(no_docs).count() == 0
    clash = odd_docs.withColumn("kept", odd_docs["part"]).withColumn("keep_id", odd_docs["part"])
    assert copies(exact_dedup.mark_copies(clash)) == plain_copies(data)
    left = exact_dedup.drop_copies(clash)
    assert left.columns == clash.columns
    assert left.count() == plain_copies(data)[1] and {r.kept for r in left.collect()} <= {"p", None}


def test_only_possible_copies_pass_the_filter(spark):
    data = [(i, f"own text {i}") for i in range(20_000)] + [(30_000 + i, f"copy {i % 500}") for i in range(1000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    hashed = docs.select("doc_id", exact_dedup.F.xxhash64(exact_dedup.text_digest(docs["text"])).alias("__hash"))
    blocks = exact_dedup.filter_blocks(len(data))
    probed = exact_dedup.possibly_repeated(hashed, exact_dedup.repeated_bits(hashed, blocks), blocks)
    assert probed.where("__maybe and doc_id >= 30000").count() == 1000
    assert probed.where("__maybe and doc_id < 30000").count() < 0.05 * 20_000


def plain_draw(docs, target, share=25):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall

    def buckets(text):
        w = find((text or "").translate(LOWER))
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[0])
    for text in target:
        t.update(buckets(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out, able = [], []
    for doc, text in docs:
        found, n = buckets(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                able.append((-score, doc, len(out)))
        out.append([doc, len(found), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(able)[: len(able) * share // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def draw_data():
    rng = np.random.default_rng(11)
    names = [f"w{i}" for i in range(400)] + ["ÉTÉ", "naïve", "漢字", "😀", "UPPER", "x" * 50, "y" * 200]
    text = lambda n: "".join(f"{w}{s}" for w, s in zip(rng.choice(names, n), rng.choice([" ", ", ", "\x00", "-"], n)))
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 80, 400))]
    docs += [(None, text(40)), (500, None), (501, ""), (502, "!!!"), (503, text(5000)), (504, "z" * 3000), (505, docs[30][1]), (505, docs[30][1]), (506, text(19)), (507, text(20))]
    return docs, [text(30) for _ in range(5)] + [None, "", "w1 w2"]


@pytest.mark.parametrize("part", [1 << 20, 100])
def test_draw_equals_a_plain_loop(spark, monkeypatch, draw_data, part):
    docs, target = draw_data
    found = [np.concatenate(c) for c in zip(*importance_resampling.features(importance_resampling.pa.array([t for _, t in docs]), part))]
    whole = [np.concatenate(c) for c in zip(*importance_resampling.features(importance_resampling.pa.array([t for _, t in docs])))]
    assert sorted(zip(*found)) == sorted(zip(*whole))  # cuts lose and double nothing
    left = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    if part == 100:
        left = left.withColumn("score", left["text"]).withColumn("rank", left["text"]).withColumn("bucket", left["text"])
    assert drawn(importance_resampling.resample(left, right)) == plain_draw(docs, target)


def test_draw_of_odd_rows(spark, odd_docs, no_docs):
    data = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert drawn(importance_resampling.resample(odd_docs, odd_docs)) == plain_draw(data, [t for _, t in data])
    assert drawn(importance_resampling.resample(odd_docs, no_docs)) == plain_draw(data, [])
    assert importance_resampling.resample(no_docs, odd_docs).count() == 0
