"""Line dedup, decontamination, quality rules, toxicity and language mixture."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from chronoseal.llm import decontamination as D
from chronoseal.llm import language_mixture, line_dedup, quality, toxicity
from chronoseal.llm.fitting import bounded_sample, draw, held_out, share_limit, training_row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))


def test_line_dedup_matches_a_plain_loop(spark, odd_docs):
    got = line_dedup.dedup_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = odd_docs.collect()
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            key = lower(line.strip(line_dedup.BLANKS))
            if len(key) >= 40 and r.doc_id is not None:
                holders[key].add(r.doc_id)

    def clean(r):
        lines = (r.text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(lower(line.strip(line_dedup.BLANKS)), ())
            if r.doc_id is None or len(ids) < 5 or r.doc_id == max(ids):
                kept.append(line)
        return (str(r.doc_id), "\n".join(kept), len(lines), len(lines) - len(kept))

    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(map(clean, rows))
    assert sum(r.n_dropped for r in got.collect()) == 5


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    line = "x" * 50
    rows = [(i, f"{line}\n{i}") for i in range(5)] + [(0, f"other\n{line}\n{line}")]
    got = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {"0", "1", "2", "3", f"{line}\n4", "other"}


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert D.contamination(no_docs, items).count() == 0
    assert quality.judge(no_docs, labels).count() == 0
    assert toxicity.score(no_docs, toxicity.learn(no_docs, labels)).count() == 0
    assert language_mixture.predict(no_docs, language_mixture.learn(no_docs)).count() == 0


def brute_contamination(text, items, window=10):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item_id, item in items:
        v = WORD.findall(lower(item or ""))
        n = min(window, len(v))
        for p in range(len(v) - n + 1) if n else ():
            for q in range(len(w) - n + 1):
                if w[q : q + n] == v[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(item_id)
    return len(w), len(hit), sorted(map(str, found)), bool(hit)


def test_contamination_matches_brute_force(spark, odd_docs, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "a b a b a b b a a b b"), (2, "A"), (3, ""), (4, None), (5, "b a, a"), (6, texts[3]), (6, texts[3]), (7, "word1 word2 word3")]
    frame, wanted = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), (r.n_words, r.n_hit, r.item_ids, r.contaminated)) for r in D.contamination(frame, wanted).collect())
    assert got == sorted((str(i), brute_contamination(t, items)) for i, t in docs)
    # Small segments and small blocks of phrases change nothing.
    index = D.build_index(frame.repartition(3))
    whole = D.phrase_matches(index, wanted).select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", F.explode(F.expr("sequence(s.start, s.stop - 1)")))
    parts = D.phrase_matches(index, wanted, most=3).select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", F.explode(F.expr("sequence(s.start, s.stop - 1)")))
    assert set(map(tuple, whole.collect())) == set(map(tuple, parts.collect()))


def test_a_segment_of_the_index_is_a_row_group(spark):
    # Readers take the rows of a row group together; lists of numbers cost them several times their bytes.
    text = " ".join(f"w{i}" for i in range(100_000))
    index = D.build_index(spark.range(8, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")))
    (file,) = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in index.inputFiles()]
    assert [file.row_group(k).num_rows for k in range(file.num_row_groups)] == [1, 1, 1]
    kinds = {file.schema.column(k).path: file.schema.column(k).physical_type for k in range(len(file.schema))}
    assert {kinds.get(name) for name in ("terms", "ends", "postings")} == {"BYTE_ARRAY"}
    items = spark.createDataFrame([(1, "w99998 w99999"), (2, "w99999 w0")], "item_id bigint, text string")
    found = D.phrase_matches(index, items).collect()
    assert sorted((r.doc_id, r.item_id, r.spans[0].start, r.spans[0].stop) for r in found) == [(k, 1, 99_998, 100_000) for k in range(8)]
    wordless = D.contamination(spark.createDataFrame([(1, None), (2, "!")], "doc_id bigint, text string"), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in wordless) == [(1, 0, 0, []), (2, 0, 0, [])]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare x x common"), (2, "rare x x x x x common"), (3, "common rare"), (4, "rare")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "rare common")], "item_id bigint, text string")
    found = D.proximity_matches(D.build_index(docs), items, slop=3).collect()
    assert {(r.doc_id, r.spans[0].start, r.spans[0].stop) for r in found} == {(1, 0, 4), (3, 0, 2)}


def test_decontaminate_keeps_clean_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "text number 3")], "item_id bigint, text string")
    kept = D.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 1


def test_quality_measures_match_a_plain_loop(spark, odd_docs):
    rnd = random.Random(5)
    made = ["".join(rnd.choice("ab \n\t#|é") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(made)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()

    def measure(i, text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, not failed)

    assert sorted((str(r.doc_id), *r[1:6], r.base_failed, r.kept) for r in got) == sorted(measure(i, t) for i, t in rows)


def labelled(spark, seed, bad):
    """400 documents; the marked half holds words of ``bad``."""
    rnd = random.Random(seed)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(80)]
        if i % 2:
            for _ in range(6):
                words[rnd.randrange(80)] = rnd.choice(bad)
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    return docs, rows


def test_quality_classifier_on_held_out_rows(spark):
    docs, rows = labelled(spark, 1, ["%%%junk", "$$$more", "***thing"])
    labels = spark.createDataFrame([(i, 1 - m) for i, _, m in rows if i % 8 < 6] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert np.mean([got[i] != bool(m) for i, _, m in rows if i % 8 >= 6]) > 0.95


def test_toxicity_on_held_out_rows_and_disguised_words(spark):
    docs, rows = labelled(spark, 2, ["loser", "idiots", "scumbag"])
    labels = spark.createDataFrame([(i, m) for i, _, m in rows] + [(None, 1)], "doc_id bigint, toxic int").where(training_row(F.col("doc_id")))
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(m) for i, _, m in rows)
    tries = [(1, "what a L0S3R"), (2, "ідіоt"), (3, "s​c​umbag"), (4, "nothing here"), (5, None), (6, "")]
    odd = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tries, "doc_id bigint, text string"), model).collect()}
    assert min(odd[i] for i in (1, 2, 3)) >= 0.3 > max(odd[i] for i in (4, 5, 6))


def test_toxicity_exception_phrases():
    model = toxicity.Model(((" trash", 5.0),), (toxicity.fold("trash can"),), (0.0, 1.0, 1.0))
    hits = toxicity.Matcher(model).hits
    assert not hits(toxicity.fold("a trash can here")) and len(hits(toxicity.fold("you trash, can it be"))) == 0
    assert len(hits(toxicity.fold("you are trash"))) == 1


def test_held_out_is_the_rest_of_the_training_rows(spark):
    ids = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id bigint")
    rows = ids.select("doc_id", training_row(F.col("doc_id")).alias("t"), held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.t != r.h for r in rows if r.doc_id is not None)
    assert not any(r.t or r.h for r in rows if r.doc_id is None)


def test_language_mixture(spark):
    rnd = random.Random(4)
    letters = {"xa": "abcde", "xb": "fghij", "xc": "klmno"}
    say = lambda lang, n: " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(n))
    docs = [(i, say(lang, 60), lang) for i, lang in enumerate([*letters] * 20)] + [(900, None, "xa"), (901, "x", None), (None, "x", "xa")]
    model = language_mixture.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert model.names == ("xa", "xb", "xc")
    asked = [(1, say("xa", 50)), (2, say("xb", 70) + " " + say("xc", 30)), (3, None), (4, "12 !!"), (5, ""), (6, say("xc", 3000))]
    got = {r.doc_id: r for r in language_mixture.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert got[1].lang_pred == "xa" and got[1].score > 0.99 and len(got[1].languages) == 1
    assert got[2].lang_pred == "xb" and abs(got[2].score - 0.7) < 0.05 and {x.lang for x in got[2].languages} == {"xb", "xc"}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert got[6].lang_pred == "xc"


def test_a_language_of_one_document_is_learned(spark):
    docs = [(i, "the small house stands near the old river", "en") for i in range(6)] + [(9, "der kleine hund schläft unter dem tisch", "de")]
    model = language_mixture.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, "der hund schläft"), (2, "the old house"), (2, "the old house")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in language_mixture.predict(asked, model).collect())
    assert model.names == ("de", "en") and got == [(1, "de"), (2, "en"), (2, "en")]


def test_samples_are_not_empty_at_any_size(spark):
    assert share_limit(8_000, 10**13) > 0 and share_limit(5, 5) == 1 << 62
    rows = spark.range(200_000).withColumnRenamed("id", "doc_id")
    drawn = rows.select(draw("doc_id").alias("d")).agg(F.min("d"), F.max("d"), F.avg("d")).first()
    assert 0 <= drawn[0] and drawn[1] < 1 << 62 and abs(drawn[2] / (1 << 62) - 0.5) < 0.01
    assert abs(bounded_sample(rows, 10_000).count() - 10_000) < 500 and bounded_sample(rows, 200_000).count() == 200_000
