"""Stages decide on rows, not on ids: rows that share an id, null ids, repeated rows; and words without a break."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoseal.llm import bpe, decontamination, quality, weighted_minhash
from chronoseal.llm.leavers import row_key, without

A, B = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
CLEAN = " ".join(f"c{i}" for i in range(60))


def texts(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__key", F.lit("own")).repartition(3)


def test_one_row_of_each_class_stays(spark):
    rows = [(3, A), (7, A), (7, B), (9, B), (11, CLEAN), (11, CLEAN), (None, CLEAN), (None, "only null"), (None, "only null"), (12, None), (12, None)]
    kept = weighted_minhash.keep_one(frame(spark, rows).drop("__key"))
    assert texts(kept.where("text is not null")) == sorted([(3, A), (7, B), (11, CLEAN), (-1, "only null")])
    assert kept.where("text is null").count() == 2


def test_near_copies_under_one_id_leave_one_row(spark):
    near = A + " end"
    kept = weighted_minhash.keep_one(frame(spark, [(5, near), (5, A), (5, A), (4, B)]).drop("__key"))
    assert len(texts(kept)) == 2 and {t for _, t in texts(kept)} - {A, near} == {B}


def test_quality_filter_judges_rows(spark):
    short = "too short"
    rows = [(1, CLEAN), (1, short), (None, CLEAN), (None, short), (2, None), (2, ""), (3, CLEAN), (3, CLEAN)]
    docs = frame(spark, rows)
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert kept.columns == docs.columns
    assert texts(kept) == sorted([(1, CLEAN), (-1, CLEAN), (3, CLEAN), (3, CLEAN)])
    assert quality.keep_good(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 0


def test_decontamination_judges_rows(spark):
    items = spark.createDataFrame([(1, A)], "item_id bigint, text string")
    rows = [(1, f"x {A} y"), (1, CLEAN), (None, A), (None, CLEAN), (2, None), (2, ""), (3, B), (3, B)]
    kept = decontamination.decontaminate(frame(spark, rows).drop("__key"), items)
    assert texts(kept.where("text is not null")) == sorted([(1, CLEAN), (-1, CLEAN), (2, ""), (3, B), (3, B)])
    assert kept.where("text is null").count() == 1


def test_rows_leave_by_key_alone(spark):
    docs = spark.range(5000).withColumn("text", F.concat(F.lit("t"), (F.col("id") % 1000).cast("string")))
    key = row_key(F.col("text"))
    gone = docs.where("id < 300").select(key.alias("k")).distinct()
    got = without(docs, key, gone)
    assert got.columns == docs.columns and got.count() == 3500 and got.where("id % 1000 < 300").count() == 0
    assert without(docs, key, gone.limit(0)).count() == 5000


def test_the_quality_fit_does_not_depend_on_arrival(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words + ["$$$"] * (8 if i % 3 == 0 else 0)) for _ in range(60))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    fits = [quality.train(spark.createDataFrame(rows[::step], "doc_id bigint, text string").repartition(n), labels) for step, n in ((1, 1), (-1, 5), (1, 7))]
    assert np.array_equal(fits[0], fits[1]) and np.array_equal(fits[0], fits[2])


@pytest.fixture(scope="module")
def codec_file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_words_without_a_break_are_merged_exactly(spark, codec_file):
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(codec_file), random.Random(2)
    made = ["".join(rnd.choice(letters) for _ in range(n)) for letters, n in (("ab", 513), ("etaoinshrdlu", 60_000), ("é", 700), ("abcdefghij", 512))]
    rows = [(i, text) for i, text in enumerate([*made, f"a {made[1]} b {made[1]}", "x" * 5000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.with_ids(docs, bpe.build_codec(docs, codec_file)).collect()}
    assert all(got[i] == library.encode(text, add_special_tokens=False).ids for i, text in rows)


def test_long_and_short_words_keep_their_order(codec_file):
    merges = bpe.Merges(open(codec_file).read())
    words = [b"hello", b"x" * 700, b" the", b"ab" * 400, b"zz"]
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ids, counts = merges.merge(data, np.cumsum(sizes) - sizes, sizes)
    alone = [merges._merge_short(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0].tolist() for w in words]
    assert ids.tolist() == sum(alone, []) and counts.tolist() == [len(a) for a in alone]
    assert pa.array(ids).null_count == 0
