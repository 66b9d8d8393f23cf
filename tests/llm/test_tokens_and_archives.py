"""BPE, token files and WARC archives."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoseal.llm import arrays as A
from chronoseal.llm import bpe, token_files, warc
from chronoseal.llm.arrays import shared_path

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_library(library):
    rnd = random.Random(1)
    alphabet = " \n\t'  ''srevlltmdaÉß1२!… 　\u0085\x1c漢😀"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoft", "ext|>", "", "  ", "x's's 're", " 's", "\n's", "''s"]
    with open(PATH, encoding="utf-8") as f:
        merges = bpe.Merges(f.read())
    data, offsets = A.utf8(pa.array(texts))
    for words in ([], [b" the", b"a", b"'s", "É".encode(), b" ", b"\n"]):
        ids, counts = bpe.encode(data, offsets, merges, bpe.Lexicon(bpe.compile_lexicon(words, merges)))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [ids_of(library, t) for t in texts]
    assert merges.decode(ids)[0].tobytes() == data.tobytes()


def test_lexicon_is_minimal_and_numbers_its_words():
    with open(PATH, encoding="utf-8") as f:
        merges = bpe.Merges(f.read())
    words = [b"walked", b"talked", b"walks", b"talks", b"talk"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, merges))
    assert lexicon.head["states"] == 11  # "ed" and "s" end in one state; "walk" is no word, so its path stays apart
    asked = [*words, b"walk", b"talkin", b"x"]
    data, sizes = np.frombuffer(b"".join(asked), np.uint8), np.array([len(w) for w in asked])
    got = lexicon.numbers(data, np.cumsum(sizes) - sizes, sizes)
    assert [sorted(words).index(w) if w in words else -1 for w in asked] == got.tolist()


def test_round_trip_query_rows(spark, odd_docs, no_docs, library):
    codec = bpe.build_codec(odd_docs, PATH, most=50)
    encoded = bpe.with_ids(odd_docs, codec)
    assert encoded.columns == [*(c for c in odd_docs.columns if c != "ids"), "ids"]
    decoded = bpe.with_decoded(encoded, codec)
    for r in decoded.collect():
        assert r.ids == ids_of(library, r.text)
        assert r.decoded == (r.text or "")
    assert bpe.round_trip(odd_docs, codec).count() == odd_docs.count()
    assert bpe.round_trip(no_docs, bpe.build_codec(no_docs, PATH)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd_docs, library, encoding):
    path = shared_path(spark, "test")
    token_files.write_tokens(odd_docs, path, PATH, end_id=2, encoding=encoding)
    rows = token_files.read_tokens(spark, path)
    assert {"lang", "source", "score", "part", "at", "ids"} <= set(rows.columns)
    got = token_files.with_starts(rows, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i))
    stream = [i for r in got for i in r.ids]
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.ids == [*ids_of(library, texts[r.doc_id]), 2] for r in got)
    sums = {r.doc_id: r.ids_crc32 for r in token_files.checksums(rows).collect()}
    assert all(sums[r.doc_id] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    cut = token_files.token_range(spark, path, 5, 60).orderBy("start").collect()
    assert [i for r in cut for i in r.ids] == stream[5:60]
    assert {r.doc_id for r in token_files.read_tokens(spark, path, 4, 10).collect()} == {4, 5, 10}


def test_token_files_of_an_empty_table(spark, no_docs):
    path = shared_path(spark, "test")
    token_files.write_tokens(no_docs, path, PATH)
    assert token_files.with_starts(token_files.read_tokens(spark, path), path).count() == 0


def test_other_tokenizers_encode_whole_texts(library):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    assert not encoder.by_word
    texts = ["Hello there", "", "One  Two"]
    ids, counts = encoder.encode(*A.utf8(pa.array(texts)))
    plain = tokenizers.Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


PAGES = [
    (1, "http://a.org/1", "x" * 200),
    (2, "http://a.org/2", "x" * 200),
    (3, None, None),
    (4, "http://a.org/\r\n4", "short"),
    (5, "http://a.org/5", "short"),
    (6, "http://a.org/6", "tricky \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n inside" * 5),
    (7, "http://a.org/7", "é" * 60),
    (7, "http://a.org/7", "é" * 60),
    (None, "http://a.org/8", "x" * 200),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, headers string")
    path = shared_path(spark, "test")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    assert records.count() == 3 * len(PAGES) and records.where("truncated").isEmpty()
    captures = warc.assemble(records)
    payloads = {r.record_id: bytes(r.payload).decode() for r in captures.collect()}
    for page_id, _, html in PAGES:
        own = [v for k, v in payloads.items() if k.startswith(f"urn:page:{page_id}:".replace("None", "none"))]
        assert own and all(v == (html or "") or (page_id in (2, None) and v == "") for v in own)
    got = warc.page_captures(captures).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted(
        [("1", "response", None), ("2", "revisit", 1), ("3", "response", None), ("4", "response", None), ("5", "response", None)]
        + [("6", "response", None), ("7", "response", None), ("7", "response", None), ("None", "revisit", 1)]
    )
    assert all(r.payload_bytes == 200 for r in got if r.record_type == "revisit")
    assert all((r.n_requests, r.n_metadata) == (1, 1) for r in got)


def test_assembly_follows_links_in_both_directions_and_over_records(spark):
    rows = [("r", "response", ["q"]), ("q", "request", []), ("m", "metadata", ["q"]), ("lost", "metadata", ["gone"]), ("s", "response", []), (None, "metadata", ["s"])]
    blank = spark.createDataFrame([(i, k, c) for i, k, c in rows], "record_id string, record_type string, concurrent_to array<string>")
    full = spark.createDataFrame([], warc.RECORDS).unionByName(blank, allowMissingColumns=True)
    got = {r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(full).collect()}
    assert got == {"r": (["q"], ["m"]), "s": ([], [])}


def test_assembly_follows_chains_of_any_length(spark):
    rows = [("r", "response", []), *[(f"m{k}", "metadata", [f"m{k - 1}" if k else "r"]) for k in range(7)], ("x", "metadata", ["y"]), ("y", "request", ["x"])]
    blank = spark.createDataFrame([(i, k, c) for i, k, c in rows], "record_id string, record_type string, concurrent_to array<string>")
    full = spark.createDataFrame([], warc.RECORDS).unionByName(blank, allowMissingColumns=True)
    (got,) = warc.assemble(full).collect()
    assert [x.record_id for x in got.metadata] == [f"m{k}" for k in range(7)] and not got.requests


def test_damaged_records():
    record, missing, _ = warc.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc")
    assert record["payload"] == b"abc" and missing == 7
    record, missing, _ = warc.parse_record(b"no headers at all")
    assert record["record_type"] is None and missing <= 0


def test_records_that_the_line_reader_leaves_together():
    one = lambda i: b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: 4\r\n\r\n\r\n\r\n" % i
    stream = b"\r\n\r\n".join(one(i) for i in range(6)) + b"\r\n\r\n"
    for kept in ([], [2], [2, 3], [1, 5]):  # separators that were not seen
        cut = stream.split(warc.SEPARATOR)
        pieces = [cut[0]]
        for i, piece in enumerate(cut[1:], 1):
            if i in kept:
                pieces[-1] += warc.SEPARATOR + piece
            else:
                pieces.append(piece)
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array(pieces, pa.binary()), pa.array([False] * len(pieces))], names=["path", "value", "split"])
        got = [r for b in warc._parse(iter([batch])) for r in b.to_pylist()]
        assert [r["record_id"] for r in got] == [str(i) for i in range(6)] and not any(r["truncated"] for r in got)


def test_empty_archive(spark):
    path = shared_path(spark, "test")
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.page_captures(warc.assemble(warc.read_archive(spark, path))).count() == 0


def test_row_groups_and_pages_are_bounded(spark, odd_docs):
    import glob

    import pyarrow.parquet as pq

    path = shared_path(spark, "test")
    token_files.write_tokens(odd_docs.select("doc_id", F.lit("many words " * 500).alias("text")), path, PATH, page_rows=2)
    file = next(f for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    column = {pq.ParquetFile(file).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5)}
    assert column["doc_id"].has_offset_index and column["ids.list.element"].has_offset_index
    assert "DELTA_BINARY_PACKED" in column["at"].encodings and "RLE_DICTIONARY" in column["ids.list.element"].encodings
