"""Digests of files that are read in splits."""

from __future__ import annotations

import os

from chronoseal.operators import artifacts as AR


def digests(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return {r["name"]: (r["size"], r["digest"]) for r in AR.split_digests(spark, str(folder), "*.parquet").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_digest_depends_on_bytes_not_on_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(AR, "FAN", 16)
    data = os.urandom(300_000) + b"\r\n\n\xff\n"
    swapped = data.split(b"\n")
    swapped[3], swapped[4] = swapped[4], swapped[3]
    files = {"a": data, "same": data, "swapped": b"\n".join(swapped), "flipped": data[:9] + bytes([data[9] ^ 1]) + data[10:], "feed": b"\n", "one": b"x"}
    for name, content in files.items():
        (tmp_path / f"{name}.parquet").write_bytes(content)
    whole, split = digests(spark, tmp_path, "64m"), digests(spark, tmp_path, "20k")
    assert whole == split
    assert {n: s for n, (s, _) in whole.items()} == {f"{n}.parquet": len(c) for n, c in files.items()}
    assert whole["a.parquet"] == whole["same.parquet"]
    assert len(set(whole.values())) == len(files) - 1


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.parquet").write_bytes(os.urandom(1_000_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert AR.split_digests(spark, str(tmp_path), "*.parquet").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
