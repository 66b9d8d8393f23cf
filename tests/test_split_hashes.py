"""SHA-256 of files that are read in splits, one after the other."""

from __future__ import annotations

import hashlib
import os

import pytest

from chronoseal.functions.hash_state import RunningSha256
from chronoseal.operators import artifacts as AR


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(AR, "WHOLE_BYTES", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_saved_state_goes_on():
    data = os.urandom(1000)
    for at in (0, 1, 63, 64, 65, 999, 1000):
        half = RunningSha256().update(data[:at])
        assert RunningSha256(half.saved()).update(data[at:]).hexdigest() == hashlib.sha256(data).hexdigest()
        assert half.hexdigest() == hashlib.sha256(data[:at]).hexdigest()


def test_large_files_have_their_plain_hash(spark, tmp_path, small_splits):
    data = os.urandom(150_000)
    files = {
        "random": data,
        "feed at the end": data + b"\n",
        "feeds": b"\n" * 70_000,
        "first feed": b"\n" + data + b"\r\n\n\n",
        "no feed": data.replace(b"\n", b""),
        "one [odd] {name} *": data[::-1],
        "mark": AR.BOM + data + b"\n",
        "mark alone": AR.BOM + b"\xef" * 5000,
        "small": b"x",
        "zeros": bytes(90_000),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.parquet").write_bytes(content)
    (tmp_path / "packed.gz").write_bytes(data)
    got = {r["name"]: (r["size"], r["sha256"]) for r in AR.file_table(spark, str(tmp_path)).collect()}
    assert got == {**{f"{n}.parquet": (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}, "packed.gz": (len(data), hashlib.sha256(data).hexdigest())}


def test_no_task_reads_a_large_file(spark, tmp_path, small_splits):
    (tmp_path / "big.bin").write_bytes(os.urandom(200_000))
    tasks = []
    run = spark.sparkContext.runJob
    try:
        spark.sparkContext.runJob = lambda rdd, f, partitions=None, *a: tasks.append((rdd.getNumPartitions(), partitions)) or run(rdd, f, partitions, *a)
        found = AR.file_table(spark, str(tmp_path))
        assert found.count() == 1
    finally:
        del spark.sparkContext.runJob
    rounds = [p for n, p in tasks if p is not None and n >= 10]
    assert rounds == [[k] for k in range(len(rounds))] and len(rounds) >= 10
    # The length alone is a condition that the source takes, so that it does not open the file.
    assert "LessThanOrEqual(length,1000)" in found._jdf.queryExecution().executedPlan().toString()
