"""WARC archives: writing, reading, and assembly of captures from their records.

Archives are written and read by Spark's text source: a record is a row, and the blank lines after a record are the line
separator. Files are gzip streams, read by one task each from front to back, one record in memory at a time;
files of concatenated gzip members (the usual form) read the same way. A record whose block holds the separator
is put together again by its Content-Length.

A capture is a response, revisit or resource record. Request and metadata records belong to the capture that they
name in WARC-Concurrent-To, directly or through another record, or that names them. Only record ids take part in that
resolution; each record then joins its capture once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import stored

CRLF = "\r\n"
SEPARATOR = b"\r\n\r\nWARC/1."
#: Fixed value: the profile of revisit records for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
BATCH_BYTES = 4 << 20
RECORDS = (
    "path string, record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, digest string, headers map<string,string>, http_headers map<string,string>, truncated boolean, payload binary"
)


def page_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) with ``digest``, ``bytes``, ``key`` (identity of the row) and ``refers_to``.

    Of rows with equal payloads of at least ``min_bytes`` bytes all but those of the smallest id refer to that one.
    Null html is an empty payload. Rows with a null id refer to the smallest id, if there is one.
    """
    payload = F.coalesce("html", F.lit(""))
    key = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("url", "html")))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"), key.alias("key"))
    narrow = rows.where(F.col("bytes") >= min_bytes).where(F.col("page_id").isNotNull()).select("digest", "bytes", "page_id", "key")
    # The rows are counted where they are; a payload of a third of all pages is one row per task.
    first = narrow.groupBy("digest", "bytes").agg(F.min(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n"))
    shared = stored(first.where("n > 1").select("digest", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key")), "payloads")
    joined = rows.join(shared, ["digest", "bytes"], "left")
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(repeats, F.col("first_key"))).drop("first_id", "first_key")


def _record(kind: str, identity: Column, block: Column, *headers: Column) -> Column:
    fields = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), identity, F.lit(">")), *headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, *fields, length), F.lit(CRLF * 2), block)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 100) -> None:
    """Write each page as request, response (or revisit) and metadata records to gzip files below ``path``."""
    rows = page_records(pages, min_bytes)
    url = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")  # null: no such header
    target, when = F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {date}")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    kind = F.lit("Content-Type: application/http;msgtype=response")
    beside = F.concat(F.lit("WARC-Concurrent-To: <"), F.col("key"), F.lit(">"))
    response = _record("response", F.col("key"), F.concat(http, F.col("payload")), when, target, digest, kind)
    refers = F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">"))
    revisit = _record("revisit", F.col("key"), http, when, target, digest, refers, F.lit(f"WARC-Profile: {PROFILE}"), kind)
    ask = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record("request", F.concat("key", F.lit(":request")), ask, when, target, beside, F.lit("Content-Type: application/http;msgtype=request"))
    note = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", F.concat("key", F.lit(":metadata")), note, when, beside, F.lit("Content-Type: application/warc-fields"))
    capture = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _fields(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:  # a folded header goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_record(raw: bytes) -> tuple[dict, int, bytes]:
    """A record from its bytes, the number of bytes that its block still lacks, and the bytes after it."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    named = dict(reversed(fields))
    stated = named.get("content-length", "")
    length = int(stated) if stated.isascii() and stated.isdigit() else len(body)
    block = body[:length]
    http: dict[str, str] = {}
    if named.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = dict(reversed(_fields(top)))
        http[":first"] = top.split(b"\r\n", 1)[0].decode("utf-8", "replace")
    plain = lambda v: v.strip("<>") if v else None
    record = {
        "record_id": plain(named.get("warc-record-id")), "record_type": named.get("warc-type"), "target_uri": plain(named.get("warc-target-uri")),
        "date": named.get("warc-date"), "concurrent_to": [plain(v) for k, v in fields if k == "warc-concurrent-to"],
        "refers_to": plain(named.get("warc-refers-to")), "digest": named.get("warc-payload-digest"),
        "headers": list(named.items()), "http_headers": list(http.items()), "payload": block,
    }
    return record, length - len(body), body[length:]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema(
        [
            *((n, pa.string()) for n in ("path", "record_id", "record_type", "target_uri", "date")),
            ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest", pa.string()),
            ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())),
            ("truncated", pa.bool_()), ("payload", pa.binary()),
        ]
    )
    out, size, path, open_ = [], 0, None, b""

    def take(raw: bytes, ended: bool) -> bytes:
        """Emit the complete records of ``raw``; returns one that goes on, unless the file has ended."""
        nonlocal size
        while raw.strip():
            record, missing, rest = parse_record(raw)
            if missing > 0 and not ended:
                return raw
            out.append(record | {"path": path, "truncated": missing > 0})
            size += len(raw) - len(rest)
            # The line reader may miss a separator, so what follows a record can be the next one.
            raw = rest.lstrip(b"\r\n")
            raw = raw if raw.startswith(b"WARC/") else b""
        return b""

    for batch in batches:
        for k in range(len(batch)):
            here, piece = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if batch.column(2)[k].as_py():
                raise ValueError(f"{here} was split; archives are read whole, so compress them with gzip")
            if here != path:
                take(open_, True)
                path, open_ = here, take(piece, False)
            else:  # the separator stood before a record, or inside the block of one that goes on
                open_ = take(open_ + SEPARATOR + piece if open_ else SEPARATOR[4:] + piece, False)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out, size = [], 0
    take(open_, True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=types)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``. A record cut short by the end of its file has ``truncated`` set; a record
    without Content-Length ends at the next record; one without headers has null fields. No files: no rows."""
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    split = F.col("_metadata.file_block_start") > 0
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"), split.alias("split"))
    return rows.mapInArrow(_parse, RECORDS)


def owners(records: DataFrame) -> DataFrame:
    """Capture of each record: ``record_id, capture_id``. Links count in both directions, any number of them in a row.

    A record takes the capture that the fewest links lead to, of several the smallest id. Each round follows one link more
    and ends the search if it reaches no new record.
    """
    ids = stored(records.where(F.col("record_id").isNotNull()).select("record_id", "record_type", "concurrent_to"), "records")
    owned = ids.where(F.col("record_type").isin(*CAPTURES)).select("record_id", F.col("record_id").alias("capture_id")).distinct()
    named = ids.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rest = ids.where(~F.col("record_type").isin(*CAPTURES)).select(F.col("record_id").alias("a")).distinct()
    links = stored(links.join(rest, "a", "left_semi"), "links")
    reached = owned
    while True:
        reached = links.join(reached, links["b"] == reached["record_id"]).groupBy("a").agg(F.min("capture_id").alias("capture_id"))
        reached = stored(reached.select(F.col("a").alias("record_id"), "capture_id").join(owned, "record_id", "left_anti"), "owners")
        if reached.isEmpty():
            return owned
        owned = owned.unionByName(reached)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its own fields, and the ``requests`` and ``metadata`` records that belong to it.

    Captures without companions have empty lists; companions without a capture are left out. A record that repeats counts
    once as a companion, while a capture that repeats keeps its rows. Lists are ordered by record id.
    """
    captures = records.where(F.col("record_type").isin(*CAPTURES))
    others = records.where(~F.col("record_type").isin(*CAPTURES)).join(owners(records), "record_id")
    companion = F.struct("record_id", "headers", "http_headers", "payload")

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, companion)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))

    single = others.dropDuplicates(["record_id"])
    groups = single.groupBy(F.col("capture_id").alias("__capture")).agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    joined = captures.join(groups, captures["record_id"] == groups["__capture"], "left").drop("__capture")
    none = F.array().cast(joined.schema["requests"].dataType)
    return joined.withColumn("requests", F.coalesce("requests", none)).withColumn("metadata", F.coalesce("metadata", none))


def page_captures(captures: DataFrame) -> DataFrame:
    """Captures of written pages: ``page_id, payload_bytes, payload_digest, record_type, refers_to``; of the full payload."""
    number = lambda c: F.when(F.regexp_extract(c, "^urn:page:(-?[0-9]+):", 1) != "", F.regexp_extract(c, "^urn:page:(-?[0-9]+):", 1).cast("bigint"))
    revisit = F.col("record_type") == "revisit"
    return captures.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_headers")["content-length"].cast("bigint")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
        F.size("requests").cast("bigint").alias("n_requests"),
        F.size("metadata").cast("bigint").alias("n_metadata"),
    )


#: DuckDB SQL of the captures of all pages.
SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to, 1 AS n_requests, 1 AS n_metadata FROM q LEFT JOIN f USING (payload_digest)"""
