"""Row hashes and canonical JSON hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import _col


def row_hash(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by a bar. Plain strings are literals."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def redacted_hash(dataset: str, lane: str, user: Column | str) -> Column:
    """Hash of a test row with the label replaced by -1."""
    return row_hash(dataset, lane, "test", "-1", _col(user))


def json_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object with keys in sorted order."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def hash_order(seed: int | str, *parts: Column | str) -> Column:
    """Deterministic pseudo-random order key: SHA-256 of seed and parts."""
    return row_hash(str(seed), *[_col(p) for p in parts])
