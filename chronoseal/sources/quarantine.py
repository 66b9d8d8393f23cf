"""Text rows to typed rows, with the rows that do not fit set aside.

A reader that stops at the first bad cell is of little use on a large table, and
one that turns bad cells into NULL hides them. Here every row is judged in one
pass: good rows come out typed, bad rows with all their reasons and the record
as it was, and the counts per reason are observed while that pass writes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import numeric as N
from ..session import written
from .readers import OOF

MALFORMED = "malformed record"


@dataclass(frozen=True)
class Contract:
    """Types by column name, columns that may be blank, and how label columns are read (NULL: not a label)."""

    types: Mapping[str, str]
    optional: Sequence[str] = ()
    labels: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Quarantined:
    """``accepted`` is typed; ``rejected`` has ``reasons, record``; ``counts`` has ``rows, rejected`` and one entry per reason."""

    accepted: DataFrame
    rejected: DataFrame
    counts: Mapping[str, int]


def score_contract(types: Mapping[str, str] = OOF) -> Contract:
    """Score tables: every value is required, numbers are finite, labels are known."""
    if "label" not in types:
        return Contract(types)
    label = L.normalize_ternary_label("label") if "prob_diagnosed" in types else L.normalize_label("label", "manifest")
    return Contract(types, labels={"label": label})


def _split(df: DataFrame, typed: Mapping[str, Column], checks: Mapping[str, Column], record: Column) -> Quarantined:
    reasons = F.filter(F.array(*[F.when(c, F.lit(reason)) for reason, c in checks.items()]), lambda r: r.isNotNull())
    marked = df.select(*[c.alias(name) for name, c in typed.items()], reasons.alias("__reasons"), record.alias("__record"))
    # The record is kept only where it is needed.
    bad = F.size("__reasons") > 0
    marked = marked.withColumn("__record", F.when(bad, F.col("__record")))
    seen = Observation()
    tallies = [F.count_if(F.array_contains("__reasons", reason)).alias(reason) for reason in checks]
    stored = written(marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"), *tallies))
    accepted = stored.where(~bad).select(*typed)
    rejected = stored.where(bad).select(F.col("__reasons").alias("reasons"), F.col("__record").alias("record"))
    return Quarantined(accepted, rejected, dict(seen.get))


def quarantine_rows(raw: DataFrame, contract: Contract) -> Quarantined:
    """Rows of text columns (see :func:`.readers.read_csv`) judged by a contract. NULL counts as blank.

    Reasons: ``missing <column>`` for a blank that is not optional; ``invalid <column>`` for text that is no value of
    the type, a number that is not finite, or an unknown label.
    """
    typed: dict[str, Column] = {}
    checks: dict[str, Column] = {}
    for name, kind in contract.types.items():
        blank = F.coalesce(F.col(name), F.lit("")) == ""
        value = contract.labels.get(name, F.nullif(F.col(name), F.lit("")).try_cast(kind))
        if name not in contract.optional:
            checks[f"missing {name}"] = blank
        if kind != "string" or name in contract.labels:
            fits = N.is_finite(value) if kind in ("double", "float") else value.isNotNull()
            checks[f"invalid {name}"] = ~blank & ~F.coalesce(fits, F.lit(False))
        typed[name] = value
    return _split(raw, typed, checks, F.to_json(F.struct(*contract.types)))


def quarantine_json(lines: DataFrame, schema: str, required: Sequence[str], text: str = "value") -> Quarantined:
    """JSON lines to typed rows; blank lines are skipped, a line that is no such object is a ``malformed record``."""
    fields = T.StructType.fromDDL(schema)
    whole = T.StructType([*fields.fields, T.StructField("__corrupt", T.StringType())])
    filled = lines.where(F.trim(F.col(text)) != "")
    parsed = filled.select(text, F.from_json(text, whole, {"columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"}).alias("__o"))
    malformed = F.col("__o.__corrupt").isNotNull() | F.col("__o").isNull()
    checks = {MALFORMED: malformed}
    checks |= {f"missing {name}": ~malformed & F.col(f"__o.{name}").isNull() for name in required}
    return _split(parsed, {f.name: F.col(f"__o.{f.name}") for f in fields}, checks, F.col(text))
