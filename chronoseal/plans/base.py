"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    covers: tuple[str, ...]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a function under its own name; ``covers`` lists survey ids, ``sql`` is the DuckDB twin."""

    def register(run: Runner) -> Runner:
        REGISTRY[run.__name__] = Query(run.__name__, run, tuple(covers.split()), sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
