"""Vectors written as text against DuckDB, on entries whose thousandfold lies at one half."""

from __future__ import annotations

import duckdb

from chronoseal.plans import load_all
from tools.check import normal


def test_entries_at_one_half_match_sql(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS vec_id, [CAST(range / 2000.0 + 0.0005 AS FLOAT), CAST(-range / 1000.0 - 0.0005 AS FLOAT)] AS embedding FROM range(2000)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    query = load_all()["vector_texts"]
    df = query.run(spark, str(tmp_path))
    result = con.execute(query.sql)
    columns = [d[0] for d in result.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, result.fetchall())
