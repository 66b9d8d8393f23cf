from __future__ import annotations

from pyspark.sql import functions as F

from chronoseal.functions import labels as L
from chronoseal.sources import quarantine as Q
from chronoseal.sources import readers as R
from chronoseal.sources import writers as WR

from .conftest import rows


def test_bad_rows_keep_their_record_and_all_reasons(spark):
    raw = spark.createDataFrame(
        [("a", "yes", "1", "0.5", "m"), ("b", "maybe", "x", "", None), ("c", "no", "2", "Infinity", "m"), ("d", "no", "2", "1e-3", "m")],
        "user_id string, label string, fold string, score string, model_id string",
    )
    got = Q.quarantine_rows(raw, Q.score_contract())
    assert rows(got.accepted) == [("a", "diagnosed", 1, 0.5, "m"), ("d", "control", 2, 0.001, "m")]
    assert got.accepted.schema["fold"].dataType.simpleString() == "int"
    by_user = {r["u"]: sorted(r["reasons"]) for r in got.rejected.select(F.get_json_object("record", "$.user_id").alias("u"), "reasons").collect()}
    assert by_user == {"b": ["invalid fold", "invalid label", "missing model_id", "missing score"], "c": ["invalid score"]}
    assert (got.counts["rows"], got.counts["rejected"], got.counts["invalid score"], got.counts["missing user_id"]) == (4, 2, 1, 0)


def test_optional_columns_and_flags(spark):
    raw = spark.createDataFrame([("a", "", "true"), ("b", "0.5", "True"), ("c", "z", "false")], "user_id string, score string, flag string")
    contract = Q.Contract({"user_id": "string", "score": "double", "flag": "boolean"}, optional=("score",), labels={"flag": L.parse_boolean("flag")})
    got = Q.quarantine_rows(raw, contract)
    assert [tuple(r) for r in got.accepted.collect()] == [("a", None, True)]
    assert rows(got.rejected.select(F.array_join("reasons", ";"))) == [("invalid flag",), ("invalid score",)]


def test_empty_tables(spark):
    raw = spark.createDataFrame([], "user_id string, score string, model_id string")
    got = Q.quarantine_rows(raw, Q.score_contract(R.TEST))
    assert got.accepted.count() == got.rejected.count() == got.counts["rows"] == got.counts["rejected"] == 0


def test_json_lines_that_are_cut_off_or_lack_fields(spark):
    lines = ['{"user_id":"a","n":1}', "", "  ", '{"user_id":"b"', '{"n":2}', "[1]", '{"user_id":"c","n":"x"}', '{"user_id":"d","n":3,"more":true}']
    got = Q.quarantine_json(spark.createDataFrame([(v,) for v in lines], "value string"), "user_id string, n int", ["user_id", "n"])
    assert rows(got.accepted) == [("a", 1), ("d", 3)]
    assert got.counts["rows"] == 6 and got.counts["rejected"] == 4
    assert rows(got.rejected.where(F.array_contains("reasons", "missing user_id")), "record") == [('{"n":2}',)]


def test_csv_keeps_blanks_at_the_ends_of_cells(spark, tmp_path):
    df = spark.createDataFrame([(" a", "b \n"), ("\tc", 'd "')], "x string, y string")
    WR.write_csv(df, str(tmp_path / "o"), ["x", "y"])
    assert rows(R.read_csv(spark, str(tmp_path / "o"), ["x", "y"])) == sorted([(" a", "b \n"), ("\tc", 'd "')])
