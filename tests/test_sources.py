from __future__ import annotations

import codecs
import json

import pytest
from pyspark.sql import functions as F

from chronoseal.operators import artifacts as AR
from chronoseal.sources import readers as R
from chronoseal.sources import writers as WR

from .conftest import rows


def test_csv_quotes_newlines_blank_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n"x,y","quote "" ok"\r\n"two\nlines",1\r\n,\r\nshort\r\n')
    got = rows(R.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]))
    assert got == sorted([("x,y", 'quote " ok'), ("two\nlines", "1"), ("short", "")])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x,y", 'quote " ok'), ("plain", None)], "a string, b string")
    WR.write_csv(df, str(tmp_path / "o"), ["a", "b"], ["a"], single=True)
    assert rows(R.read_csv(spark, str(tmp_path / "o"), ["a", "b"])) == [("plain", ""), ("x,y", 'quote " ok')]


def test_delimited_timelines(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(codecs.BOM_UTF8 + "User_ID;Diagnosed_YN;Text\n12.0;yes;a #  # b\n7;No;só um\n".encode())
    posts = R.read_delimited(spark, [str(tmp_path / "t.csv")])
    assert rows(posts, "user_id", "label", "tweet_index", "tweet_text") == [("12", "diagnosed", 0, "a"), ("12", "diagnosed", 1, ""), ("12", "diagnosed", 2, "b"), ("7", "control", 0, "só um")]


def test_label_findings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("User_ID;Diagnosed_YN;Text\n1;yes;a\n1;no;b\n2;maybe;c\n")
    users = R.read_labels(spark, [str(tmp_path / "t.csv")])
    assert rows(R.label_findings(users), "code", "detail") == [("duplicate-user", "1"), ("unknown-label", "2")]


def test_posts_are_partitioned_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i % 5}", i, f"t{i}", i % 9, [float(i)], "train" if i % 5 else "test") for i in range(40)], "user_id string, tweet_index int, tweet_text string, gpt5_relevance smallint, embedding array<float>, split string")
    path = str(tmp_path / "posts")
    WR.write_posts(df, path, files=3)
    posts = R.read_posts(spark, path)
    assert posts.columns == ["user_id", "tweet_index", "tweet_text", "gpt5_relevance"] and posts.count() == 40
    wanted = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    picked = R.read_posts_of(spark, path, wanted, ["user_id", "tweet_index"])
    assert picked.count() == 16
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "embedding" not in plan


def test_scores_and_manifests(spark, tmp_path):
    oof = spark.createDataFrame([("b", "diagnosed", 1, 0.123456789, "m"), ("a", "control", 2, 1.0, "m")], "user_id string, label string, fold int, score double, model_id string")
    WR.write_scores(oof, str(tmp_path / "oof"), True, single=True)
    text = next((tmp_path / "oof").glob("*.csv")).read_text()
    assert text == "user_id,label,fold,score,model_id\na,control,2,1.00000000,m\nb,diagnosed,1,0.12345679,m\n"
    assert rows(R.read_scores(spark, str(tmp_path / "oof"))) == [("a", "control", 2, 1.0, "m"), ("b", "diagnosed", 1, 0.12345679, "m")]
    WR.write_scores(oof, str(tmp_path / "test"), False, digits=10)
    assert R.read_scores(spark, str(tmp_path / "test"), R.TEST).columns == ["user_id", "score", "model_id"]
    man = spark.createDataFrame([("d", "train", "control", "a", "h", 1), ("d", "test", "-1", "b", "h2", None)], "dataset string, split string, label string, user_id string, row_hash string, fold int")
    WR.write_manifest(man, str(tmp_path / "man"))
    assert rows(R.read_manifest(spark, str(tmp_path / "man")), "user_id", "label", F.coalesce("fold", F.lit(-1))) == [("a", "control", 1), ("b", "-1", -1)]


def test_markers_recompute_a_blank_score(spark, tmp_path):
    head = "user_id,total_tweets,max_relevance,rel3_count,rel5_count,rel6_count,rel7_count,rel3_ratio,rel5_ratio,rel6_ratio,rel7_ratio,top10_avg_relevance,evidence_score"
    (tmp_path / "m.csv").write_text(f"{head}\na,10,7,5,4,3,2,0.5,0.4,0.3,0.2,7,\nb,10,7,5,4,3,2,0.5,0.4,0.3,0.2,7,0.25\n")
    markers = R.read_markers(spark, str(tmp_path / "m.csv"))
    assert dict(rows(markers, "user_id", "evidence_score")) == {"a": pytest.approx(1.0), "b": 0.25}
    WR.write_markers(markers, str(tmp_path / "out"), single=True)
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines()[2].endswith(",7,0.25000000")


def test_required_values(spark):
    raw = spark.createDataFrame([("a", "", "0.5"), ("b", "m", "x")], "user_id string, model_id string, score string")
    got = rows(R.required_findings(raw, None, ["user_id", "model_id", "score"], numeric=["score"]), "detail")
    assert got == [("a: missing model_id",), ("b: invalid score",)]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("u", "test", 1, [(3, "é", 8)])], R.PACKS)
    WR.write_jsonl(df, str(tmp_path / "packs"))
    line = "".join(p.read_text() for p in (tmp_path / "packs").glob("*.txt")).strip()
    assert line == json.dumps(json.loads(line), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    with open(tmp_path / "extra.json", "w") as f:
        f.write("\n" + line + "\n\n")
    assert R.read_jsonl(spark, str(tmp_path / "extra.json")).first()["selected_tweets"][0]["tweet_text"] == "é"


def test_reports_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "n int, f1 double")
    for _ in range(2):
        WR.write_report(df, str(tmp_path / "r"))
    assert spark.read.schema("n int, f1 double").json(str(tmp_path / "r")).count() == 1
    WR.write_table(df, str(tmp_path / "t"), ["n"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "train_oof_a.csv").write_text("user_id,label,fold,score,model_id\nu,yes,1,0.5,a\n")
    (tmp_path / "other.csv").write_text("x\n")
    files = {r["name"]: r for r in AR.file_table(spark, str(tmp_path), "*.csv").collect()}
    assert files["other.csv"]["sha256"] == hashlib.sha256(b"x\n").hexdigest() and files["other.csv"]["size"] == 2
    assert rows(AR.list_files(spark, str(tmp_path), "train_oof_", ".csv"), "name") == [("train_oof_a.csv",)]
    found = R.read_files(spark, str(tmp_path), R.OOF, "train_oof_")
    assert rows(found, "user_id", "score", "file_name") == [("u", 0.5, "train_oof_a.csv")]
    names = spark.createDataFrame([("part-000010-000020.parquet",), ("x.parquet",)], "n string")
    assert [tuple(r) for r in names.select(*AR.shard_range("n")).collect()] == [(10, 20), (None, None)]


def test_decision_sheet(spark, tmp_path):
    from chronoseal.operators.overrides import TEST_SHEET

    (tmp_path / "d.csv").write_text(",".join(TEST_SHEET) + "\nu,diagnosed,false,0.9000,why,p,r,true,m,m,pol,lock\n")
    d = R.read_decisions(spark, str(tmp_path / "d.csv")).first()
    assert d["llm_true_depression"] is False and d["cache_hit"] is True and d["llm_confidence"] == 0.9


def test_numeric_and_vector_tables(spark):
    df = spark.createDataFrame([("u", None, -3.0, "[1,2]")], "user_id string, a double, b double, embedding string")
    assert rows(R.numeric_table(df, ["a", "b"], ["b"])) == [("u", 0.0, 0.0)]
    assert R.vector_table(df).first()["embedding"] == [1.0, 2.0]
