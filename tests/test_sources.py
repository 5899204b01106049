import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpus_spark.plans import corpus
from corpus_spark.sources import comments, tables
from corpus_spark.streaming.rollup import documents_stream


def test_comment_csv(spark, tmp_path):
    plain = tmp_path / "telegram.csv"
    plain.write_text('datetime,author,group,comment\n13.10.2020 15:59:22 UTC+07:00,a,g,"hello, you"\n', encoding="utf-8")
    broken = tmp_path / "youtube_x.csv"
    broken.write_text('datetime,author,group,comment\n"2020-10-13,a,g,""one, two"", three"\n\nshort,line\n2020-10-14,b,g,x,y\n', encoding="utf-8")
    got = comments.read_comments(spark, [{"path": str(plain), "source": "telegram"}, {"path": str(broken), "source": ""}]).orderBy("source", "datetime").collect()
    assert [(r["source"], r["comment"]) for r in got] == [("telegram", "hello, you"), ("youtube", "one, two, three"), ("youtube", "x,y")]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        comments.read_plain(spark, str(bad))


def test_tables(spark, tmp_path):
    spark.range(5).select("id", F.lit("t").alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = tables.with_lineage(spark, str(tmp_path / "t")).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == [0, 1, 2, 3, 4] and rows[0]["source_file"].endswith(".parquet")
    for name in ("c1.csv", "c2.csv"):
        (tmp_path / name).write_text('k,text\n' + "".join(f'{k},"two\nlines"\n' for k in range(4)))
    rows = tables.with_lineage(spark, str(tmp_path / "*.csv")).collect()
    assert sorted((r["source_file"], r["row_index"], r["k"]) for r in rows) == [(n, k, str(k)) for n in ("c1.csv", "c2.csv") for k in range(4)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("some words")
    (tmp_path / "a/y.md").write_text("  ")
    art = tables.articles(spark, str(tmp_path / "a")).collect()
    assert len(art) == 1 and art[0]["doc_id"].startswith("article_") and len(art[0]["doc_id"]) == 20
    (tmp_path / "m").mkdir()
    (tmp_path / "m/r.json").write_text("﻿" + json.dumps({"experiment": {"id": "e"}, "params": {"n": 3}, "result": {}}), encoding="utf-8")
    m = tables.manifests(spark, str(tmp_path / "m")).first()
    assert m["experiment"]["id"] == "e" and m["params"] == {"n": "3"}
    e = spark.createDataFrame([(json.dumps({"evidence_items": [{"text": "a", "x": {"y": 1}}]}),)], "value string")
    assert tables.evidence_rows(e).first()["item"] == {"text": "a", "x": '{"y":1}'}
    said = spark.createDataFrame([(k, "Hua Hin", ["a"]) for k in range(5)], "id long, toponym string, l array<string>")
    man = tables.export_by_place(said, str(tmp_path / "out"), 3, "id").collect()
    assert [(r["toponym"], r["rows"]) for r in man] == [("Hua Hin", 3)] and (tmp_path / "out/place=Hua_Hin").is_dir()


def test_pipeline_and_stream(spark, tmp_path):
    rows = [(k, f"13.10.2020 {8 + k // 2:02d}:0{k % 6}:00 UTC+00:00", "a", "g" if k % 2 else None, "bangkok visa work", "telegram") for k in range(6)]
    raw = spark.createDataFrame(rows, "row_id long, datetime string, author string, group string, comment string, source string")
    from corpus_spark.operators.lexicon import gazetteer_frame

    docs, out = corpus.corpus_pipeline(raw, {"Bangkok": ("bangkok",)}, gazetteer_frame(spark, {"Bangkok": ("city", "Bangkok")}), "salt")
    assert docs.agg(F.sum("message_count")).first()[0] == 6
    assert {r["theme"]: r["count"] for r in out["driver_distribution"].collect()}["visa/legal"] == docs.count()
    assert out["toponym_frequency"].first()["toponym"] == "Bangkok"

    at = [dt.datetime(2020, 10, 13, 8, 1), dt.datetime(2020, 10, 13, 8, 30), dt.datetime(2020, 10, 15)]
    spark.createDataFrame([(k, t, "g", f"text number {k}", "s") for k, t in enumerate(at)], "row_id long, datetime timestamp, group string, comment string, source string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("row_id long, datetime timestamp, group string, comment string, source string").parquet(str(tmp_path / "in"))
    q = documents_stream(s, "1 hour", "1 hour").writeStream.format("memory").queryName("stream_docs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("stream_docs").collect()
    assert [(r["message_count"], r["text"]) for r in got] == [(2, "text number 0\ntext number 1")]
