"""Features for large inputs: samples by thresholds, windows in pieces, stored indexes."""

import datetime as dt
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpus_spark.operators import retrieval, sampling, vector_index, windows
from corpus_spark.plans import bindings as Z
from corpus_spark.sources import scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (i is not None, hashlib.md5(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", i if i is not None else 0))


@pytest.mark.parametrize("n", [0, 1, 37, 4999, 5001, 6000])
def test_simple_samples_by_threshold(spark, n):
    ids = [*range(5000), None]
    df = spark.createDataFrame([(i, "t") for i in ids], "id long, text string")
    got = sampling.simple(df, n, 9, "id")
    assert {r["id"] for r in got.collect()} == set(by_hash(ids, 9)[:n])
    assert "TakeOrdered" not in plan(got) and "SinglePartition" not in plan(got) and "Exchange" not in plan(got)


def test_repeated_ids_at_the_edge(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(30)], "id long")
    for n in (5, 10, 25, 30):
        assert sampling.simple(df, n, 1, "id").count() == n


@pytest.mark.parametrize("n", [2, 40, 500, 5000])
def test_quotas_by_threshold(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "_DIGITS", 1)  # classes of many rows, so that edges are ranked
    rows = [(k, "hot" if k % 10 else None if k % 20 else "rare") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string")
    groups = {g: by_hash([i for i, x in rows if x == g], 4) for g in ("hot", "rare", None)}
    quota = max(1, n // 3)
    taken = [i for g in groups.values() for i in g[:quota]]
    rest = by_hash([i for i, _ in rows if i not in set(taken)], 4)
    want = set((taken + rest)[:n]) if len(taken) < n else set(by_hash(taken, 4)[:n])
    got = sampling.equal_quota(df, ["g"], n, 4, "id")
    assert {r["id"] for r in got.collect()} == want
    assert "TakeOrdered" not in plan(got) and "SinglePartition" not in plan(got)
    one = [g[0] for g in groups.values()]
    rest = by_hash([i for i, _ in rows if i not in set(one)], 4)
    want = set((one + rest)[:n]) if len(one) < n else set(by_hash(one, 4)[:n])
    assert {r["id"] for r in sampling.strata(df, n, 4, "id", ["g"]).collect()} == want


def test_window_pieces(spark):
    t0 = dt.datetime(2024, 1, 1)
    hot = [("hot", t0 + dt.timedelta(milliseconds=k // 3), f"message {k} " + "x" * (k % 7), k) for k in range(3000)]
    rows = [*hot, ("calm", t0, "b", 2), ("calm", t0, "a", 1), ("calm", t0 + dt.timedelta(hours=2), None, 3)]
    m = spark.createDataFrame([(g, "s", t, x, k) for g, t, x, k in rows], "`group` string, source string, datetime timestamp, clean_text string, row_id long").repartition(6)
    want = {(r["group"], r["window_start"]): r["text"] for r in windows.roll_up(m).collect()}
    got = windows.roll_up_pieces(m, most=500).collect()
    pieces = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        pieces.setdefault((r["group"], r["window_start"]), []).append(r)
    assert {k: "\n".join(r["text"] for r in v) for k, v in pieces.items()} == want
    assert len(pieces["hot", t0]) > 60 and max(len(r["text"]) for r in got) <= 500 + 20
    assert sum(r["message_count"] for r in got) == len(rows)
    assert [len(v) for k, v in pieces.items() if k[0] == "calm"] == [1, 1]
    whole = windows.roll_up_pieces(m)
    assert {(r["group"], r["window_start"]): r["text"] for r in whole.collect()} == want


@pytest.mark.parametrize(("most", "span"), [(500, 1), (500, 3000), (40, 900), (500, 8 << 20)])
def test_pieces_are_cut_without_texts(spark, monkeypatch, most, span):
    """Ties, copies of a message, nulls and messages longer than a piece, in windows over several ranges; texts move once."""
    tables, t0, rnd = {}, dt.datetime(2024, 1, 1), random.Random(5)
    monkeypatch.setattr(windows, "written", lambda df, name: tables.setdefault(name, scratch.written(df, name)))
    say = lambda k: None if k % 11 == 0 else "" if k % 13 == 0 else f"{k} " + "x" * rnd.choice([1, 5, 30, 700 if k % 50 == 0 else 2])
    rows = [(g, t0 + dt.timedelta(seconds=k // 4), say(k), None if k % 97 == 0 else k) for g, n in (("hot", 2000), ("warm", 300), ("calm", 3), ("exact", 2)) for k in range(1, n)]
    rows += [("hot", t0 + dt.timedelta(seconds=100), "the same words", 77)] * 120 + [("edge", t0, "y" * (most - 1), 1), ("edge", t0, None, 2), ("edge", t0, None, 3)]
    m = spark.createDataFrame([(g, "s", t, x, k) for g, t, x, k in rows], "`group` string, source string, datetime timestamp, clean_text string, row_id long").repartition(6)
    want = {}
    key = lambda r: (r[0], r[1], r[3] is not None, r[3] or 0, r[2] is not None, r[2] or "")
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=key)
        size = lambda r: 0 if r[2] is None else len(r[2]) + 1
        whole, upto = sum(map(size, own)), 0
        for r in own:
            want.setdefault((g, upto // most if whole > most else 0), []).append(r)
            upto += size(r)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.roll_up_pieces(m, most=most, span=span)
        assert plan(got).count("Exchange hashpartitioning") == 1
        found = {(r["group"], r["piece"]): (r["text"], r["message_count"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert found == {k: ("\n".join(r[2] for r in v if r[2] is not None), len(v)) for k, v in want.items()}
    assert not any("text" in df.columns for df in tables.values())
    cuts = tables["cuts"].groupBy("group").count().collect()
    assert tables["hot-lengths"].select("range").distinct().count() > 1 if span < 5000 else not cuts
    assert span > 5000 or {r["group"]: r["count"] for r in cuts}["hot"] > 5


def test_lengths_move_without_texts(spark, tmp_path):
    """Clean text and its length are made below the join with events, and the join for lengths has no texts."""
    rows = [(k, None if k == 5 else f"a  text {k} http://x.y/z", "s") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, dt.datetime(2024, 1, 1), "g") for k in range(30)], "event_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Z.cleaned(spark, str(tmp_path))
        said = plan(got.select("row_id", "group", "source", "datetime", "chars"))
        found = {r["row_id"]: (r["clean_text"], r["chars"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == {k: (x, len(x)) for k, x in ((k, "" if k == 5 else f"a text {k}") for k in range(30))}
    assert "SortMergeJoin" in said and re.search(r"Exchange hashpartitioning\(doc_id.*\n.*Project \[doc_id#\d+L, source#\d+, length\(", said)


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8))
    x = [(int(k), (centres[k % 40] + 0.05 * rng.standard_normal(8)).tolist()) for k in range(2000)] + [(2000, [0.0] * 8), (2001, None), (2002, (centres[0] * 3).tolist()), (2003, (centres[0] * 3).tolist())]
    df = spark.createDataFrame(x, "id long, embedding array<double>")
    folder = str(tmp_path / "index")
    vector_index.write_index(df, folder, "id", cells=40, sample=500)
    q = spark.createDataFrame([(100, centres[0].tolist()), (101, (centres[3] + 0.01).tolist())], "query_id long, embedding array<double>")
    read = []
    got = vector_index.search(spark, folder, q, 7, "id", read=read)
    want = retrieval.nearest(df, q, 7, "id", ["id"])
    key = lambda r: (r["query_id"], r["rank"], r["id"], round(r["score"], 12))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    files = lambda d: d.select(F.input_file_name().alias("f")).distinct().count()
    every = files(spark.read.parquet(f"{folder}/rows"))
    assert files(vector_index.read_rows(spark, folder, read[0])) < every / 4
    # queries over all of the space, many of them in rounds: still exact
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got, want = vector_index.search(spark, folder, q, 5, "id", most=30), retrieval.nearest(df, q, 5, "id", ["id"])
    pick = lambda d: {(r["query_id"], r["rank"], r["id"]) for r in d.filter("query_id <> 2000").collect()}
    assert pick(got) == pick(want)
    assert vector_index.search(spark, folder, q.limit(0), 5, "id").count() == 0


@pytest.mark.parametrize("name", ["c4_places_of_table", "c4_places_joined"])
def test_places_sql_sees_occurrences_that_overlap(spark, tmp_path, name):
    """The first 'de de' touches a word, the one that begins inside it doesn't."""
    texts = ["xde de de", "de de de", "xde dex", "a-b c,", "xa-b c", "(a-b cd", "-a b c", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "de de"), (2, "a-b c"), (3, "-a b c-")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted((i, list(x)) for i, x in db.sql(entry.oracle_sql()[name]).fetchall())
    got = sorted((r["doc_id"], r["toponyms"]) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == want
    assert dict(want)[0] == ["item 1"] and dict(want)[2] == []


def test_lineage_of_a_table_of_several_files(spark, tmp_path):
    """The given table lies in three files, in no order."""
    rows = spark.createDataFrame([(7 * k % 4999, f"s{k % 3}") for k in range(4999)], "doc_id long, source string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "folder", "file_fits", "row_index", "source"]
    want = sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['io4_lineage']})").fetchall())
    assert sorted(tuple(r) for r in entry.queries()["io4_lineage"](spark, str(tmp_path)).select(columns).collect()) == want
    assert want[2000] == (2000, "file=1", True, 0, "s" + str([k for k in range(4999) if 7 * k % 4999 == 2000][0] % 3))


def test_manifests_are_not_moved_one_by_one(spark, tmp_path, monkeypatch):
    """Files of one run and of many lie in one folder, and each is opened once."""
    from corpus_spark.plans import queries_io

    seen = []
    monkeypatch.setattr(queries_io, "fresh_path", lambda _, name: seen.append(f"{tmp_path}/{name}") or seen[-1])
    spark.createDataFrame([(k, f"S{k}", k % 5) for k in range(300)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["io12_manifests"](spark, str(tmp_path))
    assert sorted((r["experiment"], r["best"]) for r in got.collect()) == sorted((f"e{k}", None if k % 2 else f"S{k}") for k in range(300))
    assert "Text" not in plan(got)
    assert len(list((tmp_path / "manifests").glob("*.txt"))) == 6


def test_scores_of_many_queries_are_held_in_turns(monkeypatch):
    """No more scores at once than the bound, and the turns give what one turn gives."""
    import pandas as pd

    x = np.random.default_rng(5).integers(-9, 9, (600, 8)).astype(float)
    rows, ids, sizes, before = pd.DataFrame({"id": range(600)}), np.arange(1000), [], retrieval._best_of
    q = np.random.default_rng(6).integers(-9, 9, (1000, 8)).astype(float)
    monkeypatch.setattr(retrieval, "MOST_SCORES", 60_000)
    monkeypatch.setattr(retrieval, "_best_of", lambda rows, scores, *more: sizes.append(scores.size) or before(rows, scores, *more))
    show = lambda df: sorted(map(tuple, df[["query_id", "id", "score"]].to_numpy().tolist()))
    got = pd.concat(retrieval._best_in_turns(rows, x, ids, q, 3, ["id"], "id", 9))
    assert max(sizes) <= 60_000 and sum(sizes) == 600_000
    assert show(got) == show(before(rows, np.round(x @ q.T, 9), ids, 3, ["id"], "id"))


def test_python_gets_texts_in_small_batches(spark, tmp_path):
    from corpus_spark.plans import bindings

    spark.range(1).write.parquet(f"{tmp_path}/documents.parquet")
    bindings.table(spark, str(tmp_path), "documents")
    said = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    texts = spark.range(0, 6000, 1, 1).select(F.concat(F.repeat(F.lit("x"), 3000), F.col("id").cast("string")).alias("t"))
    assert texts.select(said("t").alias("n")).agg(F.max("n")).first()[0] < 2000
