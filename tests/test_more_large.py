"""Tables in one scan, streams through interruptions, codebooks of many levels, plans without repeated work."""

import datetime as dt
import math
import pathlib

from pyspark.sql import functions as F

from corpus_spark.operators import bibliography, coding, lexicon, topics, windows
from corpus_spark.operators import distributions as D
from corpus_spark.plans import corpus
from corpus_spark.streaming import rollup


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_tables_from_one_scan(spark):
    said = [["A", "B"], ["B", "B"], [], None, [" ", "A"], ["C"], ["A"]]
    data = [(f"2024-0{k % 3 + 1}", None if k == 5 else f"g{k % 2}", "s", k % 3 if k != 6 else None, "neutral" if k % 2 else "positive", ("visa/legal", "work/income", "other")[k % 3], said[k]) for k in range(7)]
    docs = spark.createDataFrame(data, "period string, `group` string, source string, topic_id int, sentiment string, theme string, toponyms array<string>")
    meta = lexicon.gazetteer_frame(spark, {"A": ("city", "A"), "B": ("district", "A"), "C": ("country", None)})
    themes = ["visa/legal", "work/income", "unseen"]
    got = corpus.analyse(docs, meta, themes, 2)
    mentioned = lexicon.mentions(docs, meta)
    want = {
        "topic_distribution": D.breakdown(docs, "topic_id"), "temporal_dynamics": D.breakdown(docs, "topic_id", "period"), "group_comparison": D.breakdown(docs, "topic_id", "group"),
        "driver_distribution": D.closed_distribution(docs, "theme", themes), "driver_temporal_dynamics": D.breakdown(docs, "theme", "period"), "driver_by_group": D.breakdown(docs, "theme", "group"),
        "toponym_frequency": D.place_frequency(mentioned.drop("type", "parent_city"), meta), "top_toponyms": D.top_places(mentioned, 2), "city_level_stats": D.city_stats(mentioned), "district_level_stats": D.district_stats(mentioned),
        "topics_per_toponym": D.breakdown(mentioned, "topic_id", "toponym"), "sentiment_per_toponym": D.breakdown(mentioned, "sentiment", "toponym"), "drivers_per_toponym": D.breakdown(mentioned, "theme", "toponym"),
    }
    assert got.keys() == want.keys()
    for name in want:
        assert got[name].columns == want[name].columns and rows(got[name]) == rows(want[name]), name
    plan = D.cube(docs, corpus._SETS)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Generate ") == 1
    assert D.cube(docs.limit(0), corpus._SETS).count() == 0


def test_stream_with_late_and_repeated_rows_and_restarts(spark, tmp_path):
    t0 = dt.datetime(2024, 5, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    kind = "row_id long, datetime timestamp, `group` string, comment string, source string"
    first = [(k, at(k), "g", f"message number {k}", "s") for k in range(120)]
    second = [(k, at(k), "g", f"message number {k}", "s") for k in range(120, 400)] + first[100:]  # repeats within the delay
    late = [(1000 + k, at(k), "g", "too late by hours", "s") for k in range(20)]
    third = [(k, at(k), "g", f"message number {k}", "s") for k in range(400, 500)] + late + [(9999, at(100_000), "end", "the very end", "end")]
    dropped = 0
    for n, part in enumerate((first, second, third)):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = rollup.documents_stream(stream, "1 hour", "1 hour", unique="row_id")
        dropped += rollup.late_rows(rollup.run_available(out, str(tmp_path)))  # a new query each time, from the last one's state
    want = spark.createDataFrame([*first, *second[:280], *third[:100]], kind).withColumns({"clean_text": F.col("comment"), "lang": F.lit("en")})
    pick = lambda d: rows(d.filter("source = 's'").select("window_start", "text", "message_count"))
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    assert pick(got) == pick(windows.roll_up(want, "1 hour")) and len(pick(got)) == 9
    assert dropped == len(late)


def test_stream_keeps_state_on_disk_and_cleans_once(spark, tmp_path):
    from corpus_spark.plans import queries_more

    store = "spark.sql.streaming.stateStore.providerClass"
    kind = "row_id long, datetime timestamp, `group` string, comment string, source string"
    said = [(k, dt.datetime(2024, 5, 1) + dt.timedelta(minutes=k), "g", f"message  number {k}", "s") for k in range(90)]
    end = (9999, dt.datetime(2024, 6, 1), "end", "the very end", "end")

    def runs(folder, first_store=None):
        """Two runs, the second from the first one's state."""
        for n, part in enumerate((said[:40], [*said[40:], end])):
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{folder}/in/{n}")
            out = rollup.documents_stream(spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
            if first_store and n == 0:
                spark.conf.set(store, first_store)
            progress = rollup.run_available(out, folder)
            spark.conf.unset(store)
            yield progress, spark.read.schema(out.schema).parquet(f"{folder}/out").filter("source = 's'")

    want = [("\n".join(f"message number {k}" for k in range(a, min(a + 60, 90))), min(60, 90 - a)) for a in (0, 60)]
    on_disk = lambda progress: {any(k.startswith("rocksdb") for k in s["customMetrics"]) for p in progress for s in p["stateOperators"]}
    for folder, first_store, disk in (("new", None, True), ("old", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", False)):
        for progress, got in runs(str(tmp_path / folder), first_store):
            assert on_disk(progress) == {disk}, folder
        assert rows(got.select("text", "message_count")) == want, folder
    plan = optimized(rollup.documents_stream(spark.read.schema(kind).parquet(str(tmp_path / "new/in/*"))))
    assert plan.count("ArrowEvalPython") == 2  # repair and NFKC
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.glob("stream-*"))
    assert queries_more.st1_stream_windows(spark, "/root/testdata/sf0.001").count() > 0
    (folder,) = set(scratch.glob("stream-*")) - before
    assert list(folder.rglob("state/0/*/*.zip")) and not list(folder.rglob("state/0/*/*.delta"))


def test_codebook_roots(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None, "d") for k in range(300)]
    odd = [("x", "nowhere", "d"), ("y", "x", "d"), ("p", "q", "d"), ("q", "p", "d"), ("r", "p", "d"), ("self", "self", "d"), (None, "c1", "d"), (" ", None, "d"), ("c5", "c4", "again")]
    book = spark.createDataFrame([*chain, *odd], "code_id string, parent_id string, description string")
    got = {r["code_id"]: (r["root"], r["depth"], r["problem"]) for r in coding.codebook_roots(book).collect()}
    assert all(got[f"c{k}"] == ("c0", k, None) for k in range(300))
    assert got["x"] == ("nowhere", 1, "unknown ancestor") and got["y"] == ("nowhere", 2, "unknown ancestor")
    assert {got[k] for k in ("p", "q", "r", "self")} == {(None, None, "cycle")} and len(got) == 306
    assert coding.codebook_roots(book.limit(0)).count() == 0


def test_texts_are_worked_out_once(spark):
    from corpus_spark.plans.queries import QUERIES
    import corpus_spark.plans.queries_more  # noqa: F401

    sf = "/root/testdata/sf0.001"
    assert optimized(QUERIES["t5_preprocess"](spark, sf)).count("regexp_replace") <= 12
    assert optimized(QUERIES["r1_chunks"](spark, sf)).count("regexp_replace") <= 2
    assert optimized(QUERIES["w8_tfidf_labels"](spark, sf)).count("regexp_extract_all") == 0  # counts of terms were written


def test_relevance_tidies_a_text_once_though_scores_are_filtered(spark):
    rows = [("c1", "The  Title", " Thon\tthe eau ", ["the", "x"], 2010, 5, None, ""), ("c2", None, None, None, 0, None, True, ""), ("c3", "a", "", ["of the"], 1990, 0, None, "p")]
    docs = spark.createDataFrame(rows, "candidate_id string, title string, abstract string, keywords array<string>, year int, citation_count int, open_access boolean, pdf_url string")
    scored = bibliography.relevance(docs, ["the", "the title thon"], ["x the"], 2005, 2020)
    # terms may reach over the borders of keywords, title and abstract
    hits = {"c1": (1, 1, 3), "c2": (0, 0, 0), "c3": (0, 0, 1)}
    more = {"c1": 0.05 * 5 / 15 + math.log10(6) * 0.03, "c2": 0.05, "c3": -0.1 + 0.05}
    want = {k: 0.45 * t / 3 + 0.35 * a / 3 + 0.2 * (0.7 * min(e, 2) / 2 + 0.3 * max(0, e - 2)) + more[k] for k, (t, a, e) in hits.items()}
    got = {r["candidate_id"]: r for r in scored.collect()}
    assert {k: r["relevance_score"] for k, r in got.items()} == {k: round(v, 4) for k, v in want.items()}
    assert "matched required terms: the, the title thon" in got["c1"]["reason"]
    for part in bibliography.select(scored, 0.2):
        assert optimized(part.select("candidate_id", "relevance_score")).count("regexp_replace(") == 3


def test_labels_find_their_terms_together(spark):
    rows = [(1, "The déjà  vu, «über» Ёлка"), (2, "ﬁne ² text in the end"), (3, "été una"), (4, None), (5, "สวัสดี the hello"), (6, "привет the hello"), (7, "12 !"), (8, " 'good!' (bad), good bad. problem... xgood "), (9, "good-bad")]
    docs = spark.createDataFrame(rows, "row_id int, comment string")
    got = lexicon.label_all(docs, "comment", {"End": ("in the end",), "Vu": ("vu", "déjà vu")}, themes={"a": ("the", "una"), "b": ("vu", "end", "the end")}, theme_default="none")
    assert optimized(got).count("regexp_extract_all(") < optimized(docs.select(lexicon.theme(F.col("comment"), {"a": ("the", "una"), "b": ("vu", "end", "the end")}), lexicon.places(F.col("comment"), {"End": ("in the end",), "Vu": ("vu", "déjà vu")}), lexicon.sentiment(F.col("comment")))).count("regexp_extract_all(")
    found = {r["row_id"]: (r["clean_text"], r["lang"], r["sentiment"], r["theme"], r["toponyms"]) for r in got.collect()}
    assert found == {
        1: ("The déjà vu, «über» Ёлка", "en", "neutral", "a", ["Vu"]), 2: ("fine 2 text in the end", "en", "neutral", "b", ["End"]), 3: ("été una", "en", "neutral", "a", []), 4: ("", "other", "neutral", "none", []),
        5: ("สวัสดี the hello", "en", "neutral", "a", []), 6: ("привет the hello", "en", "neutral", "a", []), 7: ("12 !", "other", "neutral", "none", []), 8: ("'good!' (bad), good bad. problem... xgood", "en", "negative", "none", []), 9: ("good-bad", "en", "neutral", "none", []),
    }


def test_tfidf_counts_where_documents_lie_and_vocabulary_is_broadcast(spark):
    said = [("a", k % 7, f"word{k % 5} word{k % 3} common Common xy") for k in range(40)] + [("b", None, "other words here words"), ("b", 1, None)]
    docs = spark.createDataFrame(said, "topic_id string, doc_id int, text string")
    got, shuffled = topics.tfidf_labels(docs), topics.tfidf_labels(docs, few=0)
    assert rows(got) == rows(shuffled) and {r[0] for r in rows(got)} == {"a", "b"}
    assert "strategy=broadcast" in optimized(got) and "strategy=broadcast" not in optimized(shuffled)
