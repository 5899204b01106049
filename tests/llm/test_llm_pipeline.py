import numpy as np

import corpus_pipeline
from corpus_spark.llm import jaccard, places
from corpus_spark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "ngram_jaccard":
            comp = jaccard.join_components(docs, 5, 80).collect()
            assert kept == {r["component_id"] for r in comp}
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == kept


def test_run_on_empty(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    words = {"en": "the dog runs over street and house with many people who talk about weather every morning in town".split(), "de": "der hund läuft über straße und haus mit vielen leuten die jeden morgen in stadt vom wetter reden".split()}

    def text(lang):
        return " ".join(rng.choice(words[lang], 80))

    rows = [(k, text(x), x, "s", 1) for k in range(100, 140) for x in [("en", "de")[k % 2]]]
    clean, near, same = text("en"), text("de"), text("en")
    rows += [(None, text("en"), "en", "s", 1), (None, text("de"), "de", None, 1)]  # clean, without id
    rows += [(1, clean, "en", "s", 1), (1, "too short", "en", "s", 1), (1, "4 2 " * 40, "en", "s", 1)]  # one clean of three
    rows += [(2, same, "en", "s", 1)] * 3 + [(2, same, "en", "t", 1), (None, same, "en", "s", 1)]
    rows += [(4, near, "de", "s", 1), (3, near + " ende", "de", "s", 1), (3, text("de"), "de", "s", 1), (None, near, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    want = sorted({(r[0] or 0, r[1]) for r in rows if r[1] not in ("too short", "4 2 " * 40)} - {(0, same), (0, near), (4, near)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == want


def test_rows_by_place(spark, tmp_path):
    rows = [(k % 7 or None, f"t{k}", "x") for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, `whole row` string").repartition(5, "text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    numbers = places.files(docs)
    keys = places.keyed(docs, numbers, "doc_id", ["text"])
    assert keys.select("doc_id").distinct().count() == 3000 and numbers.count() == 5
    gone = keys.filter("text like '%3%'").select("doc_id")
    want = sorted((r[0] or 0, r[1]) for r in rows if "3" not in r[1])
    for most in (1, 2, 100):
        left = places.without(docs, numbers, gone, most)
        assert left.columns == docs.columns and sorted((r[0] or 0, r[1]) for r in left.collect()) == want
    assert places.without(docs, numbers, gone.limit(0)).count() == 3000
    some = keys.filter("text like '%77%'").select("doc_id")
    for few in (0, 1000):
        got = {r["text"] for r in places.among(keys, "doc_id", some, few=few).collect()}
        assert {r[1] for r in rows if "77" in r[1]} <= got and len(got) < 100
    made = spark.createDataFrame(rows, "doc_id long, text string, _metadata string")
    assert places.placed(made).columns == made.columns and places.placed(docs) is docs


def test_stages_with_odd_columns(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(5)
    words = "the dog runs over street and house with many people who talk about weather every morning in town".split()
    rows = [(k, " ".join(rng.choice(words, 70)), "en", "s", 1, f"n{k}", float(k), [k, None], dt.datetime(2020, 1, 1 + k), None if k % 2 else 2**60 + k) for k in range(20)]
    kind = "doc_id long, text string, lang string, source string, n_chars int, number string, file double, `a.b` array<int>, `row``slot` timestamp, score long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    first = sorted(docs.collect(), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert sorted(docs.collect(), key=str) == first, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 20


def test_stages_shuffle_no_texts(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan, name


def test_stages_hand_python_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    try:
        spark.conf.set(name, str(64 << 20))
        corpus_pipeline.packing_stage(spark, docs, SF)
        assert spark.conf.get(name) == str(4 << 20)
        spark.conf.set(name, str(1 << 20))  # what a session has chosen stays
        corpus_pipeline.packing_stage(spark, docs, SF)
        assert spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.unset(name)
