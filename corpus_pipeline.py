"""The training-data pipeline: quality rules, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, each row as it was. Texts are never shuffled: verdicts go by the
rows' places in the files (``llm/places.py``), and language is judged and filtered in one narrow pass.

Rows are judged one by one, whatever their ids: null and repeated ids are allowed, and rows that are
equal in all columns are near duplicates like others. Null and empty texts fail the quality rules. Very
long texts are taken whole. An empty table gives empty tables. Columns that documents has besides its
own pass through all filtering stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import jaccard, langid, packing, places, quality
from corpus_spark.llm.common import discard, small_batches, table, whole, written
from corpus_spark.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the line rule reject; texts stay as they are.

    A row without text, or with too few words, goes; ties and repeats are those of ``quality.assess``.
    """
    small_batches(spark)
    docs = places.placed(docs)
    numbers = places.files(docs)
    verdict = quality.assess(places.keyed(docs, numbers, "doc_id", ["doc_id", "source", "text"]))
    return places.without(docs, numbers, verdict.filter(~F.col("kept")).select("doc_id"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language likelier than all others together.

    A row with null text goes. Where no row is labelled nothing can be told, and all rows go.
    """
    small_batches(spark)
    model = vocabulary("piece_bpe_32k.model")
    langs, prob = langid.fit(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"), model)
    pred, score = "the language", "its score"
    found = langid.annotate(docs, model, langs, prob, docs.columns, (pred, score))
    return found.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= 0.5)).select(*whole(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8): that with the smallest id, null ids last.

    Among equal ids the row that stands first in the files stays. Rows without words link with nothing.
    """
    small_batches(spark)
    docs = places.placed(docs)
    numbers = places.files(docs)
    found = jaccard.join_components(places.keyed(docs, numbers, "doc_id", ["doc_id", "text"]), n=5, percent=80).select("doc_id", "component_id")
    found = written(found, "groups")
    # only groups of several rows have one that goes: the rows that another leads, and those leaders
    led = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("key"), "component_id")
    members = led.unionByName(led.select(F.col("component_id").alias("key"), "component_id").distinct())
    ids = places.keyed(docs, numbers, "key", ["doc_id"]).withColumnRenamed("doc_id", "id")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = members.join(ids, "key").groupBy("component_id").agg(F.min(rank)["key"].alias("stays"))
    gone = members.select("key").join(first.select(F.col("stays").alias("key")), "key", "left_anti")
    return places.without(docs, numbers, gone)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document; null text is the end token alone."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned pieces and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: DataFrame | None = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
