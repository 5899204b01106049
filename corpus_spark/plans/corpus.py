"""Workloads put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.operators import distributions as D
from corpus_spark.operators import lexicon, topics, windows
from corpus_spark.sources.scratch import written


def preprocess(raw: DataFrame, salt: str, shortest: int = 1, compatibility: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Clean messages from raw comments; nothing is shuffled. A null group is ``unknown``."""
    df = raw.filter(F.col("comment").isNotNull())
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit("unknown"))
    tidy = lambda c: T.clean_text(T.fix_encoding(F.col(c)), compatibility)
    when = F.col("datetime") if dict(df.dtypes)["datetime"].startswith("timestamp") else T.parse_datetime(F.col("datetime"))
    # a generator's output can't be filtered below it, so no text is cleaned twice
    tidied = F.explode_outer(F.array(F.struct(when.alias("datetime"), tidy("source").alias("source"), tidy("group").alias("group"), tidy("comment").alias("clean_text"))))
    others = [c for c in df.columns if c not in ("datetime", "source", "group", "comment", "clean_text")]
    df = df.select(*others, tidied.alias("_tidy")).select(*others, "_tidy.*")
    df = df.filter(F.col("datetime").isNotNull() & (F.length("clean_text") >= shortest)).withColumn("group", F.when(F.col("group") == "", "unknown").otherwise(F.col("group")))
    month = F.date_format("datetime", "yyyy-MM")
    return df.select("datetime", F.to_date("datetime").alias("date"), F.year("datetime").alias("year"), month.alias("month"), month.alias("period"), T.author_hash(F.col("author"), salt).alias("author_hash"), "source", "group", "clean_text", *keep)


def enrich(documents: DataFrame, gazetteer: Mapping[str, Sequence[str]], n_topics: int, seed: int, themes=None, vectors: str | None = None) -> DataFrame:
    """topic_id, sentiment, theme and toponyms of documents; hash topics unless there are vectors."""
    df = documents.withColumn("topic_id", topics.hash_topic(F.col("text"), n_topics)) if vectors is None else topics.kmeans_topics(documents, n_topics, seed, vectors)
    label = lexicon.theme(F.col("text"), themes) if themes else lexicon.theme(F.col("text"))
    return df.withColumns({"sentiment": lexicon.sentiment(F.col("text")), "theme": label, "toponyms": lexicon.places(F.col("text"), gazetteer)})


#: Keys of the tables that analyse() makes.
_SETS = (("topic_id",), ("period", "topic_id"), ("group", "topic_id"), ("theme",), ("period", "theme"), ("group", "theme"), ("toponym",), ("toponym", "topic_id"), ("toponym", "sentiment"), ("toponym", "theme"))


def analyse(enriched: DataFrame, meta: DataFrame, themes: Sequence[str], top: int = 20) -> dict[str, DataFrame]:
    """The distribution tables of enriched documents. All are counted in one scan; what is written is the counts."""
    counts = written(D.cube(enriched, _SETS), "counts")

    def of(*keys: str) -> DataFrame:
        return counts.filter(F.col("set") == _SETS.index(keys))

    places = of("toponym").filter("said > 0")
    known = places.select("toponym", "said").join(lexicon.few(meta), "toponym", "left")
    by_place = lambda key: D.breakdown(of("toponym", key).filter("said > 0 AND trim(toponym) <> ''"), key, "toponym", weight="said")
    return {
        "topic_distribution": D.breakdown(of("topic_id"), "topic_id", weight="docs"),
        "temporal_dynamics": D.breakdown(of("period", "topic_id"), "topic_id", "period", weight="docs"),
        "group_comparison": D.breakdown(of("group", "topic_id"), "topic_id", "group", weight="docs"),
        "driver_distribution": D.closed_distribution(of("theme"), "theme", themes, "docs"),
        "driver_temporal_dynamics": D.breakdown(of("period", "theme"), "theme", "period", weight="docs"),
        "driver_by_group": D.breakdown(of("group", "theme"), "theme", "group", weight="docs"),
        "toponym_frequency": D.place_frequency(places, meta, "said"),
        "top_toponyms": D.top_places(places, top, "said"),
        "city_level_stats": D.city_stats(known, "said"),
        "district_level_stats": D.district_stats(known, "said"),
        "topics_per_toponym": by_place("topic_id"),
        "sentiment_per_toponym": by_place("sentiment"),
        "drivers_per_toponym": by_place("theme"),
    }


def corpus_pipeline(raw: DataFrame, gazetteer: Mapping[str, Sequence[str]], meta: DataFrame, salt: str, width: str = "1 hour", shortest: int = 5, n_topics: int = 10, seed: int = 42, tiebreak: str = "row_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Comments to enriched documents and their tables."""
    clean = preprocess(raw, salt, shortest, keep=[tiebreak])
    messages = clean.withColumn("lang", T.language(F.col("clean_text")))
    documents = windows.number(windows.roll_up(messages, width, tiebreak=tiebreak))
    enriched = enrich(documents, gazetteer, n_topics, seed)
    return enriched, analyse(enriched, meta, list(lexicon.THEMES))
