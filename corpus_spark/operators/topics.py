"""Embeddings and topics: hash embedding, k-means, hash topics, topic labels, coverage and stability."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.sources.scratch import written

WIDTH = 384


def hash_embedding(text: Column, width: int = WIDTH, kind: str = "float") -> Column:
    """array<float> or array<double>: each lower-case token adds +-1 at a place from its digest; unit length, zero stays zero."""

    @F.pandas_udf(f"array<{kind}>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            rows = np.zeros((len(batch), width), dtype=np.float32 if kind == "float" else np.float64)
            for row, text_ in zip(rows, batch):
                for token in text_.lower().split() if text_ else ():
                    if token not in known:
                        if len(known) > 200_000:
                            known.clear()
                        d = hashlib.sha256(token.encode()).digest()
                        known[token] = int.from_bytes(d[:4], "big") % width, 1 if d[4] % 2 == 0 else -1
                    at, sign = known[token]
                    row[at] += sign
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(norm > 0, norm, 1)))

    return embed(text)


def hash_embedding_long(df: DataFrame, id_col: str, text: str, width: int = WIDTH) -> DataFrame:
    """(id, idx, value) in built-in functions: sparse form of the same embedding."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    digest = F.sha2(F.col("t").cast("binary"), 256)
    at = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    cells = df.select(id_col, F.explode(tokens).alias("t")).select(id_col, at.alias("idx"), sign.alias("s")).groupBy(id_col, "idx").agg(F.sum("s").cast("double").alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))
    return cells.select(id_col, "idx", (F.col("v") / norm).alias("value"))


def model_embedding(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "embedding", batch: int = 64) -> DataFrame:
    """Plug-in: ``encoder()`` runs once in each task and returns a function from texts to a matrix; rows get unit length."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for series in batches:
            parts = [np.asarray(encode(series.iloc[i : i + batch].fillna("").tolist()), dtype=np.float32) for i in range(0, len(series), batch)]
            rows = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(norm > 0, norm, 1)))

    return df.withColumn(column, embed(F.col(text)))


def kmeans_topics(df: DataFrame, n_topics: int, seed: int, vectors: str = "embedding") -> DataFrame:
    """topic_id by Spark's k-means; never more topics than rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vectors).cast("array<double>")))
    k = max(1, min(n_topics, rows.limit(n_topics).count()))
    if k == 1:
        return df.withColumn("topic_id", F.lit(0))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="topic_id").fit(rows).transform(rows).drop("_v")


def hash_topic(text: Column, k: int) -> Column:
    return (F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 8), 16, 10).cast("long") % k).cast("int")


def _tokens(df: DataFrame, topic: str, doc: str, text: str, pattern: str) -> DataFrame:
    # outer, because Spark would extract tokens a second time to leave empty lists out
    return df.select(topic, doc, F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))).alias("term")).filter(F.col("term").isNotNull())


def tfidf_labels(df: DataFrame, topic: str = "topic_id", doc: str = "doc_id", text: str = "text", top: int = 5, vocabulary: int = 2000, few: int = 200_000) -> DataFrame:
    """topic, term, score, rank: mean of unit-length tf-idf rows over all documents of the topic.

    Tokens are counted by (topic, document, term) first; everything after works on those counts. Documents are dealt out
    whole, so that their many tokens are counted where they are found, and the counts meet the vocabulary without moving
    unless it has more than ``few`` terms.
    """
    dealt = df.select(topic, doc, text).repartition(topic, doc)
    tf = written(_tokens(dealt, topic, doc, text, r"(?U)\b\w{3,}\b").groupBy(topic, doc, "term").agg(F.count("*").alias("tf")), "term-counts")
    docs = df.groupBy(topic).agg(F.count("*").alias("n"))
    terms = tf.groupBy(topic, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    known = terms.withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("total"), "term"))).filter(F.col("_r") <= vocabulary)
    idf = written(known.join(docs, topic).select(topic, "term", "n", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = tf.join(F.broadcast(idf) if idf.count() <= few else idf, [topic, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(topic, doc)))
    scores = weight.withColumn("u", F.col("w") / norm).groupBy(topic, "term").agg((F.sum("u") / F.first("n")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), F.desc("term")))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top)


def count_labels(df: DataFrame, topic: str = "topic_id", text: str = "text", top: int = 5) -> DataFrame:
    """topic, term, count, rank of the most frequent tokens of three characters or more."""
    tokens = df.select(topic, F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda t: F.length(t) >= 3)).alias("term"))
    counts = tokens.groupBy(topic, "term").agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("count"), "term"))).filter(F.col("rank") <= top)


def label_text(labels: DataFrame, topic: str = "topic_id") -> DataFrame:
    return labels.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(topic, F.array_join(F.col("t.term"), ", ").alias("label"))


def coverage(docs: DataFrame, topic: str = "topic_id", messages: str = "message_count") -> DataFrame:
    """documents, messages, the shares of both that have a topic, and the number of topics."""
    has = F.col(topic).isNotNull() & (F.col(topic) >= 0)
    return docs.agg(
        F.count("*").alias("documents"), F.sum(messages).alias("messages"), F.try_divide(F.count_if(has).cast("double"), F.count("*")).alias("document_coverage"),
        F.try_divide(F.sum(F.when(has, F.col(messages)).otherwise(0)).cast("double"), F.sum(messages)).alias("message_coverage"), F.count_distinct(F.when(has, F.col(topic))).alias("topics"),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: from the contingency counts. Fewer than two rows, or no room above chance, give 1."""
    pairs = lambda c: c.cast("double") * (c - 1) / 2
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sums = [cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))]
    for key, name in (("a", "sa"), ("b", "sb")):
        sums.append(cells.groupBy(key).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(name)))
    one = sums[0].crossJoin(F.broadcast(sums[1])).crossJoin(F.broadcast(sums[2]))
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs(F.col("n")))
    best = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("s") - expected, best - expected), F.lit(1.0)).alias("ari"))


def stability(df: DataFrame, n_topics: int, seed: int, vectors: str = "embedding") -> DataFrame:
    """Adjusted Rand index of two k-means runs with neighbouring seeds."""
    first = kmeans_topics(df, n_topics, seed, vectors).withColumnRenamed("topic_id", "topic_a")
    return adjusted_rand(kmeans_topics(first, n_topics, seed + 1, vectors), "topic_a", "topic_id")


def preview(docs: DataFrame, labels: DataFrame, k: int = 3, topic: str = "topic_id", doc: str = "doc_id", text: str = "text", chars: int = 300) -> DataFrame:
    first = docs.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(doc))).filter(F.col("rank") <= k)
    return first.select(topic, "rank", doc, F.substring(text, 1, chars).alias("text")).join(label_text(labels, topic), topic, "left")
