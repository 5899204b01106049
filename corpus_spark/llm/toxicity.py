"""Operator 13: toxicity by a character n-gram linear classifier with naive Bayes scaling.

A document's features are its distinct runs of ``SHORTEST`` to ``LONGEST`` characters (lower-cased, white
space as one blank), hashed into ``SLOTS`` places. Over labelled documents, counts of both classes give
each place its log-count ratio r; places that are rare or tell nothing are left out, and a logistic
regression (Spark ML) is trained on presence times r. A score is the logistic of the sum over the
document's places of weight times r, one array lookup for each run of characters.

Labels are learned from a bounded sample, ``per_class`` documents of each class by the hash of their ids,
never from held-out ids (crc32 of the id modulo 3 is 1). Counting and training run on Spark; the driver
holds one array of ``SLOTS`` numbers. Where not both classes are labelled, all scores are 0.

Null and empty texts have no features: their score is that of the intercept alone. Very long texts are
scored whole. Rows that repeat, or have equal ids, are scored each; a null id is not held out and has no
label. Of several labels of an id the highest counts. An empty table gives no rows. Other columns,
whatever their names, have no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.common import discard, map_slices, written

SHORTEST, LONGEST = 3, 6
_BITS = 20
SLOTS = 1 << _BITS


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def places(text: str | None, used: np.ndarray | None = None) -> np.ndarray:
    """The distinct places of a text's runs of characters; only those that ``used`` marks, if it is given."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint32)
    found, h = [], np.full(len(c), 2166136261, dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        if n > len(c):
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(16777619)
        if n >= SHORTEST:
            mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(2654435761)
            at = mixed >> np.uint32(32 - _BITS)
            found.append(at if used is None else at[used[at]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """toxic, text of at most ``per_class`` labelled ids of each class that are not held out; which, the hash of the id tells."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(13))
    sides = [known.filter(F.col("toxic") == side).orderBy(order, "doc_id").limit(per_class) for side in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id").select("toxic", "text")


def ratios(rows: DataFrame, smooth: float = 0.5, least: int = 4, telling: float = 1.5) -> np.ndarray:
    """Each place's log-count ratio; 0 where fewer than ``least`` documents have it or where it is below ``telling`` in size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS), dtype=np.int64)
        for batch in parts:
            for text, side in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                counts[side, places(text.as_py())] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"place": some, "no": counts[0, some], "yes": counts[1, some]})

    found = rows.select("toxic", "text").mapInArrow(run, "place bigint, no bigint, yes bigint").groupBy("place").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    have = found.filter(F.col("no") + F.col("yes") >= least).toPandas()
    r = np.zeros(SLOTS)
    if len(have):
        yes, no = have["yes"].to_numpy() + smooth, have["no"].to_numpy() + smooth
        ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
        r[have["place"].to_numpy()] = np.where(np.abs(ratio) >= telling, ratio, 0)
    return r


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5_000, strength: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float] | None:
    """Weight times ratio of each place, and the intercept; None if not both classes are labelled."""
    rows = written(training_rows(docs, labels, per_class), "toxic-training")
    if rows.select("toxic").distinct().count() < 2:
        return None
    r = ratios(rows)
    kept = np.flatnonzero(r)
    if not len(kept):
        kept = np.zeros(1, dtype=np.int64)  # nothing tells: a single place with ratio 0
    used = r != 0

    def named(part: pa.RecordBatch) -> dict:
        return {"toxic": part.column("toxic"), "places": [list(map(str, places(t, used).tolist())) for t in part.column("text").to_pylist()]}

    counted = written(map_slices(rows, named, "toxic int, places array<string>"), "toxic-places")
    present = CountVectorizerModel.from_vocabulary(list(map(str, kept.tolist())), "places", "present", minTF=1.0).setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(r[kept]), inputCol="present", outputCol="features")
    sides = dict(counted.groupBy("toxic").count().collect())
    # both classes weigh alike, however many of each were sampled
    weight = F.when(F.col("toxic") == 1, 1 / sides[1]).otherwise(1 / sides[0]) * (sides[0] + sides[1]) / 2
    data = scaled.transform(present.transform(counted)).select(F.col("toxic").cast("double").alias("label"), "features", weight.alias("weight"))
    fitted = LogisticRegression(regParam=strength, maxIter=rounds, standardization=False, weightCol="weight").fit(data)
    weights = np.zeros(SLOTS)
    weights[kept] = fitted.coefficients.toArray() * r[kept]
    discard(rows, counted)
    return weights, float(fitted.intercept)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: 1 where the score is at least ``limit``."""
    weights, intercept = model if model else (np.zeros(SLOTS), 0.0)
    used = weights != 0

    def work(part: pa.RecordBatch) -> dict:
        sums = np.array([intercept + weights[places(t, used)].sum() for t in part.column("text").to_pylist()])
        found = 1 / (1 + np.exp(-np.clip(sums, -500, 500))) if model else np.zeros(len(sums))
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": found, "predicted": (found >= limit).astype(np.int32)}

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", held_out().alias("held_out"), "text"), work, f"doc_id {kind}, held_out boolean, score double, predicted int")
