"""A stored index of vectors, and exact searches that read only the cells that can matter.

The index deals vectors out to cells by their nearest centroid and stores each cell's radius, the
largest angle to its centroid. By the triangle inequality on the sphere no vector of a cell is nearer to a
query than the angle to the centroid less the radius. A search takes the cells nearest to each query until
they hold k vectors, whose k-th score is a threshold, and then only the cells whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_spark.operators.retrieval import MOST_QUERIES
from corpus_spark.sources.scratch import written

#: What a bound is raised by, against rounding.
_SLACK = 1e-9


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _centroids(items: DataFrame, item_id: str, vector: str, cells: int, sample: int, rounds: int) -> np.ndarray:
    """Centres of a bounded sample, taken by the hash of ids: spherical k-means from the sample's first vectors."""
    rows = items.filter(F.col(vector).isNotNull()).select(item_id, vector).orderBy(F.xxhash64(item_id, F.lit(7)), item_id).limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 1))
    x = _unit(rows[vector])
    c = np.unique(x, axis=0)[:: max(1, len(np.unique(x, axis=0)) // cells)][:cells]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def write_index(items: DataFrame, folder: str, item_id: str, vector: str = "embedding", cells: int = 256, sample: int = 20_000, rounds: int = 5) -> None:
    """Writes all columns of items, one folder a cell, and the table of cells: cell, centroid, radius, n.

    Centres are fitted on ``sample`` vectors at most; every vector is in its nearest one's cell. Null vectors are left out.
    """
    centres = _centroids(items, item_id, vector, cells, sample, rounds)
    shared = items.sparkSession.sparkContext.broadcast(centres)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                near = _unit(part[vector]) @ shared.value.T
                cell = near.argmax(axis=1)
                yield part.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(part)), cell], -1, 1)))

    placed = written(items.filter(F.col(vector).isNotNull()).mapInPandas(place, kinds + ", cell int, angle double"), "index-rows")
    placed.drop("angle").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    known = items.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centroid array<double>")
    known.join(sizes, "cell").write.mode("overwrite").parquet(f"{folder}/cells")


def read_rows(spark: SparkSession, folder: str, cells: list[int]) -> DataFrame:
    """The rows of some cells; only their folders are read."""
    return spark.read.parquet(f"{folder}/rows").filter(F.col("cell").isin(cells))


def _scored(rows: DataFrame, queries: dict[int, list[int]], ids: np.ndarray, q: np.ndarray, k: int, item_id: str, vector: str, kinds: dict) -> DataFrame:
    """query, item_id, score: of each task, the k best rows of each query among those of the cells that it asks."""
    shared = rows.sparkSession.sparkContext.broadcast(({c: np.array(x) for c, x in queries.items()}, q))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks, vectors = shared.value
        held: list[pd.DataFrame] = []
        for pdf in parts:
            for cell, part in pdf.groupby("cell"):
                own = asks[int(cell)]
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    s = _unit(some["v"]) @ vectors[own].T
                    m = min(k, len(some))
                    edge = -np.partition(-s, m - 1, axis=0)[m - 1]
                    row, of = np.nonzero(s >= edge)
                    held.append(pd.DataFrame({"query": own[of], item_id: some[item_id].to_numpy()[row], "score": s[row, of]}))
            if held:
                rows_ = pd.concat(held).sort_values(["query", "score", item_id], ascending=[True, False, True])
                held = [rows_[rows_.groupby("query").cumcount() < k]]
        yield from held

    return rows.select(item_id, "cell", F.col(vector).cast("array<double>").alias("v")).mapInPandas(best, f"query bigint, `{item_id}` {kinds[item_id]}, score double")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, item_id: str, vector: str = "embedding", most: int = MOST_QUERIES, read: list | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the k best by cosine for each query, as if all rows were compared.

    Queries travel to each task in rounds of about ``most``; the driver holds the table of cells and one round of
    queries. ``read`` gets the cells that each round read.
    """
    cells = spark.read.parquet(f"{folder}/cells").toPandas()
    centres, radius, sizes, names = _unit(cells["centroid"]) if len(cells) else np.zeros((0, 1)), cells["radius"].to_numpy(), cells["n"].to_numpy(), cells["cell"].to_numpy()
    rounds = max(1, -(-queries.count() // most))
    kinds, key = dict(spark.read.parquet(f"{folder}/rows").dtypes) if len(cells) else {}, dict(queries.dtypes)["query_id"]
    found: DataFrame | None = None
    for turn in range(rounds if len(cells) else 0):
        own = queries.filter(F.col(vector).isNotNull())
        asked = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn).select("query_id", F.col(vector).alias("v")).toPandas()
        if not len(asked):
            continue
        q = _unit(asked["v"])
        angle = np.arccos(np.clip(q @ centres.T, -1, 1))
        # cells by their bounds, the likeliest first, until a query has seen k rows
        bound = np.cos(np.maximum(0, angle - radius)) + _SLACK
        bound[(q == 0).all(axis=1)] = 1  # a query of zeros is equally far from all
        order = np.argsort(-bound, axis=1, kind="stable")
        enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k
        near = np.zeros_like(enough)
        np.put_along_axis(near, order, enough, axis=1)
        first = written(_scored(read_rows(spark, folder, names[near.any(axis=0)].tolist()), {int(names[c]): np.flatnonzero(near[:, c]).tolist() for c in np.flatnonzero(near.any(axis=0))}, asked, q, k, item_id, vector, kinds), "index-near")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), item_id))
        edge = np.full(len(q), -np.inf)
        for r in first.withColumn("r", rank).filter(F.col("r") == k).select("query", "score").collect():
            edge[r["query"]] = r["score"]
        more = ~near & (bound >= edge[:, None])
        both = first
        if more.any():
            both = first.unionByName(_scored(read_rows(spark, folder, names[more.any(axis=0)].tolist()), {int(names[c]): np.flatnonzero(more[:, c]).tolist() for c in np.flatnonzero(more.any(axis=0))}, asked, q, k, item_id, vector, kinds))
        if read is not None:
            read.append(sorted(names[(near | more).any(axis=0)].tolist()))
        numbered = spark.createDataFrame([(i, x) for i, x in enumerate(asked["query_id"].tolist())], f"query bigint, query_id {key}")
        one = both.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(numbered), "query").select("query_id", item_id, "score", "rank")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = queries.select("query_id", F.lit(None).alias(item_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return found
