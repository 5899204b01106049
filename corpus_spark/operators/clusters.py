"""K-means on a fixed-point grid: whole numbers have exact sums, so topics don't depend on partitions or on lost tasks.

Vectors are put on a grid of at most 2**20 steps up to the largest component. Start points are chosen farthest-first among
64 vectors a topic, those with the smallest md5 over ``seed:id``. Each round assigns all vectors and takes the floor of
their means; several seeds share one scan a round. Any other engine gets the same topics from the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators.sampling import dice, simple
from corpus_spark.operators.topics import adjusted_rand
from corpus_spark.sources.scratch import discard, written

#: Cells of all centres of all seeds: they go through the driver and to each task.
MOST_CELLS = 16_000_000
_SUMS = "part int, run int, topic int, n bigint, sums array<bigint>"


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(v) > 0), F.lit(False))


def _grid(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(rows * scale + 0.5)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances without the point's own part: whole numbers below 2**53, so exact. The first of equals wins."""
    return np.argmin((centres * centres).sum(axis=1) - 2 * (points @ centres.T), axis=1)


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """The first point, then again and again the one farthest from all chosen (ties: the earliest), while any is off them."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _averaged(rows: DataFrame, runs: list[np.ndarray], scale: float) -> list[np.ndarray]:
    """One round for all runs: sums of each task, added up by groups of tasks and then by cell. Empty topics stay in place."""
    width = runs[0].shape[1]
    schema = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("topic", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def out(part: int, counts: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        found = [(r, int(t)) for r, c in enumerate(counts) for t in np.flatnonzero(c)]
        cols = [[part] * len(found), [r for r, _ in found], [t for _, t in found], [int(counts[r][t]) for r, t in found], [sums[r][t] for r, t in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def empty() -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [np.zeros(len(c), np.int64) for c in runs], [np.zeros(c.shape, np.int64) for c in runs]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = empty()
        for batch in batches:
            if batch.num_rows:
                points = _grid(_matrix(batch.column("_v"), width), scale)
                for r, centres in enumerate(runs):
                    near = _nearest(points, centres)
                    counts[r] += np.bincount(near, minlength=len(centres))
                    order = np.argsort(near, kind="stable")
                    at = np.flatnonzero(np.diff(near[order], prepend=-1))
                    sums[r][near[order][at]] += np.add.reduceat(points[order], at).astype(np.int64)
        yield out(TaskContext.get().partitionId(), counts, sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = empty()
        for batch in batches:
            got = _matrix_of_sums(batch.column("sums"), width)
            for i, (r, t, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run", "topic", "n")))):
                counts[r][t] += n
                sums[r][t] += got[i]
        yield out(0, counts, sums)

    parts = rows.rdd.getNumPartitions()
    partial = rows.mapInArrow(assign, _SUMS).repartition(math.isqrt(parts) + 1, "part").mapInArrow(add, _SUMS)
    cells = partial.select("run", "topic", "n", F.posexplode("sums").alias("at", "x")).groupBy("run", "topic", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    got, new = cells.toArrow(), [c.copy() for c in runs]
    run, topic, at, n, x = (got.column(c).to_numpy() for c in ("run", "topic", "at", "n", "x"))
    for r in range(len(runs)):
        own = run == r
        new[r][topic[own], at[own]] = x[own] // n[own]
    return new


def _matrix_of_sums(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def grid_topics(df: DataFrame, id_col: str, n_topics: int, seeds: Sequence[int], vectors: str = "embedding", rounds: int = 10) -> DataFrame:
    """``df`` with a column topic_<seed> for each seed, from 0: at most ``n_topics``, and no more than different start vectors.

    Null where the vector is null, holds null or non-finite components, or isn't as long as the longest. Equal vectors get
    equal topics; an empty table stays empty; columns named topic_<seed> are replaced. Ids choose start points only:
    null and repeated ones are allowed. Rounds stop early once no centre moves, which changes nothing.
    """
    v = F.col(vectors).cast("array<double>")
    usable = df.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(_usable(F.col("_v")))
    edge = usable.agg(F.max(F.struct(F.size("_v").alias("width"), F.array_max(F.transform("_v", F.abs)).alias("top"))).alias("m")).first()["m"]
    names = [f"topic_{s}" for s in seeds]
    if edge is None:
        return df.withColumns({c: F.lit(None).cast("int") for c in names})
    width, top = edge["width"], edge["top"]
    bits = min(20, (51 - (width - 1).bit_length()) // 2)
    scale = 2.0 ** (bits - (math.ceil(math.log2(top)) if top > 0 else 0))
    if len(seeds) * max(1, n_topics) * width > MOST_CELLS:
        raise ValueError(f"{len(seeds)} seeds x {n_topics} topics x {width} components are over {MOST_CELLS:,} cells")
    rows = written(usable.filter(F.size("_v") == width), "grid-vectors")
    runs = []
    for seed in seeds:
        picked = simple(rows, 64 * max(1, n_topics), seed, "_id").select(dice(seed, "_id").alias("h"), "_v").collect()
        picked.sort(key=lambda r: (r["h"] or "", r["_v"]))
        runs.append(farthest_first(_grid(np.array([r["_v"] for r in picked]), scale), max(1, n_topics)))
    for _ in range(rounds):
        moved = _averaged(rows.select("_v"), runs, scale)
        if all(map(np.array_equal, moved, runs)):
            break
        runs = moved
    discard(rows)

    @F.pandas_udf(", ".join(f"t{i} int" for i in range(len(runs))))
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.full((len(batch), len(runs)), -1, dtype=np.int32)
            known = np.flatnonzero(batch.notna().to_numpy())
            if len(known):
                points = _grid(np.stack(batch.to_numpy()[known]), scale)
                for r, centres in enumerate(runs):
                    found[known, r] = _nearest(points, centres)
            yield pd.DataFrame({f"t{i}": found[:, i] for i in range(len(runs))})

    fits = F.when(_usable(v) & (F.size(v) == width), v)
    held = df.withColumn("_grid_topics", nearest(fits))
    topic = lambda i: F.when(F.col(f"_grid_topics.t{i}") >= 0, F.col(f"_grid_topics.t{i}"))
    return held.withColumns({c: topic(i) for i, c in enumerate(names)}).drop("_grid_topics")


def grid_stability(df: DataFrame, id_col: str, n_topics: int, seed: int, vectors: str = "embedding", rounds: int = 10) -> DataFrame:
    """Adjusted Rand index of two neighbouring seeds, whose rounds share their scans; vectors without a topic are left out."""
    got = grid_topics(df.select(id_col, vectors), id_col, n_topics, [seed, seed + 1], vectors, rounds)
    return adjusted_rand(got.filter(F.col(f"topic_{seed}").isNotNull()), f"topic_{seed}", f"topic_{seed + 1}")
