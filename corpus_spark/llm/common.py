"""Shared pieces of the training-data operators: scratch tables, word rules, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpus_spark.sources.scratch import discard, scratch_dir, small_batches, spread, written  # noqa: F401

#: Words are runs of bytes outside these, as in ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    small_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if dealt else found


def whole(names: list[str]) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, size: int = 256) -> DataFrame:
    """Applies ``work`` to slices of Arrow batches; it returns a value for each column of ``schema``, in that order.

    Only one slice's texts are Python objects at a time. Columns that are handed on stay Arrow arrays, so that nulls
    and large integers are what they were.
    """
    out = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(out)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, size):
                made = work(batch.slice(at, size))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made.values(), kinds)], schema=kinds)

    return df.mapInArrow(run, out)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a written table if its row count proves it small; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two integer columns; returns (node, component) for every node of an edge, where
    component is the smallest node reachable. Each round is a partial aggregate for the minimum and
    an equi-join, both shuffled; nothing is gathered in the driver.
    """
    x = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    x = x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    x = written(x, "cc")
    before = None
    for _ in range(max_rounds):
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, x = x, written(small_star.filter("u <> v").distinct(), "cc")
        discard(last)
        now = x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = x.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return x.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
