"""Windowed documents on a stream: the cleaning and language rules are narrow, the roll-up appends closed windows."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.operators.windows import roll_up


def documents_stream(messages: DataFrame, width: str = "1 hour", delay: str = "1 hour", shortest: int = 5, tiebreak: str = "row_id", unique: str | None = None) -> DataFrame:
    """messages: datetime timestamp, group, comment, source and a tie-break id from the source.

    State is one row a (source, group, window) that is still open; it is dropped once the watermark passes. With
    ``unique``, an id, messages that arrive again within the delay count once; their ids are kept for as long.
    Rows behind the watermark are left out; ``late_rows`` says how many.
    """
    # a generator's output can't be filtered below it, so no text is cleaned twice
    tidied = F.explode_outer(F.array(F.struct(T.clean_text(T.fix_encoding(F.col("comment"))).alias("clean_text"))))
    others = [c for c in messages.columns if c not in ("comment", "clean_text")]
    clean = messages.filter(F.col("comment").isNotNull() & F.col("datetime").isNotNull()).select(*others, tidied.alias("_tidy")).select(*others, "_tidy.*")
    kept = clean.filter(F.length("clean_text") >= shortest).withColumn("lang", T.language(F.col("clean_text")))
    marked = kept.withWatermark("datetime", delay)
    return roll_up(marked.dropDuplicatesWithinWatermark([unique]) if unique else marked, width, tiebreak=tiebreak)


_STATE = "spark.sql.streaming.stateStore."
#: Open windows hold whole texts, which Spark's own store keeps in an executor's heap; RocksDB has them on its disk, and 128 MB in memory.
#: fallocate would set aside several MB of disk for each of the many stores.
_ON_DISK = {f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STATE}rocksdb.boundedMemoryUsage": "true", f"{_STATE}rocksdb.maxMemoryUsageMB": "128", f"{_STATE}rocksdb.allowFAllocate": "false"}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start within keep their state on the executors' disks, unless the session names a store of its own.

    A stream has its own settings once it has started, so the session's are put back. One that goes on from a state
    that another store wrote keeps that store.
    """
    ours = {} if spark.conf.get(f"{_STATE}providerClass", None) else {k: v for k, v in _ON_DISK.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


def run_available(documents: DataFrame, folder: str) -> list[dict]:
    """Appends what is closed by now to Parquet below a folder, state beside it; a later call goes on from there.

    Returns the progress of the batches that this call ran.
    """
    to = documents.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    with state_on_disk(documents.sparkSession):
        q = to.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in q.recentProgress]


def late_rows(progress: list[dict]) -> int:
    """Rows that came behind the watermark of the first stateful step that met them."""
    return sum(max((s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), default=0) for p in progress)
