"""Operator 5: best-fit packing, certified by dual-feasible-function lower bounds.

Documents become pieces of at most ``capacity`` tokens. Partitions of bounded size are packed by
best-fit decreasing. Each is held against a lower bound, the largest sum of a dual feasible function
over its pieces; gap is what it has above the bound, and a partition without gap is certified. Full
bins stay. While the whole table has more bins than its own bound, open bins are exchanged: those of
partitions with a gap, then those of all, are dealt out anew over fewer and larger partitions and
packed again, down to one partition if a task can hold them, and all bins at last if a task can hold
the table. A round that saves no bin is thrown away. What remains above the bound is in table_gap.

Pieces are dealt by a hash of their values, and a task packs them in an order of their values, so the
result does not depend on where rows were read or on which executors were lost. Rows that are equal in
all columns travel as runs with their number, at most a sixteenth of a task each.

Null text is empty and is one piece, the end token alone; very long texts are cut into many pieces.
Rows that repeat, or have equal ids, are packed each. Pieces of equal length go in the order of that
hash. An empty table gives no rows. Other columns of documents, whatever their names, have no part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.bpe import encoder
from corpus_spark.llm.common import discard, map_slices, whole, written

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Longer documents are cut; their first piece is the short one."""

    def work(part: pa.RecordBatch) -> dict:
        of, rows = [], []
        for i, raw in enumerate(encoder(tokenizer).encode(part.column("text").to_pylist())):
            raw += b"\0\0\0\0"
            n = len(raw) // 4
            start, length, k = 0, n % capacity or min(n, capacity), 0
            while start < n:
                of.append(i)
                rows.append((k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                start, length, k = start + length, capacity, k + 1
        return {"doc_id": part.column("doc_id").take(pa.array(of)), **dict(zip(("piece", "start", "length", "ids_crc32"), zip(*rows)))}

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that could hold the pieces, by two families of dual feasible functions.

    The first rounds pieces above capacity - e up to a whole bin and those below e down to nothing;
    the second rounds l to floor((k+1) l / capacity) / k where (k+1) l is no multiple of capacity.
    """
    if not len(lengths):
        return 0
    total = int((lengths * counts).sum())
    best = -(-total // capacity)
    order = np.argsort(lengths)
    v, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    below = np.r_[0, np.cumsum(v * c)]  # tokens in the shortest pieces
    above = np.r_[0, np.cumsum(c)]
    for e in range(1, capacity // 2 + 1):
        lo, hi = np.searchsorted(v, e), np.searchsorted(v, capacity - e, side="right")
        best = max(best, int(above[-1] - above[hi]) + -(-int(below[hi] - below[lo]) // capacity))
    for k in range(1, 32):
        x = (k + 1) * v
        times_k = np.where(x % capacity == 0, k * v * (k + 1) // capacity * 1, (x // capacity) * (k + 1))
        # both branches over the common denominator k (k + 1)
        best = max(best, -(-int((times_k * c).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the room left in each bin.

    Bins are stacked by the room they have; a bit mask over rooms finds the smallest that fits.
    """
    bin_of, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bin_of[i], offset[i] = b, capacity - r
        room[b] = r = r - n
        if r:
            stacks[r].append(b)
            mask |= 1 << r
    return bin_of, offset, room


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = 50_000, most: int = 1_000_000) -> DataFrame:
    """Adds sequence_id, offset, gap, certified and table_gap to rows with a length from 1 to ``capacity``.

    gap: bins above the lower bound of the partition that packed the row; table_gap: bins of the whole table
    above the table's bound; certified: one of both is 0. The first tasks hold about ``per_task`` rows, those of an
    exchange up to ``most``.
    """
    names = items.columns
    own = whole(names)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id bigint, offset bigint, room bigint, gap bigint"

    def packer(salt: int):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            some = [p for p in parts if p.num_rows]
            if not some:
                return
            held = pa.Table.from_batches(some)
            lengths, at, nth, times = (held.column(c).to_numpy() for c in ("length", "row's hash", "row's run", "row's times"))
            order = np.lexsort((nth, at, -lengths))
            order = np.repeat(order, times[order])
            bins, offset, room = best_fit_decreasing(lengths[order], capacity)
            v, c = np.unique(lengths[order], return_counts=True)
            gap = len(room) - lower_bound(v, c, capacity)
            base = (salt << 56) + (TaskContext.get().partitionId() << 32)
            out = held.select(names).take(pa.array(order))
            for name, values in (("sequence_id", base + bins), ("offset", offset), ("room", np.array(room, dtype=np.int64)[bins]), ("gap", np.full(len(order), gap, dtype=np.int64))):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield from out.to_batches(max_chunksize=10_000)

        return run

    def packed(df: DataFrame, salt: int, tasks: int, run: int) -> DataFrame:
        """Equal rows travel as runs with their number; where a run goes, its values and its number in the row tell."""
        times = df.select(*own).groupBy(*own).agg(F.count("*").alias("row's times"))
        runs = times.withColumn("row's run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("row's times") - 1) / run))))
        runs = runs.withColumn("row's times", F.least(F.lit(run), F.col("row's times") - F.col("row's run") * run)).withColumn("row's hash", F.xxhash64(*own))
        return written(runs.repartition(tasks, F.xxhash64(F.lit(salt), F.col("row's hash"), F.col("row's run"))).mapInArrow(packer(salt), out_schema), "packed")

    def count(df: DataFrame) -> tuple[int, int]:
        got = df.agg(F.count_if(F.col("offset") == 0).alias("bins"), F.count("*").alias("pieces")).first()
        return got["bins"], got["pieces"]

    sizes = items.groupBy("length").count().toPandas()  # at most ``capacity`` rows
    bound, total = lower_bound(sizes["length"].to_numpy(np.int64), sizes["count"].to_numpy(np.int64), capacity), int(sizes["count"].sum())
    tables = [packed(items, 0, max(1, -(-total // per_task)), max(1, per_task // 16))]
    used = count(tables[0])[0]
    # open bins of partitions with a gap, then all open bins, over fewer and larger partitions; at last all bins, if one task can hold them
    loose, all_open = (F.col("room") > 0) & (F.col("gap") > 0), F.col("room") > 0
    larger = [min(per_task * 4**k, most) for k in range(1, 64) if per_task * 4 ** (k - 1) < most] or [most]
    tries = [(choice, size) for choice in (loose, all_open) for size in larger] + [(F.lit(True), most)] * (total <= most)
    salt, before = 0, None
    while used > bound and tries:
        choice, size = tries[0]
        # every table is narrow: ids and lengths of pieces
        moving = reduce(DataFrame.unionByName, (t.filter(choice) for t in tables))
        bins, n = count(moving)
        tasks = max(1, -(-n // size))
        if not n or (tasks, n) == before and tasks == 1:  # what one task has packed, it packs alike again
            tries.pop(0)
            continue
        salt += 1
        again = packed(moving, salt, tasks, max(1, min(n, size) // 16))
        saved = bins - count(again)[0]
        before = (tasks, n) if saved <= 0 else None
        if saved > 0:
            tables = [*(t.filter(~choice) for t in tables), again]
            used -= saved
        else:
            discard(again)
        if saved < (used + saved - bound) / 5:  # a round that closes a fifth of the gap is tried again with other partitions
            tries.pop(0)
    result = reduce(DataFrame.unionByName, tables)
    return result.drop("room").withColumns({"certified": (F.col("gap") == 0) | F.lit(used <= bound), "table_gap": F.lit(used - bound).cast("long")})


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap, certified, table_gap."""
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
