"""CSV records with line breaks inside quotes, read from many ranges of one file at once.

Spark deals a text file out by byte ranges at line ends, but a line may begin inside a quoted field. A
range turns each of two states at its start (outside or inside quotes) into one at its end; these small
maps, one a range, are put together in the order of the ranges and tell how each one starts. Then every
range cuts its own lines into records. What a record has in later ranges is joined to it: one fragment
for each border that stands inside quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_spark.sources.scratch import written

#: A state at the end of each line, from that at its start.
_OUT, _IN = 0, 1


def after_line(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes. A field is quoted if a quote is its first character; two quotes in it are one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at = line.find(",", at + 1)  # what stands behind a closing quote belongs to the field
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(",", at)
        if at < 0:
            return False
        inside, at = False, at + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, line: the lines of files with the place where their range begins."""
    read = spark.read.options(lineSep="\n", recursiveFileLookup=False).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("line"))


def _maps(lines: DataFrame) -> DataFrame:
    """file, begin, from_out, from_in, returns: the state at each range's end for both at its start, and whether its first line ends in CR LF."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, returns = None, [_OUT, _IN], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "begin": [at[1]], "from_out": pa.array([ends[0]], pa.int32()), "from_in": pa.array([ends[1]], pa.int32()), "returns": [returns]})

        for batch in parts:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for file, begin, line in zip(*(part.column(c).to_pylist() for c in ("file", "begin", "line"))):
                    if (file, begin) != at:
                        if at is not None:
                            yield row()
                        at, ends, returns = (file, begin), [_OUT, _IN], line.endswith("\r")
                    if '"' in line:  # others change nothing
                        after = [int(after_line(line, False)), int(after_line(line, True))]
                        ends = [after[s] for s in ends]
        if at is not None:
            yield row()

    return lines.mapInArrow(run, "file string, begin bigint, from_out int, from_in int, returns boolean")


def _starts(maps: DataFrame) -> DataFrame:
    """file, begin, inside, returns: whether each range of a file starts inside quotes, and whether the file's first line ends in CR LF.

    After a range that ends alike from both states nothing before it counts; from there on only the number of
    ranges that turn one state into the other does.
    """
    order = Window.partitionBy("file").orderBy("begin")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    turns = F.when((F.col("from_out") == _IN) & (F.col("from_in") == _OUT), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = maps.withColumns({"fixed": fixed, "all_turns": F.sum(turns).over(order)}).withColumn("mark", F.when(F.col("fixed").isNotNull(), F.struct("fixed", "all_turns")))
    last = F.last("mark", ignorenulls=True).over(upto)
    before = F.coalesce(F.lag("all_turns").over(order), F.lit(0))
    state = (F.coalesce(last["fixed"], F.lit(_OUT)) + before - F.coalesce(last["all_turns"], F.lit(0))) % 2
    return seen.select("file", "begin", (state == _IN).alias("inside"), F.first("returns").over(order).alias("returns"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record_index, record: the records of CSV files as text, numbered from 0 in each file; empty lines are none.

    Where a file's first line ends in CR LF, that is a line break all over the file, and one LF within quotes.

    The scan has a task for each range of ``spark.sql.files.maxPartitionBytes``; the driver holds one row a range.
    """
    lines = _lines(spark, path)
    starts = {(r["file"], r["begin"]): (r["inside"], r["returns"]) for r in _starts(_maps(lines)).collect()}
    shared = spark.sparkContext.broadcast(starts)
    kinds = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("nth", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_()), ("record", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, returns, head, nth, out = None, [], False, False, False, 0, []

        def close(still_open: bool) -> None:
            nonlocal held, head, nth
            text = "\n".join(held)
            if text or head:
                out.append({"file": at[0], "begin": at[1], "nth": -1 if head else nth, "head": head, "open": still_open, "record": text})
                nth += not head
            held, head = [], False

        for batch in parts:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for file, begin, line in zip(*(part.column(c).to_pylist() for c in ("file", "begin", "line"))):
                    if (file, begin) != at:
                        if held:
                            close(True)
                        at, nth = (file, begin), 0
                        if at not in shared.value:
                            raise RuntimeError("the ranges of a file changed between two scans")
                        inside, returns = shared.value[at]
                        head = inside
                    if '"' in line:
                        inside = after_line(line, inside)
                    held.append(line[:-1] if returns and line.endswith("\r") else line)
                    if not inside:
                        close(False)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        if held:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    cut = written(lines.mapInArrow(run, "file string, begin bigint, nth bigint, head boolean, open boolean, record string"), "csv-records")
    whole = cut.filter(~F.col("head") & ~F.col("open")).select("file", "begin", "nth", "record")
    # pieces of records over borders: an open record and the heads of the ranges behind it
    pieces = cut.filter(F.col("head") | F.col("open") & (F.col("nth") >= 0))
    order = Window.partitionBy("file").orderBy("begin", "nth")
    pieces = pieces.withColumn("owner", F.sum((~F.col("head")).cast("int")).over(order))
    joined = pieces.groupBy("file", "owner").agg(F.min(F.struct("begin", "nth")).alias("first"), F.array_sort(F.collect_list(F.struct("begin", "nth", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    # the open record has the least place, for heads come from later ranges
    every = whole.unionByName(joined.select("file", "first.*", text.alias("record")))
    counts = every.groupBy("file", "begin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if offsets.count() <= 200_000:
        offsets = F.broadcast(offsets)
    return every.join(offsets, ["file", "begin"]).select("file", (F.col("offset") + F.col("nth")).alias("record_index"), "record")


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(file, row_index, fields, malformed) of all records behind each file's header, and the names in the first header.

    fields is a struct of texts; malformed are records with more or fewer fields than the header.
    """
    found = records(spark, path)
    if columns is None:
        columns = spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns) + ", `the whole record` string"
    parsed = F.from_csv("record", schema, {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "the whole record", "maxCharsPerColumn": "-1"})
    rows = found.filter(F.col("record_index") > 0).select("file", (F.col("record_index") - 1).alias("row_index"), parsed.alias("fields"))
    return rows.withColumn("malformed", F.col("fields")["the whole record"].isNotNull()), columns
