"""Rows by their place in the Parquet files that hold them: keys for verdicts, and filters that don't move rows.

A row's key is made of its file's number and its index there, which every read of the same files gives
alike. Keys travel, texts stay: the keys of rows that go become bitmaps of the files, one bit a row, and
each scan drops its own rows by them. The bitmaps are broadcast; where they would be more than
``_MAPS`` at once, the files are read in several scans, each with the bitmaps of its own files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.common import small, whole, written

#: Bits of a key for the row's index in its file; numbers of files have the rest.
_ROW_BITS = 40
#: Rows of one bitmap, of 4 KB, and the most bitmaps in a broadcast (64 MB).
_MAP_BITS = 15
_MAPS = 16_384


def placed(docs: DataFrame) -> DataFrame:
    """docs itself if its rows come straight from Parquet files, else a written copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return written(docs, "placed")


def _file(docs: DataFrame) -> Column:
    return docs.metadataColumn("_metadata")["file_path"]


def files(docs: DataFrame) -> DataFrame:
    """file, number: the files of the rows in the order of their names; one row a file."""
    names = docs.select(_file(docs).alias("file")).distinct()
    return written(names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number")), "files")


def keyed(docs: DataFrame, numbers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of docs, with each row's key as ``key`` in place of a column of that name."""
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(*(c for c in columns if c != key), meta["file_path"].alias("of file"), meta["row_index"].alias("at row"))
    found = rows.join(small(numbers, 1_000_000), rows["of file"] == numbers["file"])
    return found.select((F.shiftleft("number", _ROW_BITS) + F.col("at row")).alias(key), *(c for c in columns if c != key))


def _bit(maps: Column, at: Column) -> Column:
    """The bit of a bitmap, 0 where there is none."""
    byte = F.conv(F.hex(F.substring(maps, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2, F.lit(0))


def among(rows: DataFrame, key: str, ids: DataFrame, few: int = 1_000_000, most: int = 100_000_000) -> DataFrame:
    """The rows whose key is in the one column of ``ids``, and some others by chance; rows are not shuffled.

    Few ids are broadcast. More become a bitmap by their hash, of 16 or 64 MB, which lets through some others: a
    quarter of them at worst. Beyond ``most`` ids Spark joins by shuffling.
    """
    n = ids.count()
    if n <= few or n > most:
        return rows.join(F.broadcast(ids) if n <= few else ids, key, "left_semi")
    slots = 1 << (27 if n <= most // 10 else 29) - _MAP_BITS
    place = lambda c: F.pmod(F.xxhash64(c.cast("bigint"), F.lit(23)), F.lit(slots << _MAP_BITS))
    own = place(F.col(ids.columns[0]))
    maps = ids.groupBy(F.shiftright(own, _MAP_BITS).alias("in slot")).agg(F.bitmap_construct_agg(own.bitwiseAND((1 << _MAP_BITS) - 1)).alias("id map"))
    asked = place(F.col(key))
    hit = rows.withColumn("at place", asked).join(F.broadcast(written(maps, "id-maps")), F.shiftright("at place", _MAP_BITS) == F.col("in slot"))
    return hit.filter(_bit(F.col("id map"), F.col("at place").bitwiseAND((1 << _MAP_BITS) - 1)) == 1).select(*rows.columns)


def without(docs: DataFrame, numbers: DataFrame, gone: DataFrame, most: int = _MAPS) -> DataFrame:
    """docs without the rows whose keys are in the one column of ``gone``; no row of docs is shuffled."""
    columns = docs.columns
    key = F.col(gone.columns[0])
    slot = F.shiftright(key, _MAP_BITS)
    maps = gone.groupBy(F.shiftright(slot, _ROW_BITS - _MAP_BITS).alias("in file"), slot.alias("slot")).agg(F.bitmap_construct_agg(key.bitwiseAND((1 << _MAP_BITS) - 1)).alias("map"))
    maps = written(maps, "gone")
    total = maps.count()
    if not total:
        return docs
    # the first file of each scan: one row for each ``most`` bitmaps
    per_file = maps.groupBy(F.col("in file").alias("number")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    scan = per_file.select("number", F.floor(F.coalesce(before, F.lit(0)) / most).alias("scan")).groupBy("scan").agg(F.min("number").alias("number"))
    starts = [(r["file"], r["number"]) for r in scan.join(numbers, "number").orderBy("number").collect()] if total > most else [(None, None)]

    def part(first: tuple, after: tuple | None) -> DataFrame:
        path, own, mine = _file(docs), docs, maps
        if first != starts[0]:
            own, mine = own.filter(path >= first[0]), mine.filter(F.col("in file") >= first[1])
        if after:
            own, mine = own.filter(path < after[0]), mine.filter(F.col("in file") < after[1])
        meta = docs.metadataColumn("_metadata")
        rows = own.select(F.struct(*whole(columns)).alias("whole row"), meta["file_path"].alias("of file"), meta["row_index"].alias("at row"))
        rows = rows.join(small(numbers, 1_000_000), rows["of file"] == numbers["file"])
        rows = rows.withColumn("row slot", F.shiftright(F.shiftleft("number", _ROW_BITS) + F.col("at row"), _MAP_BITS))
        hit = rows.join(F.broadcast(mine), rows["row slot"] == mine["slot"], "left")
        return hit.filter(_bit(F.col("map"), F.col("at row").bitwiseAND((1 << _MAP_BITS) - 1)) == 0).select("whole row.*")

    return reduce(DataFrame.unionAll, (part(a, b) for a, b in zip(starts, [*starts[1:], None])))
