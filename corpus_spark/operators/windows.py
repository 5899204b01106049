"""Windowed documents: messages of a (source, group) rolled up by tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.functions.text import LANGUAGES
from corpus_spark.sources.scratch import written


def _rows(messages: DataFrame) -> DataFrame:
    """Messages with all the columns that a roll-up reads."""
    source = F.coalesce("source", F.lit("unknown")) if "source" in messages.columns else F.lit("unknown")
    rows = messages.withColumns({"group": F.coalesce("group", F.lit("unknown")), "source": source})
    if "lang" not in rows.columns:
        rows = rows.withColumn("lang", F.lit("other"))
    return rows if "period" in rows.columns else rows.withColumn("period", F.date_format("datetime", "yyyy-MM"))


def _span(width: str, start: str | None):
    return F.window("datetime", width, width, start) if start else F.window("datetime", width)


def roll_up(messages: DataFrame, width: str = "1 hour", start: str | None = None, tiebreak: str = "row_id", text: str = "clean_text") -> DataFrame:
    """source, group, window_start, window_end, period, text, message_count, lang_distribution.

    Text is joined by newlines in time order, ties by ``tiebreak``. The language mix comes from the same
    aggregate, because the set of languages is closed. A null group counts as ``unknown``.
    """
    rows, span = _rows(messages), _span(width, start)
    item = F.struct("datetime", tiebreak, F.col(text).alias("text"), "period")
    langs = [F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in LANGUAGES]
    got = rows.groupBy("source", "group", span.alias("w")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("message_count"), *langs)
    mix = F.create_map(*(x for l in LANGUAGES for x in (F.lit(l), F.bround(F.col(f"n_{l}") / F.col("message_count"), 4))))
    return got.select(
        "source", "group", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.get("items", F.lit(0))["period"].alias("period"),
        F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"), "message_count", F.map_filter(mix, lambda k, v: v > 0).alias("lang_distribution"),
    )


_KEYS = ["source", "group", "window_start", "window_end"]


def roll_up_pieces(messages: DataFrame, width: str = "1 hour", start: str | None = None, tiebreak: str = "row_id", text: str = "clean_text", most: int = 16 << 20, size: str | None = None, span: int = 8 << 20) -> DataFrame:
    """source, group, window_start, window_end, piece, text, message_count: windows in pieces of about ``most`` characters.

    A piece holds the messages that begin within ``most`` characters of the window's text, newlines counted, so no row
    has more than ``most`` characters and one message. Windows that are no longer have one piece, as from ``roll_up``.
    Lengths are placed first, without texts: windows of more than ``span`` characters are cut where a piece begins, about
    every ``span`` characters. Texts are then moved once, to the cut that they lie in, and no task has a whole window.
    ``size`` names a column that has the texts' lengths (null for a null text); if it was made before the messages were
    joined, their lengths move without them.
    """
    length = F.col(size) if size else F.length(text)
    rows = _rows(messages).select("source", "group", _span(width, start).alias("w"), "datetime", tiebreak, F.col(text).alias("text"), F.coalesce(length + 1, F.lit(0)).cast("long").alias("size"))
    rows = rows.select("source", "group", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "datetime", tiebreak, "text", "size")
    order = ["datetime", tiebreak]
    cuts = _cuts(written(rows.drop("text"), "lengths"), order, most, max(most, span)).withColumnsRenamed({k: f"_{k}" for k in _KEYS})
    at = F.struct(*order)
    inside = [*(F.col(k) == F.col(f"_{k}") for k in _KEYS), at >= F.col("low"), F.col("high").isNull() | (at < F.col("high"))]
    placed = rows.join(F.broadcast(cuts), inside, "left").select(*_KEYS, *order, "text", "size", "begin")
    part = Window.partitionBy(*_KEYS, "begin").orderBy(*order)  # of both sums, so that texts are sorted once
    upto = F.coalesce(F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = F.col("begin").isNotNull() | (F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > most)
    placed = placed.withColumn("piece", F.when(long, F.floor((F.coalesce("begin", F.lit(0)) + upto) / most)).otherwise(0))
    # pieces lie within cuts, so they are collected where the lengths were summed
    got = placed.groupBy(*_KEYS, "begin", "piece").agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("items"), F.count("*").alias("message_count"))
    return got.select(*_KEYS, "piece", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"), "message_count")


def _cuts(lengths: DataFrame, order: list[str], most: int, span: int) -> DataFrame:
    """The cuts of windows of more than ``span`` characters: keys, begin (the characters before it), low, high.

    A cut is the first piece of a block of ``span`` characters and what follows it; messages alike in ``order`` stay together.
    Rows are sorted in ranges: a range's length, those before it and the end of the last one give each message its place.
    """
    hot = lengths.groupBy(*_KEYS).agg(F.sum("size").alias("n")).filter(F.col("n") > span).select(*_KEYS)
    ranged = written(lengths.join(F.broadcast(hot), _KEYS, "left_semi").repartitionByRange(*_KEYS, *order).withColumn("range", F.spark_partition_id()), "hot-lengths")
    at, inside, ranges = F.struct(*order), Window.partitionBy(*_KEYS, "range").orderBy(*order), Window.partitionBy(*_KEYS).orderBy("range")
    upto = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.select(*_KEYS, "range", at.alias("at"), "size", upto.alias("upto"), F.lag(at).over(inside).alias("at_before"), F.lag("size").over(inside).alias("size_before"))
    totals = placed.groupBy(*_KEYS, "range").agg(F.sum("size").alias("n"), F.max("upto").alias("last"))
    offset = F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = totals.select(*_KEYS, "range", offset.alias("offset"), (offset - F.lag("n").over(ranges) + F.lag("last").over(ranges)).alias("last_before"))
    begin, before = F.col("offset") + F.col("upto"), F.coalesce(F.col("offset") + F.col("upto") - F.col("size_before"), F.col("last_before"))
    # the first of its window, or of a piece and not a tie of the message before, which can't be in another range
    first = before.isNull() | ((F.floor(begin / most) > F.floor(before / most)) & (F.col("at_before").isNull() | (F.col("at") != F.col("at_before"))))
    firsts = placed.join(ahead, [*_KEYS, "range"]).filter(first).groupBy(*_KEYS, F.floor(begin / span)).agg(F.min(F.struct(begin.alias("begin"), "at")).alias("cut"))
    high = F.lead("cut.at").over(Window.partitionBy(*_KEYS).orderBy("cut"))
    return written(firsts.select(*_KEYS, F.col("cut.begin").alias("begin"), F.col("cut.at").alias("low"), high.alias("high")), "cuts")


def number(documents: DataFrame, template: str = "doc_%08d", keys: tuple[str, ...] = ("source", "group", "window_start"), name: str = "doc_id") -> DataFrame:
    """Dense ids in the order of ``keys``: ranges are sorted apart, and each range starts after the sizes before it.

    The sorted ranges are written once, with the place of each row in its range; the sizes of ranges, one
    row each, are summed and broadcast.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    row = F.monotonically_increasing_id()
    ordered = documents.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.shiftright(row, 33).alias("_range"), row.bitwiseAND((1 << 33) - 1).alias("_at"))
    kept = written(ordered, "numbered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_start"))
    return kept.join(F.broadcast(starts), "_range").select(F.format_string(template, F.col("_start") + F.col("_at")).alias(name), *documents.columns)


def mix_as_json(column: str = "lang_distribution"):
    return F.to_json(column)
