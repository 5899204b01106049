"""Reading comment exports: plain CSV, and CSV whose lines were quoted as a whole."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.sources import csv_ranges

COLUMNS = ("datetime", "author", "group", "comment")


def source_of(path: Column, unknown: str = "unknown") -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.when(low.contains("youtube"), "youtube").when(low.contains("telegram"), "telegram").otherwise(unknown)


def fill_source(df: DataFrame) -> DataFrame:
    """source in lower case, filled from source_file, then source_path; rows that stay without one go."""
    parts = [F.nullif(F.lower(F.trim(F.coalesce("source", F.lit("")))), F.lit(""))] if "source" in df.columns else []
    parts += [F.nullif(source_of(F.col(c), ""), F.lit("")) for c in ("source_file", "source_path") if c in df.columns]
    return df.withColumn("source", F.coalesce(*parts) if parts else F.lit(None).cast("string")).filter(F.col("source").isNotNull())


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """The four required columns as text; records that don't fit are dropped. Large files are read in many ranges."""
    rows, names = csv_ranges.read(spark, path)
    columns = {c.lstrip("﻿").strip(): c for c in names}
    missing = [c for c in COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return rows.filter(~F.col("malformed")).select(*(F.col("fields")[columns[c]].alias(c) for c in COLUMNS))


def repair_line(line: Column) -> Column:
    """struct of the four fields, or null: an outer pair of quotes with doubled inner ones is undone, and
    whatever follows the third comma is one comment."""

    @F.pandas_udf("array<string>")
    def fields(lines: pd.Series) -> pd.Series:
        csv.field_size_limit(sys.maxsize)  # a comment may be of any length
        return lines.map(lambda x: next(csv.reader([x]), []) if x else [])

    bare = F.trim(line)
    whole = bare.rlike(r'(?s)^".*"$') & bare.contains('""')
    undone = F.when(whole, F.replace(F.regexp_replace(bare, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(bare)
    got = fields(undone)
    parts = F.struct(*(F.get(got, F.lit(k)).alias(c) for k, c in enumerate(COLUMNS[:3])), F.array_join(F.slice(got, 4, 1_000_000), ",").alias("comment"))
    return F.when((bare != "") & (F.size(got) >= 4), parts)


def read_broken(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(repair_line(F.col("value")).alias("p")).filter(F.col("p").isNotNull()).select("p.*")
    return lines.filter(~((F.lower(F.trim("datetime")) == "datetime") & (F.lower(F.trim("comment")) == "comment")) & (F.trim("comment") != ""))


def read_comments(spark: SparkSession, inputs: Iterable[Mapping[str, str]], max_rows: int | None = None) -> DataFrame:
    """inputs: {path, source}. Files named youtube_* are read as broken lines. ``max_rows`` is a limit on all."""
    out: DataFrame | None = None
    for item in inputs:
        path = item["path"]
        name = path.rstrip("/").rsplit("/", 1)[-1]
        one = (read_broken if name.startswith("youtube_") else read_plain)(spark, path).withColumn("source", F.lit(item["source"]) if item.get("source") else source_of(F.lit(name)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no inputs")
    return out if max_rows is None else out.limit(max_rows)
