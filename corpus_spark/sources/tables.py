"""Tables with lineage, articles, manifests and evidence, and what the workloads write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions.text import safe_name
from corpus_spark.sources import csv_ranges
from corpus_spark.sources.scratch import written

TEXT_COLUMNS = ("text", "clean_text", "comment")


def with_lineage(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV table with source_path, source_file and row_index, the row's place in its file from 0."""
    if path.rstrip("/").endswith(".csv"):
        rows, names = csv_ranges.read(spark, path)
        return rows.select(*(F.col("fields")[c].alias(c) for c in names), F.col("file").alias("source_path"), F.element_at(F.split("file", "/"), -1).alias("source_file"), "row_index")
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))


def text_column(df: DataFrame) -> str | None:
    return next((c for c in TEXT_COLUMNS if c in df.columns), None)


def with_text(df: DataFrame) -> DataFrame | None:
    """Rows whose text isn't blank; None for a table without a text column."""
    c = text_column(df)
    return None if c is None else df.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")


def context(tables: Mapping[str, DataFrame], primary: Sequence[str] = ("documents_enriched", "documents")) -> DataFrame | None:
    """Primary tables if there are any, else all; only those with text; stacked by name, missing columns null."""
    chosen = [df for name, df in tables.items() if name in primary] or list(tables.values())
    out: DataFrame | None = None
    for df in filter(None, map(with_text, chosen)):
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))


def export(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, df in tables.items():
        (df.write.mode("overwrite").parquet(f"{folder}/{name}") if kind == "parquet" else for_csv(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}"))


def export_by_place(mentioned: DataFrame, folder: str, cap: int, row_id: str) -> DataFrame:
    """At most ``cap`` rows a place, one folder a place; returns the manifest (toponym, path, rows)."""
    from corpus_spark.operators.sampling import first_in_groups

    rows = written(first_in_groups(mentioned, ["toponym"], cap, [row_id]).withColumn("place", safe_name(F.col("toponym"))), "by-place")
    for_csv(rows).repartition("place").write.mode("overwrite").option("header", True).partitionBy("place").csv(folder)
    return rows.groupBy("toponym", "place").agg(F.count("*").alias("rows")).select("toponym", F.concat(F.lit(f"{folder}/place="), "place").alias("path"), "rows")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Text articles below a folder: doc_id, path, filename, extension, text, pages. Blank ones are skipped."""
    from corpus_spark.operators.retrieval import plain_pages

    df = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").text(folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"))
    return df.filter(F.trim("text") != "").select(F.concat(F.lit("article_"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 12)).alias("doc_id"), "path", "filename", F.regexp_extract("filename", r"(\.[^.]+)$", 1).alias("extension"), "text", plain_pages(F.col("text")).alias("pages"))


def write_index(chunks: DataFrame, folder: str) -> DataFrame:
    """Chunks with their embeddings as one table; returns a row of counts."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    return chunks.sparkSession.read.parquet(f"{folder}/chunks").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max(F.size("embedding")).alias("dimensions"))


MANIFEST = "experiment: struct<id:string,runner:string>, params: map<string,string>, result: map<string,string>"


def manifests(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Run manifests, latest first: many small JSON files, with or without a byte order mark, of one run or a list of runs.

    ``names`` says which files are manifests. Each file is opened once: what is sorted is a table of what they hold.
    """
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=names).text(path, wholetext=True)
    # a part of the scan is a few dozen small files; tasks take several of them, in proportion to the files
    parts = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 64))
    texts = parts.select(F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("run_time"))
    found = texts.select(F.explode(F.from_json("v", f"array<struct<{MANIFEST}>>")).alias("m"), "path", "run_time").filter(F.col("m.experiment").isNotNull()).select("m.*", "path", "run_time")
    return written(found, "manifests").orderBy(F.desc("run_time"), "path")


def evidence_rows(documents: DataFrame, json: str = "value") -> DataFrame:
    """Rows from evidence documents with evidence_items, evidence or items; nested values stay as JSON text."""
    kind = "array<map<string,string>>"
    got = F.from_json(json, f"evidence_items {kind}, evidence {kind}, items {kind}")
    return documents.select(F.explode(F.coalesce(got["evidence_items"], got["evidence"], got["items"])).alias("item"))
