"""Counts and shares. A share is the count over the sum of counts of its parent key, or of everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakdown(df: DataFrame, child: str | Sequence[str], parent: str | Sequence[str] = (), drop_nulls: bool = True, weight: str | None = None) -> DataFrame:
    """parent keys, child keys, count, share. Counting shrinks the rows in each task before the shuffle.

    ``weight`` names a column of counts, where rows were counted before.
    """
    children = [child] if isinstance(child, str) else list(child)
    parents = [parent] if isinstance(parent, str) else list(parent)
    keys = [*parents, *children]
    # a filter on the keys would be moved below what computes them, and computes them again; one on counts stays
    whole = F.lit(True)
    for k in keys if drop_nulls else ():
        whole = whole & F.col(k).isNotNull()
    number = F.count_if(whole) if weight is None else F.coalesce(F.sum(F.when(whole, F.col(weight))), F.lit(0))
    counts = df.groupBy(*keys).agg(number.alias("count")).filter(F.col("count") > 0)
    if parents:
        return counts.withColumn("share", _share(F.sum("count").over(Window.partitionBy(*parents))))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("_total")))).select(*keys, "count", _share(F.col("_total")).alias("share"))


def _share(total: Column) -> Column:
    return F.coalesce(F.try_divide(F.col("count").cast("double"), total), F.lit(0.0))


def closed_distribution(df: DataFrame, column: str, labels: Sequence[str], weight: str | None = None) -> DataFrame:
    """Every label, also those that never occur, with count and share of all."""
    every = df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], f"ord int, {column} string")
    counts = df.groupBy(column).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    rows = every.join(counts, column, "left")
    count = F.coalesce("n", F.lit(0))
    return rows.select("ord", column, count.alias("count")).withColumn("share", F.coalesce(F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy())), F.lit(0.0))).drop("ord")


def place_frequency(mentioned: DataFrame, meta: DataFrame, weight: str | None = None) -> DataFrame:
    return breakdown(mentioned, "toponym", weight=weight).join(meta, "toponym", "left")


def top_places(mentioned: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    return breakdown(mentioned, "toponym", weight=weight).orderBy(F.desc("count"), "toponym").limit(n)


def city_stats(with_meta: DataFrame, weight: str | None = None) -> DataFrame:
    return breakdown(with_meta.filter(F.col("parent_city").isNotNull()), "parent_city", weight=weight)


def district_stats(with_meta: DataFrame, weight: str | None = None) -> DataFrame:
    return breakdown(with_meta.filter(F.col("type") == "district"), "toponym", "parent_city", weight=weight)


def cube(rows: DataFrame, sets: Sequence[Sequence[str]], places: str = "toponyms") -> DataFrame:
    """Counts for several sets of keys in one scan and one shuffle: the keys, toponym, set (its number), docs, said.

    docs counts rows, said their mentions of places; ``toponym`` in a set stands for the mentions' names. Keys that a set
    doesn't have are null in its rows. Blank names are no mentions.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    each = rows.select(*(k for k in keys if k != "toponym"), F.posexplode_outer(places).alias("_at", "toponym"))
    first, named = F.coalesce("_at", F.lit(0)) == 0, F.trim(F.coalesce("toponym", F.lit(""))) != ""
    each = each.withColumns({"_first": first, "_named": named})
    got = each.groupingSets([list(s) for s in sets], *keys).agg(F.grouping_id().alias("_id"), F.count_if("_first").alias("docs"), F.count_if("_named").alias("said"))
    number = {sum((k not in s) << (len(keys) - 1 - i) for i, k in enumerate(keys)): n for n, s in enumerate(sets)}
    which = F.create_map(*(F.lit(x) for pair in number.items() for x in pair))
    return got.withColumn("set", which[F.col("_id").cast("int")]).drop("_id")


def source_comparison(mentioned: DataFrame) -> DataFrame:
    return breakdown(mentioned.select(F.lower(F.coalesce("source", F.lit("unknown"))).alias("source")), "source")


def narrative_matrix(df: DataFrame, column: str, labels: Sequence[str], most: int = 5) -> DataFrame:
    return closed_distribution(df, column, labels).select(column, "count", F.least("count", F.lit(most)).alias("evidence_count"), F.when(F.col("count") > 0, "observed").otherwise("absent").alias("status"))


def value_signals(df: DataFrame, columns: Sequence[str], dataset: str = "dataset", top: int = 20) -> DataFrame:
    """dataset, column, value, count: the most frequent values of each column, missing ones as ``missing``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in columns))
    counts = df.select(dataset, F.explode(pairs).alias("p")).select(dataset, "p.*").groupBy(dataset, "column", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(dataset, "column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def profile(df: DataFrame, date_words: Sequence[str] = ("date", "time", "month", "period", "ts"), samples: int = 5) -> DataFrame:
    """columns, row_count, date_column, first_date, last_date and the first rows of a table in one aggregate.

    sample: ``samples`` rows as JSON, in the order of that text."""
    date = next((c for c in df.columns if any(w in c.lower() for w in date_words)), None)
    when = F.try_to_timestamp(F.col(date).cast("string")) if date else F.lit(None).cast("timestamp")
    some = df.select(F.to_json(F.struct(*df.columns)).alias("row")).orderBy("row").limit(samples).agg(F.array_sort(F.collect_list("row")).alias("sample"))
    told = df.agg(F.count("*").alias("row_count"), F.min(when).alias("first_date"), F.max(when).alias("last_date"))
    return told.crossJoin(F.broadcast(some)).select(F.lit(", ".join(df.columns)).alias("columns"), "row_count", F.lit(date).cast("string").alias("date_column"), "first_date", "last_date", "sample")


def code_frequency(annotations: DataFrame, field: str) -> DataFrame:
    return breakdown(annotations.select(F.coalesce(F.nullif(F.trim(F.col(field).cast("string")), F.lit("")), F.lit("unknown")).alias("code")), "code")


def coding_summary(annotations: DataFrame, memo: str = "memo", memos: int = 20) -> DataFrame:
    """rows, coders, groups, periods and the first memos by annotation id."""
    said = annotations.filter(F.trim(F.coalesce(memo, F.lit(""))) != "").orderBy("annotation_id").limit(memos).agg(F.array_sort(F.collect_list(F.struct("annotation_id", memo))).alias("m")).select(F.transform("m", lambda x: x[memo]).alias("memos"))
    return annotations.agg(F.count("*").alias("n_rows"), *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("coder_id", "group", "period"))).crossJoin(F.broadcast(said))


def code_matrix(df: DataFrame, rows: str, columns: str, normalize: str | None = None) -> DataFrame:
    """Cross-tab of two list fields in long form: row, column, value (a count, or its share of row, column or all)."""
    pairs = df.select(F.explode(rows).alias("row_code"), columns).select("row_code", F.explode(columns).alias("column_code"))
    counts = pairs.groupBy("row_code", "column_code").agg(F.count("*").alias("n"))
    if normalize is None:
        return counts.withColumn("value", F.col("n").cast("double")).drop("n")
    base = {"row": ["row_code"], "column": ["column_code"], "all": []}[normalize]
    return counts.withColumn("value", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*base)))).drop("n")


def wide(shares: DataFrame, row: str, column: str, labels: Sequence, value: str = "share") -> DataFrame:
    """A pivot over labels that are given, so that no extra job looks for them; what is missing is 0."""
    return shares.groupBy(row).pivot(column, list(labels)).agg(F.first(value)).fillna(0)
