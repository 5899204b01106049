"""Reproducible samples: rows are ordered by a hash of (seed, row id), whatever their partitions.

The hash is md5 over ``seed:id``, so that the order can be checked in any other engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.functions.lists import primary
from corpus_spark.sources.scratch import written

STRATA = ("source", "month", "toponym", "theme", "sentiment", "topic_id")


def dice(seed: int, row_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary"))


#: Hash digits of one step of the search for a threshold: 65,536 counts at most reach the driver. A null id comes before all.
_DIGITS, _NULL = 4, "!" * 32


def _slim(df: DataFrame, seed: int, row_id: str, *more: Column | str) -> DataFrame:
    """Ids, their hashes and what else is asked for, written once; texts stay where they are."""
    return written(df.select(row_id, F.coalesce(dice(seed, row_id), F.lit(_NULL)).alias("_h"), *more), "dice")


def nth(slim: DataFrame, n: int, row_id: str, few: int = 4096) -> tuple[str, object, int, int] | None:
    """Hash and id of the n-th row in the order of (_h, row_id); how many of its equals belong to the n, and how many there are.

    None if there are no more than n rows. Counts of hash prefixes narrow the place down, from 65,536 classes to
    one and on within it, until few rows are left: nothing is sorted, and no task gets more than a class.
    """
    prefix, left, size = "", n, None
    while size is None or size > few and len(prefix) < 32:
        own = slim.filter(F.col("_h").startswith(prefix)) if prefix else slim
        counts = sorted(own.groupBy(F.substring("_h", len(prefix) + 1, _DIGITS).alias("p")).count().collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return None
        for p, size in counts:
            if left <= size:
                prefix += p
                break
            left -= size
    rows = slim.filter(F.col("_h").startswith(prefix)).groupBy("_h", row_id).count().collect()
    for h, i, c in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0)):
        if left <= c:
            return h, i, left, c
        left -= c
    raise AssertionError("counts changed between two reads")


def _first(df: DataFrame, hashed: Column, edge: tuple[str, object, int, int] | None, row_id: str) -> DataFrame:
    """The rows up to an edge found by nth(): a narrow filter, but where repeated ids stand at the edge."""
    if edge is None:
        return df
    h, i, taken, size = edge
    same = (hashed == h) & (F.col(row_id).isNull() if i is None else F.col(row_id) == F.lit(i))
    below = hashed < h
    if i is not None:
        below = below | (hashed == h) & F.coalesce(F.col(row_id) < F.lit(i), F.lit(True))
    return df.filter(below | same) if taken == size else df.filter(below).unionByName(df.filter(same).limit(taken))


def simple(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """n rows at random: those up to the n-th smallest hash, which counts of hash prefixes find. No order, no shuffle of rows."""
    if n <= 0:
        return df.filter(F.lit(False))
    return _first(df, F.coalesce(dice(seed, row_id), F.lit(_NULL)), nth(_slim(df, seed, row_id), n, row_id), row_id)


def first_by_hash(slim: DataFrame, keys: Sequence[str], k: int, row_id: str) -> DataFrame:
    """The k rows of each group with the smallest (_h, row_id).

    Counts by hash prefix tell each group's last class; classes below are taken whole, and only rows of the last
    one are ranked, so that a large group is never in one task. Null keys are groups.
    """
    bins = slim.groupBy(*keys, F.substring("_h", 1, _DIGITS).alias("_bin")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))
    edge = bins.withColumn("_upto", upto).filter((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k))
    edge = written(edge.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("_bin").alias("_edge"), (k - F.col("_upto") + F.col("_n")).alias("_left")), "edges")
    on = [slim[c].eqNullSafe(edge[f"_of_{c}"]) for c in keys]
    placed = slim.join(F.broadcast(edge) if edge.count() <= 200_000 else edge, on, "left")
    own = F.substring("_h", 1, _DIGITS)
    sure = placed.filter(F.col("_edge").isNull() | (own < F.col("_edge"))).select(*slim.columns)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", row_id))
    return sure.unionByName(placed.filter(own == F.col("_edge")).withColumn("_r", rank).filter(F.col("_r") <= F.col("_left")).select(*slim.columns))


def _topped_up(slim: DataFrame, keys: Sequence[str], quota: int, n: int, row_id: str) -> DataFrame:
    """Ids of ``quota`` rows of each group, topped up from the rest, n at most; all by their hashes."""
    taken = written(first_by_hash(slim, keys, quota, row_id).select(row_id, "_h"), "taken")
    have = taken.count()
    if have >= n:
        return _first(taken, F.col("_h"), nth(taken, n, row_id), row_id).select(row_id)
    rest = written(slim.join(taken.select(row_id), row_id, "left_anti").select(row_id, "_h"), "rest")
    return taken.select(row_id).unionByName(_first(rest, F.col("_h"), nth(rest, n - have, row_id), row_id).select(row_id))


def by_place(df: DataFrame, place: str, n: int, seed: int, row_id: str, column: str = "toponyms") -> DataFrame:
    return simple(df.filter(F.array_contains(column, place)), n, seed, row_id)


def first_in_groups(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows of each group; the rank is cut in each task before the shuffle. Null keys are groups."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def equal_quota(df: DataFrame, keys: Sequence[str], n: int, seed: int, row_id: str) -> DataFrame:
    """max(1, n // groups) rows of each group, topped up from the rest, n rows at most.

    Rows travel as (keys, id); the texts are joined back to the chosen ids only.
    """
    slim = _slim(df, seed, row_id, *keys)
    groups = slim.groupBy(*keys).agg(F.lit(1)).count()
    return df.join(_bounded(_topped_up(slim, keys, max(1, n // max(1, groups)), n, row_id), n), row_id, "left_semi")


def _bounded(chosen: DataFrame, n: int) -> DataFrame:
    """At most n ids: broadcast if that is few, and then looked up below what makes the other columns."""
    return F.broadcast(chosen) if n <= 100_000 else chosen


def two_way(df: DataFrame, second: str, n: int, seed: int, row_id: str, column: str = "toponyms") -> DataFrame:
    """Strata of the first place name and a second key."""
    return equal_quota(df.withColumn("toponym_primary", primary(F.col(column))), ["toponym_primary", second], n, seed, row_id)


def strata(df: DataFrame, n: int, seed: int, row_id: str, columns: Sequence[str] = STRATA, unique: Sequence[str] = ()) -> DataFrame:
    """One row of each full stratum, topped up from the rest, cut to n, and only then freed of repeats."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return simple(df, n, seed, row_id)
    key = F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("__na__")) for c in have))
    slim = _slim(df, seed, row_id, key.alias("_s"))
    out = df.join(_bounded(_topped_up(slim, ["_s"], 1, n, row_id), n), row_id, "left_semi")
    return first_in_groups(out, list(unique), 1, [row_id]) if unique else out


def coding_sample(df: DataFrame, n: int, seed: int, row_id: str, place: str | None = None, manual: Sequence[str] = ("manual_code", "memo", "coder_id"), columns: Sequence[str] = STRATA) -> DataFrame:
    """A strata() sample with a sample_id and blank columns for coders, of one place if asked."""
    rows = df.filter(F.array_contains("toponyms", place)) if place else df
    out = strata(rows, n, seed, row_id, columns)
    return out.select(F.concat(F.lit("sample_"), F.col(row_id).cast("string")).alias("sample_id"), "*", *(F.lit("").alias(c) for c in manual))


def per_place(mentioned: DataFrame, k: int, seed: int, row_id: str, top: DataFrame | None = None) -> DataFrame:
    """k random rows of each place, or of each of the top places, with an evidence_id."""
    rows = mentioned if top is None else mentioned.join(top.select("toponym"), "toponym", "left_semi")
    rank = F.row_number().over(Window.partitionBy("toponym").orderBy(dice(seed, row_id), row_id))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= k).withColumn("evidence_id", F.concat(F.lit("E"), F.col("_r").cast("string"))).drop("_r")


def evidence(df: DataFrame, label: str, k: int, row_id: str, text: str = "text", chars: int = 500) -> DataFrame:
    """The first k rows of each class, with an id and their text cut."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(row_id))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).select(F.concat(F.lit("E"), F.col("_r").cast("string")).alias("evidence_id"), label, row_id, F.substring(text, 1, chars).alias("text"))


def matching(df: DataFrame, **values) -> DataFrame:
    """Equality filters on any columns, compared as text; empty values don't filter."""
    for column, value in values.items():
        if value not in (None, ""):
            df = df.filter(F.col(column).cast("string") == str(value))
    return df


def annotation_template(df: DataFrame, columns: Sequence[str], coder: str, row_id: str) -> DataFrame:
    """annotation_id in the order of the row id, the schema's columns in order (missing ones blank), the coder's id."""
    from corpus_spark.operators.windows import number

    have = df.withColumns({c: F.lit("") for c in columns if c not in df.columns and c not in ("annotation_id", "coder_id", row_id)})
    numbered = number(have, "ann_%08d", (row_id,), "annotation_id")
    return numbered.withColumn("coder_id", F.lit(coder)).select("annotation_id", "coder_id", *[c for c in columns if c not in ("annotation_id", "coder_id")])
