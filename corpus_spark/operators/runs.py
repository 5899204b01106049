"""Exploring tables and comparing the results of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Alias columns of the evidence keys.
ALIASES = {
    "toponym": ("toponym", "toponyms", "place"),
    "driver": ("theme", "driver", "category"),
    "sentiment": ("sentiment",),
    "topic": ("topic_id", "topic"),
    "source": ("source", "source_path", "source_file"),
}
TEXTS = ("text", "excerpt", "comment", "clean_text", "quote")


def search(df: DataFrame, words: str, n: int) -> DataFrame:
    """Rows with a substring in any column, in lower case; it stops at n."""
    low = words.strip().lower()
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False))
    return df.filter(hit).limit(n)


def filter_evidence(df: DataFrame, wanted: Mapping[str, str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Every key must occur in one of its alias columns; a key without any column leaves nothing."""
    for key, value in wanted.items():
        low = value.strip().lower()
        if low:
            hit = F.lit(False)
            for c in [c for c in aliases.get(key, (key,)) if c in df.columns]:
                hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False))
            df = df.filter(hit)
    return df


def latest(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest run of each key and how many there were; a partial aggregate, no sort."""
    own = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*own), F.struct("run_time", "run_id")).alias("r"), F.count("*").alias("run_count")).select(*keys, "r.*", "run_count")


def hypothesis_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def series(runs: DataFrame, key: str, n: int) -> DataFrame:
    """The last n runs of each key in time order, with the parameters that changed since the run before."""
    recent = runs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("run_time"), F.desc("run_id")))).filter(F.col("_r") <= n)
    order = Window.partitionBy(key).orderBy("run_time", "run_id")
    before = recent.withColumns({"step": F.row_number().over(order), "before": F.lag("params").over(order)})
    names = F.array_sort(F.array_union(F.map_keys("params"), F.map_keys(F.coalesce("before", "params"))))
    changed = F.filter(names, lambda k: ~F.element_at("params", k).eqNullSafe(F.element_at("before", k)))
    return before.withColumn("changed_params", F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(changed)).drop("_r", "before")


def compare_params(a: DataFrame, b: DataFrame) -> DataFrame:
    """param, a_value, b_value, same: a full join of two runs' parameters."""
    left, right = (df.select(F.explode("params").alias("param", f"{x}_value")) for df, x in ((a, "a"), (b, "b")))
    return left.join(right, "param", "full").withColumn("same", F.col("a_value").eqNullSafe(F.col("b_value")))


def table_profile(df: DataFrame, label: str, value: str) -> DataFrame:
    """row_count, top_label, top_value."""
    best = F.max(F.struct(F.col(value).alias("v"), F.col(label).alias("l")))
    return df.agg(F.count("*").alias("row_count"), best.alias("b")).select("row_count", F.col("b.l").alias("top_label"), F.col("b.v").cast("double").alias("top_value"))


def compare_tables(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """profiles: run_id, table, row_count, top_label, top_value. One row a table of either run."""
    left, right = (profiles.filter(F.col("run_id") == r).select("table", *(F.col(c).alias(f"{x}_{c}") for c in ("row_count", "top_label", "top_value"))) for r, x in ((a, "a"), (b, "b")))
    return left.join(right, "table", "full").withColumn("delta", F.col("a_top_value") - F.col("b_top_value"))


def hypothesis_matrix(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a hypothesis, one column a metric, from (hypothesis, metric, value)."""
    return metrics.groupBy("hypothesis").pivot("metric", list(names)).agg(F.max("value"))


def metric_delta(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """metric, a_value, b_value, delta for two hypotheses."""
    of = lambda h, name: F.max(F.when(F.col("hypothesis") == h, F.col("value"))).alias(name)
    return metrics.filter(F.col("hypothesis").isin(a, b)).groupBy("metric").agg(of(a, "a_value"), of(b, "b_value")).withColumn("delta", F.col("a_value") - F.col("b_value"))


def outcomes(sessions: DataFrame, limit: int = 5, top: int = 5) -> DataFrame:
    """sessions: hypothesis, key_table_count, evidence_count, run_count, changed_params_count."""
    part = lambda c, most: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(most)) / float(most)
    cover = (part("key_table_count", 4) + part("evidence_count", 6)) / 2
    score = F.least(F.greatest(0.5 * cover + 0.4 * part("run_count", max(1, limit)) - 0.1 * part("changed_params_count", 8), F.lit(0.0)), F.lit(1.0))
    status = F.when(score >= 0.65, "stable").when(score >= 0.45, "candidate").otherwise("needs_review")
    rows = sessions.select("*", F.bround(cover, 3).alias("coverage_ratio"), F.bround(score, 3).alias("outcome_score"), status.alias("status"))
    return rows.orderBy(F.desc("outcome_score"), F.desc("run_count"), F.desc("coverage_ratio"), "hypothesis").limit(top)


def snippets(df: DataFrame, n: int = 10, chars: int = 500, texts: Sequence[str] = TEXTS) -> DataFrame:
    """The first text that isn't blank among alias columns, cut, of n rows at most."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in texts if c in df.columns]
    text = F.coalesce(*have) if have else F.lit(None).cast("string")
    return df.select("*", F.substring(text, 1, chars).alias("snippet")).filter(F.col("snippet").isNotNull()).limit(n)
