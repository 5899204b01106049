"""Operator 7: token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles
and truncated totals for every context limit. A null text is empty and has length 0; very long texts
are encoded whole; repeated rows and ids count each, and documents of equal length are one row of the
histogram; an empty table gives an empty histogram, and no limits or quantiles. Other columns, whatever
their names, have no part in it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.bpe import encoder
from corpus_spark.llm.common import map_slices, written


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens."""

    def work(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "n_tokens": [len(x) // 4 for x in encoder(tokenizer).encode(part.column("text").to_pylist())]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """length, n_docs. As many rows as there are different lengths."""
    return counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = 1024) -> DataFrame:
    """Per length l: docs and tokens in documents of at least l, those of all shorter ones, and the
    tokens that remain if every document is cut at l; share_up_to, of which l is the quantile.

    Sums run within blocks of lengths; the totals of blocks, one row each, are summed before.
    """
    hist = written(hist.withColumn("block", F.floor(F.col("length") / block)), "histogram")
    down = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = blocks.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_later"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("all_tokens"))
    docs, tokens = F.col("d_later") + F.sum("n_docs").over(within), F.col("t_later") + F.sum(F.col("n_docs") * F.col("length")).over(within)
    return (
        hist.join(later, "block").crossJoin(F.broadcast(totals))
        .select("length", "n_docs", docs.alias("docs_from"), tokens.alias("tokens_from"), "all_docs", "all_tokens")
        .select("length", "n_docs", "docs_from", "tokens_from", (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_up_to"), (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("tokens_cut_here"), ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"), "all_docs", "all_tokens")
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_docs, total_tokens, n_longer, truncated_total for each context limit.

    Each limit is looked up in the suffix sums: the shortest length above it says how many documents are
    longer and how many tokens they have. One aggregate, with a value a limit.
    """
    above = lambda x: F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") > x, F.col("length")))
    one = sums.agg(F.max("all_docs").alias("n_docs"), F.max("all_tokens").alias("total_tokens"), F.array(*(F.struct(F.lit(int(x)).cast("long").alias("limit"), above(x).alias("s")) for x in limits)).alias("asked"))
    docs, tokens = F.coalesce("a.s.docs_from", F.lit(0)), F.coalesce("a.s.tokens_from", F.lit(0))
    each = one.filter("n_docs is not null").select("n_docs", "total_tokens", F.explode("asked").alias("a"))
    return each.select("a.limit", "n_docs", "total_tokens", docs.alias("n_longer"), (F.col("total_tokens") - tokens + docs * F.col("a.limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the shortest length that at least this share of documents doesn't exceed."""
    first = lambda x: F.min(F.when(F.col("docs_up_to") >= x * F.col("all_docs"), F.col("length")))
    one = sums.agg(F.array(*(F.struct(F.lit(float(x)).alias("share"), first(x).alias("length")) for x in shares)).alias("asked"))
    return one.select(F.explode("asked").alias("a")).select("a.*").filter("length is not null")
