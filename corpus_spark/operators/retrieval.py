"""Chunks, cosine search, evidence and extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.functions.text import collapse, sentences

#: Queries travel to every task; more than this go in several rounds.
MOST_QUERIES = 10_000
#: Scores that a task holds at once, 8 MB of them; ranking takes a few copies.
MOST_SCORES = 1_000_000


def chunk(documents: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """chunk_id, doc_id, filename, path, page_number, chunk_index, text, char_start, char_end.

    documents: doc_id, filename, path and pages array<struct<page_number,text>>. The index runs on over
    the pages of a document; it is the pages' chunk counts summed, so nothing is shuffled.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    count = lambda t: F.when(F.length(t) == 0, 0).when(F.length(t) <= size, 1).otherwise(F.ceil((F.length(t) - size) / step) + 1).cast("int")
    pages = documents.withColumn("pages", F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), collapse(F.coalesce(p["text"], F.lit(""))).alias("text"))))
    # through a generator, so that texts are collapsed once and not for each column that reads them
    pages = pages.select("doc_id", "filename", "path", F.explode_outer(F.array("pages")).alias("pages"))
    counted = pages.withColumn("counts", F.transform("pages", lambda p: count(p["text"])))
    each = counted.select("doc_id", "filename", "path", "counts", F.posexplode("pages").alias("page", "p"))
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("page")), F.lit(0), lambda a, x: a + x)
    n = F.get("counts", F.col("page"))
    cut = each.select("doc_id", "filename", "path", "p.page_number", F.col("p.text").alias("whole"), before.alias("before"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("k"))
    start = F.col("k") * step
    index = F.col("before") + F.col("k")
    return cut.select(
        F.format_string("%s_%06d", "doc_id", index).alias("chunk_id"), "doc_id", "filename", "path", "page_number", index.alias("chunk_index"),
        F.trim(F.substr("whole", start + 1, F.lit(size))).alias("text"), start.alias("char_start"), F.least(start + size, F.length("whole")).alias("char_end"),
    )


def plain_pages(text: Column) -> Column:
    """A document without pages: one page without number."""
    return F.array(F.struct(F.lit(None).cast("int").alias("page_number"), text.alias("text")))


def joined_pages(pages: Column) -> Column:
    """Text of all pages that aren't blank, with a blank line between."""
    return F.array_join(F.transform(F.filter(pages, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != ""), lambda p: p["text"]), "\n\n")


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _best_of(rows: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, k: int, place: list[str], item_id: str) -> pd.DataFrame:
    """The k best rows of each query, one per place: places are compared by their best row, so copies crowd nobody out."""
    code = rows.groupby(place, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((rows[item_id].to_numpy(), code))
    begin = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    top = np.maximum.reduceat(scores[order], begin, axis=0)
    m = min(k, len(top))
    # ties at the edge of the k best are all kept here; the final rank settles them
    edge = -np.partition(-top, m - 1, axis=0)[m - 1]
    at, of = np.nonzero(top >= edge)
    size = np.diff(np.r_[begin, len(order)])
    first = np.array([begin[g] if size[g] == 1 else begin[g] + int(scores[order[begin[g] : begin[g] + size[g]], q].argmax()) for g, q in zip(at, of)], dtype=np.int64)
    out = rows.iloc[order[first]].reset_index(drop=True)
    out.insert(0, "query_id", ids[of])
    out["score"] = top[at, of]
    return out


def _best_in_turns(rows: pd.DataFrame, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, place: list[str], item_id: str, digits: int | None) -> Iterator[pd.DataFrame]:
    """``_best_of`` for some queries at a time, so that a task never holds the scores of all of them."""
    width = max(1, MOST_SCORES // len(rows))
    for at in range(0, len(ids), width):
        s = x @ q[at : at + width].T
        yield _best_of(rows, s if digits is None else np.round(s, digits), ids[at : at + width], k, place, item_id)


def nearest(items: DataFrame, queries: DataFrame, k: int, item_id: str, location: Sequence[str], vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """query_id, location, item_id, score, rank: the k best by cosine for each query, one per location.

    The queries travel to each task in rounds of about ``MOST_QUERIES``; a task multiplies its rows in
    batches and keeps k places a query, so what is shuffled is at most tasks times queries times k rows,
    but for ties. ``digits`` rounds scores before they are ranked.
    """
    rounds = max(1, -(-queries.count() // MOST_QUERIES))
    found: DataFrame | None = None
    for turn in range(rounds):
        own = queries if rounds == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn)
        one = _nearest(items, own, k, item_id, location, vector, digits)
        found = one if found is None else found.unionByName(one)
    return found


def _nearest(items: DataFrame, queries: DataFrame, k: int, item_id: str, location: Sequence[str], vector: str, digits: int | None) -> DataFrame:
    asked = queries.select("query_id", F.col(vector).alias("v")).toPandas()  # one round of queries
    shared = items.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _unit(asked["v"]) if len(asked) else np.zeros((0, 1))))
    place = [c for c in location if c != item_id]

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        held: pd.DataFrame | None = None
        for pdf in parts:
            for at in range(0, len(pdf) if len(ids) else 0, 2000):
                part = pdf.iloc[at : at + 2000]
                rows = pd.concat(_best_in_turns(part.drop(columns="v"), _unit(part["v"]), ids, q, k, list(location), item_id, digits))
                rows = rows if held is None else pd.concat([held, rows])
                rows = rows.sort_values(["query_id", "score", item_id], ascending=[True, False, True]).drop_duplicates(["query_id", *location])
                held = rows[rows.groupby("query_id").cumcount() < k]
        if held is not None:
            yield held

    kinds = dict(items.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"`{c}` {kinds[c]}" for c in [item_id, *place]) + ", score double"
    found = items.filter(F.col(vector).isNotNull()).select(item_id, *place, F.col(vector).alias("v")).mapInPandas(best, schema)
    first = F.row_number().over(Window.partitionBy("query_id", *location).orderBy(F.desc("score"), item_id))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item_id))
    return found.withColumn("_f", first).filter("_f = 1").drop("_f").withColumn("rank", rank).filter(F.col("rank") <= k)


def task_queries(tasks: DataFrame) -> DataFrame:
    """task_id, turn, query: questions in English and Russian and the joined keywords; else title or id."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    words = F.nullif(F.array_join(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), " "), F.lit(""))
    asked = F.array_compact(F.array(blank("question_en"), blank("question_ru"), words))
    some = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.coalesce(blank("title"), F.col("task_id").cast("string"))))
    return tasks.select("task_id", F.posexplode(some).alias("turn", "query"))


def collect_evidence(results: DataFrame, k: int) -> DataFrame:
    """results: task_id, turn, rank, filename, page_number, chunk_index, score, text. One row a location, from the
    earliest query; the k best by score, numbered E1, E2, ..."""
    place = Window.partitionBy("task_id", "filename", "page_number", "chunk_index").orderBy("turn", "rank")
    once = results.withColumn("_f", F.row_number().over(place)).filter("_f = 1").drop("_f")
    return _numbered(once.withColumn("_o", F.struct("turn", "rank")), k)


def filter_evidence(evidence: DataFrame, least: float | None = None, most: int = 20) -> DataFrame:
    rows = evidence if least is None else evidence.filter(F.col("score") >= least)
    return _numbered(rows.withColumn("_o", F.col("evidence_id")), most)


def _numbered(rows: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "_o"))
    return rows.withColumn("_r", r).filter(F.col("_r") <= k).withColumn("evidence_id", F.concat(F.lit("E"), F.col("_r").cast("string"))).drop("_r", "_o")


def task_terms(english: Column, russian: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", russian, english)), F.lit(r"(?U)[\w-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 5))


def best_sentences(evidence: DataFrame, tasks: DataFrame, n: int = 5) -> DataFrame:
    """task_id, rank, sentence, score, evidence_id. tasks: task_id, terms, keywords."""
    each = evidence.select("task_id", "evidence_id", "score", F.explode(sentences(collapse(F.coalesce("text", F.lit(""))))).alias("sentence")).filter("sentence <> ''")
    low = F.lower("sentence")
    hits = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.col("low").contains(F.lower(t)) & (t != "")))
    scored = each.join(tasks.select("task_id", "terms", "keywords"), "task_id").withColumn("low", low)
    scored = scored.withColumn("score", F.col("score") + 0.2 * hits(F.col("keywords")) + 0.1 * hits(F.col("terms")))
    once = scored.withColumn("_f", F.row_number().over(Window.partitionBy("task_id", "low").orderBy(F.desc("score"), "evidence_id"))).filter("_f = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "low"))).filter(F.col("rank") <= n).select("task_id", "rank", "sentence", "score", "evidence_id")


def terms_present(evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """(task_id, kind, ord, term) that occur in the evidence of their task; texts aren't put together for it."""
    hit = evidence.join(terms, "task_id").groupBy("task_id", "kind", "ord", "term").agg(F.bool_or(F.lower(F.coalesce("text", F.lit(""))).contains(F.lower("term"))).alias("hit"))
    return hit.filter("hit").drop("hit")


def concepts(found: DataFrame, terms: DataFrame, most: int = 10) -> DataFrame:
    """task_id, concepts: present keywords, or the first ones where none is present."""
    own = terms.filter("kind = 'concept'")
    hit = found.filter("kind = 'concept'").groupBy("task_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "term"))), 1, most).alias("h"))
    every = own.groupBy("task_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "term"))), 1, most).alias("e"))
    return every.join(hit, "task_id", "left").select("task_id", F.coalesce(F.col("h.term"), F.col("e.term")).alias("concepts"))


def summaries(evidence: DataFrame, tasks: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """task_id, findings, concepts, methods, limitations, evidence_used: one row a task."""
    ordered = lambda df, order, value, name: df.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("x")).select("task_id", F.transform("x", lambda v: v[value]).alias(name))
    found = terms_present(evidence, terms)
    out = tasks.select("task_id")
    for part in (
        ordered(best_sentences(evidence, tasks, n), "rank", "sentence", "findings"), concepts(found, terms),
        ordered(found.filter("kind = 'method'"), "ord", "term", "methods"), ordered(found.filter("kind = 'limitation'"), "ord", "term", "limitations"),
        evidence.groupBy("task_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_used")),
    ):
        out = out.join(part, "task_id", "left")
    none = F.array().cast("array<string>")
    return out.select("task_id", *(F.coalesce(c, none).alias(c) for c in ("findings", "concepts", "methods", "limitations", "evidence_used")))
