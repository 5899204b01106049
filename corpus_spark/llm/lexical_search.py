"""Operator 11: ranked lexical search with hashed max-sketches.

``index`` reads every document once. A document's term frequencies are folded into a sketch: ``ROWS``
rows of hashed coordinates, each the maximum of the frequencies that fall into it, as wide as the
document has distinct terms. The impact of a term rises with its frequency, so the least of a term's
coordinates bounds its impact from above, whatever the corpus statistics are: the sketch depends on
its document alone. The index holds sketch, length and text of a document side by side; beside them
stand partial counts of the documents of each term.

``search`` takes the queries in blocks of bounded size. One scan looks all terms of a block up in all
sketches and keeps the highest bounds of each query; the documents with those are rescored exactly.
The k-th exact score is the threshold: a second scan of the sketches finds what may still reach it, and
that is rescored in order of descending bounds. Only texts of candidates leave the index, and they are
shuffled only if a count says that the candidates are too many to be broadcast.

Null and empty texts have no terms: such documents are counted nowhere, such queries get no rows.
Very long texts are taken whole. Rows that repeat, or have equal ids, are documents and queries each;
equal scores are ordered by doc_id, null ids last. Empty tables give no rows. Other columns, whatever
their names, have no part in it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.common import discard, map_slices, mix64, written

#: Rows of a sketch, and the coordinates of each per distinct term, before the next power of two.
ROWS = 3
SPREAD = 4
#: Frequencies from here on share a coordinate value, whose impact is taken as the limit of all.
MOST = 255
#: A query scores a document by w * (SCALE * tf div (1000 * tf + 8 * m)).
SCALE = 1_000_000_000

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, in UTF-8; only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def _hashes(found: list[bytes]) -> np.ndarray:
    """For each row of a sketch, each term's 64-bit hash."""
    seed = np.array([xxhash.xxh64_intdigest(t) for t in found], dtype=np.uint64)
    return np.stack([mix64(seed + np.uint64(r)) for r in range(ROWS)])


def width(distinct: int) -> int:
    """Coordinates in a row of the sketch of a document with so many distinct terms."""
    return max(64, 1 << (SPREAD * distinct - 1).bit_length())


def sketch(counts: dict[bytes, int]) -> bytes:
    """The coordinatewise maxima of a document's term frequencies, at most ``MOST``."""
    at = _hashes(list(counts)) & np.uint64(width(len(counts)) - 1)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST).astype(np.uint8)
    order = np.argsort(tf, kind="stable")  # of equal places the last, that is the highest, stays
    made = np.zeros((ROWS, width(len(counts))), dtype=np.uint8)
    for r in range(ROWS):
        made[r, at[r, order]] = tf[order]
    return made.tobytes()


def index(docs: DataFrame, held: int = 100_000, size: int = 128) -> DataFrame:
    """A written table of two kinds of rows: key, doc_id, n, sketch, text of documents with terms; term, df.

    The second are partial counts of the documents that hold a term, cut off when a task holds ``held`` terms.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"key bigint, doc_id {kind}, n bigint, sketch binary, text string, term binary, df bigint"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            of = next(iter(columns.values()))
            return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(len(of), t)) for f, t in kinds], names=[f for f, _ in kinds])

        def counted() -> pa.RecordBatch:
            return rows(term=pa.array(list(df), pa.binary()), df=pa.array(list(df.values()), pa.int64()))

        for batch in parts:
            kinds = [("key", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("n", pa.int64()), ("sketch", pa.binary()), ("text", pa.string()), ("term", pa.binary()), ("df", pa.int64())]
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                some, n, made = [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    if found := terms(text):
                        counts = Counter(found)
                        df.update(counts.keys())
                        some.append(i)
                        n.append(len(found))
                        made.append(sketch(counts))
                kept = part.take(pa.array(some, pa.int64()))
                yield rows(key=kept.column("key"), doc_id=kept.column("doc_id"), n=pa.array(n, pa.int64()), sketch=pa.array(made, pa.binary()), text=kept.column("text").cast(pa.string()))
                if len(df) > held:
                    yield counted()
                    df.clear()
        if df:
            yield counted()

    return written(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(run, schema), "lexical-index")


class _Block:
    """The queries of a block as arrays: distinct terms with weights and hashes, and each query's terms one after another."""

    def __init__(self, rows: list, df: dict[bytes, int], n_docs: int, n_terms: int):
        found = {t: i for i, t in enumerate(df)}
        self.terms, self.n_docs, self.n_terms = list(found), n_docs, n_terms
        self.w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.values()], dtype=np.int64)
        self.hashes = _hashes(self.terms)
        counts = [(r["item"], [(found[t], k) for t, k in Counter(map(bytes, r["terms"])).items() if t in found]) for r in rows]
        self.queries = [(item, have) for item, have in counts if have]  # others can't score
        self.items = [item for item, _ in self.queries]
        flat = [x for _, have in self.queries for x in have]
        self.column = np.array([t for t, _ in flat], dtype=np.int64)
        self.weight = np.array([self.w[t] * k for t, k in flat], dtype=np.int64)
        self.starts = np.cumsum([0, *(len(have) for _, have in self.queries)])[:-1]

    def damping(self, n: np.ndarray) -> np.ndarray:
        return 25 + (75 * n * self.n_docs) // self.n_terms

    def bounds(self, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """For each document and query, what the score can't exceed."""
        out = np.zeros((len(n), len(self.queries)), dtype=np.int64)
        sizes, m = np.array([len(s) for s in sketches]), self.damping(n)
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            at = (self.hashes & np.uint64(size // ROWS - 1)).astype(np.int64)
            for i in range(0, len(here), 32):
                own = here[i : i + 32]
                maxima = np.frombuffer(b"".join(sketches[k] for k in own), dtype=np.uint8).reshape(len(own), ROWS, -1)
                tf = maxima[:, 0, at[0]]
                for r in range(1, ROWS):
                    np.minimum(tf, maxima[:, r, at[r]], out=tf)
                impact = np.zeros((len(own), MOST + 1), dtype=np.int64)
                steps = np.arange(1, MOST)
                impact[:, 1:MOST] = SCALE * steps // (1000 * steps + 8 * m[own, None])
                impact[:, MOST] = SCALE // 1000
                terms_of = np.take_along_axis(impact, tf.astype(np.int64), axis=1)
                out[own] = np.add.reduceat(terms_of[:, self.column] * self.weight, self.starts, axis=1)
        return out

    def score(self, query: int, counts: dict[bytes, int], m: int) -> int:
        total = 0
        for t, k in self.queries[query][1]:
            if tf := counts.get(self.terms[t]):
                total += k * int(self.w[t]) * (SCALE * tf // (1000 * tf + 8 * m))
        return total


def _slices(parts: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _highest(found: DataFrame, block: _Block, few: int) -> DataFrame:
    """query, bound, key: of each task, the ``few`` documents with the highest bounds for each query."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(block.queries)), dtype=np.int64)
        keys = np.zeros_like(best)
        for part in _slices(parts):
            bounds = block.bounds(part.column("n").to_numpy(), part.column("sketch").to_pylist())
            best = np.concatenate([best, bounds])
            keys = np.concatenate([keys, np.repeat(part.column("key").to_numpy()[:, None], len(block.queries), axis=1)])
            if len(best) > few:
                at = np.argpartition(best, len(best) - few, axis=0)[-few:]
                best, keys = np.take_along_axis(best, at, axis=0), np.take_along_axis(keys, at, axis=0)
        query, some = np.tile(np.arange(len(block.queries)), len(best)), best.ravel() > 0
        yield pa.RecordBatch.from_pydict({"query": query[some], "bound": best.ravel()[some], "key": keys.ravel()[some]})

    return found.select("key", "n", "sketch").mapInArrow(run, "query bigint, bound bigint, key bigint")


def _between(found: DataFrame, block: _Block, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """key, asked array<struct<query, bound>>: documents with low <= bound < high for a query, and these queries."""
    kind = pa.list_(pa.struct([("query", pa.int64()), ("bound", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            bounds = block.bounds(part.column("n").to_numpy(), part.column("sketch").to_pylist())
            doc, query = np.nonzero((bounds >= low) & (bounds < high))
            own, first = np.unique(doc, return_index=True)
            values = pa.StructArray.from_arrays([pa.array(query, pa.int64()), pa.array(bounds[doc, query], pa.int64())], names=["query", "bound"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(own, pa.int64())), lists.cast(kind)], names=["key", "asked"])

    return found.select("key", "n", "sketch").mapInArrow(run, "key bigint, asked array<struct<query:bigint,bound:bigint>>")


def _rescored(found: DataFrame, candidates: DataFrame, block: _Block, low: np.ndarray, k: int, small_asked: int) -> DataFrame:
    """query, doc_id, score: the exact scores of the candidates (key, asked), as far as they are of a task's k best.

    Candidates are broadcast if a count of their queries proves them few, so that only their texts leave the scan;
    otherwise both sides are shuffled by key. A task takes them in order of descending bounds.
    """
    kind = dict(found.dtypes)["doc_id"]
    asked = candidates.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]
    rows = found.select("key", "doc_id", "n", "text").join(F.broadcast(candidates) if asked <= small_asked else candidates, "key")

    def order(x: tuple) -> tuple:
        return -x[0], x[1] is None, x[1] if x[1] is not None else 0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.queries]
        enough = low.copy()  # a score below can't be of the k best
        kind_of = pa.int64()
        for part in _slices(parts):
            kind_of = part.schema.field("doc_id").type
            m, texts, counts = block.damping(part.column("n").to_numpy()), part.column("text").cast(pa.binary()), {}
            wanted = [(-x["bound"], x["query"], d) for d, xs in enumerate(part.column("asked").to_pylist()) for x in xs]
            for bound, q, d in sorted(wanted):
                if -bound < enough[q]:
                    continue
                if d not in counts:
                    counts[d] = Counter(terms(texts[d].as_py()))
                score = block.score(q, counts[d], int(m[d]))
                if score >= max(enough[q], 1):
                    best[q].append((score, part.column("doc_id")[d].as_py()))
                    if len(best[q]) >= 4 * k:
                        best[q] = sorted(best[q], key=order)[:k]
                        enough[q] = max(enough[q], best[q][-1][0])
        rows = [(q, i, s) for q, have in enumerate(best) for s, i in sorted(have, key=order)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind_of), pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return rows.select("doc_id", "n", "text", "asked").mapInArrow(run, f"query bigint, doc_id {kind}, score bigint")


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 250_000, few: int = 64, small_asked: int = 300_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of an ``index`` with a score above 0.

    Queries are taken in blocks of about ``block_terms`` terms; the driver holds one block's terms, counts and
    thresholds. ``few`` highest bounds of a query are rescored to find its threshold; candidates with at most
    ``small_asked`` queries in all are broadcast.
    """
    kind = dict(items.dtypes)["item_id"]
    asked = map_slices(
        items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"),
        lambda part: {"item": part.column("item"), "item_id": part.column("item_id"), "terms": [terms(t) for t in part.column("text").cast(pa.binary()).to_pylist()]},
        f"item bigint, item_id {kind}, terms array<binary>",
    )
    asked = written(asked, "lexical-queries")
    found = table.filter(F.col("n").isNotNull())
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    results = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        words = mine.select(F.explode("terms").alias("term")).distinct()
        df = {bytes(t): n for t, n in table.filter(F.col("term").isNotNull()).join(F.broadcast(words), "term").groupBy("term").agg(F.sum("df")).collect()}
        block = _Block(mine.select("item", "terms").collect(), df, n_docs, n_terms)
        if not block.queries:
            continue
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "key"))
        start = written(_highest(found, block, few).withColumn("rank", rank).filter(F.col("rank") <= few), "lexical-start")
        # what stands below a query's first candidates: all bounds from there on are still to be looked at
        above = np.full(len(block.queries), np.iinfo(np.int64).max)
        for q, bound in start.filter(F.col("rank") == few).select("query", "bound").collect():
            above[q] = bound
        above[above == np.iinfo(np.int64).max] = 0  # fewer documents than that: all are candidates
        ones = np.ones(len(block.queries), dtype=np.int64)
        first = written(start.groupBy("key").agg(F.collect_list(F.struct("query", "bound")).alias("asked")), "lexical-candidates")
        best = written(_top(_rescored(found, first, block, ones, k, small_asked), k), "lexical-first")
        threshold = ones.copy()
        for q, score in best.filter(F.col("rank") == k).select("query", "score").collect():
            threshold[q] = score
        # equal bounds may stand on both sides of the border, so those are scored again, and keys tell them apart
        second = written(_between(found, block, threshold, above + 1), "lexical-candidates")
        seen = start.select("key", "query")
        fresh = second.select("key", F.explode("asked").alias("x")).select("key", "x.*").join(seen, ["key", "query"], "left_anti")
        more = written(fresh.groupBy("key").agg(F.collect_list(F.struct("query", "bound")).alias("asked")), "lexical-candidates")
        both = written(_top(best.drop("rank").unionByName(_rescored(found, more, block, threshold, k, small_asked)), k), "lexical-best")
        discard(start, first, second, more, best)
        names = table.sparkSession.createDataFrame(list(enumerate(block.items)), "query bigint, item bigint")
        results.append(both.join(F.broadcast(names), "query").select("item", "rank", "doc_id", "score"))
    if not results:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(dict(table.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all documents for each item."""
    made = index(docs)
    found = search(made, items, k)
    discard(made)  # the results are written
    return found


_ITS_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same in DuckDB, by the terms themselves.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITS_TERMS} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM p),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM p) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT row_number() OVER () AS i, item_id, {_ITS_TERMS} AS t FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT i, item_id, term, count(*)::BIGINT AS k FROM (SELECT i, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
s AS (SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN tf USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
