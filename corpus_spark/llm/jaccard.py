"""Operator 10: n-gram Jaccard join by vertical partitioning.

A document's n-grams are hashed to 64 bits; the global n-gram order is by frequency level, rare ones first,
and by hash. The levels come from a table of fixed size, filled from all documents; any order
gives the same result, this one makes prefixes selective. Documents with the same set are one class from
then on. The order of hashes is cut into fragments; the overlap of a pair is counted in each fragment apart
and summed per pair. Candidates are pairs with a common n-gram in their prefixes, whose sizes allow
the threshold and whose parity bitmaps differ in no more bits than it allows (each differing n-gram
flips one bit, so this never loses a link).

Pairs inside a component that is already known need no proof. So candidates come in rounds: first each
prefix bucket pairs its members with one of them, chosen by a hash; the links found are joined into
components; the last round pairs everything that still lies in different components. Large groups of
near copies thus cost rows in proportion to their size, and no link between components is lost. Who asks for
the links themselves sets ``every_link``: all candidates are proved then, also inside components.

Null or wordless texts have an empty set and link with nothing. With fewer than ``n`` words the whole
sequence is the one n-gram. Very long texts count whole. Rows of the same doc_id are one document with the
set whose hash is smallest. Ids are integers. Components are called by their smallest id. An empty table
gives no rows. Other columns, whatever their names, have no part in it.

Buckets of n-grams that many documents share are cut into blocks that meet in pairs, and sets that many
documents have are looked up by broadcast, so that no hot n-gram, group of copies or passage lands in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.common import components, discard, map_slices, mix64, small, word_bytes, written
from corpus_spark.llm.places import among

_BITS = 512
_WIDE = [f"m{k}" for k in range(_BITS // 64)]
#: Sets above this size get a second, wider bitmap for the pairs that the first lets through.
_BIG, _BIG_BITS = 500, 4096
_CACHE: dict[bytes, int] = {}
#: Cells of the frequency table: 16 MB, whatever the corpus.
_CELLS = 1 << 24
_CELL_SHIFT = np.uint64(40)
#: Cells that travel together.
_BLOCK = 1 << 14


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct n-gram hashes of a text, sorted; A-Z in lower case."""
    words = word_bytes(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    words = b" ".join(words).lower().split(b" ")
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    if len(_CACHE) > 150_000:
        _CACHE.clear()
    found = list(map(_CACHE.get, words))
    for i, x in enumerate(found):
        if x is None:
            found[i] = _CACHE[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(found, dtype=np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mix64(out + h[k : k + m] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def _bitmap(tokens: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Parity of the n-grams in each of ``bits`` cells, as signed 64-bit integers."""
    cells = np.bincount((mix64(tokens + np.uint64(1)) >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _prefix(size: int, percent: int) -> int:
    """So many of the first n-grams that two sets at the threshold share one of them."""
    return size - -(-percent * size // 100) + 1


def _counted(parts: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """block, counts: how many n-grams of a task's texts fall into each cell, packed in blocks of cells, empty ones left out."""
    cells = np.zeros(_CELLS, dtype=np.uint16)

    def packed() -> pa.RecordBatch:
        blocks = cells.reshape(-1, _BLOCK)
        said = np.flatnonzero(blocks.any(axis=1))
        return pa.RecordBatch.from_pydict({"block": pa.array(said, pa.int32()), "counts": pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in said], pa.binary())})

    for batch in parts:
        texts = batch.column("text")
        for at in range(0, batch.num_rows, 256):
            got = np.concatenate([shingle_hashes(t, n) for t in texts.slice(at, 256).to_pylist()])
            own, more = np.unique((got >> _CELL_SHIFT).astype(np.int64), return_counts=True)
            while len(own):
                take = np.minimum(more, 65535 - cells[own].astype(np.int64))
                cells[own] += take.astype(np.uint16)
                own, more = own[more > take], (more - take)[more > take]
                if len(own):  # a cell is full: hand over what there is
                    yield packed()
                    cells[:] = 0
    yield packed()


def frequency_levels(docs: DataFrame, n: int, one_in: int = 1) -> np.ndarray:
    """How frequent n-grams are, by the cell of their hash: 0 for rare ones, one more for each doubling of the count.

    All documents are counted, unless ``one_in`` asks for a sample by hash. A cell shares its count among the n-grams that
    fall into it, so that counts up to twice the mean, or up to 3, say nothing and are 0. A task shuffles its cells as packed
    blocks, not n-grams; what reaches the driver is one byte a cell, of a fixed number of cells.
    """

    def added(blocks: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, dtype=np.int64)
        for x in blocks["counts"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint16)
        return pd.DataFrame({"block": [blocks["block"].iloc[0]], "n": [int(total.sum())], "counts": [zlib.compress(total.tobytes(), 1)]})

    taken = docs.select("text") if one_in == 1 else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(one_in)) == 0).select("text")
    counted = taken.mapInArrow(lambda parts: _counted(parts, n), "block int, counts binary")
    counts = written(counted.groupBy("block").applyInPandas(added, "block int, n bigint, counts binary"), "frequency")
    noise = max(3.0, 2 * (counts.agg(F.sum("n")).first()[0] or 0) / _CELLS)

    def levelled(part: pa.RecordBatch) -> dict:
        rows = []
        for x in part.column("counts").to_pylist():
            c = np.frombuffer(zlib.decompress(x), dtype=np.int64)
            rows.append(np.where(c > noise, np.floor(np.log2(np.maximum(c, 1) / noise)) + 1, 0).astype(np.uint8).tobytes())
        return {"block": part.column("block"), "levels": rows}

    rows = map_slices(counts.select("block", "counts"), levelled, "block int, levels binary").toArrow()
    discard(counts)
    levels = np.zeros((_CELLS // _BLOCK, _BLOCK), dtype=np.uint8)
    for k, x in zip(rows.column("block").to_pylist(), rows.column("levels").to_pylist()):
        levels[k] = np.frombuffer(x, dtype=np.uint8)
    return levels.reshape(-1)


def sets(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, size, s1, s2 (hash of the set), m0.. (bitmap), prefix (its n-grams) and wide (bitmap of big sets)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def work(part: pa.RecordBatch) -> dict:
        levels = shared.value
        rows = []
        for text in part.column("text").to_pylist():
            t = shingle_hashes(text, n)
            s = t.view(np.int64)
            a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
            if len(s):
                p = s[np.argsort(levels[(t >> _CELL_SHIFT).astype(np.int64)], kind="stable")[: _prefix(len(s), percent)]]
                rows.append((len(s), a, b, *_bitmap(t).tolist(), p, _bitmap(t, _BIG_BITS) if len(s) > _BIG else None))
            else:
                rows.append((0, a, b, *[0] * len(_WIDE), s, None))
        return {"doc_id": part.column("doc_id"), **dict(zip(["size", "s1", "s2", *_WIDE, "prefix", "wide"], zip(*rows)))}

    cols = ["doc_id bigint", "size bigint", "s1 bigint", "s2 bigint", *(f"{m} bigint" for m in _WIDE), "prefix array<bigint>", "wide array<bigint>"]
    return map_slices(docs, work, ", ".join(cols))


def fragments_of(docs: DataFrame, n: int, count: int) -> DataFrame:
    """rep, size, s1, s2, fragment, grams: each document's n-grams cut where the global order is cut."""
    shift = np.uint64(65 - count.bit_length())

    def work(part: pa.RecordBatch) -> dict:
        rows = []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            t = shingle_hashes(text, n)
            s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(t.tobytes()), dtype=np.int64)
            cut = np.searchsorted(t >> shift, np.arange(1, count, dtype=np.uint64)) if count > 1 else []
            rows += [(doc, len(t), s1, s2, k, x) for k, x in enumerate(np.split(t.view(np.int64), cut))]
        return dict(zip(("rep", "size", "s1", "s2", "fragment", "grams"), zip(*rows)))

    return map_slices(docs, work, "rep bigint, size bigint, s1 bigint, s2 bigint, fragment int, grams array<bigint>", 128)


def _possible(percent: int):
    """Filters on sizes and bitmaps for aliases x and y; never false for a pair at the threshold."""
    a, b = F.col("x.size"), F.col("y.size")
    differ = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in _WIDE), F.lit(0))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * differ <= (100 - percent) * (a + b))


def _sieve(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Pairs of big sets whose wide bitmaps differ in no more bits than the threshold allows, and all others."""
    x = pairs.join(wide.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("wide").alias("wa")), "a", "left")
    x = x.join(wide.select(F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("wide").alias("wb")), "b", "left")
    differ = F.aggregate(F.zip_with("wa", "wb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)
    return x.filter(F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame | None, n: int, percent: int, count: int) -> DataFrame:
    """Links among pairs (a, b), written: overlaps counted by fragment, then summed per pair.

    Only texts of documents in a pair are cut into fragments, and some others by chance, which no pair asks for.
    """
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    own = fragments_of(among(docs, "doc_id", ids), n, count)
    if classes is not None:  # some doc_id has several rows
        own = own.join(classes.withColumnRenamed("doc_id", "rep"), ["rep", "s1", "s2"], "left_semi").dropDuplicates(["rep", "fragment"])
    frags = written(own.select("rep", "size", "fragment", "grams"), "fragments")
    need = pairs.select("a", "b", F.explode(F.array(*map(F.lit, range(count)))).alias("fragment"))
    left = frags.select(F.col("rep").alias("a"), "fragment", F.col("grams").alias("ga"), F.col("size").alias("na"))
    right = frags.select(F.col("rep").alias("b"), "fragment", F.col("grams").alias("gb"), F.col("size").alias("nb"))
    partial = need.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = written(summed.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")
    discard(ids, frags)
    return links


def _members(classes: DataFrame, hot: int = 10_000) -> DataFrame:
    """doc_id, n_shingles, rep: the smallest id with the same set.

    Sets of more than ``hot`` documents, of which there are few, are broadcast if a count proves it, so that
    their documents don't meet in one task; the others are joined by their hash.
    """
    reps = written(classes.filter("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    big = small(reps.filter(F.col("n") > hot).select("s1", "s2", "rep"), 1_000_000)
    of_big = classes.join(big, ["s1", "s2"])
    rest = classes.join(big.drop("rep"), ["s1", "s2"], "left_anti").join(reps.filter(F.col("n") <= hot).select("s1", "s2", "rep"), ["s1", "s2"], "left")
    cols = ["doc_id", F.col("size").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")]
    out = written(of_big.select(*cols).unionByName(rest.select(*cols)), "member")
    discard(reps)
    return out


def _buckets(now: DataFrame, most: int) -> DataFrame:
    """Pairs x, y of the rows of each bucket, each pair once.

    A bucket of more than ``most`` rows is cut into blocks, and every two of them meet apart from the others.
    """
    sizes = written(now.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > most), "hot-buckets")
    blocks = F.coalesce(F.ceil(F.col("k") / most), F.lit(1)).cast("int")
    placed = now.join(small(sizes, 500_000), "gram", "left").withColumn("blocks", blocks).drop("k")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("blocks")).cast("int"))
    x = placed.withColumn("hi", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumn("lo", F.col("block")).alias("x")
    y = placed.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("block")))).withColumn("hi", F.col("block")).alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("gram", "lo", "hi")])
    return met.filter((F.col("x.lo") < F.col("x.hi")) | (F.col("x.rep") < F.col("y.rep")))


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, fragments: int = 4, one_in: int = 1, rounds: int = 2, every_link: bool = False, bucket: int = 2000) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, n_class_links.

    n_class_links counts the other classes that the class links with, if ``every_link`` is set; else it is null.
    """
    rounds = 0 if every_link else rounds
    if fragments & (fragments - 1):
        raise ValueError("fragments must be a power of two")
    one = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    all_ = written(sets(one, n, percent, frequency_levels(one, n, one_in)), "sets")
    classes = written(all_.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "size")).alias("s")).select("doc_id", "s.*"), "classes")
    member = _members(classes)
    kept = member.filter("doc_id = rep and n_shingles > 0").select("doc_id")
    twice = all_.count() != classes.count()
    if twice:  # some doc_id has several rows: keep the row its class was taken from
        before, all_ = all_, written(all_.join(classes.select("doc_id", "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id"]), "sets")
        discard(before)

    # buckets: prefix n-grams of at least two classes
    rows = all_.select("doc_id", "size", "prefix").join(kept, "doc_id", "left_semi").select("doc_id", "size", F.explode("prefix").alias("gram"))
    shared = written(rows.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram"), "grams")
    hits = written(rows.join(shared, "gram", "left_semi"), "hits")
    maps = all_.select("doc_id", *_WIDE).join(hits.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    table = written(hits.join(maps, "doc_id").withColumnRenamed("doc_id", "rep"), "buckets")
    wide = written(all_.filter("wide is not null").select(F.col("doc_id").alias("rep"), "size", "wide"), "wide")
    discard(shared, hits, all_)
    cols = ["gram", "rep", "size", *_WIDE]

    links: DataFrame | None = None
    found: DataFrame | None = None
    for k in range(rounds + 1):
        now = table.select(*cols, F.col("rep").alias("comp")) if found is None else table.join(found, table["rep"] == found["node"], "left").select(*cols, F.coalesce("component", "rep").alias("comp"))
        if k < rounds:
            lead = written(now.groupBy("gram").agg(F.max_by(F.struct("rep", "size", "comp", *_WIDE), F.xxhash64("rep", "gram", F.lit(k))).alias("lead")).select("gram", "lead.*"), "lead")
            joined = now.alias("x").join(lead.alias("y"), "gram")
        else:
            lead = now = written(now, "now")
            joined = _buckets(now, bucket)
        cross = (joined if every_link else joined.filter(F.col("x.comp") != F.col("y.comp"))).filter(_possible(percent))
        pairs = written(cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "pairs")
        sieved = written(_sieve(pairs, wide, percent), "sieved")
        discard(lead, pairs)
        proved = _verify(sieved, one, classes.select("doc_id", "s1", "s2") if twice else None, n, percent, fragments)
        links = proved if links is None else links.unionByName(proved)
        before, found = found, written(components(links), "components")
        discard(sieved, before)
    discard(table, wide, classes)
    comp = found.withColumnsRenamed({"node": "rep"})
    out = member.join(comp, "rep", "left")
    if every_link:
        degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_class_links"))
        out = out.join(degree, "rep", "left").withColumn("n_class_links", F.coalesce("n_class_links", F.lit(0)))
    else:
        out = out.withColumn("n_class_links", F.lit(None).cast("bigint"))
    return out.select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), "n_class_links")


#: The same in DuckDB, with n = 3 and 90 %: pairs by shared shingles, components by recursion over distinct sets.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
  FROM d),
k AS (SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY g) AS rep FROM s),
r AS (SELECT rep, n, unnest(g) AS x FROM k WHERE doc_id = rep AND n > 0),
p AS (SELECT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.x = b.x AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(node, comp) AS (SELECT DISTINCT rep, rep FROM r UNION SELECT c.node, e.b FROM c JOIN e ON c.comp = e.a),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, coalesce(CASE WHEN k.n > 0 THEN m.comp END, k.doc_id) AS component_id
FROM k LEFT JOIN m ON k.rep = m.node
"""
