"""Queries of what the library does with large inputs: gazetteers as tables, files in ranges, stored indexes, hot windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.operators import coding, gazetteer, vector_index, windows
from corpus_spark.plans import bindings as Z
from corpus_spark.plans.queries import SQL, query
from corpus_spark.plans import queries_more  # noqa: F401
from corpus_spark.plans.queries_io import _CSV, _ROWS, _rows
from corpus_spark.sources import comments
from corpus_spark.sources import tables as S
from corpus_spark.sources.scratch import fresh_path
from corpus_spark.streaming import rollup

# Places of a gazetteer made of the benchmark: every two words in a row name their item

_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


def _edges(text: str) -> str:
    """A text with a mark at each place where a whole word may begin, and another where one may end: whole words are parts of it."""
    return rf"(chr(1) || regexp_replace({text}, '([^\p{{L}}\p{{M}}\p{{N}}_])', chr(2) || '\1' || chr(1), 'g') || chr(2))"


_PLACES = f"""WITH t AS MATERIALIZED (SELECT doc_id, v, {_edges("v")} AS marked FROM (SELECT doc_id, {_NORMAL} AS v FROM documents)),
w AS (SELECT item_id, string_split({_NORMAL}, ' ') AS w FROM benchmark),
a AS MATERIALIZED (SELECT item_id, alias, {_edges("alias")} AS marked FROM (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS alias FROM w, unnest(range(1, len(w))) u(i))),
h AS (SELECT DISTINCT doc_id, item_id FROM t JOIN a ON contains(t.v, a.alias) AND contains(t.marked, a.marked))
SELECT t.doc_id, coalesce(list('item ' || item_id ORDER BY item_id) FILTER (item_id IS NOT NULL), []) AS toponyms FROM t LEFT JOIN h USING (doc_id) GROUP BY t.doc_id"""


def _aliases(spark, d) -> DataFrame:
    words = F.split(T.collapse(F.lower("text")), " ")
    pairs = Z.table(spark, d, "benchmark").select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.slice(words, i, 2))).alias("pair"))
    return pairs.filter(F.size("pair") == 2).select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("toponym"), F.array_join("pair", " ").alias("alias"), F.col("item_id").alias("ord"))


@query(_PLACES)
def c4_places_of_table(spark, d):
    """A gazetteer that is broadcast after its size was counted."""
    return gazetteer.add_places(Z.table(spark, d, "documents").select("doc_id", "text"), "text", _aliases(spark, d)).drop("text")


@query(_PLACES)
def c4_places_joined(spark, d):
    """The same gazetteer as if it were too large for a broadcast."""
    return gazetteer.add_places(Z.table(spark, d, "documents").select("doc_id", "text"), "text", _aliases(spark, d), most=0).drop("text")


# Readers through their public functions


@query(_ROWS + r""", c AS (SELECT *, trim(regexp_replace(replace(coalesce(comment, ''), '"', ''''), '\s+', ' ', 'g'), ' ') AS said FROM r)
SELECT datetime, author, "group", coalesce(comment, '') AS comment, 'telegram' AS source FROM c WHERE row_id % 2 = 0 UNION ALL SELECT datetime, author, "group", said, 'youtube' FROM c WHERE row_id % 2 = 1 AND said <> ''""")
def io1_read_comments(spark, d):
    """Two inputs: a folder of plain CSV with a stated source, and one whose name says that its lines are broken."""
    folder, rows = fresh_path(spark, "inputs"), _rows(spark, d)
    rows.filter("row_id % 2 = 0").select("group", "comment", "datetime", "source", "author").write.options(**_CSV).csv(f"{folder}/plain")
    said = F.trim(F.regexp_replace(F.replace(F.coalesce("comment", F.lit("")), F.lit('"'), F.lit("'")), r"\s+", " "))
    rows.filter("row_id % 2 = 1").select(F.concat(F.lit('"'), F.concat_ws(",", "datetime", "author", "group"), F.lit(',""'), said, F.lit('"""')).alias("value")).write.text(f"{folder}/youtube_1")
    got = comments.read_comments(spark, [{"path": f"{folder}/plain", "source": "telegram"}, {"path": f"{folder}/youtube_1"}])
    return got.withColumn("comment", F.coalesce("comment", F.lit("")))


@query("SELECT doc_id::VARCHAR AS doc_id, source, sha256(text) AS text_sha256, TRUE AS in_order FROM documents")
def io4_lineage_csv(spark, d):
    """Whole texts as CSV and back: in each file rows are numbered from 0 without a gap."""
    path = fresh_path(spark, "lineage") + "/rows.csv"
    Z.table(spark, d, "documents").select("doc_id", "source", "text").write.options(**_CSV).csv(path)
    got = S.with_lineage(spark, path)
    of_file = got.groupBy("source_file").agg(F.count("*").alias("rows"), F.count_distinct("row_index").alias("places"), F.min("row_index").alias("low"), F.max("row_index").alias("high"))
    good = of_file.select("source_file", ((F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("places") == F.col("rows"))).alias("in_order"))
    return got.join(good, "source_file").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "in_order")


@query("SELECT item_id, '.txt' AS extension, text || chr(10) AS text, TRUE AS id_fits, 1 AS pages FROM benchmark WHERE trim(text) <> ''")
def io8_articles(spark, d):
    """One text file an item, read as articles."""
    folder = fresh_path(spark, "articles")
    Z.table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(folder)
    got = S.articles(spark, folder)
    fits = F.col("doc_id") == F.concat(F.lit("article_"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 12))
    return got.select(F.regexp_extract("path", "item_id=(\\d+)", 1).cast("long").alias("item_id"), "extension", "text", fits.alias("id_fits"), F.size("pages").alias("pages"))


# A stored index, searched


@query(SQL["r2_nearest"])
def r2_search_index(spark, d):
    """The index of all vectors is written, and searched for the rows whose id is divisible by 20."""
    e, folder = Z.table(spark, d, "embeddings"), fresh_path(spark, "vector-index")
    vector_index.write_index(e, folder, "vec_id", cells=64, sample=5000)
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(spark, folder, q, 5, "vec_id").withColumn("score", F.round("score", 6))


# Hot windows


@query(f"""WITH {Z.SQL_LABELLED}, w AS (SELECT source, "group", time_bucket(INTERVAL '7 days', datetime) AS t, datetime, row_id, clean_text FROM l),
p AS (SELECT *, coalesce(sum(length(clean_text) + 1) OVER (PARTITION BY source, "group", t ORDER BY datetime, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(length(clean_text) + 1) OVER (PARTITION BY source, "group", t) AS whole FROM w)
SELECT source, "group", strftime(t, '%Y-%m-%d %H:%M:%S') AS window_start, CASE WHEN whole > 3000 THEN upto // 3000 ELSE 0 END::BIGINT AS piece, string_agg(clean_text, chr(10) ORDER BY datetime, row_id) AS text, count(*) AS message_count FROM p GROUP BY ALL""")
def w1_window_pieces(spark, d):
    """Weeks in pieces of about 3,000 characters."""
    got = windows.roll_up_pieces(Z.cleaned(spark, d), "7 days", "4 days", most=3000, size="chars")
    return got.select("source", "group", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "piece", "text", "message_count")


# A codebook of many levels


@query("""WITH RECURSIVE b AS (SELECT 'n' || p_partkey AS code_id, CASE WHEN p_partkey % 101 = 0 THEN 'n' || (2 * p_partkey) WHEN p_partkey % 50 = 7 THEN 'x' || p_partkey WHEN p_partkey > 1 THEN 'n' || (p_partkey // 2) END AS parent_id FROM part),
l AS (SELECT code_id, code_id AS top, 0 AS depth, [code_id] AS path, FALSE AS again FROM b
      UNION ALL SELECT l.code_id, b.parent_id, depth + 1, list_append(path, b.parent_id), list_contains(path, b.parent_id) FROM l JOIN b ON b.code_id = l.top WHERE b.parent_id IS NOT NULL AND NOT again),
e AS (SELECT code_id, max_by(top, depth) AS top, max(depth) AS depth, max_by(again, depth) AS again FROM l GROUP BY code_id)
SELECT code_id, CASE WHEN NOT again THEN top END AS root, CASE WHEN NOT again THEN depth END::BIGINT AS depth, CASE WHEN again THEN 'cycle' WHEN top NOT IN (SELECT code_id FROM b) THEN 'unknown ancestor' END AS problem FROM e""")
def j6_codebook_roots(spark, d):
    """A tree of all parts, with parents that aren't there and pairs that are each other's parent."""
    k = F.col("p_partkey")
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    parent = F.when(k % 101 == 0, name("n", 2 * k)).when(k % 50 == 7, name("x", k)).when(k > 1, name("n", F.floor(k / 2)))
    return coding.codebook_roots(Z.table(spark, d, "part").select(name("n", k).alias("code_id"), parent.alias("parent_id")))


# A stream through interruptions


@query(SQL["w1_windows"].replace("FROM l GROUP BY", "FROM l, (SELECT min(epoch(datetime)) AS a, max(epoch(datetime)) AS b FROM l) WHERE length(clean_text) >= 5 AND NOT (row_id % 97 = 0 AND epoch(datetime) < a + (b - a) / 3) GROUP BY"))
def st1_stream_restart(spark, d):
    """Three parts in time, each read by a query of its own that goes on from the last one's state. All rows of a part come
    twice; some of the first part come with the third, behind the watermark; a last row closes all windows."""
    folder = fresh_path(spark, "stream-parts")
    rows = Z.messages(spark, d).select("row_id", F.col("datetime").cast("timestamp").alias("datetime"), "group", "comment", "source")
    at = F.col("datetime").cast("double")
    low, high, last = rows.agg(F.min(at), F.max(at), F.max("datetime")).first()
    part = F.when(at < low + (high - low) / 3, F.when(F.col("row_id") % 97 == 0, 3).otherwise(1)).when(at < low + 2 * (high - low) / 3, 2).otherwise(3)
    parted = rows.withColumn("part", part)
    for n in (1, 2, 3, 4):
        own = parted.filter(F.col("part") == n).drop("part")
        if n == 4:
            own = spark.createDataFrame([(-1, last, "end", "the end of it", "end")], rows.schema).withColumn("datetime", F.col("datetime") + F.expr("interval 10 days"))
        own.unionByName(own).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
        out = rollup.documents_stream(stream, "6 hours", "1 hour", 5, unique="row_id")
        rollup.run_available(out, folder)
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").filter("source <> 'end'")
    return got.select("source", "group", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "period", "text", "message_count")
