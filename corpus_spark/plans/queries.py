"""One query for each operator of the library, on the test tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions import lists as L
from corpus_spark.functions import text as T
from corpus_spark.operators import bibliography as B
from corpus_spark.operators import coding, retrieval, runs, sampling, topics, windows
from corpus_spark.operators import distributions as D
from corpus_spark.operators import lexicon as X
from corpus_spark.plans import bindings as Z
from corpus_spark.plans.corpus import preprocess
from corpus_spark.sources import comments
from corpus_spark.sources import tables as S
from corpus_spark.sources.scratch import fresh_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return Z.table(spark, d, "documents")


# Sources and text


@query("SELECT page_id, url, CASE WHEN contains(lower(url), 'blog') THEN 'blog' ELSE 'web' END AS kind FROM pages")
def io3_source_from_path(spark, d):
    p = Z.table(spark, d, "pages")
    return p.select("page_id", "url", F.when(comments.source_of(F.regexp_replace(F.lower("url"), "blog", "youtube")) == "youtube", "blog").otherwise("web").alias("kind"))


@query("SELECT doc_id, 'file=' || (doc_id // 2000) AS folder, TRUE AS file_fits, row_number() OVER (PARTITION BY doc_id // 2000 ORDER BY doc_id) - 1 AS row_index, source FROM documents")
def io4_lineage(spark, d):
    """Files of 2,000 ids in a row, each in its folder and in the order of ids: SQL sees no files, but it can tell these."""
    path, at = fresh_path(spark, "lineage-files"), F.expr("doc_id div 2000")
    _docs(spark, d).select("doc_id", "source", at.alias("file")).repartition("file").sortWithinPartitions("file", "doc_id").write.partitionBy("file").parquet(path)
    got = S.with_lineage(spark, path)
    fits = F.col("source_path").endswith(F.concat(F.lit("/"), "source_file"))
    return got.select("doc_id", F.regexp_extract("source_path", "/(file=[^/]+)/[^/]+$", 1).alias("folder"), fits.alias("file_fits"), "row_index", "source")


@query("SELECT doc_id, text, NULL::BIGINT AS item_id FROM documents WHERE trim(coalesce(text, '')) <> '' UNION ALL SELECT NULL, text, item_id FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def io5_context_tables(spark, d):
    return S.context({"documents": _docs(spark, d).select("doc_id", "text"), "documents_enriched": Z.table(spark, d, "benchmark").select("item_id", "text"), "other": Z.table(spark, d, "orders")})


@query("SELECT page_id, len(html) AS n, concat('article_', substr(sha1(url), 1, 12)) AS doc_id FROM pages")
def io8_article_ids(spark, d):
    return Z.table(spark, d, "pages").select("page_id", F.length("html").alias("n"), F.concat(F.lit("article_"), F.substring(F.sha1(F.col("url").cast("binary")), 1, 12)).alias("doc_id"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '') AS text FROM conversations GROUP BY conv_id")
def io9_joined_pages(spark, d):
    pages = Z.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("page_number"), "text"))).alias("pages"))
    return pages.select("conv_id", F.nullif(retrieval.joined_pages(F.col("pages")), F.lit("")).alias("text"))


@query("SELECT doc_id, coalesce(text, '') AS repaired FROM documents")
def t1_fix_encoding(spark, d):
    """Whole texts broken on purpose, repaired again."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return spread(_docs(spark, d)).select("doc_id", T.fix_encoding(broken).alias("repaired"))


@query(f"WITH {Z.SQL_CLEAN} SELECT row_id, clean_text FROM c")
def t2_clean_text(spark, d):
    return Z.messages(spark, d).select("row_id", T.clean_text(F.col("comment")).alias("clean_text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, NULL::VARCHAR AS bad FROM events")
def t3_parse_datetime(spark, d):
    e = Z.table(spark, d, "events")
    day_first = F.concat(F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), F.lit(" UTC+00:00"))
    show = lambda c: F.date_format(F.to_utc_timestamp(T.parse_datetime(c), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", show(day_first).alias("parsed"), show(F.lit("31.31.2020 nonsense")).alias("bad"))


@query(f"SELECT event_id, sha256('{Z.SALT}' || coalesce(user_id::VARCHAR, '')) AS author_hash FROM events")
def t4_author_hash(spark, d):
    return Z.table(spark, d, "events").select("event_id", T.author_hash(F.col("user_id"), Z.SALT).alias("author_hash"))


@query(f"""WITH {Z.SQL_CLEAN} SELECT row_id, strftime(datetime, '%Y-%m-%d') AS date, year(datetime)::INT AS year, strftime(datetime, '%Y-%m') AS month, strftime(datetime, '%Y-%m') AS period, sha256('{Z.SALT}' || author) AS author_hash, source, "group", clean_text FROM c WHERE length(clean_text) >= 40""")
def t5_preprocess(spark, d):
    out = preprocess(Z.messages(spark, d), Z.SALT, 40, keep=["row_id"])
    return out.drop("datetime").withColumn("date", F.col("date").cast("string"))


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def t6_month(spark, d):
    e = Z.table(spark, d, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("datetime"))
    return e.select("event_id", T.month_of(e.columns).alias("month"))


@query(f"WITH {Z.SQL_CLEAN} SELECT row_id, {Z.SQL_LANG} AS lang FROM c")
def t7_language(spark, d):
    return Z.messages(spark, d).select("row_id", T.language(T.clean_text(F.col("comment"))).alias("lang"))


@query("SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN NULL WHEN lang IN ('en', 'ru', 'th', 'uz', 'other') THEN lang ELSE 'other' END AS label FROM documents")
def t8_model_labels(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_label(F.concat(F.lit("__label__"), F.upper("lang"), F.lit("_XX"))).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(trim(source)) WHEN doc_id % 3 = 1 THEN 'youtube' END AS source FROM documents WHERE doc_id % 3 < 2")
def t9_normalise_source(spark, d):
    k = F.col("doc_id") % 3
    rows = _docs(spark, d).select("doc_id", F.when(k == 0, F.concat(F.lit(" "), F.upper("source"))).alias("source"), F.when(k == 1, "YouTube_x.csv").alias("source_file"))
    return comments.fill_source(rows).select("doc_id", "source")


@query("SELECT event_id, ['a' || (user_id % 5), 'b', event_type] AS items, 'a' || (user_id % 5) AS first FROM events")
def t10_parse_list(spark, d):
    e = Z.table(spark, d, "events")
    a = F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string"))
    k = F.col("event_id") % 4
    dialect = F.when(k == 0, F.concat(a, F.lit("; b ;"), F.col("event_type"))).when(k == 1, F.to_json(F.array(a, F.lit("b"), "event_type"))).when(k == 2, F.concat(F.lit("['"), a, F.lit("', 'b', '"), "event_type", F.lit("']"))).otherwise(F.concat(a, F.lit(", b,"), "event_type"))
    items = L.parse_list(dialect)
    return e.select("event_id", items.alias("items"), L.primary(items).alias("first"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def t11_strip_tags(spark, d):
    return Z.table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key, coalesce(nullif(trim(regexp_replace(text, '[^\p{L}\p{N}_-]+', '_', 'g'), '_'), ''), 'unknown') AS file_name FROM documents")
def t12_names(spark, d):
    return _docs(spark, d).select("doc_id", T.title_key(F.col("text")).alias("title_key"), T.safe_name(F.col("text")).alias("file_name"))


@query(r"""WITH s AS (SELECT doc_id, trim(text, ' ') AS whole, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20) AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(parts) > 0 THEN parts ELSE [whole] END AS sentences FROM s""")
def t13_sentences(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM benchmark")
def t14_unfold_abstract(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    each = Z.table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("p", "w"))
    index = each.groupBy("item_id", "w").agg(F.collect_list("p").alias("p")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("index"))
    return index.select("item_id", T.unfold_abstract(F.col("index")).alias("abstract"))


# Lexicons


@query(f"WITH {Z.SQL_LABELLED} SELECT row_id, lang, sentiment, theme, toponyms, place_perception FROM l")
def c7_all_labels(spark, d):
    """C1 sentiment, C2 themes, C3 perception, C4 places and T7 in one pass."""
    return Z.labelled(spark, d).select("row_id", "lang", "sentiment", "theme", "toponyms", "place_perception")


for _id, _column in (("c1_sentiment", "sentiment"), ("c2_theme", "theme"), ("c3_perception", "place_perception"), ("c4_places", "toponyms")):
    QUERIES[_id] = lambda spark, d, c=_column: Z.labelled(spark, d).select("row_id", c)
    SQL[_id] = f"WITH {Z.SQL_LABELLED} SELECT row_id, {_column} FROM l"


@query(f"WITH {Z.SQL_MENTIONED} SELECT row_id, toponym, type, parent_city FROM x")
def c5_mentions(spark, d):
    return Z.mentioned(spark, d).select("row_id", "toponym", "type", "parent_city")


@query(f"WITH {Z.SQL_LABELLED} SELECT row_id, toponyms FROM l")
def c6_ensure_places(spark, d):
    m = Z.messages(spark, d).select("row_id", T.clean_text(F.col("comment")).alias("text"))
    made = X.ensure_places(m, Z.GAZETTEER).select("row_id", F.array_join("toponyms", ";").alias("toponyms"))
    return X.ensure_places(made, Z.GAZETTEER).select("row_id", "toponyms")


@query("SELECT doc_id, source FROM documents WHERE lower(source) = 'src3'")
def c8_scope(spark, d):
    return X.in_scope(_docs(spark, d), " SRC3 ").select("doc_id", "source")


# Windows and topics


@query(f"""WITH {Z.SQL_LABELLED} SELECT source, "group", strftime(time_bucket(INTERVAL '6 hours', datetime), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL '6 hours', datetime) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS window_end,
 min_by(period, datetime) AS period, string_agg(clean_text, chr(10) ORDER BY datetime, row_id) AS text, count(*) AS message_count FROM l GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY source, \"group\", time_bucket(INTERVAL '6 hours', datetime)"))
def w1_windows(spark, d):
    w = windows.roll_up(Z.labelled(spark, d), "6 hours")
    return w.select("source", "group", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "period", "text", "message_count")


@query(f"""WITH {Z.SQL_LABELLED}, k AS (SELECT DISTINCT source, "group", time_bucket(INTERVAL '6 hours', datetime) AS w FROM l)
SELECT printf('doc_%08d', row_number() OVER (ORDER BY source, "group", w) - 1) AS doc_id, source, "group", strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start FROM k""")
def w2_document_ids(spark, d):
    w = windows.roll_up(Z.labelled(spark, d), "6 hours").select("source", "group", "window_start")
    return windows.number(w).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {Z.SQL_LABELLED}, n AS (SELECT source, "group", time_bucket(INTERVAL '1 day', datetime) AS w, lang, count(*) AS n FROM l GROUP BY 1, 2, 3, 4)
SELECT source, "group", strftime(w, '%Y-%m-%d') AS day, lang, round_even(n / sum(n) OVER (PARTITION BY source, "group", w), 4) AS share FROM n""")
def w3_language_mix(spark, d):
    w = windows.roll_up(Z.labelled(spark, d), "1 day")
    return w.select("source", "group", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.explode("lang_distribution").alias("lang", "share"))


_HEX = "('0x' || substr(sha256(t), 1, 8))::BIGINT"


@query(f"""WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM benchmark),
c AS (SELECT item_id, ({_HEX} % 384)::INT AS idx, sum(CASE WHEN ('0x' || substr(sha256(t), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY 1, 2 HAVING v <> 0)
SELECT item_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def w4_hash_embedding(spark, d):
    b = Z.table(spark, d, "benchmark").select("item_id", topics.hash_embedding(F.col("text")).alias("v"))
    return b.select("item_id", F.posexplode("v").alias("idx", "value")).filter("value <> 0").select("item_id", "idx", F.round(F.col("value").cast("double"), 6).alias("value"))


SQL["w4_hash_embedding_long"] = SQL["w4_hash_embedding"]


@query(SQL["w4_hash_embedding"])
def w4_hash_embedding_long(spark, d):
    return topics.hash_embedding_long(Z.table(spark, d, "benchmark"), "item_id", "text").withColumn("value", F.round("value", 6))


@query("WITH e AS (SELECT item_id, unnest([length(text), length(text) - length(replace(text, ' ', '')), 1]) AS v, unnest([0, 1, 2]) AS idx FROM benchmark) SELECT item_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 2) AS value FROM e")
def w5_model_embedding(spark, d):
    def encoder():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count(" "), 1.0] for t in texts])

    found = topics.model_embedding(Z.table(spark, d, "benchmark"), "text", encoder).select("item_id", F.posexplode("embedding").alias("idx", "value"))
    return found.withColumn("value", F.round(F.col("value").cast("double"), 2))


@query()
def w6_kmeans(spark, d):
    return topics.kmeans_topics(Z.table(spark, d, "embeddings"), 10, 42).select("vec_id", "topic_id")


@query("SELECT doc_id, (('0x' || substr(sha256(coalesce(text, '')), 1, 8))::BIGINT % 12)::INT AS topic_id FROM documents")
def w7_hash_topics(spark, d):
    return _docs(spark, d).select("doc_id", topics.hash_topic(F.col("text"), 12).alias("topic_id"))


_TFIDF = r"""WITH d AS (SELECT doc_id, ('x' || (doc_id % 5)) AS topic_id, text FROM documents),
t AS (SELECT topic_id, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{3,}')) AS term FROM d),
tf AS (SELECT topic_id, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT topic_id, count(*) AS n FROM d GROUP BY topic_id),
k AS (SELECT topic_id, term, count(*) AS df, row_number() OVER (PARTITION BY topic_id ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY topic_id, term),
w AS (SELECT tf.topic_id, doc_id, tf.term, n, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN k ON tf.topic_id = k.topic_id AND tf.term = k.term AND r <= 2000 JOIN n ON n.topic_id = tf.topic_id),
u AS (SELECT topic_id, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id, doc_id)) AS u FROM w),
s AS (SELECT topic_id, term, sum(u) / any_value(n) AS score FROM u GROUP BY topic_id, term),
f AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, term DESC) AS rank FROM s)
SELECT topic_id, term, round(score, 6) AS score, rank::INT AS rank FROM f WHERE rank <= 5"""


@query(_TFIDF)
def w8_tfidf_labels(spark, d):
    docs = _docs(spark, d).withColumn("topic_id", F.concat(F.lit("x"), (F.col("doc_id") % 5).cast("string")))
    return topics.tfidf_labels(docs).withColumn("score", F.round("score", 6))


@query(r"""WITH t AS (SELECT (doc_id % 5)::INT AS topic_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: length(x) >= 3)) AS term FROM documents),
c AS (SELECT topic_id, term, count(*) AS count, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, term) AS rank FROM t GROUP BY topic_id, term)
SELECT topic_id, term, count, rank::INT AS rank FROM c WHERE rank <= 5""")
def w9_count_labels(spark, d):
    return topics.count_labels(_docs(spark, d).withColumn("topic_id", (F.col("doc_id") % 5).cast("int")))


@query("""SELECT count(*) AS documents, sum(n_chars)::BIGINT AS messages, (count(*) FILTER (doc_id % 4 > 0)) / count(*) AS document_coverage, (sum(n_chars) FILTER (doc_id % 4 > 0)) / sum(n_chars) AS message_coverage, count(DISTINCT doc_id % 4) FILTER (doc_id % 4 > 0) AS topics FROM documents""")
def w10_coverage(spark, d):
    docs = _docs(spark, d).withColumns({"topic_id": F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4).otherwise(-1), "message_count": F.col("n_chars")})
    return topics.coverage(docs)


@query("""WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), a AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM c GROUP BY a)), b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b""")
def w11_adjusted_rand(spark, d):
    e = Z.table(spark, d, "embeddings").withColumn("b", F.col("vec_id") % 10)
    return topics.adjusted_rand(e, "label", "b").select(F.round("ari", 6).alias("ari"))


@query()
def w11_stability(spark, d):
    return topics.stability(Z.table(spark, d, "embeddings").select("vec_id", "embedding"), 10, 42)


@query(r"""WITH t AS (SELECT (doc_id % 5)::INT AS topic_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: length(x) >= 3)) AS term FROM documents),
c AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, term) AS rank FROM t GROUP BY topic_id, term),
l AS (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS label FROM c WHERE rank <= 5 GROUP BY topic_id),
f AS (SELECT (doc_id % 5)::INT AS topic_id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id)::INT AS rank, doc_id, substr(text, 1, 300) AS text FROM documents)
SELECT topic_id, rank, doc_id, text, label FROM f LEFT JOIN l USING (topic_id) WHERE rank <= 3""")
def w12_topic_preview(spark, d):
    docs = _docs(spark, d).withColumn("topic_id", (F.col("doc_id") % 5).cast("int"))
    return topics.preview(docs, topics.count_labels(docs))


# Counts and shares


def _share_sql(cte: str, child: str, parent: str = "", where: str = "true") -> str:
    keys = ", ".join(x for x in (parent, child) if x)
    over = f"PARTITION BY {parent}" if parent else ""
    return f"WITH {cte} SELECT {keys}, count(*) AS count, count(*) / sum(count(*)) OVER ({over}) AS share FROM {'x' if cte is Z.SQL_MENTIONED else 'l'} WHERE {where} GROUP BY {keys}"


_SHARES = {
    "a1_topic_distribution": ("l", "topic_id", ""), "a2_temporal_dynamics": ("l", "topic_id", "period"), "a3_group_comparison": ("l", "topic_id", '"group"'),
    "a5_driver_temporal": ("l", "theme", "period"), "a6_driver_by_group": ("l", "theme", '"group"'),
    "a11_topics_per_toponym": ("x", "topic_id", "toponym"), "a12_sentiment_per_toponym": ("x", "sentiment", "toponym"), "a13_drivers_per_toponym": ("x", "theme", "toponym"),
    "a13_source_per_toponym": ("x", "source", "toponym"), "a15_perception": ("l", "place_perception", ""), "a15_perception_by_toponym": ("x", "place_perception", "toponym"), "a15_perception_by_source": ("l", "place_perception", "source"),
}
for _name, (_base, _child, _parent) in _SHARES.items():
    QUERIES[_name] = lambda spark, d, b=_base, c=_child, p=_parent: D.breakdown((Z.labelled if b == "l" else Z.mentioned)(spark, d), c, [p.strip('"')] if p else [])
    SQL[_name] = _share_sql(Z.SQL_LABELLED if _base == "l" else Z.SQL_MENTIONED, _child, _parent)


@query(f"WITH {Z.SQL_LABELLED}, {Z.SQL_THEME_LIST} SELECT th.theme, count(l.row_id) AS count, count(l.row_id) / sum(count(l.row_id)) OVER () AS share FROM th LEFT JOIN l USING (theme) GROUP BY 1")
def a4_driver_distribution(spark, d):
    return D.closed_distribution(Z.labelled(spark, d), "theme", list(Z.THEMES))


@query(f"WITH {Z.SQL_MENTIONED} SELECT toponym, count(*) AS count, count(*) / sum(count(*)) OVER () AS share, any_value(type) AS type, any_value(parent_city) AS parent_city FROM x GROUP BY toponym")
def a7_toponym_frequency(spark, d):
    return D.place_frequency(Z.mentioned(spark, d).select("toponym"), X.gazetteer_frame(spark, Z.META))


@query(f"WITH {Z.SQL_MENTIONED} SELECT toponym, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM x GROUP BY toponym ORDER BY count DESC, toponym LIMIT 3")
def a8_top_toponyms(spark, d):
    return D.top_places(Z.mentioned(spark, d), 3)


QUERIES["a9_city_stats"] = lambda spark, d: D.city_stats(Z.mentioned(spark, d))
SQL["a9_city_stats"] = _share_sql(Z.SQL_MENTIONED, "parent_city", "", "parent_city IS NOT NULL")
QUERIES["a10_district_stats"] = lambda spark, d: D.district_stats(Z.mentioned(spark, d))
SQL["a10_district_stats"] = _share_sql(Z.SQL_MENTIONED, "toponym", "parent_city", "type = 'district'")
QUERIES["a14_source_comparison"] = lambda spark, d: D.source_comparison(Z.mentioned(spark, d))
SQL["a14_source_comparison"] = f"WITH {Z.SQL_MENTIONED} SELECT lower(coalesce(source, 'unknown')) AS source, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM x GROUP BY 1"


@query(f"WITH {Z.SQL_LABELLED}, {Z.SQL_THEME_LIST} SELECT th.theme, count(l.row_id) AS count, least(count(l.row_id), 5) AS evidence_count, CASE WHEN count(l.row_id) > 0 THEN 'observed' ELSE 'absent' END AS status FROM th LEFT JOIN l USING (theme) GROUP BY 1")
def a16_narrative_matrix(spark, d):
    return D.narrative_matrix(Z.labelled(spark, d), "theme", list(Z.THEMES))


@query("""WITH p AS (SELECT source AS dataset, 'lang' AS "column", coalesce(lang, 'missing') AS value FROM documents UNION ALL SELECT source, 'n_chars', coalesce(n_chars::VARCHAR, 'missing') FROM documents),
c AS (SELECT dataset, "column", value, count(*) AS count FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, "column" ORDER BY count DESC, value)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 20""")
def a17_value_signals(spark, d):
    return D.value_signals(_docs(spark, d).withColumn("dataset", F.col("source")), ["lang", "n_chars"])


@query("SELECT 'event_id, ts, user_id, event_type, value, props' AS columns, count(*) AS row_count, 'ts' AS date_column, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date FROM events")
def a18_profile(spark, d):
    p = D.profile(Z.table(spark, d, "events")).drop("sample")
    return p.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_date", "last_date")})


@query("WITH j AS (SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name})::VARCHAR AS j FROM customer ORDER BY 1 LIMIT 5) SELECT (SELECT count(*) FROM customer) AS row_count, 'c_custkey, c_name' AS columns, unnest(list(j)) AS sample_row FROM j")
def a18_profile_sample(spark, d):
    return D.profile(Z.table(spark, d, "customer").select("c_custkey", "c_name")).select("row_count", "columns", F.explode("sample").alias("sample_row"))


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS code, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1")
def a19_code_frequency(spark, d):
    return D.code_frequency(_docs(spark, d), "lang")


@query("""WITH a AS (SELECT event_id AS annotation_id, 'c' || (user_id % 3) AS coder_id, event_type AS "group", strftime(ts, '%Y-%m') AS period, CASE WHEN event_id % 10 = 0 THEN props END AS memo FROM events),
m AS (SELECT list(memo ORDER BY annotation_id) AS memos FROM (SELECT * FROM a WHERE memo IS NOT NULL ORDER BY annotation_id LIMIT 20))
SELECT count(*) AS n_rows, list_sort(list(DISTINCT coder_id)) AS coder_ids, list_sort(list(DISTINCT "group")) AS groups, list_sort(list(DISTINCT period)) AS periods, any_value(memos) AS memos FROM a, m""")
def a19_coding_summary(spark, d):
    e = Z.table(spark, d, "events")
    a = e.select(F.col("event_id").alias("annotation_id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("coder_id"), F.col("event_type").alias("group"), F.date_format("ts", "yyyy-MM").alias("period"), F.when(F.col("event_id") % 10 == 0, F.col("props")).alias("memo"))
    return D.coding_summary(a)


_PAIR = "WITH a AS (SELECT ['u' || (user_id % 3), event_type] AS r, ['k' || (event_id % 4)] AS c FROM events), p AS (SELECT x.r AS row_code, y.c AS column_code FROM a, unnest(a.r) x(r), unnest(a.c) y(c))"


def _fields(spark, d):
    return Z.table(spark, d, "events").select(F.array(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), "event_type").alias("r"), F.array(F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("c"))


for _norm, _over in ((None, None), ("row", "PARTITION BY row_code"), ("column", "PARTITION BY column_code"), ("all", "")):
    QUERIES[f"a20_code_matrix_{_norm or 'counts'}"] = lambda spark, d, n=_norm: D.code_matrix(_fields(spark, d), "r", "c", n)
    SQL[f"a20_code_matrix_{_norm or 'counts'}"] = f"{_PAIR} SELECT row_code, column_code, " + ("count(*)::DOUBLE" if _over is None else f"count(*) / sum(count(*)) OVER ({_over})") + " AS value FROM p GROUP BY row_code, column_code"


@query(f"""WITH {Z.SQL_LABELLED}, s AS (SELECT "group", topic_id, count(*) / sum(count(*)) OVER (PARTITION BY "group") AS share FROM l GROUP BY 1, 2) SELECT "group", """ + ", ".join(f'coalesce(max(share) FILTER (topic_id = {k}), 0)::DOUBLE AS "{k}"' for k in range(7)) + ' FROM s GROUP BY "group"')
def a21_wide_shares(spark, d):
    return D.wide(D.breakdown(Z.labelled(spark, d), "topic_id", "group"), "group", "topic_id", list(range(7)))
