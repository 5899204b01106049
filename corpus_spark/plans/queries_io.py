"""Queries of readers, writers and whole workloads: their input is written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import lexicon as X
from corpus_spark.operators import topics
from corpus_spark.plans import bindings as Z
from corpus_spark.plans import corpus
from corpus_spark.plans.queries import query
from corpus_spark.plans.queries_more import _chunks
from corpus_spark.sources import comments
from corpus_spark.sources import tables as S
from corpus_spark.sources.scratch import fresh_path

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_ROWS = f"""WITH {Z.SQL_MESSAGES}, r AS (SELECT row_id, strftime(datetime, '%d.%m.%Y %H:%M:%S UTC+00:00') AS datetime, author, "group", comment, source FROM m)"""


def _rows(spark, d) -> DataFrame:
    return Z.messages(spark, d).withColumn("datetime", F.date_format("datetime", "dd.MM.yyyy HH:mm:ss 'UTC+00:00'"))


@query(_ROWS + """ SELECT datetime, author, "group", coalesce(comment, '') AS comment FROM r""")
def io1_read_plain(spark, d):
    """Comments of many lines, with quotes and commas, as CSV."""
    path = fresh_path(spark, "comments-csv")
    _rows(spark, d).select("group", "comment", "datetime", "source", "author").write.options(**_CSV).csv(path)
    return comments.read_plain(spark, path).withColumn("comment", F.coalesce("comment", F.lit("")))


@query(_ROWS + r""", c AS (SELECT *, trim(regexp_replace(replace(coalesce(comment, ''), '"', ''''), '\s+', ' ', 'g'), ' ') AS said FROM r) SELECT datetime, author, "group", said AS comment FROM c WHERE said <> ''""")
def io2_read_broken(spark, d):
    """Lines quoted as a whole, and lines with bare commas in the comment; headers and empty lines between them."""
    path = fresh_path(spark, "broken-csv")
    said = F.trim(F.regexp_replace(F.replace(F.coalesce("comment", F.lit("")), F.lit('"'), F.lit("'")), r"\s+", " "))
    head = F.concat_ws(",", "datetime", "author", "group")
    quoted = F.concat(F.lit('"'), head, F.lit(',""'), said, F.lit('"""'))
    line = F.when(F.col("row_id") % 2 == 0, quoted).otherwise(F.concat(head, F.lit(","), said))
    more = F.when(F.col("row_id") % 10 == 0, F.lit("datetime,author,group,comment")).when(F.col("row_id") % 10 == 1, F.lit("")).when(F.col("row_id") % 10 == 2, F.lit("too,short"))
    _rows(spark, d).select(F.explode(F.array_compact(F.array(line, more))).alias("value")).write.text(path)
    return comments.read_broken(spark, path)


@query("SELECT event_id, to_json([event_type, 'u' || user_id])::VARCHAR AS tags, to_json({'k': event_type})::VARCHAR AS about, 'csv' AS kind FROM events UNION ALL SELECT event_id, event_type || '+u' || user_id, event_type, 'parquet' FROM events")
def io6_export(spark, d):
    """Nested columns written as CSV and as Parquet, read back from both."""
    folder = fresh_path(spark, "export")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = Z.table(spark, d, "events").select("event_id", F.array("event_type", user).alias("tags"), F.struct(F.col("event_type").alias("k")).alias("about"))
    for kind in ("csv", "parquet"):
        S.export({f"events_{kind}": rows}, folder, kind)
    flat = spark.read.schema("event_id long, tags string, about string").options(header=True).csv(f"{folder}/events_csv").withColumn("kind", F.lit("csv"))
    back = spark.read.schema(rows.schema).parquet(f"{folder}/events_parquet").select("event_id", F.array_join("tags", "+").alias("tags"), F.col("about.k").alias("about"), F.lit("parquet").alias("kind"))
    return flat.unionByName(back)


@query(f"WITH {Z.SQL_MENTIONED}, r AS (SELECT row_id, toponym, row_number() OVER (PARTITION BY toponym ORDER BY row_id) AS r FROM x) SELECT toponym, toponym AS place, row_id, count(*) OVER (PARTITION BY toponym) AS of_place FROM r WHERE r <= 40")
def io7_export_by_place(spark, d):
    """Folders of places, read back and met with their manifest."""
    folder = fresh_path(spark, "places")
    manifest = S.export_by_place(Z.mentioned(spark, d).select("row_id", "toponym"), folder, 40, "row_id")
    back = spark.read.schema("row_id long, toponym string, place string").options(header=True).csv(folder)
    return back.join(manifest.select("toponym", F.col("rows").alias("of_place")), "toponym").select("toponym", "place", "row_id", "of_place")


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
SELECT sum(CASE WHEN length(t) <= 1200 THEN 1 ELSE ceil((length(t) - 1200) / 1000) + 1 END)::BIGINT AS chunks, count(DISTINCT doc_id) AS documents, 384 AS dimensions FROM d WHERE t <> ''""")
def io10_write_index(spark, d):
    return S.write_index(_chunks(spark, d, 1200, 200).withColumn("embedding", topics.hash_embedding(F.col("text"))), fresh_path(spark, "index"))


@query("SELECT 'e' || s_suppkey AS experiment, s_name AS runner, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS best FROM supplier")
def io12_manifests(spark, d):
    """JSON files of one run and of up to 99, two for every hundred runs, some with a byte order mark."""
    folder, k = fresh_path(spark, "manifests"), F.col("s_suppkey")
    run = F.struct(F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.col("s_name").alias("runner")).alias("experiment"), F.struct(F.col("s_nationkey").alias("nation")).alias("params"), F.struct(F.when(k % 2 == 0, F.col("s_name")).alias("best")).alias("result"))
    files = Z.table(spark, d, "supplier").groupBy(F.expr("s_suppkey div 100").alias("file"), (k % 100 == 0).alias("alone")).agg(F.collect_list(run).alias("runs"))
    mark = F.when(F.col("file") % 3 == 0, F.lit("﻿")).otherwise("")
    text = F.when(F.col("alone"), F.to_json(F.get("runs", F.lit(0)))).otherwise(F.to_json("runs"))
    # files lie side by side in one folder, and tasks, not the driver, put them there
    files.select(F.concat(mark, text).alias("value")).write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(folder)
    return S.manifests(spark, folder, "*.txt").select(F.col("experiment.id").alias("experiment"), F.col("experiment.runner").alias("runner"), F.col("params")["nation"].alias("nation"), F.col("result")["best"].alias("best"))


@query("SELECT event_id::VARCHAR AS event, event_type AS text, '{\"user\":' || user_id || '}' AS about FROM events")
def io13_evidence_rows(spark, d):
    """Evidence documents in their three forms, a document for each user and type."""
    item = F.struct(F.col("event_id").cast("string").alias("event"), F.col("event_type").alias("text"), F.struct(F.col("user_id").alias("user")).alias("about"))
    each = Z.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(item).alias("items"))
    k = F.col("user_id") % 3
    form = F.when(k == 0, F.to_json(F.struct(F.col("items").alias("evidence_items")))).when(k == 1, F.to_json(F.struct(F.col("items").alias("evidence")))).otherwise(F.to_json(F.struct("items")))
    got = S.evidence_rows(each.select(form.alias("value")))
    return got.select(F.col("item")["event"].alias("event"), F.col("item")["text"].alias("text"), F.col("item")["about"].alias("about"))


# Whole workloads: comments to enriched documents and their tables

_DOCS = Z.SQL_CLEAN + f""", k AS (SELECT *, strftime(datetime, '%Y-%m') AS period, {Z.SQL_LANG} AS lang FROM c WHERE length(clean_text) >= 5),
w AS (SELECT source, "group", time_bucket(INTERVAL '6 hours', datetime) AS t, min_by(period, datetime) AS period, string_agg(clean_text, chr(10) ORDER BY datetime, row_id) AS text, count(*) AS message_count FROM k GROUP BY 1, 2, 3),
n AS (SELECT printf('doc_%08d', row_number() OVER (ORDER BY source, "group", t) - 1) AS doc_id, *, (('0x' || substr(sha256(text), 1, 8))::BIGINT % 10)::INT AS topic_id FROM w)"""


def _enriched(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    return corpus.corpus_pipeline(Z.messages(spark, d), Z.GAZETTEER, X.gazetteer_frame(spark, Z.META), Z.SALT, "6 hours")


@query(f"WITH {_DOCS} SELECT doc_id, source, \"group\", period, text, message_count, topic_id, {Z.SQL_PLACES.replace('clean_text', 'text')} AS toponyms FROM n")
def p1_corpus_documents(spark, d):
    """Cleaned, windowed, numbered and labelled documents from raw comments."""
    return _enriched(spark, d)[0].select("doc_id", "source", "group", "period", "text", "message_count", "topic_id", "toponyms")


@query(f"WITH {_DOCS}, x AS (SELECT unnest({Z.SQL_PLACES.replace('clean_text', 'text')}) AS toponym, topic_id FROM n) SELECT toponym, topic_id, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY toponym) AS share FROM x GROUP BY toponym, topic_id")
def p2_corpus_topics_per_toponym(spark, d):
    return _enriched(spark, d)[1]["topics_per_toponym"]


@query(f"WITH {_DOCS} SELECT period, topic_id, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY period) AS share FROM n GROUP BY period, topic_id")
def p3_corpus_temporal_dynamics(spark, d):
    return _enriched(spark, d)[1]["temporal_dynamics"]
