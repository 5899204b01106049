"""Queries of sampling, coding, retrieval, records, runs and streaming; see queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import bibliography as B
from corpus_spark.operators import coding, retrieval, runs, sampling, topics
from corpus_spark.operators import lexicon as X
from corpus_spark.plans import bindings as Z
from corpus_spark.plans.queries import QUERIES, SQL, _docs, query
from corpus_spark.sources import tables as S
from corpus_spark.sources.scratch import fresh_path

# Sampling: rows by md5 of seed and id, in both engines


def _h(row: str = "doc_id", seed: int = 42) -> str:
    return f"md5('{seed}:' || {row})"


@query(f"SELECT doc_id, source FROM documents ORDER BY {_h()}, doc_id LIMIT 50")
def s1_simple(spark, d):
    return sampling.simple(_docs(spark, d).select("doc_id", "source"), 50, 42, "doc_id")


@query(f"WITH {Z.SQL_LABELLED} SELECT row_id FROM l WHERE list_contains(toponyms, 'Estia') ORDER BY {_h('row_id')}, row_id LIMIT 20")
def s2_by_place(spark, d):
    return sampling.by_place(Z.labelled(spark, d), "Estia", 20, 42, "row_id").select("row_id")


def _quota_sql(cte: str, table: str, row: str, keys: str, n: int) -> str:
    return f"""{cte} b AS (SELECT {row} AS id, {_h(row)} AS h, {keys} FROM {table}), q AS (SELECT greatest(1, {n} // count(*)) AS q FROM (SELECT DISTINCT {keys.split(' AS ')[-1] if ' AS ' in keys else keys} FROM b)),
r AS (SELECT id, h, row_number() OVER (PARTITION BY {keys.split(' AS ')[-1] if ' AS ' in keys else keys} ORDER BY h, id) AS r FROM b) SELECT id AS {row} FROM r, q ORDER BY CASE WHEN r <= q THEN 0 ELSE 1 END, h, id LIMIT {n}"""


@query(_quota_sql("WITH", "documents", "doc_id", "source", 90))
def s3_equal_quota(spark, d):
    return sampling.equal_quota(_docs(spark, d), ["source"], 90, 42, "doc_id").select("doc_id")


_TWO = f"WITH {Z.SQL_LABELLED}, y AS (SELECT row_id, period, coalesce(toponyms[1], 'unknown') AS primary_toponym FROM l), b AS (SELECT row_id AS id, {_h('row_id')} AS h, primary_toponym, period FROM y), q AS (SELECT greatest(1, 60 // count(*)) AS q FROM (SELECT DISTINCT primary_toponym, period FROM b)), r AS (SELECT id, h, row_number() OVER (PARTITION BY primary_toponym, period ORDER BY h, id) AS r FROM b) SELECT id AS row_id FROM r, q ORDER BY CASE WHEN r <= q THEN 0 ELSE 1 END, h, id LIMIT 60"


@query(_TWO)
def s4_two_way(spark, d):
    return sampling.two_way(Z.labelled(spark, d), "period", 60, 42, "row_id").select("row_id")


_STRATA = f"WITH {Z.SQL_LABELLED}, b AS (SELECT row_id AS id, {_h('row_id')} AS h, source, theme, sentiment, topic_id FROM l @where), r AS (SELECT id, h, row_number() OVER (PARTITION BY source, theme, sentiment, topic_id ORDER BY h, id) AS r FROM b)"


@query(_STRATA.replace("@where", "") + " SELECT id AS row_id FROM r ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, h, id LIMIT 120")
def s5_strata(spark, d):
    return sampling.strata(Z.labelled(spark, d).drop("month"), 120, 42, "row_id").select("row_id")


@query(_STRATA.replace("@where", "WHERE list_contains(toponyms, 'Dela')") + " SELECT 'sample_' || id AS sample_id, id AS row_id, '' AS manual_code, '' AS memo, '' AS coder_id FROM r ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, h, id LIMIT 40")
def s6_coding_sample(spark, d):
    return sampling.coding_sample(Z.labelled(spark, d), 40, 42, "row_id", "Dela").select("sample_id", "row_id", "manual_code", "memo", "coder_id")


@query(f"WITH {Z.SQL_MENTIONED}, t AS (SELECT toponym FROM x GROUP BY toponym ORDER BY count(*) DESC, toponym LIMIT 2), r AS (SELECT row_id, toponym, row_number() OVER (PARTITION BY toponym ORDER BY {_h('row_id')}, row_id) AS r FROM x WHERE toponym IN (SELECT toponym FROM t)) SELECT row_id, toponym, 'E' || r AS evidence_id FROM r WHERE r <= 5")
def s7_per_place(spark, d):
    from corpus_spark.operators.distributions import top_places

    said = Z.mentioned(spark, d).select("row_id", "toponym")
    return sampling.per_place(said, 5, 42, "row_id", top_places(said, 2))


@query(f"WITH {Z.SQL_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY row_id) AS r FROM l) SELECT 'E' || r AS evidence_id, theme, row_id, substr(clean_text, 1, 100) AS text FROM r WHERE r <= 5")
def s8_evidence(spark, d):
    return sampling.evidence(Z.labelled(spark, d), "theme", 5, "row_id", "clean_text", 100)


@query(f"WITH {Z.SQL_LABELLED} SELECT row_id FROM l WHERE \"group\" = 'click' AND topic_id = 3")
def s9_matching(spark, d):
    return sampling.matching(Z.labelled(spark, d), group="click", topic_id="3", period="").select("row_id")


@query("SELECT printf('ann_%08d', row_number() OVER (ORDER BY doc_id) - 1) AS annotation_id, 'coder-1' AS coder_id, doc_id, text, '' AS sentiment, '' AS memo FROM documents")
def s10_annotation_template(spark, d):
    return sampling.annotation_template(_docs(spark, d), ["annotation_id", "doc_id", "text", "sentiment", "memo"], "coder-1", "doc_id")


# Coders: A is the label table's quality, B a rule on the length of the text

_CODERS = "WITH p AS (SELECT l.doc_id AS annotation_id, l.quality::VARCHAR AS a, CASE WHEN d.n_chars > 600 THEN '1' ELSE '0' END AS b FROM labels l JOIN documents d USING (doc_id))"


def _coders(spark, d) -> DataFrame:
    a = Z.table(spark, d, "labels").select(F.col("doc_id").alias("annotation_id"), F.col("quality").cast("string").alias("code"))
    b = _docs(spark, d).select(F.col("doc_id").alias("annotation_id"), F.when(F.col("n_chars") > 600, "1").otherwise("0").alias("code"))
    return coding.pair(a, b, ["code"])


@query(_CODERS + " SELECT annotation_id, a AS code_a, b AS code_b FROM p")
def j1_pairs(spark, d):
    return _coders(spark, d)


@query(_CODERS + ", c AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) / sum(n) AS po FROM c), ma AS (SELECT a AS k, sum(n) AS n FROM c GROUP BY 1), mb AS (SELECT b AS k, sum(n) AS n FROM c GROUP BY 1), e AS (SELECT sum(ma.n * mb.n) AS s FROM ma JOIN mb USING (k)) SELECT 'code' AS field, t.n::BIGINT AS items, round(po, 9) AS percent_agreement, round((po - s / (t.n * t.n)) / (1 - s / (t.n * t.n)), 9) AS kappa FROM t, e")
def j2_agreement(spark, d):
    return coding.agreement(_coders(spark, d), "code").withColumns({c: F.round(c, 9) for c in ("percent_agreement", "kappa")})


@query(_CODERS + " SELECT coalesce(a, '') AS a, coalesce(b, '') AS b, count(*) AS n FROM p GROUP BY 1, 2")
def j2_confusion(spark, d):
    return coding.confusion(_coders(spark, d), "code")


@query(f"WITH {Z.SQL_LABELLED}, p AS (SELECT toponyms AS a, list_filter(toponyms, lambda x: x <> 'Estia') AS b FROM l) SELECT 'codes' AS field, count(*) AS items, round(avg((list_sort(a) = list_sort(b))::INT), 9) AS exact_match, round(avg(CASE WHEN len(a) = 0 THEN 1 ELSE len(b) / len(a) END), 9) AS mean_jaccard FROM p")
def j3_multi_agreement(spark, d):
    p = Z.labelled(spark, d).select(F.col("toponyms").alias("codes_a"), F.filter("toponyms", lambda x: x != "Estia").alias("codes_b"))
    return coding.multi_agreement(p, "codes").withColumns({c: F.round(c, 9) for c in ("exact_match", "mean_jaccard")})


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'de'")
def j4_segments(spark, d):
    return coding.coded_segments(_docs(spark, d).drop("n_chars"), "de").select("doc_id")


_NOTES = "WITH a AS (SELECT event_id::VARCHAR AS annotation_id, CASE WHEN event_id % 50 > 0 THEN user_id::VARCHAR ELSE ' ' END AS doc_id, event_type AS code, 'x;' || event_type AS many FROM events)"
_CODES = ("click", "view", "x")


@query(_NOTES + ", v AS (SELECT annotation_id, 'code' AS col, code AS v FROM a UNION ALL SELECT annotation_id, 'many', u.v FROM a, unnest(['x', code]) u(v)) SELECT annotation_id, col AS \"column\", 'unknown code' AS problem, v AS value FROM v WHERE v NOT IN ('click', 'view', 'x') UNION ALL SELECT annotation_id, 'doc_id', 'empty', NULL FROM a WHERE trim(doc_id) = '' UNION ALL SELECT NULL, 'coder_id', 'missing column', NULL")
def j5_violations(spark, d):
    e = Z.table(spark, d, "events")
    a = e.select(F.col("event_id").cast("string").alias("annotation_id"), F.when(F.col("event_id") % 50 > 0, F.col("user_id").cast("string")).otherwise(" ").alias("doc_id"), F.col("event_type").alias("code"), F.concat(F.lit("x;"), "event_type").alias("many"))
    codes = spark.createDataFrame([("g", c) for c in _CODES], "code_group string, code string")
    return coding.violations(a, [("doc_id", "string", True, None), ("coder_id", "string", True, None), ("code", "category", True, "g"), ("many", "multi_category", False, "g")], codes)


_BOOK = "WITH b AS (SELECT 'n' || p_partkey AS code_id, CASE WHEN p_partkey % 4 = 0 THEN 'x' || p_partkey WHEN p_partkey % 4 = 1 THEN 'n0' END AS parent_id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS description, 'g' || (p_partkey % 3) AS mutually_exclusive_group, p_brand AS book FROM part UNION ALL SELECT 'n1', NULL, 'again', 'g0', 'more')"


def _book(spark, d):
    k = F.col("p_partkey")
    one = Z.table(spark, d, "part").select(F.concat(F.lit("n"), k.cast("string")).alias("code_id"), F.when(k % 4 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 4 == 1, "n0").alias("parent_id"), F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("description"), F.concat(F.lit("g"), (k % 3).cast("string")).alias("mutually_exclusive_group"), F.col("p_brand").alias("book"))
    return one.unionByName(spark.createDataFrame([("n1", None, "again", "g0", "more")], one.schema))


@query(_BOOK + " SELECT code_id, 'duplicate id' AS problem FROM b GROUP BY code_id HAVING count(*) > 1 UNION ALL SELECT code_id, 'empty description' FROM b WHERE trim(description) = '' UNION ALL SELECT code_id, 'unknown parent' FROM b WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT code_id FROM b)")
def j6_codebook_problems(spark, d):
    return coding.codebook_problems(_book(spark, d))


@query(_BOOK + " SELECT DISTINCT code_id FROM b WHERE mutually_exclusive_group = 'g1'")
def j7_group_codes(spark, d):
    books = _book(spark, d).groupBy("book").agg(F.collect_list(F.struct("code_id", "mutually_exclusive_group")).alias("codes"))
    return coding.group_codes(coding.flatten_codebook(books), "g1")


# Retrieval

_CHUNKS = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
k AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 400 THEN 1 ELSE ceil((length(t) - 400) / 300)::BIGINT + 1 END)) AS k FROM d)"""


def _chunks(spark, d, size=400, overlap=100):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("filename"), F.col("source").alias("path"), retrieval.plain_pages(F.col("text")).alias("pages"))
    return retrieval.chunk(docs, size, overlap)


@query(_CHUNKS + " SELECT doc_id || printf('_%06d', k) AS chunk_id, doc_id, k::INT AS chunk_index, trim(substr(t, (k * 300)::INT + 1, 400)) AS text, (k * 300)::INT AS char_start, least(k * 300 + 400, length(t))::INT AS char_end FROM k")
def r1_chunks(spark, d):
    return _chunks(spark, d).drop("filename", "path", "page_number")


_NEAR = "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]) AS score FROM embeddings v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5"


@query(_NEAR)
def r2_nearest(spark, d):
    e = Z.table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(e, q, 5, "vec_id", ["vec_id"]).withColumn("score", F.round("score", 6))


def _found(spark, d, k=8):
    """Chunks of documents found for tasks made of benchmark items, by hash embedding."""
    chunks = _chunks(spark, d, 1200, 200).withColumn("embedding", topics.hash_embedding(F.col("text"), kind="double"))
    asked = retrieval.task_queries(_tasks(spark, d)).withColumn("query_id", F.concat_ws("/", "task_id", F.col("turn").cast("string")))
    queries = asked.withColumn("embedding", topics.hash_embedding(F.col("query"), kind="double"))
    hits = retrieval.nearest(chunks, queries, k, "chunk_id", ["filename", "page_number", "chunk_index", "text"], digits=9)
    return hits.join(asked, "query_id")


def _tasks(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) >= 5)
    return Z.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("question_en"), F.lit("").alias("question_ru"), words.alias("keywords"), F.lit("t").alias("title"), retrieval.task_terms(F.col("text"), F.lit("")).alias("terms"))


_ASKED = r"""WITH b AS (SELECT item_id::VARCHAR AS task_id, text AS q, list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) >= 5) AS k, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+'), lambda w: length(w) >= 5)) AS terms FROM benchmark),
u AS (SELECT task_id, 0 AS turn, trim(q, ' ') AS query FROM b UNION ALL SELECT task_id, 1, array_to_string(k, ' ') FROM b WHERE len(k) > 0)"""


@query(_ASKED + " SELECT * FROM u")
def r3_task_queries(spark, d):
    return retrieval.task_queries(_tasks(spark, d))


def _cells(table: str, key: str, text: str) -> str:
    """(key, idx, v, norm) of hash embeddings, sparse."""
    return f"""(SELECT {key}, idx, v, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM (
  SELECT {key}, (('0x' || substr(sha256(t), 1, 8))::BIGINT % 384)::INT AS idx, sum(CASE WHEN ('0x' || substr(sha256(t), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')) AS t FROM {table}) GROUP BY {key}, idx HAVING v <> 0))"""


_EVIDENCE = _ASKED + f""", d AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
n AS (SELECT doc_id, source, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1200 THEN 1 ELSE ceil((length(t) - 1200) / 1000)::BIGINT + 1 END)) AS k FROM d),
ck AS (SELECT doc_id || printf('_%06d', k) AS chunk_id, source AS filename, k::INT AS chunk_index, trim(substr(t, (k * 1000)::INT + 1, 1200)) AS text FROM n),
uq AS (SELECT task_id || '/' || turn AS query_id, * FROM u),
sc AS (SELECT q.query_id, c.chunk_id, round(sum(q.v * c.v) / (any_value(q.norm) * any_value(c.norm)), 9) AS score FROM {_cells('uq', 'query_id', 'query')} q JOIN {_cells('ck', 'chunk_id', 'text')} c ON q.idx = c.idx GROUP BY q.query_id, c.chunk_id),
f1 AS (SELECT uq.task_id, uq.turn, sc.query_id, ck.*, sc.score, row_number() OVER (PARTITION BY sc.query_id, filename, chunk_index, text ORDER BY sc.score DESC, ck.chunk_id) AS f FROM sc JOIN ck USING (chunk_id) JOIN uq USING (query_id)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f1 WHERE f = 1),
f3 AS (SELECT *, row_number() OVER (PARTITION BY task_id, filename, chunk_index ORDER BY turn, rank) AS g FROM f2 WHERE rank <= 8),
f4 AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, turn, rank) AS r FROM f3 WHERE g = 1),
ev AS (SELECT task_id, 'E' || r AS evidence_id, filename, chunk_index, score, text FROM f4 WHERE r <= 10)"""


@query(_EVIDENCE + " SELECT task_id, evidence_id, filename, chunk_index, round(score, 6) AS score FROM ev")
def r4_evidence(spark, d):
    return retrieval.collect_evidence(_found(spark, d), 10).select("task_id", "evidence_id", "filename", "chunk_index", F.round("score", 6).alias("score"))


_EV = "WITH e AS (SELECT (user_id % 4)::VARCHAR AS task_id, 'E' || event_id AS eid, value AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, eid) AS r FROM e WHERE score >= 20)"


@query(_EV + " SELECT task_id, 'E' || r AS evidence_id, score FROM r WHERE r <= 12")
def r5_filter_evidence(spark, d):
    e = Z.table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("task_id"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("evidence_id"), F.col("value").alias("score"))
    return retrieval.filter_evidence(e, 20.0, 12)


_SENTENCES = _EVIDENCE + r""", st AS (SELECT task_id, evidence_id, score, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM ev),
pt AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20) AS parts FROM st),
se AS (SELECT task_id, evidence_id, score, unnest(CASE WHEN len(parts) > 0 THEN parts ELSE [t] END) AS sentence FROM pt),
hs AS (SELECT se.task_id, evidence_id, sentence, lower(sentence) AS low, score + 0.2::DOUBLE * len(list_filter(k, lambda x: contains(lower(sentence), lower(x)))) + 0.1::DOUBLE * len(list_filter(terms, lambda x: contains(lower(sentence), x))) AS score FROM se JOIN b USING (task_id) WHERE sentence <> ''),
o1 AS (SELECT *, row_number() OVER (PARTITION BY task_id, low ORDER BY score DESC, evidence_id) AS f FROM hs),
bs AS (SELECT * FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, low) AS rank, sentence, score, evidence_id FROM o1 WHERE f = 1) WHERE rank <= 5)"""


@query(_SENTENCES + " SELECT task_id, rank::INT AS rank, sentence, round(score, 6) AS score, evidence_id FROM bs")
def r6_best_sentences(spark, d):
    return retrieval.best_sentences(retrieval.collect_evidence(_found(spark, d), 10), _tasks(spark, d)).withColumn("score", F.round("score", 6))


def _terms(spark, d):
    """The tasks' keywords as concepts, and two lists for all of them."""
    tasks = _tasks(spark, d)
    own = tasks.select("task_id", F.lit("concept").alias("kind"), F.posexplode("keywords").alias("ord", "term"))
    lists = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("ord"), F.lit(term).alias("term")) for kind, k, term in (("method", 0, "thon"), ("method", 1, "eau"), ("limitation", 0, "xylophone"))))
    return own.unionByName(tasks.select("task_id", F.inline(lists)))


_CONCEPTS = """, tx AS (SELECT task_id, unnest(k) AS term, generate_subscripts(k, 1) AS ord FROM b),
th AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.task_id = tx.task_id AND contains(lower(ev.text), lower(tx.term))) AS hit FROM tx),
co AS (SELECT task_id, coalesce((list(term ORDER BY ord) FILTER (hit))[1:10], list(term ORDER BY ord)[1:10]) AS concepts FROM th GROUP BY task_id)"""


@query(_EVIDENCE + _CONCEPTS + " SELECT * FROM co")
def r7_concepts(spark, d):
    terms = _terms(spark, d)
    return retrieval.concepts(retrieval.terms_present(retrieval.collect_evidence(_found(spark, d), 10), terms), terms)


@query(_SENTENCES + _CONCEPTS + """, fi AS (SELECT task_id, list(sentence ORDER BY rank) AS findings FROM bs GROUP BY task_id),
me AS (SELECT task_id, list_filter(['thon', 'eau'], lambda m: list_contains(list_transform(l, lambda x: contains(x, m)), true)) AS methods FROM (SELECT task_id, list(lower(text)) AS l FROM ev GROUP BY task_id)),
us AS (SELECT task_id, list(evidence_id ORDER BY evidence_id) AS used FROM ev GROUP BY task_id)
SELECT b.task_id, coalesce(findings, []) AS findings, coalesce(concepts, []) AS concepts, coalesce(methods, []) AS methods, []::VARCHAR[] AS limitations, coalesce(used, []) AS evidence_used FROM b LEFT JOIN fi USING (task_id) LEFT JOIN co USING (task_id) LEFT JOIN me USING (task_id) LEFT JOIN us USING (task_id)""")
def r8_summaries(spark, d):
    return retrieval.summaries(retrieval.collect_evidence(_found(spark, d), 10), _tasks(spark, d), _terms(spark, d))


# Records: documents as candidates (title: their first line; abstract: the text; doi: md5 of the text, so copies merge)

_CAND = "WITH c AS (SELECT doc_id AS ordinal, 'c' || doc_id AS candidate_id, CASE doc_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'crossref' ELSE 'openalex' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'q1' ELSE 'q9' END AS query_id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 5 > 0 THEN md5(text) END AS doi, CASE WHEN doc_id % 3 = 0 THEN 'https://x.org/abs/' || doc_id ELSE '' END AS url, CASE WHEN doc_id % 4 = 1 THEN 'p' || doc_id ELSE '' END AS pdf_url, CASE WHEN doc_id % 6 = 0 THEN true END AS open_access, (2000 + doc_id % 26)::INT AS year, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 900)::INT END AS citation_count, CASE WHEN doc_id % 3 > 0 THEN text END AS abstract, [source, lang] AS keywords FROM documents)"


def _candidates(spark, d):
    k = F.col("doc_id")
    text = k.cast("string")
    return _docs(spark, d).select(
        k.alias("ordinal"), F.concat(F.lit("c"), text).alias("candidate_id"), F.when(k % 3 == 0, "arxiv").when(k % 3 == 1, "crossref").otherwise("openalex").alias("source"), F.when(k % 2 == 0, "q1").otherwise("q9").alias("query_id"),
        F.split("text", "\n")[0].alias("title"), F.when(k % 5 > 0, F.md5(F.col("text").cast("binary"))).alias("doi"), F.when(k % 3 == 0, F.concat(F.lit("https://x.org/abs/"), text)).otherwise("").alias("url"), F.when(k % 4 == 1, F.concat(F.lit("p"), text)).otherwise("").alias("pdf_url"),
        F.when(k % 6 == 0, True).alias("open_access"), (2000 + k % 26).cast("int").alias("year"), F.when(k % 7 > 0, (k % 900).cast("int")).alias("citation_count"), F.when(k % 3 > 0, F.col("text")).alias("abstract"), F.array("source", "lang").alias("keywords"),
    )


@query("SELECT 'crossref_' || substr(sha1('10.1/' || page_id), 1, 12) AS candidate_id, url AS title, ['A ' || page_id, 'B'] AS authors, 2020 AS year, 'https://x.org/' || page_id || '.pdf' AS pdf_url, 'see it' AS abstract, true AS open_access FROM pages")
def b1_crossref(spark, d):
    p, k = Z.table(spark, d, "pages"), F.col("page_id").cast("string")
    item = F.struct(F.concat(F.lit("10.1/"), k).alias("DOI"), F.array("url").alias("title"), F.lit("<p>see <i>it</i></p>").alias("abstract"), F.array(F.struct(F.lit("A").alias("given"), k.alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("B").alias("family"))).alias("author"), F.array(F.struct(F.concat(F.lit("https://x.org/"), k, F.lit(".pdf")).alias("URL"), F.lit("application/PDF").alias("content-type"))).alias("link"), F.struct(F.array(F.array(F.lit(2020), F.lit(5))).alias("date-parts")).alias("published-online"))
    rows = p.select(F.lit("q").alias("query_id"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    return B.crossref(rows).select("candidate_id", "title", "authors", "year", "pdf_url", "abstract", "open_access")


@query("SELECT 'openalex_' || substr(sha1('10.2/ab' || page_id), 1, 12) AS candidate_id, '10.2/ab' || page_id AS doi, url AS title, 'one two one' AS abstract, (page_id % 2 = 0) AS open_access, page_id::INT AS citation_count FROM pages")
def b2_openalex(spark, d):
    p, k = Z.table(spark, d, "pages"), F.col("page_id").cast("string")
    item = F.struct(F.concat(F.lit("W"), k).alias("id"), F.concat(F.lit("https://doi.org/10.2/AB"), k).alias("doi"), F.col("url").alias("title"), F.col("page_id").alias("cited_by_count"), F.struct((F.col("page_id") % 2 == 0).alias("is_oa")).alias("open_access"), F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"))
    rows = p.select(F.lit("q").alias("query_id"), F.to_json(F.struct(F.array(item).alias("results"))).alias("payload"))
    return B.openalex(rows).select("candidate_id", "doi", "title", "abstract", "open_access", "citation_count")


@query("SELECT 'semantic_scholar_' || substr(sha1('S' || page_id), 1, 12) AS candidate_id, url AS title, ['N'] AS authors, (page_id % 3 = 0) AS open_access FROM pages")
def b3_semantic_scholar(spark, d):
    p, k = Z.table(spark, d, "pages"), F.col("page_id").cast("string")
    item = F.struct(F.concat(F.lit("S"), k).alias("paperId"), F.col("url").alias("title"), F.array(F.struct(F.lit("N").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), F.when(F.col("page_id") % 3 == 0, F.struct(F.lit("u").alias("url"))).alias("openAccessPdf"))
    rows = p.select(F.lit("q").alias("query_id"), F.to_json(F.struct(F.array(item).alias("data"))).alias("payload"))
    return B.semantic_scholar(rows).select("candidate_id", "title", "authors", "open_access")


@query("SELECT 'arxiv_' || substr(sha1('http://a.org/abs/' || page_id), 1, 12) AS candidate_id, 'A title ' || page_id AS title, 2021 AS year, 'http://a.org/pdf/' || page_id AS pdf_url FROM pages")
def b4_arxiv(spark, d):
    k = F.col("page_id").cast("string")
    feed = F.concat(F.lit("<feed><entry><id>http://a.org/abs/"), k, F.lit("</id><title>A  title\n "), k, F.lit("</title><summary>s</summary><published>2021-02-03</published><author><name>N</name></author><link href='x' title='html'/></entry></feed>"))
    return B.arxiv(Z.table(spark, d, "pages").select(F.lit("q").alias("query_id"), feed.alias("payload"))).select("candidate_id", "title", "year", "pdf_url")


@query("SELECT 'manual_seed_' || substr(sha1(trim(p_name)), 1, 12) AS candidate_id, trim(p_name) AS title, (p_partkey % 2 = 0) AS open_access FROM part")
def b5_seeds(spark, d):
    none = lambda t: F.lit(None).cast(t)
    rows = Z.table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("title"), none("array<string>").alias("authors"), none("int").alias("year"), none("string").alias("journal"), none("string").alias("abstract"), F.lit("").alias("doi"), F.lit("u").alias("url"), F.when(F.col("p_partkey") % 2 == 0, "p").otherwise("").alias("pdf_url"), none("boolean").alias("open_access"), none("array<string>").alias("keywords"), F.lit("n").alias("note"))
    return B.seeds(rows).select("candidate_id", "title", "open_access")


@query(_CAND + r""", k AS (SELECT *, coalesce('doi:' || lower(trim(nullif(doi, ''))), 'title:' || trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS merge_key FROM c)
SELECT merge_key, arg_min(candidate_id, ordinal) AS candidate_id, arg_min(title, ordinal) AS title, arg_min(pdf_url, ordinal) FILTER (pdf_url <> '') AS pdf_url, arg_min(year, ordinal) FILTER (year IS NOT NULL) AS year, arg_min(citation_count, ordinal) FILTER (citation_count IS NOT NULL) AS citation_count, list_sort(list_distinct(flatten(list(keywords)))) AS keywords, list_sort(list(DISTINCT source)) AS sources, min(ordinal) AS ordinal FROM k GROUP BY merge_key""")
def b6_deduplicate(spark, d):
    return B.deduplicate(_candidates(spark, d)).select("merge_key", "candidate_id", "title", "pdf_url", "year", "citation_count", "keywords", "sources", "ordinal")


_MUST, _MAY = ("thon", "the"), ("est", "ing", "eau")
_N = r"trim(regexp_replace(lower(coalesce({}, '')), '\s+', ' ', 'g'))"


def _hits(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


_REL = _CAND + f""", n AS (SELECT *, {_N.format('title')} AS nt, {_N.format('abstract')} AS na, {_N.format("array_to_string(keywords, ' ') || ' ' || title || ' ' || coalesce(abstract, '')")} AS nk FROM c),
p AS (SELECT *, 0.45::DOUBLE * ({_hits('nt', _MUST + _MAY)} / 5) + 0.35::DOUBLE * ({_hits('na', _MUST + _MAY)} / 5) + 0.2::DOUBLE * (0.7::DOUBLE * ({_hits('nk', _MUST)} / 2) + 0.3::DOUBLE * ({_hits('nk', _MAY)} / 3)) + CASE WHEN year < 2005 OR year > 2020 THEN -0.1::DOUBLE ELSE 0.05::DOUBLE * ((year - 2005) / 15) END + CASE WHEN coalesce(citation_count, 0) = 0 THEN 0 ELSE least(0.08::DOUBLE, log10(citation_count + 1) * 0.03::DOUBLE) END + CASE WHEN coalesce(open_access, false) OR pdf_url <> '' THEN 0.05::DOUBLE ELSE 0 END AS s FROM n),
r AS (SELECT candidate_id, source, round_even(least(1.0::DOUBLE, s), 4) AS relevance_score FROM p)"""


def _scored(spark, d):
    return B.relevance(_candidates(spark, d), _MUST, _MAY, 2005, 2020)


@query(_REL + " SELECT candidate_id, relevance_score FROM r")
def b7_relevance(spark, d):
    return _scored(spark, d).select("candidate_id", "relevance_score")


@query(_CAND + " SELECT candidate_id, CASE WHEN pdf_url = '' AND source = 'arxiv' AND url <> '' THEN replace(url, '/abs/', '/pdf/') ELSE pdf_url END AS pdf_url, CASE WHEN pdf_url = '' AND source = 'arxiv' AND url <> '' THEN true ELSE open_access END AS open_access FROM c")
def b8_fill_pdf(spark, d):
    return B.fill_pdf(_candidates(spark, d)).select("candidate_id", "pdf_url", "open_access")


@query(_REL + " SELECT candidate_id, relevance_score FROM r WHERE relevance_score >= 0.45")
def b9_selected(spark, d):
    return B.select(_scored(spark, d), 0.45)[0].select("candidate_id", "relevance_score")


@query(_REL + " SELECT source, count(*) AS count FROM r WHERE relevance_score < 0.45 GROUP BY source")
def b9_rejected_counts(spark, d):
    return B.per_source(B.select(_scored(spark, d), 0.45)[1])


@query(_CAND + " SELECT candidate_id, pdf_url <> '' AND coalesce(open_access, false) AS eligible, CASE WHEN pdf_url = '' THEN 'no_pdf_url' WHEN NOT coalesce(open_access, false) THEN 'not_open_access' ELSE 'eligible' END AS state FROM c")
def b10_download_state(spark, d):
    return B.download_state(_candidates(spark, d)).select("candidate_id", "eligible", "state")


@query(_CAND + " SELECT candidate_id, CASE WHEN query_id = 'q1' THEN 'First' ELSE 'Zeroth' END AS used_query FROM c")
def j8_query_lookup(spark, d):
    asked = spark.createDataFrame([("q1", 1, "First"), ("q0", 0, "Zeroth"), ("q2", 2, "Second")], "query_id string, ord int, name string")
    return B.with_query(_candidates(spark, d), asked).select("candidate_id", "used_query")


@query(_CAND + " SELECT candidate_id, title, year, citation_count, coalesce(open_access, NULL) AS open_access, keywords, nullif(trim(pdf_url), '') AS pdf_url FROM c")
def io11_candidate_round_trip(spark, d):
    c = _candidates(spark, d).withColumn("title", F.trim("title"))
    back = B.from_text(B.to_text(c))
    return back.join(c.select("candidate_id", F.col("title").alias("t")), "candidate_id").select("candidate_id", _docs_title(c), "year", "citation_count", "open_access", "keywords", "pdf_url")


def _docs_title(_c):
    return F.col("t").alias("title")


SQL["io11_candidate_round_trip"] = SQL["io11_candidate_round_trip"].replace("title, year", "trim(title, ' ') AS title, year")

# Runs: events as runs (user: experiment, type: hypothesis, props: parameters)

_RUNS = "WITH r AS (SELECT event_id AS run_id, user_id AS experiment, event_type AS hypothesis, ts AS run_time, value, json_extract_string(props, '$.k') AS k FROM events)"


def _runs(spark, d):
    e = Z.table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("experiment"), F.col("event_type").alias("hypothesis"), F.col("ts").alias("run_time"), "value", F.from_json("props", "map<string,string>").alias("params"))


@query("SELECT event_id, event_type FROM events WHERE contains(event_id::VARCHAR, '19') OR contains(user_id::VARCHAR, '19') OR contains(lower(event_type), '19') OR contains(lower(props), '19')")
def e1_search(spark, d):
    return runs.search(Z.table(spark, d, "events").drop("ts", "value"), " 19 ", 1 << 30).select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') AND contains(lower(lang), 'e')")
def e2_filter_evidence(spark, d):
    return runs.filter_evidence(_docs(spark, d), {"source": "SRC1", "lang": "e", "toponym": " "}).select("doc_id")


@query(_RUNS + " SELECT experiment, arg_max(run_id, (run_time, run_id)) AS run_id, arg_max(hypothesis, (run_time, run_id)) AS hypothesis, count(*) AS run_count FROM r GROUP BY experiment")
def e3_latest(spark, d):
    return runs.latest(_runs(spark, d).drop("params"), ["experiment"]).select("experiment", "run_id", "hypothesis", "run_count")


@query(_RUNS + ", t AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY run_time DESC, run_id DESC) AS n FROM r), u AS (SELECT * FROM t WHERE n <= 5) SELECT experiment, run_id, (row_number() OVER w)::INT AS step, CASE WHEN row_number() OVER w = 1 OR k IS NOT DISTINCT FROM lag(k) OVER w THEN [] ELSE ['k'] END AS changed_params FROM u WINDOW w AS (PARTITION BY experiment ORDER BY run_time, run_id)")
def e4_series(spark, d):
    return runs.series(_runs(spark, d), "experiment", 5).select("experiment", "run_id", "step", "changed_params")


@query("WITH p AS (SELECT event_type AS \"table\", user_id % 2 AS run, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2) SELECT \"table\", max(n) FILTER (run = 0) AS a_rows, max(n) FILTER (run = 1) AS b_rows, max(v) FILTER (run = 0) - max(v) FILTER (run = 1) AS delta FROM p GROUP BY \"table\"")
def e5_compare_tables(spark, d):
    e = Z.table(spark, d, "events").groupBy(F.col("event_type").alias("table"), (F.col("user_id") % 2).cast("string").alias("run_id")).agg(F.count("*").alias("row_count"), F.max("value").alias("top_value")).withColumn("top_label", F.lit("x"))
    return runs.compare_tables(e, "0", "1").select("table", F.col("a_row_count").alias("a_rows"), F.col("b_row_count").alias("b_rows"), "delta")


@query("SELECT 'k' AS param, json_extract_string(a.props, '$.k') AS a_value, json_extract_string(b.props, '$.k') AS b_value, json_extract_string(a.props, '$.k') IS NOT DISTINCT FROM json_extract_string(b.props, '$.k') AS same FROM events a, events b WHERE a.event_id = 1 AND b.event_id = 2")
def e5_compare_params(spark, d):
    r = _runs(spark, d)
    return runs.compare_params(r.filter("run_id = 1"), r.filter("run_id = 2"))


_METRICS = "WITH m AS (SELECT event_type AS hypothesis, 'm' || (event_id % 3) AS metric, max(value) AS value FROM events GROUP BY 1, 2)"


def _metrics(spark, d):
    return Z.table(spark, d, "events").groupBy(F.col("event_type").alias("hypothesis"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("metric")).agg(F.max("value").alias("value"))


@query(_METRICS + " SELECT hypothesis, max(value) FILTER (metric = 'm0') AS m0, max(value) FILTER (metric = 'm1') AS m1, max(value) FILTER (metric = 'm2') AS m2 FROM m GROUP BY hypothesis")
def e6_hypothesis_matrix(spark, d):
    return runs.hypothesis_matrix(_metrics(spark, d), ["m0", "m1", "m2"])


@query(_METRICS + " SELECT metric, max(value) FILTER (hypothesis = 'click') AS a_value, max(value) FILTER (hypothesis = 'view') AS b_value, max(value) FILTER (hypothesis = 'click') - max(value) FILTER (hypothesis = 'view') AS delta FROM m WHERE hypothesis IN ('click', 'view') GROUP BY metric")
def e6_metric_delta(spark, d):
    return runs.metric_delta(_metrics(spark, d), "click", "view")


_SESS = "WITH s AS (SELECT user_id::VARCHAR AS hypothesis, count(DISTINCT event_type) AS key_table_count, count(*) % 9 AS evidence_count, count(*) AS run_count, count(*) % 5 AS changed_params_count FROM events GROUP BY 1), v AS (SELECT *, (least(key_table_count, 4) / 4 + least(evidence_count, 6) / 6) / 2 AS c FROM s), o AS (SELECT *, least(greatest(0.5::DOUBLE * c + 0.4::DOUBLE * (least(run_count, 5) / 5) - 0.1::DOUBLE * (least(changed_params_count, 8) / 8), 0), 1) AS x FROM v) SELECT hypothesis, round_even(c, 3) AS coverage_ratio, round_even(x, 3) AS outcome_score, CASE WHEN x >= 0.65 THEN 'stable' WHEN x >= 0.45 THEN 'candidate' ELSE 'needs_review' END AS status FROM o ORDER BY outcome_score DESC, run_count DESC, coverage_ratio DESC, hypothesis LIMIT 10"


@query(_SESS)
def e7_outcomes(spark, d):
    n = F.count("*")
    s = Z.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("hypothesis")).agg(F.count_distinct("event_type").alias("key_table_count"), (n % 9).alias("evidence_count"), n.alias("run_count"), (n % 5).alias("changed_params_count"))
    return runs.outcomes(s, 5, 10).select("hypothesis", "coverage_ratio", "outcome_score", "status")


@query("SELECT doc_id, substr(coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE text END), ''), nullif(trim(source), '')), 1, 50) AS snippet FROM documents")
def e8_snippets(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.trim("text")).alias("text"), F.col("source").alias("quote"))
    return runs.snippets(rows, 1 << 30, 50).select("doc_id", "snippet")


# Streaming


@query(SQL["w1_windows"].replace("FROM l GROUP BY", "FROM l WHERE length(clean_text) >= 5 GROUP BY"))
def st1_stream_windows(spark, d):
    """Raw messages to windowed documents on a stream with a watermark; a last row far ahead closes all windows."""
    from corpus_spark.streaming.rollup import documents_stream, run_available

    folder = fresh_path(spark, "stream")
    rows = Z.messages(spark, d).select("row_id", F.col("datetime").cast("timestamp").alias("datetime"), "group", "comment", "source")
    rows.write.parquet(f"{folder}/in/1")
    last = spark.read.schema(rows.schema).parquet(f"{folder}/in/1").agg(F.max("datetime").alias("t")).select(F.lit(-1).cast("long").alias("row_id"), (F.col("t") + F.expr("interval 10 days")).alias("datetime"), F.lit("end").alias("group"), F.lit("the end of it").alias("comment"), F.lit("end").alias("source"))
    last.write.parquet(f"{folder}/in/2")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    out = documents_stream(stream, "6 hours", "1 hour", 5)
    run_available(out, folder)
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").filter("source <> 'end'")
    return got.select("source", "group", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "period", "text", "message_count")
