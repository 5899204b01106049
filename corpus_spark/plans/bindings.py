"""The test tables seen as the library's inputs, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.operators import lexicon
from corpus_spark.sources.scratch import small_batches, spread

SALT = "test-salt"
#: Themes, places and words from frequent tokens of the test tables.
THEMES = {"alpha": ("thon", "ing", "est"), "beta": ("thes", "erin", "une"), "gamma": ("the", "de", "la"), "delta": ("des", "und", "con"), "unseen": ("xylophone",)}
THEME_DEFAULT = "delta"
PERCEPTIONS = {"near": ("thon", "eau", "ung"), "far": ("erst", "tion", "ción"), "other": ("ble",)}
GAZETTEER = {"Thonia": ("thon", "then"), "Estia": ("est", "esti"), "Dela": ("de la", "des"), "Undland": ("und",), "Ingham": ("ing", "in the"), "Nowhere": ("xylophone",)}
META = {"Thonia": ("city", "Thonia"), "Estia": ("district", "Thonia"), "Dela": ("city", "Dela"), "Undland": ("country", None), "Ingham": ("district", "Dela"), "Nowhere": ("city", "Nowhere")}
POSITIVE, NEGATIVE = ("thon", "est", "des", "ist"), ("er", "und", "une", "no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, datetime, author, group, comment, source: documents met by events on their id."""
    d, e = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "events")
    return d.join(e, d["doc_id"] == e["event_id"]).select(F.col("doc_id").alias("row_id"), F.col("ts").alias("datetime"), F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("group"), F.col("text").alias("comment"), "source")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with clean text and its length as ``chars``, both made before documents meet events, so that lengths move without texts."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", T.clean_text(F.col("text")).alias("clean_text")).withColumn("chars", F.length("clean_text"))
    e = table(spark, sf_dir, "events")
    return d.join(e, d["doc_id"] == e["event_id"]).select(F.col("doc_id").alias("row_id"), F.col("ts").alias("datetime"), F.col("event_type").alias("group"), "source", "clean_text", "chars")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with clean text, language and all labels."""
    m = lexicon.label_all(messages(spark, sf_dir), "comment", GAZETTEER, positive=POSITIVE, negative=NEGATIVE, themes=THEMES, theme_default=THEME_DEFAULT, perceptions=PERCEPTIONS, perception_default="none")
    return m.drop("comment").select("*", F.date_format("datetime", "yyyy-MM").alias("period"), (F.length("clean_text") % 7).cast("int").alias("topic_id"))


def mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.mentions(labelled(spark, sf_dir).drop("clean_text"), lexicon.gazetteer_frame(spark, META))


def _word(terms, column: str) -> str:
    return f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(terms)})($|[^\\p{{L}}\\p{{N}}_])')"


def _best(scores: dict[str, str], default: str) -> str:
    """CASE over scores: the first of the largest, the default at zero."""
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} = 0 THEN '{default}' " + " ".join(f"WHEN {s} = {top} THEN '{k}'" for k, s in scores.items()) + " END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SQL_MESSAGES = 'm AS (SELECT d.doc_id AS row_id, e.ts AS datetime, e.user_id::VARCHAR AS author, e.event_type AS "group", d.text AS comment, d.source FROM documents d JOIN events e ON d.doc_id = e.event_id)'
SQL_CLEAN = SQL_MESSAGES + rf""", c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(comment, ''), '{_CONTROL}', ' ', 'g'), '(?i)https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text FROM m)"""
_UZ = "|".join(T.UZBEK_HINTS).replace("'", "''")
_COUNT = "len(regexp_extract_all(clean_text, '{}'))"
_TH, _CY, _LA = (_COUNT.format(x) for x in ("[\\x{0E00}-\\x{0E7F}]", "[\\x{0400}-\\x{04FF}]", "[A-Za-z]"))
SQL_LANG = f"CASE WHEN {_TH} > 0 AND {_TH} >= {_CY} AND {_TH} >= {_LA} THEN 'th' WHEN regexp_matches(clean_text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_UZ})($|[^\\p{{L}}\\p{{N}}_])') THEN 'uz' WHEN {_CY} = 0 AND {_LA} = 0 THEN 'other' WHEN {_CY} >= {_LA} THEN 'ru' ELSE 'en' END"
_TOKENS = "list_distinct(list_transform(string_split(clean_text, ' '), lambda t: lower(trim(t, '.,!?;:()[]{}\"'''))))"
_POS, _NEG = (f"len(list_intersect({_TOKENS}, {_list(w)}))" for w in (POSITIVE, NEGATIVE))
SQL_SENTIMENT = f"CASE WHEN {_POS} > {_NEG} THEN 'positive' WHEN {_NEG} > {_POS} THEN 'negative' ELSE 'neutral' END"
SQL_THEME = _best({k: "(" + " + ".join(f"{_word([t], 'clean_text')}::INT" for t in terms) + ")" for k, terms in THEMES.items()}, THEME_DEFAULT)
SQL_PERCEPTION = _best({k: "(" + " + ".join(f"contains(lower(clean_text), '{t}')::INT" for t in terms) + ")" for k, terms in PERCEPTIONS.items()}, "none")
SQL_PLACES = "list_filter([" + ", ".join(f"CASE WHEN {_word(aliases, 'lower(clean_text)')} THEN '{name}' END" for name, aliases in GAZETTEER.items()) + "], lambda x: x IS NOT NULL)"
SQL_LABELLED = SQL_CLEAN + f""", l AS (SELECT row_id, datetime, author, "group", source, clean_text, strftime(datetime, '%Y-%m') AS period, {SQL_LANG} AS lang, {SQL_SENTIMENT} AS sentiment, {SQL_THEME} AS theme, {SQL_PLACES} AS toponyms, {SQL_PERCEPTION} AS place_perception, (length(clean_text) % 7)::INT AS topic_id FROM c)"""
SQL_META = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', {'NULL' if p is None else repr(p)})" for k, (t, p) in META.items()) + ") t(toponym, type, parent_city))"
SQL_MENTIONED = SQL_LABELLED + ", " + SQL_META + ", x AS (SELECT l.* EXCLUDE (toponyms), u.toponym, g.type, g.parent_city FROM l, unnest(l.toponyms) u(toponym) LEFT JOIN g ON g.toponym = u.toponym)"
SQL_THEME_LIST = "th AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in THEMES) + ") t(theme))"
