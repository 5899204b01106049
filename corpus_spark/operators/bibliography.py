"""Bibliographic records: normalised payloads, merging, relevance, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions.text import strip_tags, title_key, unfold_abstract

FIELDS = ("candidate_id", "source", "query_id", "title", "authors", "year", "journal", "abstract", "doi", "url", "pdf_url", "open_access", "citation_count", "language", "keywords", "metadata")
CROSSREF = "struct<message:struct<items:array<struct<DOI:string,title:array<string>,`container-title`:array<string>,abstract:string,URL:string,language:string,author:array<struct<given:string,family:string>>,link:array<struct<URL:string,`content-type`:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>>>>>"
OPENALEX = "struct<results:array<struct<id:string,doi:string,title:string,publication_year:int,language:string,cited_by_count:int,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>,abstract_inverted_index:map<string,array<int>>>>>"
SEMANTIC = "struct<data:array<struct<paperId:string,title:string,abstract:string,venue:string,url:string,year:int,citationCount:int,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,openAccessPdf:struct<url:string>>>>"
ATOM = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,link:array<struct<_href:string,_title:string,_type:string>>>>>"


def record_id(source: str, value: Column) -> Column:
    return F.concat(F.lit(f"{source}_"), F.substring(F.sha1(F.coalesce(value, F.lit("")).cast("binary")), 1, 12))


def _record(rows: DataFrame, source: str, query: Column, **columns: Column) -> DataFrame:
    kinds = {"authors": "array<string>", "keywords": "array<string>", "year": "int", "citation_count": "int", "open_access": "boolean", "metadata": "map<string,string>"}
    more = {"source": F.lit(source), "query_id": query, "metadata": F.create_map(F.lit("sources"), F.lit(source)), "keywords": F.array().cast("array<string>")} | columns
    return rows.select(*(more.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS))


def crossref(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """payloads: query_id and a JSON text a row."""
    x = payloads.select("query_id", F.explode(F.from_json(json, CROSSREF)["message"]["items"]).alias("i")).filter(F.get(F.col("i.title"), F.lit(0)) != "")
    title, doi = F.get(F.col("i.title"), F.lit(0)), F.col("i.DOI")
    names = F.filter(F.transform(F.coalesce("i.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))), lambda n: n != "")
    parts = F.coalesce(*(F.col(f"i.{c}") for c in ("`published-print`", "`published-online`", "created")))["date-parts"]
    pdf = F.get(F.filter("i.link", lambda v: F.lower(F.coalesce(v["content-type"], F.lit(""))).contains("pdf")), F.lit(0))["URL"]
    return _record(x, "crossref", F.col("query_id"), candidate_id=record_id("crossref", F.coalesce(F.nullif(doi, F.lit("")), title)), title=title, authors=names, year=F.get(F.get(parts, F.lit(0)), F.lit(0)), journal=F.get(F.col("i.container-title"), F.lit(0)), abstract=F.when(F.col("i.abstract").isNotNull(), strip_tags(F.col("i.abstract"))), doi=doi, url=F.col("i.URL"), pdf_url=pdf, open_access=F.when(pdf.isNotNull(), True), language=F.col("i.language"))


def openalex(payloads: DataFrame, json: str = "payload") -> DataFrame:
    x = payloads.select("query_id", F.explode(F.from_json(json, OPENALEX)["results"]).alias("i")).filter(F.coalesce("i.title", F.lit("")) != "")
    doi = F.lower(F.replace(F.nullif(F.col("i.doi"), F.lit("")), F.lit("https://doi.org/"), F.lit("")))
    names = F.filter(F.transform("i.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return _record(x, "openalex", F.col("query_id"), candidate_id=record_id("openalex", F.coalesce(doi, F.col("i.id"))), title=F.col("i.title"), authors=F.coalesce(names, F.array().cast("array<string>")), year=F.col("i.publication_year"), journal=F.col("i.primary_location.source.display_name"), abstract=F.nullif(unfold_abstract(F.col("i.abstract_inverted_index")), F.lit("")), doi=doi, url=F.col("i.id"), pdf_url=F.col("i.open_access.oa_url"), open_access=F.col("i.open_access.is_oa"), citation_count=F.col("i.cited_by_count"), language=F.col("i.language"), metadata=F.create_map(F.lit("sources"), F.lit("openalex"), F.lit("openalex_id"), F.col("i.id")))


def semantic_scholar(payloads: DataFrame, json: str = "payload") -> DataFrame:
    x = payloads.select("query_id", F.explode(F.from_json(json, SEMANTIC)["data"]).alias("i")).filter(F.coalesce("i.title", F.lit("")) != "")
    doi, pdf = F.col("i.externalIds.DOI"), F.col("i.openAccessPdf.url")
    names = F.filter(F.transform("i.authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return _record(x, "semantic_scholar", F.col("query_id"), candidate_id=record_id("semantic_scholar", F.coalesce(F.nullif(doi, F.lit("")), F.col("i.paperId"))), title=F.col("i.title"), authors=F.coalesce(names, F.array().cast("array<string>")), year=F.col("i.year"), journal=F.col("i.venue"), abstract=F.col("i.abstract"), doi=doi, url=F.col("i.url"), pdf_url=pdf, open_access=F.coalesce(pdf, F.lit("")) != "", citation_count=F.col("i.citationCount"), metadata=F.create_map(F.lit("sources"), F.lit("semantic_scholar"), F.lit("paper_id"), F.col("i.paperId")))


def arxiv(payloads: DataFrame, xml: str = "payload") -> DataFrame:
    """An Atom feed a row."""
    x = payloads.select("query_id", F.explode(F.from_xml(xml, ATOM)["entry"]).alias("i"))
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    link = F.get(F.filter("i.link", lambda v: (v["_title"] == "pdf") | (v["_type"] == "application/pdf")), F.lit(0))["_href"]
    url = F.coalesce("i.id", F.lit(""))
    pdf = F.coalesce(link, F.when(url.contains("/abs/"), F.replace(url, F.lit("/abs/"), F.lit("/pdf/"))))
    return _record(x, "arxiv", F.col("query_id"), candidate_id=record_id("arxiv", url), title=squeeze(F.col("i.title")), authors=F.coalesce(F.transform("i.author", lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>")), year=F.substring("i.published", 1, 4).try_cast("int"), abstract=squeeze(F.col("i.summary")), url=url, pdf_url=pdf, open_access=F.lit(True), metadata=F.create_map(F.lit("sources"), F.lit("arxiv"), F.lit("arxiv_id"), url))


def seeds(rows: DataFrame, query_id: str = "manual_seed") -> DataFrame:
    """A list kept by hand: title, authors, year, journal, abstract, doi, url, pdf_url, open_access, keywords, note."""
    x = rows.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).filter("title <> ''")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    return _record(x, "manual_seed", F.lit(query_id), candidate_id=record_id("manual_seed", F.coalesce(blank("doi"), F.col("title"))), title=F.col("title"), authors=F.coalesce("authors", none), year=F.col("year"), journal=F.col("journal"), abstract=F.col("abstract"), doi=blank("doi"), url=blank("url"), pdf_url=blank("pdf_url"), open_access=F.coalesce("open_access", blank("pdf_url").isNotNull()), keywords=F.coalesce("keywords", none), metadata=F.create_map(F.lit("sources"), F.lit("manual_seed"), F.lit("note"), F.col("note")))


def merge_key() -> Column:
    doi = F.lower(F.trim(F.nullif(F.col("doi"), F.lit(""))))
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("title:"), title_key(F.coalesce("title", F.lit("")))))


def deduplicate(candidates: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One record a key: the first to arrive, empty fields filled by later ones in order, keywords and sources united.

    Each field is the least (ordinal, value) among values that aren't empty: a partial aggregate, without lists.
    """
    kinds = dict(candidates.dtypes)
    keep = [f for f in FIELDS if f in candidates.columns and f not in ("keywords", "metadata", "source", "candidate_id", "query_id", "title", "authors")]
    present = lambda f: (F.col(f).isNotNull() & (F.col(f) != "")) if kinds[f] == "string" else F.col(f).isNotNull()
    whole = [f for f in ("candidate_id", "source", "query_id", "title") if f in candidates.columns]
    aggs = [F.min_by(f, ordinal).alias(f) for f in whole]
    aggs += [F.min_by(f, F.when(present(f), F.col(ordinal))).alias(f) for f in keep]
    if "authors" in candidates.columns:
        aggs.append(F.min_by("authors", F.when(F.size("authors") > 0, F.col(ordinal))).alias("authors"))
    if "keywords" in candidates.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"))
    aggs += [F.array_sort(F.collect_set("source")).alias("sources"), F.min(ordinal).alias(ordinal)]
    if "metadata" in candidates.columns:
        last = F.array_sort(F.collect_list(F.struct(ordinal, F.map_entries("metadata").alias("e"))))
        aggs.append(F.map_from_entries(F.flatten(F.transform(F.map_entries(F.aggregate(last, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(F.transform(x["e"], lambda y: y["key"]), k)), F.map_from_entries(x["e"])))), lambda e: F.array(e)))).alias("metadata"))
    return candidates.withColumn("merge_key", merge_key()).groupBy("merge_key").agg(*aggs)


def relevance(candidates: DataFrame, required: Sequence[str], optional: Sequence[str], year_from: int, year_to: int, weights: tuple[float, float, float] = (0.45, 0.35, 0.2)) -> DataFrame:
    """Adds relevance_score and reason."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    clean = lambda terms: [" ".join(t.lower().split()) for t in terms if t.strip()]
    must, may = clean(required), clean(optional)
    hits = lambda text, terms: sum((text.contains(t).cast("int") for t in terms), F.lit(0))
    share = lambda text: hits(text, must + may) / float(len(must + may)) if must + may else F.lit(0.0)
    # a generator's output can't be worked out again in a filter below it: each text is tidied once, whatever is asked of it
    texts = F.struct(tidy(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).alias("keywords"), tidy(F.col("title")).alias("title"), tidy(F.col("abstract")).alias("abstract"))
    rows = candidates.select("*", F.explode_outer(F.array(texts)).alias("_tidy"))
    title, abstract = F.col("_tidy.title"), F.col("_tidy.abstract")
    joined = lambda *parts: F.concat_ws(" ", *(F.nullif(F.col(f"_tidy.{c}"), F.lit("")) for c in parts))
    everything = joined("keywords", "title", "abstract")
    keyword = 0.7 * (hits(everything, must) / float(len(must)) if must else F.lit(1.0)) + 0.3 * (hits(everything, may) / float(len(may)) if may else F.lit(0.0))
    year, cited = F.coalesce("year", F.lit(0)), F.coalesce("citation_count", F.lit(0))
    recency = F.when(year == 0, 0.0).when((year < year_from) | (year > year_to), -0.1).otherwise(0.05 * ((year - year_from) / float(max(1, year_to - year_from))))
    citation = F.when(cited == 0, 0.0).otherwise(F.least(F.lit(0.08), F.log10(cited + 1) * 0.03))
    open_ = F.when(F.coalesce("open_access", F.lit(False)) | (F.coalesce("pdf_url", F.lit("")) != ""), 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), weights[0] * share(title) + weights[1] * share(abstract) + weights[2] * keyword + recency + citation + open_)
    matched = F.array_compact(F.array(*(F.when(joined("title", "abstract").contains(t), F.lit(t)) for t in must))) if must else F.array().cast("array<string>")
    two = lambda name, c: F.concat(F.lit(f"{name}="), F.format_string("%.2f", c))
    reason = F.concat_ws("; ", two("title_score", share(title)), two("abstract_score", share(abstract)), two("keyword_score", keyword), F.when(F.size(matched) > 0, F.concat(F.lit("matched required terms: "), F.array_join(matched, ", "))), F.when(open_ > 0, F.lit("OA/PDF available")), F.when(F.col("citation_count").isNotNull(), F.concat(F.lit("cited_by_count="), F.col("citation_count").cast("string"))), F.when(recency != 0, two("recency_bonus", recency)), F.when(citation != 0, two("citation_bonus", citation)))
    return rows.withColumns({"relevance_score": F.bround(score, 4), "reason": reason}).drop("_tidy")


def fill_pdf(candidates: DataFrame) -> DataFrame:
    lacks = (F.coalesce("pdf_url", F.lit("")) == "") & (F.col("source") == "arxiv") & (F.coalesce("url", F.lit("")) != "")
    return candidates.withColumns({"pdf_url": F.when(lacks, F.replace("url", F.lit("/abs/"), F.lit("/pdf/"))).otherwise(F.col("pdf_url")), "open_access": F.when(lacks, True).otherwise(F.col("open_access"))})


def select(candidates: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Selected and rejected, best first."""
    enough = F.coalesce("relevance_score", F.lit(0.0)) >= least
    order = [F.desc("relevance_score"), "candidate_id"]
    return candidates.filter(enough).orderBy(*order), candidates.filter(~enough).orderBy(*order)


def per_source(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.count("*").alias("count"))


def download_state(candidates: DataFrame) -> DataFrame:
    """eligible and state, without any network."""
    has, free = F.coalesce("pdf_url", F.lit("")) != "", F.coalesce("open_access", F.lit(False))
    return candidates.withColumns({"eligible": has & free, "state": F.when(~has, "no_pdf_url").when(~free, "not_open_access").otherwise("eligible")})


def with_query(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each candidate's query; the first query where its own isn't listed. queries: query_id, ord, name - a short list."""
    first = queries.orderBy("ord").limit(1).select(F.struct("query_id", "name").alias("first"))
    known = queries.select("query_id", F.col("name").alias("query_name"))
    return candidates.join(known, "query_id", "left").crossJoin(F.broadcast(first)).select("*", F.coalesce("query_name", "first.name").alias("used_query")).drop("query_name", "first")


def to_text(candidates: DataFrame) -> DataFrame:
    """Flat columns for CSV: lists joined, metadata as JSON."""
    kinds = dict(candidates.dtypes)
    return candidates.select(*(F.array_join(c, "; ").alias(c) if kinds[c] == "array<string>" else F.to_json(c).alias(c) if kinds[c].startswith("map") else F.col(c).cast("string").alias(c) for c in candidates.columns))


def from_text(rows: DataFrame) -> DataFrame:
    """The way back: empty is null, years through double, true/1/yes words."""
    empty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    how = {"authors": items, "keywords": items, "sources": items, "year": lambda c: empty(c).try_cast("double").cast("int"), "citation_count": lambda c: empty(c).try_cast("double").cast("int"), "relevance_score": lambda c: empty(c).try_cast("double"), "open_access": lambda c: F.lower(empty(c)).isin("true", "1", "yes"), "metadata": lambda c: F.from_json(c, "map<string,string>")}
    return rows.select(*(how.get(c, empty)(c).alias(c) for c in rows.columns))
