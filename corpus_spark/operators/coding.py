"""Manual coding: pairing coders, agreement, coded segments, validation of annotations and codebooks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.sources.scratch import discard, written


def pair(a: DataFrame, b: DataFrame, fields: Sequence[str], key: str = "annotation_id") -> DataFrame:
    left = a.select(key, *(F.col(f).alias(f"{f}_a") for f in fields))
    return left.join(b.select(key, *(F.col(f).alias(f"{f}_b") for f in fields)), key)


def confusion(pairs: DataFrame, field: str) -> DataFrame:
    """a, b, n in long form; nulls are empty strings."""
    a, b = (F.coalesce(F.col(f"{field}_{x}").cast("string"), F.lit("")).alias(x) for x in "ab")
    return pairs.select(a, b).groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame, field: str) -> DataFrame:
    """items, percent_agreement, kappa (null where chance agreement is complete). All from the small confusion table."""
    cells = confusion(pairs, field)
    marks = cells.select(F.col("a").alias("code"), "n", F.lit(0).cast("long").alias("m")).unionByName(cells.select(F.col("b").alias("code"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    chance = marks.groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("nm"))
    seen = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po = F.try_divide(F.col("same").cast("double"), F.col("items"))
    pe = F.try_divide(F.col("nm"), F.col("items").cast("double") * F.col("items"))
    return seen.crossJoin(F.broadcast(chance)).select(F.lit(field).alias("field"), F.coalesce("items", F.lit(0)).alias("items"), po.alias("percent_agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def multi_agreement(pairs: DataFrame, field: str) -> DataFrame:
    """items, exact_match, mean_jaccard of two list fields; two empty lists agree fully."""
    a, b = (F.array_sort(F.array_distinct(F.coalesce(f"{field}_{x}", F.array().cast("array<string>")))) for x in "ab")
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
    return pairs.agg(F.count("*").alias("items"), F.avg((a == b).cast("double")).alias("exact_match"), F.avg(jaccard).alias("mean_jaccard")).select(F.lit(field).alias("field"), "*")


def coded_segments(df: DataFrame, code: str, field: str | None = None, skip: Sequence[str] = ("annotation_id", "doc_id", "coder_id", "text", "memo")) -> DataFrame:
    """Rows with a code in one field, or in any but ids, text and memo."""
    from corpus_spark.functions.lists import parse_list

    kinds = dict(df.dtypes)
    hit = F.lit(False)
    for c in [field] if field else [c for c in df.columns if c not in skip]:
        items = F.col(c) if kinds[c].startswith("array") else parse_list(F.col(c).cast("string"))
        hit = hit | F.coalesce(F.array_contains(items, code), F.lit(False))
    return df.filter(hit)


def violations(annotations: DataFrame, rules: Sequence[tuple[str, str, bool, str | None]], codes: DataFrame) -> DataFrame:
    """annotation_id, column, problem, value. rules: (column, type, required, code group); codes: (code_group, code).

    A missing column is one row without id; cells are checked in one pass, codes by an anti-join.
    """
    from corpus_spark.functions.lists import parse_list

    spark = annotations.sparkSession
    kind = "annotation_id string, column string, problem string, value string"
    missing = [(None, c, "missing column", None) for c, _, required, _ in rules if required and c not in annotations.columns]
    out = spark.createDataFrame(missing, kind)
    have = [r for r in rules if r[0] in annotations.columns]
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, *_ in have}
    must = {c for c, _, required, _ in have if required} | ({"doc_id", "coder_id"} & set(annotations.columns))
    if must:
        blank = F.array_compact(F.array(*(F.when(text.get(c, F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == "", F.lit(c)) for c in sorted(must))))
        out = out.unionByName(annotations.select("annotation_id", F.explode(blank).alias("column")).select("annotation_id", "column", F.lit("empty").alias("problem"), F.lit(None).cast("string").alias("value")))
    coded = [(c, t, g) for c, t, _, g in have if g]
    if coded:
        def named(column: str, group: str):
            return lambda v: F.struct(F.lit(column).alias("column"), F.lit(group).alias("code_group"), v.alias("code"))

        cells = [(c, g, parse_list(F.col(c).cast("string")) if t == "multi_category" else F.filter(F.array(text[c]), lambda x: x != "")) for c, t, g in coded]
        each = F.flatten(F.array(*(F.transform(items, named(c, g)) for c, g, items in cells)))
        used = annotations.select("annotation_id", F.explode(each).alias("v")).select("annotation_id", "v.*")
        out = out.unionByName(used.join(codes, ["code_group", "code"], "left_anti").select("annotation_id", "column", F.lit("unknown code").alias("problem"), F.col("code").alias("value")))
    return out


def require_valid(found: DataFrame) -> None:
    some = found.limit(20).collect()
    if some:
        raise ValueError("; ".join(f"{r['column']}: {r['problem']} {r['value'] or ''} ({r['annotation_id']})" for r in some))


def codebook_problems(codebook: DataFrame) -> DataFrame:
    """code_id, problem: missing and repeated ids, empty descriptions, parents that aren't there."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    say = lambda df, what: df.select("code_id", F.lit(what).alias("problem"))
    twice = codebook.filter(~blank("code_id")).groupBy("code_id").agg(F.count("*").alias("n")).filter("n > 1")
    lost = codebook.filter(~blank("parent_id")).join(codebook.select(F.col("code_id").alias("parent_id")).distinct(), "parent_id", "left_anti")
    return say(codebook.filter(blank("code_id")), "missing id").unionByName(say(twice, "duplicate id")).unionByName(say(codebook.filter(blank("description")), "empty description")).unionByName(say(lost, "unknown parent"))


def codebook_roots(codebook: DataFrame, most_rounds: int = 40) -> DataFrame:
    """code_id, root, depth, problem: every code's line of parents followed to its end, however deep.

    problem is ``unknown ancestor`` where the line ends in a parent that isn't there (root is that parent) and ``cycle``
    where it never ends (root is null); else null. Jumps double with each round: a round joins every code that isn't at
    its end with what its furthest known ancestor knows, so a line of n codes takes log2(n) rounds, and what is left
    after as many rounds as there are codes stands above or in a cycle. Of repeated ids the least parent counts.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    parent = F.when(~blank("parent_id"), F.col("parent_id"))
    known = codebook.filter(~blank("code_id")).groupBy("code_id").agg(F.min(parent).alias("up"))
    there = known.select(F.col("code_id").alias("up"), F.lit(True).alias("there"))
    # at: the furthest ancestor known so far; done: it has no parent, or isn't there
    lines = known.join(there, "up", "left").select("code_id", F.coalesce("up", "code_id").alias("at"), F.col("up").isNotNull().cast("long").alias("depth"), (F.col("up").isNull() | F.col("there").isNull()).alias("done"), (F.col("up").isNotNull() & F.col("there").isNull()).alias("lost"))
    lines = written(lines, "lines")
    rounds = min(most_rounds, max(1, lines.count()).bit_length() + 1)
    for _ in range(rounds):
        if not lines.filter(~F.col("done")).limit(1).count():
            break
        ahead = lines.select(F.col("code_id").alias("at"), F.col("at").alias("next_at"), F.col("depth").alias("next_depth"), F.col("done").alias("next_done"), F.col("lost").alias("next_lost"))
        moved = lines.filter(~F.col("done")).join(ahead, "at").select("code_id", F.col("next_at").alias("at"), (F.col("depth") + F.col("next_depth")).alias("depth"), F.col("next_done").alias("done"), F.col("next_lost").alias("lost"))
        before, lines = lines, written(lines.filter("done").unionByName(moved), "lines")
        discard(before)
    problem = F.when(~F.col("done"), "cycle").when(F.col("lost"), "unknown ancestor")
    return lines.select("code_id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), problem.alias("problem"))


def flatten_codebook(books: DataFrame, column: str = "codes") -> DataFrame:
    """One row a code from an array of structs."""
    return books.select(F.explode(column).alias("c")).select("c.*")


def group_codes(codebook: DataFrame, group: str) -> DataFrame:
    return codebook.filter(F.col("mutually_exclusive_group") == group).select("code_id").distinct().orderBy("code_id")


def field_metric(types: Mapping[str, str], pairs: DataFrame, field: str) -> DataFrame:
    return multi_agreement(pairs, field) if types.get(field) == "multi_category" else agreement(pairs, field)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
