"""Operator 4: quality rules with cross-document line frequency.

Base measures come from one narrow pass. Lines are normalised (ASCII white space collapsed, lower
case) and hashed; distinct documents, copies of a text included, are counted for each (host, line).
Lines in more than the limit of a host's documents are removed, and a document of whose words too few
are left is rejected. Only ids and hashes are shuffled, after partial counts; a hot line or host is one
row a task by then.

Null and empty texts have no words and fail the base rule; very long ones are measured whole. Each row
is a document: rows with the same doc_id, repeated ones too, are judged and counted one by one. A line
at the limit stays, a document at the share stays. A null host is a host of its own. An empty table
gives no rows. Other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.common import map_slices, word_bytes, written

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = word_bytes(text)
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(text)) if text else 0, 0, 0
    lines = Counter(text.split("\n"))
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    dup = sum(k - 1 for line, k in lines.items() if k > 1 and line.strip(" \t\n\x0b\x0c\r"))
    repeat = 0
    if n > 3:
        place = {w: i for i, w in enumerate(set(words))}
        ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
        pair = ids[:-1] * len(place) + ids[1:]
        if len(place) > 1_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        windows = pair[:-1] * len(place) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    return n, chars, len(_SYMBOLS.findall(text)), dup, repeat


def _line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def measures(docs: DataFrame) -> DataFrame:
    """row, doc_id, host, the base measures and lines array<struct<h, words>> of distinct lines."""

    def work(part: pa.RecordBatch) -> dict:
        found, per_line = [], []
        for text in part.column("text").to_pylist():
            lines: dict[int, int] = {}
            for line in text.split("\n") if text else ():
                if words := word_bytes(line.lower()):
                    h = _line_hash(b" ".join(words))
                    lines[h] = lines.get(h, 0) + len(words)
            found.append(measure(text))
            per_line.append([{"h": h, "words": k} for h, k in lines.items()])
        return {**{c: part.column(c) for c in ("row", "doc_id", "host")}, **dict(zip(_MEASURES, zip(*found))), "lines": per_line}

    kind = dict(docs.dtypes)["doc_id"]
    cols = ", ".join(f"{c} bigint" for c in _MEASURES)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").alias("host"), "text")
    return map_slices(rows, work, f"row bigint, doc_id {kind}, host string, {cols}, lines array<struct<h:bigint,words:bigint>>")


def assess(docs: DataFrame, share: float = 0.05, least: int = 25, left: float = 0.3, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, kept.

    A line is removed if more than max(``least``, ``share`` of its host's documents with words) documents
    of the host have it; a document is depleted if fewer than ``left`` of its words remain. The removed
    lines are broadcast if a count proves them few; otherwise they are joined by line, dealt over ``salts``.
    """
    base = written(measures(docs), "quality")
    host = [F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host")]
    key = ["host", "no_host"]
    lines = base.select("row", *host, F.explode("lines").alias("line")).select("row", *key, "line.*")
    per_line = lines.groupBy(*key, "h").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    per_host = base.filter("n_words > 0").select(*host).groupBy(*key).agg(F.count("*").alias("docs"))
    hot = written(per_line.join(per_host, key).filter(F.col("n") > F.col("docs") * share).select(*key, "h"), "quality-hot")
    if hot.count() <= broadcast_rows:
        found = lines.join(F.broadcast(hot), [*key, "h"])
    else:
        dealt = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = lines.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(dealt, [*key, "h", "salt"])
    gone = found.groupBy("row").agg(F.sum("words").alias("gone"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return (
        base.drop("lines").join(gone, "row", "left")
        .withColumns({"base_failed": failed, "n_words_left": rest})
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", (~F.col("base_failed") & (F.col("n_words_left") >= F.col("n_words") * left)).alias("kept"))
    )


#: The same in DuckDB: base measures by lists of words, lines by their normalised text.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM d),
hit AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n FROM win),
rep AS (SELECT row, count(DISTINCT i + k) AS n_repeat FROM hit, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY row),
ln AS (SELECT row, source, unnest(ls) AS line FROM d),
dup AS (SELECT row, sum(n - 1) AS n_dup FROM (SELECT row, line, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row, line) GROUP BY row),
norm AS (SELECT row, source, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
                len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
         FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
freq AS (SELECT source, line, count(DISTINCT row) AS n FROM norm GROUP BY source, line),
host AS (SELECT source, count(*) AS docs FROM d WHERE len(w) > 0 GROUP BY source),
hot AS (SELECT f.source, f.line FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 25 AND f.n > h.docs * 0.05),
gone AS (SELECT row, sum(words) AS gone FROM norm n JOIN hot h ON n.source IS NOT DISTINCT FROM h.source AND n.line = h.line GROUP BY row),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(w) - coalesce(gone, 0)::BIGINT AS n_words_left
  FROM d LEFT JOIN rep USING (row) LEFT JOIN dup USING (row) LEFT JOIN gone USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= n_words * 0.3 AS kept
FROM m
"""
