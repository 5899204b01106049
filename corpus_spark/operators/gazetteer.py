"""Place names from a gazetteer that is a table of any size, not a list in the plan.

A text is cut into tokens: runs of word characters, and single other characters, each with the blank
before it. An alias is the same tokens in a row, so finding aliases is looking up word n-grams. A first
lookup, by an alias's first token, tells which lengths can start at a token at all; the second is by the
whole alias. Aliases match as whole words: neither edge of a match may touch a word character.

A gazetteer whose aliases were counted and are small enough is broadcast once and looked up batch by
batch, without a shuffle; a larger one is joined: n-grams are dealt out and met with aliases by Spark.
Bits of hashed aliases, at most 4 MB of them, are broadcast first and hold back nearly all n-grams that
are no alias. Both ways give the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions import text as T
from corpus_spark.functions.lists import once
from corpus_spark.sources.scratch import written

_TOKEN = r"(?U) ?(?:\w+|[^\w ])"
_WORD = r"(?U)\w$"
#: Bits of hashed aliases: 16 for each alias, up to this many, in words of 64.
_MOST_BITS = 1 << 25


def tokens(text: Column) -> Column:
    """Word runs and single other characters of the lower-case text, each with the blank before it, if there is one."""
    return F.regexp_extract_all(T.collapse(F.lower(F.coalesce(text, F.lit("")))), F.lit(_TOKEN), F.lit(0))


def _is_word(token: Column) -> Column:
    return token.rlike(_WORD)


def compile_aliases(aliases: DataFrame) -> DataFrame:
    """alias, first, length, toponym, ord of a table (toponym, alias, ord or none): aliases as texts are read, each once.

    Without ``ord`` names are ordered by themselves. Blank aliases and null names go.
    """
    place = F.col("ord").cast("long") if "ord" in aliases.columns else F.lit(0).cast("long")
    cut = aliases.select("toponym", place.alias("ord"), tokens(F.col("alias")).alias("t")).filter((F.size("t") > 0) & F.col("toponym").isNotNull())
    return cut.select(F.array_join("t", "").alias("alias"), F.ltrim(F.col("t")[0]).alias("first"), F.size("t").alias("length"), "toponym", "ord").groupBy("alias", "first", "length", "toponym").agg(F.min("ord").alias("ord"))


class _Known:
    """A gazetteer in memory: lengths by first token, names by alias."""

    def __init__(self, rows: list):
        names = sorted({(r["ord"], r["toponym"]) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        # a name with several orders stands where its first one does
        number: dict[str, int] = {}
        self.names: list[str] = []
        for _, name in names:
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
        self.aliases: dict[str, list[int]] = {}
        lengths: dict[str, set[int]] = {}
        for r in rows:
            self.aliases.setdefault(r["alias"], []).append(number[r["toponym"]])
            lengths.setdefault(r["first"], set()).add(r["length"])
        self.firsts = pa.array(list(lengths), pa.string())
        self.lengths = [sorted(x) for x in lengths.values()]

    def find(self, lists: pa.ListArray, words: pa.ListArray) -> list[list[str]]:
        """The names in each text of a batch of token lists; ``words`` says of each token whether it is a word."""
        flat, is_word = lists.flatten(), words.flatten()
        starts = np.cumsum(np.r_[0, pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)])
        hit = pc.index_in(pc.utf8_ltrim(flat, " "), value_set=self.firsts)
        at = np.flatnonzero(pc.is_valid(hit).to_numpy(zero_copy_only=False))
        rows, kind = np.searchsorted(starts, at, side="right") - 1, hit.take(pa.array(at)).to_pylist()
        found: list[set[int]] = [set() for _ in range(len(lists))]
        for i, row, k in zip(at.tolist(), rows.tolist(), kind):
            begin, end = int(starts[row]), int(starts[row + 1])
            said = flat[i].as_py()
            if not is_word[i].as_py() and not said.startswith(" ") and i > begin and is_word[i - 1].as_py():
                continue  # touches the word before it
            for n in self.lengths[k]:
                if i + n > end:
                    break
                names = self.aliases.get("".join(flat.slice(i, n).to_pylist()).lstrip(" "))
                if names is None:
                    continue
                last = i + n - 1
                if not is_word[last].as_py() and last + 1 < end and is_word[last + 1].as_py() and not flat[last + 1].as_py().startswith(" "):
                    continue  # touches the word behind it
                found[row].update(names)
        return [[self.names[k] for k in sorted(f)] for f in found]


def _looked_up(df: DataFrame, text: str, known: DataFrame, into: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(_Known(known.collect()))

    @F.arrow_udf("array<string>")
    def names(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(shared.value.find(part.field("t"), part.field("w")), pa.list_(pa.string()))

    both = once(tokens(F.col(text)), lambda t: F.struct(t.alias("t"), F.transform(t, _is_word).alias("w")))
    return df.withColumn(into, names(both))


def grams(df: DataFrame, text: str, key: str, longest: int, firsts: DataFrame) -> DataFrame:
    """key, gram: the word n-grams of texts that could be aliases; ``firsts`` has first tokens and the lengths that begin with them."""
    none = F.lit(None).cast("string")

    def windows(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.struct(F.when(i > 1, F.get(t, i - 2)).otherwise(none).alias("before"), F.slice(t, i, longest + 1).alias("here")))

    cut = df.select(key, F.explode(once(tokens(F.col(text)), lambda t: F.when(F.size(t) > 0, windows(t)))).alias("w")).select(key, "w.*")
    first = F.get("here", F.lit(0))
    free = first.startswith(" ") | F.col("before").isNull() | _is_word(first) | ~_is_word(F.col("before"))
    met = cut.filter(free).join(firsts, F.ltrim(first) == firsts["first"]).select(key, "here", F.explode("lengths").alias("n")).filter(F.col("n") <= F.size("here"))
    last, after = F.get("here", F.col("n") - 1), F.get("here", F.col("n"))
    ends = _is_word(last) | after.isNull() | after.startswith(" ") | ~_is_word(after)
    return met.filter(ends).select(key, F.ltrim(F.array_join(F.slice("here", 1, F.col("n")), "")).alias("gram"))


def _perhaps(found: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The n-grams whose bit an alias has set. Of a huge gazetteer more pass, and the join that follows is exact anyway."""
    bits = min(_MOST_BITS, 1 << max(10, (16 * count - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    mark = known.select(slot("alias").alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("marks"))
    asked = found.withColumn("s", slot("gram"))
    met = (F.shiftright(asked["s"], 6) == mark["word"]) & (F.getbit(mark["marks"], asked["s"].bitwiseAND(63).cast("int")) == 1)
    return asked.join(F.broadcast(mark), met, "leftsemi").drop("s")


def _joined(df: DataFrame, text: str, known: DataFrame, into: str) -> DataFrame:
    known = written(known, "gazetteer")
    longest, count = known.agg(F.coalesce(F.max("length"), F.lit(1)), F.count("*")).first()
    rows = written(df.withColumn("row of the text", F.monotonically_increasing_id()), "texts-with-places")
    firsts = known.groupBy("first").agg(F.collect_set("length").alias("lengths"))
    hits = _perhaps(grams(rows, text, "row of the text", longest, firsts), known, count).distinct().join(known.select(F.col("alias").alias("gram"), "toponym", "ord"), "gram")
    order = known.groupBy("toponym").agg(F.min("ord").alias("ord"))
    hits = hits.select("row of the text", "toponym").distinct().join(order, "toponym")
    of_row = hits.groupBy("row of the text").agg(F.array_sort(F.collect_list(F.struct("ord", "toponym"))).alias("found"))
    out = rows.join(of_row, "row of the text", "left").withColumn(into, F.coalesce(F.transform("found", lambda x: x["toponym"]), F.array().cast("array<string>")))
    return out.select(*df.columns, into) if into not in df.columns else out.select(*df.columns)


def add_places(df: DataFrame, text: str, aliases: DataFrame, into: str = "toponyms", most: int = 64 << 20) -> DataFrame:
    """Adds the names whose aliases stand in a text as whole words, each once, in the gazetteer's order.

    aliases: (toponym, alias) and, if there is one, ord. Up to ``most`` characters of aliases and names are broadcast.
    Null texts have no names.
    """
    known = compile_aliases(aliases)
    size = known.agg(F.sum(F.length("alias") + F.length("first") + F.length("toponym"))).first()[0] or 0
    return (_looked_up if size <= most else _joined)(df, text, known, into)
