"""Operator 1: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood is
the sum over all its segmentations into pieces, computed by a forward pass; a text's is the product
over its words. Expectation maximisation over word counts of a bounded, documented sample of labelled
rows (``per_lang`` rows of each language, chosen by hash) learns the piece probabilities. All text of
these rows counts; long words, such as sentences of languages without blanks, are cut into stretches.
Forward and backward sums of short words are scaled by a constant for each character, those of long
words at each step, so that neither underflows. The model takes vocabulary times languages.

Null, empty and letterless texts are ``und`` with score 0. Very long texts are scored whole, word by
word. Languages that are equally likely go by name. Repeated rows and ids are judged each. An empty
table gives no rows; with no labelled rows at all everything is ``und``. Other columns of the table,
whatever their names, have no part in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.llm.common import whole, written

UNKNOWN = "und"
MARK = "▁"
#: Probability of a character that is no piece.
FLOOR = 1e-7
#: Words longer than this are summed one at a time with rescaling; for learning they are cut into stretches of it.
_SHORT = 40
#: Begins a stretch that continues a word; white space is in no word.
_MORE = "\n"
#: Each character of a short word multiplies sums by this: with _SHORT + 1 of them they stay below 1e288.
_SCALE = 1e7


class Lattice:
    """All segmentations of words into pieces of the vocabulary."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.n = len(names) + 1  # the last stands for any unknown character
        self.piece = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names))
        self.scale = _SCALE ** np.array([*map(len, names), 1], dtype=float)[:, None]
        self.step: dict[str, int] = dict.fromkeys((p[:k] for p in names for k in range(1, len(p))), -1)
        self.step.update(self.piece)
        self._plant()

    def _plant(self) -> None:
        """The same prefixes as sorted keys (parent, letter), for many words at once."""
        node = {"": 0} | {s: k for k, s in enumerate(self.step, 1)}
        letters = {c: k for k, c in enumerate(sorted(set("".join(self.piece))), 1)}
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.width = len(letters) + 1
        keys = np.array([node[s[:-1]] * self.width + letters[s[-1]] for s in self.step], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.arange(1, len(keys) + 1)[order]
        self.ends = np.array([-1, *self.step.values()])

    def batch(self, words: list[str]) -> tuple:
        """Arcs of many short words, sorted by their ends: word, start, end and piece of each, and the words' lengths."""
        spelled = list(map(_spelled, words))
        n = np.array(list(map(len, spelled)), dtype=np.int64)
        text = self.letter[np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        word = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        left = n[word] - at
        here, node = np.arange(len(text)), np.zeros(len(text), dtype=np.int64)
        single = np.zeros(len(text), dtype=bool)
        starts, lengths, pieces = [], [], []
        for k in range(1, self.longest + 1):
            inside = left[here] >= k
            here, node = here[inside], node[inside]
            key = node * self.width + text[here + k - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            here, node = here[known], self.child[place[known]]
            whole = self.ends[node] >= 0
            starts.append(here[whole])
            pieces.append(self.ends[node[whole]])
            lengths.append(np.full(len(starts[-1]), k))
            if k == 1:
                single[starts[0]] = True
        odd = np.flatnonzero(~single)
        start = np.concatenate([*starts, odd])
        piece = np.concatenate([*pieces, np.full(len(odd), self.n - 1)])
        w, a = word[start], at[start]
        b = a + np.concatenate([*lengths, np.ones(len(odd), dtype=np.int64)])
        order = np.lexsort((w, b))
        return w[order], a[order], b[order], piece[order], n

    def forward(self, arcs: tuple, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language], times _SCALE for each character; prob[piece, language] is scaled."""
        w, a, b, p, n = arcs
        alpha = np.zeros((len(n), n.max() + 1, prob.shape[1]))
        alpha[:, 0] = 1
        ends = np.searchsorted(b, np.arange(1, n.max() + 2))
        for j in range(1, n.max() + 1):
            s = slice(ends[j - 1], ends[j])
            if s.start < s.stop:
                at = w[s]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                alpha[at[first], j] = np.add.reduceat(alpha[at, a[s]] * prob[p[s]], first, axis=0)
        return alpha

    def backward(self, arcs: tuple, prob: np.ndarray) -> np.ndarray:
        w, a, b, p, n = arcs
        beta = np.zeros((len(n), n.max() + 1, prob.shape[1]))
        beta[np.arange(len(n)), n] = 1
        order = np.lexsort((w, a))
        w, a, b, p = w[order], a[order], b[order], p[order]
        begins = np.searchsorted(a, np.arange(0, n.max() + 1))
        for i in range(n.max() - 1, -1, -1):
            s = slice(begins[i], begins[i + 1])
            if s.start < s.stop:
                at = w[s]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                beta[at[first], i] = np.add.reduceat(beta[at, b[s]] * prob[p[s]], first, axis=0)
        return beta

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), prob.shape[1]))
        near = [k for k, x in enumerate(words) if len(x) <= _SHORT]
        if near:
            arcs = self.batch([words[k] for k in near])
            alpha = self.forward(arcs, prob * self.scale)
            out[near] = np.log(alpha[np.arange(len(near)), arcs[4]]) - np.log(_SCALE) * arcs[4][:, None]
        for k, word in enumerate(words):
            if len(word) > _SHORT:
                out[k] = self._long(word, prob)
        return out

    def _long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """One forward pass over any length: a ring of the last positions, rescaled at each step."""
        ring, scale = {0: np.ones(prob.shape[1])}, np.zeros(prob.shape[1])
        s, get = MARK + word, self.step.get
        for i in range(len(s)):
            here = ring.pop(i)
            scale += np.log(here)
            ring = {k: v / here for k, v in ring.items()}
            single = False
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                x = get(s[i:j])
                if x is None:
                    break
                if x >= 0:
                    ring[j] = ring.get(j, 0) + prob[x]
                    single |= j == i + 1
            if not single:
                ring[i + 1] = ring.get(i + 1, 0) + prob[self.n - 1]
        return scale + np.log(ring[len(s)])


_LATTICE: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    if model not in _LATTICE:
        _LATTICE[model] = Lattice(model)
    return _LATTICE[model]


def _words(text: str) -> list[str]:
    return text.lower().split()


def _spelled(word: str) -> str:
    return word[1:] if word.startswith(_MORE) else MARK + word


def _stretches(word: str) -> list[str]:
    return [word[:_SHORT], *(_MORE + word[k : k + _SHORT] for k in range(_SHORT, len(word), _SHORT))]


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word or stretch of one, n) over the rows: counted in each task first, then summed by word."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in parts:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if text:
                    seen.setdefault(lang, Counter()).update(x for w in _words(text) for x in _stretches(w))
            if sum(map(len, seen.values())) > 200_000:
                yield from (pd.DataFrame({"lang": k, "word": list(c), "n": list(c.values())}) for k, c in seen.items())
                seen = {}
        yield from (pd.DataFrame({"lang": k, "word": list(c), "n": list(c.values())}) for k, c in seen.items())

    return labelled.select("lang", "text").mapInPandas(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample(labelled: DataFrame, per_lang: int, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """About ``per_lang`` rows of each language, chosen by a hash of their id."""
    known = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return known, []
    rate = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))))
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return known.filter(dice < rate[F.col("lang")]), sorted(sizes)


def fit(labelled: DataFrame, model: str, per_lang: int = 1500, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and probabilities [piece, language], by expectation maximisation.

    What reaches the driver is the table of expected counts, bounded by vocabulary times languages.
    """
    rows, langs = sample(labelled, per_lang)
    grid = lattice(model)
    if not langs:
        return [], np.zeros((grid.n, 0))
    counts = written(word_counts(rows), "langid-words")
    place = {x: k for k, x in enumerate(langs)}
    prob = np.full((grid.n, len(langs)), 1.0 / grid.n)
    for _ in range(rounds):
        now = prob

        def expect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = lattice(model)
            total: dict[int, np.ndarray] = {}
            for pdf in parts:
                for lang, part in pdf.groupby("lang"):
                    k = place[lang]
                    p = now[:, k : k + 1] * g.scale
                    sums = total.setdefault(k, np.zeros(g.n))
                    for at in range(0, len(part), 4000):
                        some = part.iloc[at : at + 4000]
                        arcs = g.batch(some["word"].tolist())
                        alpha, beta = g.forward(arcs, p)[:, :, 0], g.backward(arcs, p)[:, :, 0]
                        w, a, b, x, n = arcs
                        share = alpha[w, a] * p[x, 0] * beta[w, b] / alpha[np.arange(len(n)), n][w]
                        sums += np.bincount(x, weights=share * some["n"].to_numpy(float)[w], minlength=g.n)
            for k, sums in total.items():
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": k, "piece": at, "n": sums[at]})

        got = counts.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros_like(prob)
        expected[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
        expected[-1] = 0
        prob = (expected + 0.01) / (expected.sum(axis=0) + 0.01 * grid.n)
        prob[-1] = FLOOR
    return langs, prob


def annotate(docs: DataFrame, model: str, langs: list[str], prob: np.ndarray, keep: list[str], names: tuple[str, str] = ("lang_pred", "score"), cache: int = 200_000) -> DataFrame:
    """The columns ``keep`` as they are, with the predicted language and its posterior under equal priors in ``names``.

    One narrow pass over ``text``. The parameters have the size of vocabulary times languages and travel by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, prob))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = shared.value
        g = lattice(model)
        place: dict[str, int] = {}
        logs = np.zeros((0, max(1, len(known))))
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(place) > cache:
                    place, logs = {}, logs[:0]
                texts = part.column(at_text).to_pylist()
                found, new = [], {}
                for text in texts:
                    words = _words(text) if text and known else []
                    ids = list(map(place.get, words))
                    if None in ids:
                        for i, x in enumerate(ids):
                            if x is None:
                                ids[i] = new.setdefault(words[i], len(place) + len(new))
                    found.append(np.array(ids, dtype=np.int32))
                if new:
                    fresh = list(new)
                    logs = np.concatenate([logs] + [g.log_likelihood(fresh[k : k + 4000], p) for k in range(0, len(fresh), 4000)])
                    place.update(new)
                pred, score = [], []
                for text, ids in zip(texts, found):
                    if not len(ids) or not any(map(str.isalpha, text)):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    x = np.take(logs, ids, axis=0).sum(axis=0)
                    x = np.exp(x - x.max())
                    k = int(x.argmax())
                    pred.append(known[k])
                    score.append(round(float(x[k] / x.sum()), 6))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=out.names)

    own = [] if "text" in keep else ["text"]
    at_text = [*keep, *own].index("text")
    rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(whole([*keep, *own]))))
    out = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).toDF(*keep, *names)


def predict(docs: DataFrame, model: str, langs: list[str], prob: np.ndarray, cache: int = 200_000) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return annotate(docs.select("doc_id", "text"), model, langs, prob, ["doc_id"], cache=cache)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that nothing is learned from."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0) & F.col(doc_id).isNotNull()


def identify(docs: DataFrame, model: str, per_lang: int = 1500) -> DataFrame:
    """Learns from the rows outside the held-out fold, predicts all: doc_id, held_out, lang_pred, score."""
    langs, prob = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), model, per_lang)
    return predict(docs, model, langs, prob).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
