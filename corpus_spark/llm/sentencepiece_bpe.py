"""Operator 8: SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda (a heap) of adjacent symbol pairs ordered by the score of the piece that
they would make, leftmost first among equals, and merges until the agenda is empty. Symbols that are
no piece become byte pieces. No piece has a word mark behind another character and none holds a
newline, so merges never cross those places: texts are cut there and a bounded cache keeps the ids
of chunks. Every chunk that enters the cache is compared with the sentencepiece library's ids, by
Arrow batch; a difference raises an error. Decoding is the library's decode(ids).

Null and empty texts have no ids and decode to the empty text; very long texts are encoded whole. Pairs
of equal score go by place, the leftmost first. Repeated rows and ids are encoded each; an empty table
gives no rows. Other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_FAR = 48


class Agenda:
    """Merge-type encoder over the pieces and scores of a model file."""

    def __init__(self, path: str, cache: int = 1_200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        special = lambda i: self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if not special(i)}
        ranks = {x: k for k, x in enumerate(sorted({-self.sp.get_score(i) for i in self.ids.values()}))}
        self.order = {p: ranks[-self.sp.get_score(i)] for p, i in self.ids.items()}
        self.bytes = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        odd = [p for p in self.ids if "\n" in p or re.search(f"[^{MARK}]{MARK}", p)]
        if odd or len(self.bytes) != 256:
            raise ValueError("texts can't be cut at words with this vocabulary")
        self.text = [str(i) for i in range(n)]
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def merge(self, chunk: str) -> list[int]:
        """Ids of a normalised chunk."""
        symbols = list(chunk)
        n = len(symbols)
        order = self.order.get
        made = list(map(order, map(add, symbols, symbols[1:])))
        agenda = [(r << 32) + i for i, r in enumerate(made) if r is not None]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            made.append(None)  # made[i]: what symbol i and the next would make now
            while agenda:
                top = heappop(agenda)
                i = top & 0xFFFFFFFF
                if made[i] != top >> 32:
                    continue  # one of the two has been merged meanwhile
                j = after[i]
                piece = symbols[i] = symbols[i] + symbols[j]
                symbols[j] = ""
                made[j] = None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = made[i] = order(piece + symbols[k])
                    if r is not None:
                        heappush(agenda, (r << 32) + i)
                else:
                    made[i] = None
                h = before[i]
                if h >= 0:
                    r = made[h] = order(symbols[h] + piece)
                    if r is not None:
                        heappush(agenda, (r << 32) + h)
        left = list(filter(None, symbols))
        ids = list(map(self.ids.get, left))
        if None in ids:
            ids = [x for s, i in zip(left, ids) for x in ((i,) if i is not None else [self.bytes[b] for b in s.encode("utf-8", "replace")])]
        return ids

    def _agree(self, text: str, own: list[int]) -> None:
        if self.sp.encode(text, num_threads=1) != own:
            raise ValueError(f"ids differ from the library's in {text[:80]!r}")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encodes unseen chunks, each the rest behind a word mark or led by a newline."""
        words = [c for c in chunks if c[:1] != "\n" and c]
        lines = [c for c in chunks if c[:1] == "\n"]
        found, own = {}, []
        for c in words:
            own += (ids := self.merge(MARK + c))
            found[c] = array("i", ids).tobytes()
        for c in lines:
            own += (ids := self.merge("\n") + (self.merge(c[1:]) if len(c) > 1 else []))
            found[c] = array("i", ids).tobytes()
        if "" in chunks:
            found[""] = array("i", self.merge(MARK)).tobytes()
        if words:
            self._agree(" ".join(words) + "".join(lines), own)
        elif lines:
            self._agree("a" + "".join(lines), self.merge(MARK + "a") + own)
        return found

    def _plain(self, text: str) -> bytes:
        """A text in which blanks meet or word marks occur."""
        own: list[int] = []
        for chunk in re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", MARK + text.replace(" ", MARK)):
            own += self.merge(chunk)
        self._agree(text, own)
        return np.array(own, dtype="<i4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        out: list = []
        cache, cut, new = self.cache, [], set()
        if len(cache) >= self.most:
            cache.clear()
        for text in texts:
            out.append(b"")
            if not text:
                continue
            if text[0] == " " or "  " in text or MARK in text:
                out[-1] = self._plain(text)
                continue
            chunks = text.replace("\n", " \n").split(" ")
            if text[0] == "\n":
                chunks[0] = ""  # the word mark that leads every text
            found = list(map(cache.get, chunks))
            lost = [i for i, x in enumerate(found) if x is None]
            new.update([chunks[i] for i in lost])
            cut.append((len(out) - 1, chunks, found, lost))
        made = self._learn(list(new)) if new else {}
        cache.update((c, v) for c, v in made.items() if len(c) <= _FAR)
        for at, chunks, found, lost in cut:
            for i in lost:
                found[i] = made[chunks[i]]
            out[at] = b"".join(found)
        return [np.frombuffer(x, dtype="<i4").tolist() for x in out]


_MADE: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    if path not in _MADE:
        _MADE[path] = Agenda(path)
    return _MADE[path]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, decoded string. One narrow pass, no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = agenda(model)
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = enc.encode(part["text"])
                yield pd.DataFrame({"id": part["id"], "ids": ids, "decoded": enc.sp.decode(ids, num_threads=1) if ids else []})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode() with the digests taken where the ids are: only four values a row leave Python."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = agenda(model)
        name = enc.text.__getitem__
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = enc.encode(part["text"])
                yield pd.DataFrame({"id": part["id"], "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(",".join(map(name, x))) for x in ids], "decoded_sha256": [sha(x) for x in enc.sp.decode(ids, num_threads=1)]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
