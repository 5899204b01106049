import zlib

import numpy as np
import pytest

from corpus_spark.llm import packing, sentencepiece_bpe, token_counts
from corpus_spark.llm.bpe import ByteBpe
from corpus_spark.llm.queries import vocabulary

TEXTS = ["", " ", "a", " a", "a  b", "a \nb", "\n\na", "a\n", "a ", "don't  stop", "x\ty", "<|endoftext|> a <s>", "é" * 100 + " x", "a\n\n b", "日本 語\n", "a b\r\nc", "ÀÉ 😀 x\x00y", "▁▁a ▁", "a\x85b  c", "one two " * 5000, "x" * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")


def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_byte_bpe_is_exact():
    path = vocabulary("byte_bpe_50k.json")
    whole, enc = library(path), ByteBpe(path)
    assert enc.fast is not None
    texts = [*TEXTS, "name\tage\n\n\tx", "col1\tcol2\tcol3\n\n\nnext line", "<|endoftext|>", " " * 5000 + "x", "word " * 20_000, "é" * 100_000, "\n" * 1999 + "a" * 1999]
    assert enc.encode(texts) == list(map(whole, texts))
    assert enc.encode([None]) == [b""]


def test_byte_bpe_on_all_white_space():
    path = vocabulary("byte_bpe_50k.json")
    whole, enc = library(path), ByteBpe(path)
    space = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()] + ["\u200b", "\u180e", "\ufeff"]
    pool = space * 2 + [*"aé日😀1٣!'-,sSdt", "'s", "'ll", " word", "<|endoftext|>", "\u0301"]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(pool, rng.integers(1, 40)))
        assert enc.encode([text])[0] == whole(text), text
    for block in range(0, 0x110000, 64):  # every code point, between letters and alone
        text = "".join(f"a{c} {c}{c}1{c}'s" for c in map(chr, range(block, block + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert enc.encode([text])[0] == whole(text), hex(block)


def test_sentencepiece(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, None, "repeated", "repeated"]
    got = sentencepiece_bpe.encode_decode(docs(spark, texts), path).orderBy("doc_id").collect()
    for row, t in zip(got, texts):
        ids = sp.encode(t or "")
        assert row["ids"] == ids and row["decoded"] == sp.decode(ids)
    assert sentencepiece_bpe.digests(docs(spark, texts).limit(0), path).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for cap in (10, 2048):
        for _ in range(20):
            n = rng.integers(1, cap + 1, rng.integers(1, 200))
            bins, offset, room = packing.best_fit_decreasing(n, cap)
            v, c = np.unique(n, return_counts=True)
            bound = packing.lower_bound(v, c, cap)
            assert bound <= len(room)
            for b in range(len(room)):
                at = np.flatnonzero(bins == b)
                at = at[np.argsort(offset[at])]
                assert offset[at].tolist() == np.r_[0, np.cumsum(n[at])[:-1]].tolist() and n[at].sum() <= cap
    assert packing.lower_bound(np.array([6]), np.array([5]), 10) == 5  # two never fit one bin
    assert packing.lower_bound(np.array([], dtype=int), np.array([], dtype=int), 10) == 0


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    texts = [*TEXTS, None, "same", "same"]
    rows = packing.pack_documents(docs(spark, texts), path).collect()
    ids = [np.frombuffer(x, dtype="<u4").tolist() + [0] for x in ByteBpe(path).encode(texts)]
    for doc, want in enumerate(ids):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs(spark, ["a"]).limit(0), path).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_packing_exchanges_between_partitions(spark, seed):
    n = np.random.default_rng(seed).integers(1, 900, 600).tolist()
    items = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "k long, length long")
    got = packing.pack(items, 2048, per_task=60).collect()
    assert sorted(r["k"] for r in got) == list(range(600))
    few = len({r["sequence_id"] for r in got})
    v, c = np.unique(n, return_counts=True)
    bound = packing.lower_bound(v, c, 2048)
    assert few <= bound + 1 and all(r["table_gap"] == few - bound and r["certified"] == (r["gap"] == 0 or few <= bound) for r in got)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(x for _, x in p) <= 2048 and [o for o, _ in sorted(p)] == [sum(x for _, x in sorted(p)[:i]) for i in range(len(p))] for p in places.values())
    again = packing.pack(items.repartition(7), 2048, per_task=60).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_packing_reports_what_tasks_too_small_leave(spark):
    n = np.random.default_rng(5).integers(1, 900, 600).tolist()
    items = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "k long, length long")
    got = packing.pack(items, 2048, per_task=60, most=60).collect()
    v, c = np.unique(n, return_counts=True)
    assert sorted(r["k"] for r in got) == list(range(600))
    assert {r["table_gap"] for r in got} == {len({r["sequence_id"] for r in got}) - packing.lower_bound(v, c, 2048)}


def test_packing_of_equal_rows(spark):
    items = spark.createDataFrame([(None, 1025)] * 300 + [(1, 1023)] * 300, "k long, length long")
    got = packing.pack(items, 2048, per_task=50).collect()
    assert len(got) == 600 and len({r["sequence_id"] for r in got}) <= 301


def test_token_counts(spark):
    path = vocabulary("byte_bpe_50k.json")
    texts = [*TEXTS, None]
    n = [len(x) // 4 for x in ByteBpe(path).encode(texts)]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs(spark, texts), path)), block=8)
    for r in sums.collect():
        x = r["length"]
        assert r["n_docs"] == n.count(x) and r["docs_from"] == sum(k >= x for k in n) and r["tokens_from"] == sum(k for k in n if k >= x)
        assert r["docs_up_to"] == sum(k <= x for k in n) and r["tokens_cut_here"] == sum(min(k, x) for k in n)
    for r in token_counts.at_limits(sums, [0, 3, 100, 10**6]).collect():
        assert r["truncated_total"] == sum(min(k, r["limit"]) for k in n) and r["n_longer"] == sum(k > r["limit"] for k in n)
    half = token_counts.quantiles(sums, [0.5]).first()["length"]
    assert sum(k <= half for k in n) >= len(n) / 2 > sum(k < half for k in n)
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs(spark, texts).limit(0), path))).count() == 0


@pytest.mark.parametrize("text", ["abc", "über", "日本"])
def test_agenda_merges_like_the_library(text):
    a = sentencepiece_bpe.agenda(vocabulary("piece_bpe_32k.model"))
    assert a.merge("▁" + text) == a.sp.encode(text)
