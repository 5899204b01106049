"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import dialogue_repair as D
from corpus_spark.llm import lexical_search as S
from corpus_spark.llm import toxicity as X

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=10):
    found = [(i, t, Counter(_TERM.findall(t.translate(_LOW)))) for i, t in docs if t]
    found = [(i, c, sum(c.values())) for i, _, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in _TERM.findall((text or "").translate(_LOW)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("few,asked", [(64, 300_000), (3, 0)])
def test_search_is_exact(spark, few, asked):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "naïve", "日本", "x"]
    text = lambda n: " ".join(words[k] for k in np.minimum(rng.zipf(1.3, n) - 1, len(words) - 1))
    docs = [(k, text(rng.integers(1, 80))) for k in range(300)] + [(1000 + k, "w3 w9, W9!") for k in range(150)] + [(7, text(30)), (None, "w3 w9 w9"), (500, None), (501, ""), (502, " .,;"), (503, "w1 " * 3000)]
    items = [(1, "w3 w9 w9 w40"), (2, text(25)), (3, ""), (4, None), (5, "unknown terms"), (2, "日本 naïve"), (6, "w0"), (7, "ÜBER-w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    made = S.index(d)
    got = sorted((tuple(r) for r in S.search(made, q, few=few, block_terms=20, small_asked=asked).collect()), key=repr)
    assert got == ranked(docs, items)
    assert S.search_documents(d.limit(0), q).count() == 0 and S.search(made, q.limit(0)).count() == 0


def test_bounds_are_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 5, 400):
        counts = Counter(f"t{k}".encode() for k in rng.integers(0, 300, n))
        maxima = np.frombuffer(S.sketch(counts), dtype=np.uint8).reshape(S.ROWS, -1)
        assert maxima.shape[1] == S.width(len(counts)) >= S.SPREAD * len(counts)
        at = S._hashes(list(counts)) & np.uint64(maxima.shape[1] - 1)
        for j, (_, tf) in enumerate(counts.items()):
            assert min(maxima[r, int(at[r, j])] for r in range(S.ROWS)) >= min(tf, S.MOST)


def cheapest(rows):
    """All edit sequences by exhaustion: the least (cost, audit) for rows of (initial, must go, truncated)."""
    best = {}

    def go(i, state, cost, audit, inserts):
        if cost > best.get("cost", (99,))[0] or inserts > 4:
            return
        if i == len(rows) and state in (0, 3):
            best["cost"] = min(best.get("cost", (99, "")), (cost, audit))
        ins = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        go(i, ins, cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, state, cost + 2, audit + "D", 0)
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if to is not None:
                    go(i + 1, to, cost + 5 * cut, audit + "K", 0)
                go(i + 1, ins, cost + 1 + 5 * cut, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best["cost"]


def test_block_tables_against_exhaustion():
    symbols = [("u", 1, 0), ("s", 0, 0), ("s", 0, 1), ("u", 0, 0), ("u", 0, 1), ("a", 0, 0), ("a", 0, 1), ("x", 0, 0), ("x", 0, 1)]
    for n in range(4):
        for own in itertools.product(range(9), repeat=n):
            want = cheapest([symbols[k] for k in own])
            for size in (1, 2, 4):
                assert D.tables(size).repair(np.array(own, dtype=np.int64)) == want, own
    rng = np.random.default_rng(0)
    for n in (5, 6, 7):
        for _ in range(25):
            own = rng.integers(0, 9, n)
            assert D.tables(3).repair(own) == D.tables().repair(own) == cheapest([symbols[k] for k in own])
    long = rng.integers(0, 9, 5003)
    assert D.tables(1).repair(long) == D.tables(4).repair(long)


def test_repair_of_odd_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 5, "user", " \t"), (2, 7, "user", "cut"), (3, None, None, None), (None, 1, "user", "Who?"), (None, 2, "assistant", "Me!"), (4, 0, "tool", "x."), (4, 1, "user", "x.\n"), (4, 1, "user", "x.\n"), (5, 0, "system", "é" * 100_000 + "."), (5, 1, "user", "a."), (5, 3, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash"))
    got = {r["conv_id"]: r.asDict() for r in D.repair(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == ("KK", 0, sha("user:Hi.\nassistant:Yes."))
    assert (got[2]["audit"], got[2]["blank"], got[2]["truncated"], got[2]["gaps"], got[2]["repaired_sha256"]) == ("DD", 1, 1, 1, sha(""))
    assert (got[3]["blank"], got[3]["gaps"], got[3]["audit"]) == (1, 0, "D") and got[None]["audit"] == "KK"
    assert (got[4]["duplicate"], got[4]["illegal"], got[4]["audit"]) == (1, 2, "RRD")
    assert got[5]["audit"] == "KKK" and got[5]["repaired_sha256"] == sha("system:" + "é" * 100_000 + ".\nuser:a.\nassistant:b.")
    assert D.repair(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(k, t, "assistant", "Is it? Yes.") for k in range(200) for t in range(2)] + [(None, None, None, None)]
    got = D.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["turn"]), []).append(r)
    assert len(by) == 401
    for (c, t), rs in by.items():
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if c is None else "Is it? Yes."
        assert len(rs) == (2 if h == 3 else 1) and all(r["gone"] == (h == 0) for r in rs)
        assert all(r["text"] == {0: "", 1: "", 2: text.replace("?", "").replace(".", "")}.get(h, text) and r["role"] == ("user" if h == 4 else " " if c is None else "assistant") for r in rs)


def test_spooled_conversation(spark, monkeypatch):
    monkeypatch.setattr(D, "_SPOOL", 50)
    c = D._Conversation(1)
    for k in range(40):
        c.add(k, "user" if k % 2 == 0 else "assistant", f"text {k}.")
    got = c.result()
    assert got["audit"] == "K" * 40 and got["repaired_sha256"] == hashlib.sha256("\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:text {k}." for k in range(40)).encode()).hexdigest()


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(5)
    calm, rude = ["river", "table", "cloud", "garden", "window", "paper"], ["blorgface", "snarkwit", "grumbot"]
    texts, labels = [], []
    for k in range(600):
        words = [calm[x] for x in rng.integers(0, 6, 40)]
        toxic = k % 4 == 0
        if toxic:
            words[int(rng.integers(40))] = rude[int(rng.integers(3))].upper() + "!"
        texts.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    texts += [(None, "a"), (700, None), (701, ""), (702, "river " * 20_000 + "snarkwit"), (3, "river river")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = X.fit(docs, known)
    got = X.score(docs, model).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    toxic = {k for k, t in labels if t}
    own = [r for r in held if r["doc_id"] < 600 and r["doc_id"] != 3]
    assert np.mean([r["predicted"] == (r["doc_id"] in toxic) for r in own]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (700, 701)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert {r["predicted"] for r in got if r["doc_id"] == 702} == {1}
    # labels of held-out documents have no part: turned over, they leave the model as it is
    turned = known.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = X.fit(docs, turned)
    assert np.array_equal(again[0] != 0, model[0] != 0) and np.allclose(again[0], model[0], atol=1e-6)
    none = X.fit(docs, known.filter("toxic = 0"))
    assert none is None and {r["score"] for r in X.score(docs, none).collect()} == {0.0}
    assert X.score(docs.limit(0), model).count() == 0


def test_places_by_hand():
    """Places of a text are those of its runs, each taken alone."""
    text = " Ab  cÉ\nd "
    runs = {" ab cé d "[i : i + n] for n in range(3, 7) for i in range(10 - n)}

    def place(run):
        h = np.uint32(2166136261)
        with np.errstate(over="ignore"):
            for c in run:
                h = (h ^ np.uint32(ord(c))) * np.uint32(16777619)
            return int(((h ^ (h >> np.uint32(15)) ^ np.uint32(len(run))) * np.uint32(2654435761)) >> np.uint32(12))

    assert set(X.places(text).tolist()) == {place(r) for r in runs}
    assert X.places("").size == X.places(None).size == 0
