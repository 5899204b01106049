import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpus_spark.llm import jaccard, neighbours
from corpus_spark.llm.common import components


def classes(n, links):
    low = {k: k for k in n}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


def test_components(spark):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(25)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = classes({x for p in e for x in p}, e)
    assert all(got[k] == v for k, v in want.items() if k in got) and {k for a, b in e if a != b for k in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: len(v) for k, v in sets.items()}, classes(sets, links)


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts, k = {}, 0
    for _ in range(8):
        base = list(rng.choice(words, rng.integers(40, 120)))
        for _ in range(14):
            t = list(base)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(len(t))] = str(rng.choice(words))
            texts[k] = " ".join(t)
            k += 1
    shared = " ".join(rng.choice(words, 30))
    for _ in range(30):
        texts[k] = " ".join(rng.choice(words, 20)) + " " + shared
        k += 1
    texts |= {k: None, k + 1: "", k + 2: "One", k + 3: "one", k + 4: "a b", k + 5: " A  b ", k + 6: "\n"}
    df = spark.createDataFrame([(a, t, "clash") for a, t in texts.items()], "doc_id long, text string, size string")
    for n, percent in ((3, 90), (5, 80)):
        size, comp = brute(texts, n, percent)
        got = {r["doc_id"]: r for r in jaccard.join_components(df, n, percent, one_in=2).collect()}
        assert {a: r["n_shingles"] for a, r in got.items()} == size
        assert {a: r["component_id"] for a, r in got.items()} == comp


def test_jaccard_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(4000)]
    passage = list(rng.choice(words, 60))
    texts = {k: " ".join([*passage, *rng.choice(words, 6)]) for k in range(60)}  # one passage in all, most of each
    texts |= {100 + k: " ".join(passage) for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    real = jaccard._members
    monkeypatch.setattr(jaccard, "_members", lambda c: real(c, hot=5))
    size, comp = brute(texts, 3, 90)
    for bucket in (7, 1000):
        got = {r["doc_id"]: r for r in jaccard.join_components(df, 3, 90, one_in=2, rounds=0, bucket=bucket).collect()}
        assert {a: r["component_id"] for a, r in got.items()} == comp and {a: r["n_shingles"] for a, r in got.items()} == size


def test_jaccard_edges(spark):
    kind = "doc_id long, text string"
    assert jaccard.join_components(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "x y z"), (4, "q r s t"), (None, "a b c d e f")]
    got = jaccard.join_components(spark.createDataFrame(rows, kind)).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == 1 and by[2] == 1 and by[3] == 3 and by[4] == 4 and None in by


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(6):
            c = rng.standard_normal(16)
            for _ in range(int(rng.integers(2, 40))):
                rows.append((k, (c + 0.1 * rng.standard_normal(16)).tolist(), label))
                k += 1
        for _ in range(100):
            rows.append((k, rng.standard_normal(16).tolist(), label))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 1), (k + 2, rows[0][1], None), (k + 3, None, 0), (k + 4, [0.0] * 16, 0), (k + 5, [float("nan")] * 16, 0), (k + 6, [None] * 16, 0), (k + 7, [1.0] * 8, 0), (k + 8, [2.0] * 8, 0), (k + 9, [], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, sim string")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df, 0.95).collect()}
    assert len(got) == len(rows)
    good = {i: (np.array(v, dtype=np.float32).astype(float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.linalg.norm(v), l) for i, (v, l) in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.95]
    comp = classes([r[0] for r in rows], links)
    n = {i: 0 for i in comp}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    same = sum(got[i]["n_links"] == n[i] and got[i]["component_id"] == comp[i] for i in comp)
    assert same >= 0.99 * len(comp)
    assert all(got[i]["n_links"] <= n[i] for i in comp) and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_neighbours_of_any_magnitude_and_label(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 16))
    x[1::2] = x[::2] * 1.0001 + 0.001
    x *= np.where(np.arange(40) % 4 < 2, 1e200, 1e-200)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i // 20]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in neighbours.near_duplicates(df).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(40)}


def test_neighbours_find_rare_links(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for a in range(0, 400, 2):
        off = rng.standard_normal(64)
        off -= (off @ x[a]) * x[a]
        x[a + 1] = 0.981 * x[a] + np.sqrt(1 - 0.981**2) * off / np.linalg.norm(off)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df).collect()}
    found = sum(got[a]["component_id"] == got[a + 1]["component_id"] for a in range(0, 400, 2))
    assert found >= 0.99 * 200 and abs(got[0]["recall"] - found / 200) < 0.02
    assert neighbours.trees_for(1 << 20, 64, 0.98, 0.99) > neighbours.trees_for(4000, 64, 0.98, 0.99) > 2


def test_neighbours_exact_where_the_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_audit", lambda *a: None)
    monkeypatch.setattr(neighbours, "trees_for", lambda *a: 1)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 32))
    x[1::50] = x[::50] + 0.01 * rng.standard_normal((30, 32))
    df = spark.createDataFrame([(i, v.tolist(), i // 50 % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df, leaf=4, trees=1, descents=0, max_rounds=1).collect()}
    assert all(got[a + 1]["component_id"] == a and got[a]["n_links"] == 1 for a in range(0, 1500, 50)) and sum(r["n_links"] for r in got.values()) == 60


def test_neighbours_join_saturated_groups(spark):
    rng = np.random.default_rng(8)
    axes = np.eye(16)
    turn = np.arccos(0.98) - 0.03
    rows = []
    for g, c in enumerate((axes[0], np.cos(turn) * axes[0] + np.sin(turn) * axes[1])):
        rows += [(20 * g + i, (c + 0.002 * rng.standard_normal(16)).tolist(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.near_duplicates(df).collect()
    assert {(r["component_id"], r["n_links"], r["kept"]) for r in got} == {(0, 39, True), (0, 39, False)} and all(r["saturated"] for r in got)


def test_jaccard_counts_every_link(spark):
    words = [f"w{k}" for k in range(120)]
    texts = {k: " ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(60)} | {100: " ".join(words), 101: " ".join(words), 102: "other words here"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_class_links"] for r in jaccard.join_components(df, 3, 90, one_in=2, every_link=True).collect()}
    assert got == {k: 60 for k in range(60)} | {100: 60, 101: 60, 102: 0}


def test_rare_links_need_no_exact_comparison(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 24))
    x[6000:6060] = x[:60] + 0.02 * rng.standard_normal((60, 24))
    rows = [(k, v.tolist(), k % 60 % 2) for k, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "_exact", lambda *a: pytest.fail("all pairs were compared"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(k, 6000 + k) for k in range(60) if unit[k] @ unit[6000 + k] >= 0.98]
    assert len(links) > 50
    found = sum(got[a]["component_id"] == got[b]["component_id"] == a and got[a]["n_links"] >= 1 for a, b in links)
    assert found >= 0.99 * len(links) and got[0]["recall"] >= 0.99


def test_saturated_lists_grow(spark):
    edges = spark.createDataFrame([(1, 10 + k, 0.99 - k / 10_000) for k in range(20)] + [(2, 30 + k, 0.9 - k / 1000) for k in range(20)], "src long, dst long, sim double")
    for wide, want in ((4, 4), (8, 8), (48, 20)):
        got = neighbours._best(edges.repartition(3), 4, wide, 0.98).groupBy("src").count().collect()
        assert dict(got) == {1: want, 2: 4}


def test_levels_are_counted_over_all_documents(spark):
    """An n-gram of 40 of 4,000 documents has the level that all of them give; full cells are handed over and summed."""
    rows = [(k, f"a b c w{k} v{k} u{k}" if k % 100 == 0 else f"w{k} v{k} u{k}") for k in range(4000)]
    levels = jaccard.frequency_levels(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3)
    cell = lambda t: int(jaccard.shingle_hashes(t, 3)[0] >> np.uint64(40))
    assert levels.shape == (1 << 24,) and levels.dtype == np.uint8
    assert levels[cell("a b c")] == int(np.log2(40 / 3)) + 1 and levels[cell("w1 v1 u1")] == 0
    assert (levels > 0).sum() == 1
    many = [pa.RecordBatch.from_pydict({"text": ["x y z"] * 70_000})]
    packed = [np.frombuffer(zlib.decompress(x), dtype=np.uint16) for p in jaccard._counted(iter(many), 3) for x in p.column("counts").to_pylist()]
    assert len(packed) == 2 and sum(int(x.sum()) for x in packed) == 70_000
