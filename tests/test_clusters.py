"""K-means on a grid against plain integer arithmetic; odd vectors, ties, repeats and partitions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import clusters

KIND = "id long, embedding array<double>"


def plain(vectors, k, seed, rounds):
    """Python integers only; all vectors are start candidates."""
    top = max(abs(x) for v in vectors.values() for x in v)
    scale = 2.0 ** (min(20, (51 - (len(next(iter(vectors.values()))) - 1).bit_length()) // 2) - math.ceil(math.log2(top)))
    q = {i: [math.floor(x * scale + 0.5) for x in v] for i, v in vectors.items()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    order = sorted(q, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[: 64 * k]
    centres = [q[order[0]]]
    while len(centres) < k:
        far = max(order, key=lambda i: min(dist(q[i], c) for c in centres))  # max() keeps the first of equals
        if min(dist(q[far], c) for c in centres) == 0:
            break
        centres.append(q[far])
    near = lambda p: min(range(len(centres)), key=lambda t: dist(p, centres[t]))
    for _ in range(rounds):
        topic = {i: near(p) for i, p in q.items()}
        for t in range(len(centres)):
            own = [q[i] for i in q if topic[i] == t]
            if own:
                centres[t] = [sum(c) // len(own) for c in zip(*own)]
    return {i: near(p) for i, p in q.items()}


def found(df, *seeds):
    return [{r["id"]: r[f"topic_{s}"] for r in df.collect()} for s in seeds]


def test_grid_topics_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(4, 5)) * 3
    vectors = {k: (middle[k % 4] + rng.normal(size=5)).tolist() for k in range(300)}
    df = spark.createDataFrame(list(vectors.items()), KIND)
    one = found(clusters.grid_topics(df, "id", 4, [1, 2], rounds=5), 1, 2)
    assert one == [plain(vectors, 4, s, 5) for s in (1, 2)]
    again = found(clusters.grid_topics(df.repartition(13, F.rand(3)), "id", 4, [1, 2], rounds=5), 1, 2)
    assert again == one


def test_fewer_candidates_than_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = {k: rng.normal(size=3).tolist() for k in range(400)}
    df = spark.createDataFrame(list(vectors.items()), KIND)
    assert found(clusters.grid_topics(df, "id", 2, [7], rounds=3), 7) == [plain(vectors, 2, 7, 3)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (1, [1.0, 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 99, "x") for i, v in rows], KIND + ", topic_3 int, _v string")
    got = clusters.grid_topics(df, "id", 8, [3])
    assert sorted(got.columns) == sorted(df.columns) and got.count() == len(rows)
    topic = {(r["id"], str(r["embedding"])): r["topic_3"] for r in got.collect()}
    assert all(topic[i, str(v)] is None for i, v in rows if i in (4, 5, 6, 7, 8, 9))
    assert topic[1, "[1.0, 0.0]"] == topic[2, "[1.0, 0.0]"] and len({t for t in topic.values() if t is not None}) == 3  # three different vectors
    assert got.limit(0).count() == 0 and clusters.grid_topics(df.limit(0), "id", 3, [3]).count() == 0
    assert clusters.grid_topics(df.filter("id = 4"), "id", 3, [3]).first()["topic_3"] is None
    zeros = spark.createDataFrame([(k, [0.0, 0.0]) for k in range(5)], KIND)
    assert {r["topic_0"] for r in clusters.grid_topics(zeros, "id", 3, [0]).collect()} == {0}
    assert clusters.grid_stability(zeros, "id", 3, 0).first()["ari"] == 1.0


def test_too_many_cells_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 100)], KIND)
    with pytest.raises(ValueError, match="cells"):
        clusters.grid_topics(df, "id", 200_000, [1])


def test_rounds_read_each_vector_once(spark):
    """Two seeds share a scan, and what is shuffled is sums of tasks, not vectors."""
    df = spark.range(2000).select("id", F.array((F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double")).alias("_v")).repartition(8)
    runs = [np.zeros((2, 2)), np.ones((3, 2))]
    new = clusters._averaged(df.select("_v"), runs, 1.0)
    assert [c.shape for c in new] == [(2, 2), (3, 2)] and np.array_equal(new[1][1:], np.ones((2, 2)))
    assert np.array_equal(new[0][0], [0, 2]) and np.array_equal(new[0][1], [0, 0])  # floor of the means 0.9995 and 2
