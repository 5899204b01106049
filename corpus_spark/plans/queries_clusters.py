"""Queries of k-means on a grid, and the same steps as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.operators import clusters
from corpus_spark.plans import bindings as Z
from corpus_spark.plans.queries import query

_GRID = """b AS (SELECT pow(2, 20 - ceil(log2(max(abs(x))))) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)),
e AS MATERIALIZED (SELECT vec_id, i, floor(embedding[i]::DOUBLE * s + 0.5)::BIGINT AS x FROM embeddings, b, unnest(range(1, len(embedding) + 1)) u(i))"""


def _steps(p: str, k: int, seed: int, rounds: int) -> str:
    """Tables ``p``f1.. of start points, ``p``c0.. of centres and ``p``a, the topic of each vector after all rounds."""
    far = lambda n, before: f"SELECT c.r, c.vec_id, least({before}, sum((a.x - z.x) * (a.x - z.x))) AS d FROM {p}n{n - 1} c JOIN e a USING (vec_id) JOIN e z ON z.i = a.i AND z.vec_id = (SELECT vec_id FROM {p}f{n}) GROUP BY c.r, c.vec_id{', c.d' if n > 1 else ''}"
    sql = [f"{p}n0 AS (SELECT r, vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('{seed}:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= {64 * k})", f"{p}f1 AS (SELECT vec_id FROM {p}n0 WHERE r = 1)"]
    for n in range(1, k):
        sql.append(f"{p}n{n} AS MATERIALIZED ({far(n, 'c.d' if n > 1 else 'NULL')})")
        sql.append(f"{p}f{n + 1} AS MATERIALIZED (SELECT vec_id FROM {p}n{n} WHERE d > 0 ORDER BY d DESC, r LIMIT 1)")
    sql.append(f"{p}c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {n} AS t, i, x FROM e WHERE vec_id = (SELECT vec_id FROM {p}f{n + 1})" for n in range(k)) + ")")
    near = lambda n: f"SELECT vec_id, t FROM (SELECT vec_id, t, row_number() OVER (PARTITION BY vec_id ORDER BY d, t) AS r FROM (SELECT e.vec_id, c.t, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN {p}c{n} c USING (i) GROUP BY e.vec_id, c.t)) WHERE r = 1"
    for n in range(rounds):
        sql.append(f"{p}a{n} AS MATERIALIZED ({near(n)})")
        mean = f"SELECT t, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM {p}a{n} JOIN e USING (vec_id) GROUP BY t, i"
        sql.append(f"{p}c{n + 1} AS MATERIALIZED (SELECT t, i, coalesce(m.x, c.x) AS x FROM {p}c{n} c LEFT JOIN ({mean}) m USING (t, i))")
    return ",\n".join([*sql, f"{p}a AS MATERIALIZED ({near(rounds)})"])


@query(f"WITH {_GRID},\n{_steps('', 10, 42, 6)}\nSELECT vec_id, t::INT AS topic_id FROM a")
def w6_grid_kmeans(spark, d):
    """All vectors in ten topics after six rounds."""
    got = clusters.grid_topics(Z.table(spark, d, "embeddings"), "vec_id", 10, [42], rounds=6)
    return got.select("vec_id", F.col("topic_42").alias("topic_id"))


_ARI = """m AS (SELECT p.t AS a, q.t AS b, count(*)::DOUBLE AS n FROM pa p JOIN qa q USING (vec_id) GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM m), x AS (SELECT sum(k * (k - 1) / 2) AS x FROM (SELECT sum(n) AS k FROM m GROUP BY a)), y AS (SELECT sum(k * (k - 1) / 2) AS y FROM (SELECT sum(n) AS k FROM m GROUP BY b))
SELECT round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y"""


@query(f"WITH {_GRID},\n{_steps('p', 10, 42, 6)},\n{_steps('q', 10, 43, 6)},\n{_ARI}")
def w11_grid_stability(spark, d):
    """Two seeds in the same scans."""
    return clusters.grid_stability(Z.table(spark, d, "embeddings"), "vec_id", 10, 42, rounds=6).select(F.round("ari", 6).alias("ari"))
