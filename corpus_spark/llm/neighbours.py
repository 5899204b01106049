"""Operator 9: embedding near-duplicates by NN-descent.

Only vectors of the same non-null label are compared, by cosine in double precision. Equal vectors
are one class with a multiplicity. A neighbour graph with k entries a class starts from random
projection leaves and is refined by joins of neighbours of neighbours: each class sees its neighbours
and reverse neighbours together and proposes better ones to them.

Lists whose entries are all links are saturated: they double with each step, up to ``widest`` entries.
Beyond that components don't depend on them: whatever classes meet in a leaf or a join, all links among
them count, and a spanning forest of these is kept, so a list that stays saturated hides no link that
leaves its group. Within each component all links are counted in blocks of bounded size.

Two classes at the threshold share a leaf of b signs with probability (1 - angle / pi) ** b, whatever
the data. The number of trees grows with the largest label until one of them is shared with the target
probability; dense leaves are compared whole, in pairs of blocks. Recall of components is audited: small
tables by brute force, others by recapture with an independent set of trees. While it is under the
target, another round with new leaves follows, and only after the last one all classes of each label are
compared in blocks.

Vectors that are null, zero, or hold null or non-finite components link with nothing and form their
own component, as do vectors without label. Vectors of other lengths never link with each other.
Vectors of any magnitude count, very long ones too. Labels are of any type; those that are no integers
are compared by a 64-bit hash. Equal similarities go by id. Rows that repeat a vec_id count as vectors
of their own, and take the smallest id as usual. An empty table gives no rows. Other columns, whatever
their names, have no part in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.common import components, discard, small, written

_BLOCK = 512
_EDGE = "src bigint, dst bigint, sim double"
_MET = _EDGE + ", span boolean"
#: Tables of at most so many classes are audited by brute force.
_ASKED = 4096


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of numbers
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def can_link():
    """A label, an id and a non-zero vector of finite components."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.col("embedding").isNotNull() & good, F.lit(False))


def _leaves(reps: DataFrame, seed: int, leaf: int) -> DataFrame:
    """Adds the leaf of each row: signs of random projections, about ``leaf`` rows a leaf if signs are even."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for (label, dim), part in pdf.groupby(["label", "dim"]):
                n = int(part["of_label"].iat[0])
                bits = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
                code = np.zeros(len(part), dtype=np.int64)
                if bits:
                    planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits))
                    code = ((_unit(part["embedding"]) @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64)
                yield part.assign(code=code)

    return reps.mapInPandas(run, _schema(reps) + ", code bigint")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _best(edges: DataFrame, k: int, wide: int, limit: float) -> DataFrame:
    """The k most similar entries of each source, and up to ``wide`` where those are all links: a saturated list is enlarged.

    Partial lists are cut in each task before the shuffle.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.drop_duplicates(["src", "dst"]).sort_values(["src", "sim", "dst"], ascending=[True, False, True])
            at = pdf.groupby("src").cumcount()
            yield pdf[(at < k) | (at < wide) & (pdf["sim"] >= limit)]

    narrow = edges.mapInPandas(cut, _EDGE)
    w = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    ranked = narrow.dropDuplicates(["src", "dst"]).withColumn("r", w).filter(F.col("r") <= wide)
    return ranked.filter((F.col("r") <= k) | (F.col("sim") >= limit)).drop("r")


def _by_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], dict | None], schema: str) -> DataFrame:
    """Applies ``work`` to each group of rows; many small groups share an Arrow batch, and a group that a
    batch cuts is carried over. Only one group and one batch are in memory."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in parts:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            k = pdf[keys].to_numpy()
            cut = np.r_[0, 1 + np.flatnonzero((k[1:] != k[:-1]).any(axis=1))]
            held = pdf.iloc[cut[-1] :]
            yield from emit([pdf.iloc[a:b] for a, b in zip(cut[:-1], cut[1:])])
        if held is not None:
            yield from emit([held])

    def emit(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [m for m in map(work, groups) if m]
        if made:
            yield pd.DataFrame({c: np.concatenate([m[c] for m in made]) for c in made[0]})

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the first node of their component, for all but these, in a symmetric matrix of links."""
    root = np.full(len(near), -1)
    for i in np.flatnonzero(near.any(axis=1)):
        if root[i] < 0:
            root[i], new = i, np.array([i])
            while len(new):
                new = np.flatnonzero(near[new].any(axis=0) & (root < 0))
                root[new] = i
    at = np.flatnonzero((root >= 0) & (root != np.arange(len(near))))
    return at, root[at]


def _local(grouped: DataFrame, k: int, wide: int, limit: float) -> DataFrame:
    """What meets in each bounded group of (g, rep, embedding): best pairs as edges both ways, and a spanning forest of all links."""

    def best(pdf: pd.DataFrame) -> dict | None:
        ids, at = np.unique(pdf["rep"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        x = _unit([pdf["embedding"].iat[i] for i in at])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        m = min(k, len(ids) - 1)
        near = s >= limit
        if wide > m and (near.sum(axis=1) >= m).any():  # a saturated list: its further links are proposed too
            m = min(wide, len(ids) - 1)
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, axis=1), axis=1, kind="stable"), axis=1)
        rows = np.repeat(np.arange(len(ids)), m)
        kept = ((np.arange(m) < k) | np.take_along_axis(near, at, axis=1)).ravel()
        rows, at = rows[kept], at.ravel()[kept]
        a, b = _forest(near | near.T)
        return {"src": np.r_[ids[rows], ids[a]], "dst": np.r_[ids[at], ids[b]], "sim": np.r_[s[rows, at], np.ones(len(a))], "span": np.r_[np.zeros(len(rows), dtype=bool), np.ones(len(a), dtype=bool)]}

    return _by_group(grouped, ["g"], best, _MET)


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(g, rep, embedding) of rows with their group's size ``n``: every two blocks of a group meet in one g."""
    placed = rows.withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    sent = placed.select(*keys, "rep", "embedding", "block", F.explode(others).alias("o"))
    return sent.select(F.xxhash64(*keys, F.least("block", "o"), F.greatest("block", "o")).alias("g"), "rep", "embedding")


def _start(reps: DataFrame, seed: int, leaf: int, k: int, wide: int, limit: float) -> DataFrame:
    coded = _leaves(reps, seed, leaf)
    key = ["label", "dim", "code"]
    dense = small(written(coded.groupBy(*key).agg(F.count("*").alias("n")), "leaf"), 200_000)
    return _local(_in_blocks(coded.join(dense, key), key), k, wide, limit)


def _exact(reps: DataFrame, limit: float) -> DataFrame:
    """Spanning edges of all links: all classes of a label and length are compared, in pairs of blocks."""
    sizes = written(reps.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
    return _local(_in_blocks(reps.join(small(sizes, 200_000), ["label", "dim"]), ["label", "dim"]), 1, 1, limit).filter("span").select("src", "dst")


def trees_for(rows: int, leaf: int, limit: float, target: float) -> int:
    """So many trees that two classes at the threshold share a leaf with probability ``target``, in a label of ``rows``."""
    bits = max(0, int(np.ceil(np.log2(max(1.0, rows / leaf)))))
    share = (1 - np.arccos(np.clip(limit, -1, 1)) / np.pi) ** bits
    return 1 if share >= target else int(np.ceil(np.log(1 - target) / np.log(1 - share)))


def _descend(graph: DataFrame, reps: DataFrame, k: int, wide: int, limit: float, salt: int) -> DataFrame:
    """What meets in one round: every class compares its neighbours and at most 2k reverse neighbours with each other.

    Of more reverse neighbours, 2k are taken by a hash in this round; the others stay in the graph.
    """
    back = graph.select(F.col("dst").alias("g"), F.col("src").alias("rep"), F.xxhash64("src", "dst", F.lit(salt)).alias("h"))
    some = back.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).filter(F.col("r") <= 2 * k).select("g", "rep")
    near = graph.select(F.col("src").alias("g"), F.col("dst").alias("rep")).unionByName(some)
    vec = reps.select("rep", "embedding")
    grouped = near.join(vec, "rep").select("g", "rep", "embedding")
    own = graph.select(F.col("src").alias("rep")).distinct().join(vec, "rep").select(F.col("rep").alias("g"), "rep", "embedding")
    return _local(grouped.unionByName(own), k, wide, limit)


def _counts(members: DataFrame, limit: float) -> DataFrame:
    """Links of each class inside its component, by pairs of blocks: (rep, n).

    members: component, rep, weight, embedding. Each block meets each block of its component in a task.
    """
    many = members.groupBy("component").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    placed = members.join(many, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sent = placed.select(
        "component", "block", "rep", "weight", "embedding",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))).alias("p"),
    ).select("component", "block", "rep", "weight", "embedding", "p.*")

    def meet(pdf: pd.DataFrame) -> dict:
        lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
        a, b = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        if not len(a) or not len(b):
            return {"rep": pdf["rep"].to_numpy(), "n": np.zeros(len(pdf), dtype=np.int64)}
        x, y = _unit(a["embedding"]), _unit(b["embedding"])
        near = x @ y.T >= limit
        if lo == hi:
            np.fill_diagonal(near, False)
            return {"rep": a["rep"].to_numpy(), "n": near @ a["weight"].to_numpy(np.int64)}
        return {"rep": np.r_[a["rep"].to_numpy(), b["rep"].to_numpy()], "n": np.r_[near @ b["weight"].to_numpy(np.int64), near.T @ a["weight"].to_numpy(np.int64)]}

    return _by_group(sent, ["component", "lo", "hi"], meet, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n"))


def _audit(reps: DataFrame, comp: DataFrame, limit: float, queries: int) -> float:
    """Share of links that lie inside a component, by brute force for about ``queries`` classes, all of a small table.

    A class with many links doesn't hide the others: the lower of the shares by link and by class counts.
    """
    total = reps.count()
    if not total:
        return 1.0
    joined = written(reps.join(comp, reps["rep"] == comp["node"], "left").select("label", "dim", "rep", "embedding", F.coalesce("component", "rep").alias("component")), "audit")
    got = _asked(joined, limit, -(-total // queries))
    discard(joined)
    return float(min(got["found"].sum() / got["links"].sum(), (got["found"] / got["links"]).mean())) if len(got) else 1.0


def _recaptured(reps: DataFrame, comp: DataFrame, caught: DataFrame, trees: int, leaf: int) -> float:
    """Share of links that lie inside a component, by the links that leaves of an independent set of trees have caught.

    A link of similarity s meets in one of these trees with a known probability p(s); weighted by 1 / p each caught link
    stands for all like it, so the estimate holds for links near the threshold as for equal vectors. The work is that of
    a few trees, however rare links are. Nothing caught: nothing is known to be missing.
    """
    links = caught.filter("src < dst").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    ends = links.join(comp.select(F.col("node").alias("src"), F.col("component").alias("a")), "src", "left").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst", "left")
    sized = ends.join(reps.select(F.col("rep").alias("src"), "of_label"), "src")
    bits = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("of_label") / leaf))).cast("double"))
    share = F.pow(1 - F.acos(F.least(F.lit(1.0), "sim")) / np.pi, bits)
    weight = 1 / (1 - F.pow(1 - share, F.lit(trees)))
    got = sized.select(weight.alias("w"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("int").alias("found")).agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("found")).alias("found")).first()
    return float(got["found"] / got["all"]) if got["all"] else 1.0


def _asked(joined: DataFrame, limit: float, one_in: int) -> pd.DataFrame:
    """rep, links, found of the asked classes that have links."""
    asked = joined.filter(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(one_in)) == 0).toPandas()  # a hash sample of known expected size
    by_dim = {dim: (q["label"].to_numpy(), q["rep"].to_numpy(), _unit(q["embedding"]), q["component"].to_numpy()) for dim, q in asked.groupby("dim")}
    shared = joined.sparkSession.sparkContext.broadcast(by_dim)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = {dim: np.zeros((2, len(q[1])), dtype=np.int64) for dim, q in shared.value.items()}
        for pdf in parts:
            for dim, part in pdf.groupby("dim"):
                if dim in links:
                    label, rep, q, c = shared.value[dim]
                    for at in range(0, len(part), 512):
                        rows = part.iloc[at : at + 512]
                        near = _unit(rows["embedding"]) @ q.T >= limit
                        near &= (rows["label"].to_numpy()[:, None] == label) & (rows["rep"].to_numpy()[:, None] != rep)
                        links[dim][0] += near.sum(axis=0)
                        links[dim][1] += (near & (rows["component"].to_numpy()[:, None] == c)).sum(axis=0)
        for dim, (n, m) in links.items():
            yield pd.DataFrame({"rep": shared.value[dim][1], "links": n, "found": m})[n > 0]

    return joined.mapInPandas(run, "rep bigint, links bigint, found bigint").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).toPandas()


def near_duplicates(vectors: DataFrame, limit: float = 0.98, k: int = 6, widest: int = 48, leaf: int = 64, trees: int = 2, descents: int = 2, target: float = 0.99, max_rounds: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept, saturated, recall for every row of (vec_id, embedding, label).

    Lists have k entries; saturated ones double with each step, up to ``widest``.
    """
    whole = dict(vectors.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("bigint") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter(can_link())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = small(written(classes.groupBy("label").agg(F.count("*").alias("of_label")), "labels"), 200_000)
    reps = written(classes.join(sizes, "label"), "reps")
    discard(classes)
    largest, n = reps.agg(F.max("of_label"), F.count("*")).first()
    trees = max(trees, trees_for(largest or 0, leaf, limit, target))
    others = max(2, -(-trees // 3))  # trees of the audit
    graph: DataFrame | None = None
    links: DataFrame | None = None
    wide, recall = k, 0.0
    for step in range(max_rounds):
        used: list[DataFrame | None] = [links]
        for at in range(trees + descents):
            seed = 1000 * step + at
            met = written(_start(reps, seed, leaf, k, wide, limit) if at < trees else _descend(graph, reps, k, wide, limit, seed), "met")
            span, new = met.filter("span").select("src", "dst"), met.filter("not span").drop("span")
            links = span if links is None else links.unionByName(span)
            graph = new if graph is None else graph.unionByName(new)
            used.append(met)
            if at >= trees - 1:
                wide = min(widest, 2 * wide)
                graph = written(_best(graph, k, wide, limit), "graph")
                used.append(graph)
        links = written(links.distinct(), "spans")
        comp = written(components(links, "src", "dst"), "components")
        discard(*used[:-1])  # all but the last graph
        if n <= _ASKED:
            recall = _audit(reps, comp, limit, _ASKED)
        else:
            caught = [written(_start(reps, 1000 * step + 500 + at, leaf, k, wide, limit), "caught") for at in range(others)]
            every = reduce(DataFrame.unionByName, caught)
            recall = _recaptured(reps, comp, every.filter(~F.col("span") & (F.col("sim") >= limit)).drop("span"), others, leaf)
            if recall < 1:  # what the audit has caught is kept
                more = written(links.unionByName(every.filter("span").select("src", "dst")).distinct(), "spans")
                discard(links, comp)
                links, comp = more, written(components(more, "src", "dst"), "components")
            discard(*caught)
        if recall is not None and recall >= target:
            break
        discard(comp)
    else:
        comp, recall = written(components(_exact(reps, limit), "src", "dst"), "components"), 1.0
    discard(links)
    full = graph.groupBy("src").agg((F.min("sim") >= limit).alias("low"), F.count("*").alias("m")).select(F.col("src").alias("rep"), (F.col("low") & (F.col("m") >= k)).alias("saturated"))
    members = reps.join(comp, reps["rep"] == comp["node"]).select("component", "rep", "weight", "embedding")
    count = _counts(members, limit)
    known = reps.drop("dim", "of_label").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(count, "rep", "left").join(full, "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("saturated", F.lit(False)).alias("saturated"))
    of = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id", "saturated")
    rest = rows.filter(~can_link()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(False).alias("saturated"))
    return of.unionByName(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "saturated", F.lit(recall).alias("recall"))
