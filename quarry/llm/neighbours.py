"""Problem 6: the most similar vectors for every vector, by NN-descent in Spark.

The first graph comes from vectors that share a random-projection code. Each round of descent then joins
neighbours of neighbours: every vector goes to a hub among its neighbours and their neighbours (the least of them under
a mixing that changes by round), so that vectors with common surroundings meet, and all that meet are compared exactly. Vectors are
brought together by sorting and cut into blocks of bounded size, so no code and no hub makes a large group, and no
pairs are listed but the k best of each vector. Rounds end when few neighbours change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.common import Stage, shuffle_partitions, stage_of

DIMENSIONS, K = 64, 5
#: Random-projection tables and bits of a code; vectors compared at once; neighbours kept in the graph.
TABLES, BITS, BLOCK, KEPT = 4, 40, 2048, 7
#: Rounds of descent at least and at most, and the share of changed neighbours below which they end.
LEAST_ROUNDS, ROUNDS, SETTLED = 3, 8, 0.01
_EMPTY = -1


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for an array of `dimensions` finite numbers, not all zero; false for null."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _prepared(vectors: DataFrame, dimensions: int, seed: int = 7) -> DataFrame:
    """(id, vec binary of doubles or floats, same two hashes of the direction, code0.. of each table) of the usable vectors."""
    planes = np.random.default_rng(seed).standard_normal((dimensions, TABLES * BITS)).astype(np.float32)
    weights = (1 << np.arange(BITS, dtype=np.int64))[::-1]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimensions)
            unit = flat / np.linalg.norm(flat.astype(np.float64), axis=1)[:, None]
            signs = (unit.astype(np.float32) @ planes > 0).reshape(len(flat), TABLES, BITS)
            keys = (signs * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), *(pa.array(keys[:, t]) for t in range(TABLES))],
                names=["id", "vec", *(f"code{t}" for t in range(TABLES))],
            )

    schema = "id long, vec binary, " + ", ".join(f"code{t} long" for t in range(TABLES))
    e = F.transform("embedding", lambda x: x.cast("float"))
    return vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), dimensions)).select("id", e.alias("embedding")).mapInArrow(codes, schema)


def _best(ids: np.ndarray, raw: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of a block its `kept` most similar others: ids and cosines (double); ties to the smaller id."""
    n = len(ids)
    x = raw.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x.astype(np.float32)
    take = min(kept + 4, n - 1)
    out_ids, out_sims = np.full((n, kept), _EMPTY, dtype=np.int64), np.full((n, kept), -2.0)
    if take <= 0:
        return out_ids, out_sims
    for a in range(0, n, 512):
        s = y[a : a + 512] @ y.T
        rows = np.arange(len(s))
        s[rows, rows + a] = -4
        top = np.argpartition(s, n - take, axis=1)[:, n - take :] if take < n else np.tile(np.arange(n), (len(s), 1))
        exact = np.einsum("ij,ikj->ik", x[a : a + 512], x[top])
        exact[top == (rows + a)[:, None]] = -4
        order = np.lexsort((ids[top], -exact), axis=1)[:, :kept]
        m = order.shape[1]
        out_ids[a : a + len(s), :m] = np.take_along_axis(ids[top], order, 1)
        out_sims[a : a + len(s), :m] = np.take_along_axis(exact, order, 1)
    out_ids[out_sims < -1.5] = _EMPTY
    return out_ids, out_sims


_LIST = "id long, nbrs array<long>, sims array<double>"


def _in_blocks(rows: DataFrame, key: str, block: int, dimensions: int, kept: int, parts: int) -> DataFrame:
    """(id, nbrs, sims): the best of each vector among those next to it in the order of `key`, in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            ids = t.column("id").to_numpy()
            raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dimensions)
            nbrs, sims = _best(ids, raw, kept)
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * kept)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(nbrs.ravel())), pa.ListArray.from_arrays(offsets, pa.array(sims.ravel()))], names=["id", "nbrs", "sims"]
            )

        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - count)
                held.append(part)
                count += part.num_rows
                b = b.slice(part.num_rows)
                if count == block:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    ordered = rows.select("id", "vec", key).repartitionByRange(parts, key, F.xxhash64("id")).sortWithinPartitions(key)
    return ordered.mapInArrow(compare, _LIST)


def _merged(lists: DataFrame, kept: int = KEPT) -> DataFrame:
    """One list of the `kept` best a vector of several (id, nbrs, sims, old); ties to the smaller id.

    `fresh` is the share of the K best that no list marked `old` had.
    """
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("nbrs").alias("n"))))
    best = lists.groupBy("id").agg(pairs.alias("p"), F.flatten(F.collect_list(F.when(F.col("old"), F.slice("nbrs", 1, K)))).alias("had"))
    p = F.slice(F.array_sort(F.array_distinct(F.filter("p", lambda x: x["n"] >= 0))), 1, kept)
    out = best.select("id", p.alias("p"), "had").select("id", F.transform("p", lambda x: x["n"]).alias("nbrs"), F.transform("p", lambda x: -x["s"]).alias("sims"), "had")
    return out.select("id", "nbrs", "sims", (F.size(F.array_except(F.slice("nbrs", 1, K), "had")) / K).alias("fresh"))


def build_graph(prepared: DataFrame, stage: Stage, dimensions: int = DIMENSIONS, block: int = BLOCK, rounds: int = ROUNDS, kept: int = KEPT) -> DataFrame:
    """The neighbour graph (id, nbrs, sims) of prepared distinct vectors by NN-descent, `kept` neighbours each."""
    # no more ranges than full blocks, so that few vectors all meet
    ranges = max(1, min(shuffle_partitions(prepared.sparkSession), math.ceil(prepared.count() / block)))
    parts: list[DataFrame] = []
    for t in range(TABLES):
        part = stage.write(_in_blocks(prepared, f"code{t}", block, dimensions, kept, ranges), f"table{t}")
        parts.append(part)
    graph = stage.write(_merged(reduce(DataFrame.unionByName, parts).withColumn("old", F.lit(False)), kept), "graph")
    stage.drop(*parts)
    for r in range(rounds):
        met = stage.write(_in_blocks(prepared.select("id", "vec").join(_hubs(graph, r), "id"), "hub", block, dimensions, kept, ranges), f"met{r}")
        after = stage.write(_merged(graph.drop("fresh").withColumn("old", F.lit(True)).unionByName(met.withColumn("old", F.lit(False))), kept), "graph")
        changed = after.agg(F.avg("fresh")).first()[0] or 0.0
        stage.drop(met, graph)
        graph = after
        if r + 1 >= LEAST_ROUNDS and changed < SETTLED:
            break
    return graph


def _hubs(graph: DataFrame, r: int) -> DataFrame:
    """(id, hub): of each vector the least, under a mixing that changes by round, of itself, its neighbours and their neighbours.

    Two vectors have the same hub as often as their surroundings agree. Of a neighbour only its own least is
    joined, so no list of neighbours of neighbours is made, and a vector goes to one hub however popular that is.
    """

    def mixed(x: Column) -> Column:
        return F.struct(F.xxhash64(x, F.lit(r)).alias("h"), x.alias("hub"))

    around = F.concat(F.array("id"), F.slice("nbrs", 1, K))
    least = graph.select("id", F.array_min(F.transform(around, mixed)).alias("least"), around.alias("around"))
    further = least.select("id", F.explode("around").alias("via")).join(least.select(F.col("id").alias("via"), "least"), "via")
    return further.groupBy("id").agg(F.min("least").alias("least")).select("id", "least.hub")


def nearest(vectors: DataFrame, k: int = K, dimensions: int = DIMENSIONS, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """vectors(id, embedding, ...) -> (id, other, cosine): the k most similar other rows of every usable row.

    Usable is an embedding of `dimensions` finite numbers, not all zero; others, nulls and null ids are left out.
    Cosines are computed in double, ties go to the smaller id. Rows with the same vector are one vector in the
    graph and rows of their own in the result: of a group of copies only the k + 1 smallest ids are ever another
    row's neighbours, so a hot group never multiplies. k is at most KEPT - 1. Fewer rows than k give fewer pairs.
    """
    stage = stage_of(vectors, "neighbours")
    prepared = stage.write(_prepared(vectors, dimensions), "vectors")
    distinct, copies = _distinct(prepared, stage)
    graph = build_graph(distinct, stage, dimensions, block, rounds)
    edges = graph.select(F.col("id").alias("rep"), F.explode(F.arrays_zip(F.slice("nbrs", 1, k).alias("n"), F.slice("sims", 1, k).alias("s"))).alias("e")).select(
        "rep", F.col("e.n").alias("other_rep"), F.col("e.s").alias("cosine")
    )
    return _with_copies(edges, copies, k)


def _distinct(prepared: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The prepared vectors without copies, and the copies as (id, rep), rep being the smallest id with that vector."""
    keyed = prepared.select("id", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g"))
    groups = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = stage.write(keyed.join(groups.drop("n"), ["h", "g"]).select("id", "rep"), "copies")
    return prepared.join(copies.where("id <> rep").select("id"), "id", "left_anti"), copies


def _with_copies(edges: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """edges(rep, other_rep, cosine) between distinct vectors -> (id, other, cosine): the k best rows of each row with that vector."""
    # a group's first k + 1 ids; the window's limit is applied before the shuffle, so a hot group never gathers
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    few = copies.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("few"))
    within = few.select("rep", F.col("rep").alias("other_rep"), F.lit(1.0).alias("cosine"))
    reached = edges.unionByName(within).join(few.withColumnRenamed("rep", "other_rep"), "other_rep", "left").select(
        "rep", F.explode(F.coalesce("few", F.array("other_rep"))).alias("other"), "cosine"
    )
    ranked = (
        reached.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("s"), F.col("other").alias("o")))).alias("best"))
        .select("rep", F.slice("best", 1, k + 1).alias("best"))
    )
    every = ranked.join(copies.withColumnRenamed("id", "row"), "rep", "left").select(F.coalesce("row", "rep").alias("id"), "best")
    mine = F.slice(F.filter("best", lambda x: x["o"] != F.col("id")), 1, k)
    return every.select("id", F.explode(mine).alias("b")).select("id", F.col("b.o").alias("other"), (-F.col("b.s")).alias("cosine"))


def similar_pairs(vectors: DataFrame, k: int = K) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other, once each."""
    return nearest(vectors, k).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


#: Greedy search: nodes every query starts from, and of each bucket it falls into, and candidates it keeps.
ENTRIES, NEAR_ENTRIES, BEAM = 128, 12, 64
#: Neighbours in a graph to search: enough to leave a tight cluster.
LINKS = 24


def greedy_search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int = K, dimensions: int = DIMENSIONS) -> DataFrame:
    """queries(id, embedding), vectors(id, embedding), graph(id, nbrs) -> (id, other, cosine): the k best by greedy graph search.

    All queries walk together: each keeps its BEAM best nodes, opens those not opened yet, and joins their
    neighbours, forwards and back (of the links back to a popular node LINKS, by hash), until none of a query's
    best k is unopened. Queries start from ENTRIES nodes of least hash, which every task holds, and from NEAR_ENTRIES nodes of each bucket they fall into. A query's own row is no answer; unusable vectors
    take no part.
    """
    stage = stage_of(vectors, "search")
    base = stage.write(vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), dimensions)).select(F.col("id").alias("node"), F.col("embedding").alias("v")), "base")
    links = graph.select(F.col("id").alias("a"), F.explode("nbrs").alias("b"))
    few = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("p", few).where(F.col("p") <= LINKS).drop("p")
    links = stage.write(links.unionByName(back).distinct(), "links")
    asked = stage.write(queries.where(F.col("id").isNotNull() & usable(F.col("embedding"), dimensions)).select("id", F.col("embedding").alias("q")), "asked")

    @F.pandas_udf("double")
    def cosine(q: pd.Series, v: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype="float64")
        x, y = np.stack(q.to_numpy()).astype(np.float64), np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(np.einsum("ij,ij->i", x, y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1))

    entries = base.join(graph.select(F.col("id").alias("node")), "node", "left_semi").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()
    nodes = np.array([r.node for r in entries], dtype=np.int64)
    points = np.array([r.v for r in entries], dtype=np.float64).reshape(-1, dimensions)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = np.array(f.q.tolist(), dtype=np.float64).reshape(-1, dimensions)
            s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ points.T
            yield pd.DataFrame({"id": np.repeat(f.id.to_numpy(), len(nodes)), "node": np.tile(nodes, len(f)), "s": s.ravel(), "opened": False})

    first = asked.mapInPandas(begin, "id long, node long, s double, opened boolean")
    # and from nodes that share the beginning of a code, a few of each bucket
    bits = max(1, math.ceil(math.log2(max(2, base.count()) / NEAR_ENTRIES)))
    near = _buckets(_prepared(vectors, dimensions), bits).withColumn("p", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("id")))).where(F.col("p") <= NEAR_ENTRIES)
    met = _buckets(_prepared(queries, dimensions), bits).join(near.select("bucket", F.col("id").alias("node")), "bucket").select("id", "node").distinct()
    near_first = met.join(base, "node").join(asked, "id").select("id", "node", cosine("q", "v").alias("s"), F.lit(False).alias("opened"))
    first = first.unionByName(near_first).groupBy("id", "node").agg(F.max("s").alias("s"), F.min("opened").alias("opened"))
    order = Window.partitionBy("id").orderBy(F.desc("s"), "node")
    beam = stage.write(first.withColumn("p", F.row_number().over(order)).where(F.col("p") <= BEAM), "beam")
    while True:
        opening = beam.where((F.col("p") <= k + 3) & ~F.col("opened"))
        if opening.isEmpty():
            break
        new = opening.select("id", F.col("node").alias("a")).join(links, "a").select("id", F.col("b").alias("node")).distinct()
        new = new.join(beam.select("id", "node"), ["id", "node"], "left_anti").join(base, "node").join(asked, "id")
        seen = beam.select("id", "node", "s", (F.col("opened") | (F.col("p") <= k + 3)).alias("opened"))
        both = seen.unionByName(new.select("id", "node", cosine("q", "v").alias("s"), F.lit(False).alias("opened")))
        after = stage.write(both.withColumn("p", F.row_number().over(order)).where(F.col("p") <= BEAM), "beam")
        stage.drop(beam)
        beam = after
    best = beam.where(F.col("id") != F.col("node")).withColumn("p", F.row_number().over(order)).where(F.col("p") <= k)
    return best.select("id", F.col("node").alias("other"), F.col("s").alias("cosine"))


def _buckets(prepared: DataFrame, bits: int) -> DataFrame:
    """(id, bucket): the beginnings of each table's code, told apart by table."""
    codes = F.array(*(F.xxhash64(F.lit(t), F.shiftright(f"code{t}", BITS - bits)) for t in range(TABLES)))
    return prepared.select("id", F.explode(codes).alias("bucket"))


def search_queries(vectors: DataFrame, k: int = K) -> DataFrame:
    """greedy_search for every row whose id is divisible by 100, against all rows: (id, other, cosine).

    The graph and the search know each vector once; its copies are answers and queries of their own.
    """
    stage = stage_of(vectors, "graph")
    prepared = stage.write(_prepared(vectors, DIMENSIONS), "vectors")
    distinct, copies = _distinct(prepared, stage)
    distinct = stage.write(distinct, "distinct")
    graph = build_graph(distinct, stage, kept=LINKS).select("id", "nbrs")
    query = (F.col("id") % 100) == 0
    reps = distinct.where(query).select("id").unionByName(copies.where(query).select(F.col("rep").alias("id"))).distinct()
    once = vectors.select("id", "embedding").join(distinct.select("id"), "id", "left_semi")
    found = greedy_search(once.join(reps, "id", "left_semi"), once, graph, k)
    return _with_copies(found.select(F.col("id").alias("rep"), F.col("other").alias("other_rep"), "cosine"), copies, k).where(query)
