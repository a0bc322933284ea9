"""Scoring, fusing, merging and re-ordering ranked results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TEST_PENALTY, is_test_file, parse_ranking
from quarry.functions.vectors import clamped_score, dot, norm

FUSION = 60
MAX_SUPPORTING, MAX_RELATED = 2, 4
#: Queries compared with all vectors at once; more go in further passes.
QUERY_BLOCK = 2000


def score_all(vectors: DataFrame, query: list[float] | Column) -> DataFrame:
    """vectors(id, file_path, embedding) -> (id, score): cosine with the query, clamped to 0..1, less for test files.

    Null vectors and those of length zero are left out; one with other dimensions than the query's is an error.
    """
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    cosine = dot(F.col("embedding"), q) / (norm(F.col("embedding")) * norm(q))
    penalty = F.when(is_test_file(F.col("file_path")), TEST_PENALTY).otherwise(1.0)
    fits = F.when(F.col("embedding").isNull() | (F.size("embedding") == F.size(q)), F.lit(True)).otherwise(F.raise_error(F.lit("the index holds vectors with other dimensions than the question's")))
    usable = (norm(F.col("embedding")) > 0) & fits
    return vectors.where(usable).select("id", clamped_score(cosine, penalty).alias("score")).where("not isnan(score)")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score), ties to the smaller id: a bounded sort of every partition, then of those."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def block_top_k(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int) -> DataFrame:
    """queries(query_id, embedding) against vectors(id, file_path, embedding) -> (query_id, id, score, rank).

    Queries are held in blocks of QUERY_BLOCK; each block passes once over all vectors as a matrix product and
    every task keeps only its k best per query, so k rows per query and task are shuffled.
    """
    spark = vectors.sparkSession
    good = lambda c: (F.size(c) == dimensions) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0)
    rows = queries.where(good("embedding")).select("query_id", "embedding").orderBy("query_id").toLocalIterator(prefetchPartitions=False)
    base = vectors.where(good("embedding")).select("id", "embedding", F.when(is_test_file(F.col("file_path")), TEST_PENALTY).otherwise(1.0).alias("penalty"))
    out = None
    done = False
    while not done:
        block = [(r.query_id, r.embedding) for _, r in zip(range(QUERY_BLOCK), rows)]
        done = len(block) < QUERY_BLOCK
        if not block and out is not None:
            break
        ids = [i for i, _ in block]
        q = np.array([e for _, e in block], dtype=np.float64).reshape(-1, dimensions)
        shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True) if len(block) else q))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            held = [pd.DataFrame({"q": [], "id": [], "score": []})] * 0
            for f in frames:
                if not len(f) or not len(ids):
                    continue
                x = np.stack(f.embedding.to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                s = np.clip(q @ x.T, 0, 1) * f.penalty.to_numpy()
                v = f.id.to_numpy()
                order = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, :k]
                held.append(pd.DataFrame({"q": np.repeat(np.arange(len(ids)), order.shape[1]), "id": v[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
                if len(held) > 8:
                    held = [pd.concat(held).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)]
            if held:
                t = pd.concat(held).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
                yield pd.DataFrame({"query_id": [ids[int(i)] for i in t.q], "id": t.id.astype("int64"), "score": t.score})

        part = base.mapInPandas(best, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], limit: int) -> DataFrame:
    """rankings of (query_id, id, rank), best first -> (query_id, id, score, rank): reciprocal rank fusion.

    Equal scores keep the order in which the first ranking, then the next, found them.
    """
    parts = [r.select("query_id", "id", "rank", F.lit(k).alias("list")) for k, r in enumerate(rankings)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def merge_workspace(results: DataFrame, limit: int) -> DataFrame:
    """results(query_id, project, id, score, found_via_calls): all projects in one ranking, supporting definitions behind.

    Matches by score, the first `limit`; then at most MAX_SUPPORTING definitions found through calls. Ties by
    project and id.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "project", "id")

    def first(rows: DataFrame, n: int) -> DataFrame:
        # a constant limit: every task keeps no more than n rows a query before the shuffle
        return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

    via = F.coalesce("found_via_calls", F.lit(False))
    kept = first(results.where(~via), limit).unionByName(first(results.where(via), MAX_SUPPORTING))
    order = Window.partitionBy("query_id").orderBy("found_via_calls", "place")
    return kept.withColumn("rank", F.row_number().over(order)).drop("place")


def merge_related(hits: DataFrame, limit: int = MAX_RELATED) -> DataFrame:
    """hits(diff_id, file_path, start_line, end_line, score) of several hunks: one row per place at its best score, the best `limit`."""
    best = hits.groupBy("diff_id", "file_path", "start_line", "end_line").agg(F.max("score").alias("score"))
    w = Window.partitionBy("diff_id").orderBy(F.desc("score"), "file_path", "start_line", "end_line")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def apply_rerank(results: DataFrame, replies: DataFrame, limit: int) -> DataFrame:
    """results(query_id, id, rank), replies(query_id, reply) -> new ranks: the mentioned first, the rest as they were.

    A query without a reply keeps its order.
    """
    sizes = results.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    said = replies.join(sizes, "query_id").select("query_id", F.posexplode(parse_ranking(F.col("reply"), F.col("n"))).alias("said", "old"))
    joined = results.join(said.withColumnRenamed("old", "rank"), ["query_id", "rank"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("said").asc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= limit).select("query_id", "id", F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank"))


def candidate_count(limit: int, rerank: bool) -> int:
    """How many results to fetch before re-ordering."""
    return min(3 * limit, 15) if rerank else limit


def reciprocal_rank(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mean reciprocal rank of results(query_id, id, rank) against relevant(query_id, id): one row (queries, mrr)."""
    asked = relevant.select("query_id").distinct()
    first = results.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return asked.join(first, "query_id", "left").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
