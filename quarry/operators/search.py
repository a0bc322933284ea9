"""Hybrid retrieval: vectors and keywords, fused, and extended through the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.bm25 import bm25
from quarry.operators.graph import definitions_called_by
from quarry.operators.ranking import block_top_k, fuse

CANDIDATES = 50


def hybrid_search(chunks: DataFrame, refs: DataFrame | None, queries: DataFrame, limit: int = 5, dimensions: int = 64, stem: bool = True, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """queries(query_id, text, embedding) -> (query_id, id, rank, score, found_via_calls).

    The CANDIDATES nearest chunks and the CANDIDATES best by keywords are fused, the first `limit` kept; with
    refs at most two definitions called by the best three follow. Texts are fetched by the caller for these rows
    only. `kept` is a keyword index made before. A query without an embedding is answered by keywords alone and the other way round.
    """
    near = block_top_k(queries, chunks, CANDIDATES, dimensions)
    words = bm25(chunks, queries, CANDIDATES, stem, kept)
    fused = fuse([near, words], limit).withColumn("found_via_calls", F.lit(False))
    if refs is None:
        return fused
    places = chunks.select("id", "file_path", "start_line", "end_line")
    pulled = definitions_called_by(fused.join(places, "id"), chunks, refs)
    last = fused.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = pulled.join(last, "query_id").select("query_id", "id", F.lit(0.0).alias("score"), (F.col("last") + F.col("place")).cast("int").alias("rank"), F.lit(True).alias("found_via_calls"))
    return fused.unionByName(more)


def matched_keywords(results: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """results plus which of the question's words stand in each hit's name, path or content."""
    from quarry.functions.text import keyword_terms

    q = queries.select("query_id", F.transform(keyword_terms(F.col("text")), F.lower).alias("asked"))
    c = chunks.select("id", F.lower(F.concat_ws("\n", "name", "file_path", "content")).alias("hay"))
    return results.join(q, "query_id").join(c, "id").select(results["*"], F.array_distinct(F.filter("asked", lambda w: F.contains(F.col("hay"), w))).alias("matched_keywords"))


def low_confidence(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Marks a query's results whose best score is under the threshold; never drops any."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return results.withColumn("low_confidence", best < threshold)
