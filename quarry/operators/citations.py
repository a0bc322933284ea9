"""Checking an answer's citations against the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import citation_marks
from quarry.operators.graph import file_lengths

STORED = "array<struct<file_path:string,start_line:int,end_line:int,score:double>>"


def extract(answers: DataFrame) -> DataFrame:
    """answers(id, answer) -> (id, place, path, line): the distinct path:line marks in order."""
    return answers.select("id", F.posexplode(citation_marks(F.col("answer"))).alias("place", "c")).select("id", "place", F.col("c.path").alias("path"), F.col("c.line").alias("line"))


def verify(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """extract plus `verified`: the file is indexed and has the line."""
    known = file_lengths(chunks).select(F.col("file_path").alias("path"), "last_line")
    return extract(answers).join(known, "path", "left").select("id", "place", "path", "line", F.coalesce(F.col("line") <= F.col("last_line"), F.lit(False)).alias("verified"))


def stored_citations(column: Column) -> Column:
    """A turn's stored citations as structs; null where the JSON is cut."""
    return F.from_json(column, STORED)


def collect_citations(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """results(query_id, id, rank, score) -> (query_id, citations): what a turn records, in the order of rank."""
    c = results.join(chunks.select("id", "file_path", "start_line", "end_line"), "id")
    one = F.struct("rank", F.struct("file_path", "start_line", "end_line", F.round("score", 2).alias("score")).alias("c"))
    return c.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"])).alias("citations"))
