"""Recorded questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.citations import stored_citations


def record_turn(turns: DataFrame, path: str) -> None:
    """Appends turns(id, session_id, asked_at, question, answer, citations) to the history."""
    turns.select("id", "session_id", "asked_at", "question", "answer", "citations").write.mode("append").parquet(path)


def recent_turns(turns: DataFrame, limit: int) -> DataFrame:
    """The newest turns by id, newest first: a bounded sort."""
    return turns.where("id is not null").orderBy(F.desc("id")).limit(limit)


def count_turns(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("turns"), F.count_if(F.col("answer").isNull()).alias("unanswered"), F.countDistinct("session_id").alias("sessions"))


def transcripts(turns: DataFrame, limit_a_session: int = 10_000) -> DataFrame:
    """(session_id, turns, transcript): each session as Markdown, oldest first.

    Unanswered questions say so; sources are listed with their scores; cut citations count as none. A session of
    more than limit_a_session turns comes in parts of that size, so no row grows without bound.
    """
    from pyspark.sql import Window

    source = F.transform(
        F.coalesce(stored_citations(F.col("citations")), F.array().cast("array<struct<file_path:string,start_line:int,end_line:int,score:double>>")),
        lambda c: F.format_string("- `%s:%d-%d` (score %.2f)\n", c["file_path"], c["start_line"], c["end_line"], c["score"]),
    )
    sources = F.when(F.size(source) > 0, F.concat(F.lit("\n**Sources:**\n"), F.array_join(source, ""))).otherwise("\n**Sources:** none\n")
    answer = F.coalesce(F.col("answer"), F.lit("_No answer was recorded for this question._"))
    text = F.concat(F.lit("\n### "), F.coalesce("question", F.lit("")), F.lit("\n*"), F.coalesce("asked_at", F.lit("")), F.lit("*\n\n"), answer, F.lit("\n"), sources)
    t = turns.where("id is not null and session_id is not null").select(F.trim("session_id").alias("session_id"), "id", text.alias("t"))
    numbered = t.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1) / limit_a_session).cast("int"))
    joined = numbered.groupBy("session_id", "part").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "").alias("body"))
    return joined.select("session_id", "part", "turns", F.concat(F.lit("\n---\n\n## Session "), "session_id", F.lit("\n"), "body").alias("transcript"))
