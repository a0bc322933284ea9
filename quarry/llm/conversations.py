"""Problem 1: conversations from message rows.

The turns of a session are linked to their predecessors (a forest of parent pointers); pointer jumping finds for
every turn its root and its depth in as many joins as the longest conversation's length has binary digits. Orphans
(a parent that is no row) and cycles never reach a root and are reported as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.common import Stage, shuffle_partitions, stage_of
from quarry.llm.replies import INVISIBLE, has_text, instant, question_key, real_reply

MAX_JUMPS = 48


def pointer_jump(links: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Roots and depths of a forest. links(id long unique, parent long null) -> (id, root, depth, state).

    state: `rooted` (depth 1 is a root), `orphan` (the chain ends at an id that is no row; root is that id) or
    `cycle` (no end; root and depth null). Every round doubles the distance each pointer spans, and only rows
    that have not arrived take part, so the rounds are log2 of the longest chain. Null ids are dropped; an empty
    table gives none. A row is its own ancestor's only child in a chain, so no join key repeats there; in a tree
    a hot parent only repeats on the streamed side, where AQE splits it.
    """
    own = stage or stage_of(links, "jump")
    base = links.where(F.col("id").isNotNull()).select("id", "parent")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    start = (
        base.join(known, "parent", "left")
        .select(
            "id",
            F.when(F.col("parent").isNull(), F.col("id")).when(F.col("known").isNull(), F.col("parent")).alias("root"),
            F.when(F.col("parent").isNull() | F.col("known").isNull(), F.lit(1)).cast("long").alias("depth"),
            (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"),
            F.when(F.col("known"), F.col("parent")).alias("up"),
            F.lit(1).cast("long").alias("span"),
        )
    )
    state = own.write(start, "forest")
    # only rows that have not arrived are written anew; the others stay in the table of the round they arrived in
    settled, waiting = [state.where(F.col("root").isNotNull())], state.where(F.col("root").isNull())
    total = None
    for jump in range(MAX_JUMPS):
        if waiting.isEmpty():
            break
        if total is None:
            total = state.count()
        if (1 << jump) > total:
            break  # longer than any path without a repeat: what is left are cycles
        via = reduce(DataFrame.unionByName, [*settled, waiting]).select(
            F.col("id").alias("up"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("orphan").alias("o"),
            F.col("up").alias("u"), F.col("span").alias("s"),
        )
        moved = own.write(waiting.join(via, "up").select(
            "id",
            F.col("r").alias("root"),
            (F.col("span") + F.col("d")).alias("depth"),
            F.coalesce(F.col("o"), F.lit(False)).alias("orphan"),
            F.when(F.col("r").isNull(), F.col("u")).alias("up"),
            (F.col("span") + F.col("s")).alias("span"),
        ), "forest")
        settled.append(moved.where(F.col("root").isNotNull()))
        waiting = moved.where(F.col("root").isNull())
    state = reduce(DataFrame.unionByName, [*settled, waiting])
    return state.select(
        "id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"),
        F.when(F.col("root").isNull(), "cycle").when(F.col("orphan"), "orphan").otherwise("rooted").alias("state"),
    )


def canonical_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: (session_id, at, turn_id, good).

    Rows of a session with the same instant and the same question up to white space are one turn with the
    smallest id, good if a question shows and any of them has a real reply. Rows without an id or with a blank
    session_id are dropped; an instant that cannot be read makes the turn not good. Aggregated before the shuffle,
    so a session with a third of all rows is no hot key.
    """
    t = turns.select(
        "id",
        F.regexp_replace("session_id", r"^[\s ​]+|[\s ​]+$", "").alias("session_id"),
        instant(F.col("asked_at")).alias("at"),
        question_key(F.col("question")).alias("q"),
        has_text(F.col("question")).alias("asked"),
        real_reply(F.col("answer")).alias("replied"),
    ).where(F.col("id").isNotNull() & (F.length("session_id") > 0))
    return (
        t.groupBy("session_id", "at", F.xxhash64("q").alias("qh"), F.length("q").alias("ql"))
        .agg(F.min("id").alias("turn_id"), F.max("replied").alias("replied"), F.max("asked").alias("asked"))
        .select("session_id", "at", "turn_id", (F.col("asked") & F.col("replied") & F.col("at").isNotNull()).alias("good"))
    )


def predecessor_links(turns: DataFrame) -> DataFrame:
    """Each turn's predecessor in its session: adds `parent` (null for the first).

    Rows are range-partitioned by (session, instant, id), so a session of any size spreads over many tasks; the
    last row of each earlier range stands in for what precedes a range, and only those few rows are exchanged.
    """
    spark = turns.sparkSession
    n = shuffle_partitions(spark)
    parts = turns.repartitionByRange(n, "session_id", "at", "turn_id").withColumn("part", F.spark_partition_id())
    parts = stage_of(turns, "turns").write(parts, "ranges")
    order = Window.partitionBy("part", "session_id").orderBy("at", "turn_id")
    inner = parts.withColumn("parent", F.lag("turn_id").over(order))
    # of every (range, session) the last turn: as many rows as sessions, and one more for each range that cuts one
    ends = parts.groupBy("part", "session_id").agg(F.max_by("turn_id", F.struct("at", "turn_id")).alias("last"))
    before = ends.select(
        "part", "session_id", F.lag("last").over(Window.partitionBy("session_id").orderBy("part")).alias("before")
    ).where(F.col("before").isNotNull())
    first = inner.where(F.col("parent").isNull()).select("part", "session_id", "turn_id")
    across = first.join(before, ["part", "session_id"]).select("turn_id", "before")
    return inner.join(across, "turn_id", "left").select(
        "session_id", "at", "turn_id", "good", F.coalesce("parent", "before").alias("parent")
    )


def conversations(turns: DataFrame) -> DataFrame:
    """Messages of the kept sessions: (session_id, msg_no, role, turn_id, depth).

    turns(id, session_id, asked_at, question, answer, ...); other columns are ignored. A session is dropped if a
    turn has no visible question, no real reply or no readable instant, or if its chain is broken. Empty input
    gives no rows.
    """
    stage = stage_of(turns, "conversations")
    linked = stage.write(predecessor_links(canonical_turns(turns)), "linked")
    forest = pointer_jump(linked.select(F.col("turn_id").alias("id"), "parent"), stage)
    placed = linked.join(forest.withColumnRenamed("id", "turn_id"), "turn_id").select(
        "session_id", "turn_id", "root", "depth", (F.col("good") & (F.col("state") == "rooted")).alias("good")
    )
    # a path is named by its root: unlike padded session names, roots are of one form
    kept = placed.groupBy("root").agg(F.min("good").alias("whole")).where("whole").select("root")
    return (
        placed.join(kept, "root", "left_semi")
        .select("session_id", "turn_id", "depth", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
        .select(
            "session_id",
            (F.col("depth") * 2 - F.when(F.col("role") == "user", 1).otherwise(0)).cast("int").alias("msg_no"),
            "role", "turn_id",
        )
    )


def session_report(turns: DataFrame) -> DataFrame:
    """How many sessions are kept and why others are not: (outcome, sessions, turns)."""
    t = canonical_turns(turns).groupBy("session_id").agg(F.count("*").alias("n"), F.min("good").alias("whole"), F.max("good").alias("any"))
    outcome = F.when(F.col("whole"), "kept").when(F.col("any"), "incomplete").otherwise("without_reply")
    return t.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("sessions"), F.sum("n").alias("turns"))
