"""The call and import graph: definitions, references, enclosing symbols, call expansion and impact.

Joins of lines with symbols have the file as equi-key and the interval as residual. Where many lines ask for the
same place (a hot symbol, repeated references) places are made distinct first, and the best symbol of each is a
partial aggregation, not a window over the joined rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import qualified_name

MAX_CALLERS, MAX_IMPACTED, MAX_PULLED_IN, EXPANDED_RESULTS = 8, 10, 2, 3
NOT_SYMBOLS = ("module", "general")


def symbols(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("chunk_type").isin(*NOT_SYMBOLS))


def find_definitions(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(symbol) of the form name or Parent::name -> the chunks that define them."""
    parts = F.split("symbol", "::")
    w = wanted.select("symbol", F.element_at(parts, -1).alias("want_name"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::")).alias("want_parent")).distinct()
    c = symbols(chunks)
    hit = (c["name"] == w["want_name"]) & (w["want_parent"].isNull() | (c["parent"] == w["want_parent"]))
    return c.join(w, hit).select("symbol", "id", "file_path", "name", "parent", "chunk_type", "start_line", "end_line")


def find_references(refs: DataFrame, wanted: DataFrame, calls_only: bool = False) -> DataFrame:
    """wanted(symbol) -> references to its last segment."""
    w = wanted.select("symbol", F.element_at(F.split("symbol", "::"), -1).alias("symbol_name")).distinct()
    r = refs.where("kind = 'call'") if calls_only else refs
    return r.join(w, "symbol_name").select("symbol", "file_path", "line", "kind")


def enclosing(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """places(file_path, line, ...) plus symbol and symbol_id: the smallest chunk that holds the line (ties: smaller id), null if none. Columns of these names are replaced."""
    places = places.drop("symbol", "symbol_id")
    distinct = places.select("file_path", "line").where("file_path is not null and line is not null").distinct()
    c = symbols(chunks).select(F.col("file_path").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("cid"), qualified_name(F.col("parent"), F.col("name")).alias("q"))
    held = distinct.join(c, (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("s"), F.col("e")))
    best = held.groupBy("file_path", "line").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), "cid", "q")).alias("b"))
    return places.join(best, ["file_path", "line"], "left").select(places["*"], F.col("b.q").alias("symbol"), F.col("b.cid").alias("symbol_id"))


def chunk_at_line(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """Like enclosing, over all chunks: places plus chunk_id."""
    distinct = places.select("file_path", "line").where("file_path is not null and line is not null").distinct()
    c = chunks.select(F.col("file_path").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("cid"))
    held = distinct.join(c, (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("s"), F.col("e")))
    best = held.groupBy("file_path", "line").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), "cid")).alias("b"))
    return places.join(best, ["file_path", "line"], "left").select(places["*"], F.col("b.cid").alias("chunk_id"))


def symbols_in_range(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranges(range_id, file_path, start_line, end_line) -> (range_id, symbol_id, name, symbol): the symbols each overlaps."""
    c = symbols(chunks).select(F.col("file_path").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("symbol_id"), "name", qualified_name(F.col("parent"), F.col("name")).alias("symbol"))
    hit = (F.col("file_path") == F.col("f")) & (F.col("s") <= F.col("end_line")) & (F.col("e") >= F.col("start_line"))
    return ranges.join(c, hit).select("range_id", "symbol_id", "name", "symbol", F.col("s").alias("symbol_start"))


def called_in_range(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    """(range_id, symbol_name, first_line): the distinct symbols called in each range."""
    r = refs.where("kind = 'call'").groupBy("file_path", "symbol_name", "line").count().select(F.col("file_path").alias("f"), "symbol_name", "line")
    hit = (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return ranges.join(r, hit).groupBy("range_id", "symbol_name").agg(F.min("line").alias("first_line"))


def definitions_called_by(results: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """results(query_id, rank, id, file_path, start_line, end_line) -> (query_id, id, place): definitions the first results call.

    Of the EXPANDED_RESULTS best results of a query the called symbols' definitions that are no results
    themselves, at most MAX_PULLED_IN, in the order of result, first call and id.
    """
    top = results.where(F.col("rank") <= EXPANDED_RESULTS).withColumn("range_id", F.struct("query_id", "rank"))
    called = called_in_range(top, refs)
    defs = symbols(chunks).select(F.col("name").alias("symbol_name"), F.col("id").alias("def_id"))
    found = called.join(defs, "symbol_name").select(F.col("range_id.query_id").alias("query_id"), F.col("def_id").alias("id"), F.col("range_id.rank").alias("rank"), "first_line")
    new = found.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = new.groupBy("query_id", "id").agg(F.min(F.struct("rank", "first_line")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.first_line", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_PULLED_IN).select("query_id", "id", "place")


def callers_of(names: DataFrame, refs: DataFrame, chunks: DataFrame, limit: int = MAX_CALLERS) -> DataFrame:
    """names(symbol_id, name, file_path) -> (symbol_id, file_path, line, caller, place): calls from other files, the first `limit`."""
    n = names.select(F.col("symbol_id").alias("asked"), F.col("name").alias("symbol_name"), F.col("file_path").alias("own"))
    calls = refs.where("kind = 'call'").join(n, "symbol_name").where(F.col("file_path") != F.col("own"))
    w = Window.partitionBy("asked").orderBy("file_path", "line")
    first = calls.select("asked", "file_path", "line").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return enclosing(first, chunks).select(F.col("asked").alias("symbol_id"), "file_path", "line", F.col("symbol").alias("caller"), "place")


def impacted_callers(hunks: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """hunks(diff_id, hunk_no, file_path, new_start, new_count) -> (diff_id, symbol, file_path, line, caller, place).

    The changed symbols (a deletion counts as one line) that are called elsewhere, the first MAX_IMPACTED of a
    diff in the order of hunks and lines, with their first callers.
    """
    ranges = hunks.select(
        F.struct("diff_id", "hunk_no").alias("range_id"), "file_path", F.col("new_start").alias("start_line"), (F.col("new_start") + F.greatest("new_count", F.lit(1)) - 1).alias("end_line")
    )
    changed = symbols_in_range(ranges, chunks).join(ranges.select("range_id", "file_path"), "range_id")
    per = changed.groupBy(F.col("range_id.diff_id").alias("diff_id"), "symbol", "name", "file_path").agg(F.min(F.struct(F.col("range_id.hunk_no").alias("h"), "symbol_start", "symbol_id")).alias("at"))
    once = per.groupBy("diff_id", "symbol").agg(F.min(F.struct("at", "name", "file_path")).alias("m")).select("diff_id", "symbol", F.col("m.at").alias("at"), F.col("m.name").alias("name"), F.col("m.file_path").alias("file_path"))
    calls = callers_of(once.select(F.struct("diff_id", "symbol").alias("symbol_id"), "name", "file_path"), refs, chunks)
    called = once.join(calls.select(F.col("symbol_id.diff_id").alias("diff_id"), F.col("symbol_id.symbol").alias("symbol")).distinct(), ["diff_id", "symbol"], "left_semi")
    w = Window.partitionBy("diff_id").orderBy("at.h", "at.symbol_start", "at.symbol_id", "symbol")
    kept = called.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MAX_IMPACTED).select("diff_id", "symbol")
    c = calls.select(F.col("symbol_id.diff_id").alias("diff_id"), F.col("symbol_id.symbol").alias("symbol"), "file_path", "line", "caller", "place")
    return c.join(kept, ["diff_id", "symbol"])


def without_changed_code(hits: DataFrame, hunks: DataFrame) -> DataFrame:
    """hits(file_path, start_line, end_line, ...) that overlap no hunk, on its old or its new side."""
    h = hunks.select(F.col("file_path").alias("hf"), "old_start", (F.col("old_start") + F.greatest("old_count", F.lit(1)) - 1).alias("old_end"), "new_start", (F.col("new_start") + F.greatest("new_count", F.lit(1)) - 1).alias("new_end"))
    old = (F.col("start_line") <= F.col("old_end")) & (F.col("end_line") >= F.col("old_start"))
    new = (F.col("start_line") <= F.col("new_end")) & (F.col("end_line") >= F.col("new_start"))
    return hits.join(h, (F.col("file_path") == F.col("hf")) & (old | new), "left_anti")


def file_lengths(chunks: DataFrame) -> DataFrame:
    """(file_path, last_line): the last line any chunk of a file reaches."""
    return chunks.groupBy("file_path").agg(F.max("end_line").alias("last_line"))
