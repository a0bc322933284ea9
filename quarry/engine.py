"""The engine as one object: index a tree, search it, look symbols up, review a diff."""

from __future__ import annotations

import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.embed import Embedder, Generator, HashingEmbedder, embed_chunks
from quarry.functions.text import call_site_text, citation_marks, stored_path
from quarry.operators import citations, diff, graph, plan, prompts, ranking, search
from quarry.operators.parsing import chunks_of, parse_files, references_of
from quarry.sources.walker import Options, source_files
from quarry.store import Index

MAX_HUNKS, HITS_A_HUNK = 20, 6


class Engine:
    """Without a generator everything but answers, re-ordering and explanations works."""

    def __init__(self, spark: SparkSession, index: Index, embedder: Embedder | None = None, config: Config | None = None, generator: Generator | None = None):
        self.spark, self.index, self.embedder, self.config, self.generator = spark, index, embedder or HashingEmbedder(), config or Config(), generator

    def index_tree(self, root: str, options: Options | None = None, force: bool = False) -> dict:
        """Indexes what is new or changed below root; the counts of the plan, the skipped and the chunks that failed."""
        if self.index.rebuild_reason(self.embedder.name, force):
            self.index.reset(self.embedder.name)
        scanned = source_files(self.spark, root, options).cache()
        try:
            current = scanned.where("skip_reason is null")
            steps = plan.plan_index(current.select(F.col("relative_path").alias("path"), "content_hash"), self.index.table("files")).cache()
            counts = plan.plan_counts(steps).first().asDict()
            counts["skipped"] = scanned.where("skip_reason is not null").count()
            counts["failed_chunks"] = 0
            if counts["removed"]:
                self.index.remove(steps.where("status = 'removed'").select("path"))
            if counts["new"] + counts["changed"]:
                todo = current.join(plan.files_to_index(steps).withColumnRenamed("path", "relative_path"), "relative_path")
                parsed = parse_files(todo).cache()
                done = embed_chunks(chunks_of(parsed), self.embedder, self.config.model.parallelism if self.embedder.name != "hashing" else None).cache()
                failed = done.where("error is not null").select(F.col("file_path").alias("path")).distinct().withColumn("bad", F.lit(True))
                counts["failed_chunks"] = done.where("error is not null").count()
                hashes = todo.select(F.col("relative_path").alias("path"), "content_hash").join(failed, "path", "left").select("path", F.when(F.col("bad").isNull(), F.col("content_hash")).alias("content_hash"))
                self.index.replace_files(done.where("error is null").drop("error"), references_of(parsed), hashes)
                done.unpersist()
                parsed.unpersist()
            counts["untracked"] = self.index.delete_untracked()
            steps.unpersist()
            return counts
        finally:
            scanned.unpersist()

    def search(self, question: str, limit: int | None = None, stem: bool = True) -> DataFrame:
        """The hits of a question with their places and texts, in the order of rank.

        With re-ordering on and a generator, more candidates are fetched and its order of them decides.
        """
        limit = limit or self.config.search.top_k
        rerank = self.config.search.rerank and self.generator is not None
        q = self.spark.createDataFrame([(0, question, self.embedder.embed_query(question))], "query_id long, text string, embedding array<float>")
        chunks = self.index.table("chunks")
        kept = self.index.keyword_index() if stem else None
        hits = search.hybrid_search(chunks, self.index.table("refs"), q, ranking.candidate_count(limit, rerank), self.embedder.dimensions, stem, kept)
        if rerank:
            hits = self._reordered(hits, chunks, q, limit)
        hits = search.matched_keywords(search.low_confidence(hits, self.config.search.similarity_threshold), chunks, q)
        return F.broadcast(hits).join(chunks.drop("embedding"), "id").orderBy("rank")  # limit + 2 rows

    def _reordered(self, hits: DataFrame, chunks: DataFrame, q: DataFrame, limit: int) -> DataFrame:
        """The matches in the generator's order, the first `limit`, then the supporting definitions; unchanged if it fails."""
        found = hits.where("not found_via_calls")
        asked = prompts.rerank_prompt(found, chunks, q).first()
        try:
            reply = self.generator.generate(asked.prompt) if asked else ""
        except OSError:
            reply = ""
        replies = self.spark.createDataFrame([(0, reply)], "query_id long, reply string")
        order = ranking.apply_rerank(found, replies, limit)
        best = found.withColumnRenamed("rank", "old_rank").join(order, ["query_id", "id", "old_rank"]).drop("old_rank")
        return best.select(hits.columns).unionByName(hits.where("found_via_calls"))

    def answer(self, question: str, session: str | None = None, limit: int | None = None) -> dict:
        """Answers from the index: searches, prompts the generator, checks its citations and records the turn.

        In a session the question is first rewritten so that it stands alone. Without hits, or if the generator
        fails, the turn is recorded without an answer.
        """
        if self.generator is None:
            raise ValueError("answers need a model server")
        turns = self.index.table("turns")
        earlier = [(r.question, r.answer) for r in turns.where((F.col("session_id") == session) & F.col("answer").isNotNull()).orderBy(F.desc("id")).limit(prompts.HISTORY_TURNS).collect()][::-1] if session else []
        asked = prompts.rewritten_question(self.generator.generate(prompts.follow_up_prompt(question, earlier)), question) if earlier else question
        hits = self.search(asked, limit)
        rows = hits.collect()
        found = self.spark.createDataFrame([(0, r.id, r.rank, r.score) for r in rows], "query_id long, id long, rank int, score double")
        chunks = self.index.table("chunks")
        context = prompts.context_blocks(found, chunks).first()
        text, failure = None, None
        if rows:
            try:
                text = self.generator.generate(prompts.answer_prompt(asked, context.context, earlier)).strip() or None
            except OSError as e:
                failure = str(e)
        sources = citations.collect_citations(found, chunks).first() if rows else None
        last = turns.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        row = (last + 1, session or f"s{int(time.time() * 1000)}", now, question, text, sources.citations if sources else "[]")
        self.index.record_turns(self.spark.createDataFrame([row], "id long, session_id string, asked_at string, question string, answer string, citations string"))
        wrong = [f"{r.path}:{r.line}" for r in self.check_answer(text).collect()] if text else []
        return {"question": asked, "answer": text, "failure": failure, "unverified": wrong, "low_confidence": bool(rows) and rows[0].low_confidence, "sources": [(r.file_path, r.start_line, r.end_line, round(r.score, 2)) for r in rows]}

    def definitions(self, symbol: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(symbol,)], "symbol string")
        chunks = self.index.table("chunks")
        return graph.find_definitions(chunks, wanted).join(chunks.select("id", "content"), "id").orderBy("file_path", "start_line")

    def references(self, symbol: str, calls_only: bool = False) -> DataFrame:
        wanted = self.spark.createDataFrame([(symbol,)], "symbol string")
        found = graph.find_references(self.index.table("refs"), wanted, calls_only)
        return graph.enclosing(found.drop("symbol"), self.index.table("chunks")).orderBy("file_path", "line")

    def explain(self, path: str, line: int | None = None) -> DataFrame:
        """The chunk at a line, or a file's chunks in order."""
        chunks = self.index.table("chunks").where(F.col("file_path") == path).drop("embedding")
        if line is None:
            return chunks.orderBy("start_line", "id")
        held = chunks.where(F.lit(line).between(F.col("start_line"), F.col("end_line")))
        return held.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(1)

    def stored_path(self, typed: str) -> str:
        """A path as the index stores it, from one typed anywhere below the project."""
        root = str(self.index.meta("project_root") or "")
        full = Path(typed).resolve() if Path(typed).is_absolute() else None
        if full and root and full.is_relative_to(root):
            return full.relative_to(root).as_posix()
        return self.spark.createDataFrame([(typed,)], "p string").select(stored_path(F.col("p"))).first()[0]

    def explanation(self, path: str, line: int | None = None) -> dict:
        """The code at a place with its callers and what it calls, and what the generator says of it."""
        path = self.stored_path(path)
        found = self.explain(path, line).collect()
        if not found:
            return {}
        chunks, refs = self.index.table("chunks"), self.index.table("refs")
        named = [r for r in found if r.chunk_type not in ("module", "general")]
        asked = self.spark.createDataFrame([(r.id, r.name, r.file_path) for r in named], "symbol_id long, name string, file_path string")
        calls = graph.callers_of(asked, refs, chunks).orderBy("symbol_id", "place").select(call_site_text(F.col("file_path"), F.col("line"), F.col("caller")).alias("t"))
        callers = [r.t for r in calls.collect()]
        ranges = self.spark.createDataFrame([(r.id, r.file_path, r.start_line, r.end_line) for r in found], "range_id long, file_path string, start_line int, end_line int")
        called = [r.symbol_name for r in graph.called_in_range(ranges, refs).groupBy("symbol_name").agg(F.min("first_line").alias("l")).orderBy("l", "symbol_name").collect()]
        code = "\n".join(r.content for r in found)
        prompt = prompts.explain_prompt(f"{path}:{found[0].start_line}-{found[-1].end_line}", code, callers, called)
        return {"path": path, "chunks": [(r.name, r.start_line, r.end_line) for r in found], "callers": callers, "calls": called, "prompt": prompt, "explanation": self.generator.generate(prompt) if self.generator else None}

    def check_answer(self, answer: str) -> DataFrame:
        a = self.spark.createDataFrame([(0, answer)], "id long, answer string")
        return citations.verify(a, self.index.table("chunks")).where("not verified")

    def review(self, text: str, prefix: str = "") -> dict:
        """A diff's impacted callers, related code and prompt, with the generator's review if there is one.

        prefix: the indexed folder below the repository; files outside are shown but not looked up. A renamed file
        is looked up under its old name too.
        """
        files = diff.parse_diff(text)
        inside = [(f, p) for f in files for name in dict.fromkeys((f.path, f.renamed_from)) if name and (p := diff.to_index_path(name, prefix)) is not None]
        rows = [(0, n, p, *h[:4], h[4]) for n, (f, p) in enumerate(inside) for h in f.hunks]
        hunks = self.spark.createDataFrame([(0, k, p, a, b, c, d, t) for k, (_, _, p, a, b, c, d, t) in enumerate(rows)], "diff_id long, hunk_no int, file_path string, old_start int, old_count int, new_start int, new_count int, text string")
        chunks, refs = self.index.table("chunks"), self.index.table("refs")
        impacted = graph.impacted_callers(hunks, chunks, refs).orderBy("symbol", "place").collect()
        asked = [(k, f"File: {p}\n{t}") for k, (_, _, p, _, _, _, _, t) in enumerate(rows[:MAX_HUNKS])]
        vectors = self.embedder.embed([t for _, t in asked]) if asked else []
        related: list = []
        if asked:
            q = self.spark.createDataFrame([(k, t, v) for (k, t), v in zip(asked, vectors)], "query_id long, text string, embedding array<float>")
            hits = ranking.block_top_k(q, chunks, HITS_A_HUNK, self.embedder.dimensions).where(F.col("score") >= self.config.search.similarity_threshold)
            placed = hits.join(chunks.select("id", "file_path", "start_line", "end_line"), "id").withColumn("diff_id", F.lit(0))
            best = ranking.merge_related(graph.without_changed_code(placed, hunks))
            related = best.join(chunks.select("file_path", "start_line", "end_line", "content"), ["file_path", "start_line", "end_line"]).orderBy("rank").collect()
        callers: dict[str, list[str]] = {}
        for r in impacted:
            callers.setdefault(r.symbol, []).append(f"{diff.to_diff_path(r.file_path, prefix)}:{r.line}" + (f" in {r.caller}" if r.caller else ""))
        shown, left_out = diff.render_diff(files)
        prompt = prompts.review_prompt(shown, left_out, [(diff.to_diff_path(r.file_path, prefix), r.start_line, r.end_line, r.content) for r in related], list(callers.items()))
        said = self.generator.generate(prompt) if self.generator else None
        return {"review": said, "impacted": callers, "related": [(diff.to_diff_path(r.file_path, prefix), r.start_line, r.end_line, r.score) for r in related], "omitted_hunks": left_out, "prompt": prompt}

    def stats(self) -> dict:
        return index_stats(self.index.table("chunks")).first().asDict()

    def status(self, root: str) -> dict:
        """stats with the model, the size on disk, the seconds since the last change and how the tree differs."""
        now = source_files(self.spark, root).where("skip_reason is null").select(F.col("relative_path").alias("path"), "content_hash")
        counts = plan.plan_counts(plan.plan_index(now, self.index.table("files"))).first().asDict()
        age = int(time.time() - float(self.index.manifest()["meta"]["updated_at"]))
        return self.stats() | {"model": self.index.meta("embedding_model"), "bytes": self.index.size_bytes(), "age_seconds": age} | counts


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, files, and the distinct extensions in order (null and empty paths count as no file)."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./\\]+)$", 1))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.array_join(F.array_sort(F.collect_set(F.when(F.length(ext) > 0, ext))), ",").alias("extensions"))


def file_chunks(chunks: DataFrame) -> DataFrame:
    """Every chunk's place in its file, by start line and id."""
    return chunks.select("id", "file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")).alias("place"))


def search_all(spark: SparkSession, engines: dict[str, Engine], question: str, limit: int) -> DataFrame:
    """One question against several projects, merged; paths carry their project's root."""
    every = None
    for project, e in engines.items():
        hits = e.search(question, limit).select(F.lit(0).cast("long").alias("query_id"), F.lit(project).alias("project"), "id", "score", "found_via_calls", F.concat_ws("/", F.lit(project), "file_path").alias("file_path"), "start_line", "end_line")
        every = hits if every is None else every.unionByName(hits)
    return ranking.merge_workspace(every, limit).orderBy("rank")


def check_across(engines: dict[str, Engine], answer: str) -> list[str]:
    """The marks of an answer over several projects that none of them holds; paths carry their project's root."""
    spark = next(iter(engines.values())).spark
    known = None
    for project, e in engines.items():
        part = graph.file_lengths(e.index.table("chunks")).select(F.concat_ws("/", F.lit(project), "file_path").alias("path"), "last_line")
        known = part if known is None else known.unionByName(part)
    marks = spark.createDataFrame([(answer,)], "a string").select(F.posexplode(citation_marks(F.col("a"))).alias("place", "c")).select("place", F.col("c.path").alias("path"), F.col("c.line").alias("line"))
    missing = marks.join(known, "path", "left").where(~F.coalesce(F.col("line") <= F.col("last_line"), F.lit(False)))
    return [f"{r.path}:{r.line}" for r in missing.orderBy("place").collect()]


def project_root(path: str | Path) -> str:
    return str(Path(path).resolve())
