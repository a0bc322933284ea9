"""The engine's own queries over the supplied tables, each whole, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.common import Stage, read_table
from quarry.engine import file_chunks, index_stats
from quarry.functions import text as T
from quarry.functions.hashing import fnv1a64
from quarry.functions.vectors import norm, normalise
from quarry.operators import bm25, chunking, citations, diff, graph, history, parsing, plan, prompts, ranking, scan, search
from quarry.streaming.watch import bursts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    """chunks with paths in one notation."""
    return read_table(spark, base, "chunks").withColumn("file_path", T.stored_path(F.col("file_path")))


_CHUNKS = r"""chunks AS (SELECT id, project, regexp_replace(replace(trim(file_path), chr(92), '/'), '^(\./)+', '') AS file_path, language, name, chunk_type, parent, content, start_line, end_line, embedding FROM main.chunks)"""
_WITH = f"WITH {_CHUNKS}"
_PAIRS = ", ".join(f"('{e}', '{lang}')" for e, lang in [*T.EXTENSION_LANGUAGES.items(), ("md", "md")])
_INDEXABLE = r"""lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) IN (SELECT e FROM (VALUES """ + _PAIRS + r""") v(e, l)) AND regexp_extract(relative_path, '([^/]*)$', 1) NOT IN ('package-lock.json', 'npm-shrinkwrap.json', 'pnpm-lock.yaml') AND NOT contains(regexp_extract(relative_path, '([^/]*)$', 1), '.min.')"""
_SMALL_LIMIT = 4096
# DuckDB: the lines of a text as in functions.text.lines
_LINES = r"CASE WHEN length(content) = 0 THEN [] ELSE string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') END"


@query(rf"""SELECT lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) AS extension, any_value(v.l) AS file_language, count(*) AS files
FROM source_files JOIN (VALUES {_PAIRS}) v(e, l) ON v.e = lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) WHERE {_INDEXABLE} GROUP BY 1""")
def scan_extension_histogram(spark: SparkSession, base: str) -> DataFrame:
    return scan.extension_histogram(read_table(spark, base, "source_files"))


_SECRETS = " ".join(f"WHEN regexp_matches(content, '{p}') THEN 'looks like it holds {w}'" for w, p in scan.SECRET_CONTENT.items())


@query(rf"""SELECT relative_path, CASE WHEN content IS NULL THEN 'unreadable' WHEN regexp_matches(regexp_extract(relative_path, '([^/]*)$', 1), '{scan.SECRET_NAME}') THEN 'looks like it holds credentials'
WHEN strlen(content) > {_SMALL_LIMIT} THEN concat(strlen(content) // 1024, ' KB, over the {_SMALL_LIMIT // 1024} KB limit') {_SECRETS} END AS skip_reason FROM source_files WHERE {_INDEXABLE}""")
def scan_skip_reasons(spark: SparkSession, base: str) -> DataFrame:
    return scan.scan(read_table(spark, base, "source_files"), _SMALL_LIMIT).select("relative_path", "skip_reason")


@query("SELECT relative_path, md5(content) AS digest, strlen(content) AS bytes FROM source_files")
def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "source_files").select("relative_path", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


@query(r"""WITH p AS (SELECT DISTINCT project FROM source_files WHERE project IS NOT NULL)
SELECT project, printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(project) + 1), lambda i: ascii(project[i])::UHUGEINT)), lambda h, b: (xor(h::BIT, b::BIT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS key FROM p""")
def project_keys(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "source_files").where("project is not null").select("project").distinct().select("project", fnv1a64(F.col("project")).alias("key"))


@query(rf"""WITH f AS (SELECT relative_path, {_LINES} AS ls FROM source_files), w AS (SELECT relative_path, ls, unnest(range(0, greatest(0, len(ls) - 6) + 1, 25)) AS s FROM f WHERE len(ls) > 0)
SELECT relative_path AS file_path, s + 1 AS start_line, least(s + 30, len(ls)) AS end_line, concat('lines-', s + 1, '-', least(s + 30, len(ls))) AS name, md5(array_to_string(ls[s + 1 : s + 30], chr(10))) AS digest FROM w""")
def line_window_chunks(spark: SparkSession, base: str) -> DataFrame:
    w = chunking.line_windows(read_table(spark, base, "source_files"))
    return w.select("file_path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "name", F.md5("content").alias("digest"))


@query(_WITH + r""" SELECT id, md5(concat('File: ', file_path, chr(10), 'Language: ', language, chr(10), 'Symbol: ', name, ' (', chunk_type, ')', chr(10), 'Parent: ', coalesce(parent, '<module>'), chr(10), 'Lines: ', start_line, '-', end_line, chr(10), chr(10), content)) AS digest FROM chunks""")
def embed_texts(spark: SparkSession, base: str) -> DataFrame:
    c = _chunks(spark, base)
    return c.select("id", F.md5(T.embed_text(*(F.col(x) for x in ("file_path", "language", "name", "chunk_type", "parent", "start_line", "end_line", "content")))).alias("digest"))


@query(_WITH + r""" SELECT id, CASE WHEN parent IS NULL THEN name ELSE concat(parent, '::', name) END AS qualified, contains(file_path, '/test') OR contains(file_path, 'test_') OR starts_with(file_path, 'test') AS is_test FROM chunks""")
def qualified_names(spark: SparkSession, base: str) -> DataFrame:
    return _chunks(spark, base).select("id", T.qualified_name(F.col("parent"), F.col("name")).alias("qualified"), T.is_test_file(F.col("file_path")).alias("is_test"))


_PLAN = """n AS (SELECT relative_path AS path, max(content_hash) AS h FROM source_files WHERE relative_path IS NOT NULL GROUP BY 1), o AS (SELECT path, max(content_hash) AS oh FROM files WHERE path IS NOT NULL GROUP BY 1),
plan AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN n.h = o.oh THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL OUTER JOIN o ON n.path = o.path)"""


def _plan(spark: SparkSession, base: str) -> DataFrame:
    return plan.plan_index(read_table(spark, base, "source_files").select(F.col("relative_path").alias("path"), "content_hash"), read_table(spark, base, "files"))


@query(f"WITH {_PLAN} SELECT path, status FROM plan")
def plan_index_diff(spark: SparkSession, base: str) -> DataFrame:
    return _plan(spark, base)


@query(f"""WITH {_PLAN} SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status <> 'unchanged') > 0 AS stale FROM plan""")
def plan_counts(spark: SparkSession, base: str) -> DataFrame:
    return plan.plan_counts(_plan(spark, base))


@query(rf"""WITH {_CHUNKS}, {_PLAN}, f AS (SELECT relative_path, {_LINES} AS ls FROM source_files JOIN plan ON relative_path = path AND status IN ('new', 'changed')),
w AS (SELECT relative_path, ls, unnest(range(0, greatest(0, len(ls) - 6) + 1, 25)) AS s FROM f WHERE len(ls) > 0),
fresh AS (SELECT relative_path AS file_path, concat('lines-', s + 1, '-', least(s + 30, len(ls))) AS name, CAST(s + 1 AS INT) AS start_line, CAST(least(s + 30, len(ls)) AS INT) AS end_line FROM w)
SELECT file_path, name, start_line, end_line FROM chunks WHERE file_path NOT IN (SELECT file_path FROM fresh) UNION ALL SELECT file_path, name, start_line, end_line FROM fresh""")
def replace_file_chunks(spark: SparkSession, base: str) -> DataFrame:
    todo = plan.files_to_index(_plan(spark, base)).withColumnRenamed("path", "relative_path")
    fresh = chunking.line_windows(read_table(spark, base, "source_files").join(todo, "relative_path"))
    columns = ["file_path", "name", "start_line", "end_line"]
    return plan.replace_rows(_chunks(spark, base).select(*columns), fresh.select(*columns))


@query(f"WITH {_CHUNKS} SELECT id, file_path FROM chunks WHERE file_path IN (SELECT path FROM files)")
def delete_untracked(spark: SparkSession, base: str) -> DataFrame:
    return plan.tracked_only(_chunks(spark, base).select("id", "file_path"), read_table(spark, base, "files"))


@query(f"WITH {_CHUNKS}, {_PLAN} SELECT id, file_path FROM chunks WHERE file_path NOT IN (SELECT path FROM plan WHERE status = 'removed')")
def remove_gone_files(spark: SparkSession, base: str) -> DataFrame:
    return plan.remove_files(_chunks(spark, base).select("id", "file_path"), _plan(spark, base).where("status = 'removed'"))


@query(r"""WITH f AS (SELECT max_by(parse_failed, parsed_at) AS failed, max(parsed_at) AS last_run, count(*) AS runs, relative_path FROM parsed_files WHERE relative_path IS NOT NULL AND parse_failed IS NOT NULL GROUP BY relative_path)
SELECT count(*) AS files, sum(runs)::BIGINT AS runs, max(last_run) AS last_run FROM f""")
def parse_log_summary(spark: SparkSession, base: str) -> DataFrame:
    p = read_table(spark, base, "parsed_files").where("relative_path is not null and parse_failed is not null")
    f = p.groupBy("relative_path").agg(F.count("*").alias("runs"), F.max("parsed_at").alias("last_run"))
    return f.agg(F.count("*").alias("files"), F.sum("runs").alias("runs"), F.max("last_run").alias("last_run"))


@query(r"""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings""")
def vector_lengths(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"))


@query(r"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, unnest(range(1, len(e) + 1)) AS place, round((unnest(e) / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS component FROM v WHERE list_dot_product(e, e) > 0""")
def vector_normalised(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings").where(norm(F.col("embedding")) > 0)
    parts = e.select("vec_id", F.posexplode(normalise(F.col("embedding").cast("array<double>"))).alias("place", "component"))
    return parts.select("vec_id", (F.col("place") + 1).cast("long").alias("place"), (F.round(F.col("component").cast("double"), 4) + F.lit(0.0)).alias("component"))


_V = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0)"""


@query(f"""WITH {_V}, q AS (SELECT * FROM u WHERE vec_id = (SELECT min(vec_id) FROM u)) SELECT u.vec_id AS id, round(least(greatest(list_dot_product(u.e, q.e) / (u.n * q.n), 0), 1), 6) AS score FROM u, q""")
def vector_scores(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings").where(norm(F.col("embedding")) > 0)
    first = e.orderBy("vec_id").limit(1).collect()
    rows = e.select(F.col("vec_id").alias("id"), F.lit("src/x").alias("file_path"), "embedding")
    return ranking.score_all(rows, list(first[0].embedding) if first else [0.0]).select("id", F.round("score", 6).alias("score"))


def _topk_sql(penalty: str) -> str:
    return f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, u.vec_id AS id, least(greatest(list_dot_product(u.e, q.e) / (u.n * q.n), 0), 1) * {penalty} AS score FROM u JOIN u q ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def _topk(spark: SparkSession, base: str, path) -> DataFrame:
    e = read_table(spark, base, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ranking.block_top_k(q, e.select(F.col("vec_id").alias("id"), path.alias("file_path"), "embedding"), 5, 64)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_topk_sql("1.0"))
def vector_topk(spark: SparkSession, base: str) -> DataFrame:
    return _topk(spark, base, F.lit("src/a.py"))


@query(_topk_sql("CASE WHEN u.vec_id % 3 = 0 THEN 0.8 ELSE 1.0 END"))
def vector_topk_penalised(spark: SparkSession, base: str) -> DataFrame:
    return _topk(spark, base, F.when(F.col("vec_id") % 3 == 0, "src/test_a.py").otherwise("src/a.py"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = rf"list_filter(string_split_regex({{}}, '[^\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_STOP}))"


@query(rf"""SELECT id, CASE WHEN len({_TERMS.format('question').replace('{{', '{').replace('}}', '}')}) > 0 THEN array_to_string(list_transform({_TERMS.format('question').replace('{{', '{').replace('}}', '}')}, lambda w: concat('"', w, '"')), ' OR ') END AS keyword_query FROM turns WHERE question IS NOT NULL""")
def keyword_queries(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "turns").where("question is not null").select("id", T.keyword_query(F.col("question")).alias("keyword_query"))


def _subject_queries(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "subjects").select(F.col("subject_id").cast("long").alias("query_id"), F.col("description").alias("text"))


_TOK = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"
_BM25 = rf"""{_CHUNKS}, t AS (SELECT id, {_TOK.format('name')} AS a, {_TOK.format('content')} AS b, {_TOK.format('file_path')} AS c FROM chunks),
dl AS (SELECT id, len(a) + len(b) + len(c) AS n FROM t), st AS (SELECT count(*) AS total, avg(n) AS avgdl FROM dl),
q AS (SELECT subject_id::BIGINT AS query_id, unnest({_TERMS.format('description').replace('{{', '{').replace('}}', '}')}) AS w FROM subjects),
asked AS (SELECT query_id, lower(w) AS term, count(*) AS mentions FROM q GROUP BY 1, 2),
p AS (SELECT id, unnest(a) AS term, 10.0 AS wt FROM t UNION ALL SELECT id, unnest(b), 1.0 FROM t UNION ALL SELECT id, unnest(c), 2.0 FROM t),
f AS (SELECT term, id, sum(wt)::DOUBLE AS f FROM p WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), np AS (SELECT term, count(*) AS n_p FROM f GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((total - n_p + 0.5) / (n_p + 0.5)) > 0 THEN ln((total - n_p + 0.5) / (n_p + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM np, st),
sc AS (SELECT query_id, id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avgdl)) * mentions) AS score FROM f JOIN idf USING (term) JOIN dl USING (id) JOIN asked USING (term) GROUP BY 1, 2),
words AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"""


_KEPT: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _keyword_index(spark: SparkSession, base: str, stem: bool) -> tuple[DataFrame, DataFrame]:
    """Postings sorted by term, and lengths, written once to the shared folder for each session and set of tables."""
    key = (spark.sparkContext.applicationId, base, stem)
    if key not in _KEPT:
        posts, lengths = bm25.postings(_chunks(spark, base), stem)
        stage = Stage(spark, "keywords")
        _KEPT[key] = stage.write(posts.repartitionByRange("term").sortWithinPartitions("term"), "postings"), stage.write(lengths, "lengths")
    return _KEPT[key]


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM words WHERE rank <= 50")
def bm25_topk_nostem(spark: SparkSession, base: str) -> DataFrame:
    found = bm25.bm25(None, _subject_queries(spark, base), 50, stem=False, kept=_keyword_index(spark, base, False))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    return bm25.bm25(None, _subject_queries(spark, base), 50, kept=_keyword_index(spark, base, True)).select("query_id", "id", F.round("score", 6).alias("score"))


_GOOD = "len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_HYBRID = rf"""{_BM25}, ok AS (SELECT id, file_path, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE embedding IS NOT NULL AND {_GOOD}),
un AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n, CASE WHEN contains(file_path, '/test') OR contains(file_path, 'test_') OR starts_with(file_path, 'test') THEN 0.8 ELSE 1.0 END AS pen FROM ok),
nth AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM un), qv AS (SELECT subject_id::BIGINT AS query_id, e, n FROM subjects JOIN nth ON k = subject_id),
vs AS (SELECT qv.query_id, un.id, least(greatest(list_dot_product(un.e, qv.e) / (un.n * qv.n), 0), 1) * un.pen AS s FROM un, qv),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM vs),
every AS (SELECT query_id, id, rank, 0 AS l FROM near WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1 FROM words WHERE rank <= 50),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS seen FROM every GROUP BY 1, 2),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, id) AS rank FROM fused)"""


def _hybrid_queries(spark: SparkSession, base: str) -> DataFrame:
    """The subjects as questions; the k-th takes the vector of the k-th usable chunk."""
    from pyspark.sql import Window

    e = F.col("embedding")
    usable = _chunks(spark, base).where((F.size(e) == 64) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)).select("id", "embedding")
    n = read_table(spark, base, "subjects").agg(F.coalesce(F.max("subject_id"), F.lit(1))).first()[0]
    first = usable.orderBy("id").limit(int(n)).withColumn("query_id", F.row_number().over(Window.orderBy("id")).cast("long"))
    return _subject_queries(spark, base).join(first.select("query_id", "embedding"), "query_id")


def _hybrid(spark: SparkSession, base: str, refs: DataFrame | None = None, limit: int = 10) -> DataFrame:
    return search.hybrid_search(_chunks(spark, base), refs, _hybrid_queries(spark, base), limit, stem=False, kept=_keyword_index(spark, base, False))


@query(f"WITH {_HYBRID} SELECT query_id, id, round(score, 8) AS score, rank FROM hits WHERE rank <= 10")
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    return _hybrid(spark, base).select("query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_HYBRID}, h AS (SELECT query_id, id, score, rank FROM hits WHERE rank <= 10), top AS (SELECT h.query_id, h.rank, c.file_path, c.start_line, c.end_line FROM h JOIN chunks c ON c.id = h.id WHERE h.rank <= 3),
called AS (SELECT query_id, rank, symbol_name, min(line) AS fl FROM top JOIN main.refs r ON r.file_path = top.file_path AND r.kind = 'call' AND r.line BETWEEN start_line AND end_line GROUP BY 1, 2, 3),
d AS (SELECT query_id, c.id, min(rank * 1000000::BIGINT + fl) AS pl FROM called JOIN chunks c ON c.name = symbol_name AND c.chunk_type NOT IN ('module', 'general') WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = called.query_id AND h.id = c.id) GROUP BY 1, 2),
o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pl, id) AS place FROM d), l AS (SELECT query_id, max(rank) AS last FROM h GROUP BY 1)
SELECT query_id, id, round(score, 8) AS score, rank, false AS found_via_calls FROM h UNION ALL SELECT o.query_id, o.id, 0.0, last + place, true FROM o JOIN l ON l.query_id = o.query_id WHERE place <= 2""")
def hybrid_search_expanded(spark: SparkSession, base: str) -> DataFrame:
    found = _hybrid(spark, base, read_table(spark, base, "refs"))
    return found.select("query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"), "found_via_calls")


@query(f"WITH {_CHUNKS}, s AS (SELECT DISTINCT symbol_name AS symbol FROM refs) SELECT symbol, id, file_path, start_line FROM s JOIN chunks ON name = symbol AND chunk_type NOT IN ('module', 'general')")
def find_definitions(spark: SparkSession, base: str) -> DataFrame:
    wanted = read_table(spark, base, "refs").select(F.col("symbol_name").alias("symbol")).distinct()
    return graph.find_definitions(_chunks(spark, base), wanted).select("symbol", "id", "file_path", "start_line")


def _asked_symbols(spark: SparkSession, base: str) -> DataFrame:
    c = graph.symbols(_chunks(spark, base)).where("parent is not null")
    return c.select(F.concat_ws("::", "parent", "name").alias("symbol")).distinct()


_ASKED = "a AS (SELECT DISTINCT concat(parent, '::', name) AS symbol, name FROM chunks WHERE parent IS NOT NULL AND chunk_type NOT IN ('module', 'general'))"


@query(f"WITH {_CHUNKS}, {_ASKED} SELECT symbol, file_path, line, kind, count(*) AS n FROM a JOIN main.refs r ON r.symbol_name = a.name GROUP BY ALL")
def find_references(spark: SparkSession, base: str) -> DataFrame:
    return graph.find_references(read_table(spark, base, "refs"), _asked_symbols(spark, base)).groupBy("symbol", "file_path", "line", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_CHUNKS}, {_ASKED} SELECT symbol, count(*) AS calls FROM a JOIN main.refs r ON r.symbol_name = a.name WHERE kind = 'call' GROUP BY 1")
def callers_only(spark: SparkSession, base: str) -> DataFrame:
    return graph.find_references(read_table(spark, base, "refs"), _asked_symbols(spark, base), calls_only=True).groupBy("symbol").agg(F.count("*").alias("calls"))


_HELD = "p AS (SELECT DISTINCT file_path, line FROM refs), h AS (SELECT p.file_path, p.line, c.id, CASE WHEN parent IS NULL THEN name ELSE concat(parent, '::', name) END AS q, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY c.end_line - c.start_line, c.id) AS r FROM p JOIN chunks c ON c.file_path = p.file_path AND p.line BETWEEN c.start_line AND c.end_line {})"


@query(f"WITH {_CHUNKS}, {_HELD.format('AND c.chunk_type NOT IN (' + chr(39) + 'module' + chr(39) + ', ' + chr(39) + 'general' + chr(39) + ')')} SELECT x.symbol_name, x.file_path, x.line, x.kind, h.q AS symbol, h.id AS symbol_id FROM main.refs x LEFT JOIN h ON h.file_path = x.file_path AND h.line = x.line AND h.r = 1")
def enclosing_symbol(spark: SparkSession, base: str) -> DataFrame:
    return graph.enclosing(read_table(spark, base, "refs"), _chunks(spark, base)).select("symbol_name", "file_path", "line", "kind", "symbol", "symbol_id")


@query(f"WITH {_CHUNKS}, {_HELD.format('')} SELECT p.file_path, p.line, h.id AS chunk_id FROM p LEFT JOIN h ON h.file_path = p.file_path AND h.line = p.line AND h.r = 1")
def chunk_at_line(spark: SparkSession, base: str) -> DataFrame:
    places = read_table(spark, base, "refs").select("file_path", "line").distinct()
    return graph.chunk_at_line(places, _chunks(spark, base))


def _ranges(spark: SparkSession, base: str) -> DataFrame:
    return _chunks(spark, base).where(F.col("chunk_type").isin("class", "struct", "impl", "type")).select(F.col("id").alias("range_id"), "file_path", "start_line", "end_line")


_RANGES = "g AS (SELECT id AS range_id, file_path, start_line, end_line FROM chunks WHERE chunk_type IN ('class', 'struct', 'impl', 'type'))"


@query(f"WITH {_CHUNKS}, {_RANGES} SELECT range_id, c.id AS symbol_id, name FROM g JOIN chunks c ON c.file_path = g.file_path AND c.start_line <= g.end_line AND c.end_line >= g.start_line AND c.chunk_type NOT IN ('module', 'general')")
def symbols_in_range(spark: SparkSession, base: str) -> DataFrame:
    return graph.symbols_in_range(_ranges(spark, base), _chunks(spark, base)).select("range_id", "symbol_id", "name")


_FUNCTIONS = "g AS (SELECT id AS range_id, file_path, start_line, end_line FROM chunks WHERE chunk_type IN ('function', 'method', 'arrow_function'))"


@query(f"WITH {_CHUNKS}, {_FUNCTIONS} SELECT range_id, symbol_name, min(line) AS first_line FROM g JOIN main.refs r ON r.file_path = g.file_path AND r.line BETWEEN g.start_line AND g.end_line AND r.kind = 'call' GROUP BY 1, 2")
def called_symbols_in_range(spark: SparkSession, base: str) -> DataFrame:
    ranges = _chunks(spark, base).where(F.col("chunk_type").isin("function", "method", "arrow_function")).select(F.col("id").alias("range_id"), "file_path", "start_line", "end_line")
    return graph.called_in_range(ranges, read_table(spark, base, "refs"))


# every file's first three functions as the results of a question about it
_RESULTS = """f AS (SELECT id, file_path, start_line, end_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS rank FROM chunks WHERE chunk_type IN ('function', 'method', 'arrow_function')), res AS (SELECT * FROM f WHERE rank <= 3)"""


@query(rf"""WITH {_CHUNKS}, {_RESULTS}, called AS (SELECT res.file_path AS q, rank, symbol_name, min(line) AS fl FROM res JOIN main.refs r ON r.file_path = res.file_path AND r.kind = 'call' AND r.line BETWEEN start_line AND end_line GROUP BY 1, 2, 3),
d AS (SELECT q, c.id, min(rank * 1000000::BIGINT + fl) AS pl FROM called JOIN chunks c ON c.name = symbol_name AND c.chunk_type NOT IN ('module', 'general') WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.file_path = q AND res.id = c.id) GROUP BY 1, 2),
o AS (SELECT q AS query_id, id, row_number() OVER (PARTITION BY q ORDER BY pl, id) AS place FROM d) SELECT * FROM o WHERE place <= 2""")
def call_expansion(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy("start_line", "id")
    f = _chunks(spark, base).where(F.col("chunk_type").isin("function", "method", "arrow_function")).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    found = graph.definitions_called_by(f.select(F.col("file_path").alias("query_id"), "rank", "id", "file_path", "start_line", "end_line"), _chunks(spark, base), read_table(spark, base, "refs"))
    return found.select("query_id", "id", F.col("place").cast("long").alias("place"))


def _hunks(spark: SparkSession, base: str) -> DataFrame:
    """Changes made up from arithmetic on the paths: one hunk in every file, a diff a project."""
    f = read_table(spark, base, "source_files")
    n = F.length("relative_path")
    return f.select(F.col("project").alias("diff_id"), n.alias("hunk_no"), F.col("relative_path").alias("file_path"), (n % 40 + 1).alias("old_start"), (n % 7).alias("old_count"), (n % 40 + 1).alias("new_start"), (n % 9).alias("new_count"))


_HUNKS = "hk AS (SELECT project AS diff_id, length(relative_path) AS hunk_no, relative_path AS file_path, length(relative_path) % 40 + 1 AS old_start, length(relative_path) % 7 AS old_count, length(relative_path) % 40 + 1 AS new_start, length(relative_path) % 9 AS new_count FROM source_files)"


@query(rf"""WITH {_CHUNKS}, {_HUNKS}, sy AS (SELECT *, CASE WHEN parent IS NULL THEN name ELSE concat(parent, '::', name) END AS symbol FROM chunks WHERE chunk_type NOT IN ('module', 'general')),
ch AS (SELECT diff_id, hunk_no, symbol, name, c.file_path, c.start_line AS ss, c.id FROM hk JOIN sy c ON c.file_path = hk.file_path AND c.start_line <= new_start + greatest(new_count, 1) - 1 AND c.end_line >= new_start),
per AS (SELECT diff_id, symbol, name, file_path, min((hunk_no, ss, id)) AS wh FROM ch GROUP BY 1, 2, 3, 4),
once AS (SELECT *, row_number() OVER (PARTITION BY diff_id, symbol ORDER BY wh, name, file_path) AS k FROM per QUALIFY k = 1),
ca AS (SELECT DISTINCT diff_id, symbol, r.file_path, r.line FROM once JOIN main.refs r ON r.symbol_name = once.name AND r.kind = 'call' AND r.file_path <> once.file_path),
pl AS (SELECT *, row_number() OVER (PARTITION BY diff_id, symbol ORDER BY file_path, line) AS place FROM ca QUALIFY place <= 8),
kp AS (SELECT diff_id, symbol, row_number() OVER (PARTITION BY diff_id ORDER BY wh, symbol) AS nth FROM once WHERE EXISTS (SELECT 1 FROM pl WHERE pl.diff_id = once.diff_id AND pl.symbol = once.symbol) QUALIFY nth <= 10)
SELECT pl.diff_id, pl.symbol, pl.file_path, pl.line, place FROM pl JOIN kp ON kp.diff_id = pl.diff_id AND kp.symbol = pl.symbol""")
def impacted_callers(spark: SparkSession, base: str) -> DataFrame:
    found = graph.impacted_callers(_hunks(spark, base), _chunks(spark, base), read_table(spark, base, "refs"))
    return found.select("diff_id", "symbol", "file_path", "line", F.col("place").cast("long").alias("place"))


@query(f"WITH {_CHUNKS}, {_HUNKS} SELECT id, file_path FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM hk WHERE hk.file_path = c.file_path AND ((c.start_line <= old_start + greatest(old_count, 1) - 1 AND c.end_line >= old_start) OR (c.start_line <= new_start + greatest(new_count, 1) - 1 AND c.end_line >= new_start)))")
def changed_code_exclusion(spark: SparkSession, base: str) -> DataFrame:
    return graph.without_changed_code(_chunks(spark, base), _hunks(spark, base)).select("id", "file_path")


@query(f"WITH {_CHUNKS} SELECT file_path, max(end_line) AS last_line FROM chunks GROUP BY 1")
def file_last_lines(spark: SparkSession, base: str) -> DataFrame:
    return graph.file_lengths(_chunks(spark, base))


@query(rf"WITH {_CHUNKS}, e AS (SELECT DISTINCT lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) AS x FROM chunks) SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT file_path) FROM chunks) AS files, (SELECT string_agg(x, ',' ORDER BY x) FROM e WHERE length(x) > 0) AS extensions")
def index_statistics(spark: SparkSession, base: str) -> DataFrame:
    return index_stats(_chunks(spark, base))


@query(f"WITH {_CHUNKS} SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM chunks")
def chunks_in_file_order(spark: SparkSession, base: str) -> DataFrame:
    return file_chunks(_chunks(spark, base)).select("id", "file_path", F.col("place").cast("long").alias("place"))


_MARKS = r"""m AS (SELECT id, unnest(list_transform(string_split_regex(coalesce(answer, ''), '[\s()\[\]{}<>,"''`]+'), lambda p: regexp_replace(p, '[.:;]+$', ''))) AS p FROM turns),
c AS (SELECT id, regexp_replace(regexp_extract(p, '^(.*):(\d+)(?:[-–]\d*)?$', 1), '^(\./)+', '') AS path, TRY_CAST(regexp_extract(p, '^(.*):(\d+)(?:[-–]\d*)?$', 2) AS INT) AS line FROM m WHERE regexp_matches(p, '^(.*):(\d+)(?:[-–]\d*)?$')),
cit AS (SELECT DISTINCT id, path, line FROM c WHERE contains(path, '.') AND NOT ends_with(path, ':') AND line IS NOT NULL)"""


@query(f"WITH {_MARKS} SELECT * FROM cit")
def citation_extract(spark: SparkSession, base: str) -> DataFrame:
    return citations.extract(read_table(spark, base, "turns")).select("id", "path", "line")


@query(f"WITH {_CHUNKS}, {_MARKS}, l AS (SELECT file_path, max(end_line) AS last_line FROM chunks GROUP BY 1) SELECT id, path, line, coalesce(line <= last_line, false) AS verified FROM cit LEFT JOIN l ON file_path = path")
def citation_verify(spark: SparkSession, base: str) -> DataFrame:
    return citations.verify(read_table(spark, base, "turns"), _chunks(spark, base)).select("id", "path", "line", "verified")


_REPLY = "concat('I would take [', {0} % 7 + 1, '], then ', {0} % 3 + 1, ', then 2 and 99.')"


@query(rf"""WITH {_HYBRID}, h AS (SELECT query_id, id, rank FROM hits WHERE rank <= 10), z AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1),
rp AS (SELECT query_id, list_distinct(list_filter([query_id % 7 + 1, query_id % 3 + 1, 2, 99], lambda x: x BETWEEN 1 AND n)) AS l, [query_id % 7 + 1, query_id % 3 + 1, 2, 99] AS o FROM z),
sd AS (SELECT query_id, old, list_position(o, old) AS said FROM (SELECT query_id, o, unnest(l) AS old FROM rp)),
nw AS (SELECT h.query_id, id, rank AS old_rank, row_number() OVER (PARTITION BY h.query_id ORDER BY said NULLS LAST, rank) AS rank FROM h LEFT JOIN sd ON sd.query_id = h.query_id AND old = rank) SELECT * FROM nw WHERE rank <= 5""")
def rerank_apply(spark: SparkSession, base: str) -> DataFrame:
    q = F.col("query_id")
    reply = F.concat(F.lit("I would take ["), (q % 7 + 1).cast("string"), F.lit("], then "), (q % 3 + 1).cast("string"), F.lit(", then 2 and 99."))
    replies = _subject_queries(spark, base).select("query_id", reply.alias("reply"))
    out = ranking.apply_rerank(_hybrid(spark, base).select("query_id", "id", "rank"), replies, 5)
    return out.select("query_id", "id", F.col("old_rank").cast("long").alias("old_rank"), F.col("rank").cast("long").alias("rank"))


_SCORED = "sc AS (SELECT id, project, 0::BIGINT AS query_id, (id * 7919 % 1000) / 1000.0::DOUBLE AS score, id % 11 = 0 AS via FROM main.chunks)"


@query(f"""WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY via ORDER BY score DESC, project, id) AS place FROM sc),
f AS (SELECT * FROM k WHERE place <= CASE WHEN via THEN 2 ELSE 20 END) SELECT id, project, score, row_number() OVER (ORDER BY via, place) AS rank FROM f""")
def workspace_merge(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "chunks").select("id", "project", F.lit(0).cast("long").alias("query_id"), ((F.col("id") * 7919 % 1000) / 1000.0).alias("score"), (F.col("id") % 11 == 0).alias("found_via_calls"))
    return ranking.merge_workspace(c, 20).select("id", "project", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_CHUNKS}, b AS (SELECT project AS diff_id, file_path, start_line, end_line, max((id * 7919 % 1000) / 1000.0::DOUBLE) AS score FROM chunks GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY score DESC, file_path, start_line, end_line) AS rank FROM b) SELECT * FROM r WHERE rank <= 4""")
def merge_related(spark: SparkSession, base: str) -> DataFrame:
    c = _chunks(spark, base).select(F.col("project").alias("diff_id"), "file_path", "start_line", "end_line", ((F.col("id") * 7919 % 1000) / 1000.0).alias("score"))
    return ranking.merge_related(c).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT id, session_id, question FROM turns ORDER BY id DESC LIMIT 20")
def history_recent(spark: SparkSession, base: str) -> DataFrame:
    return history.recent_turns(read_table(spark, base, "turns"), 20).select("id", "session_id", "question")


@query("SELECT count(*) AS turns, count(*) FILTER (answer IS NULL) AS unanswered, count(DISTINCT session_id) AS sessions FROM turns")
def history_counts(spark: SparkSession, base: str) -> DataFrame:
    return history.count_turns(read_table(spark, base, "turns"))


_SOURCES = """CASE WHEN json_valid(citations) AND starts_with(trim(citations), '[') AND json_array_length(citations::JSON) > 0 THEN chr(10) || '**Sources:**' || chr(10) || list_aggregate(list_transform(from_json(citations::JSON, '[{"file_path":"VARCHAR","start_line":"INTEGER","end_line":"INTEGER","score":"DOUBLE"}]'),
lambda c: '- `' || c.file_path || ':' || c.start_line || '-' || c.end_line || '` (score ' || printf('%.2f', round(c.score, 2)) || ')' || chr(10)), 'string_agg', '') ELSE chr(10) || '**Sources:** none' || chr(10) END"""


@query(f"""WITH t AS (SELECT id, trim(session_id, ' ') AS session_id, chr(10) || '### ' || coalesce(question, '') || chr(10) || '*' || coalesce(asked_at, '') || '*' || chr(10) || chr(10) || coalesce(answer, '_No answer was recorded for this question._') || chr(10) || {_SOURCES} AS t FROM turns WHERE id IS NOT NULL AND session_id IS NOT NULL)
SELECT session_id, 0 AS part, count(*) AS turns, chr(10) || '---' || chr(10) || chr(10) || '## Session ' || session_id || chr(10) || string_agg(t, '' ORDER BY id) AS transcript FROM t GROUP BY 1""")
def history_transcripts(spark: SparkSession, base: str) -> DataFrame:
    return history.transcripts(read_table(spark, base, "turns"))


@query(r"""WITH p AS (SELECT id, CASE WHEN json_valid(citations) AND starts_with(trim(citations), '[') THEN json_array_length(citations::JSON) END AS n FROM turns WHERE citations IS NOT NULL) SELECT id, n::INT AS n FROM p WHERE n IS NOT NULL""")
def stored_citation_counts(spark: SparkSession, base: str) -> DataFrame:
    t = read_table(spark, base, "turns").select("id", F.size(citations.stored_citations(F.col("citations"))).alias("n"), F.get_json_object("citations", "$").isNotNull().alias("whole"))
    return t.where("whole and n >= 0").select("id", "n")


@query(r"""WITH e AS (SELECT ts, event_type IN ('click', 'purchase') AS hit, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT ts, hit, sum(brk) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) FILTER (hit) AS started, max(ts) AS ended, count(*) AS events, count(*) FILTER (hit) AS relevant FROM s GROUP BY k HAVING count(*) FILTER (hit) > 0""")
def watch_debounce(spark: SparkSession, base: str) -> DataFrame:
    return bursts(read_table(spark, base, "events"), F.col("event_type").isin("click", "purchase"), "5 minutes")


def _whole_files(spark: SparkSession, base: str) -> DataFrame:
    f = read_table(spark, base, "source_files")
    return f.where("relative_path is not null and content is not null").select(F.col("relative_path").alias("file_path"), F.coalesce(T.language_of(F.col("relative_path")), F.lit("")).alias("language"), T.file_name(F.col("relative_path")).alias("name"), F.lit("file").alias("chunk_type"), "content", F.lit(1).alias("start_line"), F.size(T.lines(F.col("content"))).alias("end_line"))


@query("SELECT relative_path AS file_path, content, true AS fits FROM source_files WHERE content IS NOT NULL")
def budget_split(spark: SparkSession, base: str) -> DataFrame:
    """What the byte budget cuts, put together again, and whether all pieces keep to it."""
    pieces = chunking.fit_chunks(_whole_files(spark, base))
    size = pieces.groupBy("file_path").agg((F.max(F.octet_length("content")) <= chunking.MAX_BYTES).alias("fits"))
    return chunking.rejoined(pieces).join(size, "file_path")


@query()
def structural_chunks(spark: SparkSession, base: str) -> DataFrame:
    return parsing.structural_chunks(read_table(spark, base, "source_files"))


@query()
def extracted_references(spark: SparkSession, base: str) -> DataFrame:
    return parsing.references(read_table(spark, base, "source_files"))


def _added_files(spark: SparkSession, base: str) -> DataFrame:
    """Every source file as the diff that adds it."""
    f = read_table(spark, base, "source_files").where("content is not null")
    ls = T.lines(F.col("content"))
    body = F.array_join(F.transform(ls, lambda x: F.concat(F.lit("+"), x)), "\n")
    text = F.concat(F.lit("diff --git a/"), "relative_path", F.lit(" b/"), "relative_path", F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), "relative_path", F.lit("\n@@ -0,0 +1,"), F.size(ls).cast("string"), F.lit(" @@\n"), body, F.lit("\n"))
    return f.select(F.xxhash64("relative_path").alias("diff_id"), text.alias("text"))


@query(f"WITH f AS (SELECT relative_path, {_LINES} AS ls FROM source_files WHERE content IS NOT NULL) SELECT relative_path AS path, 'added' AS change, 0 AS hunk_no, 1 AS new_start, len(ls)::INT AS new_count FROM f")
def diff_hunks(spark: SparkSession, base: str) -> DataFrame:
    return diff.diff_hunks(_added_files(spark, base)).select("path", "change", "hunk_no", "new_start", "new_count")


@query(f"WITH f AS (SELECT relative_path, {_LINES} AS ls FROM source_files WHERE content IS NOT NULL) SELECT relative_path AS path, 'added' AS change, len(ls)::BIGINT AS added, 0::BIGINT AS removed FROM f")
def diff_summary(spark: SparkSession, base: str) -> DataFrame:
    return diff.diff_summary(diff.diff_hunks(_added_files(spark, base))).select("path", "change", "added", "removed")


@query(f"""WITH {_CHUNKS}, n AS (SELECT name, count(DISTINCT file_path) AS files, count(*) AS definitions FROM chunks WHERE chunk_type NOT IN ('module', 'general') GROUP BY 1) SELECT name, files, definitions FROM n WHERE definitions > 1""")
def ambiguous_definitions(spark: SparkSession, base: str) -> DataFrame:
    return graph.symbols(_chunks(spark, base)).groupBy("name").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("definitions")).where("definitions > 1")


@query("SELECT kind, count(*) AS n, count(DISTINCT symbol_name) AS symbols, count(DISTINCT file_path) AS files FROM refs GROUP BY 1")
def reference_counts(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "refs").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("symbol_name").alias("symbols"), F.countDistinct("file_path").alias("files"))


_ITEM = "'[' || rank || '] ' || file_path || chr(10) || CASE WHEN length(content) > 400 THEN left(content, 400) || '…' ELSE content END"


@query(f"""WITH {_HYBRID}, c AS (SELECT h.query_id, h.rank, {_ITEM} AS b FROM hits h JOIN chunks ON chunks.id = h.id WHERE h.rank <= 10), i AS (SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS items FROM c GROUP BY 1)
SELECT query_id, 'Order these pieces of code by how well they help to answer the question. Reply with their numbers only.' || chr(10) || 'Question: ' || description || chr(10) || chr(10) || items AS prompt FROM i JOIN subjects ON subject_id = query_id""")
def rerank_prompts(spark: SparkSession, base: str) -> DataFrame:
    return prompts.rerank_prompt(_hybrid(spark, base), _chunks(spark, base), _subject_queries(spark, base))


_BLOCK = "CASE WHEN contains(file_path, '/test') OR contains(file_path, 'test_') OR starts_with(file_path, 'test') THEN 'TEST FILE' ELSE 'SOURCE FILE' END || ' ' || file_path || ':' || start_line || '-' || end_line || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10)"


@query(f"""WITH {_HYBRID}, c AS (SELECT h.query_id, h.rank, {_BLOCK} AS b FROM hits h JOIN chunks ON chunks.id = h.id WHERE h.rank <= 5) SELECT query_id, string_agg(b, chr(10) ORDER BY rank) AS context FROM c GROUP BY 1""")
def answer_contexts(spark: SparkSession, base: str) -> DataFrame:
    return prompts.context_blocks(_hybrid(spark, base, limit=5), _chunks(spark, base))


@query(f"""WITH {_HYBRID}, h AS (SELECT query_id, id, rank FROM hits WHERE rank <= 10), rel AS (SELECT query_id, id FROM near WHERE rank = 1), fr AS (SELECT h.query_id, min(rank) AS r FROM h JOIN rel ON rel.query_id = h.query_id AND rel.id = h.id GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN fr ON fr.query_id = q.query_id""")
def retrieval_mrr(spark: SparkSession, base: str) -> DataFrame:
    q = _hybrid_queries(spark, base)
    near = ranking.block_top_k(q, _chunks(spark, base), 1, 64).select("query_id", "id")
    return ranking.reciprocal_rank(_hybrid(spark, base), near)
