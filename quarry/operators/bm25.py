"""BM25 over name, content and path, as relations: postings, document lengths and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.porter import stemmed_tokens
from quarry.functions.text import keyword_terms

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Weight of a term's occurrence by column.
WEIGHTS = {"name": 10.0, "content": 1.0, "file_path": 2.0}


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, unstemmed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: F.length(t) > 0)


def postings(chunks: DataFrame, stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """(term, id, col, pos) and (id, n): every occurrence, and every chunk's length over all columns.

    Null texts have no tokens; null ids are left out.
    """
    cut = (lambda c: stemmed_tokens(F.coalesce(F.col(c), F.lit("")))) if stem else (lambda c: plain_tokens(F.col(c)))
    t = chunks.where("id is not null").select("id", *(cut(c).alias(c) for c in WEIGHTS))
    lengths = t.select("id", sum((F.size(c) for c in WEIGHTS), F.lit(0)).alias("n"))
    # one explode of the columns' arrays, one of their tokens
    each = t.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("ts")) for c in WEIGHTS))).alias("x"))
    posts = each.select("id", F.col("x.col").alias("col"), F.posexplode("x.ts").alias("pos", "term"))
    return posts.select("term", "id", "col", "pos"), lengths


def query_phrases(queries: DataFrame, stem: bool = True) -> DataFrame:
    """queries(query_id, text) -> (query_id, phrase, words): one row per distinct phrase and its number of mentions.

    A word with _ is a phrase of several tokens that must stand side by side.
    """
    words = queries.where("text is not null").select("query_id", F.explode(keyword_terms(F.col("text"))).alias("word"))
    cut = stemmed_tokens(F.col("word")) if stem else plain_tokens(F.col("word"))
    p = words.select("query_id", cut.alias("phrase")).where(F.size("phrase") > 0)
    return p.groupBy("query_id", "phrase").agg(F.count("*").alias("mentions"))


def bm25(chunks: DataFrame | None, queries: DataFrame, limit: int = 50, stem: bool = True, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """queries(query_id, text) against chunks(id, name, content, file_path) -> (query_id, id, score, rank).

    Only the postings of asked terms are joined with the queries; frequencies are aggregated before the shuffle.
    `kept` are postings and lengths made before (with the same stemming); without them they are made anew.
    Terms in most chunks weigh next to nothing but still match. Ties go to the smaller id. Queries without words
    and empty tables give no rows.
    """
    posts, lengths = kept or postings(chunks, stem)
    asked = query_phrases(queries, stem)
    terms = asked.select(F.explode("phrase").alias("term")).distinct()
    relevant = posts.join(terms, "term")
    phrases = asked.select("phrase").distinct()
    # occurrences of a phrase: all its tokens at positions counted back to the phrase's begin, in one column
    steps = phrases.select("phrase", F.size("phrase").alias("width"), F.posexplode("phrase").alias("at", "term"))
    begins = relevant.join(steps, "term").groupBy("phrase", "width", "id", "col", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count("*").alias("k"))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    freq = begins.where("k = width").groupBy("phrase", "id").agg(F.sum(F.element_at(weight, F.col("col"))).alias("f"))
    total, avgdl = lengths.agg(F.count("*"), F.avg("n")).first()
    n_p = freq.groupBy("phrase").agg(F.count("*").alias("n_p"))
    raw = F.ln((F.lit(total) - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    idf = n_p.select("phrase", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(avgdl or 1.0)))
    scored = freq.join(idf, "phrase").join(lengths, "id").join(asked, "phrase").groupBy("query_id", "id").agg(F.sum(part * F.col("mentions")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
