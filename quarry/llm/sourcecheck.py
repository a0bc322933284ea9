"""Problem 3: source files that do not parse.

Every file's tokens are derived against the grammar of the language its name promises (syntax.derivatives): an
empty derivative names the failing token, a derivative that is not nullable at the end says the file stops early.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.syntax.derivatives import Parser
from quarry.llm.syntax.grammars import grammar
from quarry.llm.syntax.lexers import tokens

# The language of an extension, as the grammars name it.
LANGUAGES = {
    "py": "py", "pyi": "py", "rs": "rs", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "go": "go",
    "java": "java", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json",
}
RESULT = "project string, relative_path string, language string, status string, line int"


_PARSERS: dict[str, Parser] = {}


def parse_status(language: str, text: str) -> tuple[str, int | None]:
    """('ok', None), or 'error' or 'truncated' with the 1-based line where it shows."""
    if not text.strip():
        return ("error", 1) if language == "json" and text else ("ok", None)
    if language not in _PARSERS:
        _PARSERS[language] = Parser(grammar(language))
    toks = tokens(language, text)
    status, at = _PARSERS[language].run([k for k, _ in toks])
    if status == "ok":
        return "ok", None
    offset = toks[at][1] if at < len(toks) else len(text)
    return status, text.count("\n", 0, offset) + 1


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for project, path, text in zip(f.project, f.relative_path, f.content):
            language = LANGUAGES[path.rsplit(".", 1)[-1].lower()]
            rows.append((project, path, language, *parse_status(language, text or "")))
        out = pd.DataFrame(rows, columns=["project", "relative_path", "language", "status", "line"])
        out["line"] = out["line"].astype("Int32")
        yield out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def parse_files(source_files: DataFrame) -> DataFrame:
    """source_files(project, relative_path, content, ...) -> (project, relative_path, language, status, line).

    One row per file whose extension has a grammar; others (md too) never break and give none. A null content is
    an empty file, and fine; null paths are kept out; repeated rows are judged each for itself. Files are parsed
    where they are read: no shuffle, one file in memory at a time besides its batch.
    """
    known = source_files.where(extension(F.col("relative_path")).isin(list(LANGUAGES)))
    return known.select("project", "relative_path", "content").mapInPandas(_check, RESULT)


def broken_files(source_files: DataFrame) -> DataFrame:
    """The paths whose text breaks the grammar of their extension's language, once each: (relative_path)."""
    return parse_files(source_files).where("status <> 'ok'").select("relative_path").distinct()


def failure_rates(source_files: DataFrame) -> DataFrame:
    """Files and failures by project and language, with the rate and how many stop early."""
    return parse_files(source_files).groupBy("project", "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("status") == "truncated").alias("truncated"),
        F.round(F.avg((F.col("status") != "ok").cast("double")), 6).alias("rate"),
    )


def recorded_against_found(source_files: DataFrame, parsed_files: DataFrame) -> DataFrame:
    """How the log's latest verdict of each file with its present content agrees with the parse: (language, recorded, found, files).

    Of several runs the last counts (ties: a failure); runs of another content and null hashes do not.
    """
    last = (
        parsed_files.where("content_hash is not null and parse_failed is not null")
        .groupBy("relative_path", "content_hash")
        .agg(F.max(F.struct("parsed_at", "parse_failed")).alias("m"))
        .select("relative_path", "content_hash", F.col("m.parse_failed").alias("recorded"))
    )
    found = parse_files(source_files).select("relative_path", "language", (F.col("status") != "ok").alias("found"))
    return (
        source_files.select("relative_path", "content_hash").join(last, ["relative_path", "content_hash"], "left")
        .join(found, "relative_path").groupBy("language", "recorded", "found").agg(F.count("*").alias("files"))
    )
