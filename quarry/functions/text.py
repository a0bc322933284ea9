"""Text expressions: all Catalyst, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a question.
STOP_WORDS = (
    "the and for are but not you all any can does did how what when where which who why this that these those with "
    "from was were into its use"
).split()
# Language of an extension.
EXTENSION_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp",
    "hpp": "cpp", "hh": "cpp", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "html": "html",
    "css": "css", "sh": "bash", "bash": "bash", "zsh": "bash", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
    "yaml": "yaml", "yml": "yaml", "sql": "sql", "toml": "toml", "json": "json",
}
PLAIN_TEXT_EXTENSIONS = ("md",)
# File names that are machine-made and never indexed.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml")
TEST_PENALTY = 0.8


def stored_path(path: Column) -> Column:
    """A path with forward slashes and without a leading ./ (null stays null)."""
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-cased extension; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path's extension, `md` for Markdown, else null."""
    table = F.create_map(*(F.lit(x) for kv in [*EXTENSION_LANGUAGES.items(), ("md", "md")] for x in kv))
    return F.try_element_at(table, extension(path))


def indexable(path: Column) -> Column:
    """Known extension, no lockfile, not *.min.*"""
    name = file_name(path)
    return extension(path).isin([*EXTENSION_LANGUAGES, *PLAIN_TEXT_EXTENSIONS]) & ~name.isin(list(LOCKFILES)) & ~name.contains(".min.")


def lines(content: Column) -> Column:
    """The lines of a text: one trailing line end dropped, \\r before \\n dropped, an empty text has none."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def is_test_file(path: Column) -> Column:
    return path.contains("/test") | path.contains("\\test") | path.contains("test_") | path.startswith("test")


def keyword_terms(question: Column) -> Column:
    """Words of three characters or more that are no stop words, in order, duplicates kept."""
    words = F.split(question, r"[^\p{L}\p{N}_]+", -1)
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w)))


def keyword_query(question: Column) -> Column:
    """The words quoted and joined with OR; null if none is left."""
    terms = keyword_terms(question)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "))


def qualified_name(parent: Column, name: Column) -> Column:
    return F.concat_ws("::", parent, name)


def embed_text(path: Column, language: Column, name: Column, kind: Column, parent: Column, start: Column, end: Column, content: Column) -> Column:
    """The text a chunk is embedded as: a header of where it comes from, a blank line, the code."""
    return F.concat(
        F.lit("File: "), path, F.lit("\nLanguage: "), language, F.lit("\nSymbol: "), name, F.lit(" ("), kind, F.lit(")\nParent: "),
        F.coalesce(parent, F.lit("<module>")), F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), content,
    )


# What an embedding model with task prefixes wants before a document and before a query.
TASK_PREFIXES = {"nomic-embed-text": ("search_document: ", "search_query: ")}


def task_prefixes(model: str) -> tuple[str, str]:
    """(before a document, before a query); empty for models without task prefixes."""
    return next((p for m, p in TASK_PREFIXES.items() if m in model), ("", ""))


def same_model(a: str | None, b: str | None) -> bool:
    """Equal up to a trailing :latest."""
    return (a or "").removesuffix(":latest") == (b or "").removesuffix(":latest")


def first_signature_line(content: Column) -> Column:
    """The first line that shows something and is no // comment; '' if there is none."""
    kept = F.filter(F.transform(lines(content), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.startswith("//"))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def chunk_type_of(kind: Column) -> Column:
    """A grammar node's kind without _item, _declaration, _definition."""
    return F.regexp_replace(kind, "_item|_declaration|_definition", "")


def split_target(target: Column) -> tuple[Column, Column]:
    """(path, line) of path[:line]; line is null if there is none."""
    m = r"^(.*):(\d+)$"
    is_line = target.rlike(m)
    return F.when(is_line, F.regexp_extract(target, m, 1)).otherwise(target), F.when(is_line, F.regexp_extract(target, m, 2).try_cast("int"))


def citation_marks(answer: Column) -> Column:
    """The distinct `path:line` marks of an answer, in order: array<struct<path, line>>."""
    parts = F.split(F.coalesce(answer, F.lit("")), "[\\s()\\[\\]{}<>,\"'`]+", -1)
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"[.:;]+$", ""))
    m = r"^(.*):(\d+)(?:[-–]\d*)?$"
    structs = F.transform(
        F.filter(trimmed, lambda p: p.rlike(m)),
        lambda p: F.struct(F.regexp_replace(F.regexp_extract(p, m, 1), r"^(\./)+", "").alias("path"), F.regexp_extract(p, m, 2).try_cast("int").alias("line")),
    )
    return F.array_distinct(F.filter(structs, lambda s: s["path"].contains(".") & ~s["path"].endswith(":") & s["line"].isNotNull()))


def parse_ranking(reply: Column, n: Column) -> Column:
    """The numbers 1..n in a reply, first mention first."""
    numbers = F.transform(F.regexp_extract_all(reply, F.lit("([0-9]+)")), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= n)))


def change_text(change: Column, renamed_from: Column) -> Column:
    return F.when(change == "renamed", F.concat(F.lit("renamed from "), renamed_from)).otherwise(change)


def call_site_text(path: Column, line: Column, caller: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.coalesce(F.concat(F.lit(" in "), caller), F.lit("")))


def added_removed(text: Column) -> tuple[Column, Column]:
    """How many lines of a hunk begin with + and with -."""
    ls = lines(text)
    return F.size(F.filter(ls, lambda x: x.startswith("+"))), F.size(F.filter(ls, lambda x: x.startswith("-")))


def age_text(seconds: Column) -> Column:
    """just now, or how many minutes, hours or days."""
    def many(n: Column, what: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    s = F.greatest(seconds, F.lit(0))
    return (
        F.when(s < 60, "just now").when(s < 3600, many(F.floor(s / 60), "minute")).when(s < 86400, many(F.floor(s / 3600), "hour")).otherwise(many(F.floor(s / 86400), "day"))
    )
