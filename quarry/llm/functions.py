"""Problem 4: functions paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.common import stage_of
from quarry.llm.headers import Header, above, docstring, function_name, headers

FUNCTION_TYPES = ("function", "method", "arrow_function")
# Languages by extension and by the column's notations.
_LANGUAGES = {"py": "py", "python": "py", "rs": "rs", "rust": "rs", "js": "js", "javascript": "js", "mjs": "js", "jsx": "js", "ts": "ts", "typescript": "ts", "tsx": "ts", "go": "go", "golang": "go", "java": "java"}
#: A description is a stock phrase if more functions of different names carry it than this share of all names, and this many, together.
STOCK_SHARE, STOCK_MORE = 0.001, 2

# Beginnings of comments that address tools, and reminders and stand-ins in place of a description.
_DIRECTIVE = re.compile(
    r"^(noqa|type:|pylint|pyright|mypy|flake8|ruff|isort|fmt:|yapf|pragma|nosec|coding[:=]|eslint|tslint|jshint|jslint|istanbul|c8 |v8 |prettier|@?ts-|biome|stylelint|webpack|nolint|lint:|go:|\+build|line |clippy|rustfmt|cfg|allow\(|nosonar|noinspection|checkstyle|cspell|codecov|spell|sourcery|bandit|suppress|formatter:|language=|region\b|endregion\b|#?(region|endregion)|export \w+$|cgo|nocov|lcov|gcov|deno-|jscpd|sonar|snyk|semgrep|doctest:|vim:|-\*-)",
    re.I,
)
_REMINDER = re.compile(r"^\W*(todo|fixme|xxx|hack|tbd|wip|tbc|tba|to ?do|note to self|to be (done|defined|written|documented|completed|continued|described|filled)|needs? (docs?|documentation|description)|(please )?(add|write|insert|fill in|describe|document)( (a|the|me|this|some|your|proper))*( (docs?|documentation|description|comment|here|me|this|later|function|summary))+|missing (docs?|documentation|description)|no (docs?|documentation|description)|description( goes)? here|doc(umentation)? (missing|pending))\b", re.I)
_STAND_IN = re.compile(r"^\W*(|n/?a|none|null|undocumented|internal|private|public|see (above|below|there|code|source|name)|inheritdoc|inherited|helper( (function|method))?|function|method|docs?|comment|description|dito|ditto|same( as above)?|as above|self[- ]explanatory|obvious|s\.? ?o\.?|siehe oben|voir ci-dessus|ver arriba|getter|setter|constructor|deprecated|override|overrides?|summary|\?+)\W*$", re.I)
_TAG = re.compile(r"^\s*(?:@(?:param|arg|argument|return|returns|throws|exception|raises|type|rtype|yield|yields|template|typeparam)\b|:(?:param|type|returns?|rtype|raises?|arg|yields?)\b[^:]*:|\\(?:param|return)\b|(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|errors|panics|safety)\s*:?\s*$|#+\s*(?:arguments|returns?|parameters|examples?|errors|panics|safety)\s*$)", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|#+\s*(?:arguments|returns?|parameters|errors|panics|safety))\s*:?\s*$", re.I)
_CODE = re.compile(
    r"^\s*(?:(?:const|let|var|val|auto|int|long|double|string|boolean|final|mut)\s+[\w\s:<>,\[\]]+=[^=]|[\w.\[\]]+\s*(?::=|[-+*/]?=(?!=))\s*\S|(?:return|raise|throw|import|from\s+\S+\s+import|del|yield|await|defer|go)\b.*[;)\]\w]$|(?:if|for|while|switch|else|elif|try|catch|with|match)\b.*[{:]$|[\w.]+\([^)]*\)\s*;?$|[}\])]+;?$|\w[\w.]*\s*\(.*\)\s*[;{]$|(?:def|fn|func|function|class|pub|public|private|print|assert)\b.*[:({;)]$)"
)
# Words that say nothing about one function in particular.
_FILLER = set("a an the this that these it its is are be has have does do of to and or in on for with by from as function method class helper routine procedure fn func def called name named gets get sets set given passed value values parameter parameters param params argument arguments arg args return returns returned result results input output takes take self none void type of int integer string number list object der die das und ist eine ein el la los las un una le les".split())


def _comment_text(block: str) -> str:
    """The words inside comments, one line a line, without their marks."""
    out, inside = [], False
    for line in block.split("\n"):
        s = line.strip()
        if inside or s.startswith("/*"):
            ends = "*/" in s
            s = re.sub(r"^/\*+!?|^\*+(?!/)|\*+/.*$", "", s)
            out.append(s.strip().rstrip("*/").rstrip() if ends else s.strip())
            inside = not ends
        elif s.startswith("//"):
            out.append(re.sub(r"^//[/!]*", "", s).strip())
        elif s.startswith("#") and not re.match(r"#!?\[", s):
            out.append(re.sub(r"^#+:?", "", s).strip())
        elif s.startswith("--"):
            out.append(s[2:].strip())
    return "\n".join(out)


def _above(text: str, found: Header) -> str:
    """The comments before the header (of a text with anything else before it only those directly above) and inside it on lines of their own."""
    first = text[: found.start] if found.leading else above(text, found.start)
    lines = [x for x in text[found.start : found.stop].split("\n") if re.match(r"\s*(//|/\*|\*|#(?!!?\[))", x)]
    return first + "\n" + "\n".join(lines)


def described(language: str, text: str, found: Header, name: str) -> str:
    """The function's own description, from its comment or docstring; '' if there is none."""
    docs = [_comment_text(_above(text, found))]
    if language == "py":
        docs.append(docstring(text, found.stop) or "")
    return next((d for d in (description(x, found.names, name) for x in docs) if d), "")


def _words(s: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=[a-z\d])(?=[A-Z])", " ", s))]


def _stem(w: str) -> str:
    """A word without the endings that only bend it, so a name's `count` meets `counts` and `counting`."""
    for end in ("ings", "ing", "ies", "es", "ed", "s", "d", "y", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def description(text: str, names: list[str], name: str) -> str:
    """What of a documentation text describes the function; '' if that is nothing.

    Left out: directives, rule lines, dead code, reminders, stand-ins, tags without words of their own, and texts
    whose words are all in the signature's names.
    """
    known = {_stem(w) for n in [*names, name] for w in _words(n)} | {_stem(w) for w in _FILLER} | _FILLER
    kept: list[str] = []
    tags = False
    for line in text.split("\n"):
        s = line.strip()
        if not s or not re.search(r"\w", s):
            tags = tags and bool(s)
            continue
        if _DIRECTIVE.match(s):
            continue
        if _SECTION.match(s):
            tags = True
            continue
        if _TAG.match(s) or tags:
            continue
        kept.append(s)
    if kept and _REMINDER.match(kept[0]):
        return ""
    kept = [s for s in kept if not _REMINDER.match(s)]
    if kept and all(_CODE.match(s) for s in kept):
        return ""
    whole = " ".join(kept).strip()
    whole = re.sub(rf"^{re.escape(name)}\b[:\s-]*", "", whole, flags=re.I) if name else whole
    if _STAND_IN.match(re.sub(r"[{}@()\[\]<>*_`]", "", whole)):
        return ""
    if not [w for w in _words(whole) if _stem(w) not in known and w not in known]:
        return ""
    return whole


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for i, path, lang, name, text in zip(f.id, f.file_path, f.language, f.name, f.content):
            if not text or re.match(r"\W*\.\.\. continued from ", text):
                continue
            name = re.sub(r"-part-\d+-\d+$", "", name or "")
            ext = (path or "").rsplit(".", 1)[-1].strip().lower()
            first = _LANGUAGES.get(ext) or _LANGUAGES.get((lang or "").strip().lower())
            for language in [first] if first else ("py", "rs", "go", "java", "ts"):
                if found := headers(language, text, True):
                    if said := described(language, text, found[0], name):
                        rows.append((i, name, said, found[0].repairs, text))
                    break
        yield pd.DataFrame(rows, columns=["chunk_id", "name", "description", "repairs", "content"])


PAIRS = "chunk_id long, name string, description string, repairs int, content string"


def documented_functions(chunks: DataFrame, keep_code: bool = True) -> DataFrame:
    """chunks(id, name, chunk_type, content, file_path, language, ...) -> (chunk_id, name, description, repairs[, content]).

    One row per function, method or arrow function with a description of its own. Later pieces of cut functions
    and repeated headers give none; null ids and contents are left out; repeated rows are rows of their own, but
    count once where stock phrases are counted. Those counts are aggregated before the shuffle and compared with
    the number of distinct functions, so the rule is the same at every size.
    """
    functions = chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES) & F.col("id").isNotNull()).select("id", "file_path", "language", "name", "content")
    found = functions.mapInPandas(_extract, PAIRS)
    if not keep_code:
        found = found.drop("content")
    return _without_stock(found, functions.select("name"))


def _without_stock(found: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs whose description is no stock phrase; names: those of all functions."""
    found = stage_of(found, "functions").write(
        found.withColumn("key", F.xxhash64(F.lower(F.regexp_replace("description", r"[\W\d_]+", " ")))), "described"
    )
    named = names.select(F.countDistinct("name")).first()[0]
    counts = found.select("key", "name").distinct().groupBy("key").agg(F.count("*").alias("n"))
    stock = counts.where(F.col("n") > STOCK_MORE + STOCK_SHARE * named).select("key")
    return found.join(stock, "key", "left_anti").drop("key")


def documented_ids(chunks: DataFrame) -> DataFrame:
    """The ids of documented_functions: (chunk_id)."""
    return documented_functions(chunks, keep_code=False).select("chunk_id")


def _extract_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, text in zip(f.relative_path, f.content):
            language = _LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
            if not language or not text:
                continue
            for found in headers(language, text):
                name = function_name(language, text, found)
                rows.append((path, name, text.count("\n", 0, found.start) + 1, described(language, text, found, name), found.repairs))
        yield pd.DataFrame(rows, columns=["relative_path", "name", "line", "description", "repairs"])


def documented_in_files(source_files: DataFrame) -> DataFrame:
    """source_files(relative_path, content, ...) -> (relative_path, name, line, description, repairs): the functions of whole files with descriptions of their own.

    Files that do not parse give the functions whose headers are whole or can be mended; line is the header's
    first. Null paths and contents and other languages give none; repeated rows are rows of their own.
    """
    files = source_files.where("relative_path is not null and content is not null").select("relative_path", "content")
    every = stage_of(source_files, "files").write(files.mapInPandas(_extract_files, "relative_path string, name string, line int, description string, repairs int"), "functions")
    return _without_stock(every.where("description <> ''"), every.select("name"))
