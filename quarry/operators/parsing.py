"""Structural chunks and references of source files.

Python is parsed by its own grammar; languages with braces (Rust, Go, Java, JavaScript, TypeScript, C, C++, C#, Kotlin,
Swift, PHP, shell) and Ruby by a scanner of their lines that knows strings and comments; all others are cut into line
windows. Per language: functions, methods, types with skeletons, a module
chunk, calls and imports.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.text import EXTENSION_LANGUAGES
from quarry.operators.chunking import MAX_BYTES, OVERLAP, WINDOW, fit_budget

MAX_CONSTANTS, MAX_DEFINES = 60, 40
_STRINGS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`", re.S)
_BRACED = {
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?|default)\s+)*(?P<kind>fn|struct|enum|trait|impl|union|mod)\b(?:\s*<[^{;]*?>)?\s*(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", re.M),
    "go": re.compile(r"^(?P<kind>func)\s+(?:\([^)]*?(?P<parent>\w+)\s*\)\s*)?(?P<name>\w+)|^type\s+(?P<tname>\w+)\s+(?P<tkind>struct|interface)", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native|sealed)\s+|@\w+(?:\([^)]*\))?\s+)*(?:(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)|(?!return|new|else|throw|package|import)(?:<[^>]+>\s+)?(?:[\w.<>,\[\]?]+\s+)+?(?P<mname>\w+)\s*\([^;{)]*\)\s*(?:throws\s+[\w., ]+)?\{)", re.M),
    "javascript": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?P<kind>class|function\*?|async\s+function|interface|enum)\s+(?P<name>[\w$]+)|(?:const|let|var)\s+(?P<aname>[\w$]+)(?:\s*:[^=]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:\s*[^=]+)?|[\w$]+)\s*=>|(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<mname>[#\w$]+)\s*\([^;{}]*\)(?:\s*:\s*[^{;=]+)?\s*\{)", re.M),
}
for _k in ("typescript", "tsx"):
    _BRACED[_k] = _BRACED["javascript"]
_NO_NAME = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|foreach|using|lock|when|guard|defer|case)\b)"
_C_LIKE = re.compile(
    rf"^[ \t]*(?:template\s*<[^{{;]*>\s*)?(?:typedef\s+)?(?P<kind>class|struct|enum|union|namespace)\s+(?:class\s+)?(?P<name>\w+)(?=[^;(){{]*\{{)|^[ \t]*{_NO_NAME}(?:[\w:<>,\[\]~]+[\s*&]+)*?(?:(?P<parent>\w+)::)?(?P<mname>~?\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^;{{}}]*)?\{{",
    re.M,
)
_BRACED |= {
    "c": _C_LIKE, "cpp": _C_LIKE,
    "csharp": re.compile(rf"^[ \t]*(?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|unsafe|extern|new)\s+)*(?:(?P<kind>class|interface|struct|enum|record|namespace)\s+(?P<name>\w+)|{_NO_NAME}[\w.<>,\[\]?]+\s+(?P<mname>\w+)\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?:where[^{{;]*)?\{{)", re.M),
    "kotlin": re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|open|override|abstract|final|suspend|inline|data|sealed|enum|companion|operator|infix|tailrec|annotation|inner|@\w+(?:\([^)]*\))?)\s+)*(?P<kind>fun|class|interface|object)\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)", re.M),
    "swift": re.compile(r"^[ \t]*(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|async|@\w+(?:\([^)]*\))?)\s+)*(?P<kind>func|class|struct|enum|protocol|extension|actor)\s+(?P<name>\w+)", re.M),
    "php": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*(?P<kind>function|class|interface|trait|enum)\s+&?(?P<name>\w+)", re.M),
    "bash": re.compile(r"^[ \t]*(?:(?P<kind>function)\s+(?P<name>[\w\-:.]+)\s*(?:\(\s*\))?|(?P<mname>[\w\-:.]+)\s*\(\s*\))\s*(?=\{)", re.M),
}
# What is no code: in languages whose comments begin with a number sign those too.
_HASH_STRINGS = re.compile(r"(?<![\w$\\{])#[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'[^']*'", re.S)
_BLANKED = {"php": re.compile(_STRINGS.pattern + r"|(?<![\w$])#(?!\[)[^\n]*|'(?:[^'\\]|\\.)*'", re.S), "bash": _HASH_STRINGS, "ruby": re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")}
_CONTAINERS = {"struct", "enum", "trait", "impl", "union", "class", "interface", "record", "mod", "namespace", "object", "protocol", "extension", "actor", "module"}
_CALL = re.compile(r"(?:\b|(?<=[.:]))([A-Za-z_$][\w$]*)(?:::<[^>]*>)?!?\s*\(")
_NO_CALL = frozenset("if for while switch match return catch fn func function sizeof typeof await async new and or not in is def class lambda with elif print except super".split()) - {"print", "super"}
_IMPORTS = {
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M), "go": re.compile(r"^[ \t]*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", re.M),
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M), "javascript": re.compile(r"^[ \t]*import\s+([^;'\"]*?)\s*(?:from\s*)?[\"'][^\"']+[\"']", re.M),
}
for _k in ("typescript", "tsx"):
    _IMPORTS[_k] = _IMPORTS["javascript"]
_IMPORTS |= {
    "c": re.compile(r"^[ \t]*#[ \t]*include\s*[<\"]([^>\"\n]+)[>\"]", re.M), "csharp": re.compile(r"^[ \t]*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M), "kotlin": re.compile(r"^[ \t]*import\s+([\w.*]+)", re.M),
    "swift": re.compile(r"^[ \t]*import[ \t]+(?:\w+[ \t]+)?([\w.]+)", re.M), "php": re.compile(r"^[ \t]*use\s+([\w\\]+)[^;]*;", re.M), "bash": re.compile(r"^[ \t]*(?:source|\.)[ \t]+([^\s;]+)", re.M), "ruby": re.compile(r"^[ \t]*require(?:_relative)?[ \t(]+[\"']([^\"']+)", re.M),
}
_IMPORTS["cpp"] = _IMPORTS["c"]


@dataclass
class Found:
    name: str
    kind: str
    parent: str | None
    start: int  # 1-based line, with what is written directly above
    end: int
    body: int  # line on which the body begins
    container: bool


def _above(rows: list[str], line: int) -> int:
    """The first line of the comments, attributes and decorators directly above `line` (1-based)."""
    k = line - 1
    while k > 0 and re.match(r"\s*(//|/\*|\*|#|@)", rows[k - 1]):
        k -= 1
    return k + 1


def _python(text: str, rows: list[str]) -> tuple[list[Found], list[tuple[str, int, str]]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    found: list[Found] = []
    refs: list[tuple[str, int, str]] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                found.append(Found(child.name, "class" if is_class else "function", parent, _above(rows, first), child.end_lineno or child.lineno, child.body[0].lineno, is_class))
                if is_class:
                    visit(child, child.name)
            else:
                visit(child, parent)

    visit(tree, None)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if name:
                refs.append((name, getattr(f, "end_lineno", n.lineno) or n.lineno, "call"))
        elif isinstance(n, ast.Import | ast.ImportFrom):
            for a in n.names:
                if a.name != "*":
                    refs.append(((a.name.rsplit(".", 1)[-1]), n.lineno, "import"))
    return found, sorted(refs, key=lambda r: r[1])


def _braced(language: str, text: str, rows: list[str]) -> tuple[list[Found], list[tuple[str, int, str]]]:
    blank = _BLANKED.get(language, _STRINGS).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ends = [m.start() for m in re.finditer("\n", blank)]
    line_of = lambda i: bisect_left(ends, i) + 1
    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    found: list[tuple[int, int, Found]] = []
    for m in _BRACED[language].finditer(blank):
        g = m.groupdict()
        name = next((g[k] for k in ("name", "tname", "aname", "mname") if g.get(k)), None)
        if not name:
            continue
        kind = "arrow_function" if g.get("aname") else "method" if g.get("mname") or g.get("parent") else (g.get("tkind") or g.get("kind") or "function").strip()
        kind = "function" if kind.startswith(("fn", "fun", "async")) or language in ("c", "bash") and kind == "method" else kind
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        brace = blank.find("{", m.end() - 1)
        stop = blank.find(";", m.end())
        if brace < 0 or (0 <= stop < brace and kind not in ("method",)):
            if kind == "arrow_function" and stop > 0:
                found.append((begin, stop, Found(name, kind, None, _above(rows, line_of(begin)), line_of(stop), line_of(begin), False)))
            continue
        end = close.get(brace, len(blank) - 1)
        found.append((begin, end, Found(name, kind, g.get("parent"), _above(rows, line_of(begin)), line_of(end), line_of(brace), kind in _CONTAINERS)))
    # nested spans, outermost first: the innermost open container holds, an open function hides
    out: list[Found] = []
    open_spans: list[tuple[int, Found]] = []
    for begin, end, f in sorted(found, key=lambda x: (x[0], -x[1])):
        while open_spans and open_spans[-1][0] < end:
            open_spans.pop()
        if f.parent is None:
            f.parent = next((h.name for _, h in reversed(open_spans) if h.container), None)
        if f.kind != "mod" and all(h.container for _, h in open_spans):
            out.append(f)
        open_spans.append((end, f))
    heads: dict[str, list[tuple[int, int]]] = {}
    for begin, _, f in found:
        heads.setdefault(f.name, []).append((begin, f.body))
    refs = [(m.group(1), line_of(m.start(1)), "call") for m in _CALL.finditer(blank) if m.group(1) not in _NO_CALL and not re.search(r"\b(fn|func|function|def|class)\s+$", blank[max(0, m.start() - 12) : m.start(1)]) and not any(b <= m.start(1) <= b + 200 and line_of(m.start(1)) <= body for b, body in heads.get(m.group(1), ()))]
    for m in _IMPORTS[language].finditer(text):
        words = re.findall(r"[A-Za-z_$][\w$]*", m.group(1).rsplit("/", 1)[-1].rsplit("\\", 1)[-1] if language in ("go", "php", "bash", "ruby", "c", "cpp") else m.group(1).rsplit(".", 1)[-1] if language in ("csharp", "kotlin", "swift") else re.sub(r"^.*[.:](?=[\w*]+$)", "", m.group(1)) if language == "java" else m.group(1))
        refs += [(w, line_of(m.start(1)), "import") for w in words if w not in ("as", "self", "crate", "super", "type", "static")]
    return out, sorted(refs, key=lambda r: r[1])


_RUBY = re.compile(r"^([ \t]*)(class|module|def)\s+(?:self\.)?([\w.:]+[?!=]?)")


def _ruby(text: str, rows: list[str]) -> tuple[list[Found], list[tuple[str, int, str]]]:
    """Methods, classes and modules to the `end` that stands as deep as they do."""
    code = _BLANKED["ruby"].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text).split("\n")
    found: list[Found] = []
    holders: list[tuple[int, str]] = []
    for k, row in enumerate(code):
        m = _RUBY.match(row)
        if not m:
            continue
        deep = re.compile(rf"{m.group(1)}end\b")
        end = k if re.search(r"\bend\s*$", row) else next((j for j in range(k + 1, len(code)) if deep.match(code[j])), len(code) - 1)
        holders = [h for h in holders if h[0] >= k]
        container = m.group(2) != "def"
        found.append(Found(m.group(3), "method" if holders and not container else m.group(2) if container else "function", holders[-1][1] if holders else None, _above(rows, k + 1), end + 1, min(k + 2, end + 1), container))
        if container:
            holders.append((end, m.group(3)))
    blank = "\n".join(code)
    ends = [m.start() for m in re.finditer("\n", blank)]
    refs = [(m.group(1), bisect_left(ends, m.start(1)) + 1, "call") for m in _CALL.finditer(blank) if m.group(1) not in _NO_CALL and not re.search(r"\bdef\s+(self\.)?$", blank[max(0, m.start() - 12) : m.start(1)])]
    for m in _IMPORTS["ruby"].finditer(text):
        refs += [(w, text.count("\n", 0, m.start(1)) + 1, "import") for w in re.findall(r"[A-Za-z_]\w*", m.group(1).rsplit("/", 1)[-1])]
    return found, sorted(refs, key=lambda r: r[1])


def _skeleton(f: Found, members: list[Found], rows: list[str], python: bool) -> str:
    """A container's lines with its members' bodies left out."""
    out: list[str] = []
    k = f.start
    while k <= f.end:
        inner = next((m for m in members if m.start <= k <= m.end and m is not f), None)
        if inner is None:
            out.append(rows[k - 1])
            k += 1
            continue
        head = rows[inner.start - 1 : inner.body - (1 if python else 0)]
        if python:
            out += [*head, " " * (len(rows[inner.body - 1]) - len(rows[inner.body - 1].lstrip())) + "..."]
        else:
            out += [*head[:-1], (head[-1] if head else "").split("{")[0].rstrip() + " { ... }"]
        k = inner.end + 1
    return "\n".join(out)


def parse_source(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """(chunks, references) of a file: (language, name, chunk_type, parent, content, start, end) and (symbol, line, kind).

    A file that does not parse, or of a language without structure, is cut into line windows and has no
    references. Adjacent equal references count once.
    """
    language = EXTENSION_LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "md" if path.lower().endswith(".md") else "")
    rows = re.sub(r"\r?\n\Z", "", content).replace("\r\n", "\n").split("\n") if content else []
    if not rows:
        return [], []
    text = "\n".join(rows)
    try:
        if language == "python":
            found, refs = _python(text, rows)
        elif language == "ruby":
            found, refs = _ruby(text, rows)
        elif language in _BRACED:
            found, refs = _braced(language, text, rows)
        else:
            found, refs = [], []
    except (SyntaxError, ValueError, RecursionError):
        found, refs = [], []
    chunks: list[tuple] = []
    for f in found:
        whole = "\n".join(rows[f.start - 1 : f.end])
        signature = next((x.strip() for x in rows[f.start - 1 : f.end] if x.strip() and not x.strip().startswith(("//", "#", "*", "/*", "@"))), "")
        if f.container:
            skeleton = _skeleton(f, [m for m in found if m.parent == f.name and not m.container and f.start <= m.start and m.end <= f.end], rows, language == "python")
            whole = skeleton if len(skeleton.encode()) <= MAX_BYTES else whole
        for name, piece, a, b in fit_budget(f.name, whole, f.start):
            chunks.append((language, name, f.kind, f.parent, piece, a, min(b, f.end) if name != f.name else f.end))
    if found:
        first = min(f.start for f in found)
        constants = [x.strip() for x in rows if re.match(r"(?:export\s+)?(?:pub\s+)?(?:const|static|final|val)\b.*=|[A-Z][A-Z0-9_]*\s*=", x.strip()) and not x.startswith(" ")][:MAX_CONSTANTS]
        top = [x for x in rows[: first - 1] if x.strip()]
        defines = ", ".join(f"{f.parent + '::' if f.parent else ''}{f.name} ({f.kind})" for f in found[:MAX_DEFINES])
        body = "\n".join([f"Module: {path}", "", *top, *[c for c in constants if c not in top], "", f"Defines: {defines}"])
        chunks.insert(0, (language, path.rsplit("/", 1)[-1], "module", None, body, 1, max(1, first - 1)))
    else:
        for s in range(0, max(1, len(rows) - OVERLAP), WINDOW - OVERLAP):
            e = min(s + WINDOW, len(rows))
            for name, piece, a, b in fit_budget(f"lines-{s + 1}-{e}", "\n".join(rows[s:e]), s + 1):
                chunks.append((language, name, "general", None, piece, a, b))
    kept = [r for k, r in enumerate(refs) if k == 0 or refs[k - 1] != r]
    return chunks, kept


_CHUNKS = "file_path string, language string, name string, chunk_type string, parent string, content string, start_line int, end_line int"
_REFS = "symbol_name string, file_path string, line int, kind string"


def parse_files(files: DataFrame) -> DataFrame:
    """files(relative_path, content) -> chunks and references from one parse of each file, told apart by `kind`: null for a chunk.

    Parsed where the files are read; null paths and contents give none.
    """
    names = [x.split()[0] for x in f"{_CHUNKS}, symbol_name string, line int, kind string".split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for p, t in zip(f.relative_path, f.content):
                chunks, refs = parse_source(p, t)
                rows += [(p, *c, None, None, None) for c in chunks]
                rows += [(p, None, None, None, None, None, None, None, *r) for r in refs]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line", "line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.where("relative_path is not null and content is not null").select("relative_path", "content").mapInPandas(run, f"{_CHUNKS}, symbol_name string, line int, kind string")


def chunks_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind is null").select(*[x.split()[0] for x in _CHUNKS.split(", ")])


def references_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind is not null").select(*[x.split()[0] for x in _REFS.split(", ")])


def structural_chunks(files: DataFrame) -> DataFrame:
    """files(relative_path, content) -> chunks; null contents give none."""
    return chunks_of(parse_files(files))


def references(files: DataFrame) -> DataFrame:
    """files(relative_path, content) -> (symbol_name, file_path, line, kind): calls and imports."""
    return references_of(parse_files(files))


def register(spark) -> None:
    """The scalar functions for SQL: fnv1a is an expression (functions.hashing); these two are Arrow functions."""
    from quarry.functions.porter import stemmed_tokens

    spark.udf.register("stemmed_tokens", stemmed_tokens)
