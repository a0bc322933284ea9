"""Token streams of source texts: lists of (kind, offset); kind is a literal for keywords and signs, else a class."""

from __future__ import annotations

import re

Token = tuple[str, int]

# Reserved words by language.
WORDS = {
    "js": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set from as true false null",
    "ts": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set from as true false null interface type enum implements private public protected readonly abstract declare namespace module keyof is satisfies infer asserts unique override",
    "rs": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield non",
    "py": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
}
WORD_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}

_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
_ID = r"[^\W\d]\w*"
_JS = re.compile(
    rf"(?P<ws>[^\S\n]+|//[^\n]*|\#![^\n]*)|(?P<nl>\n)|(?P<bc>/\*)|(?P<id>[$\w#@][$\w]*)|(?P<num>{_NUM}n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<tpl>`)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|\?\?=|&&=|\|\|=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]])",
    re.S,
)
_JS_NUM = re.compile(rf"{_NUM}n?")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_RS = re.compile(
    rf"(?P<ws>\s+|//[^\n]*)|(?P<bc>/\*)|(?P<raw>(?:br|cr|r)(?P<h>\#*)\".*?\"(?P=h))|(?P<str>[bc]?\"(?:[^\"\\]|\\.)*\")"
    rf"|(?P<chr>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[^}}]*\}}|.))')|(?P<life>'{_ID})|(?P<id>(?:r\#)?{_ID})"
    r"|(?P<num>0[xX][0-9a-fA-F_]+\w*|0[bB][01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[iuf](?:8|16|32|64|128|size))?)"
    r"|(?P<op>\.\.\.|\.\.=|<<=|\.\.|::|->|=>|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!<>=?:;,.(){}\[\]\#@$])",
    re.S,
)
_GO = re.compile(
    rf"(?P<ws>[^\S\n]+|//[^\n]*)|(?P<nl>\n)|(?P<bc>/\*.*?\*/)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<chr>'(?:[^'\\\n]|\\[^\n]|\\x..|\\[0-7]{{3}}|\\u.{{4}}|\\U.{{8}})')"
    rf"|(?P<id>{_ID})|(?P<num>{_NUM}i?)"
    r"|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!<>=:;,.(){}\[\]~])",
    re.S,
)
_JAVA = re.compile(
    rf"(?P<ws>\s+|//[^\n]*|/\*.*?\*/)|(?P<txt>\"\"\"(?:[^\\]|\\.)*?\"\"\")|(?P<str>\"(?:[^\"\\\n]|\\.)*\")|(?P<chr>'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)')"
    r"|(?P<id>[$A-Za-z_][$\w]*)"
    rf"|(?P<uid>{_ID})|(?P<num>(?:{_NUM})[lLfFdD]?)"
    r"|(?P<op>\.\.\.|<<=|->|::|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@])",
    re.S,
)
_PY = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<com>\#[^\n]*)|(?P<nl>\r?\n)"
    r"|(?P<str>(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'))"
    rf"|(?P<id>{_ID})|(?P<num>(?:{_NUM})[jJ]?(?!\w))"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~<>=:;,.(){}\[\]@])",
    re.S,
)
_REGEX_AFTER = frozenset("( , = : [ ! & | ? { } ; + - * / % ^ ~ < > => == === != !== && || ?? return typeof case in of do else void delete throw new += -= ...".split())
_ENDS = frozenset("ID NUM STR TPL REGEX ) ] } this super true false null break continue return ++ -- async get set of from as static type yield let".split())
_GOES_ON = frozenset(". ?. , ; ) ] : ? ( [ } => = == === != !== < > <= >= && || ?? + - * / % & | ^ ** << += -= *= /= instanceof in of TPL else catch finally as satisfies".split())
_GO_ENDS = frozenset("ID NUM STR CHR break continue fallthrough return ++ -- ) ] }".split())


def _template_end(s: str, i: int) -> int:
    """Index after the template literal whose text begins at i, or -1."""
    n = len(s)
    while i < n:
        c = s[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and s[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                c = s[i]
                if c == "`":
                    i = _template_end(s, i + 1)
                    if i < 0:
                        return -1
                    continue
                if c in "\"'":
                    m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(s, i)
                    if not m:
                        return -1
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            if depth:
                return -1
        else:
            i += 1
    return -1


def _js(s: str, words: frozenset[str]) -> list[Token]:
    out: list[Token] = []
    i, n, fresh, prev = 0, len(s), False, ""
    match = _JS.match
    while i < n:
        m = match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind, j = m.lastgroup, m.end()
        if kind == "ws":
            i = j
            continue
        if kind == "nl":
            fresh, i = True, j
            continue
        if kind == "bc":
            j = s.find("*/", j)
            if j < 0:
                out.append(("ERR", i))
                return out
            fresh = fresh or "\n" in s[i:j]
            i = j + 2
            continue
        if kind == "id":
            w = m.group()
            if w[0].isdigit():
                m2 = _JS_NUM.match(s, i)
                j = m2.end() if m2 else j
                t = "NUM" if m2 and not (j < n and (s[j].isalnum() or s[j] == "_")) else "ERR"
            elif w in words:
                t = "ID" if prev in (".", "?.") else w
            else:
                t = "AT" if w[0] == "@" else "ID" if w != "#" else "ERR"
        elif kind == "num":
            t = "NUM"
        elif kind == "str":
            t = "STR"
        elif kind == "tpl":
            j = _template_end(s, j)
            if j < 0:
                out.append(("ERR", i))
                return out
            t = "TPL"
        else:
            t = m.group()
            if t in ("/", "/=") and (not prev or prev in _REGEX_AFTER):
                m2 = _REGEX.match(s, i)
                if m2:
                    t, j = "REGEX", m2.end()
        if fresh and prev in _ENDS and t not in _GOES_ON:
            out.append((";", i))
        fresh = False
        out.append((t, i))
        prev, i = t, j
    if prev and prev not in (";", "}", "{") and prev in _ENDS:
        out.append((";", n))
    return out


def _nested_end(s: str, i: int) -> int:
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(s, i):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def _rust(s: str) -> list[Token]:
    out: list[Token] = []
    i, n, words = 0, len(s), WORD_SETS["rs"]
    match = _RS.match
    while i < n:
        m = match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind, j = m.lastgroup, m.end()
        if kind == "bc":
            j = _nested_end(s, j)
            if j < 0:
                out.append(("ERR", i))
                return out
        elif kind != "ws":
            w = m.group()
            t = {"raw": "STR", "h": "STR", "str": "STR", "chr": "CHR", "life": "LIFE", "num": "NUM", "op": w}.get(kind) or (w if w in words else "ID")
            out.append((t, i))
            if kind == "num" and w[-1].isdigit() and j < n and (s[j].isalpha() or s[j] == "_"):
                out.append(("ERR", j))
                return out
        i = j
    return out


def _go(s: str) -> list[Token]:
    out: list[Token] = []
    i, n, prev, words = 0, len(s), "", WORD_SETS["go"]
    match = _GO.match
    while i < n:
        m = match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind = m.lastgroup
        if kind == "nl" or kind == "bc" and "\n" in m.group():
            if prev in _GO_ENDS:
                out.append((";", i))
                prev = ";"
        elif kind not in ("ws", "bc"):
            w = m.group()
            t = {"str": "STR", "chr": "CHR", "num": "NUM", "op": w}.get(kind) or (w if w in words else "ID")
            out.append((t, i))
            prev = t
            if kind == "num" and m.end() < n and (s[m.end()].isalpha() or s[m.end()] == "_"):
                out.append(("ERR", m.end()))
                return out
        i = m.end()
    if prev in _GO_ENDS:
        out.append((";", n))
    return out


def _java(s: str) -> list[Token]:
    out: list[Token] = []
    i, n, words = 0, len(s), WORD_SETS["java"]
    match = _JAVA.match
    while i < n:
        m = match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind = m.lastgroup
        if kind != "ws":
            w = m.group()
            if kind == "op" and w == "/" and s[i : i + 2] == "/*":
                out.append(("ERR", i))
                return out
            t = {"txt": "STR", "str": "STR", "chr": "CHR", "num": "NUM", "op": w}.get(kind) or (w if w in words else "ID")
            out.append((t, i))
        i = m.end()
    return out


_F_START = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(\"\"\"|'''|\"|')")
_PLAIN_STRING = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def _format_string_end(s: str, i: int) -> int | None:
    """Where the format string that begins at i ends, strings within its fields passed over; None if there is none or it is not closed so."""
    m = _F_START.match(s, i)
    if not m:
        return None
    quote, i, n, depth = m.group(1), m.end(), len(s), 0
    while i < n:
        c = s[i]
        if not depth:
            if s.startswith(quote, i):
                return i + len(quote)
            if c == "\\" or s.startswith(("{{", "}}"), i):
                i += 2
                continue
            if c == "\n" and len(quote) == 1:
                return None
            depth += c == "{"
        elif c in "{[(":
            depth += 1
        elif c in "}])":
            depth -= 1
        elif c in "\"'" or c in "fFtTrR":
            end = _format_string_end(s, i) if c not in "\"'" else None
            if end is None and c in "\"'":
                p = _PLAIN_STRING.match(s, i)
                end = p.end() if p else None
                if end is None:
                    return None
            if end is not None:
                i = end
                continue
        i += 1
    return None


def _python(s: str) -> list[Token]:
    out: list[Token] = []
    levels, depth, i, n, words = [0], 0, 0, len(s), WORD_SETS["py"]
    match = _PY.match
    start = True
    while i < n:
        if start and not depth:
            col, j = 0, i
            while j < n and s[j] in " \t\f":
                col = col + 1 if s[j] == " " else (col // 8 + 1) * 8 if s[j] == "\t" else 0
                j += 1
            if j >= n:
                break
            if s[j] == "#":
                k = s.find("\n", j)
                i = n if k < 0 else k + 1
                continue
            if s[j] in "\r\n":
                i = j + (2 if s.startswith("\r\n", j) else 1)
                continue
            start, i = False, j
            if col > levels[-1]:
                levels.append(col)
                out.append(("INDENT", j))
            while col < levels[-1]:
                levels.pop()
                out.append(("DEDENT", j))
            if col != levels[-1]:
                out.append(("ERR", j))
                return out
        if s[i] in "fFtTrR" and (end := _format_string_end(s, i)) is not None:
            out.append(("STR", i))
            i = end
            continue
        m = match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind = m.lastgroup
        if kind == "nl":
            if not depth:
                out.append(("NL", i))
                start = True
        elif kind not in ("ws", "com"):
            w = m.group()
            t = {"str": "STR", "num": "NUM", "op": w}.get(kind) or (w if w in words else "ID")
            if kind == "op":
                depth += (w in "([{") - (w in ")]}")
                if depth < 0:
                    out.append((t, i))
                    return [*out, ("ERR", i)]
            out.append((t, i))
        i = m.end()
    if out and not start:
        out.append(("NL", n))
    if depth:
        return out[:-1] if out and out[-1][0] == "NL" else out  # the end inside a bracket: stops too early
    out += [("DEDENT", n)] * (len(levels) - 1)
    return out


_JSON = re.compile(r"(?P<ws>[ \t\r\n]+)|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)|(?P<op>[{}\[\]:,])")


def _json(s: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(s)
    while i < n:
        m = _JSON.match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        if m.lastgroup != "ws":
            out.append(({"str": "STR", "num": "NUM", "word": "NUM"}.get(m.lastgroup) or m.group(), i))
        i = m.end()
    return out


_TOML = re.compile(
    r"(?P<ws>[ \t]+|\#[^\n]*)|(?P<nl>\r?\n)|(?P<str3>\"\"\"(?:[^\\]|\\.)*?\"\"\"\"{0,2}|'''.*?'''\'{0,2})|(?P<str>\"(?:[^\"\\\n]|\\[btnfre\"\\uUx])*\"|'[^'\n]*')"
    r"|(?P<bare>[A-Za-z0-9_+\-][A-Za-z0-9_+:\-]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?)?(?:Z\b)?)|(?P<op>\[\[|\]\]|[=\[\]{},.])",
    re.S,
)
_TOML_VALUE = re.compile(r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d+)?|0x[0-9A-Fa-f_]+|0o[0-7_]+|0b[01_]+|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)$")


def _toml(s: str) -> list[Token]:
    out: list[Token] = []
    i, n, stack, value = 0, len(s), [], False
    while i < n:
        m = _TOML.match(s, i)
        if not m:
            out.append(("ERR", i))
            return out
        kind, w = m.lastgroup, m.group()
        j = m.end()
        if kind == "nl":
            if not stack:
                out.append(("NL", i))
                value = False
        elif kind == "op":
            if w in ("[[", "]]") and (value or stack):
                w, j = w[0], i + 1
            if w == "=":
                value = True
            elif w in "[{" and value:
                stack.append(w)
            elif w in "]}" and stack:
                stack.pop()
            if w == "," and stack and stack[-1] == "{":
                value = True
            out.append((w, i))
        elif kind == "str3":
            out.append(("STR3", i))
        elif kind == "str":
            out.append(("STR", i))
        elif kind == "bare":
            key = re.match(r"[A-Za-z0-9_\-]+$", w) is not None
            val = _TOML_VALUE.match(w) is not None
            out.append(("BOTH" if key and val else "KEY" if key else "VAL" if val else "ERR", i))
            if not key and not val:
                return out
        i = j
    out.append(("NL", n))
    return out


_YAML_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'\"%@`][^#]*?|[\-?:](?=[^\s])[^#]*?)\s*:(?:\s+|$)")
_YAML_FLOW = re.compile(r"(?P<ws>\s+|(?<=\s)#[^\n]*)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<op>[\[\]{},]|:(?=[\s,\[\]{}]|$))|(?P<plain>(?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}]))(?:[^,\[\]{}:\n#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*)")


def _yaml(s: str) -> list[Token]:
    """Lines as IN/OUT levels with -, KEY, VAL (a scalar), flow signs and END (end of a line's node)."""
    out: list[Token] = []
    levels = [-1]
    lines, offsets, at = s.split("\n"), [], 0
    for x in lines:
        offsets.append(at)
        at += len(x) + 1
    k = 0

    def scalar(text: str, pos: int, col: int) -> bool:
        """Tokens of what follows a key or dash; False on a bad one. Takes further lines for flow, quotes, blocks and folded text."""
        nonlocal k
        text = text.strip()
        while m := re.match(r"(?:&[^\s]+|![^\s]*)(?:\s+|$)", text):
            text = text[m.end() :]
        if not text or text[0] == "#":
            return True
        if text[0] in "|>":
            if not re.match(r"[|>][+\-\d]*\s*(?:#.*)?$", text):
                return False
            while k + 1 < len(lines) and (not lines[k + 1].strip() or len(lines[k + 1]) - len(lines[k + 1].lstrip(" ")) > col):
                k += 1
            out.append(("VAL", pos))
            return True
        if text[0] in "\"'":
            whole, quoted = text, re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
            while not (m := quoted.match(whole)) and k + 1 < len(lines):
                k += 1
                whole += "\n" + lines[k]
                if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip(" ")) <= col:
                    return False
            if not m or not re.match(r"\s*(?:#.*)?$", whole[m.end() :]) or (m.end() < len(whole) and whole[m.end()] == "#"):
                return False
            out.append(("VAL", pos))
            return True
        if text[0] in "[{":
            whole, i, depth = text, 0, 0
            while True:
                if i >= len(whole):
                    if not depth:
                        return True
                    if k + 1 >= len(lines):
                        return True  # the grammar finds it open
                    k += 1
                    whole += "\n" + lines[k]
                m = _YAML_FLOW.match(whole, i)
                if not m:
                    return False
                if m.lastgroup != "ws":
                    if not depth and i:
                        return False
                    t = {"str": "FSTR", "plain": "FSTR"}.get(m.lastgroup) or m.group()
                    out.append((t, pos))
                    depth += (t in "[{") - (t in "]}")
                i = m.end()
        if text[0] in "]},@`%" or (text[0] in "*" and not re.match(r"\*\S+\s*(?:#.*)?$", text)):
            return False
        plain = re.split(r"\s#", text)[0]
        if re.search(r":(\s|$)", plain):
            return False
        while k + 1 < len(lines):
            nxt = lines[k + 1]
            ind = len(nxt) - len(nxt.lstrip(" "))
            if not nxt.strip():
                k += 1
                continue
            if ind <= col or nxt.lstrip().startswith("#"):
                break
            if re.search(r":(\s|$)", re.split(r"\s#", nxt)[0]):
                return False
            k += 1
        out.append(("VAL", pos))
        return True

    while k < len(lines):
        line = lines[k].rstrip("\r")
        pos = offsets[k]
        body = line.lstrip(" ")
        if not body.strip() or body[0] == "#":
            k += 1
            continue
        if body[0] == "\t":
            return [*out, ("ERR", pos)]
        col = len(line) - len(body)
        if col == 0 and re.match(r"(---|\.\.\.)(\s|$)", line):
            out += [("OUT", pos)] * (len(levels) - 1)
            levels = [-1]
            out.append(("DOC", pos))
            k += 1
            continue
        if col == 0 and line[0] == "%" and not out:
            k += 1
            continue
        while col < levels[-1]:
            levels.pop()
            out.append(("OUT", pos))
        dashes = False
        while True:
            dash = re.match(r"-(\s+|$)", body)
            if col > levels[-1]:
                levels.append(col)
                out.append(("IN", pos))
            elif col < levels[-1] or (levels[-1] != col):
                return [*out, ("ERR", pos)]
            if dash:
                dashes = True
                out.append(("-", pos))
                rest = body[dash.end() :]
                if not rest or rest[0] == "#":
                    break
                if re.match(r"-(\s|$)", rest) or _YAML_KEY.match(rest):
                    col += dash.end()
                    body = rest
                    continue
                if not scalar(rest, pos, col):
                    return [*out, ("ERR", pos)]
                break
            key = _YAML_KEY.match(body)
            if key:
                out.append(("KEY", pos))
                if not scalar(body[key.end() :], pos, col):
                    return [*out, ("ERR", pos)]
                break
            if not scalar(body, pos, col - 1):
                return [*out, ("ERR", pos)]
            break
        k += 1
    out += [("OUT", len(s))] * (len(levels) - 1)
    return out


def tokens(language: str, text: str) -> list[Token]:
    """The tokens of a text; an ERR token stands where no token of the language begins."""
    text = text.removeprefix("﻿")
    if language in ("js", "ts"):
        return _js(text, WORD_SETS[language])
    return {"rs": _rust, "go": _go, "java": _java, "py": _python, "json": _json, "toml": _toml, "yaml": _yaml}[language](text)
