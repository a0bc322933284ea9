"""Functions of a text, whole or broken, by generalised LL parsing of their headers with repairs.

A header is looked for at every line's first token; a text that breaks before, between or inside headers still gives
the functions whose headers are whole or can be mended with MAX_REPAIRS tokens left out or put in. Bodies are not
parsed: what follows a header does not decide whether it is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from quarry.llm.syntax.derivatives import Grammar
from quarry.llm.syntax.gll import Recogniser
from quarry.llm.syntax.grammars import language_rules
from quarry.llm.syntax.lexers import WORDS, tokens

MAX_REPAIRS = 3
# Rules of a header, on top of each language's own.
_HEADERS = {
    "py": "header: ('@' named NL)* ['async'] 'def' ident [tparams] '(' [dparams] ')' ['->' star] ':'",
    "rs": "header: attr* [vis] ('const' | 'async' | 'unsafe' | 'extern' [STR] | 'default')* 'fn' ID [generics] '(' [fnparam (',' fnparam)* [',']] ')' ['->' type] [where] ('{' | ';')",
    "go": "header: 'func' [params] ID [tparams] sig '{'",
    "java": "header: mod* [tparams] [type | 'void'] id params dims [throws] ('{' | ';')",
    "js": "header: ['export' ['default']] (DECOR ['async'] 'function' ['*'] [ident] params '{' | ('const' | 'let' | 'var') ident '=' arrowhead | DECOR membermod* ['*'] propkey params '{' | propkey ['=' | ':'] arrowhead | arrowhead)\narrowhead: ['async'] ((ident | params) '=>' | 'function' ['*'] [ident] params '{')",
    "ts": "header: ['export' ['default']] ['declare'] (decorator* ['async'] 'function' ['*'] [ident] tparams params [typeann] ('{' | ';') | ('const' | 'let' | 'var') ident [typeann] '=' arrowhead | decorator* membermod* ['*'] propkey ['?'] tparams params [typeann] ('{' | ';') | membermod* propkey [typeann] ('=' | ':') arrowhead | arrowhead)\narrowhead: ['async'] ((ident | tparams params [typeann]) '=>' | 'function' ['*'] [ident] tparams params [typeann] '{')",
}
# What may be put in, what is never left out, and statements that look like the header of a method.
_CLOSING = frozenset(") ] > : , NL".split())
_KEPT = frozenset("def fn func class function => ; { } NL".split())
_STATEMENTS = frozenset("if for while switch catch return else do try with synchronized new throw await typeof match loop function super this".split())
_NAME = re.compile(r"[\w$#]+")
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!!?\[)|\*|/\*)")


@dataclass(frozen=True)
class Header:
    start: int  # offset of its first token
    stop: int  # offset after its last
    names: list[str]  # of the function, its parameters and their types
    repairs: int
    leading: bool  # nothing but comments stands before it


@cache
def recogniser(language: str) -> Recogniser:
    rules = language_rules(language) + "\n" + _HEADERS[language].replace("DECOR", "decorator*")
    insertable = _CLOSING if language in ("js", "ts", "java") else _CLOSING | {"{"}
    return Recogniser(Grammar(rules, "header", tuple(WORDS[language].split())), MAX_REPAIRS, insertable, _KEPT)


def all_tokens(language: str, text: str) -> list[tuple[str, int]]:
    """The tokens of a text; where the lexer gives up it begins anew on the next line."""
    out, at = [], 0
    while True:
        toks = tokens(language, text[at:] if at else text)
        bad = next((p for k, p in toks if k == "ERR"), None)
        out += [(k, p + at) for k, p in toks if k != "ERR" and (bad is None or p <= bad)]
        if bad is None:
            return out
        after = text.find("\n", at + bad)
        if after < 0:
            return out
        at = after + 1


def headers(language: str, text: str, first: bool = False) -> list[Header]:
    """The function headers of a text in order; only the first if so asked.

    In a whole text, what could be a call (a header of a method mended, or without a body) is no header.
    """
    toks = [x for x in all_tokens(language, text) if x[0] not in ("INDENT", "DEDENT")]
    kinds = [k for k, _ in toks]
    parser = recogniser(language)
    may_begin = parser.g.first[parser.g.start]
    out: list[Header] = []
    i, line_end = 0, -1
    while i < len(toks):
        kind, at = toks[i]
        fresh = at > line_end
        if fresh:
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
            fresh = not text[text.rfind("\n", 0, at) + 1 : at].strip()
        if not fresh or kind not in may_begin:
            i += 1
            continue
        found = parser.prefix(kinds, i)
        if found is None:
            i += 1
            continue
        end, repairs = found
        names = [m.group() for k, p in toks[i : end + 1] if k == "ID" or k not in ("STR", "NUM") and k.isalpha() and k.islower() and k in _STATEMENTS for m in [_NAME.match(text, p)] if m]
        sure = first or not repairs or language not in ("js", "ts", "java") or not {"function", "=>"}.isdisjoint(kinds[i : end + 1])
        if kind in _STATEMENTS and kind != "function" or not names or not sure or not first and kinds[end] == ";" and language != "rs":
            i += 1
            continue
        names = [x for x in names if x not in _STATEMENTS]
        last, closing = toks[end][1], kinds[end]
        stop = last + len(closing) if not closing.isupper() else last + 1
        out.append(Header(at, stop, names, repairs, i == 0))
        if first:
            break
        i, line_end = end + 1, max(line_end, last)
    return out


def header(language: str, text: str) -> tuple[int, int, list[str]] | None:
    """(offset of its first token, offset after its last, its names) of the first function in the text, or None."""
    found = headers(language, text, True)
    return (found[0].start, found[0].stop, found[0].names) if found else None


_NAMED = {
    "py": re.compile(r"\bdef\s+([^\W\d]\w*)"), "rs": re.compile(r"\bfn\s+([^\W\d]\w*)"), "go": re.compile(r"\bfunc\s*(?:\([^)]*\)?)?\s*([^\W\d]\w*)"),
    "js": re.compile(r"\bfunction\s*\*?\s*([\w$]+)|\b(?:const|let|var)\s+([\w$]+)|([\w$#]+)\s*[?=:]*\s*(?:<[^>]*>)?\s*\("), "java": re.compile(r"([\w$]+)\s*\("),
}
_NAMED["ts"] = _NAMED["js"]


def function_name(language: str, text: str, found: Header) -> str:
    """The name the header gives the function; '' if it gives none."""
    m = _NAMED[language].search(text, found.start, found.stop)
    return next((x for x in m.groups() if x), "") if m else ""


def above(text: str, start: int) -> str:
    """The comment that stands directly above an offset."""
    lines = text[:start].split("\n")[:-1]
    kept: list[str] = []
    inside = False  # between the end and the beginning of a block comment, read upwards
    for x in reversed(lines):
        s = x.strip()
        if inside or s.endswith("*/") or _COMMENT_LINE.match(x):
            kept.append(x)
            inside = (inside or s.endswith("*/")) and "/*" not in s
        elif s:
            break
        elif kept:
            break
    return "\n".join(reversed(kept))


def docstring(text: str, stop: int) -> str | None:
    """The string that is the first statement after a Python header ending at `stop`."""
    m = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?(\"\"\"|'''|\"|')").match(text, stop)
    if not m:
        return None
    q = m.group(1)
    end = re.compile(rf"(?:[^\\]|\\.)*?{q}", re.S).match(text, m.end())
    return text[m.end() : end.end() - len(q)] if end else text[m.end() :]
