"""Ignore files: matching of paths by .gitignore patterns."""

from __future__ import annotations

import re


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        elif c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in pattern {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Rule:
    """One line of an ignore file that lies in the folder `base` (relative, '' for the root)."""

    def __init__(self, line: str, base: str = ""):
        self.negated = line.startswith("!")
        text = line[1:] if self.negated else line
        self.only_dirs = text.endswith("/")
        text = text.rstrip("/")
        anchored = "/" in text
        text = text.lstrip("/")
        self.base = base
        self.regex = re.compile(("" if anchored else "(?:.*/)?") + _regex(text) + r"\Z", re.S)

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.only_dirs and not is_dir:
            return False
        if self.base:
            if not path.startswith(self.base + "/"):
                return False
            path = path[len(self.base) + 1 :]
        return self.regex.match(path) is not None


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file; blank lines and comments are none; trailing blanks count only escaped."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if line and not line.startswith("#") and line.strip("/!"):
            out.append(Rule(line, base))
    return out


def ignored(path: str, is_dir: bool, all_rules: list[Rule]) -> bool:
    """The last matching rule decides."""
    for r in reversed(all_rules):
        if r.matches(path, is_dir):
            return not r.negated
    return False
