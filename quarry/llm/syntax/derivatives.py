"""Parsing with memoised derivatives.

What may follow a prefix of the tokens is a language, held as a set of continuations (a symbol and what comes
after it). Continuations and sets are hash-consed, so equal languages are one object, and every derivative by a
token is computed once: over a corpus almost every step is one look-up. The empty set marks the exact token that
fails; a set that is not nullable at the end says the text stops too early.
"""

from __future__ import annotations

import re

#: Cached derivatives a parser keeps; beyond that it starts its cache anew, which changes no result.
MAX_CACHED = 400_000


class Grammar:
    """Rules `name: body` in EBNF: 'literal' or CLASS terminals, ( ) [ ] * + |, and !('a' 'b') x for x not beginning with a or b."""

    def __init__(self, rules: str, start: str, words: tuple[str, ...] = ()):
        self.nodes: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.rule: dict[str, int] = {}
        self.eps = self._node(("s",))
        anyname = " | ".join(["ID", *(f"'{w}'" for w in words)])
        parts = re.split(r"^\s*(\w+):", "\n" + rules + f"\nanyname: {anyname}\n", flags=re.M)[1:]
        for name, body in zip(parts[::2], parts[1::2]):
            self.tokens = re.findall(r"'[^']*'|\w+|[()\[\]*+|!]", body)
            self.at = 0
            self.rule[name] = self._alt()
            assert self.at == len(self.tokens), (name, self.tokens[self.at :])
        self.start = self._node(("r", start))
        self._analyse()

    def _node(self, n: tuple) -> int:
        if n not in self.ids:
            self.ids[n] = len(self.nodes)
            self.nodes.append(n)
        return self.ids[n]

    def _alt(self) -> int:
        options = [self._seq()]
        while self.at < len(self.tokens) and self.tokens[self.at] == "|":
            self.at += 1
            options.append(self._seq())
        return options[0] if len(options) == 1 else self._node(("a", *options))

    def _seq(self) -> int:
        items = []
        while self.at < len(self.tokens) and self.tokens[self.at] not in "|)]":
            items.append(self._item())
        return items[0] if len(items) == 1 else self._node(("s", *items))

    def _item(self) -> int:
        t = self.tokens[self.at]
        self.at += 1
        if t == "!":
            self.at += 1
            banned = []
            while self.tokens[self.at] != ")":
                banned.append(self.tokens[self.at].strip("'"))
                self.at += 1
            self.at += 1
            return self._node(("n", tuple(banned), self._item()))
        if t in "([":
            inner = self._alt()
            self.at += 1
            x = inner if t == "(" else self._node(("o", inner))
        elif t[0] == "'":
            x = self._node(("t", t[1:-1]))
        elif t.isupper():
            x = self._node(("t", t))
        else:
            x = self._node(("r", t))
        if self.at < len(self.tokens) and self.tokens[self.at] in "*+":
            star = self._node(("*", x))
            x = star if self.tokens[self.at] == "*" else self._node(("s", x, star))
            self.at += 1
        return x

    def _analyse(self) -> None:
        """Nullable and first sets, to their fixed point."""
        n = len(self.nodes)
        self.nullable, self.first = [False] * n, [frozenset()] * n
        changed = True
        while changed:
            changed = False
            for i, (kind, *x) in enumerate(self.nodes):
                if kind == "t":
                    null, first = False, frozenset(x)
                elif kind == "a":
                    null, first = any(self.nullable[k] for k in x), frozenset().union(*(self.first[k] for k in x))
                elif kind in "*o":
                    null, first = True, self.first[x[0]]
                elif kind == "r":
                    k = self.rule[x[0]]
                    null, first = self.nullable[k], self.first[k]
                elif kind == "n":
                    null, first = self.nullable[x[1]], self.first[x[1]] - set(x[0])
                else:
                    null, first = True, frozenset()
                    for k in x:
                        first |= self.first[k]
                        if not self.nullable[k]:
                            null = False
                            break
                if (null, first) != (self.nullable[i], self.first[i]):
                    self.nullable[i], self.first[i], changed = null, first, True


class Parser:
    """Derives a grammar's language token by token."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self._reset()

    def _reset(self) -> None:
        self.cells: list[tuple[int, int]] = [(-1, -1)]  # continuation: symbol, then what follows; 0 is the end
        self.cell_ids: dict[tuple[int, int], int] = {}
        self.steps: dict[tuple[int, str], frozenset[int]] = {}
        self.sets: list[frozenset[int]] = []
        self.set_ids: dict[frozenset[int], int] = {}
        self.derived: dict[tuple[int, str], int] = {}
        self.begin = self._set(frozenset([self._cell(self.g.start, 0)]))

    def _cell(self, node: int, rest: int) -> int:
        key = (node, rest)
        found = self.cell_ids.get(key)
        if found is None:
            found = self.cell_ids[key] = len(self.cells)
            self.cells.append(key)
        return found

    def _set(self, s: frozenset[int]) -> int:
        found = self.set_ids.get(s)
        if found is None:
            found = self.set_ids[s] = len(self.sets)
            self.sets.append(s)
        return found

    def _step(self, cell: int, tok: str) -> frozenset[int]:
        """The derivative of one continuation."""
        if cell == 0:
            return frozenset()
        key = (cell, tok)
        found = self.steps.get(key)
        if found is None:
            node, rest = self.cells[cell]
            found = self._derive(node, rest, tok)
            self.steps[key] = found
        return found

    def _derive(self, node: int, rest: int, tok: str) -> frozenset[int]:
        g = self.g
        out: frozenset[int] = frozenset()
        if tok in g.first[node]:
            kind, *x = g.nodes[node]
            if kind == "t":
                return frozenset([rest])
            if kind == "r":
                return self._derive(g.rule[x[0]], rest, tok)
            if kind == "a":
                out = out.union(*(self._step(self._cell(k, rest), tok) for k in x if tok in g.first[k]))
            elif kind in "*o":
                out = self._derive(x[0], self._cell(node, rest) if kind == "*" else rest, tok)
            elif kind == "n":
                out = self._derive(x[1], rest, tok)
            else:
                for i, k in enumerate(x):
                    if tok in g.first[k]:
                        after = rest
                        for later in reversed(x[i + 1 :]):
                            after = self._cell(later, after)
                        out |= self._derive(k, after, tok) if not g.nullable[k] else self._proper(k, after, tok)
                    if not g.nullable[k]:
                        break
        if g.nullable[node]:
            out |= self._step(rest, tok)
        return out

    def _proper(self, node: int, rest: int, tok: str) -> frozenset[int]:
        """_derive without the way past a nullable node: the caller goes on to the next symbol itself."""
        kind, *x = self.g.nodes[node]
        if kind in "*o":
            return self._derive(x[0], self._cell(node, rest) if kind == "*" else rest, tok)
        return self._derive(node, rest, tok)

    def _nullable(self, cell: int) -> bool:
        while cell:
            node, cell = self.cells[cell]
            if not self.g.nullable[node]:
                return False
        return True

    def run(self, tokens: list[str]) -> tuple[str, int]:
        """('ok', -1), ('error', index of the failing token) or ('truncated', number of tokens)."""
        if len(self.derived) + len(self.steps) > MAX_CACHED:
            self._reset()
        state, derived = self.begin, self.derived
        for i, tok in enumerate(tokens):
            after = derived.get((state, tok))
            if after is None:
                cells = self.sets[state]
                after = self._set(frozenset().union(*(self._step(c, tok) for c in cells)) if cells else frozenset())
                derived[(state, tok)] = after
            state = after
            if not self.sets[state]:
                return "error", i
        return ("ok", -1) if any(self._nullable(c) for c in self.sets[state]) else ("truncated", len(tokens))
