"""Generalised LL parsing with error recovery.

Descriptors (a grammar slot, a node of the graph-structured stack, a position, repairs made) are worked off from a
queue, cheapest first, so every reading of an ambiguous grammar is followed and each descriptor once. A call of a rule
is a node of the stack, shared by all callers at that position; what a node has already returned is handed to later
callers. Where a token fits no reading, it may be left out, or a closing mark put in, each for one repair more.
"""

from __future__ import annotations

from quarry.llm.syntax.derivatives import Grammar

#: Remembered results' nodes; beyond that the memory starts anew, which changes no result.
MAX_REMEMBERED = 400_000
_END = "$end"


class Recogniser:
    """Finds the shortest prefix of tokens that the start rule derives, with the fewest repairs."""

    def __init__(self, grammar: Grammar, repairs: int, insertable: frozenset[str], kept: frozenset[str] = frozenset()):
        """insertable: tokens that may be put in; kept: tokens that may not be left out."""
        self.g, self.repairs, self.insertable, self.kept = grammar, repairs, insertable, kept
        self.slots: list[tuple[int, int]] = [(-1, -1)]  # a node, then the slot after it; 0 ends a rule
        self.slot_ids: dict[tuple[int, int], int] = {}
        self.begins = {r: self._slot(k, 0) for r, k in grammar.rule.items()}
        self._forget()

    def _forget(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.results: dict[int, tuple[int, int] | None] = {}
        self.size = 1

    def _slot(self, node: int, rest: int) -> int:
        key = (node, rest)
        found = self.slot_ids.get(key)
        if found is None:
            found = self.slot_ids[key] = len(self.slots)
            self.slots.append(key)
        return found

    def prefix(self, tokens: list[str], start: int = 0) -> tuple[int, int] | None:
        """(index of the last token, repairs) of what begins at `start`, or None.

        Results are remembered by the tokens that were looked at: texts with equal tokens are parsed once.
        """
        at, i, n = 0, start, len(tokens)
        step, results = self.next, self.results
        while at not in results:
            after = step.get((at, tokens[i] if i < n else _END))
            if after is None:
                break
            at, i = after, i + 1
        else:
            found = results[at]
            return None if found is None else (start + found[0], found[1])
        found, reach = self._parse(tokens, start)
        if self.size > MAX_REMEMBERED:
            self._forget()
        at = 0
        for k in range(start, reach + 1):
            key = (at, tokens[k] if k < n else _END)
            after = self.next.get(key)
            if after is None:
                after = self.next[key] = self.size
                self.size += 1
            at = after
        self.results[at] = None if found is None else (found[0] - start, found[1])
        return found

    def _parse(self, tokens: list[str], start: int) -> tuple[tuple[int, int] | None, int]:
        """The result, and the last index that was looked at."""
        g, slots, first, nullable, n = self.g, self.slots, self.g.first, self.g.nullable, len(tokens)
        begin = (g.nodes[g.start][1], start, 0)
        edges: dict[tuple, set[tuple[int, tuple]]] = {begin: set()}
        popped: dict[tuple, set[tuple[int, int]]] = {begin: set()}
        seen: set[tuple] = set()
        queues: list[dict[int, list[tuple[int, tuple]]]] = [{} for _ in range(self.repairs + 1)]
        reach = start

        def add(slot: int, node: tuple, at: int, cost: int) -> None:
            key = (slot, node, at, cost)
            if key not in seen:
                seen.add(key)
                queues[cost].setdefault(at, []).append((slot, node))

        add(self.begins[begin[0]], begin, start, 0)
        for cost, queue in enumerate(queues):
            while queue:
                at = min(queue)
                slot, node = queue[at].pop()
                if not queue[at]:
                    del queue[at]
                tok = tokens[at] if at < n else _END
                if slot == 0:
                    if node == begin:
                        return (at - 1, cost), reach
                    if (at, cost) not in popped[node]:
                        popped[node].add((at, cost))
                        for back, above in edges[node]:
                            add(back, above, at, cost)
                    continue
                reach = max(reach, at)
                symbol, rest = slots[slot]
                kind, *x = g.nodes[symbol]
                stuck = False
                if kind == "t":
                    if tok == x[0]:
                        add(rest, node, at + 1, cost)
                    else:
                        stuck = True
                        if cost < self.repairs and x[0] in self.insertable and at > start:
                            add(rest, node, at, cost + 1)
                elif not nullable[symbol] and tok not in first[symbol]:
                    stuck = True
                elif kind == "r":
                    called = (x[0], at, cost)
                    if called not in edges:
                        edges[called], popped[called] = set(), set()
                        add(self.begins[x[0]], called, at, cost)
                    if (rest, node) not in edges[called]:
                        edges[called].add((rest, node))
                        for end, paid in popped[called]:
                            add(rest, node, end, paid)
                elif kind == "a":
                    for k in x:
                        if nullable[k] or tok in first[k]:
                            add(self._slot(k, rest), node, at, cost)
                elif kind in "*o":
                    if tok in first[x[0]]:
                        add(self._slot(x[0], slot if kind == "*" else rest), node, at, cost)
                    add(rest, node, at, cost)
                elif kind == "n":
                    if tok not in x[0]:
                        add(self._slot(x[1], rest), node, at, cost)
                else:
                    after = rest
                    for k in reversed(x):
                        after = self._slot(k, after)
                    add(after, node, at, cost)
                if stuck and cost < self.repairs and start < at < n and tok not in self.kept:
                    add(slot, node, at + 1, cost + 1)
        return None, reach
