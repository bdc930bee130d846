"""A generalised LL recogniser with a graph-structured stack.

A grammar maps a nonterminal to its alternatives, each a tuple of symbols. A symbol is a nonterminal, or
a terminal: a callable that says whether the token at a position fits and how far it reaches. Descriptors
(a place in an alternative, a stack node, a position) are worked off once each, so ambiguity and left
recursion cost polynomial time and never loop. Parsing starts anywhere and needs no valid surroundings.
"""

from __future__ import annotations

from collections.abc import Callable

Terminal = Callable[[list, int], int]
Grammar = dict[str, list[tuple]]


class Parser:
    """Recognises nonterminals of a grammar from any position of a token list."""

    def __init__(self, grammar: Grammar, watch: tuple[str, ...] = ()):
        self.grammar, self.watch = grammar, frozenset(watch)

    def parse(self, tokens: list, start: str, at: int) -> tuple[set[int], list[tuple[str, int, int]]]:
        """Where ``start`` may end if it begins at ``at``, and the watched nonterminals completed on the way."""
        grammar, watch = self.grammar, self.watch
        root = (start, at)
        edges: dict[tuple, list[tuple]] = {root: []}  # stack node -> (alternative, dot, parent node)
        popped: dict[tuple, set[int]] = {root: set()}
        seen: set[tuple] = set()
        work: list[tuple] = [(alt, 0, root, at) for alt in reversed(grammar[start])]
        spans: list[tuple[str, int, int]] = []
        while work:
            item = work.pop()
            if item in seen:
                continue
            seen.add(item)
            alt, dot, node, pos = item
            size = len(alt)
            while dot < size:
                symbol = alt[dot]
                if symbol.__class__ is str:
                    child = (symbol, pos)
                    back = (alt, dot + 1, node)
                    known = edges.get(child)
                    if known is None:
                        edges[child] = [back]
                        popped[child] = set()
                        work.extend((a, 0, child, pos) for a in reversed(grammar[symbol]))
                    elif back not in known:
                        known.append(back)
                        work.extend((alt, dot + 1, node, end) for end in popped[child])
                    break
                end = symbol(tokens, pos)
                if end < 0:
                    break
                pos, dot = end, dot + 1
            else:
                if pos not in popped[node]:
                    popped[node].add(pos)
                    if node[0] in watch:
                        spans.append((node[0], node[1], pos))
                    work.extend((a, d, parent, pos) for a, d, parent in edges[node])
        return popped[root], spans
