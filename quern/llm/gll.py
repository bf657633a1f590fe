"""Generalised LL recognition with a graph-structured stack, over class strings.

A text is lexed into a string with one character per token class. Bracketed groups are recognised from the inside out:
the content of a group is run once for all nonterminals that a group of its kind may hold (their parses share one
graph-structured stack), and the group is then one token that carries the set of nonterminals that derive it. Equal
contents are recognised once per worker.
"""

from __future__ import annotations

import re

_SYNTAX = re.compile(r"'(?:[^'\\]|\\.)*'|[({\[<]:\w+:[)}\]>]|\w+|[=|()?*+\n]")
END = ""


class Grammar:
    """Rules 'Name = alternatives', with quoted terminals, x? x* x+ and ( ), and groups (:N:) [:N:] {:N:} <:N:>."""

    def __init__(self, rules: str, classes: dict[str, str]):
        self.classes = classes
        self.names: dict[str, int] = {}
        self.alternatives: list[list[int]] = []
        self.productions: list[tuple] = []
        self.of: list[int] = []
        self.held: dict[str, set[str]] = {"(": set(), "[": set(), "{": set(), "<": set()}
        self.groups: dict[str, frozenset] = {}
        self._group_char: dict[tuple[str, frozenset], str] = {}
        self._predicted: list[dict[str, tuple[int, ...]]] = []
        joined = re.sub(r"\n\s*\|", " |", rules.strip())
        for line in filter(str.strip, joined.split("\n")):
            tokens = _SYNTAX.findall(line)
            self._rule(self._nt(tokens[0]), tokens[2:])
        self._sets()

    def _nt(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.alternatives)
            self.alternatives.append([])
        return self.names[name]

    def _rule(self, nt: int, tokens: list[str]) -> None:
        at = 0

        def choice() -> list[list]:
            nonlocal at
            out: list[list] = [[]]
            while at < len(tokens) and tokens[at] != ")":
                t = tokens[at]
                at += 1
                if t == "|":
                    out.append([])
                    continue
                if t == "(":
                    inner = choice()
                    at += 1
                    symbol = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._fresh(inner)
                elif t[0] == "'":
                    symbol = self.classes[t[1:-1].replace("\\'", "'")]
                elif len(t) > 3 and t[0] in "({[<":
                    self.held[t[0]].add(t[2:-2])
                    self._nt(t[2:-2])
                    symbol = (t[0], t[2:-2])
                else:
                    symbol = self._nt(t)
                if at < len(tokens) and tokens[at] in "?*+":
                    kind = tokens[at]
                    at += 1
                    if kind == "?":
                        symbol = self._fresh([[], [symbol]])
                    else:
                        many = self._fresh([])
                        self._add(many, [])
                        self._add(many, [symbol, many])
                        if kind == "+":
                            out[-1].append(symbol)
                        symbol = many
                out[-1].append(symbol)
            return out

        for alternative in choice():
            self._add(nt, alternative)

    def _fresh(self, alternatives: list[list]) -> int:
        nt = self._nt(f"#{len(self.alternatives)}")
        for a in alternatives:
            self._add(nt, a)
        return nt

    def _add(self, nt: int, symbols: list) -> None:
        self.alternatives[nt].append(len(self.productions))
        self.productions.append(tuple(symbols))
        self.of.append(nt)

    def _sets(self) -> None:
        n = len(self.alternatives)
        # Any holds whatever is balanced: it is given by the caller and has no rule
        missing = [k for k, i in self.names.items() if not self.alternatives[i] and k != "Any"]
        if missing:
            raise ValueError(f"no rule for {missing}")
        self.nullable = [False] * n
        first: list[set] = [set() for _ in range(n)]
        follow: list[set] = [set() for _ in range(n)]
        for name in set().union(*self.held.values()):
            follow[self._nt(name)].add(END)
        for name in ("File", "File_s"):
            if name in self.names:
                follow[self.names[name]].add(END)
        changed = True
        while changed:
            changed = False
            for p, symbols in enumerate(self.productions):
                nt = self.of[p]
                before = len(first[nt]), self.nullable[nt]
                for s in symbols:
                    if isinstance(s, int):
                        first[nt] |= first[s]
                        if not self.nullable[s]:
                            break
                    else:
                        first[nt].add(s)
                        break
                else:
                    self.nullable[nt] = True
                changed |= before != (len(first[nt]), self.nullable[nt])
        changed = True
        while changed:
            changed = False
            for p, symbols in enumerate(self.productions):
                tail = set(follow[self.of[p]])
                for s in reversed(symbols):
                    if isinstance(s, int):
                        size = len(follow[s])
                        follow[s] |= tail
                        changed |= len(follow[s]) != size
                        tail = tail | first[s] if self.nullable[s] else set(first[s])
                    else:
                        tail = {s}
        self.first, self.follow = first, follow
        self._first_of = []
        for symbols in self.productions:
            out, empty = set(), True
            for s in symbols:
                if isinstance(s, int):
                    out |= first[s]
                    if not self.nullable[s]:
                        empty = False
                        break
                else:
                    out.add(s)
                    empty = False
                    break
            self._first_of.append((out, empty))
        self._predicted = [{} for _ in range(n)]
        self._follows = [{} for _ in range(n)]

    def _in(self, c: str, symbols: set) -> bool:
        if c in symbols:
            return True
        held = self.groups.get(c)
        return held is not None and not held.isdisjoint(symbols)

    def _predict(self, nt: int, c: str) -> tuple[int, ...]:
        ends = self._in(c, self.follow[nt])
        out = tuple(p for p in self.alternatives[nt] if self._in(c, self._first_of[p][0]) or (self._first_of[p][1] and ends))
        self._predicted[nt][c] = out
        return out

    def _may_follow(self, nt: int, c: str) -> bool:
        out = self._follows[nt][c] = self._in(c, self.follow[nt])
        return out

    def derived(self, text: str, starts: list[str]) -> set[str]:
        """Which of the start nonterminals derive the whole text."""
        n = len(text)
        wide = n + 1
        productions, of, groups = self.productions, self.of, self.groups
        edges: dict[int, list[tuple[int, int, int]]] = {}
        pops: dict[int, set[int]] = {}
        stack: list[tuple[int, int, int, int]] = []
        for name in starts:
            nt = self.names[name]
            node = nt * wide
            if node not in edges:
                edges[node], pops[node] = [], set()
                c = text[0] if n else END
                found = self._predicted[nt].get(c)
                for p in self._predict(nt, c) if found is None else found:
                    stack.append((p, 0, node, 0))
        seen = set(stack)
        while stack:
            p, d, node, i = stack.pop()
            symbols = productions[p]
            while True:
                if d == len(symbols):
                    ends = pops[node]
                    if i not in ends:
                        c = text[i] if i < n else END
                        ok = self._follows[of[p]].get(c)
                        if self._may_follow(of[p], c) if ok is None else ok:
                            ends.add(i)
                            for q, e, parent in edges[node]:
                                x = (q, e, parent, i)
                                if x not in seen:
                                    seen.add(x)
                                    stack.append(x)
                    break
                s = symbols[d]
                if s.__class__ is int:
                    child = s * wide + i
                    back = (p, d + 1, node)
                    known = edges.get(child)
                    if known is None:
                        edges[child], pops[child] = [back], set()
                        c = text[i] if i < n else END
                        found = self._predicted[s].get(c)
                        for q in self._predict(s, c) if found is None else found:
                            x = (q, 0, child, i)
                            seen.add(x)
                            stack.append(x)
                    elif back not in known:
                        known.append(back)
                        for j in tuple(pops[child]):
                            x = (p, d + 1, node, j)
                            if x not in seen:
                                seen.add(x)
                                stack.append(x)
                    break
                if i == n:
                    break
                c = text[i]
                if s.__class__ is str:
                    if c != s:
                        break
                elif s not in groups.get(c, ()):
                    break
                i += 1
                d += 1
        return {name for name in starts if n in pops[self.names[name] * wide]}

    def group(self, kind: str, names: set[str]) -> str:
        """The token of a group of this kind that derives exactly these nonterminals."""
        key = kind, frozenset(names)
        c = self._group_char.get(key)
        if c is None:
            c = self._group_char[key] = chr(0xF0000 + len(self._group_char))
            self.groups[c] = frozenset((kind, x) for x in names)
        return c
