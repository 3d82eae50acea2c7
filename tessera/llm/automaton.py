"""Regular expressions to one deterministic automaton: parsing, Thompson construction, subset construction, minimisation, transition arrays.

Understood: bytes, ``\\xHH`` and escaped characters, classes with ranges and negation, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, and ``(?i:...)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def edge(self, a: int, symbols: frozenset[int] | None, b: int) -> None:
        self.edges[a].append((symbols, b))


class _Parser:
    """Recursive descent to a tree: ('set', bytes), ('cat', nodes), ('or', nodes), ('rep', node, low, high or None)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def alternatives(self):
        nodes = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            nodes.append(self.sequence())
        return nodes[0] if len(nodes) == 1 else ("or", nodes)

    def sequence(self):
        nodes = []
        while self.peek() not in ("", "|", ")"):
            nodes.append(self.repeated(self.atom()))
        return ("cat", nodes)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                close = self.s.index("}", self.i)
                low, _, high = self.s[self.i : close].partition(",")
                comma, self.i = "," in self.s[self.i : close], close + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def folded(self, symbols: set[int]) -> tuple:
        if self.fold:
            symbols |= {b ^ 32 for b in symbols if 65 <= b <= 90 or 97 <= b <= 122}
        return ("set", frozenset(symbols))

    def atom(self):
        c = self.peek()
        if c == "(":
            was = self.fold
            self.i += 1
            if self.s.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError("a group does not end")
            self.i, self.fold = self.i + 1, was
            return node
        if c == "[":
            self.i += 1
            negated = self.peek() == "^"
            self.i += negated
            symbols: set[int] = set()
            while self.peek() != "]" or not symbols:
                a = b = self.char()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    b = self.char()
                symbols |= set(range(a, b + 1))
            self.i += 1
            kind, got = self.folded(symbols)
            return (kind, frozenset(range(256)) - got if negated else got)
        return self.folded({self.char()})


def _reverse(node):
    if node[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_reverse(x) for x in node[1]])
    return ("rep", _reverse(node[1]), *node[2:]) if node[0] == "rep" else node


def _build(nfa: _Nfa, node, a: int) -> int:
    if node[0] == "set":
        b = nfa.state()
        nfa.edge(a, node[1], b)
        return b
    if node[0] == "cat":
        for x in node[1]:
            a = _build(nfa, x, a)
        return a
    if node[0] == "or":
        end = nfa.state()
        for x in node[1]:
            s = nfa.state()
            nfa.edge(a, None, s)
            nfa.edge(_build(nfa, x, s), None, end)
        return end
    _, inner, low, high = node
    for _ in range(low):
        a = _build(nfa, inner, a)
    if high is None:
        s = nfa.state()
        nfa.edge(a, None, s)
        e = _build(nfa, inner, s)
        nfa.edge(e, None, s)
        out = nfa.state()
        nfa.edge(s, None, out)
        return out
    out = nfa.state()
    nfa.edge(a, None, out)
    for _ in range(high - low):
        a = _build(nfa, inner, a)
        nfa.edge(a, None, out)
    return out


@dataclass
class Dfa:
    """Transition arrays. ``classes`` maps a byte to its class; the state after one is ``table[state * n_classes + class]``;
    bit r of ``accepts[state]`` tells that a match of rule r ends here. State 0 is the first; ``dead`` is that of no match, or -1."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    n_classes: int
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """By byte: whether it leads back to the first state from every state."""
        return (self.table.reshape(-1, self.n_classes) == 0).all(axis=0)[self.classes]


def compile_rules(patterns: list[str], search: bool = False, backward: bool = False) -> Dfa:
    """search: matches may begin at any byte. backward: of the reversed patterns."""
    nfa = _Nfa()
    first = nfa.state()
    if search:
        nfa.edge(first, frozenset(range(256)), first)
    final: dict[int, int] = {}
    for r, p in enumerate(patterns):
        node = _Parser(p).parse()
        s = nfa.state()
        nfa.edge(first, None, s)
        final[_build(nfa, _reverse(node) if backward else node, s)] = 1 << r

    # bytes that no set tells apart are one class
    sets = list({s for es in nfa.edges for s, _ in es if s is not None})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {x: k for k, x in enumerate(dict.fromkeys(signature))}
    classes = np.array([number[x] for x in signature], np.uint8)
    example = [signature.index(x) for x in number]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for symbols, t in nfa.edges[todo.pop()]:
                if symbols is None and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(x for x in seen if x in final or any(s is not None for s, _ in nfa.edges[x]))

    ids = {closure([first]): 0}
    rows, order = [], list(ids)
    for now in order:
        row = []
        for b in example:
            to = closure({t for x in now for symbols, t in nfa.edges[x] if symbols is not None and b in symbols})
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({final[x] for x in s if x in final}) for s in order], np.int64)

    # Moore's refinement
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, where = np.unique(block, return_index=True)
    rank = np.empty(len(where), np.int64)  # blocks in order of their first state, so that 0 stays first
    rank[np.argsort(where)] = np.arange(len(where))
    keep = np.sort(where)
    small = rank[block[table[keep]]]
    dead = [k for k in range(len(keep)) if not accepts[keep[k]] and (small[k] == k).all()]
    return Dfa(classes, small.astype(np.int32).ravel(), accepts[keep], len(example), dead[0] if dead else -1)


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """One pass over all bytes: positions after which some rule's match ends, and the bits of these rules.

    The buffer is cut into ``lanes`` stretches at bytes that lead back to the first state, and all stretches are
    stepped together; where such bytes are rare the stretches are uneven, never wrong.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(dfa.resets[data]) + 1
    want = np.arange(1, lanes) * n // lanes
    k = np.searchsorted(cuts, want)
    edges = np.unique(np.concatenate(([0], cuts[k[k < len(cuts)]], [n])))
    start, length = edges[:-1], np.diff(edges)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes that have a byte at step t
    column = dfa.classes[data]
    state = np.zeros(len(start), np.int32)
    flag, at, bits = dfa.accepts != 0, [], []
    for t in range(int(length[0])):
        m = active[t]
        now = dfa.table[state[:m] * dfa.n_classes + column[start[:m] + t]]
        state[:m] = now
        hit = np.flatnonzero(flag[now])
        if hit.size:
            at.append(start[hit] + t)
            bits.append(dfa.accepts[now[hit]])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, bits = np.concatenate(at), np.concatenate(bits)
    order = np.argsort(at)
    return at[order] + 1, bits[order]
