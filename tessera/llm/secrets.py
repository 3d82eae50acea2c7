"""Operator 8, secret scans: one combined deterministic automaton over all rules.

The rules are compiled together (automaton.py) to a minimal automaton that steps once over every
byte and tells where a match of which rule ends. Only there, the rule's reversed automaton walks back
to the places where that match may begin, and its forward automaton on to the longest end: the
leftmost non-overlapping matches, as a search with the single rule finds them. Matches that are then
too short are dropped.

Scale: a narrow map over the texts without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa, compile_rules, scan
from .common import flat, need, tune

ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches; ``head`` is the part before the value that must have ``least`` characters (all of the match where there is none)."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


#: The base kinds, in the order in which equal starts are listed. Lengths are checked after a match, as a short
#: match uses up its text all the same, and as counters multiply states. Hexadecimal digits are everywhere, so that
#: there a run of six calls for a look; a shorter run has no long match in it.
BASE = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{6,}", least=32),
)
#: Further well-known formats. Each open-ended rule doubles the states, so that there are few.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = compile_rules([r.pattern for r in rules], search=True)
        self.back = [compile_rules([r.pattern], backward=True) for r in rules]
        self.ahead = [compile_rules([r.pattern]) for r in rules]
        self.head = [compile_rules([r.head]) if r.head else None for r in rules]

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, at: int, stop: int) -> int:
        state, end = 0, -1
        for k in range(at, stop):
            state = dfa.table[state * dfa.n_classes + dfa.classes[data[k]]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                end = k + 1
        return end

    @staticmethod
    def _leftmost(dfa: Dfa, data: bytes, end: int, least: int) -> int:
        state, start = 0, -1
        for k in range(end - 1, least - 1, -1):
            state = dfa.table[state * dfa.n_classes + dfa.classes[data[k]]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                start = k
        return start

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text: (start, rule, end) in bytes, by start, then by rule. Ends of texts must be told apart by
        a byte that resets the automaton, so that callers put a line feed after each."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        at, bits = scan(self.all, data)
        for r, rule in enumerate(self.rules):
            ends = at[(bits >> r) & 1 == 1]
            docs = np.searchsorted(offsets, ends - 1, side="right") - 1
            done = -1
            for end, d in zip(ends.tolist(), docs.tolist(), strict=True):
                if end <= done:
                    continue
                low = max(int(offsets[d]), done)
                start = self._leftmost(self.back[r], data, end, low)
                if start < 0:
                    continue
                stop = self._longest(self.ahead[r], data, start, int(offsets[d + 1]))
                done = stop
                value = self._longest(self.head[r], data, start, stop) if rule.head else start
                if stop - value >= rule.least:
                    found[d].append((start - int(offsets[d]), r, stop - int(offsets[d])))
        for x in found:
            x.sort()
        return found


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, kinds array<string>, starts array<long>, ends array<long>: spans in code points, end exclusive, by start and order of the rules.

    One row for each input row, repeated rows too; null and empty texts have no spans; a null doc_id is kept.
    """
    tune(spark, 2048)
    names = [r.kind for r in rules]
    scanner = compiled(rules)  # compiled once; some hundred kilobytes go with the task

    def find(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            # a line feed after each text
            n = len(offsets) - 1
            out = np.full(len(data) + n, 10, np.uint8)
            keep = np.ones(len(out), bool)
            keep[offsets[1:] + np.arange(n)] = False
            out[keep] = data
            spaced = offsets + np.arange(n + 1)
            kinds, starts, ends, cut = [], [], [], [0]
            for d, spans in enumerate(scanner.spans(out, spaced)):
                if spans:  # bytes to code points
                    own = out[spaced[d] : spaced[d + 1]]
                    points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                    kinds += [names[r] for _, r, _ in spans]
                    starts += [int(points[s]) for s, _, _ in spans]
                    ends += [int(points[e]) for _, _, e in spans]
                cut.append(len(kinds))
            cuts = pa.array(cut, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in ((kinds, pa.string()), (starts, pa.int64()), (ends, pa.int64())))], names=["doc_id", "kinds", "starts", "ends"])

    return need(docs, "doc_id", "text").mapInArrow(find, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def secret_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts and the digest of the base kinds, and all spans as text."""
    found = secret_spans(spark, docs)
    listed = F.arrays_zip("kinds", "starts", "ends")
    base = [r.kind for r in BASE]

    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter(listed, lambda x: x["kinds"].isin(base))), 256).alias("base_sha256"), joined(listed).alias("spans"))
