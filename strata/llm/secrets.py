"""Secret scans with one deterministic automaton for all rules.

``Automaton.compile`` parses the rules' regular expressions, joins them into one NFA, makes it deterministic by
subset construction over byte classes, minimises it by partition refinement and keeps the transitions in one array.
The scan takes one pass over the bytes of a batch: the batch is cut into lanes at *foreign* bytes (bytes that no rule
can contain and that lead every state back to the start) and all lanes step together through the array. Accepting states
tell the rules that a match of ends there; in the lanes where they are met, the exact expressions of these rules, and of no
others, settle where spans start and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, portions


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; matches whose group ``group`` has under ``least``
    characters are dropped; ``detect`` is a pattern that matches inside every kept match. Long counts behind a prefix
    that the counted class can itself contain multiply the states, so ``detect`` may count less than ``least``."""

    kind: str
    pattern: str
    detect: str
    group: int = 0
    least: int = 0


#: The base rules, then the method's own.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", least=16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", least=32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{4}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", r"AIza[0-9A-Za-z_-]{4}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", r"-----BEGIN [A-Z ]"),
)
BASE = ("assign", "access", "hex")


class _Pattern:
    """The tree of a rule's expression: ("bytes", set), ("all", nodes), ("any", nodes) or ("times", node, low, high).

    Of regular expressions it takes ASCII literals, escapes of signs, \\n, \\t, \\r and \\xhh, the dot, classes, groups (plain, (?:...),
    (?i:...)), alternatives and the greedy counts ? * + {m} {m,} {m,n}; it raises on anything else.
    """

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.tree = self._any(False)
        if self.at < len(text):
            raise ValueError(f"unsupported in a rule: {text[self.at:]}")

    def _next(self, *options: str) -> str | None:
        for o in options:
            if self.text.startswith(o, self.at):
                self.at += len(o)
                return o
        return None

    def _any(self, fold: bool) -> tuple:
        found = [self._all(fold)]
        while self._next("|"):
            found.append(self._all(fold))
        return ("any", found)

    def _all(self, fold: bool) -> tuple:
        found = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            node = self._one(fold)
            if sign := self._next("?", "*", "+"):
                node = ("times", node, int(sign == "+"), 1 if sign == "?" else None)
            elif count := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
                self.at = count.end()
                low = int(count[1])
                node = ("times", node, low, int(count[3]) if count[3] else None if count[2] else low)
            found.append(node)
        return ("all", found)

    def _one(self, fold: bool) -> tuple:
        if self._next("(?i:"):
            return self._closed(True)
        if self._next("(?:"):
            return self._closed(fold)
        if self._next("(?"):
            raise ValueError(f"unsupported in a rule: {self.text}")
        if self._next("("):
            return self._closed(fold)
        if self._next("["):
            return ("bytes", self._class(fold))
        if self._next("."):
            return ("bytes", frozenset(range(256)) - {10})
        return ("bytes", self._folded({self._byte("^$*+?{")}, fold))

    def _closed(self, fold: bool) -> tuple:
        node = self._any(fold)
        if not self._next(")"):
            raise ValueError(f"a group is not closed: {self.text}")
        return node

    def _byte(self, banned: str = "") -> int:
        c = self.text[self.at]
        self.at += 1
        if c in banned or ord(c) > 127:
            raise ValueError(f"unsupported in a rule: {c}")
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c in "ntr":
            return {"n": 10, "t": 9, "r": 13}[c]
        if c.isalnum():
            raise ValueError(f"unsupported in a rule: \\{c}")
        return ord(c)

    def _class(self, fold: bool) -> frozenset[int]:
        negated, found = bool(self._next("^")), set()
        while not self._next("]"):
            low = high = self._byte()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            found |= set(range(low, high + 1))
        found = self._folded(found, fold)
        return frozenset(range(256)) - found if negated else found

    @staticmethod
    def _folded(found: set[int], fold: bool) -> frozenset[int]:
        text = bytes(sorted(found))
        return frozenset(found | set(text.lower()) | set(text.upper()) if fold else found)


class _Nfa:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, at: int) -> int:
        """Appends a tree behind state ``at``; returns its end."""
        kind, arg = tree[:2]
        if kind == "bytes":
            self.moves[at].append((arg, end := self.state()))
        elif kind == "all":
            end = at
            for inner in arg:
                end = self.add(inner, end)
        elif kind == "any":
            end = self.state()
            for inner in arg:
                self.empty[at].append(start := self.state())
                self.empty[self.add(inner, start)].append(end)
        else:
            low, high = tree[2:]
            for _ in range(low):
                at = self.add(arg, at)
            self.empty[at].append(end := self.state())
            if high is None:
                self.empty[self.add(arg, end)].append(end)
            for _ in range((high or 0) - low):
                at = self.add(arg, at)
                self.empty[at].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state + byte_class[b]]`` is the next state (states are premultiplied by the number of classes). States from
    ``accept`` on are accepting; ``rules[state // n_classes]`` has a bit for each pattern that ends there. ``foreign`` marks
    the bytes that lead each state to ``start``."""

    step: np.ndarray
    byte_class: np.ndarray
    start: int
    accept: int
    rules: np.ndarray
    foreign: np.ndarray
    n_states: int
    n_classes: int

    @staticmethod
    def compile(patterns: Iterable[str]) -> "Automaton":
        nfa = _Nfa()
        first, finals = nfa.state(), {}
        for k, pattern in enumerate(patterns):
            nfa.empty[first].append(begin := nfa.state())
            finals[nfa.add(_Pattern(pattern).tree, begin)] = 1 << k

        used = {s for moves in nfa.moves for s, _ in moves}
        marks = np.zeros((256, len(used)), bool)
        for k, s in enumerate(sorted(used, key=sorted)):
            marks[list(s), k] = True
        _, byte_class = np.unique(marks, axis=0, return_inverse=True)
        byte_class = byte_class.ravel()
        samples = [int(np.flatnonzero(byte_class == k)[0]) for k in range(byte_class.max() + 1)]

        closures: dict[int, frozenset[int]] = {}
        for s in range(len(nfa.empty)):
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(x for x in seen if nfa.moves[x] or x in finals)

        origin = closures[first]
        rows: list[list[int]] = []
        number = {origin: 0}
        order = [origin]
        for states in order:  # grows while it is read
            row = []
            for byte in samples:
                reached = set(origin)
                for s in states:
                    for allowed, t in nfa.moves[s]:
                        if byte in allowed:
                            reached |= closures[t]
                key = frozenset(reached)
                if key not in number:
                    number[key] = len(order)
                    order.append(key)
                row.append(number[key])
            rows.append(row)
        moves = np.array(rows, np.int64)
        ends = np.array([sum(finals[s] for s in states if s in finals) for states in order], np.int64)

        part = np.unique(ends, return_inverse=True)[1].ravel()
        while True:
            _, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        n, classes = int(part.max()) + 1, len(samples)
        small, rules = np.empty((n, classes), np.int64), np.empty(n, np.int64)
        small[part], rules[part] = part[moves], ends
        last = np.argsort(rules > 0, kind="stable")  # accepting states behind all others
        place = np.empty(n, np.int64)
        place[last] = np.arange(n)
        small, rules = place[small[last]], rules[last]
        start = int(place[part[0]])
        foreign_class = np.all(small == start, axis=0)
        return Automaton((small * classes).astype(np.int32).ravel(), byte_class.astype(np.int32), start * classes, int((rules == 0).sum()) * classes, rules, foreign_class[byte_class], n, classes)

    def accepted(self, data: np.ndarray, lane: int = 2048) -> Iterator[tuple[int, int, int]]:
        """One pass over ``data``; yields (start, end, bits of the rules) of the lanes in which rules match. Lanes end
        behind foreign bytes, so no match crosses their ends."""
        n = len(data)
        if not n:
            return
        cuts = np.flatnonzero(self.foreign[data])
        goal = np.arange(lane, n, lane)
        at = np.searchsorted(cuts, goal)
        edges = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]] + 1, [n]]))
        low, size = edges[:-1], np.diff(edges)
        order = np.argsort(-size, kind="stable")
        low, size = low[order], size[order]
        kinds = self.byte_class[data]
        place, state, found = low.copy(), np.full(len(low), self.start, np.int32), np.zeros(len(low), np.int64)
        alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # lanes longer than i
        done = int(size[0])
        for i in range(int(size[0])):
            k = int(alive[i])
            if k < 8:
                done = i
                break
            state[:k] = now = self.step.take(state[:k] + kinds.take(place[:k]))
            place[:k] += 1
            if now.max() >= self.accept:
                at = np.flatnonzero(now >= self.accept)
                found[at] |= self.rules[now[at] // self.n_classes]
        if done < size[0]:  # a few long lanes are stepped one by one
            step, each, rules = self.step.tolist(), self.byte_class.tolist(), self.rules.tolist()
            for j in range(int(np.searchsorted(-size, -done, side="left"))):
                s, bits = int(state[j]), 0
                for b in data[int(low[j]) + done : int(low[j] + size[j])].tobytes():
                    s = step[s + each[b]]
                    if s >= self.accept:
                        bits |= rules[s // self.n_classes]
                found[j] |= bits
        for j in np.flatnonzero(found):
            yield int(low[j]), int(low[j] + size[j]), int(found[j])


def _found(rules: tuple[Rule, ...]) -> list[tuple[int, Rule, re.Pattern]]:
    return [(k, r, re.compile(r.pattern.encode("ascii"))) for k, r in enumerate(rules)]


def _scan(rules: tuple[Rule, ...], automaton: Automaton, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    exact = _found(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in portions(batches, "text"):
        raw, at = buffers(batch.column(1))
        count = len(at) - 1
        # documents stand behind each other, a line feed after each
        shift = np.arange(count + 1)
        data = np.full(len(raw) + count, 10, np.uint8)
        keep = np.ones(len(data), bool)
        keep[at[1:] + shift[:-1]] = False
        data[keep] = raw
        begin = at + shift
        spans: list[list[tuple[int, int, str, int]]] = [[] for _ in range(count)]
        for low, high, bits in automaton.accepted(data):
            part = data[low:high].tobytes()
            for k, rule, pattern in exact:
                if not bits >> k & 1:
                    continue
                for m in pattern.finditer(part):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        d = int(np.searchsorted(begin, low + m.start(), side="right")) - 1
                        spans[d].append((low + m.start() - int(begin[d]), k, rule.kind, low + m.end() - int(begin[d])))
        out = []
        for d, found in enumerate(spans):
            if found:
                heads = np.concatenate([[0], np.cumsum((raw[at[d] : at[d + 1]] & 0xC0) != 0x80)])
                found = [{"kind": name, "start": int(heads[s]), "end": int(heads[e])} for s, _, name, e in sorted(found)]
            out.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end) in code points, end exclusive, by start, then rule order.

    Whole texts; null and empty texts have no spans. Repeated rows each give a row, columns other than doc_id and text
    are ignored, an empty table gives none. The automaton (some hundred KB, by the rules alone) goes to the tasks with
    their code; nothing is shuffled.
    """
    automaton = Automaton.compile(r.detect for r in rules)
    if not automaton.foreign[10]:
        raise ValueError("rules must not match line feeds")
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _scan(rules, automaton, batches), f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans) -> "F.Column":
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's span replaced by ``mark``; all rows and columns stay, n_chars follows the text if it is there.

    Overlapping spans are merged first. Null and clean texts stay as they are.
    """
    automaton = Automaton.compile(r.detect for r in rules)
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), texts.cast(pa.binary())], ["doc_id", "text"])
            changed: dict[int, str] = {}
            for part in _scan(rules, automaton, iter([pair])):
                for row, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if spans:
                        text, out, last = texts[row].as_py(), [], 0
                        for s in spans:
                            if s["start"] >= last:
                                out += [text[last : s["start"]], mark]
                            last = max(last, s["end"])
                        changed[row] = "".join(out) + text[last:]
            columns = list(batch.columns)
            if changed:
                new = [changed.get(k, x) for k, x in enumerate(texts.to_pylist())]
                columns[names.index("text")] = pa.array(new, texts.type)
                if "n_chars" in names:
                    old = batch.column(names.index("n_chars"))
                    columns[names.index("n_chars")] = pa.array([len(new[k]) if k in changed else x for k, x in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, schema)
