r"""Secret scans with one combined deterministic automaton.

The rules' regexes are parsed to NFAs and determinised together by subset construction, minimised by partition
refinement, and stored as transition arrays (state x byte class). One pass over a text's UTF-8 bytes runs all rules at
once; it stops where a state accepts, by a row that can't be indexed, and asks nothing at other bytes. Where a rule first accepts, its reversed automaton finds the leftmost start behind the rule's last match and its
own anchored automaton the longest end; a text without any event costs that one pass only. A rule may ask for a least
length of a group, read by the rule's regex on the span found.

Rules must be ones whose earliest end belongs to their leftmost start, as those here do; tests hold them to ``re``.
Spans count code points, end exclusive. Base kinds come first in ties of start. A null text counts as empty; rows are
scanned one by one, so repeated rows stay and nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from operator import length_hint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False


#: The base rules; then this operator's own.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 32, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson NFA over bytes of one rule's regex: literals, classes, groups, ``|``, ``? * + {m,n}`` and ``\\xHH``."""

    def __init__(self, pattern: str, any_case: bool):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.p, self.i, self.any_case = pattern, 0, any_case
        self.start, self.end = self.either()

    def node(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def either(self) -> tuple[int, int]:
        a, b = self.node(), self.node()
        while True:
            x, y = self.sequence()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if self.i >= len(self.p) or self.p[self.i] != "|":
                return a, b
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.node()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self.repeated()
            self.empty[last].append(x)
            last = y
        return first, last

    def repeated(self) -> tuple[int, int]:
        at = self.i
        self.atom()
        behind, low, high = self.i, 1, 1
        if m := re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
            self.i = m.end()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
        over = self.i
        first = last = self.node()
        for k in range(max(low, 1) if high is None else high):
            self.i = at
            x, y = self.atom()
            assert self.i == behind
            self.empty[last].append(x)
            end = self.node()
            self.empty[y].append(end)
            if k >= low:
                self.empty[last].append(end)
            if high is None and k == max(low, 1) - 1:
                self.empty[end].append(x)
                if low == 0:
                    self.empty[last].append(end)
            last = end
        self.i = over
        return first, last

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            x = self.either()
            self.i += 1
            return x
        a, b = self.node(), self.node()
        self.steps[a].append((frozenset(self.one_of() if c == "[" else self.folded([self.char()])), b))
        return a, b

    def folded(self, codes: Iterable[int]) -> set[int]:
        codes = set(codes)
        return codes | {ord(chr(x).swapcase()) for x in codes if chr(x).isalpha()} if self.any_case else codes

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def one_of(self) -> set[int]:
        self.i += 1
        found: set[int] = set()
        while self.p[self.i] != "]":
            low = high = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.i += 1
        return self.folded(found)

    def turned(self) -> Nfa:
        """The same language, read backwards."""
        out = object.__new__(Nfa)
        out.steps, out.empty = [[] for _ in self.steps], [[] for _ in self.steps]
        for a, to in enumerate(self.steps):
            for on, b in to:
                out.steps[b].append((on, a))
        for a, to in enumerate(self.empty):
            for b in to:
                out.empty[b].append(a)
        out.start, out.end = self.end, self.start
        return out


class Earliest:
    """An NFA of a rule's earliest ends: its anchored automaton without moves out of accepting states.

    Without it, every loop at a rule's end would stay alive beside all others and multiply the combined states.
    """

    def __init__(self, dfa: Dfa):
        n = len(dfa.moves)
        self.steps = [[] for _ in range(n + 1)]
        self.empty = [[n] if says else [] for says in dfa.accepts] + [[]]
        self.start, self.end = 0, n
        for s, row in enumerate(dfa.moves):
            if dfa.accepts[s]:
                continue
            for to in {t for t in row if t != dfa.dead}:
                self.steps[s].append((frozenset(b for b in range(256) if row[dfa.classes[b]] == to), to))


class Dfa:
    """Transition arrays of NFAs taken together. ``anchored``: only from the first byte; else from every byte."""

    def __init__(self, nfas: list[Nfa], anchored: bool):
        base = [sum(len(n.steps) for n in nfas[:k]) for k in range(len(nfas))]
        steps = [[(on, b + o) for on, b in to] for n, o in zip(nfas, base) for to in n.steps]
        empty = [[b + o for b in to] for n, o in zip(nfas, base) for to in n.empty]
        ends = {n.end + o: k for k, (n, o) in enumerate(zip(nfas, base))}
        sets = {on for to in steps for on, _ in to}
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        sample = [self.classes.index(k) for k in range(len(kinds))]

        def closed(states: Iterable[int]) -> frozenset[int]:
            seen = set(states)
            todo = list(seen)
            while todo:
                for b in empty[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(x for x in seen if steps[x] or x in ends)

        roots = closed(n.start + o for n, o in zip(nfas, base))
        number, rows, todo = {roots: 0}, [], [roots]
        while todo:  # subset construction
            now = todo.pop(0)
            row = []
            for byte in sample:
                to = closed({b for x in now for on, b in steps[x] if byte in on})
                if not anchored:
                    to |= roots
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        accepts = [tuple(sorted({ends[x] for x in s if x in ends})) for s in number]
        dead = next((k for s, k in number.items() if not s), -1)
        signs: dict = {}
        part = [signs.setdefault((a, k == dead), len(signs)) for k, a in enumerate(accepts)]
        while True:  # minimisation by partition refinement
            signs = {}
            finer = [signs.setdefault((part[k], *(part[t] for t in row)), len(signs)) for k, row in enumerate(rows)]
            if len(set(finer)) == len(set(part)):
                break
            part = finer
        order: dict[int, int] = {}
        for p in part:
            order.setdefault(p, len(order))
        first = {order[p]: k for k, p in reversed(list(enumerate(part)))}
        self.moves = [[order[part[t]] for t in rows[first[s]]] for s in range(len(order))]
        self.accepts = [accepts[first[s]] for s in range(len(order))]
        self.dead = order[part[dead]] if dead >= 0 else -1

    def expanded(self) -> list[list]:
        """Rows by byte that hold the next row itself, or a ``Stop`` before one that accepts: the form the pass runs on."""
        rows: list[list] = [[] for _ in self.moves]
        into = [Stop(row, says) if says else row for row, says in zip(rows, self.accepts)]
        for row, to in zip(rows, self.moves):
            row.extend(into[to[c]] for c in self.classes)
        return rows

    def ends(self, data: bytes, places: range) -> int | None:
        """The last place in ``places`` after which this anchored automaton accepts."""
        s, found = 0, None
        for i in places:
            s = self.moves[s][self.classes[data[i]]]
            if s == self.dead:
                break
            if self.accepts[s]:
                found = i
        return found


class Stop:
    """Stands for the row of an accepting state. It can't be indexed, so the pass ends there without asking at each byte."""

    __slots__ = ("row", "says")

    def __init__(self, row: list, says: tuple[int, ...]):
        self.row, self.says = row, says


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        nfas = [Nfa(r.pattern, r.any_case) for r in rules]
        self.rules = rules
        self.forward = [Dfa([n], anchored=True) for n in nfas]
        self.all = Dfa([Earliest(d) for d in self.forward], anchored=False)
        self.backward = [Dfa([n.turned()], anchored=True) for n in nfas]
        self.exact = [re.compile(r.pattern.encode(), re.I if r.any_case else 0) for r in rules]
        self.rows = self.all.expanded()

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, of matches that are long enough, by start and rule."""
        found, over, row, rest = [], [0] * len(self.rules), self.rows[0], iter(data)
        while True:
            try:
                for byte in rest:
                    row = row[byte]
                at, byte = len(data), None
            except TypeError:  # one byte behind a stop
                at = len(data) - length_hint(rest) - 1
            while type(row) is Stop:
                for k in row.says:
                    if at > over[k]:
                        self.match(data, at, k, over, found)
                if byte is None:
                    break
                at, row, byte = at + 1, row.row[byte], next(rest, None)
            if byte is None:
                break
            row = row[byte]
        return sorted(found)

    def match(self, data: bytes, at: int, k: int, over: list[int], found: list[tuple[int, int, int]]) -> None:
        """Add the match of rule ``k`` whose earliest end is ``at``, if it is long enough; the rule goes on behind it."""
        start = self.backward[k].ends(data, range(at - 1, over[k] - 1, -1))
        if start is None:
            return
        over[k] = self.forward[k].ends(data, range(start, len(data))) + 1
        if self.long_enough(k, data[start : over[k]]):
            found.append((start, k, over[k]))

    def long_enough(self, k: int, span: bytes) -> bool:
        r = self.rules[k]
        return (len(span) if not r.group else len(self.exact[k].fullmatch(span)[r.group])) >= r.least

    def of_text(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        data = (text or "").encode()
        spans = self.spans(data)
        if len(data) == len(text or ""):
            return [(self.rules[k].kind, a, b) for a, k, b in spans]
        out, at, chars = [], 0, 0
        for a, k, b in spans:
            chars += len(data[at:a].decode())
            at = a
            out.append((self.rules[k].kind, chars, chars + len(data[a:b].decode())))
        return out


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id, spans array<struct<kind, start, end>>`` by start, then rule."""

    def work() -> Callable:
        s = scanner(rules)
        as_rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        return lambda keys, texts: [keys, [as_rows(s.of_text(t)) for t in texts]]

    return map_texts(df, id_col, text_col, "id long, spans array<struct<kind:string,start:long,end:long>>", work)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with the union of its spans replaced by ``[kind]`` of each union's first span."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``df``, secrets in ``text_col`` replaced; nulls stay null."""

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        s = scanner(rules)
        return texts.map(lambda t: None if t is None else redact(t, s.of_text(t)))

    return df.withColumn(text_col, clean(F.col(text_col)))


def digest(scan: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    text: Callable[[Column], Column] = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan.select(
        F.col("id").alias("doc_id"),
        *(n(k).alias(f"n_{k}") for k in base),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
