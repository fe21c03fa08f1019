"""Secret scan by one combined deterministic automaton.

The whole expressions of all rules are compiled together: parsed, turned into a nondeterministic automaton over bytes,
made deterministic by subset construction with a start state that loops on every byte, minimised by partition refinement,
and laid out as one transition array (states x byte classes) with a bit set of accepted rules for each state. One pass over a batch's
bytes finds, for all rules at once, every byte at which a match of a rule ends: the bytes are cut into lanes behind pairs of bytes
after which every state is the start state, and all lanes advance together, a byte a step. Where a rule's ends stop, an automaton
of the reversed rule, made in the same way, goes back to the leftmost byte at which a match with that end begins. Matches of
a rule that would begin within the match before it begin behind it, or not at all.

That gives leftmost longest matches as long as a rule ends in a repeated set or in fixed text, and none of its matches begins in
the head (what comes before the repeated set) of another: so it is with the rules here, of which the tests hold every kind against a regular expression engine.
What a match must have (LEAST) is asked of it afterwards: a match that fails is dropped, and the search goes on behind it.

Base kinds: assign, access, hex. Further kinds: private_key, github, slack, jwt. Positions are code points, ends
exclusive. Nulls: a null text is an empty one; a null doc_id is carried. Repeated rows give a row each. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spelled, tidied

RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]+",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
#: The least number of characters of a match, or of its tail: what the repeated set at the rule's end takes.
LEAST = {"assign": ("tail", 8), "access": ("match", 16), "hex": ("match", 32), "private_key": ("match", 1), "github": ("tail", 36), "slack": ("tail", 10), "jwt": ("match", 40)}
KINDS, BASE = tuple(RULES), ("assign", "access", "hex")


# ---------------------------------------------------------------- compiling


class _Parser:
    """A regular expression over ASCII bytes: literals, \\xNN, classes, groups, (?i: ), |, ?, *, +, {n}, {n,}."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def atom(self):
        c = self.take()
        if c == "(":
            fold, self.fold = self.fold, self.fold or self.text.startswith("?i:", self.at)
            self.at += 3 if self.text.startswith("?i:", self.at) else 2 if self.text.startswith("?:", self.at) else 0
            inner = self.either()
            self.take()
            self.fold = fold
            return inner
        if c == "[":
            chars = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    chars |= set(range(low, self.char() + 1))
                else:
                    chars.add(low)
            self.take()
            return self.folded(chars)
        self.at -= 1
        return self.folded({self.char()})

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def folded(self, chars: set[int]):
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
        return ("set", frozenset(chars))

    def repeat(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return {"?": ("or", [node, ("seq", [])]), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        if c == "{":
            low, _, rest = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            many = "," in self.text[self.at : self.text.index("}", self.at)]
            self.at = self.text.index("}", self.at) + 1
            if rest:
                raise ValueError("upper bounds aren't supported")
            return ("seq", [node] * int(low) + [("star", node)] * many)
        return node


class _Nondeterministic:
    def __init__(self):
        self.free, self.moves = [], []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Adds a node's automaton behind ``start``; its last state."""
        kind, what = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((what, end))
            return end
        if kind == "seq":
            for x in what:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "or":
            for x in what:
                self.free[self.add(x, start)].append(end)
        else:
            self.free[start].append(end)
            self.free[self.add(what, end)].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


def parsed(pattern: str):
    return _Parser(pattern).either()


def turned(node):
    """The node whose matches are those of ``node``, read backwards."""
    kind, what = node
    if kind == "set":
        return node
    if kind == "star":
        return (kind, turned(what))
    return (kind, [turned(x) for x in (reversed(what) if kind == "seq" else what)])


def compile_rules(nodes: tuple, search: bool = True):
    """(byte class of each byte, transitions: states x classes, accepted rules of each state as bits); state 0 starts.

    search: a match may begin at any byte; else at the first one only.
    """
    import numpy as np

    nfa = _Nondeterministic()
    root, accepts = nfa.state(), {}
    for bit, node in enumerate(nodes):
        begin = nfa.state()
        nfa.free[root].append(begin)
        accepts[nfa.add(node, begin)] = 1 << bit
    # bytes that all sets treat alike are one class
    sets = {s for moves in nfa.moves for s, _ in moves}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    # subset construction; in a search the root stays in every subset
    start, always = nfa.closure([root]), [root] if search else []
    number, table, todo = {start: 0}, [], [start]
    for subset in todo:
        row = []
        for byte in sample:
            to = nfa.closure([*always, *(t for s in subset for chars, t in nfa.moves[s] if byte in chars)])
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    moves = np.array(table, np.int64)
    accepted = np.array([sum({accepts.get(s, 0) for s in subset}) for subset in todo], np.int64)
    # minimisation: split blocks until all members' moves lead to the same blocks
    _, block = np.unique(accepted, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)  # so that the start state, which is seen first, is 0
    rename = np.empty(len(order), np.int64)
    rename[order] = np.arange(len(order))
    return classes, rename[block[moves[first[order]]]].astype(np.int32), accepted[first[order]]


class Scanner:
    """The automata of some rules, and the scan of a batch of texts."""

    def __init__(self, rules: tuple[str, ...], least: tuple[tuple[str, int], ...]):
        import numpy as np

        nodes, self.least = [parsed(r) for r in rules], least
        self.classes, self.moves, self.accepted = compile_rules(tuple(nodes))
        self.flat, self.accepted = self.moves.ravel().astype(np.int64), self.accepted.astype(np.uint8)
        self.back = [self._anchored(turned(x)) for x in nodes]
        self.ahead = [self._anchored(x) for x in nodes]
        self.rows, self.back_rows = self.moves.tolist(), [tuple(x.tolist() for x in r) for r in self.back]
        # pairs of byte classes after which every state is the start state
        pairs = [(self.moves[np.unique(self.moves[:, c])] == 0).all(axis=0) for c in range(self.moves.shape[1])]
        self.resets = np.array(pairs)[self.classes][:, self.classes]

    @staticmethod
    def _anchored(node):
        """(transitions by byte, accepting states, states that nothing leads out of) of one rule."""
        import numpy as np

        classes, moves, accepted = compile_rules((node,), search=False)
        return moves[:, classes].astype(np.int64), accepted > 0, (accepted == 0) & (moves == np.arange(len(moves))[:, None]).all(axis=1)

    def ends(self, buf):
        """For each byte the rules, as bits, of which a match ends with it."""
        import numpy as np

        n = len(buf)
        after = np.flatnonzero(self.resets[buf[:-1], buf[1:]]) + 2
        cuts = after[np.unique(np.searchsorted(after, np.arange(LANE, n, LANE)).clip(max=len(after) - 1))] if len(after) else after
        starts = np.unique(np.concatenate([[0], cuts]))
        starts = starts[starts < n]
        sizes = np.diff(np.append(starts, n))
        order = np.argsort(-sizes, kind="stable")
        starts, falling = starts[order], -sizes[order]
        state, out = np.zeros(len(starts), np.int64), np.zeros(n, np.uint8)
        step, width = self.classes[buf], self.moves.shape[1]
        for t in range(int(-falling[0])):
            alive = int(np.searchsorted(falling, -t, side="left"))  # lanes longer than t
            if alive <= FEW:
                for lane in range(alive):
                    a, b = int(starts[lane]) + t, int(starts[lane] - falling[lane])
                    out[a:b] = self.accepted[self._walk(int(state[lane]), step[a:b].tolist())]
                break
            at = starts[:alive] + t
            now = self.flat[state[:alive] * width + step[at]]
            state[:alive] = now
            out[at] = self.accepted[now]
        return out

    def _walk(self, state: int, steps: list[int]) -> list[int]:
        """The states after each step, one at a time: quicker for a long lane by itself."""
        rows, out = self.rows, []
        for c in steps:
            state = rows[state][c]
            out.append(state)
        return out

    def begins(self, buf, rule: int, last):
        """For each byte of ``last``, at which a match of the rule ends, the leftmost byte at which one with that end begins."""
        import numpy as np

        moves, accepting, dead = self.back[rule]
        begin, lane, at, state = np.array(last), np.arange(len(last)), np.array(last), np.zeros(len(last), np.int64)
        while len(lane):
            if len(lane) <= FEW:
                for i, a, s in zip(lane.tolist(), at.tolist(), state.tolist(), strict=True):
                    found = self._back_from(buf, rule, a, 0, s)
                    begin[i] = found if found >= 0 else begin[i]
                break
            state = moves[state, buf[at]]
            hit = accepting[state]
            begin[lane[hit]] = at[hit]
            at -= 1
            going = ~dead[state] & (at >= 0)
            lane, at, state = lane[going], at[going], state[going]
        return begin

    def _back_from(self, buf, rule: int, last: int, first: int, state: int = 0) -> int:
        """The leftmost byte, of those from ``first`` on, at which a match with its end at ``last`` begins; -1 if none."""
        moves, accepting, dead = self.back_rows[rule]
        begin, at = -1, last
        while at >= first:
            low = max(first, at - 4096)
            for byte in buf[low : at + 1][::-1].tolist():
                state = moves[state][byte]
                if accepting[state]:
                    begin = at
                elif dead[state]:
                    return begin
                at -= 1
        return begin

    def tail(self, buf, rule: int, begin: int, last: int) -> int:
        """How many bytes of the match come after the first byte at which it could have ended, that one included."""
        moves, accepting, _ = self.ahead[rule]
        state = 0
        for at in range(begin, last + 1):
            state = moves[state, buf[at]]
            if accepting[state]:
                return last + 1 - at
        return 0

    def spans(self, texts: list[bytes]):
        """(text, rule, start, end) of all passing matches as arrays, by text, start and rule; places are code points."""
        import numpy as np

        buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        ends, parts = self.ends(buf), []
        stops = ends & ~np.append(ends[1:], np.uint8(0))
        for rule, (what, least) in enumerate(self.least):
            last = np.flatnonzero(stops & (1 << rule))
            begin = self.begins(buf, rule, last)
            behind, kept = 0, np.ones(len(last), bool)
            for i in np.flatnonzero(begin[1:] <= last[:-1]) + 1 if len(last) else ():
                # begins within the match before it, unless that is dropped itself
                before = i - 1
                while before >= 0 and not kept[before]:
                    before -= 1
                behind = int(last[before]) + 1 if before >= 0 else 0
                if begin[i] < behind:
                    begin[i] = self._back_from(buf, rule, int(last[i]), behind)
                    kept[i] = begin[i] >= 0
            if what == "match":
                kept &= last + 1 - begin >= least
            else:
                for i in np.flatnonzero(kept):
                    kept[i] = self.tail(buf, rule, int(begin[i]), int(last[i])) >= least
            parts.append((np.full(int(kept.sum()), rule), begin[kept], last[kept] + 1))
        rule, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        text = np.searchsorted(bounds, begin, side="right") - 1
        order = np.lexsort((rule, begin))
        rule, begin, end, text = rule[order], begin[order], end[order], text[order]
        if len(rule):
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            first = points[bounds[text]]
            begin, end = points[begin] - first, points[end] - first
        return text, rule, begin, end


LANE, FEW = 192, 8


@lru_cache(2)
def scanner(kinds: tuple[str, ...] = KINDS) -> Scanner:
    return Scanner(tuple(RULES[k] for k in kinds), tuple(LEAST[k] for k in kinds))


def _scanned(kinds: tuple[str, ...], shared):
    def run(batches):
        import pandas as pd

        from .common import numbers, slices

        for frame in batches:
            ids, texts = numbers(frame["doc_id"]), [t or "" for t in frame["text"].tolist()]
            for a, b in slices(texts, 1_000_000):
                found = [[] for _ in range(a, b)]
                spans = shared.value.spans([t.encode("utf-8", "surrogatepass") for t in texts[a:b]])
                for text, rule, start, end in zip(*(x.tolist() for x in spans), strict=True):
                    found[text].append({"kind": kinds[rule], "start": start, "end": end})
                yield pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64"), "spans": found})

    return run


def find_secrets(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, spans: array of (kind, start, end), by start and then kind, for every row."""
    small_batches(docs.sparkSession)
    given = docs.select(spelled(), "text")
    shared = docs.sparkSession.sparkContext.broadcast(scanner(kinds))  # some megabytes, whatever the corpus
    return given.mapInPandas(tidied(_scanned(kinds, shared)), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def listed(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
