"""One deterministic automaton for many patterns, run over all chunks of a batch at once.

Patterns are written with literals, classes [a-z], groups, | ? * + and {m,n}. They are joined into one
nondeterministic automaton (Thompson) with a loop at its start, and made deterministic by subsets over byte
classes. Texts are cut into chunks of equal width that overlap by the longest match, the chunks' states step
forward column by column, and a hit's absolute position is deduplicated between neighbouring chunks.
"""

from __future__ import annotations

import numpy as np

OTHER = 128  # every byte beyond ASCII


def _folded(chars: set[int]) -> set[int]:
    return chars | {ord(chr(x).swapcase()) for x in chars if x < 128 and chr(x).isalpha()}


def _class(spec: str, fold: bool) -> frozenset[int]:
    negated, out, i = spec.startswith("^"), set(), 0
    spec = spec[negated:]
    while i < len(spec):
        if spec[i] == "\\":
            i += 1
            out.add({"s": 32, "n": 10, "t": 9}.get(spec[i], ord(spec[i])))
        elif i + 2 < len(spec) and spec[i + 1] == "-":
            out.update(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 2
        else:
            out.add(ord(spec[i]))
        i += 1
    if fold:
        out = _folded(out)
    return frozenset(range(129)) - out if negated else frozenset(out)


class Automaton:
    def __init__(self, patterns: list[str], ignore_case: bool = True) -> None:
        self.next: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.fold = ignore_case
        start = self._state()
        accept = {}
        for number, pattern in enumerate(patterns):
            self._text, self._at = pattern, 0
            first, last = self._alternatives()
            assert self._at == len(pattern), (pattern, self._at)
            self.free[start].append(first)
            accept[last] = number
        self.next[start].append((frozenset(range(129)), start))
        self._determine(start, accept)

    def _state(self) -> int:
        self.next.append([])
        self.free.append([])
        return len(self.next) - 1

    def _alternatives(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            x, y = self._sequence()
            self.free[a].append(x)
            self.free[y].append(b)
            if self._at < len(self._text) and self._text[self._at] == "|":
                self._at += 1
                continue
            return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self._state()
        while self._at < len(self._text) and self._text[self._at] not in "|)":
            begin = self._at
            x, y = self._atom()
            after = self._at
            low, high = 1, 1
            rest = self._text[after:]
            if rest[:1] in ("?", "*", "+"):
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[rest[0]]
                after += 1
            elif rest.startswith("{"):
                end = rest.index("}")
                parts = rest[1:end].split(",")
                low, high = int(parts[0]), int(parts[-1]) if parts[-1] else None
                after += end + 1
            count = max(low, 1) if high is None else high
            for i in range(count):
                if i:
                    self._at = begin
                    x, y = self._atom()
                self.free[b].append(x)
                if i >= low:
                    self.free[x].append(y)
                if high is None and i == count - 1:
                    self.free[y].append(x)
                b = y
            self._at = after
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._text[self._at]
        self._at += 1
        if c == "(":
            x, y = self._alternatives()
            self._at += 1
            return x, y
        if c == "[":
            end = self._at
            while self._text[end] != "]" or self._text[end - 1] == "\\":
                end += 1
            chars = _class(self._text[self._at : end], self.fold)
            self._at = end + 1
        else:
            if c == "\\":
                c = self._text[self._at]
                self._at += 1
            chars = frozenset(_folded({ord(c)}) if self.fold else {ord(c)})
        x, y = self._state(), self._state()
        self.next[x].append((chars, y))
        return x, y

    def _closure(self, states: frozenset[int]) -> frozenset[int]:
        out, stack = set(states), list(states)
        while stack:
            for t in self.free[stack.pop()]:
                if t not in out:
                    out.add(t)
                    stack.append(t)
        return frozenset(out)

    def _determine(self, start: int, accept: dict[int, int]) -> None:
        first = self._closure(frozenset([start]))
        numbers, todo, rows, hits = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            row = np.zeros(129, np.int32)
            moves: dict[int, set[int]] = {}
            for s in now:
                for chars, t in self.next[s]:
                    for c in chars:
                        moves.setdefault(c, set()).add(t)
            made: dict[frozenset[int], int] = {}
            for c, targets in moves.items():
                key = frozenset(targets)
                if key not in made:
                    then = self._closure(key)
                    if then not in numbers:
                        numbers[then] = len(numbers)
                        todo.append(then)
                    made[key] = numbers[then]
                row[c] = made[key]
            rows.append(row)
            hits.append(any(s in accept for s in now))
        table = np.stack(rows)
        # bytes that behave alike share a column
        _, columns = np.unique(table, axis=1, return_inverse=True)
        width = int(columns.max()) + 1
        small = np.zeros((len(rows), width), np.int32)
        small[:, columns.ravel()] = table
        self.width = width
        self.columns = np.zeros(256, np.int32)
        self.columns[:128] = columns.ravel()[:128]
        self.columns[128:] = columns.ravel()[OTHER]
        self.table = (small * width).ravel()
        self.hits = np.array(hits)

    def ends(self, data: bytes, chunk: int = 1024, overlap: int = 128) -> np.ndarray:
        """Sorted positions of the bytes at which a match ends; matches are at most ``overlap`` bytes long."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        count = -(-n // chunk)
        codes = np.zeros(overlap + count * chunk, np.int32)
        codes[overlap : overlap + n] = self.columns[np.frombuffer(data, np.uint8)]
        codes[overlap + n :] = self.columns[10]
        codes[:overlap] = self.columns[10]
        # row i holds chunk i and the overlap before it, columns lie one behind the other in memory
        view = np.lib.stride_tricks.as_strided(codes, (count, overlap + chunk), (codes.itemsize * chunk, codes.itemsize))
        steps = np.ascontiguousarray(view.T)
        state = np.zeros(count, np.int32)
        found = []
        for i in range(overlap + chunk):
            state = self.table.take(state + steps[i])
            if i >= overlap:
                at = np.flatnonzero(self.hits.take(state // self.width))
                if len(at):
                    found.append(at * chunk + (i - overlap))
        ends = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return ends[ends < n]
