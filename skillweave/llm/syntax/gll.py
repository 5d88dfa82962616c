"""A generalised LL recogniser with a graph-structured stack, over bracket-structured input.

Rules are regular right-hand sides, compiled to automata; every state has a table from the next token to the
moves that can go on (FIRST and FOLLOW sets). A state with one move runs on without a descriptor. A state with
several puts descriptors on the work list; rule calls are nodes of a graph-structured stack, shared by all
callers at a position, with the positions at which the call has ended.

Brackets nest in every grammar here, so the lexer folds each bracketed stretch into one token. A rule's
bracket move asks whether the stretch derives from the rule inside the brackets, which is decided by the same
engine and remembered by content: identifiers and literals are one token each, so short stretches recur all
over a collection. Lists of statements are cut after semicolons and blocks; a cut that does not parse is
tried as a whole, so cutting never rejects.

Notation: 'lit' is a token, UPPER a token class, Name a rule, NAME any word, with | * + ? and parentheses;
what stands between '(' and ')' (or [ ] { } INDENT DEDENT, '${' }, TEMPLATE END, JSX END, FSTR END) is the bracket's content.
"""

from __future__ import annotations

import re

PAIRS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT", "${": "}", "TEMPLATE": "END", "JSX": "END", "FSTR": "END"}
EOF = 0
BASE = 10_000
MOST = 400_000

_SCAN = re.compile(r"'([^']+)'|([A-Za-z_]\w*)|([()|*+?;=])|\s+|#.*")


#: bracketed stretches within one another that are decided by recursion; deeper ones are put off, see accepts
LEVELS = 60


class _TooDeep(Exception):
    """The (rule, group) that must be decided before what holds it."""


class _Node:
    __slots__ = ("edges", "ends")

    def __init__(self, edge: tuple | None) -> None:
        self.edges: list[tuple] = [edge] if edge else []
        self.ends: list[int] = []


class Grammar:
    def __init__(self, text: str, starts: list[str], contextual: str = "", lists: str = "") -> None:
        """contextual: words that are tokens of their own and may still be identifiers (ID). lists: rules that
        are repetitions of one rule and may be cut."""
        self.terms: dict[str, int] = {"EOF": EOF}
        self.contextual = contextual.split()
        self.lists = set(lists.split())
        self._rules: dict[str, tuple] = {}
        self._parse(text)
        self.rule_ids = {name: i for i, name in enumerate(self._rules)}
        for word in self.contextual:
            self.term(word)
        self._compile(starts)
        self.keywords = {t for t in self.terms if re.fullmatch(r"[A-Za-z_]\w*", t) and not t.isupper()}
        self.groups: list[tuple[int, tuple]] = []
        self._group_ids: dict[tuple[int, tuple], int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        self._segments: dict[tuple[int, tuple], bool] = {}
        self._level = 0

    def term(self, name: str) -> int:
        return self.terms.setdefault(name, len(self.terms))

    # the notation

    def _parse(self, text: str) -> None:
        items = [(m[1], m[2], m[3]) for m in _SCAN.finditer(text) if m.lastindex]
        assert not re.sub(_SCAN, "", text), re.sub(_SCAN, "", text)[:80]
        pos = 0

        def alternatives(closing: str | None) -> tuple:
            nonlocal pos
            options = [sequence(closing)]
            while pos < len(items) and items[pos][2] == "|":
                pos += 1
                options.append(sequence(closing))
            return ("alt", options) if len(options) > 1 else options[0]

        def sequence(closing: str | None) -> tuple:
            nonlocal pos
            parts = []
            while pos < len(items):
                literal, name, sign = items[pos]
                if (literal or name) == closing and closing is not None and not sign:
                    break
                if sign in ("|", ")", ";"):
                    break
                pos += 1
                if sign == "(":
                    part = alternatives(None)
                    assert items[pos][2] == ")", items[pos - 5 : pos + 5]
                    pos += 1
                elif literal in PAIRS or name in PAIRS:
                    kind = literal or name
                    inner = alternatives(PAIRS[kind])
                    pos += 1
                    rule = f"{kind}{len(self._rules)}"
                    if inner[0] == "rule":
                        rule = inner[1]
                    else:
                        self._rules[rule] = inner
                    part = ("group", kind, rule)
                elif literal or (name.isupper() and name != "NAME"):
                    part = ("term", literal or name)
                elif name == "NAME":
                    part = ("name",)
                else:
                    part = ("rule", name)
                while pos < len(items) and items[pos][2] in ("*", "+", "?"):
                    part = (items[pos][2], part)
                    pos += 1
                parts.append(part)
            return parts[0] if len(parts) == 1 else ("seq", parts)

        while pos < len(items):
            name = items[pos][1]
            assert items[pos + 1][2] == "=", (name, items[pos : pos + 3])
            pos += 2
            self._rules[name] = ()
            self._rules[name] = alternatives(None)
            assert items[pos][2] == ";", (name, items[pos])
            pos += 1

    # rules to automata

    def _compile(self, starts: list[str]) -> None:
        for ast in list(self._rules.values()):
            self._terms_of(ast)
        words = [t for t in self.terms if re.fullmatch(r"[A-Za-z_]\w*", t) and not t.isupper()]
        self.name_terms = [self.term(w) for w in words] + [self.term("ID")]
        edges: list[list[tuple]] = []
        blank: list[list[int]] = []

        def state() -> int:
            edges.append([])
            blank.append([])
            return len(edges) - 1

        def build(ast: tuple, a: int, b: int) -> None:
            kind = ast[0] if ast else "seq"
            if kind == "seq":
                parts = ast[1] if ast else []
                for i, part in enumerate(parts):
                    c = b if i == len(parts) - 1 else state()
                    build(part, a, c)
                    a = c
                if not parts:
                    blank[a].append(b)
            elif kind == "alt":
                for option in ast[1]:
                    build(option, a, b)
            elif kind in "*+?":
                c, d = state(), state()
                build(ast[1], c, d)
                blank[a].append(c)
                blank[d].append(b)
                if kind != "+":
                    blank[a].append(b)
                if kind != "?":
                    blank[d].append(c)
            elif kind == "term":
                for t in [ast[1]] + (self.contextual if ast[1] == "ID" else []):
                    edges[a].append(("t", self.term(t), b))
            elif kind == "name":
                edges[a].extend(("t", t, b) for t in self.name_terms)
            elif kind == "group":
                edges[a].append(("g", self.term(ast[1]), b, self.rule_ids[ast[2]]))
            else:
                edges[a].append(("c", self.rule_ids[ast[1]], b))

        start, final = [], []
        for ast in self._rules.values():
            a, b = state(), state()
            build(ast, a, b)
            start.append(a)
            final.append(b)
        accepting = set(final)
        owner: dict[int, int] = {}
        closed: dict[int, tuple[list[tuple], bool]] = {}
        for rule, first in enumerate(start):
            todo = [first]
            while todo:
                s = todo.pop()
                if s in closed:
                    continue
                reach, stack = {s}, [s]
                while stack:
                    for t in blank[stack.pop()]:
                        if t not in reach:
                            reach.add(t)
                            stack.append(t)
                out = [e for t in sorted(reach) for e in edges[t]]
                closed[s] = list(dict.fromkeys(out)), bool(reach & accepting)
                owner[s] = rule
                todo.extend(e[2] for e in out)
        n = len(start)
        first: list[set[int]] = [set() for _ in range(n)]
        nullable = [closed[s][1] for s in start]
        follow: list[set[int]] = [set() for _ in range(n)]
        for name in starts:
            follow[self.rule_ids[name]].add(EOF)
        for out, _ in closed.values():
            for e in out:
                if e[0] == "g":
                    follow[e[3]].add(EOF)

        def ahead(s: int) -> tuple[set[int], bool]:
            out, end = closed[s]
            keys: set[int] = set()
            for e in out:
                if e[0] != "c":
                    keys.add(e[1])
                else:
                    keys |= first[e[1]]
                    if nullable[e[1]]:
                        more, over = ahead_of.get(e[2], (set(), False))
                        keys |= more
                        end = end or over
            return keys, end

        ahead_of: dict[int, tuple[set[int], bool]] = {}
        changed = True
        while changed:
            changed = False
            for s in closed:
                new = ahead(s)
                if ahead_of.get(s) != new:
                    ahead_of[s] = new
                    changed = True
            for rule, s in enumerate(start):
                keys, end = ahead_of[s]
                if keys != first[rule] or end != nullable[rule]:
                    first[rule], nullable[rule] = set(keys), end
                    changed = True
        changed = True
        while changed:
            changed = False
            for s, (out, _) in closed.items():
                for e in out:
                    if e[0] == "c":
                        keys, end = ahead_of[e[2]]
                        new = keys | (follow[owner[s]] if end else set())
                        if not new <= follow[e[1]]:
                            follow[e[1]] |= new
                            changed = True
        self.start = start
        self.table: list[dict[int, tuple]] = [{} for _ in edges]
        for s, (out, end) in closed.items():
            moves: dict[int, list[tuple]] = {}
            for e in out:
                if e[0] == "t":
                    moves.setdefault(e[1], []).append((0, e[2]))
                elif e[0] == "g":
                    moves.setdefault(e[1], []).append((1, e[2], e[3]))
                else:
                    keys = set(first[e[1]])
                    if nullable[e[1]]:
                        more, over = ahead_of[e[2]]
                        keys |= more | (follow[owner[s]] if over else set())
                    for k in keys:
                        moves.setdefault(k, []).append((2, e[2], e[1]))
            if end:
                for k in follow[owner[s]]:
                    moves.setdefault(k, []).append((3,))
            self.table[s] = {k: tuple(dict.fromkeys(v)) for k, v in moves.items()}

    def _terms_of(self, ast: tuple) -> None:
        if not ast:
            return
        if ast[0] in ("term", "group"):
            self.term(ast[1])
        elif ast[0] in ("seq", "alt"):
            for x in ast[1]:
                self._terms_of(x)
        elif ast[0] in "*+?":
            self._terms_of(ast[1])

    # recognising

    def group(self, kind: int, content: tuple) -> int:
        key = (kind, content)
        found = self._group_ids.get(key)
        if found is None:
            found = self._group_ids[key] = BASE + len(self.groups)
            self.groups.append(key)
        return found

    def rest(self) -> None:
        """Forget what was remembered once it is much; only between files."""
        if len(self.groups) > MOST or len(self._segments) > MOST:
            self.groups.clear()
            self._group_ids.clear()
            self._known.clear()
            self._segments.clear()

    def accepts(self, rule: str, content: tuple) -> bool:
        """Nesting may have any depth: what lies too deep is decided first and remembered, then what holds it is
        decided again, from the innermost to the outermost."""
        put_off: list[tuple[int, int]] = []
        while True:
            self._level = 0
            try:
                if not put_off:
                    return self._derives(self.rule_ids[rule], content)
                self.inside(*put_off[-1])
                put_off.pop()
            except _TooDeep as e:
                put_off.append(e.args[0])

    def inside(self, rule: int, group: int) -> bool:
        key = (rule, group)
        known = self._known.get(key)
        if known is None:
            if self._level >= LEVELS:
                raise _TooDeep(key)
            self._level += 1
            known = self._known[key] = self._derives(rule, self.groups[group - BASE][1])
            self._level -= 1
        return known

    cut_after: frozenset[int] = frozenset()
    cut_blocks: frozenset[int] = frozenset()
    joins: frozenset[int] = frozenset()
    openers: frozenset[int] = frozenset()

    def cutting(self, after: str, joins: str, openers: str, blocks: str = "{") -> Grammar:
        """Cut lists after the tokens ``after`` unless one of ``joins`` follows, and after a block if one of
        ``openers`` follows."""
        ids = lambda words: frozenset(self.terms[w] for w in words.split() if w in self.terms)
        self.cut_after, self.joins, self.openers, self.cut_blocks = ids(after), ids(joins), ids(openers), ids(blocks)
        self.list_ids = frozenset(self.rule_ids[x] for x in self.lists)
        return self

    list_ids: frozenset[int] = frozenset()

    def _derives(self, rule: int, content: tuple) -> bool:
        if rule not in self.list_ids or len(content) < 4:
            return self._run(rule, content)
        groups, begin, last = self.groups, 0, len(content) - 1
        for i, t in enumerate(content):
            if i == last:
                cut = True
            elif t >= BASE:
                after = content[i + 1]
                cut = groups[t - BASE][0] in self.cut_blocks and after in self.openers
            elif t in self.cut_after:
                after = content[i + 1]
                cut = after not in self.joins
            else:
                continue
            if cut:
                part = content[begin : i + 1]
                begin = i + 1
                key = (rule, part)
                known = self._segments.get(key)
                if known is None:
                    known = self._segments[key] = self._run(rule, part)
                if not known:
                    return self._run(rule, content)
        return True

    def _run(self, rule: int, content: tuple) -> bool:
        n, table, start, groups = len(content), self.table, self.start, self.groups
        keys = [t if t < BASE else groups[t - BASE][0] for t in content]
        keys.append(EOF)
        root = _Node(None)
        nodes = {(rule, 0): root}
        seen: set[tuple] = set()
        moves = table[start[rule]].get(keys[0])
        if moves is None:
            return False
        work = [(m, root, 0) for m in moves]
        while work:
            move, node, pos = work.pop()
            while True:
                op = move[0]
                if op == 0:
                    pos += 1
                    state = move[1]
                elif op == 2:
                    key = (move[2], pos)
                    callee = nodes.get(key)
                    if callee is None:
                        callee = nodes[key] = _Node((move[1], node))
                        node = callee
                        state = start[move[2]]
                    else:
                        edge = (move[1], node)
                        if edge in callee.edges:
                            break
                        callee.edges.append(edge)
                        state = move[1]
                        for end in callee.ends:
                            for m in table[state].get(keys[end], ()):
                                work.append((m, node, end))
                        break
                elif op == 1:
                    if not self.inside(move[2], content[pos]):
                        break
                    pos += 1
                    state = move[1]
                else:
                    if pos in node.ends:
                        break
                    if node is root and pos == n:
                        return True
                    node.ends.append(pos)
                    k = keys[pos]
                    for state, caller in node.edges:
                        for m in table[state].get(k, ()):
                            work.append((m, caller, pos))
                    break
                moves = table[state].get(keys[pos])
                if moves is None:
                    break
                move = moves[0]
                if len(moves) > 1:
                    mark = (state, id(node), pos)
                    if mark in seen:
                        break
                    seen.add(mark)
                    for m in moves[1:]:
                        work.append((m, node, pos))
        return False
