"""Lexers: a text becomes one nested token sequence, or None if it has no valid tokens or brackets.

Brackets are folded by ``Grammar.group``. Where line ends matter they become tokens: NL in Python and YAML,
inserted semicolons in Go, ASI in JavaScript and TypeScript.
"""

from __future__ import annotations

import re
from functools import lru_cache

from skillweave.llm.syntax import grammars as G
from skillweave.llm.syntax.gll import BASE, Grammar

_CONFLICT = r"^(?:<<<<<<<|>>>>>>>|\|\|\|\|\|\|\||=======)(?=[ \r\n]|$)"
_ID = r"(?:[^\W\d]|\$)(?:\w|[$\u0300-\u036f\u0900-\u0dff\u200c\u200d])*"
_SLASHES = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_STR = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_CHR = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_NUM = r"0[xX][0-9a-fA-F_']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?\w*|0[bB][01_']+\w*|0[oO][0-7_]+\w*|(?:\d[\d_']*\.?(?!\.)(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[A-Za-z]*\d*"


class Lexer:
    """pattern has the groups skip (1), conflict (2), word (3), number (4), string (5), character (6), then
    the language's own, named like token classes, and op last."""

    def __init__(self, grammar: tuple, own: str, ops: str, strings: str, chars: str, skip: str, number: str = _NUM, prefix: str = "") -> None:
        text, starts, contextual, lists = grammar
        self.grammar = Grammar(text, starts, contextual, lists)
        t = self.grammar.terms
        before = rf"(?!{prefix}[\"'])" if prefix else ""
        ops = "|".join(re.escape(x) for x in sorted(ops.split(), key=len, reverse=True))
        self.pattern = re.compile(
            rf"((?:[^\S\n]+|\n|{skip})+)|({_CONFLICT})|({before}{_ID})|({number})|({strings})|(?P<_char>{chars})|{own}(?P<op>{ops})",
            re.M,
        )
        self.op_ids = {x: self.grammar.term(x) for x in [y for y in re.findall(r"\S+", " ".join(self._unescape(ops)))]}
        self.words = {w: t[w] for w in self.grammar.keywords}
        self.id, self.num, self.str, self.chr = (self.grammar.term(x) for x in ("ID", "NUM", "STR", "CHAR"))
        self.asi = self.grammar.term("ASI")
        self.open = {"(": t.get("(", -1), "[": t.get("[", -1), "{": t.get("{", -1)}
        self.own_ids = {n: self.grammar.term(n) for n in self.pattern.groupindex if n.isupper()}
        self.chr_index = self.pattern.groupindex["_char"]
        self.op_index = self.pattern.groupindex["op"]
        self.names = {i: n for n, i in self.pattern.groupindex.items()}

    @staticmethod
    def _unescape(ops: str) -> list[str]:
        return [re.sub(r"\\(.)", r"\1", x) for x in re.split(r"(?<!\\)\|", ops)]

    def lex(self, text: str) -> tuple | None:
        raise NotImplementedError


class BraceLexer(Lexer):
    """Languages whose line ends mean nothing."""

    def prepare(self, text: str) -> str:
        return text

    def lex(self, text: str) -> tuple | None:
        text = self.prepare(text)
        stack: list[tuple[str, list[int]]] = []
        out: list[int] = []
        words, ops, group = self.words, self.op_ids, self.grammar.group
        at, last_op, chr_index, n = 0, self.op_index, self.chr_index, len(text)
        for m in self.pattern.finditer(text):
            if m.start() != at:
                return None
            at = m.end()
            k = m.lastindex
            if k == 1:
                continue
            if k == 3:
                out.append(words.get(m[3], self.id))
            elif k == last_op:
                op = m[k]
                if op in "([{":
                    stack.append((op, out))
                    out = []
                elif op in ")]}":
                    if not stack:
                        return None
                    kind, outer = stack.pop()
                    if kind != {")": "(", "]": "[", "}": "{"}[op]:
                        return None
                    outer.append(group(self.open[kind], tuple(out)))
                    out = outer
                else:
                    out.append(ops[op])
            elif k == 4:
                out.append(self.num)
            elif k == 5:
                out.append(self.str)
            elif k == chr_index:
                out.append(self.chr)
            elif k == 2:
                return None
            else:
                out.append(self.own_ids[self.names[k]])
        return tuple(out) if at == n and not stack else None


class CLexer(BraceLexer):
    _DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)(?:[^\n\\]|\\(?:\r?\n|.)|/\*(?:[^*]|\*(?!/))*\*/)*", re.M)
    _KNOWN = set("include define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line import include_next embed".split()) | {""}

    def prepare(self, text: str) -> str:
        if "#" not in text:
            return text
        return self._DIRECTIVE.sub(lambda m: "\n" * m[0].count("\n") if m[1] in self._KNOWN else m[0], text)


class CppLexer(CLexer):
    pass


class RustLexer(BraceLexer):
    def prepare(self, text: str) -> str:
        return re.sub(r"\A#!(?!\[)[^\n]*", "", text)


class GoLexer(BraceLexer):
    """Inserts semicolons at line ends after what can end a statement, and before a closing bracket on the
    same line, where they may be left out."""

    def lex(self, text: str) -> tuple | None:
        stack: list[tuple[str, list[int]]] = []
        out: list[int] = []
        words, ops, group = self.words, self.op_ids, self.grammar.group
        semi, chr_index = ops[";"], self.chr_index
        enders = {self.id, self.num, self.str, self.chr, ops["++"], ops["--"]} | {
            words[w] for w in ("break", "continue", "fallthrough", "return")
        }
        at = 0
        for m in self.pattern.finditer(text + "\n"):
            if m.start() != at:
                return None
            at = m.end()
            k = m.lastindex
            if k == 1:
                if out and "\n" in m[1] and (out[-1] >= BASE or out[-1] in enders):
                    out.append(semi)
            elif k == 3:
                out.append(words.get(m[3], self.id))
            elif k == self.op_index:
                op = m[k]
                if op in "([{":
                    stack.append((op, out))
                    out = []
                elif op in ")]}":
                    if not stack:
                        return None
                    kind, outer = stack.pop()
                    if kind != {")": "(", "]": "[", "}": "{"}[op]:
                        return None
                    if op == "}" and out and out[-1] != semi:
                        out.append(semi)
                    outer.append(group(self.open[kind], tuple(out)))
                    out = outer
                else:
                    out.append(ops[op])
            elif k == 4:
                out.append(self.num)
            elif k == 5:
                out.append(self.str)
            elif k == chr_index:
                out.append(self.chr)
            else:
                return None
        return tuple(out) if at == len(text) + 1 and not stack else None


_STARTERS = (
    "const let var type export interface import return if for while switch throw try declare abstract public private "
    "protected readonly static enum namespace }"
).split()


class ScriptLexer(Lexer):
    """JavaScript and TypeScript: regular expressions, templates and JSX by context, ASI at line ends."""

    _REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
    _TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|(\$\{))")
    _IN_TAG = re.compile(r"(?:[^/>{\"'<]|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")
    _IN_TEXT = re.compile(r"[^<{]*")
    _OPEN, _CLOSE = re.compile(r"<\s*([\w.:$-]*)"), re.compile(r"</\s*([\w.:$-]*)\s*>")
    _ARGS = re.compile(r"<[^<>]*>")
    _PLAIN, _QUOTED = re.compile(r"[^`{}\"']*"), re.compile(rf"{_STR}|{_CHR}")
    _GOES_ON = set(". , ; ) ] } ? : = == === != !== + - * / % & | ^ && || ?? => ?. < > <= >= ( [ ` += -= *= instanceof in of as satisfies is else catch finally extends implements".split())

    def __init__(self, *a: object, jsx: bool = False) -> None:
        super().__init__(*a)
        self.jsx = jsx
        w, o = self.words, self.op_ids
        self.operand = {self.id, self.num, self.str, *(self.grammar.term(x) for x in ("TEMPLATE", "REGEX", "JSX", "PRIVATE"))}
        self.operand |= {w[x] for x in ("this", "super", "null", "true", "false")} | {w[x] for x in self.grammar.contextual if x in w}
        self.enders = self.operand | {o["++"], o["--"], w["break"], w["continue"], w["return"], w["debugger"]}
        for x in ("await", "of", "as", "async", "extends", "implements", "is", "keyof", "yield", "from"):
            self.operand.discard(w.get(x, -1))
        # in TypeScript ! and > may end an expression or a type
        self.starters = frozenset(_STARTERS) if "interface" in w and a[0] is G.TYPESCRIPT else frozenset()
        if self.starters:
            self.enders.add(o["!"])
        self.angle = o[">"]
        self.template, self.regex, self.jsx_id, self.hole = (self.grammar.term(x) for x in ("TEMPLATE", "REGEX", "JSX", "${"))

    @classmethod
    def _markup(cls, text: str, i: int, open_: list[list]) -> tuple[int, str]:
        """Reads JSX on from i: the index of the next expression's brace and "hole", the index behind the element and
        "done", or "bad". open_ holds [name, whether inside its tag] of the elements that are open."""
        while True:
            name, tag = open_[-1]
            i = (cls._IN_TAG if tag else cls._IN_TEXT).match(text, i).end()
            if i >= len(text):
                return i, "bad"
            c = text[i]
            if c == "{":
                return i, "hole"
            if not tag:
                if text.startswith("</", i):
                    m = cls._CLOSE.match(text, i)
                    if not m or m[1] != name:
                        return i, "bad"
                    open_.pop()
                    i = m.end()
                else:
                    m = cls._OPEN.match(text, i)
                    open_.append([m[1], True])
                    i = m.end()
            elif c in "\"'":
                i = text.find(c, i + 1) + 1
                if not i:
                    return i, "bad"
            elif c == "<":
                # an element as an attribute's value, or the type arguments of the tag
                before = i - 1
                while text[before].isspace():
                    before -= 1
                m = cls._OPEN.match(text, i) if text[before] == "=" else None
                if m:
                    open_.append([m[1], True])
                else:
                    m = cls._ARGS.match(text, i)
                    if not m:
                        return i, "bad"
                i = m.end()
            elif text.startswith("/>", i):
                open_.pop()
                i += 2
            elif c == ">":
                open_[-1][1] = False
                i += 1
            else:
                return i, "bad"
            if not open_:
                return i, "done"

    def template_end(self, text: str, at: int) -> int:
        """Index behind the template that begins at ``at``, by its quotes and braces alone, or -1."""
        open_, i, n = ["`"], at + 1, len(text)
        while open_ and i < n:
            if open_[-1] == "`":
                m = self._TEMPLATE.match(text, i)
                if not m:
                    return -1
                i = m.end()
                if m[1]:
                    open_.append("{")
                else:
                    open_.pop()
                continue
            i = self._PLAIN.match(text, i).end()
            c = text[i : i + 1]
            if c in ("{", "`"):
                open_.append(c)
            elif c == "}":
                open_.pop()
            elif c:
                quoted = self._QUOTED.match(text, i)
                i = quoted.end() - 1 if quoted else i
            i += 1
        return -1 if open_ else i

    def lex(self, text: str) -> tuple | None:
        if text.startswith("#!"):
            text = "//" + text[2:]
        stack: list[tuple] = []
        out: list[int] = []
        words, ops, group, enders = self.words, self.op_ids, self.grammar.group, self.enders
        asi, semi, goes_on, op_index = self.asi, ops[";"], self._GOES_ON, self.op_index
        at, n, line_end = 0, len(text), False
        angle, starters = self.angle, self.starters

        def read_on(at: int) -> int:
            """Reads the template or the markup on the stack's top on; the index at which code goes on, or -1."""
            nonlocal out
            kind, outer, open_ = stack[-1]
            if kind == "`":
                m = self._TEMPLATE.match(text, at)
                if not m:
                    return -1
                at, what = m.end(), "hole" if m[1] else "done"
            else:
                at, what = self._markup(text, at, open_)
                at += what == "hole"
            if what == "bad":
                return -1
            if what == "hole":
                stack.append(("${", out, None))
                out = []
            else:
                stack.pop()
                outer.append(group(self.template if kind == "`" else self.jsx_id, tuple(out)))
                out = outer
            return at

        while at < n:
            again = False
            for m in self.pattern.finditer(text, at):
                if m.start() != at:
                    return None
                k = m.lastindex
                if k == 1:
                    at = m.end()
                    line_end = line_end or "\n" in m[1]
                    continue
                if line_end:
                    line_end = False
                    if out and m[0] not in goes_on and (
                        out[-1] >= BASE or out[-1] in enders or (out[-1] == angle and m[0] in starters)
                    ):
                        out.append(asi)
                if k == 3:
                    out.append(words.get(m[3], self.id))
                elif k == op_index:
                    op = m[k]
                    if op in "([{":
                        stack.append((op, out, None))
                        out = []
                    elif op in ")]}":
                        if not stack:
                            return None
                        kind, outer, _ = stack.pop()
                        if kind == "${" and op == "}":
                            outer.append(group(self.hole, tuple(out)))
                            out = outer
                            at, again = read_on(m.end()), True
                            break
                        if kind != {")": "(", "]": "[", "}": "{"}[op]:
                            return None
                        if op == "}" and out and out[-1] != semi and out[-1] != asi and (
                            out[-1] >= BASE or out[-1] in enders or (starters and out[-1] == angle)
                        ):
                            out.append(asi)
                        outer.append(group(self.open[kind], tuple(out)))
                        out = outer
                    elif op == "`":
                        stack.append(("`", out, None))
                        out = []
                        at, again = read_on(m.end()), True
                        break
                    elif op in ("/", "/=") and not (out and (out[-1] >= BASE or out[-1] in self.operand)):
                        found = self._REGEX.match(text, at)
                        if not found:
                            return None
                        out.append(self.regex)
                        at, again = found.end(), True
                        break
                    elif op == "<" and self.jsx and not (out and (out[-1] >= BASE or out[-1] in self.operand)) and re.match(r"<(?:[A-Za-z][\w.:-]*[\s/><]|>)", text[at : at + 80]):
                        tag = self._OPEN.match(text, at)
                        stack.append(("jsx", out, [[tag[1], True]]))
                        out = []
                        at, again = read_on(tag.end()), True
                        break
                    else:
                        out.append(ops[op])
                elif k == 4:
                    out.append(self.num)
                elif k in (5, 6):
                    out.append(self.str)
                elif k == 2:
                    return None
                else:
                    out.append(self.own_ids[self.names[k]])
                at = m.end()
            if at < 0:
                return None
            if not again:
                break
        if at != n or stack:
            return None
        if out and out[-1] != semi and out[-1] != asi:
            out.append(asi)
        return tuple(out)


class PythonLexer(Lexer):
    """Indentation as brackets; an f-string holds the tokens of its fields."""

    _OPENED = re.compile(r"(\w*)(\"\"\"|'''|[\"'])")
    _OUTSIDE = re.compile(r"[^{}\\]*")
    _WITHIN = re.compile(r"[^{}()\[\]\"'!:=]*")
    _CONVERTED = re.compile(r"![rsa]\s*(?=[:}])")
    _SHOWN = re.compile(r"=\s*(?=[!:}])")

    def _fields(self, literal: str) -> list[str] | None:
        """The expressions in an f-string's fields, None if it is none."""
        prefix, quote = self._OPENED.match(literal).groups()
        text, raw = literal[len(prefix) + len(quote) : -len(quote)], "r" in prefix.lower()
        found: list[str] = []
        # how many fields' format specifications are open
        at, depth, n = 0, 0, len(text)
        while True:
            at = self._OUTSIDE.match(text, at).end()
            if at >= n:
                return None if depth else found
            c = text[at]
            if c == "\\":
                named = None if raw else re.compile(r"\\N\{[^}]*\}").match(text, at)
                # a backslash doesn't escape a brace
                at = named.end() if named else at + (1 if raw or text[at + 1 : at + 2] in ("{", "}") else 2)
            elif not depth and text[at + 1 : at + 2] == c:
                at += 2
            elif c == "}":
                if not depth:
                    return None
                depth -= 1
                at += 1
            else:
                begin = at + 1
                at = self._expression_end(text, begin)
                if at < 0 or not text[begin:at].strip():
                    return None
                found.append(text[begin:at])
                shown = self._SHOWN.match(text, at)
                at = shown.end() if shown else at
                converted = self._CONVERTED.match(text, at)
                at = converted.end() if converted else at
                if text[at : at + 1] not in (":", "}"):
                    return None
                depth += text[at] == ":"
                at += 1

    def _expression_end(self, text: str, at: int) -> int:
        """Index at which a field's expression ends, -1 if it has no end."""
        depth = 0
        while True:
            at = self._WITHIN.match(text, at).end()
            c = text[at : at + 1]
            if not c:
                return -1
            if c in "\"'":
                quoted = self._QUOTED.match(text, at)
                if not quoted:
                    return -1
                at = quoted.end()
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if not depth:
                    return at if c == "}" else -1
                depth -= 1
            elif not depth and (c == ":" or (c == "!" and text[at + 1 : at + 2] != "=")):
                return at
            elif not depth and c == "=" and text[at - 1] not in "=!<>" and self._SHOWN.match(text, at):
                return at
            at += 1

    def lex(self, text: str) -> tuple | None:
        if text.startswith("﻿"):
            text = text[1:]
        g = self.grammar
        words, ops, group = self.words, self.op_ids, g.group
        nl, indent = g.term("NL"), g.term("INDENT")
        self.hole, self.fstr = g.term("${"), g.term("FSTR")
        depth: list[tuple[str, list[int]]] = []
        blocks: list[tuple[int, list[int]]] = []
        out: list[int] = []
        text += "\n"
        at, n, fresh, column = 0, len(text), True, None
        for m in self.pattern.finditer(text):
            if m.start() != at:
                return None
            at = m.end()
            k = m.lastindex
            if k == 1:
                s = m[1]
                cut = s.rfind("\n")
                if not depth and (cut >= 0 or fresh):
                    if cut >= 0 and re.sub(r"\\\r?\n|#[^\n]*", "", s).find("\n") < 0 and "#" not in s:
                        continue  # only joined lines
                    if out and not fresh:
                        out.append(nl)
                        fresh = True
                    column = self._width(s[cut + 1 :])
                continue
            if fresh:
                fresh = False
                width = column or 0
                if not blocks:
                    blocks.append((width, []))
                if width > blocks[-1][0]:
                    blocks.append((width, out))
                    out = []
                else:
                    while width < blocks[-1][0]:
                        if len(blocks) == 1:
                            return None
                        _, outer = blocks.pop()
                        outer.append(group(indent, tuple(out)))
                        out = outer
                    if width != blocks[-1][0]:
                        return None
            column = None
            if k == 3:
                out.append(words.get(m[3], self.id))
            elif k == self.op_index:
                op = m[k]
                if op in "([{":
                    depth.append((op, out))
                    out = []
                elif op in ")]}":
                    if not depth:
                        return None
                    kind, outer = depth.pop()
                    if kind != {")": "(", "]": "[", "}": "{"}[op]:
                        return None
                    outer.append(group(self.open[kind], tuple(out)))
                    out = outer
                else:
                    out.append(ops[op])
            elif k == 4:
                if m[4][-1].isalpha() and not re.fullmatch(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[\d._]+(?:[eE][+-]?[\d_]+)?[jJ]", m[4]):
                    return None
                out.append(self.num)
            elif k in (5, 6):
                if "{" not in m[0] and "}" not in m[0] or not set("fFtT") & set(self._OPENED.match(m[0])[1]):
                    out.append(self.str)
                    continue
                found = self._fields(m[0])
                inner = None if found is None else [self.lex(f"({x})") for x in found]
                # a field is what stands between one pair of brackets and the line's end
                if inner is None or any(not x or len(x) != 2 or x[0] < BASE for x in inner):
                    return None
                out.append(group(self.fstr, tuple(group(self.hole, g.groups[x[0] - BASE][1]) for x in inner)))
            else:
                return None
        if depth or at != n:
            return None
        if out and out[-1] < BASE and out[-1] != nl:
            out.append(nl)
        elif out and out[-1] >= BASE and g.groups[out[-1] - BASE][0] != indent:
            out.append(nl)
        while len(blocks) > 1:
            _, outer = blocks.pop()
            outer.append(group(indent, tuple(out)))
            out = outer
        return tuple(out)

    @staticmethod
    def _width(s: str) -> int:
        if "\t" not in s and "\f" not in s:
            return len(s)
        width = 0
        for c in s:
            width = width // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else width + 1
        return width


class YamlLexer:
    _QUOTED = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")
    _KEY = re.compile(r"(?:[^\s#\[\]{},\"'&*!|>%@`:?-]|[:?-](?=[^\s]))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]))*[ \t]*:(?=\s|$)")
    _PROP = re.compile(r"(?:&\S+|!\S*)(?=\s|$)[ \t]*")
    _FLOW = re.compile(r"\s+|#[^\n]*|(\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|([\[{])|([\]}])|(,)|(:(?=[\s,\[\]{}\"']|$))|(\*[^\s,\[\]{}]+)|([&!][^\s,\[\]{}]*)|([^\s,\[\]{}:#\"'&*!|>%@`](?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}:#]))*)")

    def __init__(self) -> None:
        text, starts, contextual, lists = G.YAML
        self.grammar = g = Grammar(text, starts, contextual, lists)
        self.t = {x: g.term(x) for x in "KEY NL INDENT DASH PLAIN STR BLOCKTEXT ALIAS PROP FLOWKEY QUESTION MERGE SEPARATOR , [ {".split()}

    def lex(self, text: str) -> tuple | None:
        t, g = self.t, self.grammar
        text = text.replace("\r\n", "\n")
        out: list[int] = []
        levels: list[tuple[float, list[int]]] = [(-1, out)]
        at, n = 0, len(text)

        def level(width: float) -> bool:
            nonlocal out
            while width < levels[-1][0]:
                _, outer = levels.pop()
                outer.append(g.group(t["INDENT"], tuple(out)))
                out = outer
            if width > levels[-1][0]:
                if levels[-1][0] == -1:
                    levels[-1] = (width, out)
                else:
                    levels.append((width, out))
                    out = []
            return width == levels[-1][0]

        while at < n:
            end = text.find("\n", at)
            end = n if end < 0 else end
            line = text[at:end]
            body = line.lstrip(" ")
            if not body.strip() or body[0] == "#":
                at = end + 1
                continue
            if line.startswith(("---", "...")) and (len(line) == 3 or line[3] in " \t"):
                if not level(levels[0][0]):
                    return None
                while len(levels) > 1:
                    _, outer = levels.pop()
                    outer.append(g.group(t["INDENT"], tuple(out)))
                    out = outer
                levels[0] = (-1, out)
                out.append(t["SEPARATOR"])
                rest = line[3:].strip()
                if rest and not rest.startswith("#"):
                    out.extend([t["PLAIN"], t["NL"]])
                at = end + 1
                continue
            if body[0] == "%" and len(body) == len(line) and not out:
                at = end + 1
                continue
            width: float = len(line) - len(body)
            if body[0] == "\t":
                return None
            at += int(width)
            while body[0] == "-" and (len(body) == 1 or body[1] in " \t"):
                if not level(width + 0.5):
                    return None
                out.append(t["DASH"])
                rest = body[1:].lstrip(" ")
                if not rest or rest[0] == "#":
                    body = ""
                    break
                width += len(body) - len(rest)
                at += len(body) - len(rest)
                body = rest
                if not level(width):
                    return None
            if not body:
                out.append(t["NL"])
                at = end + 1
                continue
            if not level(width):
                return None
            key = self._KEY.match(body)
            if not key:
                quoted = self._QUOTED.match(text, at)
                if quoted and re.match(r"[ \t]*:(?=\s|$)", text[quoted.end() :]):
                    at = quoted.end() + re.match(r"[ \t]*:", text[quoted.end() :]).end()
                    out.append(t["KEY"])
                    key = quoted
                elif body.startswith("<<:"):
                    out.append(t["KEY"])
                    at += 3
                    key = True
                elif body.startswith("? "):
                    out.append(t["QUESTION"])
                    at += 2
            else:
                out.append(t["KEY"])
                at += key.end()
            done = self._value(text, at, width, out, bool(key))
            if done < 0:
                return None
            at = done
            out.append(t["NL"])
        while len(levels) > 1:
            _, outer = levels.pop()
            outer.append(g.group(t["INDENT"], tuple(out)))
            out = outer
        return tuple(out)

    def _value(self, text: str, at: int, width: float, out: list[int], keyed: bool) -> int:
        """Tokens of the value at ``at``; index of the next line, or -1."""
        t, n = self.t, len(text)
        while at < n and text[at] in " \t":
            at += 1
        while m := self._PROP.match(text, at):
            out.append(t["PROP"])
            at = m.end()
        if at >= n or text[at] in "\n#":
            end = text.find("\n", at)
            return n if end < 0 else end + 1
        c = text[at]
        if c in "\"'":
            m = self._QUOTED.match(text, at)
            if not m:
                return -1
            out.append(t["STR"])
            at = m.end()
        elif c in "[{":
            at = self._flow(text, at, out)
            if at < 0:
                return -1
        elif c in "|>":
            m = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?(?=\n|\Z)").match(text, at)
            if not m:
                return -1
            out.append(t["BLOCKTEXT"])
            at = m.end() + 1
            while at < n:
                end = text.find("\n", at)
                end = n if end < 0 else end
                line = text[at:end]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= width:
                    break
                at = end + 1
            return at
        elif c == "*":
            end = text.find("\n", at)
            out.append(t["ALIAS"])
            return n if end < 0 else end + 1
        elif c in "@`%&!,]}" or (c in "-?:" and (at + 1 >= n or text[at + 1] in " \n")):
            return -1
        else:
            end = text.find("\n", at)
            end = n if end < 0 else end
            plain = re.sub(r"\s#.*", "", text[at:end])
            if re.search(r":(?:\s|$)", plain):
                return -1
            out.append(t["PLAIN"])
            return end + 1
        end = text.find("\n", at)
        end = n if end < 0 else end
        if not re.fullmatch(r"[ \t]*(?:\s#.*)?", text[at:end]):
            return -1
        return end + 1

    def _flow(self, text: str, at: int, out: list[int]) -> int:
        t, g = self.t, self.grammar
        stack: list[tuple[str, list[int]]] = []
        own: list[int] = []
        while True:
            m = self._FLOW.match(text, at)
            if not m:
                return -1
            at = m.end()
            k = m.lastindex
            if k is None:
                continue
            if k == 2:
                stack.append((m[2], own))
                own = []
            elif k == 3:
                kind, outer = stack.pop()
                if (kind == "[") != (m[3] == "]"):
                    return -1
                outer.append(g.group(t[kind], tuple(own)))
                own = outer
                if not stack:
                    out.extend(own)
                    return at
            else:
                own.append(t[("STR", "", "", ",", "FLOWKEY", "ALIAS", "PROP", "PLAIN")[k - 1]])


_C_OPS = "( ) [ ] { } . , ; : ? = == != <= >= < > << >> <<= >>= + - * / % & | ^ ~ ! && || ++ -- -> ... += -= *= /= %= &= |= ^= ##"
_CPP_OPS = "( ) [ ] { } . , ; : :: ? = == != <= >= <=> < > <<= + - * / % & | ^ ~ ! && || ++ -- -> ->* .* ... += -= *= /= %= &= |= ^= ##"
_JS_OPS = "( ) [ ] { } . , ; : ? ?. = == === != !== <= >= < > <<= + - * / % ** & | ^ ~ ! && || ?? ++ -- => ... += -= *= **= /= %= &= |= ^= &&= ||= ??= @ `"
_PY_OPS = "( ) [ ] { } . , ; : := = == != <= >= < > << >> <<= >>= + - * / // % @ ** & | ^ ~ -> ... += -= *= **= /= //= %= @= &= |= ^="
_RAW = r'(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\((?:[^)]|\)(?!(?P=mark)"))*\)(?P=mark)"|'
_PY_STR = (
    r"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    r"|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"
)


@lru_cache(maxsize=None)
def lexer(dialect: str) -> Lexer | YamlLexer:
    """One lexer, with its grammar, per dialect and process."""
    starters = "if for while do switch return break continue throw try const let var goto"
    if dialect == "c":
        made = CLexer(G.C, r"", _C_OPS, r'(?:u8|[uUL])?' + _STR, r"(?:u8|[uUL])?" + _CHR, rf"{_SLASHES}|\\\r?\n", prefix="(?:u8|[uUL])")
        made.grammar.cutting(";", "else while", "if for while switch return break continue goto static extern const struct typedef int char void unsigned size_t".replace("while ", ""))
    elif dialect in ("cpp", "c+cpp"):
        made = CppLexer(G.CPP if dialect == "cpp" else G.HEADER, r"", _CPP_OPS, _RAW + r'(?:u8|[uUL])?' + _STR, r"(?:u8|[uUL])?" + _CHR, rf"{_SLASHES}|\\\r?\n", prefix="(?:u8|[uUL])?R?")
        made.grammar.cutting(";", "else while catch", "if for switch return break continue goto static inline auto std template namespace class struct using public private protected")
    elif dialect in ("javascript", "typescript"):
        grammar = G.JAVASCRIPT if dialect == "javascript" else G.TYPESCRIPT
        made = ScriptLexer(grammar, rf"(?P<PRIVATE>#{_ID})|", _JS_OPS, _STR, _CHR, _SLASHES, jsx=True) if dialect == "javascript" else ScriptLexer(grammar, rf"(?P<PRIVATE>#{_ID})|", _JS_OPS, _STR, _CHR, _SLASHES)
        made.grammar.cutting("; ASI", "else while catch finally", "if for switch return break continue throw try const let var function export import async class")
    elif dialect == "tsx":
        made = ScriptLexer(G.TYPESCRIPT, rf"(?P<PRIVATE>#{_ID})|", _JS_OPS, _STR, _CHR, _SLASHES, jsx=True)
        made.grammar.cutting("; ASI", "else while catch finally", "if for switch return break continue throw try const let var function export import async class")
    elif dialect == "java":
        ops = "( ) [ ] { } . , ; : :: ? = == != <= >= < > <<= + - * / % & | ^ ~ ! && || ++ -- -> ... += -= *= /= %= &= |= ^= @"
        block = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|'
        made = BraceLexer(G.JAVA, r"", ops, block + r'"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")', _CHR, _SLASHES)
        made.grammar.cutting(";", "else while catch finally", "if for switch return break continue throw try public private protected static final")
    elif dialect == "go":
        ops = "( ) [ ] { } . , ; : = := == != <= >= < > << >> <<= >>= + - * / % & | ^ &^ &^= ~ ! && || ++ -- <- ... += -= *= /= %= &= |= ^="
        made = GoLexer(G.GO, r"", ops, _STR + r"|`[^`]*`", r"'(?:[^'\\\n]|\\[^\n]+?)'", _SLASHES)
        made.grammar.cutting(";", "else", "")
    elif dialect == "rust":
        ops = "( ) [ ] { } . , ; : :: = == != <= >= < > <<= + - * / % & | ^ ~ ! && || -> => .. ..= ... ? # $ @ += -= *= /= %= &= |= ^="
        nested = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
        raw = r'(?:b|c|br|cr|r)?"(?:[^"\\]|\\[\s\S])*"|(?:br|cr|r)(?P<hash>#+)"(?:[^"]|"(?!(?P=hash)))*"(?P=hash)'
        made = RustLexer(
            G.RUST, r"(?P<LIFETIME>'[A-Za-z_]\w*(?!'))|", ops, raw, r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'", nested,
            r"0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w+)?", prefix="(?:b|c|br|cr|r)#*",
        )
        made.grammar.cutting(";", "else", "let fn pub use impl struct enum mod trait if for while loop match return const static")
    elif dialect == "python":
        PythonLexer._QUOTED = re.compile(_PY_STR)
        made = PythonLexer(G.PYTHON, r"", _PY_OPS, _PY_STR, r"(?!)", r"#[^\n]*|\\\r?\n", r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?(?![\w])", prefix="[rRbBuUfFtT]{1,2}")
        made.grammar.cutting("NL", "INDENT elif else except finally", "")
    elif dialect == "json":
        made = BraceLexer(G.JSON, r"", "{ } [ ] , :", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"(?!)", r"(?!)", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
    else:
        made = YamlLexer()
    return made
