"""Where declarations begin at the outermost level of a source text.

The scan is lexical and forgiving: it skips what it cannot read, so that texts that do not parse are cut well
too. A declaration is a function, method, class, struct, union, enum, interface, trait, record or type at
bracket depth 0 that starts a statement.
"""

from __future__ import annotations

import re

from skillweave.llm.syntax.lexers import CLexer, Lexer, PythonLexer, ScriptLexer, lexer

_LEADS = {
    "script": set("export default declare async abstract".split()),
    "java": set("public private protected static final abstract sealed strictfp native synchronized default".split()),
}
_TYPES = set("class struct union enum interface trait record".split())


class _Outer:
    """The tokens at depth 0: text, position; a closed bracket is one token, its opening character."""

    def __init__(self, text: str, lx: Lexer, line_of) -> None:
        self.tokens: list[tuple[str, int]] = []
        self.comments: list[tuple[int, int]] = []
        depth, at, n = 0, 0, len(text)
        pattern, script = lx.pattern, isinstance(lx, ScriptLexer)
        previous = ""
        comment = re.compile(r"#[^\n]*" if isinstance(lx, PythonLexer) else r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/")
        while at < n:
            m = pattern.match(text, at)
            if not m or m.end() == at:
                at += 1
                continue
            k = m.lastindex
            if k == 1:
                self.comments.extend(c.span() for c in comment.finditer(text, at, m.end()))
                at = m.end()
                continue
            if k == 2:
                at = text.find("\n", at)
                at = n if at < 0 else at
                continue
            token, end = m[0], m.end()
            if script and k == lx.op_index:
                operand = previous and (previous in ")]}" or previous[-1].isalnum() or previous[-1] in "_$\"'`/")
                if token == "`":
                    end = lx.template_end(text, at)
                    if end < 0:
                        break
                elif token in ("/", "/=") and not operand:
                    found = lx._REGEX.match(text, at)
                    end = found.end() if found else end
            previous = token if k == lx.op_index and token != "`" else "x"
            if k == 3 and token in ("return", "typeof", "case", "in", "of"):
                previous = "("
            if k == lx.op_index and token in ("(", "[", "{"):
                if not depth:
                    self.tokens.append((token, at))
                depth += 1
            elif k == lx.op_index and token in (")", "]", "}"):
                depth = max(0, depth - 1)
                if not depth:
                    self.tokens.append((token, at))
            elif not depth:
                self.tokens.append((token if k in (3, lx.op_index) else "lit", at))
            at = end
        del line_of


def _statements(tokens: list[tuple[str, int]], line: list[int], ends_by_line: bool) -> list[list[int]]:
    """Indices of the tokens of every statement at depth 0."""
    out: list[list[int]] = []
    now: list[int] = []
    for i, (t, _) in enumerate(tokens):
        if ends_by_line and now and line[i] > line[i - 1] and _may_end(tokens[i - 1][0]) and _may_start(t):
            out.append(now)
            now = []
        now.append(i)
        # a block ends a statement unless the statement goes on with an operator or a word such as else
        if t == ";" or (t == "}" and not _goes_on(tokens, i, now)):
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def _may_end(t: str) -> bool:
    return t in (")", "]", "}", "lit", "++", "--") or t[-1].isalnum() or t[-1] in "_$`"


def _may_start(t: str) -> bool:
    return t[0].isalpha() or t[0] in "_$@#({[" or t == "lit"


def _goes_on(tokens: list[tuple[str, int]], i: int, now: list[int]) -> bool:
    if i + 1 == len(tokens):
        return False
    after = tokens[i + 1][0]
    if after in (";", ",", ".", "=", ")", "(", "[", "?", ":", "else", "catch", "finally", "from"):
        return True
    first = tokens[now[0]][0]
    return first == "do" and after == "while"


def _is_declaration(words: list[str], language: str) -> bool:
    """words: the tokens of a statement without annotations and attributes."""
    if language in ("javascript", "typescript", "tsx"):
        while words and words[0] in _LEADS["script"]:
            words = words[1:]
        if not words:
            return False
        if words[0] in ("const", "declare") and words[1:2] == ["enum"]:
            return True
        if words[0] in ("function", "class"):
            return True
        if words[0] in ("interface", "enum"):
            return len(words) > 1 and words[1][0].isalpha()
        if words[0] == "type":
            return len(words) > 2 and words[2] in ("=", "<")
        # a method on its own: name(...) [: type] {
        call = words.index("(") if "(" in words else 0
        if "function" in words[:call] or not (words[0][0].isalpha() or words[0][0] in "_$#*["):
            return False
        return _called_block(words) and words[0] not in ("if", "for", "while", "switch", "with", "catch", "try", "do", "else")
    if language == "go":
        return words[0] in ("func", "type")
    if language == "rust":
        while words and (words[0] in ("pub", "async", "unsafe", "const", "extern", "lit", "default") or words[0] in "()"):
            words = words[1:]
        return bool(words) and (words[0] in ("fn", "type") or (words[0] in _TYPES and len(words) > 1 and words[1] != "="))
    if language == "java":
        while words and words[0] in _LEADS["java"]:
            words = words[1:]
        if words and words[0] in ("class", "interface", "enum", "record"):
            return True
        return _called_block(words)
    if "=" in words and "{" in words and words.index("=") < words.index("{") and words[0] != "using" and "operator" not in words:
        return False
    while words and words[0] in ("static", "const", "inline", "extern", "export", "constexpr", "friend", "lit"):
        words = words[1:]
    if not words:
        return False
    if words[0] == "template" and "{" in words:
        return True
    if words[0] == "typedef" or (words[0] == "using" and "=" in words):
        return True
    if words[0] in _TYPES:
        brace = words.index("{") if "{" in words else -1
        if brace > 0 and "(" not in words[:brace]:
            return True
    return words[0] not in ("namespace", "using", "if", "for", "while", "do", "switch", "else", "return") and _called_block(words)


def _called_block(words: list[str]) -> bool:
    """name ( ... ) ... { without an assignment before."""
    if "(" not in words or "{" not in words:
        return False
    call = words.index("(")
    if call == 0 or "{" in words[:call] or ("=" in words[:call] and "operator" not in words[:call]):
        return False
    after = words[call:]
    brace = len(after) - 1 - after[::-1].index("{")
    return "=>" not in after[:brace] and "=" not in after[:brace] and (words[call - 1][0].isalpha() or words[call - 1][0] in "_$>~=+-*/<!&|^%[]")


def declaration_lines(text: str, language: str) -> list[int]:
    """1-based lines at which the declarations of the outermost level begin, with the comment, decorator,
    attribute and annotation lines directly above. language: a dialect of ``lexers``."""
    if language in ("json", "yaml"):
        return []
    lx = lexer(language)
    if isinstance(lx, CLexer):
        text = lx.prepare(text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    count = len(starts)

    def line_of(pos: int) -> int:
        low, high = 0, count
        while high - low > 1:
            mid = (low + high) // 2
            if starts[mid] <= pos:
                low = mid
            else:
                high = mid
        return low + 1

    outer = _Outer(text, lx, line_of)
    tokens = outer.tokens
    lines = [line_of(p) for _, p in tokens]
    above = [False] * (count + 2)
    for a, b in outer.comments:
        first, last = line_of(a), line_of(b - 1)
        for i in range(first, last + 1):
            begin = starts[i - 1]
            end = starts[i] if i < count else len(text)
            before, behind = text[begin : max(begin, a)], text[min(b, end) : end]
            rest = (before if i == first else "") + (behind if i == last else "")
            above[i] = above[i] or not re.sub(r"/\*.*?\*/|//.*", "", rest).strip()
    found: list[int] = []
    if isinstance(lx, PythonLexer):
        base = None
        at = 0
        while at < len(tokens):
            word, pos = tokens[at]
            begin = starts[lines[at] - 1]
            fresh = at == 0 or lines[at] > lines[at - 1]
            column = len(text[begin:pos].expandtabs()) if fresh and not text[begin:pos].strip() else None
            if column is not None and base is None:
                base = column
            if column is not None and column <= base:
                if word == "@":
                    end = at + 1
                    # the decorator's logical line: up to the next token that begins a line at this column
                    while end < len(tokens) and not (
                        lines[end] > lines[end - 1] and not text[starts[lines[end] - 1] : tokens[end][1]].strip()
                        and tokens[end][0] not in (")", "]", "}")
                    ):
                        end += 1
                    for i in range(lines[at], lines[end - 1] + 1):
                        above[i] = True
                    at = end
                    continue
                if word in ("def", "class") or (word == "async" and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "def"):
                    found.append(lines[at])
            at += 1
    else:
        by_line = language in ("javascript", "typescript", "tsx", "go")
        for statement in _statements(tokens, lines, by_line):
            body = list(statement)
            # annotations, decorators and attributes in front
            while body:
                word = tokens[body[0]][0]
                if word == "@" and len(body) > 1 and tokens[body[1]][0] != "interface":
                    size = 2
                    while size + 1 < len(body) and tokens[body[size]][0] == ".":
                        size += 2
                    if size < len(body) and tokens[body[size]][0] == "(":
                        size += 2
                elif word == "#" and language == "rust":
                    size = 3 if len(body) > 2 else len(body)
                    if len(body) > 3 and tokens[body[1]][0] == "!":
                        size = 4
                elif word == "[" and language == "cpp":
                    size = 2
                else:
                    break
                for i in range(lines[body[0]], lines[body[min(size, len(body)) - 1]] + 1):
                    above[i] = True
                body = body[size:]
            if not body:
                continue
            words = [tokens[i][0] for i in body]
            if words[0] == "@":
                words = words[1:]
            if _is_declaration(words, language):
                found.append(lines[body[0]])
    out = []
    for line in found:
        while line > 1 and above[line - 1] and text[starts[line - 2] : starts[line - 1]].strip():
            line -= 1
        out.append(line)
    return sorted(set(out))
