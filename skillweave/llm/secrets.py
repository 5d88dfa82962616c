"""Credentials embedded in source code (problem 2).

Token formats, key armor, connection strings and the names that credentials go by are one deterministic
automaton (``automaton``). It runs over overlapping chunks of all texts of a batch; the absolute ends of its
hits are deduplicated and name the lines worth a closer look. There an exact grammar reads the literals,
joins those that are put together from pieces, tells placeholders and lookups from values, and gives the
absolute spans of each secret. Redaction splices a placeholder over the spans: quotes, pieces and the number
of lines stay, so that the code around still reads the same.

Defined cases: null and empty texts hold nothing. A line is reported once per record whatever it holds. A
value put together from pieces is reported at its first piece, a key block at its BEGIN. A repeated id counts
once. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.automaton import Automaton

_PASS_WORDS = set("password passwd pwd pass passphrase passcode".split())
_SECRET_WORDS = set("secret secrets token apikey credential credentials".split())
_KEY_OWNERS = set("api access private secret encryption signing auth master hmac crypt crypto encrypt sign shared service ssh tls deploy".split())
#: what parts the words of a name: _, - and all beyond ASCII
_PARTS = "[^\x00-,.-^`-\x7f]"
#: what begins or names a credential; the automaton's patterns. Lines without a hit are not read: every name that name_kind
#: takes must have one, so that its words are made from the same sets
ANCHORS = [
    "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|npm_|[^a-z]sk-|[rs]k_(live|test)_|AIza|[^a-z]SG\\.|eyJ",
    "-----BEGIN ",
    "://",
    "(bearer|basic)[^!-\x7f]",
    "shared[_-]?access[_-]?key|account[_-]?key|authorization|auth[_-]?header",
    "|".join(sorted((_PASS_WORDS - {"pass"}) | _SECRET_WORDS)) + "|pass[^a-z\n]",
    # the parts between are seldom many; 8 bytes of them before a key are enough of a hit
    f"({'|'.join(sorted(_KEY_OWNERS))})([\\s.]|{_PARTS}{{0,7}})key|{_PARTS}{{8}}key",
]

_BODY = r"[A-Za-z0-9_-]"
#: kind, pattern with the secret as a whole or as the group ``s``
FORMATS = [
    ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\[nr]|\s|[\"'+])*(?=(?:[A-Za-z0-9+/=:,\s-]|\\[nr]|[\"'+])*?[A-Za-z0-9+/]{24})"),
    ("aws_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])"),
    ("github_token", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})"),
    ("gitlab_token", rf"(?<![A-Za-z0-9_-])glpat-{_BODY}{{16,}}"),
    ("slack_token", r"(?<![A-Za-z0-9_-])xox[abeoprs]-[A-Za-z0-9-]{16,}"),
    ("npm_token", r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{30,}"),
    ("pay_key", r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("api_key", rf"(?<![A-Za-z0-9_-])sk-{_BODY}{{20,}}"),
    ("maps_key", rf"(?<![A-Za-z0-9_-])AIza{_BODY}{{30,}}"),
    ("mail_key", rf"(?<![A-Za-z0-9_-])SG\.{_BODY}{{16,}}\.{_BODY}{{16,}}"),
    ("jwt", rf"(?<![A-Za-z0-9_-])eyJ{_BODY}{{8,}}\.eyJ{_BODY}{{8,}}\.{_BODY}{{8,}}"),
    ("shared_key", r"(?i:SharedAccessKey|AccountKey|SharedSecret)=(?P<s>[A-Za-z0-9+/=_-]{16,})"),
    ("connection_password", r"(?i:(?<![A-Za-z])(?:password|pwd))=(?P<s>[^;\s\"']{4,})(?=;)"),
    ("url_password", r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>{}$]*:(?P<s>[^\s@/\"'`]+)@(?=[\w.\[-])"),
    ("authorization", r"(?<![A-Za-z])[Bb]earer\s+(?P<s>[A-Za-z0-9._~+/=-]{16,})"),
    ("authorization", r"(?<![A-Za-z])[Bb]asic\s+(?P<s>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])"),
]

_LITERAL = re.compile(
    r"\"\"\"(?P<a>(?:[^\"\\]++|\\.|\"(?!\"\"))*+)\"\"\"|'''(?P<b>(?:[^'\\]++|\\.|'(?!''))*+)'''"
    r"|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`]*)`", re.S,
)
_QUOTE = re.compile("[\"'`]")
#: what may stand between the pieces of one value
_GLUE = re.compile(r"(?:\s|\\\n|\+|\.\.(?!\.)|&|(?://|#)[^\n\"']*\n)*(?:[rbfuRBFU]{1,2}(?=[\"']))?")
#: what stands between a name and its literal
_DIRECT = re.compile(r"\s*(?:\(\s*)?(?:[A-Za-z_:]+(?:::from|\.from)?\(\s*)?[rbfuRBFU]{0,2}(?=[\"'`])")
#: the end of a key block, and its body where the end is missing
_KEY_END = re.compile(r"-----(?:END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?P<next>BEGIN ))")
_KEY_BODY = re.compile(r"(?:(?:[\s\"'+,]|\\[nr])*[A-Za-z0-9+/=]{20,})*(?:(?:[\s\"'+,]|\\[nr])*[A-Za-z0-9+/]+=+)?")
_NAME = re.compile(
    r"(?P<q>[\"']?)(?P<n>[A-Za-z_][\w.\-]*)(?P=q)\]?(?P<t>\s*:\s*(?:&'?\w*\s*)?[A-Za-z_][\w<>\[\], |:?]*?(?=\s*=[^=>]))?\s*(?::=|=>|=(?![=>])|:(?!:|//))"
)
_SPOKEN = re.compile(r"(?i)\b(password|passwd|passphrase|pwd|secret|token|api key|access key)\s*(?:is|:|=)\s*(?P<v>\S+)\s*$")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--)|\s(?:#|//)\s")
_LOOKUP = re.compile(r"(?i)environ|getenv|\benv\b|process\.env|env::|getproperty|config\.get|os\.get|secrets?\.|vault|prompt|input\(|getpass|read_")
_FALLBACK = re.compile(r"(?:\|\||\?\?|\?:|\bor\b|\belse\b|:|,|\bunwrap_or(?:_else)?\s*\(|\borElse(?:Get)?\s*\(|\bunwrap_or_default\s*\()\s*(?:String::from\s*\(|\|\|\s*|\(\)\s*->\s*)?(?=[rbfu]?[\"'`])")

_PUBLIC = set("public pub pubkey verify verification authorized".split())
_PLACEHOLDERS = set(
    "changeme change_me change-me password passwd pass secret token api_key apikey key user username none null nil true false todo "
    "fixme test example sample dummy placeholder default redacted hidden masked unset empty string undefined".split()
)
_TEMPLATE = re.compile(r"\$\{|\{\{|\}\}|%\(|<[^>\s]*>|^%[sdv]$|\{[A-Za-z_.]*\}|^\$[A-Za-z_]\w*$|\$\(|^@|^%\w+%$")


def name_words(name: str) -> list[str]:
    """Lower-case words of an identifier without trailing numbers."""
    name = name.rsplit(".", 1)[-1]
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    while words and words[-1].isdigit():
        words.pop()
    return [w.lower() for w in words]


def name_kind(name: str) -> str:
    """password or secret if the name's last words say that its value is one."""
    words = name_words(name)
    if not words or _PUBLIC & set(words):
        return ""
    if words[-1] in _PASS_WORDS:
        return "password"
    if words[-1] in _SECRET_WORDS or (words[-1] == "key" and len(words) > 1 and words[-2] in _KEY_OWNERS):
        return "secret"
    return ""


def is_placeholder(value: str) -> bool:
    v = value.strip()
    low = v.lower()
    if not v or low in _PLACEHOLDERS or _TEMPLATE.search(v) or "..." in v or "…" in v:
        return True
    if re.search(r"(?i)your[_-]|_here\b|example|placeholder|changeme|change_me|replace[_-]?me|dummy|redacted|insert[_-]", low):
        return True
    if re.search(r"([xX0*#.•-])\1{5,}", v) or len(set(v)) < 3:
        return True
    return bool(re.fullmatch(r"[xX*#.\-_•]+", v))


def is_strong(value: str, kind: str) -> bool:
    """Whether a literal under a name of that kind is a secret."""
    if re.search(r"\s", value) or is_placeholder(value):
        return False
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if kind == "secret":
        if len(value) < 16 or not re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", value) or re.fullmatch(r"[a-z]+(?:[-_.][a-z0-9]+)+", value):
            return False
        mixed = bool(re.search(r"[A-Z]{2}", value) and re.search(r"[a-z]", value))
        return letters >= 2 and (digits >= 1 or bool(re.search(r"[+/=]", value)) or mixed)
    if len(value) < 6 or re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|/|\.{1,2}/", value):
        return False
    turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]))
    symbols = sum(c in "!#$%*+=?@^&~|" for c in value)
    return letters >= 1 and (digits >= 1 or symbols >= 1 or turns >= 2)


@dataclass(frozen=True)
class Secret:
    """begin: where its value begins; spans: what to take out."""

    kind: str
    begin: int
    spans: tuple[tuple[int, int], ...]


@cache
def _formats() -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p)) for kind, p in FORMATS]


@cache
def anchors() -> Automaton:
    return Automaton(ANCHORS)


def _basic(token: str) -> bool:
    try:
        plain = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    user, colon, word = plain.partition(b":")
    return bool(colon and word) and all(32 <= c < 127 for c in plain) and not is_placeholder(word.decode())


def _hit(kind: str, pattern: re.Pattern, m: re.Match) -> tuple[str, int, int] | None:
    """kind, start and end of the secret that a format's match holds, if it is one."""
    start, end = m.span("s") if "s" in pattern.groupindex else m.span()
    value, body = m.string, m.string[start:end]
    if kind == "private_key":
        close = _KEY_END.search(value, end)
        return kind, start, close.end() if close and not close["next"] else len(value)
    if kind == "authorization" and pattern.pattern.find("asic") > 0:
        return (kind, start, end) if _basic(body) else None
    if is_placeholder(body) or (kind not in ("url_password", "connection_password") and len(set(body)) < 8):
        return None
    if kind == "authorization" and not (re.search(r"\d", body) and re.search(r"[A-Za-z]", body)):
        return None
    return kind, start, end


def format_hits(value: str, begins: int | None = None) -> Iterator[tuple[str, int, int]]:
    """kind, start and end of every secret that its format tells; with begins, of those that begin before it."""
    for kind, pattern in _formats():
        matches = pattern.finditer(value) if begins is None else filter(None, (pattern.match(value, i) for i in range(begins)))
        yield from filter(None, (_hit(kind, pattern, m) for m in matches))


def key_blocks(text: str, begin: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """Key blocks that begin from begin to stop, as they stand in the text, each to its END line however far that is.

    Without an END of its own, or with little but code before it, a block ends with its body.
    """
    kind, pattern = _formats()[0]
    m = pattern.search(text, begin)
    while m and m.start() < stop:
        close = _KEY_END.search(text, m.end())
        end = _KEY_BODY.match(text, m.end()).end()
        if close and not close["next"]:
            body = text[m.end() : close.start()]
            if 2 * sum(map(len, re.findall(r"[A-Za-z0-9+/=]{16,}", body))) >= len(re.sub(r"\s", "", body)):
                end = close.end()
        yield kind, m.start(), end
        m = pattern.search(text, end)


class _Chains:
    """The literals of a text, those that follow each other joined; a chain is followed to its last literal."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: by the begin of a literal, its chain's number and its place there and in the joined value
        self.known: dict[int, tuple[int, int, int]] = {}
        self.chains: list[tuple[list[tuple[int, int]], str]] = []

    def _literal(self, at: int) -> tuple[re.Match, tuple[int, int]] | None:
        m = _LITERAL.match(self.text, at)
        return m and (m, m.span(m.lastgroup))

    def of(self, begin: int, end: int) -> Iterator[tuple[list[tuple[int, int]], str, bool]]:
        """The chains that begin from begin to end, their values, and whether one is new, no rest of one given before."""
        text, at = self.text, begin
        while quote := _QUOTE.search(text, at, end):
            start = quote.start()
            if start in self.known:
                number, place, skip = self.known[start]
                chain, value, new = self.chains[number][0][place:], self.chains[number][1][skip:], False
            else:
                chain, size, new, here = [], 0, True, start
                while found := self._literal(here):
                    self.known.setdefault(here, (len(self.chains), len(chain), size))
                    chain.append(found[1])
                    size += found[1][1] - found[1][0]
                    here = _GLUE.match(text, found[0].end()).end()
                    if here >= len(text) or text[here] not in "\"'`":
                        break
                if not chain:
                    at = start + 1
                    continue
                value = "".join(text[a:b] for a, b in chain)
                self.chains.append((chain, value))
            yield chain, value, new
            # behind the last literal's closing quotes
            at = chain[-1][1]
            at += 3 if text[at : at + 3] in ('"""', "'''") and text[chain[-1][0] - 3 : chain[-1][0]] == text[at : at + 3] else 1


def _positions(chain: list[tuple[int, int]], start: int, end: int) -> tuple[tuple[int, int], ...]:
    """Absolute spans of the joined value's characters start to end."""
    out, at = [], 0
    for a, b in chain:
        size = b - a
        low, high = max(start - at, 0), min(end - at, size)
        if low < high:
            out.append((a + low, a + high))
        at += size
    return tuple(out)


def _plain_settings(text: str) -> bool:
    """Whether the text is key: value lines, whose values need no quotes."""
    lines = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    keyed = sum(bool(re.match(r"\s*(?:- )?[\"']?[\w.\-/]+[\"']?\s*(?::(?:\s|$)|=)", x)) and x.rstrip()[-1] not in ";{(," for x in lines)
    return bool(lines) and keyed >= 0.7 * len(lines)


def find_secrets(text: str, lines: list[int]) -> list[Secret]:
    """The secrets that begin on or follow from the given lines (0-based), each with its spans."""
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    limits = starts[1:] + [len(text) + 1]
    out: dict[tuple[int, int], Secret] = {}

    def add(kind: str, spans: tuple[tuple[int, int], ...], first: int | None = None) -> None:
        if not spans:
            return
        begin = spans[0][0] if first is None else first
        over = [s for s in out.values() if any(a < d and c < b for a, b in s.spans for c, d in spans)]
        if any(s.spans[0][0] <= spans[0][0] and spans[-1][1] <= s.spans[-1][1] for s in over):
            return
        # it goes on where shorter ones end: all of them are one secret
        for s in over:
            del out[s.spans[0]]
            begin = min(begin, s.begin)
        joined: list[tuple[int, int]] = []
        for a, b in sorted([*spans, *(x for s in over for x in s.spans)]):
            if joined and a < joined[-1][1]:
                joined[-1] = joined[-1][0], max(b, joined[-1][1])
            else:
                joined.append((a, b))
        out[joined[0]] = Secret(kind, begin, tuple(joined))

    settings: bool | None = None
    known, reach = _Chains(text), {}
    for number in lines:
        begin, stop = starts[number], limits[number] - 1
        line = text[begin:stop]
        # a value may go on, or only begin, on the next lines
        last = number
        while last not in reach and last + 1 < len(starts):
            here = text[starts[last] : limits[last] - 1].rstrip()
            ahead = text[starts[last + 1] : limits[last + 1] - 1].lstrip()
            if here.endswith(("+", "(", "=", ":", "\\", "..", ",")) and re.match(r"[+.(]?\s*[rbfu]?[\"'`]", ahead):
                last += 1
            elif here.endswith(("\"", "'", "`")) and re.match(r"(?:\+\s*|\.\.?\s*)?[rbfu]?[\"'`]", ahead):
                last += 1
            else:
                break
        last = reach.get(last, last)
        reach.update(dict.fromkeys(range(number, last + 1), last) if number not in reach else {})
        end = limits[last] - 1
        chains = []
        for chain, value, new in known.of(begin, end if line.rstrip().endswith(("(", "=", ":", "\\")) else stop):
            chains.append(chain)
            if not new and chain[0][0] > stop:
                continue
            # the rest of a chain that has been read can only tell more of what begins on this line
            begins = None if new else sum(b - a for a, b in takewhile(lambda x: x[0] < stop, chain))
            for kind, a, b in format_hits(value, begins):
                # the whole value begins at its first piece, a key block where it says so
                first = chain[0][0] if len(chain) > 1 and kind != "private_key" else None
                add(kind, _positions(chain, a, b), first)
        for kind, a, b in format_hits(line):
            if kind != "private_key":
                add(kind, ((begin + a, begin + b),))
        if "-----BEGIN" in line:
            for kind, a, b in key_blocks(text, begin, stop):
                add(kind, ((a, b),))
        for m in _NAME.finditer(line):
            kind = name_kind(m["n"])
            if not kind:
                continue
            after = begin + m.end()
            direct = _DIRECT.match(text, after, end)
            found: list[tuple[int, int]] | None = None
            if direct and not (_LOOKUP.search(direct[0])):
                found = next((c for c in chains if c[0][0] >= after and c[0][0] <= direct.end() + 3), None)
            else:
                for f in _FALLBACK.finditer(text[after:stop]):
                    if _LOOKUP.search(text[after : after + f.start()]):
                        found = next((c for c in chains if after + f.end() <= c[0][0] <= after + f.end() + 4), None)
            if found:
                value = "".join(text[a:b] for a, b in found)
                if is_strong(value, kind):
                    add(kind, tuple(found))
                continue
            if direct or (after < end and text[after] == "\n"):
                continue
            plain = re.match(r"[ \t]*([^\s\"'`(){}\[\],;]+)[ \t]*(?:[#].*)?$", text[after:stop])
            if plain:
                if settings is None:
                    settings = _plain_settings(text)
                if (settings or _COMMENT.search(line[: m.start()] + " ")) and is_strong(plain[1], kind):
                    add(kind, ((after + plain.start(1), after + plain.end(1)),))
        if _COMMENT.search(line):
            m = _SPOKEN.search(line)
            if m and is_strong(m["v"].strip("\"'`"), "password" if m[1].lower()[0] == "p" else "secret"):
                add("password", ((begin + m.start("v"), begin + m.end("v")),))
    return sorted(out.values(), key=lambda s: s.spans[0])


def batch_lines(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, list[int]]]:
    """(index, lines with anchor hits) of the texts that have any; one automaton run per limit of bytes."""
    group: list[tuple[int, bytes]] = []
    size = 0

    def run() -> Iterator[tuple[int, list[int]]]:
        data = b"\n".join(x for _, x in group) + b"\n"
        ends = anchors().ends(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        firsts = np.cumsum([0] + [len(x) + 1 for _, x in group])
        owner = np.searchsorted(firsts, ends, "right") - 1
        line = np.searchsorted(breaks, ends, "left")
        base = np.searchsorted(breaks, firsts[:-1], "left")
        for i in np.unique(owner):
            yield group[i][0], np.unique(line[owner == i] - base[i]).tolist()

    for index, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        group.append((index, raw))
        size += len(raw)
        if size >= limit:
            yield from run()
            group, size = [], 0
    if group:
        yield from run()


PLACEHOLDER = "REDACTED"


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with every secret's first span replaced by the placeholder and its other spans emptied; line
    ends within a span stay."""
    edits = [(a, b, PLACEHOLDER if i == 0 else "") for s in secrets for i, (a, b) in enumerate(s.spans)]
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + "\n" * text.count("\n", a, b) + text[b:]
    return text


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for i, lines in batch_lines(texts):
            text = texts[i]
            for s in find_secrets(text, lines):
                rows.append((ids[i], text.count("\n", 0, s.begin) + 1, s.kind))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())],
            names=["id", "line", "kind"],
        )


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = dict(batch_lines(texts))
        out, counts = [], []
        for i, text in enumerate(texts):
            secrets = find_secrets(text, found[i]) if i in found else []
            out.append(redact(text, secrets) if secrets else text)
            counts.append(len(secrets))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["id", "text", "secrets"]
        )


def embedded_secrets(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """id, line, kind of every secret, distinct."""
    own = df.select(F.col(record_id).alias("id"), text).where(F.length(text) > 0)
    return own.mapInArrow(_found, "id string, line int, kind string").distinct()


def redacted(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """id, text without its secrets, secrets (their number); a row per row of df, null texts stay null."""
    return df.select(F.col(record_id).alias("id"), text).mapInArrow(_redacted, "id string, text string, secrets int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, line of every line on which a secret begins."""
    found = embedded_secrets(spark.read.parquet(f"{sf_dir}/source_unit.parquet"), "data_id", "code")
    return found.select(F.col("id").alias("data_id"), "line").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, code, secrets of the units that held secrets, redacted; one row per data_id."""
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    out = redacted(units, "data_id", "code").where("secrets > 0")
    # rows of one data_id hold the same code; where they don't, one of them stands as it is
    one = out.groupBy(F.col("id").alias("data_id")).agg(F.min(F.struct("text", "secrets")).alias("one"))
    return one.select("data_id", F.col("one.text").alias("code"), "one.secrets")


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
