"""Inference of a skill record's purpose, as SQL expressions over flat records.

The expressions are texts, because a plan of this size is put together faster from a few texts than from
thousands of Column calls. Every token is looked up once in sets of literals; families are counted over the few
hint words that a record holds, not over its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from skillweave.functions.text import WS
from skillweave.functions.vocab import FAMILY_HINTS, GENERIC_NOUNS, INTENT_VERBS, LIFECYCLE, STOPWORDS, VERB_ALIASES

BLOB_LISTS = "workflow inputs outputs invariants error_cases anti_goals evidence".split()
HEADS = "symbol name summary when_to_use".split()


def quoted(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def literal_map(pairs: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, r'\\A{WS}+|{WS}+\\z', '')"


def items(c: str) -> str:
    """Trimmed items that aren't empty; a null item is the text None, a null list is empty."""
    texts = f"transform({c}, x -> {trimmed("coalesce(x, 'None')")})"
    return f"coalesce(filter({texts}, x -> x != ''), cast(array() as array<string>))"


def tokens(c: str) -> str:
    """As functions.text.tokens."""
    found = f"regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '$1 $2')), '[A-Za-z][A-Za-z0-9]*', 0)"
    kept = f"filter({found}, x -> length(x) > 1 and x not in ({quoted(STOPWORDS)}))"
    # the map is only asked for the few words that are in it
    return f"transform({kept}, x -> if(x in ({quoted(VERB_ALIASES)}), {literal_map(VERB_ALIASES)}[x], x))"


def blob(lists: Iterable[str] = BLOB_LISTS) -> str:
    """The record's texts, one per line, without empty ones; lists hold trimmed items."""
    heads = f"filter(array({', '.join(HEADS)}), x -> coalesce(x, '') != '')"
    return f"array_join(concat({heads}, {', '.join(lists)}), '\\n')"


def verb_at(words: str) -> str:
    """The place of the first intent verb, from 1; 0 if there is none."""
    return f"coalesce(array_position(transform({words}, x -> x in ({quoted(INTENT_VERBS)})), true), 0L)"


def action(words: str, at: str) -> str:
    return f"if({at} > 0, element_at({words}, cast(greatest({at}, 1L) as int)), 'execute')"


def target(words: str, at: str) -> str:
    """The first two words after the first intent verb that are neither verbs nor generic nouns, else object."""
    tail = f"slice({words}, cast({at} as int) + 1, greatest(size({words}), 0))"
    kept = f"filter({tail}, x -> x not in ({quoted(INTENT_VERBS + GENERIC_NOUNS)}))"
    return f"coalesce(nullif(array_join(slice({kept}, 1, 2), '_'), ''), 'object')"


def family(given: str, hits: str) -> str:
    """The given family, else the one with most hint words (the last name among equals), else workflow.

    hits: the family of each different hint word among the words.
    """
    best = f"array_max(transform(array_distinct({hits}), f -> struct(size(filter({hits}, g -> g = f)) as n, f as name))).name"
    return f"coalesce(nullif({given}, ''), {best}, 'workflow')"


def family_hits(words: str) -> str:
    hints = {w: name for name, own in FAMILY_HINTS.items() for w in own}
    return f"transform(array_distinct(filter({words}, x -> x in ({quoted(hints)}))), x -> {literal_map(hints)}[x])"


def lifecycle(act: str) -> str:
    cases = " ".join(f"when {act} in ({quoted(verbs)}) then '{name}'" for name, verbs in LIFECYCLE.items())
    return f"case {cases} else 'execute' end"


def signature(*lists: str, n: int = 6) -> str:
    """The first n tokens of the lists' items."""
    whole = lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"
    return f"slice({tokens(f"array_join({whole}, ' ')")}, 1, {n})"


def io_shape(inputs: str, outputs: str) -> str:
    sides = [f"coalesce(nullif(array_join({signature(x, n=2)}, '_'), ''), 'unspecified')" for x in (inputs, outputs)]
    return f"concat({sides[0]}, '->', {sides[1]})"


def purpose_id(fam: str, act: str, tgt: str) -> str:
    """20 hexadecimal digits of the key-sorted compact JSON of the triple (ASCII words)."""
    key = f"to_json(struct({act} as intent_action, {tgt} as intent_target, {fam} as task_family))"
    return f"substring(sha1({key}), 1, 20)"


def representative_score(level: str, summary: str, lists: Mapping[str, str]) -> str:
    """How well a record can stand for its purpose; added in this order, as floats depend on it."""
    share = lambda c, most: f"least(1.0D, size({lists[c]}) / {most}.0D)"
    parts = [f"{share('workflow', 6)} * 0.30D", f"{share('invariants', 5)} * 0.20D", f"{share('error_cases', 5)} * 0.20D"]
    parts += [f"{share('evidence', 4)} * 0.10D", f"least(1.0D, length(coalesce({summary}, '')) / 600.0D) * 0.10D"]
    return " + ".join(parts) + f" + case {level} when 'pattern' then 0.10D when 'composite' then 0.06D else 0.0D end"


def low_value_reason(lists: Mapping[str, str]) -> str:
    """Why a skill record is not worth indexing; "" if it is. The first reason wins. Reads symbol, summary, _blob."""
    flat = r"(?i)\\bgetter\\b|\\bsetter\\b|\\btrivial\\b|\\bthin wrapper\\b|\\blogging[- ]only\\b|\\bconstant mapping\\b"
    thin = f"length(coalesce(summary, '')) < 80 and size({lists['workflow']}) <= 1"
    bare = f"size({lists['invariants']}) = 0 and size({lists['error_cases']}) = 0"
    shown = " or ".join(f"contains(symbol, '{x}')" for x in ("toString", "__str__", "__repr__"))
    return (
        f"case when _blob rlike '{flat}' then 'boilerplate_or_trivial' "
        f"when symbol rlike '^(get|set|is|has)[A-Z_]' and size({lists['workflow']}) <= 1 then 'getter_setter_like' "
        f"when {thin} and {bare} then 'too_little_reusable_logic' when {shown} then 'representation_only' else '' end"
    )
