"""String operations as Columns; the white-space class is Python's, spelled out for Java's regex."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.vocab import STOPWORDS, VERB_ALIASES

WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """c without white space of any script at its ends; null stays null."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    """Whether c has nothing but white space; null stays null."""
    return ~c.rlike("[^" + WS[1:])


def bounded(c: Column, n: int) -> Column:
    """The first n words with single blanks between them; null gives "". Only as much of the text is read."""
    first = F.regexp_extract(c, rf"\A{WS}*+((?:[^{WS[1:]}++{WS}*+){{0,{n}}}+)", 1)
    return F.coalesce(F.rtrim(F.regexp_replace(first, WS + "+", " ")), F.lit(""))


def bounded_list(items: Column, maximum: int, n: int = 25) -> Column:
    """At most maximum different non-empty items of at most n words, in first-seen order; null gives []."""
    texts = F.filter(F.transform(items, lambda x: bounded(x, n)), lambda x: x != "")
    return F.coalesce(F.slice(F.array_distinct(texts), 1, maximum), F.array().cast("array<string>"))


def trimmed_items(items: Column) -> Column:
    """Trimmed items that aren't empty; a null item is the text None, a null list is []."""
    texts = F.transform(items, lambda x: strip(F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def line_count(c: Column) -> Column:
    """Lines as Python's splitlines() counts them; "" has none."""
    parts = F.size(F.split(c, NL))
    return F.when(c == "", 0).otherwise(parts - F.when(c.rlike(rf"(?s)(?:{NL})\z"), 1).otherwise(0))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def with_aliases(tokens: Column) -> Column:
    """Inflected verbs replaced by their base form."""
    aliases = literal_map(VERB_ALIASES)
    return F.transform(tokens, lambda x: F.coalesce(aliases[x], x))


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits that begin with a letter, longer than one character and no
    stop-words, camel case split, inflected verbs replaced; null gives []."""
    found = F.regexp_extract_all(F.lower(split_camel(F.coalesce(c, F.lit("")))), F.lit("[A-Za-z][A-Za-z0-9]*"), 0)
    kept = F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))
    return with_aliases(kept)


def token_counts(df: DataFrame, c: str) -> DataFrame:
    """token, n of all tokens of a column. Words are counted as they stand and combined before they move; stop-words
    and aliases are seen to on the counts, once a word."""
    words = F.regexp_extract_all(F.lower(split_camel(F.coalesce(c, F.lit("")))), F.lit("[A-Za-z][A-Za-z0-9]*"), 0)
    raw = df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kept = raw.where((F.length("token") > 1) & ~F.col("token").isin(STOPWORDS))
    own = F.coalesce(literal_map(VERB_ALIASES)[F.col("token")], F.col("token"))
    return kept.groupBy(own.alias("token")).agg(F.sum("n").alias("n"))


def code_fence_stripped(c: Column) -> Column:
    """The inside of a text that is one fenced block as a whole, trimmed; any other text trimmed."""
    cleaned = strip(c)
    fence = r"(?s)\A```(?:[A-Za-z0-9_+.-]+)?" + WS + r"*\n?(.*?)\n?```\z"
    return F.when(cleaned.rlike(fence), strip(F.regexp_extract(cleaned, fence, 1))).otherwise(cleaned)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
