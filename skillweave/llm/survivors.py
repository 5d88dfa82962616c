"""Best representative of each duplicate group (problem 6).

``survivors`` unpivots the fields of all records to long rows (group, field, value, vote), sums the votes per
value, chooses each field's winner by max_by and pivots the winners back to one row per group. A vote is
weight x source trust x recency decay in millionths (integers, so that sums do not depend on their order). A
record may vote more than once for a field (parts), its votes add up.

Defined cases: a null or blank value gets no vote; a field without any vote is null in the result. Repeated
rows of one record vote once, with their largest vote. Ties go to the latest time (null is earliest), then
the smallest record id. A null group is no group. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.text import is_blank, strip, with_aliases
from skillweave.sql_words import ALIASES

MICRO = 1_000_000


@dataclass(frozen=True)
class FieldVote:
    """value: what the field shows (string). weight: a non-negative number. key: what counts as the same
    value, the value itself unless given. trust and decay: of this field, instead of the record's."""

    value: Column
    weight: Column
    key: Column | None = None
    trust: Column | None = None
    decay: Column | None = None


def recency(at: Column, newest: Column, half_life_days: float, unknown: float = 0.5**10) -> Column:
    """Halves every half_life_days before newest; an unknown time counts as ten half-lives old unless told."""
    age = (F.unix_timestamp(newest) - F.unix_timestamp(at)) / 86400.0
    lives = F.when(age > 0, age / half_life_days).otherwise(0.0)
    return F.when(age.isNull(), unknown).otherwise(F.pow(F.lit(0.5), lives))


def survivors(
    df: DataFrame,
    group: Column,
    record_id: Column,
    at: Column,
    fields: Mapping[str, FieldVote | list[FieldVote]],
    trust: Column | None = None,
    decay: Column | None = None,
) -> DataFrame:
    """One row per group: group, min_id and max_id of its records, one string column per field."""
    one = F.lit(1.0)

    def factor(v: FieldVote) -> Column:
        first = lambda *x: next((c for c in x if c is not None), one)
        return first(v.trust, trust) * first(v.decay, decay)

    votes = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(part).alias("part"),
            (v.value if v.key is None else v.key).cast("string").alias("key"),
            v.value.cast("string").alias("value"),
            F.round(v.weight * factor(v) * MICRO).cast("bigint").alias("vote"),
        )
        for name, own in fields.items()
        for part, v in enumerate(own if isinstance(own, list) else [own])
    ]
    long = (
        df.select(
            group.alias("group"), record_id.alias("record_id"), at.alias("at"), F.explode(F.array(*votes)).alias("v")
        )
        .where(F.col("group").isNotNull())
        .select("group", "record_id", "at", "v.*")
    )
    # a value without a vote is only kept once a record, which then still counts as a member of its group
    valid = ~F.coalesce(is_blank(F.col("value")), F.lit(True))
    long = long.where(valid | ((F.col("field") == next(iter(fields))) & (F.col("part") == 0)))
    # repeated rows collapse first, partly before the exchange: a hot group moves one row per record and value
    once = long.groupBy("group", "field", "part", "key", "record_id").agg(
        F.max(F.when(valid, F.col("vote"))).alias("vote"), F.max("at").alias("at"), F.max("value").alias("value")
    )
    newest = F.struct("vote", "at", (-F.col("record_id")).alias("minus_id"))
    tally = once.groupBy("group", "field", "key").agg(
        F.sum("vote").alias("vote"), F.max("at").alias("at"), F.min("record_id").alias("first_id"),
        F.max_by("value", newest).alias("value"), F.max("record_id").alias("last_id"),
    )
    strength = F.struct("vote", "at", (-F.col("first_id")).alias("minus_id"))

    def winner(name: str) -> Column:
        here = (F.col("field") == name) & F.col("vote").isNotNull()
        return F.max_by(F.when(here, F.col("value")), F.when(here, strength)).alias(name)

    return tally.groupBy("group").agg(
        F.min("first_id").alias("min_id"), F.max("last_id").alias("max_id"), *[winner(name) for name in fields]
    )


def key_words(c: Column) -> Column:
    """The ASCII words of a key field, camel case split, lower case, verbs in base form; null if there is none."""
    split = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    found = with_aliases(F.transform(F.regexp_extract_all(split, F.lit("[A-Za-z0-9]+"), 0), F.lower))
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def purpose_key() -> Column:
    """The three key fields in one string; null where one of them is null or has no word."""
    parts = [key_words(F.col(c)) for c in ("task_family", "intent_action", "intent_target")]
    missing = parts[0].isNull() | parts[1].isNull() | parts[2].isNull()
    return F.when(~missing, F.concat_ws("|", *parts))


TEXTS = ("transfer_title", "transfer_summary")
LISTS = ("workflow", "inputs", "outputs", "invariants", "error_cases")


def filled(name: str) -> Column:
    if name in TEXTS:
        return ~F.coalesce(is_blank(F.col(name)), F.lit(True))
    return F.coalesce(F.exists(F.col(name), lambda x: ~F.coalesce(is_blank(x), F.lit(True))), F.lit(False))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """card_id, title_card_id, summary_card_id of every purpose with at least two cards.

    The three results are fields of the survivor, whose values are card ids. Each of a card's filled fields is a
    vote for the card, and the votes add up. A filled title is a vote that decays with the card's age: the latest
    wins, cards so old or undated that nothing is left of their votes by their order in time. A filled summary is a
    vote of its length. All sources are trusted alike, the result's definition knows no trust.
    """
    cards = spark.read.parquet(f"{sf_dir}/purpose_index.parquet")
    newest = F.lit(cards.agg(F.max("indexed_at")).first()[0]).cast("timestamp")
    me, at = F.col("card_id"), F.col("indexed_at")
    told = [filled(c).alias(f"has_{c}") for c in TEXTS + LISTS]
    size = F.length(strip(F.col("transfer_summary"))).alias("size")
    # a card without any filled field still stands for itself, with a vote of nothing
    known = cards.select("card_id", "indexed_at", purpose_key().alias("purpose"), size, *told)
    title, summary, *others = (F.when(F.col(f"has_{c}"), me) for c in TEXTS + LISTS)
    fields = {
        "card_id": [FieldVote(me, F.lit(0)), *(FieldVote(x, F.lit(1)) for x in (title, summary, *others))],
        "title_card_id": FieldVote(title, F.lit(1), decay=recency(at, newest, 30.0, 0.0)),
        "summary_card_id": FieldVote(summary, F.col("size")),
    }
    out = survivors(known, F.col("purpose"), me, at, fields).where("min_id < max_id")
    return out.select(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).cast("bigint").alias(c) for c in fields])


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purpose the merged title, summary and level-free texts by trust x recency votes.

    A card's trust is its support_count + 1; votes halve every 30 days before the newest card.
    """
    cards = spark.read.parquet(f"{sf_dir}/purpose_index.parquet")
    newest = F.lit(cards.agg(F.max("indexed_at")).first()[0]).cast("timestamp")
    me, at = F.col("card_id"), F.col("indexed_at")
    text = {c: FieldVote(strip(F.col(c)), F.lit(1), F.lower(strip(F.col(c)))) for c in TEXTS}
    lists = {c: FieldVote(F.array_join(F.col(c), "\n"), F.lit(1)) for c in LISTS}
    trust = F.col("support_count") + 1
    return survivors(cards, purpose_key(), me, at, text | lists, trust, recency(at, newest, 30.0)).select(
        F.col("group").alias("purpose"), *text, *lists
    )


QUERIES = {"p6_found": p6_found, "p6_merged": p6_merged}

def _words_sql(c: str) -> str:
    return (
        rf"list_transform(regexp_extract_all(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), "
        f"lambda w: coalesce(map {{{ALIASES}}}[lower(w)], lower(w)))"
    )


_SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))
_SPACES += (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _trim_sql(c: str) -> str:
    return f"trim({c}, {' || '.join(f'chr({x})' for x in _SPACES)})"


_PURPOSES = f"""
k as (select *, {_words_sql("task_family")} as f, {_words_sql("intent_action")} as a, {_words_sql("intent_target")} as t from purpose_index),
g as (select *, array_to_string(f, ' ') || '|' || array_to_string(a, ' ') || '|' || array_to_string(t, ' ') as purpose
      from k where len(f) > 0 and len(a) > 0 and len(t) > 0)"""
_VALUES = {c: (_trim_sql(c), f"lower({_trim_sql(c)})") for c in TEXTS} | {c: (f"array_to_string({c}, chr(10))",) * 2 for c in LISTS}
_LONG = " union all ".join(f"select purpose, card_id, indexed_at, vote, '{c}' as field, {v} as value, {k} as key from v" for c, (v, k) in _VALUES.items())
_WON = ", ".join(f"max_by(value, (vote, seen, -early)) filter (where field = '{c}' and vote is not null) as {c}" for c in _VALUES)

SQL = {
    "p6_found": f"""
with k as (
  select distinct card_id, indexed_at, {_words_sql("task_family")} as f, {_words_sql("intent_action")} as a,
         {_words_sql("intent_target")} as t,
         coalesce(length({_trim_sql("transfer_title")}), 0) as title,
         coalesce(length({_trim_sql("transfer_summary")}), 0) as summary,
         {" + ".join(f"(coalesce(len({c}), 0) > 0)::int" for c in LISTS)} as lists
  from purpose_index
), g as (
  select *, array_to_string(f, ' ') || '|' || array_to_string(a, ' ') || '|' || array_to_string(t, ' ') as purpose
  from k where len(f) > 0 and len(a) > 0 and len(t) > 0
), r as (
  select purpose, card_id, title, summary,
         row_number() over (partition by purpose order by lists + (title > 0)::int + (summary > 0)::int desc,
                            indexed_at desc nulls last, card_id) as c,
         row_number() over (partition by purpose order by title > 0 desc, indexed_at desc nulls last, card_id) as t,
         row_number() over (partition by purpose order by summary desc, indexed_at desc nulls last, card_id) as s
  from g
)
select max(case when c = 1 then card_id end) as card_id,
       max(case when t = 1 then case when title > 0 then card_id else 0 end end) as title_card_id,
       max(case when s = 1 then case when summary > 0 then card_id else 0 end end) as summary_card_id
from r group by purpose having count(distinct card_id) > 1
""",
    "p6_merged": f"""
with {_PURPOSES},
v as (select *, cast(round((support_count + 1) * case when indexed_at is null then pow(0.5, 10) else pow(0.5, (floor(epoch((select max(indexed_at) from purpose_index))) - floor(epoch(indexed_at))) / 86400.0 / 30.0) end * 1000000) as bigint) as vote from g),
l as ({_LONG}),
o as (select purpose, field, key, card_id, max(case when {_trim_sql("value")} != '' then vote end) as vote, coalesce(max(indexed_at), '-infinity'::timestamp) as seen, max(value) as value
      from l group by all),
y as (select purpose, field, key, sum(vote) as vote, max(seen) as seen, min(card_id) as early, max_by(value, (coalesce(vote, -1), seen, -card_id)) as value from o group by purpose, field, key)
select purpose, {_WON} from y group by purpose
""",
}
