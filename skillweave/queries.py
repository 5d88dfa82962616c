"""Queries of the core operators and their SQL, for the driver's entry module.

The records of the purpose view are the cards of purpose_index with the symbol and repository of the unit that
represents them; the pipeline's model answers are read off the tables, so that SQL can give them too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave import sql_words as W
from skillweave.functions import guards, normalize, text
from skillweave.functions.vocab import CAPABILITY_TAGS, SCORES, TASK_FAMILIES
from skillweave.operators import decisions, purpose_index, selection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ SQL fragments

_SPACES = " || ".join(f"chr({x})" for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NL = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _bounded(c: str, n: int) -> str:
    return f"coalesce(array_to_string(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w != '')[1:{n}], ' '), '')"


def _items(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []), lambda y: trim(coalesce(y, 'None'), {_SPACES})), lambda y: y != '')"


def _tokens(c: str) -> str:
    camel = rf"lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'))"
    found = f"list_filter(regexp_extract_all({camel}, '[A-Za-z][A-Za-z0-9]*'), lambda t: length(t) > 1 and t not in ({W.STOP}))"
    return f"list_transform({found}, lambda t: coalesce(map {{{W.ALIASES}}}[t], t))"


_TEST = (
    "(contains(p, '/tests/') or contains(p, '/test/') or starts_with(b, 'test_') or ends_with(b, '_test.py') or ends_with(b, '.spec.ts') "
    "or ends_with(b, '.spec.js') or ends_with(b, '.test.ts') or ends_with(b, '.test.js'))"
)
_PATH = "select *, '/' || lower(replace(relative_path, '\\', '/')) as p, regexp_extract(lower(replace(relative_path, '\\', '/')), '[^/]*$') as b from source_unit"
_MARKER = W.MARKER
_SUFFIX = r"lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '[^.].*?(\.[^.]+)$', 1))"
_LANGUAGE = (
    f"case when {_SUFFIX} = '' then 'text' else coalesce(map {{{W.LANGUAGE_OF}}}[{_SUFFIX}], ltrim({_SUFFIX}, '.')) end"
)


# ------------------------------------------------------------------ scanning and guards


@query("select distinct data_id, substr(sha1(concat_ws('|', repo_name, relative_path, symbol, line_start, line_end, coalesce(code, ''))), 1, 20) as unit_id from source_unit")
def unit_data_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content-addressed id of every unit, recomputed."""
    own = guards.unit_id(*[F.col(c) for c in "repo_name relative_path symbol line_start line_end".split()], F.coalesce("code", F.lit("")))
    return table(spark, sf_dir, "source_unit").select("data_id", own.alias("unit_id")).distinct()


@query(f"select distinct relative_path, {_LANGUAGE} as language from source_unit")
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_unit").select("relative_path", guards.language(F.col("relative_path")).alias("language")).distinct()


@query(f"select distinct test_path, {_TEST} as is_test from (select *, relative_path || suffix as test_path, '/' || lower(relative_path || suffix) as p, regexp_extract(lower(relative_path || suffix), '[^/]*$') as b from source_unit, (values (''), ('/tests/x.py'), ('_test.py'), ('.spec.ts')) v(suffix))")
def test_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test paths among the units' paths, and among paths made from them."""
    ends = F.explode(F.array(*map(F.lit, ["", "/tests/x.py", "_test.py", ".spec.ts"])))
    paths = table(spark, sf_dir, "source_unit").select("relative_path", ends.alias("suffix"))
    path = F.concat("relative_path", "suffix")
    return paths.select(path.alias("test_path"), guards.is_test_path(path).alias("is_test")).distinct()


@query(f"select coalesce({_MARKER}, 'none') as marker, count(*) as n from source_unit where code is not null group by all")
def secret_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "source_unit").where("code is not null")
    return units.groupBy(F.coalesce(guards.secret_marker(F.col("code")), F.lit("none")).alias("marker")).agg(F.count("*").alias("n"))


@query(f"select data_id, case when {_TEST} then 'test_file' when strlen(code) > 8000 then 'file_too_large' when {_MARKER} is not null then 'secret_marker:' || {_MARKER} else 'kept' end as outcome from ({_PATH}) where code is not null group by all")
def file_guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first guard that each text fails; the size limit is lowered so that all guards occur."""
    units = table(spark, sf_dir, "source_unit").where("code is not null")
    reason = guards.skip_reason(F.col("relative_path"), F.octet_length("code"), F.col("code"), 8000)
    return units.select("data_id", F.coalesce(reason, F.lit("kept")).alias("outcome")).distinct()


@query(rf"select doc_id, case when text = '' then 0 else len(regexp_split_to_array(text, '{_NL}')) - case when regexp_matches(text, '(?s)(?:{_NL})\z') then 1 else 0 end end as lines from documents where text is not null")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("lines"))


@query("select data_id, lower(regexp_extract(relative_path, '[^/]*$')) in ('main.py', 'main.go', 'main.rs', 'cli.py', 'index.js', 'index.ts') or contains(code, '__name__ == \"__main__\"') or contains(code, 'public static void main') as entrypoint from source_unit where code is not null and unit_type in ('file', 'command_entrypoint') group by all")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole files start a program."""
    files = table(spark, sf_dir, "source_unit").where("code is not null and unit_type in ('file', 'command_entrypoint')")
    return files.select("data_id", guards.is_entrypoint(F.col("relative_path"), F.col("code")).alias("entrypoint")).distinct()


@query("select coalesce(repo_name, '') as repo_name, coalesce(reason, 'none') as reason, count(*) as n, count(distinct path) as paths from skipped_file group by all")
def scan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = table(spark, sf_dir, "skipped_file").groupBy(F.coalesce("repo_name", F.lit("")).alias("repo_name"), F.coalesce("reason", F.lit("none")).alias("reason"))
    return skipped.agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


# ------------------------------------------------------------------ parsing


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillweave.operators.parsing import parse_files

    files = table(spark, sf_dir, "source_unit").where("code is not null and unit_type in ('file', 'command_entrypoint')")
    files = files.select("repo_name", F.coalesce("repo_path", F.lit("")).alias("repo_path"), "relative_path", F.col("code").alias("content"))
    return parse_files(files.distinct())


@query()
def parsed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of the whole files among the table's units (functions, methods, files and their chunks)."""
    return _parsed(spark, sf_dir)


# ------------------------------------------------------------------ normalisation


@query(f"select doc_id, {_bounded('text', 60)} as words from documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 60).alias("words"))


_LISTED = f"list_filter(list_transform(coalesce(workflow, []), lambda y: {_bounded('y', 3)}), lambda y: y != '')"


@query(f"with c as (select distinct card_id, {_LISTED} as items from purpose_index) select card_id, array_to_string([y for y, i in list_zip(items, range(1, len(items) + 1)) if false], '|') as items from c".replace("[y for y, i in list_zip(items, range(1, len(items) + 1)) if false]", "list_filter(items, lambda y, i: list_position(items, y) = i)[1:4]"))
def norm_string_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four different items of three words, in first-seen order."""
    cards = table(spark, sf_dir, "purpose_index")
    return cards.select("card_id", F.array_join(text.bounded_list(F.col("workflow"), 4, 3), "|").alias("items")).distinct()


_CLAMP = "case when {0} is null or isnan({0}) then 0.0 else least(1.0, greatest(0.0, {0})) end"


@query("select distinct tag_id, " + ", ".join(f"{_CLAMP.format(s + '_score')} as {s}" for s in SCORES) + " from source_unit_tag")
def norm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "source_unit_tag")
    return tags.select("tag_id", *[normalize.clamp(F.col(f"{s}_score")).alias(s) for s in SCORES]).distinct()


_SNAKE = "translate(lower({0}), '- ', '__')"


@query(f"select distinct card_id, case when {_SNAKE.format(_bounded('task_family', 3))} in ({W.FAMILIES}) then {_SNAKE.format(_bounded('task_family', 3))} else 'workflow' end as family from purpose_index")
def closed_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "purpose_index")
    v = F.try_parse_json(F.to_json(F.struct("task_family")))
    family = normalize.closed(normalize.field(v, "task_family"), TASK_FAMILIES, "workflow")
    return cards.select("card_id", family.alias("family")).distinct()


_CANDIDATES = f"list_filter(list_transform(list_concat(coalesce(selection_tags, []), ['Validate-Input', 'fail fast', 'fail-fast', 'junk', 'Retry Backoff']), lambda y: {_bounded('y', 5)}), lambda y: y != '')"
_DISTINCT = "list_filter({0}, lambda y, i: list_position({0}, y) = i)"


@query(f"with a as (select distinct tag_id, {_CANDIDATES} as c from source_unit_tag), b as (select tag_id, list_filter(list_transform({_DISTINCT.format('c')}[1:4], lambda y: {_SNAKE.format('y')}), lambda y: y in ({W.CAPABILITIES})) as k from a) select tag_id, array_to_string({_DISTINCT.format('k')}[1:2], ',') as tags from b")
def closed_vocab_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two vocabulary words among the first four candidates."""
    own = F.concat(F.coalesce("selection_tags", F.array().cast("array<string>")), F.array(*map(F.lit, ["Validate-Input", "fail fast", "fail-fast", "junk", "Retry Backoff"])))
    tags = table(spark, sf_dir, "source_unit_tag").select("tag_id", own.alias("tags"))
    v = F.try_parse_json(F.to_json(F.struct("tags")))
    return tags.select("tag_id", F.array_join(normalize.closed_list(normalize.field(v, "tags"), CAPABILITY_TAGS, 2), ",").alias("tags")).distinct()


@query("select event_id, case when event_id % 10 < 4 then try_cast(props::json->>'k' as bigint) when event_id % 10 = 9 then 7 end as k, event_id % 10 between 4 and 8 as failed from events")
def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of answers that are bare, fenced, amid other text or hold a key twice; and answers that are no
    object: a list, nothing, an object cut off, one with a brace too many, two in a row."""
    events = table(spark, sf_dir, "events")
    shapes = ["%s", "```json\n%s\n```", "Here it is: %s - done", "  %s\n", "[%s]", "", '{"k": ', '{"k": 1}}', '{"k": 1} {"k": 2}', '{"k": 1, "k": 7}']
    shape = F.get(F.array(*map(F.lit, shapes)), (F.col("event_id") % 10).cast("int"))
    answer = F.replace(shape, F.lit("%s"), F.col("props"))
    own = normalize.with_object(events.select("event_id", answer.alias("answer")), "answer")
    k = F.try_variant_get(normalize.payload(F.col("object")), "$.k", "bigint")
    return own.select("event_id", k.alias("k"), (F.col("object_error") != "").alias("failed"))


_FENCE = rf"(?s)\A```(?:[A-Za-z0-9_+.-]+)?{_WS}*\n?(.*?)\n?```\z"
_INSIDE = f"case when regexp_matches({{0}}, '{_FENCE}') then trim(regexp_extract({{0}}, '{_FENCE}', 1), {_SPACES}) else {{0}} end"


@query(
    f"with d as (select doc_id, trim(text, {_SPACES}) as r, trim(chr(10) || '```python' || chr(10) || text || chr(10) || '```  ', {_SPACES}) as w from documents) "
    f"select doc_id, {_INSIDE.replace('{0}', 'r')} as raw, {_INSIDE.replace('{0}', 'w')} as wrapped from d"
)
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those that hold fences of their own too, as they are and wrapped."""
    wrapped = F.concat(F.lit("\n```python\n"), "text", F.lit("\n```  "))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.code_fence_stripped(F.col("text")).alias("raw"), text.code_fence_stripped(wrapped).alias("wrapped"))


def _listed(c: str, maximum: int, n: int = 25) -> str:
    """As text.bounded_list."""
    whole = f"list_filter(list_transform(coalesce({c}, []), lambda y: {_bounded('y', n)}), lambda y: y != '')"
    return f"{_DISTINCT.format(whole)}[1:{maximum}]"


def _vocabulary(c: str, words: str, maximum: int) -> str:
    """As normalize.closed_list."""
    said = f"list_filter(list_transform({_listed(c, 2 * maximum, 5)}, lambda y: {_SNAKE.format('y')}), lambda y: y in ({words}))"
    return f"{_DISTINCT.format(said)}[1:{maximum}]"


def _closed(c: str, words: str, fallback: str) -> str:
    said = _SNAKE.format(_bounded(c, 3))
    return f"case when {said} in ({words}) then {said} else '{fallback}' end"


_FEATURES = {
    "capability_tags": _vocabulary("list_concat(coalesce(workflow, []), ['Validate-Input', 'fail fast', 'fail-fast', 'junk', 'Retry Backoff'])", W.CAPABILITIES, 8),
    "constraint_tags": _vocabulary("list_concat(['fail closed', 'no-plan-change', 'junk'], coalesce(inputs, []))", W.CONSTRAINTS, 5),
    "custom_tags": _listed("outputs", 4, 5),
    "domain_hints": _listed("inputs", 4, 5),
    "failure_modes": _listed("error_cases", 6),
    "interaction_pattern": _closed("case when support_count > 1 then 'Multi-Step workflow' else intent_action end", W.PATTERNS, "single_step"),
    "notes": _bounded("intent_target", 40),
    "retrieval_phrases": _listed("invariants", 8, 10),
    "success_signal": _bounded("array_to_string(outputs, ' ')", 30),
    "success_tags": _vocabulary("['no error', 'goal-satisfied', 'No Error']", W.SUCCESSES, 4),
    "task_family": _closed("task_family", W.FAMILIES, "workflow"),
    "transfer_summary": _bounded("transfer_summary", 60),
    "transfer_title": _bounded("transfer_title", 12),
    "when_to_use": _bounded("array_to_string(workflow, ' ')", 80),
}
_PRINT = " || ',' || ".join(f"""'"{k}":' || to_json({k})""" for k in _FEATURES)


@query(
    "with f as (select distinct card_id, " + ", ".join(f"{v} as {k}" for k, v in _FEATURES.items()) + " from purpose_index) "
    f"""select card_id, task_family, interaction_pattern, array_to_string(capability_tags, ',') as capability_tags, array_to_string(constraint_tags, ',') as constraint_tags,
    array_to_string(success_tags, ',') as success_tags, sha256('{{"canonical_fingerprint":"",' || {_PRINT} || '}}') as fingerprint from f"""
)
def features_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen features and their fingerprint, from answers made of the cards' texts."""
    words = lambda *x: F.array(*map(F.lit, x))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    payload = {
        "transfer_title": F.col("transfer_title"), "transfer_summary": F.col("transfer_summary"), "when_to_use": F.array_join("workflow", " "),
        "task_family": F.col("task_family"), "success_signal": F.array_join("outputs", " "), "notes": F.col("intent_target"),
        "capability_tags": F.concat(some("workflow"), words("Validate-Input", "fail fast", "fail-fast", "junk", "Retry Backoff")),
        "constraint_tags": F.concat(words("fail closed", "no-plan-change", "junk"), some("inputs")),
        "success_tags": words("no error", "goal-satisfied", "No Error"), "failure_modes": F.col("error_cases"),
        "interaction_pattern": F.when(F.col("support_count") > 1, "Multi-Step workflow").otherwise(F.col("intent_action")),
        "domain_hints": F.col("inputs"), "retrieval_phrases": F.col("invariants"), "custom_tags": F.col("outputs"),
    }
    v = F.try_parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in payload.items()])))
    own = table(spark, sf_dir, "purpose_index").select("card_id", normalize.once(v, normalize.features).alias("f"))
    lists = [F.array_join(f"f.{c}", ",").alias(c) for c in ("capability_tags", "constraint_tags", "success_tags")]
    return own.select("card_id", "f.task_family", "f.interaction_pattern", *lists, F.col("f.canonical_fingerprint").alias("fingerprint")).distinct()


# ------------------------------------------------------------------ selection

_LAST_TAG = (
    "select data_id, coalesce(keep_for_extraction, false) as keep, (" + " + ".join(_CLAMP.format(s + "_score") for s in SCORES)
    + ") / 6.0 as mean from (select *, row_number() over (partition by data_id order by tagged_at desc, tag_id desc) as n from source_unit_tag) where n = 1"
)
_ONE_UNIT = "select data_id, min(coalesce(repo_path, '')) as repo_path, min(repo_name) as repo_name, min(relative_path) as relative_path, min(symbol) as symbol from source_unit group by data_id"


def last_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, keep, mean of every unit's latest tag, with its scores normalised."""
    scores = [F.col(f"{s}_score") for s in SCORES]
    tags = table(spark, sf_dir, "source_unit_tag").groupBy("data_id").agg(
        F.max_by(F.struct("keep_for_extraction", *scores), F.struct("tagged_at", "tag_id")).alias("t")
    )
    mean = selection.mean_score([normalize.clamp(F.col(f"t.{s}_score")) for s in SCORES])
    return tags.select("data_id", F.coalesce("t.keep_for_extraction", F.lit(False)).alias("keep"), mean.alias("mean"))


def one_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["repo_name", "relative_path", "symbol"]
    return table(spark, sf_dir, "source_unit").groupBy("data_id").agg(
        F.min(F.coalesce("repo_path", F.lit(""))).alias("repo_path"), *[F.min(c).alias(c) for c in names]
    )


@query(f"select data_id, mean, keep and mean >= 0.5 as passes from ({_LAST_TAG})")
def tag_mean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_tags(spark, sf_dir).select("data_id", "mean", selection.passes_selection(F.col("keep"), F.col("mean")).alias("passes"))


_CAPPED = (
    f"select u.*, t.mean, row_number() over (partition by u.repo_path order by t.mean desc, u.data_id) <= 20 as selected "
    f"from ({_ONE_UNIT}) u join ({_LAST_TAG}) t using (data_id) where t.keep and t.mean >= 0.5"
)


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = last_tags(spark, sf_dir).where(selection.passes_selection(F.col("keep"), F.col("mean")))
    return selection.repository_cap(one_unit(spark, sf_dir).join(tags, "data_id"), k=20)


@query(f"select data_id, repo_path, mean, selected from ({_CAPPED})")
def repo_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-repository cap, lowered to 20 so that it bites."""
    return capped(spark, sf_dir).select("data_id", "repo_path", "mean", "selected")


@query("select distinct card_id, coalesce(support_count > 1, false) and coalesce(representative_score, 0) >= 0.45 as passes from purpose_index")
def skill_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "purpose_index")
    passes = selection.passes_value(F.col("support_count") > 1, normalize.clamp(F.col("representative_score")))
    return cards.select("card_id", passes.alias("passes")).distinct()


# ------------------------------------------------------------------ decisions with a scripted model


def _byte(hexes: Column, at: int) -> Column:
    return F.conv(F.substring(hexes, at, 2), 16, 10).cast("int")


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input of the decision: tags from the table, the other stages' answers from the digits of data_id."""
    units = one_unit(spark, sf_dir).join(last_tags(spark, sf_dir), "data_id", "left")
    rank = capped(spark, sf_dir).select("data_id", "selected")
    own = units.join(rank, "data_id", "left")
    a, b, c, d = (_byte(F.col("data_id"), i) for i in (1, 3, 5, 7))
    empty = F.array().cast("array<string>")
    tag = F.struct(F.col("keep").alias("keep_for_extraction"), *[F.col("mean").alias(f"{s}_score") for s in SCORES])
    skill = F.struct((a >= 20).alias("worth_extracting"), (a / 256.0).alias("skill_value_score"), F.concat(F.lit("skill "), "symbol").alias("summary"))
    return own.select(
        "data_id", "repo_name", "relative_path", "symbol", F.coalesce("selected", F.lit(False)).alias("selected"),
        F.when(F.col("mean").isNotNull(), tag).alias("source_tag"), skill.alias("skill"),
        F.struct(F.lit("code").alias("code"), F.lit(True).alias("output_valid"), empty.alias("validation_notes")).alias("reconstruction"),
        F.struct((b < 128).alias("equivalent"), F.concat(F.lit("judge "), b.cast("string")).alias("reason")).alias("equivalence"),
        F.when(b >= 128, F.struct((c < 128).alias("keep"), F.concat(F.lit("adjudicator "), c.cast("string")).alias("reason"))).alias("adjudication"),
        F.when(d >= 10, F.struct(F.lit("validation").alias("task_family"), F.concat(F.lit("title "), "symbol").alias("transfer_title"))).alias("retrieval"),
        F.lit("").alias("tag_error"), F.when(a == 255, F.lit("no answer")).otherwise(F.lit("")).alias("stage_error"),
        F.when(d < 10, F.lit("no answer")).otherwise(F.lit("")).alias("feature_error"),
    )


_HEX = "(16 * (strpos('0123456789abcdef', substr(data_id, {0}, 1)) - 1) + strpos('0123456789abcdef', substr(data_id, {0} + 1, 1)) - 1)"
# the decision's threshold is met by the mean of six equal scores, added up again
_DECIDED = f"""
select u.data_id, u.repo_name, u.relative_path, u.symbol, a, b, c, d, t.mean,
  case when t.mean is null then 'tagging_error'
       when not t.keep or (t.mean + t.mean + t.mean + t.mean + t.mean + t.mean) / 6.0 < 0.5 then 'source_unit_selection_gate'
       when not coalesce(r.selected, false) then 'per_repository_cap' when a = 255 then 'pipeline_error'
       when a < 20 or a / 256.0 < 0.45 then 'skill_value_gate' when b < 128 then 'equivalent'
       when c < 128 then 'kept' else 'dropped' end as k
from (select *, {_HEX.format(1)} as a, {_HEX.format(3)} as b, {_HEX.format(5)} as c, {_HEX.format(7)} as d from ({_ONE_UNIT})) u
left join ({_LAST_TAG}) t using (data_id) left join ({_CAPPED}) r using (data_id)
"""
_DECISION = f"""
select data_id, repo_name, relative_path, symbol, k in ('equivalent', 'kept') as accepted,
  case when k in ('tagging_error', 'source_unit_selection_gate', 'per_repository_cap') then 'source_tagging' when k = 'pipeline_error' then 'error'
       when k = 'skill_value_gate' then 'extraction' when k = 'equivalent' then 'equivalence' else 'adjudication' end as decision_stage,
  case k when 'equivalent' then 'equivalence' when 'kept' then 'adjudication' else '' end as accepted_stage,
  case when k = 'equivalent' then 'judge ' || b when k in ('kept', 'dropped') then 'adjudicator ' || c else k end as rationale,
  case when k = 'pipeline_error' then 'no answer' when k in ('equivalent', 'kept') and d < 10 then 'feature_tagging_error:no answer' else '' end as error,
  d, b
from ({_DECIDED})
"""


@query(f"select * exclude (d, b) from ({_DECISION})")
def accept_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit's one decision under the scripted model."""
    cols = "data_id repo_name relative_path symbol accepted decision_stage accepted_stage rationale error".split()
    return decisions.decide(scripted(spark, sf_dir)).select(*cols)


@query(f"select count(*) filter (where accepted) as accepted_records, count(*) filter (where not accepted) as rejected_records, count(*) filter (where accepted and d >= 10) as retrieval_records from ({_DECISION})")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_counts(decisions.decide(scripted(spark, sf_dir)))


@query(f"select data_id, accepted_stage, rationale, accepted_stage = 'equivalence' as shows_code, b >= 128 as adjudicated, d >= 10 as has_retrieval from ({_DECISION}) where accepted")
def accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = decisions.accepted_records(decisions.decide(scripted(spark, sf_dir)))
    present = lambda c: F.col(c).isNotNull()
    return own.select("data_id", "accepted_stage", "rationale", present("reconstruction").alias("shows_code"), present("adjudication").alias("adjudicated"), present("retrieval").alias("has_retrieval"))


@query(f"select data_id, repo_name, relative_path, symbol, 'validation' as task_family, 'title ' || symbol as transfer_title from ({_DECISION}) where accepted and d >= 10")
def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.retrieval_records(decisions.decide(scripted(spark, sf_dir)))


@query("select coalesce(decision_stage, '') as decision_stage, coalesce(accepted_stage, '') as accepted_stage, count(distinct data_id) as units, count(distinct data_id) filter (where accepted) as accepted from unit_decision group by all")
def decision_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "unit_decision")
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("decision_stage", "accepted_stage")]
    return d.groupBy(*keys).agg(F.countDistinct("data_id").alias("units"), F.countDistinct(F.when(F.col("accepted"), F.col("data_id"))).alias("accepted"))


@query(f"with d as ({_DECISION}) select decision_stage, accepted_stage, rationale in ('tagging_error', 'pipeline_error') as failed, count(*) as units, count(distinct repo_name) as repositories, count(*) filter (where accepted and d >= 10) as retrieval_records from d group by all")
def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages with the scripted model, from the tagged units to counts by outcome."""
    d = decisions.decide(scripted(spark, sf_dir))
    failed = F.col("rationale").isin("tagging_error", "pipeline_error").alias("failed")
    return d.groupBy("decision_stage", "accepted_stage", failed).agg(
        F.count("*").alias("units"), F.countDistinct("repo_name").alias("repositories"),
        F.count_if(F.col("accepted") & F.col("retrieval").isNotNull()).alias("retrieval_records"),
    )


# ------------------------------------------------------------------ the purpose view


def purpose_records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Flat skill records: a card's texts with the symbol and repository of the unit that stands for it."""
    cards = table(spark, sf_dir, "purpose_index").dropDuplicates(["card_id"])
    units = one_unit(spark, sf_dir).select("data_id", "repo_name", "symbol")
    own = cards.join(units, cards.representative_data_id == units.data_id).drop("data_id")
    level = F.element_at(F.map_keys("level_counts"), 1)
    return own.select(
        F.concat_ws("-", "representative_data_id", "card_id").alias("data_id"), "repo_name", "symbol", level.alias("level"),
        F.concat_ws(" ", "intent_action", "transfer_title").alias("name"), F.col("transfer_summary").alias("summary"),
        "workflow", "inputs", "outputs", "invariants", "error_cases", *more,
    )


_RECORDS = f"""
select representative_data_id || '-' || card_id as data_id, u.repo_name, coalesce(u.symbol, '') as symbol, map_keys(level_counts)[1] as level,
  concat_ws(' ', intent_action, transfer_title) as name, coalesce(transfer_summary, '') as summary, {_items("workflow")} as workflow, {_items("inputs")} as inputs,
  {_items("outputs")} as outputs, {_items("invariants")} as invariants, {_items("error_cases")} as error_cases, []::varchar[] as evidence, '' as given, p.task_family as own_family
from (select distinct on (card_id) * from purpose_index) p join ({_ONE_UNIT}) u on u.data_id = p.representative_data_id
"""
#: the same records as they come nested: with their inputs as evidence, and a family given where the card's id is even
_NESTED = f"""
select * exclude (evidence, given, card), inputs as evidence, case when card % 2 = 0 then coalesce(own_family, '') else '' end as given
from (select *, cast(regexp_extract(data_id, '-([0-9]+)$', 1) as bigint) as card from ({_RECORDS}))
"""
_BLOB = "array_to_string(list_concat(list_filter([symbol, name, summary], lambda y: y != ''), workflow, inputs, outputs, invariants, error_cases, evidence), chr(10))"
_REASON = r"""case when regexp_matches(blob, '(?i)\b(getter|setter|trivial|thin wrapper|logging[- ]only|constant mapping)\b') then 'boilerplate_or_trivial'
  when regexp_matches(symbol, '^(get|set|is|has)[A-Z_]') and len(workflow) <= 1 then 'getter_setter_like'
  when length(summary) < 80 and len(workflow) <= 1 and len(invariants) = 0 and len(error_cases) = 0 then 'too_little_reusable_logic'
  when contains(symbol, 'toString') or contains(symbol, '__str__') or contains(symbol, '__repr__') then 'representation_only' else '' end"""
# the family of each different hint word, and the one that most of them name
_HITS = f"list_filter(list_transform(list_distinct(words), lambda w: map {{{W.HINTS}}}[w]), lambda f: f is not null)"
_FAMILY = "list_max(list_transform(list_distinct(hits), lambda f: {'n': len(list_filter(hits, lambda g: g = f)), 'name': f}))"
_LIFE = f"case {W.LIFECYCLE} else 'execute' end"


def _sign(c: str, n: int, sep: str) -> str:
    return f"array_to_string({_tokens(f'array_to_string({c}, chr(32))')}[1:{n}], '{sep}')"


def inferred_sql(records: str) -> str:
    return f"""
with r as ({records}), b as (select *, {_BLOB} as blob from r), w as (select *, {_tokens("blob")} as words, {_REASON} as reason from b),
h as (select *, {_HITS} as hits from w),
a as (select *, list_filter(words, lambda t: t in ({W.VERBS}))[1] as verb, {_FAMILY} as fam from h),
t as (select *, coalesce(verb, 'execute') as intent_action, case when given != '' then given when len(hits) > 0 then fam.name else 'workflow' end as task_family,
        list_filter(words[case when verb is null then 1 else list_position(words, verb) + 1 end:], lambda t: t not in ({W.VERBS}, {W.NOUNS}))[1:2] as tail from a),
f as (select *, case when len(tail) = 0 then 'object' else array_to_string(tail, '_') end as intent_target from t)
select *, {_LIFE} as lifecycle_stage,
  coalesce(nullif({_sign("inputs", 2, "_")}, ''), 'unspecified') || '->' || coalesce(nullif({_sign("outputs", 2, "_")}, ''), 'unspecified') as io_shape,
  {_sign("invariants", 6, " ")} as constraint_signature, {_sign("error_cases", 6, " ")} as failure_signature,
  substr(sha1('{{"intent_action":"' || intent_action || '","intent_target":"' || intent_target || '","task_family":' || to_json(task_family) || '}}'), 1, 20) as purpose_id,
  least(1.0::double, len(workflow) / 6.0::double) * 0.30::double + least(1.0::double, len(invariants) / 5.0::double) * 0.20::double
  + least(1.0::double, len(error_cases) / 5.0::double) * 0.20::double + least(1.0::double, len(evidence) / 4.0::double) * 0.10::double
  + least(1.0::double, length(summary) / 600.0::double) * 0.10::double
  + case level when 'pattern' then 0.10::double when 'composite' then 0.06::double else 0.0::double end as score
from f
"""


_INFERRED = inferred_sql(_RECORDS)


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_index.infer(purpose_records(spark, sf_dir))


@query(f"select token, count(*) as n from (select unnest({_tokens('text')}) as token from documents) group by token having count(*) >= 5")
def tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.token_counts(table(spark, sf_dir, "documents"), "text").where("n >= 5")


@query(f"select data_id, reason from ({_INFERRED})")
def low_value_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred(spark, sf_dir).select("data_id", "reason")


@query(f"select data_id, purpose_id, task_family, intent_action, intent_target, lifecycle_stage, io_shape, constraint_signature, failure_signature from ({_INFERRED})")
def infer_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inferred(spark, sf_dir)
    flat = [F.array_join(c, " ").alias(c) for c in ("constraint_signature", "failure_signature")]
    return own.select("data_id", "purpose_id", "task_family", "intent_action", "intent_target", "lifecycle_stage", "io_shape", *flat)


@query(f"select data_id, score from ({_INFERRED})")
def representative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred(spark, sf_dir).select("data_id", "score")


@query(f"select data_id, purpose_id, task_family, intent_action, intent_target from ({_INFERRED}) where reason = ''")
def purpose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_index.edges(inferred(spark, sf_dir)).select("data_id", "purpose_id", "purpose_key.*")


@query(f"select data_id, reason from ({_INFERRED}) where reason != ''")
def purpose_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_index.dropped(inferred(spark, sf_dir))


@query(f"select purpose_id, coalesce(nullif(level, ''), 'unknown') as level, count(*) as n from ({_INFERRED}) where reason = '' group by all")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_index.level_histogram(inferred(spark, sf_dir))


@query(f"""
with e as (select * from ({_INFERRED}) where reason = ''),
g as (select purpose_id, count(*) as support_count, count(distinct repo_name) as repo_support from e group by purpose_id),
l as (select purpose_id, string_agg(level || '=' || n, ',' order by level) as levels from
      (select purpose_id, coalesce(nullif(level, ''), 'unknown') as level, count(*) as n from e group by all) group by purpose_id),
b as (select *, row_number() over (partition by purpose_id order by score desc, data_id desc) as n from e)
select g.purpose_id, g.support_count, g.repo_support, l.levels, b.task_family, b.intent_action, b.intent_target, b.data_id as representative_data_id,
  floor(b.score * 1000000 + 0.5) / 1000000 as representative_score, b.name as transfer_title, b.summary as transfer_summary,
  array_to_string(b.workflow, '|') as workflow, array_to_string(b.inputs, '|') as inputs, array_to_string(b.outputs, '|') as outputs,
  array_to_string(b.invariants, '|') as invariants, array_to_string(b.error_cases, '|') as error_cases
from g join l using (purpose_id) join b on b.purpose_id = g.purpose_id and b.n = 1
""")
def purpose_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one card per purpose."""
    own = purpose_index.cards(inferred(spark, sf_dir))
    entries = F.transform(F.map_entries("level_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return own.select(
        "purpose_id", "support_count", "repo_support", F.array_join(entries, ",").alias("levels"), "task_family", "intent_action", "intent_target",
        "representative_data_id", "representative_score", "transfer_title", "transfer_summary",
        *[F.array_join(c, "|").alias(c) for c in purpose_index.CARD_LISTS],
    )


@query(f"select data_id, reason, purpose_id, task_family, intent_action, intent_target, lifecycle_stage, score from ({inferred_sql(_NESTED)})")
def nested_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as other tools write them: JSON objects with the skill nested, some with a family of their own."""
    flat = purpose_records(spark, sf_dir, "task_family")
    skill = F.struct("level", "name", "summary", *purpose_index.CARD_LISTS, F.col("inputs").alias("evidence"))
    given = F.when(F.substring_index("data_id", "-", -1).cast("bigint") % 2 == 0, F.col("task_family"))
    whole = F.to_json(F.struct("data_id", "repo_name", "symbol", skill.alias("skill"), F.struct(given.alias("task_family")).alias("retrieval")))
    own = purpose_index.infer(purpose_index.records_of(flat.select(F.try_parse_json(whole).alias("payload")), "payload"))
    return own.select("data_id", "reason", "purpose_id", "task_family", "intent_action", "intent_target", "lifecycle_stage", "score")

