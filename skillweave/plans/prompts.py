"""The messages of each stage, as Columns.

What a stage may see is the contract: regeneration sees neither source, repository nor path; the equivalence
judge sees the skill's summary but not the skill; neither judge sees the unit's type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweave.functions.normalize import SKILL_LISTS
from skillweave.functions.vocab import CAPABILITY_TAGS, CONSTRAINT_TAGS, INTERACTION_PATTERNS, SCORES, SUCCESS_TAGS, TASK_FAMILIES


def _messages(system: str, parts: list[Column]) -> Column:
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", F.concat(*parts)))


def _text(s: str) -> Column:
    return F.lit(s)


def _line(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"))


def _block(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"\n{name}:\n"), F.coalesce(c, F.lit("")), F.lit("\n"))


def _json(c: str) -> Column:
    return F.to_json(F.col(c))


def _where() -> list[Column]:
    return [_line("Repository", F.col("repo_name")), _line("Path", F.col("relative_path"))]


def _lines() -> Column:
    return F.concat(F.lit("Lines: "), F.col("line_start").cast("string"), F.lit(" to "), F.col("line_end").cast("string"), F.lit("\n"))


def chunk_context() -> Column:
    """A sentence on the chunk's place, "" for whole units."""
    m = "parser_metadata."
    said = F.concat(
        F.lit("This is chunk "), F.col(m + "chunk_index").cast("string"), F.lit(" of "), F.col(m + "chunk_count").cast("string"),
        F.lit(" of "), F.col(m + "parent_symbol"), F.lit("; state only what this chunk shows.\n"),
    )
    return F.when(F.coalesce(F.col(m + "chunk_count"), F.lit(0)) > 0, said).otherwise(F.lit(""))


_TAG_KEYS = "keep_for_extraction (boolean), selection_rationale (text), " + ", ".join(f"{s}_score" for s in SCORES) + " (numbers from 0 to 1), selection_tags and risk_tags (lists of texts)"
_SKILL_KEYS = (
    "level (atomic, composite or pattern), name, summary (at most 80 words), worth_extracting (boolean), worth_reason, skill_value_score, "
    "generality_score, abstraction_score, confidence (numbers from 0 to 1) and the lists " + ", ".join(SKILL_LISTS) + " (at most 6 items of 25 words)"
)


def source_tagging() -> Column:
    system = (
        "You rate units of source code as evidence for reusable procedures. Rate low what is trivial: accessors, plain wrappers, "
        "constants, layout, conventions of one project. Rely on the code alone. Answer with one JSON object."
    )
    ask = (
        f"Rate this unit. Keys of the answer: {_TAG_KEYS}.\nreusable_intent: more than local plumbing. procedural_steps: ordered steps, "
        "branches, changes of state, calls. boundary_conditions: preconditions, invariants, checks, error paths. transferability: can be "
        "told without the project's names. interface_sufficiency: inputs, outputs and effects can be recovered. non_triviality: no "
        "accessor, wrapper or boilerplate.\n\n"
    )
    return _messages(
        system,
        [_text(ask), *_where(), _line("Language", F.col("language")), _line("Symbol", F.col("symbol")), _line("Unit type", F.col("unit_type")),
         _lines(), _line("Interface", F.col("interface")), _line("Parser metadata", _json("parser_metadata")), _block("Code", F.col("code"))],
    )


def extraction() -> Column:
    system = (
        "You write down the reusable skill that a piece of source code implements. Say only what the code supports, invent no context. "
        "Obvious helpers are not worth extracting. Answer with one compact JSON object."
    )
    return _messages(
        system,
        [_text(f"Extract the skill. Keys of the answer: {_SKILL_KEYS}. Quote no code.\n\n"), *_where(), _line("Language", F.col("language")),
         _line("Symbol", F.col("symbol")), _line("Unit type", F.col("unit_type")), _lines(), _line("Interface", F.col("interface")),
         chunk_context(), _block("Rating of the unit", _json("source_tag")), _block("Code", F.col("code"))],
    )


def regeneration() -> Column:
    system = "You write code from a skill's description and an interface, and from nothing else. Keep the described behaviour, add no feature. Answer with code only."
    ask = "Write the unit that this skill describes. Keep its interface, its behaviour and its edge cases; rely on no state outside unless the skill says so.\n\n"
    return _messages(
        system,
        [_text(ask), _line("Language", F.col("language")), _line("Symbol", F.col("symbol")), _line("Unit type", F.col("unit_type")),
         _line("Interface", F.col("interface")), chunk_context(), _block("Skill", _json("skill"))],
    )


def equivalence() -> Column:
    system = "You judge strictly whether two pieces of code do the same: behaviour, side effects, results, errors. Style and names don't matter. Answer with one JSON object."
    ask = "Compare both units. Keys of the answer: equivalent (boolean), confidence (number from 0 to 1), reason, differences (list of texts), risk_level (low, medium or high).\n\n"
    return _messages(
        system,
        [_text(ask), _line("Language", F.col("language")), _line("Symbol", F.col("symbol")), _line("Interface", F.col("interface")),
         chunk_context(), _line("Summary of the skill", F.col("skill.summary")), _block("Original", F.col("code")), _block("Generated", F.col("generated"))],
    )


def adjudication() -> Column:
    system = "A skill and the code made from it disagree with the source. You decide whether the skill itself is true to the source, even where the code is not. Answer with one JSON object."
    ask = "Decide whether to keep the skill. Keys of the answer: keep, skill_is_correct, generation_failed (booleans), reason, corrective_notes (list of texts).\n\n"
    return _messages(
        system,
        [_text(ask), _line("First judgement", F.col("first_reason")), _line("Language", F.col("language")), _line("Symbol", F.col("symbol")),
         _line("Interface", F.col("interface")), chunk_context(), _block("Original", F.col("code")), _block("Skill", _json("skill")), _block("Generated", F.col("generated"))],
    )


FEATURE_SKILL = ["level", "summary", "worth_extracting", "skill_value_score", "generality_score", "abstraction_score", *SKILL_LISTS, "confidence"]


def feature_payload() -> Column:
    """Provenance and the skill's fields side by side, without its name and the reason of its worth."""
    heads = [F.col(c) for c in ("data_id", "repo_name", "relative_path", "symbol", "accepted_stage", "rationale")]
    return F.struct(*heads, *[F.col(f"skill.{c}").alias(c) for c in FEATURE_SKILL])


def feature_tagging() -> Column:
    system = "You rewrite skills as cards that can be searched for and reused anywhere. Prefer general words to a project's names and take families and tags from the given lists. Answer with one JSON object."
    lists = {
        "task_family": TASK_FAMILIES, "capability_tags (3 to 8)": CAPABILITY_TAGS, "constraint_tags (0 to 5)": CONSTRAINT_TAGS,
        "success_tags (1 to 4)": SUCCESS_TAGS, "interaction_pattern": INTERACTION_PATTERNS,
    }
    given = "".join(f"{k}: {', '.join(v)}\n" for k, v in lists.items())
    ask = (
        "Describe the skill below. Keys from closed lists:\n" + given + "Other keys: transfer_title (6 to 12 words), transfer_summary, when_to_use, "
        "success_signal, failure_modes, domain_hints, retrieval_phrases, custom_tags, notes.\n"
    )
    return _messages(system, [_text(ask), _block("Skill", F.to_json(feature_payload()))])


BUILDERS = {
    "source_tagging": source_tagging, "extraction": extraction, "regeneration": regeneration,
    "equivalence": equivalence, "adjudication": adjudication, "feature_tagging": feature_tagging,
}
