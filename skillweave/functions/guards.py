"""Predicates that keep files and records out, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweave.functions.text import any_of
from skillweave.functions.vocab import LANGUAGES, SECRET_MARKERS, TEST_DIRS, TEST_ENDS, TEST_START

ENTRYPOINT_NAMES = "main.py main.go main.rs cli.py index.js index.ts".split()


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot; "" for names without one and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1))


def is_test_path(path: Column) -> Column:
    """Files under tests/ or test/, named test_*, *_test.py, or *.spec/.test of ts and js."""
    whole = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    name = base_name(whole)
    return any_of([whole.contains(x) for x in TEST_DIRS] + [name.startswith(TEST_START)] + [name.endswith(x) for x in TEST_ENDS])


def secret_marker(text: Column) -> Column:
    """The first marker whose pattern occurs in the text; null if none does."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SECRET_MARKERS):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def skip_reason(path: Column, size: Column, text: Column, max_bytes: int, include_tests: bool = False) -> Column:
    """The first guard that a readable text file fails, null if it passes all."""
    marker = secret_marker(text)
    chain = F.when(size > max_bytes, F.lit("file_too_large")).when(
        marker.isNotNull(), F.concat(F.lit("secret_marker:"), marker)
    )
    return chain if include_tests else F.when(is_test_path(path), F.lit("test_file")).otherwise(chain)


def language(path: Column) -> Column:
    """The language of a path's extension; an unknown extension names itself, none is text."""
    own = file_suffix(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(own == "", F.lit("text")).otherwise(F.coalesce(known[own], F.ltrim(own, F.lit("."))))


def is_entrypoint(path: Column, text: Column) -> Column:
    return any_of(
        [
            F.lower(base_name(path)).isin(ENTRYPOINT_NAMES),
            text.contains('__name__ == "__main__"'),
            text.contains("public static void main"),
        ]
    )


def unit_id(repo: Column, path: Column, symbol: Column, start: Column, end: Column, code: Column) -> Column:
    """20 hexadecimal digits of the unit's provenance, place and body."""
    seed = F.concat_ws("|", repo, path, symbol, start.cast("string"), end.cast("string"), code)
    return F.substring(F.sha1(seed), 1, 20)
