"""Settings of a run: one table of keys, from which they are read, checked and written."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from types import SimpleNamespace
from typing import Any, NamedTuple

from skillweave.functions.vocab import LANGUAGES, SKIP_DIRS


class Key(NamedTuple):
    """rule: what a value must meet, with the words that say so."""

    section: str
    name: str
    kind: type
    default: Any = None
    rule: tuple[Callable[[Any], bool], str] | None = None


_FILLED = (bool, "is required")
_COUNT = (lambda x: x >= 1, "must be at least 1")
_SHARE = (lambda x: 0 <= x <= 1, "must be in [0, 1]")

# Names, types and defaults of the settings file, which other tools write too.
KEYS = (
    Key("model", "base_url", str, None, _FILLED),
    Key("model", "model", str, None, _FILLED),
    Key("model", "api_key_env", str, "OPENAI_API_KEY"),
    Key("model", "timeout_seconds", int, 120),
    Key("model", "max_retries", int, 2),
    Key("model", "allow_public_url", bool, False),
    Key("model", "temperature", float, 0.0),
    Key("model", "max_json_tokens", int, 4096),
    Key("model", "max_code_tokens", int, 8192),
    Key("scan", "allowed_extensions", list, tuple(LANGUAGES)),
    Key("scan", "skip_dirs", list, tuple(SKIP_DIRS)),
    Key("scan", "include_tests", bool, False),
    Key("scan", "min_unit_lines", int, 3, _COUNT),
    Key("scan", "max_file_bytes", int, 200_000),
    Key("scan", "max_unit_bytes", int, 12_000),
    Key("scan", "max_units_per_repo", int, 400, _COUNT),
    Key("pipeline", "concurrency", int, 4, _COUNT),
    Key("pipeline", "min_selection_score", float, 0.50, _SHARE),
    Key("pipeline", "min_skill_value_score", float, 0.45, _SHARE),
    Key("pipeline", "build_purpose_index", bool, True),
    Key("pipeline", "store_full_traces", bool, True),
    Key("", "output_dir", str, "runs"),
)
SECTIONS = tuple(dict.fromkeys(k.section for k in KEYS if k.section))


class Section(SimpleNamespace):
    """The keys of one section as attributes; pickled to the executors with the client that uses them."""


def _problems(values: Mapping[tuple[str, str], Any], given: Mapping[str, Any]) -> Iterator[str]:
    known = {(k.section, k.name) for k in KEYS}
    for section in SECTIONS:
        yield from (f"{section}.{name} is unknown" for name in sorted(set(given.get(section) or {}) - {n for s, n in known if s == section}))
    for k in KEYS:
        if k.rule and not _met(k, values[k.section, k.name]):
            yield f"{k.section}.{k.name} {k.rule[1]}"


def _met(key: Key, value: Any) -> bool:
    try:
        return bool(key.rule[0](value))
    except TypeError:
        return False


class Settings:
    """model, scan and pipeline (sections) and output_dir, from a nested mapping as in a settings file.

    Unknown keys within a section and values that break a rule are errors, all of them told at once; what
    stands beside the sections is left alone. A null or an empty section has its defaults.
    """

    model: Section
    scan: Section
    pipeline: Section
    output_dir: str

    def __init__(self, **given: Any) -> None:
        values = {}
        for k in KEYS:
            held = (given.get(k.section) or {}) if k.section else given
            value = held.get(k.name, k.default)
            values[k.section, k.name] = list(value) if k.kind is list and value is not None else value
        for section in SECTIONS:
            setattr(self, section, Section(**{n: v for (s, n), v in values.items() if s == section}))
        self.output_dir = str(values["", "output_dir"] or "runs")
        wrong = list(_problems(values, given))
        if wrong:
            raise ValueError("; ".join(wrong))

    def validate(self) -> None:
        """Again, as attributes may have been set since."""
        wrong = list(_problems({(k.section, k.name): getattr(getattr(self, k.section) if k.section else self, k.name) for k in KEYS}, {}))
        if wrong:
            raise ValueError("; ".join(wrong))

    def to_dict(self) -> dict:
        return {s: dict(vars(getattr(self, s))) for s in SECTIONS} | {"output_dir": self.output_dir}


def read_settings(path: str) -> Settings:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the settings must be one JSON object")
    return Settings(**found)


def model_url(model: Section) -> str:
    """The base URL; env:NAME is looked up and must be set."""
    kind, colon, name = model.base_url.partition(":")
    if kind != "env" or not colon:
        return model.base_url
    found = os.environ.get(name.strip(), "").strip() if name.strip() else ""
    if not found:
        raise ValueError(f"the model URL's environment variable {name.strip()!r} is not set")
    return found
