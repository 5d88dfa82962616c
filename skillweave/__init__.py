"""Skill-record analytics on Spark: scan, gate, decide and index source units as DataFrames."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"
#: where the exported names live; they are imported when asked for, as every Python worker imports this package
_EXPORTS = {
    "HttpClient": "plans.models",
    "Pipeline": "plans.pipeline",
    "ScriptedClient": "plans.models",
    "Settings": "plans.config",
    "read_settings": "plans.config",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str) -> object:
    if name in _EXPORTS:
        return getattr(import_module(f"skillweave.{_EXPORTS[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
