"""Settings of the plans as records: made by name, from a file or from pairs of a command line, and written beside results."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, get_type_hints


@dataclass(frozen=True)
class PromptSettings:
    """A template with {text}, {language} and {examples}; what is added below it, and from the second try on."""

    template: str = "{examples}\n\nTranslate from {language}:\n{text}"
    instruction: str = ""
    retry: str = ""


@dataclass(frozen=True)
class ExtractionSettings:
    """The document pipeline: which volumes, how many samples, votes and rounds, and what is left out."""

    volumes: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    samples: int = 5
    votes: int = 2
    passes: int = 3
    retries: int = 2
    examples: int = 3
    low: float = 0.3
    high: float = 4.0
    prompt: PromptSettings = field(default_factory=PromptSettings)


@dataclass(frozen=True)
class TrainingSettings:
    """The training table: the profile, folds and bins, ids that are dropped or take the old target."""

    profile: str = "main"
    folds: int = 4
    bins: int = 20
    excluded: tuple[str, ...] = ()
    swapped: tuple[str, ...] = ()


@dataclass(frozen=True)
class PoolSettings:
    """The pool of examples: lengths in characters, and the fold that is left out."""

    most: int = 400
    least: int = 20
    skip_fold: int | None = None
    unique: bool = True


SETTINGS = {"extraction": ExtractionSettings, "training": TrainingSettings, "pool": PoolSettings, "prompt": PromptSettings}


def _value(kind: Any, given: Any) -> Any:
    if dataclasses.is_dataclass(kind):
        return kind(**{k: _value(get_type_hints(kind)[k], v) for k, v in given.items()}) if isinstance(given, dict) else given
    if getattr(kind, "__origin__", None) is tuple:
        parts = given.split(",") if isinstance(given, str) else given
        return tuple(x for x in (str(p).strip() for p in parts) if x)
    if kind == int | None:
        return None if given in (None, "", "none") else int(given)
    if kind is bool and isinstance(given, str):
        if given.lower() not in ("true", "false"):
            raise ValueError(f"{given!r} is neither true nor false")
        return given.lower() == "true"
    return kind(given)


def settings(name: str, given: dict[str, Any] | None = None) -> Any:
    """The record of that name with the given fields, texts turned into the fields' types; an unknown field is an error."""
    kind = SETTINGS[name]
    hints = get_type_hints(kind)
    unknown = sorted(set(given or {}) - set(hints))
    if unknown:
        raise ValueError(f"{name} has no settings {unknown}, only {sorted(hints)}")
    return kind(**{k: _value(hints[k], v) for k, v in (given or {}).items()})


def to_json(record: Any) -> str:
    return json.dumps(dataclasses.asdict(record), ensure_ascii=False, sort_keys=True)


def from_json(name: str, text: str) -> Any:
    return settings(name, json.loads(text))
