"""Settings from JSON documents, and the check that operators make of their parameters."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable


def require(sound: bool, what: str) -> None:
    if not sound:
        raise ValueError(what)


def from_json(made: Callable, text: str) -> dict:
    """The members of a JSON object as keyword arguments of ``made``, an operator or a class; unknown names are refused."""
    given = json.loads(text)
    require(isinstance(given, dict), "settings must be a JSON object")
    if unknown := set(given) - set(inspect.signature(made).parameters):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return given
