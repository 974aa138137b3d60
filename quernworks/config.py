"""Settings of stages from the environment and the command line, laid over a dataclass's own."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import fields, is_dataclass, replace
from typing import TypeVar

T = TypeVar("T")


def _value(text: str, name: str, old: object) -> object:
    """The text as JSON where it is that, else as it stands; it must be of the old value's type, if that tells one."""
    try:
        new = json.loads(text)
    except ValueError:
        new = text
    if isinstance(old, str) and not isinstance(new, str) and new is not None:
        new = text
    if isinstance(old, tuple) and isinstance(new, list):
        new = tuple(new)
    if isinstance(old, float) and isinstance(new, int) and not isinstance(new, bool):
        new = float(new)
    if old is not None and new is not None and type(new) is not type(old):
        raise ValueError(f"{name} must be of type {type(old).__name__}, not {text!r}")
    return new


def overridden(config: T, arguments: Iterable[str] = (), environment: Mapping[str, str] | None = None, prefix: str = "QUERNWORKS_") -> T:
    """``config`` with fields from variables ``PREFIX_FIELD``, then from arguments ``field=value``.

    A field that there is not, and a value of another type, are errors; variables that name none are not.
    """
    if not is_dataclass(config):
        raise TypeError("settings are a dataclass")
    environment = os.environ if environment is None else environment
    names = {f.name: getattr(config, f.name) for f in fields(config)}
    given = {n: environment[prefix + n.upper()] for n in names if prefix + n.upper() in environment}
    for argument in arguments:
        name, sign, text = argument.partition("=")
        if not sign or name not in names:
            raise ValueError(f"no setting {argument!r}; there are {sorted(names)}")
        given[name] = text
    return replace(config, **{n: _value(t, n, names[n]) for n, t in given.items()})
