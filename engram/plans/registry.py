"""Names of operators, for calls by name; a later registration replaces an earlier one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_known: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, function: Callable[..., DataFrame]) -> None:
    _known[name] = function


def get(name: str) -> Callable[..., DataFrame] | None:
    return _known.get(name)


def names() -> list[str]:
    return sorted(_known)


def call(name: str, **arguments) -> DataFrame:
    """Arguments that the function doesn't take are dropped."""
    import inspect

    function = _known[name]
    taken = inspect.signature(function).parameters
    return function(**{k: v for k, v in arguments.items() if k in taken})
