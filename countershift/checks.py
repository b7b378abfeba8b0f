"""Checks of scalar arguments."""

from __future__ import annotations

import math
import numbers

from countershift.errors import DecompositionError

INT32 = 2**31 - 1


def integer(name: str, value, least: int = -INT32) -> int:
    ok = isinstance(value, numbers.Real) and not isinstance(value, bool) and math.isfinite(value) and value == int(value)
    if not ok or not least <= value <= INT32:
        raise DecompositionError(f"{name} must be an integer of at least {least}")
    return int(value)


def number(name: str, value, above: float = -math.inf, least: float = -math.inf, below: float = math.inf) -> float:
    ok = isinstance(value, numbers.Real) and not isinstance(value, bool) and math.isfinite(value)
    if not ok or not (value > above and value >= least and value < below):
        raise DecompositionError(f"{name} is out of range")
    return float(value)


def flag(name: str, value) -> bool:
    if not isinstance(value, bool):
        raise DecompositionError(f"{name} must be True or False")
    return value


def choice(name: str, value, options: tuple[str, ...]) -> str:
    if value not in options:
        raise DecompositionError(f"{name} must be one of {', '.join(options)}")
    return value


def probabilities(name: str, values) -> tuple[float, ...]:
    out = sorted({float(v) for v in ([values] if isinstance(values, numbers.Real) else values)})
    if not out or not all(math.isfinite(v) and 0 < v < 1 for v in out):
        raise DecompositionError(f"{name} must lie strictly between 0 and 1")
    return tuple(out)
