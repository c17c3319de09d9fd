"""Checks of parameters; messages are part of the interface."""

from __future__ import annotations

import math

ALTERNATIVES = ("two-sided", "less", "greater")


def alternative(value: str) -> str:
    if value not in ALTERNATIVES:
        raise ValueError("alternative must be 'two-sided', 'less', or 'greater'")
    return value


def alpha(value: float, interval: bool = False) -> float:
    """``interval`` selects the wording of the correlation tests."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or not 0 < value < 1:
        raise ValueError("alpha must be in the open interval (0, 1)" if interval else "alpha must be between 0 and 1")
    return float(value)


def number(value: float, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a constant number")
    return float(value)


def flag(value: bool, name: str) -> bool:
    if not isinstance(value, bool):
        raise TypeError(f"{name} must be a constant boolean")
    return value


def quantile_type(value: int) -> int:
    if value not in (5, 7) or isinstance(value, bool):
        raise ValueError("quantile_type must be 5 (SAS) or 7 (R/Excel, default)")
    return value


BIN_METHODS = {"sturges": "sturges", "fd": "fd", "freedman-diaconis": "fd", "freedman_diaconis": "fd", "scott": "scott", "sqrt": "sqrt", "rice": "rice", "auto": "auto"}


def bin_method(value: str) -> str:
    if value is None:
        raise ValueError("'method' must not be NULL")
    if not isinstance(value, str):
        raise TypeError("'method' must be a constant string")
    if value.lower() not in BIN_METHODS:
        raise ValueError(f"bin_edges: unknown method '{value}'")
    return BIN_METHODS[value.lower()]


ADJUST_METHODS = ("bonferroni", "holm", "hochberg", "BH", "fdr", "BY", "none")


def adjust_method(value: str) -> str:
    if value not in ADJUST_METHODS:
        raise ValueError(f"adjust_p: unknown method '{value}'")
    return value
