"""Checks of arguments."""

from __future__ import annotations


def require(name: str, value: float, least: float | None = None, most: float | None = None) -> None:
    """Raise ValueError for a value outside its range."""
    if least is not None and value < least or most is not None and value > most:
        raise ValueError(f"{name} is {value}, not between {least} and {most}")
