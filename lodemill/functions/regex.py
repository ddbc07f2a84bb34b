"""Python regular expressions as Spark ones.

Java needs flags to read a pattern as Python does: only ``\\n`` ends a line, classes and case are
Unicode's. ``\\Z`` and named groups are spelt differently.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = False, multiline: bool = False, dot_all: bool = False) -> str:
    flags = "dU" + ("i" if ignore_case else "") + ("m" if multiline else "") + ("s" if dot_all else "")
    body = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern.replace("(?P<", "(?<"))
    return f"(?{flags}){body}"


def found(text: Column, pattern: str, ignore_case: bool = True, **flags: bool) -> Column:
    """Whether the pattern occurs; a null text is empty."""
    return F.coalesce(text, F.lit("")).rlike(java(pattern, ignore_case, **flags))


def union(patterns: list[str]) -> str:
    """One alternation of several patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def matches(patterns: list[str], text: Column, ignore_case: bool = True) -> Column:
    """Whether any of the patterns occurs: one pass over the text."""
    return found(text, union(patterns), ignore_case)


def all_matches(text: Column, pattern: str, group: int = 0, **flags: bool) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(pattern, **flags)), F.lit(group))


def replaced(text: Column, pattern: str, by: str, **flags: bool) -> Column:
    return F.regexp_replace(text, java(pattern, **flags), by)
